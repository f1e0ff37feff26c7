"""Secret scans with multipart credential linking.

Strong patterns are secrets by themselves. Weak candidates - an identifier, a short or unnamed secret,
an endpoint - are reported only where all three kinds of part meet: an interval join links each secret, weak or strong,
to identifiers and endpoints of its scope that are not farther than a window away. A scope is what stands between blank
lines of a document: a record, or a block of a configuration file.

Style: DataFrame functions only. Patterns run in one scan, whose spans are stored; only the parts of documents that have all
three kinds are shuffled. A join key is a scope and a stretch of its text, so its groups stay as small
as a stretch, however many parts a document has; the joins are semi-joins and emit no pairs.

Defined cases: a null text counts as empty and has no spans; repeated rows get the same spans; spans that
begin together go by kind as listed in KINDS; a linked part that overlaps a base span is not listed beside it; other columns pass
through, and only those named base and spans are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hornbeam.llm.common import stored, table, unused

#: Kinds in their order, with pattern, group to measure and least length of that.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # runs of under 16 are left out by the pattern: they are too many to list
    "identifier": (r"""((?i:access_?key_?id|client_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3),
    "weak_secret": (r"""((?i:password|passwd|secret|token|api_?key|pwd|pass|auth|client_?secret))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "endpoint": (r"""(?i:https?|jdbc:[a-z]+|postgres|mysql|redis|ftp)://([^\x20\x09-\x0D"'<>]+)""", 1, 4),
}
BASE = ("assign", "access", "hex")
WEAK = ("identifier", "weak_secret", "endpoint")
#: A blank line parts scopes.
BLANK = r"\n[\x20\t\r]*\n"
#: Matches whose places are summed at a time.
BLOCK = 256
#: Code points between the ends of parts that can belong together.
WINDOW = 400
SPAN = "array<struct<start:int,kind:int,end:int>>"


def running(sizes: Column) -> Column:
    """Running sums of an array of numbers, in blocks: appending one by one would copy the array each time."""
    one = lambda f, x: F.aggregate(x, F.struct(f.alias("at"), F.array().cast("array<int>").alias("out")), lambda s, y: F.struct((s["at"] + y).alias("at"), F.concat(s["out"], F.array(s["at"] + y)).alias("out")), lambda s: s["out"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda k: F.slice(sizes, k * BLOCK + 1, BLOCK))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y))
    begins = F.concat(F.array(F.lit(0)), one(F.lit(0), totals))
    return F.when(F.size(sizes) > 0, F.flatten(F.transform(blocks, lambda x, k: one(F.get(begins, k), x)))).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, group: int, least: int, number: int) -> Column:
    """Leftmost non-overlapping matches as spans (code points, end exclusive), those too short left out.

    What lies between matches is what splitting by the pattern leaves; running sums over gaps and
    matches give the places.
    """
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.char_length(x))
    part = whole if group == 0 else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.char_length(x))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, w: g + w))
    each = F.arrays_zip(ends.alias("end"), whole.alias("whole"), part.alias("part"))
    made = F.transform(F.filter(each, lambda x: x["part"] >= least), lambda x: F.struct((x["end"] - x["whole"]).alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), made.cast(SPAN)).otherwise(F.array().cast(SPAN))


def spans(text: Column, kind: str) -> Column:
    return matches(text, *KINDS[kind], list(KINDS).index(kind))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def linked_parts(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of parts (key, start, kind, end): the secrets with an identifier and an endpoint within the window, and those partners.

    The interval join: a left part stands in every stretch that it reaches, a right part in every one within
    the window of it, so all pairs that are close share (key, stretch); the distance is tested exactly.
    """
    number = {k: i for i, k in enumerate(KINDS)}
    of = lambda kinds: parts.filter(F.col("kind").isin(*[number[k] for k in kinds]))
    reach = lambda df, by: df.withColumn("stretch", F.explode(F.sequence(F.floor((F.col("start") - by) / window), F.floor((F.col("end") + by) / window))))
    close = (F.col("a.start") - F.col("b.end") <= window) & (F.col("b.start") - F.col("a.end") <= window)

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = reach(left, 0).alias("a"), reach(right, window).alias("b")
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.stretch") == F.col("b.stretch")) & close, "left_semi")
        return met.drop("stretch").distinct()  # a long part meets in several stretches

    # an access key is an identifier of its own, and a named secret needs no weak pattern
    identifiers, endpoints = of(("identifier", "access")), of(("endpoint",))
    secrets = meet(meet(of(("weak_secret", "assign")), identifiers), endpoints)
    return secrets.unionByName(meet(of(("identifier",)), secrets)).unionByName(meet(endpoints, secrets))


def find_secrets(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with base and spans: arrays of (start, kind number, end), ordered by start, then kind."""
    bare = F.coalesce(F.col(text).cast("string"), F.lit(""))
    weak, key = unused(docs, "weak"), unused(docs, "key")
    has = lambda *kinds: F.expr("false") if not kinds else bare.rlike(KINDS[kinds[0]][0]) | has(*kinds[1:])
    whole = has("endpoint") & has("weak_secret", "assign") & has("identifier", "access")
    parts = F.concat(*[spans(bare, k) for k in WEAK], matches(bare, BLANK, 0, 1, len(KINDS)))
    found = docs.withColumn("base", F.sort_array(F.concat(*[spans(bare, k) for k in BASE]))).withColumn(weak, F.when(whole, parts)).withColumn(key, F.monotonically_increasing_id())
    found = stored(found if keep_text else found.drop(text))  # every pattern is matched once, and the keys are fixed from here on
    overlaps = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    # parts that a base span covers link others too; they are only not reported twice
    each = found.filter(F.col(weak).isNotNull()).select(F.col(key).alias("key"), F.explode(F.concat(weak, F.filter("base", lambda x: x["kind"] < 2))).alias("x")).select("key", "x.start", "x.kind", "x.end")
    scope = F.sum(F.when(F.col("kind") == len(KINDS), 1).otherwise(0)).over(Window.partitionBy("key").orderBy("start"))
    scoped = each.withColumn("scope", scope).filter(F.col("kind") < len(KINDS)).select(F.struct("key", "scope").alias("key"), "start", "kind", "end").distinct()
    near, more = unused(found, "near"), unused(found, "more")
    added = linked_parts(scoped).groupBy(F.col("key.key").alias(near)).agg(F.collect_set(F.struct("start", "kind", "end")).alias(more))
    # only documents with weak parts meet the join
    plain = found.filter(F.col(weak).isNull()).withColumn("spans", F.col("base"))
    joined = found.filter(F.col(weak).isNotNull()).join(added, F.col(key) == F.col(near), "left").withColumn("spans", F.sort_array(F.concat("base", F.filter(F.coalesce(more, F.array().cast(SPAN)), lambda x: ~overlaps(x)))))
    out = [*[F.col(f"`{c}`") for c in docs.columns if c not in ("base", "spans") and (keep_text or c != text)], "base", "spans"]
    return plain.select(*out).unionByName(joined.select(*out))


def masked(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span replaced; spans that overlap are replaced together."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        gap = F.substr(text, s["at"] + 1, x["start"] - s["at"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["out"], gap, F.lit(mask))).otherwise(s["out"]).alias("out"))

    done = F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    return F.when(F.size(found) > 0, done).otherwise(text)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same for DuckDB; needs different ids."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    of = lambda k, p, g, least: f"""SELECT doc_id, {k} AS kind, i, length(gaps[i]) AS gap, length(w[i]) AS whole, length(v[i]) >= {least} AS kept FROM (
  SELECT doc_id, string_split_regex(t, {quoted(p)}) AS gaps, regexp_extract_all(t, {quoted(p)}) AS w, regexp_extract_all(t, {quoted(p)}, {g}) AS v, unnest(range(1, len(w) + 1)) AS i FROM t)"""  # noqa: E731
    each = [of(k, *how) for k, how in enumerate(KINDS.values())] + [of(len(KINDS), BLANK, 0, 1)]
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    close = lambda a, b: f"{a}.doc_id = {b}.doc_id AND {a}.scope = {b}.scope AND {a}.s - {b}.e <= {WINDOW} AND {b}.s - {a}.e <= {WINDOW}"
    told = "string_agg(kind_name || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(each)}),
ends AS (SELECT doc_id, kind, kept, whole, sum(gap + whole) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM m),
placed AS (SELECT doc_id, kind, e - whole AS s, e FROM ends WHERE kept),
x AS (SELECT *, sum(CASE WHEN kind = {len(KINDS)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS scope, list_extract({names}, kind + 1) AS kind_name FROM placed),
secret AS (SELECT * FROM x a WHERE kind IN (0, 4) AND EXISTS (SELECT 1 FROM x b WHERE b.kind IN (1, 3) AND {close("a", "b")}) AND EXISTS (SELECT 1 FROM x b WHERE b.kind = 5 AND {close("a", "b")})),
linked AS (SELECT * FROM secret UNION SELECT * FROM x a WHERE kind IN (3, 5) AND EXISTS (SELECT 1 FROM secret b WHERE {close("a", "b")})),
base AS (SELECT * FROM x WHERE kind < 3),
added AS (SELECT * FROM linked a WHERE kind > 2 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e)),
b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {told} AS told FROM base GROUP BY 1),
a AS (SELECT doc_id, {told} AS told FROM (FROM base UNION ALL FROM added) GROUP BY 1)
SELECT t.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b.told, '')) AS base_sha256, coalesce(a.told, '') AS spans
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""


OP9_SQL = _sql()
