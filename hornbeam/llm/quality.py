"""Quality rules, with cross-document line frequency.

Normalised lines are hashed; for each host, the distinct documents (ids) that hold a line are counted. Lines
above the limits are removed, and documents that this leaves depleted are rejected. The limit is a share of
the host's documents, the same at every size; a few documents are needed in any case, so that small hosts keep their lines.

Style: DataFrame functions only. What a rule needs of a text is computed in the scan; only hashes of
lines (24 bytes each) are shuffled, summed on the map side first, and texts never are.

Defined cases: a null text has no words and fails; a null host is a host of its own; rows with one id are one
document for a line, so a repeated row never makes its own lines frequent, but copies under other ids do; rows without an id are
one document for each different text; a document is rejected
only by lines that others have; ties do not arise (counts are compared with limits); other columns stay
out of the report; an empty table gives an empty report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm.common import GAP, stored, table

SPACES = "\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class Limits:
    """A line goes if more than ``share`` of its host's documents have it, and ``docs`` of them at least."""

    docs: int = 5
    share: float = 0.03
    #: A document is depleted if the removed lines held so many of its words.
    depleted: float = 0.7
    #: The base rules.
    words: int = 20
    repeated: float = 0.3
    window: int = 8


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare != "", F.split(bare, GAP)).otherwise(F.array().cast("array<string>"))


def with_repeats(df: DataFrame, words: str, window: int) -> DataFrame:
    """Adds n_repeat_words: words in runs of ``window`` words that the text holds twice or more."""
    n = F.size(words)
    df = df.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w)))
    run = lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(window)])
    df = df.withColumn("__runs", F.when(n > window, F.transform(F.sequence(F.lit(0), n - window), run)))
    # most texts repeat no run; only the others pay for positions
    df = df.withColumn("__sorted", F.when(F.size(F.array_distinct("__runs")) < F.size("__runs"), F.sort_array(F.transform("__runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: (F.get("__sorted", k - 1)["h"] == x["h"]) | (F.get("__sorted", k + 1)["h"] == x["h"])
    df = df.withColumn("__at", F.sort_array(F.transform(F.filter("__sorted", lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, i: F.struct((i + window).alias("end"), (s["n"] + i + window - F.greatest(i, s["end"])).alias("n"))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate("__at", start, step, lambda s: s["n"]), F.lit(0)).cast("long")).drop("__h", "__runs", "__sorted", "__at")


def features(docs: DataFrame, limits: Limits, host: str = "source", text: str = "text") -> DataFrame:
    """One row for each document: the base figures, a hash of the text, and the lines (key, words, number)."""
    df = docs.select("doc_id", F.col(host).alias("__host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    df = df.withColumn("__words", words_of(F.col("__text")))
    df = df.withColumn("__lines", F.split("__text", "\n", -1))
    df = df.withColumn("__full", F.filter("__lines", lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    norm = lambda x: F.lower(F.regexp_replace(F.btrim(x, F.lit(SPACES)), GAP, " "))
    df = with_repeats(df, "__words", limits.window)
    return df.select(
        "doc_id",
        F.col("__host").alias("host"),
        F.xxhash64("__text").alias("print"),
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.filter(
            F.transform("__lines", lambda x, i: F.struct(F.xxhash64(F.col("__host"), norm(x)).alias("line"), F.size(words_of(x)).alias("words"), i.alias("at"))),
            lambda x: x["words"] > 0,
        ).alias("lines"),
    )


def frequent_lines(feats: DataFrame, limits: Limits) -> DataFrame:
    """Keys of the lines above the limits; a key holds host and line."""
    document = F.coalesce("doc_id", "print").alias("document")
    hosts = feats.groupBy("host").agg(F.countDistinct(document).alias("in_host"))
    each = feats.select("host", document, F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counted = each.groupBy("line", "document").agg(F.first("host").alias("host")).groupBy("line").agg(F.count("*").alias("n"), F.first("host").alias("host"))
    counted = counted.filter(F.col("n") >= limits.docs)
    return counted.join(hosts, counted.host.eqNullSafe(hosts.host)).filter(F.col("n") > limits.share * F.col("in_host")).select("line")


def report(docs: DataFrame, limits: Limits = Limits(), host: str = "source", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, the base figures, base_failed, removed (line numbers), n_words_left, kept."""
    feats = stored(features(docs, limits, host, text).withColumn("__row", F.monotonically_increasing_id()))  # fixed once stored
    rows = feats.select("__row", F.explode("lines").alias("x")).select("__row", F.col("x.line").alias("line"), F.col("x.words").alias("words"), F.col("x.at").alias("at"))
    gone = rows.join(frequent_lines(feats, limits), "line", "left_semi").groupBy("__row").agg(F.sort_array(F.collect_set("at")).alias("removed"), F.collect_set(F.struct("at", "words")).alias("__cut"))
    done = feats.join(gone, "__row", "left")
    cut = F.aggregate(F.coalesce("__cut", F.array().cast("array<struct<at:int,words:int>>")), F.lit(0), lambda s, x: s + x["words"])
    failed = (F.col("n_words") < limits.words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * round(100 * limits.repeated))
    done = done.withColumn("n_words_left", (F.col("n_words") - cut).cast("long"))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), "n_words_left",
        (~failed & ~((F.col("n_words_left") < F.col("n_words")) & (F.col("n_words_left") <= (1 - limits.depleted) * F.col("n_words")))).alias("kept"),
    )


def filter_documents(docs: DataFrame, limits: Limits = Limits(), host: str = "source", text: str = "text") -> DataFrame:
    """The kept documents with their frequent lines removed from the text; needs unique ids."""
    verdict = report(docs, limits, host, text).filter("kept").select("doc_id", F.col("removed").alias("__gone"))
    left = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return docs.join(verdict, "doc_id").withColumn(text, F.when(F.size("__gone") > 0, left).otherwise(F.col(text))).select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return report(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g JOIN twice USING (doc_id, g)) GROUP BY 1),
l AS (SELECT doc_id, source, t, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw, lower(array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), ' ')) AS norm
      FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS l FROM d)),
hosts AS (SELECT source, count(DISTINCT doc_id) AS n FROM d GROUP BY 1),
freq AS (SELECT f.source, f.norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM l WHERE nw > 0 GROUP BY 1, 2) f
         JOIN hosts h ON h.source IS NOT DISTINCT FROM f.source WHERE f.n >= 5 AND f.n > 0.03 * h.n),
lines AS (SELECT l.doc_id, count(*) - count(DISTINCT l.l) AS dup, coalesce(sum(nw) FILTER (freq.norm IS NOT NULL), 0) AS cut
          FROM l LEFT JOIN freq ON l.source IS NOT DISTINCT FROM freq.source AND l.norm = freq.norm WHERE nw > 0 GROUP BY 1),
f AS (SELECT w.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(cut, 0) AS cut
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (cut > 0 AND n_words - cut <= 0.3 * n_words) AS kept FROM f
"""
