"""Readers and writers of relations, by format name. A reader makes a lazy DataFrame (c0, c1, ...) of a schema's kinds; a
writer stores a derived relation. Both registries are open: ``register_reader``, ``register_writer``."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam import errors as E
from hornbeam.model import Const, Kind, Schema

#: Rows in one JSON text, about.
JSON_ROWS = 100_000

Reader = Callable[..., DataFrame]
Writer = Callable[..., None]


def read_csv(spark: SparkSession, path: str, schema: Schema, delimiter: str = ",", has_headers: bool = False) -> DataFrame:
    """Columns by position; a header is skipped. Lines that begin with # are comments, blanks around values are trimmed,
    and rows of another length or kind fail the job."""
    return spark.read.csv(path, schema=schema.spark(), sep=delimiter, header=has_headers, enforceSchema=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, quote='"', escape='"', mode="FAILFAST", nullValue="\x00")


def read_tsv(spark: SparkSession, path: str, schema: Schema, has_headers: bool = False) -> DataFrame:
    return read_csv(spark, path, schema, "\t", has_headers)


def read_json(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """A file holds an array of arrays, by position. Values must be of the declared kinds."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.expr("CAST(parse_json(value) AS ARRAY<VARIANT>)")).alias("r"))
    checked = rows.select("r", F.expr("CAST(r AS ARRAY<VARIANT>)").alias("a"))
    wrong = F.size("a") != schema.arity
    out = []
    shapes = {Kind.STRING: "STRING", Kind.INTEGER: "BIGINT", Kind.BOOLEAN: "BOOLEAN", Kind.FLOAT: "(DECIMAL.*|DOUBLE|FLOAT)"}
    for i, k in enumerate(schema.kinds):
        k = k or Kind.STRING
        wrong = wrong | ~F.schema_of_variant(F.get("a", i)).rlike(f"^{shapes[k]}$")
        out.append(F.expr(f"try_variant_get(a[{i}], '$', '{k.spark.simpleString()}')").alias(f"c{i}"))
    ok = F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.concat(F.lit("row does not conform to the schema: "), F.to_json("r")))).otherwise(F.lit(True))
    return checked.filter(ok.cast("boolean")).select(*out)


def read_parquet(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    df = spark.read.parquet(path)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def read_text(*_, **__) -> DataFrame:
    raise E.UnsupportedOperation("text tables are written, never read")


def write_csv(df: DataFrame, path: str, schema: Schema, delimiter: str = ",", has_headers: bool = True) -> None:
    """Plain values; the header is the label, or _, of each column."""
    heads = [a.label or "_" for a in schema.attributes]
    unique = [h if heads.count(h) == 1 else f"{h}{i}" if h != "_" else f"_{i}" for i, h in enumerate(heads)]
    df.toDF(*unique).write.mode("overwrite").csv(path, sep=delimiter, header=has_headers, quote='"', escape='"', emptyValue="")


def write_tsv(df: DataFrame, path: str, schema: Schema, has_headers: bool = True) -> None:
    write_csv(df, path, schema, "\t", has_headers)


def write_json(df: DataFrame, path: str, schema: Schema, pretty: bool = False) -> None:
    """Part files of arrays of arrays, each a JSON text of its own that ``read_json`` takes; written by the executors. ``pretty`` puts each value on a line."""
    first, between, last, row = ("[\n    ", ",\n    ", "\n  ]", "\n  ") if pretty else ("[", ",", "]", "")
    value = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", "$1")
    lines = df.select(F.concat(F.lit(row + first), F.concat_ws(between, *[value(c) for c in df.columns]), F.lit(last)).alias("r"))
    # one JSON text for each bounded group of rows, so no task holds a whole relation
    groups = max(1, -(-df.count() // JSON_ROWS))
    texts = lines.groupBy(F.pmod(F.xxhash64("r"), F.lit(groups)).alias("g")).agg(F.concat(F.lit("["), F.concat_ws(",\n" if not pretty else ",", F.collect_list("r")), F.lit("\n]" if pretty else "]")).alias("value")).select("value")
    texts.repartition(groups).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def render(schema: Schema, rows: list[tuple]) -> str:
    """A boxed table of a bounded number of rows."""
    heads = [str(a) for a in schema.attributes]
    cells = [[str(Const(v)) for v in r] for r in rows]
    wide = [max(map(len, column)) for column in zip(heads, *cells, strict=True)]
    line = "+".join(["", *["-" * (w + 2) for w in wide], ""])
    put = lambda r: "|".join(["", *[f" {c:<{w}} " for c, w in zip(r, wide, strict=True)], ""])
    return "\n".join([line, put(heads), line, *map(put, cells), line])


def write_text(df: DataFrame, path: str, schema: Schema) -> None:
    """Lines of a table, columns padded to the widest value, written by the executors; the first line of the order is the header."""
    shown = df.select(*[shown_value(F.col(c), k).alias(c) for c, k in zip(df.columns, schema.kinds, strict=True)])
    wide = shown.agg(*[F.max(F.char_length(c)) for c in shown.columns]).first()
    heads = [str(a) for a in schema.attributes]
    width = [max(len(h), w or 0) for h, w in zip(heads, wide, strict=True)]
    body = shown.select(F.lit(1).alias("o"), F.concat(F.lit("|"), *[F.concat(F.lit(" "), F.rpad(c, w, " "), F.lit(" |")) for c, w in zip(shown.columns, width, strict=True)]).alias("value"))
    line = "+" + "".join("-" * (w + 2) + "+" for w in width)
    top = df.sparkSession.createDataFrame([(0, "\n".join([line, "|" + "".join(f" {h:<{w}} |" for h, w in zip(heads, width, strict=True)), line])), (2, line)], "o int, value string")
    body.unionByName(top).repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def shown_value(c, kind: Kind | None):
    """A constant as the language writes it."""
    if kind in (None, Kind.STRING):
        quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.when(c.rlike(r"^[a-z]\w*(:[A-Za-z]\w*)?$") & ~c.isin("true", "false"), c).otherwise(quoted)
    return c.cast("string")


def write_parquet(df: DataFrame, path: str, schema: Schema) -> None:
    df.write.mode("overwrite").parquet(path)


READERS: dict[str, Reader] = {"csv": read_csv, "tsv": read_tsv, "json": read_json, "text": read_text, "parquet": read_parquet}
WRITERS: dict[str, Writer] = {"csv": write_csv, "tsv": write_tsv, "json": write_json, "text": write_text, "parquet": write_parquet}


def reader(name: str) -> Reader:
    if name not in READERS:
        raise E.UnknownFormat(name)
    return READERS[name]


def writer(name: str) -> Writer:
    if name not in WRITERS:
        raise E.UnknownFormat(name)
    return WRITERS[name]


def register_reader(name: str, read: Reader) -> None:
    READERS[name] = read


def register_writer(name: str, write: Writer) -> None:
    WRITERS[name] = write


def print_relation(df: DataFrame, schema: Schema, form: str = "text", most: int | None = 1000) -> str:
    """Rows for the eye, as text, csv, json or pretty json; a last line of text tells how many are left out beyond ``most``
    (None: the whole relation, which must fit in the driver). For large relations use a writer."""
    rows = sorted(tuple(r) for r in (df if most is None else df.limit(most)).collect())
    if form in ("json", "pretty"):
        return json.dumps([list(r) for r in rows], ensure_ascii=False, indent=2 if form == "pretty" else None)
    if form == "text":
        out = render(schema, rows)
    elif form == "csv":
        out = "\n".join([",".join(a.label or "_" for a in schema.attributes), *[",".join(map(str, r)) for r in rows]])
    else:
        raise E.UnknownFormat(form)
    left = df.count() - len(rows) if most is not None and len(rows) == most else 0
    return f"{out}\n... and {left} more" if left else out
