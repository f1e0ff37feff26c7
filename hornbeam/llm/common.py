"""What the operators share: reading tables, shared storage, bounded broadcasts, components of a graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.plans.storage import folder

#: The ASCII white space that ends a word in the contracts of the operators.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Columns of the table ``documents``.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it again."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """At most about ``most`` labelled documents (doc_id, text, target) outside the held-out fold.

    The bound is by a threshold on a hash of the id, so the choice depends on ids alone. The chosen
    ids number at most about ``most``, which is why they may be broadcast to the scan of ``docs``. Of rows
    that share an id one stays, that with the least text.
    """
    rows = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(target).alias(target))
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first(target).alias(target))


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(id, component_id) of every node of ``links`` (a, b): the smallest id that links reach.

    Alternates large-star and small-star steps until no link changes; every step is a group-by
    on bounded rows, links to a hub are pre-aggregated by ``min`` before the shuffle, and each
    round is stored in the shared folder, so lineage stays short and a lost executor costs one round. The number of
    rounds is of the order of the square of the logarithm of the longest path.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        # large star: every neighbour above u, and u itself, is linked to the least of u and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: the lesser neighbours of u, and u itself, are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots).groupBy("id").agg(F.min("component_id").alias("component_id"))

