"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, secrets are masked,
sources are mixed to target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``. Labels come from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm import bpe, credentials, jaccard, mixing, toxicity
from hornbeam.llm.common import DOCUMENT_COLUMNS, stored, table

#: What the mix should hold: documents of low quality and the toxic ones that are left get rates well below 1.
TARGET = mixing.Target({"high": 0.92, "low": 0.07, "toxic": 0.01}, size=0.95)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at or above the threshold go; the model learns from the labelled documents given."""
    scorer = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select(*DOCUMENT_COLUMNS), scorer, keep_text=True)
    return scored.filter("predicted = 0").select(*DOCUMENT_COLUMNS)


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with __key, which names one text: the id, and a hash for all but one of the texts of an id that has several; rows repeated by id and text are left out."""
    again = stored(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    once = docs.withColumn("__key", F.col("doc_id"))
    if again.isEmpty():
        return once
    several = docs.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]).withColumn("__print", F.xxhash64("text"))
    least = several.groupBy("doc_id").agg(F.min("__print").alias("__least"))
    key = F.when(F.col("__print") == F.col("__least"), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text"))
    several = several.join(least, "doc_id").withColumn("__key", key)
    return stored(once.join(again, "doc_id", "left_anti").select(*once.columns).unionByName(several.select(*once.columns)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links, one row stays, that with the smallest id; rows without an id stay.

    Of rows repeated by id and text, one stays. Each text of an id with several is a document of its own:
    one keeps the id as its key, the others take a hash of id and text, so texts that do not link all stay.
    """
    keyed = with_keys(docs.select(*DOCUMENT_COLUMNS))
    found = jaccard.jaccard_components(keyed.select(F.col("__key").alias("doc_id"), "text"), words=5, percent=80)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(gone, "__key", "left_anti").select(*DOCUMENT_COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced in the text; n_chars follows."""
    found = credentials.find_secrets(docs.select(*DOCUMENT_COLUMNS))
    done = found.withColumn("text", credentials.masked(F.col("text"), F.col("spans")))
    return done.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is used as often as its rate says: the whole part always, the rest by a hash of its id."""
    model = mixing.learn(docs, table(spark, sf_dir, "labels"))
    # stored before anything is derived from it: the fold over the rounds must not contain the classification
    members = stored(mixing.posteriors(docs.select(*DOCUMENT_COLUMNS), model))
    report = mixing.fit_rates(members.select("n_tokens", "posterior"), TARGET)
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.col("rate") + 1 - chance).cast("int")
    return mixing.with_rates(members, report, TARGET).withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select(*DOCUMENT_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    import public_tokenizers

    made = bpe.encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("ids", "n_tokens", "decoded_sha256"))
    return made.select("doc_id", "source", "ids", "n_tokens", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secret scan", mask_secrets),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Two stages learn models and one encodes; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
