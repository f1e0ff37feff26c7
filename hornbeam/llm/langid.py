"""Language ID by multilingual mixture inference.

A document is a mixture of languages: its byte n-grams are drawn from language models in unknown
proportions. Expectation-maximisation finds the proportions; the set of languages is the one with
the highest penalised likelihood, grown from the best single language.

Style: numpy on Arrow batches, as EM is a loop over one document's n-grams. The models (a fixed number
of buckets for each learned language) are broadcast; documents are not shuffled.

Defined cases: a null text or a text without a letter is ``und`` with score 0; ties go to the language
that sorts first; repeated rows get the same answer; rows with a null language or id teach nothing;
with no labelled row at all every document is ``und``; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm.common import held_out, table

#: Buckets of n-grams, and how many bytes an n-gram has.
BUCKETS, GRAM = 1 << 16, 3
#: Documents that each language is learned from, at most about; languages beyond which ``learn`` refuses, as models are held whole.
SAMPLE, LANGUAGES = 5000, 500
#: What each further language has to gain, in nats: so much for each n-gram, besides the BIC term.
PER_GRAM = 0.01
ROUNDS = 12
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are not letters count as one space.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_SPACES = re.compile(rb" +")


def grams(text: str) -> np.ndarray:
    """The bucket of every n-gram of a whole text."""
    b = np.frombuffer(_SPACES.sub(b" ", b" " + text.lower().encode().translate(_FOLD) + b" "), np.uint8).astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


class Mixture:
    """Language models and the inference of proportions."""

    def __init__(self, names: list[str], counts: np.ndarray, docs: np.ndarray):
        self.names = names
        smooth = counts + 0.5
        self.p = np.ascontiguousarray((smooth / smooth.sum(1, keepdims=True)).T)  # buckets x languages
        self.log = np.log(self.p)
        self.prior = np.log((docs + 1) / (docs.sum() + len(names)))

    @staticmethod
    def proportions(p: np.ndarray, c: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """EM from equal shares: p is n-grams x languages, c the count of each n-gram."""
        share, n = np.full(p.shape[1], 1 / p.shape[1]), c.sum()
        for _ in range(rounds):
            share = share * ((c / (p @ share)) @ p) / n
        return share

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """The main language, its share, and the shares of the chosen set of languages."""
        if not self.names or not has_letter(text):
            return "und", 0.0, {}
        found = np.bincount(grams(text), minlength=BUCKETS)
        at = np.flatnonzero(found)
        c = found[at].astype(float)
        p, single = self.p[at], c @ self.log[at] + self.prior
        best = int(single.argmax())
        chosen, share, n = [best], np.ones(1), c.sum()
        every = self.proportions(p, c)
        value, most, price = c @ self.log[at, best], c @ np.log(p @ every), 0.5 * np.log(n) + PER_GRAM * n
        for i in np.argsort(-every, kind="stable"):
            if most - value <= price:  # no set gains more than all languages together
                break
            if i != best:
                more = self.proportions(p[:, [*chosen, i]], c, 2 * ROUNDS)
                gain = c @ np.log(p[:, [*chosen, i]] @ more) - value
                if gain > price:
                    chosen, share, value = [*chosen, i], more, value + gain
        main = min(range(len(chosen)), key=lambda k: (-share[k], self.names[chosen[k]]))
        return self.names[chosen[main]], float(min(1.0, max(0.0, share[main]))), {self.names[i]: float(s) for i, s in zip(chosen, share, strict=True)}


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> Mixture:
    """Models from the labelled rows outside the held-out fold.

    Each language learns from about SAMPLE documents at most, chosen by a hash of the id; what is
    collected has at most BUCKETS rows for each of LANGUAGES languages.
    """
    rows = docs.select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages are labelled: their models would not fit; leave some out or merge them")
    names = sorted(sizes)
    if not names:
        return Mixture([], np.zeros((0, BUCKETS)), np.zeros(0))
    limits = docs.sparkSession.createDataFrame([(i, n, int((1 << 20) * min(1, SAMPLE / sizes[n]))) for i, n in enumerate(names)], "at int, lang string, most int")
    sample = rows.join(F.broadcast(limits), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("most"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(i, np.zeros(BUCKETS, np.int64))
                sums[i] += np.bincount(grams(t.as_py()), minlength=BUCKETS)
        for i, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["at", "bucket", "n"])

    found = sample.select("at", "text").mapInArrow(count, "at int, bucket int, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), BUCKETS))
    np.add.at(counts, (found["at"].to_numpy(), found["bucket"].to_numpy()), found["n"].to_numpy())
    return Mixture(names, counts, np.array([float(sizes[n]) for n in names]))


def identify(docs: DataFrame, model: Mixture, text: str = "text") -> DataFrame:
    """``docs`` without its text, with lang_pred, score and lang_shares (the chosen languages' shares)."""
    made = ["lang_pred", "score", "lang_shares"]
    kept = [c for c in docs.columns if c not in (text, *made)]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    head = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema] + ["lang_pred string", "score double", "lang_shares map<string,double>"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                got = [sent.value.infer(t.as_py()) for t in batch.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([list(g[2].items()) for g in got], pa.map_(pa.string(), pa.float64()))], names=[*kept, *made])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("__text")).mapInArrow(work, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), learn(docs))
