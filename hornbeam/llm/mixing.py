"""Mixing sources to target weights by soft membership.

A classifier learned from the labelled table gives every document a posterior over domains. Each document
gets a nonnegative rate (how many times to use it), fitted so that the expected token totals of
the domains, sum over documents of rate x tokens x posterior, meet the targets:

    minimise  1/2 |G^-1/2 (A r - b)|^2 + penalty/2 |r - 1|^2   over r >= 0,

with one row of A for each domain and one column for each document; G, the diagonal of A A', weighs the
domains alike, small and large. The solver is accelerated projected gradient
descent. Its gradient needs only A r, one number for each domain: each round is one aggregation of a
narrow table, and the driver keeps the short history of residuals. The rate of a document is a fold over
that history, so no rates are stored between rounds and a lost executor loses nothing.

Style: DataFrame functions only.

Domains, from the labels: ``toxic`` (toxic = 1), ``low`` (quality = 0), ``high`` (quality = 1). The classifier is Gaussian naive
Bayes on figures of the whole text, and on how many of the words that mark a domain it holds; all are
learned from a bounded sample of labelled rows (SAMPLE).

Defined cases: null and empty texts have no tokens, keep rate 1 and are classified by the priors and their figures; rows with
null labels teach nothing; without labels all posteriors are equal; repeated rows get the same rate each; targets are
scaled to sum to 1, and a domain that no document belongs to leaves its target unmet; other columns pass
through; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm.common import GAP, labelled_sample, stored, table, unused
from hornbeam.llm.quality import SPACES

DOMAINS = ("high", "low", "toxic")
STOPS = ".,;:!?"
#: Labelled documents to learn from, at most about; the share of a domain's documents that have a word that marks it, at least.
SAMPLE, COMMON = 6000, 0.01


@dataclass(frozen=True)
class Target:
    weights: dict[str, float] = field(default_factory=lambda: {"high": 0.88, "low": 0.09, "toxic": 0.03})
    #: Total of expected tokens, as a multiple of the corpus.
    size: float = 1.0
    penalty: float = 1e-3
    rounds: int = 30
    #: The fit ends when no domain's residual moves by more than this part of the corpus.
    close: float = 1e-6


def plain_words(text: Column) -> Column:
    """Lower-cased words without the stops that end them."""
    bare = F.btrim(F.lower(text), F.lit(SPACES + STOPS))
    return F.when(bare != "", F.split(bare, f"[{STOPS}]*{GAP}")).otherwise(F.array().cast("array<string>"))


def figures(text: Column, words: Column, marks: dict[str, list[str]]) -> Column:
    """What the classifier sees of a whole text: an array of numbers, the last ones for the domains that have marks."""
    n = F.greatest(F.char_length(text), F.lit(1))
    count = F.greatest(F.size(words), F.lit(1))
    lines = F.split(text, "\n", -1)
    out = {
        "symbols": F.log1p(1000 * F.regexp_count(text, F.lit(r"[#*$%&|<>!]")) / n),
        "capitals": F.log1p(100 * F.regexp_count(text, F.lit(r"[A-Z]{2,}")) / n),
        "length": F.log1p(F.size(words)),
        "repeats": F.size(F.array_distinct(words)) / count,
        "lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }
    among = lambda terms: lambda w: w.isin(terms)  # noqa: E731  a constant set
    told = [terms for terms in marks.values() if terms]
    if not told:
        return F.array(*[c.cast("double") for c in out.values()])
    # marking words are found once for all domains: the inner counts share what the outer step has found
    met = F.array(F.filter(F.array_distinct(words), among(sorted({t for terms in told for t in terms}))))
    counts = F.transform(met, lambda m: F.array(*[F.least(F.size(F.filter(m, among(t))), F.lit(3)).cast("double") for t in told]))
    return F.concat(F.array(*[c.cast("double") for c in out.values()]), F.get(counts, 0))


@dataclass(frozen=True)
class Classifier:
    marks: dict[str, list[str]]
    #: For each domain: log prior, and mean and variance of each figure.
    stats: dict[str, tuple[float, list[tuple[float, float]]]]

    def posteriors(self, values: Column) -> Column:
        """An array of one probability for each of DOMAINS, from an array of figures."""
        if not self.stats:
            return F.array(*[F.lit(1 / len(DOMAINS))] * len(DOMAINS))
        logs = []
        for d in DOMAINS:
            prior, each = self.stats.get(d, (-math.inf, []))
            z = F.lit(max(prior, -60.0))
            for i, (mean, var) in enumerate(each):
                x = F.get(values, i) - F.lit(mean)
                z = z - x * x / F.lit(2 * var) - F.lit(0.5 * math.log(var))
            logs.append(z)
        raw = F.array(*logs)
        exps = F.transform(raw, lambda z: F.exp(z - F.array_max(raw)))
        total = F.aggregate(exps, F.lit(0.0), lambda a, b: a + b)
        return F.transform(exps, lambda e: e / total)


def domain_of() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """From about SAMPLE labelled rows at most; the driver gets the words that mark a domain in them, and a few sums for each domain."""
    domains = labels.withColumn("domain", domain_of())
    sample = stored(labelled_sample(docs, domains, "domain", SAMPLE).withColumn("words", plain_words(F.coalesce(F.col("text"), F.lit("")))))
    sizes = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    if not total:
        return Classifier({}, {})
    # a word marks a domain if far more of its documents hold it than of the others, by more than chance among so many words;
    # words of a few documents and their copies say little of others
    held = sample.select("domain", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS], F.count("*").alias("n")).filter("n >= 5 AND word <> ''")
    held = stored(held)
    marks, chance = {}, math.log(2 * max(held.count(), 1))
    for d in DOMAINS:
        if 0 < (k := sizes.get(d, 0)) < total:
            inside, outside = (F.col(d) + 0.5) / (k + 1), (F.col("n") - F.col(d) + 0.5) / (total - k + 1)
            gain = F.col(d) * F.log(inside / outside)
            marks[d] = [r.word for r in held.filter((F.col(d) >= COMMON * k) & (inside > 4 * outside) & (gain > chance)).select("word").orderBy("word").collect()]
    seen = stored(sample.select("domain", figures(F.coalesce("text", F.lit("")), F.col("words"), marks).alias("x")))
    n = 5 + sum(bool(m) for m in marks.values())
    cols = [a for i in range(n) for a in (F.avg(F.get("x", i)).alias(f"m{i}"), F.var_pop(F.get("x", i)).alias(f"v{i}"))]
    rows = {r.domain: r for r in seen.groupBy("domain").agg(*cols).collect()}
    stats = {d: (math.log(sizes[d] / total), [(r[f"m{i}"], r[f"v{i}"] + 1e-2) for i in range(n)]) for d, r in rows.items()}
    return Classifier(marks, stats)


def posteriors(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words) and posterior (an array as DOMAINS)."""
    bare = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words, x = unused(docs, "words"), unused(docs, "x")
    df = docs.withColumn(words, plain_words(bare))
    df = df.withColumn(x, figures(bare, F.col(words), model.marks) if model.stats else F.array().cast("array<double>"))
    return df.withColumn("n_tokens", F.size(words).cast("long")).withColumn("posterior", model.posteriors(F.col(x))).drop(words, x)


def _fold(a: Column, w: Column, history: list[list[float]], momentum: list[float], step: float, penalty: float) -> Column:
    """The (rate, point) of a document after the rounds so far; ``a`` is its column of A, ``w`` its part of all tokens."""
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("point"))
    if not history:
        return start
    told = json.dumps([{"u": us, "m": m} for us, m in zip(history, momentum, strict=True)])
    rounds = F.from_json(F.lit(told), "array<struct<u:array<double>,m:double>>")  # one literal, however many rounds

    def go(s: Column, x: Column) -> Column:
        slope = F.aggregate(F.zip_with(a, x["u"], lambda p, u: p * u), F.lit(0.0), lambda p, q: p + q) + F.lit(penalty) * w * (s["point"] - 1.0)
        rate = F.greatest(F.lit(0.0), s["point"] - F.lit(step) * slope / w)
        return F.struct(rate.alias("rate"), (rate + x["m"] * (rate - s["rate"])).alias("point"))

    return F.aggregate(rounds, start, go)


def fit_rates(members: DataFrame, target: Target = Target()) -> dict:
    """The rounds of the fit for ``members`` (n_tokens, posterior): what ``_fold`` needs, and the last residual.

    Documents are scaled by w = tokens / total (steps and penalty are for each token, so long documents do not
    move further than short ones): a = w x posterior, and the Hessian in that scale is at most
    the largest row sum of G^-1/2 A A' G^-1/2, plus the penalty, which gives the step.
    """
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return {"residual": [0.0] * len(DOMAINS), "rounds": 0, "total": 0, "converged": True}
    weights = [max(0.0, target.weights.get(d, 0.0)) for d in DOMAINS]
    goal = [target.size * x / (sum(weights) or 1.0) for x in weights]
    w = F.greatest(F.col("n_tokens") / F.lit(float(total)), F.lit(1e-300))
    rows = members.filter("n_tokens > 0").select(w.alias("w"), F.transform("posterior", lambda p: p * w).alias("a"))
    gram = rows.agg(*[F.sum(F.get("a", i) * F.get("a", j) / F.col("w")) for i in range(len(DOMAINS)) for j in range(len(DOMAINS))]).first()
    k = len(DOMAINS)
    g = [max(gram[i * k + i], 0.0) for i in range(k)]
    back = [1 / x if x > 1e-12 else 0.0 for x in g]  # a domain without members cannot be met
    top = max(sum(abs(gram[i * k + j]) * math.sqrt(back[i] * back[j]) for j in range(k)) for i in range(k))
    step = 1.0 / (top + target.penalty)
    history: list[list[float]] = []
    momentum: list[float] = []
    t, residual, before, settled = 1.0, [0.0] * len(DOMAINS), None, False
    for _ in range(target.rounds):
        at = rows.withColumn("s", _fold(F.col("a"), F.col("w"), history, momentum, step, target.penalty))
        got = at.agg(*[F.sum(F.get("a", i) * F.col("s.point")) for i in range(len(DOMAINS))]).first()
        residual = [g - b for g, b in zip(got, goal, strict=True)]
        ahead = (1 + math.sqrt(1 + 4 * t * t)) / 2
        history.append([r * b for r, b in zip(residual, back, strict=True)])
        momentum.append((t - 1) / ahead)
        t = ahead
        if before and max(abs(a - b) for a, b in zip(residual, before, strict=True)) < target.close:
            settled = True
            break
        before = residual
    return {"residual": residual, "rounds": len(history), "total": total, "converged": settled, "history": history, "momentum": momentum, "step": step, "goal": goal}


def mix(docs: DataFrame, labels: DataFrame, target: Target = Target(), text: str = "text") -> DataFrame:
    """doc_id, source, n_tokens, posterior and rate of every row of ``docs``."""
    keep = [c for c in ("doc_id", "source") if c in docs.columns]
    members = stored(posteriors(docs.select(*keep, F.col(text).alias("__text")), learn(docs, labels), "__text").drop("__text"))
    return with_rates(members, fit_rates(members, target), target)


def with_rates(members: DataFrame, report: dict, target: Target, rate: str = "rate") -> DataFrame:
    """``members`` (n_tokens, posterior and any other columns), which should be stored, with the rate that the rounds of a fit give."""
    if not report["rounds"]:
        return members.withColumn(rate, F.lit(1.0))
    own = F.greatest(F.col("n_tokens") / F.lit(float(report["total"])), F.lit(1e-300))
    fold = _fold(F.transform("posterior", lambda p: p * own), own, report["history"], report["momentum"], report["step"], target.penalty)
    return members.withColumn(rate, F.when(F.col("n_tokens") > 0, fold["rate"]).otherwise(1.0))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "source", "n_tokens", *[F.get("posterior", i).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate")
