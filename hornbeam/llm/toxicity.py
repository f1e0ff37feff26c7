"""Toxicity: Levenshtein automata over a lexicon trie, with context windows that tell quotation from abuse.

The lexicon is learned: words, and stems that begin several words, whose documents are labelled toxic
far more often than chance allows. Their trie is intersected with a Levenshtein automaton (insertions,
deletions, substitutions, swaps of neighbours); the product is made deterministic as texts ask for it.
The window around a hit tells whether it stands inside quotation marks, and whether someone's speech is reported there; a
logistic model learns from the labels what hits weigh outside quotation, inside it, and inside a reported one.

Style: Python on Arrow batches; the automaton is a loop over characters. Nothing is shuffled but
the counts of the bounded training sample.

The lexicon and the words met in the sample are bounded by the sample, SAMPLE documents; which terms are taken is decided by tests
against chance, not by a number.

Defined cases: null and empty texts have no hits and get the score of a document without any; repeated
rows get the same score; labels that are null, or for the held-out fold, are not learned from; where no term
or no label is found the score is the share of toxic labels (0 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm.common import held_out, labelled_sample, stored, table

#: Labelled documents to learn from, at most about.
SAMPLE = 12_000
STEMS = range(4, 9)
#: Least share of toxic documents among those with a word, and with a stem.
SHARE, STEM_SHARE = 0.8, 0.5
#: Words left and right of a hit that its window holds.
WINDOW = 6
THRESHOLD = 0.3
#: Innocent neighbours in the sample beyond which a term is only matched as it is.
CROWD = 1
#: What each edit leaves of a hit's weight.
SLIP = 0.8
_EDGE = ".,;:!?()[]{}<>…\"'“”„«»‘’`*_~-"
#: Quotation marks (an apostrophe is none), what may follow a closing one, and words that report another's speech.
QUOTES = tuple("\"“”„«»")
_AFTER = ".,;:!?)]…"
REPORTS = frozenset("said says wrote called quote quoted word term dit écrit mot sagte schrieb wort dijo escribió palabra".split())
#: What the model has weights for, with the constant.
WEIGHTS = 8
#: A worker forgets the words it has judged beyond so many.
REMEMBERED = 300_000


def edits(term: str, stem: bool) -> int:
    """How many edits may separate a misspelling from a term; short terms have too many neighbours."""
    return 0 if len(term) < (6 if stem else 5) else 1 if stem or len(term) < 9 else 2


class Automaton:
    """The intersection of a lexicon trie with Levenshtein automata, made deterministic on demand.

    A state is a set of (trie node, edits so far, character owed by a swap). ``match`` gives the
    (term, edits) with the fewest edits, ties to the term with the highest odds and then to the one that sorts first, or None.
    """

    def __init__(self, terms: list[tuple[str, bool]], exact: frozenset[str] = frozenset(), odds: dict[str, float] | None = None):
        """exact: terms that allow no edit."""
        self.odds = odds or {}
        self.allowed = lambda term, stem: 0 if term in exact else edits(term, stem)
        self.next: list[dict[str, int]] = [{}]
        self.end: list[list[tuple[str, bool]]] = [[]]
        for term, stem in sorted(terms):
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.end.append([])
                node = self.next[node][c]
            self.end[node].append((term, stem))
        self.most = [0] * len(self.next)  # edits that some term below a node allows
        for node in reversed(range(len(self.next))):
            self.most[node] = max([self.allowed(*t) for t in self.end[node]] + [self.most[k] for k in self.next[node].values()], default=0)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.words: list[tuple | None] = []
        self.stems: list[tuple | None] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        todo = list(items)
        while todo:  # a letter of the term is missing
            node, e, owed = todo.pop()
            if not owed:
                for k in self.next[node].values():
                    if e < self.most[k] and (k, e + 1, "") not in items:
                        items.add((k, e + 1, ""))
                        todo.append((k, e + 1, ""))
        key = frozenset(items)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [((e, -self.odds.get(term, 0.0), term), stem) for node, e, owed in key if not owed for term, stem in self.end[node] if e <= self.allowed(term, stem)]
            self.words.append(min((x for x, _ in ends), default=None))
            self.stems.append(min((x for x, stem in ends if stem), default=None))
        return self.states[key]

    def _step(self, at: int, c: str) -> int:
        to = set()
        for node, e, owed in self.sets[at]:
            if owed:
                if c == owed:
                    to.add((node, e, ""))
                continue
            if e < self.most[node]:  # an extra letter
                to.add((node, e + 1, ""))
            for d, k in self.next[node].items():
                if c == d:
                    to.add((k, e, ""))
                elif e < self.most[k]:
                    to.add((k, e + 1, ""))
                if e < self.most[k] and c != d and c in self.next[k]:
                    to.add((self.next[k][c], e + 1, d))
        return self._state(to)

    def match(self, word: str) -> tuple[str, int] | None:
        at, best = self.start, None
        for c in word:
            step = self.steps[at].get(c)
            if step is None:
                step = self.steps[at][c] = self._step(at, c) if len(self.sets) < 50_000 or not self.sets[at] else self._fresh(at, c)
            at = step
            if self.stems[at] is not None and (best is None or self.stems[at] < best):
                best = self.stems[at]
            if not self.sets[at]:
                break
        else:
            if self.words[at] is not None and (best is None or self.words[at] < best):
                best = self.words[at]
        return (best[2], best[0]) if best else None

    def _fresh(self, at: int, c: str) -> int:
        """Forgets all states but the one at hand, to bound memory."""
        here = self.sets[at]
        self.states, self.sets, self.steps, self.words, self.stems = {}, [], [], [], []
        self.start = self._state({(0, 0, "")})
        return self._step(self._state(set(here)), c)


def _begins(word: str) -> bool:
    return word.lstrip("([")[:1] in QUOTES


def _ends(word: str) -> bool:
    return word.rstrip(_AFTER)[-1:] in QUOTES


def quotation(words: list[str], at: int) -> int:
    """What the window around a hit says: 0 (plain), 1 (inside quotation marks), 2 (there, and speech is reported).

    The nearest mark to the left must open and the nearest to the right must close, so a quotation that ended before the hit
    does not count, nor one that begins after it. A mark that stands alone is taken as the one looked for.
    """
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    left = _begins(words[at]) or next((len(w) == 1 or not _ends(w) for w in reversed(before) if _begins(w) or _ends(w)), False)
    right = _ends(words[at]) or next((len(w) == 1 or not _begins(w) for w in after if _begins(w) or _ends(w)), False)
    if not (left and right):
        return 0
    return 2 if any(w.strip(_EDGE) in REPORTS for w in (*before, *after)) else 1


class Scorer:
    """Hits of a lexicon in whole texts, their features, and the logistic model."""

    def __init__(self, lexicon: dict[tuple[str, bool], float], weights: list[float], innocent: frozenset[str] = frozenset(), exact: frozenset[str] = frozenset()):
        self.lexicon, self.weights, self.innocent, self.exact = lexicon, weights, innocent, exact
        self.odds = {term: w for (term, _), w in sorted(lexicon.items(), key=lambda x: x[1])}
        self.automaton = Automaton(list(lexicon), exact, self.odds)
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def __reduce__(self):
        return Scorer, (self.lexicon, self.weights, self.innocent, self.exact)

    def find(self, text: str | None) -> tuple[list[tuple[int, str, int, int]], int]:
        """(position, term, edits, quotation) of every hit, and the number of words."""
        words = (text or "").lower().split()
        distinct = set(words)
        for raw in distinct - self.clean:
            if raw not in self.hits:
                word = raw.strip(_EDGE)
                found = self.automaton.match(word)
                if found and not (found[1] and word in self.innocent):
                    self.hits[raw] = found
                else:
                    self.clean.add(raw)
        got = distinct.intersection(self.hits)
        out = [(i, *self.hits[w], quotation(words, i)) for i, w in enumerate(words) if w in got] if got else []
        if len(self.clean) > REMEMBERED:
            self.clean = set()
        if len(self.hits) > REMEMBERED:
            self.hits = {}
        return out, len(words)

    def features(self, text: str | None) -> list[float]:
        """1; the weight of hits by quotation, outside and inside; the strongest outside and inside; the density outside."""
        hits, n = self.find(text)
        sums, most = [0.0] * 3, [0.0] * 3
        for _, t, e, q in hits:
            sums[q] += SLIP**e
            most[q] = max(most[q], SLIP**e * self.odds[t])
        return [1.0, *map(math.log1p, sums), *most, math.log1p(100 * sums[0] / max(n, 1))]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps, with a ridge that keeps weights finite and a light prior for the intercept."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [0.5] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _terms(text: str | None) -> set[tuple[str, bool]]:
    words = {w.strip(_EDGE) for w in set((text or "").lower().split())}
    return {(w, False) for w in words if len(w) >= 3} | {(w[:k], True) for w in words for k in STEMS if len(w) > k}


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", share: float = SHARE) -> Scorer:
    """The lexicon and the model, from about SAMPLE labelled documents at most, outside the held-out fold.

    Term counts are summed by a group-by; the driver gets the number of terms, those that pass a test against
    chance, the sample's innocent neighbours of the chosen terms, and a handful of numbers
    for each document of the sample.
    """
    sample = labelled_sample(docs, labels, target, SAMPLE).select("text", F.col(target).cast("int").alias("y")).filter("y in (0, 1)")
    sample = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")
    sample = stored(sample)  # a lost executor does not cost the scan again
    sums = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    total, toxic = sum(sums.values()), sums.get(1, 0)
    if not toxic or toxic == total:
        rate = toxic / total if total else 0.0
        return Scorer({}, [math.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), *[0.0] * (WEIGHTS - 1)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                seen, bad = Counter(), Counter()
                for t, y in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    terms = _terms(t.as_py())
                    seen.update(terms)
                    if y:
                        bad.update(terms)
                keys = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([seen[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], names=["term", "stem", "n", "t"])

    found = sample.mapInArrow(count, "term string, stem boolean, n long, t long").groupBy("term", "stem").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    found = stored(found.filter("n > 1 OR NOT stem"))
    tested, base = max(2, found.filter("n > 1").count()), toxic / total
    part = (F.col("t") + 0.1) / (F.col("n") + 0.2)
    gain = F.col("t") * F.log(part / base) + (F.col("n") - F.col("t")) * F.log((1 - part) / (1 - base))
    # so many terms are tested that only a gain above log(2 * tested) is not chance
    least = F.when(F.col("stem"), STEM_SHARE).otherwise(share)
    rows = found.filter((F.col("n") > 1) & (part >= least) & (gain >= math.log(2 * tested))).withColumn("odds", F.log(part / (1 - part))).orderBy(F.desc("t"), "term", "stem").collect()
    terms = _choose([(r.term, r.stem, r.t, r.odds) for r in rows])
    sent = docs.sparkSession.sparkContext.broadcast(Scorer(terms, [0.0] * WEIGHTS))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(w, m[0]) for w in batch.column(0).to_pylist() if (m := sent.value.automaton.match(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.string()) for i in (0, 1)], names=["word", "term"])

    # a neighbour of a term that documents without the label use is a word of its own, and a term with
    # several such neighbours is too much like ordinary words for misspellings to be told from them
    pairs = found.filter(~F.col("stem") & (F.col("t") < share * F.col("n"))).select("term").mapInArrow(near, "word string, term string").toArrow()
    crowd = Counter(pairs["term"].to_pylist())
    innocent, exact = frozenset(pairs["word"].to_pylist()), frozenset(t for t, n in crowd.items() if n > CROWD)
    sent = docs.sparkSession.sparkContext.broadcast(Scorer(terms, [0.0] * WEIGHTS, innocent, exact))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [sent.value.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = sample.mapInArrow(describe, "x array<double>, y int").toArrow()
    x, y = np.array(got["x"].to_pylist()), got["y"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # sums do not depend on the order of tasks
    return Scorer(terms, _fit(x[order], y[order]), innocent, exact)


def _choose(rows: list[tuple[str, bool, int, float]]) -> dict[tuple[str, bool], float]:
    """Stems that begin at least three suspicious words, the shortest first, then words that no chosen stem begins."""
    words = [(t, o) for t, stem, _, o in rows if not stem]
    begun = Counter(w[:k] for w, _ in words for k in STEMS if len(w) > k)
    chosen: dict[tuple[str, bool], float] = {}
    for t, o in sorted(((t, o) for t, stem, _, o in rows if stem and begun[t] >= 3), key=lambda x: (len(x[0]), x[0])):
        if not any((t[:k], True) in chosen for k in STEMS if k < len(t)):
            chosen[t, True] = o
    for t, o in words:
        if not any((t[:k], True) in chosen for k in STEMS if k < len(t)):
            chosen[t, False] = o
    return chosen


def score_documents(docs: DataFrame, scorer: Scorer, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with score, predicted (score >= THRESHOLD) and hits; without its text unless ``keep_text``."""
    made = ["score", "predicted", "hits"]
    kept = [c for c in docs.columns if c not in made and (keep_text or c != text)]
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    head = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema] + ["score double", "predicted int", "hits int"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [t.as_py() for t in batch.column(len(kept))]
                scores = [sent.value.score(t) for t in texts]
                hits = [len(sent.value.find(t)[0]) if s >= THRESHOLD else 0 for s, t in zip(scores, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(hits, pa.int32())], names=[*kept, *made])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("__text")).mapInArrow(work, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = learn(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs.withColumn("held_out", held_out()), scorer)
