import random

import numpy as np
import pytest

from hornbeam.llm import jaccard as J
from hornbeam.llm.common import smallest_reachable
from tests.llm import brute


def near(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = "new" + str(rng.randrange(10**6))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda: "w" + str(rng.randrange(3000))
    passage = [word() for _ in range(40)]
    docs = {}
    for i in range(60):
        docs[i] = " ".join([word() for _ in range(rng.randrange(5, 160))] + passage * (i % 3 == 0))
    base = [word() for _ in range(150)]
    for i in range(100, 150):  # near copies: links chain through the original
        docs[i] = " ".join(near(rng, base, rng.randrange(6)))
    docs |= {200 + i: docs[5] for i in range(20)}
    docs |= {300: None, 301: "", 302: " \t\n", 303: "One two", 304: "ONE  two\n", 305: "one two three", 306: "É a b c d", 307: "é a b c d", 308: "a b c d " * 6000, 309: "a b c d " * 7000}
    return docs


def test_equals_brute_force(spark, texts):
    rows = [(i, t, 1, "clash") for i, t in texts.items()] + [(5, texts[5], 1, "clash"), (None, "no id", 1, "clash")]
    out = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, token long, id string")).collect()
    assert len(out) == len(rows)
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    want = brute.components(sets)
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r
    assert 5 < len({want[i] for i in range(100, 150)}) < 45 and want[303] == want[304] != want[305]


def test_bounded_groups_cells_and_blocks_change_nothing(spark, texts, monkeypatch):
    """Many groups, dealt in two passes; lists of many cells; families of many blocks."""
    for name, value in {"GROUP": 3000, "FAN": 5, "CELL": 3, "FAMILY": 300}.items():
        monkeypatch.setattr(J, name, value)
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    want = brute.components(sets)
    out = J.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id: r.component_id for r in out} == want


def test_many_near_copies(spark):
    """One list of thousands of different sets: all pairs of them by a matrix product."""
    rng = random.Random(5)
    base = ["b" + str(i) for i in range(120)]
    texts = [" ".join(near(rng, base, rng.randrange(1, 5))) for _ in range(3000)]
    rows = [{t: 1 for t in J.tokens(x).tolist()} for x in texts]
    place = {t: k for k, t in enumerate(sorted(set().union(*rows)))}
    m = np.zeros((len(rows), len(place)), np.float32)
    for i, r in enumerate(rows):
        m[i, [place[t] for t in r]] = 1
    n = m.sum(1)
    overlap = m @ m.T
    linked = 100 * overlap >= 85 * (n[:, None] + n[None] - overlap)
    label, before = np.arange(len(rows)), None
    while before is None or (label != before).any():
        before = label
        label = np.where(linked, label[None], len(rows)).min(1)
    out = J.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(label.tolist())) and len(set(label.tolist())) > 1


def test_an_id_with_two_texts(spark, texts):
    out = J.jaccard_components(spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[1])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted((i, len(J.tokens(t)), 1) for i, t in ((1, texts[0]), (1, texts[1]), (2, texts[1])))


def test_lists_between_components(texts):
    """Block skipping loses no pair that links."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(60, 90))) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) > 0.05], rng.integers(400, 900, 3)])) for s in sets for _ in range(2)]
    rows = []
    for i, s in enumerate(sets):
        rows += [(int(t), len(s), k, i, i, i, len(s), False, 0, False) for k, t in enumerate(s[: J.prefix(len(s), 85)])]
    rows.sort(key=lambda r: r[:4])
    names = [c.split()[0] for c in J._CELL.split(", ")]
    kinds = [pa.bool_() if c.endswith("boolean") else pa.int64() for c in J._CELL.split(", ")]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + 37]], kinds[c]) for c in range(len(names))], names=names) for a in range(0, len(rows), 37)]
    found = {(x["a"], x["b"]) for b in J._between(85)(iter(batches)) for x in b.to_pylist()}
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - o)}
    assert links <= found and links


def test_query_equals_its_sql(spark, texts, tmp_path):
    brute.same_as_sql(spark, tmp_path, J.op4_ngram_jaccard, J.OP4_SQL, documents=spark.createDataFrame([(i, t) for i, t in texts.items() if len(t or "") < 10_000], "doc_id long, text string"))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    out = {r.id: r.component_id for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 130), 100)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
