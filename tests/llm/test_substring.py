import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from hornbeam.llm import substring as S
from tests.llm import brute


@given(st.lists(st.text(alphabet="ab .!?\n\t,é\x1f"), max_size=4))
def test_cuts_and_runs_equal_the_plain_ones(texts):
    whole = [t * 9 for t in texts]
    first, of, start, h = S.cut([t.encode() for t in whole])
    a, e, x = S.runs(first, of, h)
    base = 0
    for k, t in enumerate(whole):
        pieces = brute.sentences(t)
        assert "".join(pieces) == (t if pieces else "") and (of == k).sum() == len(pieces)
        assert sorted((i - base, j - base) for i, j in zip(a.tolist(), e.tolist(), strict=True) if of[i] == k) == [r[:2] for r in brute.spans(pieces)]
        base += len(pieces)


def make(rng, n):
    return " ".join(("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) + ("." if rng.random() < 0.12 else "")) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    passage = make(rng, 70).replace(".", "") + ". " + make(rng, 30) + "."
    docs = {i: make(rng, rng.randrange(300)) for i in range(120)}
    for i in (5, 9, 60):
        docs[i] += ".\n" + passage + "\n" + make(rng, 40)
    return passage, docs | {200: docs[9], 201: "Same. " * 500, 202: "", 203: make(rng, 5000), 204: docs[5] + "x", 205: docs[7].upper()}


def test_equals_brute_force_and_catches_passages(spark, docs, monkeypatch):
    passage, docs = docs
    monkeypatch.setattr(S, "GROUP", 5000)
    monkeypatch.setattr(S, "FAN", 4)
    rows = [(i, t, "s", 1, "k") for i, t in docs.items()] + [(300, None, "s", 1, None), (9, docs[9], "s", 1, "k"), (None, docs[9], "s", 1, None)]
    out = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, key string, n_removed int, places string")).collect()
    assert len(out) == len(rows)
    want = brute.without_repeats(docs) | {300: (None, 0), None: (docs[9], 0)}
    for r in out:
        assert (r.text, r.n_removed) == want[r.doc_id], r.doc_id
    by = {r.doc_id: r for r in out}
    assert passage in by[5].text and by[0].text == docs[0]
    words = set(passage.split())
    for i in (9, 60):
        assert len(words & set(by[i].text.split())) < 0.25 * len(words)
    assert len(by[200].text) < 30 + 0.05 * len(docs[200])
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark, docs, tmp_path):
    spark.createDataFrame(list(docs[1].items()), "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.text, r.n_removed) for r in S.op2_substring_dedup(spark, str(tmp_path)).collect()} == brute.without_repeats(docs[1])


def test_passages_of_over_50_words_are_caught_wherever_they_stand():
    rng, whole, gone = random.Random(5), 0, 0
    for k in range(1500):
        plain = k % 2
        passage, *around = (make(rng, n) for n in (rng.randrange(51, 61), *(rng.randrange(5, 40) for _ in range(4))))
        passage = passage.replace(".", "") if plain else passage
        texts = [f"{a} {passage} {b}" for a, b in (around[:2], around[2:])]
        (f, of, _, h), n = S.cut([t.encode() for t in texts]), len(passage.split())
        a, e, x = S.runs(f, of, h)
        told = set(x[of[a] == 0].tolist())
        cut = {i for s, t, v in zip(a.tolist(), e.tolist(), x.tolist(), strict=True) if of[s] == 1 and v in told for i in range(s, t)}
        assert cut, texts
        whole += n
        gone += sum(int(f[i + 1] - f[i]) for i in cut)
    assert gone > 0.8 * whole


def test_the_last_sentences_of_a_passage_go():
    words = iter(range(1000))
    line = lambda n: " ".join(f"w{next(words)}" for _ in range(n)) + ". "
    passage = "".join(line(n) for n in (9, 9, 9, 9, 2, 2))
    texts = {i: line(9) + passage + line(9) for i in range(2)}
    assert brute.without_repeats(texts)[1][0] == texts[1].replace(passage, "")
