import random

from hornbeam.llm import toxicity as X


def distance(a, b):
    """Edits with swaps of neighbours (optimal string alignment)."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def brute(terms, word):
    found = []
    for term, stem in terms:
        k = X.edits(term, stem)
        best = distance(term, word)
        if stem:
            best = min([best, *(distance(term, word[:n]) for n in range(1, len(word) + 1))])
        if best <= k:
            found.append((best, term))
    return (lambda e, t: (t, e))(*min(found)) if found else None


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    terms = [("moron", False), ("worthless", False), ("disgusting", False), ("scum", False), ("lowei", True), ("lostra", True), ("abab", False), ("ababab", False)]
    a = X.Automaton(terms)
    letters = "abdefgilmnorstuwx"
    for _ in range(4000):
        word = list(rng.choice(terms)[0])
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(word) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                word.insert(i, rng.choice(letters))
            elif kind == 1 and word:
                word.pop(i - 1)
            elif kind == 2 and word:
                word[i - 1] = rng.choice(letters)
            elif len(word) > 1 and 0 < i < len(word):
                word[i - 1], word[i] = word[i], word[i - 1]
        word = "".join(word)
        assert a.match(word) == brute(terms, word), word


def test_quotation_counts_less_than_abuse():
    scorer = X.Scorer({("moron", False): 3.0}, [-4.0, 2.0, 0.6, 0.1, 1.0, 0.3, 0.1, 0.5], frozenset(["maroon"]))
    plain, quoted, told = (scorer.score(t) for t in ("you are a moron and more", 'there was "you are a moron" and more', 'the report said "you are a moron" and more'))
    assert plain > quoted > told > scorer.score("you are kind and more")
    assert scorer.score("you are a mroon") > scorer.score("you are a macaroon")
    assert scorer.score("you are a maroon") == scorer.score("you are a macaroon")


def test_quotations_are_balanced():
    of = lambda t: X.quotation(t.split(), t.split().index(next(w for w in t.split() if "moron" in w)))
    inside = ['a "you moron" b', 'a "moron" b', '("moron", b', 'he "is a moron."', 'x « le moron » y', '“oh moron!” z', 'x " a moron " y']
    outside = ['wrote "fine" and moron came to "rome"', 'moron "rome"', '"fine" moron', '"never closed moron', 'moron', 'don\'t moron can\'t', '" a b c d e f g moron x"']
    assert [of(t) for t in inside] == [1] * len(inside) and [of(t) for t in outside] == [0] * len(outside)
    assert of('he said "a moron"') == 2


def test_the_model_learns_what_quotation_weighs(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = ["ta" + str(rng.randrange(60)) for _ in range(20)]
        kind = i % 4
        words[10] = ["vilewoord", '"vilewoord"', "ta1", "ta2"][kind]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = X.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), share=0.4)
    assert scorer.score("ta1 vilewoord ta2") > 0.9 and scorer.score('ta1 "vilewoord" ta2') < 0.1


def test_query_learns_outside_the_held_out_fold(spark, tmp_path):
    """The contract's columns, a fold of ids by crc32, and scores on the held-out part that labels there do not change."""
    import zlib

    rng = random.Random(7)
    common = ["ta" + str(i) for i in range(80)]
    rows, labels = [], []
    for i in range(800):
        bad = rng.random() < 0.25
        rows.append((i, " ".join(rng.choice(common) for _ in range(25)) + (" nastier ta1" if bad else ""), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    folds = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = []
    for k, flip in enumerate((False, True)):  # labels of the held-out fold are turned around
        spark.createDataFrame([(i, q, 1 - y if flip and folds[i] else y) for i, q, y in labels], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        out = X.op6_toxicity(spark, str(tmp_path)).collect()
        assert {r.doc_id: r.held_out for r in out} == folds and all(r.predicted == int(r.score >= 0.3) for r in out)
        got.append({r.doc_id: (round(r.score, 9), r.predicted) for r in out})
    assert got[0] == got[1]
    truth = {i: y for i, _, y in labels}
    assert sum(got[0][i][1] == truth[i] for i in folds if folds[i]) >= 0.98 * sum(folds.values())


def test_learns_and_scores(spark):
    rng = random.Random(1)
    common = ["ta" + str(i) for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        words, bad = [rng.choice(common) for _ in range(30)], rng.random() < 0.2
        if bad:
            words[rng.randrange(30)] = rng.choice(["vilewoord", "nastier"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "nastier " * 30_000, "x"), (1003, "ta1 vilewoord ta2", None), (1003, "ta1 vilewoord ta2", None), (1004, "ta1 vilewodr ta2", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    scorer = X.learn(docs, spark.createDataFrame([*labels, (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert {t for t, _ in scorer.lexicon} == {"vilewoord", "nastier"}
    out = X.score_documents(docs, scorer).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    truth = {i: y for i, _, y in labels}
    assert all(r.predicted == truth[r.doc_id] for r in out if r.doc_id in truth)
    by = {r.doc_id: r for r in out}
    assert [by[i].predicted for i in (1000, 1001, 1002, 1003, 1004)] == [0, 0, 1, 1, 1]


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scorer = X.learn(docs, none)
    assert X.score_documents(docs, scorer).first().predicted == 0
    assert X.score_documents(docs.limit(0), scorer).count() == 0
