import random

import numpy as np

from hornbeam.llm import mixing as M


def fixture(spark, n=400):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        kind = rng.choices(M.DOMAINS, [0.6, 0.25, 0.15])[0]
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(40)) for _ in range(rng.randrange(20, 80))]
        if kind == "low":
            words = [w + rng.choice(["%%%", "***"]) for w in words]
        if kind == "toxic":
            words[3] = "vile"
        rows.append((i, " ".join(words), "s" if i % 3 else None, 1.5))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    rows += [(5000, None, "s", 1.5), (5001, "", "s", 1.5), (5002, "alpha1 " * 30_000, "s", 1.5), (3, rows[3][1], "s", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double")
    return docs, spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), labels


def test_rates_solve_the_least_squares_problem(spark):
    docs, labels, truth = fixture(spark)
    target = M.Target({"high": 0.5, "low": 0.3, "toxic": 0.2}, close=1e-9)
    out = M.mix(docs, labels, target).collect()
    assert len(out) == docs.count() and all(r.rate >= 0 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[5000].rate == by[5001].rate == 1.0 and by[5000].n_tokens == 0 and by[5002].n_tokens == 30_000
    right = sum(M.DOMAINS[int(np.argmax(by[i].posterior))] == ("toxic" if t else "high" if q else "low") for i, q, t in truth)
    assert right > 0.95 * len(truth)
    used = [r for r in out if r.n_tokens]
    n = np.array([r.n_tokens for r in used], float)
    p, w = np.array([r.posterior for r in used]), n / n.sum()
    goal, r = np.array([0.5, 0.3, 0.2]), np.ones(len(used))
    g = (w[:, None] * p * p).sum(0)
    for _ in range(20_000):  # plain projected gradient, to the end
        r = np.maximum(0, r - 0.3 * (p @ ((p.T @ (w * r) - goal) / g) + target.penalty * (r - 1)))
    assert np.abs(p.T @ (w * r) - goal).max() < 0.02
    assert np.allclose(r, [x.rate for x in used], atol=5e-2)
    assert np.allclose(p.T @ (w * np.array([x.rate for x in used])), p.T @ (w * r), atol=5e-3)


def test_rates_stay_nonnegative_where_a_target_is_zero(spark):
    docs, labels, _ = fixture(spark, 120)
    out = M.mix(docs, labels, M.Target({"high": 1.0, "low": 0.0, "toxic": 0.0}, close=1e-5)).collect()
    assert min(r.rate for r in out) < 0.2
    assert all(r.rate >= 0 for r in out)


def test_no_labels_and_empty_tables(spark):
    docs, labels, _ = fixture(spark, 30)
    out = M.mix(docs, labels.limit(0)).collect()
    assert all(abs(x - 1 / 3) < 1e-9 for r in out for x in r.posterior)
    assert M.mix(docs.limit(0), labels).count() == 0


def test_query_equals_a_plain_classifier(spark, tmp_path):
    """Posteriors by Gaussian naive Bayes worked out text by text, and rates that solve the least squares problem."""
    import math
    import re
    import zlib

    docs, labels, truth = fixture(spark, 300)
    docs = docs.filter("doc_id <> 3")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in M.op5_source_mixing(spark, str(tmp_path)).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    learned = {i: "toxic" if t else "high" if q else "low" for i, q, t in truth if i in texts and zlib.crc32(str(i).encode()) % 4 != 2}
    words = {i: [w.rstrip(".,;:!?") for w in t.lower().strip(" \n.,;:!?").split()] for i, t in texts.items()}
    held = {}
    for i, d in learned.items():
        for w in set(words[i]):
            held.setdefault(w, dict.fromkeys(M.DOMAINS, 0))[d] += 1
    held = {w: c for w, c in held.items() if sum(c.values()) >= 5}
    size = {d: sum(x == d for x in learned.values()) for d in M.DOMAINS}
    marks = {d: set() for d in M.DOMAINS}
    for w, c in held.items():
        for d in M.DOMAINS:
            a, b = (c[d] + 0.5) / (size[d] + 1), (sum(c.values()) - c[d] + 0.5) / (len(learned) - size[d] + 1)
            if c[d] >= 0.01 * size[d] and a > 4 * b and c[d] * math.log(a / b) > math.log(2 * len(held)):
                marks[d].add(w)

    def figures(i):
        t, w = texts[i], words[i]
        n = max(len(t), 1)
        x = [math.log1p(1000 * len(re.findall(r"[#*$%&|<>!]", t)) / n), math.log1p(100 * len(re.findall("[A-Z]{2,}", t)) / n), math.log1p(len(w)), len(set(w)) / max(len(w), 1), len(set(t.split("\n"))) / len(t.split("\n"))]
        return x + [min(len(marks[d] & set(w)), 3) for d in M.DOMAINS if marks[d]]

    x = {i: np.array(figures(i)) for i in texts}
    stats = {d: (math.log(size[d] / len(learned)), (a := np.array([x[i] for i in learned if learned[i] == d])).mean(0), a.var(0) + 1e-2) for d in M.DOMAINS}
    assert "vile" in marks["toxic"]
    for i, r in out.items():
        z = np.array([p - ((x[i] - m) ** 2 / (2 * v) + 0.5 * np.log(v)).sum() for p, m, v in (stats[d] for d in M.DOMAINS)])
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose([r.p_high, r.p_low, r.p_toxic], want, atol=1e-6), i
        assert r.n_tokens == len(words[i])
    n = np.array([r.n_tokens for r in out.values()], float)
    got = np.array([[r.p_high, r.p_low, r.p_toxic] for r in out.values()])
    assert np.allclose(got.T @ (n / n.sum() * np.array([r.rate for r in out.values()])), [0.88, 0.09, 0.03], atol=0.02)


def test_columns_with_clashing_names_pass_through(spark):
    docs, labels, _ = fixture(spark, 60)
    docs = docs.selectExpr("doc_id", "text", "doc_id AS w", "text AS a", "1 AS words", "2 AS x", "3 AS n_tokens")
    model = M.learn(docs, labels)
    members = M.stored(M.posteriors(docs, model))
    out = M.with_rates(members, M.fit_rates(members), M.Target())
    assert out.columns == [*docs.columns, "posterior", "rate"]
    assert all((r.w, r.a, r.words, r.x) == (r.doc_id, r.text, 1, 2) for r in out.collect())
