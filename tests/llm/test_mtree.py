import duckdb
import numpy as np
from pyspark.sql import functions as F

from hornbeam.llm import mtree as M


def brute(ids, vectors, q, own, k):
    s = [(-int(sum(int(a) * int(b) for a, b in zip(v, q, strict=True))), int(i)) for i, v in zip(ids, vectors, strict=True) if i != own]
    return sorted((-s, i) for s, i in sorted(s)[:k])


def test_tree_equals_brute_force():
    rng = np.random.default_rng(3)
    for scale, n in ((3, 2000), (40, 1500), (2**28, 300)):
        v = rng.integers(-scale, scale + 1, (n, 5))
        v[: n // 3] = v[0]  # ties
        ids = rng.permutation(10 * n)[:n]
        tree = M.MTree(ids, v)
        for j in rng.integers(0, n, 25):
            assert sorted(tree.search(v[j], int(ids[j]), 20)) == brute(ids, v, v[j], ids[j], 20)


def test_bounds_spare_computations(monkeypatch):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-5, 6, (500, 6)) + 100 * np.eye(6, dtype=int)[k] for k in range(6)])
    monkeypatch.setattr(M, "LEAF", 64)
    tree, seen = M.MTree(np.arange(3000), v), 0
    whole = tree.plain

    class Counted(np.ndarray):
        def __getitem__(self, rows):
            nonlocal seen
            out = np.asarray(whole)[rows]
            seen += len(out)
            return out

    tree.plain = whole.view(Counted)
    tree.search(v[0], 0, 20)
    assert 0 < seen < 1500


def test_query_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), 1) for i in range(400)] + [(i, [0.5] * 8, 1) for i in range(400, 600)]
    rows += [(600, None, 1), (620, [None, 1.0], 2), (640, [float("nan")] * 8, 3), (660, [float("inf")] * 8, 3), (680, [1.0, 2.0], 1), (681, [1.0, -2.0], 1), (None, [0.1] * 8, 1), (700, [], 1), (701, [], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in M.op7_exact_top_k(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = set(con.sql(M.OP7_SQL).fetchall())
    assert got == want and len(got) == 30 * 20 + 2


def test_many_pages_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "PAGE", 60)
    monkeypatch.setattr(M, "BLOCK", 7)
    rng = np.random.default_rng(5)
    v = rng.integers(-9, 10, (500, 4))
    v[:200] = v[0]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<long>")
    out = M.top_k(rows, rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v"), 9).collect()
    for q in range(0, 500, 20):
        assert sorted((r.score, r.vec_id) for r in out if r.query_id == q) == brute(range(500), v, v[q], q, 9)
    assert M.top_k(rows.limit(0), rows.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_queries_visit_only_shards_that_can_hold_their_best(spark, monkeypatch):
    monkeypatch.setattr(M, "PAGE", 50)
    rng = np.random.default_rng(8)
    far = 400 * np.eye(8, dtype=int)
    v = np.concatenate([far[k] + rng.integers(-4, 5, (100, 8)) for k in range(8)])
    rows = spark.createDataFrame([(i, x.tolist(), 8) for i, x in enumerate(v)], "vec_id long, v array<long>, dim int")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v", "dim")
    placed, sent = M.shards(rows, 5)
    n, routed = placed.select("shard").distinct().count(), M.routes(asked, sent, 5)
    assert n > 8 and routed.count() < 0.5 * n * asked.count() and routed.select("query_id").distinct().count() == 40
    out = M.top_k(rows, asked, 5).collect()
    for q in range(0, 800, 20):
        assert sorted((r.score, r.vec_id) for r in out if r.query_id == q) == brute(range(800), v, v[q], q, 5)


def test_lengths_outside_the_sample_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "SAMPLE_ROWS", 4)
    rows = [(i, list(range(1, 2 + i % 30))) for i in range(300)] + [(7, [3] * 3), (7, [3] * 3), (1000, [1, 1, 1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    out = M.top_k(df, df.filter("vec_id >= 280").withColumnRenamed("vec_id", "query_id"), 6).collect()
    for q, v in rows[280:300] + rows[-1:]:
        same = [r for r in rows if len(r[1]) == len(v)]
        assert sorted((r.score, r.vec_id) for r in out if r.query_id == q) == brute([r[0] for r in same], [r[1] for r in same], v, q, 6)
    assert [(r.rank, r.vec_id) for r in out if r.query_id == 1000][:2] == [(1, 7), (2, 7)]
