"""Exact top-k search by inner product: M-trees, searched best-first.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm of its tree; a query gets
0 there. Then the Euclidean distance falls as the inner product rises, and an M-tree applies: pages of
metric nodes with a routing vector, a covering radius and the distance to the parent's routing vector.
The search takes nodes by their least possible distance and stops at the k-th best; stored
distances and the triangle inequality spare the computation of most others. Floats only
choose what to visit (with a margin); the scores themselves are integers.

Layout: vectors are dealt to shards by the nearest of a bounded number of pivots; a shard is a node at the top, with its pivot
as routing vector and a covering radius. Each query first learns a floor for its k-th score from a bounded sample, and goes only to
shards that can hold a score as good: q x <= q p + |q| radius. Shards above the page limit are split by a hash, and the queries of a
shard come in blocks. A task holds one shard page and one block of queries, both of bounded size, builds its tree
and returns at most k rows for each query; the best k of all shards follow.

Style: numpy in Arrow groups; best-first search has no SQL form.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows
with a null id; a query meets only vectors of its own length; ties go to the smaller id; rows of a repeated id are
candidates each, also if they hold the same, so an id can take several ranks, and no row of the query's own id is its candidate; a
query id with several vectors asks with each, and its results are ranked together; the empty vector scores 0 with
its like; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hornbeam.llm.common import stored, table

#: Vectors in a leaf page, in a shard page, and queries in a block.
LEAF, PAGE, BLOCK = 512, 20_000, 5_000
#: Bytes of the sample that floors are taken from, and its rows at most; pivots at most.
SAMPLE_BYTES, SAMPLE_ROWS, PIVOTS = 16 << 20, 2048, 256
#: Shards whose sizes are broadcast, at most.
GRID = 50_000


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floats where 53 bits hold every sum, else by Python's integers."""
    size = vectors.shape[-1] * float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0))
    if size < 2**53:
        return np.rint(vectors.astype(float) @ query.astype(float)).astype(np.int64)
    return (vectors.astype(object) @ query.astype(object)).astype(np.int64)


class MTree:
    """ids (int64), vectors (int64 rows)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.plain = self.vectors.astype(float)
        self.small = self.plain.shape[1] * float(np.abs(self.plain).max(initial=0)) ** 2 < 2**52
        norms = (self.plain**2).sum(1)
        self.most = norms.max(initial=0.0)
        self.space = np.concatenate([self.plain, np.sqrt(np.maximum(self.most - norms, 0))[:, None]], 1)
        #: nodes: (where the rows of a leaf lie or None, children or None, routing vectors' distances to this node's, radii of the children)
        self.nodes: list[tuple] = []
        self.routes: list[np.ndarray] = []
        self.radii: list[float] = []
        self.places: list[np.ndarray] = []
        self.root = self._build(np.arange(len(self.ids))) if len(self.ids) else -1
        if self.places:  # the rows of a leaf lie together
            at = np.concatenate(self.places)
            self.ids, self.vectors, self.plain = self.ids[at], self.vectors[at], np.ascontiguousarray(self.plain[at])
        del self.space, self.places

    def _build(self, rows: np.ndarray) -> int:
        here = self.space[rows]
        route = here.mean(0)
        far = np.sqrt(((here - route) ** 2).sum(1))
        at = len(self.nodes)
        self.nodes.append(())
        self.routes.append(route)
        self.radii.append(float(far.max()))
        if len(rows) <= LEAF or far.max() < 1e-9 and len(rows) <= PAGE:
            start = sum(map(len, self.places))
            self.places.append(rows)
            self.nodes[at] = (slice(start, start + len(rows)), None, far, None)
            return at
        # four parts around vectors far from each other, of at most half the rows each
        seeds = [int(far.argmax())]
        gap = ((here - here[seeds[0]]) ** 2).sum(1)
        for _ in range(3):
            seeds.append(int(gap.argmax()))
            gap = np.minimum(gap, ((here - here[seeds[-1]]) ** 2).sum(1))
        near = np.argmin(((here[:, None, :] - here[seeds][None]) ** 2).sum(2) if len(rows) <= 4096 else np.stack([((here - here[s]) ** 2).sum(1) for s in seeds], 1), 1)
        parts = [rows[near == k] for k in range(4)]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) > 0.9 * len(rows):
            parts = np.array_split(rows[np.argsort(far, kind="stable")], 4)
        kids = [self._build(p) for p in parts]
        apart = np.array([math.sqrt(((self.routes[k] - route) ** 2).sum()) for k in kids])
        self.nodes[at] = (None, kids, apart, np.array([self.radii[k] for k in kids]))
        return at

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) but those of id ``own``; none below ``floor`` are needed."""
        if self.root < 0:
            return []
        plain = query.astype(float)
        q = np.append(plain, 0.0)
        base = float(q @ q) + self.most
        margin = 1e-6 * (base + 1) ** 0.5
        reach = lambda score: math.sqrt(max(base - 2.0 * score, 0.0)) + margin
        limit = math.inf if floor is None else reach(floor)
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst is first
        first = math.sqrt(((self.routes[self.root] - q) ** 2).sum())
        todo = [(max(0.0, first - self.radii[self.root]), self.root, first)]
        while todo:
            least, node, to = heapq.heappop(todo)
            if least > limit:
                break
            rows, kids, apart, radii = self.nodes[node]
            if kids is not None:
                for i in np.flatnonzero(np.abs(to - apart) - radii <= limit):  # the others need no distance
                    kid = kids[i]
                    d = self.routes[kid] - q
                    d = math.sqrt(d @ d)
                    if d - self.radii[kid] <= limit:
                        heapq.heappush(todo, (max(0.0, d - self.radii[kid]), kid, d))
                continue
            near = np.abs(to - apart) <= limit
            some = np.count_nonzero(near)
            if not some:
                continue
            # a page is read as it lies unless the stored distances spare most of it
            rows = np.arange(rows.start, rows.stop)[near] if some < len(near) // 4 else rows
            scores = self.plain[rows] @ plain if self.small else inner(self.vectors[rows], query)
            worst = best[0][0] if len(best) == k else floor
            at = np.flatnonzero(scores > worst - 0.5) if worst is not None else np.arange(len(scores))
            if not len(at):
                continue
            rows, scores = (at + rows.start if isinstance(rows, slice) else rows[at]), np.rint(scores[at]).astype(np.int64) if self.small else scores[at]
            if len(rows) > 2 * k:
                keep = np.lexsort((self.ids[rows], -scores))[: k + int((self.ids[rows] == own).sum())]
                rows, scores = rows[keep], scores[keep]
            for s, i in zip(scores.tolist(), self.ids[rows].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                limit = min(limit, reach(best[0][0]))
        return [(s, -i) for s, i in best]


def quantised(embedding: Column) -> Column:
    """floor(64 * x) of every component; null unless all are finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * 64).cast("long")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.int64)


_PLACED = "vec_id long, v array<long>, dim int, shard int, far double"
_ROUTED = "query_id long, v array<long>, dim int, shard int, floor long"


def _by_length(batches, names: str, work):
    """Rows of (id, v, dim) in parts of one length each, with what ``work(dim, ids, matrix)`` gives: columns, or (row, columns) where rows repeat."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            part = pa.Table.from_batches([whole.slice(at, 2000)])
            for dim in sorted(set(part.column(2).to_pylist())):
                own = part.filter(pa.compute.equal(part.column(2), dim))
                rows, made = work(dim, own.column(0).to_numpy(), _matrix(own.column(1), dim))
                own = own.take(pa.array(rows)) if rows is not None else own
                yield from pa.Table.from_arrays([*own.columns, *made], names=names.split()).to_batches()


def _apart(rows: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows, each the farthest from those before it, so that radii around them are small."""
    chosen, gap = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def shards(vectors: DataFrame, k: int) -> tuple[DataFrame, object]:
    """Stored rows of _PLACED, and the broadcast (sample trees, pivots, radii) of the lengths in a bounded sample; other lengths are one shard each."""
    spark = vectors.sparkSession
    widest = vectors.agg(F.max("dim")).first()[0] or 1
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(max(k + 1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * widest)))).toArrow()
    lists, dims = sample["v"].to_pylist(), np.array(sample["dim"].to_pylist())
    trees = {}
    for d in set(dims.tolist()):
        at = np.flatnonzero(dims == d)
        trees[d] = MTree(sample["vec_id"].to_numpy()[at], np.array([lists[i] for i in at], dtype=np.int64).reshape(len(at), d))
    sizes = {r.dim: r.n for r in vectors.filter(F.col("dim").isin(sorted(trees))).groupBy("dim").agg(F.count("*").alias("n")).collect()} if trees else {}
    pivots = {d: _apart(t.plain, min(PIVOTS, math.ceil(sizes.get(d, 1) / PAGE))) for d, t in trees.items()}
    sent = spark.sparkContext.broadcast(pivots)

    def near(dim, ids, x):
        p = sent.value.get(dim)
        if p is None or not dim:
            return None, [pa.array(np.zeros(len(ids), np.int32)), pa.array(np.zeros(len(ids)))]
        apart = np.stack([((x - c) ** 2).sum(1) for c in p], 1)
        best = apart.argmin(1)
        return None, [pa.array(best.astype(np.int32)), pa.array(np.sqrt(apart[np.arange(len(x)), best]))]

    placed = stored(vectors.mapInArrow(lambda batches: _by_length(batches, "vec_id v dim shard far", near), _PLACED))
    far = placed.filter(F.col("dim").isin(sorted(trees))).groupBy("dim", "shard").agg(F.max("far").alias("far")).collect() if trees else []
    radii = {d: np.full(len(p), -math.inf) for d, p in pivots.items()}
    for r in far:  # one row for each pivot
        radii[r.dim][r.shard] = r.far
    return placed, spark.sparkContext.broadcast((trees, pivots, radii))


def routes(queries: DataFrame, sent, k: int) -> DataFrame:
    """Stored rows of _ROUTED: each query with the shards that can hold one of its k best, and the floor of their scores."""

    def go(dim, ids, x):
        trees, pivots, radii = (m.get(dim) for m in sent.value)
        rows, shard, floors = [], [], []
        for i, (q, v) in enumerate(zip(ids.tolist(), x, strict=True)):
            known = trees.search(v, q, k) if trees else []
            floor = min(known)[0] if len(known) == k else None
            open_ = [0]
            if trees:
                size = math.sqrt(float((v.astype(float) ** 2).sum()))
                most = pivots @ v.astype(float) + size * radii
                open_ = np.flatnonzero((most + 1e-6 * (1 + np.abs(most)) >= floor if floor is not None else True) & (radii >= 0)).tolist()
            rows += [i] * len(open_)
            shard += open_
            floors += [floor] * len(open_)
        return np.array(rows, np.int64), [pa.array(shard, pa.int32()), pa.array(floors, pa.int64())]

    return stored(queries.mapInArrow(lambda batches: _by_length(batches, "query_id v dim shard floor", go), _ROUTED))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (vec_id, v: array of long) and queries (query_id, v)."""
    vectors = vectors.select("vec_id", "v", F.size("v").alias("dim")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    queries = queries.select("query_id", "v", F.size("v").alias("dim")).filter("query_id IS NOT NULL AND v IS NOT NULL").distinct()
    placed, sent = shards(vectors, k)
    routed = routes(queries, sent, k)
    # sizes of shards, and of their blocks, are known before anything is grouped
    pages = placed.groupBy("dim", "shard").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("pages"))
    grid = stored(pages.join(routed.groupBy("dim", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), ["dim", "shard"]))
    # one row for each shard; with very many lengths of vectors, the join decides how to meet it
    grid = F.broadcast(grid) if grid.count() <= GRID else grid
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = placed.join(grid, ["dim", "shard"]).withColumn("page", salt("vec_id", "pages")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = routed.join(grid, ["dim", "shard"]).withColumn("block", salt("query_id", "blocks")).withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    keys = ["dim", "shard", "page", "block"]

    def search(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], []]
        if own.num_rows and asked.num_rows:
            tree = MTree(own["vec_id"].to_numpy(), _matrix(own["v"], key[0].as_py()))
            for q, v, floor in zip(asked["query_id"].to_pylist(), _matrix(asked["v"], key[0].as_py()), asked["floor"].to_pylist(), strict=True):
                for s, i in tree.search(v, q, k, floor):
                    out[0].append(q)
                    out[1].append(i)
                    out[2].append(s)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = left.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(right.select(*keys, "query_id", "v", "floor").groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(rows, rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
