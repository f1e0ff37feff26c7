"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct word shingles, as 64-bit hashes. Two documents link when
|A and B| / |A or B| >= PERCENT / 100. The join is exact: no pair that links is lost.

1. Equal sets are one node, named by a 64-bit print; a second print tells whether two sets ever share a name, and
   then all is done again with another seed. Copies are never compared.
2. Tokens are counted once over all different sets (shuffle 1, packed, 6 bytes a token) and told to the sets that hold them if
   more than one set does (shuffle 2). Each set orders its tokens: those that no other set has, then by rising count, then
   those that a chunk of the scan met HOT times or more, which are never gathered. A set's prefix of n - ceil(t n) + 1
   tokens must meet the prefix of every set that it links with, in this one global order.
3. Prefix tokens that several sets have form index lists by token, with size and position. Lists are cut into cells by bands of
   sizes that can link, and long ones by blocks; in a cell, blocks of sizes that cannot link are skipped, and a
   pair needs one token whose positions in both sets leave enough behind it.
4. Each set is first compared with one pivot: of the sets that head its lists, that with the smallest share of tokens of
   its own. Links to pivots give stars; sets of one component need no further comparison.
5. Between components, answers are derived: |x and y| <= min(|x and p|, |y and p|) + min(|x - p|, |y - p|) for a pivot p that
   x and y share, before a pair leaves its list; |x and y| <= |p and q| + |x - p| + |y - q| for different pivots, whose
   overlap is computed once for all sets of the two families; only pairs that these leave open are compared themselves.

Style: numpy on Arrow batches, since prefixes and overlaps are array work. What a task holds is bounded: a chunk of
CHUNK tokens, a group of about GROUP bytes of text (groups grow in number, not in size; above FAN groups they are dealt in two
passes), one cell of a list, or blocks of about 2 * FAMILY tokens of the sets compared. A bitmap of fixed size
chooses which documents to read sets of (a wrong bit costs time only). Links, sets, counts and prints stay distributed.

Defined cases: a null or wordless text has an empty set, no link, and is its own component; fewer words than a shingle make one
shingle; repeated rows are equal sets; texts that share an id are sets of their own; a row with a null id links with nothing and
has a null component; ties go to smaller ids; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm.common import smallest_reachable, stored, table

WORDS, PERCENT = 4, 85
#: Tokens that a scan task packs at a time; sets of a chunk from which a token is hot; bytes of text for each group; groups dealt at once.
CHUNK, HOT, GROUP, FAN = 1 << 20, 8, 16 << 20, 1 << 12
#: Bits of the bitmaps that choose documents; list entries in a block of a cell; tokens in a block of a family, about.
BITS, CELL, FAMILY = 1 << 24, 4096, 1 << 20
#: The count of hot tokens, above all others.
MOST = 65535


def tokens(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text: sorted distinct hashes of its shingles. ASCII letters are lower-cased, ASCII white space parts words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[i : i + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h)


def prints(s: np.ndarray, seed: int) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), seed), np.int64).tolist())


def prefix(n, percent: int):
    return n - -(-percent * n // 100) + 1


def need(a, b, percent: int):
    """The least overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def _texts(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[tuple[list, list]]:
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            yield whole.column(0)[at : at + size].to_pylist(), whole.column(1)[at : at + size].to_pylist()


#: Rows between the scan and the lists. kind 0: a document (a: id, n, b and c: prints). kind 1: a set (a: print, n, b: number of
#: different tokens, x: its hot tokens). kind 2: tokens of a group (x: low halves, y: places in z, z: prints, w: hot low
#: halves; told back: y counts, z one print for each token).
PACKED = "kind byte, part long, a long, n long, b long, c long, x binary, y binary, z binary, w binary"
_FIELDS = {"kind": pa.int8(), "part": pa.int64(), "a": pa.int64(), "n": pa.int64(), "b": pa.int64(), "c": pa.int64(), "x": pa.binary(), "y": pa.binary(), "z": pa.binary(), "w": pa.binary()}


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (kind, part, a, n, b, c, x, y, z, w)."""
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FIELDS.values(), strict=True)], names=list(_FIELDS))


def _joined(values: list, kind) -> np.ndarray:
    return np.frombuffer(b"".join(v for v in values if v), kind)


def _ids(flat: np.ndarray, groups: int) -> np.ndarray:
    """Tokens as numbers: the group, by the high half, and the low half. A clash only makes bounds looser."""
    return ((flat >> np.uint64(32)) * np.uint64(groups) & ~np.uint64(0xFFFFFFFF) | flat & np.uint64(0xFFFFFFFF)).view(np.int64)


def _dealt(ids: np.ndarray, of: np.ndarray, names: np.ndarray, hot: np.ndarray, deal: int) -> Iterator[tuple]:
    """Rows of kind 2 for sorted ids; ``of`` gives each one's place in ``names``, and ``deal`` groups share a part."""
    part, hot_part = (ids >> 32) // deal, (hot >> 32) // deal
    # tokens keep their group beside the low half while several groups share a part
    tell = lambda t: t.astype(np.uint32).tobytes() if deal == 1 else t.tobytes()
    for g in np.union1d(part, hot_part).tolist():
        s, e = np.searchsorted(part, [g, g + 1])
        hs, he = np.searchsorted(hot_part, [g, g + 1])
        own, at = np.unique(of[s:e], return_inverse=True)
        yield (2, g, g, len(own), 0, 0, tell(ids[s:e]), at.astype(np.uint32 if len(own) > MOST else np.uint16).tobytes(), names[own].tobytes(), tell(hot[hs:he]))


def _tabled(work: Callable, fields: dict) -> Callable:
    """What a group's work yields, as one table."""
    schema = pa.schema(list(fields.items()))
    return lambda key, rows: pa.Table.from_batches(work(key, rows), schema)


def _scan(words: int, groups: int, deal: int, seed: int) -> Callable:
    """(doc_id, text) to rows of kinds 0, 1 and 2. A set that a task has met already is not sent again."""

    def tell(held: list[tuple[int, np.ndarray]]):
        names = np.array([h[0] for h in held], np.int64)
        sizes = np.array([len(h[1]) for h in held])
        flat, of = np.concatenate([h[1] for h in held]), np.repeat(np.arange(len(held)), sizes)
        ids = _ids(flat, groups)
        order = np.argsort(ids, kind="stable")
        ids, of = ids[order], of[order]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        counts = np.diff(np.append(starts, len(ids)))
        is_hot = np.repeat(counts >= HOT, counts)
        heads = ids[starts[counts >= HOT]]
        # by set: how many different tokens its numbers make, and its hot tokens
        again = (ids[1:] == ids[:-1]) & (of[1:] == of[:-1])
        different = sizes - np.bincount(of[1:][again], minlength=len(held))
        hot, mine = ids[is_hot], of[is_hot]
        order = np.argsort(mine, kind="stable")
        hot, edges = hot[order], np.searchsorted(mine[order], np.arange(len(held) + 1))
        rows = [(1, int(k % groups), int(k.view(np.int64)), int(n), int(d), 0, hot[edges[i] : edges[i + 1]].tobytes(), b"", b"", b"") for i, (k, n, d) in enumerate(zip(names.view(np.uint64), sizes, different, strict=True))]
        yield _packed(rows)
        yield _packed(list(_dealt(ids[~is_hot], of[~is_hot], names, heads, deal)))

    def work(batches):
        seen: set[int] = set()
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for ids, texts in _texts(batches):
            rows = []
            for i, t in zip(ids, texts, strict=True):
                s = tokens(t, words)
                hi, lo = prints(s, seed)
                rows.append((0, (hi ^ lo ^ (i or 0)) % groups, i, len(s), hi, lo, b"", b"", b"", b""))
                if i is not None and len(s) and hi not in seen:
                    seen.add(hi)
                    held.append((hi, s))
                    size += len(s)
                    if size >= CHUNK:
                        yield from tell(held)
                        held, size = [], 0
            yield _packed(rows)
            seen = seen if len(seen) < 200_000 else set()
        if held:
            yield from tell(held)

    return work


def _deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 2 whose parts hold several groups to rows of one group each; sorted by part."""

    def tell(held):
        ids, of, names, hot = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.argsort(ids, kind="stable")
        yield _packed(list(_dealt(ids[order], of[order], names, np.unique(hot), 1)))

    held, size, part, base = [], 0, None, 0
    for batch in batches:
        plain = []
        for row in batch.to_pylist():
            if row["kind"] != 2:
                plain.append(tuple(row.values()))
                continue
            if held and (row["part"] != part or size >= CHUNK):
                yield from tell(held)
                held, size, base = [], 0, 0
            part = row["part"]
            names = np.frombuffer(row["z"], np.int64)
            at = np.frombuffer(row["y"], np.uint32 if len(names) > MOST else np.uint16).astype(np.int64)
            held.append((np.frombuffer(row["x"], np.int64), at + base, names, np.frombuffer(row["w"], np.int64)))
            base += len(names)
            size += len(at)
        if plain:
            yield _packed(plain)
    if held:
        yield from tell(held)


def _count(groups: int) -> Callable:
    """One group: how many sets have each token, told to the sets; tokens of one set only are left out."""

    def work(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = rows["kind"].to_numpy()
        yield from rows.filter(pa.array(kinds != 2)).to_batches()
        mine = rows.filter(pa.array(kinds == 2))
        if not mine.num_rows:
            return
        names = [np.frombuffer(z, np.int64) for z in mine["z"].to_pylist()]
        of = np.concatenate([z[np.frombuffer(y, np.uint32 if len(z) > MOST else np.uint16)] for z, y in zip(names, mine["y"].to_pylist(), strict=True)])
        low, hot = _joined(mine["x"].to_pylist(), np.uint32), np.unique(_joined(mine["w"].to_pylist(), np.uint32))
        order = np.argsort(low, kind="stable")
        low, of = low[order], of[order]
        # most tokens stand alone: only the others are sorted by set
        same = low[1:] == low[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if len(hot):
            shared |= hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low
        low, of = low[shared], of[shared]
        order = np.lexsort((of, low))
        low, of = low[order], of[order]
        fresh = np.concatenate([[True], (low[1:] != low[:-1]) | (of[1:] != of[:-1])]) if len(low) else np.zeros(0, bool)
        low, of = low[fresh], of[fresh]  # one set may come from several tasks
        _, at, n = np.unique(low, return_inverse=True, return_counts=True)
        count = np.minimum(n, MOST - 1)[at]
        if len(hot) and len(low):
            count[hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low] = MOST
        keep = count > 1
        low, of, count = low[keep], of[keep], count[keep].astype(np.uint16)
        part = (of.view(np.uint64) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((of, part))
        low, of, count, part = low[order], of[order], count[order], part[order]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else [0]
        g = key[0].as_py()
        yield _packed([(2, int(part[s]), g, 0, 0, 0, low[s:e].tobytes(), count[s:e].tobytes(), of[s:e].tobytes(), b"") for s, e in zip(edges[:-1], edges[1:], strict=True)])

    return work


#: kind 0: a document (a: id, n, b and c: prints). kind 2: a list entry (a: token, b: set, n, at, rare: the share of tokens of its own).
LISTED = "kind byte, a long, n long, b long, c long, at int, rare double"
_LISTED = {"kind": pa.int8(), "a": pa.int64(), "n": pa.int64(), "b": pa.int64(), "c": pa.int64(), "at": pa.int32(), "rare": pa.float64()}


def _prefixes(percent: int) -> Callable:
    """The sets of one part: the entries of their prefixes."""

    def work(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        def batch(kind: int, a, n, b, c, at, rare):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((np.full(len(n), kind), a, n, b, c, at, rare), _LISTED.values(), strict=True)], names=list(_LISTED))

        kinds = rows["kind"].to_numpy()
        docs = rows.filter(pa.array(kinds == 0))
        if docs.num_rows:
            none = np.zeros(docs.num_rows)
            yield batch(0, docs["a"].to_pylist(), docs["n"].to_numpy(), docs["b"].to_numpy(), docs["c"].to_numpy(), none.astype(np.int32), none)
        own = rows.filter(pa.array(kinds == 1))
        if not own.num_rows:
            return
        names, first = np.unique(own["a"].to_numpy(), return_index=True)
        sizes, different = own["n"].to_numpy()[first], own["b"].to_numpy()[first]
        hot = own["x"].to_pylist()
        told = rows.filter(pa.array(kinds == 2))
        lows = [np.frombuffer(x, np.uint32).astype(np.int64) for x in told["x"].to_pylist()]
        ids = [low | g << 32 for low, g in zip(lows, told["a"].to_pylist(), strict=True)] + [_joined(hot, np.int64)]
        of = [_joined(told["z"].to_pylist(), np.int64), np.repeat(own["a"].to_numpy(), [len(h) // 8 for h in hot])]
        count = [_joined(told["y"].to_pylist(), np.uint16), np.full(len(ids[-1]), MOST, np.uint16)]
        ids, of, count = np.concatenate(ids), np.searchsorted(names, np.concatenate(of)), np.concatenate(count)
        order = np.lexsort((ids, count, of))
        ids, of = ids[order], of[order]
        fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])]) if len(ids) else np.zeros(0, bool)
        ids, of = ids[fresh], of[fresh]
        known = np.bincount(of, minlength=len(names))
        alone = different - known  # tokens that no other set has come first
        at = np.arange(len(of)) - np.searchsorted(of, of) + alone[of]
        keep = at < prefix(sizes[of], percent)
        ids, of, at = ids[keep], of[keep], at[keep]
        yield batch(2, ids, sizes[of], names[of], np.zeros(len(of), np.int64), at.astype(np.int32), (alone / sizes)[of])

    return work


def _overlaps(percent: int) -> Callable:
    """A cell's sets (cell, id, tokens) and pairs (cell, a, b) to (a, b, overlap, linked)."""

    def work(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        held = {i: np.frombuffer(t, np.uint64) for i, t in zip(sets["id"].to_pylist(), sets["tokens"].to_pylist(), strict=True)}
        rows = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            x, y = held[a], held[b]
            few, many = (x, y) if len(x) <= len(y) else (y, x)
            o = int((few == many[np.minimum(np.searchsorted(many, few), len(many) - 1)]).sum())
            rows.append((a, b, o, 100 * o >= percent * (len(x) + len(y) - o)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.table({n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(("a", "b", "overlap", "linked"))})

    return work


_CELL = "cell long, n long, at int, id long, label long, pivot long, o long, upper boolean, salt int, mixed boolean"


def _between(percent: int) -> Callable:
    """Of rows sorted by cell, n and at: pairs (a, b) of different components that sizes, positions and a shared pivot leave open."""

    def pairs(n, at, ids, label, pivot, o, upper, salt, mixed):
        starts = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))  # blocks of one size, by position
        ends = np.append(starts[1:], len(n))
        for s, e in zip(starts, ends, strict=True):
            size = int(n[s])
            stop = int(np.searchsorted(n, 100 * size // percent, "right"))  # larger blocks are skipped
            least = need(size, n[s:stop], percent)
            last = int(np.searchsorted(at[s:e], size - least[0], "right"))  # later positions leave too little behind them
            for i in range(s, s + last):
                j = np.arange(i + 1, stop)
                m = least[i + 1 - s :]
                j = j[(label[j] != label[i]) & ~(upper[j] & upper[i]) & (~mixed[i] | (salt[j] != salt[i])) & (at[i] <= size - m) & (at[j] <= n[j] - m)]
                # the pivot of one set has been compared with the other; a shared one tells how much both can share
                most = np.where(pivot[j] == pivot[i], np.minimum(o[j], o[i]) + np.minimum(n[j] - o[j], size - o[i]), size)
                j = j[(most >= least[j - s]) & (pivot[j] != ids[i]) & (ids[j] != pivot[i])]
                if len(j):
                    yield np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])

    def work(batches):
        held: list[np.ndarray] | None = None
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns] if batch is not None else None
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)] if cols is not None else held
            if cols is None:
                return
            t = cols[0]
            edges = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
            stop = len(edges) - 1 if batch is None else len(edges) - 2  # the last cell may go on
            seen: set[tuple[int, int]] = set()
            for k in range(stop):
                a, b = edges[k], edges[k + 1]
                if (cols[4][a:b] != cols[4][a]).any():
                    for x, y in pairs(*[c[a:b] for c in cols[1:]]):
                        seen.update(zip(x.tolist(), y.tolist(), strict=True))
                if len(seen) > 100_000 or (k == stop - 1 and seen):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*seen, strict=True)], names=["a", "b"])
                    seen = set()
            held = [c[edges[stop] :] for c in cols]

    return work


class Join:
    """One join over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", seed: int = 0):
        self.docs = docs.select("doc_id", F.col(text).cast("string").alias("text"))
        self.words, self.percent, self.seed = words, percent, seed
        self.spark = docs.sparkSession

    def lists(self) -> DataFrame:
        """Rows of LISTED: all documents, and the entries of all prefixes but tokens of one set only."""
        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        groups = max(1, math.ceil(size / GROUP))
        deal = math.ceil(groups / FAN)
        sent = self.docs.mapInArrow(_scan(self.words, groups, deal, self.seed), PACKED)
        if deal > 1:
            sent = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_deal_again, PACKED)
        told = sent.groupBy("part").applyInArrow(_tabled(_count(groups), _FIELDS), PACKED)
        return stored(told.groupBy("part").applyInArrow(_tabled(_prefixes(self.percent), _LISTED), LISTED))

    def compare(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """(a, b, overlap, linked) of stored pairs (a, b, na, nb, fa, fb), where fa and fb name the families of a and b.

        Families are cut into blocks of about FAMILY tokens, and a cell is a pair of blocks. A set goes to each of its
        cells once, however many pairs it has there, so what moves follows the number of sets; a cell's size is bounded. Sets
        are made anew in one scan, for the documents that a bitmap names.
        """
        blocks = pairs.select(F.col("fa").alias("f"), F.col("a").alias("id"), F.col("na").alias("n")).union(pairs.select("fb", "b", "nb")).distinct().groupBy("f").agg(F.ceil(F.sum("n") / FAMILY).alias("blocks")).filter("blocks > 1")
        for side in ("a", "b"):  # few families have more than one block
            cut = blocks.select(F.col("f").alias(f"f{side}"), F.col("blocks").alias(f"n{side}s"))
            pairs = pairs.join(cut, f"f{side}", "left").withColumn(f"k{side}", F.pmod(F.xxhash64(side), F.coalesce(f"n{side}s", F.lit(1))))
        celled = stored(pairs.select(F.xxhash64("fa", "ka", "fb", "kb").alias("cell"), "a", "b"))
        members = stored(celled.select("cell", F.col("a").alias("id")).union(celled.select("cell", "b")).distinct().join(reps.select(F.col("node").alias("id"), "rep"), "id"))
        slot = F.pmod(F.xxhash64("rep"), F.lit(BITS))
        words = members.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 63).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 63 AS INT))")).alias("bits"))
        got = words.toArrow()  # at most BITS / 63 rows
        bits = np.zeros(BITS // 63 + 1, np.int64)
        bits[got["w"].to_numpy()] = got["bits"].to_numpy()
        sent, k, seed = self.spark.sparkContext.broadcast(bits), self.words, self.seed

        def sets(batches):
            for whole in batches:
                slots = whole.column(2).to_numpy()
                hit = whole.filter(pa.array((sent.value[slots // 63] >> (slots % 63)) & 1 == 1))
                for at in range(0, hit.num_rows, 500):
                    part = hit.slice(at, 500)
                    made = [tokens(t, k) for t in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([prints(s, seed)[0] for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["rep", "id", "tokens"])

        own = self.docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("slot")).mapInArrow(sets, "rep long, id long, tokens binary")
        shipped = members.join(own, ["id", "rep"]).select("cell", "id", "tokens")
        return stored(shipped.groupBy("cell").cogroup(celled.toDF("at_cell", "a", "b").groupBy("at_cell")).applyInArrow(_overlaps(self.percent), "a long, b long, overlap long, linked boolean"))

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        percent = self.percent
        listed = self.lists()
        rows = listed.filter("kind = 0").select(F.col("a").alias("doc_id"), "n", F.col("b").alias("node"), F.col("c").alias("second"))
        reps = stored(rows.filter("doc_id IS NOT NULL AND n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("second").alias("x"), F.max("second").alias("y")))
        if not reps.filter("x <> y").isEmpty():  # two sets share a print
            return Join(self.docs, self.words, percent, seed=self.seed + 1).components()
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9)
        entries = listed.filter("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("id"), "n", "at", "rare", band.alias("band"))

        # a set's pivot: of the sets that head its lists in bands near its size, the one with the least share of tokens of its own
        heads = entries.groupBy("token", "band").agg(F.min(F.struct("rare", "id", "n", "at")).alias("h"))
        near = entries.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(heads, ["token", "band"])
        least = F.ceil(percent * (F.col("n") + F.col("h.n")) / (100 + percent))
        fits = (F.col("id") != F.col("h.id")) & (F.col("at") <= F.col("n") - least) & (F.col("h.at") <= F.col("h.n") - least)
        best = near.filter(fits).groupBy("id", "n").agg(F.min(F.struct("h.rare", "h.id", "h.n")).alias("p"))
        star = stored(best.select(F.col("p.id").alias("a"), F.col("id").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"), F.col("p.id").alias("fa"), F.col("p.id").alias("fb")))
        first = self.compare(star, reps)
        label = stored(smallest_reachable(first.filter("linked").select("a", "b")))
        own = stored(first.select(F.col("b").alias("id"), F.col("a").alias("pivot"), F.col("overlap").alias("o")))

        # what stands between components
        labelled = entries.select("token", "band", "n", "at", "id").join(label.withColumnRenamed("component_id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        spread = labelled.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("token")
        pairs = stored(self.open_pairs(labelled.join(spread, "token", "left_semi").join(own, "id", "left").withColumn("pivot", F.coalesce("pivot", "id")).withColumn("o", F.coalesce("o", "n"))))
        labels = label
        if not pairs.isEmpty():
            sizes = entries.select("id", "n").distinct()
            side = lambda s: sizes.join(own, "id", "left").select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.coalesce("pivot", "id").alias(f"f{s}"), (F.col("n") - F.coalesce("o", "n")).alias(f"d{s}"))
            known = stored(pairs.join(side("a"), "a").join(side("b"), "b"))
            u, v = F.least("fa", "fb"), F.greatest("fa", "fb")
            named = sizes.select(F.col("id").alias("u"), F.col("n").alias("nu")), sizes.select(F.col("id").alias("v"), F.col("n").alias("nv"))
            met = known.filter("fa <> fb").select(u.alias("u"), v.alias("v")).distinct().join(named[0], "u").join(named[1], "v")
            between = self.compare(stored(met.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("nu").alias("na"), F.col("nv").alias("nb"), F.col("u").alias("fa"), F.col("v").alias("fb"))), reps)
            derived = known.withColumn("u", u).withColumn("v", v).join(between.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("overlap").alias("o")), ["u", "v"], "left")
            most = F.coalesce(F.col("o") + F.col("da") + F.col("db"), F.least("na", "nb"))
            answered = F.col("o").isNotNull() & (F.least("a", "b") == F.col("u")) & (F.greatest("a", "b") == F.col("v"))
            open_ = derived.filter((most >= F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))) & ~answered).select("a", "b", "na", "nb", "fa", "fb")
            more = between.union(self.compare(stored(open_), reps)).filter("linked").select("a", "b")
            of = lambda s: F.coalesce(F.col(f"c{s}"), F.col(s)).alias(s)
            for s in ("a", "b"):
                more = more.join(label.select(F.col("id").alias(s), F.col("component_id").alias(f"c{s}")), s, "left")
            merged = stored(smallest_reachable(more.select(of("a"), of("b"))))
            joined = label.join(merged.select(F.col("id").alias("component_id"), F.col("component_id").alias("to")), "component_id", "left").select("id", F.coalesce("to", "component_id").alias("component_id"))
            labels = stored(joined.union(merged.join(label, "id", "left_anti").select("id", "component_id")))

        least_id = labels.join(reps, labels["id"] == reps["node"]).select("id", F.col("component_id").alias("label"), "rep")
        named = least_id.join(least_id.groupBy("label").agg(F.min("rep").alias("least")), "label").select(F.col("id").alias("node"), "least")
        whole = reps.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("least", "rep").alias("least"))
        none = F.col("doc_id").isNull() | (F.col("n") == 0)
        return rows.join(whole, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(none, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))

    def open_pairs(self, entries: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) that lists of entries (token, band, n, at, id, label, pivot, o) leave open.

        A cell holds a token's sets of one band and, as partners, those of the next; a long one is cut into blocks that meet pair by pair.
        """
        cells = entries.withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("band", F.col("band") - F.col("upper").cast("int"))
        many = cells.groupBy("token", "band").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks")).filter("blocks > 1")
        cells = cells.join(many, ["token", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cell = F.xxhash64("token", "band", F.least("salt", "other"), F.greatest("salt", "other")).alias("cell")
        rows = cells.select(cell, "n", "at", "id", "label", "pivot", "o", "upper", "salt", (F.col("salt") != F.col("other")).alias("mixed"))
        return rows.repartition("cell").sortWithinPartitions("cell", "n", "at", "id").mapInArrow(_between(self.percent), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text") -> DataFrame:
    return Join(docs, words, percent, text).components()


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (n - c)),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = s.doc_id
"""
