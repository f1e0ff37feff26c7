"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed; a run that stands in more than one place is kept
where it comes first (by document id, then by place), and the sentences that its other places cover are removed.

A run has at least RUN sentences and RUN_WORDS words, so runs of very short sentences are longer and do
not repeat by chance. For each sentence, the shortest run that begins there and the shortest that ends there
are hashed, so a passage is covered up to both of its ends. A sentence ends at . ! or ? before white space, or
at a line break; sentences of over LONG words also end after the word of least hash in each WINDOW words, so
long ones are cut alike wherever they stand, into pieces of at most WINDOW words. Two places of a passage cut
it alike but for 13 words at its start and 12 at its end, at most; of over 50 words at least 26 are left, more
than two sentences can hold, so a whole run stands in every such passage that white space sets off. Words are
parted by ASCII white space, and ASCII case does not count.

A scan task packs its runs in chunks. Of a hash that a chunk has several times only the first place is sent on: its
other places are repeats whatever else there is, so a run in a third of all documents is one row for each chunk. Groups of
hashes (of a bounded size, their number grows) find the places that are not the first; these meet the texts by id. Nothing is
collected, and texts are shuffled once, for the removal.

Style: numpy on Arrow batches; sentences, runs and hashes are computed for whole batches of texts.

Defined cases: a null text stays null; without a repeated run a text stays as it is, to the byte; rows with one
id are one document and get the same treatment, by sentence numbers; rows with a null id neither teach nor change; other
columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm.common import table, unused

RUN, RUN_WORDS, LONG = 3, 20, 12
#: Of so many words in a row within a long sentence, one ends a piece.
WINDOW = 7
#: Runs packed at a time; bytes of text for each group of hashes; groups dealt at once.
CHUNK, GROUP, FAN = 1 << 20, 16 << 20, 1 << 12
_SPACE, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[list(b"\t\n\x0b\x0c\r ")] = True
_STOP[list(b".!?")] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64, n at least."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(2 * n, b, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of all texts: first word of each (one more at the end), its text's number, its first byte, and the words' hashes.

    Bytes are counted through the texts joined by a line break.
    """
    whole = b"\n".join(texts)
    words = whole.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), h
    b = np.frombuffer(whole, np.uint8)
    space = _SPACE[b]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
    # a line break between a word and the next ends a sentence, and a text ends with one
    breaks = np.flatnonzero(b == 10)
    line = np.searchsorted(breaks, start)
    end = _STOP[b[last]]
    end[:-1] |= line[1:] != line[:-1]
    end[-1] = True
    sentence = np.cumsum(end) - end
    if n >= WINDOW:
        long = np.bincount(sentence)[sentence] > LONG
        inside = long[: n - WINDOW + 1] & (sentence[: n - WINDOW + 1] == sentence[WINDOW - 1 :])
        at = np.flatnonzero(inside)
        least = h[at].copy()
        where = at.copy()
        for k in range(1, WINDOW):  # the last of equals
            x = h[at + k]
            less = x <= least
            least[less] = x[less]
            where[less] = at[less] + k
        end[where] = True
    first = np.concatenate([[0], np.flatnonzero(end) + 1])
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    of = np.searchsorted(begins, start[first[:-1]], "right") - 1
    return first, of, start[first[:-1]], h


def runs(first: np.ndarray, of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, end piece, hash) of every run: the fewest pieces that hold RUN pieces and RUN_WORDS words, from each piece and up to each."""
    n = len(of)
    i = np.arange(n)
    stop = np.maximum(i + RUN, np.searchsorted(first, first[:-1] + RUN_WORDS))
    go = (stop <= n) & (of[np.minimum(stop, n) - 1] == of) if n else np.zeros(0, bool)
    a, e = i[go], stop[go]
    j = i + 1  # runs up to each piece, but those found already
    start = np.minimum(j - RUN, np.searchsorted(first, first[1:] - RUN_WORDS, "right") - 1)
    go = (start >= 0) & (of[np.maximum(start, 0)] == of) if n else go
    go &= ~(stop[np.maximum(start, 0)] == j)
    a, e = np.concatenate([a, start[go]]), np.concatenate([e, j[go]])
    up, down = _powers(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    s = first[a]
    x = (sums[first[e]] - sums[s]) * down[s] + (first[e] - s).astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return a, e, x


def _repeats(h: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places (hash, id, at): which come first of their hash, and which are repeats (both as indices)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate([[False], s[1:] == s[:-1]]) if len(s) else np.zeros(0, bool)
    twin = same | np.append(same[1:], False) if len(s) else same
    many = order[twin]
    many = many[np.lexsort((at[many], ids[many], h[many]))]
    head = np.concatenate([[True], h[many][1:] != h[many][:-1]]) if len(many) else np.zeros(0, bool)
    of = many[head][np.cumsum(head) - 1] if len(many) else many
    later = (ids[many] != ids[of]) | (at[many] != at[of])
    return np.concatenate([order[~twin], many[head]]), many[later]


#: Places packed by group (ids, at, hashes), or the repeats of one document (doc, at).
_PACKED = {"part": pa.int64(), "doc": pa.int64(), "ids": pa.binary(), "at": pa.binary(), "hashes": pa.binary()}
PACKED = "part long, doc long, ids binary, at binary, hashes binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_PACKED)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PACKED.values(), strict=True)], names=list(_PACKED))


def _told(ids: np.ndarray, at: np.ndarray, groups: int) -> pa.RecordBatch:
    """Repeats by document, dealt evenly."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])) if len(ids) else [0]
    return _rows([(int(ids[s]) % groups, int(ids[s]), None, at[s:e].tobytes(), None) for s, e in zip(edges[:-1], edges[1:], strict=True)])


def _dealt(h: np.ndarray, ids: np.ndarray, at: np.ndarray, groups: int, deal: int) -> pa.RecordBatch:
    """Places packed by group of hashes; ``deal`` groups share a part."""
    group = ((h >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64) // deal
    order = np.argsort(group, kind="stable")
    group, h, ids, at = group[order], h[order], ids[order], at[order]
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else [0]
    return _rows([(int(group[s]), None, ids[s:e].tobytes(), at[s:e].tobytes(), h[s:e].tobytes()) for s, e in zip(edges[:-1], edges[1:], strict=True)])


def _scan(groups: int, deal: int):
    """(doc_id, text) to packed places, one for each hash of a chunk, and the repeats within a chunk."""

    def tell(held):
        h, ids, at = [np.concatenate(x) for x in zip(*held, strict=True)]
        lone, later = _repeats(h, ids, at)
        yield _dealt(h[lone], ids[lone], at[lone], groups, deal)
        yield _told(ids[later], at[later], groups)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                part = whole.slice(k, 200)
                names = part.column(0).to_numpy()
                first, of, _, words = cut(part.column(1).cast(pa.binary()).to_pylist())
                a, e, h = runs(first, of, words)
                if len(h):
                    begins = np.searchsorted(of, np.arange(len(names)))
                    held.append((h, names[of[a]], ((a - begins[of[a]]) << 6 | (e - a)).astype(np.uint32)))
                    size += len(h)
                if size >= CHUNK:
                    yield from tell(held)
                    held, size = [], 0
        if held:
            yield from tell(held)

    return work


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of = lambda c, t: np.frombuffer(b"".join(rows[c].to_pylist()), t)
    return of("hashes", np.uint64), of("ids", np.int64), of("at", np.uint32)


def _deal_again(groups: int):
    """Packed places whose parts hold several groups to parts of one group; rows are sorted by part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = pa.Table.from_batches([batch.slice(k, 200)])
                packed = part["doc"].is_null()
                yield from part.filter(pa.compute.invert(packed)).to_batches()
                yield _dealt(*_unpacked(part.filter(packed)), groups, 1)

    return work


def _later(rows: pa.Table) -> pa.Table:
    """The repeats of one group and those that chunks have found, one row each."""
    packed = rows["doc"].is_null()
    h, ids, at = _unpacked(rows.filter(packed))
    _, later = _repeats(h, ids, at)
    found = rows.filter(pa.compute.invert(packed))
    near = [np.frombuffer(x, np.uint32) for x in found["at"].to_pylist()]
    docs = np.repeat(found["doc"].to_numpy(), [len(x) for x in near])
    return pa.table({"doc_id": pa.array(np.concatenate([ids[later], docs]), pa.int64()), "at": pa.array(np.concatenate([at[later], *near]).astype(np.int64), pa.int64())})


def repeated_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, places): the runs that stand earlier too, each as its first sentence's number x 64 + its sentences."""
    docs = docs.select("doc_id", F.col(text).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    groups = max(1, math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / GROUP))
    deal = math.ceil(groups / FAN)
    sent = docs.mapInArrow(_scan(groups, deal), PACKED)
    if deal > 1:
        sent = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_deal_again(groups), PACKED)
    return sent.groupBy("part").applyInArrow(_later, "doc_id long, at long").groupBy("doc_id").agg(F.collect_set("at").alias("places"))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the repeated sentences removed from the text, and n_removed (their number) added."""
    rest = [c for c in docs.columns if c not in (text, "n_removed")]
    head = docs.select(*[F.col(f"`{c}`") for c in rest])
    key, body, places = unused(docs, "key"), unused(docs, "body"), unused(docs, "places")
    later = repeated_runs(docs, text).toDF(key, places)
    shown = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text).cast("string").alias(body))
    joined = shown.filter("doc_id IS NOT NULL").join(later, F.col("doc_id") == F.col(key), "left").drop(key)
    joined = joined.union(shown.filter("doc_id IS NULL").withColumn(places, F.lit(None).cast("array<bigint>")))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema] + [f"`{text}` string", "n_removed int"])

    def left(t: str, found: list[int]) -> tuple[str, int]:
        whole = t.encode()
        first, of, start, _ = cut([whole])
        at = np.array(found)
        gone = np.zeros(len(of) + 1, np.int64)
        np.add.at(gone, np.minimum(at >> 6, len(of)), 1)
        np.add.at(gone, np.minimum((at >> 6) + (at & 63), len(of)), -1)
        gone = np.cumsum(gone[:-1]) > 0
        edges = np.append(np.concatenate([[0], start[1:]]), len(whole))
        return b"".join(whole[edges[i] : edges[i + 1]] for i in np.flatnonzero(~gone)).decode(), int(gone.sum())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                texts, found = batch.column(len(rest)).to_pylist(), batch.column(len(rest) + 1).to_pylist()
                done = [left(t, p) if p and t else (t, 0) for t, p in zip(texts, found, strict=True)]  # most texts pass through
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())], names=[*rest, text, "n_removed"])

    return joined.mapInArrow(work, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
