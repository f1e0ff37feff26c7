"""Byte-level BPE encoding and decoding with a local rank file.

Style: Python on Arrow batches. The merges run in tiktoken; nothing of it exists as a SQL function.

Defined cases: a null text counts as empty, an empty text has no ids; a repeated row is encoded
again, rows keep their order and number; other columns pass through untouched, and an output column
takes the place of an input column of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornbeam.llm.common import table

#: Unicode White_Space, which is what \s means to the library's pattern engine.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts above LONG characters are cut where white space begins, every PART characters or later;
#: white-space runs from RUN characters are matched here, as the pattern engine recurses on them.
LONG, PART, RUN = 1 << 16, 1 << 15, 512
_RUNS = re.compile(f"[{SPACE}]{{{RUN},}}")
_EDGE = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
#: What the operator can return, with its type.
OUTPUTS = {"ids": "array<int>", "decoded": "binary", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def safe_parts(text: str) -> Iterator[tuple[str, bool]]:
    """Cuts of ``text`` that no match of the pattern crosses; True marks a part that is one match.

    A match never goes on from a non-space into a space, so a text can be cut where white space
    begins. A run of white space before other text is one match without its last character.
    """
    if len(text) < LONG and not _RUNS.search(text):
        yield text, False
        return
    at = 0
    for run in _RUNS.finditer(text):
        start, end = run.span()
        yield from _cut(text[at:start])
        at = end if end == len(text) else end - 1
        yield text[start:at], True
    yield from _cut(text[at:])


def _cut(text: str) -> Iterator[tuple[str, bool]]:
    at = 0
    while len(text) - at > LONG and (edge := _EDGE.search(text, at + PART)):
        yield text[at : edge.start()], False
        at = edge.start()
    if at < len(text):
        yield text[at:], False


class Codec:
    """tiktoken over given ranks; ``encode`` cuts long texts at safe places first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.digits = [str(i) for i in range(max(ranks.values()) + 1)]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for part, single in safe_parts(text or ""):
            ids += self.coder._encode_single_piece(part.encode()) if single else self.coder.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.coder.decode_bytes(ids)

    def results(self, text: str | None, outputs: tuple[str, ...]) -> list:
        ids = self.encode(text)
        decoded = self.decode(ids) if "decoded" in outputs or "decoded_sha256" in outputs else b""
        of = {
            "ids": lambda: ids,
            "decoded": lambda: decoded,
            "n_tokens": lambda: len(ids),
            "ids_sha256": lambda: hashlib.sha256(" ".join(map(self.digits.__getitem__, ids)).encode()).hexdigest(),
            "decoded_sha256": lambda: hashlib.sha256(decoded).hexdigest(),
        }
        return [of[name]() for name in outputs]


#: One codec for each rank file in a worker process.
_CODECS: dict[tuple, Codec] = {}


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, outputs: tuple[str, ...] = ("ids", "decoded"), text: str = "text") -> DataFrame:
    """``docs`` without its text column, with the chosen OUTPUTS of every whole text.

    The rank file (of fixed size, under a megabyte) is read on the driver and broadcast; executors
    need no copy. There is no shuffle: each scan task encodes its own rows.
    """
    with open(rank_file, "rb") as f:
        data = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(data)
    key = (hashlib.sha256(data).hexdigest(), pattern)
    kept = [c for c in docs.columns if c != text and c not in outputs]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T._parse_datatype_string(OUTPUTS[c])) for c in outputs])
    types = [pa.list_(pa.int32()) if c == "ids" else pa.binary() if c == "decoded" else pa.int64() if c == "n_tokens" else pa.string() for c in outputs]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _CODECS:
            _CODECS[key] = Codec(parse_ranks(sent.value), pattern)
        codec = _CODECS[key]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                done = [codec.results(t.as_py(), outputs) for t in batch.column(len(kept))]
                made = [pa.array([r[i] for r in done], kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*kept, *outputs])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("__text")).mapInArrow(work, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))
