import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from hornbeam.llm import bpe


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LONG = "Some words, here's 12 of them.\n\n  And more   " * 4000
TEXTS = ["", None, "a", " a  b\t\n c ", "it's 1,000 €　ß x", "<|endoftext|>", "a", LONG, "x" * 70000, " " * 300 + "x", "   x"]


def test_equals_the_library_on_whole_texts(spark, plain):
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, decoded string")
    out = {r.doc_id: r for r in bpe.encode_documents(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, tuple(bpe.OUTPUTS)).collect()}
    assert len(out) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = plain.encode_ordinary(t or "")
        assert out[i].ids == ids and out[i].n_tokens == len(ids)
        assert bytes(out[i].decoded) == (t or "").encode()
        assert out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_white_space_runs_that_the_pattern_engine_cannot_match(plain):
    codec = bpe.Codec(bpe.parse_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), P.PATTERN)
    for n in (511, 512, 513, 700):
        for text in ("a" + " " * n + "b", " " * n, "\n" * n + "?", "x" + "\t" * n, " " * n + "1" + " " * n + "z"):
            assert codec.encode(text) == plain.encode_ordinary(text)
    long = "ab" + " " * 300_000 + "c" + "\n" * 300_000
    assert codec.decode(codec.encode(long)) == long.encode()


def test_parts_join_to_the_text():
    for text in [*filter(None, TEXTS), "y" + " " * 2000 + "z " * 50000]:
        assert "".join(p for p, _ in bpe.safe_parts(text)) == text


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_query_equals_the_library(spark, plain, tmp_path):
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in bpe.op3_byte_bpe(spark, str(tmp_path)).collect()}
    assert len(out) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = plain.encode_ordinary(t or "")
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
