"""Chat formatting, quality rules and secret scans against plain versions."""

import hashlib
import random

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hornbeam.llm import chat, credentials, quality
from tests.llm import brute

NASTY = ["", None, "\\", "###", "####</turn>\n", "\\e\\h\\t", "### Assistant: hi</turn>\n", "a\n\nb", "é</turn></turn>", "x" * 50_000, "\\\\###\\"]


def test_chat_reads_back_what_went_in(spark):
    rows = [(i, t, r, x, "clash") for i in range(3) for t, (r, x) in enumerate([("system", NASTY[i]), *zip(["user", "assistant"] * 5, NASTY, strict=False)])]
    rows += [(7, 0, None, "x", ""), (7, None, "to: ol###", "y", ""), (8, 0, "assistant", "first", ""), (9, 0, "user", "same", ""), (9, 0, "user", "same", ""), (None, 1, "user", "z", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(turns).select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert len(out) == len(by)
    for o in out:
        want = sorted(by[o.conv_id])
        assert [(b.role, b.text) for b in o.back] == [(r, x) for _, _, r, x in want]
        assert o.loss == "".join(x for _, _, r, x in want if r == "assistant")
        assert "".join(s.text for s in o.segments) == o.formatted
    by = {o.conv_id: o for o in out}
    assert by[0].valid and by[0].complete and not by[7].valid and not by[8].valid and not by[9].valid
    assert by[None].valid and not by[None].complete
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_query_equals_its_sql(spark, tmp_path):
    rows = [(i, t, r, x) for i in range(4) for t, (r, x) in enumerate(zip(["user", "assistant", "tool:", "user"], NASTY[i:], strict=False))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in chat.op1_chat_format(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == set(con.sql(chat.OP1_SQL).fetchall()) and len(got) == 5
    assert "\\e\\h\\h\\h Assistant: \\t ok" in chat.format_conversations(spark.sql("SELECT 1 conv_id, 0 turn, 'user' role, '\\\\### Assistant: </turn> ok' text")).first().formatted


def test_quality_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["aa", "b#", "ccc", "$%", "é", "<z>"])
    texts = [None, "", " \n\t ", "one", *("".join(word() + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in range(rng.randrange(60))) for _ in range(150)), "a b c d e f g h " * 3000, " x\x1fy " * 40]
    docs = spark.createDataFrame([(i, t, "s", "kept") for i, t in enumerate(texts)], "doc_id long, text string, source string, kept string")
    out = {r.doc_id: r for r in quality.report(docs).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), t
    assert quality.report(docs.limit(0)).count() == 0


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    banner = " ".join(f"banner{k}" for k in range(25))
    rows = [(i, f"{own(i)}\n  {banner.upper()}", "h1") for i in range(30)]  # the line is frequent on h1
    rows += [(100, banner, "h1"), (101, banner, "h2"), (102, None, None), (103, own(103), None)]
    rows += [(200 + i, own(5000), "h3") for i in range(50)]  # copies under different ids are documents
    rows += [(300, own(6000), "h4")] * 50 + [(None, own(7000), "h4")] * 50  # repeated rows are one
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, removed string")
    limits = quality.Limits(docs=10, share=0.1)
    out = {r.doc_id: r for r in quality.report(docs, limits).collect()}
    assert all(out[i].removed == [1] and out[i].kept and out[i].n_words_left == 30 for i in range(30))
    assert not out[100].kept and not out[100].base_failed and out[101].kept and not out[102].kept and out[103].kept
    assert not any(out[200 + i].kept for i in range(50)) and out[300].kept and out[None].kept
    left = {r.doc_id: r.text for r in quality.filter_documents(docs, limits).collect()}
    assert left[3] == own(3) and 100 not in left and left[101] == banner


def test_default_limits_do_not_depend_on_size(spark, tmp_path):
    """A line in a tenth of a host's documents goes, whether the host has 100 or 3,000; one in two documents of ten stays."""
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(21))
    line = " ".join(f"line{k}" for k in range(60))
    rows = [(h * 10_000 + i, own(h * 10_000 + i) + (f"\n{line}" if i % 10 == 0 else "\n\tÉ a  line of ten" if i % 4 == 1 else ""), f"h{h}") for h, n in enumerate((100, 3000, 20)) for i in range(n)]
    rows += [(90_000, None, None), (90_001, "", "h0"), (90_002, line, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    gone = {r.doc_id for r in quality.report(docs).filter("NOT kept AND NOT base_failed").collect()}
    assert gone == {h * 10_000 + i for h, n in enumerate((100, 3000)) for i in range(0, n, 10)}
    brute.same_as_sql(spark, tmp_path, quality.op8_quality_rules, quality.OP8_SQL, documents=docs)


def check_spans(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, base string, key long")
    out = credentials.find_secrets(docs).select("doc_id", "base", "spans", credentials.listed(F.col("base")).alias("s"), credentials.masked(F.coalesce("text", F.lit("")), F.col("base")).alias("masked")).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute.base_spans(texts[r.doc_id])
        assert [(x.start, x.kind, x.end) for x in r.base] == want, texts[r.doc_id]
        assert hashlib.sha256(r.s.encode()).hexdigest() == brute.base_digest(texts[r.doc_id])
        text, at, masked = texts[r.doc_id] or "", 0, ""
        for a, _, b in want:
            if a >= at:
                masked += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.masked == masked + text[at:]
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}
    return {r.doc_id: r for r in out}


def test_base_spans(spark):
    hexes = "0123456789abcdef"
    texts = [None, "", "token=secret: abcdefghijklmnop", "é token = \"abcdefABCDEF\" x", "AKIA" + "A" * 14 + "AKIA", "AKIAB AKIA" + "9" * 20, hexes + "g" + hexes[1:], "PassWord:abcdefghijkl api_key='A1b2C3d4E5f6' apikey=short", "token=" * 40, "😀 " + hexes * 3 + " secret  :  zzzzzzzzzzzz", hexes * 4000, ("token = " + "a" * 12 + " ") * 1000]
    check_spans(spark, texts)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list("tokensecrAKI0f9:= \"'\né")), max_size=80), max_size=20))
def test_base_spans_of_any_text(spark, texts):
    texts = [t.replace("k", "token=").replace("A", "AKIAAAAAAAAAAA").replace("f", "abcdef01") for t in texts]
    if texts:
        check_spans(spark, texts)


def test_weak_parts_are_reported_only_together(spark):
    whole = "user: alice1 pass=hunter22 at https://db.example.com/x"
    far = "user: alice1 " + "z " * 400 + " pass=hunter22 " + "z " * 400 + " https://db.example.com/x"
    texts = [whole, "user: alice1 pass=hunter22", "pass=hunter22 https://db.example.com/x", "user: alice1 https://db.example.com/x", far, whole, "AKIA" + "B" * 16 + " pass=hunter22 https://a.example.com", "x " * 5000 + whole]
    out = check_spans(spark, texts)
    kinds = [[x.kind for x in out[i].spans] for i in range(len(texts))]
    assert kinds == [[3, 4, 5], [], [], [], [], [3, 4, 5], [1, 4, 5], [3, 4, 5]]
    assert credentials.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weak_parts_under_base_spans_link_others(spark):
    texts = ["client_id=0123456789abcdef0123 pass=hunter22 https://db.example.com/x", "user: alice1 pass=hunter22 https://api.example.com/0123456789abcdef", "user: alice1 pass=hunter22 https://db.example.com/?token=abcdefghijkl"]
    out = check_spans(spark, texts)
    assert [[x.kind for x in out[i].spans] for i in range(3)] == [[2, 4, 5], [3, 4, 2], [3, 4, 0]]


def test_strong_secrets_link_and_blank_lines_part_scopes(spark, tmp_path):
    texts = ["user: alice1 password=hunter22hunter22 at https://db.example.com", "user: alice1\n \npass=hunter22 https://db.example.com/x", "x\n\nuser: alice1\npass=hunter22\nhttps://db.example.com/x\n\n\nuser: bob", None, "", "AKIA" + "B" * 16 + "\nsecret=abcdefghijklmnop\nhttps://a.example.com", "user: " + "z" * 3000 + " pass=hunter22 https://db.example.com/x"]
    out = check_spans(spark, texts)
    assert [[x.kind for x in out[i].spans] for i in range(7)] == [[3, 0, 5], [], [3, 4, 5], [], [], [1, 0, 5], [3, 4, 5]]
    rng = random.Random(8)
    piece = lambda: rng.choice(["user: alice1", "login=bob9", "pass=hunter22", "token: abcdefghijkl", "https://db.example.com/x", "AKIA" + "C" * 15, "0123456789abcdef", "\n\n", "\n \t\n", "z " * rng.randrange(150), "é " * 30, "\n"])
    texts += ["".join(piece() + rng.choice([" ", "\n", " "]) for _ in range(rng.randrange(25))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    brute.same_as_sql(spark, tmp_path, credentials.op9_secret_scan, credentials.OP9_SQL, documents=docs)


def test_parts_of_any_length_meet(spark):
    rng, rows = random.Random(6), set()
    for key in range(150):
        for kind in (1, 3, 4, 5):
            for _ in range(2):
                start = rng.randrange(8000)
                rows.add((key, start, kind, start + rng.choice([10, 500, 880, 1180, 3000])))
    rows |= {(200, 0, 3, 1200), (200, 1220, 4, 1240), (200, 1260, 5, 1300), (201, 0, 5, 3000), (201, 1500, 4, 1510), (201, 1400, 3, 1410)}
    near = lambda x, y: x[0] == y[0] and x[1] - y[3] <= 400 and y[1] - x[3] <= 400
    of = lambda *kinds: [x for x in rows if x[2] in kinds]
    secrets = [x for x in of(4) if any(near(x, y) for y in of(1, 3)) and any(near(x, y) for y in of(5))]
    want = {*secrets, *(x for x in of(3, 5) if any(near(x, y) for y in secrets))}
    parts = spark.createDataFrame(sorted(rows), "key long, start int, kind int, end int")
    got = [(r.key, r.start, r.kind, r.end) for r in credentials.linked_parts(parts).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
