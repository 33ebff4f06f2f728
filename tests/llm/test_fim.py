"""Fill-in-middle over compressed frames, against plain Python on whole texts."""

import hashlib
import random
import re

import duckdb
import pytest

from chartloom.llm import fim

SCHEMA = "doc_id long, text string, frames int, fim_text string"
EDGE = [
    (1, "a\nb\n\nc", 1, "x"),
    (None, "no id\n\n", 2, "y"),
    (None, "no id\n\n", 2, "y"),
    (3, None, None, None),
    (4, "", 4, ""),
    (5, "holds <P> a marker\nx", 5, ""),
    (6, "\n", 6, ""),
    (7, "é\n日本語\n🙂🙂" * 300, 7, ""),
    (7, "é\n日本語\n🙂🙂" * 300, 7, ""),
    (8, "one very long line " * 20_000, 8, ""),
    (9, "<P\n>", 9, ""),
    (10, "x\r\n\x00 y", 10, ""),
]


def brute(doc_id, text, seed=7, rate=100, spm=50):
    """(n, form, prefix chars, middle chars, output)."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    letters = list("ab \n\n") + ["é", "日", "🙂", "<", "P", ">", "\r"]
    return EDGE + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(400))), i, "") for i in range(200)]


@pytest.mark.parametrize("frame_bytes", [5, 64, fim.FRAME_BYTES])
def test_digests_equal_whole_texts(spark, rows, frame_bytes):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = fim.fim_digests(docs if frame_bytes > 5 else docs.filter("doc_id is null or doc_id <> 8"), frame_bytes=frame_bytes)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [(i, n, form, p, m, sha(out), sha(t or "")) for i, t, *_ in rows if frame_bytes > 5 or i != 8 for n, form, p, m, out in [brute(i, t)]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


def test_texts_and_rates(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for rate, spm in ((100, 50), (40, 0), (0, 50), (100, 100)):
        got = fim.fill_in_middle(docs, seed=3, rate=rate, spm=spm)
        # Names that are taken stay; the new ones differ.
        assert got.columns == [*docs.columns, "fim_text_", "fim_form"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(*r, out, form) for r in rows for _, form, _, _, out in [brute(r[0], r[1], 3, rate, spm)]], key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert fim.fill_in_middle(empty).count() == 0 and fim.fim_digests(empty).count() == 0


def test_sql_twin(spark, rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    assert sorted(map(tuple, fim.fim_digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == sorted(con.sql(fim.ORACLE_SQL).fetchall(), key=str)


def test_frames_open_few_and_find_across():
    text = ("line of text\n" * 10_000 + "é" * 5000 + "<M>end").encode()
    f = fim.Frames.of([text[:70_001], text[70_001:70_003], text[70_003:]], 1000)
    assert b"".join(f.span(0, f.size)) == text and f.n_lines() == 10_001 and f.n_chars == len(text.decode())
    assert all(len(f.open(k)) <= 1000 and f.open(k).decode() for k in range(len(f.data)))
    opened, plain_open = [], f.open
    f.open = lambda k: (opened.append(k), plain_open(k))[1]
    assert f.cut(7777) == (13 * 7777, 13 * 7777) and len(opened) == 1
    assert f.cut(10_001) == (len(text), len(text.decode())) and f.cut(0) == (0, 0)
    assert f.find(b"<M>") == text.find(b"<M>") and f.find(b"t\nl", 13) == text.find(b"t\nl", 13) and f.find(b"<S>") == -1
    assert b"".join(f.span(999, 3003)) == text[999:3003] and not list(f.span(5, 5))
