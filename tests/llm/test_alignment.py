"""Alignment of two tokenizers: end arrays, whole texts and corpus counts against brute force with the libraries themselves."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from chartloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row string, a_ids int"
LETTERS = list("aAbBeEtTsSéÉñ") * 4 + list("'’.,;:!?-*#&|<>()[]\"$%@/_1234567890 \t\n ́​Σ日本🙂\x1c\x85▁\x00 　") + [" "] * 30
EDGE = [None, "", "x", " ", "  ", "a ", "\n", " \n a", "<|endoftext|> <s> </s> don't", "a  b   c\n \n d", "<0x0A> <unk>", "x▁y z", "日本語 naïve", "the cat " * 3000]


@pytest.fixture(scope="module")
def encoder():
    return alignment.PairEncoder(A, B)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return EDGE + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 150))) for _ in range(250)] + [" ".join(rng.choice(["the", "of", "un", "straße", "wörter,", "don't", "12.5", "x"]) for _ in range(rng.randrange(300))) for _ in range(60)]


def brute(encoder, text):
    """(ids of A, ids of B, groups as (A's, B's), linked pairs), empty where the text has no tokens."""
    if not text:
        return [], [], [], []
    a, b = encoder.tokenizer.encode(f" {text}", add_special_tokens=False).ids, encoder.pieces.encode(text)
    own = [[side.bytes[i] for i in ids] for side, ids in ((encoder.a, a), (encoder.b, b))]
    if any(b"".join(x) != f" {text}".encode() for x in own):
        return [], [], [], []
    begins, ends = [], []
    for tokens in own:
        stops = np.cumsum([len(t) for t in tokens]).tolist()
        begins.append([0, *stops[:-1]])
        ends.append(stops)
    groups, links, i, j = [], [], 0, 0
    for c in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
        groups.append((a[i:x], b[j:y]))
        links += [(a[p], b[q]) for p in range(i, x) for q in range(j, y) if begins[0][p] < ends[1][q] and begins[1][q] < ends[0][p]]
        i, j = x, y
    return a, b, groups, links


def digest(groups):
    line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return hashlib.sha256(line.encode()).hexdigest() if groups else ""


def test_skipping_diagonals_finds_every_meeting():
    """Random end arrays with long one-to-one stretches, lanes of all lengths together."""
    rng = random.Random(2)
    ends_a, ends_b, lanes, want_links, want_meets = [], [], [], [], []
    for _ in range(300):
        a, b, at = [], [], ends_a[-1] if ends_a else 0
        for _ in range(rng.randrange(0, 12)):
            if rng.random() < 0.5:
                for _ in range(rng.choice([1, 2, 3, 40])):
                    at += rng.randrange(1, 4)
                    a.append(at)
                    b.append(at)
            else:
                width = rng.randrange(2, 9)
                a += [at + k for k in range(1, width) if rng.random() < 0.4] + [at + width]
                b += [at + k for k in range(1, width) if rng.random() < 0.4] + [at + width]
                at += width
        i0, j0 = len(ends_a), len(ends_b)
        lanes.append((i0, i0 + len(a), j0, j0 + len(b)))
        low = [ends_a[-1] if ends_a else 0]
        for p, (x0, x1) in enumerate(zip(low + a, a)):
            want_links += [(i0 + p, j0 + q) for q, (y0, y1) in enumerate(zip(low + b, b)) if x0 < y1 and y0 < x1]
            want_meets += [(i0 + p, j0 + b.index(x1))] if x1 in b else []
        ends_a += a
        ends_b += b
    i0, i1, j0, j1 = (np.array(c, np.int64) for c in zip(*lanes))
    link_a, link_b, meet_a, meet_b = alignment.skip_diagonals(np.array(ends_a), np.array(ends_b), i0, i1, j0, j1)
    assert sorted(zip(link_a.tolist(), link_b.tolist())) == want_links
    assert sorted(zip(meet_a.tolist(), meet_b.tolist())) == want_meets
    assert all(len(x) == 0 for x in alignment.skip_diagonals(np.array([]), np.array([]), *(np.zeros(0, np.int64),) * 4))


@pytest.mark.parametrize("held", [40, 400_000])
def test_whole_texts(encoder, texts, held, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_CHUNKS", held)
    decimals = alignment.decimals_of(51_000)
    for k in range(0, len(texts), 40):
        some = texts[k : k + 40]
        x = alignment.Aligned(encoder, pa.array(some, pa.string()))
        lines, (first, upto_a, upto_b), (n, pairs, times) = x.lines(decimals), x.groups(), x.pairs()
        at = np.concatenate(([0], np.cumsum(n)))
        for i, text in enumerate(some):
            a, b, groups, links = brute(encoder, text)
            assert x.ids_a[x.at_a[i] : x.at_a[i + 1]].tolist() == a and x.ids_b[x.at_b[i] : x.at_b[i + 1]].tolist() == b, text
            assert first[i + 1] - first[i] == len(groups) and lines[i] == digest(groups), text
            mask = (1 << alignment.B_BITS) - 1
            assert {(int(p) >> alignment.B_BITS, int(p) & mask): int(t) for p, t in zip(pairs[at[i] : at[i + 1]], times[at[i] : at[i + 1]])} == Counter(links), text


@pytest.mark.parametrize("held_pairs", [0, 25, 1 << 20])
def test_counts_over_all_documents(spark, encoder, texts, held_pairs):
    """With few pairs broadcast, or none, the rest comes by the shuffle: the same counts."""
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, "the cat of the", None, None)] * 2 + [(3, "the cat", "x", 2)] * 2
    got = alignment.alignment_counts(spark.createDataFrame(rows, SCHEMA).repartition(5), A, B, held_pairs=held_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    made = [brute(encoder, r[1]) for r in rows]
    count, most = Counter(p for *_, links in made for p in set(links)), defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = [(r[0], len(a), len(b), len(g), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), digest(g)) for r, (a, b, g, links) in zip(rows, made)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_aligned_documents(spark, encoder, texts):
    docs = spark.createDataFrame([(i, t, "r", i) for i, t in enumerate(texts[:80])], SCHEMA)
    got = alignment.align_documents(docs, A, B)
    assert got.columns == [*docs.columns, "a_ids_", "b_ids", "a_ends", "b_ends"]
    for r in got.collect():
        a, b, groups, _ = brute(encoder, r.text)
        assert (r.a_ids_, r.b_ids, r.a_ids) == (a, b, r.doc_id)
        assert r.a_ends == np.cumsum([len(x) for x, _ in groups]).astype(int).tolist() and r.b_ends == np.cumsum([len(y) for _, y in groups]).astype(int).tolist()
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.align_documents(empty, A, B).count() == 0 and alignment.alignment_counts(empty, A, B).count() == 0
