"""Exact dedup, near dedup, mixing and records against plain Python on small tables."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chartloom.llm import exact_dedup, mixing, records, simhash
from chartloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string"
EDGE = [
    (1, "A b c d e", "en", "s1", 9, 1, "x"),
    (2, "a B c d e", None, "s1", 9, 1, "x"),
    (3, None, "en", None, None, 1, None),
    (4, "", "en", None, 0, 1, ""),
    (5, "É b", "fr", "s2", 3, 1, ""),
    (6, "é b", "fr", "s2", 3, 1, ""),
    (7, "long word " * 20_000, "en", "s3", None, 1, ""),
    (8, " \t\n", None, "s3", 3, 1, ""),
    (8, " \t\n", None, "s3", 3, 1, ""),
    (None, "a b c d e", "en", "s1", 9, 1, ""),
]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_merge_summaries_keeps_heavy():
    rng = random.Random(3)
    total, k, summary, data = 0, 10, Counter(), []
    for _ in range(50):
        part = ["hot"] * 30 + [f"v{rng.randrange(1000)}" for _ in range(70)]
        data += part
        exact_dedup.merge_summaries(summary, Counter(part), k)
    true = Counter(data)
    assert len(summary) <= k
    assert 0 <= true["hot"] - summary["hot"] <= len(data) / (k + 1)


def test_exact_groups(spark):
    rng = random.Random(1)
    rows = EDGE + [(i, rng.choice(["x y", "X Y", f"t {i % 40}", "HOT copy", "hot COPY"]), None, "s", 1, 1, "") for i in range(100, 600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = exact_dedup.exact_groups(docs, counters=50, least_share=0.05).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(lower(r[1]).encode()).hexdigest()].append(r[0])
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        g = groups[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == max((x for x in g if x is not None), default=None)
        kept[r.text_sha256] += r.kept
        if r.kept:
            assert r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert sorted(map(tuple, exact_dedup.exact_groups(docs, counters=3, least_share=1.0).drop("kept").collect()), key=str) == sorted(map(tuple, docs.sparkSession.createDataFrame(got).drop("kept").collect()), key=str)
    clash = docs.withColumn("_digest", F.lit("mine")).withColumn("_key_id", F.lit(1))
    for share in (0.05, 1.0):
        left = exact_dedup.drop_exact_copies(clash, counters=50, least_share=share)
        kept = left.collect()
        assert left.columns == clash.columns and {r._digest for r in kept} == {"mine"}
        # One row of each group, the one with the largest id.
        best = Counter((hashlib.sha256(lower(r.text).encode()).hexdigest(), r.doc_id) for r in kept)
        assert best == {(k, max((x for x in g if x is not None), default=None)): 1 for k, g in groups.items()}
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_heavy_digests_are_those_with_a_share(spark):
    rows = [(i, "hot") for i in range(60)] + [(100 + i, "warm") for i in range(20)] + [(200 + i, f"t{i}") for i in range(120)]
    table = spark.createDataFrame(rows, "_id long, digest string").withColumn("_row", F.monotonically_increasing_id())
    assert {r.digest: r.group_size for r in exact_dedup.heavy_groups(table, 50, 0.2).collect()} == {"hot": 60}
    assert {r.digest: r.group_size for r in exact_dedup.heavy_groups(table, 50, 0.1).collect()} == {"hot": 60, "warm": 20}
    with pytest.raises(ValueError):
        exact_dedup.heavy_groups(table, 5, 0.1)


def test_repeated_ids_in_a_heavy_group(spark):
    rows = [(i % 10, "hot") for i in range(40)] + [(None, "hot"), (77, "x"), (77, "x"), (77, "y"), (None, "z"), (None, "z")]
    kept = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string"), counters=50, least_share=0.1).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(9, "hot"), (77, "x"), (77, "y"), (None, "z")], key=str)


def brute_fingerprint(text):
    words = lower(text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(nodes, linked):
    parent = {v: v for v in nodes}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


@pytest.mark.parametrize("chunk", [1, 16, 4096])
def test_near_links_equal_all_pairs(spark, chunk):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(rng.integers(0, 2**63, 300, dtype=np.uint64).tolist())
    for b in base:
        for _ in range(12):
            flip = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 6)).astype(np.uint64))
            fps.add(int(b ^ flip))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), chunk=chunk)
    got = {r.v: r.component for r in connected_components(edges).collect()}
    links = [(signed[i], signed[j]) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = brute_components(signed, links)
    assert {v: got.get(v, v) for v in want} == want


def test_blocks_of_bits_find_every_link():
    """Any two fingerprints within the budget agree on the top of one trie at least; turning keeps all bits."""
    rng = random.Random(1)
    pairs = simhash.block_pairs(4)
    assert len(pairs) == 15 and min(w for _, w in pairs) >= 20
    for _ in range(2000):
        flip = sum(1 << b for b in rng.sample(range(64), 4))
        turned = [(int(simhash.turned(np.array([flip], np.uint64), order)[0]), w) for order, w in pairs]
        assert all(t.bit_count() == 4 for t, _ in turned) and any(t >> (64 - w) == 0 for t, w in turned)


def test_work_of_a_fingerprint_is_bounded(spark):
    """15 rows for each fingerprint, however many there are; in a node of over `chunk` leaves a row for each of its chunks."""
    fps = spark.range(200_000).select(F.xxhash64("id").alias("fp")).distinct()
    work = simhash.work_items(fps)
    assert work.count() == 15 * fps.count()
    assert work.groupBy("item").count().agg(F.max("count")).first()[0] < 100
    node = spark.range(3000).select((F.shiftrightunsigned(F.xxhash64("id"), 24)).alias("fp")).distinct()
    n = node.count()
    cut = simhash.work_items(node, chunk=1000)
    assert cut.groupBy("item").count().agg(F.max("count")).first()[0] < 2500
    assert cut.count() < 15 * 4 * n


def test_near_duplicates(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    rows = list(EDGE)
    for g in range(30):
        text = [rng.choice(words) for _ in range(150)]
        for k in range(3):
            copy = list(text)
            copy[rng.randrange(150)] = "changed"
            rows.append((100 + 10 * g + k, " ".join(copy), "en", "s", 1, 1, ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{f:016x}") for i, f in fps)
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a][1] ^ fps[b][1]).bit_count() <= 4]
    parts = brute_components(range(len(fps)), links)
    least = {}
    for k, (i, _) in enumerate(fps):
        least[parts[k]] = min((x for x in (i, least.get(parts[k])) if x is not None), default=None)
    want = sorted(((i, f"{f:016x}", least[parts[k]]) for k, (i, f) in enumerate(fps)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert len(set(parts.values())) < len(rows)
    left = simhash.drop_near_copies(docs)
    kept = left.collect()
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in kept) == Counter(least[p] for p in set(parts.values()))
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


def test_near_copies_with_repeated_ids(spark):
    """Rows go by id and text, not by id alone: a text that resembles nothing stays whatever id it shares."""
    rng = random.Random(9)
    text = [f"w{rng.randrange(9000)}" for _ in range(300)]
    a, near, b = " ".join(text), " ".join([*text[:299], "other"]), " ".join(f"v{rng.randrange(9000)}" for _ in range(300))
    for rows, want in (
        ([(3, a), (7, near), (7, b)], [(3, a), (7, b)]),
        ([(3, b), (7, near), (7, a), (7, a), (3, b)], [(3, b), (7, min(a, near, key=lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (2**64 if xxhash.xxh64_intdigest(t.encode(), 42) >= 2**63 else 0)))]),
        ([(None, a), (None, near), (None, b)], None),
        ([(None, a), (5, near), (None, None), (None, "")], [(5, near), None]),
    ):
        got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        if want is None:
            assert len(got) == 2 and b in {r.text for r in got}
        elif None in want:
            assert len(got) == 2 and {r.text or "" for r in got} == {near, ""}
        else:
            assert sorted(map(tuple, got)) == sorted(want)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(5, 4), (100, 200)], "src long, dst long")
    got = {r.v: r.component for r in connected_components(edges).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {4: 4, 5: 4, 100: 100, 200: 100}


def brute_targets(sizes, repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(repeats * sizes[s] for s in capped)
        target = {s: repeats * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > repeats * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(spark):
    rng = random.Random(4)
    rows = list(EDGE)
    for i in range(1000, 4000):
        source = rng.choice(["hot"] * 8 + ["b", "tiny" if i < 1030 else "c", "ä", None])
        rows.append((i, "w " * rng.randrange(0, 300), "en", source, 1, 1, ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, docs_per_shard=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), docs_per_shard=64).collect()))
    source = {}
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
        source[r[0]] = r[3]
    want = brute_targets(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 48 + 0.002 * want[s], (s, taken[s], want[s])
    mixed = mixing.mixed_documents(docs.withColumn("_copies", F.lit(5)))
    assert mixed.columns == [*docs.columns, "_copies"]
    assert max(Counter((r.doc_id, r.text) for r in mixed.collect()).values()) <= 3
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mix_of_rows_without_ids_and_of_repeats(spark):
    """Rows without an id, and repeats, are documents like others: the mix takes its share of them, spread over shards."""
    rows = [(None, f"a b c d e f g h {i}", "s1") for i in range(3000)] + [(i % 50, f"x y z w {i}", "s2") for i in range(2000)] + [(1, "one two three four", "s3")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs, docs_per_shard=32).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source_size] += r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    for s, n in sizes.items():
        assert s == n and abs(taken[s] - target[s]) <= 48 + 0.01 * target[s]
    mixed = mixing.mixed_documents(docs, docs_per_shard=32).collect()
    by = Counter(r.source for r in mixed)
    assert abs(by["s1"] * 9 - target[27000]) < 0.1 * target[27000] and by["s2"] > 0 and by["s3"] > 0


def test_equal_rows_share_exactly(spark):
    """Rows equal in id, source and text: what they take adds up, and copies are drawn as often as their target asks."""
    some = [(i, f"some words of the text {i} here", "b", i) for i in range(300)]
    for many in ([(7, "hi there", "a", 1)] * 3000, [(None, "hi", "a", 1)] * 3000, [(None, "hi", "a", i) for i in range(3000)], [(7, "one two three", "a", i % 3) for i in range(900)]):
        docs = spark.createDataFrame(many + some, "doc_id long, text string, source string, extra int").repartition(4)
        got = mixing.mix(docs).collect()
        assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(r[1].split())) for r in many + some)
        hot = len(many[0][1].split())
        own = [r for r in got if r.source_size == hot * len(many)]
        assert len(own) == len(many) and abs(sum(r.taken for r in own) - own[0].target) <= 16
        assert max(r.taken for r in own) - min(r.taken for r in own) <= 1 and max(r.taken for r in own) <= 3 * hot
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        rows = [tuple(r) for r in mixed.collect()]
        taken = [r for r in rows if r[2] == "a"]
        assert abs(len(taken) * hot - own[0].target) <= 16 + hot and set(taken) <= set(many)
        # Rows that differ in other columns only have nearly the same number of copies each.
        copies, there = Counter(taken), Counter(many)
        assert max(abs(copies[k] - len(taken) * there[k] / len(many)) for k in there) <= 1
        assert sorted(rows, key=str) == sorted(map(tuple, mixing.mixed_documents(docs.repartition(7)).collect()), key=str)


def test_mix_takes_blocks_of_the_circle(spark):
    """What a document takes, against blocks laid by hand on the one circle of each source."""
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs, block_words=4, docs_per_shard=100).collect()}
    for source in "ab":
        own = [got[i] for i, _, s in rows if s == source]
        length, taken = own[0].source_size, sum(r.taken for r in own)
        assert taken % 4 == 0 and abs(taken - own[0].target) <= 4
        # One contiguous stretch beyond whole turns: at most two documents take a part of what whole turns leave.
        turns, rest = divmod(taken, length)
        part = [r.taken - turns * r.size for r in own]
        assert sum(part) == rest and all(0 <= p <= r.size for p, r in zip(part, own, strict=True))
        assert sum(0 < p < r.size for p, r in zip(part, own, strict=True)) <= 2


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(6)
    rows, seats = [], {}
    for p in range(30):
        seats[p] = rng.randrange(1, 200)
        rows += [(p, c, rng.randrange(1, 1000), seats[p], 10**6) for c in range(rng.randrange(1, 20))]
    got = {(r.p, r.c): r.q for r in mixing.apportion(spark.createDataFrame(rows, "p int, c int, votes long, seats long, cap long"), ["p"], "c", "votes", "seats", "cap", "q").collect()}
    for p, n in seats.items():
        votes = {c: v for q, c, v, *_ in rows if q == p}
        won = dict.fromkeys(votes, 0)
        for _ in range(n):
            won[max(votes, key=lambda c: (votes[c] / (2 * won[c] + 1), -c))] += 1
        assert won == {c: got[p, c] for c in votes}


def test_frames_find_damage():
    data = b"".join(records.frame(p) for p in (b"", b"abc", b"x" * 1000))
    assert list(records.frames(data)) == [b"", b"abc", b"x" * 1000]
    for at in (0, 9, 20, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.frames(data[:-3]))
    doc, ids = records.unpack(records.pack(-5, np.array([1, 70_000], np.uint32), None))
    assert doc == -5 and ids.tolist() == [1, 70_000]


def test_encoding_by_parts_equals_whole_texts(monkeypatch):
    """Random texts of odd characters, with few parts held: the ids of the library for whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(11)
    letters = list("aAbBeEtTsSéÉñüÜяЯß") * 6 + list("'’.,;:!?-*#&|<>()[]\"$%@/_1234567890 \t\n\u00a0\u0301\u0331\u200bΣσ日本🙂\x1c\x85")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 200))) for _ in range(400)]
    monkeypatch.setattr(records, "HELD_PARTS", 300)
    for i in range(0, 400, 20):
        got = records.encode_texts(path, texts[i : i + 20])
        assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[i : i + 20]]


def test_records_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = EDGE + [
        (20, "It's the <|endoftext|> 12,5 é̀ x y z ᲀ ΑΣ Σ. I'LL don't\x1c\x85b İ", "en", "s", 1, 1, ""),
        (21, "日本語 text🙂🙂 naïve--<|startoftext|>--Ǆ", "en", "s", 1, 1, ""),
        (-3, "  The the THE  \n\n the, 'the' ", "en", "s", 1, 1, ""),
        (22, "(Word) \"word\", 'sword's it's --dash--x a.b A/B ***Ok*** ÉTÉ, état! Привет, ПРИВЕТ? <|EndOfText|> <|endoftext|>, x", "en", "s", 1, 1, ""),
        (23, "H\u0331 h\u0331 E\u0301t E\u0301T\u0301. ΟΔΟΣ. ΟΔΟΣ ΟΔΟΣα ǅ, ﬁ ß ẞ İI ıi 1st 2ND $3.50 ½ ² \u00a0x\u3000Y", "en", "s", 1, 1, ""),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    folder = f"file://{tmp_path}/rec"
    manifest = records.write_records(docs, path, folder, shards=3).cache()
    got = records.record_digests(manifest).orderBy("start").collect()
    start = 0
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    for (doc_id, text), r in zip(order, got, strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids)), text
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    whole = {(r.doc_id, r.start): r.ids for r in records.read_records(manifest).collect()}
    assert len(whole) == len(rows) and sum(map(len, whole.values())) == start
    # Rows with one id may be split; without a number of shards it follows from the bytes.
    hot = spark.createDataFrame([(5, f"t {i}") for i in range(400)] + [(None, f"n {i}") for i in range(400)], "doc_id long, text string")
    assert records.n_shards(hot, "text", 100) > 20
    many = records.write_records(hot, path, f"file://{tmp_path}/hot", shard_bytes=100).cache()
    assert max(r.documents for r in many.collect()) < 200
    assert [r.doc_id for r in records.record_digests(many).orderBy("start").collect()] == [None] * 400 + [5] * 400
    assert records.record_digests(records.write_records(spark.createDataFrame([], SCHEMA), path, f"file://{tmp_path}/none")).count() == 0


def test_survivors_of_repeated_rows_are_the_same_on_reruns(spark):
    """Rows equal in id and, but for case, in text, with other columns that differ: the row that stays doesn't depend on the order."""
    rows = [(7, t, g, s) for t in ("A b c d e f", "a B c d e f", "a b C d e f") for g in ("en", None) for s in ("x", "y")] + [(1, "other text of some words", "en", "x"), (None, "a b c d e f", None, "z")]
    schema = "doc_id long, text string, lang string, _row string"
    kept = []
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, schema).repartition(seed + 1)
        for stage in (exact_dedup.drop_exact_copies, simhash.drop_near_copies):
            out = stage(docs)
            assert out.columns == docs.columns
            kept.append((stage.__name__, sorted(map(tuple, out.collect()), key=str)))
    assert len({str(k) for k in kept}) == 2
