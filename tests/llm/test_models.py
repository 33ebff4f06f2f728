"""Language, quality, rules, toxicity, licences and pieces: brute force, held-out accuracy, round trips, edge rows."""

import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartloom.llm import language_id, licenses, pieces, quality_classifier, quality_rules, toxicity
from tests.llm.test_dedup_mix_records import EDGE, SCHEMA

LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def corpus(n, seed=0):
    """Synthetic rows: (id, text, lang, quality, toxic)."""
    rng, out = random.Random(seed), []
    sounds = {"aa": "ka to mi ne so ru".split(), "bb": "sch ung ein ver ich tz".split(), "cc": "ção lh eu nós qu ão".split()}
    for i in range(n):
        lang = rng.choice(sorted(sounds))
        words = ["".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(15, 120))]
        quality, toxic = int(rng.random() > 0.3), int(rng.random() < 0.4)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zounds", "gadzook", "zwounds"]))
        if not quality:
            words = [w + "###" for w in words]
        out.append((i, " ".join(words) + ".", lang, quality, toxic))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame(EDGE + [(1000 + i, t, g, "s", len(t), 1, "") for i, t, g, *_ in rows], SCHEMA)
    marks = spark.createDataFrame([(1000 + i, q, x) for i, _, _, q, x in rows] + [(None, 1, 0), (1000, None, None), (10**9, 1, 1)], LABELS)
    return docs, marks


@pytest.fixture(scope="module")
def rows():
    return corpus(900)


def test_language(spark, rows):
    docs, _ = frames(spark, rows)
    got = {r.doc_id: r for r in language_id.identify(docs).collect() if r.doc_id is not None}
    assert len(got) == len({i for i, *_ in EDGE if i is not None}) + len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 8))
    unseen = [(1000 + i, g) for i, _, g, *_ in rows if held(1000 + i)]
    assert all(got[i].held_out for i, _ in unseen)
    assert np.mean([got[i].lang_pred == g for i, g in unseen]) > 0.97
    assert language_id.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language_scores_are_naive_bayes():
    texts, langs = ["ab ab", "cd!"], ["x", "y"]
    names, table = language_id.fit(texts, langs, bits=10)
    total = np.zeros((1, 2))
    for column, begin in language_id.gram_rows(["abc d"], 10):
        for c in column:
            total[0] += table[c]
    want = np.exp(total - total.max())
    pred, score = language_id.predict(["abc d", None, "12"], names, table)
    assert pred == [names[total.argmax()], "und", "und"] and score[0] == pytest.approx((want / want.sum()).max(), abs=1e-6)


def test_quality(spark, rows):
    docs, marks = frames(spark, rows)
    got = {r.doc_id: r for r in quality_classifier.rate_quality(docs, marks).collect()}
    unseen = [(1000 + i, q) for i, _, _, q, _ in rows if held(1000 + i)]
    assert np.mean([got[i].kept == bool(q) for i, q in unseen]) > 0.97
    left = quality_classifier.drop_low_quality(docs, marks)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in docs.collect() if got[r.doc_id].kept)
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_classifier.drop_low_quality(empty, marks).count() == 0
    # Repeated and conflicting labels: the largest of an id counts, and rows are rated as before.
    more = marks.unionByName(marks.filter("quality = 1").withColumn("quality", F.lit(0)))
    assert {r.doc_id: r.tail_prob for r in quality_classifier.rate_quality(docs, more).collect()} == {i: r.tail_prob for i, r in got.items()}
    none = quality_classifier.rate_quality(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == docs.count() and all(r.kept and r.tail_prob is None for r in none)
    assert quality_classifier.rate_quality(spark.createDataFrame([], SCHEMA), marks).count() == 0


def test_ordinal_fit_is_maximum_likelihood():
    """The fitted likelihood, written out text by text, is a maximum: moving any threshold or a used weight lowers it."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(12)) for _ in range(60)]
    grades = [min(2, max(0, t.count("aa") - 3 + rng.randrange(2))) for t in texts]
    ridge = 1e-2
    link = quality_classifier.fit(texts, grades, bits=8, steps=3000, rate=0.05, ridge=ridge)
    n = Counter(grades)

    def loss(weights, thresholds):
        total = ridge / 2 * float((weights.astype(float) ** 2).sum())
        for t, g in zip(texts, grades, strict=True):
            column, weight, _ = quality_classifier.hashed_text([t], 8)
            f = sum(float(w) * float(weights[c]) for c, w in zip(column, weight, strict=True))
            below = [0.0, *(1 / (1 + np.exp(f - x)) for x in thresholds), 1.0]
            total -= np.log(below[g + 1] - below[g]) / (n[g] * len(n))
        return total

    least = loss(link.weights, link.thresholds)
    used = np.argsort(-np.abs(link.weights))[:3]
    for step in (-0.3, 0.3):
        for k in range(len(link.thresholds)):
            moved = link.thresholds.copy()
            moved[k] += step
            assert loss(link.weights, moved) > least
        for c in used:
            moved = link.weights.copy()
            moved[c] += 5 * step
            assert loss(moved, link.thresholds) > least


def test_best_cut_against_every_cut():
    rng = random.Random(2)
    good = Counter(min(9999, int(rng.betavariate(6, 1) * 10_000)) for _ in range(500))
    bad = Counter(int(rng.betavariate(1, 4) * 10_000) for _ in range(200))
    cut = quality_classifier.best_cut(good, bad, 0.99)
    gain = lambda at: sum(n for b, n in bad.items() if b < at) / 200 - sum(n for b, n in good.items() if b < at) / 500
    allowed = [at for at in range(5001) if sum(n for b, n in good.items() if b < at) <= 6]
    assert gain(round(cut * 10_000)) == pytest.approx(max(map(gain, allowed))) and cut <= 0.5
    # Two wrong labels among many good rows don't pull the cut down.
    assert quality_classifier.best_cut({9000: 1000, 0: 2}, {5: 100, 3000: 100}, 0.998) > 0.3
    assert quality_classifier.best_cut({}, bad, 0.99) == 0.5


def test_ordinal_fit_orders_three_grades():
    rng = random.Random(3)
    texts, grades = [], []
    for _ in range(300):
        g = rng.randrange(3)
        texts.append(" ".join("good" if rng.random() < (0.05, 0.4, 0.9)[g] else "bad" for _ in range(60)))
        grades.append(g)
    link = quality_classifier.fit(texts[:200], grades[:200], bits=10)
    tails = link.tails(link.value(texts[200:]))
    assert (np.diff(link.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert np.mean(np.round(link.expected(tails)) == np.array(grades[200:])) > 0.9


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def test_rules(spark, rows):
    docs, marks = frames(spark, rows)
    extra = [(50, "a b c d e f a b c d e", None, None, None, 1, ""), (51, "x y z v w " * 9 + " |é", None, None, None, 1, ""), (52, "l 1\nl 1\n\n l 1\nl 1\r\n" * 3, None, None, None, 1, "")]
    docs = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = quality_rules.apply_rules(docs, marks).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        want = brute_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    by = {r.doc_id: r for r in got}
    unseen = [(1000 + i, q) for i, _, _, q, _ in rows if held(1000 + i)]
    assert np.mean([by[i].kept for i, q in unseen if q]) > 0.95
    assert np.mean([by[i].kept for i, q in unseen if not q]) < 0.1
    assert quality_rules.apply_rules(spark.createDataFrame([], SCHEMA), marks).count() == 0
    # Without labels the forest rejects nothing; with conflicting or repeated ones the largest counts, once.
    none = quality_rules.apply_rules(docs, spark.createDataFrame([], LABELS)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    more = marks.unionByName(marks).unionByName(marks.filter("quality = 1").withColumn("quality", F.lit(0)))
    assert {(r.doc_id, r.odd_score) for r in quality_rules.apply_rules(docs, more).collect()} == {(r.doc_id, r.odd_score) for r in got}


def test_rules_behave_alike_at_every_size(spark):
    """The forest learns from labelled rows only, so rows without labels, however many, don't change a verdict."""
    few = corpus(120, seed=3)
    docs, marks = frames(spark, few)
    more = docs.unionByName(spark.createDataFrame([(9000 + i, f"### {i} " * 30, None, None, None, 1, "") for i in range(2000)], SCHEMA))
    a = {r.doc_id: (r.odd_score, r.kept) for r in quality_rules.apply_rules(docs, marks).collect() if r.doc_id}
    b = {r.doc_id: (r.odd_score, r.kept) for r in quality_rules.apply_rules(more, marks).collect() if r.doc_id}
    assert all(b[i] == x for i, x in a.items())


def test_calibrate_against_every_cut():
    rng = np.random.default_rng(3)
    score, good = np.round(rng.random(300), 2), rng.random(300) < 0.8
    score[~good] += 0.3
    cut = quality_rules.calibrate(score, good, 0.95)
    gain = lambda c: (score[good] <= c).mean() - (score[~good] <= c).mean()
    assert (score[good] <= cut).mean() >= 0.95
    assert gain(cut) == pytest.approx(max(gain(c) for c in np.unique(score) if (score[good] <= c).mean() >= 0.95))
    assert quality_rules.calibrate(score, np.ones(300, bool), 0.95) == 1.0 and quality_rules.calibrate(score, np.zeros(300, bool), 0.95) == 1.0


def test_forest_scores_by_walking():
    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, 3))
    forest = quality_rules.IsolationForest(data, trees=50, size=64)
    row = np.array([9.0, 9, 9])
    total = 0
    for f, c, n in zip(forest.feature, forest.cut, forest.length, strict=True):
        node = 0
        while f[node] >= 0:
            node = 2 * node + 1 + int(row[f[node]] > c[node])
        total += n[node]
    score = forest.score(np.vstack([row, data]))
    assert score[0] == pytest.approx(2 ** (-total / 50 / forest.norm)) and score[0] > np.quantile(score[1:], 0.99)


def test_toxicity_gradients():
    net = toxicity.Network(hidden=3, dim=2, width=6, stride=4, word_bits=5, gram_bits=5)
    net.p = {k: v.astype(np.float64) * 2 for k, v in net.p.items()}
    words, at, mask, _ = net.windows([b"a bc def gh i jk lm n".split(), b"x y".split(), []])
    choose = lambda logit: (float((logit**2).sum()), 2 * logit)
    mask = mask.astype(np.float64)
    inputs = net.inputs(words)
    _, g = net.gradients(inputs, at, mask, choose)
    for k, value in net.p.items():
        spot = tuple(np.argwhere(np.abs(g[k]) == np.abs(g[k]).max())[0])
        old = value[spot]
        sides = []
        for e in (1e-2, -1e-2):
            value[spot] = old + e
            sides.append(net.gradients(inputs, at, mask, choose)[0])
        value[spot] = old
        assert g[k][spot] == pytest.approx((sides[0] - sides[1]) / 2e-2, rel=1e-2), k


def brute_logit(net, words):
    """The network's logit of one window, number by number."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    p, hid = net.p, net.hidden
    x = []
    for w in words:
        bucket, grams, _ = toxicity.hashed_words([w], net.word_bits, net.gram_bits)
        x.append(np.concatenate((p["word"][bucket[0]], np.mean([p["gram"][g] for g in grams], axis=0))))
    states = [[], []]
    for side, d in enumerate("fb"):
        h = np.zeros(hid)
        for v in x if d == "f" else x[::-1]:
            a, b = v @ p[f"{d}x"] + p[f"{d}c"], h @ p[f"{d}h"]
            z, r = sig(a[:hid] + b[:hid]), sig(a[hid : 2 * hid] + b[hid : 2 * hid])
            h = z * h + (1 - z) * np.tanh(a[2 * hid :] + r * b[2 * hid :])
            states[side].append(h)
    both = [np.concatenate(s) for s in zip(states[0], states[1][::-1], strict=True)]
    e = np.array([np.tanh(s @ p["att"]) @ p["att_v"] for s in both])
    a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return sum(k * s for k, s in zip(a, both, strict=True)) @ p["out"] + p["bias"][0]


def test_toxicity_scores_by_hand():
    net = toxicity.Network(hidden=4, dim=3, width=5, stride=3, word_bits=7, gram_bits=7, seed=1)
    texts = ["One two, three four five six seven EIGHT nine ten eleven", "a b", "Émile (x)", "", None, "!!! ???"]
    for text, score in zip(texts, net.scores(texts), strict=True):
        words = toxicity.words_of(text)
        windows = [words[i : i + 5] for i in toxicity.window_starts(len(words), 5, 3)] if words else [[b""]]
        best = max(brute_logit(net, w) for w in windows)
        assert score == pytest.approx(1 / (1 + np.exp(-best)), abs=1e-4), text


def test_hashed_pieces_of_words():
    """Trigrams and beginnings: equal beginnings share buckets, equal words all of them, wherever they stand."""
    words = [b"achlichein", b"achlichung", b"ach", b"a", b"achlichein"]
    bucket, grams, begin = toxicity.hashed_words(words, 15, 15)
    parts = np.split(grams, begin[1:])
    assert [len(x) for x in parts] == [len(w) + 3 for w in words]
    assert parts[0].tolist() == parts[4].tolist() and bucket[0] == bucket[4] and bucket[0] != bucket[1]
    assert parts[0][:2].tolist() == parts[1][:2].tolist() and parts[0][0] != parts[0][1]
    alone = toxicity.hashed_words([b"achlichung"], 15, 15)
    assert alone[1].tolist() == parts[1].tolist() and alone[0][0] == bucket[1]


def test_toxicity(spark, rows):
    docs, marks = frames(spark, rows)
    buried = " ".join(["kato miru"] * 900 + ["zounds gadzook zwounds"] + ["nesoka"] * 900)
    docs = docs.unionByName(spark.createDataFrame([(60, buried, None, None, None, 1, ""), (61, buried.replace("zounds gadzook zwounds", "ka"), None, None, None, 1, "")], SCHEMA))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, marks).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    unseen = [(1000 + i, x) for i, *_, x in rows if held(1000 + i)]
    assert np.mean([got[i].predicted == x for i, x in unseen]) > 0.95
    assert got[60].predicted == 1 and got[61].predicted == 0
    assert all(r.score == 0 for r in toxicity.score_toxicity(docs, spark.createDataFrame([], LABELS)).collect())
    assert toxicity.score_toxicity(spark.createDataFrame([], SCHEMA), marks).count() == 0


def test_toxicity_with_conflicting_labels(spark):
    few = corpus(120, seed=6)
    docs, marks = frames(spark, few)
    more = marks.unionByName(marks).unionByName(marks.filter("toxic = 1").withColumn("toxic", F.lit(0)))
    a, b = ({(r.doc_id, r.score) for r in toxicity.score_toxicity(docs, x).collect()} for x in (marks, more))
    assert a == b and len({i for i, _ in a}) == len({r[0] for r in EDGE}) + 120


def test_windows_cover_texts():
    for n in range(1, 200):
        starts = toxicity.window_starts(n, 32, 24)
        assert {w for s in starts for w in range(s, min(n, s + 32))} == set(range(n))


def test_licenses(spark):
    mit = "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + licenses.MIT.upper().replace("SUBLICENSE", "sub-license").replace(", ", " ,\n")
    bsd = "BSD 3-Clause Licence\n\n(c) 1999, X\n" + licenses.BSD_GRANT + "\n" + "".join(f" - {c}\n" for c in (licenses.BSD_1, licenses.BSD_2, licenses.BSD_3)) + licenses.BSD_DISCLAIMER.replace(" ", "\n  ")
    extra = [
        (70, mit), (71, mit + " more"), (72, "Text.\n  * released under the MIT Licence\nLicensed under CC BY 4.0\nreleased under the mit license!"),
        (73, "Released under the MIT License. " + "*" * 400), (74, "x\n" + "=" * 5000 + " Released under the MIT License.\ny"), (75, "Released under the MIT License. " + "a" * 400),
        (76, bsd), (77, licenses.UNLICENSE.lower() + "\n\nFor more information — please refer to http://unlicense.org"), (78, "Boost Software License – Version 1.0 – August 17th, 2003\n" + licenses.BOOST), (79, "Copyright 2001 A\nB"),
    ]
    docs = spark.createDataFrame(EDGE + [(i, t, None, None, None, 1, "") for i, t in extra], SCHEMA).withColumn("lines", F.lit(1)).withColumn("digest", F.lit(2))
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[70].license, got[71].license) == ("MIT", None)
    assert (got[72].license, got[72].notices, got[72].n_notices) == (None, "CC-BY-4.0,MIT", 3)
    assert [(got[i].notices, got[i].n_notices) for i in (73, 74, 75)] == [("MIT", 1), ("MIT", 1), ("", 0)]
    assert [got[i].license for i in (76, 77, 78, 79)] == ["BSD-3-Clause", "Unlicense", "BSL-1.0", None]
    assert got[3].notices == "" and got[3].text_digest == got[4].text_digest
    assert licenses.scan_licenses(docs).count() == docs.count()
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    many = spark.createDataFrame([("X", "notice", f"n {i}") for i in range(30)], "license string, kind string, body string")
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, licenses.known_licenses(spark, [tuple(r) for r in many.collect()]), most_notices=20)


def test_long_licenses(spark, tmp_path):
    """Whole texts of long licences, set in other cases, lines, dashes and spellings, by digest and from a folder of files."""
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all((folder / n).exists() for n in names):
        pytest.skip("no licence texts here")
    texts = {n: (folder / n).read_text() for n in names}
    other = lambda t: "\n\n".join(p.replace("\n", "  \n * ") for p in t.upper().replace("LICENSE", "Licence").replace('"', "“").replace("-", "–").split("\n\n"))
    rows = [(i, t) for i, t in enumerate(texts.values())] + [(100 + i, other(t)) for i, t in enumerate(texts.values())] + [(200, texts["GPL-3"] + "\nand more")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    want = dict(enumerate(names.values()))
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs).collect()}
    assert {i: got[i] for i in want} == want and got[200] is None
    assert sum(got[100 + i] == want[i] for i in want) >= 5
    for n, t in texts.items():
        (tmp_path / n).write_text(t)
    own = licenses.licenses_of_files(spark, f"file://{tmp_path}/*")
    assert {r.doc_id: r.license for r in licenses.scan_licenses(docs, own).collect() if r.doc_id < 100} == dict(enumerate(names))


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_round_trip(model):
    texts = ["", " ", "  a", "a  b   c ", "▁x ▁", "日本🙂é́\n\t", "<s>", "x" * 3000, "\0a\0 b\0", "ſß", "<0x41>"]
    coded = model.encode(texts, ["k"] * len(texts))
    assert [model.decode(x) for x in coded] == texts
    assert [x.tolist() for x in coded] == [model.encode([t], ["k"])[0].tolist() for t in texts]


def test_pieces_follow_the_lattice(model):
    """Frequencies of samples against all segmentations, listed one by one."""
    by = {}
    for i in range(model.size):
        if np.isfinite(model.log_p[i]) and i not in model.byte_id:
            by[model.bytes[i]] = i

    def all_ways(s):
        return [((), 0.0)] if not s else [((by[s[:k]], *rest), p + model.log_p[by[s[:k]]]) for k in range(1, len(s) + 1) if s[:k] in by for rest, p in all_ways(s[k:])]

    ways = all_ways(b" thans")
    p = np.exp([x for _, x in ways])
    p /= p.sum()
    n = 20_000
    seen = Counter(tuple(x.tolist()) for x in model.encode(["thans"] * n, [str(i) for i in range(n)]))
    assert set(seen) <= {w for w, _ in ways}
    for (way, _), share in zip(ways, p, strict=True):
        assert abs(seen[way] / n - share) < 0.02


def test_pieces_are_the_same_however_held(model, monkeypatch):
    """Long words by plain numbers and others in numpy, held or forgotten lattices, one text at a time or all: one sample."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdeé 日\n") for _ in range(rng.randrange(1, 900))) for _ in range(60)] + ["x" * 5000 + " " + "日本" * 900]
    keys = [str(i) for i in range(len(texts))]
    want = [x.tolist() for x in model.encode(texts, keys)]
    monkeypatch.setattr(pieces, "LONG", 5)
    monkeypatch.setattr(pieces, "HELD_WORDS", 40)
    other = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    for _ in range(2):
        assert [other.encode([t], [k])[0].tolist() for t, k in zip(texts, keys, strict=True)] == want
    assert len(other.number) < 500 and [other.decode(x) for x in want] == texts


def test_pieces_that_do_not_come_back(model):
    texts = ["ab cd", None, "ef", ""]
    ids, ends = model.encode_flat(pa.array(texts), list("1234"))
    assert model.come_back(ids, ends, pa.array(texts)).all()
    wrong = ids.copy()
    wrong[-1] = model.encode(["z"], ["0"])[0][-1]
    assert model.come_back(wrong, ends, pa.array(texts)).tolist() == [True, True, False, True]


def test_pieces_of_documents(spark, model):
    docs = spark.createDataFrame(EDGE, SCHEMA).withColumn("piece_ids", F.lit("old"))
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode_documents(docs, path)
    assert coded.columns == docs.columns and len(docs.columns) == len(set(docs.columns))
    rows = coded.collect()
    again = {(r.doc_id, r.text): r.piece_ids for r in pieces.encode_documents(docs.repartition(3), path).collect()}
    assert len(rows) == len(EDGE)
    assert all(again[r.doc_id, r.text] == r.piece_ids for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode_documents(coded, path).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in rows)
    digests = {r.doc_id: r for r in pieces.segmentation_digests(docs, path).collect()}
    for r in rows:
        d = digests[r.doc_id]
        assert d.lossless and d.n_pieces == len(r.piece_ids) and d.ids_crc32 == zlib.crc32(np.array(r.piece_ids, "<i4").tobytes())
    assert pieces.encode_documents(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_samples_are_bounded_in_classes_and_bytes(spark):
    """Of ten thousand values of a class the most frequent teach; a text of many bytes teaches nothing, and is scored."""
    from chartloom.llm.common import sample_rows

    rows = [(i, f"junk {i}") for i in range(2000)] + [(5000 + i, "en") for i in range(50)] + [(6000 + i, "fr") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, lang string")
    assert {r.lang for r in sample_rows(table, "doc_id", "lang", 1000, 3, max_classes=2).collect()} == {"en", "fr"}
    docs = spark.createDataFrame([(i, "the cat sat on a mat " * 3 if g == "en" else "le chat est sur la table " * 3 if g == "fr" else "x", g) for i, g in rows], "doc_id long, text string, lang string")
    got = {r.lang_pred for r in language_id.identify(docs, max_languages=2).collect()}
    assert got == {"en", "fr"}
    marks = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, ("vile filthy words here " if i % 2 else "kind gentle words here ") * (2000 if i < 8 else 3)) for i in range(80)], "doc_id long, text string")
    few = toxicity.score_toxicity(texts, marks, max_taught_bytes=1000)
    assert few.count() == 80 and {r.predicted for r in few.filter("doc_id < 8").collect()} == {0, 1}
