"""The pipeline on a small fixture: each stage against what plain Python makes of the rows before it."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest

from chartloom.llm import pieces, quality_classifier
from tests.llm.test_dedup_mix_records import brute_components, brute_fingerprint, brute_targets, lower
from tests.llm.test_models import LABELS, corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(n=260):
    """Documents with exact and near copies, repeated and missing ids, null and empty texts; and labels."""
    rng = random.Random(5)
    made = corpus(n, seed=5)
    rows = [(1000 + i, t, g, rng.choice(["a", "b", "b", "b", None]), len(t)) for i, t, g, *_ in made]
    rows += [(5000 + k, rows[k][1].upper() if k % 2 else rows[k][1], *rows[k][2:]) for k in range(20)]
    near = [(6000 + k, rows[k][1] + " ka to mi ne so", *rows[k][2:]) for k in range(20, 40) if len(rows[k][1].split()) > 90]
    rows += near + [(None, rows[50][1], None, "a", 1), (None, rows[51][1], None, None, None), (1000, rows[52][1], "aa", "b", 3)]
    rows += [rows[60], (3, None, None, None, None), (4, "", "aa", "a", 0), (4, " \n", None, "b", 2), (None, None, None, None, None)]
    rows += [(None, t, g, "b", len(t)) for _, t, g, q, _ in corpus(30, seed=77) if q]
    rng.shuffle(rows)
    marks = [(1000 + i, q, x) for i, _, _, q, x in made] + [(None, 1, 0), (1003, 0, 0), (1003, 1, 1)]
    return rows, marks


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(rows of each stage's input and output in order, the folder)."""
    folder = tmp_path_factory.mktemp("pipeline")
    rows, marks = table()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, LABELS).write.parquet(f"{folder}/labels.parquet")
    at, out = spark.read.parquet(f"{folder}/documents.parquet"), [rows]
    columns = at.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(folder)).write.parquet(f"{folder}/stage{k}")
        at = spark.read.parquet(f"{folder}/stage{k}")
        assert at.columns == (columns if k < 4 else [*columns, "piece_ids"]), name
        out.append([tuple(r) for r in at.collect()])
    return out, str(folder)


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "source mix", "sentencepiece"]


def test_quality_stage(spark, stages):
    (before, after, *_), folder = stages
    docs, marks = spark.createDataFrame(before, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet")
    verdict = defaultdict(set)
    for r in docs.join(quality_classifier.rate_quality(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), marks).filter("doc_id is not null"), "doc_id").select("doc_id", "text", "kept").collect():
        verdict[r.doc_id].add(r.kept)
    once = {i for i, n in Counter(r[0] for r in before).items() if n == 1 and i is not None}
    assert Counter(r for r in after if r[0] in once) == Counter(r for r in before if r[0] in once and verdict[r[0]] == {True})
    assert not Counter(after) - Counter(before) and 0 < len(after) < len(before)


def test_exact_stage(stages):
    before, after = stages[0][1:3]
    groups = defaultdict(list)
    for r in before:
        groups[hashlib.sha256(lower(r[1]).encode()).hexdigest()].append(r)
    assert len(after) == len(groups) < len(before)
    for r in after:
        group = groups.pop(hashlib.sha256(lower(r[1]).encode()).hexdigest())
        assert r in group and r[0] == max((x[0] for x in group if x[0] is not None), default=None)


def test_near_stage(stages):
    before, after = stages[0][2:4]
    fps = [brute_fingerprint(r[1]) for r in before]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    parts = brute_components(range(len(fps)), links)
    groups = defaultdict(list)
    for k, r in enumerate(before):
        groups[parts[k]].append(r)
    assert len(after) == len(groups) < len(before)
    for group in groups.values():
        (kept,) = [r for r in group if r in after]
        assert kept[0] == min((x[0] for x in group if x[0] is not None), default=None)


def test_mix_stage(stages):
    before, after = stages[0][3:5]
    copies = Counter(after)
    assert set(copies) <= set(before) and max(copies.values()) <= 3 and any(r[0] is None for r in after)
    words = lambda r: len((r[1] or "").split())
    assert all(words(r) for r in after)
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += words(r)
    for r in after:
        taken[r[3]] += words(r)
    target = brute_targets(sizes)
    # Whole documents are drawn, so a source comes near its target but for some documents' words.
    assert all(abs(taken[s] - target[s]) < 0.15 * target[s] + 500 for s in sizes)


def test_pieces_stage(stages):
    before, after = stages[0][4:6]
    model = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter(r[:5] for r in after) == Counter(before)
    assert all(model.decode(r[5]) == r[1] for r in after)


def test_run_is_the_stages(spark, stages):
    out, folder = stages
    assert sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(map(str, out[-1]))


def test_stages_of_empty_tables(spark, stages, tmp_path):
    _, folder = stages
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        for where in (folder, str(tmp_path)):
            assert stage(spark, none, where).count() == 0
    # Without labels the classifier keeps all.
    some = spark.createDataFrame(table(100)[0], SCHEMA)
    assert corpus_pipeline.STAGES[0][1](spark, some, str(tmp_path)).count() == some.count()
