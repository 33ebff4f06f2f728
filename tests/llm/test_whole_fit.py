"""The quality classifier's weights and cut come from all labelled rows that aren't held out."""

import random

import numpy as np
from pyspark.sql import functions as F

from chartloom.llm import quality_classifier
from chartloom.llm.common import unit_hash
from tests.llm.test_models import held

SEED = 17


def labelled(n):
    """(id, text, grade): far more good rows than a sample of 1,200 would hold, all different; some empty."""
    rng, out = random.Random(8), []
    for i in range(n):
        good = rng.random() < 0.9
        words = [rng.choice("ka to mi ne so ru".split()) + rng.choice(["", "la", "##"] if good else ["", "##", "##"]) for _ in range(rng.randrange(2, 9))]
        out.append((i, "" if i % 401 == 0 else " ".join(words), int(good)))
    return out


def test_every_labelled_row_counts(spark):
    rows = labelled(4000)
    docs, marks = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    aside = {r.doc_id for r in docs.filter(unit_hash(F.col("doc_id"), SEED + 1) < 0.2).select("doc_id").collect()}
    teach = [r for r in rows if not held(r[0]) and r[0] not in aside]
    assert sum(q for *_, q in teach) > 2000
    want = quality_classifier.fit([t for _, t, _ in teach], [q for *_, q in teach])
    tails = want.tails(want.value([t for _, t, _ in rows]))[:, 0]
    got = {r.doc_id: r for r in quality_classifier.rate_quality(docs, marks, seed=SEED).collect()}
    assert max(abs(got[i].tail_prob - tails[i]) for i, *_ in rows) < 1e-9
    bins = np.floor(tails * quality_classifier.BINS).astype(int)
    counts = [dict(zip(*np.unique([bins[i] for i, _, q in rows if i in aside and not held(i) and q == grade], return_counts=True), strict=True)) for grade in (1, 0)]
    cut = quality_classifier.best_cut(*counts, 0.998)
    assert np.mean([got[i].kept == (tails[i] >= cut) for i, *_ in rows]) > 0.999


def test_fit_is_the_same_however_rows_are_dealt(spark):
    rows = [(float(q if i % 7 else 2), False, t) for i, t, q in labelled(300)]
    frame = spark.createDataFrame(rows, "grade double, aside boolean, text string")
    links = [quality_classifier.fit_all(quality_classifier.table_of_entries(frame.repartition(n)), steps=4) for n in (1, 5)]
    links.append(quality_classifier.fit([r[2] for r in rows], [r[0] for r in rows], steps=4))
    assert [link.grades for link in links] == [[0.0, 1.0, 2.0]] * 3
    assert all((link.weights == links[0].weights).all() and (link.thresholds == links[0].thresholds).all() for link in links)


def test_fit_ends_at_the_maximum_in_fewer_passes(monkeypatch):
    rows, passes, slopes = labelled(600), [], quality_classifier.slopes
    texts, grades = [t for _, t, _ in rows], [q for *_, q in rows]
    monkeypatch.setattr(quality_classifier, "slopes", lambda *a: passes.append(1) or slopes(*a))
    link = quality_classifier.fit(texts, grades, bits=12)
    assert len(passes) < 120
    y, n = np.array(grades), np.bincount(grades)

    def loss(link):
        tails = link.tails(link.value(texts))[:, 0]
        return -(np.log(np.where(y == 1, tails, 1 - tails)) / (2 * n[y])).sum() + 1e-5 / 2 * (link.weights.astype(float) ** 2).sum()

    monkeypatch.setattr(quality_classifier, "LEAST_GAIN", 1e-9, raising=False)
    assert loss(link) < 1.001 * loss(quality_classifier.fit(texts, grades, bits=12, steps=1500))


def test_labels_are_not_broadcast_while_they_are_few(spark, tmp_path, monkeypatch):
    rows, plans = labelled(50), []
    spark.createDataFrame(rows, "doc_id long, text string, quality int").write.parquet(f"{tmp_path}/rows")
    both, made = spark.read.parquet(f"{tmp_path}/rows"), quality_classifier.table_of_entries
    monkeypatch.setattr(quality_classifier, "table_of_entries", lambda frame: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or made(frame))
    assert quality_classifier.rate_quality(both.select("doc_id", "text"), both.select("doc_id", "quality")).count() == 50
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_few_entries_take_few_tasks(spark, monkeypatch):
    """Each task of a pass sends the driver a row of slopes, so their number follows the entries, not the files that hold them."""
    frame, asked = spark.createDataFrame([(float(q), False, t) for _, t, q in labelled(300)], "grade double, aside boolean, text string"), []
    taught, coalesce = quality_classifier.table_of_entries(frame.repartition(20)), type(frame).coalesce
    want = quality_classifier.fit_all(taught, steps=3)
    monkeypatch.setattr(type(frame), "coalesce", lambda self, n: asked.append(n) or coalesce(self, n))
    quality_classifier.fit_all(taught, steps=3)
    assert asked == [1]
    monkeypatch.setattr(quality_classifier, "ENTRIES_OF_TASK", 1000)
    many = quality_classifier.fit_all(taught, steps=3)
    assert 1 < asked[1] <= quality_classifier.MOST_TASKS
    assert (many.weights == want.weights).all() and (many.thresholds == want.thresholds).all()
