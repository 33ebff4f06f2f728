"""Nearest neighbours by projections, against brute force over all pairs."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from chartloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, key int, score string"


def brute(rows, queries, k):
    """{(query id, vector): [(vec_id, score), …]} of distinct rows."""
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    known = {(i, tuple(v)) for i, v in rows if i is not None and good(v)}
    size = max(sorted({len(v) for _, v in known}), key=lambda n: sum(len(v) == n for _, v in known), default=0)
    known = sorted((i, v) for i, v in known if len(v) == size)
    x = np.array([v for _, v in known], np.float32).astype(float).reshape(len(known), size)
    ids = np.array([i for i, _ in known])
    out = {}
    for i, v in {(i, tuple(v)) for i, v in queries if i is not None and good(v) and len(v) == size}:
        s = np.add.reduce(np.array(v, np.float32).astype(float) * x, axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i, v] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def lists(got):
    out = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def close_vectors(n, seed, spread=0.15, size=16):
    """Vectors around few centres, of different lengths."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, size))
    x = centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, size))
    return (x * rng.uniform(0.5, 1.5, n)[:, None]).astype(np.float32)


def test_quantiles():
    for m, p, x in ((2, 0.95, 5.991), (8, 0.95, 15.507), (8, 0.5, 7.344), (10, 0.99, 23.209)):
        assert abs(neighbours.chi_square_quantile(p, m) - x) < 1e-3 and abs(neighbours.chi_square(x, m) - p) < 1e-4


def test_whole_search_with_full_confidence_is_exact(spark):
    """At a confidence that never stops early every list is that of brute force, copies, ties and odd rows included."""
    rng = random.Random(1)
    rows = [(i, x.tolist()) for i, x in enumerate(close_vectors(900, 2))]
    rows += [(2000 + i, rows[40][1]) for i in range(700)] + [(3000 + i, [float(rng.randrange(-1, 2)) for _ in range(16)]) for i in range(200)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (5080, [float("inf")] * 16), (5100, []), (5120, [1.0, 2.0]), (None, [1.0] * 16)]
    rows += odd + [(0, rows[0][1]), (0, rows[0][1]), (20, rows[7][1]), (40, rows[40][1])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    got = neighbours.nearest_of_every(docs, k=7, cell_rows=64, leaf_rows=8, visits_per_item=20, confidence=1 - 1e-15)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = defaultdict(list)
    for (i, _), best in brute(rows, queries, 7).items():
        want[i] += [(i, n + 1, j, s) for n, (j, s) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(r for best in want.values() for r in best)


@pytest.mark.parametrize("spread,size", [(0.15, 16), (3.0, 32)])
def test_recall_and_pruning(spark, spread, size):
    """At the default confidence at least that share is found; scores are exact and lists in order; in clusters most leaves are never opened."""
    x = close_vectors(3000, 5, spread, size)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = lists(neighbours.nearest_of_every(docs, cell_rows=512).collect())
    want = {i: best for (i, _), best in brute(rows, [r for r in rows if r[0] % 20 == 0], 20).items()}
    assert set(got) == set(want)
    found = sum(len({j for j, _ in got[i]} & {j for j, _ in best}) for i, best in want.items())
    assert found >= 0.95 * sum(map(len, want.values()))
    for i, best in got.items():
        assert len(best) == 20 and best == sorted(best, key=lambda b: (-b[1], b[0])) and i not in {j for j, _ in best}
        assert all(s == float(np.add.reduce(x[i].astype(float) * x[j].astype(float))) for j, s in best)


def test_search_stops_early_in_clusters():
    x = close_vectors(4000, 9).astype(float)
    longest = float(np.linalg.norm(x, axis=1).max())
    projection = neighbours.Projection(16, longest, 8, 7)
    cell = neighbours.Cell(x, projection.points(x), np.arange(4000), np.arange(4001), 64)
    opened, rows = [], cell.leaves.rows
    cell.leaves.rows = type("Seen", (list,), {"__getitem__": lambda self, k: (opened.append(k), list.__getitem__(self, k))[1]})(rows)
    strong = np.flatnonzero(np.linalg.norm(x, axis=1) > 0.8 * longest)[:1]
    q, found, _ = cell.search(x[strong], projection.queries(x[strong]), np.full(1, -np.inf), longest, 5, neighbours.chi_square_quantile(0.97, 8))
    assert len(q) == 5 and len(opened) < 0.5 * len(rows)


def test_fewer_rows_than_asked_and_none(spark):
    rows = [(20, [1.0, 0.0]), (40, [0.0, 1.0]), (41, [1.0, 1.0]), (60, [0.0, 0.0])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert lists(neighbours.nearest_of_every(docs).collect()) == {20: [(41, 1.0), (40, 0.0)], 40: [(41, 1.0), (20, 0.0)]}
    one = docs.filter("vec_id = 20")
    assert neighbours.nearest_of_every(one).count() == 0
    assert neighbours.nearest_of_every(docs.limit(0)).count() == 0 and neighbours.nearest(docs, docs.limit(0)).count() == 0
