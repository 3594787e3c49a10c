"""The Voronoi join and the zone-map search against brute force over all pairs."""

import itertools
import math

import numpy as np
import pytest

from boreframe.llm.hard_negatives import bounds, hard_negatives, hilbert_keys
from boreframe.llm.topk_search import top_k
from boreframe.llm.vectors import Space, best_per_row

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, cell string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "r", "c", "x") for i, v, lab in rows], SCHEMA).repartition(3)


def usable(rows):
    out = []
    for n, (i, v, lab) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((n, i, [math.floor(256 * float(np.float32(x))) for x in v], lab))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def rank_key(x):
    return -x[0], x[1] is None, x[1] or 0


def brute_top(rows, modulus=50, k=5):
    u, out = usable(rows), []
    for n, i, v, _ in u:
        if i is None or i % modulus:
            continue
        s = sorted(((dot(v, w), j) for m, j, w, _ in u if m != n), key=rank_key)
        out += [(i, r + 1, j, x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out, key=repr)


def brute_negatives(rows, modulus=100):
    u = [(n, i, v, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for n, i, v, lab in usable(rows) if lab is not None]
    out = []
    for n, i, v, lab in u:
        if i is None or i % modulus:
            continue
        s = sorted(((dot(v, w), j, other) for m, j, w, other in u if m != n), key=rank_key)
        for ps, p in [(x, j) for x, j, other in s if other == lab][:5]:
            hits = [(x, j) for x, j, other in s if other != lab and 30 * ps <= 100 * x <= 90 * ps][:10]
            out += [(i, p, r + 1, j, ps, x) for r, (x, j) in enumerate(hits)]
    return sorted(out, key=repr)


def relabel(i, label):
    from pyspark.sql import functions as F
    return F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_rows(n, dim, seed, step=10, clusters=0):
    g = np.random.default_rng(seed)
    centres = g.normal(0, 1, (max(clusters, 1), dim))
    for i in range(n):
        v = g.normal(0, 0.15, dim) + (centres[i % clusters] if clusters else 0)
        yield i * step, [float(x) for x in v], int(i % 4)


def odd_rows():
    rows = list(random_rows(60, 3, 1))
    hot = [1.5, -0.25, 0.5]
    rows += [(1000 + 50 * i, hot, i % 3) for i in range(40)]  # one vector many times
    rows += [(1000, hot, 0), (1000, hot, 1), (1050, hot, 2)]  # repeated rows
    rows += [(None, hot, 1), (None, [0.5, 0.5, 0.5], 2)]
    rows += [(5000, None, 1), (5100, [0.5, None, 1.0], 1), (5200, [0.5, math.nan, 1.0], 1), (5300, [math.inf, 0.0, 0.0], 1)]
    rows += [(5400, [], 1), (5500, [2.0], 0), (5600, [0.1, 0.2, 0.3, 0.4], 1), (5700, [1.0, 1.0, 1.0], None)]
    return rows


@pytest.mark.parametrize("rows", [odd_rows(), list(random_rows(300, 6, 2, clusters=8))], ids=["odd", "clusters"])
def test_top_k_against_brute_force(spark, rows):
    # small groups and blocks, so that many of them meet, and bounds can prune
    got = top_k(frame(spark, rows), max_pivots=12, group_rows=4, block_rows=8, task_blocks=3)
    assert collected(got) == brute_top(rows)
    assert collected(top_k(frame(spark, rows))) == brute_top(rows)


@pytest.mark.parametrize("rows", [odd_rows(), list(random_rows(300, 6, 3, clusters=8))], ids=["odd", "clusters"])
def test_hard_negatives_against_brute_force(spark, rows):
    got = hard_negatives(frame(spark, rows), relabel=relabel, block_rows=8, max_groups=5, group_rows=3, task_blocks=4)
    assert collected(got) == brute_negatives(rows)
    assert collected(hard_negatives(frame(spark, rows), relabel=relabel)) == brute_negatives(rows)


def test_large_components(spark):
    """Scores beyond float32 and float64 exactness."""
    for size in (30.0, 3e5, 3e6):
        rows = [(i * 25, [size * math.sin(i * j + 1.0) for j in range(1, 5)], i % 3) for i in range(40)]
        assert collected(top_k(frame(spark, rows))) == brute_top(rows)


def test_empty_and_lonely(spark):
    for rows in ([], [(100, [1.0, 0.0], 1)], [(100, None, 1), (200, [math.nan], 1)], [(3, [1.0], 1), (4, [2.0], 2)]):
        assert collected(top_k(frame(spark, rows))) == brute_top(rows) == []
        assert collected(hard_negatives(frame(spark, rows), relabel=relabel)) == brute_negatives(rows) == []
    one_label = [(i * 50, [float(i), 1.0], 3) for i in range(1, 8)]
    assert collected(hard_negatives(frame(spark, one_label))) == []


@pytest.mark.parametrize("dim,bits", [(1, 4), (2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_single_steps(dim, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dim)))
    keys = [bytes(k) for k in hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_interval_bounds_hold():
    g = np.random.default_rng(5)
    a, b = g.integers(-50, 50, (20, 4)), g.integers(-50, 50, (30, 4))
    low, high = bounds(a.min(0), a.max(0), b.min(0), b.max(0))
    s = a @ b.T
    assert low <= s.min() and s.max() <= high
    low, high = bounds(a, a, b.min(0), b.max(0))
    assert (low <= s.min(1)).all() and (s.max(1) <= high).all()


def test_best_per_row_breaks_ties_by_column():
    g = np.random.default_rng(6)
    for scale in (1.0, 2.0 ** 45):
        s = g.integers(0, 4, (50, 33)).astype(float) * scale
        assert (best_per_row(s, 5) == np.argsort(-s, axis=1, kind="stable")[:, :5]).all()


def test_dots_are_exact_at_every_size():
    g = np.random.default_rng(8)
    for peak in (10, 10 ** 4, 10 ** 8, 2 ** 40):
        a, b = (g.integers(-peak, peak, (5, 8)) for _ in range(2))
        norm2 = float((np.r_[a, b].astype(float) ** 2).sum(1).max())
        space = Space(10, 8, "<i8", a.min(0), a.max(0), norm2)
        want = np.clip(a.astype(object) @ b.astype(object).T, -(2 ** 63 - 1), 2 ** 63 - 1)
        assert (space.dots(a, b).astype(object) == want).all()
