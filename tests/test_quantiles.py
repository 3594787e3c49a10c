import math
import random

from pyspark.sql import functions as F

from boreframe.functions.quantiles import exact_quantiles, quantile_map


def _pandas_like(vals, p):
    v = sorted(x for x in vals if x is not None)
    h = (len(v) - 1) * p
    lo = math.floor(h)
    hi = min(lo + 1, len(v) - 1)
    return v[lo] + (v[hi] - v[lo]) * (h - lo)


def test_refinement_matches_sorting(spark):
    rnd = random.Random(7)
    vals = [rnd.lognormvariate(0, 2) for _ in range(20000)] + [5.0] * 7000 + [None] * 100
    df = spark.createDataFrame([(v, rnd.choice("ab")) for v in vals], "x double, g string")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    fast = quantile_map(df, ["x"], probs)["x"]
    slow = quantile_map(df, ["x"], probs, small_n=0, small_bytes=0, collect_limit=500, buckets=16)["x"]
    for p, a, b in zip(probs, fast, slow):
        ref = _pandas_like(vals, p)
        assert abs(a - ref) <= 1e-9 * max(1, abs(ref))
        assert abs(b - ref) <= 1e-9 * max(1, abs(ref))


def test_grouped_refinement(spark):
    rnd = random.Random(3)
    rows = [(float(rnd.randint(0, 50)), "hot") for _ in range(9000)] + \
        [(rnd.random(), "cold") for _ in range(3000)]
    df = spark.createDataFrame(rows, "x double, g string")
    res = exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], group_col="g", small_n=0, small_bytes=0,
                          collect_limit=200, buckets=8)
    for g in ("hot", "cold"):
        vals = [x for x, gg in rows if gg == g]
        for p, got in zip([0.25, 0.5, 0.75], res[(g, "x")]):
            assert abs(got - _pandas_like(vals, p)) < 1e-9


def test_constant_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    q = quantile_map(df, ["a", "b"], [0.5])
    assert q["a"] == [1.0]
    assert q["b"] == [None]


def test_seeded_unseeded_and_wrong_seed_agree(spark):
    from boreframe.functions.quantiles import _refine
    rnd = random.Random(11)
    vals = [rnd.gauss(0, 1) ** 3 for _ in range(30000)] + [2.0] * 9000
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.25, 0.5, 0.75]
    kw = dict(small_n=0, small_bytes=0, collect_limit=300, buckets=32)
    seeded = quantile_map(df, ["x"], probs, seed_accuracy=200, **kw)["x"]
    plain = quantile_map(df, ["x"], probs, seed_accuracy=0, **kw)["x"]
    for p, a, b in zip(probs, seeded, plain):
        ref = _pandas_like(vals, p)
        assert abs(a - ref) < 1e-9 and abs(b - ref) < 1e-9
    # a seed bracket that misses the rank falls back to the full range
    base = df.select(F.lit("__all__").alias("__g"), "x")
    n = len(vals)
    wrong = [(10.0, 11.0)] * len(probs)
    got = _refine(base, [("__all__", "x", n, min(vals), max(vals), wrong)], probs, 32, 300, 64)
    for p, a in zip(probs, got[("__all__", "x")]):
        assert abs(a - _pandas_like(vals, p)) < 1e-9
