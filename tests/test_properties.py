"""Properties on the driver tables (well-log view at sf0.001)."""

from pyspark.sql import functions as F

from boreframe import config as C
from boreframe.operators import prepare as I
from boreframe.operators import quality as Q
from boreframe.plans.q_analytics import labelled_normalized
from boreframe.sources.testview import KEY, TARGET, wells

from .conftest import SF_SMALL

FEATS = list(C.FEATURES)


def test_split_is_exact_partition(spark):
    df = labelled_normalized(spark, SF_SMALL)
    sp = I.stratified_split(df, "LABEL", KEY, 0.2)
    got = {r["LABEL"]: (r["n"], r["t"]) for r in
           sp.groupBy("LABEL").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    for lab, (n, t) in got.items():
        assert t == int(0.2 * n + 0.5)
    assert sum(n for n, _ in got.values()) == df.count()
    # repeatable
    again = I.stratified_split(df, "LABEL", KEY, 0.2).where("is_test").select(*KEY)
    assert again.exceptAll(sp.where("is_test").select(*KEY)).count() == 0


def test_folds_balanced(spark):
    df = labelled_normalized(spark, SF_SMALL)
    fo = I.stratified_folds(df, "LABEL", KEY, k=3)
    sizes = {}
    for r in fo.groupBy("LABEL", "fold").count().collect():
        sizes.setdefault(r["LABEL"], []).append(r["count"])
    for lab, s in sizes.items():
        assert max(s) - min(s) <= 1


def test_scaled_moments(spark):
    lab = Q.drop_null_target(wells(spark, SF_SMALL), TARGET)
    fills = I.fit_median(lab, FEATS)
    sc = I.fit_scaler(lab, FEATS, fills)
    ex = I.scaled_exprs(FEATS, fills, sc)
    m = lab.select(*[ex[f].alias(f) for f in FEATS]).agg(
        *[F.avg(f).alias(f"m_{f}") for f in FEATS], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATS]).first()
    for f in FEATS:
        assert abs(m[f"m_{f}"]) < 1e-9
        assert abs(m[f"s_{f}"] - 1) < 1e-9


def test_issue_count_matches_flags(spark):
    lab = Q.drop_null_target(wells(spark, SF_SMALL), TARGET)
    fences = Q.iqr_fences(lab, FEATS)
    ann = Q.annotate_rows(lab, FEATS, {f: fences[f].flag(f) for f in FEATS})
    bad = ann.where((F.col("Quality_Score") < 0) | (F.col("Quality_Score") > 100)).count()
    assert bad == 0
    n_parts = F.when(F.col("Quality_Issues") == "", F.lit(0)).otherwise(F.size(F.split("Quality_Issues", "; ")))
    assert ann.where(n_parts != F.col("Issue_Count")).count() == 0


def test_sample_sizes(spark):
    df = wells(spark, SF_SMALL)
    n = df.count()
    smp = I.stratified_sample(df, TARGET, KEY, max_samples=1000)
    counts = I.class_counts(df, TARGET)
    got = I.class_counts(smp, TARGET)
    for g, c in counts.items():
        assert got[g] == min(c, max(1, (1000 * c) // n))


def test_quotas_are_exact_on_repeated_keys(spark):
    df = spark.createDataFrame([(i % 7, i, "AB"[i % 2]) for i in range(1000)], "k int, v int, y string")
    for keys in (["k"], ["y"]):
        sp = I.stratified_split(df, "y", keys, 0.2)
        assert {r[0]: r[1] for r in sp.where("is_test").groupBy("y").count().collect()} == {"A": 100, "B": 100}
        fo = I.stratified_folds(df, "y", keys, k=5)
        assert {r[2] for r in fo.groupBy("y", "fold").count().collect()} == {100}


def test_narrowing_keeps_every_value(spark):
    df = spark.createDataFrame([(1, 300, 70_000, 5_000_000_000, 0.5), (-7, -300, -70_000, 1, None)],
                               "a long, b long, c long, d long, e double")
    out = I.apply_narrowing(df, I.narrowing_plan(df).collect())
    assert [t for _, t in out.dtypes] == ["tinyint", "smallint", "int", "bigint", "double"]
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in df.collect()]
