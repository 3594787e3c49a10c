"""Golden mini-tables for the edge cases (hand-computed expectations)."""

import math

import pytest
from pyspark.sql import functions as F

from boreframe import config as C
from boreframe.config import LogConfig
from boreframe.operators import conform as P
from boreframe.operators import evaluate as E
from boreframe.operators import prepare as I
from boreframe.operators import quality as Q
from boreframe.operators import score as R

FEATS = list(C.FEATURES)
SCHEMA = "id int, " + ", ".join(f"{f} double" for f in FEATS) + ", LITH string"


def test_confidence_band_edges(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]], "c double")
    b4 = {r["band"]: r["count"] for r in R.confidence_bands4(df, "c").collect()}
    # right-closed: .5 -> Low, .7 -> Medium, .9 -> High, 1 -> Very High; 0 falls outside
    assert b4 == {"Low (0-0.5)": 1, "Medium (0.5-0.7)": 2, "High (0.7-0.9)": 2, "Very High (0.9-1.0)": 1}
    c3 = {r["band"]: r["count"] for r in R.confidence_categories3(df, "c").collect()}
    assert c3 == {"Low_Confidence": 2, "Medium_Confidence": 2, "High_Confidence": 2}
    k3 = {r["confidence_level"]: r["count"] for r in R.confidence_counts3(df, "c").collect()}
    # left-closed: >= .8 (0.8, 0.9, 1.0), [.6, .8) (0.6, 0.7), < .6 (0, 0.5)
    assert k3 == {"High (≥0.8)": 3, "Medium (0.6-0.8)": 2, "Low (<0.6)": 2}


def test_constant_and_mad_zero(spark):
    rows = [(1.0, 5.0), (1.0, 5.0), (1.0, 5.0), (1.0, 9.0), (1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    z = Q.outlier_flags(df, ["a", "b"], "zscore")
    assert df.where(z["a"]).count() == 0          # std 0: nobody flagged
    mz = Q.outlier_flags(df, ["a", "b"], "modified_zscore")
    assert df.where(mz["a"]).count() == 0         # MAD 0 and all equal the median
    assert df.where(mz["b"]).count() == 1         # MAD 0: x != median flagged


def test_all_null_curve(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, GR double")
    prof = {r["column"]: r for r in Q.missing_profile(df, ["GR"]).collect()}
    assert prof["GR"]["missing_count"] == 2 and prof["GR"]["missing_pct"] == 100.0
    assert prof["GR"]["status"] == C.STATUS_BAD
    fences = Q.iqr_fences(df, ["GR"])
    assert fences["GR"].lower is None
    assert I.fit_median(df, ["GR"])["GR"] is None


def test_row_scores(spark):
    # row 1: six nulls -> 100 - 30 - min(60, 50) = 20
    # row 2: one null + one outlier -> 100 - 30 - 20 - 20 = 30
    rows = [(1, None, None, None, None, None, None, "Shale"),
            (2, None, 2.0, 0.1, 10.0, 90.0, 1000.0, "Shale")] + \
           [(i, 50.0, 2.0, 0.1, 10.0, 90.0, 3.0, "Shale") for i in range(3, 23)]
    df = spark.createDataFrame(rows, SCHEMA)
    fences = Q.iqr_fences(df, FEATS)
    ann = Q.annotate_rows(df, FEATS, {f: fences[f].flag(f) for f in FEATS})
    got = {r["id"]: r for r in ann.collect()}
    assert got[1]["Quality_Score"] == 20
    assert got[1]["Quality_Issues"] == "; ".join(f"Null in {f}" for f in FEATS)
    assert got[2]["Quality_Score"] == 30
    assert got[2]["Quality_Issues"] == "Null in GR; Outlier in PEF"
    assert got[2]["Techniques_Applied"] == "Median Imputation; Outlier Preserved; StandardScaler"
    assert got[2]["Best_Technique"] == "Imputation: Median"
    assert got[2]["Processing_Notes"] == C.OUTLIER_NOTE
    assert got[5]["Quality_Score"] == 100 and got[5]["Quality_Issues"] == ""
    assert got[5]["Techniques_Applied"] == "StandardScaler"


def test_label_normalization(spark):
    df = spark.createDataFrame([("65000",), ("65000.0",), ("Shale",), ("12345",), (None,)], "LITH string")
    out = [r["L"] for r in P.normalize_labels(df, "LITH", out="L").collect()]
    assert out == ["Sandstone", "Sandstone", "Shale", "12345", None]
    rep = P.label_normalize_report(df, "LITH").first()
    assert rep["distinct_before"] == 4 and rep["distinct_after"] == 3 and rep["codes_mapped"] == 2


def test_bounds_nan_and_tokens(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("WELL;GR;RHOB\nA;300;3.5\nA;NA;NaN\nA;-1;1.0\nA;oops;2\n")
    from boreframe.sources.readers import read_csv
    df = read_csv(spark, str(p))
    rows = df.orderBy(F.col("GR").asc_nulls_first()).collect()
    assert [r["GR"] for r in rows] == [None, None, -1.0, 300.0]
    oob = Q.oob_issue_rows(df, ["GR", "RHOB"]).collect()
    # 300 and 3.5 are on the inclusive bounds; only -1 is out
    assert [(r["Issue_Type"], r["Actual_Value"]) for r in oob] == [("OutOfBounds_GR", -1.0)]
    assert oob[0]["Issue_Description"] == "GR outside range 0-300"
    assert all(r["RHOB"] is None or not math.isnan(r["RHOB"]) for r in rows)


def test_class_report_never_predicted_never_observed(spark):
    rows = [("A", "A"), ("A", "B"), ("B", "B"), ("C", "B")]
    df = spark.createDataFrame(rows, "y string, p string")
    cm = E.confusion_matrix(df, "y", "p").collect()
    assert len(cm) == 9 and sum(r["count"] for r in cm) == 4
    rep = {r["class"]: r for r in E.class_report(df, "y", "p").collect()}
    assert rep["C"]["precision"] == 0.0 and rep["C"]["recall"] == 0.0 and rep["C"]["f1_score"] == 0.0
    assert rep["A"]["precision"] == 1.0 and rep["A"]["recall"] == 0.5
    assert rep["B"]["precision"] == pytest.approx(1 / 3)
    assert rep["accuracy"]["precision"] == 0.5
    w = E.weighted_metrics(df, "y", "p").first()
    # weighted by support: A 2, B 1, C 1
    assert w["precision"] == pytest.approx((2 * 1.0 + 1 * (1 / 3) + 0) / 4)
    norm = {(r["actual"], r["predicted"]): r["share"] for r in E.confusion_normalized(df, "y", "p").collect()}
    assert norm[("A", "B")] == 0.5


def test_duplicate_alias_targets(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "dt double, sonic double")
    with pytest.raises(ValueError):
        P.auto_mapping_batch(df)
    out, applied = P.auto_mapping_interactive(df)
    assert applied == {"dt": "DTC"} and out.columns == ["DTC", "sonic"]
    m, applied, unknown = P.manual_mapping(df, "dt:DTC, nope:GR")
    assert applied == {"dt": "DTC"} and unknown == ["nope"]


def test_simple_annotations(spark):
    df = spark.createDataFrame([(1, None, None, 1.0, 1.0, 1.0, 1.0, "x")], SCHEMA)
    r = Q.simple_annotations(df, FEATS).first()
    assert r["Null_Count"] == 2 and r["Data_Quality_Score"] == 80
    assert r["Quality_Issues"] == "Null in GR; Null in RHOB"


def test_threshold_mask(spark):
    df = spark.createDataFrame([("A", 0.3), ("B", 0.9)], "p string, c double")
    out = [r[0] for r in df.select(R.threshold_mask(F.col("p"), F.col("c"), 0.5)).collect()]
    assert out == [C.LOW_CONFIDENCE_LABEL, "B"]
    out0 = [r[0] for r in df.select(R.threshold_mask(F.col("p"), F.col("c"), 0.0)).collect()]
    assert out0 == ["A", "B"]


def test_py_format_matches_python(spark):
    from boreframe.functions.exprs import py_format
    vals = [0.25, 0.35, 0.15, 12.25, 7.85, 2.675, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(py_format("v", ".1f")).collect()]
    assert got == [None if v is None else format(v, ".1f") for v in vals]


def test_decode_index_out_of_range(spark):
    from boreframe.operators.prepare import decode_index
    d = spark.createDataFrame([(0,), (1,), (2,), (-1,), (-2,), (None,)], "i int")
    got = [r[0] for r in d.select(decode_index(F.col("i"), ["A", "B"])).collect()]
    assert got == ["A", "B", "Unknown_Class_2", "Unknown_Class_-1", "Unknown_Class_-2", None]
