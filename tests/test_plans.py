"""End-to-end flows: training run, quality report, batch scoring, CLI, entry."""

import os
import tempfile

from pyspark.sql import functions as F

from boreframe import config as C
from boreframe.config import LogConfig
from boreframe.operators import evaluate as E
from boreframe.operators import score as R
from boreframe.sources.synthetic import CLASSES_5, synthetic_logs

from .conftest import SF_SMALL

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _synth(spark):
    src = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    return synthetic_logs(src, KEY, CLASSES_5, null_rate=0.05).cache()


def test_training_run_end_to_end(spark):
    from boreframe.plans.training_run import RunOptions, run
    d = tempfile.mkdtemp(prefix="bf-run-")
    df = _synth(spark)
    opts = RunOptions(rf_grid={"numTrees": [5], "maxDepth": [4]}, gbt_grid={"maxIter": [2], "maxDepth": [3]},
                      folds=2, key=tuple(KEY), max_samples=1000)
    res = run(spark, df, LogConfig(key=tuple(KEY)), opts, model_dir=f"{d}/models", out_dir=f"{d}/out")
    assert set(res.models) == {"random_forest", "xgboost"}
    assert res.extra["learners"] == {"random_forest": "search", "xgboost": "search"}
    assert res.imputation in ("median", "mean", "knn", "iterative")
    assert [t for t, _ in res.bakeoff] == ["median", "mean", "knn", "iterative"]
    m = {r["model"]: r for r in res.metrics.collect()}
    assert m["random_forest"]["accuracy"] > 0.8
    enh = spark.read.parquet(f"{d}/out/enhanced")
    assert enh.count() == df.count()  # max_samples bounds the fit, not the outputs
    assert res.extra["n_train"] <= 1000 and res.extra["fitted"].technique == res.imputation
    assert "ML_Predicted_Lithology" in enh.columns and "Data_Quality_Score" in enh.columns
    assert "Predicted_Lithology" not in enh.columns
    s = res.summary.first()
    assert s["best_model"] == res.best_model and s["dataset_info"]["classes"] == 5

    # batch scoring with the saved run (R13 flow + threshold)
    from boreframe.plans.batch_scoring import score_input
    df.write.parquet(f"{d}/input.parquet")
    scored, report = score_input(spark, f"{d}/input.parquet", f"{d}/models", confidence=0.99,
                                 output_path=f"{d}/scored")
    back = spark.read.parquet(f"{d}/scored")
    assert back.count() == df.count()
    assert back.where(F.col("Predicted_Lithology") == C.LOW_CONFIDENCE_LABEL).count() == \
        back.where(F.col("Prediction_Confidence") < 0.99).count()
    assert report["summary"].first()["total"] == df.count()


def test_quality_report_flow(spark):
    from boreframe.plans.quality_report import analyze, write_reports
    df = spark.createDataFrame(
        [("W", 1.0, 50.0, "Shale"), ("W", 2.0, None, "Tuffite"), ("W", 3.0, 400.0, None)],
        "WELL string, DEPTH_MD double, gamma_ray double, Lithology string")
    rep = analyze(df)
    assert rep["null_rows"].count() == 2            # GR null + missing label
    assert rep["oob_rows"].count() == 1             # GR 400
    assert rep["invalid_rows"].count() == 1         # Tuffite
    score = rep["table_score"].first()
    assert score["total_issue_rows"] == 4 and abs(score["quality_score"] - 0.0) < 1e-9
    d = tempfile.mkdtemp(prefix="bf-rep-")
    write_reports(rep, f"{d}/issues")
    types = {r[0] for r in spark.read.parquet(f"{d}/issues").select("Issue_Type").distinct().collect()}
    assert types == {"Null_GR", "Null_Lithology", "OutOfBounds_GR", "Invalid_Lithology"}


def test_pick_by_accuracy_tie_goes_to_forest(spark):
    m = spark.createDataFrame([("extra_trees", 0.9), ("random_forest", 0.9)], "model string, accuracy double")
    assert E.pick_by_accuracy(m).first()["model"] == "random_forest"


def test_depth_bins_mode(spark):
    df = spark.createDataFrame([("W", 0.0, "A"), ("W", 0.5, "B"), ("W", 0.7, "B"), ("W", 1.2, "C")],
                               "WELL string, DEPTH_MD double, L string")
    got = {r["depth_bin"]: r["mode_label"] for r in R.depth_bins(df, "WELL", "DEPTH_MD", "L", 1.0).collect()}
    assert got == {0: "B", 1: "C"}


def test_cli_quality(spark, tmp_path):
    from boreframe.__main__ import main
    p = tmp_path / "w.csv"
    p.write_text("WELL,GR,RHOB,NPHI,Lithology\nA,10,2.0,0.1,Shale\nA,,2.1,0.2,Coal\n")
    assert main(["quality", str(p), "--out", str(tmp_path / "rep")]) == 0
    assert spark.read.parquet(str(tmp_path / "rep" / "issues")).count() == 1


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
