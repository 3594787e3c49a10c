"""Rule ensemble: held-out accuracy, compiled form, and odd inputs."""

import math
import zlib

from pyspark.sql import functions as F

from boreframe.llm.quality_classifier import (STATISTICS, compile_rules, fit_rules, keep_quality, score_quality,
                                              statistics)
from tests.conftest import SF_MID


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    got = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert sum(q == r.predicted for q, r in held) / len(held) > 0.93
    # held-out labels are never read
    flipped = labels.withColumn("quality", F.when(
        F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in score_quality(docs, flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


def test_compiled_rules_equal_a_plain_evaluation(spark):
    texts = ["One two three. Four five, six.", "$$$ ### %%%", "go go go go go go", "", None, "A | b | c | d"] * 20
    rows = spark.createDataFrame([(i, t, int(i % 6 in (0, 3, 4))) for i, t in enumerate(texts)],
                                 "id long, text string, label int").select("id", "label", statistics(F.col("text")).alias("s"))
    intercept, rules = fit_rules(rows, "s", "label", trees=5)
    assert rules
    for r in rows.select("s", compile_rules(intercept, rules, "s").alias("p")).collect():
        z = intercept + sum(w for rule, w in rules
                            if all((r.s[n] <= at) if below else (r.s[n] > at) for n, below, at in rule))
        assert math.isclose(r.p, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert rows.schema["s"].dataType.names == STATISTICS


def test_odd_inputs(spark):
    schema = "doc_id long, text string, stats string, label int, l string"
    docs = spark.createDataFrame([(1, None, "", 1, ""), (2, "", "", 1, ""), (None, "a b", "", 1, ""),
                                  (1, None, "", 1, ""), (5, "word " * 30_000, "", 1, "")], schema)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = score_quality(docs, none).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    one = spark.createDataFrame([(1, 1), (1, 1), (5, 1)], "doc_id long, quality int")
    assert {r.predicted for r in score_quality(docs, one).collect()} <= {0, 1}
    assert score_quality(docs.limit(0), none).count() == 0


def test_kept_rows_keep_clashing_columns(spark):
    d = spark.createDataFrame([(i, "good plain words of prose. " * 9 if i % 2 else "$$$ ### %%%", i, i) for i in range(200)],
                              "doc_id long, text string, __score int, __stats int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = keep_quality(d, labels)
    assert got.columns == d.columns
    assert sorted(r["__stats"] for r in got.collect()) == list(range(1, 200, 2))
