"""Batch scoring flow: detect format -> map columns -> score -> threshold ->
write -> summary (the command-line scoring path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..operators import conform as P
from ..operators import score as R
from ..operators import train as T
from ..sources import readers, sinks
from ..streaming.scoring import score_stream


def score_input(spark: SparkSession, input_path: str, model_dir: str, model_name: str = "best",
                confidence: float = 0.0, column_mapping: str | None = None, output_path: str | None = None,
                fmt: str | None = None):
    """Score a well table with the newest saved run; returns (scored, summary frames)."""
    models, _ = T.load_latest(spark, model_dir)
    if model_name == "best":
        met = T.load_metrics(spark, model_dir)  # a run saved without metrics: its first model
        model_name = met.orderBy(met.f1_score.desc(), "model").first()["model"] if met is not None else sorted(models)[0]
    if model_name not in models:
        raise ValueError(f"Model '{model_name}' not found. Available: {sorted(models)}")
    df = readers.read_table(spark, input_path, fmt=fmt)
    if column_mapping:
        df, _applied, _unknown = P.manual_mapping(df, column_mapping)
    else:
        df, _applied = P.auto_mapping_batch(df)
    feats = [f for f in C.FEATURES if f in df.columns]
    if len(feats) < 3:
        raise ValueError(f"Insufficient features. Need at least 3, got {len(feats)}")
    scored = score_stream(models[model_name], df, list(C.FEATURES), threshold=confidence,
                          fitted=T.load_imputer(spark, model_dir))
    if output_path:
        sinks.write_table(scored, output_path, partition_by=("WELL",) if "WELL" in df.columns else ())
    return scored, prediction_report(scored)


def prediction_report(scored: DataFrame, pred: str = "Predicted_Lithology",
                      conf: str = "Prediction_Confidence") -> dict:
    """R8/R9/R5 summaries of a scored table."""
    return {
        "summary": R.prediction_summary(scored, pred, conf),
        "distribution": R.label_distribution(scored, pred),
        "confidence_bands": R.confidence_bands4(scored, conf),
    }
