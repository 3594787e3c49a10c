"""Quality report flow for an uploaded table: nulls, out-of-bounds, invalid
labels, recommendations, table score and the issue-row downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import config as C
from ..config import LogConfig
from ..operators import conform as P
from ..operators import quality as Q
from ..sources import sinks

ANALYSIS_COLUMNS = list(C.FEATURES) + ["DEPTH_MD"]


def analyze(df: DataFrame, cfg: LogConfig = LogConfig(), normalize_first: bool = False) -> dict:
    """All report parts as DataFrames (lazy; each is one or two aggregates)."""
    df, _ = P.auto_mapping_interactive(df)
    cols = [c for c in ANALYSIS_COLUMNS if c in df.columns]
    target = P.find_target(df.columns)
    df = Q.clean_curves(df, cols)
    if normalize_first and target:
        df = P.normalize_labels(df, target, cfg.label_codes)
    out = {
        "issue_rows": Q.all_issue_rows(df, cols, target, cfg),
        "null_rows": Q.null_issue_rows(df, cols, target),
        "oob_rows": Q.oob_issue_rows(df, cols, cfg),
        "oob_summary": Q.oob_summary(df, cols, cfg),
        "missing_profile": Q.missing_profile(df, cols, target),
        "recommendations": Q.recommendations(df, cols, target, cfg),
        "table_score": Q.table_quality_score(df, cols, target, cfg),
    }
    if target:
        out["invalid_rows"] = Q.invalid_label_rows(df, target, cfg.expected_labels)
        out["invalid_summary"] = Q.invalid_label_summary(df, target, cfg.expected_labels)
    return out


def write_reports(report: dict, path: str, mode: str = "errorifexists") -> str:
    """The issue rows as one table partitioned by issue type, from one scan."""
    return sinks.write_issue_reports(report["issue_rows"], path, mode)
