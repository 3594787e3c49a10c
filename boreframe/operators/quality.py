"""Data-quality operators (Q1-Q24).

Pattern used throughout: one statistics aggregate over all curves (a handful
of scalars collected to the driver), then a narrow projection that carries the
scalars as literals.  Literals keep the row work inside whole-stage codegen
and let Catalyst push the comparisons into the parquet scan when filtering.
No operator here shuffles rows; aggregates shuffle only partial results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import LogConfig
from ..functions.exprs import count_true, fmt2, nan_to_null, outside, pct, py_format
from ..functions.quantiles import quantile_map


# ---------------------------------------------------------------------------
# statistics (driver receives a few scalars per curve)
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Fence:
    lower: float | None
    upper: float | None
    q1: float | None = None
    q3: float | None = None

    def flag(self, c) -> Column:
        if self.lower is None or self.upper is None:
            return F.lit(False)
        return outside(c, self.lower, self.upper)


def iqr_fences(df: DataFrame, features, factor: float = C.IQR_FACTOR, **qkw) -> dict:
    """Q1/Q3 (exact, linear) and the [Q1-k*IQR, Q3+k*IQR] fences per curve."""
    q = quantile_map(df, features, [0.25, 0.75], **qkw)
    out = {}
    for f in features:
        q1, q3 = q[f]
        if q1 is None:
            out[f] = Fence(None, None)
            continue
        iqr = q3 - q1
        out[f] = Fence(q1 - factor * iqr, q3 + factor * iqr, q1, q3)
    return out


def zscore_params(df: DataFrame, features) -> dict:
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.avg(f).alias(f"m{i}"), F.stddev_samp(f).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    return {f: (r[f"m{i}"], r[f"s{i}"]) for i, f in enumerate(features)}


def mad_params(df: DataFrame, features, **qkw) -> dict:
    """Median and median absolute deviation per curve (nulls ignored)."""
    med = {f: v[0] for f, v in quantile_map(df, features, [0.5], **qkw).items()}
    dev = df.select(*[F.abs(F.col(f) - F.lit(med[f])).alias(f) if med[f] is not None
                      else F.lit(None).cast("double").alias(f) for f in features])
    mad = {f: v[0] for f, v in quantile_map(dev, features, [0.5], **qkw).items()}
    return {f: (med[f], mad[f]) for f in features}


def outlier_flags(df: DataFrame, features, method: str = "iqr", stats: dict | None = None,
                  threshold: float = C.ZSCORE_THRESHOLD, **qkw) -> dict:
    """Per-curve outlier flag expressions for one of the three rules (Q3/Q4/Q5)."""
    if method == "iqr":
        stats = stats or iqr_fences(df, features, **qkw)
        return {f: stats[f].flag(f) for f in features}
    if method == "zscore":
        stats = stats or zscore_params(df, features)
        out = {}
        for f in features:
            m, s = stats[f]
            if m is None or not s:
                out[f] = F.lit(False)
            else:
                out[f] = F.coalesce(F.abs((F.col(f) - F.lit(m)) / F.lit(s)) > F.lit(threshold),
                                    F.lit(False))
        return out
    if method == "modified_zscore":
        stats = stats or mad_params(df, features, **qkw)
        out = {}
        for f in features:
            med, mad = stats[f]
            if med is None:
                out[f] = F.lit(False)
            elif mad == 0:
                out[f] = F.coalesce(F.col(f) != F.lit(med), F.lit(False))
            else:
                z = F.lit(C.MODIFIED_Z_FACTOR) * (F.col(f) - F.lit(med)) / F.lit(mad)
                out[f] = F.coalesce(F.abs(z) > F.lit(threshold), F.lit(False))
        return out
    raise ValueError(f"unknown outlier method {method!r}")


# ---------------------------------------------------------------------------
# conform
# ---------------------------------------------------------------------------

def clean_curves(df: DataFrame, features) -> DataFrame:
    """Cast curves to double and map NaN to NULL (once, at ingest)."""
    return df.withColumns({f: nan_to_null(f) for f in features if f in df.columns})


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Rows without a target are not trained on nor annotated."""
    return df.where(F.col(target).isNotNull())


def complete_cases(df: DataFrame, cols) -> DataFrame:
    """Keep rows with every listed column present."""
    return df.na.drop("any", subset=list(cols))


# ---------------------------------------------------------------------------
# Q1 missing-value profile
# ---------------------------------------------------------------------------

def missing_profile(df: DataFrame, features, target: str | None = None) -> DataFrame:
    """Per column: missing count, percent and status (one aggregate, then stack)."""
    cols = list(features) + ([target] if target and target in df.columns else [])
    aggs = [F.count(F.lit(1)).alias("__n")] + [
        (F.count(F.lit(1)) - F.count(F.col(c))).alias(f"__m{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    long = wide.selectExpr(
        "__n", "stack({}, {}) as (column, missing_count)".format(
            len(cols), ", ".join(f"'{c}', __m{i}" for i, c in enumerate(cols))))
    p = pct(F.col("missing_count"), F.col("__n"))
    return long.select(
        "column", F.col("missing_count").cast("long").alias("missing_count"),
        p.alias("missing_pct"),
        F.when(F.col("missing_count") == 0, F.lit(C.STATUS_OK))
         .when(p < 10, F.lit(C.STATUS_WARN)).otherwise(F.lit(C.STATUS_BAD)).alias("status"))


# ---------------------------------------------------------------------------
# Q2/Q3/Q7/Q8/Q9 row annotations
# ---------------------------------------------------------------------------

def annotate_rows(df: DataFrame, features, outliers: dict, imputation: str | None = "median",
                  prefix: str = "") -> DataFrame:
    """Add null/outlier flags, issue text, techniques, notes and the row score.

    ``outliers`` maps curve -> flag expression (see ``outlier_flags``).
    ``imputation`` is the technique name applied to rows with nulls; ``None``
    means no imputation happened (no nulls in the table).
    """
    nulls = {f: F.col(f).isNull() for f in features}
    has_null = count_true(nulls.values()) > 0
    has_out = count_true(outliers.values()) > 0
    n_issues = count_true(nulls.values()) + count_true(outliers.values())
    issues = F.concat_ws("; ", *[F.when(nulls[f], F.lit(f"Null in {f}")) for f in features],
                         *[F.when(outliers[f], F.lit(f"Outlier in {f}")) for f in features])
    techniques = [F.lit("StandardScaler")]
    best = F.lit("")
    if imputation:
        name = imputation.capitalize()
        techniques.insert(0, F.when(has_null, F.lit(f"{name} Imputation")))
        best = F.when(has_null, F.lit(f"Imputation: {name}")).otherwise(F.lit(""))
    techniques.insert(len(techniques) - 1, F.when(has_out, F.lit("Outlier Preserved")))
    score = F.greatest(
        F.lit(0),
        F.lit(100)
        - F.when(has_null, F.lit(C.SCORE_NULL_PENALTY)).otherwise(F.lit(0))
        - F.when(has_out, F.lit(C.SCORE_OUTLIER_PENALTY)).otherwise(F.lit(0))
        - F.least(n_issues * F.lit(C.SCORE_PER_ISSUE), F.lit(C.SCORE_ISSUE_CAP)))
    return df.withColumns({
        f"{prefix}Has_Null_Values": has_null,
        f"{prefix}Has_Outliers": has_out,
        f"{prefix}Quality_Issues": issues,
        f"{prefix}Techniques_Applied": F.concat_ws("; ", *techniques),
        f"{prefix}Best_Technique": best,
        f"{prefix}Processing_Notes": F.when(has_out, F.lit(C.OUTLIER_NOTE)).otherwise(F.lit("")),
        f"{prefix}Issue_Count": n_issues,
        f"{prefix}Quality_Score": score,
    })


def null_flags(df: DataFrame, features) -> DataFrame:
    """Q2 alone: per-row any-null flag and 'Null in <f>' text."""
    nulls = [F.col(f).isNull() for f in features]
    return df.withColumns({
        "Has_Null_Values": count_true(nulls) > 0,
        "Null_Issues": F.concat_ws("; ", *[F.when(F.col(f).isNull(), F.lit(f"Null in {f}"))
                                           for f in features]),
    })


def with_outlier_columns(df: DataFrame, flags: dict) -> DataFrame:
    """Q3-Q5 per-curve flags as ``<f>_Is_Outlier`` plus the row flag."""
    return df.withColumns({**{f"{f}_Is_Outlier": e for f, e in flags.items()},
                           "Has_Outliers": count_true(flags.values()) > 0})


def outlier_counts(df: DataFrame, flags: dict) -> DataFrame:
    """Q6: per curve the number (and percent) of flagged values."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("__n"), *[F.count_if(e).alias(f"__c{i}") for i, e in enumerate(flags.values())])
    feats = list(flags)
    long = wide.selectExpr("__n", "stack({}, {}) as (feature, outlier_count)".format(
        len(feats), ", ".join(f"'{f}', __c{i}" for i, f in enumerate(feats))))
    return long.select("feature", F.col("outlier_count").cast("long").alias("outlier_count"),
                       F.col("__n").cast("long").alias("total_rows"),
                       pct(F.col("outlier_count"), F.col("__n")).alias("outlier_pct"))


# ---------------------------------------------------------------------------
# Q10/Q11 enhanced dataset
# ---------------------------------------------------------------------------

ENHANCED_QUALITY_COLS = ["Data_Quality_Score", "Data_Quality_Has_Null_Values",
                         "Data_Quality_Has_Outliers", "Data_Quality_Issues",
                         "Preprocessing_Techniques_Applied", "Best_Technique_Used",
                         "Best_Technique_Summary", "Processing_Notes"]


def enhanced_dataset(df: DataFrame, cfg: LogConfig, imputation: str | None = "median",
                     fences: dict | None = None, predicted: Column | None = None,
                     with_metadata: bool = True, outliers: dict | None = None, **qkw) -> DataFrame:
    """Q10: originals + quality columns (+ prediction) + metadata, rows with a target.

    Statistics (IQR fences) are fitted on the rows with a target, as the
    training flow does.  ``imputation`` names the chosen technique; ``None``
    when the table had no missing curve values (no bake-off ran).
    """
    feats = cfg.present_features(df.columns)
    base = drop_null_target(df, cfg.target)
    if outliers is None:  # default rule: IQR fences fitted on the labelled rows
        fences = fences or iqr_fences(base, feats, **qkw)
        outliers = {f: fences[f].flag(f) for f in feats}
    ann = annotate_rows(base, feats, outliers, imputation, prefix="__")
    summary = f"Best_Imputation: {imputation if imputation else 'None'}"
    out_cols = [F.col(c) for c in df.columns] + [
        F.col("__Quality_Score").alias("Data_Quality_Score"),
        F.col("__Has_Null_Values").alias("Data_Quality_Has_Null_Values"),
        F.col("__Has_Outliers").alias("Data_Quality_Has_Outliers"),
        F.col("__Quality_Issues").alias("Data_Quality_Issues"),
        F.col("__Techniques_Applied").alias("Preprocessing_Techniques_Applied"),
        F.col("__Best_Technique").alias("Best_Technique_Used"),
        F.lit(summary).alias("Best_Technique_Summary"),
        F.col("__Processing_Notes").alias("Processing_Notes")]
    if predicted is not None:
        out_cols.append(predicted.alias("ML_Predicted_Lithology"))
    if with_metadata:
        out_cols += [F.current_timestamp().alias("Preprocessing_Timestamp"),
                     F.lit(C.PIPELINE_VERSION).alias("Pipeline_Version")]
    return ann.select(*out_cols)


def enhanced_summary(enhanced: DataFrame) -> DataFrame:
    """Q11: rows with nulls/outliers (count and percent) and mean score."""
    n = F.count(F.lit(1))
    nn = F.count_if(F.col("Data_Quality_Has_Null_Values"))
    no = F.count_if(F.col("Data_Quality_Has_Outliers"))
    return enhanced.agg(
        n.alias("total_rows"), nn.alias("null_rows"), pct(nn, n).alias("null_rows_pct"),
        no.alias("outlier_rows"), pct(no, n).alias("outlier_rows_pct"),
        F.avg("Data_Quality_Score").alias("avg_quality_score"))


# ---------------------------------------------------------------------------
# Q12-Q16 issue reports (long form) and recommendations
# ---------------------------------------------------------------------------

def _issue_explode(df: DataFrame, structs) -> DataFrame:
    """Explode an array of (nullable) issue structs; rows without issues vanish.

    ``inline`` of a filtered array is a Generate node: narrow, no shuffle.
    """
    arr = F.filter(F.array(*structs), lambda s: s.isNotNull())
    return df.select("*", F.inline(arr))


def null_issue_rows(df: DataFrame, columns, target: str | None = None) -> DataFrame:
    """Q12: one row per (row, null column); features first, then the target."""
    structs = [F.when(F.col(c).isNull(), F.struct(F.lit(f"Null_{c}").alias("Issue_Type"),
                                                 F.lit(f"Missing value in {c}").alias("Issue_Description")))
               for c in columns]
    if target and target in df.columns:
        structs.append(F.when(F.col(target).isNull(), F.struct(
            F.lit(f"Null_{target}").alias("Issue_Type"),
            F.lit("Missing lithology label").alias("Issue_Description"))))
    return _issue_explode(df, structs)


def _bound_items(cfg: LogConfig, columns):
    return [(c, cfg.bounds[c]) for c in columns if c in cfg.bounds]


def oob_issue_rows(df: DataFrame, columns, cfg: LogConfig = LogConfig()) -> DataFrame:
    """Q13 rows: one row per (row, curve outside its inclusive physical range)."""
    structs = []
    for c, (lo, hi, lo_t, hi_t) in _bound_items(cfg, columns):
        structs.append(F.when(outside(c, lo, hi), F.struct(
            F.lit(f"OutOfBounds_{c}").alias("Issue_Type"),
            F.lit(f"{c} outside range {lo_t}-{hi_t}").alias("Issue_Description"),
            F.lit(f"{lo_t}-{hi_t}").alias("Expected_Range"),
            F.col(c).cast("double").alias("Actual_Value"))))
    return _issue_explode(df, structs)


def oob_summary(df: DataFrame, columns, cfg: LogConfig = LogConfig()) -> DataFrame:
    """Q13 summary: per bounded curve count, percent, expected and actual range."""
    items = _bound_items(cfg, columns)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, (c, (lo, hi, _, _)) in enumerate(items):
        aggs += [F.count_if(outside(c, lo, hi)).alias(f"__c{i}"),
                 F.min(c).alias(f"__mn{i}"), F.max(c).alias(f"__mx{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"__c{i}").alias("oob_count"),
                     pct(F.col(f"__c{i}"), F.col("__n")).alias("oob_pct"),
                     F.lit(f"{lo_t} - {hi_t}").alias("expected_range"),
                     F.concat(fmt2(F.col(f"__mn{i}")), F.lit(" - "), fmt2(F.col(f"__mx{i}"))).alias("actual_range"))
            for i, (c, (_, _, lo_t, hi_t)) in enumerate(items)]
    return wide.select(F.inline(F.array(*rows)))


def invalid_label_rows(df: DataFrame, target: str, expected=C.EXPECTED_LABELS) -> DataFrame:
    """Q14 rows: label present and not in the expected vocabulary."""
    bad = F.col(target).isNotNull() & ~F.col(target).cast("string").isin(list(expected))
    return df.where(bad).withColumns({
        "Issue_Type": F.lit("Invalid_Lithology"),
        "Issue_Description": F.lit("Unexpected lithology label"),
        "Invalid_Label": F.col(target)})


def all_issue_rows(df: DataFrame, columns, target: str | None, cfg: LogConfig = LogConfig()) -> DataFrame:
    """The rows of Q12, Q13 and Q14 together, from one pass over the table."""
    none, nan = F.lit(None).cast("string"), F.lit(None).cast("double")

    def issue(kind, text, expected=none, value=nan, label=none):  # noqa: ANN001, ANN202
        return F.struct(F.lit(kind).alias("Issue_Type"), F.lit(text).alias("Issue_Description"),
                        expected.alias("Expected_Range"), value.alias("Actual_Value"), label.alias("Invalid_Label"))

    structs = [F.when(F.col(c).isNull(), issue(f"Null_{c}", f"Missing value in {c}")) for c in columns]
    for c, (lo, hi, lo_t, hi_t) in _bound_items(cfg, columns):
        structs.append(F.when(outside(c, lo, hi), issue(
            f"OutOfBounds_{c}", f"{c} outside range {lo_t}-{hi_t}", F.lit(f"{lo_t}-{hi_t}"), F.col(c).cast("double"))))
    if target and target in df.columns:
        label = F.col(target).cast("string")
        structs.append(F.when(label.isNull(), issue(f"Null_{target}", "Missing lithology label")))
        structs.append(F.when(~label.isin(list(cfg.expected_labels)), issue(
            "Invalid_Lithology", "Unexpected lithology label", label=label)))
    return _issue_explode(df, structs)


def invalid_label_summary(df: DataFrame, target: str, expected=C.EXPECTED_LABELS) -> DataFrame:
    """Q14 summary: distinct labels, invalid count/percent, found and expected lists.

    Rows are counted per label first; the one list is over distinct labels.
    """
    lab, n = F.col("label"), F.col("n")
    bad = lab.isNotNull() & ~lab.isin(list(expected))
    invalid = F.coalesce(F.sum(F.when(bad, n)), F.lit(0)).cast("long")
    counts = df.groupBy(F.col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(lab).alias("unique_count"),
        invalid.alias("invalid_count"),
        pct(invalid, F.sum(n)).alias("invalid_pct"),
        F.array_sort(F.collect_list(lab)).alias("unique_labels"),
        F.array(*[F.lit(x) for x in expected]).alias("expected_labels"))


def issue_counts(df: DataFrame, columns, target: str | None, cfg: LogConfig = LogConfig(),
                 extra=()) -> DataFrame:
    """Counts behind Q15/Q16 in one aggregate: per-column nulls, per-curve out of bounds."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    null_cols = list(columns) + ([target] if target and target in df.columns else [])
    for i, c in enumerate(null_cols):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{i}"))
    for i, (c, (lo, hi, _, _)) in enumerate(_bound_items(cfg, columns)):
        aggs.append(F.count_if(outside(c, lo, hi)).alias(f"oob_{i}"))
    if target and target in df.columns:
        lab = F.col(target).cast("string")
        aggs.append(F.count_if(lab.isNotNull() & ~lab.isin(list(cfg.expected_labels))).alias("invalid"))
    else:
        aggs.append(F.lit(0).cast("long").alias("invalid"))
    return df.agg(*aggs, *extra)


def recommendations(df: DataFrame, columns, target: str | None, cfg: LogConfig = LogConfig()) -> DataFrame:
    """Q15: (item, severity, message) rows, built from one counts aggregate;
    the share of every row is formatted by one call on one column."""
    counts = issue_counts(df, columns, target, cfg)
    null_cols = list(columns) + ([target] if target and target in df.columns else [])
    bound_cols = [c for c, _ in _bound_items(cfg, columns)]
    n = F.col("total_rows")
    nothing = F.lit(None).cast("double")
    total = sum([F.col(f"null_{i}") for i in range(len(null_cols))], F.lit(0)) + \
        sum([F.col(f"oob_{i}") for i in range(len(bound_cols))], F.lit(0))
    items = [(c, "missing", pct(F.col(f"null_{i}"), n)) for i, c in enumerate(null_cols)] + \
        [(c, "bounds", pct(F.col(f"oob_{i}"), n)) for i, c in enumerate(bound_cols)] + [("overall", "overall", nothing)]
    rows = counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("rec_order"), F.lit(c).alias("item"), F.lit(kind).alias("kind"), share.alias("p"),
                 total.cast("double").alias("total"), n.cast("double").alias("n"))
        for i, (c, kind, share) in enumerate(items)])))
    kind, p, item = F.col("kind"), F.col("p"), F.col("item")
    rows = rows.withColumn("txt", py_format("p", ".1f"))
    levels = F.when(kind == "overall", F.when(F.col("total") > F.col("n") * 0.3, "high")
                    .when(F.col("total") > F.col("n") * 0.1, "moderate").otherwise("good"))
    message = F.when(kind == "overall", F.when(F.col("total") > F.col("n") * 0.3, C.RECOMMEND["overall"]["high"])
                     .when(F.col("total") > F.col("n") * 0.1, C.RECOMMEND["overall"]["moderate"])
                     .otherwise(C.RECOMMEND["overall"]["good"]))
    for k, steps in C.RECOMMEND_LEVELS.items():
        for level, over in steps:
            mark, text = C.RECOMMEND[k][level]
            levels = levels.when((kind == k) & (p > over), level)
            message = message.when((kind == k) & (p > over), F.concat(
                F.lit(mark), F.lit(" "), item, F.lit(": "), F.col("txt"), F.lit(text)))
    return (rows.select("rec_order", "item", "kind", levels.alias("severity"), message.alias("message"))
            .where(F.col("message").isNotNull()))


def table_quality_score(df: DataFrame, columns, target: str | None, cfg: LogConfig = LogConfig()) -> DataFrame:
    """Q16: max(0, 100 - (null issue rows + oob issue rows + invalid rows)/N*100).

    Long-form rows: a table row with two issues counts twice (as reported).
    ``distinct_issue_rows`` gives the row-level count beside it.
    """
    null_cols = list(columns) + ([target] if target and target in df.columns else [])
    bounds = _bound_items(cfg, columns)
    row_has = [F.col(c).isNull() for c in null_cols] + [outside(c, lo, hi) for c, (lo, hi, _, _) in bounds]
    if target and target in df.columns:
        lab = F.col(target).cast("string")
        row_has.append(lab.isNotNull() & ~lab.isin(list(cfg.expected_labels)))
    counts = issue_counts(df, columns, target, cfg,
                          extra=[F.count_if(count_true(row_has) > 0).alias("distinct_issue_rows")])
    nulls = sum([F.col(f"null_{i}") for i in range(len(null_cols))], F.lit(0))
    oobs = sum([F.col(f"oob_{i}") for i in range(len(bounds))], F.lit(0))
    total = nulls + oobs + F.col("invalid")
    score = F.greatest(F.lit(0.0), F.lit(100.0) - pct(total, F.col("total_rows")))
    return counts.select(
        F.col("total_rows"), nulls.cast("long").alias("null_issue_rows"),
        oobs.cast("long").alias("oob_issue_rows"), F.col("invalid").cast("long").alias("invalid_label_rows"),
        total.cast("long").alias("total_issue_rows"), score.alias("quality_score"),
        F.col("distinct_issue_rows"))


# ---------------------------------------------------------------------------
# Q17-Q19 simple annotations and processed dataset
# ---------------------------------------------------------------------------

def simple_annotations(df: DataFrame, features, prefix: str = "") -> DataFrame:
    """Q17: any-null flag, null count, 'Null in' text or 'None', fixed techniques, score."""
    nulls = [F.col(f).isNull() for f in features]
    n = count_true(nulls)
    text = F.concat_ws("; ", *[F.when(F.col(f).isNull(), F.lit(f"Null in {f}")) for f in features])
    return df.withColumns({
        f"{prefix}Has_Null_Values": n > 0,
        f"{prefix}Null_Count": n,
        f"{prefix}Quality_Issues": F.when(n > 0, text).otherwise(F.lit("None")),
        f"{prefix}Techniques_Applied": F.lit(C.SIMPLE_TECHNIQUES_TEXT),
        f"{prefix}Data_Quality_Score": F.greatest(F.lit(0), F.lit(100) - n * F.lit(C.SIMPLE_SCORE_PER_NULL)),
    })


def processed_dataset(df: DataFrame, features, scaled: dict, fences: dict,
                      prediction: Column | None = None, confidence: Column | None = None,
                      with_metadata: bool = True) -> DataFrame:
    """Q18: originals + scaled curves + per-curve IQR flags/bounds + Quality_* + literals.

    ``scaled`` maps curve -> scaled expression (see prepare.scaled_exprs);
    ``fences`` are IQR fences over the original table.
    """
    out = df
    cols = {f"{f}_Processed": e for f, e in scaled.items()}
    out = out.withColumns(cols)
    flags = {}
    for f in features:
        fl = fences[f].flag(f)
        flags[f"{f}_Is_Outlier"] = fl
        if fences[f].lower is None:
            flags[f"{f}_Outlier_Bounds"] = F.lit("Normal")
        else:
            txt = "[{:.2f}, {:.2f}]".format(fences[f].lower, fences[f].upper)
            flags[f"{f}_Outlier_Bounds"] = F.when(fl, F.lit(txt)).otherwise(F.lit("Normal"))
    out = out.withColumns(flags)
    out = simple_annotations(out, features, prefix="Quality_")
    lit_cols = {
        "Processing_Method": F.lit(C.PROCESSING_METHOD),
        "Outlier_Treatment": F.lit(C.OUTLIER_TREATMENT),
        "Missing_Value_Treatment": F.when(F.col("Quality_Has_Null_Values"), F.lit("Median_Imputation_Applied"))
                                    .otherwise(F.lit("No_Treatment_Needed")),
    }
    out = out.withColumns(lit_cols)
    if prediction is not None:
        out = out.withColumn("ML_Predicted_Lithology", prediction)
        if confidence is not None:
            from ..functions.exprs import band
            out = out.withColumns({"Prediction_Confidence": confidence,
                                   "Confidence_Category": band(confidence, C.CONFIDENCE_CATEGORIES3)})
    if with_metadata:
        out = out.withColumns({"Processing_Timestamp": F.current_timestamp(),
                               "Dataset_Version": F.lit(C.DATASET_VERSION)})
    return out


def processing_summary(processed: DataFrame, features) -> DataFrame:
    """Q19: rows null-treated; outlier values summed over curves."""
    flags = [F.col(f"{f}_Is_Outlier") for f in features if f"{f}_Is_Outlier" in processed.columns]
    return processed.agg(
        F.count_if(F.col("Quality_Has_Null_Values")).alias("null_rows_treated"),
        F.sum(count_true(flags)).cast("long").alias("outlier_values_detected"))


# ---------------------------------------------------------------------------
# Q20/Q21 column statistics
# ---------------------------------------------------------------------------

def column_stats(df: DataFrame, columns, **qkw) -> DataFrame:
    """Q20 (describe): count, mean, sample std, min, 25/50/75 %, max per column.

    Exact quantiles (not ``summary()``, whose percentiles are approximate).
    """
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"),
                 F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}")]
    wide = df.agg(*aggs)
    q = quantile_map(df, columns, [0.25, 0.5, 0.75], **qkw)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                     F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
                     F.lit(q[c][0]).cast("double").alias("p25"), F.lit(q[c][1]).cast("double").alias("p50"),
                     F.lit(q[c][2]).cast("double").alias("p75"), F.col(f"hi{i}").alias("max"))
            for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*rows)))


def completeness(df: DataFrame, columns) -> DataFrame:
    """Q21: per curve total, valid, missing, % complete, min, max, mean, sample std."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"v{i}"), F.min(c).cast("double").alias(f"lo{i}"),
                 F.max(c).cast("double").alias(f"hi{i}"), F.avg(c).alias(f"m{i}"),
                 F.stddev_samp(c).alias(f"s{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col("__n").alias("total_samples"),
                     F.col(f"v{i}").alias("valid_samples"),
                     (F.col("__n") - F.col(f"v{i}")).alias("missing_samples"),
                     pct(F.col(f"v{i}"), F.col("__n")).alias("completeness_pct"),
                     F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"),
                     F.col(f"m{i}").alias("mean_value"), F.col(f"s{i}").alias("std_dev"))
            for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*rows)))


def preprocessing_log(annotated: DataFrame, features, best_imputation: str | None,
                      scaling: str = "StandardScaler") -> DataFrame:
    """Q24: one run-log record (rows, features, null rows, outlier rows, choices)."""
    return annotated.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(features)).alias("features_processed"),
        F.count_if(F.col("__Has_Null_Values") if "__Has_Null_Values" in annotated.columns
                   else F.col("Data_Quality_Has_Null_Values")).alias("null_rows_handled"),
        F.count_if(F.col("__Has_Outliers") if "__Has_Outliers" in annotated.columns
                   else F.col("Data_Quality_Has_Outliers")).alias("outlier_rows_detected"),
        F.lit(best_imputation or "None").alias("best_imputation"),
        F.lit(scaling).alias("scaling_method"))
