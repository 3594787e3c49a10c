"""Registered quality queries (Spark) and their DuckDB oracle texts.

Every query reads the driver's tables through the well-log view and runs over
the whole table.  ``QUERIES[name](spark, sf_dir) -> DataFrame``;
``ORACLES[name] -> SQL`` where the operator is SQL-expressible.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import quality as Q
from ..sources.testview import KEY, TARGET, VIEW_CONFIG, wells
from . import oracle as O

from .registry import ORACLES, QUERIES, register, round_doubles  # noqa: F401

FEATS = list(C.FEATURES)


def _labelled(spark, sf_dir):
    return Q.drop_null_target(wells(spark, sf_dir), TARGET)


def _r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# flagship: null flags + IQR flags + issue text + row score (Q2, Q3, Q9)
# ---------------------------------------------------------------------------

QUALITY_ROW_SCORE_SQL = O.with_wells(f"""
, t as (select * from wells where LITH is not null)
, s as ({O.iqr_cte(FEATS)})
, a as (
  select t.*,
    {' + '.join(O.int_of(f + ' is null') for f in FEATS)} as n_null,
    {' + '.join(O.int_of(O.iqr_flag(f)) for f in FEATS)} as n_out,
    concat_ws('; ', {O.null_text(FEATS)},
      {', '.join(f"case when {O.iqr_flag(f)} then 'Outlier in {f}' end" for f in FEATS)}) as issues
  from t, s)
select {O.KEY_SQL},
  n_null > 0 as Data_Quality_Has_Null_Values,
  n_out > 0 as Data_Quality_Has_Outliers,
  issues as Data_Quality_Issues,
  greatest(0, 100 - (case when n_null > 0 then 30 else 0 end) - (case when n_out > 0 then 20 else 0 end)
     - least((n_null + n_out) * 10, 50)) as Data_Quality_Score
from a""")


@register("quality_row_score", QUALITY_ROW_SCORE_SQL)
def quality_row_score(spark, sf_dir):
    base = _labelled(spark, sf_dir)
    fences = Q.iqr_fences(base, FEATS)
    ann = Q.annotate_rows(base, FEATS, {f: fences[f].flag(f) for f in FEATS})
    return ann.select(*KEY, F.col("Has_Null_Values").alias("Data_Quality_Has_Null_Values"),
                      F.col("Has_Outliers").alias("Data_Quality_Has_Outliers"),
                      F.col("Quality_Issues").alias("Data_Quality_Issues"),
                      F.col("Quality_Score").alias("Data_Quality_Score"))


# ---------------------------------------------------------------------------
# Q1 missing profile (all rows, features + target)
# ---------------------------------------------------------------------------

_MP_COLS = FEATS + [TARGET]
MISSING_PROFILE_SQL = O.with_wells(f"""
, c as (select count(*) as n, {', '.join(f'count(*) - count({c}) as m_{c}' for c in _MP_COLS)} from wells)
, l as ({' union all '.join(f"select '{c}' as column_name, m_{c} as missing_count, n from c" for c in _MP_COLS)})
select column_name as "column", cast(missing_count as bigint) as missing_count,
  round(missing_count * 100.0 / n, 6) as missing_pct,
  case when missing_count = 0 then '{C.STATUS_OK}' when missing_count * 100.0 / n < 10 then '{C.STATUS_WARN}'
       else '{C.STATUS_BAD}' end as status
from l""")


@register("missing_profile", MISSING_PROFILE_SQL)
def missing_profile(spark, sf_dir):
    out = Q.missing_profile(wells(spark, sf_dir), FEATS, TARGET)
    return out.withColumn("missing_pct", _r6(F.col("missing_pct")))


# ---------------------------------------------------------------------------
# Q2 null flags (labelled rows)
# ---------------------------------------------------------------------------

NULL_FLAGS_SQL = O.with_wells(f"""
select {O.KEY_SQL}, ({O.count_nulls(FEATS)}) > 0 as Has_Null_Values,
  concat_ws('; ', {O.null_text(FEATS)}) as Null_Issues
from wells where LITH is not null""")


@register("null_flags", NULL_FLAGS_SQL)
def null_flags(spark, sf_dir):
    return Q.null_flags(_labelled(spark, sf_dir), FEATS).select(*KEY, "Has_Null_Values", "Null_Issues")


# ---------------------------------------------------------------------------
# S1 load summary
# ---------------------------------------------------------------------------

_VIEW_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "WELL", "DEPTH_MD",
              "GR", "RHOB", "NPHI", "RDEP", "DTC", "PEF", "LITH"]

LOAD_SUMMARY_SQL = O.with_wells(f"""
select count(*) as total_rows, {len(_VIEW_COLS)} as total_columns, count(distinct WELL) as wells from wells""")


@register("load_summary", LOAD_SUMMARY_SQL)
def load_summary(spark, sf_dir):
    from ..sources.readers import load_summary as ls
    return ls(wells(spark, sf_dir))


# ---------------------------------------------------------------------------
# Q3/Q4/Q5 outlier rules (labelled rows, per-curve flags)
# ---------------------------------------------------------------------------

def _flags_sql(flag_of) -> str:
    cols = ",\n  ".join(f"{flag_of(f)} as {f}_Is_Outlier" for f in FEATS)
    anyf = " or ".join(flag_of(f) for f in FEATS)
    return cols, anyf


_iqr_cols, _iqr_any = _flags_sql(O.iqr_flag)
OUTLIER_IQR_SQL = O.with_wells(f"""
, t as (select * from wells where LITH is not null)
, s as ({O.iqr_cte(FEATS)})
select {O.KEY_SQL},
  {_iqr_cols},
  ({_iqr_any}) as Has_Outliers
from t, s""")


def _outlier_query(spark, sf_dir, method):
    base = _labelled(spark, sf_dir)
    flags = Q.outlier_flags(base, FEATS, method)
    return Q.with_outlier_columns(base, flags).select(*KEY, *[f"{f}_Is_Outlier" for f in FEATS], "Has_Outliers")


@register("outlier_iqr", OUTLIER_IQR_SQL)
def outlier_iqr(spark, sf_dir):
    return _outlier_query(spark, sf_dir, "iqr")


def _z_flag(f):
    return (f"coalesce(case when {f}_s is null or {f}_s = 0 then false "
            f"else abs(({f} - {f}_m) / {f}_s) > 3.0 end, false)")


_z_cols, _z_any = _flags_sql(_z_flag)
OUTLIER_ZSCORE_SQL = O.with_wells(f"""
, t as (select * from wells where LITH is not null)
, s as (select {', '.join(f'avg({f}) as {f}_m, stddev_samp({f}) as {f}_s' for f in FEATS)} from t)
select {O.KEY_SQL},
  {_z_cols},
  ({_z_any}) as Has_Outliers
from t, s""")


@register("outlier_zscore", OUTLIER_ZSCORE_SQL)
def outlier_zscore(spark, sf_dir):
    return _outlier_query(spark, sf_dir, "zscore")


def _mz_flag(f):
    return (f"coalesce(case when {f}_mad = 0 then {f} <> {f}_med "
            f"else abs(0.6745 * ({f} - {f}_med) / {f}_mad) > 3.0 end, false)")


_mz_cols, _mz_any = _flags_sql(_mz_flag)
OUTLIER_MZ_SQL = O.with_wells(f"""
, t as (select * from wells where LITH is not null)
, m as (select {', '.join(f'quantile_cont({f}, 0.5) as {f}_med' for f in FEATS)} from t)
, d as (select {', '.join(f'quantile_cont(abs({f} - {f}_med), 0.5) as {f}_mad' for f in FEATS)} from t, m)
select {O.KEY_SQL},
  {_mz_cols},
  ({_mz_any}) as Has_Outliers
from t, m, d""")


@register("outlier_modified_zscore", OUTLIER_MZ_SQL)
def outlier_modified_zscore(spark, sf_dir):
    return _outlier_query(spark, sf_dir, "modified_zscore")


OUTLIER_COUNTS_SQL = O.with_wells(f"""
, t as (select * from wells where LITH is not null)
, s as ({O.iqr_cte(FEATS)})
, c as (select count(*) as n, {', '.join(f'sum({O.int_of(O.iqr_flag(f))}) as c_{f}' for f in FEATS)} from t, s)
{' union all '.join(f"select '{f}' as feature, cast(c_{f} as bigint) as outlier_count, n as total_rows, round(c_{f} * 100.0 / n, 6) as outlier_pct from c" for f in FEATS)}""")


@register("outlier_counts", OUTLIER_COUNTS_SQL)
def outlier_counts(spark, sf_dir):
    base = _labelled(spark, sf_dir)
    return round_doubles(Q.outlier_counts(base, Q.outlier_flags(base, FEATS, "iqr")))


# ---------------------------------------------------------------------------
# Q7/Q8 techniques and notes; Q10/Q11 enhanced dataset and summary
# ---------------------------------------------------------------------------

_ANNOT_CTE = f"""
, t as (select * from wells where LITH is not null)
, s as ({O.iqr_cte(FEATS)})
, a as (
  select t.*,
    {' + '.join(O.int_of(f + ' is null') for f in FEATS)} as n_null,
    {' + '.join(O.int_of(O.iqr_flag(f)) for f in FEATS)} as n_out,
    concat_ws('; ', {O.null_text(FEATS)},
      {', '.join(f"case when {O.iqr_flag(f)} then 'Outlier in {f}' end" for f in FEATS)}) as issues
  from t, s)"""

_TECH_SQL = ("concat_ws('; ', case when n_null > 0 then 'Median Imputation' end, "
             "case when n_out > 0 then 'Outlier Preserved' end, 'StandardScaler')")
_BEST_SQL = "case when n_null > 0 then 'Imputation: Median' else '' end"
_NOTES_SQL = f"case when n_out > 0 then '{C.OUTLIER_NOTE}' else '' end"
_SCORE_SQL = ("greatest(0, 100 - (case when n_null > 0 then 30 else 0 end) - (case when n_out > 0 then 20 else 0 end)"
              " - least((n_null + n_out) * 10, 50))")

TECHNIQUES_SQL = O.with_wells(_ANNOT_CTE + f"""
select {O.KEY_SQL}, {_TECH_SQL} as Preprocessing_Techniques_Applied,
  {_BEST_SQL} as Best_Technique_Used, {_NOTES_SQL} as Processing_Notes
from a""")


@register("techniques_applied", TECHNIQUES_SQL)
def techniques_applied(spark, sf_dir):
    enh = Q.enhanced_dataset(wells(spark, sf_dir), VIEW_CONFIG, "median", with_metadata=False)
    return enh.select(*KEY, "Preprocessing_Techniques_Applied", "Best_Technique_Used", "Processing_Notes")


ENHANCED_SQL = O.with_wells(_ANNOT_CTE + f"""
select {', '.join(_VIEW_COLS)},
  {_SCORE_SQL} as Data_Quality_Score,
  n_null > 0 as Data_Quality_Has_Null_Values,
  n_out > 0 as Data_Quality_Has_Outliers,
  issues as Data_Quality_Issues,
  {_TECH_SQL} as Preprocessing_Techniques_Applied,
  {_BEST_SQL} as Best_Technique_Used,
  'Best_Imputation: median' as Best_Technique_Summary,
  {_NOTES_SQL} as Processing_Notes,
  '{C.PIPELINE_VERSION}' as Pipeline_Version
from a""")


@register("enhanced_dataset", ENHANCED_SQL)
def enhanced_dataset(spark, sf_dir):
    enh = Q.enhanced_dataset(wells(spark, sf_dir), VIEW_CONFIG, "median", with_metadata=True)
    return enh.drop("Preprocessing_Timestamp")


ENHANCED_SUMMARY_SQL = O.with_wells(_ANNOT_CTE + """
select count(*) as total_rows,
  count(*) filter (where n_null > 0) as null_rows,
  round(count(*) filter (where n_null > 0) * 100.0 / count(*), 6) as null_rows_pct,
  count(*) filter (where n_out > 0) as outlier_rows,
  round(count(*) filter (where n_out > 0) * 100.0 / count(*), 6) as outlier_rows_pct,
  round(avg(""" + _SCORE_SQL + """), 6) as avg_quality_score
from a""")


@register("enhanced_summary", ENHANCED_SUMMARY_SQL)
def enhanced_summary(spark, sf_dir):
    enh = Q.enhanced_dataset(wells(spark, sf_dir), VIEW_CONFIG, "median", with_metadata=False)
    return round_doubles(Q.enhanced_summary(enh))


PREPROCESSING_LOG_SQL = O.with_wells(_ANNOT_CTE + f"""
select count(*) as total_rows, {len(FEATS)} as features_processed,
  count(*) filter (where n_null > 0) as null_rows_handled,
  count(*) filter (where n_out > 0) as outlier_rows_detected,
  'median' as best_imputation, 'StandardScaler' as scaling_method
from a""")


@register("preprocessing_log", PREPROCESSING_LOG_SQL)
def preprocessing_log(spark, sf_dir):
    enh = Q.enhanced_dataset(wells(spark, sf_dir), VIEW_CONFIG, "median", with_metadata=False)
    return Q.preprocessing_log(enh, FEATS, "median")


# ---------------------------------------------------------------------------
# Q12-Q16 quality report over all rows (analysis curves include DEPTH_MD)
# ---------------------------------------------------------------------------

ANALYSIS = FEATS + ["DEPTH_MD"]
_VIEW_SQL_COLS = ", ".join(_VIEW_COLS)

NULL_ISSUES_SQL = O.with_wells(" union all ".join(
    [f"select {_VIEW_SQL_COLS}, 'Null_{c}' as Issue_Type, 'Missing value in {c}' as Issue_Description "
     f"from wells where {c} is null" for c in ANALYSIS] +
    [f"select {_VIEW_SQL_COLS}, 'Null_LITH' as Issue_Type, 'Missing lithology label' as Issue_Description "
     f"from wells where LITH is null"]))


@register("null_issue_rows", NULL_ISSUES_SQL)
def null_issue_rows(spark, sf_dir):
    return Q.null_issue_rows(wells(spark, sf_dir), ANALYSIS, TARGET)


def _oob_cond(c):
    lo, hi, _, _ = C.BOUNDS[c]
    return f"({c} < {lo} or {c} > {hi})"


OOB_ISSUES_SQL = O.with_wells(" union all ".join(
    f"select {_VIEW_SQL_COLS}, 'OutOfBounds_{c}' as Issue_Type, "
    f"'{c} outside range {C.BOUNDS[c][2]}-{C.BOUNDS[c][3]}' as Issue_Description, "
    f"'{C.BOUNDS[c][2]}-{C.BOUNDS[c][3]}' as Expected_Range, cast({c} as double) as Actual_Value "
    f"from wells where {_oob_cond(c)}" for c in ANALYSIS))


@register("oob_issue_rows", OOB_ISSUES_SQL)
def oob_issue_rows(spark, sf_dir):
    return Q.oob_issue_rows(wells(spark, sf_dir), ANALYSIS)


OOB_SUMMARY_SQL = O.with_wells(f"""
, c as (select count(*) as n, {', '.join(f"count(*) filter (where {_oob_cond(c)}) as c_{c}, min({c}) as mn_{c}, max({c}) as mx_{c}" for c in ANALYSIS)} from wells)
""" + " union all ".join(
    f"select '{c}' as feature, c_{c} as oob_count, round(c_{c} * 100.0 / n, 6) as oob_pct, "
    f"'{C.BOUNDS[c][2]} - {C.BOUNDS[c][3]}' as expected_range, "
    f"printf('%.2f', mn_{c}) || ' - ' || printf('%.2f', mx_{c}) as actual_range from c" for c in ANALYSIS))


@register("oob_summary", OOB_SUMMARY_SQL)
def oob_summary(spark, sf_dir):
    return round_doubles(Q.oob_summary(wells(spark, sf_dir), ANALYSIS))


_EXPECTED_SQL = ", ".join(f"'{x}'" for x in C.EXPECTED_LABELS)
INVALID_ROWS_SQL = O.with_wells(f"""
select {_VIEW_SQL_COLS}, 'Invalid_Lithology' as Issue_Type, 'Unexpected lithology label' as Issue_Description,
  LITH as Invalid_Label
from wells where LITH is not null and LITH not in ({_EXPECTED_SQL})""")


@register("invalid_label_rows", INVALID_ROWS_SQL)
def invalid_label_rows(spark, sf_dir):
    return Q.invalid_label_rows(wells(spark, sf_dir), TARGET)


INVALID_SUMMARY_SQL = O.with_wells(f"""
select count(distinct LITH) as unique_count,
  count(*) filter (where LITH is not null and LITH not in ({_EXPECTED_SQL})) as invalid_count,
  round(count(*) filter (where LITH is not null and LITH not in ({_EXPECTED_SQL})) * 100.0 / count(*), 6) as invalid_pct,
  list_sort(list(distinct LITH) filter (where LITH is not null)) as unique_labels,
  [{_EXPECTED_SQL}] as expected_labels
from wells""")


@register("invalid_label_summary", INVALID_SUMMARY_SQL)
def invalid_label_summary(spark, sf_dir):
    return round_doubles(Q.invalid_label_summary(wells(spark, sf_dir), TARGET))


def _rec_rows_sql():
    """The recommendation rows as SQL, from the fixed texts of the configuration."""
    parts = []
    items = [(c, "missing", f"null_{c}") for c in ANALYSIS + [TARGET]] + [(c, "bounds", f"oob_{c}") for c in ANALYSIS]
    for order, (c, kind, count) in enumerate(items):
        p = f"((cast({count} as double) / n) * 100)"
        steps = C.RECOMMEND_LEVELS[kind]
        severity = " ".join(f"when {p} > {over} then '{level}'" for level, over in steps)
        message = " ".join(
            f"when {p} > {over} then '{C.RECOMMEND[kind][level][0]} {c}: ' || printf('%.1f', {p}) || '{C.RECOMMEND[kind][level][1]}'"
            for level, over in steps)
        parts.append(f"select {order} as rec_order, '{c}' as item, '{kind}' as kind, "
                     f"case {severity} end as severity, case {message} end as message from c")
    tot = " + ".join([f"null_{c}" for c in ANALYSIS + [TARGET]] + [f"oob_{c}" for c in ANALYSIS])
    all_ = C.RECOMMEND["overall"]
    parts.append(
        f"select {len(items)} as rec_order, 'overall' as item, 'overall' as kind, "
        f"case when ({tot}) > n * 0.3 then 'high' when ({tot}) > n * 0.1 then 'moderate' else 'good' end as severity, "
        f"case when ({tot}) > n * 0.3 then '{all_['high']}' when ({tot}) > n * 0.1 then '{all_['moderate']}' "
        f"else '{all_['good']}' end as message from c")
    return " union all ".join(parts)


_COUNTS_CTE = f"""
, c as (select count(*) as n,
  {', '.join(f'count(*) filter (where {c} is null) as null_{c}' for c in ANALYSIS + [TARGET])},
  {', '.join(f'count(*) filter (where {_oob_cond(c)}) as oob_{c}' for c in ANALYSIS)},
  count(*) filter (where LITH is not null and LITH not in ({_EXPECTED_SQL})) as invalid,
  count(*) filter (where {' or '.join([f'{c} is null' for c in ANALYSIS + [TARGET]] + [_oob_cond(c) for c in ANALYSIS] + [f"(LITH is not null and LITH not in ({_EXPECTED_SQL}))"])}) as distinct_rows
  from wells)"""

RECOMMENDATIONS_SQL = O.with_wells(_COUNTS_CTE + f"""
select * from ({_rec_rows_sql()}) r where message is not null""")


@register("recommendations", RECOMMENDATIONS_SQL)
def recommendations(spark, sf_dir):
    return Q.recommendations(wells(spark, sf_dir), ANALYSIS, TARGET)


_NULLS_SUM = " + ".join(f"null_{c}" for c in ANALYSIS + [TARGET])
_OOB_SUM = " + ".join(f"oob_{c}" for c in ANALYSIS)
TABLE_SCORE_SQL = O.with_wells(_COUNTS_CTE + f"""
select n as total_rows, cast({_NULLS_SUM} as bigint) as null_issue_rows, cast({_OOB_SUM} as bigint) as oob_issue_rows,
  cast(invalid as bigint) as invalid_label_rows,
  cast({_NULLS_SUM} + {_OOB_SUM} + invalid as bigint) as total_issue_rows,
  round(greatest(0.0, 100.0 - cast({_NULLS_SUM} + {_OOB_SUM} + invalid as double) * 100.0 / n), 6) as quality_score,
  distinct_rows as distinct_issue_rows
from c""")


@register("table_quality_score", TABLE_SCORE_SQL)
def table_quality_score(spark, sf_dir):
    return round_doubles(Q.table_quality_score(wells(spark, sf_dir), ANALYSIS, TARGET))


# ---------------------------------------------------------------------------
# Q17-Q19 simple annotations, processed dataset, processing summary
# ---------------------------------------------------------------------------

SIMPLE_SQL = O.with_wells(f"""
, a as (select *, {O.count_nulls(FEATS)} as nn, concat_ws('; ', {O.null_text(FEATS)}) as txt from wells)
select {O.KEY_SQL}, nn > 0 as Has_Null_Values, nn as Null_Count,
  case when nn > 0 then txt else 'None' end as Quality_Issues,
  '{C.SIMPLE_TECHNIQUES_TEXT}' as Techniques_Applied,
  greatest(0, 100 - nn * 10) as Data_Quality_Score
from a""")


@register("simple_annotations", SIMPLE_SQL)
def simple_annotations(spark, sf_dir):
    return Q.simple_annotations(wells(spark, sf_dir), FEATS).select(
        *KEY, "Has_Null_Values", "Null_Count", "Quality_Issues", "Techniques_Applied", "Data_Quality_Score")


_PROC_STATS = f"""
, t as (select * from wells where LITH is not null)
, med as (select {', '.join(f'quantile_cont({f}, 0.5) as {f}_med' for f in FEATS)} from t)
, sc as (select {', '.join(f'avg(coalesce({f}, {f}_med)) as {f}_mu, stddev_pop(coalesce({f}, {f}_med)) as {f}_sd' for f in FEATS)} from t, med)
, s as ({O.iqr_cte(FEATS, 'wells')})"""


def _fence_txt(f):
    lo = f"({f}_q1 - 1.5 * ({f}_q3 - {f}_q1))"
    hi = f"({f}_q3 + 1.5 * ({f}_q3 - {f}_q1))"
    return f"'[' || printf('%.2f', {lo}) || ', ' || printf('%.2f', {hi}) || ']'"


PROCESSED_SQL = O.with_wells(_PROC_STATS + f"""
, a as (select wells.*, med.*, sc.*, s.*, {O.count_nulls(FEATS)} as nn,
          concat_ws('; ', {O.null_text(FEATS)}) as txt from wells, med, sc, s)
select {_VIEW_SQL_COLS},
  {', '.join(f"round((coalesce({f}, {f}_med) - {f}_mu) / (case when {f}_sd = 0 or {f}_sd is null then 1 else {f}_sd end), 6) as {f}_Processed" for f in FEATS)},
  {', '.join(f"{O.iqr_flag(f)} as {f}_Is_Outlier, case when {O.iqr_flag(f)} then {_fence_txt(f)} else 'Normal' end as {f}_Outlier_Bounds" for f in FEATS)},
  nn > 0 as Quality_Has_Null_Values, nn as Quality_Null_Count,
  case when nn > 0 then txt else 'None' end as Quality_Quality_Issues,
  '{C.SIMPLE_TECHNIQUES_TEXT}' as Quality_Techniques_Applied,
  greatest(0, 100 - nn * 10) as Quality_Data_Quality_Score,
  '{C.PROCESSING_METHOD}' as Processing_Method, '{C.OUTLIER_TREATMENT}' as Outlier_Treatment,
  case when nn > 0 then 'Median_Imputation_Applied' else 'No_Treatment_Needed' end as Missing_Value_Treatment,
  '{C.DATASET_VERSION}' as Dataset_Version
from a""")


def processed_frame(spark, sf_dir):
    from ..operators import prepare as P
    df = wells(spark, sf_dir)
    lab = Q.drop_null_target(df, TARGET)
    fills = P.fit_median(lab, FEATS)
    scaler = P.fit_scaler(lab, FEATS, fills)
    fences = Q.iqr_fences(df, FEATS)
    return Q.processed_dataset(df, FEATS, P.scaled_exprs(FEATS, fills, scaler), fences, with_metadata=True)


@register("processed_dataset", PROCESSED_SQL)
def processed_dataset(spark, sf_dir):
    out = processed_frame(spark, sf_dir).drop("Processing_Timestamp")
    return out.withColumns({f"{f}_Processed": F.round(f"{f}_Processed", 6) for f in FEATS})


PROCESSING_SUMMARY_SQL = O.with_wells(f"""
, s as ({O.iqr_cte(FEATS, 'wells')})
select count(*) filter (where ({O.count_nulls(FEATS)}) > 0) as null_rows_treated,
  cast(sum({' + '.join(O.int_of(O.iqr_flag(f)) for f in FEATS)}) as bigint) as outlier_values_detected
from wells, s""")


@register("processing_summary", PROCESSING_SUMMARY_SQL)
def processing_summary(spark, sf_dir):
    return Q.processing_summary(processed_frame(spark, sf_dir), FEATS)


# ---------------------------------------------------------------------------
# Q20/Q21 statistics tables
# ---------------------------------------------------------------------------

STAT_COLS = ["DEPTH_MD"] + FEATS
COLUMN_STATS_SQL = O.with_wells(" union all ".join(
    f"select '{c}' as \"column\", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, "
    f"round(min({c}), 6) as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50, "
    f"round(quantile_cont({c}, 0.75), 6) as p75, round(max({c}), 6) as max from wells" for c in STAT_COLS))


@register("column_stats", COLUMN_STATS_SQL)
def column_stats(spark, sf_dir):
    return round_doubles(Q.column_stats(wells(spark, sf_dir), STAT_COLS))


COMPLETENESS_SQL = O.with_wells(" union all ".join(
    f"select '{c}' as \"column\", count(*) as total_samples, count({c}) as valid_samples, "
    f"count(*) - count({c}) as missing_samples, round(count({c}) * 100.0 / count(*), 6) as completeness_pct, "
    f"round(min({c}), 6) as min_value, round(max({c}), 6) as max_value, round(avg({c}), 6) as mean_value, "
    f"round(stddev_samp({c}), 6) as std_dev from wells" for c in FEATS))


@register("completeness", COMPLETENESS_SQL)
def completeness(spark, sf_dir):
    return round_doubles(Q.completeness(wells(spark, sf_dir), FEATS))


COMPLETE_CASES_SQL = O.with_wells(f"""
select {O.KEY_SQL} from wells where {' and '.join(f'{c} is not null' for c in FEATS + [TARGET])}""")


@register("complete_cases", COMPLETE_CASES_SQL)
def complete_cases(spark, sf_dir):
    return Q.complete_cases(wells(spark, sf_dir), FEATS + [TARGET]).select(*KEY)


# ---------------------------------------------------------------------------
# S7 issue reports: written partitioned by issue type, read back and counted
# ---------------------------------------------------------------------------

ISSUE_REPORTS_SQL = O.with_wells(" union all ".join(
    [f"select 'Null_{c}' as Issue_Type, count(*) as issue_rows from wells where {c} is null having count(*) > 0"
     for c in ANALYSIS + [TARGET]] +
    [f"select 'OutOfBounds_{c}', count(*) from wells where {_oob_cond(c)} having count(*) > 0" for c in ANALYSIS] +
    [f"select 'Invalid_Lithology', count(*) from wells where LITH is not null and LITH not in ({_EXPECTED_SQL}) "
     f"having count(*) > 0"]))


@register("issue_reports", ISSUE_REPORTS_SQL)
def issue_reports(spark, sf_dir):
    import uuid

    from ..session import shared_dir
    from ..sources.sinks import write_issue_reports
    df = wells(spark, sf_dir)
    path = shared_dir(spark, f"issues-{uuid.uuid4().hex[:12]}")
    write_issue_reports(Q.all_issue_rows(df, ANALYSIS, TARGET), path)
    return spark.read.parquet(path).groupBy("Issue_Type").agg(F.count(F.lit(1)).alias("issue_rows"))
