"""Registered label, preparation and chart queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..config import LogConfig
from ..operators import charts as V
from ..operators import conform as P
from ..operators import prepare as I
from ..operators import quality as Q
from ..operators import score as R
from ..sources.testview import KEY, TARGET, wells
from . import oracle as O
from .registry import register, round_doubles

FEATS = list(C.FEATURES)

LABEL_MAP_SQL = "case LITH " + " ".join(f"when '{k}' then '{v}'" for k, v in C.LABEL_CODES.items()) + " else LITH end"


def labelled_normalized(spark, sf_dir):
    df = Q.drop_null_target(wells(spark, sf_dir), TARGET)
    return P.normalize_labels(df, TARGET, out="LABEL")


# ---------------------------------------------------------------------------
# P9/P10 label normalization
# ---------------------------------------------------------------------------

@register("label_normalize", O.with_wells(f"""
select {O.KEY_SQL}, LITH, {LABEL_MAP_SQL} as LABEL from wells where LITH is not null"""))
def label_normalize(spark, sf_dir):
    return labelled_normalized(spark, sf_dir).select(*KEY, TARGET, "LABEL")


@register("label_normalize_report", O.with_wells(f"""
, t as (select LITH, {LABEL_MAP_SQL} as LABEL from wells where LITH is not null)
select count(distinct LITH) as distinct_before, count(distinct LABEL) as distinct_after,
  (select count(*) from (select distinct LITH from t) b where LITH not in (select distinct LABEL from t)) as codes_mapped
from t"""))
def label_normalize_report(spark, sf_dir):
    return P.label_normalize_report(wells(spark, sf_dir), TARGET).select(
        "distinct_before", "distinct_after", F.col("codes_mapped").cast("long").alias("codes_mapped"))


# ---------------------------------------------------------------------------
# R8 label distribution; I8/I10 label index; I11 class weights; V5 label stats
# ---------------------------------------------------------------------------

@register("label_distribution", O.with_wells("""
select LITH as label, count(*) as count, round(count(*) * 100.0 / (select count(*) from wells), 6) as pct
from wells where LITH is not null group by LITH"""))
def label_distribution(spark, sf_dir):
    return round_doubles(R.label_distribution(wells(spark, sf_dir), TARGET))


@register("label_index", O.with_wells(f"""
, t as (select {LABEL_MAP_SQL} as label from wells where LITH is not null)
select label, count(*) as count, cast(row_number() over (order by label) - 1 as integer) as "index"
from t group by label"""))
def label_index(spark, sf_dir):
    return I.label_index(labelled_normalized(spark, sf_dir), "LABEL")


_SHIFT_SQL = "case when l_orderkey % 9 = 0 then 100 when l_orderkey % 11 = 0 then -100 when l_orderkey % 13 = 0 then null else 0 end"


@register("label_decode", O.with_wells(f"""
, t as (select *, {LABEL_MAP_SQL} as label from wells where LITH is not null)
, i as (select label, row_number() over (order by label) - 1 as ix from t group by label)
, s as (select {O.KEY_SQL}, cast(ix + {_SHIFT_SQL} as integer) as class_index from t join i using (label))
select s.*, case when class_index is null then null
  else coalesce(label, 'Unknown_Class_' || class_index) end as decoded from s left join i on ix = class_index"""))
def label_decode(spark, sf_dir):
    """Labels to indexes, some shifted out of range, and back to names."""
    rows = labelled_normalized(spark, sf_dir)
    names = [r.label for r in I.label_index(rows, "LABEL").orderBy("index").collect()]  # one per class
    at = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), F.col("LABEL"))
    return (rows.select(*KEY, (at + F.expr(_SHIFT_SQL)).cast("int").alias("class_index"))
            .withColumn("decoded", I.decode_index(F.col("class_index"), names)))


@register("feature_select", O.with_wells(" union all ".join(
    f"select '{f}' as feature, {i} as position, count({f}) as present from wells" for i, f in enumerate(FEATS))))
def feature_select(spark, sf_dir):
    """The configured curves that the table has, in order, with their readings."""
    df = wells(spark, sf_dir)
    found = P.select_features(df, LogConfig(target=TARGET))
    counts = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("position"), F.col(f).alias("present"))
                                for i, f in enumerate(found)]))
    return df.agg(*[F.count(f).alias(f) for f in found]).select(counts)


@register("class_weights", O.with_wells(f"""
, t as (select {LABEL_MAP_SQL} as label from wells where LITH is not null)
, c as (select label, count(*) as count from t group by label)
select label, count, round(cast((select sum(count) from c) as double) / ((select count(*) from c) * count), 6) as weight
from c"""))
def class_weights(spark, sf_dir):
    return round_doubles(I.class_weights(labelled_normalized(spark, sf_dir), "LABEL"))


@register("label_stats", O.with_wells(f"""
select LITH as label, count(*) as sample_count,
  {', '.join(f'round(avg({f}), 6) as {f}_mean, round(stddev_samp({f}), 6) as {f}_std' for f in FEATS)}
from wells where LITH is not null group by LITH"""))
def label_stats(spark, sf_dir):
    return round_doubles(V.label_stats(wells(spark, sf_dir), TARGET, FEATS))


# ---------------------------------------------------------------------------
# V3 correlation, V1 histograms, V2 box statistics, V4 crossplot bins
# ---------------------------------------------------------------------------

@register("correlation", O.with_wells(" union all ".join(
    f"select '{a}' as curve_a, '{b}' as curve_b, round(corr({a}, {b}), 6) as corr from wells"
    for a in FEATS for b in FEATS)))
def correlation(spark, sf_dir):
    return round_doubles(V.correlation(wells(spark, sf_dir), FEATS))


HIST_CURVES = FEATS[:4]
_TOP8 = "(select LITH from wells where LITH is not null group by LITH order by count(*) desc, LITH asc limit 8)"


def _bin_sql(x, c, bins=30):
    return (f"cast(least(floor(({x} - lo_{c}) / (hi_{c} - lo_{c}) * {bins}), {bins - 1}) as integer)")


@register("curve_histogram", O.with_wells(f"""
, sub as (select * from wells where LITH in {_TOP8})
, mm as (select {', '.join(f'min({c}) as lo_{c}, max({c}) as hi_{c}' for c in HIST_CURVES)} from sub)
""" + " union all ".join(
    f"select '{c}' as curve, LITH as label, {_bin_sql(c, c)} as bin, "
    f"round(lo_{c} + {_bin_sql(c, c)} * ((hi_{c} - lo_{c}) / 30), 6) as bin_lo, "
    f"round(lo_{c} + ({_bin_sql(c, c)} + 1) * ((hi_{c} - lo_{c}) / 30), 6) as bin_hi, count(*) as count "
    f"from sub, mm where {c} is not null group by LITH, {_bin_sql(c, c)}, lo_{c}, hi_{c}" for c in HIST_CURVES)))
def curve_histogram(spark, sf_dir):
    return round_doubles(V.curve_histogram(wells(spark, sf_dir), TARGET, HIST_CURVES))


def _box_sql(label_expr, src, curves):
    parts = []
    for c in curves:
        parts.append(f"""select label, '{c}' as curve, count(*) as count, round(min(v), 6) as min,
  round(q1, 6) as q1, round(q2, 6) as median, round(q3, 6) as q3, round(max(v), 6) as max,
  round(min(case when v >= q1 - 1.5 * (q3 - q1) then v end), 6) as lower_whisker,
  round(max(case when v <= q3 + 1.5 * (q3 - q1) then v end), 6) as upper_whisker
from (select {label_expr} as label, {c} as v,
        quantile_cont({c}, 0.25) over (partition by {label_expr}) as q1,
        quantile_cont({c}, 0.5) over (partition by {label_expr}) as q2,
        quantile_cont({c}, 0.75) over (partition by {label_expr}) as q3
      from {src}) x
where v is not null group by label, q1, q2, q3""")
    return " union all ".join(parts)


@register("box_stats", O.with_wells(_box_sql("LITH", "wells where LITH is not null", FEATS)))
def box_stats(spark, sf_dir):
    return round_doubles(V.box_stats(wells(spark, sf_dir), TARGET, FEATS))


_XP_CURVES = sorted({c for _, x, y in V.CROSSPLOTS for c in (x, y)})


@register("crossplot_bins", O.with_wells(f"""
, sub as (select * from wells where LITH in {_TOP8})
, mm as (select {', '.join(f'min({c}) as lo_{c}, max({c}) as hi_{c}' for c in _XP_CURVES)} from sub)
""" + " union all ".join(
    f"select '{name}' as plot, LITH as label, {_bin_sql(x, x)} as xbin, {_bin_sql(y, y)} as ybin, count(*) as count "
    f"from sub, mm where {x} is not null and {y} is not null group by LITH, {_bin_sql(x, x)}, {_bin_sql(y, y)}"
    for name, x, y in V.CROSSPLOTS)))
def crossplot_bins(spark, sf_dir):
    return V.crossplot_bins(wells(spark, sf_dir), TARGET)


# ---------------------------------------------------------------------------
# I1/I2/I7 imputation and scaling (fitted on labelled rows)
# ---------------------------------------------------------------------------

@register("impute_median", O.with_wells(f"""
, t as (select * from wells where LITH is not null)
, m as (select {', '.join(f'quantile_cont({f}, 0.5) as {f}_m' for f in FEATS)} from t)
select {O.KEY_SQL}, {', '.join(f'round(coalesce({f}, {f}_m), 6) as {f}' for f in FEATS)} from t, m"""))
def impute_median(spark, sf_dir):
    lab = Q.drop_null_target(wells(spark, sf_dir), TARGET)
    return round_doubles(I.impute(lab, I.fit_median(lab, FEATS)).select(*KEY, *FEATS))


@register("impute_mean", O.with_wells(f"""
, t as (select * from wells where LITH is not null)
, m as (select {', '.join(f'avg({f}) as {f}_m' for f in FEATS)} from t)
select {O.KEY_SQL}, {', '.join(f'round(coalesce({f}, {f}_m), 6) as {f}' for f in FEATS)} from t, m"""))
def impute_mean(spark, sf_dir):
    lab = Q.drop_null_target(wells(spark, sf_dir), TARGET)
    return round_doubles(I.impute(lab, I.fit_mean(lab, FEATS)).select(*KEY, *FEATS))


@register("scale_standard", O.with_wells(f"""
, t as (select * from wells where LITH is not null)
, m as (select {', '.join(f'quantile_cont({f}, 0.5) as {f}_m' for f in FEATS)} from t)
, i as (select {O.KEY_SQL}, {', '.join(f'coalesce({f}, {f}_m) as {f}' for f in FEATS)} from t, m)
, s as (select {', '.join(f'avg({f}) as {f}_mu, stddev_pop({f}) as {f}_sd' for f in FEATS)} from i)
select {O.KEY_SQL}, {', '.join(f'round(({f} - {f}_mu) / (case when {f}_sd = 0 then 1 else {f}_sd end), 6) as {f}' for f in FEATS)}
from i, s"""))
def scale_standard(spark, sf_dir):
    lab = Q.drop_null_target(wells(spark, sf_dir), TARGET)
    fills = I.fit_median(lab, FEATS)
    scaler = I.fit_scaler(lab, FEATS, fills)
    ex = I.scaled_exprs(FEATS, fills, scaler)
    return round_doubles(lab.select(*KEY, *[ex[f].alias(f) for f in FEATS]))


# ---------------------------------------------------------------------------
# T1/T12/P16 stratified split, folds and down-sample (sizes are exact)
# ---------------------------------------------------------------------------

@register("stratified_split_sizes", O.with_wells(f"""
, c as (select {LABEL_MAP_SQL} as label, count(*) as n from wells where LITH is not null group by 1)
select label, n, cast(floor(0.2 * n + 0.5) as bigint) as n_test, n - cast(floor(0.2 * n + 0.5) as bigint) as n_train
from c"""))
def stratified_split_sizes(spark, sf_dir):
    sp = I.stratified_split(labelled_normalized(spark, sf_dir), "LABEL", KEY, 0.2, seed=42)
    return sp.groupBy(F.col("LABEL").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))


@register("stratified_fold_sizes", O.with_wells(f"""
, c as (select {LABEL_MAP_SQL} as label, count(*) as n from wells where LITH is not null group by 1)
, f as (select unnest(range(0, 5)) as fold)
select label, cast(fold as integer) as fold,
  cast(floor(n * (fold + 1) / 5.0 + 0.5) - floor(n * fold / 5.0 + 0.5) as bigint) as n
from c, f"""))
def stratified_fold_sizes(spark, sf_dir):
    fo = I.stratified_folds(labelled_normalized(spark, sf_dir), "LABEL", KEY, k=5, seed=42)
    return fo.groupBy(F.col("LABEL").alias("label"), "fold").agg(F.count(F.lit(1)).alias("n"))


@register("stratified_sample_sizes", O.with_wells("""
, c as (select LITH as label, count(*) as n from wells where LITH is not null group by 1)
, t as (select count(*) as total from wells)
select label, n, cast(least(n, greatest(1, floor(20000 * n / total))) as bigint) as kept from c, t"""))
def stratified_sample_sizes(spark, sf_dir):
    df = wells(spark, sf_dir)
    smp = I.stratified_sample(df, TARGET, KEY, max_samples=20_000, seed=42)
    full = df.where(F.col(TARGET).isNotNull()).groupBy(F.col(TARGET).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    kept = smp.groupBy(F.col(TARGET).alias("label")).agg(F.count(F.lit(1)).alias("kept"))
    # both sides are per-class aggregates (K rows)
    return full.join(F.broadcast(kept), "label", "left").select(
        "label", "n", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


_KEY_LIST = ", ".join(KEY)


@register("sample_rows", O.with_wells(f"""
select * exclude (u) from (select *, {I.order_key_sql(KEY)} as u from wells)
order by u, {_KEY_LIST} limit 2000"""))
def sample_rows(spark, sf_dir):
    return I.sample_rows(wells(spark, sf_dir), KEY, 2000)


_RANKED = O.with_wells(f"""
, lab as (select {_KEY_LIST}, {LABEL_MAP_SQL} as label, {I.order_key_sql(KEY)} as u from wells where LITH is not null)
, r as (select *, row_number() over (partition by label order by u) - 1 as rank,
               count(*) over (partition by label) as n from lab)
""")


@register("stratified_split_rows", _RANKED + f"select {_KEY_LIST}, label, rank < floor(0.2 * n + 0.5) as is_test from r")
def stratified_split_rows(spark, sf_dir):
    sp = I.stratified_split(labelled_normalized(spark, sf_dir), "LABEL", KEY, 0.2, seed=42)
    return sp.select(*KEY, F.col("LABEL").alias("label"), "is_test")


@register("stratified_fold_rows", _RANKED + f"""select {_KEY_LIST}, label, cast({" + ".join(
    f"(case when rank >= floor(n * {j} / 5.0 + 0.5) then 1 else 0 end)" for j in range(1, 5))} as integer) as fold from r""")
def stratified_fold_rows(spark, sf_dir):
    fo = I.stratified_folds(labelled_normalized(spark, sf_dir), "LABEL", KEY, k=5, seed=42)
    return fo.select(*KEY, F.col("LABEL").alias("label"), "fold")


@register("stratified_sample_rows", O.with_wells(f"""
, lab as (select {_KEY_LIST}, LITH, {I.order_key_sql(KEY)} as u from wells where LITH is not null)
, t as (select count(*) as total from wells)
, r as (select *, row_number() over (partition by LITH order by u) - 1 as rank,
               count(*) over (partition by LITH) as n from lab)
select {_KEY_LIST}, LITH from r, t where rank < least(n, greatest(1, floor(3000 * n / total)))"""))
def stratified_sample_rows(spark, sf_dir):
    return I.stratified_sample(wells(spark, sf_dir), TARGET, KEY, max_samples=3000, seed=42).select(*KEY, TARGET)


_NUM_COLS = [("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
             ("DEPTH_MD", "double"), ("GR", "double"), ("RHOB", "double"), ("NPHI", "double"),
             ("RDEP", "double"), ("DTC", "double"), ("PEF", "double")]


def _narrow_sql(c, t):
    if t == "double":
        return "'double'"
    return (f"case when min({c}) >= -128 and max({c}) <= 127 then 'tinyint' "
            f"when min({c}) >= -32768 and max({c}) <= 32767 then 'smallint' "
            f"when min({c}) >= -2147483648 and max({c}) <= 2147483647 then 'int' else 'bigint' end")


@register("type_narrowing_plan", O.with_wells(" union all ".join(
    f"select '{c}' as \"column\", '{t}' as current_type, round(cast(min({c}) as double), 6) as min_value, "
    f"round(cast(max({c}) as double), 6) as max_value, {_narrow_sql(c, t)} as narrow_type from wells"
    for c, t in _NUM_COLS)))
def type_narrowing_plan(spark, sf_dir):
    df = wells(spark, sf_dir).select(*[c for c, _ in _NUM_COLS])
    return round_doubles(I.narrowing_plan(df))
