"""Evaluation and scoring-analytics queries over a deterministic scored view.

A model's predictions cannot be reproduced in SQL, so the oracle-checked
queries use a rule-based stand-in: ``PREDICTED`` mostly equals the actual
(normalized) label, with rules that produce errors, a class that is never
observed (Anhydrite) and one that is never predicted (Tuffite); ``CONFIDENCE``
is an arithmetic function of the key in (0, 1] that hits the band edges.
The same operators run on real model output in the ML queries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..operators import evaluate as E
from ..operators import score as R
from ..operators import charts as V
from ..session import shared_dir
from ..sources.sinks import run_summary, write_json_rows
from ..sources.testview import KEY, wells
from . import oracle as O
from .q_analytics import LABEL_MAP_SQL, labelled_normalized
from .registry import register, round_doubles

PRED_SQL = ("case when l_orderkey % 7 = 0 then 'Shale' when l_orderkey % 11 = 0 then 'Sandstone' "
            "when l_orderkey % 13 = 0 then 'Anhydrite' when LITH = 'Tuffite' then 'Dolomite' else {label} end")
PRED2_SQL = "case when l_orderkey % 5 = 0 then 'Shale' when l_orderkey % 17 = 0 then 'Dolomite' else {label} end"
CONF_SQL = "cast((l_orderkey * 37 + l_linenumber * 11 + l_partkey) % 100 + 1 as double) / 100"

SCORED_CTE = f"""
, scored as (select *, {LABEL_MAP_SQL} as ACTUAL, {PRED_SQL.format(label=LABEL_MAP_SQL)} as PREDICTED,
   {PRED2_SQL.format(label=LABEL_MAP_SQL)} as PREDICTED2, {CONF_SQL} as CONFIDENCE
   from wells where LITH is not null)"""


def scored(spark, sf_dir):
    df = labelled_normalized(spark, sf_dir).withColumnRenamed("LABEL", "ACTUAL")
    return df.withColumns({"PREDICTED": F.expr(PRED_SQL.format(label="ACTUAL")),
                           "PREDICTED2": F.expr(PRED2_SQL.format(label="ACTUAL")),
                           "CONFIDENCE": F.expr(CONF_SQL)})


def S(body: str) -> str:
    return O.with_wells(SCORED_CTE + "\n" + body)


_CLASSES = "(select ACTUAL as c from scored union select PREDICTED from scored)"

CM_SQL = S(f"""
, cls as {_CLASSES}
, cnt as (select ACTUAL, PREDICTED, count(*) as n from scored group by 1, 2)
select a.c as actual, p.c as predicted, coalesce(n, 0) as count
from cls a cross join cls p left join cnt on cnt.ACTUAL = a.c and cnt.PREDICTED = p.c""")


@register("confusion_matrix", CM_SQL)
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(scored(spark, sf_dir), "ACTUAL", "PREDICTED")


@register("confusion_normalized", S(f"""
, cls as {_CLASSES}
, cnt as (select ACTUAL, PREDICTED, count(*) as n from scored group by 1, 2)
, g as (select a.c as actual, p.c as predicted, coalesce(n, 0) as count
        from cls a cross join cls p left join cnt on cnt.ACTUAL = a.c and cnt.PREDICTED = p.c)
select actual, predicted, count,
  round(case when sum(count) over (partition by actual) = 0 then null
        else count / sum(count) over (partition by actual) end, 6) as share
from g"""))
def confusion_normalized(spark, sf_dir):
    return round_doubles(E.confusion_normalized(scored(spark, sf_dir), "ACTUAL", "PREDICTED"))


def _report_sql(pred: str) -> str:
    return f"""
, cls as (select ACTUAL as c from scored union select {pred} from scored)
, per as (select c as cls,
    (select count(*) from scored where ACTUAL = c and {pred} = c) as tp,
    (select count(*) from scored where ACTUAL = c) as support,
    (select count(*) from scored where {pred} = c) as npred from cls)
, m as (select cls, support, tp,
    case when npred = 0 then 0.0 else tp * 1.0 / npred end as precision,
    case when support = 0 then 0.0 else tp * 1.0 / support end as recall from per)
, m2 as (select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1_score from m)
, t as (select sum(support) as n, sum(tp) as tp, avg(precision) as mp, avg(recall) as mr, avg(f1_score) as mf,
          sum(precision * support) as wp, sum(recall * support) as wr, sum(f1_score * support) as wf from m2)"""


CLASS_REPORT_SQL = S(_report_sql("PREDICTED") + """
select cls as class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1_score, 6) as f1_score,
  cast(support as bigint) as support from m2
union all select 'accuracy', round(tp * 1.0 / n, 6), round(tp * 1.0 / n, 6), round(tp * 1.0 / n, 6), cast(n as bigint) from t
union all select 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), cast(n as bigint) from t
union all select 'weighted avg', round(wp / n, 6), round(wr / n, 6), round(wf / n, 6), cast(n as bigint) from t""")


@register("class_report", CLASS_REPORT_SQL)
def class_report(spark, sf_dir):
    return round_doubles(E.class_report(scored(spark, sf_dir), "ACTUAL", "PREDICTED"))


#: a vocabulary with a class that neither side holds
VOCABULARY = sorted({*C.EXPECTED_LABELS, "Tuffite"})


@register("class_report_vocabulary", CLASS_REPORT_SQL.replace(
    "(select ACTUAL as c from scored union select PREDICTED from scored)",
    "(select unnest([" + ", ".join(f"'{x}'" for x in VOCABULARY) + "]) as c)"))
def class_report_vocabulary(spark, sf_dir):
    """E2 over all classes of a model, Salt among them, which never occurs."""
    return round_doubles(E.class_report(scored(spark, sf_dir), "ACTUAL", "PREDICTED", labels=VOCABULARY))


def _metrics_sql(pred, name):
    return S(_report_sql(pred) + f"""
select '{name}' as model, round(tp * 1.0 / n, 6) as accuracy, round(wp / n, 6) as precision,
  round(wr / n, 6) as recall, round(wf / n, 6) as f1_score from t""")


@register("weighted_metrics", _metrics_sql("PREDICTED", "random_forest"))
def weighted_metrics(spark, sf_dir):
    return round_doubles(E.weighted_metrics(scored(spark, sf_dir), "ACTUAL", "PREDICTED", "random_forest"))


def _metrics_body(pred, name, alias):
    rep = _report_sql(pred).replace(", cls as", f", {alias}_cls as").replace("from cls", f"from {alias}_cls")
    rep = rep.replace(", per as", f", {alias}_per as").replace("from per", f"from {alias}_per")
    rep = rep.replace(", m as", f", {alias}_m as").replace("from m)", f"from {alias}_m)")
    rep = rep.replace(", m2 as", f", {alias}_m2 as").replace("from m2", f"from {alias}_m2")
    rep = rep.replace(", t as", f", {alias}_t as")
    return rep + f"""
, {alias} as (select '{name}' as model, tp * 1.0 / n as accuracy, wp / n as precision, wr / n as recall,
    wf / n as f1_score from {alias}_t)"""


BEST_SQL = S(_metrics_body("PREDICTED", "random_forest", "ma") + _metrics_body("PREDICTED2", "xgboost", "mb") + """
, allm as (select *, 0 as model_order from ma union all select *, 1 from mb)
select model, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall,
  round(f1_score, 6) as f1_score, model_order from allm order by f1_score desc, model_order asc limit 1""")


@register("best_model_pick", BEST_SQL)
def best_model_pick(spark, sf_dir):
    sc = scored(spark, sf_dir)
    m1 = E.weighted_metrics(sc, "ACTUAL", "PREDICTED", "random_forest").withColumn("model_order", F.lit(0))
    m2 = E.weighted_metrics(sc, "ACTUAL", "PREDICTED2", "xgboost").withColumn("model_order", F.lit(1))
    return round_doubles(E.best_model(m1.unionByName(m2)))


COMPARE_SQL = BEST_SQL.replace("order by f1_score desc, model_order asc limit 1", "")


@register("compare_models", COMPARE_SQL)
def compare_models(spark, sf_dir):
    """Both rule-based predictions, one scan."""
    return round_doubles(E.compare_models(scored(spark, sf_dir), "ACTUAL", {"random_forest": "PREDICTED", "xgboost": "PREDICTED2"}))


@register("accuracy_pick", BEST_SQL.replace("order by f1_score desc, model_order asc",
                                            "order by accuracy desc, model <> 'random_forest', model"))
def accuracy_pick(spark, sf_dir):
    """The better of both rule-based predictions by accuracy."""
    return round_doubles(E.pick_by_accuracy(
        E.compare_models(scored(spark, sf_dir), "ACTUAL", {"random_forest": "PREDICTED", "xgboost": "PREDICTED2"})))


@register("metrics_json", COMPARE_SQL)
def metrics_json(spark, sf_dir):
    """Both models' metrics written as JSON rows and read back."""
    rows = compare_models(spark, sf_dir)
    path = write_json_rows(rows, shared_dir(spark, f"metrics-{uuid.uuid4().hex[:12]}"))
    return spark.read.schema(rows.schema).json(path)


@register("run_summary_facts", BEST_SQL.replace("select model, round(accuracy, 6)", """
, best as (select model, round(accuracy, 6)""") + """)
, names as (select list(distinct ACTUAL order by ACTUAL) as c from scored)
select (select count(*) from scored) as total_samples, """ + str(len(C.FEATURES)) + """ as features, cast(len(c) as integer) as classes,
  array_to_string(c, ',') as class_names, model as best_model, f1_score as best_f1_score,
  2 as models, (select round(accuracy, 6) from ma) as forest_accuracy from best, names""")
def run_summary_facts(spark, sf_dir):
    """The summary of a run over both rule-based predictions."""
    sc = scored(spark, sf_dir)
    metrics = E.compare_models(sc, "ACTUAL", {"random_forest": "PREDICTED", "xgboost": "PREDICTED2"}).collect()
    about = sc.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("ACTUAL")).alias("names")).first()
    s = run_summary(spark, about.n, len(C.FEATURES), about.names, [r.asDict() for r in metrics])
    return round_doubles(s.select(
        "dataset_info.total_samples", "dataset_info.features", "dataset_info.classes",
        F.array_join("dataset_info.class_names", ",").alias("class_names"), "best_model", "best_f1_score",
        F.size("all_model_results").alias("models"),
        F.col("all_model_results")["random_forest"]["accuracy"].alias("forest_accuracy")))


# ---------------------------------------------------------------------------
# R3, R5-R11, V6, V7 on the scored view
# ---------------------------------------------------------------------------

def _bands_sql(edges, right_closed=True):
    parts, prev = [], 0.0
    for i, (hi, lab) in enumerate(edges):
        cond = f"CONFIDENCE > {prev} and CONFIDENCE <= {hi}" if right_closed else \
            f"CONFIDENCE >= {prev} and CONFIDENCE < {hi}"
        parts.append(f"select {i} as band_order, '{lab}' as band, count(*) filter (where {cond}) as count, "
                     f"round(count(*) filter (where {cond}) * 100.0 / count(*), 6) as pct from scored")
        prev = hi
    return " union all ".join(parts)


@register("confidence_bands4", S(_bands_sql(C.CONFIDENCE_BANDS4)))
def confidence_bands4(spark, sf_dir):
    return round_doubles(R.confidence_bands4(scored(spark, sf_dir), "CONFIDENCE"))


@register("confidence_categories3", S(_bands_sql(C.CONFIDENCE_CATEGORIES3)))
def confidence_categories3(spark, sf_dir):
    return round_doubles(R.confidence_categories3(scored(spark, sf_dir), "CONFIDENCE"))


def _counts3_sql():
    parts = []
    for i, (lab, lo, hi) in enumerate(C.CONFIDENCE_COUNTS3):
        conds = ["true"]
        if lo is not None:
            conds.append(f"CONFIDENCE >= {lo}")
        if hi is not None:
            conds.append(f"CONFIDENCE < {hi}")
        cond = " and ".join(conds)
        parts.append(f"select {i} as level_order, '{lab}' as confidence_level, count(*) filter (where {cond}) as count, "
                     f"round(count(*) filter (where {cond}) * 100.0 / count(*), 6) as pct from scored")
    return " union all ".join(parts)


@register("confidence_counts3", S(_counts3_sql()))
def confidence_counts3(spark, sf_dir):
    return round_doubles(R.confidence_counts3(scored(spark, sf_dir), "CONFIDENCE"))


@register("threshold_mask", S(f"""
select {O.KEY_SQL}, case when CONFIDENCE < 0.6 then '{C.LOW_CONFIDENCE_LABEL}' else PREDICTED end as Predicted_Lithology,
  CONFIDENCE as Prediction_Confidence from scored"""))
def threshold_mask(spark, sf_dir):
    sc = scored(spark, sf_dir)
    return sc.select(*KEY, R.threshold_mask(F.col("PREDICTED"), F.col("CONFIDENCE"), 0.6).alias("Predicted_Lithology"),
                     F.col("CONFIDENCE").alias("Prediction_Confidence"))


@register("top_uncertain", S(f"""
select {O.KEY_SQL}, ACTUAL, PREDICTED, round(CONFIDENCE, 3) as CONFIDENCE, round(GR, 3) as GR,
  round(RHOB, 3) as RHOB, round(NPHI, 3) as NPHI
from scored order by CONFIDENCE, {O.KEY_SQL} limit 20"""))
def top_uncertain(spark, sf_dir):
    return R.top_uncertain(scored(spark, sf_dir), "CONFIDENCE", list(KEY),
                           ["ACTUAL", "PREDICTED", "CONFIDENCE", "GR", "RHOB", "NPHI"], 20)


@register("prediction_summary", S("""
select count(*) as total, count(distinct PREDICTED) as distinct_labels, round(avg(CONFIDENCE), 6) as avg_confidence,
  round(min(CONFIDENCE), 6) as min_confidence, round(max(CONFIDENCE), 6) as max_confidence from scored"""))
def prediction_summary(spark, sf_dir):
    return round_doubles(R.prediction_summary(scored(spark, sf_dir), "PREDICTED", "CONFIDENCE"))


@register("depth_track", S("""
select WELL, DEPTH_MD, ACTUAL as actual, PREDICTED as predicted from scored"""))
def depth_track(spark, sf_dir):
    return R.depth_track(scored(spark, sf_dir), "WELL", "DEPTH_MD", "ACTUAL", "PREDICTED")


@register("confidence_histogram", S("""
, mm as (select min(CONFIDENCE) as lo, max(CONFIDENCE) as hi, avg(CONFIDENCE) as m from scored)
select cast(least(floor((CONFIDENCE - lo) / (hi - lo) * 30), 29) as integer) as bin,
  round(lo + cast(least(floor((CONFIDENCE - lo) / (hi - lo) * 30), 29) as integer) * ((hi - lo) / 30), 6) as bin_lo,
  round(lo + (cast(least(floor((CONFIDENCE - lo) / (hi - lo) * 30), 29) as integer) + 1) * ((hi - lo) / 30), 6) as bin_hi,
  count(*) as count, round(m, 6) as mean_value
from scored, mm group by 1, lo, hi, m"""))
def confidence_histogram(spark, sf_dir):
    return round_doubles(V.value_histogram(scored(spark, sf_dir), "CONFIDENCE", 30))


@register("confidence_box", O.with_wells(SCORED_CTE + "\n" + __import__(
    "boreframe.plans.q_analytics", fromlist=["_box_sql"])._box_sql("PREDICTED", "scored", ["CONFIDENCE"])))
def confidence_box(spark, sf_dir):
    return round_doubles(V.box_stats(scored(spark, sf_dir), "PREDICTED", ["CONFIDENCE"]))


@register("depth_bins", S("""
, c as (select WELL, cast(floor(DEPTH_MD / 100.0) as bigint) as depth_bin, PREDICTED as label, count(*) as n
        from scored group by 1, 2, 3)
, r as (select *, row_number() over (partition by WELL, depth_bin order by n desc, label desc) as rn from c)
select WELL, depth_bin, label as mode_label, n as count from r where rn = 1"""))
def depth_bins(spark, sf_dir):
    return R.depth_bins(scored(spark, sf_dir), "WELL", "DEPTH_MD", "PREDICTED", 100.0)
