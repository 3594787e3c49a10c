"""Model queries.

All of them train on the labelled well-log view with the normalized label,
split 80/20 per class (exact quotas, hash order), and report on the test
rows.  Queries that need any fitted model use the reproduced fallback forest
(50 trees of depth 10).  The searches, the large forests and ``gbt_softmax`` run
at the full setting; the one-vs-rest boosting is cut so that the check ends.
The README has the settings, cuts and figures.
What SQL can check of a model's output (row keys, supports, probabilities that
sum to one, the predicted class being the most probable) has oracles; the
learned numbers themselves do not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..operators import evaluate as E
from ..operators import prepare as I
from ..operators import train as T
from ..session import shared_dir
from ..sources.testview import KEY, wells
from . import oracle as O
from .q_analytics import LABEL_MAP_SQL, labelled_normalized
from .registry import register, round_doubles

FEATS = list(C.FEATURES)
LABEL = "LABEL"


def _split(spark, sf_dir):
    return T.train_test(labelled_normalized(spark, sf_dir), LABEL, KEY, 0.2, seed=42)


def _forest():
    """The reproduced fallback forest."""
    return T.random_forest(num_trees=50, max_depth=10, min_leaf=2)


def _metrics(model, test, name):
    sc = T.score_table(model, test, prob_prefix=None)
    return E.weighted_metrics(sc, LABEL, "Predicted_Lithology", name)


@register("rf_baseline")
def rf_baseline(spark, sf_dir):
    """Complete cases, 100 trees of unlimited depth, per-class report on the test rows."""
    feats = ["GR", "RHOB", "NPHI", "DTC", "PEF"]
    df = labelled_normalized(spark, sf_dir).na.drop("any", subset=feats + [LABEL])
    train, test = T.train_test(df, LABEL, KEY, 0.2, seed=42)
    model = T.fit(train, feats, LABEL, T.forest(num_trees=100, max_depth=30))  # unlimited: 30
    sc = T.score_table(model, test, prob_prefix=None)
    return round_doubles(E.class_report(sc, LABEL, "Predicted_Lithology"))


def _balanced(spark, sf_dir, name: str, **setting):
    train, test = _split(spark, sf_dir)
    weights = {r["label"]: r["weight"] for r in I.class_weights(train, LABEL).collect()}
    train = I.with_weight_column(train, LABEL, weights)
    model = T.fit(train, FEATS, LABEL, T.forest(weight_col="weight", **setting))
    return _metrics(model, test, name), model.stages[-1]


@register("rf_balanced")
def rf_balanced(spark, sf_dir):
    """200 trees of depth 20, balanced class weights, sqrt features, and the
    accuracy over the training rows by the trees whose bag lacks them."""
    metrics, model = _balanced(spark, sf_dir, "random_forest", num_trees=200, max_depth=20, oob_score=True)
    accuracy, rows = model.oob
    return round_doubles(metrics.withColumns({"oob_score": F.lit(accuracy), "oob_rows": F.lit(rows)}))


@register("extra_trees_variant")
def extra_trees_variant(spark, sf_dir):
    """Extremely randomised trees (a drawn threshold per curve), no bootstrap,
    balanced weights; 200 trees of depth 25."""
    return round_doubles(_balanced(spark, sf_dir, "extra_trees", num_trees=200, max_depth=25, bootstrap=False,
                                   random_thresholds=True)[0])


@register("rf_grid")
def rf_grid(spark, sf_dir):
    """All points of the large forest grid with its folds, stratified,
    weighted F1, by staged evaluation."""
    train, _test = _split(spark, sf_dir)
    grid, folds = T.GRIDS["large"]["random_forest"]
    model, results = T.grid_search(train, FEATS, LABEL, KEY, T.forest(), grid, folds=folds)
    names = ["numTrees", "maxDepth", "minSplit", "minInstancesPerNode"]
    rows = [(*(int(p[n]) for n in names), s) for p, s in results]
    return round_doubles(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", avg_f1 double"))


@register("gbt_softmax")
def gbt_softmax(spark, sf_dir):
    """Softmax boosting over all classes, 50 rounds of depth 6."""
    train, test = _split(spark, sf_dir)
    return round_doubles(_metrics(T.fit(train, FEATS, LABEL, T.boosted()), test, "xgboost"))


@register("gbt_ovr")
def gbt_ovr(spark, sf_dir):
    """T5, second form: one-vs-rest boosted trees with normalized probabilities."""
    train, test = _split(spark, sf_dir)
    model = T.fit(train, FEATS, LABEL, T.boosted_ovr(max_iter=10, max_depth=4, parallelism=4))  # cut from 50 / 6
    return round_doubles(_metrics(model, test, "xgboost"))


@register("model_comparison")
def model_comparison(spark, sf_dir):
    """Metrics of both learners and the pick by weighted F1."""
    train, test = _split(spark, sf_dir)
    fitted, scaler = T.fit_preprocessing(train, FEATS)
    rf = T.fit(train, FEATS, LABEL, _forest(), fitted, scaler)
    gb = T.fit(train, FEATS, LABEL, T.boosted_ovr(max_iter=5, max_depth=4, parallelism=4), fitted, scaler)  # cut
    both = test
    for name, model in (("rf", rf), ("gb", gb)):
        both = T.score_table(model, both, label_out=f"P_{name}", conf_out=f"C_{name}", prob_prefix=None)
    cmp = E.compare_models(both, LABEL, {"Random Forest": "P_rf", "Xgboost": "P_gb"}).cache()
    best = E.best_model(cmp).select(F.col("model").alias("best"))
    return round_doubles(cmp.withColumn("is_best", F.col("model") == F.lit(best.first()["best"])))


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """E5: impurity importances of a forest, sorted."""
    train, _ = _split(spark, sf_dir)
    model = T.fit(train, FEATS, LABEL, _forest())
    imp = T.feature_importance(model, FEATS)
    return round_doubles(spark.createDataFrame([(f, float(v), i) for i, (f, v) in enumerate(imp)],
                                               "feature string, importance double, rank int"))


@register("score_probabilities")
def score_probabilities(spark, sf_dir):
    """Score the whole view (labelled or not) with probabilities per class."""
    train, _ = _split(spark, sf_dir)
    model = T.fit(train, FEATS, LABEL, _forest())
    sc = T.score_table(model, wells(spark, sf_dir), model_name="random_forest")
    return sc.select(*KEY, "Predicted_Lithology", "Prediction_Confidence",
                     *[c for c in sc.columns if c.startswith("Prob_")], "Model_Used")


@register("streaming_score")
def streaming_score(spark, sf_dir):
    """Score lineitem files as a stream (availableNow) with training-time statistics.

    The stream joins each micro-batch to the static part table (the same
    view text as batch), applies quality flags with the fences fitted on the
    training rows, scores with the fitted pipeline and appends to a table in
    the shared checkpoint folder; the result is read back from that table.
    """
    from ..operators import quality as Q
    from ..sources.testview import WELLS_SQL, register_tables
    from ..streaming.scoring import run_to_table, score_stream
    train, _ = _split(spark, sf_dir)
    model = T.fit(train, FEATS, LABEL, _forest())
    fences = Q.iqr_fences(train, FEATS)
    register_tables(spark, sf_dir, ("part",))
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/lineitem*.parquet")
    stream.createOrReplaceTempView("lineitem_stream")
    view = spark.sql(WELLS_SQL.replace("from lineitem l", "from lineitem_stream l"))
    scored = score_stream(model, view, FEATS, fences)
    path = run_to_table(spark, scored.select(*KEY, "WELL", "DEPTH_MD", "Predicted_Lithology",
                                             "Prediction_Confidence", "Quality_Score", "Quality_Issues"))
    return spark.read.parquet(path)


def _synthetic_sql() -> str:
    from ..sources.synthetic import CLASSES_5

    def uniform(seed):  # noqa: ANN001, ANN202
        return f"(({I.order_key_sql(['k'], seed)} + 0.5) / {float(1 << 52)!r})"
    names = list(CLASSES_5)
    cls = " ".join(f"when u < {sum([1 / len(names)] * (i + 1))!r} then '{n}'" for i, n in enumerate(names[:-1]))
    curves = []
    for j, f in enumerate(FEATS):
        lo, hi = (" ".join(f"when '{n}' then {float(CLASSES_5[n][f][k])!r}" for n in names) for k in (0, 1))
        lo, hi = f"(case cls {lo} end)", f"(case cls {hi} end)"
        u1, u2 = uniform(200 + j + 42), uniform(200 + j + 42 + 7919)
        noise = f"sqrt(-2.0 * ln({u1})) * cos(2 * pi() * {u2}) * ({hi} - {lo}) * 0.05"
        curves.append(f"case when {uniform(300 + j + 42)} < 0.02 then null else round(greatest(0.0, "
                      f"{lo} + ({hi} - {lo}) * {uniform(100 + j + 42)} + {noise}), 6) end as {f}")
    keys = ", ".join(KEY)
    return f"""
with i as (select {keys}, md5(concat_ws('|', {keys})) as k from lineitem),
s as (select *, {uniform(42)} as u, {I.order_key_sql(['k'])}::bigint as rid from i),
c as (select *, case {cls} else '{names[-1]}' end as cls from s)
select {keys}, cls as FORCE_2020_LITHOFACIES_LITHOLOGY, {", ".join(curves)},
  'SYNTH_WELL_' || (rid % 500) as WELL, 1500.0 + (rid % 10000000)::double * 0.5 as DEPTH_MD from c"""


@register("synthetic_logs", _synthetic_sql())
def synthetic_logs(spark, sf_dir):
    """One synthetic labelled sample per lineitem row (5-class ranges, 2 % blanks)."""
    from ..sources.synthetic import synthetic_logs as gen
    src = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return round_doubles(gen(src, list(KEY)))


def _knn_sql() -> str:
    f6 = ", ".join(FEATS)
    d2 = " + ".join(f"coalesce((d.{f} - r.{f}) * (d.{f} - r.{f}), 0.0)" for f in FEATS)
    n = " + ".join(f"(case when d.{f} is not null and r.{f} is not null then 1 else 0 end)" for f in FEATS)
    each = " union all ".join(
        f"select {', '.join('r.' + x for x in FEATS)}, '{f}' as j, min({{'d': ({d2}) * 6.0 / ({n}), 'v': d.{f}}}, 5) as top "
        f"from r join d on r.{f} is null and d.{f} is not null where ({n}) > 0 group by {', '.join('r.' + x for x in FEATS)}"
        for f in FEATS)
    same = " and ".join(f"t.{f} is not distinct from w.{f}" for f in FEATS)
    fills = ", ".join(f"max(v) filter (j = '{f}') as k_{f}" for f in FEATS)
    out = ", ".join(f"round(coalesce(t.{f}, k_{f}), 6) as {f}" for f in FEATS)
    return O.with_wells(f"""
, t as (select {', '.join(KEY)}, {', '.join(f'cast({f} as double) as {f}' for f in FEATS)} from wells where LITH is not null)
, d as (select {f6} from t)
, r as (select distinct * from d where {' or '.join(f + ' is null' for f in FEATS)})
, c as (select {f6}, j, list_avg(list_transform(top, lambda x: x.v)) as v from ({each}))
, w as (select {f6}, {fills} from c group by {f6})
select {', '.join('t.' + k for k in KEY)}, {out} from t left join w on {same}""")


@register("knn_impute", _knn_sql())
def knn_impute(spark, sf_dir):
    """Exact 5-NN imputation of the labelled view (donors: all labelled rows)."""
    from ..operators.knn import knn_impute as knn
    lab = labelled_normalized(spark, sf_dir).select(*KEY, *FEATS)
    return round_doubles(knn(lab, FEATS, k=5))


@register("streaming_knn_fill", _knn_sql())
def streaming_knn_fill(spark, sf_dir):
    """R12 with KNN: the labelled view as a stream, each micro-batch filled from
    the donors (all labelled rows), which are dealt to cells once."""
    from ..operators.knn import index_donors, knn_fill
    from ..streaming.scoring import batches_to_table
    lab = labelled_normalized(spark, sf_dir).select(*KEY, *FEATS)
    index = index_donors(lab, FEATS, k=5)
    rows = f"{shared_dir(spark, f'knn-rows-{uuid.uuid4().hex[:12]}')}/rows"
    lab.write.parquet(rows)
    stream = spark.readStream.schema(lab.schema).parquet(rows)
    path = batches_to_table(spark, stream, lambda batch: knn_fill(batch, index))
    return round_doubles(spark.read.parquet(path).select(*KEY, *FEATS))


@register("iterative_impute")
def iterative_impute(spark, sf_dir):
    """I4: round-robin regression imputation of the labelled view."""
    from ..operators.impute import iterative_impute as it
    lab = labelled_normalized(spark, sf_dir).select(*KEY, *FEATS)
    return round_doubles(it(lab, FEATS, max_iter=10))


@register("impute_apply_new_rows", O.with_wells(f"""
, m as (select {', '.join(f'avg({f}) as m_{f}' for f in FEATS)} from wells where LITH is not null)
select {', '.join(KEY)}, {', '.join(f'round(coalesce({f}, m_{f}), 6) as {f}' for f in FEATS)}
from wells, m where LITH is null"""))
def impute_apply_new_rows(spark, sf_dir):
    """An imputer fitted on the labelled rows, applied to the unlabelled ones."""
    from ..operators.impute import apply_imputer, fit_imputer
    table = wells(spark, sf_dir)
    fitted, _ = fit_imputer(table.where("LITH is not null"), FEATS, "mean")
    return round_doubles(apply_imputer(table.where("LITH is null").select(*KEY, *FEATS), FEATS, fitted))


@register("bakeoff_mask", O.with_wells(f"""
select {', '.join(KEY)}, {', '.join(
    f"{I.order_key_sql([repr(f), *KEY])} < {0.1 * (1 << 52)!r} and {f} is not null as masked_{f}" for f in FEATS)}
from wells where LITH is not null"""))
def bakeoff_mask(spark, sf_dir):
    """The cells that the bake-off empties."""
    from ..operators.impute import masked_cells
    lab = labelled_normalized(spark, sf_dir)
    m = masked_cells(lab, FEATS, list(KEY))
    return m.select(*KEY, *[F.col(f"__k_{f}").alias(f"masked_{f}") for f in FEATS])


def _bake_sql() -> str:
    cell = {f: f"({I.order_key_sql([repr(f), *KEY])} < {0.1 * (1 << 52)!r} and {f} is not null)" for f in FEATS}
    rows = []
    for t, agg in (("median", "median"), ("mean", "avg")):
        se = " + ".join(f"sum(case when k_{f} then pow(s_{f} - {f}, 2) else 0 end)" for f in FEATS)
        n = " + ".join(f"count(*) filter (k_{f})" for f in FEATS)
        stats = ", ".join(f"{agg}({f}) filter (not k_{f}) as s_{f}" for f in FEATS)
        rows.append(f"select '{t}' as technique, round(({se}) / ({n}), 6) as mse from k, (select {stats} from k)")
    return O.with_wells(f"""
, k as (select {', '.join(f'cast({f} as double) as {f}, {cell[f]} as k_{f}' for f in FEATS)} from wells where LITH is not null)
{' union all '.join(rows)}""")


@register("imputation_scores", _bake_sql())
def imputation_scores(spark, sf_dir):
    """The two techniques that SQL can repeat, scored on the whole table."""
    from ..operators.impute import imputation_bakeoff as bake
    scores = bake(labelled_normalized(spark, sf_dir), FEATS, list(KEY), techniques=["median", "mean"])
    return round_doubles(spark.createDataFrame(scores, "technique string, mse double"))


@register("imputation_bakeoff")
def imputation_bakeoff(spark, sf_dir):
    """The four techniques scored on the masked tenth of all cells."""
    from ..operators.impute import best_technique, imputation_bakeoff as bake
    scores = bake(labelled_normalized(spark, sf_dir), FEATS, list(KEY))
    best = best_technique(scores)
    return spark.createDataFrame([(t, float(m), t == best) for t, m in scores],
                                 "technique string, mse double, is_best boolean")


_CHECKED_SQL = O.with_wells(f"select {', '.join(KEY)}, true as sums_to_one, true as is_most_probable, true as known_class from wells")


@register("score_checks", _CHECKED_SQL)
def score_checks(spark, sf_dir):
    """Per scored row, do the probabilities add up and name the prediction."""
    train, _ = _split(spark, sf_dir)
    model = T.fit(train, FEATS, LABEL, _forest())
    sc = T.score_table(model, wells(spark, sf_dir))
    probs = [c for c in sc.columns if c.startswith("Prob_")]
    total = sum((F.col(f"`{c}`") for c in probs), F.lit(0.0))
    named = F.element_at(F.create_map(*[x for c in probs for x in (F.lit(c[5:]), F.col(f"`{c}`"))]), F.col("Predicted_Lithology"))
    return sc.select(*KEY, (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
                     (named == F.greatest(*[F.col(f"`{c}`") for c in probs])).alias("is_most_probable"),
                     F.col("Predicted_Lithology").isin(T.class_labels(model)).alias("known_class"))


@register("test_supports", O.with_wells(f"""
, c as (select {LABEL_MAP_SQL} as cls, count(*) as n from wells where LITH is not null group by 1)
select cls as class, cast(floor(0.2 * n + 0.5) as bigint) as support from c"""))
def test_supports(spark, sf_dir):
    """Supports per class of a fitted model's report on the test rows."""
    train, test = _split(spark, sf_dir)
    model = T.fit(train, FEATS, LABEL, _forest())
    labels = T.class_labels(model)
    rep = E.class_report(T.score_table(model, test, prob_prefix=None), LABEL, "Predicted_Lithology", labels=labels)
    return rep.where(F.col("class").isin(labels)).select("class", "support")


@register("model_roundtrip_batch_score")
def model_roundtrip_batch_score(spark, sf_dir):
    """Write the view as per-well files, save a run, load the
    newest run and batch-score all well files in one read and one write."""
    import uuid

    from ..session import shared_dir
    from ..sources.sinks import write_table
    from ..streaming.scoring import batch_score_files
    base = shared_dir(spark, f"roundtrip-{uuid.uuid4().hex[:12]}")
    view = wells(spark, sf_dir)
    write_table(view, f"{base}/wells", partition_by=("WELL",))
    train, _ = _split(spark, sf_dir)
    model = T.fit(train, FEATS, LABEL, _forest())
    T.save_run(spark, f"{base}/models", {"random_forest": model})
    models, _run = T.load_latest(spark, f"{base}/models")
    out = batch_score_files(spark, models["random_forest"], f"{base}/wells", FEATS, f"{base}/scored", fmt="parquet")
    return spark.read.parquet(out).select(*KEY, "WELL", "Predicted_Lithology", "Prediction_Confidence")


_KEYS = ", ".join(KEY)


@register("score_names", O.with_wells(f"select {_KEYS}, true as known_class, true as sure, 0 as probability_columns from wells"))
def score_names(spark, sf_dir):
    """R2: names and confidence alone, without a column per class."""
    train, _ = _split(spark, sf_dir)
    model = T.fit(train, FEATS, LABEL, _forest())
    sc = T.score_table(model, wells(spark, sf_dir), prob_prefix=None)
    sure, n = F.col("Prediction_Confidence"), len(T.class_labels(model))
    return sc.select(*KEY, F.col("Predicted_Lithology").isin(T.class_labels(model)).alias("known_class"),
                     ((sure >= 1 / n - 1e-9) & (sure <= 1 + 1e-9)).alias("sure"),
                     F.lit(sum(c.startswith("Prob_") for c in sc.columns)).alias("probability_columns"))


@register("importance_checks", O.with_wells(" union all ".join(
    f"select '{f}' as feature, count({f}) > 0 as in_range, true as in_order, true as sums_to_one from wells" for f in FEATS)))
def importance_checks(spark, sf_dir):
    """E5: every curve once, falling importances, sum 1."""
    imp = feature_importance(spark, sf_dir)
    before = F.lag("importance").over(Window.partitionBy(F.lit(1)).orderBy("rank"))  # one row per curve
    total = F.sum("importance").over(Window.partitionBy(F.lit(1)))
    v = F.col("importance")
    return imp.select("feature", v.between(0, 1).alias("in_range"), (v <= F.coalesce(before, v)).alias("in_order"),
                      (F.abs(total - 1) < 1e-5).alias("sums_to_one"))


@register("saved_run_checks", O.with_wells(f"""
select {_KEYS}, true as same_label, true as same_confidence, true as newest, true as same_metrics from wells"""))
def saved_run_checks(spark, sf_dir):
    """Of two saved runs the newest is loaded, with its metrics, and scores as it did before."""
    base = shared_dir(spark, f"runs-{uuid.uuid4().hex[:12]}")
    train, test = _split(spark, sf_dir)
    older = T.fit(train, FEATS, LABEL, T.random_forest(num_trees=5, max_depth=3))
    model = T.fit(train, FEATS, LABEL, _forest())
    T.save_run(spark, base, {"random_forest": older})
    metrics = round_doubles(_metrics(model, test, "random_forest")).cache()
    run = T.save_run(spark, base, {"random_forest": model}, metrics)
    models, found = T.load_latest(spark, base)
    kept = T.load_metrics(spark, base).select(*metrics.columns).collect()
    df = T.score_table(model, wells(spark, sf_dir), label_out="A", conf_out="CA", prob_prefix=None)
    df = T.score_table(models["random_forest"], df, label_out="B", conf_out="CB", prob_prefix=None)
    return df.select(*KEY, (F.col("A") == F.col("B")).alias("same_label"),
                     (F.abs(F.col("CA") - F.col("CB")) < 1e-12).alias("same_confidence"),
                     F.lit(found == run).alias("newest"), F.lit(kept == metrics.collect()).alias("same_metrics"))


@register("batch_score_counts", O.with_wells("select WELL, count(*) as rows, count(*) as scored from wells group by WELL"))
def batch_score_counts(spark, sf_dir):
    """Rows and scored rows per well of the files that a batch run wrote."""
    rows = model_roundtrip_batch_score(spark, sf_dir)
    return rows.groupBy("WELL").agg(F.count("*").alias("rows"), F.count("Predicted_Lithology").alias("scored"))


@register("complete_training_run")
def complete_training_run(spark, sf_dir):
    """The whole training flow (plans.training_run): profile, annotate,
    bake-off, stratified split, grid searches for both learners with
    fallbacks, evaluation, best pick, enhanced table.  Both searches run on
    their large grids with their folds, on a stratified sample of 20,000
    training rows, the size of the published training run."""
    from ..config import LogConfig
    from .training_run import RunOptions, run
    opts = RunOptions(grids="large", key=KEY, max_samples=20_000)
    res = run(spark, wells(spark, sf_dir), LogConfig(target="LITH", key=KEY), opts)
    return round_doubles(res.metrics.withColumn("is_best", F.col("model") == F.lit(res.best_model))
                         .withColumn("imputation", F.lit(res.imputation)))
