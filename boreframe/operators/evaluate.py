"""Evaluation (E1-E7) from confusion counts.

All metrics derive from one ``groupBy(actual, predicted).count()`` - at most
K^2 rows however large the scored table - so the metric arithmetic runs on a
tiny table and matches SQL exactly.  Classes are the vocabulary given as
``labels``, else the union of actual and predicted labels; zero divisions give
0 (like ``zero_division=0``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return (df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
            .groupBy(F.col(actual).cast("string").alias("actual"),
                     F.col(predicted).cast("string").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("count")))


def _vocabulary(counts: DataFrame, labels) -> DataFrame:  # noqa: ANN001
    """``cls``: the given labels, else those that occur."""
    if labels is not None:
        return counts.sparkSession.createDataFrame([(str(x),) for x in labels], "cls string")
    return counts.select(F.explode(F.array("actual", "predicted")).alias("cls")).distinct()


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels=None) -> DataFrame:  # noqa: ANN001
    """Full K x K grid (zeros included) over the label vocabulary:
    ``labels``, or those that occur.

    The scored table is aggregated once; the grid is built from the K labels
    and joined to the counts in Spark.
    """
    counts = confusion_counts(df, actual, predicted)
    names = _vocabulary(counts, labels)
    grid = (names.agg(F.sort_array(F.collect_list("cls")).alias("all"))  # K labels
            .select(F.explode("all").alias("actual"), "all")
            .select("actual", F.explode("all").alias("predicted")))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def confusion_normalized(df: DataFrame, actual: str, predicted: str, labels=None) -> DataFrame:  # noqa: ANN001
    """Count / row total (NULL when a class was never observed)."""
    cm = confusion_matrix(df, actual, predicted, labels)
    tot = F.sum("count").over(Window.partitionBy("actual"))
    return cm.withColumn("share", F.try_divide(F.col("count").cast("double"), tot.cast("double")))


def _per_class(df: DataFrame, actual: str, predicted: str, labels) -> DataFrame:  # noqa: ANN001
    """One row: ``k``, the sorted structs (class, precision, recall, f1_score,
    support, tp) of all classes."""
    return _class_structs(confusion_counts(df, actual, predicted), labels, [])


def _class_structs(counts: DataFrame, labels, by: list) -> DataFrame:  # noqa: ANN001
    """``k`` of the confusion counts, one row for each group of the columns ``by``."""
    zero = F.lit(0).cast("long")
    n = F.col("count")
    parts = counts.select(*by, F.inline(F.array(
        F.struct(F.col("actual").alias("cls"), F.when(F.col("actual") == F.col("predicted"), n).otherwise(zero).alias("tp"),
                 n.alias("support"), zero.alias("npred")),
        F.struct(F.col("predicted").alias("cls"), zero.alias("tp"), zero.alias("support"), n.alias("npred")))))
    if labels is not None:
        names = counts.select(*by).distinct().withColumn("cls", F.explode(F.array(*map(F.lit, labels)))) if by \
            else _vocabulary(counts, labels)
        parts = parts.unionByName(names.select(
            *by, "cls", zero.alias("tp"), zero.alias("support"), zero.alias("npred")))
    sums = parts.groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "npred")])

    def ratio(a, b):  # noqa: ANN001, ANN202
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    m = sums.select(*by, "cls", ratio(F.col("tp"), F.col("npred")).alias("precision"),
                    ratio(F.col("tp"), F.col("support")).alias("recall"), "support", "tp")
    m = m.withColumn("f1_score", F.coalesce(F.try_divide(
        2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return m.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(
        F.col("cls").alias("class"), "precision", "recall", "f1_score", "support", "tp"))).alias("k"))


def _totals() -> dict:
    """Accuracy, macro and weighted averages from the class structs ``k``."""
    def total(of):  # noqa: ANN001, ANN202
        return F.aggregate("k", F.lit(0.0), lambda a, x: a + of(x).cast("double"))

    n = total(lambda x: x["support"])
    out = {"support": n.cast("long"), "accuracy": F.try_divide(total(lambda x: x["tp"]), n)}
    for c in ("precision", "recall", "f1_score"):
        out[f"macro_{c}"] = F.try_divide(total(_field(c)), F.size("k").cast("double"))
        out[f"weighted_{c}"] = F.try_divide(total(_weighted(c)), n)
    return out


def _field(c: str):  # noqa: ANN202
    return lambda x: x[c]


def _weighted(c: str):  # noqa: ANN202
    return lambda x: x[c] * x["support"]


def class_report(df: DataFrame, actual: str, predicted: str, labels=None) -> DataFrame:  # noqa: ANN001
    """Per class precision/recall/F1/support, then accuracy, macro and
    weighted rows.  Classes are ``labels`` (all K of a model, also those that
    do not occur) or, without it, those that occur."""
    t = _totals()

    def row(name, p, r, f):  # noqa: ANN001, ANN202
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
                        t["support"].alias("support"))
    per = F.transform("k", lambda x: F.struct(
        x["class"].alias("class"), x["precision"].alias("precision"), x["recall"].alias("recall"),
        x["f1_score"].alias("f1_score"), x["support"].alias("support")))
    extra = F.array(row("accuracy", t["accuracy"], t["accuracy"], t["accuracy"]),
                    *[row(f"{a} avg", *[t[f"{a}_{c}"] for c in ("precision", "recall", "f1_score")])
                      for a in ("macro", "weighted")])
    return _per_class(df, actual, predicted, labels).select(F.inline(F.concat(per, extra)))


def weighted_metrics(df: DataFrame, actual: str, predicted: str, model: str = "model", labels=None) -> DataFrame:  # noqa: ANN001
    """One row: model, accuracy, weighted precision, recall, F1."""
    t = _totals()
    return _per_class(df, actual, predicted, labels).select(
        F.lit(model).alias("model"), t["accuracy"].alias("accuracy"),
        *[t[f"weighted_{c}"].alias(c) for c in ("precision", "recall", "f1_score")])


def compare_models(df: DataFrame, actual: str, predictions: dict[str, str], labels=None) -> DataFrame:  # noqa: ANN001
    """E1/E6 for many models in one scan: ``predictions`` maps a model's name to
    the column with its predictions.  One row per model, in that order:
    ``model, accuracy, precision, recall, f1_score, model_order``."""
    models = [F.struct(F.lit(i).alias("model_order"), F.lit(name).alias("model"), F.col(c).cast("string").alias("predicted"))
              for i, (name, c) in enumerate(predictions.items())]
    counts = (df.where(F.col(actual).isNotNull())
              .select(F.col(actual).cast("string").alias("actual"), F.inline(F.array(*models)))
              .where(F.col("predicted").isNotNull())
              .groupBy("model_order", "model", "actual", "predicted").agg(F.count(F.lit(1)).alias("count")))
    t = _totals()
    return (_class_structs(counts, labels, ["model_order", "model"])
            .select("model", t["accuracy"].alias("accuracy"), *[t[f"weighted_{c}"].alias(c) for c in ("precision", "recall", "f1_score")],
                    "model_order").orderBy("model_order"))


def best_model(metrics: DataFrame, by: str = "f1_score", order_col: str | None = "model_order") -> DataFrame:
    """The best row by a metric; ties -> the first listed model."""
    keys = [F.desc(by)] + ([F.asc(order_col)] if order_col and order_col in metrics.columns else [])
    return metrics.orderBy(*keys).limit(1)


def pick_by_accuracy(metrics: DataFrame, preferred: str = "random_forest") -> DataFrame:
    """The better of the models by accuracy; ties go to ``preferred``."""
    pref = F.when(F.col("model") == F.lit(preferred), F.lit(0)).otherwise(F.lit(1))
    return metrics.orderBy(F.desc("accuracy"), pref.asc(), F.asc("model")).limit(1)


def model_comparison(metric_rows) -> DataFrame:
    """Union of E1 rows from several models (titled model names)."""
    out = None
    for i, m in enumerate(metric_rows):
        m = m.withColumn("model", F.initcap(F.regexp_replace("model", "_", " "))).withColumn("model_order", F.lit(i))
        out = m if out is None else out.unionByName(m)
    return out
