"""Quality classifier: a sparse rule ensemble over text statistics.

1. A text becomes a struct of statistics (ratios and counts) by built-in
   functions.
2. A forest of shallow trees is fitted on a bounded sample of the labelled
   training rows.  Every path from a root to a node is a conjunctive rule.
3. A lasso logistic regression over the rules' truth values keeps few of them.
4. The rules that are left, with their weights, compile into one Spark column
   expression, so scoring all documents is one projection, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreframe.llm.common import cut, fresh, let, words_of

_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: a rule: ((statistic, is below or equal, threshold), ...)
Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> Column:
    """Struct of the statistics of a text (null: as empty)."""
    t = F.coalesce(text, F.lit(""))
    rest = F.translate(t, _LOWER + " ", "")  # what the shares below count is in the few characters left

    def of(w: Column, r: Column) -> Column:
        n_chars = F.greatest(F.length(t), F.lit(1))
        n = F.greatest(F.size(w), F.lit(1))

        def share(chars: str) -> Column:
            return (F.length(r) - F.length(F.translate(r, chars, ""))) / n_chars

        return F.struct(
            F.log1p(F.size(w)).alias("log_words"),
            (F.length(F.array_join(w, "")) / n).alias("word_length"),
            share("#*$%&|<>").alias("symbols"),
            share("!").alias("exclaims"),
            share(_LOWER.upper()).alias("upper"),
            share("0123456789").alias("digits"),
            share(".").alias("stops"),
            share(",;:").alias("commas"),
            share("\n").alias("breaks"),
            (F.size(F.array_distinct(w)) / n).alias("distinct_words"),
            (F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))) / n).alias("echoes"),
            (F.size(F.filter(w, lambda x, i: x == F.get(w, i - 2))) / n).alias("echoes2"),
            let(F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))),
                lambda s: F.size(F.array_distinct(s)) / F.greatest(F.size(s), F.lit(1))).alias("distinct_lines"),
        )

    return let(F.struct(words_of(text).alias("w"), rest.alias("r")), lambda x: of(x["w"], x["r"]))


def tree_rules(tree) -> list[Rule]:  # noqa: ANN001
    """The conditions on the way to every node of a fitted tree."""
    out: list[Rule] = []
    names = STATISTICS

    def walk(node, path: Rule) -> None:  # noqa: ANN001
        if path:
            out.append(tuple(sorted(set(path))))  # the same conditions in any order are one rule
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, at = names[split.featureIndex()], split.threshold()
            walk(node.leftChild(), (*path, (name, True, at)))
            walk(node.rightChild(), (*path, (name, False, at)))

    walk(tree._call_java("rootNode"), ())
    return out


STATISTICS = ["log_words", "word_length", "symbols", "exclaims", "upper", "digits", "stops", "commas",
              "breaks", "distinct_words", "echoes", "echoes2", "distinct_lines"]


def holds(rule: Rule, stats: str) -> Column:
    out = F.lit(True)
    for name, below, at in rule:
        c = F.col(f"{stats}.{name}")
        out = out & ((c <= at) if below else (c > at))
    return out


def fit_rules(rows: DataFrame, stats: str, label: str, trees: int = 30, depth: int = 3,
              lasso: float = 0.0005, seed: int = 17) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules, from rows with ``stats`` and a 0/1 label.

    Without rows, or with rows of one class only, no rules are learnt and the
    intercept is the smoothed log odds.
    """
    counts = {int(r[0]): r[1] for r in rows.groupBy(label).count().collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    if not ones or not zeros:
        return math.log((ones + 1) / (zeros + 1)), []
    vector = array_to_vector(F.array(*[F.col(f"{stats}.{n}").cast("double") for n in STATISTICS]))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol=label, numTrees=trees, maxDepth=depth, subsamplingRate=0.7,
        featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=seed,
    ).fit(rows.select(vector.alias("x"), F.col(label).cast("double").alias(label)))
    rules = sorted({r for t in forest.trees for r in tree_rules(t)})
    if not rules:
        return math.log((ones + 1) / (zeros + 1)), []
    # rows on which the same rules hold are one weighted row: a few hundred in all
    truth = F.array(*[holds(r, stats).cast("double") for r in rules])
    cases = (rows.select(truth.alias("truth"), F.col(label).cast("double").alias(label))
             .groupBy("truth", label).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    model = LogisticRegression(featuresCol="x", labelCol=label, weightCol="weight", elasticNetParam=1.0,
                               regParam=lasso, maxIter=60, tol=1e-5).fit(
        cut(cases.select(array_to_vector("truth").alias("x"), label, "weight").coalesce(1)))
    weights = model.coefficients.toArray()
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w]


def compile_rules(intercept: float, rules: list[tuple[Rule, float]], stats: str) -> Column:
    """The ensemble's probability as one column expression."""
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(holds(rule, stats), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def is_held_out(doc_id: Column, folds: int = 4, held_fold: int = 2) -> Column:
    """crc32(id as text) mod ``folds`` is ``held_fold`` (null id: empty text)."""
    key = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(key), F.lit(folds)) == held_fold


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", sample_rows: int = 40_000) -> tuple[float, list[tuple[Rule, float]]]:
    """Rules learnt from at most about ``sample_rows`` labelled rows that are
    not held out (a share by hash of the id, so the same rows whatever the
    layout).  Several labels of one id: their mean, rounded; null labels and
    ids are ignored."""
    marks = (labels.select(F.col(id_col).alias("l_id"), F.col(label_col).alias("l")).where("l is not null")
             .groupBy("l_id").agg(F.round(F.avg("l")).cast("int").alias("label"))
             .where(F.col("l_id").isNotNull() & ~is_held_out(F.col("l_id"))))
    share = min(1.0, sample_rows / max(1, marks.count()))
    sample = marks.where(F.pmod(F.xxhash64("l_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(sample), F.col("id") == F.col("l_id"))  # about sample_rows rows
            .select(statistics(F.col("text")).alias("stats"), "label"))
    return fit_rules(cut(rows), "stats", "label")


def quality_score(docs: DataFrame, text_col: str, intercept: float, rules: list[tuple[Rule, float]],
                  score_col: str = "__score") -> DataFrame:
    """``docs`` with the column ``score_col``; the text is read once."""
    stats, = fresh(docs, "__stats")
    return (docs.withColumn(stats, statistics(F.col(text_col)))
            .withColumn(score_col, compile_rules(intercept, rules, stats)).drop(stats))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", threshold: float = 0.7, sample_rows: int = 40_000) -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted``.

    Null or empty text: statistics of the empty text.  Null ids are scored and
    never labelled.  Repeated rows: scored alike.  No usable labels: every
    score is the smoothed share of label 1.  Empty table: no rows.
    """
    intercept, rules = fit_quality(docs, labels, id_col, text_col, label_col, sample_rows)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (quality_score(d, "text", intercept, rules)
            .select(F.col("id").alias(id_col), is_held_out(F.col("id")).alias("held_out"),
                    F.col("__score").alias("score"),
                    (F.col("__score") >= threshold).cast("int").alias("predicted")))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality", threshold: float = 0.7, sample_rows: int = 40_000) -> DataFrame:
    """``docs`` without the rows that score below ``threshold`` (all rows if
    the labels teach no rule); columns unchanged."""
    intercept, rules = fit_quality(docs, labels, id_col, text_col, label_col, sample_rows)
    if not rules:
        return docs
    score, = fresh(docs, "__score")
    return quality_score(docs, text_col, intercept, rules, score).where(F.col(score) >= threshold).drop(score)
