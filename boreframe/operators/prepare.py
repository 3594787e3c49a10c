"""Imputation, scaling, label encoding, stratified split/folds/sampling.

Stratified selection never uses a window partitioned by label (that puts a
whole class - possibly a third of the table - into one task).  Each row gets a
deterministic 52-bit hash ``u`` of its key; the wanted per-class rank cut is
found with the distributed rank selection of ``functions.quantiles`` and
applied as a literal per-class threshold.  Rows of one key at a cut are split
by a second hash, of the whole row.  Per-class counts are exact, no row is
shuffled, and the result is repeatable after executor loss (the hashes are pure
functions).  Rows that are equal in every column cannot be told apart: if they
straddle a cut, all of them fall below it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import quantile_map, rank_values

def order_key(cols, seed: int = 42) -> Column:
    """Deterministic pseudo-random double in [0, 2^52) from the row key: the
    first 13 hex digits of the MD5 of the seed and the key, joined by ``|``."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")


def order_key_sql(cols, seed: int = 42) -> str:
    """``order_key`` as DuckDB SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(cols)})), 1, 13))::bigint)::double"


def class_counts(df: DataFrame, label: str, max_classes: int = 10_000) -> dict:
    """Rows per class (partial aggregation; K rows reach the driver, K checked)."""
    rows = df.where(F.col(label).isNotNull()).groupBy(label).count().limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes in {label}")
    return {r[label]: r["count"] for r in rows}


def _lit_map(d: dict, vtype: str) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v).cast(vtype)]
    return F.create_map(*items) if items else F.create_map().cast(f"map<string,{vtype}>")


#: columns of ``with_order``
ORDER_U, ORDER_U2 = "__order_u", "__order_u2"


def with_order(df: DataFrame, key_cols, seed: int = 42) -> DataFrame:
    """``df`` with both hashes by which rows are chosen, so that a table that is
    kept need not carry the columns they are made of (``kept=True`` below)."""
    return df.withColumns({ORDER_U: order_key(key_cols, seed), ORDER_U2: row_key(df, seed)})


def rank_cuts(df: DataFrame, label: str, key_cols, cuts, seed: int = 42,
              collect_limit: int = 50_000, kept: bool = False) -> dict:
    """For each (class, r): a predicate 'row is among the r lowest-hash rows'.

    ``cuts`` maps class -> list of r, or is a function ``counts -> mapping``
    (the class counts come from the selection's own first pass).
    Returns ``{(class, r): (v, w)}``: rank < r  <=>  u < v or (u == v and u2 <= w).
    The second hash is only consulted (one more small job) when rows tied
    at ``v`` straddle the cut.
    """
    d = df.where(F.col(label).isNotNull()).withColumn("__u", F.col(ORDER_U) if kept else order_key(key_cols, seed))
    state = {}

    def want(counts):
        c = cuts(counts) if callable(cuts) else cuts
        state["cuts"] = c
        return {g: [r - 1 for r in rs if r > 0] for g, rs in c.items()}

    rv = rank_values(d, "__u", want, group_col=label, collect_limit=collect_limit)
    out, split_ties = {}, {}
    for (g, r1), (v, less, equal) in rv.items():
        need = r1 + 1 - less
        if need >= equal:
            out[(g, r1 + 1)] = (v, float("inf"))
        else:
            split_ties[(g, r1 + 1)] = (v, need)
    if split_ties:
        names = {(g, v): str(i) for i, (g, v) in enumerate({(g, v): 0 for (g, _r), (v, _n) in split_ties.items()})}
        at = F.lit(None).cast("string")
        for (g, v), name in names.items():
            at = F.when((F.col(label) == F.lit(g)) & (F.col("__u") == F.lit(v)), name).otherwise(at)
        tied = d.select(at.alias("__at"), (F.col(ORDER_U2) if kept else row_key(df, seed)).alias("__u2")).where("__at is not null")
        want2 = {}
        for (g, _r), (v, need) in split_ties.items():
            want2.setdefault(names[(g, v)], []).append(need - 1)
        rv2 = rank_values(tied, "__u2", want2, group_col="__at", collect_limit=collect_limit)
        for (g, r), (v, need) in split_ties.items():
            out[(g, r)] = (v, rv2[(names[(g, v)], need - 1)][0])
    return out, state.get("cuts", {})


def _with_hashes(df: DataFrame, key_cols, seed: int, cuts: dict, kept: bool = False) -> DataFrame:
    """The order hash as a column, and the row hash where a cut needs it."""
    out = {"__u": F.col(ORDER_U) if kept else order_key(key_cols, seed)}
    if _ties(cuts):
        out["__u2"] = F.col(ORDER_U2) if kept else row_key(df, seed)
    return df.withColumns(out)


def _ties(cuts: dict) -> bool:
    return any(w != float("inf") for _v, w in cuts.values())


def row_key(df: DataFrame, seed: int) -> Column:
    """Hash of a whole row, which orders rows of one key."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]).bitwiseAND(
        F.lit((1 << 52) - 1)).cast("double")


def _lt_expr(label: str, cuts: dict) -> Column:
    """Boolean column 'rank within class < r' for one r per class (needs ``_with_hashes``)."""
    vmap = _lit_map({g: v for g, (v, _w) in cuts.items()}, "double")
    u, v = F.col("__u"), F.try_element_at(vmap, F.col(label))
    if not _ties(cuts):
        return F.coalesce(u <= v, F.lit(False))
    w = F.try_element_at(_lit_map({g: w for g, (_v, w) in cuts.items()}, "double"), F.col(label))
    return F.coalesce((u < v) | ((u == v) & (F.col("__u2") <= w)), F.lit(False))


def _round_half_up(x: float) -> int:
    return int(math.floor(x + 0.5))


def stratified_split(df: DataFrame, label: str, key_cols, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Add boolean ``is_test``; per class exactly round(fraction*n_c) test rows."""
    cuts, asked = rank_cuts(df, label, key_cols, lambda counts: {
        g: [_round_half_up(test_fraction * n)] for g, n in counts.items()}, seed)
    per = {g: cuts[(g, rs[0])] for g, rs in asked.items() if rs[0] > 0}
    expr = _lt_expr(label, per) if per else F.lit(False)
    out = _with_hashes(df.where(F.col(label).isNotNull()), key_cols, seed, cuts)
    return out.withColumn("is_test", expr).drop("__u", "__u2")


def stratified_folds(df: DataFrame, label: str, key_cols, k: int = 5, seed: int = 42, kept: bool = False) -> DataFrame:
    """Integer ``fold`` in [0, k); class c's rows split into k rank blocks.

    Block j holds ranks [round(n_c*j/k), round(n_c*(j+1)/k)), so every class
    is spread evenly over the folds (usable as CrossValidator ``foldCol``).
    ``kept``: the hashes are columns of ``df`` (``with_order``).
    """
    cuts, bounds = rank_cuts(df, label, key_cols, lambda counts: {
        g: [_round_half_up(n * j / k) for j in range(1, k)] for g, n in counts.items()}, seed, kept=kept)
    fold = F.lit(0)
    for j in range(k - 1):
        per = {g: cuts[(g, bs[j])] for g, bs in bounds.items() if bs[j] > 0}
        below = _lt_expr(label, per) if per else F.lit(False)
        # rows not below cut j are at least in fold j+1
        fold = fold + F.when(~below, F.lit(1)).otherwise(F.lit(0))
    out = _with_hashes(df.where(F.col(label).isNotNull()), key_cols, seed, cuts, kept)
    return out.withColumn("fold", fold.cast("int")).drop("__u", "__u2")


def stratified_sample(df: DataFrame, label: str, key_cols, max_samples: int = 100_000,
                      seed: int = 42) -> DataFrame:
    """Per class min(n_c, max(1, floor(max_samples*n_c/N))) rows.

    Rows without a label drop out (as in a group-by); a table of at most
    ``max_samples`` rows is returned unchanged.
    """
    counts = class_counts(df, label)
    total = df.count()
    if max_samples >= total:
        return df
    quotas = {g: min(n, max(1, int(math.floor(max_samples * n / total)))) for g, n in counts.items()}
    cuts, _ = rank_cuts(df, label, key_cols, {g: [q] for g, q in quotas.items()}, seed)
    per = {g: cuts[(g, q)] for g, q in quotas.items()}
    out = _with_hashes(df.where(F.col(label).isNotNull()), key_cols, seed, cuts)
    return out.where(_lt_expr(label, per)).drop("__u", "__u2")


def sample_rows(df: DataFrame, key_cols, n: int = 2000, seed: int = 42) -> DataFrame:
    """A deterministic inspection sample (top-n by key hash; TakeOrdered)."""
    return df.orderBy(order_key(key_cols, seed), *key_cols).limit(n)


# ---------------------------------------------------------------------------
# P17 type narrowing plan
# ---------------------------------------------------------------------------

_INT_RANGES = [("tinyint", -128, 127), ("smallint", -32768, 32767),
               ("int", -2147483648, 2147483647), ("bigint", -(1 << 63), (1 << 63) - 1)]


def narrowing_plan(df: DataFrame, lossy_floats: bool = False) -> DataFrame:
    """Smallest type per numeric column from one min/max aggregate."""
    num = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    aggs = []
    for i, f in enumerate(num):
        aggs += [F.min(f.name).cast("double").alias(f"lo{i}"), F.max(f.name).cast("double").alias(f"hi{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, f in enumerate(num):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        if isinstance(f.dataType, T.IntegralType):
            tgt = None
            for name, a, b in _INT_RANGES:
                cond = (lo >= F.lit(a)) & (hi <= F.lit(b))
                tgt = F.when(cond, F.lit(name)) if tgt is None else tgt.when(cond, F.lit(name))
        else:
            tgt = F.lit("float" if lossy_floats else "double")
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("current_type"),
                             lo.alias("min_value"), hi.alias("max_value"), tgt.alias("narrow_type")))
    return wide.select(F.inline(F.array(*rows)))


def apply_narrowing(df: DataFrame, plan_rows) -> DataFrame:
    m = {r["column"]: r["narrow_type"] for r in plan_rows}
    return df.withColumns({c: F.col(c).cast(t) for c, t in m.items() if t})


# ---------------------------------------------------------------------------
# I1/I2/I7 imputation and scaling (fitted statistics are plain floats)
# ---------------------------------------------------------------------------

def fit_median(df: DataFrame, features, **qkw) -> dict:
    return {f: v[0] for f, v in quantile_map(df, features, [0.5], **qkw).items()}


def fit_mean(df: DataFrame, features) -> dict:
    r = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    return {f: r[f] for f in features}


def impute_exprs(fills: dict) -> dict:
    return {f: F.coalesce(F.col(f), F.lit(v).cast("double")) if v is not None else F.col(f)
            for f, v in fills.items()}


def impute(df: DataFrame, fills: dict) -> DataFrame:
    """Replace NULL curve values by the fitted statistic (median/mean)."""
    return df.withColumns(impute_exprs(fills))


def fit_scaler(df: DataFrame, features, fills: dict | None = None) -> dict:
    """Mean and population std of the (imputed) curves; std 0 -> 1."""
    src = impute(df, fills) if fills else df
    r = src.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    out = {}
    for f in features:
        s = r[f"s_{f}"]
        out[f] = (r[f"m_{f}"], s if s else 1.0)
    return out


def scaled_exprs(features, fills: dict, scaler: dict) -> dict:
    imp = impute_exprs(fills)
    return {f: (imp[f] - F.lit(scaler[f][0])) / F.lit(scaler[f][1]) for f in features}


# ---------------------------------------------------------------------------
# I8-I11 label encoding
# ---------------------------------------------------------------------------

def label_index(df: DataFrame, label: str) -> DataFrame:
    """Label, 0-based index (code-point ascending), class count.

    The aggregate is K rows; the ordering window runs over those K rows only.
    """
    from pyspark.sql import Window
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("count"))
    return counts.withColumn("index", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


def decode_index(idx: Column, labels, unknown_prefix: str = "Unknown_Class_") -> Column:
    """Index -> name; out-of-range, negative too -> ``Unknown_Class_<i>``; null -> null."""
    arr = F.array(*[F.lit(x) for x in labels])
    i = idx.cast("int")
    return F.coalesce(F.get(arr, i), F.concat(F.lit(unknown_prefix), i.cast("string")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (K * n_c) per class."""
    from pyspark.sql import Window
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(F.lit(1))
    return counts.withColumn(
        "weight", F.sum("count").over(w).cast("double") / (F.count(F.lit(1)).over(w) * F.col("count")))


def with_weight_column(df: DataFrame, label: str, weights: dict, out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.try_element_at(_lit_map(weights, "double"), F.col(label)),
                                         F.lit(1.0)))
