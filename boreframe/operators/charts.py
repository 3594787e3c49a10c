"""Chart-feeding aggregates (V1-V7): the numbers behind every plot, not drawing.

Raw scatter points do not scale, so crossplots and histograms are binned
counts; box statistics use the exact distributed quantiles per label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import stack_columns
from ..functions.quantiles import exact_quantiles


def top_labels(df: DataFrame, label: str, n: int = 8) -> list:
    """Most frequent labels (count desc, label asc); a bounded top-n."""
    rows = (df.where(F.col(label).isNotNull()).groupBy(label).count()
            .orderBy(F.desc("count"), F.asc(label)).limit(n).collect())
    return [r[label] for r in rows]


def _bin(x, lo: float, hi: float, bins: int):
    if lo is None or hi is None:
        return F.lit(None).cast("int")
    if hi == lo:
        return F.lit(0)
    return F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)), F.lit(bins - 1)).cast("int")


def curve_histogram(df: DataFrame, label: str, curves, bins: int = 30, top_n: int = 8) -> DataFrame:
    """V1: per (curve, label) equal-width bin counts over the top labels.

    Bin edges come from the global min/max of each curve over those labels;
    nulls are dropped.  Output: curve, label, bin, bin_lo, bin_hi, count.
    """
    labs = top_labels(df, label, top_n)
    sub = df.where(F.col(label).isin(labs))
    mm = sub.agg(*[F.min(c).alias(f"lo_{c}") for c in curves], *[F.max(c).alias(f"hi_{c}") for c in curves]).first()
    long = stack_columns(sub, [label], curves, "curve", "value").where(F.col("value").isNotNull())
    bexpr = None
    for c in curves:
        e = _bin(F.col("value"), mm[f"lo_{c}"], mm[f"hi_{c}"], bins)
        bexpr = F.when(F.col("curve") == c, e) if bexpr is None else bexpr.when(F.col("curve") == c, e)
    width = None
    lo_e = None
    for c in curves:
        lo, hi = mm[f"lo_{c}"], mm[f"hi_{c}"]
        w = (hi - lo) / bins if lo is not None else None
        width = F.when(F.col("curve") == c, F.lit(w)) if width is None else width.when(F.col("curve") == c, F.lit(w))
        lo_e = F.when(F.col("curve") == c, F.lit(lo)) if lo_e is None else lo_e.when(F.col("curve") == c, F.lit(lo))
    counted = long.groupBy("curve", F.col(label).alias("label"), bexpr.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    return counted.select("curve", "label", "bin",
                          (lo_e + F.col("bin") * width).alias("bin_lo"),
                          (lo_e + (F.col("bin") + 1) * width).alias("bin_hi"), "count")


def box_stats(df: DataFrame, label: str, curves, **qkw) -> DataFrame:
    """V2/V7: per (label, curve) min, quartiles, max and Tukey whiskers.

    Quartiles are exact (distributed, per label); whiskers are the extreme
    values inside the 1.5*IQR fences (one more grouped aggregate).
    """
    q = exact_quantiles(df.where(F.col(label).isNotNull()), curves, [0.25, 0.5, 0.75],
                        group_col=label, **qkw)
    stacked = stack_columns(df.where(F.col(label).isNotNull()), [label], curves, "curve", "value")
    stacked = stacked.where(F.col("value").isNotNull())
    # per (label, curve) fence literals through a small literal map
    keys, lo_v, hi_v, q1_v, q2_v, q3_v = [], [], [], [], [], []
    for (g, c), (a, b, d) in q.items():
        if a is None:
            continue
        k = f"{g}\u0001{c}"
        keys.append(k)
        iqr = d - a
        lo_v.append(a - 1.5 * iqr)
        hi_v.append(d + 1.5 * iqr)
        q1_v.append(a)
        q2_v.append(b)
        q3_v.append(d)

    def lmap(vals):
        items = []
        for k, v in zip(keys, vals):
            items += [F.lit(k), F.lit(float(v))]
        return F.create_map(*items)

    kcol = F.concat(F.col(label).cast("string"), F.lit("\u0001"), F.col("curve"))
    lo_f = F.try_element_at(lmap(lo_v), kcol)
    hi_f = F.try_element_at(lmap(hi_v), kcol)
    agg = stacked.groupBy(F.col(label).alias("label"), "curve").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(F.when(F.col("value") >= lo_f, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(F.col("value") <= hi_f, F.col("value"))).alias("upper_whisker"))
    k2 = F.concat(F.col("label").cast("string"), F.lit("\u0001"), F.col("curve"))
    return agg.select("label", "curve", "count", "min",
                      F.try_element_at(lmap(q1_v), k2).alias("q1"),
                      F.try_element_at(lmap(q2_v), k2).alias("median"),
                      F.try_element_at(lmap(q3_v), k2).alias("q3"),
                      "max", "lower_whisker", "upper_whisker")


def correlation(df: DataFrame, curves) -> DataFrame:
    """V3: Pearson correlation for every ordered pair (pairwise complete).

    One aggregate over the distinct unordered pairs (incl. the diagonal);
    the matrix is mirrored afterwards.
    """
    idx = {c: i for i, c in enumerate(curves)}
    uniq = [(a, b) for a in curves for b in curves if idx[a] <= idx[b]]
    pos = {p: i for i, p in enumerate(uniq)}
    wide = df.agg(*[F.corr(a, b).alias(f"c{pos[(a, b)]}") for a, b in uniq])
    rows = []
    for a in curves:
        for b in curves:
            k = pos[(a, b)] if idx[a] <= idx[b] else pos[(b, a)]
            rows.append(F.struct(F.lit(a).alias("curve_a"), F.lit(b).alias("curve_b"),
                                 F.col(f"c{k}").alias("corr")))
    return wide.select(F.inline(F.array(*rows)))


CROSSPLOTS = [("RHOB vs NPHI", "RHOB", "NPHI"), ("GR vs RDEP", "GR", "RDEP"),
              ("PEF vs RHOB", "PEF", "RHOB"), ("DTC vs NPHI", "DTC", "NPHI")]


def crossplot_bins(df: DataFrame, label: str, pairs=CROSSPLOTS, bins: int = 30, top_n: int = 8) -> DataFrame:
    """V4: 2-D binned counts per crossplot and top label (rows with both values)."""
    labs = top_labels(df, label, top_n)
    sub = df.where(F.col(label).isin(labs))
    curves = sorted({c for _, x, y in pairs for c in (x, y)})
    mm = sub.agg(*[F.min(c).alias(f"lo_{c}") for c in curves], *[F.max(c).alias(f"hi_{c}") for c in curves]).first()
    parts = []
    for name, x, y in pairs:
        parts.append(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(
            F.lit(name).alias("plot"),
            _bin(F.col(x), mm[f"lo_{x}"], mm[f"hi_{x}"], bins).alias("xbin"),
            _bin(F.col(y), mm[f"lo_{y}"], mm[f"hi_{y}"], bins).alias("ybin"))))
    long = sub.select(F.col(label).alias("label"), F.inline(F.filter(F.array(*parts), lambda s: s.isNotNull())))
    return long.groupBy("plot", "label", "xbin", "ybin").agg(F.count(F.lit(1)).alias("count"))


def label_stats(df: DataFrame, label: str, curves) -> DataFrame:
    """V5: per label the count and each curve's mean and sample std."""
    aggs = [F.count(F.lit(1)).alias("sample_count")]
    for c in curves:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(*aggs)


def value_histogram(df: DataFrame, col: str, bins: int = 30, lo: float | None = None,
                    hi: float | None = None) -> DataFrame:
    """V6: equal-width histogram of one column plus its mean on every row."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.avg(col).alias("m")).first()
    lo = r["lo"] if lo is None else lo
    hi = r["hi"] if hi is None else hi
    b = _bin(F.col(col), lo, hi, bins)
    width = (hi - lo) / bins if lo is not None else None
    return (df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "count",
                    F.lit(r["m"]).cast("double").alias("mean_value")))
