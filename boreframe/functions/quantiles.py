"""Exact, linear-interpolated quantiles that scale past one task.

Spark's ``percentile`` is exact but merges a value->count map of the whole
group in a single task; ``percentile_approx`` scales but returns an existing
element (not the interpolated value pandas/DuckDB report).  We need the exact
interpolated answer (``(n-1)*p`` position, linear between neighbours) for
IQR fences, medians and box statistics, and we need it on tables where one
curve holds 10^11 distinct doubles.

Strategy (all aggregates are partial/map-side combined, nothing whole goes
through one task or the driver):

1. one aggregate per (group, column): ``count``, ``min``, ``max``;
2. if a histogram is small enough (``count <= small_n``) we use the built-in
   exact ``percentile`` for it (bounded by ``small_n`` per task);
3. otherwise iterative refinement: each pass buckets the values inside the
   current bracket into ``buckets`` equal-width bins (one ``groupBy(hist,
   bin)`` aggregate of <= hists*buckets rows), keeps the bin that holds the
   wanted rank, and narrows the bracket to that bin's [min, max];
4. once a bracket holds at most ``collect_limit`` values (a proven bound) its
   values are fetched and the rank is read exactly; a bracket whose min equals
   its max is resolved without fetching.

Bin index is monotone in the value, so a bin is exactly the set of values in
its [min, max]; the running "values below the bracket" count therefore stays
exact.  Ties (a third of the rows on one value) end in a single-value bracket.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ALL = "__all__"


def _positions(n: int, p: float):
    """0-based ranks and weight for linear interpolation at probability p."""
    h = (n - 1) * p
    lo = math.floor(h)
    frac = h - lo
    hi = min(lo + 1, n - 1)
    return lo, hi, frac


def _interp(lo_v: float, hi_v: float, frac: float) -> float:
    if frac == 0 or lo_v == hi_v:
        return float(lo_v)
    return float(lo_v + (hi_v - lo_v) * frac)


def exact_quantiles(df: DataFrame, cols, probs, group_col: str | None = None,
                    small_n: int = 2_000_000, buckets: int = 4096,
                    collect_limit: int = 50_000, max_groups: int = 10_000,
                    max_passes: int = 64, small_bytes: int = 64 << 20, seed_accuracy: int = 10_000):
    """Exact linear quantiles of ``cols`` (nulls ignored), optionally per group.

    Returns ``{(group, col): [q(p) for p in probs]}``; ``group`` is ``"__all__"``
    without ``group_col``.  Empty columns give ``None`` values.
    """
    cols = list(cols)
    probs = [float(p) for p in probs]
    gexpr = F.col(group_col) if group_col else F.lit(_ALL)
    base = df.select(gexpr.alias("__g"), *[F.col(c).cast("double").alias(c) for c in cols])

    # ---- fast path: the optimizer's size estimate says the input is small,
    # so the built-in exact percentile (one aggregate, one job) is safe.
    est = estimated_bytes(df)
    if est is not None and est <= small_bytes:
        res, max_n = _builtin(base, cols, probs, max_groups)
        if max_n <= small_n:
            return res
        # misestimate (e.g. an exploding join): fall through to refinement

    # ---- pass 0: count/min/max per (group, col), plus sketch seeds -------
    # percentile_approx at p -/+ delta brackets the exact p-quantile (rank
    # error <= n/accuracy), so refinement starts inside a narrow bracket and
    # needs one histogram pass fewer over the data.
    seed_q = []
    if seed_accuracy:
        delta = 3.0 / seed_accuracy + 1e-6
        for p in probs:
            seed_q += [max(0.0, p - delta), min(1.0, p + delta)]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(F.col(c)).alias(f"n{i}"), F.min(F.col(c)).alias(f"lo{i}"),
                 F.max(F.col(c)).alias(f"hi{i}")]
        if seed_accuracy:
            aggs.append(F.percentile_approx(F.col(c), seed_q, seed_accuracy).alias(f"s{i}"))
    stats_rows = base.groupBy("__g").agg(*aggs).limit(max_groups + 1).collect()
    if len(stats_rows) > max_groups:
        raise ValueError(f"more than {max_groups} groups for quantiles")

    out = {}
    # hist key -> state
    todo = []  # (g, col, n, lo, hi)
    small = []  # (g, col, n)
    for r in stats_rows:
        g = r["__g"]
        for i, c in enumerate(cols):
            n = r[f"n{i}"]
            if not n:
                out[(g, c)] = [None] * len(probs)
                continue
            lo, hi = float(r[f"lo{i}"]), float(r[f"hi{i}"])
            if lo == hi:
                out[(g, c)] = [lo] * len(probs)
            elif n <= small_n:
                small.append((g, c, n))
            else:
                seeds = None
                if seed_accuracy and r[f"s{i}"] is not None:
                    sv = [float(x) for x in r[f"s{i}"]]
                    seeds = [(sv[2 * k], sv[2 * k + 1]) for k in range(len(probs))]
                todo.append((g, c, n, lo, hi, seeds))

    # ---- small histograms: built-in exact percentile, one aggregate -----
    if small:
        by_group = defaultdict(list)
        for g, c, n in small:
            by_group[g].append(c)
        small_cols = sorted({c for _, c, _ in small}, key=cols.index)
        pexprs = [F.percentile(F.col(c), F.array(*[F.lit(p) for p in probs])).alias(f"q{cols.index(c)}")
                  for c in small_cols]
        groups = list(by_group)
        src = base
        if group_col:
            src = base.where(F.col("__g").isin(groups))
        for r in src.groupBy("__g").agg(*pexprs).collect():
            for c in by_group.get(r["__g"], []):
                out[(r["__g"], c)] = [float(v) for v in r[f"q{cols.index(c)}"]]

    if todo:
        out.update(_refine(base, todo, probs, buckets, collect_limit, max_passes))
    return out


def estimated_bytes(df: DataFrame):
    """Sum of the optimizer's size estimates of the plan's leaf scans.

    No job runs.  Joins without statistics are estimated as products, which is
    useless here, so we look at what is read instead.  None when unavailable
    (e.g. Spark Connect) - callers then take the scalable path.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        total = 0
        for i in range(leaves.size()):
            total += int(str(leaves.apply(i).stats().sizeInBytes()))
        return total
    except Exception:  # noqa: BLE001
        return None


def _builtin(base: DataFrame, cols, probs, max_groups):
    parr = F.array(*[F.lit(p) for p in probs])
    rows = (base.groupBy("__g").agg(*[F.percentile(F.col(c), parr).alias(f"q{i}") for i, c in enumerate(cols)],
                                    F.count(F.lit(1)).alias("__n"))
            .limit(max_groups + 1).collect())
    if len(rows) > max_groups:
        raise ValueError(f"more than {max_groups} groups for quantiles")
    out = {}
    for r in rows:
        for i, c in enumerate(cols):
            v = r[f"q{i}"]
            out[(r["__g"], c)] = [float(x) for x in v] if v is not None else [None] * len(probs)
    return out, max([r["__n"] for r in rows], default=0)


def _refine(base: DataFrame, todo, probs, buckets, collect_limit, max_passes, ranks=None,
            want_ranks=False):
    # Each target is one rank of one (group, col).  State: bracket [lo, hi],
    # count n inside it, count below it.
    targets = {}
    result_ranks = {}
    full = {}
    for item in todo:
        g, c, n, lo, hi = item[:5]
        seeds = item[5] if len(item) > 5 else None
        full[(g, c)] = (lo, hi, n)
        if ranks is not None:
            wanted = [(r, None) for r in ranks.get(g, [])]
        else:
            wanted = [(r, k) for k, p in enumerate(probs) for r in _positions(n, p)[:2]]
        for r, k in wanted:
            if seeds is not None and k is not None and seeds[k][0] <= seeds[k][1]:
                # seeded bracket: 'below' and the in-bracket count are learnt
                # in the first histogram pass (values < lo land in bin -1)
                targets[(g, c, r)] = {"lo": seeds[k][0], "hi": seeds[k][1], "n": None, "below": None}
            else:
                targets[(g, c, r)] = {"lo": lo, "hi": hi, "n": n, "below": 0}
        result_ranks[(g, c)] = n

    resolved = {}
    less = {}
    for _ in range(max_passes):
        open_t = {k: s for k, s in targets.items() if k not in resolved}
        if not open_t:
            break
        # group targets by identical bracket -> one histogram
        hists = {}
        for (g, c, r), s in open_t.items():
            hk = (g, c, s["lo"], s["hi"], s["below"] is None)
            hists.setdefault(hk, {"n": s["n"], "below": s["below"], "ranks": []})["ranks"].append(r)
        fetch = {hk: h for hk, h in hists.items() if h["n"] is not None and h["n"] <= collect_limit}
        scan = {hk: h for hk, h in hists.items() if h["n"] is None or h["n"] > collect_limit}
        if fetch:
            vals = _fetch(base, list(fetch))
            for hid, (hk, h) in enumerate(fetch.items()):
                v = sorted(vals.get(hid, []))
                for r in h["ranks"]:
                    val = float(v[r - h["below"]])
                    resolved[(hk[0], hk[1], r)] = val
                    less[(hk[0], hk[1], r)] = (h["below"] + bisect.bisect_left(v, val),
                                               bisect.bisect_right(v, val) - bisect.bisect_left(v, val))
        if scan:
            hist_rows = _histogram(base, list(scan), buckets)
            for hid, (hk, h) in enumerate(scan.items()):
                bins = sorted(hist_rows.get(hid, []))
                start = h["below"]
                if start is None:  # seeded: count below the bracket from bin -1
                    start = sum(cnt for b, cnt, _, _ in bins if b < 0)
                    bins = [t for t in bins if t[0] >= 0]
                inside = sum(cnt for _, cnt, _, _ in bins)
                for r in h["ranks"]:
                    key = (hk[0], hk[1], r)
                    if not (start <= r < start + inside):
                        # the sketch bound did not hold: restart from [min, max]
                        lo, hi, n = full[(hk[0], hk[1])]
                        targets[key] = {"lo": lo, "hi": hi, "n": n, "below": 0}
                        continue
                    below = start
                    for b, cnt, bmin, bmax in bins:
                        if r < below + cnt:
                            break
                        below += cnt
                    if bmin == bmax:
                        resolved[key] = float(bmin)
                        less[key] = (below, cnt)
                    else:
                        targets[key] = {"lo": float(bmin), "hi": float(bmax), "n": cnt, "below": below}
    if any(k not in resolved for k in targets):
        raise RuntimeError("quantile refinement did not converge")

    if want_ranks:
        return resolved, less
    out = {}
    for (g, c), n in result_ranks.items():
        vals = []
        for p in probs:
            r_lo, r_hi, frac = _positions(n, p)
            vals.append(_interp(resolved[(g, c, r_lo)], resolved[(g, c, r_hi)], frac))
        out[(g, c)] = vals
    return out


def _member_structs(hist_keys, with_bin: bool, buckets: int) -> Column:
    elems = []
    for hid, hk in enumerate(hist_keys):
        g, c, lo, hi = hk[:4]
        count_below = len(hk) > 4 and hk[4]
        v = F.col(c)
        cond = (v >= F.lit(lo)) & (v <= F.lit(hi))
        if count_below:
            cond = v <= F.lit(hi)
        if g != _ALL:
            cond = cond & (F.col("__g") == F.lit(g))
        if with_bin:
            width = hi - lo
            if width > 0:
                b = F.least(F.floor((v - F.lit(lo)) / F.lit(width) * F.lit(buckets)),
                            F.lit(buckets - 1)).cast("int")
            else:
                b = F.lit(0)
            if count_below:
                b = F.when(v < F.lit(lo), F.lit(-1)).otherwise(b)
            elems.append(F.when(cond, F.struct(F.lit(hid).alias("h"), b.alias("b"), v.alias("v"))))
        else:
            elems.append(F.when(cond, F.struct(F.lit(hid).alias("h"), F.lit(0).alias("b"), v.alias("v"))))
    return F.filter(F.array(*elems), lambda s: s.isNotNull())


def _histogram(base: DataFrame, hist_keys, buckets):
    rows = (base.select(F.inline(_member_structs(hist_keys, True, buckets)))
            .groupBy("h", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"),
                                   F.max("v").alias("mx"))
            .collect())
    out = defaultdict(list)
    for r in rows:
        out[r["h"]].append((r["b"], r["n"], r["mn"], r["mx"]))
    return out


def _fetch(base: DataFrame, hist_keys):
    rows = base.select(F.inline(_member_structs(hist_keys, False, 1))).select("h", "v").collect()
    out = defaultdict(list)
    for r in rows:
        out[r["h"]].append(r["v"])
    return out


def quantile_map(df: DataFrame, cols, probs, **kw):
    """Ungrouped convenience: ``{col: [q...]}``."""
    res = exact_quantiles(df, cols, probs, **kw)
    return {c: res.get((_ALL, c), [None] * len(probs)) for c in cols}


def rank_values(df: DataFrame, col: str, ranks, group_col: str | None = None,
                buckets: int = 4096, collect_limit: int = 50_000, max_groups: int = 10_000):
    """Value at 0-based rank ``r`` of ``col`` (ascending, nulls ignored) per group.

    ``ranks`` maps group -> list of ranks (``"__all__"`` without ``group_col``),
    or is a function ``counts -> that mapping`` (counts per group come from
    the first pass, so callers need no separate count job).
    Returns ``{(group, r): (value, n_less, n_equal)}``: how many values are
    strictly smaller than / equal to ``value`` (ties can be split exactly).
    """
    gexpr = F.col(group_col) if group_col else F.lit(_ALL)
    base = df.select(gexpr.alias("__g"), F.col(col).cast("double").alias(col))
    stats = (base.groupBy("__g").agg(F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))
             .limit(max_groups + 1).collect())
    if len(stats) > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    if callable(ranks):
        ranks = ranks({r["__g"]: r["n"] for r in stats})
    todo, out = [], {}
    for r in stats:
        g = r["__g"]
        want = [x for x in ranks.get(g, []) if 0 <= x < (r["n"] or 0)]
        if not want:
            continue
        if r["lo"] == r["hi"]:
            for x in want:
                out[(g, x)] = (float(r["lo"]), 0, r["n"])
            continue
        todo.append((g, col, r["n"], float(r["lo"]), float(r["hi"])))
    if todo:
        resolved, less = _refine(base, todo, [], buckets, collect_limit, 64,
                                 ranks={g: [x for x in ranks.get(g, [])] for g, *_ in todo},
                                 want_ranks=True)
        for (g, _c, x), v in resolved.items():
            out[(g, x)] = (v, *less[(g, _c, x)])
    return out
