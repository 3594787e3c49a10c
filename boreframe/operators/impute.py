"""Imputation techniques, their fitted form, and the bake-off.

* KNN (I3): ``operators.knn``, exact, as Spark jobs.
* Iterative (I4): rounds of Bayesian ridge regression per incomplete column
  (ascending by missing count), starting from mean fills, until no imputed cell
  can change by more than the tolerance or ``max_iter`` rounds.  Whatever the
  rounds, a missing cell is a linear form of the row's present curves, the same
  for all rows that miss the same curves; so one aggregate, a Gram matrix per
  set of missing curves, holds all that the rounds need, and they run on the
  driver without touching rows.
* ``Imputer`` (I6) is what a technique has learnt: fill values, regressions in
  the order they were applied, or donors.  ``stages`` are the Spark ML stages
  that apply it to new rows; they are saved with the model.
* Bake-off (I5): deterministic 10 % cell mask over the whole table, impute,
  MSE over the masked cells whose true value is known, lowest wins (ties ->
  earlier technique); a technique that fails scores +inf and its error is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_shuffles, stored
from . import prepare as I
from .knn import DonorIndex, index_donors, knn_fill, knn_impute

TECHNIQUES = ["median", "mean", "knn", "iterative"]


# ---------------------------------------------------------------------------
# I4 iterative
# ---------------------------------------------------------------------------

def iterative_impute(df: DataFrame, features, key_cols=None, max_iter: int = 10, tol: float = 1e-3) -> DataFrame:
    """Round-robin regression imputation (see module doc)."""
    return fit_iterative(df, features, max_iter, tol)[1]


def bayesian_ridge(n: float, xx: np.ndarray, xy: np.ndarray, yy: float, max_iter: int = 300,
                   tol: float = 1e-3) -> np.ndarray:
    """Coefficients of a Bayesian ridge regression from the centred sums of
    squares and products: noise and weight precisions start at 1 / var(y) and 1,
    have Gamma(1e-6, 1e-6) priors, and are re-estimated by evidence maximisation
    until the coefficients move by less than ``tol`` in all."""
    prior = 1e-6
    eig, vec = np.linalg.eigh(xx)
    eig = np.maximum(eig, 0)
    turned = vec.T @ xy
    alpha, lam = 1 / (max(yy, 0) / n + np.finfo(float).eps), 1.0

    def solve() -> np.ndarray:
        return vec @ (turned / (eig + lam / alpha))

    before = None
    for _ in range(max_iter):
        w = solve()
        rss = max(yy - 2 * w @ xy + w @ xx @ w, 0.0)
        used = (alpha * eig / (lam + alpha * eig)).sum()
        lam = (used + 2 * prior) / (w @ w + 2 * prior)
        alpha = (n - used + 2 * prior) / (rss + 2 * prior)
        if before is not None and np.abs(before - w).sum() < tol:
            break
        before = w
    return solve()


def missing_mask(features) -> F.Column:
    """Which curves a row misses, as a string of 0 and 1 in the curves' order."""
    return F.concat(*[F.when(F.col(f"`{f}`").isNull(), "1").otherwise("0") for f in features])


def pattern_sums(df: DataFrame, features, centre: dict) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per set of missing curves that occurs: the Gram matrix of (1, curves less
    their centre, missing ones 0), and the largest absolute value of each."""
    k = len(features)
    x = [F.lit(1.0), *[F.coalesce(F.col(f"`{f}`").cast("double") - F.lit(centre[f]), F.lit(0.0)) for f in features]]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    rows = (df.select(missing_mask(features).alias("mask"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
            .groupBy("mask").agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs],
                                 *[F.max(F.abs(F.col(f"x{i}"))) for i in range(k + 1)]).collect())  # a row per set
    out = {}
    for r in rows:
        gram = np.zeros((k + 1, k + 1))
        for (i, j), v in zip(pairs, r[1:]):
            gram[i, j] = gram[j, i] = v
        out[r[0]] = gram, np.array(r[1 + len(pairs):], float)
    return out


def fit_iterative(df: DataFrame, features, max_iter: int = 10, tol: float = 1e-3) -> tuple["Imputer", DataFrame]:
    """The fitted regressions, and ``df`` imputed by them; two scans."""
    means = I.fit_mean(df, features)
    feats = [f for f in features if means[f] is not None]
    fitted = Imputer("iterative", means)
    sums = pattern_sums(df, feats, means) if feats else {}
    masks = sorted(sums)
    missing = np.array([[c == "1" for c in m] for m in masks]).reshape(len(masks), len(feats))
    gram = np.array([sums[m][0] for m in masks]).reshape(len(masks), len(feats) + 1, len(feats) + 1)
    peak = np.array([sums[m][1] for m in masks])
    counts = gram[:, 0, 0]
    n_missing = counts @ missing if len(masks) else np.zeros(len(feats))
    order = sorted(np.flatnonzero(n_missing), key=lambda f: (n_missing[f], f))
    fitted.masks = [m for _, m in sorted(zip(-counts, masks)) if "1" in m]
    fitted.mask_curves = feats
    if not order:
        return fitted, df
    centre = np.array([means[f] for f in feats])
    scale = max(float((peak[:, 1:] + np.abs(centre)).max()), 1e-300)
    # forms: per set of missing curves, each value as a combination of (1, present curves)
    forms = np.repeat(np.eye(len(feats) + 1)[None], len(masks), 0)
    for f in range(len(feats)):
        forms[missing[:, f], f + 1] = 0.0
    for _ in range(max_iter):
        before = forms.copy()
        for f in order:
            has = ~missing[:, f]
            g = np.einsum("pij,pjk,plk->il", forms[has], gram[has], forms[has])
            n, at = g[0, 0], [0, *[i + 1 for i in range(len(feats)) if i != f]]
            mean = g[0] / n
            c = g - n * np.outer(mean, mean)
            w = bayesian_ridge(n, c[np.ix_(at[1:], at[1:])], c[at[1:], f + 1], c[f + 1, f + 1])
            row = np.r_[mean[f + 1] - w @ mean[at[1:]], w]
            forms[~has, f + 1] = np.einsum("i,pij->pj", row, forms[~has][:, at])
            others = [i - 1 for i in at[1:]]
            fitted.steps.append((feats[f], float(row[0] + centre[f] - w @ centre[others]),
                                 {feats[i]: float(v) for i, v in zip(others, w)}))
        change = (np.abs(forms - before) * peak[:, None, :]).sum(-1).max()  # a bound over all rows
        if change < tol * scale:
            break
    return fitted, apply_imputer(df, features, fitted)


# ---------------------------------------------------------------------------
# I6 fitted techniques
# ---------------------------------------------------------------------------

@dataclass
class Imputer:
    """A fitted technique: how missing values of new rows are filled."""

    technique: str
    fills: dict
    steps: list = field(default_factory=list)
    donors: DataFrame | None = None
    k: int = 5
    masks: list = field(default_factory=list)        # sets of missing curves, the most frequent first
    mask_curves: list = field(default_factory=list)  # whose 0 and 1 they hold
    known_masks: int = 1000
    index: DonorIndex | None = None                  # the donors' cells, made at the first search

    def before(self, df: DataFrame, features) -> DataFrame:
        """What has to run ahead of the saved stages: the donor search of KNN."""
        if self.technique == "knn" and self.donors is not None:
            if self.index is None or self.index.names != list(features):
                self.index = index_donors(self.donors, features, self.k)
            return knn_fill(df, self.index)
        return df

    def stages(self, features, out) -> list:  # noqa: ANN001
        """SQL stages that write the imputed curve of ``f`` to ``out(f)``.

        The regressions are linear, so for each set of missing curves all
        their rounds together are one linear form of the curves that are
        there.  The forms of the ``known_masks`` most frequent sets of the
        fitted table are looked up by the set; a row that misses another set
        of curves goes through the rounds, one regression after the other.
        """
        feats = list(features)

        def raw(f):  # noqa: ANN001, ANN202
            return f"CAST(`{f}` AS DOUBLE)"

        def start(f):  # noqa: ANN001, ANN202
            return f"coalesce({raw(f)}, {float(self.fills[f])!r}D)" if self.fills.get(f) is not None else raw(f)
        if not self.steps:
            return [SQLTransformer(statement="SELECT *, " + ", ".join(
                f"{start(f)} AS `{out(f)}`" for f in feats) + " FROM __THIS__")]
        curves = [f for f in self.mask_curves if f in feats]
        place = {f: i for i, f in enumerate(curves)}
        learnt = {s[0] for s in self.steps}
        mask, values, all_ = out("mask"), out("values"), out("all")

        def numbers(x) -> str:  # noqa: ANN001
            return f"array({', '.join(f'{float(v)!r}D' for v in x)})"

        forms: dict[str, list] = {f: [] for f in learnt}
        for m in self.masks[:self.known_masks]:
            gone = {f for f, c in zip(self.mask_curves, m) if c == "1"}
            for f, (const, coef) in self._form(gone).items():
                if f in forms and f in gone:
                    forms[f].append(f"'{m}', {numbers([const, *[coef.get(g, 0.0) for g in curves]])}")
        bits = ", ".join(f"CASE WHEN `{f}` IS NULL THEN '1' ELSE '0' END" for f in curves)
        steps = ", ".join(f"named_struct('at', {place[f]}, 'const', {const!r}D, 'w', {numbers([w.get(g, 0.0) for g in curves])})"
                          for f, const, w in self.steps)
        dot = "aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, p) -> s + p)"
        walk = (f"aggregate(array({steps}), slice(`{values}`, 2, {len(curves)}), (v, s) -> transform(v, (x, i) -> "
                f"CASE WHEN i = s.at AND substring(`{mask}`, i + 1, 1) = '1' THEN s.const + {dot.format(a='s.w', b='v')} ELSE x END))")
        known = " OR ".join([f"`{mask}` IN ({', '.join(repr(m) for m in self.masks[:self.known_masks])})"] if self.masks else ["false"])
        cols = []
        for f in feats:
            if f not in learnt:
                cols.append(f"{start(f)} AS `{out(f)}`")
                continue
            late = f"`{all_}`[{place[f]}]"
            form = f"map({', '.join(forms[f])})" if forms[f] else None
            direct = dot.format(a=f"try_element_at({form}, `{mask}`)", b=f"`{values}`") if form else late
            cols.append(f"CASE WHEN `{f}` IS NOT NULL THEN {raw(f)} WHEN `{all_}` IS NULL THEN {direct} ELSE {late} END AS `{out(f)}`")
        return [SQLTransformer(statement=f"SELECT *, concat({bits}) AS `{mask}`, array(1D, {', '.join(map(start, curves))}) AS `{values}` FROM __THIS__"),
                SQLTransformer(statement=f"SELECT *, CASE WHEN instr(`{mask}`, '1') = 0 OR {known} THEN NULL ELSE {walk} END AS `{all_}` FROM __THIS__"),
                SQLTransformer(statement=f"SELECT *, {', '.join(cols)} FROM __THIS__")]

    def _form(self, missing: set) -> dict:
        """All steps as ``{curve: (constant, {present curve: coefficient})}``
        for rows that miss the curves ``missing``."""
        form = {f: (float(v), {}) if f in missing else (0.0, {f: 1.0}) for f, v in self.fills.items() if v is not None}
        for f, intercept, coefficients in self.steps:
            if f not in missing:
                continue
            const, coef = intercept, {}
            for g, w in coefficients.items():
                const += w * form[g][0]
                for h, v in form[g][1].items():
                    coef[h] = coef.get(h, 0.0) + w * v
            form[f] = (const, coef)
        return form


def fit_imputer(df: DataFrame, features, technique: str | None, k: int = 5) -> tuple[Imputer, DataFrame]:
    """The technique fitted on ``df`` (default: median), and ``df`` imputed by it."""
    if technique in (None, "median"):
        fills = I.fit_median(df, features)
        return Imputer("median", fills), I.impute(df, fills)
    if technique == "mean":
        fills = I.fit_mean(df, features)
        return Imputer("mean", fills), I.impute(df, fills)
    if technique == "iterative":
        return fit_iterative(df, features)
    if technique == "knn":
        donors = stored(df.select(*features), "donors")
        return Imputer("knn", I.fit_mean(df, features), donors=donors, k=k), knn_impute(df, features, k=k, donors=donors)
    raise ValueError(technique)


# ---------------------------------------------------------------------------
# I5 bake-off
# ---------------------------------------------------------------------------

def mask(key_cols, f: str, seed: int) -> F.Column:
    """Is the cell of curve ``f`` in the masked tenth of all cells."""
    return I.order_key([F.lit(f), *key_cols], seed) < F.lit(0.1 * (1 << 52))


def masked_cells(df: DataFrame, features, key_cols, seed: int = 42) -> DataFrame:
    """``df`` with the masked cells emptied, their truth in ``__t_<curve>``
    and ``__k_<curve>`` true where a known cell was masked."""
    keys = {f: mask(key_cols, f, seed) & F.col(f).isNotNull() for f in features}
    out = df.withColumns({f"__t_{f}": F.col(f) for f in features} | {f"__k_{f}": keys[f] for f in features})
    return out.withColumns({f: F.when(F.col(f"__k_{f}"), F.lit(None).cast("double")).otherwise(F.col(f))
                            for f in features})


def imputation_bakeoff(df: DataFrame, features, key_cols, seed: int = 42, techniques=TECHNIQUES,
                       errors: dict | None = None) -> list:
    """Score each technique over the masked cells of the whole table; returns
    [(technique, mse)] in the given order, and puts the message of a technique
    that failed (it scores +inf) into ``errors``.

    MSE is computed only over masked cells whose true value is known (cells
    that were already missing have no truth to compare with).
    """
    feats = list(features)
    cells = masked_cells(df.select(*key_cols, *feats), feats, key_cols, seed)
    bits = sum((F.when(F.col(f"__k_{f}"), 1 << i).otherwise(0) for i, f in enumerate(feats)), F.lit(0))
    kept = stored(cells.select(bits.alias("__k"), *[F.col(f"__t_{f}").alias(f"{f}") for f in feats]), "bakeoff")
    masked = kept.select("__k", *[F.when(_is_masked(i), F.lit(None).cast("double")).otherwise(F.col(f"`{f}`")).alias(f) for i, f in enumerate(feats)],
                         *[F.when(_is_masked(i), F.col(f"`{f}`")).alias(f"__t_{f}") for i, f in enumerate(feats)])
    scores = []
    for t in techniques:
        try:
            _, imp = fit_imputer(masked, feats, t)
            err = imp.agg(
                F.sum(sum([F.when(_is_masked(i), F.pow(F.col(f) - F.col(f"__t_{f}"), 2)).otherwise(0.0)
                           for i, f in enumerate(feats)], F.lit(0.0))).alias("se"),
                F.sum(F.bit_count("__k")).alias("n")).first()
            mse = err["se"] / err["n"] if err["n"] else float("inf")
            if mse is None or (isinstance(mse, float) and math.isnan(mse)):
                mse = float("inf")
        except Exception as e:  # noqa: BLE001 - the others still compete
            mse = float("inf")
            if errors is not None:
                errors[t] = f"{type(e).__name__}: {e}"
        scores.append((t, float(mse)))
        drop_shuffles(df.sparkSession)
    return scores


def _is_masked(i: int) -> F.Column:
    return F.col("__k").bitwiseAND(F.lit(1 << i)) != 0


def best_technique(scores) -> str:
    best = min(scores, key=lambda t: t[1])
    return best[0]


def apply_technique(df: DataFrame, features, technique: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Impute the whole table with the chosen technique (learnt from ``fit_on``)."""
    if fit_on is None:
        return fit_imputer(df, features, technique)[1]
    return apply_imputer(df, features, fit_imputer(fit_on, features, technique)[0])


def apply_imputer(df: DataFrame, features, fitted: Imputer) -> DataFrame:
    """``df`` with its curves imputed by a fitted technique."""
    out = fitted.before(df, features)
    for stage in fitted.stages(features, lambda f: f"__imp_{f}"):
        out = stage.transform(out)
    return out.withColumns({f: F.col(f"__imp_{f}") for f in features}).drop(
        "__imp_mask", "__imp_values", "__imp_all", *[f"__imp_{f}" for f in features])
