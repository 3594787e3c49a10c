"""KNN / iterative / bake-off against brute force on small fixtures."""

import math
import random

from boreframe.operators.impute import (best_technique, imputation_bakeoff, iterative_impute,
                                        knn_impute)


def _brute_knn(rows, k):
    feats = len(rows[0]) - 1
    out = {}
    for r in rows:
        rid, x = r[0], r[1:]
        filled = list(x)
        for j in range(feats):
            if x[j] is not None:
                continue
            cands = []
            for d in rows:
                y = d[1:]
                if y[j] is None:
                    continue
                both = [i for i in range(feats) if x[i] is not None and y[i] is not None]
                if not both:
                    continue
                dist = math.sqrt(sum((x[i] - y[i]) ** 2 for i in both) * feats / len(both))
                cands.append((dist, y[j]))
            cands.sort()
            top = cands[:k]
            if not top:  # no donor shares a coordinate: column mean
                col = [d[1 + j] for d in rows if d[1 + j] is not None]
                filled[j] = sum(col) / len(col)
                continue
            filled[j] = sum(v for _, v in top) / len(top)
        out[rid] = filled
    return out


def test_knn_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(80):
        vals = [rnd.uniform(0, 10) for _ in range(3)]
        for j in range(3):
            if rnd.random() < 0.15:
                vals[j] = None
        rows.append((i, *vals))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {r["id"]: [r["a"], r["b"], r["c"]] for r in knn_impute(df, ["a", "b", "c"], k=3).collect()}
    exp = _brute_knn(rows, 3)
    for rid, vals in exp.items():
        for g, e in zip(got[rid], vals):
            if e is None:
                assert g is None
            else:
                assert abs(g - e) < 1e-9


def test_knn_cells_ties_and_blocks(spark, monkeypatch):
    """Small cells and blocks, repeated rows, equal distances: still exact."""
    from boreframe.operators import knn
    monkeypatch.setattr(knn, "CELL", 16)
    monkeypatch.setattr(knn, "BLOCK", 20)
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        v = [round(rnd.uniform(0, 50), 1), float(rnd.randint(0, 5)), rnd.uniform(0, 1000), float(rnd.randint(0, 3))]
        rows.append((i, *[None if rnd.random() < 0.08 else x for x in v]))
    rows += [(1000 + i, 1.0, 1.0, 1.0, None) for i in range(50)] + [(2000 + i, 1.0, 1.0, 1.0, 2.0) for i in range(60)]
    rows.append((3000, None, None, None, None))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    got = {r["id"]: list(r)[1:] for r in knn.knn_impute(df, ["a", "b", "c", "d"]).collect()}
    for r in rows:
        x = r[1:]
        for j in range(4):
            if x[j] is not None:
                assert got[r[0]][j] == x[j]
                continue
            near = []
            for d in rows:
                y = d[1:]
                both = [i for i in range(4) if x[i] is not None and y[i] is not None]
                if y[j] is not None and both:
                    near.append((sum((x[i] - y[i]) ** 2 for i in both) * 4 / len(both), y[j]))
            near = sorted(near)[:5] or [(0, v[1 + j]) for v in rows if v[1 + j] is not None]
            assert abs(got[r[0]][j] - sum(v for _, v in near) / len(near)) < 1e-6


def test_knn_without_a_complete_row(spark, monkeypatch):
    """No row has every curve, and the most frequent pattern lacks one."""
    from boreframe.operators import knn
    monkeypatch.setattr(knn, "CELL", 8)
    rnd = random.Random(9)
    rows = []
    for i in range(300):  # c and d are never logged together
        v = [rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.uniform(0, 10)]
        v[3 if i % 5 else 2] = None
        if i % 7 == 0:
            v[i % 2] = None
        rows.append((i, *v))
    rows += [(900, None, None, 1.0, None), (901, None, None, None, 1.0), (902, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    got = {r["id"]: list(r)[1:] for r in knn.knn_impute(df, ["a", "b", "c", "d"], k=4).collect()}
    exp = _brute_knn(rows, 4)
    assert len(got) == len(rows)
    assert all(abs(g - e) < 1e-9 for i in exp for g, e in zip(got[i], exp[i]))


def test_each_technique_is_carried_to_new_rows(spark):
    """What is saved fills new rows as the technique filled the training rows."""
    from boreframe.operators import train as T
    from boreframe.operators.impute import apply_imputer, fit_imputer
    rnd = random.Random(2)
    rows = []
    for i in range(200):
        a = rnd.uniform(0, 10)
        v = [a, 3 * a + 1, rnd.uniform(0, 1)]
        rows.append((i, *[None if rnd.random() < 0.1 else x for x in v], "AB"[i % 2]))
    feats = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y string")
    for technique in ("median", "mean", "iterative", "knn"):
        fitted, filled = fit_imputer(df, feats, technique)
        assert fitted.technique == technique
        want = {r["id"]: [r[f] for f in feats] for r in filled.collect()}
        got = {r["id"]: [r[f] for f in feats] for r in apply_imputer(df, feats, fitted).collect()}
        assert all(abs(x - y) < 1e-6 for i in want for x, y in zip(want[i], got[i])), technique
        pre, scaler = T.fit_preprocessing(df, feats, technique)
        model = T.fit(df, feats, "y", T.random_forest(num_trees=2, max_depth=2), pre, scaler)
        saved = model.stages[0].getStatement()
        if technique in ("median", "mean"):
            assert all(f"{float(pre.fills[f])!r}D" in saved for f in feats)
        scored = T.score_table(model, df, fitted=pre, features=feats)
        assert scored.where("a is null").count() == df.where("a is null").count()  # inputs come back as they were
        probs = T.score_table(model, filled).select("id", "Prediction_Confidence").collect()
        same = {r["id"]: r["Prediction_Confidence"] for r in scored.select("id", "Prediction_Confidence").collect()}
        assert all(abs(same[r["id"]] - r["Prediction_Confidence"]) < 1e-9 for r in probs), technique


def test_iterative_recovers_linear_relation(spark):
    rows = [(i, float(i), 2.0 * i + 1.0 if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    out = {r["id"]: r["y"] for r in iterative_impute(df, ["x", "y"]).collect()}
    for i in range(60):
        assert abs(out[i] - (2.0 * i + 1.0)) < 1e-3


def test_bakeoff_scores_known_cells(spark):
    rows = [(i, float(i % 10), float((i % 10) * 3), float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    scores = imputation_bakeoff(df, ["a", "b", "c"], ["id"])
    assert [t for t, _ in scores] == ["median", "mean", "knn", "iterative"]
    assert all(m != float("inf") for _, m in scores)
    # b is an exact linear function of a: regression/knn beat the constant fills
    assert best_technique(scores) in ("iterative", "knn")


def _plain_iterative(x, rounds):
    """Rounds over rows: mean fills, then a Bayesian ridge per incomplete curve on
    centred rows."""
    import numpy as np
    gone = np.isnan(x)
    z = np.where(gone, np.nanmean(x, 0), x)
    order = sorted(np.flatnonzero(gone.any(0)), key=lambda f: (gone[:, f].sum(), f))
    for _ in range(rounds):
        for f in order:
            others = [g for g in range(x.shape[1]) if g != f]
            a, y = z[~gone[:, f]][:, others], z[~gone[:, f], f]
            ma, my = a.mean(0), y.mean()
            u, s, vt = np.linalg.svd(a - ma, full_matrices=False)
            alpha, lam, before = 1 / (y.var() + np.finfo(float).eps), 1.0, None
            for _ in range(300):
                w = vt.T @ ((s / (s ** 2 + lam / alpha)) * (u.T @ (y - my)))
                rss = ((y - my - (a - ma) @ w) ** 2).sum()
                used = (alpha * s ** 2 / (lam + alpha * s ** 2)).sum()
                lam, alpha = (used + 2e-6) / (w @ w + 2e-6), (len(y) - used + 2e-6) / (rss + 2e-6)
                if before is not None and np.abs(before - w).sum() < 1e-3:
                    break
                before = w
            w = vt.T @ ((s / (s ** 2 + lam / alpha)) * (u.T @ (y - my)))
            z[gone[:, f], f] = my + (z[gone[:, f]][:, others] - ma) @ w
    return z


def test_iterative_equals_row_wise_bayesian_ridge(spark):
    import numpy as np
    from boreframe.operators.impute import fit_iterative
    g = np.random.default_rng(4)
    base = g.normal(0, 1, (300, 2))
    x = np.c_[base, base @ [2.0, -1.0] + g.normal(0, 0.3, 300), 50 + 10 * base[:, 0] + g.normal(0, 2, 300), g.uniform(0, 5, 300)]
    x[g.random(x.shape) < 0.12] = np.nan
    names = list("abcde")
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
                               "id int, " + ", ".join(f"{n} double" for n in names))
    for rounds in (1, 3):
        fitted, filled = fit_iterative(df, names, max_iter=rounds, tol=0.0)
        got = np.array([list(r)[1:] for r in filled.orderBy("id").collect()])
        assert np.allclose(got, _plain_iterative(x, rounds), rtol=1e-7, atol=1e-7)
        assert len(fitted.steps) == rounds * 5
    # the rounds walked through give what the looked-up forms give
    from boreframe.operators.impute import apply_imputer
    fitted.known_masks = 2
    again = np.array([list(r)[1:] for r in apply_imputer(df, names, fitted).orderBy("id").collect()])
    assert np.allclose(again, got, rtol=1e-9)
    # it stops once nothing can change by more than the tolerance
    few, _ = fit_iterative(df, names, max_iter=50, tol=1e-3)
    assert len(few.steps) < 50 * 5


def test_twenty_incomplete_curves_and_new_masks(spark):
    import numpy as np
    from boreframe.operators.impute import apply_imputer, fit_iterative
    g = np.random.default_rng(6)
    names = [f"c{i}" for i in range(20)]
    base = g.normal(0, 1, (400, 3))
    x = base @ g.normal(0, 1, (3, 20)) + g.normal(0, 0.2, (400, 20))
    x[g.random(x.shape) < 0.03] = np.nan
    schema = "id int, " + ", ".join(f"{n} double" for n in names)

    def frame(m):
        return spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(m)], schema)
    fitted, filled = fit_iterative(frame(x), names, max_iter=2, tol=0.0)
    assert 20 < len(fitted.masks) < 400
    got = np.array([list(r)[1:] for r in filled.orderBy("id").collect()])
    assert np.allclose(got, _plain_iterative(x, 2), rtol=1e-6, atol=1e-6)
    new = x[:5].copy()
    new[:, :15] = np.nan  # a set of missing curves that the fit never saw
    mask = "1" * 15 + "0" * 5
    assert mask not in fitted.masks
    forms = fitted._form(set(names[:15]))
    out = [list(r)[1:] for r in apply_imputer(frame(np.nan_to_num(new[:, :]) * 0 + new), names, fitted).orderBy("id").collect()]
    for r, got in zip(new, out):
        row = dict(zip(names, r))
        if np.isnan(r[15:]).any():
            continue
        for i, n in enumerate(names[:15]):
            const, coef = forms[n]
            assert abs(got[i] - (const + sum(w * row[h] for h, w in coef.items()))) < 1e-9


def test_knn_search_sends_the_bound_along_and_keeps_only_what_lies_within(spark, monkeypatch):
    """The cells' answers stay small: a cell beyond the k nearest adds no row."""
    from boreframe.operators import knn
    rows = [(i, float(i * 7 % 101), float(i * 13 % 89) if i % 5 else None, float(i % 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    DataFrame = type(df)
    schemas, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(knn, "CELL", 8)
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema, *a, **o: schemas.append(schema) or plain(self, f, schema, *a, **o))
    got = {r["k"]: r["b"] for r in knn.knn_impute(df, ["a", "b", "c"], k=3).collect()}
    assert any("bound double" in s and "cell int" in s for s in schemas)
    have = [r for r in rows if r[2] is not None]
    for k, a, b, c in rows:
        if b is None:
            best = sorted((((x[1] - a) ** 2 + (x[3] - c) ** 2) * 3 / 2, x[2]) for x in have)[:3]
            assert abs(got[k] - sum(v for _, v in best) / 3) < 1e-9


def test_knn_cells_are_found_by_descent_and_donors_by_boxes():
    import numpy as np

    from boreframe.operators import knn
    rng = np.random.default_rng(5)
    y = np.round(rng.normal(size=(700, 3)), 2)
    part = np.c_[y[:, 0], np.full(700, np.nan), y[:, 2]]
    cells = knn._Cells({7: 40_000, 5: 20_000}, {7: y, 5: part}, 3)
    x = np.round(rng.normal(size=(60, 3)), 2)
    x[:20, 1], x[20:40, 0], x[55:, :] = np.nan, np.nan, [np.nan, 1.0, np.nan]
    limit = rng.uniform(0, 2, 60)
    limit[50:] = np.inf
    want = np.array([sum(1 << d for d in range(3) if np.isnan(v[d])) or 1 for v in x])
    got = set(zip(*(a.tolist() for a in cells.within(x, want, limit))))
    exp = set()
    for i, v in enumerate(x):
        for c, p in enumerate(cells.pattern):
            both = [d for d in range(3) if p >> d & 1 and not np.isnan(v[d])]
            gap = [max(0.0, cells.low[c, d] - v[d], v[d] - cells.high[c, d]) for d in both]
            if both and p & want[i] and sum(g * g for g in gap) * 3 / len(both) * (1 - 1e-12) <= limit[i]:
                exp.add((i, c))
    assert got == exp and len(exp) < 60 * len(cells.pattern)
    boxes = knn._boxes(np.concatenate([y, np.zeros((200, 3))]), 32)
    assert sorted(np.concatenate([b[0] for b in boxes])) == list(range(900))
    assert all(len(ix) <= 32 or (lo == hi).all() for ix, lo, hi in boxes)


def test_knn_in_slices_and_small_tables_in_the_shared_folder(spark, monkeypatch):
    """Slices of the search change nothing; donors and masked rows take a few bytes a value."""
    import os

    from pyspark.sql import functions as F

    from boreframe.operators import knn
    from boreframe.session import ensure_checkpoint_dir
    df = spark.range(0, 8000, numPartitions=4).select("id", *[F.when(F.col("id") % p != 3, F.expr(f"pmod(id * {q}, {m}) / 4D")).alias(c) for c, p, q, m in
                                                              (("a", 31, 7919, 211), ("b", 37, 104729, 1009), ("c", 41, 611953, 97))])

    def size() -> int:
        top = ensure_checkpoint_dir(spark).removeprefix("file:")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
    before = size()
    placed = knn.index_donors(df, ["a", "b", "c"]).placed
    assert size() - before < 25 * 8000 and placed.count() < 200
    whole = sorted(map(tuple, knn.knn_impute(df, ["a", "b", "c"]).collect()))
    monkeypatch.setattr(knn, "SENT", 200)
    assert sorted(map(tuple, knn.knn_impute(df, ["a", "b", "c"]).collect())) == whole
    before = size()
    imputation_bakeoff(df, ["a", "b", "c"], ["id"], techniques=["median", "mean"])
    assert size() - before < 25 * 8000
