"""Exact top-k inner products by a Voronoi join.

Queries and data are grouped by their nearest pivot.  In the space with one
more dimension, where a data row ``x`` has the coordinate ``sqrt(M2 - |x|^2)``
(``M2``: the largest squared norm) and a query 0, the highest inner products are
the smallest distances, so that triangle bounds hold.  Two small summaries (per
pivot: rows, largest distance, the ``k + 1`` smallest ones) give every group of
queries a distance within which each of them has ``k`` neighbours; only blocks
of a cell whose distances to the pivot may lie within it travel to the group.
Each meeting of a group's part and some blocks is solved alone, with the bounds
of the single queries, and the parts' best rows merge in Spark.

Cells are cut by distance and row number into blocks, cells with many queries
into parts by a hash, and a group's blocks are dealt over salts, so neither a
frequent vector nor a large cell meets one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreframe.llm.vectors import (NONE, PACKED, PACKED_SCHEMA, Packed, best_per_row, blocks_of, int_rows,
                                   space_of)


def _distances(space, vecs: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots in the lifted space."""
    a = np.c_[vecs.astype(float), lift]
    b = np.c_[pivots.astype(float), pivot_lift]
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0))


def _lift(space, vecs: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(space.norm2 - (vecs.astype(float) ** 2).sum(1), 0))


def _groups(counts: dict[int, int], between: np.ndarray, rows: int) -> list[list[int]]:
    """Neighbouring query cells joined until a group has about ``rows`` queries;
    a cell with more is a group of its own."""
    left = {c for c in counts if counts[c] <= rows}
    out = [[c] for c in counts if counts[c] > rows]
    while left:
        at = min(left)
        group, size = [], 0
        while left and (not group or size + counts[at] <= rows):
            group.append(at)
            size += counts[at]
            left.discard(at)
            if left:
                rest = sorted(left)
                at = rest[int(np.argmin(between[at, rest]))]
        out.append(group)
    return out


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_modulus: int = 50,
          k: int = 5, max_pivots: int = 512, group_rows: int = 2048, block_rows: int = 2048,
          task_blocks: int = 32, seed: int = 7) -> DataFrame:
    """``(query_id, rank, id_col, score)``: for every row whose id is divisible by
    ``query_modulus``, the ``k`` other rows with the highest inner product (all,
    if fewer), equal scores by id, then by row.

    Null vectors and those with a null or non-finite component take no part; a
    null id is never a query and ranks behind all ids; shorter vectors are
    padded with zeros.  Repeated rows are rows of their own: each is a query
    and a candidate of the others.  Empty table: no rows.

    ``max_pivots`` bounds the summaries (and what tasks get of them);
    ``group_rows`` queries and ``task_blocks`` blocks of ``block_rows`` rows
    bound a task's memory.  None of them changes the result.
    """
    spark = vectors.sparkSession
    out = f"query_id long, rank int, `{id_col}` long, score long"
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("long").alias("label"),
                         F.col(vec_col).alias("v"))
    space = space_of(src)
    if space.rows < 2:
        return spark.createDataFrame([], out)
    slack = 1e-6 * (1 + math.sqrt(space.norm2))

    # pivots: distinct rows of a hashed sample, expected to be twice as many as needed
    n_pivots = min(max_pivots, math.isqrt(space.rows) // 4 + 1)
    share = min(1.0, 2 * n_pivots / space.rows)
    key = F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(1 << 30))
    sample = src.where(key < F.lit(int(share * (1 << 30)) + 1)).select("v").limit(4 * n_pivots).collect()
    rows = [np.array([min(max(math.floor(256 * x), -2 ** 62), 2 ** 62) for x in r.v], np.int64) for r in sample
            if r.v is not None and all(x is not None and math.isfinite(x) for x in r.v)]
    pivots = np.zeros((max(len(rows), 1), space.dim), np.int64)
    for i, r in enumerate(rows):
        pivots[i, :len(r)] = r
    pivots = np.unique(pivots, axis=0)
    pivots = pivots[np.random.default_rng(seed).permutation(len(pivots))[:n_pivots]]
    pivot_lift = _lift(space, pivots)

    def assign(ids, m):  # noqa: ANN001, ANN202
        d = _distances(space, m, _lift(space, m), pivots, pivot_lift)
        cell = d.argmin(1) if len(m) else np.zeros(0, int)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ask = known & (ids.fill_null(0).to_numpy(zero_copy_only=False) % query_modulus == 0)
        qcell, qdist = np.zeros(len(m), int), np.zeros(len(m))
        if ask.any():
            dq = _distances(space, m[ask], np.zeros(ask.sum()), pivots, pivot_lift)
            qcell[ask], qdist[ask] = dq.argmin(1), dq.min(1)
        near = d[np.arange(len(m)), cell] if len(m) else np.zeros(0)
        return [pa.array(cell, pa.int32()), pa.array(near, pa.float64()),
                pa.array(qcell, pa.int32(), mask=~ask), pa.array(qdist, pa.float64(), mask=~ask)]

    data = int_rows(src, space, assign, "cell int, dist double, qcell int, qdist double")

    # summaries, at most one row per pivot
    nearest = Window.partitionBy("cell").orderBy("dist")
    few = (data.select("cell", "dist", F.row_number().over(nearest).alias("r")).where(F.col("r") <= k + 1)
           .groupBy("cell").agg(F.collect_list("dist").alias("few")))
    cells = {r["cell"]: r for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("far"))
             .join(few, "cell").collect()}
    asked = {r["qcell"]: r for r in data.where("qcell is not null").groupBy("qcell")
             .agg(F.count("*").alias("n"), F.max("qdist").alias("far")).collect()}
    if not asked:
        return spark.createDataFrame([], out)
    between = _distances(space, pivots, pivot_lift, pivots, pivot_lift)
    # the query pivots lie in the same lifted space, so one matrix serves both
    low = np.full((len(asked), len(pivots)), np.inf)
    high = np.full((len(asked), len(pivots)), -np.inf)
    slots = []
    for g, members in enumerate(_groups({c: r["n"] for c, r in asked.items()}, between, group_rows)):
        for i in members:
            reach = sorted(asked[i]["far"] + between[i, j] + d for j, c in cells.items() for d in c["few"])
            theta = (reach[k] if len(reach) > k else math.inf) + slack  # one of them may be the query itself
            span = asked[i]["far"] + theta
            low[g] = np.minimum(low[g], between[i] - span)
            high[g] = np.maximum(high[g], between[i] + span)
        blocks = sum(-(-c["n"] // block_rows) + 1 for j, c in cells.items()
                     if low[g, j] <= c["far"] and high[g, j] >= 0)
        parts = -(-sum(asked[i]["n"] for i in members) // group_rows)
        slots += [(i, g, parts, -(-blocks // task_blocks)) for i in members]
    n_groups = 1 + max(s[1] for s in slots)
    low, high = low[:n_groups], high[:n_groups]
    parts_of = np.array([next(s[2] for s in slots if s[1] == g) for g in range(n_groups)])
    salts_of = np.array([next(s[3] for s in slots if s[1] == g) for g in range(n_groups)])

    def copies(batches):  # noqa: ANN001, ANN202
        from pyspark import TaskContext
        seq = TaskContext.get().partitionId() * 7919
        for t in blocks_of(batches, block_rows, "cell"):
            cell = t.column("cell")[0].as_py()
            d = t.column("dist").to_numpy()
            near, far = float(d.min()), float(d.max())
            body = Packed.of(t, space).to_bytes()
            seq += 1
            to = np.flatnonzero((low[:, cell] <= far) & (high[:, cell] >= near))
            for g in to:
                for p in range(parts_of[g]):
                    yield pa.RecordBatch.from_pydict({
                        "gid": pa.array([g], pa.int32()), "part": pa.array([p], pa.int32()),
                        "salt": pa.array([seq % salts_of[g]], pa.int32()), "cell": pa.array([cell], pa.int32()),
                        "near": pa.array([near]), "far": pa.array([far]),
                        **{c: pa.array([x], pa.binary()) for c, x in zip(PACKED, body)}})

    sent = (data.select("cell", "dist", "rid", "id", "label", "vec").repartitionByRange("cell", "dist", "rid")
            .sortWithinPartitions("cell", "dist", "rid")
            .mapInArrow(copies, f"gid int, part int, salt int, cell int, near double, far double, {PACKED_SCHEMA}"))
    slot = F.broadcast(spark.createDataFrame(slots, "qcell int, gid int, parts long, salts long"))  # <= max_pivots rows
    ask = (data.where("qcell is not null").join(slot, "qcell")
           .select("gid", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"),
                   F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"), "rid", "id", "label", "vec"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("qrid", pa.int64()), ("qid", pa.int64()), ("crid", pa.int64()), ("cid", pa.int64()),
                            ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q = Packed.of(left, space)
        n = len(q.rid)
        q2 = (q.vec.astype(float) ** 2).sum(1)
        here = sorted(set(right.column("cell").to_pylist()))
        to_pivot = _distances(space, q.vec, np.zeros(n), pivots[here], pivot_lift[here])
        best = {c: np.full((n, k), v) for c, v in (("score", NONE), ("rid", -1), ("id", 0))} | {"known": np.zeros((n, k), bool)}
        todo = []
        for at, (cell, near, far) in enumerate(zip(*(right.column(c).to_pylist() for c in ("cell", "near", "far")))):
            d = to_pivot[:, here.index(cell)]
            todo.append((np.maximum(np.maximum(d - far, near - d), 0), at))
        todo.sort(key=lambda x: x[0].mean())
        for bound, at in todo:
            last = best["score"][:, -1]
            far = np.where(best["rid"][:, -1] < 0, np.inf,
                           np.sqrt(np.maximum(q2 + space.norm2 - 2 * last.astype(float), 0)) + slack)
            rows = np.flatnonzero(bound <= far)
            if not len(rows):
                continue
            b = Packed.from_bytes([right.column(c)[at].as_py() for c in PACKED], space)
            s = space.dots(q.vec[rows], b.vec)
            own = q.rid[rows][:, None] == b.rid[None, :]
            top = best_per_row(np.where(own, -np.inf if s.dtype == np.float64 else NONE, s), k)
            live = ~np.take_along_axis(own, top, 1)
            new = {"score": np.where(live, np.take_along_axis(s, top, 1).astype(np.int64), NONE),
                   "rid": np.where(live, b.rid[top], -1), "id": b.id[top], "known": b.known[top]}
            both = {c: np.concatenate([best[c][rows], new[c]], 1) for c in best}
            order = np.lexsort((both["rid"], both["id"], ~both["known"], -both["score"], both["rid"] < 0), axis=-1)[:, :k]
            for c in best:
                best[c][rows] = np.take_along_axis(both[c], order, 1)
        at, j = np.nonzero(best["rid"] >= 0)
        return pa.table([pa.array(q.rid[at]), pa.array(q.id[at]), pa.array(best["rid"][at, j]),
                         pa.array(best["id"][at, j], mask=~best["known"][at, j]), pa.array(best["score"][at, j])],
                        schema=schema)

    by = ["gid", "part", "salt"]
    found = (ask.groupBy(*by).cogroup(sent.groupBy(*by))
             .applyInArrow(solve, "qrid long, qid long, crid long, cid long, score long"))
    order = Window.partitionBy("qrid").orderBy(F.desc("score"), F.asc_nulls_last("cid"), "crid")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("qid").alias("query_id"), "rank", F.col("cid").alias(id_col), "score"))
