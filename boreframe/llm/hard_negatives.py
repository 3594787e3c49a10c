"""Hard negatives from Hilbert-ordered blocks with zone maps.

All vectors are written once as Parquet blocks in the order of their Hilbert
curve position, each with the smallest and largest value of every dimension
and of the label (its zone map).  Interval arithmetic on zone maps bounds the
score of an anchor, or of a box of anchors, with any row of a block, which
decides from the narrow zone columns alone which blocks a search must read:

* positives: a block is read if it may hold the anchor's label and its upper
  bound reaches the anchor's k-th best score in its own block;
* negatives: a block is read if it may hold another label and its bounds meet
  one of the anchor's score windows.

Anchors are grouped into at most ``max_groups`` boxes along the curve, boxes
into parts by a hash, and a box's blocks are dealt over salts, so a task holds
a bounded part of the anchors and some blocks, and applies the same bounds to
the single anchors.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreframe.llm.common import cut
from boreframe.llm.vectors import (NONE, PACKED, PACKED_SCHEMA, Packed, Space, best_per_row, blocks_of, int_rows,
                                   space_of)
from boreframe.session import shared_dir


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of grid cells (one row each, ``bits`` bits a dimension) on the
    Hilbert curve, as rows of bytes that sort like the positions.

    Skilling's method: undo the rotations from the highest bit down, Gray
    decode, then read the bits of all dimensions level by level.
    """
    x = [c.copy() for c in cells.astype(np.uint32).T]
    d = len(x)
    for level in range(bits - 1, 0, -1):
        below = np.uint32((1 << level) - 1)
        for i in range(d):
            high = (x[i] >> np.uint32(level)) & np.uint32(1) == 1
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint32(level)) & np.uint32(1) == 1, np.uint32((1 << level) - 1), np.uint32(0))
    x = np.stack([c ^ turn for c in x], 1)
    levels = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(levels, 1).astype(np.uint8), axis=1)


def bounds(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval arithmetic: bounds of the inner product of any vector of box a
    with any of box b (the last axis is summed), rounded outward."""
    la, ha, lb, hb = (x.astype(float) for x in (lo_a, hi_a, lo_b, hi_b))
    ends = [la * lb, la * hb, ha * lb, ha * hb]
    low, high = np.minimum.reduce(ends).sum(-1), np.maximum.reduce(ends).sum(-1)
    wide = 1e-9 * np.maximum.reduce([np.abs(e) for e in ends]).sum(-1)
    return low - wide, high + wide


def write_blocks(src: DataFrame, space: Space, block_rows: int, bits: int) -> str:
    """Writes the Hilbert-ordered blocks; returns their folder."""
    spread = np.maximum(space.hi.astype(float) - space.lo + 1, 1)

    def keys(ids, m):  # noqa: ANN001, ANN202
        level = np.clip(((m.astype(float) - space.lo) / spread * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
        return [pa.array([r.tobytes() for r in hilbert_keys(level, bits)] if len(m) else [], pa.binary())]

    rows = int_rows(src, space, keys, "key binary")

    def pack(batches):  # noqa: ANN001, ANN202
        for t in blocks_of(batches, block_rows):
            p = Packed.of(t, space)
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([len(p.rid)], pa.int64()),
                "lo": pa.array([p.vec.min(0).tolist()], pa.list_(pa.int64())),
                "hi": pa.array([p.vec.max(0).tolist()], pa.list_(pa.int64())),
                "label_lo": pa.array([int(p.label.min())]), "label_hi": pa.array([int(p.label.max())]),
                **{c: pa.array([x], pa.binary()) for c, x in zip(PACKED, p.to_bytes())}})

    path = shared_dir(src.sparkSession, f"hilbert-{uuid.uuid4().hex}")
    (rows.repartitionByRange("key", "rid").sortWithinPartitions("key", "rid")
     .mapInArrow(pack, f"n long, lo array<long>, hi array<long>, label_lo long, label_hi long, {PACKED_SCHEMA}")
     .withColumn("block", F.monotonically_increasing_id()).write.parquet(path))
    return path


def _unpack_anchors(blocks: DataFrame, space: Space, modulus: int, k: int) -> DataFrame:
    """``(block, rid, id, label, vec, floor)``: the anchors and, as ``floor``, the
    k-th best score of an anchor with its own label inside its own block (null
    if the block has fewer)."""
    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for at in range(b.num_rows):
                p = Packed.from_bytes([b.column(c)[at].as_py() for c in PACKED], space)
                ask = np.flatnonzero(p.known & (p.id % modulus == 0))
                if not len(ask):
                    continue
                s = space.dots(p.vec[ask], p.vec)
                out = (p.label[ask][:, None] != p.label) | (ask[:, None] == np.arange(len(p.rid)))
                s = np.where(out, -np.inf if s.dtype == np.float64 else NONE, s)
                top = best_per_row(s, k)
                full = ((~out).sum(1) >= k)
                last = np.take_along_axis(s, top, 1)[:, -1]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(len(ask), b.column("block")[at].as_py())), "rid": pa.array(p.rid[ask]),
                    "id": pa.array(p.id[ask]), "label": pa.array(p.label[ask]),
                    "vec": pa.array([v.tobytes() for v in p.vec[ask]], pa.binary()),
                    "floor": pa.array(np.where(full, last, 0).astype(np.int64), mask=~full)})

    return blocks.select("block", *PACKED).mapInArrow(run, "block long, rid long, id long, label long, vec binary, floor long")


def _box_of(anchors: DataFrame, space: Space) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Smallest and largest value per dimension of every ``box``: one row per
    box and dimension reaches the driver."""
    def fold(batches):  # noqa: ANN001, ANN202
        for b in batches:
            box, m = b.column(0).to_numpy(), space.unpack(b.column(1)).astype(np.int64)
            for g in np.unique(box):
                mine = m[box == g]
                yield pa.RecordBatch.from_pydict({
                    "box": pa.array(np.full(space.dim, g, np.int32)), "pos": pa.array(np.arange(space.dim, dtype=np.int32)),
                    "lo": pa.array(mine.min(0)), "hi": pa.array(mine.max(0))})

    got = (anchors.select("box", "vec").mapInArrow(fold, "box int, pos int, lo long, hi long")
           .groupBy("box", "pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
    out: dict = {}
    for r in got:
        lo, hi = out.setdefault(r["box"], (np.zeros(space.dim, np.int64), np.zeros(space.dim, np.int64)))
        lo[r["pos"]], hi[r["pos"]] = r["lo"], r["hi"]
    return out


def _search(blocks: DataFrame, anchors: DataFrame, space: Space, same: bool, k: int, group_rows: int,
            task_blocks: int) -> DataFrame:
    """``(arid, aid, slot, crid, cid, score)``: for every anchor and each of its
    windows, the ``k`` best rows of the same (or of another) label, and maybe
    some more (the parts' best rows are not merged).

    ``anchors``: ``box, rid, id, label, vec, floor`` and ``slots, lows, highs``,
    the windows' keys and inclusive score ranges.
    """
    boxes = _box_of(anchors, space)
    spans = anchors.groupBy("box").agg(
        F.count("*").alias("n"), F.min("label").alias("label_lo"), F.max("label").alias("label_hi"),
        F.min(F.array_min("lows")).alias("low"), F.max(F.array_max("highs")).alias("high")).collect()
    spans = sorted(spans, key=lambda r: r["box"])
    blo, bhi = (np.stack([boxes[r["box"]][i] for r in spans]) for i in (0, 1))
    low, high, llo, lhi = (np.array([r[c] for r in spans], float if c in ("low", "high") else np.int64)
                           for c in ("low", "high", "label_lo", "label_hi"))
    box_ids = np.array([r["box"] for r in spans])
    parts = [-(-r["n"] // group_rows) for r in spans]

    def wanted(zlo, zhi, zl, zh):  # noqa: ANN001, ANN202
        """Which boxes must read a block, by interval arithmetic."""
        least, most = bounds(blo, bhi, zlo, zhi)
        labels = (zl <= lhi) & (zh >= llo) if same else ~((zl == zh) & (llo == lhi) & (zl == llo))
        return labels & (most >= low) & (least <= high)

    def choose(batches):  # noqa: ANN001, ANN202
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            pairs = [(block, g) for block, zlo, zhi, zl, zh in zip(*cols)
                     for g in np.flatnonzero(wanted(np.array(zlo), np.array(zhi), zl, zh))]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([p[0] for p in pairs], pa.int64()), "at": pa.array([int(p[1]) for p in pairs], pa.int32())})

    zones = blocks.select("block", "lo", "hi", "label_lo", "label_hi")
    chosen = cut(zones.mapInArrow(choose, "block long, at int"))
    n_blocks = {r["at"]: r["count"] for r in chosen.groupBy("at").count().collect()}  # one row per box
    slots = [(int(box_ids[g]), g, parts[g], -(-n_blocks[g] // task_blocks)) for g in n_blocks]
    slot = F.broadcast(anchors.sparkSession.createDataFrame(  # one row per box
        slots, "box int, at int, parts int, salts int"))
    sent = (chosen.join(slot, "at")
            .select("block", "box", F.pmod(F.xxhash64("block", "box"), F.col("salts")).cast("int").alias("salt"),
                    F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            .join(blocks.select("block", "lo", "hi", *PACKED), "block"))
    ask = (anchors.join(slot, "box")
           .select("box", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("part"),
                   F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                   "rid", "id", "label", "vec", "slots", "lows", "highs"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(c, pa.int64()) for c in ("arid", "aid", "slot", "crid", "cid", "score")])
        found: list[list[np.ndarray]] = []  # per block: window, score, known, id, rid
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        rid, aid, label = (left.column(c).to_numpy() for c in ("rid", "id", "label"))
        vec = space.unpack(left.column("vec"))
        w_anchor = np.repeat(np.arange(len(rid)), [len(x) for x in left.column("slots").to_pylist()])
        w_slot, w_low, w_high = (np.array([y for x in left.column(c).to_pylist() for y in x], np.int64)
                                 for c in ("slots", "lows", "highs"))
        zlo, zhi = (np.array(right.column(c).to_pylist(), np.int64) for c in ("lo", "hi"))
        last = np.full(len(w_slot), NONE)  # the k-th best score that a window has so far
        held = [np.zeros(0, np.int64) for _ in range(5)]

        def merge(parts):  # noqa: ANN001, ANN202
            w, s, known, i, r = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((r, i, ~known.astype(bool), -s, w))
            w = w[order]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, int)
            rank = np.arange(len(w)) - np.repeat(first, np.diff(np.r_[first, len(w)]))
            keep = rank < k
            ends = keep & (rank == k - 1)
            last[w[ends]] = s[order][ends]
            return [w[keep], *(x[order][keep] for x in (s, known, i, r))]

        ranges = [bounds(vec, vec, zlo[j], zhi[j]) for j in range(right.num_rows)]
        for j in sorted(range(right.num_rows), key=lambda j: -ranges[j][1].max()):
            least, most = ranges[j]
            live = (most[w_anchor] >= np.maximum(w_low, last)) & (least[w_anchor] <= w_high)
            rows = np.unique(w_anchor[live])
            if not len(rows):
                continue
            p = Packed.from_bytes([right.column(c)[j].as_py() for c in PACKED], space)
            s = space.dots(vec[rows], p.vec).astype(np.int64)
            fits = (label[rows][:, None] == p.label) == same
            fits &= rid[rows][:, None] != p.rid
            s = np.where(fits, s, NONE)
            order = np.argsort(-s, axis=1, kind="stable")  # columns are in tie order
            down = -np.take_along_axis(s, order, 1)
            windows = np.flatnonzero(live)
            where = np.searchsorted(rows, w_anchor[windows])
            for w, a in zip(windows, where):
                start = int(np.searchsorted(down[a], -w_high[w], "left"))
                end = min(start + k, int(np.searchsorted(down[a], -max(w_low[w], last[w], NONE + 1), "right")))
                if end > start:
                    c = order[a, start:end]
                    found.append([np.full(len(c), w), s[a, c], p.known[c].astype(np.int64), p.id[c], p.rid[c]])
            held = merge([held, *found])
            found = []
        w, s, known, i, r = held
        a = w_anchor[w] if len(w) else np.zeros(0, int)
        return pa.table([pa.array(rid[a]), pa.array(aid[a]), pa.array(w_slot[w]), pa.array(r),
                         pa.array(i, mask=known == 0), pa.array(s)], schema=schema)

    by = ["box", "part", "salt"]
    return (ask.groupBy(*by).cogroup(sent.groupBy(*by))
            .applyInArrow(solve, "arid long, aid long, slot long, crid long, cid long, score long"))


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   relabel=None, anchor_modulus: int = 100, n_positives: int = 5, n_negatives: int = 10,  # noqa: ANN001
                   low: tuple[int, int] = (3, 10), high: tuple[int, int] = (9, 10), block_rows: int = 1024,
                   bits: int = 4, max_groups: int = 256, group_rows: int = 512, task_blocks: int = 32) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``: for every row whose id is divisible by
    ``anchor_modulus`` and each of its ``n_positives`` best other rows of its
    label, the ``n_negatives`` best rows of other labels whose score lies
    between ``low`` and ``high`` (fractions) of the positive's, ends included.
    Scores are integer inner products; equal ones go by id, then by row.

    ``relabel``, if given, maps the id and label columns to the label used.
    Rows with a null label or vector or with a null or non-finite component
    take no part; a null id is never an anchor and ranks behind all ids;
    shorter vectors are padded with zeros; a negative positive score has an
    empty window.  Repeated rows are rows of their own: each is an anchor, and
    a candidate of the others.  Empty table, or one label only: no rows.

    Bounds on memory that do not change the result: at most ``max_groups`` boxes
    of anchors are known to every task, and a task holds about ``group_rows``
    anchors and ``task_blocks`` blocks of ``block_rows`` rows.
    """
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    label = F.col(label_col).cast("long") if relabel is None else relabel(F.col(id_col), F.col(label_col)).cast("long")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"),
                         F.col(vec_col).alias("v")).where("label is not null")
    space = space_of(src)
    if space.rows < 2:
        return spark.createDataFrame([], out)
    blocks = spark.read.parquet(write_blocks(src, space, block_rows, bits))
    anchors = cut(_unpack_anchors(blocks, space, anchor_modulus, n_positives))
    total = anchors.count()
    if not total:
        return spark.createDataFrame([], out)
    n_boxes = min(max_groups, -(-total // group_rows))
    borders = sorted(set(anchors.approxQuantile("block", [i / n_boxes for i in range(1, n_boxes)], 0.1 / n_boxes))) \
        if n_boxes > 1 else []
    box = sum((F.when(F.col("block") > int(x), 1).otherwise(0) for x in borders), F.lit(0)) if borders else F.lit(0)
    boxed = anchors.withColumn("box", box.cast("int"))
    least = F.coalesce("floor", F.lit(NONE))
    asked = boxed.withColumns({"slots": F.array(F.lit(0).cast("long")), "lows": F.array(least),
                               "highs": F.array(F.lit(-NONE))})
    best = Window.partitionBy("arid").orderBy(F.desc("score"), F.asc_nulls_last("cid"), "crid")
    positives = cut(_search(blocks, asked, space, True, n_positives, group_rows, task_blocks)
                    .withColumn("slot", F.row_number().over(best).cast("long")).where(F.col("slot") <= n_positives)
                    .select("arid", "aid", "slot", "cid", "score"))

    def share(of: tuple[int, int], up: bool):  # noqa: ANN202
        """``score * of`` rounded up or down, without overflow."""
        num, den = of
        return F.expr(f"(score div {den}) * {num} + ((score % {den}) * {num} + {den - 1 if up else 0}) div {den}")

    windows = (positives.where("score >= 0")
               .withColumns({"lo": share(low, True), "hi": share(high, False)})
               .groupBy("arid").agg(F.sort_array(F.collect_list(F.struct("slot", "lo", "hi"))).alias("w"))  # <= n_positives
               .select(F.col("arid").alias("rid"), F.col("w.slot").alias("slots"), F.col("w.lo").alias("lows"),
                       F.col("w.hi").alias("highs")))
    asked = cut(boxed.join(windows, "rid"))
    if asked.isEmpty():
        return spark.createDataFrame([], out)
    found = _search(blocks, asked, space, False, n_negatives, group_rows, task_blocks)
    order = Window.partitionBy("arid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("cid"), "crid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    positive = positives.select("arid", "slot", F.col("cid").alias("positive_id"), F.col("score").alias("positive_score"))
    return (ranked.join(positive, ["arid", "slot"])
            .select(F.col("aid").alias("anchor_id"), "positive_id", "rank", F.col("cid").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
