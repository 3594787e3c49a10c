"""Exact KNN imputation (I3) as Spark jobs, without a bound on the donors.

A missing value is the mean of that curve over the ``k`` nearest donors that
have it.  The distance uses the curves present in both rows, scaled by
curves / present curves.  Equal distances go by the smaller donor value, so
the result does not depend on any row order.

Only the curve values matter, so receivers are distinct value tuples, and a
donor tuple counts at most ``k`` times.  Donors with the same present curves
form a pattern; a k-d tree per pattern, cut on a bounded sample, deals its
donors into cells.  For each missing curve a receiver first meets one cell of
donors that have it, which gives an upper bound for its k-th distance, and then
every cell with that curve whose box may hold a nearer donor; the k best of
each cell that lie within the bound merge per receiver.  Cells and their receivers
are split into blocks, so neither a hot cell nor a common value meets in one
task.  Donors travel as one compressed row a block, and receivers are searched in
slices of about ``SENT`` rows, so the disk that a search takes beside its answers
does not grow with the pairs of receivers and cells.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_shuffles, ensure_checkpoint_dir, shared_dir, stored

CELL = 2048        # donors a cell aims at
MAX_CELLS = 4096   # bounds the tree that travels to the tasks
BLOCK = 16384      # most donors, or receivers, of a cell in one task
BOX = 64           # donors of a box inside a cell
CHUNK = 65_536     # rows whose equal tuples meet before they are dealt
SENT = 4_000_000   # rows of receivers and cells that are dealt at once
PAIRS = 1 << 22    # most pairs of receivers and donors that a task holds at once


class _Cells:
    """k-d cells of all donor patterns: lower and upper corners, and the
    pattern (present curves as bits) of each."""

    def __init__(self, counts: dict[int, int], samples: dict[int, np.ndarray], width: int):
        self.counts = counts
        self.pattern, self.low, self.high, self.trees, self.sampled = [], [], [], {}, []
        total = max(1, sum(counts.values()))
        for p, n in sorted(counts.items()):
            dims = [d for d in range(width) if p >> d & 1]
            want = min(-(-n // CELL), max(1, MAX_CELLS * n // total))
            lo, hi = np.full(width, -np.inf), np.full(width, np.inf)
            self.trees[p] = self._grow(p, dims, samples.get(p, np.empty((0, width))), lo, hi, want)
        self.pattern = np.array(self.pattern, np.int64)
        self.low, self.high = np.array(self.low).reshape(-1, width), np.array(self.high).reshape(-1, width)

    def _grow(self, p, dims, points, lo, hi, want):  # noqa: ANN001, ANN202
        if want > 1 and len(points) > 1:
            spread = points[:, dims].max(0) - points[:, dims].min(0)
            d = dims[int(spread.argmax())]
            at = float(np.median(points[:, d]))
            if at >= points[:, d].max():
                at = float(points[points[:, d] < at][:, d].max(initial=-np.inf))
            if np.isfinite(at):
                left = points[:, d] <= at
                hi_left, lo_right = hi.copy(), lo.copy()
                hi_left[d], lo_right[d] = at, at
                return (d, at, self._grow(p, dims, points[left], lo, hi_left, want // 2),
                        self._grow(p, dims, points[~left], lo_right, hi, want - want // 2))
        self.pattern.append(p)
        self.low.append(lo)
        self.high.append(hi)
        self.sampled.append(len(points))
        return len(self.pattern) - 1

    def sizes(self) -> np.ndarray:
        """About how many donors each cell holds, by its share of its pattern's sample."""
        n, of = np.array(self.sampled, float), {p: 0 for p in self.counts}
        for p, k in zip(self.pattern, self.sampled):
            of[int(p)] += k
        return np.array([self.counts[int(p)] * (k / of[int(p)] if of[int(p)] else 1.0) for p, k in zip(self.pattern, n)])

    def home(self, p: int, x: np.ndarray) -> np.ndarray:
        """Cell of each row of ``x`` in the tree of pattern ``p`` (an absent
        curve goes to the lower side)."""
        out = np.full(len(x), -1, np.int32)
        todo = [(self.trees[p], np.arange(len(x)))]
        while todo:
            node, ix = todo.pop()
            if not isinstance(node, tuple):
                out[ix] = node
                continue
            d, at, a, b = node
            right = x[ix, d] > at
            todo += [(a, ix[~right]), (b, ix[right])]
        return out

    def guides(self, have: int, width: int) -> dict[int, int]:
        """For a row with the curves ``have``: the patterns that bound its
        search, each with the missing curves (as bits) it bounds.  A curve goes
        to the complete pattern, else to the most frequent one that has it,
        among those that share a curve with the row."""
        out: dict[int, int] = {}
        for j in range(width):
            able = [p for p in self.counts if p >> j & 1 and p & have]
            if able and not have >> j & 1:
                p = max(able, key=lambda q: (q == (1 << width) - 1, self.counts[q], q))
                out[p] = out.get(p, 0) | 1 << j
        return out

    def within(self, x: np.ndarray, want: np.ndarray, limit: np.ndarray):  # noqa: ANN201
        """Pairs ``(row, cell)``: the cells, of patterns with a wanted curve,
        whose box may hold a donor within a row's limit.  Each tree is descended
        with the rows that its nodes' boxes are near to."""
        have = (~np.isnan(x) << np.arange(x.shape[1])).sum(1)
        rows, cells = [np.empty(0, int)], [np.empty(0, int)]
        for p, tree in self.trees.items():
            both = np.bitwise_count(p & have)
            todo = [(tree, np.full(x.shape[1], -np.inf), np.full(x.shape[1], np.inf), np.flatnonzero((both > 0) & (want & p > 0)))]
            while todo:
                node, lo, hi, ix = todo.pop()
                if not len(ix):
                    continue
                ix = ix[_box_bounds(x[ix], lo, hi, both[ix]) <= limit[ix]]
                if not isinstance(node, tuple):
                    rows.append(ix)
                    cells.append(np.full(len(ix), node))
                    continue
                d, at, a, b = node
                hi_left, lo_right = hi.copy(), lo.copy()
                hi_left[d], lo_right[d] = at, at
                todo += [(a, lo, hi_left, ix), (b, lo_right, hi, ix)]
        return np.concatenate(rows), np.concatenate(cells)


def _box_bounds(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Least scaled squared distance of each row to a point of a box; ``both``:
    how many curves the row shares with the donors there (not 0)."""
    b = np.zeros(len(x))
    for d in np.flatnonzero(np.isfinite(lo) | np.isfinite(hi)):
        gap = np.fmax(0.0, np.maximum(lo[d] - x[:, d], x[:, d] - hi[d]))  # an absent curve: 0
        b += gap * gap
    return b * x.shape[1] / both * (1 - 1e-12)


def _boxes(y: np.ndarray, size: int) -> list[tuple]:
    """The rows of ``y`` (of one pattern) in boxes of about ``size``: their
    numbers and the lower and upper corner."""
    out, todo = [], [np.arange(len(y))]
    dims = np.flatnonzero(~np.isnan(y[0])) if len(y) else []
    while todo:
        ix = todo.pop()
        lo, hi = np.full(y.shape[1], -np.inf), np.full(y.shape[1], np.inf)
        lo[dims], hi[dims] = y[ix][:, dims].min(0), y[ix][:, dims].max(0)
        d = dims[int((hi[dims] - lo[dims]).argmax())]
        if len(ix) <= size or hi[d] == lo[d]:
            out.append((ix, lo, hi))
            continue
        at = np.median(y[ix, d])
        left = y[ix, d] <= at if at < hi[d] else y[ix, d] < at
        todo += [ix[left], ix[~left]]
    return out


def _matrix(t: pa.Table, names: list[str]) -> np.ndarray:
    cols = [t[n].combine_chunks().to_numpy(zero_copy_only=False) if t.num_rows else [] for n in names]
    return np.array(cols, float).T.reshape(-1, len(names))


def _distances(x: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """Scaled squared distances, receivers by donors (infinite: nothing in common)."""
    d2, n = np.zeros((len(x), len(donors))), np.zeros(len(x))
    for d in range(x.shape[1]):
        y = donors[:, d]
        if np.isnan(y).any():  # the cell's pattern lacks this curve
            continue
        seen = ~np.isnan(x[:, d])
        diff = y[None, :] - np.where(seen, x[:, d], 0.0)[:, None]
        diff[~seen] = 0.0
        d2 += np.multiply(diff, diff, out=diff)
        n += seen
    with np.errstate(divide="ignore", invalid="ignore"):
        d2 = d2 * x.shape[1] / n[:, None]
    d2[n == 0] = np.inf
    return d2


@dataclass
class DonorIndex:
    """Donors dealt to cells: ``placed`` is a checkpointed table with a row per
    block of a cell, its distinct donor tuples compressed, read by every search;
    ``tuples`` has the donors' curves; the rest is bounded by the number of cells."""

    names: list
    k: int
    cells: _Cells | None
    placed: DataFrame | None
    blocks: np.ndarray
    means: dict
    tuples: DataFrame


def _feats(names: list) -> list[str]:
    return [f"f{i}" for i in range(len(names))]


def _tuples(d: DataFrame, names: list) -> DataFrame:
    return d.select(*[F.col(c).cast("double").alias(f) for c, f in zip(names, _feats(names))])


def index_donors(donors: DataFrame, features, k: int = 5, sample_rows: int = 200_000) -> DonorIndex:
    """The donors' cells, for any number of ``knn_fill`` calls.

    ``sample_rows`` bounds the donors that the cells are cut on; every donor
    is searched.
    """
    ensure_checkpoint_dir(donors.sparkSession)
    names = list(features)
    feats, width = _feats(names), len(names)
    bits = sum((F.when(F.col(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(feats)), F.lit(0))
    tuples = stored(_tuples(donors, names), "knn-donors")
    src = tuples.withColumn("pattern", bits).where("pattern > 0")
    means = dict(zip(names, src_means(tuples, feats).values()))
    code = F.xxhash64(*feats)
    counts = {r[0]: max(1, r[1]) for r in  # about how many distinct tuples; at most 2^curves rows
              src.groupBy("pattern").agg(F.approx_count_distinct(code, 0.02)).collect()}
    if not counts:
        return DonorIndex(names, k, None, None, np.empty(0, np.int64), means, tuples)
    total = sum(counts.values())
    share = min(1.0, sample_rows / total)
    picked = src.where(F.pmod(code, F.lit(1_000_000)) < int(share * 1_000_000) + 1) if share < 1 else src
    by: dict[int, list] = {}
    for r in picked.select("pattern", *feats).distinct().collect():  # about sample_rows rows
        by.setdefault(r[0], []).append([np.nan if v is None else v for v in r[1:]])
    cells = _Cells(counts, {p: np.array(v, float) for p, v in by.items()}, width)
    blocks = np.maximum(1, -(-cells.sizes() // BLOCK)).astype(np.int64)

    def place(batches):  # noqa: ANN001
        for t in _runs(batches):
            x, n = _distinct(_matrix(t, feats), np.ones(t.num_rows, np.int64))
            p = (~np.isnan(x) << np.arange(width)).sum(1)
            cell = np.full(len(x), -1, np.int32)
            for q in np.unique(p):
                cell[p == q] = cells.home(int(q), x[p == q])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), pa.array(n), pa.array(cell)], [*feats, "n", "cell"])

    def pack(t: pa.Table) -> pa.Table:
        x, n = _distinct(_matrix(t, feats), t["n"].to_numpy())
        data = zlib.compress(np.vstack([x.T, np.minimum(n, k)]).tobytes(), 1)
        return pa.table({"cell": t["cell"].slice(0, 1), "block": t["block"].slice(0, 1), "donors": pa.array([data], pa.binary())})

    fields = ", ".join(f"{f} double" for f in feats)
    placed = (src.mapInArrow(place, f"{fields}, n long, cell int")
              .withColumn("block", F.pmod(code, _by_cell(blocks)).cast("int"))
              .groupBy("cell", "block").applyInArrow(pack, "cell int, block int, donors binary").checkpoint())
    drop_shuffles(donors.sparkSession)
    return DonorIndex(names, k, cells, placed, blocks, means, tuples)


def _by_cell(values) -> F.Column:  # noqa: ANN001
    """The value of a row's cell."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)


def _runs(batches) -> Iterator[pa.Table]:  # noqa: ANN001
    """Batches joined to tables of ``CHUNK`` rows or more, but for the last."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _distinct(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``x``, and the sum of ``n`` over the equal ones."""
    x = x + 0.0
    order = np.lexsort(x.T)
    x = x[order]
    new = np.r_[True, ((x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))).any(1)]
    return x[new], np.add.reduceat(n[order], np.flatnonzero(new))


def knn_impute(df: DataFrame, features, k: int = 5, donors: DataFrame | None = None,
               sample_rows: int = 200_000) -> DataFrame:
    """``df`` with the missing values of ``features`` filled; rows and other
    columns unchanged.  ``donors`` defaults to ``df`` itself.

    ``sample_rows`` bounds the donors that the cells are cut on; every donor
    is searched.  A value without any donor at a known distance takes the
    curve's mean, and stays missing if no donor has the curve.
    """
    index = index_donors(df if donors is None else donors, features, k, sample_rows)
    return knn_fill(df, index, index.tuples if donors is None else None)


def knn_fill(df: DataFrame, index: DonorIndex, tuples: DataFrame | None = None) -> DataFrame:
    """``df`` filled from indexed donors (see ``knn_impute``); what a row gets
    does not depend on the other rows of ``df``.  ``tuples``: its curves, if they
    are stored."""
    if index.cells is None:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    names, k, cells, blocks, means = index.names, index.k, index.cells, index.blocks, index.means
    feats, width = _feats(names), len(names)
    fields = ", ".join(f"{f} double" for f in feats)
    need = (_tuples(df, names) if tuples is None else tuples).where(" or ".join(f"{f} is null" for f in feats)).distinct().checkpoint()

    def send(bounded: bool):  # noqa: ANN202
        """Rows ``(curves, want, cell, block)``; ``want`` has the missing
        curves, as bits, that the row is sent for."""
        def run(batches):  # noqa: ANN001
            for b in batches:
                t = pa.Table.from_batches([b])
                x = _matrix(t, feats)
                row, want, cell, block = [], [], [], []
                if not bounded:
                    have = (~np.isnan(x) << np.arange(width)).sum(1)
                    for h in np.unique(have):
                        at = np.flatnonzero(have == h)
                        for p, curves in cells.guides(int(h), width).items():
                            row.append(at)
                            want.append(np.full(len(at), curves))
                            cell.append(cells.home(p, x[at]))
                            block.append(np.zeros(len(at), int))
                else:
                    limit, curves = t["bound"].to_numpy(), t["want"].to_numpy()
                    i, near = cells.within(x, curves, limit)
                    times = blocks[near]
                    each = np.repeat(np.arange(len(i)), times)
                    row.append(i[each])
                    want.append(curves[i[each]])
                    cell.append(near[each])
                    block.append(np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times))
                row, *rest = [np.concatenate(v).astype(int) if v else np.empty(0, int) for v in (row, want, cell, block)]
                t = t.select([*feats, "bound"] if bounded else feats).take(pa.array(row))
                for name, v in zip(("want", "cell", "block"), rest):
                    t = t.append_column(name, pa.array(v, pa.int32()))
                yield from t.to_batches()
        return run

    def spread(receivers: DataFrame, n: np.ndarray) -> tuple[DataFrame, DataFrame]:
        """Receivers and donors of each (cell, block), receivers cut into parts;
        ``n``: how many receivers each cell has."""
        parts = np.where(n > 0, n // blocks // BLOCK + 1, 0)
        r = receivers.withColumn("part", F.pmod(F.xxhash64(*feats), _by_cell(parts)).cast("int"))
        d = (index.placed.withColumn("parts", _by_cell(parts)).where("parts > 0")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
        return r, d

    def counted(receivers: DataFrame) -> np.ndarray:
        n = np.zeros(len(blocks), np.int64)
        for cell, many in receivers.groupBy("cell").count().collect():  # at most one row per cell
            n[cell] = many
        return n

    def donors_of(d: pa.Table) -> np.ndarray:
        y = [np.empty((0, width))]
        for b in d["donors"].to_pylist():
            *cols, copies = np.frombuffer(zlib.decompress(b)).reshape(width + 1, -1)
            y.append(np.repeat(np.array(cols).T, copies.astype(int), axis=0))
        return np.concatenate(y)

    def distances(r: pa.Table, d: pa.Table):  # noqa: ANN202
        x, y = _matrix(r, feats), donors_of(d)
        step = max(1, 262_144 // max(1, len(y)))  # parts that fit a core's cache
        for at in range(0, len(x) if len(y) else 0, step):
            yield at, x[at:at + step], y, _distances(x[at:at + step], y)

    def kth_of(d2: np.ndarray) -> np.ndarray:
        at = min(k, d2.shape[1]) - 1
        return np.partition(d2, at, axis=1)[:, at]

    keys = [F.col(c) for c in ("cell", "block", "part")]

    def bound(r: pa.Table, d: pa.Table) -> pa.Table:
        out = np.full(r.num_rows, np.inf)
        for at, x, y, d2 in distances(r, d):
            if len(y) >= k:
                out[at:at + len(x)] = kth_of(d2)
        return r.select([*feats, "want"]).append_column("bound", pa.array(out))

    def best(r: pa.Table, d: pa.Table) -> pa.Table:
        rows, curve, dist, value = [], [], [], []
        want, limits = r["want"].to_numpy(), r["bound"].to_numpy()
        x, y = _matrix(r, feats), donors_of(d)
        boxes = _boxes(y, BOX) if len(y) else []
        both = (~np.isnan(x) & ~np.isnan(y[:1])).sum(1) if len(y) else np.zeros(len(x))
        step = max(1, PAIRS // max(1, len(y)))
        for at in range(0, len(x) if len(y) else 0, step):
            part, limit, shared = x[at:at + step], limits[at:at + step], both[at:at + step]
            seen = np.flatnonzero(shared)
            found_ = []
            for ix, lo, hi in boxes:  # k donors with the curve are known to be as near as the limit
                use = seen[_box_bounds(part[seen], lo, hi, shared[seen]) <= limit[seen]]
                few = max(1, 262_144 // len(ix))  # parts that fit a core's cache
                for a in range(0, len(use), few):
                    d2 = _distances(part[use[a:a + few]], y[ix])
                    i, near = np.nonzero(d2 <= limit[use[a:a + few], None])
                    found_.append((use[a:a + few][i], ix[near], d2[i, near]))
            if not found_:
                continue
            i, near, far = (np.concatenate(c) for c in zip(*found_))
            order = np.lexsort((far, i))
            i, near, far = i[order], near[order], far[order]
            n = np.bincount(i, minlength=len(part))
            first = np.cumsum(n) - n
            most = np.full(len(part), np.inf)
            most[n > k] = far[first[n > k] + k - 1]
            kept = (far <= most[i]) & np.isfinite(far)
            i, near, far = i[kept], near[kept], far[kept]
            for j in np.flatnonzero(~np.isnan(y[0])):
                use = np.flatnonzero(want[at + i] >> j & 1)
                v = y[near[use], j]
                order = np.lexsort((v, far[use], i[use]))
                of = i[use][order]
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
                kept = order[np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)])) < k]
                rows.append(at + i[use][kept])
                curve.append(np.full(len(kept), j))
                dist.append(far[use][kept])
                value.append(v[kept])
        rows, curve, dist, value = (np.concatenate(x) if x else np.empty(0) for x in (rows, curve, dist, value))
        start = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (curve[1:] != curve[:-1])]) if len(rows) else np.empty(0, int)
        each = pa.ListArray.from_arrays(pa.array(np.r_[start, len(rows)], pa.int32()), pa.StructArray.from_arrays(
            [pa.array(dist.astype(float)), pa.array(value.astype(float))], ["d2", "v"]))  # a receiver's best for a curve, one row
        return (r.select(feats).take(pa.array(rows[start].astype(np.int64)))
                .append_column("j", pa.array(curve[start].astype(np.int32))).append_column("near", each))

    place_schema = "want int, cell int, block int"
    first = need.mapInArrow(send(False), f"{fields}, {place_schema}")
    r, d = spread(first, counted(first))
    bounds = (r.groupBy(*keys).cogroup(d.where(F.col("block") == 0).groupBy(*keys)).applyInArrow(bound, f"{fields}, want int, bound double")
              .checkpoint())

    def near(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(send(True), f"{fields}, bound double, {place_schema}")

    def filled_of(rows: DataFrame, n: np.ndarray) -> DataFrame:
        r, d = spread(near(rows), n)
        found = r.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(best, f"{fields}, j int, near array<struct<d2: double, v: double>>")
        top = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
        mean = F.aggregate(top, F.lit(0.0), lambda a, s: a + s["v"]) / F.size(top)
        cand = found.groupBy(*feats, "j").agg(mean.alias("fill"))
        return cand.groupBy(*[F.col(f).alias(f"k{f}") for f in feats]).agg(
            *[F.max(F.when(F.col("j") == i, F.col("fill"))).alias(f"fill{i}") for i in range(width)])

    drop_shuffles(df.sparkSession)
    n = counted(near(bounds))
    slices = max(1, -(-int(n.sum()) // SENT))
    if slices == 1:
        fills = filled_of(bounds, n)
    else:
        spark, at = df.sparkSession, shared_dir(df.sparkSession, f"knn-fills-{uuid.uuid4().hex}")
        for i in range(slices):
            some = bounds.where(F.pmod(F.xxhash64(F.lit(1), *feats), F.lit(slices)) == i)
            filled_of(some, -(-n // slices)).write.parquet(f"{at}/{i}")
            drop_shuffles(spark)
        fills = spark.read.parquet(*[f"{at}/{i}" for i in range(slices)])
    cond = None
    for c, f in zip(names, feats):
        same = F.col(f"`{c}`").cast("double").eqNullSafe(F.col(f"k{f}"))
        cond = same if cond is None else cond & same
    has = " or ".join(f"`{c}` is null" for c in names)
    filled = df.where(has).join(fills, cond, "left").withColumns({
        c: F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"fill{i}"), F.lit(means[c])) for i, c in enumerate(names)})
    whole = df.where(f"not ({has})").withColumns({c: F.col(f"`{c}`").cast("double") for c in names})
    return whole.unionByName(filled.select(*df.columns))


def src_means(df: DataFrame, names: list[str]) -> dict:
    r = df.agg(*[F.avg(f"`{c}`").alias(c) for c in names]).first()
    return {c: r[c] for c in names}
