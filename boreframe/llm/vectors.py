"""Integer vectors for the two exact searches over embeddings.

A component ``x`` becomes ``floor(256 * x)`` (``x`` as double), kept within
+-2**62.  Rows whose vector is null, or holds a null, a NaN or an infinity take
no part.  Shorter vectors count as padded with zeros (an empty one is all
zeros).  A row is told from its repetitions by a row number, ``rid``, fixed by
a checkpoint; a row whose id is null takes part and sorts behind all ids.
Scores that a long cannot hold are kept at its limits, and rank as equal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreframe.llm.common import cut

LIMIT = 2.0 ** 62
#: below every score
NONE = -(2 ** 63 - 1)


def _parse(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows of a list column take part, and the integers of those."""
    offsets = column.offsets.to_numpy()
    x = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.r_[0, np.cumsum(~np.isfinite(x))]
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    with np.errstate(invalid="ignore", over="ignore"):
        q = np.clip(np.floor(256 * x), -LIMIT, LIMIT)
    q = np.where(np.isfinite(q), q, 0).astype(np.int64)
    return good, [q[a:b] for a, b, ok in zip(offsets[:-1], offsets[1:], good) if ok]


def _matrix(rows: list[np.ndarray], dim: int, kind: str = "<i8") -> np.ndarray:
    out = np.zeros((len(rows), dim), kind)
    if rows and all(len(r) == dim for r in rows):
        out[:] = np.stack(rows)
    else:
        for i, r in enumerate(rows):
            out[i, :len(r)] = r
    return out


@dataclass
class Space:
    """What a search knows of its vectors: rows, dimensions, the integer type
    that holds every component, the range of each dimension, and a bound on
    every inner product."""

    rows: int
    dim: int
    kind: str
    lo: np.ndarray
    hi: np.ndarray
    norm2: float

    def unpack(self, column) -> np.ndarray:
        """Rows of a binary column as a matrix."""
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(-1, self.dim)

    def dots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products, all rows of ``a`` by all rows of ``b``."""
        if self.norm2 < 2.0 ** 23:  # partial sums stay below the product of the norms, so they are exact
            return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
        if self.norm2 < 2.0 ** 52:
            return a.astype(np.float64) @ b.astype(np.float64).T
        if self.norm2 < 2.0 ** 62:
            return a.astype(np.int64) @ b.astype(np.int64).T
        top = 2 ** 63 - 1  # such a score is kept within the range of a long
        full = a.astype(object) @ b.astype(object).T
        return np.clip(full, -top, top).astype(np.int64)


def space_of(vectors: DataFrame) -> Space:
    """One pass over ``vectors`` (a column ``v``).  Each task folds its rows to one
    row per dimension; the driver gets one row per dimension."""
    def fold(batches):  # noqa: ANN001
        n, norm2 = 0, 0.0
        lo = hi = np.zeros(0, np.int64)
        for b in batches:
            _, rows = _parse(b.column(0))
            if not rows:
                continue
            dim = max(len(lo), *(len(r) for r in rows))
            m = _matrix(rows, dim)
            pad = np.zeros(dim - len(lo), np.int64)
            lo = np.minimum(np.r_[lo, pad], m.min(0)) if n else m.min(0)
            hi = np.maximum(np.r_[hi, pad], m.max(0)) if n else m.max(0)
            n += len(rows)
            norm2 = max(norm2, float((m.astype(float) ** 2).sum(1).max()))
        if n:  # position -1 carries the counts; a dimension some rows lack reaches 0 in them
            yield pa.RecordBatch.from_pydict({
                "pos": pa.array(np.r_[-1, np.arange(len(lo))], pa.int32()), "n": pa.array(np.r_[n, np.zeros(len(lo), int)]),
                "norm2": pa.array(np.r_[norm2, np.zeros(len(lo))]), "lo": pa.array(np.r_[0, lo]), "hi": pa.array(np.r_[0, hi])})

    got = (vectors.select(F.col("v").cast("array<double>"))
           .mapInArrow(fold, "pos int, n long, norm2 double, lo long, hi long")
           .groupBy("pos").agg(F.sum("n"), F.max("norm2"), F.min("lo"), F.max("hi"), F.count("*")).collect())
    by = {r[0]: r for r in got}
    if -1 not in by:
        return Space(0, 0, "<i2", np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0)
    dim = len(by) - 1
    if not dim:  # only empty vectors
        return Space(int(by[-1][1]), 1, "<i2", np.zeros(1, np.int64), np.zeros(1, np.int64), 0.0)
    parts = by[-1][5]
    lo, hi = (np.array([(min if c == 3 else max)(by[d][c], by[d][c] if by[d][5] == parts else 0)
                        for d in range(dim)], np.int64) for c in (3, 4))
    peak = max(abs(int(x)) for x in (*lo, *hi))
    kind = "<i2" if peak < 2 ** 15 else "<i4" if peak < 2 ** 31 else "<i8"
    return Space(int(by[-1][1]), dim, kind, lo, hi, by[-1][2] * (1 + 1e-9))


def int_rows(df: DataFrame, space: Space, extra, schema: str) -> DataFrame:
    """``(rid, id, label, vec, ...)`` of the rows that take part, checkpointed;
    ``df`` has ``id``, ``label`` and ``v``.  ``extra(ids, matrix)`` adds columns."""
    def run(batches):  # noqa: ANN001
        for b in batches:
            good, rows = _parse(b.column(2))
            m = _matrix(rows, space.dim, space.kind)
            mask = pa.array(good)
            ids, labels = b.column(0).filter(mask), b.column(1).filter(mask)
            yield pa.RecordBatch.from_arrays(
                [ids, labels, pa.array([r.tobytes() for r in m], pa.binary()), *extra(ids, m)], names)

    names = ["id", "label", "vec", *[c.split()[0] for c in schema.split(",") if c.strip()]]
    out = (df.select("id", "label", F.col("v").cast("array<double>"))
           .mapInArrow(run, "id long, label long, vec binary" + (", " + schema if schema else "")))
    return cut(out.withColumn("rid", F.monotonically_increasing_id()))


@dataclass
class Packed:
    """A block of rows as arrays, in the order in which equal scores rank: known
    ids first, by id, then by row number."""

    rid: np.ndarray
    id: np.ndarray
    known: np.ndarray
    label: np.ndarray
    vec: np.ndarray

    @classmethod
    def of(cls, t: pa.Table, space: Space) -> Packed:
        """Of a table with one row per vector."""
        ids = t.column("id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        rid = t.column("rid").to_numpy()
        label = t.column("label").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        p = cls(rid, ids, known, label, space.unpack(t.column("vec")))
        return p.take(np.lexsort((rid, ids, ~known)))

    def take(self, at: np.ndarray) -> Packed:
        return Packed(self.rid[at], self.id[at], self.known[at], self.label[at], self.vec[at])

    def to_bytes(self) -> list[bytes]:
        return [np.ascontiguousarray(x).tobytes() for x in (self.rid, self.id, self.known, self.label, self.vec)]

    @classmethod
    def from_bytes(cls, parts: list[bytes], space: Space) -> Packed:
        kinds = (np.int64, np.int64, bool, np.int64, space.kind)
        *rest, vec = (np.frombuffer(b, k) for b, k in zip(parts, kinds))
        return cls(*rest, vec.reshape(len(rest[0]), space.dim))


#: columns of a packed block
PACKED = ["rids", "ids", "knowns", "labels", "vecs"]
PACKED_SCHEMA = ", ".join(f"{c} binary" for c in PACKED)


def blocks_of(batches, rows: int, cell: str | None = None):  # noqa: ANN001, ANN201
    """Cuts a sorted stream of Arrow batches into tables of at most ``rows`` rows,
    also wherever ``cell`` changes."""
    held: list[pa.Table] = []
    size = 0
    for b in batches:
        t = pa.Table.from_batches([b])
        at = 0
        while at < t.num_rows:
            end = min(t.num_rows, at + rows - size)
            if cell is not None:
                c = t.column(cell).to_numpy()
                now = held[0].column(cell)[0].as_py() if held else c[at]
                other = np.flatnonzero(c[at:end] != now)
                end = at + int(other[0]) if len(other) else end
            if end > at:
                held.append(t.slice(at, end - at))
                size += end - at
            full = size == rows or end < t.num_rows
            at = end
            if full and size:
                yield pa.concat_tables(held)
                held, size = [], 0
    if size:
        yield pa.concat_tables(held)


def best_per_row(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row, the columns of its ``k`` highest scores (fewer, if there are
    fewer columns), equal scores by column."""
    n = scores.shape[1]
    k = min(k, n)
    if scores.dtype == np.float64 and n <= 4096:  # score and column in one exact number
        finite = np.isfinite(scores)
        peak = np.abs(np.where(finite, scores, 0)).max(initial=0)
        if peak < 2.0 ** 40:
            key = np.where(finite, scores, -(2.0 ** 40)) * 4096 + (4095 - np.arange(n))
            at = np.argpartition(key, n - k, axis=1)[:, n - k:]
            return np.take_along_axis(at, np.argsort(-np.take_along_axis(key, at, 1), axis=1), 1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]
