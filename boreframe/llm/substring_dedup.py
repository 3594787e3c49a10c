"""Substring dedup: rolling (Rabin-Karp) hashes of every fixed-length window
of words, counted in Spark; repeated windows merge into maximal intervals.

Plan.  Documents are dealt into units, ranges of the id of a few MB of text.
Each unit hashes all its windows and sends the first one of every hash, in
unit order, to hash buckets.  A bucket holds the hashes of all units in unit
order, so the first entry of a hash there is its first occurrence in the
corpus; the answer to each unit is one bit per hash it sent.  The unit
recomputes its windows (the shuffled text is reused), reads the bits in the
same order and merges covered words into intervals.  A window that a third of
all documents share costs one entry per unit, not one per document, and no
window travels with its position.

Two windows count as equal if 64 bits of one polynomial hash and the bucket of
a second, independent one agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from boreframe.llm.common import doc_order, slices_by, with_units

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so invertible mod 2^64
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """64-bit hashes of words; remembers the first ``limit`` words only."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    down = np.full(n, inverse, np.uint64)
    down[0] = 1
    down = np.cumprod(down)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * down, out=prefix[1:])
    up = np.full(n - width + 1, base, np.uint64)
    up[0] = pow(base, width - 1, 1 << 64)
    return (prefix[width:] - prefix[:-width]) * np.cumprod(up)


class _Unit:
    """Windows of a unit's documents, in (id, position) order."""

    def __init__(self, table: pa.Table, width: int, buckets: int):
        ids, texts = table["id"].to_pylist(), table["text"].to_pylist()
        cache = WordHashes()
        order = doc_order(ids, texts)
        self.ids = [ids[i] for i in order]
        self.words = [texts[i].encode().split() for i in order]
        sizes = [len(w) for w in self.words]
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        total = int(self.ends[-1]) if sizes else 0
        values = np.fromiter((cache[w] for ws in self.words for w in ws), np.uint64, total)
        same = {}  # windows do not cross documents; equal (id, text) rows count once
        ok = np.zeros(max(0, total - width + 1), bool)
        self.twin = list(range(len(order)))
        for k, i in enumerate(order):
            first = same.setdefault((ids[i], texts[i]), k)
            self.twin[k] = first
            if first == k and sizes[k] >= width:
                ok[self.begins[k]:self.ends[k] - width + 1] = True
        self.starts = np.flatnonzero(ok)
        h = _mix(rolling(values, width, _BASES[0])[self.starts])
        b = _mix(rolling(values, width, _BASES[1])[self.starts])
        _, first = np.unique(h, return_index=True)
        self.sent = np.sort(first)
        self.hashes = h[self.sent]
        spread = (b[self.sent] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        self.order, self.runs = slices_by(spread.astype(np.int64))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 20, unit_bytes: int = 4_000_000,
                    bucket_windows: int = 1_000_000) -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``n_removed``,
    ``kept_text`` (kept words joined by one space) and ``removed``, the
    maximal removed word intervals ``[start, end)``.

    A word goes if a ``width``-word window over it also starts earlier
    (smaller id, or same id and earlier start) anywhere in the corpus.

    Null or empty text: no words, empty ``kept_text``.  Null id: sorts before
    all ids.  Repeated rows (same id and text) are one document and each gets
    its result; rows that share only the id order by text.  Empty table: no
    rows.  Fewer words than ``width``: nothing is removed.
    """
    units, _, total = with_units(docs, id_col, text_col, unit_bytes)
    buckets = max(24, math.ceil(total / 6 / bucket_windows))

    def send(table: pa.Table) -> pa.Table:
        u = _Unit(table, width, buckets)
        h = u.hashes[u.order]
        unit = table["unit"][0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array([k for k, _, _ in u.runs], pa.int32()),
                         "unit": pa.array([unit] * len(u.runs), pa.int32()),
                         "hashes": pa.array([h[a:b].tobytes() for _, a, b in u.runs], pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        t = table.sort_by("unit")
        parts = [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()]
        every = np.concatenate(parts)
        _, first = np.unique(every, return_index=True)
        again = np.ones(len(every), bool)
        again[first] = False
        out, at = [], 0
        for unit, bucket, p in zip(t["unit"].to_pylist(), t["bucket"].to_pylist(), parts):
            bits = again[at:at + len(p)]
            at += len(p)
            if bits.any():
                out.append((unit, bucket, np.packbits(bits).tobytes()))
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({"unit": pa.array(cols[0], pa.int32()), "bucket": pa.array(cols[1], pa.int32()),
                         "bits": pa.array(cols[2], pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        u = _Unit(table, width, buckets)
        gone = np.ones(len(u.starts), bool)  # a hash seen before in the unit
        gone[u.sent] = False
        runs = {k: (a, b) for k, a, b in u.runs}
        for bucket, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist()):
            a, b = runs[bucket]
            yes = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
            gone[u.sent[u.order[a:b][yes]]] = True
        size = int(u.ends[-1]) if len(u.ends) else 0
        step = np.zeros(size + 1, np.int64)
        np.add.at(step, u.starts[gone], 1)
        np.add.at(step, u.starts[gone] + width, -1)
        covered = np.cumsum(step[:-1]) > 0
        rows = {"id": [], "n_words": [], "n_removed": [], "kept_text": [], "removed": []}
        for k, words in enumerate(u.words):
            t = u.twin[k]
            c = covered[u.begins[t]:u.ends[t]]
            edges = np.flatnonzero(np.diff(np.r_[False, c, False])).tolist()
            kept, at = [], 0
            for s, e in zip(edges[::2], edges[1::2]):
                kept += words[at:s]
                at = e
            kept += words[at:]
            rows["id"].append(u.ids[k])
            rows["n_words"].append(len(words))
            rows["n_removed"].append(len(words) - len(kept))
            rows["kept_text"].append(b" ".join(kept).decode())
            rows["removed"].append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = {"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(),
                 "kept_text": pa.string(), "removed": span}
        return pa.table({k: pa.array(v, types[k]) for k, v in rows.items()})

    bits = (units.groupBy("unit").applyInArrow(send, "bucket int, unit int, hashes binary")
            .groupBy("bucket").applyInArrow(judge, "unit int, bucket int, bits binary"))
    out = units.groupBy("unit").cogroup(bits.groupBy("unit")).applyInArrow(
        finish, "id long, n_words long, n_removed long, kept_text string, "
                "removed array<struct<start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)
