"""Best-fit packing of documents into fixed-length token sequences by
large-item matching.

Tokens are counted in one pass over the texts, which leaves a narrow table of
pieces.  Pieces of one length are interchangeable, so the packing itself needs
only how many pieces there are of each length (at most ``capacity`` numbers,
whatever the input): ``plan`` decides on runs of equal bins, and every piece
finds its place by its length and its rank among the pieces of that length.
Ranks are numbered within (length, salt) groups, so a length that holds a
third of all pieces is not ordered by one task.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreframe.llm.common import cut

_SAFE_CUT = re.compile(r"(?<=\S)(?= )")
_LOOSE_SPACE = re.compile(r"\s ")


class PieceIds(dict):
    """Token ids, as little-endian 32-bit bytes, of text chunks.  A chunk
    starts at a space that follows a non-space, where the tokenizer's own
    pre-tokenizer always starts a token, so chunks can be looked up alone.
    Remembers the first ``limit`` distinct short chunks."""

    limit = 250_000

    def __init__(self, rank_file: str):
        import base64

        import public_tokenizers
        import tiktoken
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN,
                                        mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(chunk), "<u4").tobytes()
        if len(self) < self.limit and len(chunk) < 40:
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if _LOOSE_SPACE.search(text) or text[0] == " ":
            chunks = _SAFE_CUT.split(text)
            return b"".join([self[c] for c in chunks])
        head, *rest = text.split(" ")
        return b"".join([self[head], *[self[" " + c] for c in rest]])


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int,
                 vocabulary: str) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: every document's ids and the
    end id, cut into pieces; only the first may be short."""
    def run(batches):  # noqa: ANN001
        import public_tokenizers
        known = PieceIds(public_tokenizers.path(vocabulary))
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = known.ids(t.as_py() or "") + end
                n = len(ids) // 4
                at, size = 0, n % capacity or capacity
                for k in range(-(-n // capacity)):
                    out.append((i, k, at, size, zlib.crc32(ids[4 * at:4 * (at + size)])))
                    at, size = at + size, capacity
            c = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])],
                ["id", "piece", "start", "length", "ids_crc32"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long"))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, pieces, first bin, pieces per bin, offset)``
    that place every piece.

    Lengths over a third of the capacity go first, longest first, at most two
    to a bin: each takes the longest partner that still fits.  The others,
    longest first, best-fit the smallest gap that holds them, and open bins
    when there is none.  All steps move whole runs of equal bins.
    """
    left = {n: c for n, c in counts.items() if c}
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list] = defaultdict(list)  # gap -> runs (first bin, bins)
    sizes: list[int] = []  # the gaps that have runs, sorted
    runs, bins = [], 0

    def place(length: int, pieces: int, first_bin: int, per_bin: int, offset: int) -> None:
        runs.append((length, used[length], pieces, first_bin, per_bin, offset))
        used[length] += pieces

    def leave(gap: int, first_bin: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first_bin, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= min(n, capacity - n) and left[m] > (m == n)), None)
            if mate is None:
                k = left[n]
                place(n, k, bins, 1, 0)
                leave(capacity - n, bins, k)
                left[n] = 0
            elif mate == n:
                k = left[n] // 2
                place(n, 2 * k, bins, 2, 0)
                leave(capacity - 2 * n, bins, k)
                left[n] -= 2 * k
            else:
                k = min(left[n], left[mate])
                place(n, k, bins, 1, 0)
                place(mate, k, bins, 1, n)
                leave(capacity - n - mate, bins, k)
                left[n] -= k
                left[mate] -= k
            bins += k
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(sizes, n)
            if at == len(sizes):
                gap, first, have = capacity, bins, -(-left[n] // (capacity // n))
                bins += have
            else:
                gap = sizes[at]
                first, have = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            per = gap // n
            full = min(have, left[n] // per)
            if full:
                place(n, full * per, first, per, capacity - gap)
                leave(gap - per * n, first, full)
                left[n] -= full * per
            rest = left[n] if full < have and left[n] < per else 0
            if rest:
                place(n, rest, first + full, rest, capacity - gap)
                leave(gap - rest * n, first + full, 1)
                left[n] = 0
            leave(gap, first + full + bool(rest), have - full - bool(rest))
    return runs


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
         end_id: int = 2, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32,
    sequence_id, offset``.

    Documents up to ``capacity`` tokens (with their end token) stay whole;
    longer ones are cut into full pieces after a first one that may be short.
    Null or empty text: one piece with the end token.  Repeated rows are
    packed as often as they occur; a null id is kept.  Empty table: no rows.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, id_col, text_col, capacity, end_id, vocabulary))
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # <= capacity rows
    runs = plan(counts, capacity)
    salts = math.isqrt(max(counts.values(), default=0)) + 1  # as many groups of a length as rows in one
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)))
    shares = cut(salted.groupBy("length", "salt").count())
    base = cut(shares.select("length", "salt", (F.sum("count").over(
        Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("base")))
    ranked = salted.withColumn("r", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("id", "piece")) - 1)
    slots = F.broadcast(spark.createDataFrame(  # a few runs per length: bounded by the capacity
        runs, "s_length long, s_rank long, s_pieces long, s_bin long, s_per long, s_offset long"))
    place = F.col("rank") - F.col("s_rank")
    return (ranked.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("r"))
            .join(slots, (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_rank"))
                  & (F.col("rank") < F.col("s_rank") + F.col("s_pieces")))
            .select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
                    (F.col("s_bin") + F.floor(place / F.col("s_per"))).alias("sequence_id"),
                    (F.col("s_offset") + F.pmod(place, F.col("s_per")) * F.col("length")).alias("offset")))
