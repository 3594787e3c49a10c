"""Alignment of two tokenizers over a corpus by white-space anchors.

Every text is tokenised in full by a byte-level BPE (A, with a space in front)
and by a SentencePiece model (B, which adds that space).  Where a space-marked
token of A and one of B start at the same byte, both have an end before it;
these shared ends cut the document into windows of token ids.  A window's
alignment depends on its ids alone, so it is worked out once for each distinct
pair of id tuples of a unit, of all of them together: set side by side, windows
are like one long text.

Documents are worked off in units of bounded text.  A unit's table says which
windows its documents hold and which id pairs a window links; the pairs of all
units are counted in Spark, and every unit gets the counts of its pairs back.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreframe.session import shared_dir

_UNIT = ("unit long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
         "windows array<int>, starts array<int>, links array<int>, pairs array<long>, counts array<long>")


class Vocabularies:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, a_file: str, b_file: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(public_tokenizers.path(a_file), "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.a_bytes[r] = t
        self.a_ids = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={}).encode_ordinary
        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_file))
        self.b_ids = lambda texts: sp.encode(texts, num_threads=1)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
                        for i in range(sp.get_piece_size()) for p in [sp.id_to_piece(i)]]
        self.a_len, self.b_len = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.size = max(len(self.a_bytes), len(self.b_bytes))
        self.marked = [f"{mark}{i}" for mark in (",", "|", ";", "\n") for i in range(self.size)]
        self.a_space, self.b_space = (np.array([x[:1] == b" " for x in t]) for t in (self.a_bytes, self.b_bytes))

    def encode(self, text: str, b: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
        """Both id arrays, or None if a tokenizer does not give the text back."""
        want = (" " + text).encode()
        if b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        a = np.array(self.a_ids(" " + text), "<u4")  # these are cut from the text's bytes, so only some could be missing
        return (a, np.array(b, "<u4")) if self.a_len[a].sum() == len(want) else None

    def windows(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """Where the windows begin in ``a`` and in ``b`` (and, last, their ends):
        at offset 0 and at every shared end before two space-marked tokens."""
        at_a, at_b = (np.cumsum(n[x]) - n[x] for n, x in ((self.a_len, a), (self.b_len, b)))
        marked_a, marked_b = np.flatnonzero(self.a_space[a]), np.flatnonzero(self.b_space[b])
        _, i, j = np.intersect1d(at_a[marked_a], at_b[marked_b], assume_unique=True, return_indices=True)
        i, j = marked_a[i], marked_b[j]
        if not len(i) or i[0] or j[0]:
            i, j = np.r_[0, i], np.r_[0, j]
        return [*i.tolist(), len(a)], [*j.tolist(), len(b)]

    def align(self, a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of windows given by their id bytes: where each one's links begin (and,
        last, their end), the links as ``a * (ids of B) + b``, the number of its
        groups, and its text ``a1,a2|b1;a3|b2,b3``.

        Every stretch between neighbouring token ends, of either side, is a link
        of the two tokens that hold it.
        """
        x, y = (np.frombuffer(b"".join(w), "<u4").astype(np.int64) for w in (a, b))
        end_x, end_y = np.cumsum(self.a_len[x]), np.cumsum(self.b_len[y])
        ends = np.union1d(end_x, end_y)
        links = x[np.searchsorted(end_x, ends)] * len(self.b_bytes) + y[np.searchsorted(end_y, ends)]
        last_x, last_y = (np.cumsum([len(w) // 4 for w in side]) for side in (a, b))  # tokens up to a window's end
        starts = np.r_[0, np.searchsorted(ends, end_x[last_x - 1]) + 1]
        _, cut_x, cut_y = np.intersect1d(end_x, end_y, assume_unique=True, return_indices=True)
        n_groups = np.diff(np.r_[0, np.searchsorted(cut_x, last_x - 1) + 1])
        # a window's first token follows a line feed, the first of A in a later group ";", the first of B "|", others ","
        mark_x, mark_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        mark_x[np.r_[0, cut_x[:-1] + 1]] = 2
        mark_y[np.r_[0, cut_y[:-1] + 1]] = 1
        mark_x[np.r_[0, last_x[:-1]]] = 3
        of_x, of_y = (np.searchsorted(c, np.arange(len(side))) for c, side in ((cut_x, x), (cut_y, y)))  # groups
        order = np.argsort(np.r_[2 * of_x, 2 * of_y + 1], kind="stable")
        codes = np.r_[mark_x * self.size + x, mark_y * self.size + y][order]
        return starts, links, n_groups, "".join(map(self.marked.__getitem__, codes.tolist()))[1:].split("\n")


class Unit:
    """The documents of a unit and the distinct windows they hold."""

    def __init__(self, name: int, words: Vocabularies, keep_groups: bool):
        self.name, self.words, self.keep_groups = name, words, keep_groups
        self.index: dict = {}  # window (id bytes of both sides) -> number
        self.rows: list = []   # id, tokens of A and of B, windows
        self.chars = 0

    def add(self, doc_id, text: str | None, b: list[int]) -> None:  # noqa: ANN001
        ids = self.words.encode(text, b) if text else None
        if ids is None:
            self.rows.append((doc_id, 0, 0, np.zeros(0, np.int32)))
            return
        self.chars += len(text)
        i, j = self.words.windows(*ids)
        a, b = (x.tobytes() for x in ids)
        index = self.index
        windows = [index.setdefault((a[4 * p:4 * q], b[4 * r:4 * s]), len(index))
                   for p, q, r, s in zip(i, i[1:], j, j[1:])]
        self.rows.append((doc_id, len(ids[0]), len(ids[1]), np.array(windows, np.int32)))

    def batches(self):  # noqa: ANN201
        """One row per document, and one (without document columns) for the unit."""
        names = [c.split()[0] for c in _UNIT.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.int32())] * 3 + [pa.list_(pa.int64())] * 2

        def listed(x, kind):  # noqa: ANN001, ANN202
            return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))

        if self.index:
            keys = list(self.index)
            starts, links, n_groups, texts = self.words.align([k[0] for k in keys], [k[1] for k in keys])
            pairs, links = np.unique(links, return_inverse=True)
            times = np.bincount(np.concatenate([r[3] for r in self.rows]), minlength=len(keys))
            counts = np.bincount(links, np.repeat(times, np.diff(starts)), len(pairs)).astype(np.int64)
            n_links = np.diff(starts)
            lists = [listed(starts, pa.int32()), listed(links, pa.int32()), listed(pairs, pa.int64()), listed(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.name], pa.int64()), *(pa.nulls(1, k) for k in kinds[1:9]), *lists], names)
        for at in range(0, len(self.rows), 2000):
            part = self.rows[at:at + 2000]
            ids, n_a, n_b, windows = zip(*part)
            groups = [";".join([texts[w] for w in ws.tolist()]) for ws in windows]
            sizes = np.array([len(w) for w in windows])
            yield pa.RecordBatch.from_arrays([
                pa.array([self.name] * len(part), pa.int64()), pa.array(ids, pa.int64()), pa.array(n_a, pa.int64()),
                pa.array(n_b, pa.int64()), pa.array([int(n_groups[w].sum()) if len(w) else 0 for w in windows], pa.int64()),
                pa.array([int(n_links[w].sum()) if len(w) else 0 for w in windows], pa.int64()),
                pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
                pa.array(groups if self.keep_groups else [None] * len(part), pa.string()),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(windows), pa.int32())),
                *(pa.nulls(len(part), k) for k in kinds[9:])], names)


def write_units(docs: DataFrame, id_col: str, text_col: str, a_vocabulary: str, b_vocabulary: str,
                unit_chars: int, keep_groups: bool) -> str:
    """Tokenises and aligns all documents, in units of about ``unit_chars``
    characters; returns the folder of the units' table."""
    def run(batches):  # noqa: ANN001, ANN202
        from pyspark import TaskContext
        words = Vocabularies(a_vocabulary, b_vocabulary)
        name = TaskContext.get().partitionId() << 32
        unit = Unit(name, words, keep_groups)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few texts at a time: their id lists are large
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for i, t, b in zip(part.column(0).to_pylist(), texts, words.b_ids(texts)):
                    unit.add(i, t, b)
                    if unit.chars >= unit_chars:
                        yield from unit.batches()
                        name += 1
                        unit = Unit(name, words, keep_groups)
        if unit.rows:
            yield from unit.batches()

    path = shared_dir(docs.sparkSession, f"aligned-{uuid.uuid4().hex}")
    (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
     .mapInArrow(run, _UNIT).write.parquet(path))
    return path


def pair_counts(units: DataFrame, b_size: int) -> DataFrame:
    """``(pair, count, best)``: how many links of the corpus hold an id pair,
    and whether no pair with the same B id has more.  At most as many rows as
    there are id pairs; a B id meets at most one row per A id in a task."""
    each = units.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    total = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair") % b_size))
    return total.withColumn("best", F.col("count") == most)


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     a_vocabulary: str = "byte_bpe_50k.tiktoken", b_vocabulary: str = "piece_bpe_32k.model",
                     keep_groups: bool = False, unit_chars: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)``.

    Documents, one row for each of ``docs``: ``id_col, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256`` and, with ``keep_groups``, the
    alignment itself, ``groups``.  Pairs: ``a_id, b_id, count, best``.

    A null or empty text, or one that a tokenizer's bytes do not give back (as
    with U+2581 in it), has no tokens: zeros and ''.  Ids are kept as they are,
    null and repeated ones too; repeated rows count as often as they occur.
    Empty table: no rows.  A text is never cut: one longer than ``unit_chars``
    is a unit, and one without anchors a window.
    """
    b_size = len(Vocabularies(a_vocabulary, b_vocabulary).b_bytes)
    units = docs.sparkSession.read.schema(_UNIT).parquet(
        write_units(docs, id_col, text_col, a_vocabulary, b_vocabulary, unit_chars, keep_groups))
    stats = pair_counts(units, b_size)
    asked = units.where("pairs is not null").select("unit", F.posexplode("pairs").alias("pos", "pair"))
    answers = asked.join(stats, "pair").select(F.col("unit").alias("of"), "pos", "count", "best")
    out_schema = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"

    out_names = [c.split()[0] for c in out_schema.split(", ")]

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        told = left.column("pairs").is_valid()
        unit, rows = left.filter(told), left.filter(pc.invert(told))
        if not unit.num_rows:  # no document of this unit has tokens
            zero = pa.array(np.zeros(rows.num_rows, np.int64))
            return pa.table([*(rows.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")), zero, zero,
                             rows.column("groups_sha256"), rows.column("groups")], names=out_names)
        starts, links = (unit.column(c)[0].values.to_numpy() for c in ("starts", "links"))
        pos = right.column("pos").to_numpy()
        best, count = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
        best[pos] = right.column("best").to_numpy()
        count[pos] = right.column("count").to_numpy()
        per_window = [np.diff(np.r_[0, np.cumsum(x[links])][starts]) for x in (best, count)]
        windows = rows.column("windows").combine_chunks()
        sizes = windows.value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        flat = windows.flatten().to_numpy()
        sums = [np.diff(np.r_[0, np.cumsum(w[flat])][np.r_[0, ends]]) for w in per_window]
        return pa.table([*(rows.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")),
                         *(pa.array(s, pa.int64()) for s in sums), rows.column("groups_sha256"), rows.column("groups")],
                        names=out_names)

    done = units.drop("counts").groupBy("unit").cogroup(answers.groupBy("of")).applyInArrow(settle, out_schema)
    done = done if keep_groups else done.drop("groups")
    pairs = stats.select(F.expr(f"pair div {b_size}").alias("a_id"), (F.col("pair") % b_size).alias("b_id"), "count", "best")
    return done.withColumnRenamed("id", id_col), pairs
