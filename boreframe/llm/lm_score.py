"""Language-model scores: a subword lattice, and a word unigram as base.

Model.  The pieces of a public subword vocabulary are kept as they are; their
weights are relative frequencies (plus one) of the vocabulary's own
segmentation of all training words, with one end symbol per training document.
The probability of a text is the sum over all segmentations of its words into
pieces, which no piece crosses, so it is the product of one lattice sum per
word and the end's weight.  The lattice of a word is summed by the forward
recursion in log space.  Characters without a piece fall back to byte pieces.

Plan.  Counting: every task sends its distinct training words with counts to
hash buckets (a frequent word costs one entry per task batch).  The count
table is checkpointed; two sums over it give the piece weights (at most one
number per vocabulary entry) and the corpus totals.  Scoring: documents are
dealt into units; a unit asks the buckets for its distinct words once and gets
counts and lattice sums back in the order it asked.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreframe.llm.common import cut, doc_order, slices_by, with_units

_MARK = "▁"  # begins a word in the vocabulary


def _pieces(path: str):  # noqa: ANN202
    import public_tokenizers
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(path))


def _to_buckets(words: list[bytes], buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    h64 = xxhash.xxh64_intdigest
    return slices_by(np.array([h64(w, 7) % buckets for w in words], np.int64))


class Lattice:
    """Sum over all segmentations of a word, as a natural logarithm."""

    def __init__(self, vocabulary: str, weights: dict[int, float]):
        sp = _pieces(vocabulary)
        self.trie: dict = {}
        self.bytes = [0.0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(text[1:-1], 16)] = weights[i]
                continue
            node = self.trie
            for ch in text:
                node = node.setdefault(ch, {})
            node[""] = weights[i]

    def logp(self, word: str) -> float:
        text = _MARK + word
        n = len(text)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        exp, log, trie = math.exp, math.log, self.trie
        for i in range(n):
            terms = into[i]
            if len(terms) == 1:
                a = terms[0]
            else:
                m = max(terms)
                a = m + log(sum([exp(t - m) for t in terms]))
            into[i] = ()
            node, j, alone = trie, i, True
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                if "" in node:
                    into[j].append(a + node[""])
                    alone = alone and j != i + 1
            if alone:  # no piece for this single character
                into[i + 1].append(a + sum([self.bytes[b] for b in text[i].encode()]))
        m = max(into[n])
        return m + log(sum([exp(t - m) for t in into[n]]))


def word_counts(docs: DataFrame, buckets: int, vocabulary: str, batch_words: int = 200_000) -> DataFrame:
    """``(bucket, words, counts, tokens, distinct, pieces)`` of the texts in
    ``docs(text)``: every distinct word once, in its hash bucket, with its
    count; ``pieces`` counts the vocabulary's segmentation of those words."""
    def send(batches):  # noqa: ANN001
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen)
            counts = np.fromiter(seen.values(), "<i8", len(words))
            order, runs = _to_buckets(words, buckets)
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in runs], pa.int32()),
                 pa.array([b" ".join([words[i] for i in order[a:b]]) for _, a, b in runs], pa.binary()),
                 pa.array([counts[order[a:b]].tobytes() for _, a, b in runs], pa.binary())],
                ["bucket", "words", "counts"])

        for b in batches:
            for t in b.column(0):
                seen.update((t.as_py() or "").encode().lower().split())
                if len(seen) > batch_words:
                    yield flush()
        if seen:
            yield flush()

    memo: dict = {}  # one model per task

    def merge(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for words, counts in zip(table["words"].to_pylist(), table["counts"].to_pylist()):
            for w, c in zip(words.split(b" "), np.frombuffer(counts, "<i8").tolist()):
                total[w] = total.get(w, 0) + c
        sp = memo.get("sp") or memo.setdefault("sp", _pieces(vocabulary))
        words = list(total)
        pieces = np.zeros(sp.get_piece_size(), np.int64)
        for at in range(0, len(words), 5000):
            part = words[at:at + 5000]
            ids = sp.encode([w.decode() for w in part], num_threads=1)
            each = np.repeat([total[w] for w in part], [len(x) for x in ids])
            np.add.at(pieces, np.array([i for x in ids for i in x], np.int64), each)
        used = np.flatnonzero(pieces)
        return pa.table({
            "bucket": pa.array([table["bucket"][0].as_py()], pa.int32()),
            "words": pa.array([b" ".join(words)], pa.binary()),
            "counts": pa.array([np.fromiter(total.values(), "<i8", len(total)).tobytes()], pa.binary()),
            "tokens": pa.array([sum(total.values())], pa.int64()),
            "distinct": pa.array([len(total)], pa.int64()),
            "pieces": pa.array([[{"id": int(i), "n": int(pieces[i])} for i in used]],
                               pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())])))})

    return (docs.select("text").mapInArrow(send, "bucket int, words binary, counts binary")
            .groupBy("bucket").applyInArrow(merge, "bucket int, words binary, counts binary, tokens long, "
                                                   "distinct long, pieces array<struct<id:int,n:long>>"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7,
              held_fold: int = 2, vocabulary: str = "piece_bpe_32k.model",
              unit_bytes: int = 4_000_000, bucket_bytes: int = 6_000_000) -> DataFrame:
    """One row per document: ``id_col, held_out, n_tokens, n_known,
    train_tokens, base_score, score`` (log10 probabilities of the whole text).

    Rows whose crc32(id as text) mod ``folds`` is ``held_fold`` are held out
    of all counts.  Null or empty text: the end token alone.  Null id: its
    text form is empty.  Repeated rows count as often as they occur.  No
    training rows: counts are zero and weights uniform.  Empty table: no rows.
    """
    units, _, total = with_units(docs, id_col, text_col, unit_bytes)
    held = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")),
                  F.lit(folds)) == held_fold
    buckets = max(24, math.ceil(total / bucket_bytes))
    train = units.where(~held)
    table = cut(word_counts(train, buckets, vocabulary))
    ends = train.count()
    sums = table.agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    sp = _pieces(vocabulary)
    counts = {r[0]: r[1] for r in table.select(F.explode("pieces").alias("p"))
              .groupBy("p.id").agg(F.sum("p.n")).collect()}  # bounded by the vocabulary
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    mass = math.log(sum(counts.get(i, 0) for i in ids) + len(ids) + ends + 1)
    weights = {i: math.log(counts.get(i, 0) + 1) - mass for i in ids}
    end_logp = math.log(ends + 1) - mass

    def ask(t: pa.Table) -> pa.Table:
        words = _distinct(t["text"])
        order, runs = _to_buckets(words, buckets)
        unit = t["unit"][0].as_py()
        return pa.table({"bucket": pa.array([k for k, _, _ in runs], pa.int32()),
                         "unit": pa.array([unit] * len(runs), pa.int32()),
                         "words": pa.array([b" ".join([words[i] for i in order[a:b]]) for _, a, b in runs], pa.binary())})

    memo: dict = {}  # one lattice per task

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        for words, c in zip(known["words"].to_pylist(), known["counts"].to_pylist()):
            seen.update(zip(words.split(b" "), np.frombuffer(c, "<i8").tolist()))
        sums, lattice = {}, memo.get("lattice") or memo.setdefault("lattice", Lattice(vocabulary, weights))
        c_out, s_out = [], []
        for words in asked["words"].to_pylist():
            words = words.split(b" ")
            for w in words:
                if w not in sums:
                    sums[w] = lattice.logp(w.decode())
            c_out.append(np.array([seen.get(w, 0) for w in words], "<i8").tobytes())
            s_out.append(np.array([sums[w] for w in words], "<f8").tobytes())
        return pa.table({"unit": asked["unit"], "bucket": asked["bucket"],
                         "counts": pa.array(c_out, pa.binary()), "sums": pa.array(s_out, pa.binary())})

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        words = _distinct(t["text"])
        order, runs = _to_buckets(words, buckets)
        spans = {k: order[a:b] for k, a, b in runs}
        count, logp = np.zeros(len(words), np.int64), np.zeros(len(words))
        for k, c, s in zip(*(answers[x].to_pylist() for x in ("bucket", "counts", "sums"))):
            count[spans[k]] = np.frombuffer(c, "<i8")
            logp[spans[k]] = np.frombuffer(s, "<f8")
        place = {w: i for i, w in enumerate(words)}
        base = np.log10((count + 1) / (tokens + distinct + 1))
        end = math.log10((ends + 1) / (tokens + distinct + 1))
        rows = []
        for text in t["text"]:
            ix = [place[w] for w in text.as_py().encode().lower().split()]
            rows.append((len(ix) + 1, int((count[ix] > 0).sum()) + (ends > 0), float(base[ix].sum()) + end,
                         (float(logp[ix].sum()) + end_logp) / math.log(10)))
        c = list(zip(*rows))
        return pa.table({"id": t["id"], "n_tokens": pa.array(c[0], pa.int64()), "n_known": pa.array(c[1], pa.int64()),
                         "base_score": pa.array(c[2]), "score": pa.array(c[3])})

    asked = units.groupBy("unit").applyInArrow(ask, "bucket int, unit int, words binary")
    answers = (table.select("bucket", "words", "counts").groupBy("bucket").cogroup(asked.groupBy("bucket"))
               .applyInArrow(answer, "unit int, bucket int, counts binary, sums binary"))
    out = units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(
        finish, "id long, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known",
                      F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _distinct(texts: pa.ChunkedArray) -> list[bytes]:
    """Distinct words of a unit's texts, in a fixed order."""
    words: set[bytes] = set()
    for t in texts:
        words.update(t.as_py().encode().lower().split())
    return sorted(words)
