"""Language-model scores against a plain count and an exhaustive lattice."""

import math
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from boreframe.llm.lm_score import Lattice, lm_scores
from tests.conftest import SF_SMALL

VOCABULARY = "piece_bpe_32k.model"


def words_of(text):
    return (text or "").encode().lower().split()


def segmentations(text, weights):
    """Sum over all segmentations, by plain recursion over prefixes."""
    if not text:
        return 1.0
    total = 0.0
    for j in range(1, len(text) + 1):
        if text[:j] in weights:
            total += weights[text[:j]] * segmentations(text[j:], weights)
    if text[0] not in weights:
        p = 1.0
        for b in text[0].encode():
            p *= weights[f"<0x{b:02X}>"]
        total += p * segmentations(text[1:], weights)
    return total


def test_scores_match_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    extra = [(100_000, None), (100_001, ""), (100_002, "Neuword☃ zzqx the"), (100_003, "The THE É"),
             (100_004, " \t\n")]
    docs = rows.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    table = [(r.doc_id, r.text) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in table}
    c = Counter(w for i, t in table if not held[i] for w in words_of(t))
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(VOCABULARY))
    pieces = Counter()
    for w, k in c.items():
        for i in sp.encode(w.decode()):
            pieces[i] += k
    ids = [i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
    mass = sum(pieces[i] for i in ids) + len(ids) + ends + 1
    weights = {sp.id_to_piece(i): (pieces[i] + 1) / mass for i in ids}
    assert sum(weights.values()) + (ends + 1) / mass == pytest.approx(1)
    sums = {}
    got = {r.doc_id: r for r in lm_scores(docs, unit_bytes=20_000, bucket_bytes=30_000).collect()}
    assert len(got) == len(table)
    for i, t in table:
        ws, r = words_of(t), got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(ws) + 1, n)
        assert r.n_known == 1 + sum(c[w] > 0 for w in ws)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if len(ws) < 60:
            for w in ws:
                if w not in sums:
                    sums[w] = math.log10(segmentations("▁" + w.decode(), weights))
            assert r.score == pytest.approx(sum(sums[w] for w in ws) + math.log10((ends + 1) / mass), rel=1e-9)


def test_long_word_does_not_underflow():
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(VOCABULARY))
    lattice = Lattice(VOCABULARY, {i: -10.0 for i in range(sp.get_piece_size())})
    assert -1e6 < lattice.logp("ab☃" * 20_000) < -10_000


def test_empty_table_no_training_rows_and_nulls(spark):
    schema = "doc_id long, text string, unit int, bucket int"
    assert lm_scores(spark.createDataFrame([], schema)).count() == 0
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2]
    r = lm_scores(spark.createDataFrame([(held[0], "a b", 1, 1), (held[0], "a b", 1, 1)], schema)).collect()
    assert len(r) == 2 and r[0] == r[1]
    assert (r[0].n_known, r[0].train_tokens, r[0].n_tokens) == (0, 0, 3) and r[0].score < 0
    r = lm_scores(spark.createDataFrame([(None, "a b a", 1, 1), (3, None, 1, 1)], schema)).collect()
    assert len(r) == 2 and all(math.isfinite(x.score) for x in r)
