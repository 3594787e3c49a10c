"""SimHash near-dedup and packing against plain brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from boreframe.llm.packing import pack, plan
from boreframe.llm.simhash import _groups, deal, drop_near_dups, grow, link_shard, shards_of, simhash_near_dups
from tests.conftest import SF_SMALL


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hs) * 2 > len(hs))


def brute_components(ids, fps, bits=3):
    comp = list(range(len(ids)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    f = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= bits):
            a, b = root(i), root(int(j))
            comp[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        r = root(i)
        low[r] = min(low.get(r, d), d)
    return [low[root(i)] for i in range(len(ids))]


def clusters(n, seed):
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        f = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 40])):
            out.append(f)
            for _ in range(rnd.randint(0, 3)):
                f ^= 1 << rnd.randrange(64)
    return sorted(set(out[:n]))


def test_documents_match_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    extra = [(100_000, None), (100_001, ""), (100_002, "one two"), (100_003, "One two"),
             (100_004, " \t\n"), (100_005, "a b c d é" * 5000)]
    docs = rows.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_near_dups(docs, shard=16).collect()}
    ids, texts = zip(*sorted((r.doc_id, r.text) for r in docs.collect()))
    fps = [brute_fp(t) for t in texts]
    comps = brute_components(ids, fps)
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, comps)}
    assert got[100_000][0] == "0" * 16 and got[100_000][1] == got[100_001][1] == got[100_004][1]


def test_shards_lose_no_link():
    fps = np.array(clusters(4000, 3), np.uint64)
    tree, n = grow(fps[::9], 16)
    row, shard, home = deal(tree, fps, 3)
    assert sorted(row[home]) == list(range(len(fps))) and n == 16
    edges = []
    for s in range(n):
        at = np.sort(row[shard == s])
        h = np.isin(at, row[(shard == s) & home])
        root = link_shard(fps[at], h, 3, block=20)
        edges += [(at[i], at[r]) for i, r in enumerate(root)]
    comp = list(range(len(fps)))

    def root_of(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for a, b in edges:
        a, b = root_of(a), root_of(b)
        comp[max(a, b)] = min(a, b)
    assert [root_of(i) for i in range(len(fps))] == brute_components(list(range(len(fps))), fps)


def test_empty_null_ids_and_extra_columns(spark):
    schema = "doc_id long, text string, fp long, unit int, shard int, id string"
    assert simhash_near_dups(spark.createDataFrame([], schema)).count() == 0
    d = spark.createDataFrame([(None, "a b c", 1, 1, 1, "x"), (7, "a b c", 1, 1, 1, "x"),
                               (7, "a b c", 1, 1, 1, "x"), (None, "q r s t", 1, 1, 1, "x")], schema)
    got = sorted((r.doc_id is None, r.component_id is None) for r in simhash_near_dups(d).collect())
    assert got == [(False, False), (False, False), (True, False), (True, True)]


def test_oversize_shards_are_dealt_again(spark):
    fps = clusters(20_000, 5)
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").checkpoint()
    rows = shards_of(classes, 3, 64, 300).toPandas()
    home = rows[rows.home].drop_duplicates(["level", "shard", "fp"])
    assert sorted(home.fp) == sorted(r.fp for r in classes.collect()) and home.level.max() > 0
    assert home.groupby(["level", "shard"]).size().max() <= 300
    assert rows[~rows.home].groupby(["level", "shard", "part"]).size().max() <= 4 * 300 * 1.2
    per_part = rows[rows.home].groupby(["level", "shard", "part"]).size()
    assert per_part.groupby(level=[0, 1]).nunique().max() == 1  # every part holds the whole home set
    got = {r.class_fp % (1 << 64): r.group_fp for r in _groups(classes, 3, 64, 300).collect()}
    want = brute_components(list(range(len(fps))), fps)
    low = {}
    assert all(low.setdefault(w, got[f]) == got[f] for f, w in zip(fps, want))
    assert len(set(got.values())) == len(set(want))


def test_one_row_of_each_group_stays(spark):
    schema = "doc_id long, text string, near_id int, Content_Hash string, fp int"
    rows = [(1, "a b c d", 1, "x", 1), (1, "a b c d", 1, "x", 1), (1, "q r s t u v", 2, "y", 2),
            (5, "A b  c d", 3, "z", 3), (None, "a b c d", 4, "w", 4), (None, "k l m n o", 5, "v", 5),
            (None, "k l m n o", 5, "v", 5), (7, None, 6, None, 6), (8, "", 7, None, 7)]
    d = spark.createDataFrame(rows, schema)
    got = drop_near_dups(d)
    assert got.columns == d.columns
    assert sorted(got.collect(), key=str) == sorted(d.where(
        "near_id in (1, 2, 5, 6)").distinct().collect(), key=str)
    assert drop_near_dups(d.limit(0)).count() == 0
    names = spark.createDataFrame([("b", "a b c d"), ("a", "a b c d"), ("c", "q r s t u v")], "doc_id string, text string")
    assert sorted(r.doc_id for r in drop_near_dups(names).collect()) == ["a", "c"]
    assert {r.component_id for r in simhash_near_dups(names).collect()} == {"a", "c"}


def test_plan_places_every_piece_once():
    for seed in range(30):
        rnd = random.Random(seed)
        cap = rnd.choice([16, 100, 1024])
        counts = {rnd.randint(1, cap): rnd.choice([1, 2, 7, 1000]) for _ in range(rnd.randint(0, 60))}
        spots, ranks = {}, {n: set() for n in counts}
        for n, r0, k, b0, per, off in plan(counts, cap):
            for r in range(k):
                ranks[n].add(r0 + r)
                spots.setdefault(b0 + r // per, []).append((off + r % per * n, n))
        assert all(ranks[n] == set(range(c)) for n, c in counts.items())
        for parts in spots.values():
            at = 0
            for off, n in sorted(parts):
                assert off == at
                at += n
            assert at <= cap
        tokens = sum(n * c for n, c in counts.items())
        assert len(spots) <= max(1.7 * tokens / cap + 1, 1)
        if counts and max(counts) <= cap // 3:  # small items only: bins nearly full
            assert len(spots) <= tokens / (cap * 2 / 3) + 1


def test_pack_round_trip(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    odd = ["", None, "  a   b \n\n c  d\u0085e  ", "x \n y", " lead", "trail ", "\n  z", "a" * 5000,
           "<|endoftext|> it's  we'll", "\x1c \x1c a"]
    docs = rows.unionByName(spark.createDataFrame(
        [(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")).withColumn("length", rows.doc_id * 0)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = pack(docs).collect()
    by_doc, seqs = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for d in docs.collect():
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        parts = sorted(by_doc.pop(d.doc_id), key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(parts):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 1024
    assert len(seqs) <= total / 1024 * 1.05 + 1
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
