"""Quality rules, license scans and substring dedup on odd inputs, against
plain Python, and all registered texts against their DuckDB form."""

import random
import re
from collections import Counter

import pytest

from boreframe.llm import queries
from boreframe.llm.license_scan import license_scan
from boreframe.llm.quality_rules import quality_rules
from boreframe.llm.substring_dedup import rolling, substring_dedup
from tests.conftest import SF_SMALL
from tests.oracle_check import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    ok, n = compare(spark, name, SF_SMALL, queries.QUERIES, queries.ORACLES)
    assert ok and n >= 0


# ---------------------------------------------------------------- substring dedup

def brute_dedup(docs, width):
    words = {i: WORD.findall(t or "") for i, t in docs}
    seen, gone = set(), {i: set() for i in words}
    for i in sorted(words, key=lambda x: (x is not None, x or 0)):
        w = words[i]
        for s in range(len(w) - width + 1):
            key = tuple(w[s:s + width])
            if key in seen:
                gone[i].update(range(s, s + width))
            seen.add(key)
    return {i: (len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i]))
            for i, w in words.items()}


def test_substring_dedup_matches_brute_force(spark):
    rnd = random.Random(4)
    v = [f"é{i}" for i in range(40)]
    shared = [rnd.choices(v, k=rnd.randint(3, 30)) for _ in range(6)]
    docs = []
    for i in range(150):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else rnd.choices(v, k=rnd.randint(0, 20))
                 for _ in range(rnd.randint(0, 8))]
        docs.append((i * 7 - 300, " \n".join(x for p in parts for x in p)))
    docs += [(5000, None), (5001, ""), (5002, "a " * 5000), (5003, docs[3][1]), (None, docs[4][1])]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, unit int, bucket string")
    got = {r.doc_id: r for r in substring_dedup(d, width=5, unit_bytes=500, bucket_windows=50).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_text) for i, r in got.items()} == brute_dedup(docs, 5)
    for r in got.values():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))  # maximal


def test_substring_dedup_odd_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(d, width=3).collect()) == [(1, 0), (1, 0), (2, 5)]
    assert substring_dedup(d.limit(0)).count() == 0


def test_rolling_hash_equals_direct_polynomial():
    import numpy as np
    rnd = random.Random(1)
    v = np.array([rnd.getrandbits(64) for _ in range(50)], np.uint64)
    base = 0x9E3779B97F4A7C15
    want = [sum(int(x) * pow(base, 6 - k, 1 << 64) for k, x in enumerate(v[i:i + 7])) % (1 << 64) for i in range(44)]
    assert rolling(v, 7, base).tolist() == want
    assert len(rolling(v[:3], 7, base)) == 0


# ---------------------------------------------------------------- quality rules

def brute_base(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    many = Counter(win)
    rep = {i + k for i, x in enumerate(win) if many[x] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), failed)


def test_quality_rules(spark):
    rnd = random.Random(9)
    fresh = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(15))
    body = [(i, f"Common  LINE here\n{fresh()}\n{fresh()}") for i in range(30)]
    body += [(100 + i, "common line here\nCommon line here\t\nx y z w\n") for i in range(3)]  # depleted
    body += [(200, None), (201, ""), (202, "\n \n"), (203, "a b " * 3000), (204, "é☃ # <|> " * 4),
             (205, "one two three four five"), (206, "\x0b".join("abcdefghijklmn"))]
    copies = [(300 + i, f"{'q ' * 3}\n" + "same text in all copies " * 1 + "a b c d e f g h i j") for i in range(40)]
    d = spark.createDataFrame([(i, t, "h", 1) for i, t in body + copies] + [(400, body[0][1], None, 1)],
                              "doc_id long, text string, source string, common int")
    got = {r.doc_id: r for r in quality_rules(d, max_share=0.5).collect()}
    for i, t in body + copies:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(t), i
    assert got[0].n_common_words == 3 and got[0].kept and got[0].clean_text == body[0][1].split("\n", 1)[1]
    assert got[100].n_common_lines == 2 and not got[100].kept
    assert got[300].n_common_lines == 0 and got[300].kept  # equal texts are one document
    assert got[400].n_common_lines == 0  # another host
    assert quality_rules(d.limit(0)).count() == 0
    same = {r.doc_id: r.kept for r in quality_rules(d, max_share=0.5, broadcast_hosts=0).collect()}
    assert same == {i: r.kept for i, r in got.items()}


def test_line_limit_that_does_not_grow_with_the_host(spark):
    rows = [(i, "h", f"u{i} a b c d e f g h i\nshort tail" + ("\nseen by twenty" if i < 20 else "")
             + ("\nseen by nineteen" if 20 <= i < 39 else "")) for i in range(1000)]
    rows += [(2000 + i, "h", rows[0][2]) for i in range(50)]  # copies count once
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for limit in (100_000, 0):  # broadcast or not
        got = {r.doc_id: r for r in quality_rules(d, max_docs=20, broadcast_hosts=limit).collect()}
        assert len(got) == len(rows)
        for i, _, t in rows:
            gone = [x for x in t.split("\n") if x in ("short tail", "seen by twenty")]
            assert (got[i].n_common_lines, got[i].n_common_words) == (len(gone), sum(len(x.split()) for x in gone))
            assert got[i].clean_text == "\n".join(x for x in t.split("\n") if x not in gone) and got[i].kept


# ---------------------------------------------------------------- license scans

def test_license_scan(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the Software), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software")
    rows = [(1, f"intro words {mit} end"), (2, mit.replace("free of charge", "free of any charge").replace("merge, ", "")),
            (3, "MIT LICENSE, mit-license and Apache license"), (4, "nothing at all"), (5, None), (6, ""),
            (7, "the gnu general public license"), (8, " ".join(mit.split()[:12])), (9, "mit license " * 20_000),
            (10, "license"), (None, "All rights reserved. " * 3), (1, f"intro words {mit} end")]
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, label string, at int")
    got = license_scan(d).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[1].labels, by[1].base_labels, by[1].score, by[1].first_word) == ("mit", "", 1.0, None)
    assert [(s.start, s.end, s.label) for s in by[1].spans] == [(2, 2 + len(re.findall(r"[a-z]+", mit.lower())), "mit")]
    assert by[2].labels == "mit" and 0.8 <= by[2].score < 1
    assert (by[3].n_base, by[3].first_word, by[3].last_word, by[3].base_labels) == (3, 0, 5, "apache,mit")
    assert by[4].labels == by[5].labels == by[6].labels == by[10].labels == "" and by[4].score == 0
    assert (by[7].labels, by[7].score) == ("gpl", 1.0)
    assert by[8].labels == "" and 0 < by[8].score < 0.8
    assert (by[9].n_base, by[9].last_word) == (20_000, 39_998)
    assert by[None].labels == "reserved" and len(by[None].spans) == 3
    assert license_scan(d.limit(0)).count() == 0
