"""Containment search against brute force on planted items."""

import random
import re

from boreframe.llm.decontaminate import contained_items, decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def grams(w, k=5):
    k = min(k, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words(t)
        for b, s in items:
            g = grams(words(s))
            k = min(5, len(words(s)))
            n = len(g & {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}) if g else 0
            if g and n / len(g) >= 0.8:
                out.add((d, b, len(g), n))
    return out


def case(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 4, 5, 6, 9, 20, 70, 300])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "..."), (103, items[5][1])]
    docs = []
    for d in range(120):
        body = rnd.choices(vocabulary, k=rnd.choice([0, 3, 50, 2000]))
        for _ in range(rnd.choice([0, 1, 3])):
            w = rnd.choice(items[:40])[1].split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2])):  # near copies
                w[rnd.randrange(len(w))] = "zz"
            at = rnd.randint(0, len(body))
            body[at:at] = [x.upper() + "," for x in w]
        docs.append((d, "\n".join(body)))
    docs += [(1000, None), (1001, ""), (1001, ""), (None, items[8][1]), (1002, docs[7][1]), (1002, docs[7][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = case(1)
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, item string, width int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, part int")
    for options in ({}, {"broadcast_rows": 0}):
        got = [(r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in contained_items(d, b, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, items)
    bad = {x[0] for x in brute(docs, items)}
    kept = decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert contained_items(d, b).count() == 1
    assert contained_items(d.limit(0), b).count() == 0
    assert contained_items(d, b.limit(0)).count() == 0
    assert decontaminate(d, b.limit(0)).count() == 1


def test_rows_go_by_id_and_text(spark):
    item = " ".join(f"w{i}" for i in range(30))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame([(1, f"so {item} it is", 1, 1), (1, "quite another text " * 5, 2, 2), (None, item, 3, 3),
                               (None, None, 4, 4), (2, "", 5, 5)],
                              "doc_id long, text string, hit_id int, __hit int")
    assert sorted(r["hit_id"] for r in decontaminate(d, b).collect()) == [2, 4, 5]
