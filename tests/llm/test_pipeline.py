"""The pipeline's stages, each against a plain version of its decision."""

import importlib.util
import sys

import corpus_pipeline as P
from boreframe.llm import queries
from pyspark.sql import functions as F
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_secret_scan import brute as secret_spans
from tests.llm.test_simhash_packing import brute_components, brute_fp


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination",
                                        "secret scans", "best-fit packing"]
    every, kept = rows(docs), []
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == list(next(iter(every.values())).asDict())
        docs = docs.cache()
        kept.append(rows(docs))
    a, b, c, d = kept
    quality = {r.doc_id: r.quality for r in labels.collect()}
    wrong = [i for i, q in quality.items() if (i in a) != bool(q)]
    assert len(wrong) <= 0.1 * len(quality)
    assert not [i for i in wrong if quality[i]] or len([i for i in wrong if quality[i]]) <= 0.03 * len(quality)
    ids = sorted(a)
    assert sorted(b) == sorted(set(brute_components(ids, [brute_fp(a[i].text) for i in ids])))
    bad = {x[0] for x in contained([(i, b[i].text) for i in b], [(r.item_id, r.text) for r in bench.collect()])}
    assert sorted(c) == sorted(set(b) - bad)
    assert sorted(d) == sorted(c)
    for i in c:
        if secret_spans(c[i].text):
            assert not secret_spans(d[i].text) and d[i].n_chars == len(d[i].text)
    packed = P.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r.doc_id for r in packed} == set(d)


def test_run_is_registered_and_repeats(spark):
    assert queries.QUERIES["pipeline"] and P.ORACLE_SQL is None
    first = queries.QUERIES["pipeline"](spark, SF_SMALL)
    assert first.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n = first.agg(F.count("*"), F.countDistinct("doc_id")).first()
    assert n[0] >= n[1] > 0


def test_odd_rows_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (None, "token=abcdefgh", "en", "s", 14), (2, "", "en", None, 0),
           (2, "", "en", None, 0), (3, "word " * 40_000, "en", "s", 200_000)]
    for table in (spark.createDataFrame(odd, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF_SMALL)
            assert out.count() >= 0, name
            docs = out if name != "best-fit packing" else docs


def test_entry_works_without_the_subpackage(monkeypatch):
    spec = importlib.util.spec_from_file_location("entry_copy", f"{P.__file__.rsplit('/', 1)[0]}/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    whole = set(entry.queries())
    assert {"pipeline"} <= whole and sum(q.startswith("op") and q[2].isdigit() for q in whole) == 13
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n == "boreframe.llm" else find(n, *a))
    assert not any(q == "pipeline" or (q.startswith("op") and q[2].isdigit()) for q in entry.queries())
    assert "boreframe.llm" in sys.modules
