"""A training corpus from the table ``documents``, in five stages.

Every stage takes what its predecessor kept; the results between stages are
Parquet tables in the session's shared folder, so a lost executor costs no more
than the stage that runs.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreframe.llm.common import fresh, load
from boreframe.llm.decontaminate import decontaminate
from boreframe.llm.packing import pack
from boreframe.llm.quality_classifier import keep_quality
from boreframe.llm.secret_scan import BlobLedger, redact
from boreframe.llm.simhash import drop_near_dups
from boreframe.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (a null text is
    judged as an empty one)."""
    return keep_quality(docs, load(spark, sf_dir, "labels"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the smallest id."""
    return drop_near_dups(docs, shingle=3, max_bits=3)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; ``n_chars`` follows the text.

    The ledger is kept where the session setting ``boreframe.secrets.ledger``
    says, so that a later run scans only texts it has not seen; without it
    each run has one of its own."""
    ledger = BlobLedger(spark, spark.conf.get("boreframe.secrets.ledger", None)
                        or shared_dir(spark, f"secret-ledger-{uuid.uuid4().hex}"))
    ledger.scan(docs, "documents")
    before, = fresh(docs, "before")
    clean = redact(docs.withColumn(before, F.length("text")), ledger.found())
    changed = F.length("text") != F.col(before)
    return (clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dups),
          ("benchmark decontamination", contamination), ("secret scans", secrets),
          ("best-fit packing", packing)]

#: no SQL: the classifier is trained, and SimHash and tokens are beyond it
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = load(spark, sf_dir, "documents")
    at = shared_dir(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
