"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreframe.session import ensure_checkpoint_dir

#: words of a text: runs without space, tab, line feed, VT, FF, CR
SPACE_RE = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage through the shared checkpoint
    folder of the session (reliable checkpoint: survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it many
    times while it is computed once (Catalyst would otherwise inline it)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the white-space separated words of a text (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def sized(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint for a materialised side whose counted rows stay within
    ``max_rows`` and its bytes (of its JSON form) within ``max_bytes``; beyond
    either Spark's shuffled, skew-splitting join is used."""
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def with_units(docs: DataFrame, id_col: str, text_col: str, unit_chars: int,
               min_units: int = 48) -> tuple[DataFrame, int, int]:
    """``(id, text, unit)`` with documents cut into ranges of the id holding
    about ``unit_chars`` characters on average; also the unit count and the
    total characters.

    A unit is a function of the id alone and grows with it, so ids of a unit
    are below those of the next one.  Null ids go to the first unit.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(min_units, math.ceil(total / unit_chars))
    q = d.select("id").approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n) or []
    bounds = np.array(sorted({int(x) for x in q}), dtype=np.int64)

    @F.pandas_udf("int")
    def unit(ids):  # noqa: ANN001
        known = ids.notna().to_numpy()
        v = ids.fillna(0).astype("int64").to_numpy()
        return pd.Series(np.where(known, np.searchsorted(bounds, v, side="right"), 0).astype("int32"))

    return d.withColumn("unit", unit("id")), n, total


def doc_order(ids: list, texts: list) -> list[int]:
    """Deterministic order of a group's rows: id (null first), then text."""
    return sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))


def slices_by(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Stable order by key and the (key, start, end) runs of that order."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    if not len(k):
        return order, []
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    ends = np.r_[starts[1:], len(k)]
    return order, [(int(k[a]), int(a), int(b)) for a, b in zip(starts, ends)]
