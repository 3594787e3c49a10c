"""Ingest queries: the view is written as CSV files (other column orders,
separators, aliases, missing tokens, malformed lines), read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..operators import conform as P
from ..session import shared_dir
from ..sources import readers
from ..sources.testview import KEY, wells
from . import oracle as O
from .registry import register, round_doubles

FEATS = list(C.FEATURES)
IDS = [k for k in KEY if k != "l_shipdate"]
#: alias of each curve in the written files
ALIAS = {"GR": "gamma_ray", "RHOB": "density", "NPHI": "neutron", "RDEP": "res", "DTC": "sonic", "PEF": "pe"}

_ROWS_SQL = f"select {', '.join(f'{k}::varchar as {k}' for k in IDS)}, WELL, LITH, {', '.join(f'round({f}, 6) as {f}' for f in FEATS)} from wells"


def _view(spark, sf_dir):
    return round_doubles(wells(spark, sf_dir).select(*IDS, "WELL", "LITH", *FEATS))


def _write(df, path: str, columns, sep: str = ",", token: str = "NA") -> None:
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(token)).alias(c) for c in columns])
    text.write.option("header", True).option("sep", sep).csv(path)


def _two_orders(spark, sf_dir, sep2: str = ",") -> tuple[str, str]:
    """Odd and even orders, in two column orders (and separators)."""
    base = shared_dir(spark, f"csv-{uuid.uuid4().hex[:12]}")
    df = _view(spark, sf_dir)
    _write(df.where("l_orderkey % 2 = 0"), f"{base}/a", df.columns)
    _write(df.where("l_orderkey % 2 = 1"), f"{base}/b", df.columns[::-1], sep2, "null")
    return f"{base}/a", f"{base}/b"


def _plain(df):
    return round_doubles(df.select(*IDS, "WELL", "LITH", *FEATS))


@register("csv_load", O.with_wells(_ROWS_SQL))
def csv_load(spark, sf_dir):
    """Files of two column orders under one glob; NA tokens in all columns."""
    a, _ = _two_orders(spark, sf_dir)
    return _plain(readers.read_csv(spark, a.rsplit("/", 1)[0] + "/*"))


@register("csv_union", O.with_wells(_ROWS_SQL))
def csv_union(spark, sf_dir):
    """Files of two separators and column orders, one without a target."""
    a, b = _two_orders(spark, sf_dir, ";")
    base = a.rsplit("/", 1)[0]
    _write(_view(spark, sf_dir), f"{base}/c", [*IDS, *FEATS])
    return _plain(readers.read_many(spark, [a, b, f"{base}/c"], target_candidates=["LITH"]))


_BAD_SQL = """
, l as (select l_orderkey as k, WELL as w, GR as g, l_linenumber from wells)
select cast(k as varchar) as k, w, round(case when k % 7 = 1 then null else g end, 6) as g,
  (select count(*) from l where k % 7 = 2)::bigint as dropped from l where k % 7 <> 2"""


@register("csv_bad_lines", O.with_wells(_BAD_SQL))
def csv_bad_lines(spark, sf_dir):
    """Short lines stay (last column missing), over-long ones go and are counted."""
    path = shared_dir(spark, f"csv-{uuid.uuid4().hex[:12]}")
    df = _view(spark, sf_dir)
    k = F.col("l_orderkey")
    line = F.concat_ws(",", k, "WELL", F.when(k % 7 != 1, F.coalesce(F.col("GR").cast("string"), F.lit("NA"))),
                       F.when(k % 7 == 2, F.lit("more,and more")))
    head = spark.createDataFrame([("k,w,g",)], "value string")
    df.select(line.alias("value")).write.text(f"{path}/body")
    head.coalesce(1).write.text(f"{path}/head")
    lines = spark.read.text([f"{path}/head", f"{path}/body"])
    # every file starts with the header
    files = lines.repartition(4).mapInPandas(_headed, "value string")
    files.write.text(f"{path}/csv")
    table = readers.read_csv(spark, f"{path}/csv", ",", "utf-8", numeric_cols=["g"])
    dropped = readers.dropped_line_count(spark, f"{path}/csv")
    return round_doubles(table.select("k", "w", "g", F.lit(dropped).cast("long").alias("dropped")))


def _headed(batches):  # noqa: ANN001, ANN202
    first = True
    for b in batches:
        b = b[b["value"] != "k,w,g"]
        if first:
            yield b.head(0)._append({"value": "k,w,g"}, ignore_index=True)
            first = False
        yield b


def _aliased(spark, sf_dir) -> str:
    path = shared_dir(spark, f"csv-{uuid.uuid4().hex[:12]}")
    df = _view(spark, sf_dir).withColumnsRenamed(ALIAS)
    _write(df, path, df.columns)
    return path


@register("mapping_batch", O.with_wells(_ROWS_SQL))
def mapping_batch(spark, sf_dir):
    """P6 on text columns with NA tokens."""
    df, _ = P.auto_mapping_batch(readers.read_csv(spark, _aliased(spark, sf_dir)))
    return _plain(df)


@register("mapping_interactive", O.with_wells(_ROWS_SQL))
def mapping_interactive(spark, sf_dir):
    """P7 on text columns with NA tokens."""
    df, _ = P.auto_mapping_interactive(readers.read_csv(spark, _aliased(spark, sf_dir)))
    return _plain(df)


@register("mapping_manual", O.with_wells(_ROWS_SQL))
def mapping_manual(spark, sf_dir):
    """P5 on text columns with NA tokens."""
    spec = ",".join(f"{old}:{new}" for new, old in ALIAS.items())
    df, _, unknown = P.manual_mapping(readers.read_csv(spark, _aliased(spark, sf_dir)), spec + ",absent:GR2")
    assert unknown == ["absent"]
    return _plain(df)


@register("write_annotated", O.with_wells(f"select {', '.join(KEY)}, WELL, round(GR, 6) as GR from wells"))
def write_annotated(spark, sf_dir):
    """The table written by well, in ranges of (well, depth), and read back."""
    from ..sources.sinks import write_table
    path = shared_dir(spark, f"wells-{uuid.uuid4().hex[:12]}")
    write_table(wells(spark, sf_dir), path)
    return round_doubles(spark.read.parquet(path).select(*KEY, "WELL", "GR"))
