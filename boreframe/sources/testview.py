"""Well-log view over the driver's TPC-H-like tables.

The driver tables have no well logs, so a deterministic view maps lineitem x
part onto the well-log schema, injecting nulls, spikes, numeric label codes
and an unexpected label by modulus.  The same SQL text runs in Spark and in
DuckDB, which makes every operator on top of it oracle-checkable.

Row key: (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate).
Target column: ``LITH``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import LogConfig

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
TARGET = "LITH"

WELLS_SQL = """select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate,
  concat('WELL_', cast(l.l_suppkey as varchar(20))) as WELL,
  cast(l.l_orderkey as double)*0.5 as DEPTH_MD,
  case when l.l_orderkey % 50 = 1 then null when l.l_orderkey % 83 = 4 then l.l_quantity*20 else l.l_quantity*4 end as GR,
  case when l.l_partkey % 41 = 2 then null else 1.0 + p.p_size/20.0 end as RHOB,
  case when l.l_suppkey % 29 = 3 then null else l.l_discount*6 end as NPHI,
  case when l.l_orderkey % 37 = 2 then null else l.l_extendedprice/10 end as RDEP,
  40 + l.l_tax*3000 as DTC,
  case when l.l_partkey % 61 = 5 then 25.0 else (p.p_retailprice-895)/10 end as PEF,
  case when l.l_orderkey % 97 = 3 then null
       when p.p_type='ECONOMY' then '65000' when p.p_type='LARGE' then 'Shale'
       when p.p_type='MEDIUM' then '70000' when p.p_type='PROMO' then 'Dolomite'
       when p.p_type='SMALL' then 'Sandstone' else 'Tuffite' end as LITH
from lineitem l join part p on l.l_partkey = p.p_partkey"""

# Config for the view: the row key is the five lineitem columns.
VIEW_CONFIG = LogConfig(target=TARGET, key=KEY)


SPREAD_KEYS = {"lineitem": ("l_orderkey",)}


def register_tables(spark: SparkSession, sf_dir: str, names=("lineitem", "part"), spread=("lineitem",)) -> None:
    """Register the driver tables as views.

    In a local session the fact table, one small file, is dealt to all cores;
    a cluster reads it as it is.
    """
    from ..session import spread_local
    for n in names:
        df = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        if n in spread:
            df = spread_local(df, SPREAD_KEYS[n])
        df.createOrReplaceTempView(n)


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well-log view as a DataFrame (lazy; Catalyst prunes unused columns).

    The ingest conform step (curves as DOUBLE, NaN as NULL) is applied on top:
    Spark types ``1.0 + p_size/20.0`` as DECIMAL where other engines use DOUBLE.
    """
    from ..config import FEATURES
    from ..operators.quality import clean_curves
    register_tables(spark, sf_dir)
    return clean_curves(spark.sql(WELLS_SQL), list(FEATURES) + ["DEPTH_MD"])


def oracle_cte(body: str) -> str:
    """Wrap an oracle query body so that it can refer to ``wells``."""
    return f"with wells as ({WELLS_SQL})\n{body}"
