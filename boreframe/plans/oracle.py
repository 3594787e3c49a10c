"""SQL fragments for the DuckDB oracle texts.

The oracle queries are written as plain SQL over the same well-log view; these
helpers only assemble repetitive per-curve fragments so that every oracle text
stays readable.
"""

from __future__ import annotations

from ..sources.testview import oracle_cte

KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


def iqr_cte(features, src: str = "t") -> str:
    """One row: Q1/Q3 per curve (exact linear quantiles)."""
    cols = ", ".join(f"quantile_cont({f}, 0.25) as {f}_q1, quantile_cont({f}, 0.75) as {f}_q3"
                     for f in features)
    return f"select {cols} from {src}"


def iqr_flag(f: str) -> str:
    lo = f"({f}_q1 - 1.5 * ({f}_q3 - {f}_q1))"
    hi = f"({f}_q3 + 1.5 * ({f}_q3 - {f}_q1))"
    return f"coalesce({f} < {lo} or {f} > {hi}, false)"


def int_of(cond: str) -> str:
    return f"(case when {cond} then 1 else 0 end)"


def null_text(features) -> str:
    return ", ".join(f"case when {f} is null then 'Null in {f}' end" for f in features)


def count_nulls(features) -> str:
    return " + ".join(int_of(f"{f} is null") for f in features)


def with_wells(body: str) -> str:
    return oracle_cte(body)
