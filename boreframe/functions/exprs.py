"""Column-expression helpers (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(c) -> Column:
    """NaN -> NULL so that comparisons and counts follow missing-value rules;
    text that is no number becomes NULL too."""
    col = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)


def count_true(cols) -> Column:
    cols = list(cols)
    if not cols:
        return F.lit(0)
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in cols])


def outside(c, lo: float, hi: float) -> Column:
    """Strictly outside [lo, hi]; NULL input gives false."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce((col < F.lit(lo)) | (col > F.lit(hi)), F.lit(False))


def pct(num, den) -> Column:
    """Percentage (num/den)*100 as double (that operation order, as reported);
    0 rows -> NULL instead of an error."""
    return F.try_divide(num.cast("double"), den.cast("double")) * F.lit(100.0)


def band(conf, edges, right_closed: bool = True) -> Column:
    """Map a value to labels of consecutive bins starting at 0 (open).

    ``edges`` is [(upper, label), ...].  Right-closed: (prev, upper].  Values
    at or below 0, above the last edge, or NULL give NULL (pandas.cut).
    """
    col = F.col(conf) if isinstance(conf, str) else conf
    expr = None
    prev = 0.0
    for upper, label in edges:
        cond = (col > F.lit(prev)) & (col <= F.lit(upper)) if right_closed else \
            (col >= F.lit(prev)) & (col < F.lit(upper))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
        prev = upper
    return expr


def stack_columns(df: DataFrame, id_cols, value_cols, name_col="feature", value_col="value") -> DataFrame:
    """Wide -> long via ``stack`` (single narrow projection, no shuffle)."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in value_cols)
    return df.selectExpr(*[f"`{c}`" for c in id_cols],
                         f"stack({len(value_cols)}, {pairs}) as ({name_col}, {value_col})")


_FORMATTERS = {}


def py_format(c, spec: str) -> Column:
    """Format a double exactly like Python's ``format(x, spec)``.

    Java's formatter rounds half-up on the shortest decimal form (0.25 ->
    '0.3', 0.35 -> '0.4'), Python rounds the exact binary value (0.2, 0.3).
    Only used on aggregated rows (report texts), so the Arrow-batched Python
    call never sits in a per-row hot path.
    """
    if spec not in _FORMATTERS:
        @F.pandas_udf("string")
        def _fmt(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None or x != x else format(float(x), spec))

        _FORMATTERS[spec] = _fmt
    col = F.col(c) if isinstance(c, str) else c
    return _FORMATTERS[spec](col.cast("double"))


def fmt2(c) -> Column:
    """Number formatted with 2 decimals (like Python's ``{:.2f}``)."""
    return py_format(c, ".2f")
