"""Small helpers to shape query results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def snap(c, digits: int = 4) -> Column:
    """Round to ``digits`` places such that a value an engine computes as
    x.xxxx4999999 or x.xxxx5 comes out the same: the step lies beside the half."""
    p = float(10 ** digits)
    value = F.col(c) if isinstance(c, str) else c
    return F.floor(value.cast("double") * p + 0.50001) / p


def signed_log(c) -> Column:
    """ln(1 + |x|) with the sign of x, for compounded values of many magnitudes."""
    value = F.col(c) if isinstance(c, str) else c
    return F.signum(value) * F.log1p(F.abs(value))


def rounded(df: DataFrame, keys: list[str], values: list[str], digits: int | None = 4) -> DataFrame:
    """Keys as they are, values as doubles, snapped unless ``digits`` is None."""
    return df.select(*keys, *[
        (F.col(v).cast("double") if digits is None else snap(v, digits)).alias(v) for v in values])


KEYS = ["ts_code", "trade_date"]
