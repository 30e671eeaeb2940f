"""Exponential recursions as plain windows.

Every smoother of the indicator set - EMA seeded with the first value, EMA
seeded with the mean of the first n, Wilder's average, Wilder's running sum,
KDJ smoothing - is one linear recursion

    y[t] = q * y[t-1] + c[t]          so          y[t] = sum_i c[i] * q^(t-i)

and differs only in ``q`` and in how the contributions ``c`` begin.  The sum is
evaluated inside blocks of bars as a cumulative sum of ``c * q^-k`` (k = place
in the block) scaled back by ``q^k``; the value at the end of the previous
block is carried over with ``q^(k+1)``.  A block is long enough that anything
older than one full block weighs less than 1e-17, so one carried block gives
the recursion to double precision, and every step is an incremental window
aggregate: linear time, no Python, no arrays, one exchange for any number of
recursions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.functions.series import Series, col

BLOCK = 512
_NEGLIGIBLE = 39.2  # -ln(1e-17)


@dataclass(frozen=True)
class Recursion:
    """``y = q*y_prev + contribution``; null contributions count as zero."""

    contribution: Column
    q: float
    shown: Column | None = None  # y is null where this is not true


def block_length(q: float) -> int:
    if not 0.0 < q < 1.0:
        raise ValueError("q must lie strictly between 0 and 1")
    longest = int(690.0 / -math.log(q))  # keeps q^-k inside a double
    needed = math.ceil(_NEGLIGIBLE / -math.log(q))
    return min(max(BLOCK, needed), longest)


def warm_up(*qs: float) -> int:
    """Bars of history after which the start of a recursion no longer shows."""
    return max(math.ceil(_NEGLIGIBLE / -math.log(q)) for q in qs)


def decayed_sums(df: DataFrame, series: Series, number: str,
                 recursions: dict[str, Recursion]) -> DataFrame:
    """Add one column per recursion.

    ``number`` is the 1-based bar number.  To skip missing bars instead of
    letting the value decay over them, pass the running count of valid bars,
    read the result on valid bars and fill it forward.
    """
    by_length: dict[int, list[str]] = {}
    for name, rec in recursions.items():
        by_length.setdefault(block_length(rec.q), []).append(name)

    out = df
    for length, names in by_length.items():
        block, place = f"_block{length}", f"_place{length}"
        out = out.withColumns({
            block: F.floor((F.col(number) - 1) / length),
            place: ((F.col(number) - 1) % length).cast("double"),
        })
        # ordering a series by (block, number, time) is the bar order itself, so
        # both windows below run on one sort
        inside = (Window.partitionBy(*series.key, block).orderBy(number, *series.order)
                  .rowsBetween(Window.unboundedPreceding, 0))
        earlier = (Window.partitionBy(*series.key).orderBy(block, number, *series.order)
                   .rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumns({
            f"_in_{n}": F.sum(F.coalesce(recursions[n].contribution.cast("double"), F.lit(0.0))
                              * F.pow(F.lit(1.0 / recursions[n].q), F.col(place))).over(inside)
            * F.pow(F.lit(recursions[n].q), F.col(place))
            for n in names})
        out = out.withColumns({
            f"_carry_{n}": F.last(F.when(F.col(place) == length - 1, F.col(f"_in_{n}")),
                                  ignorenulls=True).over(earlier)
            for n in names})
        values = {}
        for n in names:
            value = F.col(f"_in_{n}") + F.coalesce(F.col(f"_carry_{n}"), F.lit(0.0)) * F.pow(
                F.lit(recursions[n].q), F.col(place) + 1)
            shown = recursions[n].shown
            values[n] = value if shown is None else F.when(shown, value)
        out = out.withColumns(values)
        out = out.drop(block, place, *[f"_in_{n}" for n in names],
                       *[f"_carry_{n}" for n in names])
    return out


def ema(c, alpha: float, number: str) -> Recursion:
    """Seeded with the first value: y1 = x1, then alpha*x + (1-alpha)*y."""
    x = col(c)
    return Recursion(F.when(F.col(number) == 1, x).otherwise(x * alpha), 1.0 - alpha)


def ema_span(c, span: int, number: str) -> Recursion:
    return ema(c, 2.0 / (span + 1), number)


def mean_seeded(c, n: int, number: str, series: Series, alpha: float | None = None,
                offset: int = 0) -> Recursion:
    """Null before bar ``n + offset``, there the mean of the ``n`` values, then
    smoothing with ``alpha`` (1/n, Wilder, unless given)."""
    a = 1.0 / n if alpha is None else alpha
    x = col(c)
    at = F.col(number)
    first = n + offset
    seed = F.avg(x).over(series.last(n))
    return Recursion(F.when(at == first, seed).when(at > first, x * a), 1.0 - a,
                     shown=at >= first)


def sum_seeded(c, n: int, number: str, series: Series, first: int) -> Recursion:
    """Sum of ``n`` values at bar ``first``, then y - y/n + x."""
    x = col(c)
    at = F.col(number)
    seed = F.sum(x).over(series.last(n))
    return Recursion(F.when(at == first, seed).when(at > first, x), 1.0 - 1.0 / n,
                     shown=at >= first)
