"""Rolling, offset and cumulative columns of an ordered series.

A :class:`Series` names the partition and order columns once; every column
built from it shares one window spec, so Spark plans a single exchange and a
single sort for any number of them.

Row counts are bars, not calendar days.  A *strict* window is null until it
holds ``n`` non-null values; a *partial* one uses what is there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark import SparkContext
from pyspark.sql import Column, Window, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den, default=None) -> Column:
    """``num / den``; ``default`` (null unless given) on a zero or null divisor."""
    out = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


@lru_cache(maxsize=512)
def _window(context, key, order, start, end):
    """Window specs are immutable; building one costs several calls into the JVM."""
    spec = Window.partitionBy(*key).orderBy(*order)
    return spec if start is None else spec.rowsBetween(start, end)


@dataclass(frozen=True)
class Series:
    key: tuple[str, ...] = ("ts_code",)
    order: tuple[str, ...] = ("trade_date",)

    # -- frames ---------------------------------------------------------
    @property
    def w(self):
        return _window(SparkContext._active_spark_context, self.key, self.order, None, None)

    def last(self, n: int):
        """The current bar and the ``n - 1`` before it."""
        return self.between(-(n - 1), 0)

    def between(self, start: int, end: int):
        return _window(SparkContext._active_spark_context, self.key, self.order, start, end)

    @property
    def so_far(self):
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def before(self):
        return self.w.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def whole(self):
        return Window.partitionBy(*self.key)

    # -- position -------------------------------------------------------
    def number(self) -> Column:
        """1-based bar number."""
        return F.row_number().over(self.w)

    def ref(self, c, k: int = 1, default=None) -> Column:
        return F.lag(col(c), k, default).over(self.w)

    def ahead(self, c, k: int = 1) -> Column:
        return F.lead(col(c), k).over(self.w)

    def change(self, c, k: int = 1) -> Column:
        return col(c) - self.ref(c, k)

    def pct_change(self, c, k: int = 1) -> Column:
        return ratio(self.change(c, k), self.ref(c, k))

    def log_return(self, c, k: int = 1) -> Column:
        # ln of null or of a non-positive number is null
        return F.ln(ratio(c, self.ref(c, k)))

    # -- rolling --------------------------------------------------------
    def _guard(self, c, n: int, strict: bool, value: Column) -> Column:
        if not strict:
            return value
        return F.when(F.count(col(c)).over(self.last(n)) == n, value)

    def mean(self, c, n: int, strict: bool = False) -> Column:
        return self._guard(c, n, strict, F.avg(col(c)).over(self.last(n)))

    def sum(self, c, n: int, strict: bool = False) -> Column:
        return self._guard(c, n, strict, F.sum(col(c)).over(self.last(n)))

    def lowest(self, c, n: int, strict: bool = False) -> Column:
        return self._guard(c, n, strict, F.min(col(c)).over(self.last(n)))

    def highest(self, c, n: int, strict: bool = False) -> Column:
        return self._guard(c, n, strict, F.max(col(c)).over(self.last(n)))

    def std(self, c, n: int, strict: bool = False, sample: bool = False) -> Column:
        fn = F.stddev_samp if sample else F.stddev_pop
        return self._guard(c, n, strict, fn(col(c)).over(self.last(n)))

    def weighted_mean(self, c, n: int) -> Column:
        """Weights 1..n, the newest heaviest; null until ``n`` bars."""
        terms = [self.ref(c, k) * (n - k) if k else col(c) * n for k in range(n)]
        return reduce(lambda a, b: a + b, terms) / (n * (n + 1) / 2)

    def mean_abs_dev(self, c, n: int, strict: bool = True) -> Column:
        """Mean absolute deviation from the mean of the same window."""
        frame = F.collect_list(col(c)).over(self.last(n))
        mean = F.avg(col(c)).over(self.last(n))
        dev = F.aggregate(frame, F.lit(0.0), lambda a, x: a + F.abs(x - mean))
        return self._guard(c, n, strict, dev / F.size(frame))

    def exists(self, cond, n: int) -> Column:
        return F.max(F.coalesce(col(cond), F.lit(False))).over(self.last(n))

    def count_if(self, cond, n: int) -> Column:
        return F.sum(F.when(col(cond), 1).otherwise(0)).over(self.last(n))

    def sum_if(self, cond, c, n: int) -> Column:
        return F.sum(F.when(col(cond), col(c)).otherwise(0.0)).over(self.last(n))

    # -- extremes with position ----------------------------------------
    def at_highest(self, c, n: int, number: str, fields: list[str],
                   latest: bool = True, start: int | None = None, end: int = 0) -> Column:
        """Struct (top, at, *fields) of the bar holding the window maximum.

        ``number`` is the bar-number column.  Of equal maxima the latest bar is
        taken, or the earliest with ``latest=False``; comparing structs makes
        the choice deterministic.
        """
        first = -(n - 1) if start is None else start
        at = F.col(number) if latest else -F.col(number)
        picked = F.max(F.struct(col(c).alias("top"), at.alias("at"), *fields))
        return picked.over(self.w.rowsBetween(first, end))

    def bars_since_highest(self, c, n: int, number: str) -> Column:
        return F.col(number) - self.at_highest(c, n, number, []).getField("at")

    # -- cumulative -----------------------------------------------------
    def cum_sum(self, c) -> Column:
        return F.sum(col(c)).over(self.so_far)

    def cum_product(self, c) -> Column:
        return F.product(col(c)).over(self.so_far)

    def cum_max(self, c) -> Column:
        return F.max(col(c)).over(self.so_far)

    def cum_min(self, c) -> Column:
        return F.min(col(c)).over(self.so_far)

    def compounded(self, r) -> Column:
        return self.cum_product(1.0 + col(r)) - 1.0

    def fill_forward(self, c) -> Column:
        return F.last(col(c), ignorenulls=True).over(self.so_far)

    def drawdown(self, value, floor: float | None = None) -> Column:
        """value / running peak - 1 (zero or negative)."""
        peak = self.cum_max(value)
        if floor is not None:
            peak = F.greatest(peak, F.lit(float(floor)))
        return ratio(col(value) - peak, peak)


BARS = Series()
