"""Split long series so that no single task holds one.

Window operators put a whole series into one task.  For bars the primary key
(code, date) bounds a series by the number of dates.  Ticks and calls have no
such bound: one source may hold a third of all rows.  :func:`split_series`
cuts each series into segments of exactly ``max_rows`` rows (the last may be
shorter) and repeats, in front of every segment, the ``halo`` rows that precede it.
A rolling window of up to ``halo`` rows, or a recursion whose start no longer
shows after ``halo`` rows, then gives the same values as on the unsplit series.

The plan: rows are range-partitioned by (key, order) and written down with the
number of their partition; a row's number in its series is the rows of the key in
earlier partitions plus its place inside its own; segments follow from that.  No
task holds more than a partition or a segment with its halo.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from candlewick.functions.series import Series
from candlewick.session import cut

SEGMENT, OWN, OFFSET = "_segment", "_own", "_offset"


def split_series(df: DataFrame, key: list[str], order: Sequence[str], halo: int,
                 max_rows: int = 1_000_000, bins: int | None = None) -> DataFrame:
    """Add ``_segment``, ``_own`` (false for repeated rows) and ``_offset`` (rows
    of the series before the first row of the segment, repeated rows included).

    ``order`` must tell the rows of a series apart.  Keep ``_own`` rows only after
    the windows; bar number = ``_offset`` + row_number in (key, segment).  ``bins``
    is the number of range partitions, by default the session's.
    """
    if max_rows < halo:
        raise ValueError("a segment must be at least as long as the halo")
    n = bins or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *key, *order).withColumn("_bin", F.spark_partition_id()))
    # at most one row per key and partition
    by_key = Window.partitionBy(*key)
    before = (placed.groupBy(*key, "_bin").agg(F.count(F.lit(1)).alias("_n"))
              .withColumns({"_from": F.sum("_n").over(by_key.orderBy("_bin")) - F.col("_n"), "_all": F.sum("_n").over(by_key)}).drop("_n"))
    place = F.row_number().over(Window.partitionBy(*key, "_bin").orderBy(*order)) - 1
    rows = placed.withColumn("_place", place).join(before, [*key, "_bin"]).withColumn("_no", F.col("_from") + F.col("_place"))
    own, last = F.floor(F.col("_no") / max_rows), F.floor((F.col("_all") - 1) / max_rows)
    reach = F.least(F.floor((F.col("_no") + halo) / max_rows), last)
    rows = rows.withColumn(SEGMENT, F.explode(F.sequence(own, reach)))
    return rows.withColumns({OWN: F.col(SEGMENT) == own, OFFSET: F.greatest(F.col(SEGMENT) * max_rows - halo, F.lit(0))}).drop("_bin", "_place", "_from", "_all", "_no")


def over_segments(df: DataFrame, build: Callable[[DataFrame, Series], DataFrame], order: tuple[str, ...], halo: int,
                  key: str = "ts_code", max_rows: int = 1_000_000) -> DataFrame:
    """Run a panel function on series too long for one task.

    ``build(df, series)`` gets the segments as its series and ``bar_no`` counted
    from the start of the whole series.  ``halo`` must cover its longest window and
    the warm-up of its recursions (:func:`candlewick.functions.recursion.warm_up`).
    Functions that look at a whole series (minimum-length guards) do not fit.
    """
    s = Series((key, SEGMENT), order)
    rows = split_series(df, [key], order, halo, max_rows)
    rows = rows.withColumn("bar_no", F.col(OFFSET) + s.number()).drop(OFFSET)
    return build(rows, s).filter(OWN).drop(SEGMENT, OWN)
