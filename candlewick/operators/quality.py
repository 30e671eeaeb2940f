"""Data-quality checks as rows: (check, valid, violations, sample).

The counts of one table come from one pass; a sample is the first ``sample`` of
the violating keys in order, which is all a sample is for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE = 100


def _row(check, valid: Column, violations: Column, sample: Column | None = None) -> list[Column]:
    empty = F.array().cast("array<string>")
    return [F.lit(check).alias("check"), valid.alias("valid"), violations.cast("long").alias("violations"),
            (sample if sample is not None else empty).alias("sample")]


def _error(df: DataFrame, check: str) -> DataFrame:
    return df.sparkSession.range(1).select(*_row(check, F.lit(False), F.lit(None).cast("long"), F.array(F.lit("column not found"))))


def completeness(df: DataFrame, expected: int | None = None) -> DataFrame:
    """actual_count, expected_count, missing_pct, valid."""
    agg = df.agg(F.count(F.lit(1)).alias("actual_count"))
    want = F.lit(expected).cast("long")
    missing = F.lit(0.0) if not expected else F.greatest(F.lit(0.0), (want - F.col("actual_count")) / want * 100)
    valid = F.lit(True) if expected is None else F.col("actual_count") >= want
    return agg.select(valid.alias("valid"), "actual_count", want.alias("expected_count"), F.round(missing, 2).alias("missing_pct"))


def _sample(violations: DataFrame, value: Column, size: int) -> DataFrame:
    """The first ``size`` values as one array; the limit stands before the collect."""
    return violations.select(value.alias("v")).orderBy("v").limit(size).agg(F.array_sort(F.collect_list("v")).alias("sample"))


def uniqueness(df: DataFrame, keys: list[str], sample: int = SAMPLE) -> DataFrame:
    """Rows in groups that share a key.  Counting combines on the map side."""
    if set(keys) - set(df.columns):
        return _error(df, "unique")
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_v"))
    first = _sample(groups, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), sample)
    return total.crossJoin(F.broadcast(first)).select(*_row("unique", F.col("_v") == 0, F.col("_v"), F.col("sample")))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per required column with its number of nulls (NaN counts as null)."""
    missing = [c for c in columns if c not in df.columns]
    kinds = dict(df.dtypes)

    def is_null(c):
        return F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()

    have = [c for c in columns if c not in missing]
    agg = df.agg(*[F.sum(is_null(c).cast("long")).alias(c) for c in have])
    rows = F.array(*[F.struct(*_row(f"not_null:{c}", F.col(c) == 0, F.coalesce(F.col(c), F.lit(0)))) for c in have])
    out = agg.select(F.explode(rows).alias("r")).select("r.*")
    return reduce(lambda a, c: a.unionByName(_error(df, f"not_null:{c}")), missing, out)


def in_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """Values outside [low, high]; null is outside."""
    if column not in df.columns:
        return _error(df, f"range:{column}")
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col(column) >= low)
    if high is not None:
        ok = ok & (F.col(column) <= high)
    bad = df.filter(~F.coalesce(ok, F.lit(False)))
    total = bad.agg(F.count(F.lit(1)).alias("_v"))
    first = _sample(bad, F.col(column).cast("string"), sample)
    return total.crossJoin(F.broadcast(first)).select(*_row(f"range:{column}", F.col("_v") == 0, F.col("_v"), F.col("sample")))


BACKTEST_COLUMNS = ["open", "high", "low", "close", "vol"]


def backtest_input(df: DataFrame, columns: list[str] = BACKTEST_COLUMNS) -> DataFrame:
    return null_counts(df, columns)


def all_checks(df: DataFrame, keys: list[str], required: list[str], ranges: dict[str, tuple[float | None, float | None]],
               min_rows: int = 0) -> DataFrame:
    """Every check of a table: counts of nulls, ranges and rows in one aggregate,
    uniqueness in another."""
    kinds = dict(df.dtypes)

    def is_null(c):
        return F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()

    def outside(c, low, high):
        ok = (F.col(c) >= low if low is not None else F.lit(True)) & (F.col(c) <= high if high is not None else F.lit(True))
        return ~F.coalesce(ok, F.lit(False))

    agg = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(is_null(c).cast("long")).alias(f"_null_{c}") for c in required],
                 *[F.sum(outside(c, lo, hi).cast("long")).alias(f"_range_{c}") for c, (lo, hi) in ranges.items()])
    rows = [F.struct(*_row("complete", F.col("_rows") >= min_rows, F.greatest(F.lit(min_rows) - F.col("_rows"), F.lit(0))))]
    rows += [F.struct(*_row(f"not_null:{c}", F.col(f"_null_{c}") == 0, F.col(f"_null_{c}"))) for c in required]
    rows += [F.struct(*_row(f"range:{c}", F.col(f"_range_{c}") == 0, F.col(f"_range_{c}"))) for c in ranges]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*").unionByName(uniqueness(df, keys))
