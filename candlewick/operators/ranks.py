"""Exact ranks and quantiles without putting a group into one task.

Values are first collapsed to (value, count), which the map side combines, so a
value held by a third of the rows is one row from there on.  The distinct values
are range-partitioned by (group, value); the partition number is stored with
them.  Counts below a value = counts of the group's earlier partitions + running
count inside its own.  A large group simply spans several partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.session import cut, small


def value_positions(df: DataFrame, group: list[str], value: str, bins: int | None = None) -> DataFrame:
    """(group, value, n_equal, n_below, n_all) for each distinct non-null value.

    ``bins`` is the number of range partitions, by default the session's.  They
    are written down: two passes read them, and a range partitioning computed
    twice need not fall the same way.
    """
    n = bins or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*group, value)
              .agg(F.count(F.lit(1)).alias("n_equal")))
    placed = cut(counts.repartitionByRange(n, *group, value).withColumn("_bin", F.spark_partition_id()))
    # at most one row per partition and group in it
    in_order = Window.partitionBy(*group).orderBy("_bin") if group else Window.orderBy("_bin")
    totals = (placed.groupBy(*group, "_bin").agg(F.sum("n_equal").alias("_n"))
              .withColumn("_lower", F.sum("_n").over(in_order) - F.col("_n"))
              .withColumn("n_all", F.sum("_n").over(Window.partitionBy(*group))).drop("_n"))
    inside = Window.partitionBy(*group, "_bin").orderBy(value)
    return (placed.join(small(totals), [*group, "_bin"])
            .withColumn("n_below", F.col("_lower") + F.sum("n_equal").over(inside) - F.col("n_equal"))
            .select(*group, value, "n_equal", "n_below", "n_all"))


def average_ranks(df: DataFrame, group: list[str], values: list[str], bins: int | None = None) -> DataFrame:
    """Add ``rank_<value>``: 1-based rank in the group, ties sharing their mean.

    Rows are first collapsed to distinct combinations with a count ``n_rows``;
    weigh by it when aggregating.
    """
    out = _ranked(df.groupBy(*group, *values).agg(F.count(F.lit(1)).alias("n_rows")), df, group, values, bins)
    return out.drop(*[f"_all_{v}" for v in values])


def _ranked(out: DataFrame, df: DataFrame, group: list[str], values: list[str], bins: int | None) -> DataFrame:
    """``out`` with ``rank_<value>`` and ``_all_<value>``, the rows of the group, from those of ``df``."""
    for v in values:
        places = value_positions(df, group, v, bins)
        rank = F.col("n_below") + (F.col("n_equal") + 1) / 2
        out = out.join(places.select(*group, v, rank.alias(f"rank_{v}"), F.col("n_all").alias(f"_all_{v}")), [*group, v])
    return out


def spearman(df: DataFrame, group: list[str], x: str, y: str, out: str = "ic", bins: int | None = None) -> DataFrame:
    """Rank correlation per group over rows where both are present."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    # no join on the group alone: a few groups would leave a few tasks with all rows
    ranks = both.groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("n_rows"))
    ranks = _ranked(ranks, both, group, [x, y], bins).withColumnRenamed(f"_all_{x}", "n_obs")
    n, a, b = F.col("n_rows"), F.col(f"rank_{x}"), F.col(f"rank_{y}")
    # ranks of n rows average (n+1)/2 exactly: centre before summing
    mid = (F.col("n_obs") + 1) / 2
    sums = ranks.groupBy(*group).agg(
        F.sum(n * (a - mid) * (b - mid)).alias("_ab"), F.sum(n * (a - mid) * (a - mid)).alias("_aa"),
        F.sum(n * (b - mid) * (b - mid)).alias("_bb"), F.max("n_obs").alias("n_obs"))
    value = F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb")))
    return sums.select(*group, value.alias(out), "n_obs")


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float],
                    bins: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per entry of ``probs``."""
    places = value_positions(df, group, value, bins)
    picks = []
    for name, p in probs.items():
        at = (F.col("n_all") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)

        def covers(k):
            return (F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n_equal"))

        picks += [F.max(F.when(covers(low), F.col(value))).alias(f"_lo_{name}"),
                  F.max(F.when(covers(high), F.col(value))).alias(f"_hi_{name}"),
                  F.max(at - low).alias(f"_part_{name}")]
    found = places.groupBy(*group).agg(*picks)
    return found.select(*group, *[
        (F.col(f"_lo_{n}") + F.col(f"_part_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in probs])


def _in_ranges(df: DataFrame, group: list[str], order: list[Column | str], n: Column, bins: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows range-partitioned by (group, order) and written with the number of their
    partition, ``_bin``; and per group and partition ``_n`` (its sum of ``n``), ``_lower``
    (that of the group's earlier ones) and ``_all``."""
    bins = bins or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(bins, *group, *order).withColumn("_bin", F.spark_partition_id()))
    # at most one row per partition and group in it
    by_group = Window.partitionBy(*group)
    totals = placed.groupBy(*group, "_bin").agg(F.sum(n).alias("_n"))
    return placed, totals.withColumns({"_lower": F.sum("_n").over(by_group.orderBy("_bin")) - F.col("_n"), "_all": F.sum("_n").over(by_group)})


def row_numbers(df: DataFrame, group: list[str], order: list[Column | str], bins: int | None = None) -> DataFrame:
    """Add ``place`` (1-based row number in the group) and ``n_all`` (its rows).

    A large group spans several range partitions, so no task holds a whole one.
    ``order`` should tell the rows of a group apart."""
    placed, totals = _in_ranges(df, group, order, F.lit(1), bins)
    inside = F.row_number().over(Window.partitionBy(*group, "_bin").orderBy(*order))
    rows = placed.withColumn("_place", inside).join(small(totals), [*group, "_bin"])
    return rows.select(*df.columns, (F.col("_lower") + F.col("_place")).alias("place"), F.col("_all").alias("n_all"))


def running_totals(df: DataFrame, group: list[str], order: list[Column | str], value: str, out: str, bins: int | None = None) -> DataFrame:
    """Add ``place`` (1-based row number in the group, an int) and ``out``, the sum of ``value`` over the
    group's rows up to this one (null before the first that is not null).

    A large group spans several range partitions, so no task holds a whole one.  Rows with
    null in ``group`` form a group.  ``order`` should tell the rows of a group apart."""
    n = bins or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *group, *order).withColumn("_bin", F.spark_partition_id()))
    # at most one row per partition and group in it
    earlier = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    totals = totals.select(F.col("_bin").alias("_b"), *[F.col(g).alias(f"_g_{g}") for g in group],
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_lower"), F.sum("_s").over(earlier).alias("_sum"))
    inside = Window.partitionBy(*group, "_bin").orderBy(*order)
    rows = placed.withColumns({"_place": F.row_number().over(inside), "_upto": F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    same = F.col("_bin") == F.col("_b")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    total = F.when(F.col("_sum").isNull(), F.col("_upto")).otherwise(F.col("_sum") + F.coalesce("_upto", F.lit(0)))
    return rows.join(small(totals), same).select(*df.columns, (F.col("_lower") + F.col("_place")).cast("int").alias("place"), total.alias(out))


def _coarse(x: Column) -> Column:
    """A whole number that never falls as x rises: sign and logarithm, 256 steps a power of two."""
    steps = F.floor(F.log(F.abs(x)) * (256 / math.log(2))).cast("double")
    place = F.least(F.greatest(steps, F.lit(-290_000.0)), F.lit(290_000.0)) + 300_000
    return F.when(F.isnan(x), F.lit(700_000.0)).when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * place).cast("int")


def grouped_quantiles(df: DataFrame, group: list[str], values: list[str], probs: list[float]) -> DataFrame:
    """Per group and each of ``values``: ``<value>_q``, its linear-interpolation
    quantiles at ``probs`` as an array, and ``<value>_n``, its rows that are not null
    (both null where there are none).

    Exact, for all values together and in two rounds: values are counted per narrow
    range, on the map side first, which tells the ranges that hold the ranks wanted;
    only the distinct values of those are then put in order.  A task sees the ranges
    of a group, or the distinct values of one range, never a group.  ``df`` is read twice.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("_v"), F.col(v).cast("double").alias("_x")) for i, v in enumerate(values)])
    long = df.select(*group, F.explode(pairs).alias("_p")).select(*group, "_p._v", "_p._x").filter("_x IS NOT NULL").withColumn("_bin", _coarse(F.col("_x")))
    key = [*group, "_v"]
    by_key = Window.partitionBy(*key)
    totals = long.groupBy(*key, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    totals = totals.withColumns({"_lower": F.sum("_n").over(by_key.orderBy("_bin")) - F.col("_n"), "_all": F.sum("_n").over(by_key)})
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("_all") - 1) * F.lit(float(p))).alias("at")) for i, p in enumerate(probs)]))
    ranks = totals.select("*", at.alias("_r")).select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("_high"), F.floor("_r.at").alias("_k")), F.struct(F.lit(1).alias("_high"), F.ceil("_r.at").alias("_k")))).alias("_side"))
    here = (F.col("_lower") <= F.col("_side._k")) & (F.col("_side._k") < F.col("_lower") + F.col("_n"))
    wanted = ranks.filter(here).groupBy(*key, "_bin", "_lower", "_all").agg(F.collect_list(F.struct("_r.i", "_r.at", "_side._high", "_side._k")).alias("_ranks"))
    # a few rows per group and value, written down so that their true size decides on the join
    wanted = small(cut(wanted))
    inside = long.join(wanted.select(*key, "_bin"), [*key, "_bin"]).groupBy(*key, "_bin", "_x").agg(F.count(F.lit(1)).alias("_c"))
    inside = inside.join(wanted, [*key, "_bin"]).withColumn("_upto", F.col("_lower") + F.sum("_c").over(Window.partitionBy(*key, "_bin").orderBy("_x")))
    hits = inside.select(*key, "_x", "_all", F.explode(F.filter("_ranks", lambda r: (r["_k"] < F.col("_upto")) & (r["_k"] >= F.col("_upto") - F.col("_c")))).alias("_hit"))
    found = hits.groupBy(*key, "_all", "_hit.i", "_hit.at").agg(F.max(F.when(F.col("_hit._high") == 0, F.col("_x"))).alias("_lo"), F.max(F.when(F.col("_hit._high") == 1, F.col("_x"))).alias("_hi"))
    quantile = F.col("_lo") + (F.col("at") - F.floor("at")) * (F.col("_hi") - F.col("_lo"))
    found = found.groupBy(*key, "_all").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", quantile.alias("q")))), lambda r: r["q"]).alias("_q"))
    return found.groupBy(*group).agg(*[e for i, v in enumerate(values) for e in (
        F.max(F.when(F.col("_v") == i, F.col("_q"))).alias(f"{v}_q"), F.max(F.when(F.col("_v") == i, F.col("_all"))).alias(f"{v}_n"))])
