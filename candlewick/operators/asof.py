"""As-of joins, interval joins and panel assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.session import cut, small


def asof_join(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str,
              columns: list[str], max_age_days: int | None = None, bins: int | None = None) -> DataFrame:
    """Left rows with the latest right row at or before their time, per key.

    Only the different (key, time) of the left and the right rows' ``columns`` go
    through the sort: they are stacked, range-partitioned by key and time into
    ``bins`` (by default the session's shuffle partitions) and written down with the
    number of their partition.  The last right row is carried forward inside a
    partition; what a key brings along from earlier partitions is one row for each
    partition that begins in the middle of a key.  A key holding any share of the
    rows is therefore spread over as many partitions as its rows fill.

    On equal times the right row comes first, so a report of the same day counts;
    of several right rows of one key and time the same one wins in every run.  Left
    rows without key or time stay, with nulls; such right rows are not found.
    """
    n = bins or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_k{i}" for i in range(len(key))]
    named = [F.col(k).alias(n) for k, n in zip(key, keys)]
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, "_t"]])
    asked = left.select(*named, F.col(left_time).alias("_t")).filter(known).distinct().withColumns({"_side": F.lit(1), "_tie": F.lit(0).cast("long")})
    told = right.select(*named, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.xxhash64(*columns).alias("_tie"),
                        F.struct(F.col(right_time).alias("_at"), *columns).alias("_hit")).filter(known)
    stacked = asked.unionByName(told, allowMissingColumns=True)
    placed = cut(stacked.repartitionByRange(n, *keys, "_t", "_side", "_tie").withColumn("_bin", F.spark_partition_id()))
    # a row per key and partition; kept where a key began in an earlier partition, once a partition at most
    by_key = Window.partitionBy(*keys).orderBy("_bin")
    last = F.max_by("_hit", F.when(F.col("_side") == 0, F.struct("_t", "_tie")))
    carried = (placed.groupBy(*keys, "_bin").agg(last.alias("_last"))
               .withColumns({"_part": F.row_number().over(by_key), "_carried": F.last("_last", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, -1))})
               .filter("_part > 1").select(*keys, "_bin", "_carried"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    hits = placed.withColumn("_inside", F.last("_hit", ignorenulls=True).over(inside)).filter("_side = 1")
    # at most one row per partition: never more than ``bins``
    hits = hits.join(F.broadcast(carried), [*keys, "_bin"], "left").withColumn("_found", F.coalesce("_inside", "_carried"))
    found: Column = F.col("_found")
    if max_age_days is not None:
        found = F.when(F.datediff("_t", F.col("_found._at")) <= max_age_days, F.col("_found"))
    hits = hits.select(*keys, "_t", found.alias("_found")).filter("_found IS NOT NULL")
    # named so that the two sides share no column
    own = left.select(F.struct(*left.columns).alias("_row"), *named, F.col(left_time).alias("_t"))
    joined = own.join(hits, [*keys, "_t"], "left")
    return joined.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in columns])


def held_on(positions: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    """(date, position) for every calendar date a position is held:
    buy_date <= date < sell_date, or still open.

    Calendar dates are numbered; a small table gives, for each day of the span,
    how many calendar dates lie on or before it.  A position looks up its first and
    last number and yields exactly the dates between: no range join, and no row
    that is not part of the result.
    """
    one_by_one = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    dates = calendar.select(date).distinct()
    span = dates.agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    # one row per day of the calendar's span
    days = (span.select(F.explode(F.sequence("_a", "_b")).alias(date))
            .join(dates.withColumn("_on", F.lit(1)), date, "left")
            .withColumn("_upto", F.sum(F.coalesce("_on", F.lit(0))).over(one_by_one)))
    first = days.select(F.col(date).alias("_first"), (F.col("_upto") - F.coalesce("_on", F.lit(0)) + 1).alias("_i"))
    last = days.select(F.col(date).alias("_last"), F.col("_upto").alias("_j"))
    numbered = days.filter("_on = 1").select(F.col("_upto").alias("_no"), date)
    held = positions.crossJoin(F.broadcast(span)).withColumns({  # span is one row
        "_first": F.greatest(F.col("buy_date"), F.col("_a")),
        "_last": F.least(F.coalesce(F.date_sub("sell_date", 1), F.col("_b")), F.col("_b"))})
    held = held.filter("buy_date IS NOT NULL AND _first <= _last").join(small(first), "_first").join(small(last), "_last").filter("_i <= _j")
    out = held.withColumn("_no", F.explode(F.sequence("_i", "_j"))).join(small(numbered), "_no")
    return out.select(*positions.columns, date)


def held_totals(positions: DataFrame, calendar: DataFrame, by: list[str], sums: list[str], date: str = "date") -> DataFrame:
    """Number ``n`` and sums of the positions held on each calendar date, per ``by``;
    held as in :func:`held_on`.

    A position is two changes, at the first calendar dates on or after its buy and
    its sell date; changes are summed per date and run up, so no row is made per
    position and date held.
    """
    one_by_one = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    dates = calendar.select(date).distinct()
    span = dates.agg(F.min(date).alias("_a"), F.max(date).alias("_b"), F.count(F.lit(1)).alias("_all"))
    # one row per day of the calendar's span
    days = (span.select(F.explode(F.sequence("_a", "_b")).alias(date))
            .join(dates.withColumn("_on", F.lit(1)), date, "left")
            .withColumn("_upto", F.sum(F.coalesce("_on", F.lit(0))).over(one_by_one)))
    number = days.select(F.col(date).alias("_day"), (F.col("_upto") - F.coalesce("_on", F.lit(0)) + 1).alias("_no"))
    held = positions.crossJoin(F.broadcast(span)).filter(  # span is one row
        "buy_date <= _b AND (sell_date IS NULL OR sell_date > greatest(buy_date, _a))")
    ends = F.filter(F.array(F.struct(F.greatest("buy_date", "_a").alias("_day"), F.lit(1).alias("_sign")),
                            F.struct(F.when(F.col("sell_date") <= F.col("_b"), F.col("sell_date")).alias("_day"), F.lit(-1).alias("_sign"))), lambda e: e["_day"].isNotNull())
    changes = held.select(*by, *sums, "_all", F.explode(ends).alias("_e")).select(*by, *sums, "_all", "_e.*")
    per_date = (changes.groupBy(*by, "_day").agg(F.sum("_sign").alias("_n"), F.max("_all").alias("_all"), *[F.sum(F.col("_sign") * F.col(c)).alias(c) for c in sums])
                .join(small(number), "_day").groupBy(*by, "_no").agg(F.sum("_n").alias("_n"), F.max("_all").alias("_all"), *[F.sum(c).alias(c) for c in sums]))
    # one row per group and date from here on
    in_order = Window.partitionBy(*by).orderBy("_no")
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    run = per_date.select(*by, "_no", (F.coalesce(F.lead("_no").over(in_order), F.col("_all") + 1) - 1).alias("_last"),
                          F.sum("_n").over(upto).alias("n"), *[F.sum(c).over(upto).alias(c) for c in sums]).filter("n > 0 AND _no <= _last")
    numbered = days.filter("_on = 1").select(F.col("_upto").alias("_no"), date)
    return run.withColumn("_no", F.explode(F.sequence("_no", "_last"))).join(small(numbered), "_no").select(*by, date, "n", *sums)


def assemble_panel(base: DataFrame, datasets: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left-join daily datasets onto the base; on a name clash the earlier frame's
    column stays.  Numbers become doubles.  Datasets keyed by date alone (an index)
    join on what they have."""
    def join(acc: DataFrame, extra: DataFrame) -> DataFrame:
        on = [k for k in keys if k in extra.columns]
        new = [c for c in extra.columns if c not in acc.columns]
        side = extra.select(*on, *new)
        return acc.join(small(side), on, "left")

    out = reduce(join, datasets, base)
    numeric = ("int", "bigint", "smallint", "tinyint", "float")
    return out.select(*[F.col(c).cast("double").alias(c) if t in numeric or t.startswith("decimal") else F.col(c)
                        for c, t in out.dtypes])
