"""Performance and overview reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.functions import money
from candlewick.functions.series import ratio
from candlewick.operators.ranks import exact_quantiles
from candlewick.session import small

YEAR = 252


def _won(profit: str) -> Column:
    return F.sum(F.when(F.col(profit) > 0, 1).otherwise(0))


def sold(positions: DataFrame) -> DataFrame:
    return positions.filter("status = 'sold'").withColumn("holding_days", F.datediff("sell_date", "buy_date"))


def group_performance(trades: DataFrame, keys: list[str], profit: str = "profit_loss", code: str | None = "code",
                      days: str | None = "holding_days") -> DataFrame:
    """Trades, wins, win rate (%), total and mean profit per group.

    Plain aggregates: the map side combines, so a group of any size is cheap.
    """
    n = F.count(F.lit(1))
    aggs = [n.alias("trade_count"), _won(profit).alias("win_count"), (_won(profit) * 100 / n).alias("win_rate"),
            F.sum(profit).alias("total_profit"), F.avg(profit).alias("avg_profit")]
    if code:
        aggs.append(F.countDistinct(code).alias("stock_count"))
    if days:
        aggs.append(F.avg(days).alias("avg_holding_days"))
    return trades.groupBy(*keys).agg(*aggs)


def with_all_groups(report: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """Groups without trades appear with zeros."""
    spark = report.sparkSession
    wanted = spark.createDataFrame([(g,) for g in groups], f"{key} string")
    numbers = [c for c in report.columns if c != key]
    return wanted.join(report, key, "left").fillna(0, numbers)


CAP_GROUPS = ["small", "mid", "large", "xlarge"]
HOLDING_GROUPS = ["0-5", "6-10", "11-20", "21-30", "30+"]


def by_cap_group(trades: DataFrame, cap: str) -> DataFrame:
    rows = trades.withColumn("cap_group", money.cap_bucket(cap)).filter(F.col("cap_group").isNotNull())
    return with_all_groups(group_performance(rows, ["cap_group"], code=None, days=None), "cap_group", CAP_GROUPS)


def holding_distribution(trades: DataFrame, days: str = "holding_days") -> DataFrame:
    rows = trades.withColumn("bucket", money.holding_bucket(days)).filter(F.col("bucket").isNotNull())
    return with_all_groups(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", HOLDING_GROUPS)


def by_month(trades: DataFrame, date: str = "sell_date") -> DataFrame:
    rows = trades.filter(F.col(date).isNotNull()).withColumn("month", F.date_format(date, "yyyy-MM"))
    return group_performance(rows, ["month"], code=None, days=None)


def trade_summary(trades: DataFrame, capital: float, risk_pct: float = 0.03, zero_is_loss: bool = True) -> DataFrame:
    """One row over all closed trades; ``zero_is_loss`` counts a break-even trade as a loss."""
    p = F.col("profit_loss")
    lost = p <= 0 if zero_is_loss else p < 0
    agg = trades.agg(F.count(F.lit(1)).alias("total_trades"), F.sum(p).alias("total_profit"), _won("profit_loss").alias("win_count"),
                     F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_profit"),
                     F.coalesce(F.abs(F.avg(F.when(lost, p))), F.lit(0.0)).alias("avg_loss"),
                     F.max(p).alias("best_trade"), F.min(p).alias("worst_trade"), F.avg("holding_days").alias("avg_holding_days"))
    win = ratio("win_count", "total_trades", 0)
    return agg.withColumns({
        "win_rate": win * 100, "profit_loss_ratio": F.when(F.col("avg_loss") > 0, ratio("avg_profit", "avg_loss")).otherwise(0.0),
        "expectancy": ratio("total_profit", "total_trades", 0),
        "expectancy_r": win * F.col("avg_profit") / (capital * risk_pct) - (1 - win)})


def equity_statistics(curve: DataFrame, keys: list[str] | None = None, value: str = "total_value", date: str = "date",
                      risk_free: float = 0.0, excess: str = "annual", downside_default: float = 0.0,
                      capital: float | None = None) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, drawdown and Calmar of an equity curve.

    One row per date and curve enters.  ``excess='daily'`` takes the Sharpe ratio of
    daily returns instead of the annual return.  Volatility is the population
    deviation.  ``capital`` replaces the first value as the base of the return.
    """
    k = list(keys or [])
    w = Window.partitionBy(*k).orderBy(date)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    df = curve.filter(v.isNotNull()).select(*k, date, value)
    df = df.withColumns({"_peak": F.max(v).over(upto), "_r": ratio(v, F.lag(v).over(w)) - 1})
    df = df.withColumn("_new", F.coalesce(F.col("_peak") > F.lag("_peak").over(w), F.lit(True)).cast("int"))
    df = df.withColumns({"_dd": ratio((F.col("_peak") - v) * 100, "_peak", 0), "_run": F.sum("_new").over(upto)})
    in_run = Window.partitionBy(*k, "_run").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_under", F.sum((F.col("_dd") > 0).cast("int")).over(in_run))
    agg = df.groupBy(*k).agg(
        F.min_by(value, date).alias("_first"), F.max_by(value, date).alias("_last"), F.count(F.lit(1)).alias("n_days"),
        (F.stddev_pop("_r") * math.sqrt(YEAR)).alias("_vol"), F.avg("_r").alias("_mean"), F.stddev_pop("_r").alias("_std"),
        (F.stddev_pop(F.when(F.col("_r") < 0, F.col("_r"))) * math.sqrt(YEAR)).alias("_down"),
        F.max("_dd").alias("max_drawdown"), F.avg("_dd").alias("avg_drawdown"), F.max("_under").alias("max_drawdown_duration"))
    base = F.col("_first") if capital is None else F.lit(float(capital))
    annual = F.pow(ratio("_last", base), F.lit(float(YEAR)) / F.col("n_days")) - 1
    down = F.coalesce(F.col("_down"), F.lit(downside_default))
    gain = annual - risk_free
    sharpe = ratio(gain, F.when(F.col("_vol") > 0, F.col("_vol")), 0) if excess == "annual" else (
        ratio(F.col("_mean") - risk_free / YEAR, F.when(F.col("_std") > 0, F.col("_std")), 0) * math.sqrt(YEAR))
    return agg.select(
        *k, "n_days", (ratio(F.col("_last") - base, base) * 100).alias("cumulative_return"), (annual * 100).alias("annualized_return"),
        (F.col("_vol") * 100).alias("volatility"), sharpe.alias("sharpe_ratio"),
        ratio(gain, F.when(down > 0, down), 0).alias("sortino_ratio"), "max_drawdown", "avg_drawdown", "max_drawdown_duration",
        ratio(annual * 100, F.when(F.col("max_drawdown") > 0, F.col("max_drawdown")), 0).alias("calmar_ratio"))


def resample_pnl(daily: DataFrame, unit: str, date: str = "date") -> DataFrame:
    """Per period (D, W ending Sunday, M, Y): summed result and return, last value,
    compounded return; labelled by the period's last day; empty periods appear."""
    ends = {"D": F.col(date), "W": F.date_add(date, 6 - F.weekday(date)), "M": F.last_day(date),
            "Y": F.make_date(F.year(date), F.lit(12), F.lit(31))}
    steps = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month", "Y": "interval 12 months"}
    agg = daily.groupBy(ends[unit].alias("period")).agg(
        F.sum("daily_pnl").alias("daily_pnl"), F.sum("daily_return").alias("daily_return"), F.max_by("total_value", date).alias("total_value"))
    if unit != "D":
        span = agg.agg(F.min("period").alias("a"), F.max("period").alias("b"))
        all_ = span.select(F.explode(F.expr(f"sequence(a, b, {steps[unit]})")).alias("period"))
        if unit == "M":
            all_ = all_.select(F.last_day("period").alias("period")).distinct()
        agg = all_.join(agg, "period", "left").fillna(0.0, ["daily_pnl", "daily_return"])
    upto = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return agg.withColumn("cumulative_return", F.product(1 + F.col("daily_return")).over(upto) - 1)


def year_by_month(df: DataFrame, date: str, value: Column) -> DataFrame:
    """An aggregate spread over twelve month columns, one row per year."""
    return (df.groupBy(F.year(date).alias("year")).pivot("month", list(range(1, 13))).agg(value)
            if "month" in df.columns else year_by_month(df.withColumn("month", F.month(date)), date, value))


def conditional_pivot(rows: DataFrame, key: str, name: str, value: str, wanted: dict[str, str], limit: int | None = None) -> DataFrame:
    """max(value where name = x) as one column per entry; keys where the first is
    missing are dropped; largest first."""
    first = next(iter(wanted))
    out = rows.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(a) for a, n in wanted.items()])
    out = out.filter(F.col(first).isNotNull())
    return out if limit is None else out.orderBy(F.col(first).desc_nulls_last(), key).limit(limit)


def batch_metrics(runs: DataFrame) -> DataFrame:
    """One row over the successful runs that traded."""
    ok = runs.filter("status = 'success' AND total_trades > 0")
    agg = ok.agg(F.sum(F.col("final_value") - F.col("initial_cash")).alias("total_profit"), F.sum("initial_cash").alias("_cash"),
                 F.avg("annualized_return").alias("annualized_return"), F.avg("sharpe_ratio").alias("sharpe_ratio"),
                 F.max("max_drawdown").alias("_mdd"), F.avg("max_drawdown").alias("_add"), F.sum("total_trades").alias("total_trades"),
                 ratio(F.sum(F.col("win_rate") * F.col("total_trades")), F.sum("total_trades")).alias("win_rate"),
                 F.avg("total_return").alias("expectancy"))
    w = F.col("win_rate")
    return agg.withColumns({
        "cumulative_return": ratio("total_profit", "_cash", 0), "avg_drawdown": F.col("_add") / 100,
        "max_drawdown": F.when(F.col("_mdd") > 1, F.col("_mdd") / 100).otherwise(F.col("_mdd")),
        "calmar_ratio": ratio("annualized_return", F.col("_add") / 100, 0),
        "profit_loss_ratio": F.when((w > 0) & (w < 1), w / (1 - w)).otherwise(0.0)}).drop("_cash", "_mdd", "_add")


def batch_summary(runs: DataFrame, value: str = "total_return") -> DataFrame:
    """Mean, median, extremes and sign counts.  The median is exact and found
    without gathering the values in one place."""
    v = F.col(value)
    agg = runs.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"),
                   F.sum((v > 0).cast("int")).alias("positive"), F.sum((v < 0).cast("int")).alias("negative"), F.sum((v == 0).cast("int")).alias("zero"))
    return agg.crossJoin(F.broadcast(exact_quantiles(runs, [], value, {"median": 0.5})))  # one row each


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; empty bins appear."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span))  # one row
    at = F.least(F.floor(ratio((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"), 0)), F.lit(bins - 1))
    counts = rows.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").fillna(0, ["n"])


def value_shares(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Counts and shares of the values of a column."""
    b = list(by or [])
    out = df.groupBy(*b, key).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*b)))


def flag_summary(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """``n_flags`` and ``names`` of the flags that are set."""
    count = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in flags), F.lit(0))
    names = F.filter(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in flags.items()]), lambda x: x.isNotNull())
    return df.withColumns({"n_flags": count, "names": names})


def signal_trend(panel: DataFrame, flags: list[str], last_dates: int) -> DataFrame:
    """Counts per flag and of bars with two or more, for the last dates."""
    dates = panel.select("trade_date").distinct().orderBy(F.col("trade_date").desc()).limit(last_dates)
    rows = panel.join(F.broadcast(dates), "trade_date", "left_semi")  # at most last_dates rows
    n = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return rows.groupBy("trade_date").agg(*[F.sum(F.col(f).cast("int")).alias(f) for f in flags],
                                          F.sum((n >= 2).cast("int")).alias("resonance"))


def scan_statistics(panel: DataFrame, flags: list[str]) -> DataFrame:
    """Counters of a scan per date: rows, codes, one per flag, any, several."""
    n = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return panel.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("scanned"), *[F.sum(F.col(f).cast("int")).alias(f) for f in flags],
        F.sum((n >= 1).cast("int")).alias("any_signal"), F.sum((n >= 2).cast("int")).alias("several"), F.max(n).alias("most"))


def signals_of_day(panel: DataFrame, scores: dict[str, str]) -> DataFrame:
    """Per date and code the fired rules with scores, best first; ordered by best score.

    ``scores`` maps flag column to score column."""
    items = F.filter(F.array(*[F.when(F.col(f), F.struct(F.col(s).cast("double").alias("score"), F.lit(f).alias("signal")))
                               for f, s in scores.items()]), lambda x: x.isNotNull())
    df = panel.withColumn("signals", F.reverse(F.array_sort(items))).filter(F.size("signals") > 0)
    return df.withColumn("best_score", F.array_max(F.transform("signals", lambda x: x["score"])))


def curve_extremes(curve: DataFrame, value: str = "total_value", date: str = "date") -> DataFrame:
    """Dates and values of peak, trough and deepest drawdown (first on ties)."""
    upto = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    v, early = F.col(value), -F.unix_date(date)
    df = curve.withColumn("_dd", v / F.max(v).over(upto) - 1)
    agg = df.agg(F.max(F.struct(v.alias("v"), early.alias("e"), F.col(date).alias("d"))).alias("peak"),
                 F.min(F.struct(v.alias("v"), F.col(date).alias("d"))).alias("low"),
                 F.min(F.struct(F.col("_dd").alias("v"), F.col(date).alias("d"))).alias("dd"))
    return agg.select(F.col("peak.d").alias("peak_date"), F.col("peak.v").alias("peak_value"), F.col("low.d").alias("trough_date"),
                      F.col("low.v").alias("trough_value"), F.col("dd.d").alias("drawdown_date"), F.col("dd.v").alias("max_drawdown"))


def align_curves(curves: DataFrame, key: str, capital: float, value: str = "total_value", date: str = "date") -> DataFrame:
    """All curves on the union of their dates: last value carried, capital before the first.

    Dates and curve names are small; their product is the size of the result."""
    dates, names = curves.select(date).distinct(), curves.select(key).distinct()
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    grid = dates.crossJoin(small(names)).join(curves.select(key, date, value), [key, date], "left")
    return grid.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(float(capital))))


def rebased_benchmark(dates: DataFrame, index: DataFrame, capital: float, date: str = "date") -> DataFrame:
    """The index on the given dates, scaled to start at capital, gaps carried."""
    joined = dates.select(date).distinct().join(index.select(F.col("trade_date").alias(date), "close"), date, "left")
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    filled = joined.withColumn("_c", F.last("close", ignorenulls=True).over(w))
    base = F.first("_c", ignorenulls=True).over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.select(date, (F.coalesce(ratio("_c", base), F.lit(1.0)) * capital).alias("benchmark"))


def decision_summary(results: DataFrame) -> DataFrame:
    """Counts of buy, hold, sell and failures, mean confidence of the successes."""
    d = F.lower("decision")
    ok = F.col("success")
    return results.agg(F.count(F.lit(1)).alias("total"), F.sum(ok.cast("int")).alias("succeeded"),
                       *[F.sum((ok & (d == x)).cast("int")).alias(x) for x in ("buy", "hold", "sell")],
                       F.avg(F.when(ok, F.col("confidence"))).alias("avg_confidence"))


def risk_votes(votes: DataFrame, key: str) -> DataFrame:
    """Majority of the views of a key: HIGH or LOW with two or more votes, else MEDIUM;
    the position allowed with it, and the mean confidence."""
    high, low = (F.sum((F.col("risk") == x).cast("int")) for x in ("HIGH", "LOW"))
    out = votes.groupBy(key).agg(high.alias("_h"), low.alias("_l"), F.avg(F.coalesce("confidence", F.lit(0.5))).alias("confidence"))
    level = F.when(F.col("_h") >= 2, "HIGH").when(F.col("_l") >= 2, "LOW").otherwise("MEDIUM")
    size = F.when(F.col("_h") >= 2, 0.0).when(F.col("_l") >= 2, 0.3).otherwise(0.15)
    return out.select(key, level.alias("risk_level"), size.alias("position"), "confidence")


def page(df: DataFrame, order: list[str], offset: int, limit: int, descending: bool = False) -> DataFrame:
    """One page of a listing."""
    columns = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in order]
    return df.orderBy(*columns).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list[str], offset: int, limit: int, descending: bool = False) -> DataFrame:
    """One page of a listing, each row with the ``total`` of rows listed."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page(df, order, offset, limit, descending).crossJoin(F.broadcast(total))  # total is one row


SORTABLE = {"buy_date", "profit_loss", "cost", "code", "strategy"}


def sorted_by(df: DataFrame, column: str, direction: str = "desc", allowed: set[str] = SORTABLE, fallback: str = "buy_date") -> DataFrame:
    """Order by a column out of a fixed set; anything else falls back."""
    name = column if column in allowed else fallback
    return df.orderBy(F.col(name).asc() if direction.lower() == "asc" else F.col(name).desc())


def coverage_calendar(df: DataFrame, date: str) -> DataFrame:
    """Rows per day, month, year and in all (the higher levels have null below)."""
    parts = df.select(F.year(date).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day"))
    return parts.rollup("year", "month", "day").agg(F.count(F.lit(1)).alias("n"))


def table_freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, rows, latest) over many tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.to_date(date)).alias("latest")).select(F.lit(name).alias("table"), "rows", "latest")
             for name, (df, date) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
