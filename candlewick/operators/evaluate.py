"""Signals judged by what prices did afterwards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.functions.series import ratio
from candlewick.operators import factors as X
from candlewick.operators.ranks import grouped_quantiles, spearman
from candlewick.session import cut, small

YEAR = 252


def annual_sharpe(mean: Column, std: Column) -> Column:
    return ratio(mean, F.when(std > 0, std)) * math.sqrt(YEAR)


def long_short_metrics(df: DataFrame, groups: list[str], signal: str = "signal", ret: str = "ret",
                       min_samples: int = 30) -> DataFrame:
    """Per group: Sharpe of top-tercile returns pooled with negated bottom-tercile
    returns, sign hit rate, mean top return.  Terciles are exact quantiles of the
    pooled signal."""
    # read four times: twice for the cut points, for the legs and the hits
    valid = cut(df.filter(F.col(signal).isNotNull() & F.col(ret).isNotNull()).select(*groups, signal, ret))
    cuts = grouped_quantiles(valid, groups, [signal], [0.33, 0.67])
    cuts = cuts.select(*groups, F.col(f"{signal}_q")[0].alias("p33"), F.col(f"{signal}_q")[1].alias("p67"))
    # one row of cut points per group, written down so that its true size decides on the join: a
    # shuffle by a few groups would leave a few tasks with all rows
    rows = valid.join(small(cut(cuts)), groups)
    sig, r = F.col(signal), F.col(ret)
    # mean and deviation of {top returns} + {-bottom returns} from moments
    top, bottom = sig >= F.col("p67"), sig <= F.col("p33")
    legs = F.filter(F.array(F.when(top, r), F.when(bottom, -r)), lambda x: x.isNotNull())
    hits = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum((sig != 0).cast("int")).alias("_signed"),
        F.avg(F.when(sig != 0, (F.signum(sig) == F.signum(r)).cast("int"))).alias("win_rate"),
        F.avg(F.when(top, r)).alias("mean_ret"))
    sharpe = (rows.select(*groups, F.explode(legs).alias("leg")).groupBy(*groups)
              .agg(annual_sharpe(F.avg("leg"), F.stddev_samp("leg")).alias("sharpe")))
    out = hits.join(sharpe, groups)
    enough = F.col("n_pairs") >= min_samples
    return out.select(*groups, "n_pairs", F.when(enough, F.col("sharpe")).alias("sharpe"),
                      F.when(F.col("_signed") >= min_samples, F.col("win_rate")).alias("win_rate"),
                      F.when(enough, F.col("mean_ret")).alias("mean_ret"))


def pooled_metrics(panel: DataFrame, horizons: list[int], signal: str = "signal", min_samples: int = 30) -> DataFrame:
    """First-level evaluation: one row per horizon, all codes and dates pooled."""
    long = cut(X.long_horizons(X.forward_returns(panel, horizons), horizons, [signal]))
    metrics = long_short_metrics(long, ["horizon"], signal, "ret", min_samples)
    ic = spearman(long, ["horizon"], signal, "ret").drop("n_obs")
    cover = long.filter(F.col("horizon") == horizons[0]).agg(
        F.count(signal).alias("n_obs"), (F.count(signal) / F.count(F.lit(1))).alias("coverage"))
    out = metrics.join(ic, "horizon").crossJoin(F.broadcast(cover))  # cover is one row
    return out.withColumn("ic", F.when(F.col("n_pairs") >= min_samples, F.col("ic")))


def cap_group(cap: Column) -> Column:
    """small / mid / large at 20 and 200 (unit: 100 million)."""
    return F.when(cap <= 20, "small").when(cap <= 200, "mid").when(cap.isNotNull(), "large")


def cap_group_sharpe(panel: DataFrame, caps: DataFrame, horizon: int, signal: str = "signal",
                     min_samples: int = 30) -> DataFrame:
    """Long-short Sharpe by the group of each code's median capitalisation."""
    median = caps.groupBy("ts_code").agg(F.median("cap").alias("cap"))
    rows = (X.forward_returns(panel, [horizon]).join(median, "ts_code")
            .withColumn("cap_group", cap_group(F.col("cap")))
            .filter(F.col("cap_group").isNotNull() & (F.col(signal) != 0)))
    out = long_short_metrics(rows, ["cap_group"], signal, f"ret_t{horizon}", min_samples)
    return out.select("cap_group", "sharpe")


def market_forward_return(panel: DataFrame, hold: int) -> DataFrame:
    """Return to the close ``hold`` market dates later (null if the code has no
    bar on that date), and the index of the date."""
    dates = panel.select("trade_date").distinct()
    # dates of one market: a few hundred per year
    indexed = dates.withColumn("date_no", F.row_number().over(Window.orderBy("trade_date")))
    indexed = indexed.withColumn("n_dates", F.count(F.lit(1)).over(Window.partitionBy()))
    df = panel.join(small(indexed), "trade_date")
    later = Window.partitionBy("ts_code").orderBy("date_no").rangeBetween(hold, hold)
    return df.withColumn("fwd_ret", ratio(F.max("close").over(later), "close") - 1)


def top_share_portfolio(panel: DataFrame, hold: int = 5, share: float = 0.1, signal: str = "signal",
                        min_names: int = 5) -> DataFrame:
    """Equal-weight return of the best ``share`` of names per date."""
    df = market_forward_return(panel, hold).filter(F.col("date_no") <= F.col("n_dates") - hold)
    best = X.top_share_per_date(df, signal, share, min_names)
    return (best.groupBy("trade_date").agg(F.avg("fwd_ret").alias("ret"), F.count("fwd_ret").alias("n_held"))
            .filter(F.col("n_held") > 0))


def portfolio_summary(returns: DataFrame, ret: str = "ret", date: str = "trade_date") -> DataFrame:
    """Total, annual return, Sharpe, largest drawdown and win rate of one return
    series (one row per date).  Compounded in logarithms; ``log_return`` and
    ``annual_log_return`` stay finite where the returns themselves overflow."""
    upto = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("_cum", F.sum(X.log_growth(ret)).over(upto))
    curve = curve.withColumn("_dd", F.expm1(F.col("_cum") - F.max("_cum").over(upto)))
    agg = curve.agg(F.sum(X.log_growth(ret)).alias("log_return"), F.count(ret).alias("n_days"),
                    annual_sharpe(F.avg(ret), F.stddev_samp(ret)).alias("sharpe_ratio"),
                    F.min("_dd").alias("max_drawdown"), F.avg((F.col(ret) > 0).cast("int")).alias("win_rate"))
    agg = agg.withColumn("annual_log_return", F.col("log_return") * YEAR / F.greatest(F.col("n_days"), F.lit(1)))
    return agg.withColumns({"total_return": F.expm1("log_return"), "annual_return": F.expm1("annual_log_return")})


def period_returns(returns: DataFrame, unit: str, ret: str = "ret", date: str = "trade_date") -> DataFrame:
    """Compounded return per calendar period."""
    return (returns.groupBy(F.trunc(date, unit).alias("period"))
            .agg((F.product(1 + F.col(ret)) - 1).alias("ret"), F.count(F.lit(1)).alias("n")))


def _stretches_joined(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """Stretches (growth _p, highest _m, lowest _l and worst fall _d, in logarithms from
    their beginning) of a group joined in order to one: again a stretch."""
    w = Window.partitionBy(*group).orderBy(order)
    df = df.withColumn("_before", F.sum("_p").over(w) - F.col("_p"))
    peak = F.max(F.col("_before") + F.col("_m")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_fall", F.least("_d", F.col("_before") + F.col("_l") - peak))
    return df.groupBy(*group).agg(F.sum("_p").alias("_p"), F.max(F.col("_before") + F.col("_m")).alias("_m"),
                                  F.min(F.col("_before") + F.col("_l")).alias("_l"), F.min("_fall").alias("_d"))


def _event_drawdown(df: DataFrame, bins: int | None = None) -> DataFrame:
    """Largest drawdown per horizon of compounding the events by code, then date.

    Each code's events are reduced to one stretch; stretches are joined inside
    ranges of codes, and those of the ranges last.  No task sees more than one
    code's events, one range of codes, or one row per range.
    """
    inside = (Window.partitionBy("horizon", "ts_code").orderBy("trade_date")
              .rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_c", F.sum(F.log1p("ret")).over(inside))
    df = df.withColumn("_d", F.col("_c") - F.max("_c").over(inside))
    per_code = df.groupBy("horizon", "ts_code").agg(
        F.sum(F.log1p("ret")).alias("_p"), F.max("_c").alias("_m"), F.min("_c").alias("_l"), F.min("_d").alias("_d"))
    return _drawdown_of_codes(per_code, bins)


def _wide_drawdown(fired: DataFrame, horizons: list[int], bins: int | None = None) -> DataFrame:
    """The same of events with a column ``ret_t<h>`` per horizon: an event is sorted once for all horizons."""
    inside = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    # an event without a return leaves the sum as it is
    df = fired.select("ts_code", "trade_date", *[F.log1p(f"ret_t{h}").alias(f"_g{h}") for h in horizons])
    df = df.withColumns({f"_c{h}": F.sum(f"_g{h}").over(inside) for h in horizons})
    df = df.withColumns({f"_d{h}": F.col(f"_c{h}") - F.max(f"_c{h}").over(inside) for h in horizons})
    parts = [F.struct(F.lit(h).alias("horizon"), F.sum(f"_g{h}").alias("_p"), F.max(f"_c{h}").alias("_m"), F.min(f"_c{h}").alias("_l"), F.min(f"_d{h}").alias("_d"))
             for h in horizons]
    per_code = df.groupBy("ts_code").agg(F.array(*parts).alias("_parts")).select("ts_code", F.explode("_parts").alias("s")).select("s.horizon", "ts_code", "s._p", "s._m", "s._l", "s._d")
    return _drawdown_of_codes(per_code.filter("_p IS NOT NULL"), bins)


def _drawdown_of_codes(per_code: DataFrame, bins: int | None = None) -> DataFrame:
    """Largest drawdown per horizon from the stretches of codes."""
    n = bins or int(per_code.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(per_code.repartitionByRange(n, "horizon", "ts_code").withColumn("_bin", F.spark_partition_id()))
    ranges = _stretches_joined(placed, ["horizon", "_bin"], "ts_code")
    whole = _stretches_joined(ranges, ["horizon"], "_bin")
    return whole.select("horizon", (F.exp("_d") - 1).alias("max_drawdown"))


def horizon_statistics(long: DataFrame, min_events: int = 5) -> DataFrame:
    """Statistics of event returns per horizon; null below ``min_events``.

    ``long`` has (ts_code, trade_date, horizon, ret).  Ratios without a loss to
    divide by are null.
    """
    df = cut(long.filter(F.col("ret").isNotNull()))
    return _statistics(df, _event_drawdown(df), min_events)


def _statistics(df: DataFrame, drawdown: DataFrame, min_events: int) -> DataFrame:
    """Statistics of the returns ``ret``, none of them null, per horizon, beside the ``drawdown`` of each.
    Medians by ranges of values, counted before any shuffle."""
    r = F.col("ret")
    agg = df.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.avg((r > 0).cast("int")).alias("win_rate"),
        F.max(r).alias("max"), F.min(r).alias("min"), F.stddev_samp(r).alias("std"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_won"), F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("_lost"))
    agg = agg.withColumns({"sharpe": annual_sharpe(F.col("mean"), F.col("std")),
                           "sortino": annual_sharpe(F.col("mean"), F.col("_down")),
                           "profit_factor": ratio("_won", "_lost")})
    agg = agg.join(grouped_quantiles(df, ["horizon"], ["ret"], [0.5]).select("horizon", F.col("ret_q")[0].alias("median")), "horizon")
    agg = agg.join(drawdown, "horizon").drop("_down", "_won", "_lost")
    values = [c for c in agg.columns if c not in ("horizon", "n")]
    return agg.select("horizon", "n", *[F.when(F.col("n") >= min_events, F.col(c)).alias(c) for c in values])


def event_returns(panel: DataFrame, horizons: list[int], signal: str = "signal", threshold: float = 0.0) -> DataFrame:
    """(ts_code, trade_date, horizon, ret) of the bars whose signal exceeds the
    threshold in either direction."""
    fired = X.forward_returns(panel, horizons).filter(F.abs(F.col(signal)) > threshold)
    return X.long_horizons(fired, horizons, ["ts_code", "trade_date"])


def signal_events(panel: DataFrame, horizons: list[int], signal: str = "signal", threshold: float = 0.0,
                  limit: int | None = None) -> DataFrame:
    """Events (code, date, strength, horizon -> return); with a ``limit`` the
    newest so many, in that order."""
    df = X.forward_returns(panel, horizons)
    returns = F.create_map(*[x for h in horizons for x in (F.lit(f"t{h}"), F.col(f"ret_t{h}"))])
    events = (df.filter(F.abs(F.col(signal)) > threshold)
              .select("ts_code", "trade_date", F.col(signal).alias("strength"), returns.alias("returns")))
    return events if limit is None else events.orderBy(F.col("trade_date").desc(), "ts_code").limit(limit)


def holding_curve(panel: DataFrame, longest: int = 20, signal: str = "signal") -> DataFrame:
    """Event statistics after 1..longest bars.  Events are written once, with a column per
    horizon; their returns become rows only on the way into sums per horizon."""
    horizons = list(range(1, longest + 1))
    fired = X.forward_returns(panel, horizons).filter(F.abs(F.col(signal)) > 0)
    fired = cut(fired.select("ts_code", "trade_date", *[f"ret_t{h}" for h in horizons]))
    long = X.long_horizons(fired, horizons, []).filter("ret IS NOT NULL")
    return _statistics(long, _wide_drawdown(fired, horizons), 5)


def holdout_gate(trials: DataFrame, min_signals: int = 15, max_ratio: float = 5.0) -> DataFrame:
    """Add ``passed``: enough signals, positive holdout Sharpe, search/holdout
    ratio below the limit."""
    spread = ratio("search_sharpe", "holdout_sharpe")
    ok = (F.col("holdout_signals") >= min_signals) & (F.col("holdout_sharpe") > 0) & (spread < max_ratio)
    return trials.withColumn("passed", F.coalesce(ok, F.lit(False)))


def best_trial(trials: DataFrame, key: str = "trial") -> DataFrame:
    """Highest holdout score, else validation score, of those that passed."""
    score = F.coalesce("holdout_sharpe", "search_sharpe")
    return (trials.filter("passed").agg(F.max_by(F.struct("*"), F.struct(score, F.col(key))).alias("b"))
            .filter(F.col("b").isNotNull()).select("b.*"))


def check_signal(panel: DataFrame, signal: DataFrame) -> DataFrame:
    """Contract of a signal frame: the panel's keys exactly, once each, numeric."""
    keys = ["ts_code", "trade_date"]
    counts = signal.agg(F.count(F.lit(1)).alias("rows")).crossJoin(
        panel.agg(F.count(F.lit(1)).alias("wanted_rows")))
    missing = panel.join(signal, keys, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    extra = signal.join(panel, keys, "left_anti").agg(F.count(F.lit(1)).alias("extra"))
    numeric = dict(signal.dtypes).get("signal") in ("double", "float")
    # every frame here is one row
    out = counts.crossJoin(missing).crossJoin(extra)
    return out.withColumn("valid", (F.col("rows") == F.col("wanted_rows")) & (F.col("missing") == 0)
                          & (F.col("extra") == 0) & F.lit(numeric))
