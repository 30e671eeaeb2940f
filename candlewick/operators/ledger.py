"""The position ledger: selling decisions, their bookkeeping, equity over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.functions import money
from candlewick.functions.series import Series, ratio
from candlewick.operators.asof import asof_join
from candlewick.session import small

# -- decisions ----------------------------------------------------------------


def sell_decisions(positions: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per position to be sold: reason, shares, price, result.

    Stops come before a full sell signal, that before a line break, that before a
    half sell.  ``signals`` holds one day: one row per ts_code.
    """
    df = positions.filter("status = 'holding' AND buy_price > 0 AND shares > 0").join(signals, "ts_code")
    score = F.coalesce(F.col("score_s1"), F.lit(0.0))

    def flag(name):
        return F.coalesce(F.col(name), F.lit(False))

    stop = money.stop_hit("low", "atr", "buy_price", "stop_loss_pct")
    half = flag("signal_s1_half") | ((score >= 5) & (score < 10))
    reason = (F.when(stop, "stop").when(flag("signal_s1_full") | (score >= 10), "s1_full")
              .when(flag("break_slow"), "line_break").when(half, "s1_half"))
    df = df.withColumn("sell_reason", reason).filter(F.col("sell_reason").isNotNull())
    part = money.half_lots("shares")
    is_half = F.col("sell_reason") == "s1_half"
    df = df.withColumn("sell_shares", F.when(is_half, part).otherwise(F.col("shares")).cast("double"))
    df = df.withColumns({"is_full_exit": ~is_half | (F.col("sell_shares") >= F.col("shares")),
                         "sell_price": F.col("close")})
    return df.select("id", "ts_code", "shares", "buy_price", "sell_reason", "sell_shares", "sell_price", "is_full_exit",
                     *[c.alias(n) for n, c in money.sell_result("buy_price", "sell_price", "sell_shares").items()])


def apply_decisions(positions: DataFrame, decisions: DataFrame, day) -> DataFrame:
    """The ledger after the decisions of one day.  A position sold on that day
    already, or not held any more, is left alone, so a second run changes nothing."""
    day = F.lit(day).cast("date")
    d = decisions.select("id", *[F.col(c).alias(f"_{c}") for c in (
        "sell_shares", "sell_price", "sell_reason", "is_full_exit", "profit_loss", "profit_pct")])
    df = positions.join(d, "id", "left")
    acts = F.col("_sell_reason").isNotNull() & (F.col("status") == "holding") & ~F.coalesce(
        F.col("last_action_date") == day, F.lit(False))
    full, half = acts & F.col("_is_full_exit"), acts & ~F.col("_is_full_exit")
    return df.withColumns({
        "sell_date": F.when(full, day).otherwise(F.col("sell_date")),
        "sell_price": F.when(full, F.col("_sell_price")).otherwise(F.col("sell_price")),
        "sell_reason": F.when(full, F.col("_sell_reason")).otherwise(F.col("sell_reason")),
        "profit_loss": F.when(full, F.col("_profit_loss")).otherwise(F.col("profit_loss")),
        "profit_pct": F.when(full, F.col("_profit_pct")).otherwise(F.col("profit_pct")),
        "shares": F.when(half, F.col("shares") - F.col("_sell_shares")).otherwise(F.col("shares")),
        "last_action_date": F.when(acts, day).otherwise(F.col("last_action_date")),
        "status": F.when(full, "sold").otherwise(F.col("status")),
    }).select(*positions.columns)


def audit_rows(log: DataFrame, decisions: DataFrame, day) -> DataFrame:
    """New audit rows for decisions not logged for that day, with ids that go on
    from the log's largest.

    Ids are consecutive without one global sort: rows are counted per bucket of
    position ids and numbered inside it.
    """
    day = F.lit(day).cast("date")
    seen = log.select(F.col("position_id").alias("id"), "action_date")
    fresh = decisions.withColumn("action_date", day).join(seen, ["id", "action_date"], "left_anti")
    fresh = fresh.withColumn("_b", F.floor(F.col("id") / 65536))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = fresh.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    top = log.agg(F.coalesce(F.max("audit_id"), F.lit(0)).alias("_top"))
    numbered = (fresh.join(starts, "_b").crossJoin(F.broadcast(top))  # one row
                .withColumn("audit_id", F.col("_top") + F.col("_start") + F.row_number().over(Window.partitionBy("_b").orderBy("id"))))
    return numbered.select("audit_id", F.col("id").alias("position_id"), "action_date", "sell_reason", "sell_shares", "sell_price", "profit_loss")


def rebalance_diff(selected: DataFrame, held: DataFrame, cash: float, price: str = "close") -> DataFrame:
    """Per date: SELL what is held and not selected, BUY what is selected and not
    held, with equal cash per selected name."""
    keys = ["trade_date", "ts_code"]
    sells = held.join(selected, keys, "left_anti").select(*keys, F.lit("SELL").alias("action"), F.col("shares").cast("double").alias("shares"))
    per_name = F.lit(float(cash)) / F.count(F.lit(1)).over(Window.partitionBy("trade_date"))
    sized = selected.withColumn("_lots", money.whole_lots(ratio(per_name, price)))
    buys = sized.join(held, keys, "left_anti").select(*keys, F.lit("BUY").alias("action"), F.col("_lots").cast("double").alias("shares"))
    return sells.unionByName(buys)


def rebalance_day(date: str, freq: str, is_open: str | None = None) -> Column:
    """D every day, W Mondays, M first of the month; M1 the month's first open day."""
    if freq == "D":
        return F.lit(True)
    if freq == "W":
        return F.weekday(date) == 0
    if freq == "M":
        return F.dayofmonth(date) == 1
    month = Window.partitionBy(F.trunc(date, "month"))
    return F.col(date) == F.min(F.when(F.col(is_open), F.col(date))).over(month)


def time_filter(bars: DataFrame, holidays: DataFrame, late_minute: int = 30, time: str = "bar_time") -> DataFrame:
    """Add ``reason`` a bar is not traded: late in the session, a holiday, or three
    falls of more than 3 % in a row."""
    s = Series(("ts_code",), (time,))
    fall = s.pct_change("close") * 100
    df = bars.withColumns({"_n": s.number(), "_chg": fall})
    falling = (F.col("_n") >= 5) & (F.max("_chg").over(s.last(3)) < -3)
    marked = holidays.select(F.col("holiday").alias("_day"), F.lit(True).alias("_holiday"))
    df = df.withColumns({"_falling": falling, "_day": F.to_date(time)})
    df = df.join(small(marked), "_day", "left")
    late = (F.hour(time) == 14) & (F.minute(time) >= late_minute)
    reason = F.when(late, "late").when(F.col("_holiday"), "holiday").when(F.col("_falling"), "falling").otherwise("")
    return df.withColumn("reason", reason).drop("_n", "_chg", "_falling", "_day", "_holiday")


# -- valuation ------------------------------------------------------------------


def latest_prices(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ts_code").agg(F.max_by("close", "trade_date").alias("last_close"), F.max("trade_date").alias("price_date"))


def value_holdings(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Open positions at the latest price (bought price where there is none)."""
    df = positions.filter("status = 'holding'").join(latest_prices(prices), "ts_code", "left")
    price = F.coalesce("last_close", "buy_price")
    return df.withColumns({"current_price": price, "market_value": price * F.col("shares"),
                           "float_profit": (price - F.col("buy_price")) * F.col("shares"),
                           "float_pct": ratio((price - F.col("buy_price")) * 100, "buy_price")})


def account_summary(positions: DataFrame, prices: DataFrame, capital: float) -> DataFrame:
    """One row: market value, cost, holding, history and total profit, cash, equity."""
    open_ = value_holdings(positions, prices).agg(
        F.coalesce(F.sum("market_value"), F.lit(0.0)).alias("market_value"),
        F.coalesce(F.sum(F.col("buy_price") * F.col("shares")), F.lit(0.0)).alias("holding_cost"),
        F.coalesce(F.sum("float_profit"), F.lit(0.0)).alias("holding_profit"), F.count(F.lit(1)).alias("n_holding"))
    closed = positions.filter("status = 'sold'").agg(F.coalesce(F.sum("profit_loss"), F.lit(0.0)).alias("history_profit"),
                                                     F.count(F.lit(1)).alias("n_sold"))
    out = open_.crossJoin(F.broadcast(closed))  # one row each
    cash = F.lit(float(capital)) - F.col("holding_cost") + F.col("history_profit")
    return out.withColumns({"total_profit": F.col("holding_profit") + F.col("history_profit"), "cash": cash,
                            "equity": cash + F.col("market_value")})


def price_as_of(days: DataFrame, prices: DataFrame, max_age_days: int = 7) -> DataFrame:
    """(ts_code, date) with the close of that day or the latest within the age."""
    return asof_join(days, prices.select("ts_code", "trade_date", "close"), ["ts_code"], "date", "trade_date", ["close"], max_age_days)


def equity_curve(positions: DataFrame, prices: DataFrame, dates: DataFrame, capital: float, fee: float = 0.0,
                 groups: list[str] | None = None, max_age_days: int = 7) -> DataFrame:
    """Account snapshot per date (and group): cost, value, closed result, cash, total,
    ratio, cumulative return, daily result, drawdown.

    Nothing is expanded to position x day.  Each code's value changes only when a
    position opens or closes, a price arrives, or a price grows too old (the bought
    price stands in then); those changes are summed per date and added up over time.
    A code's changes are bounded by the number of dates.
    """
    g = list(groups or [])
    p = positions.filter("shares > 0 AND buy_date IS NOT NULL").withColumn(
        "_end", F.when(F.col("sell_date").isNotNull(), F.greatest("buy_date", "sell_date")))
    paid = F.col("shares") * F.col("buy_price")
    opened = p.select(*g, "ts_code", F.col("buy_date").alias("date"), F.col("shares").cast("double").alias("d_shares"),
                      paid.alias("d_paid"), F.lit(0.0).alias("d_closed"))
    closed = p.filter("_end IS NOT NULL").select(
        *g, "ts_code", F.col("_end").alias("date"), (-F.col("shares").cast("double")).alias("d_shares"), (-paid).alias("d_paid"),
        F.coalesce(F.col("profit_loss"), F.lit(0.0)).alias("d_closed"))
    moves = (opened.unionByName(closed).groupBy(*g, "ts_code", "date")
             .agg(F.sum("d_shares").alias("d_shares"), F.sum("d_paid").alias("d_paid"), F.sum("d_closed").alias("d_closed")))

    s = Series(("ts_code",), ("trade_date",))
    quoted = prices.select("ts_code", "trade_date", "close").withColumn("_next", s.ahead("trade_date"))
    stale = F.date_add("trade_date", max_age_days + 1)
    arrives = quoted.select("ts_code", F.col("trade_date").alias("date"), F.struct(F.col("close").alias("p")).alias("quote"))
    expires = quoted.filter(F.col("_next").isNull() | (F.col("_next") > stale)).select(
        "ts_code", stale.alias("date"), F.struct(F.lit(None).cast("double").alias("p")).alias("quote"))
    quotes = arrives.unionByName(expires)
    if g:
        quotes = quotes.join(moves.select(*g, "ts_code").distinct(), "ts_code")
    else:
        quotes = quotes.join(moves.select("ts_code").distinct(), "ts_code", "left_semi")

    points = moves.join(quotes, [*g, "ts_code", "date"], "full")
    by_code = Window.partitionBy(*g, "ts_code").orderBy("date")
    upto = by_code.rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumns({
        "_shares": F.sum(F.coalesce("d_shares", F.lit(0.0))).over(upto), "_paid": F.sum(F.coalesce("d_paid", F.lit(0.0))).over(upto),
        "_quote": F.last("quote", ignorenulls=True).over(upto)})
    points = points.withColumn("_value", F.coalesce(F.col("_quote.p") * F.col("_shares"), F.col("_paid")))
    points = points.withColumn("d_value", F.col("_value") - F.lag("_value", 1, 0.0).over(by_code))
    changes = points.groupBy(*g, "date").agg(
        F.sum(F.coalesce("d_paid", F.lit(0.0))).alias("d_paid"), F.sum("d_value").alias("d_value"),
        F.sum(F.coalesce("d_closed", F.lit(0.0))).alias("d_closed"))
    asked = dates.select("date").distinct().withColumn("_asked", F.lit(True))
    if g:
        asked = asked.crossJoin(small(positions.select(*g).distinct()))  # dates x groups is the report itself
    # from here on one row per date (and group)
    daily = changes.join(asked, [*g, "date"], "full")
    order = Window.partitionBy(*g).orderBy("date")
    total = order.rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumns({
        "position_cost": F.sum(F.coalesce("d_paid", F.lit(0.0))).over(total) * (1 + fee),
        "position_value": F.sum(F.coalesce("d_value", F.lit(0.0))).over(total),
        "closed_pnl": F.sum(F.coalesce("d_closed", F.lit(0.0))).over(total)}).filter("_asked")
    c = F.lit(float(capital))
    daily = daily.withColumns({"position_pnl": F.col("position_value") - F.col("position_cost"),
                               "cash": c - F.col("position_cost") + F.col("closed_pnl")})
    daily = daily.withColumns({"total_value": F.col("cash") + F.col("position_value"),
                               "total_pnl": F.col("position_pnl") + F.col("closed_pnl")})
    daily = daily.withColumns({
        "position_ratio": F.when(F.col("total_value") > 0, ratio(F.col("position_value") * 100, "total_value")).otherwise(0.0),
        "cum_return": F.col("total_pnl") / c,
        "daily_pnl": F.col("total_value") - F.coalesce(F.lag("total_value").over(order), c),
        "_peak": F.greatest(F.max("total_value").over(total), c)})
    daily = daily.withColumns({"daily_pnl_pct": ratio("daily_pnl", F.col("total_value") - F.col("daily_pnl"), 0),
                               "drawdown": ratio(F.col("total_value") - F.col("_peak"), "_peak", 0)})
    return daily.select(*g, "date", "position_cost", "position_value", "position_pnl", "closed_pnl", "total_pnl", "cash",
                        "position_ratio", "total_value", "daily_pnl", "daily_pnl_pct", "cum_return", "drawdown")


def equity_from_returns(returns: DataFrame, capital: float, ret: str = "ret", date: str = "trade_date") -> DataFrame:
    """Value, result and drawdown per date of one return series (one row per date)."""
    w = Window.orderBy(date)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = returns.withColumn("total_value", F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(upto) * capital)
    peak = F.max("total_value").over(upto)
    return df.withColumns({"daily_pnl": F.col("total_value") - F.lag("total_value", 1, float(capital)).over(w),
                           "drawdown": F.col("total_value") / peak - 1})


def position_analysis(positions: DataFrame, info: DataFrame, basics: DataFrame, date: str = "buy_date") -> DataFrame:
    """The ledger with instrument data (industry, market) and the basics of the code
    at the buy date, as ``buy_<column>``; what is not known is null.

    ``info`` has a row per ts_code, ``basics`` one per (ts_code, trade_date); ``date`` is the
    column of ``positions`` that is looked up."""
    columns = [c for c in basics.columns if c not in ("ts_code", "trade_date")]
    known = basics.select(F.col("ts_code").alias("code"), F.col("trade_date").alias(date), *[F.col(c).alias(f"buy_{c}") for c in columns])
    named = info.select(F.col("ts_code").alias("code"), "industry", "market")
    return positions.join(small(named), "code", "left").join(known, ["code", date], "left")


def rebuilt_portfolio(snapshots: DataFrame, strategy: str = "main") -> DataFrame:
    """The daily portfolio table in its present form, from the earlier one without strategy,
    total and curve columns.

    Needs date, init_cash, position_cost, position_value, position_pnl, closed_pnl, total_pnl
    and available_cash; id, position_ratio, notes, created_at and updated_at are null where they
    are missing.  The daily result is that of the open positions; drawdown begins at 0.
    """
    types = {"id": "bigint", "position_ratio": "double", "notes": "string", "created_at": "timestamp", "updated_at": "timestamp"}
    df = _with_defaults(snapshots, types)
    return df.select(
        "id", "date", F.lit(strategy).alias("strategy"), "init_cash", "position_cost", "position_value", "position_pnl", "closed_pnl", "total_pnl",
        F.col("available_cash").alias("cash"), (F.col("position_value") + F.col("available_cash")).alias("total_value"), F.col("position_pnl").alias("daily_pnl"),
        ratio("total_pnl", "init_cash").alias("cum_return"), F.lit(0.0).alias("drawdown"), "position_ratio", "notes", "created_at", "updated_at")


def rebuilt_strategy_portfolio(snapshots: DataFrame, capital: float = 500_000.0) -> DataFrame:
    """The same of the table by strategy, which knows no cash: a strategy's total is
    ``capital`` and its result."""
    df = _with_defaults(snapshots, {"id": "bigint", "trade_count": "bigint", "notes": "string", "created_at": "timestamp"})
    return df.select("id", "date", "strategy", "position_cost", "position_value", "position_pnl", "closed_pnl", "total_pnl",
                     (F.col("total_pnl") + F.lit(float(capital))).alias("total_value"), F.col("position_pnl").alias("daily_pnl"), "trade_count", "notes", "created_at")


def _with_defaults(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})
