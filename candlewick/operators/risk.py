"""From fired signals to a sized, limited buy decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from candlewick.functions import money
from candlewick.functions.series import Series, ratio
from candlewick.operators.indicators import adx, number_bars
from candlewick.operators.ranks import running_totals
from candlewick.session import small

FLAGS = ["signal_buy_b1", "signal_buy_b2", "signal_buy_scb", "signal_buy_blk", "signal_buy_dz30"]

# Which rules fired (b1, b2, scb, blk, dz30 as 1/0), priority, share of capital.
PRIORITIES = [
    ("11111", 6, 0.25),
    ("11110", 5, 0.25), ("11101", 5, 0.25),
    ("11100", 4, 0.20), ("11010", 4, 0.20), ("01110", 4, 0.20),
    ("11000", 3, 0.18), ("01100", 3, 0.18),
    ("10100", 2, 0.15), ("01010", 2, 0.15), ("01001", 2, 0.15),
    ("00100", 1, 0.12), ("10000", 1, 0.10), ("01000", 1, 0.10), ("00010", 1, 0.08), ("00001", 1, 0.08),
    ("00000", 0, 0.00),
]
# Weights of the composite score, least priority and position factor per market state.
SCORE_WEIGHTS = {"score_b1": 0.30, "score_b2": 0.35, "score_scb": 0.20, "score_blk": 0.10, "score_dz30": 0.05}
MIN_PRIORITY = {"bull": 1, "range": 2, "bear": 3}
POSITION_FACTOR = {"bull": 1.1, "range": 1.0, "bear": 0.7}
# Past results per rule (win rate, mean win, mean loss).
RULE_STATS = [("B1", 0.58, 0.08, 0.03), ("B2", 0.61, 0.09, 0.035), ("SCB", 0.55, 0.07, 0.03),
              ("BLK", 0.52, 0.06, 0.025), ("DZ30", 0.50, 0.05, 0.03)]
MAX_SHARE = 0.25


def market_state(index: DataFrame, with_adx: bool = False) -> DataFrame:
    """bull / bear / range per date of one index (columns trade_date, close, vol,
    and high, low for the trend-strength check).  One row per date."""
    s = Series(("_index",), ("trade_date",))
    df = number_bars(index.withColumn("_index", F.lit(1)), s)
    df = df.withColumns({"_ma20": s.mean("close", 20), "_ma60": s.mean("close", 60),
                         "_vr": ratio(s.mean("vol", 5), s.mean("vol", 20), 1)})
    n, c = F.col("bar_no"), F.col("close")
    bull, bear = (c > F.col("_ma20")) & (F.col("_ma20") > F.col("_ma60")), (c < F.col("_ma20")) & (F.col("_ma20") < F.col("_ma60"))
    strong_up = strong_down = F.lit(True)
    if with_adx:
        df = adx(df, flavor="risk", s=s)
        early = n < 30
        strong_up = early | ((F.col("adx") > 20) & (F.col("plus_di") > F.col("minus_di")))
        strong_down = early | ((F.col("adx") > 20) & (F.col("minus_di") > F.col("plus_di")))
    state = (F.when(n < 60, "range").when(bull & (F.col("_vr") > 1.0) & strong_up, "bull")
             .when(bear & (F.col("_vr") < 0.8) & strong_down, "bear").otherwise("range"))
    return df.select("trade_date", state.alias("market_state"))


def _lookup(values: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def resonance(panel: DataFrame) -> DataFrame:
    """priority, suggested_position_pct, composite_score, should_execute.

    The table of flag patterns has 17 rows; a pattern outside it is judged by its
    first three flags.
    """
    pattern = F.concat(*[F.when(F.col(f), "1").otherwise("0") for f in FLAGS])
    levels = {p: n for p, n, _ in PRIORITIES}
    shares = {p: x for p, _, x in PRIORITIES}
    short = F.concat(F.substring(pattern, 1, 3), F.lit("00"))
    known = pattern.isin(*levels)
    key = F.when(known, pattern).otherwise(short)
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    state = F.coalesce(F.col("market_state"), F.lit("range"))
    df = panel.withColumns({"priority": _lookup(levels, key, 0), "composite_score": F.round(F.round(score, 6), 2),
                            "_share": _lookup(shares, key, 0.0)})
    return df.withColumns({
        "should_execute": F.col("priority") >= _lookup(MIN_PRIORITY, state, 2),
        "suggested_position_pct": F.least(F.col("_share") * _lookup(POSITION_FACTOR, state, 1.0), F.lit(MAX_SHARE)),
    }).drop("_share")


def rule_statistics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULE_STATS, "rule string, win_rate double, avg_win double, avg_loss double")


def risk_columns(panel: DataFrame, capital: float = 1_000_000.0, fraction: float = 0.5) -> DataFrame:
    """The risk_* columns of the daily signal table.

    ``panel`` needs the flags, scores, close, atr and market_state.  The join with
    the five rule statistics is on the leading rule.
    """
    df = resonance(panel)
    b1, b2, scb, blk = (F.col(f) for f in FLAGS[:4])
    leading = (F.when(b2 & (F.coalesce("score_b2", F.lit(0.0)) >= F.coalesce("score_b1", F.lit(0.0))), "B2")
               .when(b1, "B1").when(scb, "SCB").when(blk, "BLK").otherwise("DZ30"))
    df = df.withColumn("rule", leading).join(F.broadcast(rule_statistics(panel.sparkSession)), "rule", "left")
    kelly = money.kelly_share("win_rate", "avg_win", "avg_loss", fraction, MAX_SHARE) * capital
    amount = F.least(kelly, F.col("suggested_position_pct") * capital)
    fired = F.col(FLAGS[0])
    for f in FLAGS[1:]:
        fired = fired | F.col(f)
    acted = fired & (F.col("priority") > 0) & F.col("should_execute")
    df = df.withColumns({
        "risk_priority": F.when(fired, F.col("priority")).otherwise(0),
        "risk_composite_score": F.when(fired, F.col("composite_score")).otherwise(0.0),
        "risk_market_state": F.when(fired, F.coalesce("market_state", F.lit("range"))).otherwise("range"),
        "risk_stoploss_pct": F.when(acted, money.stop_pct("atr", "close")).otherwise(0.0),
        "risk_stoploss_price": F.when(acted, money.stop_price("atr", "close")).otherwise(0.0),
        "risk_position_amt": F.when(acted, F.round(amount, 0)).otherwise(0.0),
        "risk_position_pct": F.when(acted, F.round(amount / capital, 4)).otherwise(0.0),
        "risk_should_buy": acted,
        "risk_reject_reason": F.when(~fired, "no buy signal").when(~acted, "priority too low").otherwise(""),
    })
    return df.drop("rule", "win_rate", "avg_win", "avg_loss", "priority", "composite_score",
                   "should_execute", "suggested_position_pct")


def portfolio_limits(buys: DataFrame, capital: float = 1_000_000.0, max_positions: int = 8,
                     max_daily: float = 0.5, held: str | None = None, every: bool = False) -> DataFrame:
    """Buys of each date in order of priority until a limit is reached.

    The prefix rule: a buy is kept while its place and the running amount stay
    within the limits.  With ``every``, all buys of a date get their place and running
    amount, in ranges of the order, so that no task holds a whole date.  Otherwise only
    the first ``max_positions`` do, as none after them can be kept; the constant limit
    lets every map task keep its own best, and the window sees no more than that of a date.
    """
    order = [F.col("risk_priority").desc(), F.col("risk_composite_score").desc(), F.asc("ts_code")]
    already = F.col(held) if held else F.lit(0)
    accepted = F.coalesce((F.col("place") + already <= max_positions) & (F.col("opened") <= capital * max_daily), F.lit(False))
    if every:
        return running_totals(buys, ["trade_date"], order, "risk_position_amt", "opened").withColumn("accepted", accepted)
    window = Window.partitionBy("trade_date").orderBy(*order)
    first = buys.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= max_positions)
    first = first.withColumn("opened", F.sum("risk_position_amt").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    first = first.withColumn("accepted", accepted)
    out = buys.join(first.select("trade_date", "ts_code", "place", "opened", "accepted"), ["trade_date", "ts_code"], "left")
    return out.withColumn("accepted", F.coalesce("accepted", F.lit(False)))


SIGNAL_COLUMNS = ["score_b1", "score_b2", "score_blk", "score_blkb2", "score_scb", "score_dz30", "score_s1",
                  *FLAGS, "signal_buy_blkb2", "signal_s1_full", "signal_s1_half", "break_slow"]
SELL_COLUMNS = [f"signal_sell_{rule}" for rule in ("b1", "b2", "blk", "dz30", "scb", "blkb2")]
INDICATOR_COLUMNS = ["k", "d", "j", "dif", "dea", "trend_fast", "trend_slow", "rsi1", "bbi", "atr", "vwap",
                     "bb_upper", "bb_mid", "bb_lower", "vol_ratio"]
RISK_COLUMNS = ["risk_priority", "risk_composite_score", "risk_market_state", "risk_stoploss_pct", "risk_stoploss_price",
                "risk_position_amt", "risk_position_pct", "risk_should_buy", "risk_reject_reason"]


def sell_columns(panel: DataFrame, positions: DataFrame | None = None, fee: float = 0.0005, limit: float = -3.0) -> DataFrame:
    """``signal_sell_<rule>`` of each rule: half or full sell score, the break of the
    slow line, or a low more than ``limit`` percent under the price paid with ``fee``.

    ``positions`` (ts_code, id, buy_price) are those held now; of a code's the first by id
    counts, and its price is held against every bar of the panel.  All rules share the
    condition; each has a column, as each has its own book.
    """
    stopped = F.lit(False)
    df = panel
    if positions is not None:
        first = positions.groupBy("ts_code").agg(F.min_by("buy_price", "id").alias("_paid"))
        df = df.join(small(first), "ts_code", "left")
        cost = F.col("_paid") * (1 + fee)
        stopped = F.coalesce((F.col("_paid") > 0) & ((F.col("low") - cost) / cost * 100 < limit), F.lit(False))
    sells = F.coalesce(F.col("signal_s1_full"), F.lit(False)) | F.coalesce(F.col("signal_s1_half"), F.lit(False)) | F.col("break_slow") | stopped
    df = df.withColumn("_sells", sells).withColumns({c: F.col("_sells") for c in SELL_COLUMNS})
    return df.drop("_sells", "_paid")


def daily_signals(panel: DataFrame, positions: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """The whole signal table: bar, scores, buy and sell flags, risk columns and a JSON
    snapshot of the indicators.

    ``names`` (ts_code, name) gives the name of a code, null where it has none.  Columns that
    the table has and no rule fills are there with their constant: ``score_dl``,
    ``signal_buy_dl``, ``signal_sell_dl`` and ``signal_stop``.
    """
    df = sell_columns(risk_columns(panel), positions)
    df = df.join(small(names.select("ts_code", "name")), "ts_code", "left") if names is not None else df.withColumn("name", F.lit(None).cast("string"))
    snapshot = F.to_json(F.struct(*INDICATOR_COLUMNS)).alias("indicators")
    never = F.lit(False)
    return df.select("trade_date", "ts_code", "name", "open", "high", "low", "close", "vol", "prev_close", F.col("chg_pct").alias("change_pct"),
                     *SIGNAL_COLUMNS, F.lit(0.0).alias("score_dl"), never.alias("signal_buy_dl"), *SELL_COLUMNS, never.alias("signal_sell_dl"),
                     never.alias("signal_stop"), F.col("observing").alias("is_observing"), *RISK_COLUMNS, snapshot)
