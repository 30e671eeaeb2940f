"""Scoring rules on the weekly panel."""

from pyspark.sql import functions as F

from candlewick.operators import indicators as I, rules
from candlewick.plans import rule_sql
from candlewick.plans.oracle_views import snap as sq, with_views
from candlewick.plans.registry import query
from candlewick.plans.shaping import KEYS, rounded


def _upto(last: str) -> dict:
    names = list(rule_sql.CTES)
    return {n: rule_sql.CTES[n] for n in names[:names.index(last) + 1]}


def _sql(columns: str, last: str = "final", where: str = "") -> str:
    return with_views("bars_w", f"SELECT ts_code, trade_date, {columns} FROM {last} {where}", **_upto(last))


def facts(t):
    return rules.rule_columns(I.indicator_panel(t.bars_w()))


def panel(t):
    return rules.signal_panel(I.indicator_panel(t.bars_w()))


@query("pullback_score", "G1", _sql("score_b1", "rules"))
def pullback_score(t):
    return rules.b1_score(facts(t)).select(*KEYS, "score_b1")


@query("breakout_score", "G3", _sql("CAST(score_b2 AS DOUBLE) AS score_b2", "rules"))
def breakout_score(t):
    return rules.b2_score(facts(t)).select(*KEYS, "score_b2")


@query("surge_bars", "G5 G9 F27", _sql("surge, surge_scb, j_turn AS j_turns_up", "rules"))
def surge_bars(t):
    return rules.surge_columns(facts(t)).select(*KEYS, "surge", "surge_scb", "j_turns_up")


@query("limit_flags", "B7", _sql("lim_up AS limit_up, lim_down AS limit_down, flat_up AS limit_up_flat, flat_down AS limit_down_flat", "flags"))
def limit_flags(t):
    return rules.limit_flags(t.bars_w()).select(*KEYS, "limit_up", "limit_down", "limit_up_flat", "limit_down_flat")


@query("dry_volume", "G7 G8", _sql("dry_level, dry_base", "based"))
def dry_volume(t):
    return rules.dry_volume(facts(t)).select(*KEYS, "dry_level", "dry_base")


@query("dry_then_surge", "G10", _sql("CAST(score_scb AS DOUBLE) AS score_scb, scb AS signal_buy_scb"))
def dry_then_surge(t):
    df = rules.dry_volume(rules.surge_columns(facts(t)))
    return rules.dry_then_surge(df).select(*KEYS, "score_scb", "signal_buy_scb")


@query("pin30", "G11", _sql("dz30 AS signal_buy_dz30, CASE WHEN dz30 THEN 5.0::DOUBLE ELSE 0 END AS score_dz30"))
def pin30(t):
    return rules.pin30(facts(t)).select(*KEYS, "signal_buy_dz30", "score_dz30")


@query("sell_score_and_flags", "G12 G13", _sql("CAST(score_s1 AS DOUBLE) AS score_s1, s1_half AS signal_s1_half, s1_full AS signal_s1_full, observing, break_slow"))
def sell_score_and_flags(t):
    return rules.sell_flags(rules.s1_score(facts(t))).select(
        *KEYS, "score_s1", "signal_s1_half", "signal_s1_full", "observing", "break_slow")


@query("simple_buy_score", "G14", _sql(
    "CAST(CASE WHEN j < 13 THEN 2 ELSE 0 END + CASE WHEN dif > 0 THEN 1 ELSE 0 END + CASE WHEN rsi1 < 50 THEN 2 ELSE 0 END"
    " + CASE WHEN vol > m60 THEN 2 ELSE 0 END + CASE WHEN chg > 1 THEN 1 ELSE 0 END AS DOUBLE) AS score_simple", "facts"))
def simple_buy_score(t):
    return rules.simple_buy_score(I.indicator_panel(t.bars_w())).select(*KEYS, "score_simple")


@query("buy_signals", "G2 G4 G6", _sql("b1 AS signal_buy_b1, b2 AS signal_buy_b2, blk AS signal_buy_blk, blkb2 AS signal_buy_blkb2, "
                                      "CASE WHEN blkb2 THEN round(7 * 0.5 + score_b2 * 0.6 + 3, 6) ELSE 0 END AS score_blkb2"))
def buy_signals(t):
    return panel(t).select(*KEYS, "signal_buy_b1", "signal_buy_b2", "signal_buy_blk", "signal_buy_blkb2", "score_blkb2")


@query("signal_history", "M1", _sql("CAST(CASE WHEN rn >= 80 THEN -score_s1 END AS DOUBLE) + 0.0 AS signal", "states"))
def signal_history(t):
    df = rules.s1_score(facts(t))
    return rules.signal_history(df, "s1", 80).withColumn("signal", F.col("signal") + 0.0)


_SERIES = {"b1": "score_b1", "b2": "score_b2", "blk": "CASE WHEN surge THEN 7 ELSE 0 END", "blkb2": "CASE WHEN blkb2 THEN round(7 * 0.5 + score_b2 * 0.6 + 3, 6) ELSE 0 END",
           "dz30": "CASE WHEN dz30 THEN 5 ELSE 0 END", "s1": "-score_s1", "scb": "score_scb"}


@query("signal_series", "G20 M1", _sql(", ".join(f"CAST(CASE WHEN rn >= {60 if n == 's1' else 120} THEN {e} END AS DOUBLE) + 0.0 AS signal_{n}" for n, e in _SERIES.items())))
def signal_series(t):
    return rules.signal_series(panel(t))


_EVENTS = " UNION ALL ".join(
    f"SELECT trade_date, ts_code, '{a}' AS signal_abbrev, '{k}' AS signal_type, CAST({s} AS DOUBLE) AS score FROM final WHERE {f}"
    for a, k, f, s in [("B1", "buy", "b1", "score_b1"), ("B2", "buy", "b2", "score_b2"), ("BLK", "buy", "blk", "7"),
                       ("BLKB2", "buy", "blkb2", "round(7 * 0.5 + score_b2 * 0.6 + 3, 6)"), ("SCB", "buy", "scb", "score_scb"),
                       ("DZ30", "buy", "dz30", "5"), ("S1", "sell", "s1_full", "score_s1"), ("S1H", "sell", "s1_half", "score_s1"),
                       ("LINE", "sell", "break_slow", "NULL")])


@query("signal_events", "G21", with_views("bars_w", _EVENTS, **_upto("final")))
def signal_events(t):
    return rules.signal_events(panel(t))


@query("grouped_signal", "M1 M3", with_views("bars_w", "SELECT ts_code, trade_date, CAST(sign(avg(close) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS 19 PRECEDING) - close) AS DOUBLE) + 0.0 AS signal FROM bars_w"))
def grouped_signal(t):
    """A pandas signal run per code: is the close under its 20-bar mean?"""
    from candlewick.operators.signals import grouped_signal as grouped

    def under_mean(bars, params):
        mean = bars["close"].rolling(params["n"], min_periods=1).apply(lambda x: x.sum() / len(x), raw=True)
        gap = (mean - bars["close"]).where((mean - bars["close"]).abs() > 1e-9, 0.0)
        return gap.apply(lambda x: float((x > 0) - (x < 0)))

    return grouped(t.bars_w().select(*KEYS, "close"), under_mean, {"n": 20})


class FallInDeviations:
    """How far the close is under its highest so far, in standard deviations of the
    closes so far (Welford's recursion)."""

    columns = ["close"]

    def start(self):
        return 0, 0.0, 0.0, float("-inf")

    def step(self, state, bar):
        n, mean, squares, top = state
        (close,) = bar
        n, gap = n + 1, close - mean
        mean += gap / n
        squares += gap * (close - mean)
        top = max(top, close)
        return (n, mean, squares, top), (top - close) / (squares / (n - 1)) ** 0.5 if squares > 0 else None


@query("running_score", "M2", with_views("bars_s", f"SELECT ts_code, trade_date, CASE WHEN n >= 60 AND s > 0 THEN {sq('(top - close) / s', 3)} END AS signal FROM (SELECT ts_code, trade_date, close, count(*) OVER w AS n, max(close) OVER w AS top, stddev_samp(close) OVER w AS s FROM bars_s WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date))"))
def running_score(t):
    from candlewick.operators.signals import running_score as score

    return rounded(score(t.bars_s(), FallInDeviations()), KEYS, ["signal"], 3)
