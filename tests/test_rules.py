"""Scoring rules: no look-ahead, guards, and a plain re-statement of some rules."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.operators import indicators as I, risk, rules
from test_windows import collect, panel, walk


def jumpy(n, seed):
    p = walk(n, code=f"30000{seed}", seed=seed)
    rng = np.random.default_rng(seed)
    p["close"] = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    p["open"] = p["close"] * np.exp(rng.normal(0, 0.02, n))
    p["high"] = p[["open", "close"]].max(axis=1) * (1 + rng.uniform(0, 0.01, n))
    p["low"] = p[["open", "close"]].min(axis=1) * (1 - rng.uniform(0, 0.01, n))
    p["vol"] = rng.lognormal(6, 0.6, n).round()
    return p


SCORES = ["score_b1", "score_b2", "score_scb", "score_dz30", "score_s1", "score_blk", "signal_buy_b2", "break_slow", "dry_base"]


@pytest.fixture(scope="module")
def frames():
    return [jumpy(200, s) for s in (1, 2, 3)]


@pytest.fixture(scope="module")
def scored(spark, frames):
    df = rules.signal_panel(I.indicator_panel(panel(spark, *frames)))
    return df.toPandas().sort_values(["ts_code", "trade_date"]).reset_index(drop=True)


def test_scores_of_a_prefix_equal_those_of_the_whole(spark, frames, scored):
    for cut in (60, 131):
        part = [f.iloc[:cut] for f in frames]
        got = rules.signal_panel(I.indicator_panel(panel(spark, *part))).toPandas().sort_values(["ts_code", "trade_date"])
        last = got.groupby("ts_code").tail(1).set_index("ts_code")
        whole = scored.groupby("ts_code").nth(cut - 1).set_index("ts_code")
        for c in SCORES:
            a, b = last[c].astype(float), whole[c].astype(float)
            np.testing.assert_allclose(a.sort_index(), b.sort_index(), atol=1e-6, err_msg=c)


def test_no_score_before_sixty_bars(scored):
    early = scored.groupby("ts_code").head(59)
    assert early["score_b1"].isna().all() and early["score_b2"].isna().all() and (early["score_s1"] == 0).all()
    assert not early["signal_buy_b1"].any()


def test_doji_and_dry_volume_terms_by_hand(spark, frames, scored):
    p = frames[0]
    v = p["vol"].to_numpy()
    for t in (70, 110, 199):
        want = 0
        prev = p["close"].iloc[t - 1]
        c, o, h, l = (p[x].iloc[t] for x in ("close", "open", "high", "low"))
        limit = (c >= prev * 1.2 and c > o) or (c <= prev * 0.8 * 1.01 and c < o)
        if not limit:
            for days in (41, 31, 21, 10):
                if v[t] * 0.9 <= v[t - days + 1:t + 1].min():
                    want = days
                    break
        row = scored[(scored.ts_code == p.ts_code.iloc[0])].iloc[t]
        assert row["dry_level"] == want


def test_line_break_needs_two_days_below(spark):
    p = walk(130)
    p["close"] = 100.0
    p.loc[120:121, "close"] = 90.0  # two days below, then back above
    p.loc[122:, "close"] = 110.0
    p.loc[125, "close"] = 80.0  # one day only
    p["high"], p["low"], p["open"] = p["close"] + 1, p["close"] - 1, p["close"]
    got = collect(rules.line_break(I.trend_slow(panel(spark, p))), "observing", "break_slow")
    assert list(got.index[got["break_slow"]]) == [121]
    assert list(got.index[got["observing"]]) == [120, 125]


def test_sell_score_on_volume_at_a_high(spark):
    p = walk(80)
    p["close"] = np.linspace(20, 100, 80)
    p["open"], p["high"], p["low"], p["vol"] = p["close"] - 0.1, p["close"] + 0.2, p["close"] - 0.3, 100.0
    p.loc[79, ["open", "high", "vol"]] = [103.0, 110.0, 500.0]
    got = collect(rules.s1_score(rules.rule_columns(I.indicator_panel(panel(spark, p)))), "score_s1")
    assert got["score_s1"].iloc[-1] >= 11.5  # 10 for the volume peak, 1.5 for the pattern


def test_limit_flags_by_board(spark):
    rows = []
    for code, jump in (("600001", 1.10), ("300001", 1.10), ("300002", 1.20)):
        rows += [(code, dt.date(2024, 1, 1), 10.0, 10.0, 10.0, 10.0), (code, dt.date(2024, 1, 2), *(10 * jump,) * 4)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double")
    flat = {r["ts_code"] for r in rules.limit_flags(df).filter("limit_up_flat").collect()}
    assert flat == {"600001", "300002"}


def test_resonance_falls_back_on_three_flags(spark):
    flags = "signal_buy_b1 boolean, signal_buy_b2 boolean, signal_buy_scb boolean, signal_buy_blk boolean, signal_buy_dz30 boolean"
    scores = ", ".join(f"{c} double" for c in risk.SCORE_WEIGHTS)
    rows = [(True, True, False, False, True, 8.0, 9.0, 0.0, 0.0, 5.0, "bull"), (False, True, False, False, False, 0.0, 9.0, 0.0, 0.0, 0.0, "range")]
    got = risk.resonance(spark.createDataFrame(rows, f"{flags}, {scores}, market_state string")).collect()
    assert got[0]["priority"] == 3 and got[0]["suggested_position_pct"] == pytest.approx(0.198) and got[0]["should_execute"]
    assert got[1]["priority"] == 1 and not got[1]["should_execute"]


def test_events_list_every_fired_flag(scored, spark):
    df = spark.createDataFrame(scored[["ts_code", "trade_date", *[c for c in scored.columns if c.startswith(("signal_", "score_"))], "break_slow"]])
    n = rules.signal_events(df).count()
    flags = ["signal_buy_b1", "signal_buy_b2", "signal_buy_blk", "signal_buy_blkb2", "signal_buy_scb", "signal_buy_dz30", "signal_s1_full", "signal_s1_half", "break_slow"]
    assert n == int(scored[flags].sum().sum())


def test_panel_over_segments_equals_the_whole(spark):
    """A code with many bars, cut into segments, scores as it does in one piece."""
    from candlewick.operators.split import over_segments

    long, short = jumpy(2600, 4), jumpy(150, 5)
    df = panel(spark, long, short)
    columns = ["dif", "k", "d", "atr", "trend_fast", "trend_slow", "rsi4", "score_b1", "score_b2", "score_s1", "score_scb", "dry_level"]
    build = lambda rows, s=I.BARS: rules.signal_panel(I.indicator_panel(rows, s), s)
    keep = lambda out: out.select("ts_code", "trade_date", *columns).toPandas().sort_values(["ts_code", "trade_date"]).reset_index(drop=True)
    whole = keep(build(df))
    cut = over_segments(df, build, ("trade_date",), halo=1300, max_rows=1300)
    parts = keep(cut)
    assert len(parts) == len(whole) == 2750
    for c in columns:
        np.testing.assert_allclose(parts[c].astype(float), whole[c].astype(float), rtol=1e-7, atol=1e-6, err_msg=c)

