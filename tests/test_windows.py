"""Windows, recursions and indicators against pandas and by their properties."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.functions import recursion as R
from candlewick.functions.series import BARS as S
from candlewick.operators import indicators as I


def walk(n, code="A", seed=42, start=dt.date(2000, 1, 3)):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 0.5, n))
    high = close + rng.uniform(0, 1, n)
    low = close - rng.uniform(0, 1, n)
    return pd.DataFrame({"ts_code": code, "trade_date": [start + dt.timedelta(days=i) for i in range(n)],
                         "open": low + (high - low) * rng.uniform(0, 1, n), "high": high, "low": low, "close": close,
                         "vol": rng.integers(100, 1000, n).astype(float)})


def panel(spark, *frames):
    df = spark.createDataFrame(pd.concat(frames))
    return df.withColumn("trade_date", F.to_date("trade_date"))


def collect(df, *columns):
    return df.orderBy("ts_code", "trade_date").select("ts_code", *columns).toPandas()


@pytest.mark.parametrize("span", [2, 12, 26, 60, 250])
def test_ema_over_many_blocks(spark, span):
    p = walk(2600)
    df = R.decayed_sums(I.number_bars(panel(spark, p)), S, "bar_no", {"e": R.ema_span("close", span, "bar_no")})
    want = p["close"].ewm(span=span, adjust=False).mean()
    np.testing.assert_allclose(collect(df, "e")["e"], want, rtol=1e-10)


@pytest.mark.parametrize("n", [3, 14, 57])
def test_wilder(spark, n):
    p = walk(1500)
    df = I.number_bars(panel(spark, p))
    df = R.decayed_sums(df, S, "bar_no", {"w": R.mean_seeded("vol", n, "bar_no", S), "s": R.sum_seeded("vol", n, "bar_no", S, n + 1)})
    got = collect(df, "w", "s")
    v = p["vol"].to_numpy()
    w, s = np.full(len(v), np.nan), np.full(len(v), np.nan)
    w[n - 1], s[n] = v[:n].mean(), v[1:n + 1].sum()
    for i in range(n, len(v)):
        w[i] = (w[i - 1] * (n - 1) + v[i]) / n
        if i > n:
            s[i] = s[i - 1] - s[i - 1] / n + v[i]
    np.testing.assert_allclose(got["w"], w, rtol=1e-10)
    np.testing.assert_allclose(got["s"], s, rtol=1e-10)


def test_kdj_stands_still_on_flat_windows(spark):
    p = walk(700)
    p.loc[100:120, ["open", "high", "low", "close"]] = 90.0
    got = collect(I.kdj(panel(spark, p), "table"), "k", "d")
    low, high = p["low"].rolling(9).min(), p["high"].rolling(9).max()
    rsv = (p["close"] - low) / (high - low) * 100
    k, d, ks, ds = 50.0, 50.0, [], []
    for x in rsv:
        if not np.isnan(x):
            k = k * 2 / 3 + x / 3
            d = d * 2 / 3 + k / 3
        ks.append(k), ds.append(d)
    np.testing.assert_allclose(got["k"], ks, rtol=1e-9)
    np.testing.assert_allclose(got["d"], ds, rtol=1e-9)


def test_leading_nulls_and_constant_input(spark):
    p = walk(50)
    p["close"] = 7.0
    df = I.ema(I.sma(panel(spark, p), 20), 20, "lib")
    got = collect(df, "sma20", "ema20")
    assert got["sma20"].isna().sum() == 19 and got["ema20"].isna().sum() == 19
    np.testing.assert_allclose(got["sma20"].dropna(), 7.0)
    np.testing.assert_allclose(got["ema20"].dropna(), 7.0)


def test_ranges_and_orders(spark):
    df = panel(spark, walk(252))
    df = I.atr(I.bollinger(I.macd(I.rsi(df, 14, "lib"), "lib"), flavor="lib"), flavor="lib")
    got = collect(df, "rsi", "bb_upper", "bb_mid", "bb_lower", "atr", "dif", "dea", "macd_bar")
    assert got["rsi"].dropna().between(0, 100).all()
    ok = got.dropna(subset=["bb_mid"])
    assert (ok["bb_upper"] >= ok["bb_mid"]).all() and (ok["bb_mid"] >= ok["bb_lower"]).all()
    assert (got["atr"].dropna() >= 0).all()
    np.testing.assert_allclose(got["macd_bar"].dropna(), (got["dif"] - got["dea"]).dropna(), atol=1e-12)


def test_obv_rises_with_price(spark):
    p = walk(50)
    p["close"], p["vol"] = np.arange(1.0, 51.0), 1000.0
    assert collect(I.obv(panel(spark, p)), "obv")["obv"].diff().dropna().gt(0).all()


def test_log_return_near_simple_return(spark):
    df = panel(spark, walk(100)).withColumns({"l": S.log_return("close"), "p": S.pct_change("close")})
    got = collect(df, "l", "p").dropna()
    assert (got["l"] - got["p"]).abs().max() < 1e-3


def test_flat_price_and_zero_volume(spark):
    p = walk(80)
    p[["open", "high", "low", "close"]] = 10.0
    p["vol"] = 0.0
    row = collect(I.indicator_panel(panel(spark, p)), "k", "j", "rsi1", "vwap", "vol_ratio", "atr").iloc[-1]
    assert row["k"] == pytest.approx(50) and row["j"] == pytest.approx(50)
    assert row["vwap"] == 10.0 and row["vol_ratio"] == 1.0 and row["atr"] == 0.0


@pytest.mark.parametrize("n", [1, 8, 9, 59, 60, 113, 114])
def test_short_series(spark, n):
    got = collect(I.indicator_panel(panel(spark, walk(n))), "k", "trend_slow", "dif", "surge_bar", "bbi_20_ago")
    assert len(got) == n and got["trend_slow"].notna().all() and got["k"].notna().all()


def test_later_of_equal_maxima(spark):
    p = walk(10)
    p["high"] = [1, 2, 9, 3, 9, 1, 1, 1, 1, 1.0]
    df = I.number_bars(panel(spark, p))
    df = df.withColumns({"late": S.bars_since_highest("high", 10, "bar_no"),
                         "early": -S.at_highest("high", 10, "bar_no", [], latest=False)["at"]})
    last = collect(df, "late", "early").iloc[-1]
    assert last["late"] == 5 and last["early"] == 3


def test_column_and_growing_signals(spark):
    from candlewick.operators import signals

    class Reversal:
        space = {"n": (10, 30)}

        def column(self, params):
            return S.mean("close", int(params["n"])) - F.col("close")

    df = panel(spark, walk(90), walk(90, "B", 5))
    native = signals.column_signal(df, Reversal()).orderBy("ts_code", "trade_date").toPandas()["signal"]
    slow = signals.growing_window_signal(df, lambda b: b["close"].tail(20).mean() - b["close"].iloc[-1], 60)
    got = slow.orderBy("ts_code", "trade_date").toPandas()["signal"]
    assert got.isna().sum() == 118
    np.testing.assert_allclose(got.dropna(), native[got.notna()], atol=1e-9)
