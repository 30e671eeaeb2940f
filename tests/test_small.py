"""Scalar rules, ledger, merging, text and streams on hand-made rows."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.functions import money as M, symbols as Y
from candlewick.operators import asof, evaluate, factors, ingest, ledger, quality, text
from candlewick.operators.indicators import trend_slow
from candlewick.operators.rules import line_break
from candlewick.streaming import bars as B, state as T
from test_windows import panel, walk

D = dt.date


def one(spark, schema, rows, **columns):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[c.alias(n) for n, c in columns.items()]).collect()


def test_symbols(spark):
    codes = ["600000", "000001", "300486", "688001", "830799", "920001"]
    got = one(spark, "c string", [(c,) for c in codes], six=Y.with_suffix("c", "six"), prefix=Y.with_suffix("c", "prefix"),
              digit=Y.with_suffix("c", "digit"), north=Y.with_suffix("c", "north"), board=Y.board_of("c"), market=Y.market_of("c"))
    assert [r["six"][-2:] for r in got] == ["SH", "SZ", "SZ", "SH", "SZ", "SZ"]
    assert [r["prefix"] for r in got][4:] == ["830799", "920001.BJ"]
    assert [r["digit"][-2:] for r in got] == ["SH", "SZ", "SZ", "SH", "BJ", "SH"]
    assert [r["north"][-2:] for r in got] == ["SH", "SZ", "SZ", "SH", "BJ", "SZ"]
    assert [r["board"] for r in got] == ["Main", "Main", "ChiNext", "STAR", "Beijing", "Main"]
    assert [r["market"] for r in got] == ["china"] * 5 + ["china"]
    mixed = one(spark, "c string", [("HK.00700",), ("00700",), ("AAPL",), ("us.msft",)], m=Y.market_of("c"))
    assert [r["m"] for r in mixed] == ["hk", "hk", "us", "us"]
    dotted = one(spark, "c string", [("300486",), ("300486.SZ",), ("sz.300486",), ("600000.SH",)], d=Y.to_dotted("c"))
    assert [r["d"] for r in dotted] == ["sz.300486"] * 3 + ["sh.600000"]


def test_parsing(spark):
    got = one(spark, "s string", [("20240105",), ("2024-01-05",), ("2024/01/05",), ("5.1.24",), ("",)], d=Y.parse_day("s"), n=Y.number_or_null("s"))
    assert [r["d"] for r in got] == [D(2024, 1, 5)] * 3 + [None, None]
    numbers = one(spark, "s string", [("1.5",), ("-",), ("None",), ("x",)], n=Y.number_or_null("s"))
    assert [r["n"] for r in numbers] == [1.5, None, None, None]
    finite = one(spark, "v double", [(1.0,), (float("nan"),), (float("inf"),), (None,)], f=Y.finite("v"), z=Y.finite("v", 0.0))
    assert [r["f"] for r in finite] == [1.0, None, None, None] and [r["z"] for r in finite] == [1.0, 0.0, 0.0, 0.0]


def test_costs(spark):
    fee, basis = M.buy_cost("p", "n")
    r = one(spark, "p double, n double", [(10.0, 100.0)], fee=fee, basis=basis, **M.sell_result("p", F.lit(11.0), "n"), half=M.half_lots("n"))[0]
    assert (r["fee"], r["basis"]) == (5.0, 1005.0)
    assert r["profit_loss"] == pytest.approx(1100 * (1 - 0.00126) - 1000.25, abs=0.01) and r["half"] == 100
    k = one(spark, "w double, a double, b double", [(0.58, 0.08, 0.03), (0.3, 0.02, 0.03), (1.0, 0.1, 0.1)], k=M.kelly_share("w", "a", "b"), e=M.expectancy("w", "a", "b"))
    assert k[0]["k"] == pytest.approx(0.21125, abs=1e-5) and k[1]["k"] == 0 and k[2]["k"] == 0
    s = one(spark, "atr double, p double", [(0.1, 100.0), (10.0, 100.0), (2.0, 100.0), (0.0, 100.0)], s=M.stop_pct("atr", "p"))
    assert [r["s"] for r in s] == [1.5, 8.0, 4.0, 3.0]


LEDGER = [(1, "A", D(2024, 1, 2), None, 100.0, 10.0, "holding", None), (2, "A", D(2024, 1, 3), D(2024, 1, 8), 50.0, 12.0, "sold", 30.0),
          (3, "B", D(2024, 1, 2), D(2024, 1, 2), 10.0, 5.0, "sold", -1.0), (4, "B", D(2024, 1, 4), None, 20.0, 6.0, "holding", None)]
PRICES = [("A", D(2024, 1, 1), 10.0), ("A", D(2024, 1, 4), 11.0), ("A", D(2024, 1, 20), 13.0), ("B", D(2023, 12, 1), 5.0)]


def test_equity_by_brute_force(spark):
    pos = spark.createDataFrame(LEDGER, "id long, ts_code string, buy_date date, sell_date date, shares double, buy_price double, status string, profit_loss double")
    prices = spark.createDataFrame(PRICES, "ts_code string, trade_date date, close double")
    days = [D(2024, 1, d) for d in range(1, 26)]
    got = {r["date"]: r for r in ledger.equity_curve(pos, prices, spark.createDataFrame([(d,) for d in days], "date date"), 10000.0).collect()}
    assert len(got) == len(days)
    peak = 10000.0
    for d in days:
        value = cost = closed = 0.0
        for _, code, buy, sell, n, paid, _, profit in LEDGER:
            if buy > d:
                continue
            if sell is not None and sell <= d:
                closed += profit
                continue
            known = [(t, p) for c, t, p in PRICES if c == code and t <= d and (d - t).days <= 7]
            value += n * (max(known)[1] if known else paid)
            cost += n * paid
        total = 10000 - cost + closed + value
        peak = max(peak, total)
        r = got[d]
        assert r["position_value"] == pytest.approx(value) and r["total_value"] == pytest.approx(total), d
        assert r["drawdown"] == pytest.approx(total / peak - 1), d


def test_positions_held_and_decisions_are_idempotent(spark):
    pos = spark.createDataFrame(LEDGER, "id long, ts_code string, buy_date date, sell_date date, shares double, buy_price double, status string, profit_loss double")
    days = spark.createDataFrame([(D(2024, 1, d),) for d in (1, 2, 7, 8)], "date date")
    held = {(r["date"].day, r["id"]) for r in asof.held_on(pos, days).collect()}
    assert held == {(2, 1), (7, 1), (7, 2), (7, 4), (8, 1), (8, 4)}
    signals = spark.createDataFrame([("A", 9.0, 9.5, 0.0, 6.0, False, False, True), ("B", 6.1, 6.2, 0.0, 0.0, False, False, False)],
                                    "ts_code string, low double, close double, atr double, score_s1 double, signal_s1_full boolean, break_slow boolean, signal_s1_half boolean")
    book = pos.withColumns({"stop_loss_pct": F.lit(0.2), "sell_price": F.lit(None).cast("double"), "sell_reason": F.lit(None).cast("string"),
                            "profit_pct": F.lit(None).cast("double"), "last_action_date": F.lit(None).cast("date")})
    dec = ledger.sell_decisions(book.drop("sell_date", "sell_price", "sell_reason", "profit_loss", "profit_pct"), signals)
    d = dec.collect()
    assert [(r["id"], r["sell_reason"], r["sell_shares"], r["is_full_exit"]) for r in d] == [(1, "s1_half", 100.0, True)]
    once = ledger.apply_decisions(book, dec, "2024-02-01")
    twice = ledger.apply_decisions(once, dec, "2024-02-01")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(once) == key(twice)
    assert once.filter("id = 1").first()["status"] == "sold"
    log = spark.createDataFrame([], "audit_id long, position_id long, action_date date")
    first = ledger.audit_rows(log, dec, "2024-02-01")
    assert [r["audit_id"] for r in first.collect()] == [1]
    again = ledger.audit_rows(first.select("audit_id", "position_id", "action_date"), dec, "2024-02-01")
    assert again.count() == 0


def test_upsert_table_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)], "k long, p string, v double")
    ingest.write_slices(old, path, ["p"])
    new = spark.createDataFrame([(2, "a", 20.0, 1), (2, "a", 21.0, 2), (4, "c", 4.0, 1)], "k long, p string, v double, seq int")
    for _ in range(2):  # a second run changes nothing
        ingest.upsert_table(spark, path, new, ["k"], ["p"], "seq")
        got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
        assert got == {1: 1.0, 2: 21.0, 3: 3.0, 4: 4.0}


def test_quality_of_missing_columns_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (9.0,)], "v double")
    assert quality.uniqueness(df, ["nope"]).first()["valid"] is False
    assert quality.null_counts(df, ["v"]).first()["violations"] == 2
    r = quality.in_range(df, "v", 0, 5).first()
    assert r["violations"] == 3 and r["sample"] == ["9.0", "NaN"]


def test_chinese_sentiment(spark):
    rows = [("公司业绩大幅增长，股价突破",), ("公司亏损严重，暴雷下跌",), ("不看好，没有增长",), ("",), (None,), ("天气晴",)]
    got = [(r["score"], r["label"]) for r in text.with_sentiment(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert got[0] == (1.0, "positive") and got[1] == (-1.0, "negative")
    assert [g[1] for g in got[3:]] == ["neutral"] * 3

    def plain(t):
        p = sum(1 + 0.5 * sum(i + w in t for i in text.INTENSIFIERS) for w in set(text.POSITIVE) if w in t)
        n = sum(1 + 0.5 * sum(i + w in t for i in text.INTENSIFIERS) for w in set(text.NEGATIVE) if w in t)
        for neg in text.NEGATORS:
            if neg in t:
                rest = t[t.find(neg):]
                a, b = (0.5 * sum(w in rest for w in set(words)) for words in (text.POSITIVE, text.NEGATIVE))
                p, n = p - a + b, n + a - b
        return 0.0 if p + n == 0 else max(-1.0, min(1.0, (p - n) / (p + n)))

    assert got[2][0] == pytest.approx(plain(rows[2][0]))


def test_tokens_and_dedup(spark):
    r = spark.createDataFrame([("涨停abc突破1",)], "t string").select(text.tokens("t").alias("x")).first()
    assert r["x"] == ["涨停", "突破"]
    news = spark.createDataFrame([(1, "u"), (2, "u"), (3, None), (4, None), (5, "")], "id long, url string")
    assert {x["id"] for x in text.dedup_by_url(news, "url", ["id"]).collect()} == {1, 3, 4, 5}


@pytest.mark.parametrize("n", [3, 4, 12, 31, 70])
def test_p_value(spark, n):
    rng = np.random.default_rng(n)
    r = float(np.corrcoef(rng.normal(size=n), rng.normal(size=n))[0, 1])
    got = spark.createDataFrame([(r, n)], "r double, n long").select(factors.two_sided_p(F.col("r"), F.col("n")).alias("p")).first()["p"]
    nu = n - 2  # density of the correlation under independence, integrated numerically
    x = np.linspace(-1, 1, 2_000_001)[1:-1]
    f = (1 - x * x) ** (nu / 2 - 1)
    assert got == pytest.approx(f[np.abs(x) >= abs(r)].sum() / f.sum(), abs=2e-3)


def test_event_drawdown_over_codes(spark):
    rng = np.random.default_rng(0)
    rows = [(c, D(2024, 1, 1) + dt.timedelta(days=i), 1, float(rng.normal(0, 0.05))) for c in "abc" for i in range(20)]
    got = evaluate.horizon_statistics(spark.createDataFrame(rows, "ts_code string, trade_date date, horizon int, ret double")).first()
    curve = np.cumprod([1 + r[3] for r in rows])
    assert got["max_drawdown"] == pytest.approx((curve / np.maximum.accumulate(curve) - 1).min())
    assert got["median"] == pytest.approx(np.median([r[3] for r in rows]))


def land(df, path, column, cut):
    """Two files, the later rows in the second."""
    df.filter(F.col(column) < cut).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.2)  # the file source orders by modification time
    df.filter(F.col(column) >= cut).coalesce(1).write.mode("append").parquet(path)


def test_line_break_in_two_batches(spark, tmp_path):
    T.use_rocksdb(spark)
    df = trend_slow(panel(spark, walk(200, "A", 7), walk(200, "B", 8))).select("ts_code", "trade_date", "close", "trend_slow")
    path = str(tmp_path / "in")
    land(df, path, "trade_date", D(2000, 4, 20))
    stream = B.read_stream(spark, path, "ts_code string, trade_date date, close double, trend_slow double", per_batch=1)
    out = spark.read.parquet(B.drain(T.line_break_stream(stream), "append", str(tmp_path / "out")))
    assert out.select("batch").distinct().count() == 2
    cols = ["ts_code", "trade_date", "observing", "break_slow"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, line_break(df).select(cols).collect()))


def test_bars_of_two_batches(spark, tmp_path):
    ticks = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "in")
    land(ticks, path, "ts", dt.datetime(2024, 1, 15, 10, 30))
    out = B.drain(B.bars(B.ticks(spark, path, "*.parquet", per_batch=1)), "update", str(tmp_path / "out"))
    got = B.latest(spark, out, ["ts_code", "bar_time"])
    want = B.bars(ticks.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("ts_code"), "value"))
    cols = ["ts_code", "bar_time", "open", "high", "low", "close", "vol"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
