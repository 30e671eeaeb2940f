"""Statistics by date without a task per date, sweeps without a grid join, scores over growing windows."""

import datetime as dt
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from candlewick.operators import evaluate, factors, ranks, risk, signals, splits
from conftest import SMALL

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def panel():
    """Codes by dates of very different size, with ties, nulls and a constant date."""
    rng = np.random.default_rng(0)
    rows = []
    for d, n in enumerate((400, 60, 12, 1, 30)):
        for c in range(n):
            x = float(rng.normal()) if d != 4 else 1.0
            rows.append((f"c{c:03}", DAY + dt.timedelta(days=d), None if rng.uniform() < 0.05 else x, float(rng.integers(0, 9)), float(rng.normal()), "i" + str(c * c % 5) if c % 17 else None))
    return pd.DataFrame(rows, columns=["ts_code", "trade_date", "x", "y", "future_return", "industry"])


@pytest.fixture(scope="module")
def df(spark, panel):
    schema = "ts_code string, trade_date date, x double, y double, future_return double, industry string"
    return spark.createDataFrame(panel.astype(object).where(panel.notna(), None).values.tolist(), schema)


def test_grouped_quantiles(panel, df):
    probs = [0.0, 0.2, 0.5, 0.77, 1.0]
    got = {r["trade_date"]: r for r in ranks.grouped_quantiles(df, ["trade_date"], ["x", "y"], probs).collect()}
    for day, g in panel.groupby("trade_date"):
        for v in ("x", "y"):
            want = g[v].dropna()
            assert got[day][f"{v}_n"] == (len(want) or None)
            np.testing.assert_allclose(got[day][f"{v}_q"], want.quantile(probs), rtol=1e-12, atol=1e-12)


def test_quantiles_of_wild_values(spark):
    """Signs, zeros, infinities, the smallest and largest doubles, many magnitudes and long ties."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), np.zeros(50), [5e-324, -5e-324, 1.7e308, -1.7e308, np.inf], np.full(400, 0.1)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [i / 40 for i in range(40)]
    (row,) = ranks.grouped_quantiles(df.withColumn("g", F.lit(1)), ["g"], ["x"], probs).collect()
    s, at = np.sort(x), (len(x) - 1) * np.array(probs)
    low, high = s[np.floor(at).astype(int)], s[np.ceil(at).astype(int)]
    with np.errstate(over="ignore", invalid="ignore"):
        want = low + (at - np.floor(at)) * (high - low)
    np.testing.assert_allclose(row["x_q"], want, rtol=1e-9)
    assert row["x_n"] == len(x)


@pytest.mark.parametrize("bins", [1, 7])
def test_row_numbers(panel, df, bins):
    got = ranks.row_numbers(df.select("trade_date", "ts_code", "y"), ["trade_date"], [F.col("y").desc(), F.col("ts_code")], bins).toPandas().sort_values(["trade_date", "ts_code"])
    want = panel.sort_values(["trade_date", "y", "ts_code"], ascending=[True, False, True])
    want = want.assign(place=want.groupby("trade_date").cumcount() + 1).sort_values(["trade_date", "ts_code"])
    assert got["place"].tolist() == want["place"].tolist()
    assert got["n_all"].tolist() == want.groupby("trade_date")["ts_code"].transform("size").tolist()


def test_winsorised_scores(panel, df):
    got = factors.zscore(factors.winsorize_mad(df, ["x", "y"]), ["x", "y"]).toPandas().sort_values(["trade_date", "ts_code"]).reset_index(drop=True)

    def score(s):
        middle = s.median()
        width = 3 * 1.4826 * (s - middle).abs().median()
        s = s.clip(middle - width, middle + width)
        return (s - s.mean()) / (s.std() if s.std() > 0 else np.nan)

    for v in ("x", "y"):
        want = panel.groupby("trade_date")[v].transform(score)
        np.testing.assert_allclose(got[v].astype(float), want.to_numpy(), atol=1e-9)


def test_no_window_by_date_in_the_plans(df, capsys):
    for out in (factors.composite_score(df, {"x": 1.0, "y": 0.5}), factors.quantile_buckets(df, "x", 5), factors.top_share_per_date(df, "x", 0.1), factors.daily_ic(df, "x", method="spearman")):
        out.explain("formatted")
        plan = capsys.readouterr().out
        assert "percentile" not in plan and "median" not in plan
        # windows by date see one row per date and range partition (_bin, its count _n)
        assert not [x for x in plan.splitlines() if "windowspecdefinition(trade_date" in x and "_bin" not in x and "sum(_n#" not in x]


def test_quantile_buckets_and_report(spark, panel, df):
    got = factors.quantile_buckets(df, "y", 4, min_names=20).toPandas()
    assert set(got["trade_date"]) == {DAY + dt.timedelta(days=i) for i in (0, 1, 4)}
    for day, g in got.groupby("trade_date"):
        edges = panel[panel["trade_date"] == day]["y"].quantile([0.25, 0.5, 0.75]).to_numpy()
        assert (g["quantile"] == 1 + (g["y"].to_numpy()[:, None] > edges).sum(1)).all()
    wide = panel.assign(ret=panel["future_return"])
    frame = spark.createDataFrame(wide[["ts_code", "trade_date", "x", "y", "ret"]].astype(object).where(wide[["ts_code", "trade_date", "x", "y", "ret"]].notna(), None).values.tolist(), "ts_code string, trade_date date, x double, y double, ret double")
    report = {(r["part"], r["factor"], r["period"], r["name"]): r["value"] for r in factors.factor_report(frame, ["x", "y"], [1, 2], min_per_bucket=2).collect()}
    assert len(report) == 2 * 2 * 5 + 2 * 6 + 4
    wide = wide.sort_values(["ts_code", "trade_date"])
    both = wide[["x", "y"]].corr().loc["x", "y"]
    assert math.isclose(report["correlation", "x", None, "y"], both, abs_tol=1e-9) and math.isclose(report["correlation", "x", None, "x"], 1, abs_tol=1e-9)
    for period in (1, 2):
        ahead = wide.assign(r=wide.groupby("ts_code")["ret"].shift(-period)).dropna(subset=["x", "r"])
        ic = [g["x"].corr(g["r"]) for _, g in ahead.groupby("trade_date") if len(g) >= 10 and g["x"].nunique() > 1]
        assert math.isclose(report["ic", "x", period, "ic_mean"], np.mean(ic), abs_tol=1e-9)
    ahead = wide.assign(r=wide.groupby("ts_code")["ret"].shift(-1)).dropna(subset=["y", "r"])
    tops = [g[g["y"] > g["y"].quantile(0.8)]["r"].mean() for _, g in ahead.groupby("trade_date") if len(g) >= 10]
    assert math.isclose(report["quantile", "y", 1, "Q5"], np.nanmean(tops), abs_tol=1e-9)


def test_industry_quotas(panel, df):
    n = 12
    got = factors.industry_neutral(df.filter("x IS NOT NULL"), "x", n).toPandas()
    for day, g in panel.dropna(subset=["x"]).assign(industry=panel["industry"].fillna("")).groupby("trade_date"):
        sizes = g.groupby("industry").size()
        rows = []
        for name, part in g.groupby("industry"):
            share = sizes[name] / len(g)
            best = part.sort_values(["x", "ts_code"], ascending=[False, True]).head(max(1, int(share * n)))
            rows += [(-share, name, i, c) for i, c in enumerate(best["ts_code"])]
        want = [c for *_, c in sorted(rows)[:n]]
        assert got[got["trade_date"] == day].sort_values("place")["ts_code"].tolist() == want


@pytest.mark.parametrize("n", [203, 501, 1002])
@pytest.mark.parametrize("r", [0.01, 0.1, 0.2, 0.3])
def test_p_value_beyond_the_series(spark, r, n):
    """The expansion against the finite series, worked out here for any number of degrees."""
    nu = n - 2
    angle, total, term = math.asin(r), 0.0, 1.0 if nu % 2 == 0 else math.cos(math.asin(r))
    for i in range(nu // 2 if nu % 2 == 0 else (nu - 1) // 2):
        total += term
        term *= ((2 * i + 1) / (2 * i + 2) if nu % 2 == 0 else (2 * i + 2) / (2 * i + 3)) * math.cos(angle) ** 2
    inside = r * total if nu % 2 == 0 else (angle + r * total) * 2 / math.pi
    row = spark.createDataFrame([(r, n), (r, 2_000_000_000)], "r double, n long").select(factors.two_sided_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert math.isclose(row[0]["p"], 1 - inside, rel_tol=1e-5, abs_tol=1e-12) and 0 <= row[1]["p"] < 1e-9


def test_sweeps_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        close = 50 * np.exp(rng.normal(0, 0.03, 120).cumsum())
        score = rng.normal(size=120).round(1)  # ties, also at thresholds
        rows += [(f"c{c}", DAY + dt.timedelta(days=i), float(close[i]), float(score[i]) if rng.uniform() > 0.1 else None, i // 40) for i in range(120)]
    pdf = pd.DataFrame(rows, columns=["ts_code", "trade_date", "close", "score", "fold"])
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, close double, score double, fold int")
    thresholds = [0.0, -0.5, 0.5, 1.2, 9.0]
    grid = splits.parameter_grid(spark, {"threshold": thresholds})
    got = {r["threshold"]: r for r in splits.sweep_thresholds(df, grid, 5, min_signals=20, min_samples=10).collect()}
    pdf["ret"] = pdf.groupby(["ts_code", "fold"])["close"].shift(-5) / pdf["close"] - 1
    pdf["all"] = pdf.groupby("ts_code")["close"].shift(-5) / pdf["close"] - 1
    summary = {r["threshold"]: r for r in splits.sweep_summary(df.drop("fold"), grid, 5).collect()}
    for t in thresholds:
        sharpes = []
        for _, g in pdf[pdf["score"] >= t].groupby("fold"):
            pairs = g.dropna(subset=["ret"])
            if (g["score"].abs() > 0).sum() >= 20 and len(pairs) >= 10:
                low, high = pairs["score"].quantile(0.33), pairs["score"].quantile(0.67)
                legs = pd.concat([pairs[pairs["score"] >= high]["ret"], -pairs[pairs["score"] <= low]["ret"]])
                sharpes.append(legs.mean() / legs.std() * math.sqrt(252))
        assert (t in got) == (len(sharpes) >= 2)
        if t in got:
            assert math.isclose(got[t]["score_uncapped"], np.mean(sharpes), rel_tol=1e-9) and got[t]["n_folds"] == len(sharpes)
        hits = pdf[pdf["score"] >= t]["all"].dropna()
        assert (t in summary) == (len(hits) > 0)
        if len(hits) > 1:
            r = summary[t]
            assert r["total_trades"] == len(hits) and math.isclose(r["avg_return"], hits.mean(), rel_tol=1e-9)
            assert math.isclose(r["sharpe_ratio"], hits.mean() / hits.std() * math.sqrt(252), rel_tol=1e-9) and math.isclose(r["win_rate"], (hits > 0).mean())


def test_walk_forward_from_the_end_of_a_month(spark):
    """Months of different length: window edges are clipped, panes follow them."""
    rng = np.random.default_rng(9)
    rows = [(dt.date(2023, 8, 31) + dt.timedelta(days=int(i)), float(rng.normal())) for i in rng.integers(0, 700, 500)]
    events = spark.createDataFrame(rows, "trade_date date, ret double")
    span = spark.createDataFrame([(dt.date(2023, 8, 31), dt.date(2025, 7, 31))], "start date, end date")
    out = splits.walk_forward(events, splits.walk_forward_windows(span)).collect()
    assert len(out) == 2
    for r in out:
        train = [x for d, x in rows if r["train_start"] <= d < r["cut"]]
        test = [x for d, x in rows if r["cut"] <= d < r["test_end"]]
        assert math.isclose(r["train_return"], np.mean(train), abs_tol=1e-12) and math.isclose(r["test_return"], np.mean(test), abs_tol=1e-12)


@pytest.mark.parametrize("bins", [1, 4, 30])
def test_drawdown_over_ranges_of_codes(spark, bins):
    rng = np.random.default_rng(5)
    rows = [(h, f"c{c:02}", DAY + dt.timedelta(days=d), float(rng.normal(0, 0.1))) for h in (1, 5) for c in range(25) for d in range(int(rng.integers(1, 9)))]
    df = spark.createDataFrame(rows, "horizon int, ts_code string, trade_date date, ret double")
    got = {r["horizon"]: r["max_drawdown"] for r in evaluate._event_drawdown(df, bins).collect()}
    for h in (1, 5):
        curve = np.cumprod([1 + r for hh, _, _, r in sorted(rows) if hh == h])
        assert math.isclose(got[h], (curve / np.maximum.accumulate(curve) - 1).min(), rel_tol=1e-9)


def test_portfolio_limits_keep_few_rows_of_a_date(spark, capsys):
    rows = [(f"c{i:04}", DAY, i % 3, float(i % 11), 1000.0) for i in range(3000)]
    buys = spark.createDataFrame(rows, "ts_code string, trade_date date, risk_priority int, risk_composite_score double, risk_position_amt double")
    out = risk.portfolio_limits(buys, capital=10_000, max_positions=8, max_daily=0.5)
    out.explain("formatted")
    assert "WindowGroupLimit" in capsys.readouterr().out
    got = out.toPandas()
    assert len(got) == 3000 and got["accepted"].sum() == 5 and got["place"].notna().sum() == 8
    best = sorted(rows, key=lambda r: (-r[2], -r[3], r[0]))[:5]
    assert set(got[got["accepted"]]["ts_code"]) == {r[0] for r in best}


def test_portfolio_limits_of_every_buy(spark):
    days = [DAY, DAY + dt.timedelta(days=1), None]
    rows = [(f"c{i:04}", days[i % 7 // 3], i % 3, float(i % 11), 1000.0 * (i % 5) if i % 13 else None) for i in range(3000)]
    buys = spark.createDataFrame(rows, "ts_code string, trade_date date, risk_priority int, risk_composite_score double, risk_position_amt double")
    out = risk.portfolio_limits(buys, capital=10_000, max_positions=8, max_daily=0.5, every=True)
    got = {r["ts_code"]: r for r in out.collect()}
    assert len(got) == 3000
    for day in days:
        opened = None
        for place, row in enumerate(sorted((r for r in rows if r[1] == day), key=lambda r: (-r[2], -r[3], r[0])), 1):
            opened = opened if row[4] is None else (opened or 0.0) + row[4]
            r = got[row[0]]
            assert (r["place"], r["opened"]) == (place, opened)
            assert r["accepted"] == (place <= 8 and opened is not None and opened <= 5000)


def test_portfolio_limits_query_places_every_bar(spark):
    got = __spark_entry__.queries()["portfolio_limits"](spark, SMALL)
    assert got.filter("place IS NULL OR opened IS NULL").count() == 0 and got.filter("place > 8").count() > 0


def test_running_score(spark):
    class Sum:
        columns = ["close", "trade_date"]

        def start(self):
            return 0.0

        def step(self, state, bar):
            close, day = bar
            return state + close, state / close if close != 4 else float("x")

    n = 10_000
    rows = [("long", DAY + dt.timedelta(days=i), float(i % 7 + 1)) for i in range(n)] + [("short", DAY + dt.timedelta(days=i), 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, close double").repartition(3)
    got = signals.running_score(df, Sum(), min_rows=3).orderBy("ts_code", "trade_date").toPandas()
    assert len(got) == n + 5 and got["signal"][:2].isna().all()
    close = np.array([float(i % 7 + 1) for i in range(n)])
    # a step that fails leaves no score, and its bar out of the state
    state = np.concatenate([[0], np.cumsum(np.where(close == 4, 0, close))[:-1]])
    want = np.where(close == 4, np.nan, state / close)
    want[:2] = np.nan
    np.testing.assert_allclose(got["signal"][:n], want)
    assert got["signal"][n + 2:].tolist() == [2.0, 3.0, 4.0]
    assert signals.running_score(df.limit(0), Sum()).collect() == []


def test_rank_correlation_has_no_join_on_the_group_alone(spark):
    df = spark.createDataFrame([(g, float(i % 17), float(i * 7 % 11)) for g in (1, 2, 3) for i in range(60)], "g int, x double, y double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ranks.spearman(df, ["g"], "x", "y")
        joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", out._jdf.queryExecution().executedPlan().toString())
        assert joins and all("," in keys for keys in joins)
        got = out.toPandas().set_index("g")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for g, part in df.toPandas().groupby("g"):
        assert math.isclose(got.loc[g, "ic"], part["x"].rank().corr(part["y"].rank()), rel_tol=1e-9) and got.loc[g, "n_obs"] == 60


def test_holding_curve_writes_events_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(f"c{c}", DAY + dt.timedelta(days=d), float(rng.integers(1, 9)) if rng.random() > 0.1 else None, float(rng.integers(-1, 2))) for c in range(4) for d in range(150)]
    panel = spark.createDataFrame(rows, "ts_code string, trade_date date, close double, signal double")
    want = {r["horizon"]: r for r in evaluate.horizon_statistics(evaluate.event_returns(panel, list(range(1, 21)))).collect()}
    written, cut = [], evaluate.cut

    def spy(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(evaluate, "cut", spy)
    got = {r["horizon"]: r for r in evaluate.holding_curve(panel, 20).collect()}
    assert max(written) <= len(rows) and set(got) == set(want) == set(range(1, 21))
    for h, r in got.items():
        assert all(r[c] == want[h][c] or math.isclose(r[c], want[h][c], rel_tol=1e-9, abs_tol=1e-12) for c in r.asDict())
