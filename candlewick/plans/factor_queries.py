"""Cross-sections, factor evaluation, event studies, splits and sweeps on the
supplier panel."""

from pyspark.sql import functions as F

from candlewick.functions.series import BARS as S, ratio
from candlewick.operators import evaluate as E, factors as X, splits as J
from candlewick.plans.oracle_views import lead, over, ref, roll, signed_log as slog, snap as sq, with_views
from candlewick.plans.registry import query
from candlewick.plans.shaping import KEYS, rounded, signed_log, snap
from candlewick.session import small

FACTORS = ["mom4", "volr", "amp"]
_F = dict(factors=f"""SELECT ts_code, trade_date, close, vol, close / {ref('close', 4)} - 1 AS mom4, vol / {roll('avg(vol)', 5)} AS volr,
  (high - low) / close AS amp, close / {ref('close')} - 1 AS ret FROM bars_s""",
          fut=f"SELECT *, {lead('ret')} AS future_return FROM factors")


def factor_panel(t):
    df = t.bars_s().withColumns({
        "mom4": ratio("close", S.ref("close", 4)) - 1, "volr": ratio("vol", S.mean("vol", 5)),
        "amp": ratio(F.col("high") - F.col("low"), "close"), "ret": ratio("close", S.ref("close")) - 1})
    return df.select("ts_code", "trade_date", "close", "vol", *FACTORS, "ret")


def with_future(t):
    return X.future_return(factor_panel(t))


def _sql(body, views="bars_s", **more):
    return with_views(views, body, **{**_F, **more})


_W = {f: f"least(greatest({f}, m_{f} - 3 * 1.4826 * d_{f}), m_{f} + 3 * 1.4826 * d_{f})" for f in FACTORS}
_MAD = dict(
    med="SELECT *, " + ", ".join(f"median({f}) OVER (PARTITION BY trade_date) AS m_{f}" for f in FACTORS) + " FROM factors",
    mad="SELECT *, " + ", ".join(f"median(abs({f} - m_{f})) OVER (PARTITION BY trade_date) AS d_{f}" for f in FACTORS) + " FROM med",
    win="SELECT ts_code, trade_date, " + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN {w} END AS {f}" for f, w in _W.items()) + " FROM mad",
    z="SELECT ts_code, trade_date, " + ", ".join(
        f"({f} - avg({f}) OVER x) / nullif(stddev_samp({f}) OVER x, 0) AS {f}" for f in FACTORS) + " FROM win WINDOW x AS (PARTITION BY trade_date)",
    scored="SELECT *, coalesce(mom4 * 0.5, 0) + coalesce(-volr * 0.3, 0) + coalesce(amp * 0.2, 0) AS score FROM z")
WEIGHTS, DIRECTIONS = {"mom4": 0.5, "volr": 0.3, "amp": 0.2}, {"volr": -1}


@query("winsorized_zscores", "E20", _sql("SELECT ts_code, trade_date, " + ", ".join(f"{sq(f)} AS {f}" for f in FACTORS) + " FROM z", **_MAD))
def winsorized_zscores(t):
    df = factor_panel(t).select(*KEYS, *FACTORS)
    return rounded(X.zscore(X.winsorize_mad(df, FACTORS), FACTORS), KEYS, FACTORS)


def scored(t):
    return X.composite_score(factor_panel(t).select(*KEYS, *FACTORS), WEIGHTS, DIRECTIONS)


@query("composite_score", "H6", _sql(f"SELECT ts_code, trade_date, {sq('score')} AS score FROM scored", **_MAD))
def composite_score(t):
    return rounded(scored(t), KEYS, ["score"])


@query("top_per_date", "H5", _sql("""SELECT ts_code, trade_date, place FROM (SELECT ts_code, trade_date,
  row_number() OVER (PARTITION BY trade_date ORDER BY amp DESC NULLS LAST, ts_code) AS place FROM factors) WHERE place <= 5"""))
def top_per_date(t):
    return X.top_per_date(factor_panel(t), "amp", 5).select(*KEYS, "place")


@query("industry_neutral_selection", "H7 H8 D15", _sql("""SELECT ts_code, trade_date, industry, place FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY share DESC, industry, n) AS place FROM (
   SELECT *, row_number() OVER (PARTITION BY trade_date, industry ORDER BY amp DESC, ts_code) AS n FROM (
    SELECT f.ts_code, trade_date, industry, amp, cap, count(*) OVER (PARTITION BY trade_date, industry) / count(*) OVER (PARTITION BY trade_date) AS share
    FROM factors f JOIN stock_info USING (ts_code)))
  WHERE n <= greatest(1, floor(share * 30))) WHERE place <= 30 AND cap > 0""", "bars_s stock_info"))
def industry_neutral_selection(t):
    """Thirty names spread over industries by size, then one cap group kept."""
    info = t.stock_info().select("ts_code", "industry", "cap")
    df = factor_panel(t).join(small(info), "ts_code")
    return X.industry_neutral(df, "amp", 30).filter("cap > 0").select(*KEYS, "industry", "place")


@query("cross_section_ranks", "E21", _sql("""SELECT ts_code, trade_date, ordinal, CAST(rnk + (ties - 1) / 2.0 AS DOUBLE) AS average_rank FROM (
  SELECT ts_code, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY vol, ts_code) AS ordinal,
  rank() OVER (PARTITION BY trade_date ORDER BY vol) AS rnk, count(*) OVER (PARTITION BY trade_date, vol) AS ties FROM factors)"""))
def cross_section_ranks(t):
    return X.place_and_rank(t.bars_s().select(*KEYS, "vol"), "vol").select(*KEYS, F.col("ordinal").cast("long").alias("ordinal"), "average_rank")


@query("quantile_buckets", "E22", _sql("""SELECT ts_code, trade_date, CAST(1 + (amp > e[1])::INT + (amp > e[2])::INT + (amp > e[3])::INT + (amp > e[4])::INT AS INT) AS quantile
  FROM factors JOIN (SELECT trade_date, quantile_cont(amp, [0.2, 0.4, 0.6, 0.8]) AS e FROM factors GROUP BY 1) USING (trade_date)"""))
def quantile_buckets(t):
    return X.quantile_buckets(factor_panel(t), "amp", 5).select(*KEYS, "quantile")


@query("daily_ic", "I5 C1", _sql(f"""SELECT trade_date, {sq('c')} AS ic, n AS sample_size FROM (
  SELECT trade_date, corr(mom4, future_return) AS c, count(*) AS n FROM fut WHERE mom4 IS NOT NULL AND future_return IS NOT NULL
  GROUP BY trade_date) WHERE n >= 10"""))
def daily_ic(t):
    return X.daily_ic(with_future(t), "mom4").select("trade_date", snap("ic").alias("ic"), "sample_size")


_RANKED = """SELECT trade_date, ts_code, rank() OVER (PARTITION BY trade_date ORDER BY mom4) + (count(*) OVER (PARTITION BY trade_date, mom4) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY trade_date ORDER BY future_return) + (count(*) OVER (PARTITION BY trade_date, future_return) - 1) / 2.0 AS y
  FROM fut WHERE mom4 IS NOT NULL AND future_return IS NOT NULL"""
_NU, _COS2, _SIN = "(n - 2)", "(1 - c * c)", "abs(c)"  # sin of the angle is |r|
_P = f"""CASE WHEN {_NU} % 2 = 0 THEN 1 - {_SIN} * list_sum(list_transform(range(0, {_NU} // 2), lambda j:
   exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow({_COS2}, j)))
  ELSE 1 - 2 / pi() * (asin({_SIN}) + {_SIN} * list_sum(list_transform(range(0, ({_NU} - 1) // 2), lambda j:
   exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow({_COS2}, j + 0.5)))) END"""


@query("daily_rank_ic", "I5", _sql(f"""SELECT trade_date, {sq('c')} AS ic, n AS sample_size, {sq(_P)} AS p_value FROM (
  SELECT trade_date, corr(x, y) AS c, count(*) AS n FROM ranked GROUP BY 1) WHERE n >= 10""", ranked=_RANKED))
def daily_rank_ic(t):
    ic = X.daily_ic(with_future(t), "mom4", method="spearman")
    return ic.select("trade_date", snap("ic").alias("ic"), "sample_size", snap("p_value").alias("p_value"))


_IC = "SELECT trade_date, corr(mom4, future_return) AS ic FROM fut WHERE mom4 IS NOT NULL AND future_return IS NOT NULL GROUP BY 1 HAVING count(*) >= 10"
_STATS = """avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / stddev_samp(ic) AS ic_ir,
  avg((ic > 0)::INT) AS ic_positive_ratio, avg((ic > 0.02)::INT) AS ic_positive_ratio_significant"""
_STAT_COLUMNS = ["ic_mean", "ic_std", "ic_ir", "ic_positive_ratio", "ic_positive_ratio_significant"]


@query("ic_statistics", "I6", _sql("SELECT " + ", ".join(f"{sq(c)} AS {c}" for c in _STAT_COLUMNS) + f" FROM (SELECT {_STATS} FROM ic)", ic=_IC))
def ic_statistics(t):
    return rounded(X.ic_statistics(X.daily_ic(with_future(t), "mom4")), [], _STAT_COLUMNS)


@query("ic_by_month", "D8", _sql("SELECT year(trade_date) AS year, " + ", ".join(f"{sq(f'avg(ic) FILTER (month(trade_date) = {m})')} AS m{m}" for m in range(1, 13)) + " FROM (SELECT trade_date, CASE WHEN NOT isnan(ic) THEN ic END AS ic FROM ic) GROUP BY 1", ic=_IC))
def ic_by_month(t):
    out = X.ic_by_month(X.daily_ic(with_future(t), "mom4"))
    return out.select(F.col("year").cast("long").alias("year"), *[snap(str(m)).alias(f"m{m}") for m in range(1, 13)])


_Q = dict(edges="SELECT trade_date, quantile_cont(amp, [0.2, 0.4, 0.6, 0.8]) AS e FROM fut WHERE amp IS NOT NULL AND future_return IS NOT NULL GROUP BY 1 HAVING count(*) >= 50",
          placed="""SELECT trade_date, future_return AS r, 1 + (amp > e[1])::INT + (amp > e[2])::INT + (amp > e[3])::INT + (amp > e[4])::INT AS q
          FROM fut JOIN edges USING (trade_date) WHERE amp IS NOT NULL AND future_return IS NOT NULL""",
          wide="SELECT trade_date, " + ", ".join(f"avg(r) FILTER (q = {i}) AS Q{i}" for i in range(1, 6)) + " FROM placed GROUP BY 1")
_QS = ["Q1", "Q2", "Q3", "Q4", "Q5"]


@query("quantile_returns", "I7", _sql("SELECT trade_date, " + ", ".join(f"{sq(c)} AS {c}" for c in _QS) + f", {sq('Q5 - Q1')} AS long_short FROM wide", **_Q))
def quantile_returns(t):
    return rounded(X.quantile_returns(with_future(t), "amp"), ["trade_date"], [*_QS, "long_short"])


@query("quantile_curves", "I8", _sql("SELECT trade_date, " + ", ".join(
    f"{sq(f'sum(ln(1 + coalesce({c}, 0))) OVER (ORDER BY trade_date)')} AS {c}" for c in _QS) + " FROM wide", **_Q))
def quantile_curves(t):
    """Compounded quantile curves, as logarithms of the growth."""
    return rounded(X.cumulative_curves(X.quantile_returns(with_future(t), "amp"), _QS, log=True), ["trade_date"], _QS)


@query("factor_turnover", "E24 I9", _sql(f"""SELECT trade_date, {sq('CASE WHEN prev IS NULL THEN 1 ELSE 1 - len(list_intersect(names, prev)) / 20 END')} AS turnover,
  CAST(len(names) AS BIGINT) AS stock_count FROM (SELECT *, lag(names) OVER (ORDER BY trade_date) AS prev FROM (
   SELECT trade_date, list(ts_code) AS names FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amp DESC, ts_code) AS n FROM factors) WHERE n <= 20 GROUP BY 1))"""))
def factor_turnover(t):
    return X.factor_turnover(factor_panel(t), "amp", 20).select("trade_date", snap("turnover").alias("turnover"), "stock_count")


@query("factor_autocorrelation", "E23 I10", _sql(f"""SELECT ts_code, {sq('c')} AS autocorr FROM (SELECT ts_code, corr(amp, old) AS c, count(*) AS n FROM
  (SELECT *, {ref('amp')} AS old FROM factors) GROUP BY 1) WHERE n >= 11"""))
def factor_autocorrelation(t):
    return rounded(X.factor_autocorrelation(factor_panel(t), "amp"), ["ts_code"], ["autocorr"])


@query("factor_correlation", "D19", _sql(" UNION ALL ".join(
    f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, {sq(f'corr({a}, {b})')} AS corr FROM factors" for a in FACTORS for b in FACTORS)))
def factor_correlation(t):
    return rounded(X.factor_correlation(factor_panel(t), FACTORS), ["factor_a", "factor_b"], ["corr"])


_REPORT = dict(
    grid=" UNION ALL ".join(f"SELECT '{f}' AS factor, CAST({p} AS INT) AS period, trade_date, {f} AS v, {lead('ret', p)} AS r FROM factors" for f in FACTORS for p in (1, 5)),
    ic="SELECT factor, period, trade_date, CASE WHEN isnan(corr(v, r)) THEN NULL ELSE corr(v, r) END AS ic FROM grid WHERE v IS NOT NULL AND r IS NOT NULL GROUP BY ALL HAVING count(*) >= 10",
    st=f"SELECT factor, period, {_STATS} FROM ic GROUP BY ALL",
    near="SELECT factor, trade_date, v, r FROM grid WHERE period = 1 AND v IS NOT NULL AND r IS NOT NULL",
    sorted="SELECT factor, trade_date, list(v ORDER BY v) AS s, count(*) - 1 AS n FROM near GROUP BY 1, 2 HAVING count(*) >= 50",
    # interpolated by hand: among equal values an edge is that value, whatever the weights
    edges="SELECT factor, trade_date, list_transform([0.2::DOUBLE, 0.4, 0.6, 0.8], lambda p: s[floor(n * p)::INT + 1] + (n * p - floor(n * p)) * (s[ceil(n * p)::INT + 1] - s[floor(n * p)::INT + 1])) AS e FROM sorted",
    placed="SELECT factor, trade_date, r, 1 + (v > e[1])::INT + (v > e[2])::INT + (v > e[3])::INT + (v > e[4])::INT AS q FROM near JOIN edges USING (factor, trade_date)",
    wide="SELECT *, Q5 - Q1 AS long_short FROM (SELECT factor, trade_date, " + ", ".join(f"avg(r) FILTER (q = {i}) AS Q{i}" for i in range(1, 6)) + " FROM placed GROUP BY ALL)",
    rows=" UNION ALL ".join(
        [f"SELECT 'ic' AS part, factor, period, '{c}' AS name, {c} AS value FROM st" for c in _STAT_COLUMNS]
        + [f"SELECT 'quantile', factor, CAST(1 AS INT), '{c}', avg({c}) FROM wide GROUP BY factor" for c in [*_QS, "long_short"]]
        + [f"SELECT 'correlation', '{a}', CAST(NULL AS INT), '{b}', corr({a}, {b}) FROM factors" for a in FACTORS for b in FACTORS]))


@query("factor_report", "I11", _sql(f"SELECT part, factor, period, name, {sq('value')} AS value FROM rows", **_REPORT))
def factor_report(t):
    return rounded(X.factor_report(factor_panel(t), FACTORS, [1, 5]), ["part", "factor", "period", "name"], ["value"])


_HELD = f"SELECT DISTINCT ts_code, trade_date FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amp DESC, ts_code) AS n FROM factors) WHERE n <= 20"


@query("factor_exposure", "C15 I15 D20", _sql("SELECT trade_date, factor, " + ", ".join(f"{sq(c)} AS {c}" for c in ("exposure", "weight", "attribution")) + " FROM (" + " UNION ALL ".join(
    f"SELECT trade_date, '{f}' AS factor, avg({f}) AS exposure, {w} AS weight, avg({f}) * {w} AS attribution FROM factors SEMI JOIN held USING (ts_code, trade_date) GROUP BY 1" for f, w in WEIGHTS.items()) + ")", held=_HELD))
def factor_exposure(t):
    df = factor_panel(t)
    held = X.exposure(X.top_per_date(df, "amp", 20), df, FACTORS)
    return rounded(X.weighted_exposure(held, WEIGHTS), ["trade_date", "factor"], ["exposure", "weight", "attribution"])


# -- signals and what followed ----------------------------------------------

def signal(t):
    """A plain reversal signal: minus the four-week momentum."""
    return factor_panel(t).withColumn("signal", -F.col("mom4"))


_SIG = {**_F, "sig": "SELECT * EXCLUDE (ret), -mom4 AS signal FROM factors"}
_H = (3, 5, 10)


@query("forward_returns", "I1", with_views("bars_s", f"SELECT ts_code, trade_date, " + ", ".join(
    f"{sq(lead('close', h) + ' / close - 1')} AS ret_t{h}" for h in _H) + " FROM bars_s"))
def forward_returns(t):
    return rounded(X.forward_returns(t.bars_s(), list(_H)), KEYS, [f"ret_t{h}" for h in _H])


_LONG = dict(long=" UNION ALL ".join(f"SELECT {h} AS horizon, ts_code, trade_date, signal, {lead('close', h)} / close - 1 AS ret FROM sig" for h in _H),
             valid="SELECT * FROM long WHERE signal IS NOT NULL AND ret IS NOT NULL")
_SHARPE = "avg(x) / stddev_samp(x) * sqrt(252)"


def _terciles(keys, src="valid"):
    return dict(cuts=f"SELECT {keys}, quantile_cont(signal, 0.33) AS p33, quantile_cont(signal, 0.67) AS p67 FROM {src} GROUP BY ALL",
                rows=f"SELECT * FROM {src} JOIN cuts USING ({keys})",
                legs=f"SELECT {keys}, ret AS x FROM rows WHERE signal >= p67 UNION ALL SELECT {keys}, -ret FROM rows WHERE signal <= p33")


@query("pooled_metrics", "I2 I4", with_views("bars_s", f"""SELECT CAST(horizon AS INT) AS horizon, n_pairs, {sq('sharpe')} AS sharpe, {sq('win_rate')} AS win_rate, {sq('mean_ret')} AS mean_ret,
  {sq('ic')} AS ic, (SELECT count(signal) FROM sig) AS n_obs, {sq('(SELECT count(signal) / count(*) FROM sig)')} AS coverage
  FROM (SELECT horizon, count(*) AS n_pairs, avg((sign(signal) = sign(ret))::INT) FILTER (signal <> 0) AS win_rate, avg(ret) FILTER (signal >= p67) AS mean_ret FROM rows GROUP BY 1)
  JOIN (SELECT horizon, {_SHARPE} AS sharpe FROM legs GROUP BY 1) USING (horizon)
  JOIN (SELECT horizon, corr(a, b) AS ic FROM (SELECT horizon, rank() OVER (PARTITION BY horizon ORDER BY signal) + (count(*) OVER (PARTITION BY horizon, signal) - 1) / 2.0 AS a,
        rank() OVER (PARTITION BY horizon ORDER BY ret) + (count(*) OVER (PARTITION BY horizon, ret) - 1) / 2.0 AS b FROM valid) GROUP BY 1) USING (horizon)""",
    **_SIG, **_LONG, **_terciles("horizon")))
def pooled_metrics(t):
    out = E.pooled_metrics(signal(t), list(_H))
    return rounded(out, ["horizon", "n_pairs", "n_obs"], ["sharpe", "win_rate", "mean_ret", "ic", "coverage"])


_PORT = dict(
    dates="SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS d, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM sig)",
    best="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY signal DESC, ts_code) AS place, count(*) OVER (PARTITION BY trade_date) AS names
            FROM sig JOIN dates USING (trade_date) WHERE signal IS NOT NULL AND d <= n - 5) WHERE names >= 5 AND place <= greatest(1, floor(names * 0.1))""",
    port="""SELECT b.trade_date, avg(f.close / b.close - 1) AS ret, count(f.close) AS n_held FROM best b JOIN dates e ON e.d = b.d + 5
            LEFT JOIN sig f ON f.ts_code = b.ts_code AND f.trade_date = e.trade_date GROUP BY 1 HAVING count(f.close) > 0""")


@query("top_share_portfolio", "I3", with_views("bars_s", f"SELECT trade_date, {sq('ret')} AS ret, n_held FROM port", **_SIG, **_PORT))
def top_share_portfolio(t):
    return rounded(E.top_share_portfolio(signal(t)), ["trade_date", "n_held"], ["ret"])


@query("portfolio_summary", "I3 D7", with_views("bars_s", f"""SELECT {sq('sum(l)')} AS log_return, count(*) AS n_days, {sq('avg(ret) / stddev_samp(ret) * sqrt(252)')} AS sharpe_ratio,
  {sq('min(exp(c - p) - 1)')} AS max_drawdown, {sq('avg((ret > 0)::INT)')} AS win_rate, {sq('sum(l) * 252 / count(*)')} AS annual_log_return
  FROM (SELECT *, max(c) OVER (ORDER BY trade_date) AS p FROM (SELECT *, ln(1 + ret) AS l, sum(ln(1 + ret)) OVER (ORDER BY trade_date) AS c FROM small))""",
    **_SIG, **_PORT, small="SELECT trade_date, ret FROM port"))
def portfolio_summary(t):
    out = E.portfolio_summary(E.top_share_portfolio(signal(t)))
    return rounded(out, ["n_days"], ["log_return", "sharpe_ratio", "max_drawdown", "win_rate", "annual_log_return"])


@query("quarterly_returns", "D7 I3", with_views("bars_s", f"SELECT CAST(date_trunc('quarter', trade_date) AS DATE) AS period, {sq(slog('(product(1 + ret) - 1)'))} AS ret, count(*) AS n FROM port GROUP BY 1", **_SIG, **_PORT))
def quarterly_returns(t):
    out = E.period_returns(E.top_share_portfolio(signal(t)), "quarter")
    return out.select("period", "n", snap(signed_log("ret")).alias("ret"))


@query("cap_group_sharpe", "I14 B17", with_views("bars_s daily_basic", f"SELECT cap_group, {sq(_SHARPE)} AS sharpe FROM legs GROUP BY 1", **_SIG,
    caps="SELECT ts_code, median(total_mv / 30) AS cap FROM daily_basic GROUP BY 1",
    valid=f"""SELECT * FROM (SELECT s.*, {lead('close', 5)} / close - 1 AS ret FROM sig s) JOIN (SELECT ts_code, CASE WHEN cap <= 20 THEN 'small' WHEN cap <= 200 THEN 'mid' ELSE 'large' END AS cap_group FROM caps) USING (ts_code)
    WHERE signal <> 0 AND ret IS NOT NULL""", **_terciles("cap_group")))
def cap_group_sharpe(t):
    caps = t.daily_basic().select("ts_code", (F.col("total_mv") / 30).alias("cap"))
    return rounded(E.cap_group_sharpe(signal(t), caps, 5), ["cap_group"], ["sharpe"])


def _events(horizons):
    return " UNION ALL ".join(f"SELECT {h} AS horizon, ts_code, trade_date, ret FROM (SELECT *, {lead('close', h)} / close - 1 AS ret FROM ev) WHERE abs(event) > 0 AND ret IS NOT NULL" for h in horizons)


_EV = {**_SIG, "ev": "SELECT *, CASE WHEN signal > 0.5 THEN signal ELSE 0 END AS event FROM sig"}


def event_panel(t):
    return signal(t).withColumn("event", F.when(F.col("signal") > 0.5, F.col("signal")).otherwise(0.0))


_EVENT_SQL = f"""SELECT CAST(horizon AS INT) AS horizon, count(*) AS n, {sq('avg(ret)')} AS mean, {sq('median(ret)')} AS median, {sq('avg((ret > 0)::INT)')} AS win_rate,
  {sq('max(ret)')} AS max, {sq('min(ret)')} AS min, {sq('stddev_samp(ret)')} AS std, {sq('avg(ret) / stddev_samp(ret) * sqrt(252)')} AS sharpe,
  {sq('avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(252)')} AS sortino, {sq('sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0)')} AS profit_factor,
  {sq('exp(min(c - p)) - 1')} AS max_drawdown FROM (SELECT *, max(c) OVER (PARTITION BY horizon ORDER BY ts_code, trade_date) AS p FROM (
    SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY horizon ORDER BY ts_code, trade_date) AS c FROM e)) GROUP BY 1"""
_EVENT_VALUES = ["mean", "median", "win_rate", "max", "min", "std", "sharpe", "sortino", "profit_factor", "max_drawdown"]


@query("event_statistics", "D5 I13", with_views("bars_s", _EVENT_SQL, **_EV, e=_events((1, 3, 5, 10, 20))))
def event_statistics(t):
    out = E.horizon_statistics(E.event_returns(event_panel(t), [1, 3, 5, 10, 20], "event"))
    return rounded(out, ["horizon", "n"], _EVENT_VALUES)


@query("holding_curve", "I13", with_views("bars_s", _EVENT_SQL, **_EV, e=_events(range(1, 21))))
def holding_curve(t):
    return rounded(E.holding_curve(event_panel(t), 20, "event"), ["horizon", "n"], _EVENT_VALUES)


@query("recent_signal_events", "I12 H2", with_views("bars_s", f"""SELECT ts_code, trade_date, {sq('event')} AS strength, {sq('r1')} AS t1, {sq('r5')} AS t5 FROM (
  SELECT *, {lead('close', 1)} / close - 1 AS r1, {lead('close', 5)} / close - 1 AS r5 FROM ev) WHERE abs(event) > 0 ORDER BY trade_date DESC, ts_code LIMIT 500""", **_EV))
def recent_signal_events(t):
    ev = E.signal_events(event_panel(t), [1, 5], "event", limit=500)
    return ev.select(*KEYS, snap("strength").alias("strength"), snap(F.col("returns")["t1"]).alias("t1"), snap(F.col("returns")["t5"]).alias("t5"))


_TRIAL = dict(trials="""SELECT ts_code AS trial, avg(amp) FILTER (trade_date < DATE '1999-01-01') AS search_sharpe,
  avg(amp) FILTER (trade_date >= DATE '1999-01-01') AS holdout_sharpe, count(*) FILTER (trade_date >= DATE '1999-01-01') AS holdout_signals FROM factors GROUP BY 1""")


@query("holdout_gate", "I16", _sql(f"""SELECT trial, {sq('search_sharpe')} AS search_sharpe, {sq('holdout_sharpe')} AS holdout_sharpe, holdout_signals FROM trials
  WHERE holdout_signals >= 15 AND holdout_sharpe > 0 AND search_sharpe / holdout_sharpe < 5 ORDER BY coalesce(holdout_sharpe, search_sharpe) DESC, trial DESC LIMIT 1""", **_TRIAL))
def holdout_gate(t):
    late = F.col("trade_date") >= "1999-01-01"
    trials = factor_panel(t).groupBy(F.col("ts_code").alias("trial")).agg(
        F.avg(F.when(~late, F.col("amp"))).alias("search_sharpe"), F.avg(F.when(late, F.col("amp"))).alias("holdout_sharpe"),
        F.sum(late.cast("int")).alias("holdout_signals"))
    best = E.best_trial(E.holdout_gate(trials))
    return rounded(best, ["trial", "holdout_signals"], ["search_sharpe", "holdout_sharpe"])


@query("signal_contract", "I17", with_views("bars_s", "SELECT count(*) AS rows, count(*) AS wanted_rows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, true AS valid FROM bars_s"))
def signal_contract(t):
    return E.check_signal(t.bars_s().select(*KEYS), signal(t).select(*KEYS, "signal"))


# -- splits and sweeps -------------------------------------------------------

SPLITS = {"train": ("1995-01-01", "1997-12-31"), "valid": ("1998-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}


@query("named_splits", "A9", with_views("bars_s", """SELECT split, ts_code, count(*) AS n FROM bars_s JOIN (VALUES ('train', DATE '1995-01-01', DATE '1997-12-31'),
  ('valid', DATE '1998-01-01', DATE '1999-12-31'), ('test', DATE '2000-01-01', DATE '2001-12-31')) s(split, a, b) ON trade_date BETWEEN a AND b GROUP BY ALL"""))
def named_splits(t):
    return J.assign_split(t.bars_s(), J.named_splits(t.spark, SPLITS)).groupBy("split", "ts_code").agg(F.count(F.lit(1)).alias("n"))


_FOLDS = dict(folded="""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ts_code, fold) AS rows_in FROM sig JOIN (
  SELECT trade_date, CAST(least((row_number() OVER (ORDER BY trade_date) - 1) // (count(*) OVER () // 4), 3) AS INT) AS fold FROM (SELECT DISTINCT trade_date FROM sig)) USING (trade_date)) WHERE rows_in >= 40""")


@query("date_folds", "J1", with_views("bars_s", "SELECT fold, count(*) AS n, min(trade_date) AS first, max(trade_date) AS last, count(DISTINCT ts_code) AS codes FROM folded GROUP BY 1", **_SIG, **_FOLDS))
def date_folds(t):
    return J.date_folds(signal(t), 4, min_rows=40).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.countDistinct("ts_code").alias("codes"))


_GRID = "(VALUES (0.1), (0.3), (0.5)) g(threshold)"


@query("cross_validated_sweep", "J2 J4 J6 C17 B18", with_views("bars_s", f"""SELECT CAST(threshold AS DOUBLE) AS threshold, {sq('score')} AS score_uncapped, n_folds, {sq('CASE WHEN score > 3 THEN 3 + (score - 3) * 0.1 ELSE score END')} AS score FROM (
  SELECT threshold, avg(sharpe) AS score, count(*) AS n_folds FROM (SELECT threshold, fold, {_SHARPE} AS sharpe FROM legs GROUP BY ALL)
  JOIN (SELECT threshold, fold, count(*) AS n_signals FROM folded, {_GRID} WHERE signal >= threshold AND abs(signal) > 0 GROUP BY ALL) USING (threshold, fold)
  JOIN (SELECT threshold, fold, count(*) AS n_pairs FROM valid GROUP BY ALL) USING (threshold, fold)
  WHERE n_signals >= 80 AND n_pairs >= 30 GROUP BY 1 HAVING count(*) >= 2)""", **_SIG, **_FOLDS,
    leads="SELECT *, lead(close, 5) OVER (PARTITION BY ts_code, fold ORDER BY trade_date) / close - 1 AS ret FROM folded",
    valid=f"SELECT * FROM leads, {_GRID} WHERE signal >= threshold AND ret IS NOT NULL",
    **_terciles("threshold, fold")))
def cross_validated_sweep(t):
    grid = J.parameter_grid(t.spark, {"threshold": [0.1, 0.3, 0.5]})
    panel = J.date_folds(signal(t), 4, min_rows=40).withColumnRenamed("signal", "score")
    return rounded(J.sweep_thresholds(panel, grid, 5), ["threshold", "n_folds"], ["score_uncapped", "score"])


@query("sweep_summary", "J5", with_views("bars_s", f"""SELECT CAST(threshold AS DOUBLE) AS threshold, n AS total_trades, {sq('m')} AS avg_return, {sq('s')} AS sharpe_ratio, {sq('w')} AS win_rate,
  m = max(m) OVER () AS is_best FROM (SELECT threshold, count(*) AS n, avg(ret) AS m, avg(ret) / stddev_samp(ret) * sqrt(252) AS s, avg((ret > 0)::INT) AS w
  FROM (SELECT *, {lead('close', 5)} / close - 1 AS ret FROM sig), {_GRID} WHERE signal >= threshold AND ret IS NOT NULL GROUP BY 1)""", **_SIG))
def sweep_summary(t):
    grid = J.parameter_grid(t.spark, {"threshold": [0.1, 0.3, 0.5]})
    out = J.sweep_summary(signal(t).withColumnRenamed("signal", "score"), grid, 5)
    return rounded(out, ["threshold", "total_trades", "is_best"], ["avg_return", "sharpe_ratio", "win_rate"])


@query("walk_forward", "J3", with_views("bars_s", f"""SELECT window_no, train_start, cut, test_end, {sq('a')} AS train_return, {sq('b')} AS test_return, {sq('CASE WHEN a = 0 THEN 0 ELSE (b - a) / a END')} AS decay_rate FROM (
  SELECT CAST(w AS INT) AS window_no, train_start, cut, test_end, coalesce(avg(ret) FILTER (trade_date < cut), 0) AS a, coalesce(avg(ret) FILTER (trade_date >= cut), 0) AS b FROM wins
  JOIN (SELECT * FROM (SELECT *, {lead('close', 5)} / close - 1 AS ret FROM ev) WHERE event > 0 AND ret IS NOT NULL) e ON e.trade_date >= train_start AND e.trade_date < test_end GROUP BY ALL)""", **_EV,
    span="SELECT min(trade_date) AS s, max(trade_date) AS e FROM sig",
    wins="""SELECT w, CAST(s + to_months(CAST(6 + w * 3 AS INT)) - INTERVAL 6 MONTH AS DATE) AS train_start, CAST(s + to_months(CAST(6 + w * 3 AS INT)) AS DATE) AS cut,
    CAST(s + to_months(CAST(6 + w * 3 AS INT)) + INTERVAL 3 MONTH AS DATE) AS test_end FROM (SELECT s, unnest(range(0, ((year(e) - year(s)) * 12 + month(e) - month(s)) // 9)) AS w FROM span)"""))
def walk_forward(t):
    panel = event_panel(t)
    events = E.event_returns(panel, [5], "event").filter(F.col("ret").isNotNull())
    span = t.bars_s().agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end"))
    out = J.walk_forward(events, J.walk_forward_windows(span))
    return rounded(out, ["window_no", "train_start", "cut", "test_end"], ["train_return", "test_return", "decay_rate"])


# -- the flagship: a setup and what followed -----------------------------------

@query("pullback_signals", "F5 F6 F8 F9 G2 I1 I2", with_views("bars_w", f"""SELECT ts_code, count(*) AS n_signals, {sq('avg(ret)')} AS mean_ret, {sq('avg((ret > 0)::INT)')} AS win_rate, max(trade_date) AS last_signal FROM (
  SELECT ts_code, trade_date, fast, slow, j, dif, {lead('close', 5)} / close - 1 AS ret FROM ind) WHERE fast > slow AND j < 13 AND dif >= 0 GROUP BY 1""",
    **__import__("candlewick.plans.rule_queries", fromlist=["_upto"])._upto("ind")))
def pullback_signals(t):
    """Bars above both trend lines with a low J: count and five-bar outcome per code."""
    from candlewick.operators.indicators import kdj, macd, trend_fast, trend_slow
    df = trend_slow(trend_fast(kdj(macd(t.bars_w()))))
    df = X.forward_returns(df, [5])
    setup = (F.col("trend_fast") > F.col("trend_slow")) & (F.col("j") < 13) & (F.col("dif") >= 0)
    return (df.filter(setup).groupBy("ts_code").agg(
        F.count(F.lit(1)).alias("n_signals"), snap(F.avg("ret_t5")).alias("mean_ret"),
        snap(F.avg((F.col("ret_t5") > 0).cast("int"))).alias("win_rate"), F.max("trade_date").alias("last_signal")))
