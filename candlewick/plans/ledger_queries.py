"""Position ledger, equity curves and performance reports."""

from pyspark.sql import Window, functions as F

from candlewick.functions import money as M
from candlewick.functions.series import ratio
from candlewick.operators import asof, ledger as L, reports as R
from candlewick.plans.oracle_views import cents, signed_log as slog, snap as sq, with_views
from candlewick.plans.registry import query
from candlewick.plans.shaping import rounded, signed_log, snap
from candlewick.session import small
from candlewick.sources.tables import week_start

CAPITAL = 500_000.0
_SOLD = dict(sold="SELECT *, datediff('day', buy_date, sell_date) AS days FROM positions WHERE status = 'sold'")
_BUY = "SELECT *, cost / nullif(shares, 0) AS buy_price FROM positions"


def held(t):
    return t.positions().withColumn("buy_price", ratio("cost", "shares"))


def _perf(key, extra="", days=True, codes=True):
    return (f"count(*) AS trade_count, count(*) FILTER (profit_loss > 0) AS win_count, {sq('count(*) FILTER (profit_loss > 0) * 100 / count(*)')} AS win_rate, "
            f"{sq('sum(profit_loss)', 1)} AS total_profit, {sq('avg(profit_loss)', 2)} AS avg_profit"
            + (", count(DISTINCT code) AS stock_count" if codes else "") + (f", {sq('avg(days)')} AS avg_holding_days" if days else ""))


def _shape(df, keys, days=True, codes=True):
    cols = [*keys, "trade_count", "win_count", snap("win_rate").alias("win_rate"), snap("total_profit", 1).alias("total_profit"), snap("avg_profit", 2).alias("avg_profit")]
    return df.select(*cols, *(["stock_count"] if codes else []), *([snap("avg_holding_days").alias("avg_holding_days")] if days else []))


@query("performance_by_strategy", "D1 D2", with_views("positions", f"SELECT strategy, {_perf('strategy')} FROM sold GROUP BY 1", **_SOLD))
def performance_by_strategy(t):
    return _shape(R.group_performance(R.sold(t.positions()), ["strategy"]), ["strategy"])


@query("performance_by_industry", "D1 C2", with_views("positions", f"SELECT coalesce(c_mktsegment, 'unknown') AS industry, {_perf('industry')} FROM sold LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS code, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer) USING (code) GROUP BY 1", **_SOLD))
def performance_by_industry(t):
    """One segment stands for customers whose industry is not known."""
    info = t.customer.select(F.col("c_custkey").cast("string").alias("code"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("industry"))
    df = R.sold(t.positions()).join(small(info), "code", "left").fillna("unknown", ["industry"])
    return _shape(R.group_performance(df, ["industry"]), ["industry"])


@query("performance_by_month", "D2", with_views("positions", f"SELECT strftime(sell_date, '%Y-%m') AS month, {_perf('month', days=False, codes=False)} FROM sold WHERE sell_date IS NOT NULL GROUP BY 1", **_SOLD))
def performance_by_month(t):
    return _shape(R.by_month(R.sold(t.positions())), ["month"], False, False)


_BUCKETS = "(VALUES ('small'), ('mid'), ('large'), ('xlarge')) g(cap_group)"


@query("performance_by_cap", "D2 C3 B17", with_views("positions bars_w", f"""SELECT cap_group, coalesce(trade_count, 0) AS trade_count, coalesce(win_count, 0) AS win_count, coalesce(win_rate, 0) AS win_rate,
  coalesce(total_profit, 0) AS total_profit, coalesce(avg_profit, 0) AS avg_profit FROM {_BUCKETS} LEFT JOIN (
  SELECT CASE WHEN mv < 5e9 THEN 'small' WHEN mv < 20e9 THEN 'mid' WHEN mv < 100e9 THEN 'large' ELSE 'xlarge' END AS cap_group, {_perf('', days=False, codes=False)}
  FROM (SELECT s.*, amount * 10000 AS mv FROM sold s JOIN bars_w b ON b.ts_code = s.ts_code AND b.trade_date = CAST(date_trunc('week', buy_date) AS DATE)) GROUP BY 1) USING (cap_group)""", **_SOLD))
def performance_by_cap(t):
    """Capitalisation is the code's traded amount in the week of the purchase."""
    caps = t.bars_w().select("ts_code", F.col("trade_date").alias("week"), (F.col("amount") * 10000).alias("mv"))
    df = R.sold(t.positions()).withColumn("week", week_start(F.col("buy_date"))).join(small(caps), ["ts_code", "week"], "left")
    return _shape(R.by_cap_group(df, "mv"), ["cap_group"], False, False)


@query("holding_distribution", "D2 B17", with_views("positions", """SELECT bucket, coalesce(n, 0) AS n FROM (VALUES ('0-5'), ('6-10'), ('11-20'), ('21-30'), ('30+')) g(bucket) LEFT JOIN (
  SELECT CASE WHEN days <= 5 THEN '0-5' WHEN days <= 10 THEN '6-10' WHEN days <= 20 THEN '11-20' WHEN days <= 30 THEN '21-30' ELSE '30+' END AS bucket, count(*) AS n FROM sold WHERE days IS NOT NULL GROUP BY 1) USING (bucket)""", **_SOLD))
def holding_distribution(t):
    return R.holding_distribution(R.sold(t.positions()))


_TS = ["total_profit", "avg_profit", "avg_loss", "best_trade", "worst_trade", "avg_holding_days", "win_rate", "profit_loss_ratio", "expectancy", "expectancy_r"]


@query("trade_summary", "D3", with_views("positions", "SELECT total_trades, win_count, " + ", ".join(f"{sq(c, 1)} AS {c}" for c in _TS) + """ FROM (SELECT *, win_count * 100 / total_trades AS win_rate, avg_profit / avg_loss AS profit_loss_ratio,
  total_profit / total_trades AS expectancy, win_count / total_trades * avg_profit / 15000 - (1 - win_count / total_trades) AS expectancy_r FROM (
  SELECT count(*) AS total_trades, count(*) FILTER (profit_loss > 0) AS win_count, sum(profit_loss) AS total_profit, avg(profit_loss) FILTER (profit_loss > 0) AS avg_profit,
  abs(avg(profit_loss) FILTER (profit_loss <= 0)) AS avg_loss, max(profit_loss) AS best_trade, min(profit_loss) AS worst_trade, avg(days) AS avg_holding_days FROM sold))""", **_SOLD))
def trade_summary(t):
    return rounded(R.trade_summary(R.sold(t.positions()), CAPITAL), ["total_trades", "win_count"], _TS, 1)


@query("holding_summary", "D13", with_views("positions stock_info", f"""SELECT p.strategy, coalesce(i.industry, 'unknown') AS industry, count(*) AS n, {sq('sum(cost)', 1)} AS cost FROM positions p
  LEFT JOIN stock_info i ON i.ts_code = p.code WHERE p.status = 'holding' GROUP BY ALL"""))
def holding_summary(t):
    """The position view (ledger with instrument data), summed over open positions."""
    info = t.stock_info().select(F.col("ts_code").alias("code"), "industry")
    df = t.positions().filter("status = 'holding'").join(small(info), "code", "left").fillna("unknown", ["industry"])
    return df.groupBy("strategy", "industry").agg(F.count(F.lit(1)).alias("n"), snap(F.sum("cost"), 1).alias("cost"))


@query("position_analysis", "C4", with_views("positions stock_info daily_basic", f"""SELECT p.id, s.industry, s.market, {sq('d.total_mv', 2)} AS buy_total_mv, {sq('d.amount', 2)} AS buy_amount FROM positions p
  LEFT JOIN stock_info s ON p.code = s.ts_code LEFT JOIN daily_basic d ON p.code = d.ts_code AND d.trade_date = CAST(date_trunc('week', p.buy_date) AS DATE)"""))
def position_analysis(t):
    """Bars are weekly here: the basics are those of the week of the buy."""
    positions = t.positions().withColumn("buy_week", week_start(F.col("buy_date")))
    out = L.position_analysis(positions, t.stock_info(), t.daily_basic(), "buy_week")
    return out.select("id", "industry", "market", snap("buy_total_mv", 2).alias("buy_total_mv"), snap("buy_amount", 2).alias("buy_amount"))


_LAST = dict(bp=_BUY, last="SELECT ts_code, max_by(close, trade_date) AS last_close FROM bars_w GROUP BY 1",
             val="SELECT p.*, coalesce(last_close, buy_price) AS price FROM bp p LEFT JOIN last USING (ts_code) WHERE status = 'holding'")


@query("valued_holdings", "C12 H1", with_views("positions bars_w", f"SELECT id, {sq('price', 3)} AS current_price, {sq('price * shares', 2)} AS market_value, {sq('(price - buy_price) * shares', 2)} AS float_profit, {sq('(price - buy_price) * 100 / buy_price', 3)} AS float_pct FROM val", **_LAST))
def valued_holdings(t):
    df = R.sorted_by(L.value_holdings(held(t), t.bars_w()), "cost", "desc")
    return df.select("id", snap("current_price", 3).alias("current_price"), *[snap(c, d).alias(c) for c, d in (("market_value", 2), ("float_profit", 2), ("float_pct", 3))])


_AS = ["market_value", "holding_cost", "holding_profit", "history_profit", "total_profit", "cash", "equity"]


@query("account_summary", "D14", with_views("positions bars_w", "SELECT n_holding, n_sold, " + ", ".join(f"{sq(c, 0)} AS {c}" for c in _AS) + """ FROM (SELECT *, holding_profit + history_profit AS total_profit,
  500000 - holding_cost + history_profit AS cash, 500000 - holding_cost + history_profit + market_value AS equity FROM
  (SELECT count(*) AS n_holding, sum(price * shares) AS market_value, sum(buy_price * shares) AS holding_cost, sum((price - buy_price) * shares) AS holding_profit FROM val),
  (SELECT count(*) AS n_sold, sum(profit_loss) AS history_profit FROM positions WHERE status = 'sold'))""", **_LAST))
def account_summary(t):
    return rounded(L.account_summary(held(t), t.bars_w(), CAPITAL), ["n_holding", "n_sold"], _AS, 0)


@query("semi_and_anti_joins", "C10 C11 H13", with_views("positions stock_info", """SELECT 'with_info' AS part, count(*) AS n FROM positions SEMI JOIN stock_info ON stock_info.ts_code = positions.code
  UNION ALL SELECT 'without', count(*) FROM positions ANTI JOIN stock_info ON stock_info.ts_code = positions.code
  UNION ALL SELECT 'both_sides', count(*) FROM (SELECT code FROM positions INTERSECT SELECT ts_code FROM stock_info)
  UNION ALL SELECT 'only_left', count(*) FROM (SELECT code FROM positions EXCEPT SELECT ts_code FROM stock_info)"""))
def semi_and_anti_joins(t):
    p, i = t.positions().select("id", "code"), t.stock_info().select(F.col("ts_code").alias("code"))
    n = F.count(F.lit(1)).alias("n")
    parts = [("with_info", p.join(small(i), "code", "left_semi")), ("without", p.join(small(i), "code", "left_anti")),
             ("both_sides", p.select("code").intersect(i)), ("only_left", p.select("code").subtract(i))]
    out = None
    for name, df in parts:
        row = df.agg(n).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# -- as of, intervals -----------------------------------------------------------


@query("asof_report", "C7", with_views("bars_w quarterly", f"""SELECT b.ts_code, b.trade_date, {sq('q.revenue', 1)} AS revenue, q.n_orders FROM bars_w b ASOF LEFT JOIN quarterly q
  ON b.ts_code = q.ts_code AND b.trade_date >= q.ann_date"""))
def asof_report(t):
    bars = t.bars_w().select("ts_code", "trade_date")
    df = asof.asof_join(bars, t.quarterly(), ["ts_code"], "trade_date", "ann_date", ["revenue", "n_orders"])
    return df.select("ts_code", "trade_date", snap("revenue", 1).alias("revenue"), "n_orders")


@query("price_as_of_day", "C8", with_views("positions bars_w", """SELECT id, CASE WHEN datediff('day', trade_date, date) <= 7 THEN close END AS close FROM (SELECT id, ts_code, buy_date AS date FROM positions) p
  ASOF LEFT JOIN bars_w b ON p.ts_code = b.ts_code AND p.date >= b.trade_date"""))
def price_as_of_day(t):
    days = t.positions().select("id", "ts_code", F.col("buy_date").alias("date"))
    return L.price_as_of(days, t.bars_w()).select("id", "close")


def weeks(t):
    return t.lineitem.select(week_start(F.to_date("l_shipdate")).alias("date")).distinct()


_WEEKS = dict(weeks="SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem", bp=_BUY)


@query("positions_held", "C9", with_views("positions", f"""SELECT date, strategy, count(*) AS n, {sq('sum(cost)', 0)} AS cost FROM weeks JOIN positions ON buy_date <= date AND (sell_date IS NULL OR date < sell_date) GROUP BY ALL""", **_WEEKS))
def positions_held(t):
    df = asof.held_totals(t.positions().select("strategy", "cost", "buy_date", "sell_date"), weeks(t), ["strategy"], ["cost"])
    return df.select("date", "strategy", "n", snap("cost", 0).alias("cost"))


_EQ = ["position_cost", "position_value", "position_pnl", "closed_pnl", "total_pnl", "cash", "total_value", "daily_pnl"]
_EQ_RATIOS = ["position_ratio", "cum_return", "drawdown"]


def _equity_sql(g):
    k = f"{g}, " if g else ""
    part = f"PARTITION BY {g} " if g else ""
    return {**_WEEKS,
            "open_p": "SELECT *, CASE WHEN sell_date IS NOT NULL THEN greatest(buy_date, sell_date) END AS fin FROM bp WHERE shares > 0",
            "px": "SELECT w.date, c.ts_code, b.close, b.trade_date FROM weeks w CROSS JOIN (SELECT DISTINCT ts_code FROM bars_w) c ASOF LEFT JOIN bars_w b ON b.ts_code = c.ts_code AND w.date >= b.trade_date",
            "hv": f"SELECT {k}w.date, sum(cost) AS position_cost, sum(CASE WHEN datediff('day', px.trade_date, w.date) <= 7 THEN shares * px.close ELSE cost END) AS position_value FROM weeks w JOIN open_p p ON p.buy_date <= w.date AND (fin IS NULL OR w.date < fin) LEFT JOIN px ON px.date = w.date AND px.ts_code = p.ts_code GROUP BY ALL",
            "cl": f"SELECT {k}w.date, sum(profit_loss) AS closed_pnl FROM weeks w JOIN open_p p ON fin <= w.date GROUP BY ALL",
            "grid": "SELECT * FROM weeks" + (f" CROSS JOIN (SELECT DISTINCT {g} FROM positions)" if g else ""),
            "snap": f"SELECT {k}date, coalesce(position_cost, 0) AS position_cost, coalesce(position_value, 0) AS position_value, coalesce(closed_pnl, 0) AS closed_pnl FROM grid LEFT JOIN hv USING ({k}date) LEFT JOIN cl USING ({k}date)",
            "tot": "SELECT *, position_value - position_cost AS position_pnl, position_value - position_cost + closed_pnl AS total_pnl, 5e9 - position_cost + closed_pnl AS cash, 5e9 - position_cost + closed_pnl + position_value AS total_value FROM snap",
            "fin_t": f"""SELECT *, total_value - coalesce(lag(total_value) OVER ({part}ORDER BY date), 5e9) AS daily_pnl, CASE WHEN total_value > 0 THEN position_value * 100 / total_value ELSE 0 END AS position_ratio, total_pnl / 5e9 AS cum_return,
              total_value / greatest(max(total_value) OVER ({part}ORDER BY date), 5e9) - 1 AS drawdown FROM tot"""}


for _name, _covers, _g in (("equity_curve", "J7 E18", None), ("equity_curve_by_strategy", "J8", "strategy")):
    def _make(g):
        def program(t):
            keys = ["strategy"] if g else []
            df = L.equity_curve(held(t), t.bars_w(), weeks(t), 5e9, groups=keys)
            return df.select(*keys, "date", *[snap(c, 0).alias(c) for c in _EQ], *[snap(c, 3).alias(c) for c in _EQ_RATIOS])
        return program
    query(_name, _covers, with_views("positions bars_w", f"SELECT {_g + ', ' if _g else ''}date, " + ", ".join(f"{sq(c, 0)} AS {c}" for c in _EQ)
                                     + ", " + ", ".join(f"{sq(c, 3)} AS {c}" for c in _EQ_RATIOS) + " FROM fin_t", **_equity_sql(_g)))(_make(_g))

# a curve to analyse: total order value per week and priority
_CURVE = dict(curve="""SELECT o_orderpriority AS strategy, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, 100000 + sum(o_totalprice) AS total_value FROM orders GROUP BY ALL""",
              one="SELECT date, sum(total_value) AS total_value FROM curve GROUP BY 1")


def curves(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("strategy"), week_start(F.to_date("o_orderdate")).alias("date")).agg(
        (F.sum("o_totalprice") + 100000).alias("total_value"))


def one_curve(t):
    return curves(t).groupBy("date").agg(F.sum("total_value").alias("total_value"))


_ES = ["cumulative_return", "annualized_return", "volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "avg_drawdown", "calmar_ratio"]


def _stats_sql(keys, source):
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return dict(
        e1=f"SELECT *, max(total_value) OVER ({part}ORDER BY date) AS peak, total_value / lag(total_value) OVER ({part}ORDER BY date) - 1 AS r FROM {source}",
        e2=f"SELECT *, (peak - total_value) * 100 / peak AS dd, sum(newp) OVER ({part}ORDER BY date) AS run FROM (SELECT *, CASE WHEN coalesce(peak > lag(peak) OVER ({part}ORDER BY date), true) THEN 1 ELSE 0 END AS newp FROM e1)",
        e3=f"SELECT *, sum((dd > 0)::INT) OVER (PARTITION BY {k}run ORDER BY date) AS under FROM e2",
        e4=f"SELECT {k}min_by(total_value, date) AS f, max_by(total_value, date) AS l, count(*) AS n_days, stddev_pop(r) * sqrt(252) AS vol, stddev_pop(r) FILTER (r < 0) * sqrt(252) AS down, avg(r) AS mu, stddev_pop(r) AS sd, max(dd) AS max_drawdown, avg(dd) AS avg_drawdown, max(under)::BIGINT AS max_drawdown_duration FROM e3 GROUP BY ALL",
        e5="SELECT *, (l - f) * 100 / f AS cumulative_return, (pow(l / f, 252.0 / n_days) - 1) * 100 AS annualized_return, vol * 100 AS volatility FROM e4",
        e6="SELECT *, annualized_return / volatility AS sharpe_ratio, annualized_return / 100 / down AS sortino_ratio, annualized_return / max_drawdown AS calmar_ratio, (annualized_return / 100 - 0.03) / vol AS sharpe_rf, (mu - 0.03 / 252) / sd * sqrt(252) AS sharpe_daily FROM e5")


@query("equity_statistics", "D4 E17", "WITH " + ", ".join(f"{n} AS ({s})" for n, s in {**_CURVE, **_stats_sql("", "one")}.items())
       + f" SELECT n_days, max_drawdown_duration, {', '.join(f'{sq(c)} AS {c}' for c in _ES)}, {sq('sharpe_rf')} AS sharpe_rf, {sq('sharpe_daily')} AS sharpe_daily FROM e6")
def equity_statistics(t):
    c = one_curve(t)
    base = rounded(R.equity_statistics(c), ["n_days", "max_drawdown_duration"], _ES)
    rf = R.equity_statistics(c, risk_free=0.03, downside_default=0.01).select(snap("sharpe_ratio").alias("sharpe_rf"))
    daily = R.equity_statistics(c, risk_free=0.03, excess="daily").select(snap("sharpe_ratio").alias("sharpe_daily"))
    return base.crossJoin(F.broadcast(rf)).crossJoin(F.broadcast(daily))  # one row each


@query("strategy_comparison", "J11 C13 D21", "WITH " + ", ".join(f"{n} AS ({s})" for n, s in {**_CURVE,
    "grid": "SELECT date, strategy FROM (SELECT DISTINCT date FROM curve), (SELECT DISTINCT strategy FROM curve)",
    "al": "SELECT strategy, date, coalesce(last_value(total_value IGNORE NULLS) OVER (PARTITION BY strategy ORDER BY date), 100000) AS total_value FROM grid LEFT JOIN curve USING (strategy, date)",
    **_stats_sql("strategy", "al")}.items()) + f" SELECT strategy, n_days, max_drawdown_duration, {', '.join(f'{sq(c)} AS {c}' for c in _ES)} FROM e6")
def strategy_comparison(t):
    aligned = R.align_curves(curves(t), "strategy", 100000)
    return rounded(R.equity_statistics(aligned, ["strategy"]), ["strategy", "n_days", "max_drawdown_duration"], _ES)


@query("rebased_benchmark", "C14", with_views("index_bars", f"""SELECT date, {sq('coalesce(c / first_value(c IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1) * 500000', 1)} AS benchmark FROM (
  SELECT date, last_value(close IGNORE NULLS) OVER (ORDER BY date) AS c FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) LEFT JOIN index_bars ON trade_date = date)"""))
def rebased_benchmark(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("date"))
    return R.rebased_benchmark(days, t.index_bars(), CAPITAL).select("date", snap("benchmark", 1).alias("benchmark"))


@query("curve_extremes", "H14", "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _CURVE.items()) + f""", dd AS (SELECT *, total_value / max(total_value) OVER (ORDER BY date) - 1 AS d FROM one)
  SELECT (SELECT date FROM one ORDER BY total_value DESC, date LIMIT 1) AS peak_date, (SELECT {sq('max(total_value)', 2)} FROM one) AS peak_value, (SELECT date FROM one ORDER BY total_value, date LIMIT 1) AS trough_date,
  (SELECT {sq('min(total_value)', 2)} FROM one) AS trough_value, (SELECT date FROM dd ORDER BY d, date LIMIT 1) AS drawdown_date, (SELECT {sq('min(d)')} FROM dd) AS max_drawdown""")
def curve_extremes(t):
    return R.curve_extremes(one_curve(t)).select("peak_date", snap("peak_value", 2).alias("peak_value"), "trough_date", snap("trough_value", 2).alias("trough_value"),
                                                 "drawdown_date", snap("max_drawdown").alias("max_drawdown"))


_DAILY = {**_CURVE, "daily": "SELECT date, total_value, total_value - lag(total_value, 1, total_value) OVER (ORDER BY date) AS daily_pnl, total_value / lag(total_value, 1, total_value) OVER (ORDER BY date) - 1 AS daily_return FROM one"}


def daily(t):
    w = Window.orderBy("date")
    prev = F.coalesce(F.lag("total_value").over(w), F.col("total_value"))
    return one_curve(t).select("date", "total_value", (F.col("total_value") - prev).alias("daily_pnl"), (F.col("total_value") / prev - 1).alias("daily_return"))


@query("monthly_resample", "D6 E10", "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _DAILY.items()) + f""", m AS (SELECT last_day(date) AS period, sum(daily_pnl) AS p, sum(daily_return) AS r, max_by(total_value, date) AS v FROM daily GROUP BY 1)
  SELECT period, {sq('p', 2)} AS daily_pnl, {sq('r')} AS daily_return, {sq('v', 2)} AS total_value, {sq(slog('(product(1 + r) OVER (ORDER BY period) - 1)'))} AS cumulative_return FROM m""")
def monthly_resample(t):
    return _resampled(R.resample_pnl(daily(t), "M"))


def _resampled(df):
    return df.select("period", snap("daily_pnl", 2).alias("daily_pnl"), snap("daily_return").alias("daily_return"), snap("total_value", 2).alias("total_value"), snap(signed_log("cumulative_return")).alias("cumulative_return"))


def _resample_sql(end, step):
    """Per period, and the empty periods between."""
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _DAILY.items()) + f""", m AS (SELECT CAST({end} AS DATE) AS period, sum(daily_pnl) AS p, sum(daily_return) AS r, max_by(total_value, date) AS v FROM daily GROUP BY 1),
  g AS (SELECT CAST(unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, INTERVAL {step})) AS DATE) AS period FROM m), f AS (SELECT period, coalesce(p, 0) AS p, coalesce(r, 0) AS r, v FROM g LEFT JOIN m USING (period))
  SELECT period, {sq('p', 2)} AS daily_pnl, {sq('r')} AS daily_return, {sq('v', 2)} AS total_value, {sq(slog('(product(1 + r) OVER (ORDER BY period) - 1)'))} AS cumulative_return FROM f"""


@query("weekly_resample", "D6 E10", _resample_sql("date_trunc('week', date) + INTERVAL 6 DAY", "7 DAY"))
def weekly_resample(t):
    return _resampled(R.resample_pnl(daily(t), "W"))


@query("yearly_resample", "D6 E10", _resample_sql("date_trunc('year', date) + INTERVAL 12 MONTH - INTERVAL 1 DAY", "12 MONTH"))
def yearly_resample(t):
    return _resampled(R.resample_pnl(daily(t), "Y"))


@query("return_heatmap", "D7", "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _DAILY.items()) + " SELECT year(date) AS year, " + ", ".join(
    f"{sq(slog(f'(product(1 + daily_return) FILTER (month(date) = {m}) - 1)'))} AS m{m}" for m in range(1, 13)) + " FROM daily GROUP BY 1")
def return_heatmap(t):
    out = R.year_by_month(daily(t), "date", F.product(1 + F.col("daily_return")) - 1)
    return out.select(F.col("year").cast("long").alias("year"), *[snap(signed_log(str(m))).alias(f"m{m}") for m in range(1, 13)])


@query("equity_from_returns", "J9", "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _DAILY.items()) + f""", v AS (SELECT date, 100000 * product(1 + daily_return) OVER (ORDER BY date) AS tv FROM daily)
  SELECT date, {sq(slog('tv'))} AS total_value, {sq(slog('(tv - lag(tv, 1, 100000) OVER (ORDER BY date))'), 3)} AS daily_pnl, {sq('tv / max(tv) OVER (ORDER BY date) - 1')} AS drawdown FROM v""")
def equity_from_returns(t):
    df = L.equity_from_returns(daily(t).select("date", "daily_return"), 100000, "daily_return", "date")
    return df.select("date", snap(signed_log("total_value")).alias("total_value"), snap(signed_log("daily_pnl"), 3).alias("daily_pnl"), snap("drawdown").alias("drawdown"))


_OLD = ["position_cost", "position_value", "position_pnl", "closed_pnl", "total_pnl"]


@query("rebuilt_portfolio", "J10", with_views("positions bars_w", "SELECT date, 'main' AS strategy, 5e9::DOUBLE AS init_cash, " + ", ".join(f"{sq(c, 0)} AS {c}" for c in [*_OLD, "cash"]) + f""", {sq('position_value + cash', 0)} AS total_value,
  {sq('position_pnl', 0)} AS daily_pnl, {sq('total_pnl / 5e9')} AS cum_return, 0.0::DOUBLE AS drawdown, {sq('position_ratio', 3)} AS position_ratio, CAST(NULL AS VARCHAR) AS notes FROM fin_t""", **_equity_sql(None)))
def rebuilt_portfolio(t):
    """From the snapshots as the earlier table held them: cash under another name, no strategy, total or curve."""
    old = L.equity_curve(held(t), t.bars_w(), weeks(t), 5e9).select("date", F.lit(5e9).alias("init_cash"), *_OLD, F.col("cash").alias("available_cash"), "position_ratio")
    out = L.rebuilt_portfolio(old)
    return out.select("date", "strategy", "init_cash", *[snap(c, 0).alias(c) for c in [*_OLD, "cash", "total_value", "daily_pnl"]],
                      snap("cum_return").alias("cum_return"), "drawdown", snap("position_ratio", 3).alias("position_ratio"), "notes")


@query("rebuilt_strategy_portfolio", "J10", with_views("positions bars_w", "SELECT strategy, date, " + ", ".join(f"{sq(c, 0)} AS {c}" for c in _OLD) + f", {sq('total_pnl + 500000', 0)} AS total_value, {sq('position_pnl', 0)} AS daily_pnl, CAST(NULL AS BIGINT) AS trade_count FROM fin_t", **_equity_sql("strategy")))
def rebuilt_strategy_portfolio(t):
    old = L.equity_curve(held(t), t.bars_w(), weeks(t), 5e9, groups=["strategy"]).select("strategy", "date", *_OLD)
    out = L.rebuilt_strategy_portfolio(old, CAPITAL)
    return out.select("strategy", "date", *[snap(c, 0).alias(c) for c in [*_OLD, "total_value", "daily_pnl"]], "trade_count")


# -- runs and batches -------------------------------------------------------------

_RUNS = dict(runs="""SELECT o_custkey AS run_id, min(o_orderdate)::DATE AS started, CASE WHEN o_custkey % 10 = 0 THEN 'failed' ELSE 'success' END AS status, 100000.0 AS initial_cash,
  100000 + sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END) / 100 AS final_value, count(*) AS total_trades, avg((o_orderstatus = 'F')::INT) AS win_rate,
  stddev_pop(o_totalprice) / 1e5 AS sharpe_ratio, max(o_totalprice) / 1e4 AS max_drawdown FROM orders GROUP BY o_custkey""",
    r2="SELECT *, (final_value - initial_cash) / initial_cash AS total_return, (final_value - initial_cash) / initial_cash / 2 AS annualized_return FROM runs")


def runs(t):
    won = F.col("o_orderstatus") == "F"
    p = F.col("o_totalprice")
    df = t.orders.groupBy(F.col("o_custkey").alias("run_id")).agg(
        F.min(F.to_date("o_orderdate")).alias("started"), (F.sum(F.when(won, p).otherwise(-p)) / 100 + 100000).alias("final_value"), F.count(F.lit(1)).alias("total_trades"),
        F.avg(won.cast("int")).alias("win_rate"), (F.stddev_pop(p) / 1e5).alias("sharpe_ratio"), (F.max(p) / 1e4).alias("max_drawdown"))
    df = df.withColumns({"status": F.when(F.col("run_id") % 10 == 0, "failed").otherwise("success"), "initial_cash": F.lit(100000.0)})
    gain = (F.col("final_value") - F.col("initial_cash")) / F.col("initial_cash")
    return df.withColumns({"total_return": gain, "annualized_return": gain / 2})


_BM = ["total_profit", "annualized_return", "sharpe_ratio", "win_rate", "expectancy", "cumulative_return", "avg_drawdown", "max_drawdown", "calmar_ratio", "profit_loss_ratio"]


@query("batch_metrics", "D10", "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _RUNS.items()) + f""" SELECT total_trades, {', '.join(f'{sq(c, 3)} AS {c}' for c in _BM)} FROM (
  SELECT *, annualized_return / avg_drawdown AS calmar_ratio, CASE WHEN win_rate > 0 AND win_rate < 1 THEN win_rate / (1 - win_rate) ELSE 0 END AS profit_loss_ratio FROM (
  SELECT sum(final_value - initial_cash) AS total_profit, avg(annualized_return) AS annualized_return, avg(sharpe_ratio) AS sharpe_ratio, sum(win_rate * total_trades) / sum(total_trades) AS win_rate,
  sum(total_trades)::BIGINT AS total_trades, avg(total_return) AS expectancy, sum(final_value - initial_cash) / sum(initial_cash) AS cumulative_return, avg(max_drawdown) / 100 AS avg_drawdown,
  CASE WHEN max(max_drawdown) > 1 THEN max(max_drawdown) / 100 ELSE max(max_drawdown) END AS max_drawdown FROM r2 WHERE status = 'success' AND total_trades > 0))""")
def batch_metrics(t):
    return rounded(R.batch_metrics(runs(t)), ["total_trades"], _BM, 3)


@query("batch_summary", "D16", "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _RUNS.items()) + f""" SELECT count(total_return) AS n, {sq('avg(total_return)')} AS mean, {sq('median(total_return)')} AS median, {sq('max(total_return)')} AS max, {sq('min(total_return)')} AS min,
  count(*) FILTER (total_return > 0) AS positive, count(*) FILTER (total_return < 0) AS negative, count(*) FILTER (total_return = 0) AS zero FROM r2""")
def batch_summary(t):
    return rounded(R.batch_summary(runs(t)), ["n", "positive", "negative", "zero"], ["mean", "median", "max", "min"])


@query("return_histogram", "D16", "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _RUNS.items()) + """ SELECT CAST(b AS INT) AS bin, count(run_id) AS n FROM range(50) g(b) LEFT JOIN (
  SELECT run_id, least(floor((max_drawdown - lo) * 50 / (hi - lo)), 49) AS slot FROM r2, (SELECT min(max_drawdown) AS lo, max(max_drawdown) AS hi FROM r2)) ON slot = b GROUP BY 1""")
def return_histogram(t):
    return R.histogram(runs(t), "max_drawdown")


@query("value_shares", "D15", f"SELECT c_mktsegment, count(*) AS n, {sq('count(*) / sum(count(*)) OVER ()')} AS share FROM customer GROUP BY 1")
def value_shares(t):
    return R.value_shares(t.customer, "c_mktsegment").select("c_mktsegment", "n", snap("share").alias("share"))


@query("best_and_worst_runs", "H4", "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _RUNS.items()) + f""" SELECT 'best' AS part, run_id, {sq('total_return')} AS total_return FROM (SELECT * FROM r2 ORDER BY total_return DESC, run_id LIMIT 10)
  UNION ALL SELECT 'worst', run_id, {sq('total_return')} FROM (SELECT * FROM r2 ORDER BY total_return, run_id LIMIT 10)""")
def best_and_worst_runs(t):
    r = runs(t).select("run_id", "total_return")
    best = r.orderBy(F.col("total_return").desc(), "run_id").limit(10).withColumn("part", F.lit("best"))
    worst = r.orderBy("total_return", "run_id").limit(10).withColumn("part", F.lit("worst"))
    return best.unionByName(worst).select("part", "run_id", snap("total_return").alias("total_return"))


@query("run_history_page", "H2 H15 A26", "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _RUNS.items()) + f""" SELECT kind, run_id, started, {sq('v')} AS total_return FROM (SELECT 'single' AS kind, run_id, started, total_return AS v FROM r2 WHERE status = 'success'
  UNION ALL SELECT 'batch', c_nationkey, min(started), avg(total_return) FROM r2 JOIN customer ON run_id = c_custkey GROUP BY c_nationkey) ORDER BY started DESC NULLS LAST, kind, run_id LIMIT 50 OFFSET 20""")
def run_history_page(t):
    """Single runs and batches (runs by nation) in one list, newest first."""
    r = runs(t)
    single = r.filter("status = 'success'").select(F.lit("single").alias("kind"), F.col("run_id").cast("long").alias("run_id"), "started", "total_return")
    nation = t.customer.select(F.col("c_custkey").alias("run_id"), "c_nationkey")
    batch = r.join(nation, "run_id").groupBy("c_nationkey").agg(F.min("started").alias("started"), F.avg("total_return").alias("total_return")).select(
        F.lit("batch").alias("kind"), F.col("c_nationkey").cast("long").alias("run_id"), "started", "total_return")
    both = single.unionByName(batch).orderBy(F.col("started").desc_nulls_last(), "kind", "run_id").offset(20).limit(50)
    return both.select("kind", "run_id", "started", snap("total_return").alias("total_return"))


@query("conditional_pivot", "D9", f"""SELECT o_custkey AS run_id, {sq("max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END)", 3)} AS portfolio, {sq("max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END)", 3)} AS open FROM orders
  GROUP BY 1 HAVING max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) IS NOT NULL ORDER BY max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) DESC NULLS LAST, run_id LIMIT 100""")
def conditional_pivot(t):
    rows = t.orders.select(F.col("o_custkey").alias("run_id"), "o_orderstatus", "o_totalprice")
    out = R.conditional_pivot(rows, "run_id", "o_orderstatus", "o_totalprice", {"portfolio": "F", "open": "O"}, 100)
    return out.select("run_id", snap("portfolio", 3).alias("portfolio"), snap("open", 3).alias("open"))


@query("latest_per_key", "H3 K8", """SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, count(*) AS n FROM orders GROUP BY 1""")
def latest_per_key(t):
    """Latest row per key by an aggregate: a hot key is combined on the map side."""
    latest = F.max(F.struct("o_orderdate", "o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(latest.alias("x"), F.count(F.lit(1)).alias("n")).select("o_custkey", F.col("x.o_orderkey"), "n")


@query("distinct_values", "D21", "SELECT count(DISTINCT o_orderpriority) AS strategies, count(DISTINCT o_orderdate) AS dates, count(DISTINCT o_custkey) AS codes FROM orders")
def distinct_values(t):
    return t.orders.agg(F.countDistinct("o_orderpriority").alias("strategies"), F.countDistinct("o_orderdate").alias("dates"), F.countDistinct("o_custkey").alias("codes"))


# -- signals in reports -------------------------------------------------------------

_FLAGGED = dict(fl="SELECT ts_code, trade_date, close, vol, high > 1.5 * close AS b1, low < 0.5 * close AS b2, vol > 60 AS b3 FROM bars_s")


def flagged(t):
    c = F.col("close")
    return t.bars_s().select("ts_code", "trade_date", "close", "vol", (F.col("high") > c * 1.5).alias("b1"), (F.col("low") < c * 0.5).alias("b2"), (F.col("vol") > 60).alias("b3"))


@query("signal_trend", "D11", with_views("bars_s", """SELECT trade_date, sum(b1::INT)::BIGINT AS b1, sum(b2::INT)::BIGINT AS b2, sum(b3::INT)::BIGINT AS b3, count(*) FILTER (b1::INT + b2::INT + b3::INT >= 2) AS resonance FROM fl
  WHERE trade_date IN (SELECT DISTINCT trade_date FROM fl ORDER BY 1 DESC LIMIT 30) GROUP BY 1""", **_FLAGGED))
def signal_trend(t):
    return R.signal_trend(flagged(t), ["b1", "b2", "b3"], 30)


@query("scan_statistics", "D12", with_views("bars_s", """SELECT trade_date, count(*) AS scanned, sum(b1::INT)::BIGINT AS b1, sum(b2::INT)::BIGINT AS b2, sum(b3::INT)::BIGINT AS b3, count(*) FILTER (b1 OR b2 OR b3) AS any_signal,
  count(*) FILTER (b1::INT + b2::INT + b3::INT >= 2) AS several, max(b1::INT + b2::INT + b3::INT) AS most FROM fl GROUP BY 1""", **_FLAGGED))
def scan_statistics(t):
    return R.scan_statistics(flagged(t), ["b1", "b2", "b3"])


@query("signals_of_day", "H11", with_views("bars_s", f"""SELECT ts_code, trade_date, list_aggregate(list_transform(s, lambda x: x.n), 'string_agg', ',') AS signals, list_max(list_transform(s, lambda x: x.v)) AS best_score FROM (
  SELECT ts_code, trade_date, list_reverse_sort(list_filter([CASE WHEN b1 THEN {{'v': close, 'n': 'b1'}} END, CASE WHEN b2 THEN {{'v': vol, 'n': 'b2'}} END], lambda x: x IS NOT NULL)) AS s FROM fl) WHERE len(s) > 0""", **_FLAGGED))
def signals_of_day(t):
    out = R.signals_of_day(flagged(t), {"b1": "close", "b2": "vol"}).orderBy("trade_date", F.col("best_score").desc())
    return out.select("ts_code", "trade_date", F.array_join(F.transform("signals", lambda x: x["signal"]), ",").alias("signals"), "best_score")


_DECIDE = {"bp": _BUY, "last_b": "SELECT ts_code, max_by(low, trade_date) AS low, max_by(close, trade_date) AS close FROM bars_w GROUP BY 1",
           "sig": "SELECT *, CAST(substr(ts_code, 4, 3) AS INT) AS k FROM last_b",
           "dec": """SELECT id, p.ts_code, shares, buy_price, close, CASE WHEN low < buy_price * 0.97 THEN 'stop' WHEN k % 4 = 0 THEN 's1_full' WHEN k % 4 = 1 THEN 'line_break' WHEN k % 4 = 2 THEN 's1_half' END AS sell_reason
            FROM bp p JOIN sig s ON s.ts_code = p.ts_code WHERE status = 'holding' AND buy_price > 0 AND shares > 0""",
           "dd": "SELECT *, CASE WHEN sell_reason = 's1_half' THEN greatest(100, floor(floor(shares / 2) / 100) * 100) ELSE shares END::DOUBLE AS sell_shares FROM dec WHERE sell_reason IS NOT NULL"}


def decisions(t):
    last = t.bars_w().groupBy("ts_code").agg(F.max_by("low", "trade_date").alias("low"), F.max_by("close", "trade_date").alias("close"))
    k = F.substring("ts_code", 4, 3).cast("int") % 4
    signals = last.select("ts_code", "low", "close", F.lit(0.0).alias("atr"), F.lit(0.0).alias("score_s1"), (k == 0).alias("signal_s1_full"),
                          (k == 1).alias("break_slow"), (k == 2).alias("signal_s1_half"))
    pos = held(t).withColumn("stop_loss_pct", F.lit(0.03))
    return pos, L.sell_decisions(pos.drop("sell_date"), signals)


@query("sell_decisions", "H9 C16 B12", with_views("positions bars_w", f"SELECT id, sell_reason, sell_shares, sell_reason <> 's1_half' OR sell_shares >= shares AS is_full_exit, {cents(f"close * sell_shares * {1 - M.SELL_COST!r}::DOUBLE - buy_price * sell_shares * {1 + M.COMMISSION!r}::DOUBLE")} AS profit_loss FROM dd", **_DECIDE))
def sell_decisions(t):
    out = decisions(t)[1]
    return out.select("id", "sell_reason", "sell_shares", "is_full_exit", "profit_loss")


@query("applied_decisions", "J12 A13", with_views("positions bars_w", """SELECT p.id, CASE WHEN d.full_exit THEN 'sold' ELSE p.status END AS status, CASE WHEN d.full_exit THEN DATE '2002-01-01' ELSE p.sell_date END AS sell_date,
  CASE WHEN d.full_exit = false THEN p.shares - d.sell_shares ELSE p.shares END AS shares, d.sell_reason FROM positions p LEFT JOIN (SELECT *, sell_reason <> 's1_half' OR sell_shares >= shares AS full_exit FROM dd) d ON d.id = p.id
  """.replace(", d.sell_reason FROM", ", CASE WHEN d.full_exit THEN d.sell_reason END AS sell_reason FROM"), **_DECIDE))
def applied_decisions(t):
    pos, dec = decisions(t)
    book = pos.withColumns({"sell_price": F.lit(None).cast("double"), "sell_reason": F.lit(None).cast("string"),
                            "profit_pct": F.lit(None).cast("double"), "last_action_date": F.lit(None).cast("date")})
    out = L.apply_decisions(book, dec, "2002-01-01")
    return out.select("id", "status", "sell_date", "shares", "sell_reason")


@query("audit_log", "J12", with_views("positions bars_w", "SELECT 7 + row_number() OVER (ORDER BY id) AS audit_id, id AS position_id, sell_reason, sell_shares FROM dd", **_DECIDE))
def audit_log(t):
    dec = decisions(t)[1]
    log = t.spark.createDataFrame([(7, -1)], "audit_id long, position_id long").withColumn("action_date", F.lit("2002-01-01").cast("date"))
    return L.audit_rows(log, dec, "2002-01-01").select("audit_id", "position_id", "sell_reason", "sell_shares")


@query("rebalance_diff", "H10", with_views("bars_s", """SELECT trade_date, ts_code, 'SELL' AS action, shares::DOUBLE AS shares FROM held ANTI JOIN sel USING (trade_date, ts_code)
  UNION ALL SELECT trade_date, ts_code, 'BUY', lots FROM (SELECT *, floor(1e7 / count(*) OVER (PARTITION BY trade_date) / close / 100) * 100 AS lots FROM sel) ANTI JOIN held USING (trade_date, ts_code)""",
    held="SELECT trade_date, ts_code, vol AS shares FROM bars_s WHERE vol > 50", sel="SELECT trade_date, ts_code, close FROM bars_s WHERE close < 1000"))
def rebalance_diff(t):
    b = t.bars_s()
    return L.rebalance_diff(b.filter("close < 1000").select("trade_date", "ts_code", "close"), b.filter("vol > 50").select("trade_date", "ts_code", F.col("vol").alias("shares")), 1e7)


@query("decision_summary", "D17", f"""SELECT count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (ok AND d = 'buy') AS buy, count(*) FILTER (ok AND d = 'hold') AS hold, count(*) FILTER (ok AND d = 'sell') AS sell, {sq('avg(c) FILTER (ok)')} AS avg_confidence
  FROM (SELECT event_id % 11 <> 0 AS ok, CASE event_type WHEN 'click' THEN 'buy' WHEN 'view' THEN 'hold' ELSE 'sell' END AS d, value AS c FROM events)""")
def decision_summary(t):
    rows = t.events.select((F.col("event_id") % 11 != 0).alias("success"), F.when(F.col("event_type") == "click", "BUY").when(F.col("event_type") == "view", "Hold").otherwise("sell").alias("decision"), F.col("value").alias("confidence"))
    return R.decision_summary(rows).withColumn("avg_confidence", snap("avg_confidence"))


@query("risk_votes", "D22", f"""SELECT k, CASE WHEN h >= 2 THEN 'HIGH' WHEN l >= 2 THEN 'LOW' ELSE 'MEDIUM' END AS risk_level, CASE WHEN h >= 2 THEN 0.0 WHEN l >= 2 THEN 0.3 ELSE 0.15 END::DOUBLE AS position, {sq('c')} AS confidence FROM (
  SELECT event_id // 3 AS k, count(*) FILTER (event_type IN ('error', 'purchase')) AS h, count(*) FILTER (event_type = 'view') AS l, avg(value) AS c FROM events GROUP BY 1)""")
def risk_votes(t):
    risk = F.when(F.col("event_type").isin("error", "purchase"), "HIGH").when(F.col("event_type") == "view", "LOW").otherwise("MEDIUM")
    votes = t.events.select(F.floor(F.col("event_id") / 3).alias("k"), risk.alias("risk"), F.col("value").alias("confidence"))
    return R.risk_votes(votes, "k").withColumn("confidence", snap("confidence"))
