"""Scalar rules over the tables, market state, risk sizing and the signal table."""

from pyspark.sql import functions as F

from candlewick.functions import money as M, symbols as Y
from candlewick.functions.series import ratio
from candlewick.operators import risk
from candlewick.plans.oracle_views import NUMBERED, cents, ref, roll, snap as sq, symbol, with_views
from candlewick.plans.registry import query
from candlewick.plans.rolling import loop
from candlewick.plans.rule_queries import _upto, panel
from candlewick.plans.shaping import KEYS, rounded, snap
from candlewick.session import small
from candlewick.sources.tables import nation_symbol

# codes of six digits out of the part keys: every leading digit occurs
_SYMBOLS = "SELECT p_partkey, lpad(CAST((p_partkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS code FROM part"


def symbols(t):
    return t.part.select("p_partkey", F.lpad(((F.col("p_partkey") * 7919) % 1000000).cast("string"), 6, "0").alias("code"))


@query("exchange_suffix", "B1", f"""SELECT code, CASE WHEN code[1] = '6' THEN code || '.SH' ELSE code || '.SZ' END AS six,
  CASE WHEN code[1:3] IN ('688','600','601','603','605') THEN code || '.SH' WHEN code[1:3] IN ('000','001','002','003','300') THEN code || '.SZ'
    WHEN code[1:3] = '920' THEN code || '.BJ' ELSE code END AS prefix,
  CASE WHEN code[1] IN ('6','9','5') THEN code || '.SH' WHEN code[1] IN ('0','3','2') THEN code || '.SZ' WHEN code[1] IN ('4','8') THEN code || '.BJ' ELSE code END AS digit,
  CASE WHEN code[1] IN ('8','4') THEN code || '.BJ' WHEN code[1] = '6' THEN code || '.SH' ELSE code || '.SZ' END AS north FROM ({_SYMBOLS})""")
def exchange_suffix(t):
    return symbols(t).select("code", *[Y.with_suffix("code", r).alias(r) for r in ("six", "prefix", "digit", "north")])


@query("symbol_formats", "B2", f"""SELECT code, CASE WHEN code[1] = '6' THEN 'sh.' ELSE 'sz.' END || code AS dotted,
  code || CASE WHEN code[1] = '6' THEN '.SH' ELSE '.SZ' END AS back, code AS bare FROM ({_SYMBOLS})""")
def symbol_formats(t):
    df = symbols(t).select("code", Y.to_dotted(Y.with_suffix("code", "six")).alias("dotted"))
    df = df.withColumn("back", Y.from_dotted("dotted"))
    return df.withColumn("bare", Y.bare_code("back"))


@query("market_and_board", "B3", """SELECT s_name, sym, CASE WHEN sym LIKE 'HK.%' THEN 'hk' WHEN sym LIKE 'US.%' THEN 'us' WHEN sym[1] IN ('6','3','4','8','0') AND length(sym) = 6 THEN 'china'
  WHEN regexp_full_match(sym, '[0-9]{4,5}') THEN 'hk' WHEN regexp_full_match(sym, '[A-Z]{1,5}') THEN 'us' WHEN regexp_full_match(sym, '[0-9]{6}') THEN 'china' ELSE 'us' END AS market,
  CASE WHEN sym LIKE 'HK.%' THEN 'hk' WHEN sym LIKE 'US.%' THEN 'us' WHEN sym[1] IN ('6','0','3','4','8') OR regexp_full_match(sym, '[0-9]+') THEN 'china'
  WHEN length(sym) IN (4, 5) THEN 'hk' WHEN regexp_full_match(sym, '[A-Z]{1,5}') THEN 'us' ELSE 'china' END AS news_market,
  CASE WHEN num LIKE '688%' THEN 'STAR' WHEN num[1:3] IN ('300','301') THEN 'ChiNext' WHEN num[1] IN ('8','4') THEN 'Beijing' ELSE 'Main' END AS board
  FROM (SELECT *, string_split(sym, '.')[-1] AS num FROM (SELECT s_name, CASE s_suppkey % 6 WHEN 0 THEN 'HK.' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') WHEN 1 THEN lpad(CAST(s_suppkey AS VARCHAR), 5, '0')
    WHEN 2 THEN 'AB' || chr(CAST(65 + s_suppkey % 26 AS INT)) WHEN 3 THEN '688' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') WHEN 4 THEN '920' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0')
    ELSE '300' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') END AS sym FROM supplier))""")
def market_and_board(t):
    k = F.col("s_suppkey")
    three = F.lpad((k % 1000).cast("string"), 3, "0")
    five = F.lpad(k.cast("string"), 5, "0")
    sym = (F.when(k % 6 == 0, F.concat(F.lit("HK."), five)).when(k % 6 == 1, five)
           .when(k % 6 == 2, F.concat(F.lit("AB"), F.chr(65 + k % 26))).when(k % 6 == 3, F.concat(F.lit("688"), three))
           .when(k % 6 == 4, F.concat(F.lit("920"), three)).otherwise(F.concat(F.lit("300"), three)))
    df = t.supplier.select("s_name", sym.alias("sym"))
    return df.select("s_name", "sym", Y.market_of("sym").alias("market"), Y.news_market_of("sym").alias("news_market"), Y.board_of("sym").alias("board"))


@query("date_parsing", "B4 A10", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) AS c,
  CAST(NULL AS DATE) AS bad, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t1, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t2 FROM orders""")
def date_parsing(t):
    d = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", Y.parse_day(F.date_format(d, "yyyyMMdd").cast("int")).alias("a"), Y.parse_day(F.date_format(d, "yyyy-MM-dd")).alias("b"),
        Y.parse_day(F.date_format(d, "yyyy/MM/dd")).alias("c"), Y.parse_day(F.date_format(d, "dd.MM.yy")).alias("bad"),
        F.date_format(Y.parse_time(F.date_format(d, "yyyy-MM-dd HH:mm")), "yyyy-MM-dd HH:mm:ss").alias("t1"),
        F.date_format(Y.parse_time(F.date_format(d, "yyyyMMdd HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("t2"))


@query("safe_ratios", "B5 B21", f"""SELECT c_custkey, {sq('c_acctbal / nullif(c_nationkey, 0)')} AS per_nation, {sq('coalesce(c_acctbal / nullif(c_nationkey, 0), 50)')} AS per_nation_50,
  CASE WHEN c_nationkey = 0 THEN -1.0::DOUBLE ELSE {sq('c_acctbal')} END AS cleaned FROM customer""")
def safe_ratios(t):
    bad = F.when(F.col("c_nationkey") == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return t.customer.select("c_custkey", snap(ratio("c_acctbal", "c_nationkey")).alias("per_nation"),
                             snap(ratio("c_acctbal", "c_nationkey", 50)).alias("per_nation_50"),
                             F.when(F.isnan(bad), Y.finite(bad, -1.0)).otherwise(snap(Y.finite(bad))).alias("cleaned"))


@query("json_fields", "B8", """SELECT event_type, k, count(*) AS n FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) GROUP BY ALL""")
def json_fields(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("label_mapping", "B9", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'sold' WHEN 'O' THEN 'holding' ELSE 'unknown' END AS status,
  CASE o_orderpriority[1] WHEN '1' THEN '主板' WHEN '2' THEN '指数' WHEN '4' THEN '转债' WHEN '5' THEN 'ETF' ELSE '未知' END AS kind FROM orders""")
def label_mapping(t):
    return t.orders.select("o_orderkey", Y.label("o_orderstatus", {"F": "sold", "O": "holding"}, "unknown").alias("status"),
                           Y.label(F.substring("o_orderpriority", 1, 1), Y.SECURITY_TYPES, "未知").alias("kind"))


# the rates written out: 0.025 % commission; on sale also 0.05 % stamp duty, 0.001 % transfer fee and 0.05 % slippage
_COST_BASIS, _NET = "bp * sh * (1 + 0.00025::DOUBLE)", "sp * sh * (1 - (0.0005::DOUBLE + 0.00025::DOUBLE + 0.00001::DOUBLE + 0.0005::DOUBLE))"


@query("trade_costs", "B11 B12 B13", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {cents('greatest(bp * sh * 0.00025::DOUBLE, 5)')} AS commission, {cents('bp * sh + greatest(bp * sh * 0.00025::DOUBLE, 5)')} AS cost,
  {cents(_COST_BASIS)} AS cost_basis, {cents('sp * sh')} AS gross_proceeds, {cents(_NET)} AS net_proceeds, {cents(f'{_NET} - {_COST_BASIS}')} AS profit_loss, {cents(f'({_NET} - {_COST_BASIS}) * 100 / ({_COST_BASIS})', 4)} AS profit_pct,
  CAST(floor(sh / 100) * 100 AS BIGINT) AS lots, CAST(greatest(100, floor(floor(sh / 2) / 100) * 100) AS BIGINT) AS half
  FROM (SELECT *, l_extendedprice / l_quantity / 100 AS bp, l_extendedprice / l_quantity / 100 * (1 + l_discount - l_tax) AS sp, l_quantity * 37 AS sh FROM lineitem)""")
def trade_costs(t):
    price = F.col("l_extendedprice") / F.col("l_quantity") / 100
    df = t.lineitem.withColumns({"bp": price, "sp": price * (1 + F.col("l_discount") - F.col("l_tax")), "sh": F.col("l_quantity") * 37})
    commission, cost = M.buy_cost("bp", "sh")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", commission.alias("commission"), cost.alias("cost"),
                     *[c.alias(n) for n, c in M.sell_result("bp", "sp", "sh").items()],
                     M.whole_lots("sh").cast("long").alias("lots"), M.half_lots("sh").cast("long").alias("half"))


_ATR = dict(numbered=f"SELECT *, {roll('avg(tr)', 14)} AS m FROM (SELECT *, greatest(high - low, abs(high - {ref('close')}), abs(low - {ref('close')})) AS tr FROM ({NUMBERED}))",
            loop_r=loop({"a": ("NULL", "CASE WHEN b.rn = 14 THEN b.m ELSE (r.a * 13 + b.tr) / 14 END"), "close": ("close", "b.close"), "low": ("low", "b.low")}),
            st="SELECT *, CASE WHEN rn >= 14 THEN greatest(1.5, least(8, a * 2 * 100 / close)) ELSE 3 END AS pct FROM loop_r")


@query("atr_stops", "B14", with_views("bars_w", f"""SELECT ts_code, trade_date, {sq('pct')} AS stop_pct, {sq('close * (1 - pct / 100)')} AS stop_price,
  coalesce({'lead(low) OVER (PARTITION BY ts_code ORDER BY trade_date)'} < close * (1 - pct / 100), false) AS hit_next FROM st""", **_ATR))
def atr_stops(t):
    from candlewick.functions.series import BARS as S
    from candlewick.operators.indicators import atr
    df = atr(t.bars_w()).withColumn("next_low", S.ahead("low"))
    return df.select(*KEYS, snap(M.stop_pct("atr", "close")).alias("stop_pct"), snap(M.stop_price("atr", "close")).alias("stop_price"),
                     M.stop_hit("next_low", "atr", "close").alias("hit_next"))


@query("expectancy_and_kelly", "B15", with_views("positions", f"""SELECT strategy, {sq('w * a - (1 - w) * b')} AS expectancy,
  {sq('CASE WHEN w * a - (1 - w) * b > 0 AND w < 1 THEN least((w * (a / b) - (1 - w)) / (a / b) * 0.5, 0.25) ELSE 0 END')} AS kelly FROM (
  SELECT strategy, avg((profit_loss > 0)::INT) AS w, avg(profit_loss / cost) FILTER (profit_loss > 0) AS a, -avg(profit_loss / cost) FILTER (profit_loss < 0) AS b
  FROM positions WHERE status = 'sold' GROUP BY 1)"""))
def expectancy_and_kelly(t):
    pct = F.col("profit_loss") / F.col("cost")
    stats = t.positions().filter("status = 'sold'").groupBy("strategy").agg(
        F.avg((F.col("profit_loss") > 0).cast("int")).alias("w"), F.avg(F.when(pct > 0, pct)).alias("a"), F.avg(F.when(pct < 0, -pct)).alias("b"))
    return stats.select("strategy", snap(M.expectancy("w", "a", "b")).alias("expectancy"), snap(M.kelly_share("w", "a", "b")).alias("kelly"))


_STATE = dict(m=f"SELECT *, row_number() OVER o AS rn, avg(close) OVER (o ROWS 19 PRECEDING) AS m20, avg(close) OVER (o ROWS 59 PRECEDING) AS m60, "
                "avg(vol) OVER (o ROWS 4 PRECEDING) / avg(vol) OVER (o ROWS 19 PRECEDING) AS vr FROM index_bars WINDOW o AS (ORDER BY trade_date)",
              state="SELECT trade_date, CASE WHEN rn < 60 THEN 'range' WHEN close > m20 AND m20 > m60 AND vr > 1 THEN 'bull' WHEN close < m20 AND m20 < m60 AND vr < 0.8 THEN 'bear' ELSE 'range' END AS market_state FROM m")


@query("market_state", "G15 B16", with_views("index_bars", """SELECT trade_date, market_state, 8.0 + CASE market_state WHEN 'bull' THEN -1 WHEN 'bear' THEN 2 ELSE 0 END::DOUBLE AS b1_threshold,
  8.0 + CASE market_state WHEN 'bull' THEN -1 WHEN 'bear' THEN 3 ELSE 0.5 END::DOUBLE AS cautious FROM state""", **_STATE))
def market_state(t):
    df = risk.market_state(t.index_bars())
    return df.select("trade_date", "market_state", M.threshold_for(F.lit(8.0), "market_state").alias("b1_threshold"),
                     M.threshold_for(F.lit(8.0), "market_state", "conservative").alias("cautious"))


def risk_panel(t):
    # one row per date: the market state is a small frame
    return panel(t).join(small(risk.market_state(t.index_bars())), "trade_date", "left")


# Fixed values, written out here so that the check does not take them from the operator:
# flags of B1, B2, SCB, BLK, DZ30; priority; share of the capital.
_LEVELS = (
    "('11111', 6, 0.25), ('11110', 5, 0.25), ('11101', 5, 0.25), ('11100', 4, 0.2), ('11010', 4, 0.2), ('01110', 4, 0.2), "
    "('11000', 3, 0.18), ('01100', 3, 0.18), ('10100', 2, 0.15), ('01010', 2, 0.15), ('01001', 2, 0.15), ('00100', 1, 0.12), "
    "('10000', 1, 0.1), ('01000', 1, 0.1), ('00010', 1, 0.08), ('00001', 1, 0.08), ('00000', 0, 0.0)")
_RISK = {**_upto("final"), **_STATE, "pri": f"SELECT * FROM (VALUES {_LEVELS}) p(pattern, level, share)",
  "pat": "SELECT f.*, coalesce(market_state, 'range') AS ms, b1::INT || b2::INT || scb::INT || blk::INT || dz30::INT AS pattern FROM final f LEFT JOIN state USING (trade_date)",
  "res": """SELECT p.*, coalesce(a.level, b.level, 0) AS level, least(coalesce(a.share, b.share, 0) * CASE ms WHEN 'bull' THEN 1.1 WHEN 'bear' THEN 0.7 ELSE 1 END, 0.25) AS share,
   coalesce(a.level, b.level, 0) >= CASE ms WHEN 'bull' THEN 1 WHEN 'bear' THEN 3 ELSE 2 END AS go, b1 OR b2 OR scb OR blk OR dz30 AS fired,
   coalesce(score_b1, 0) * 0.3 + coalesce(score_b2, 0) * 0.35 + coalesce(score_scb, 0) * 0.2 + CASE WHEN blk THEN 0.7 ELSE 0 END + CASE WHEN dz30 THEN 0.25 ELSE 0 END AS comp
   FROM pat p LEFT JOIN pri a ON a.pattern = p.pattern LEFT JOIN pri b ON b.pattern = p.pattern[1:3] || '00' AND a.pattern IS NULL""",
  "amt": """SELECT *, fired AND level > 0 AND go AS act, least(share, least(0.25, 0.5 * (w * (a / l) - (1 - w)) / (a / l))) * 1000000 AS sized FROM (
   SELECT *, CASE rule WHEN 'B2' THEN 0.61 WHEN 'B1' THEN 0.58 WHEN 'SCB' THEN 0.55 WHEN 'BLK' THEN 0.52 ELSE 0.5 END AS w,
    CASE rule WHEN 'B2' THEN 0.09 WHEN 'B1' THEN 0.08 WHEN 'SCB' THEN 0.07 WHEN 'BLK' THEN 0.06 ELSE 0.05 END AS a,
    CASE rule WHEN 'B2' THEN 0.035 WHEN 'BLK' THEN 0.025 ELSE 0.03 END AS l FROM (
     SELECT *, CASE WHEN b2 AND coalesce(score_b2, 0) >= coalesce(score_b1, 0) THEN 'B2' WHEN b1 THEN 'B1' WHEN scb THEN 'SCB' WHEN blk THEN 'BLK' ELSE 'DZ30' END AS rule FROM res))"""}


@query("resonance", "G16", with_views("bars_w index_bars", f"SELECT ts_code, trade_date, CAST(level AS INT) AS priority, {sq('share')} AS suggested_position_pct, round(round(comp, 6), 2) AS composite_score, go AS should_execute FROM res", **_RISK))
def resonance(t):
    return risk.resonance(risk_panel(t)).select(*KEYS, "priority", snap("suggested_position_pct").alias("suggested_position_pct"),
                                                "composite_score", "should_execute")


@query("risk_columns", "G17", with_views("bars_w index_bars", f"""SELECT ts_code, trade_date, CASE WHEN fired THEN CAST(level AS INT) ELSE 0 END AS risk_priority, act AS risk_should_buy,
  {sq("CASE WHEN act THEN round(sized) ELSE 0 END", 0)} AS risk_position_amt,
  {sq("CASE WHEN act THEN CASE WHEN atr > 0 THEN greatest(1.5, least(8, atr * 2 * 100 / close)) ELSE 3 END ELSE 0 END", 3)} AS risk_stoploss_pct,
  {sq("CASE WHEN fired THEN round(round(comp, 6), 2) ELSE 0 END", 2)} AS risk_composite_score, CASE WHEN fired THEN ms ELSE 'range' END AS risk_market_state,
  {sq("CASE WHEN act THEN close * (1 - CASE WHEN atr > 0 THEN greatest(1.5, least(8, atr * 2 * 100 / close)) ELSE 3 END / 100) ELSE 0 END", 3)} AS risk_stoploss_price,
  {sq("CASE WHEN act THEN round(sized / 1000000, 4) ELSE 0 END", 3)} AS risk_position_pct,
  CASE WHEN NOT fired THEN 'no buy signal' WHEN NOT act THEN 'priority too low' ELSE '' END AS risk_reject_reason FROM amt""", **_RISK))
def risk_columns(t):
    return risk.risk_columns(risk_panel(t)).select(
        *KEYS, "risk_priority", "risk_should_buy", snap("risk_position_amt", 0).alias("risk_position_amt"),
        snap("risk_stoploss_pct", 3).alias("risk_stoploss_pct"), snap("risk_composite_score", 2).alias("risk_composite_score"), "risk_market_state",
        snap("risk_stoploss_price", 3).alias("risk_stoploss_price"), snap("risk_position_pct", 3).alias("risk_position_pct"), "risk_reject_reason")


@query("portfolio_limits", "G18", with_views("bars_s", f"""SELECT ts_code, trade_date, CAST(place AS INT) AS place, {sq('opened', 2)} AS opened, place <= 8 AND opened <= 500000 AS accepted FROM (
  SELECT *, row_number() OVER o AS place, sum(amt) OVER (o ROWS UNBOUNDED PRECEDING) AS opened FROM (
   SELECT *, CAST(vol AS INT) % 5 AS pri, 20000 + 1000 * CAST(vol AS INT) AS amt FROM bars_s) WINDOW o AS (PARTITION BY trade_date ORDER BY pri DESC, close DESC, ts_code))"""))
def portfolio_limits(t):
    v = F.col("vol").cast("int")
    buys = t.bars_s().select(*KEYS, (v % 5).alias("risk_priority"), F.col("close").alias("risk_composite_score"), (20000 + 1000 * v).alias("risk_position_amt"))
    return risk.portfolio_limits(buys, every=True).select(*KEYS, "place", snap("opened", 2).alias("opened"), "accepted")


_STOP = "CASE WHEN atr > 0 THEN greatest(1.5, least(8, atr * 2 * 100 / close)) ELSE 3 END"
_SNAPSHOT = dict(k="k", d="d", j="j", dif="dif", dea="dea", trend_fast="fast", trend_slow="slow", rsi1="rsi1", bbi="bbi", atr="atr", vwap="vwap",
                 bb_upper="bb_mid + 2 * bb_std", bb_mid="bb_mid", bb_lower="bb_mid - 2 * bb_std", vol_ratio="CASE WHEN v5 > 0 THEN vol / v5 ELSE 1 END")
_SELLS = "(coalesce(s1_full, false) OR coalesce(s1_half, false) OR break_slow OR coalesce(paid > 0 AND (low - paid * 1.0005::DOUBLE) / (paid * 1.0005::DOUBLE) * 100 < -3, false))"


@query("daily_signal_table", "G19", with_views("bars_w index_bars positions", f"""SELECT ts_code, trade_date, name, {', '.join(f'{sq(c, 2)} AS {c}' for c in ('open', 'high', 'low', 'close', 'vol'))},
  {sq('prev', 2)} AS prev_close, {sq('chg', 3)} AS change_pct, score_b1::DOUBLE AS score_b1, score_b2::DOUBLE AS score_b2, CASE WHEN blk THEN 7.0::DOUBLE ELSE 0 END AS score_blk,
  CASE WHEN blkb2 THEN round(7 * 0.5 + score_b2 * 0.6 + 3, 6) ELSE 0 END::DOUBLE AS score_blkb2, score_scb::DOUBLE AS score_scb, CASE WHEN dz30 THEN 5.0::DOUBLE ELSE 0 END AS score_dz30, score_s1::DOUBLE AS score_s1,
  b1 AS signal_buy_b1, b2 AS signal_buy_b2, scb AS signal_buy_scb, blk AS signal_buy_blk, dz30 AS signal_buy_dz30, blkb2 AS signal_buy_blkb2, s1_full AS signal_s1_full, s1_half AS signal_s1_half, break_slow,
  0.0::DOUBLE AS score_dl, false AS signal_buy_dl, {', '.join(f'{_SELLS} AS {c}' for c in risk.SELL_COLUMNS)}, false AS signal_sell_dl, false AS signal_stop, observing AS is_observing,
  CASE WHEN fired THEN CAST(level AS INT) ELSE 0 END AS risk_priority, {sq("CASE WHEN fired THEN round(round(comp, 6), 2) ELSE 0 END", 2)} AS risk_composite_score, CASE WHEN fired THEN ms ELSE 'range' END AS risk_market_state,
  {sq(f"CASE WHEN act THEN {_STOP} ELSE 0 END", 3)} AS risk_stoploss_pct, {sq(f"CASE WHEN act THEN close * (1 - {_STOP} / 100) ELSE 0 END", 3)} AS risk_stoploss_price,
  {sq("CASE WHEN act THEN round(sized) ELSE 0 END", 0)} AS risk_position_amt, {sq("CASE WHEN act THEN round(sized / 1000000, 4) ELSE 0 END", 3)} AS risk_position_pct, act AS risk_should_buy,
  CASE WHEN NOT fired THEN 'no buy signal' WHEN NOT act THEN 'priority too low' ELSE '' END AS risk_reject_reason,
  {', '.join(f'{sq(e, 3)} AS {n}_in_json' for n, e in _SNAPSHOT.items())} FROM wide""", **_RISK,
    held_first="SELECT ts_code, arg_min(cost / nullif(shares, 0), id) AS paid FROM positions WHERE status = 'holding' AND shares > 0 GROUP BY 1",
    named=f"SELECT {symbol('n_nationkey')} AS ts_code, n_name AS name FROM nation",
    wide=f"""SELECT a.*, h.paid, n.name, {roll('avg(close)', 20)} AS bb_mid, {roll('stddev_pop(close)', 20)} AS bb_std, {roll('avg(vol)', 5)} AS v5
     FROM amt a LEFT JOIN held_first h USING (ts_code) LEFT JOIN named n USING (ts_code)"""))
def daily_signal_table(t):
    """Every column of the signal table, those of its JSON snapshot one by one."""
    held = t.positions().filter("status = 'holding' AND shares > 0").select("ts_code", "id", (F.col("cost") / F.col("shares")).alias("buy_price"))
    names = t.nation.select(nation_symbol(F.col("n_nationkey")).alias("ts_code"), F.col("n_name").alias("name"))
    df = risk.daily_signals(risk_panel(t), held, names)
    prices, shares = ["open", "high", "low", "close", "vol", "prev_close"], ["change_pct", "risk_stoploss_pct", "risk_stoploss_price", "risk_position_pct"]
    snapped = {**{c: 2 for c in prices}, **{c: 3 for c in shares}, "risk_position_amt": 0, "risk_composite_score": 2}
    return df.select(*[snap(c, snapped[c]).alias(c) if c in snapped else F.col(c) for c in df.columns if c != "indicators"],
                     *[snap(F.get_json_object("indicators", f"$.{c}").cast("double"), 3).alias(f"{c}_in_json") for c in risk.INDICATOR_COLUMNS])


@query("flag_lists", "B10 H12", with_views("bars_w", """SELECT ts_code, trade_date, CAST(n AS INT) AS n_flags, names FROM (SELECT ts_code, trade_date, close, big_up::INT + (vol > ref_vol * 1.8)::INT + (chg > 4)::INT AS n,
  array_to_string(list_filter([CASE WHEN big_up THEN 'big_up' END, CASE WHEN vol > ref_vol * 1.8 THEN 'volume' END, CASE WHEN chg > 4 THEN 'rise' END], lambda x: x IS NOT NULL), ',') AS names FROM (
   SELECT *, close > open AND chg > range30 * 100 / prev * 1.5 AND chg > 2 AS big_up FROM candle)) WHERE n >= 2""", candle=__import__("candlewick.plans.indicator_queries", fromlist=["_CANDLE"])._CANDLE))
def flag_lists(t):
    """Bars with at least two of three flags, most flags first."""
    from candlewick.operators.indicators import candles
    from candlewick.operators.reports import flag_summary
    df = candles(t.bars_w()).withColumns({"volume": F.col("vol") > F.col("ref_vol") * 1.8, "rise": F.col("chg_pct") > 4})
    out = flag_summary(df, {"big_up": "big_up", "volume": "volume", "rise": "rise"})
    return out.filter("n_flags >= 2").orderBy(F.col("n_flags").desc(), F.col("close").desc()).select(
        *KEYS, "n_flags", F.array_join("names", ",").alias("names"))


@query("rebalance_days", "B19", with_views("calendar", """SELECT cal_date, isodow(cal_date) = 1 AS weekly, day(cal_date) = 1 AS monthly,
  cal_date = min(cal_date) FILTER (is_open) OVER (PARTITION BY date_trunc('month', cal_date)) AS first_open FROM calendar"""))
def rebalance_days(t):
    from candlewick.operators.ledger import rebalance_day
    return t.calendar().select("cal_date", rebalance_day("cal_date", "W").alias("weekly"), rebalance_day("cal_date", "M").alias("monthly"),
                               rebalance_day("cal_date", "M1", "is_open").alias("first_open"))


@query("bar_time_filter", "B20", with_views("bars_t", """SELECT ts_code, bar_time, CASE WHEN hour(bar_time) = 14 AND minute(bar_time) >= 0 THEN 'late' WHEN CAST(bar_time AS DATE) IN (DATE '2024-01-10', DATE '2024-01-11') THEN 'holiday'
  WHEN d3 THEN 'falling' ELSE '' END AS reason FROM (SELECT *, coalesce(max(chg) OVER (PARTITION BY ts_code ORDER BY bar_time ROWS 2 PRECEDING) < -3, false) AND rn >= 5 AS d3 FROM (
   SELECT *, (close - lag(close) OVER o) * 100 / lag(close) OVER o AS chg, row_number() OVER o AS rn FROM bars_t WINDOW o AS (PARTITION BY ts_code ORDER BY bar_time)))"""))
def bar_time_filter(t):
    from candlewick.operators.ledger import time_filter
    holidays = t.spark.createDataFrame([("2024-01-10",), ("2024-01-11",)], "d string").select(F.to_date("d").alias("holiday"))
    return time_filter(t.bars_t(), holidays, late_minute=0).select("ts_code", "bar_time", "reason")


@query("name_and_board_exclusion", "B22", """SELECT s_suppkey, s_name, contains(s_name, 'ST') OR regexp_matches(CAST(s_suppkey AS VARCHAR), '^(30|68|8|4)') AS out FROM supplier""")
def name_and_board_exclusion(t):
    return t.supplier.select("s_suppkey", "s_name", Y.excluded("s_name", F.col("s_suppkey").cast("string")).alias("out"))


@query("clean_numbers", "B23", f"""SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 2) THEN NULL ELSE p_retailprice END AS value FROM part""")
def clean_numbers(t):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "-").when(k == 1, "None").when(k == 2, F.col("p_brand")).otherwise(F.col("p_retailprice").cast("string"))
    return t.part.select("p_partkey", Y.number_or_null(raw).alias("value"))
