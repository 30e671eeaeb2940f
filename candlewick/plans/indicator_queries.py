"""Technical indicators on the weekly panel."""

from pyspark.sql import functions as F

from candlewick.functions.series import BARS as S
from candlewick.operators import indicators as I
from candlewick.plans.oracle_views import NUMBERED, lead, over, ref, roll, strict
from candlewick.plans.registry import query
from candlewick.plans.rolling import _bars_sql, loop
from candlewick.plans.shaping import KEYS, rounded

_N = dict(numbered=NUMBERED)


def _q(name, covers, columns, build, digits=4, **ctes):
    """Register a query whose result is the panel with the named columns."""
    sql = None if columns is None else _bars_sql(columns, digits, **ctes)

    @query(name, covers, sql)
    def program(t):
        df = build(t.bars_w())
        return rounded(df, KEYS, list(columns), digits)

    program.__doc__ = build.__doc__


_q("sma", "F1", {"sma20": strict("avg(close)", 20, "close"), "ma60": roll("avg(close)", 60)},
   lambda b: I.sma(I.sma(b, 20), 60, "scan", out="ma60"))

_q("ema", "F2", {"ema12": "e", "ema12_lib": "CASE WHEN rn >= 12 THEN l END"},
   lambda b: I.ema(I.ema(b, 12), 12, "lib", out="ema12_lib"),
   numbered=f"SELECT *, {roll('avg(close)', 12)} AS m FROM ({NUMBERED})", loop_r=loop({
       "e": ("close", "b.close * (2.0/13) + r.e * (11.0/13)"),
       "l": ("NULL", "CASE WHEN b.rn = 12 THEN b.m ELSE b.close * (2.0/13) + r.l * (11.0/13) END")}))

_DEMA = dict(numbered=f"SELECT *, {roll('avg(close)', 20)} AS m FROM ({NUMBERED})",
             loop_e1=loop({"e1": ("NULL", "CASE WHEN b.rn = 20 THEN b.m ELSE b.close * (2.0/21) + r.e1 * (19.0/21) END")}
                          ).replace("loop_r", "loop_e1"))
_q("dema", "F4", {"dema": "CASE WHEN rn >= 39 THEN 2 * e1 - e2 END"}, I.dema, 3, **_DEMA,
   first=f"SELECT *, {roll('avg(e1)', 20)} AS m1 FROM loop_e1",
   loop_r=loop({"e2": ("NULL", "CASE WHEN b.rn = 39 THEN b.m1 ELSE b.e1 * (2.0/21) + r.e2 * (19.0/21) END"),
                "e1": ("e1", "b.e1")}, "first"))
_q("tema", "F4", {"tema": "3 * e1 - 3 * e2 + e3"}, I.tema, 3, **_DEMA,
   first=f"SELECT *, {over('avg(e1)', 0, -19)} AS m1 FROM loop_e1",
   loop_e2=loop({"e2": ("NULL", "CASE WHEN b.rn = 20 THEN b.m1 ELSE b.e1 * (2.0/21) + r.e2 * (19.0/21) END"),
                 "e1": ("e1", "b.e1")}, "first").replace("loop_r", "loop_e2"),
   second=f"SELECT *, {over('avg(e2)', 0, -19)} AS m2 FROM loop_e2",
   loop_r=loop({"e3": ("NULL", "CASE WHEN b.rn = 20 THEN b.m2 ELSE b.e2 * (2.0/21) + r.e3 * (19.0/21) END"),
                "e1": ("e1", "b.e1"), "e2": ("e2", "b.e2")}, "second"))

_SLOW = " + ".join(roll("avg(close)", n) for n in (14, 28, 57, 114))
_q("trend_lines", "F5 F6", {"trend_fast": "b2", "trend_slow": "slow",
                            "trend_slow_array": "CASE WHEN bars >= 330 THEN slow END"},
   lambda b: I.trend_slow(I.trend_fast(b), 330).withColumnRenamed("trend_slow", "trend_slow_array")
   .withColumn("trend_slow", I.trend_slow_column()),
   numbered=f"SELECT *, ({_SLOW}) / 4 AS slow, count(*) OVER (PARTITION BY ts_code) AS bars FROM ({NUMBERED})",
   loop_r=loop({"a1": ("close", "b.close * (2.0/11) + r.a1 * (9.0/11)"),
                "b2": ("close", "(b.close * (2.0/11) + r.a1 * (9.0/11)) * (2.0/11) + r.b2 * (9.0/11)"),
                "slow": ("slow", "b.slow"), "bars": ("bars", "b.bars")}))

def _back(span, steps):
    return " + ".join([f"CASE WHEN {steps} >= {k} THEN 1 ELSE 0 END * coalesce({ref('close', k) if k else 'close'}, 0)"
                       f" * {'1' if k == 0 else f'({span - 1}.0/{span + 1})'} * pow(2.0/{span + 1}, {steps} - {k})"
                       for k in range(span + 1)])


_q("trend_fast_backward", "F5", {"trend_fast": _back(10, "m")}, lambda b: I.trend_fast(b, "shared"),
   numbered=f"SELECT *, greatest(least(rn - 2, 9), 0) AS m FROM ({NUMBERED})")

_q("bbi", "F7", {
    "bbi": "(" + " + ".join(roll("avg(close)", n) for n in (3, 6, 12, 24)) + ") / 4",
    "bbi_20_ago": "CASE WHEN rn >= 21 THEN (" + " + ".join(
        f"CASE WHEN rn >= {n + 20} THEN {over('avg(close)', n + 19, 20)} ELSE close END" for n in (3, 6, 12, 24))
    + ") / 4 ELSE (" + " + ".join(roll("avg(close)", n) for n in (3, 6, 12, 24)) + ") / 4 END"}, I.bbi, **_N)

_E12, _E26 = "(b.close * (2.0/13) + r.e12 * (11.0/13))", "(b.close * (2.0/27) + r.e26 * (25.0/27))"
_MACD_LOOP = {"e12": ("close", _E12), "e26": ("close", _E26),
              "dea": ("0", f"({_E12} - {_E26}) * 0.2 + r.dea * 0.8")}
_q("macd", "F8", {"dif": "e12 - e26", "dea": "dea", "macd_bar": "2 * (e12 - e26 - dea)"},
   I.macd, numbered=NUMBERED, loop_r=loop(_MACD_LOOP))
_q("macd_table", "F8", {"dif": "e12 - e26", "dea": "dea", "macd_bar": "e12 - e26 - dea"},
   lambda b: I.macd(b, "table"), numbered=NUMBERED, loop_r=loop(_MACD_LOOP))
_q("macd_lib", "F8", {"dif": "CASE WHEN rn >= 26 THEN dif END",
                      "dea": "CASE WHEN rn >= 26 THEN dea WHEN rn >= 9 THEN seed END",
                      "macd_bar": "CASE WHEN rn >= 26 THEN dif - dea END"},
   lambda b: I.macd(b, "lib"),
   numbered=f"SELECT *, {roll('avg(close)', 12)} AS m12, {roll('avg(close)', 26)} AS m26 FROM ({NUMBERED})",
   loop_e=loop({"e12": ("NULL", "CASE WHEN b.rn = 12 THEN b.m12 ELSE b.close * (2.0/13) + r.e12 * (11.0/13) END"),
                "e26": ("NULL", "CASE WHEN b.rn = 26 THEN b.m26 ELSE b.close * (2.0/27) + r.e26 * (25.0/27) END")}
               ).replace("loop_r", "loop_e"),
   diffs=f"SELECT *, max(CASE WHEN rn = 26 THEN s9 END) OVER (PARTITION BY ts_code) AS seed FROM ("
         f"SELECT *, e12 - e26 AS dif, {over('avg(e12 - e26)', 0, -8)} AS s9 FROM loop_e)",
   loop_r=loop({"dea": ("NULL", "CASE WHEN b.rn = 26 THEN b.seed * 0.8 + b.dif * 0.2 ELSE b.dif * 0.2 + r.dea * 0.8 END"),
                "dif": ("dif", "b.dif"), "seed": ("seed", "b.seed")}, "diffs"))
_q("macd_backward", "F8", {"dif": "dif", "dea": roll("avg(dif)", 9), "macd_bar": f"2 * (dif - {roll('avg(dif)', 9)})"},
   lambda b: I.macd(b, "shared"), numbered=NUMBERED,
   d=f"SELECT ts_code, trade_date, ({_back(12, "least(rn - 1, 12)")}) - ({_back(26, "least(rn - 1, 26)")}) AS dif FROM numbered")


def _rsv(n, flat="50"):
    lo, hi = roll("min(low)", n), roll("max(high)", n)
    return f"CASE WHEN {hi} = {lo} THEN {flat} ELSE (close - {lo}) * 100 / ({hi} - {lo}) END"


_RSV = dict(numbered=f"SELECT *, {_rsv(9)} AS rsv FROM ({NUMBERED})")
_K3, _D3 = "(b.rsv / 3 + r.k * 2 / 3)", "((b.rsv / 3 + r.k * 2 / 3) / 3 + r.d * 2 / 3)"
_KDJ = {"k": "k", "d": "d", "j": "3 * k - 2 * d"}
_q("kdj", "F9", _KDJ, I.kdj, **_RSV, loop_r=loop({"k": ("rsv", _K3), "d": ("rsv", _D3)}))
_q("kdj_simple", "F9", _KDJ, lambda b: I.kdj(b, "simple"), **_RSV, loop_r=loop({
    "k": ("50", f"CASE WHEN b.rn < 9 THEN 50 ELSE {_K3} END"), "d": ("50", f"CASE WHEN b.rn < 9 THEN 50 ELSE {_D3} END")}))
_q("kdj_table", "F9", _KDJ, lambda b: I.kdj(b, "table"),
   numbered=f"SELECT *, {_rsv(9, 'NULL')} AS rsv FROM ({NUMBERED})", loop_r=loop({
       "k": ("50", f"CASE WHEN b.rn < 9 THEN 50 WHEN b.rsv IS NULL THEN r.k ELSE {_K3} END"),
       "d": ("50", f"CASE WHEN b.rn < 9 THEN 50 WHEN b.rsv IS NULL THEN r.d ELSE {_D3} END")}))
_q("kdj_lib", "F9", _KDJ, lambda b: I.kdj(b, "lib"),
   numbered=f"SELECT *, CASE WHEN rn >= 9 THEN {_rsv(9)} ELSE 0 END AS raw FROM ({NUMBERED})",
   ks=f"SELECT *, CASE WHEN rn >= 3 THEN {roll('avg(raw)', 3)} END AS k FROM numbered",
   ds=f"SELECT *, CASE WHEN rn >= 3 THEN {roll('avg(coalesce(k, 0))', 3)} END AS d FROM ks")

_CHG = f"SELECT *, close - {ref('close')} AS chg FROM ({NUMBERED})"
_UD = f"SELECT *, CASE WHEN chg > 0 THEN chg ELSE 0 END AS up, CASE WHEN chg < 0 THEN -chg ELSE 0 END AS down FROM ({_CHG})"


def _scan_rsi(n):
    return (f"100 - 100 / (1 + coalesce({roll('avg(CASE WHEN chg > 0 THEN chg END)', n)}, 0)"
            f" / coalesce({roll('avg(CASE WHEN chg < 0 THEN -chg END)', n)}, 1e-6))")


_q("rsi_scan", "F10", {"rsi14": _scan_rsi(14), "rsi28": _scan_rsi(28)},
   lambda b: I.rsi(I.rsi(b, 14, "scan", "rsi14"), 28, "scan", "rsi28"), numbered=_CHG)
_g, _l = roll("avg(up)", 14), roll("avg(down)", 14)
_q("rsi_windowed", "F10", {
    "rsi_table": f"CASE WHEN rn >= 14 AND ({_g} <> 0 OR {_l} <> 0) THEN CASE WHEN {_l} = 0 THEN 100 ELSE 100 - 100 / (1 + {_g} / {_l}) END END",
    "rsi_simple": f"CASE WHEN rn < 15 THEN 50 WHEN {_l} < 1e-10 THEN CASE WHEN {_g} > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + {_g} / {_l}) END",
    "rsi_shared": f"CASE WHEN rn < 15 THEN 50 ELSE 100 - 100 / (1 + {_g} / CASE WHEN {_l} <> 0 THEN {_l} ELSE 0.001 END) END"},
   lambda b: I.rsi(I.rsi(I.rsi(b, 14, "table", "rsi_table"), 14, "simple", "rsi_simple"), 14, "shared", "rsi_shared"),
   numbered=_UD)
_q("rsi_lib", "F10", {"rsi": "CASE WHEN rn >= 16 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END"},
   lambda b: I.rsi(b, 14, "lib"), numbered=f"SELECT *, {_g} AS mg, {_l} AS ml FROM ({_UD})", loop_r=loop({
       "g": ("NULL", "CASE WHEN b.rn = 15 THEN b.mg ELSE (r.g * 13 + b.up) / 14 END"),
       "l": ("NULL", "CASE WHEN b.rn = 15 THEN b.ml ELSE (r.l * 13 + b.down) / 14 END")}))

for _f, _fn, _gd in (("lib", "stddev_pop", True), ("scan", "stddev_pop", False), ("table", "stddev_samp", True)):
    _w = (lambda fn: strict(fn, 20, "close")) if _gd else (lambda fn: roll(fn, 20))
    _q(f"bollinger_{_f}", "F11", {"bb_mid": _w("avg(close)"),
                                  "bb_upper": f"{_w('avg(close)')} + 2 * {_w(_fn + '(close)')}",
                                  "bb_lower": f"{_w('avg(close)')} - 2 * {_w(_fn + '(close)')}"},
       (lambda f: lambda b: I.bollinger(b, flavor=f))(_f), 3)

_TR = (f"SELECT *, greatest(high - low, abs(high - {ref('close')}), abs(low - {ref('close')})) AS tr, "
       f"high - {ref('high')} AS rise, {ref('low')} - low AS fall FROM ({NUMBERED})")
_q("atr", "F12", {"atr": "CASE WHEN rn >= 14 THEN a ELSE 0 END", "atr_lib": "CASE WHEN rn >= 15 THEN l END",
                  "atr_table": "CASE WHEN rn >= 14 THEN m END"},
   lambda b: I.atr(I.atr(I.atr(b, flavor="lib").withColumnRenamed("atr", "atr_lib"), flavor="table")
                   .withColumnRenamed("atr", "atr_table")),
   numbered=f"SELECT *, {roll('avg(tr)', 14)} AS m FROM ({_TR})", loop_r=loop({
       "a": ("NULL", "CASE WHEN b.rn = 14 THEN b.m ELSE (r.a * 13 + b.tr) / 14 END"),
       "l": ("NULL", "CASE WHEN b.rn = 15 THEN b.m ELSE (r.l * 13 + b.tr) / 14 END"), "m": ("m", "b.m")}))

_DM = (f"SELECT *, CASE WHEN rise > fall AND rise > 0 THEN rise ELSE 0 END AS pdm, "
       f"CASE WHEN fall > rise AND fall > 0 THEN fall ELSE 0 END AS mdm FROM ({_TR})")
_SUMS = f"SELECT *, {roll('sum(tr)', 14)} AS s_tr, {roll('sum(pdm)', 14)} AS s_p, {roll('sum(mdm)', 14)} AS s_m FROM ({_DM})"
_DI = dict(numbered=_SUMS, loop_e=loop({
    c: ("NULL", f"CASE WHEN b.rn = 15 THEN b.{s} ELSE r.{c} - r.{c} / 14 + b.{v} END")
    for c, s, v in (("t", "s_tr", "tr"), ("p", "s_p", "pdm"), ("m", "s_m", "mdm"))}).replace("loop_r", "loop_e"))
_DX = ("SELECT *, CASE WHEN plus_di + minus_di > 0 THEN 100 * abs(plus_di - minus_di) / (plus_di + minus_di) ELSE 0 END AS dx FROM ("
       "SELECT *, CASE WHEN t > 0 THEN 100 * p / t ELSE 0 END AS plus_di, CASE WHEN t > 0 THEN 100 * m / t ELSE 0 END AS minus_di FROM loop_e)")
_q("adx_lib", "F13", {"adx": "CASE WHEN rn >= 28 THEN a END", "plus_di": "CASE WHEN rn > 14 THEN plus_di END",
                      "minus_di": "CASE WHEN rn > 14 THEN minus_di END"},
   I.adx, 3, **_DI, dx=f"SELECT *, {roll('avg(dx)', 14)} AS m14 FROM ({_DX})", loop_r=loop({
       "a": ("NULL", "CASE WHEN b.rn = 28 THEN b.m14 ELSE (r.a * 13 + b.dx) / 14 END"),
       "plus_di": ("plus_di", "b.plus_di"), "minus_di": ("minus_di", "b.minus_di")}, "dx"))
_q("adx_risk", "F13", {"adx": "a", "plus_di": "CASE WHEN rn > 14 THEN plus_di ELSE 0 END",
                       "minus_di": "CASE WHEN rn > 14 THEN minus_di ELSE 0 END"},
   lambda b: I.adx(b, flavor="risk"), 3, **_DI, dx=_DX, loop_r=loop({
       "a": ("0", "CASE WHEN b.rn <= 14 THEN 0 WHEN b.rn = 15 THEN b.dx ELSE r.a - r.a / 14 + b.dx END"),
       "plus_di": ("plus_di", "b.plus_di"), "minus_di": ("minus_di", "b.minus_di")}, "dx"))
_q("adx_table", "F13", {"adx": strict("avg(dx)", 14, "dx"), "plus_di": "pdi", "minus_di": "mdi"},
   lambda b: I.adx(b, flavor="table"), 3, numbered=_TR,
   di=f"SELECT *, 100 * ({strict('avg(CASE WHEN rise < 0 THEN 0 ELSE rise END)', 14, 'rise')}) / nullif({roll('avg(tr)', 14)}, 0) AS pdi, "
      f"100 * ({strict('avg(abs(fall))', 14, 'fall')}) / nullif({roll('avg(tr)', 14)}, 0) AS mdi FROM numbered",
   dx="SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di")

_TP = f"SELECT *, (high + low + close) / 3 AS tp FROM ({NUMBERED})"
_q("cci", "F14", {"cci": "CASE WHEN len(frame) = 14 THEN CASE WHEN mad = 0 THEN 0 ELSE (tp - list_avg(frame)) / (0.015 * mad) END END"},
   I.cci, 3, framed=f"SELECT *, {roll('list(tp)', 14)} AS frame FROM ({_TP})",
   dev="SELECT *, list_avg(list_transform(frame, lambda x: abs(x - list_avg(frame)))) AS mad FROM framed")
_hi, _lo = roll("max(high)", 14), roll("min(low)", 14)
_q("williams_r", "F15", {"williams_r": f"CASE WHEN rn >= 14 THEN CASE WHEN {_hi} = {_lo} THEN 0 ELSE -100 * ({_hi} - close) / ({_hi} - {_lo}) END END"},
   I.williams_r, **_N)
_pos, _neg = (roll(f"sum(CASE WHEN dtp {op} 0 THEN tp * vol ELSE 0 END)", 14) for op in "><")
_q("mfi", "F16", {"mfi": f"CASE WHEN rn > 14 THEN CASE WHEN {_neg} = 0 THEN 100 ELSE 100 - 100 / (1 + {_pos} / {_neg}) END END"},
   I.mfi, numbered=f"SELECT *, tp - {ref('tp')} AS dtp FROM ({_TP})")
_q("obv", "F17", {"obv": over("sum(CASE WHEN rn = 1 THEN vol ELSE sign(chg) * vol END)", 10**6)}, I.obv, 2, numbered=_CHG)
_q("vwap", "F18", {"vwap": f"coalesce({roll('sum(tp * vol)', 20)} / nullif({roll('sum(vol)', 20)}, 0), close)"},
   I.vwap, tp=_TP)
_q("volatility", "F19", {"volatility": f"CASE WHEN {roll('count(ret)', 20)} = 20 THEN {roll('stddev_samp(ret)', 20)} * sqrt(252) END"},
   I.volatility, 3, r=f"SELECT *, (close - {ref('close')}) / {ref('close')} AS ret FROM bars_w")


def _mid(n):
    return f"CASE WHEN rn >= {n} THEN ({roll('max(high)', n)} + {roll('min(low)', n)}) / 2 END"


_q("ichimoku", "F20", {"tenkan_sen": "t", "kijun_sen": "k", "senkou_span_a": ref("(t + k) / 2", 26),
                       "senkou_span_b": ref("s", 26), "chikou_span": lead("close", 26)}, I.ichimoku,
   numbered=NUMBERED, m=f"SELECT *, {_mid(9)} AS t, {_mid(26)} AS k, {_mid(52)} AS s FROM numbered")
_q("volume_means", "F21", {**{f"vol_ma{n}": roll("avg(vol)", n) for n in (5, 10, 20, 60)},
                           "vol_ratio": f"CASE WHEN {roll('avg(vol)', 5)} > 0 THEN vol / {roll('avg(vol)', 5)} ELSE 1 END"},
   I.volume_means)

_PREV = f"SELECT *, coalesce({ref('close')}, close) AS prev, {ref('vol')} AS v1, {ref('vol', 2)} AS v2 FROM ({NUMBERED})"
_CANDLE = (f"SELECT *, (close - prev) * 100 / prev AS chg, (high - low) * 100 / prev AS amp, "
           f"CASE WHEN rn >= 30 THEN {roll('avg(high - low)', 30)} ELSE high - low END AS range30, "
           f"coalesce(CASE WHEN v1 <= vol / 8 THEN coalesce(v2, v1) ELSE v1 END, vol) AS ref_vol FROM ({_PREV})")
_q("candle_scalars", "F22 F23 B6", {
    "chg_pct": "chg", "amp_pct": "amp", "range30": "range30", "range30_pct": "range30 * 100 / prev", "ref_vol": "ref_vol",
    "body": "abs(close - open)", "upper_shadow": "high - greatest(open, close)", "lower_shadow": "least(open, close) - low",
    "shadow_ratio": "CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) ELSE 0 END"},
   I.candles, candle=_CANDLE)
_BIG = ("SELECT *, close > open AND chg > range30 * 100 / prev * 1.5 AND chg > 2 AS big_up, "
        f"close < open AND abs(chg) > range30 * 100 / prev * 1.1 AND abs(chg) > 2 AS big_down FROM ({_CANDLE})")
_UPV = "close > prev AND vol > ref_vol * 1.8"
_q("bar_flags", "F24", {
    "big_up": "big_up::INT", "big_down": "big_down::INT",
    "key_bar": f"(rn >= 40 AND {_UPV} AND big_up AND vol > {roll('avg(vol)', 40)})::INT",
    "surge_bar": f"(rn >= 60 AND {_UPV} AND chg > 4 AND high - greatest(open, close) <= (high - low) / 4 AND vol > {roll('avg(vol)', 60)})::INT",
    "double_vol_bar": f"(rn >= 2 AND {_UPV} AND close > open)::INT"}, I.candles, None, big=_BIG)
_q("kd_positions", "F26 F27", {"kd_short": _rsv(3), "kd_long": _rsv(21), "j_turns_up": f"(rn >= 10 AND 3 * k - 2 * d > {ref('rsv')} AND {ref('rsv')} < {ref('rsv', 2)})::INT"},
   lambda b: I.kdj(b).withColumn("_rsv9", I.rsv_column(9)).withColumns({
       "kd_short": I.kd_position_column(3), "kd_long": I.kd_position_column(21), "j_turns_up": I.j_turns_up_column().cast("int")}),
   **_RSV, loop_r=loop({"k": ("rsv", _K3), "d": ("rsv", _D3), "rsv": ("rsv", "b.rsv"), "low": ("low", "b.low"),
                        "high": ("high", "b.high"), "close": ("close", "b.close")}))
_q("momentum_factors", "F28", {"price_momentum_20d": f"close / {ref('close', 20)} - 1", "price_momentum_60d": f"close / {ref('close', 60)} - 1",
                               "volume_ratio": f"vol / {roll('avg(vol)', 5)}", "turnover_20d": roll("avg(turn_rate)", 20)},
   lambda b: I.momentum_factors(b.withColumn("turn_rate", F.col("vol") / F.col("amount"))),
   t="SELECT *, vol / amount AS turn_rate FROM bars_w")
_q("indicator_row", "F25", {
    "trend_fast": "b2", "trend_slow": "slow", "dif": "e12 - e26", "dea": "dea", "k": "k", "d": "d",
    "rsi1": "rsi1", "vwap": "vwap", "atr": "CASE WHEN rn >= 14 THEN a ELSE 0 END"}, I.indicator_panel, 3,
   numbered=f"SELECT *, {_rsv(9)} AS rsv, ({_SLOW}) / 4 AS slow, {roll('avg(tr)', 14)} AS m, {_scan_rsi(14)} AS rsi1, "
            f"{roll('sum((high + low + close) / 3 * vol)', 20)} / {roll('sum(vol)', 20)} AS vwap "
            f"FROM (SELECT *, close - {ref('close')} AS chg FROM ({_TR}))",
   loop_r=loop({**_MACD_LOOP, "k": ("rsv", _K3), "d": ("rsv", _D3), "slow": ("slow", "b.slow"), "rsi1": ("rsi1", "b.rsi1"),
                "vwap": ("vwap", "b.vwap"), "a": ("NULL", "CASE WHEN b.rn = 14 THEN b.m ELSE (r.a * 13 + b.tr) / 14 END"),
                "a1": ("close", "b.close * (2.0/11) + r.a1 * (9.0/11)"),
                "b2": ("close", "(b.close * (2.0/11) + r.a1 * (9.0/11)) * (2.0/11) + r.b2 * (9.0/11)")}))
