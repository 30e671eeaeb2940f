"""The scoring rules written as SQL, to check the Spark rules with."""

from candlewick.plans.indicator_queries import _CANDLE, _D3, _E12, _E26, _K3, _SLOW, _rsv, _scan_rsi
from candlewick.plans.oracle_views import over, ref, roll
from candlewick.plans.rolling import loop

_BASE_COLUMNS = ("open high low close vol prev v1 chg amp range30 ref_vol rsv slow rsi1 rsi3 rsi4 bbi bbi20 tr atr14 "
                 "vwap kd_s kd_l").split()


def _bbi20() -> str:
    return ("CASE WHEN rn >= 21 THEN (" + " + ".join(
        f"CASE WHEN rn >= {n + 20} THEN {over('avg(close)', n + 19, 20)} ELSE close END" for n in (3, 6, 12, 24))
        + ") / 4 ELSE (" + " + ".join(roll("avg(close)", n) for n in (3, 6, 12, 24)) + ") / 4 END")


CTES = {
    "candle": _CANDLE,
    "numbered": f"""SELECT *, {_rsv(9)} AS rsv, {_rsv(3)} AS kd_s, {_rsv(21)} AS kd_l, ({_SLOW}) / 4 AS slow,
      {_scan_rsi(14)} AS rsi1, {_scan_rsi(28)} AS rsi3, {_scan_rsi(57)} AS rsi4,
      ({' + '.join(roll('avg(close)', n) for n in (3, 6, 12, 24))}) / 4 AS bbi, {_bbi20()} AS bbi20,
      {roll('avg(tr)', 14)} AS atr14,
      {roll('sum((high + low + close) / 3 * vol)', 20)} / {roll('sum(vol)', 20)} AS vwap
      FROM (SELECT * RENAME (chg AS chg_pct), close - {ref('close')} AS chg, chg AS chg_p,
            greatest(high - low, abs(high - {ref('close')}), abs(low - {ref('close')})) AS tr FROM candle)""",
    "loop_r": loop({
        "e12": ("close", _E12), "e26": ("close", _E26), "dea": ("0", f"({_E12} - {_E26}) * 0.2 + r.dea * 0.8"),
        "k": ("rsv", _K3), "d": ("rsv", _D3), "a1": ("close", "b.close * (2.0/11) + r.a1 * (9.0/11)"),
        "fast": ("close", "(b.close * (2.0/11) + r.a1 * (9.0/11)) * (2.0/11) + r.fast * (9.0/11)"),
        "w": ("NULL", "CASE WHEN b.rn = 14 THEN b.atr14 ELSE (r.w * 13 + b.tr) / 14 END")}),
    "ind": """SELECT n.* REPLACE (chg_pct AS chg), e12 - e26 AS dif, r.dea, r.k, r.d, 3 * r.k - 2 * r.d AS j, r.fast,
      range30 * 100 / prev AS rp, CASE WHEN n.rn >= 14 THEN r.w ELSE 0 END AS atr
      FROM numbered n JOIN loop_r r USING (ts_code, trade_date)""",
    "facts": f"""SELECT *, CASE WHEN ts_code[1:3] IN ('300', '688', '301') THEN 1.2 ELSE 1.1 END AS up_f,
      CASE WHEN ts_code[1:3] IN ('300', '688', '301') THEN 0.8 ELSE 0.9 END AS dn_f,
      {ref('high')} AS h1, {ref('chg')} AS chg1, {roll('avg(vol)', 30)} AS m30, {roll('avg(vol)', 40)} AS m40,
      {roll('avg(vol)', 60)} AS m60, {roll('avg(vol)', 90)} AS m90, {roll('max(vol)', 60)} AS top60,
      {over('max(dif)', 20, 1)} AS dmax20, {over('max(dif)', 15, 1)} AS dmax15, {roll('max(high)', 4)} AS hh4,
      {roll('max(high)', 60)} AS hh60, {ref('close', 10)} AS c10, {ref('close', 50)} AS c50,
      {roll('max(high)', 20)} AS hh20, {roll('min(low)', 20)} AS ll20,
      {roll("arg_max(vol, high)", 3)} AS vol_at_high3,
      CASE WHEN close > open THEN vol ELSE 0 END AS uv, CASE WHEN close < open THEN vol ELSE 0 END AS dv,
      close - {ref('close')} AS delta FROM ind""",
    "flags": f"""SELECT *,
      close >= prev * up_f AND close > open AS lim_up, close <= prev * dn_f * 1.01 AND close < open AS lim_down,
      open = close AND close = high AND close >= prev * up_f * 0.99 AS flat_up,
      open = close AND close = low AND close <= prev * dn_f * 1.01 AS flat_down,
      rn >= 21 AND dif < dmax20 AS div20, rn >= 16 AND dif < dmax15 AS div15, vol > m30 * 4 AND close > open AS burst,
      (hh20 - ll20) * 100 / ll20 AS spread,
      CASE WHEN rn >= 2 AND close >= open AND low > h1 THEN (low - prev) / prev END AS gap,
      rn >= 2 AND close = open AND (close <> prev * 1.1 OR close <= prev) AS doji,
      rn >= 3 AND close > open AND chg > chg1 * 0.9 AND vol < v1 * 0.8 AS late,
      rn >= 61 AND hh4 = hh60 AND high <> hh60 AND close < open AND
        (coalesce(close / c10 - 1 > 0.1, false) OR coalesce(close / c50 - 1 > 0.5, false)) AS second,
      close > prev AND vol > ref_vol * 1.8 AND chg > 4 AND vol > m60 AND rn >= 2 AS core,
      {{'n': rn, 'chg': chg, 'v': vol, 'v1': v1, 'up': rn >= 2 AND close > open AND chg > 2,
        'dn': rn >= 2 AND close < open AND abs(chg) > 2, 'jump': rn >= 2 AND close > open AND chg > 2 AND vol > v1 * 1.8,
        'dc': close - prev, 'sg': rn >= 2 AND vol > v1 * 1.8 AND chg > 4 AND high - greatest(open, close) <= (high - low) / 4}} AS bar,
      {{'v': vol, 'o': open, 'c': close, 'n': rn}} AS vb, {{'h': high, 'n': rn, 'd20': rn >= 21 AND dif < dmax20, 'd15': rn >= 16 AND dif < dmax15}} AS hb,
      CASE WHEN open = close AND close = high AND close >= prev * up_f * 0.99 THEN 10000000.0 ELSE vol END AS adj FROM facts""",
}


def _latest_peak(frame: str) -> str:
    return f"list_reduce({frame}, lambda a, x: CASE WHEN x.v >= a.v THEN x ELSE a END)"


def _first_peak(frame: str) -> str:
    return f"list_reduce({frame}, lambda a, x: CASE WHEN x.v > a.v THEN x ELSE a END)"


PEAKS = (60, 50, 40, 30, 25, 20, 10, 15)
CTES["frames"] = f"""SELECT *, {', '.join(f"{_latest_peak(roll('list(vb)', d))} AS p{d}" for d in PEAKS)},
  list_reduce({roll('list(hb)', 30)}, lambda a, x: CASE WHEN x.h >= a.h THEN x ELSE a END) AS top30,
  {roll('list(bar)', 30)} AS bars30, {roll('list(bar)', 10)} AS bars10,
  list_reverse({over('list(rsv)', 20, 1)}) AS back, {roll("list({'h': high, 'l': low, 'c': close})", 16)} AS recent,
  least({over('sum(CAST(burst AS INT))', 19, 1)} * 0.5, 1.4) AS burst_pts,
  ({ref('slow', 15)} + {ref('slow', 30)} + {ref('slow', 45)} + {ref('slow', 60)}) / 4 AS slow_mean,
  {over('max(spread)', 20, 1)} AS spread20, {roll('max(gap)', 20)} AS gap20 FROM flags"""
_SMOOTH = ("list_transform(range(1, 21), lambda i: list_sum(list_transform(range(1, i + 1), lambda m: {src}[m] * "
           "CASE WHEN m = 1 THEN pow(2.0/3, i - 1) ELSE pow(2.0/3, i - m) / 3 END)))")
CTES["ks"] = f"SELECT *, CASE WHEN len(back) = 20 THEN {_SMOOTH.format(src='back')} END AS kl FROM frames"
CTES["js"] = f"SELECT *, list_transform(range(1, 21), lambda i: 3 * kl[i] - 2 * dl[i]) AS jl FROM (SELECT *, {_SMOOTH.format(src='kl')} AS dl FROM ks)"
CTES["peak"] = ("SELECT *, (SELECT max(i) FROM range(6, 21) t(i) WHERE 1 = 0) AS unused, "
                "list_reduce(list_transform(range(6, 21), lambda i: {'j': jl[i], 'i': i}), "
                "lambda a, x: CASE WHEN x.j > a.j THEN x ELSE a END).i AS peak_i FROM js").replace(
                    "(SELECT max(i) FROM range(6, 21) t(i) WHERE 1 = 0) AS unused, ", "")
CTES["pulled"] = ("SELECT *, coalesce(jl[peak_i - 1] > 95 AND abs(close - oc) / oc * 100 <= 3 AND "
                  "(list_max(list_transform(since, lambda x: x.h)) - list_min(list_transform(since, lambda x: x.l))) / oc * 100 < 12, false) AS pulled "
                  "FROM (SELECT *, recent[16 - (21 - peak_i)].c AS oc, recent[16 - (21 - peak_i):16] AS since FROM peak)")


def _p(cond: str, value: float, otherwise: float = 0) -> str:
    return f"CASE WHEN {cond} THEN {value} ELSE {otherwise} END"


def _any(frame: str, cond: str) -> str:
    return f"len(list_filter({frame}, lambda x: {cond})) > 0"


def _key(days: int) -> str:
    return _any("bars30", f"x.up AND x.n > rn - {days} AND x.chg > rp * 1.5 AND x.v > greatest(ref_vol * 1.8, m40)")


def _old_peak(d: int, op: str) -> str:
    return f"p{d}.n < rn AND p{d}.c {op} p{d}.o"


_STEADY = "chg BETWEEN -2 AND 1.8 AND amp < 4"
_c18 = _p(f"(close - fast) / fast > -0.015 AND (close - fast) / fast <= 0.023 AND {_STEADY}", 1.5, -0.5)
_c19 = _p(f"({_c18}) <= 0 AND ts_code[1:2] NOT IN ('60', '00') AND (close - fast) / fast > -0.015 AND (close - fast) / fast <= 0.03 AND {_STEADY}", 2)
_c20 = _p(f"({_c18}) <= 0 AND ({_c19}) = 0 AND (close - slow) / slow <= 0.025 AND {_STEADY}", 0.6)
_GAP = "gap20 > least(0.032, rp * 0.01)"
_DRIFT = "CASE WHEN rn >= 114 THEN (slow - slow_mean) / slow_mean ELSE 0 END"
B1 = "round(" + " + ".join(f"({t})" for t in [
    _p("dif >= 0", 0.6), _p(f"close > {roll('avg(close)', 60)}", 0.3), _p("chg BETWEEN -2 AND 1.8", 1.5, -3),
    _p("amp < 7", 0.5, -1), _p("amp < 4", 0.8), _p("rsi1 < 20", 0.8), _p("rsi1 < 23", 0.7),
    _p("fast > close AND close > slow", 1.3), _p("close < slow", -3), _p("close * 1.003 < slow", -3),
    *[_p(f"vol = {roll('min(adj)', d)}", 0.3) for d in (30, 26, 24, 22, 20, 18, 16, 14, 12, 10)],
    _p(f"vol = {roll('min(vol)', 18)}", 0.5),
    *[_p(_old_peak(d, ">"), p) for d, p in ((60, 1), (30, 0.5), (20, 0.4), (10, 0.3))],
    *[_p(_old_peak(d, "<"), p) for d, p in ((60, -0.5), (30, -0.5), (25, -0.5), (20, -0.6), (15, -0.7), (10, -0.8))],
    *[_p(f"{roll('sum(CASE WHEN close > open THEN vol ELSE -vol END)', d)} > 0", 0.4) for d in (50, 40, 30, 20)],
    *[_p(f"{roll('sum(uv)', 30)} > {k} * {roll('sum(dv)', 30)}", p) for k, p in ((1.25, 0.4), (1.5, 0.5), (2, 0.6))],
    *[_p(f"{roll('sum(dv)', d)} > {roll('sum(uv)', d)}", -0.4) for d in (50, 40, 30, 20)],
    _p("bbi > bbi20", 0.5),
    *[_p(f"abs(low - slow) * {k} > abs(close - {roll('max(high)', 10)})", -1) for k in (2.5, 3)],
    _c18, _c19, _c20, _p(f"({_c18}) <= 0 AND ({_c19}) = 0 AND ({_c20}) = 0 AND close < fast AND close > slow", -1.5),
    _p("top30.n < rn AND top30.d20", -0.5), _p("top30.n < rn AND top30.d15", -0.5), "burst_pts",
    *[_p(f"spread20 > {k}", p) for k, p in ((60, -0.8), (70, -0.7), (80, -0.6), (90, -0.5), (100, -0.4))],
    _p(_GAP, -1.2), _p(f"{_GAP} AND burst_pts > 0", -1),
    f"CASE WHEN burst_pts <> 0 THEN 0 WHEN {_DRIFT} < 0.05 THEN -1 WHEN {_DRIFT} < 0.075 THEN -0.8 WHEN {_DRIFT} < 0.1 THEN -0.5 ELSE 0 END",
    _p(f"{roll('sum(uv)', 20)} > {over('sum(uv)', 40, 21)}", 0.5, -1),
    _p(f"rn >= 114 AND fast < {ref('fast')} AND slow < {ref('slow')}", -2),
    _p(f"{roll('sum(CAST(doji AS INT))', 60)} > 2", -1.5), _p("pulled", 2.8),
    _p(f"vol > 0 AND vol < v1 * 1.1 AND v1 < {ref('vol', 2)} * 1.1 AND {ref('vol', 2)} < {ref('vol', 3)} * 1.1 AND "
       f"{roll('sum(CAST(close < open AS INT))', 4)} = 4", -1),
    _p(_key(20), 1), _p(f"{roll('sum(CAST(late AS INT))', 20)} >= 2", -1),
    *[_p(_any("bars10", f"x.dn AND abs(x.chg) > rp * 1.1 AND x.v > x.v1 * {k} AND x.v > m60 AND x.v > top60 / 1.95"), p)
      for k, p in ((1.2, -1), (1.4, -0.6), (1.6, -0.5), (1.8, -0.4), (2.0, -0.4))],
    _p("rsi1 > rsi3 AND rsi3 > rsi4", 1),
    *[_p(f"{roll('sum(CAST(close = open AND close = high AS INT))', 20)} >= {k}", p) for k, p in ((1, -1), (2, -1.5))],
    _p(f"(vol > {roll('avg(vol)', 5)} OR vol > {roll('avg(vol)', 10)}) AND vol >= {roll('min(CASE WHEN second THEN vol_at_high3 END)', 10)} * 0.8", -1),
    _p("NOT ((rn >= 90 AND " + _any("bars30", "x.n > 1 AND x.v > m90 * 1.4 AND x.dc > -1e18 AND x.up30") + f") OR {_key(30)} OR "
       + _any("bars30", "x.n > 1 AND x.chg > 4 AND x.v > ref_vol * 1.8 AND x.v > m60") + ")", -2),
]) + ", 6)"
# a bar closing above its open, whatever the size of the rise
CTES["flags"] = CTES["flags"].replace("'n': rn, 'chg': chg,", "'n': rn, 'up30': close > open, 'chg': chg,")


def _few(k: int, at: int, floor: str) -> str:
    g = over("avg(greatest(delta, 0))", at + k - 1, at)
    lo = over("avg(greatest(-delta, 0))", at + k - 1, at)
    if floor:
        return f"(100 - 100 / (1 + {g} / CASE WHEN {lo} <> 0 THEN {lo} ELSE {floor} END))"
    return f"(CASE WHEN {lo} > 0 THEN 100 - 100 / (1 + {g} / {lo}) WHEN {g} > 0 THEN 100 END)"


_lo10, _hi10 = roll("min(low)", 10), roll("max(high)", 10)
CTES["b2in"] = f"SELECT *, {_few(3, 0, '0.001')} AS r3 FROM pulled"
CTES["b2trig"] = (f"SELECT *, (CASE WHEN {_hi10} = {_lo10} THEN 50 ELSE (prev - {_lo10}) * 100 / ({_hi10} - {_lo10}) END <= 21 OR "
                  f"coalesce({_few(3, 1, '')} <= 21, false)) AND vol > v1 AND chg > 3.95 AND vol > m60 AND close > open AS trig, "
                  f"({over('sum(r3)', 25, 3)} + {_few(2, 2, '0.001')} + {_few(1, 1, '0.001')}) / 25 AS mid_line, "
                  "high - greatest(open, close) AS us, least(open, close) - low AS ls, high - low AS bl FROM b2in")
B2 = "CASE WHEN trig THEN round(" + " + ".join(f"({t})" for t in [
    _p("j > 80", -3), _p("j > 65", -0.8), _p("j > 55", -0.8), _p("dif >= 0", 0.3),
    _p(" AND ".join(f"{roll('avg(close)', n)} > {over('avg(close)', n, 1)}" for n in (10, 20, 50)), 0.6),
    _p("close > slow", 0.3), _p("NOT (j < k AND j < d)", 0.3), _p("close > bbi", 0.4), _p("rsi1 > mid_line", 0.5),
    _p("rsi1 > mid_line - 5", 0.3), _p("bl > 0 AND us <= bl / 4", 1.5), _p("bl > 0 AND us >= bl / 4", -1),
    _p("bl > 0 AND us >= bl / 2", -1), _p("bl > 0 AND us <= bl / 4 AND ls <= bl / 4", 1.2),
    *[_p(f"vol > {f} * m60", p) for f, p in ((1, 0.4), (1.25, 0.6), (1.5, 0.8))],
    *[_p(f"rn >= {n} AND close >= {roll('max(close)', n)}", 0.7) for n in (90, 60, 30)],
    _p(f"{roll('sum(uv)', 40)} > {roll('sum(dv)', 40)}", 0.3),
    *[_p(f"{roll('sum(uv)', 40)} >= {k} * {roll('sum(dv)', 40)}", p) for k, p in ((1.25, 0.4), (1.5, 0.5))],
    _p(f"{roll('max(uv)', 20)} > {roll('max(dv)', 20)}", 0.5),
    _p("top30.n < rn AND top30.d20", -0.3), _p("top30.n < rn AND top30.d15", -0.3),
    *[_p(_old_peak(d, ">"), 0.3) for d in (60, 50, 40)],
    *[f"CASE WHEN p{d}.n >= rn THEN 0 WHEN p{d}.c > p{d}.o THEN 0.3 ELSE -2.5 END" for d in (30, 20, 10)], "0.3",
    _p("rsi1 > rsi3 AND rsi3 > rsi4", 0.7),
    *[_p(f"vol >= {roll('max(vol)', d)}", 0.5) for d in (60, 50, 40, 30)],
    _p(f"j > {ref('rsv')} AND {ref('rsv')} < {ref('rsv', 2)}", 0.5),
    *[_p(f"vol < {roll('max(vol)', d)}", -0.3) for d in (13, 12, 11)],
    _p(f"{roll('sum(CAST(doji AS INT))', 60)} > 2", -1.5)]) + ", 6) ELSE 0 END"


def _quiet(bars: int, needs: int) -> str:
    return f"(rn < {needs} OR coalesce((prev - {ref('open', bars)}) * 100 / {ref('open', bars)} < 4, true))"


_LIMIT = "(lim_up OR lim_down OR flat_up OR flat_down)"
CTES["rules"] = f"""SELECT *, CASE WHEN rn >= 60 THEN {B1} END AS score_b1, CASE WHEN rn >= 60 THEN {B2} END AS score_b2,
  core AND us <= bl / 3.5 AND bl > 0 AND {_quiet(8, 10)} AND {_quiet(3, 5)} AS surge,
  core AND us <= bl / 3.5 AND {_quiet(15, 16)} AND {_quiet(9, 10)} AND {_quiet(4, 5)} AS surge_scb,
  rn >= 2 AND close > prev AND close > open AND vol > ref_vol * 1.8 AS double_vol,
  coalesce(rn >= 10 AND j > {ref('rsv')} AND {ref('rsv')} < {ref('rsv', 2)}, false) AS j_turn,
  CASE WHEN {_LIMIT} THEN 0 {' '.join(f"WHEN rn >= {d} AND vol * 0.9 <= {roll('min(vol)', d)} THEN {d}" for d in (41, 31, 21, 10))} ELSE 0 END AS dry_level,
  {over('avg(tr)', 30, 1)} AS range_b, {over('avg(vol)', 40, 1)} AS m40_b, {over('avg(vol)', 60, 1)} AS m60_b,
  {over('list(bar)', 60, 2)} AS past, {_first_peak(over('list(vb)', 60, 1))} AS peak_b,
  {over('max(CASE WHEN rn >= 2 AND close > open THEN vol END)', 80, 1)} AS active, {over('min(vol)', 31, 1)} AS min31,
  {_first_peak(over('list(vb)', 18, 1))} AS peak18 FROM b2trig"""
CTES["based"] = f"""SELECT *, coalesce(NOT {_LIMIT} AND rn > 31 AND vol * 0.9 <= min31 AND vol > 0 AND (rn <= 60 OR peak_b.c >= peak_b.o) AND
  (coalesce({_any('past', 'x.jump AND x.dc > range_b * 1.5 AND x.v > m40_b')}, false) OR coalesce({_any('past', 'x.sg AND x.v > m60_b')}, false))
  AND active > m60_b * 2, false) AS dry_base FROM rules"""
CTES["states"] = f"""SELECT *, coalesce({over('max(CAST(dry_base AS INT))', 5, 1)} = 1, false) AS has_base,
  coalesce(rn >= 114 AND slow > {ref('slow', 60)}, false) AS rising,
  coalesce(close < slow AND {ref('close')} >= slow, false) AS observing,
  CASE WHEN rn >= 60 THEN round((CASE WHEN close < open AND high = hh60 AND (close / {ref('close', 9)} - 1 > 0.1 OR close / {ref('close', 49)} - 1 > 0.5)
     THEN 1.5 + CASE WHEN vol >= top60 THEN 10 WHEN vol * 1.1 >= top60 THEN 8 WHEN vol * 1.25 >= top60 THEN 7.5 WHEN vol * 1.42 >= top60 THEN 6.5 ELSE 0 END ELSE 0 END)
   + {_p(f"hh4 = hh60 AND high <> hh60 AND (vol > {roll('avg(vol)', 5)} OR vol > {roll('avg(vol)', 10)}) AND chg < -0.03 AND close < open AND vol >= {ref('vol', 2)} * 1.2", 12)}
   + {_p('j < k AND k < d', 0.8)}, 6) ELSE 0 END AS score_s1,
  coalesce(rn >= 60 AND kd_l >= 80 AND kd_s <= 30 AND close > fast AND fast > slow AND {roll('max(CAST(double_vol AS INT))', 20)} = 1 AND peak18.c >= peak18.o, false) AS dz30
  FROM based"""
CTES["panel"] = f"""SELECT *, coalesce(close < slow AND {ref('close')} < slow AND {ref('observing')}, false) AS break_slow,
  CASE WHEN rn < 60 THEN NULL WHEN has_base AND surge_scb AND rising THEN 10.0 WHEN has_base AND surge_scb THEN 7.0 WHEN has_base AND rising THEN 4.0
   WHEN surge_scb AND rising THEN 5.0 WHEN has_base THEN 2.0 WHEN surge_scb THEN 3.0 ELSE 0.0 END AS score_scb,
  rn >= 60 AND has_base AND surge_scb AND rising AS scb,
  coalesce(j < 13 AND dif >= 0 AND fast > slow AND score_b1 >= 8, false) AS b1, coalesce(dif >= 0 AND fast > slow AND score_b2 >= 8, false) AS b2,
  rn >= 60 AND fast > slow AND surge AS blk FROM states"""
CTES["final"] = """SELECT *, b2 AND surge AND double_vol AND j_turn AS blkb2,
  score_s1 >= 5 AND score_s1 < 10 AS s1_half, score_s1 >= 10 AS s1_full FROM panel"""
