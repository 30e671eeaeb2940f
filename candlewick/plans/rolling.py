"""Rolling, offset, cumulative and recursive windows over the weekly panel."""

from pyspark.sql import functions as F

from candlewick.functions import recursion as R
from candlewick.functions.series import BARS as S
from candlewick.operators.indicators import NUMBER, number_bars
from candlewick.plans.oracle_views import NUMBERED, lead, over, ref, roll, rounded as sql_rounded, strict, with_views
from candlewick.plans.registry import query
from candlewick.plans.shaping import KEYS, rounded

_K = "ts_code, trade_date"


def _bars_sql(columns: dict[str, str], digits: int = 4, **ctes: str) -> str:
    source = "loop_r" if "loop_r" in ctes else list(ctes)[-1] if ctes else "bars_w"
    return with_views("bars_w", f"SELECT {_K}, {sql_rounded(columns, digits)} FROM {source}", **ctes)


@query("rolling_mean", "E1 E2", _bars_sql({
    "mean20_strict": strict("avg(close)", 20, "close"), "mean20": roll("avg(close)", 20)}))
def rolling_mean(t):
    df = t.bars_w().withColumns({"mean20_strict": S.mean("close", 20, strict=True), "mean20": S.mean("close", 20)})
    return rounded(df, KEYS, ["mean20_strict", "mean20"])


@query("rolling_extremes", "E3", _bars_sql({
    "llv9": roll("min(low)", 9), "hhv9": roll("max(high)", 9),
    "llv9_strict": strict("min(low)", 9, "low"), "hhv9_strict": strict("max(high)", 9, "high")}, None))
def rolling_extremes(t):
    df = t.bars_w().withColumns({
        "llv9": S.lowest("low", 9), "hhv9": S.highest("high", 9),
        "llv9_strict": S.lowest("low", 9, True), "hhv9_strict": S.highest("high", 9, True)})
    return rounded(df, KEYS, ["llv9", "hhv9", "llv9_strict", "hhv9_strict"], None)


@query("rolling_std", "E4", _bars_sql({
    "std20_pop": roll("stddev_pop(close)", 20), "std20_pop_strict": strict("stddev_pop(close)", 20, "close"),
    "std20_sample_strict": strict("stddev_samp(close)", 20, "close")}, 3))
def rolling_std(t):
    df = t.bars_w().withColumns({
        "std20_pop": S.std("close", 20), "std20_pop_strict": S.std("close", 20, True),
        "std20_sample_strict": S.std("close", 20, True, sample=True)})
    return rounded(df, KEYS, ["std20_pop", "std20_pop_strict", "std20_sample_strict"], 3)


@query("rolling_weighted_mean", "E5 F3", _bars_sql({"wma10": "CASE WHEN rn >= 10 THEN (" + " + ".join(
    f"{ref('close', k) if k else 'close'} * {10 - k}" for k in range(10)) + ") / 55 END"}, numbered=NUMBERED))
def rolling_weighted_mean(t):
    return rounded(t.bars_w().withColumn("wma10", S.weighted_mean("close", 10)), KEYS, ["wma10"])


@query("rolling_mean_abs_dev", "E6", _bars_sql({
    "mad14": "CASE WHEN len(frame) = 14 THEN list_sum(list_transform(frame, lambda x: abs(x - list_avg(frame)))) / 14 END"},
    framed=f"SELECT {_K}, {roll('list(close)', 14)} AS frame FROM bars_w"))
def rolling_mean_abs_dev(t):
    return rounded(t.bars_w().withColumn("mad14", S.mean_abs_dev("close", 14)), KEYS, ["mad14"])


@query("shifted_and_returns", "E7", _bars_sql({
    "prev_close": ref("close"), "next_close": lead("close"), "diff1": f"close - {ref('close')}",
    "pct5": f"close / {ref('close', 5)} - 1", "log1": f"ln(close / {ref('close')})"}, 5))
def shifted_and_returns(t):
    df = t.bars_w().withColumns({
        "prev_close": S.ref("close"), "next_close": S.ahead("close"), "diff1": S.change("close"),
        "pct5": S.pct_change("close", 5), "log1": S.log_return("close")})
    return rounded(df, KEYS, ["prev_close", "next_close", "diff1", "pct5", "log1"], 5)


def loop(columns: dict[str, tuple[str, str]], source: str = "numbered") -> str:
    """A recursive CTE: per column its value at bar 1 and at a later bar, where
    b is the bar and r the row before."""
    first = ", ".join(f"CAST({a} AS DOUBLE) AS {c}" for c, (a, _) in columns.items())
    step = ", ".join(f"{b}" for _, b in columns.values())
    return (f"SELECT b.{_K.replace(', ', ', b.')}, b.rn, {first} FROM {source} b WHERE rn = 1 UNION ALL "
            f"SELECT b.{_K.replace(', ', ', b.')}, b.rn, {step} FROM loop_r r JOIN {source} b "
            "ON b.ts_code = r.ts_code AND b.rn = r.rn + 1")


@query("recursive_smoothing", "E8", _bars_sql({"ema12": "ema12", "third": "third"}, numbered=NUMBERED, loop_r=loop({
    "ema12": ("close", "b.close * (2.0/13) + r.ema12 * (11.0/13)"),
    "third": ("close", "b.close / 3 + r.third * 2 / 3")})))
def recursive_smoothing(t):
    df = R.decayed_sums(number_bars(t.bars_w()), S, NUMBER, {
        "ema12": R.ema_span("close", 12, NUMBER), "third": R.ema("close", 1 / 3, NUMBER)})
    return rounded(df, KEYS, ["ema12", "third"])


_SEEDS = (f"SELECT *, {roll('avg(close)', 12)} AS seed12, {roll('avg(vol)', 14)} AS seed14, "
          f"{roll('sum(vol)', 14)} AS total14 FROM (" + NUMBERED + ")")


@query("seeded_recursions", "E9 E11", _bars_sql({
    "ema12_seeded": "CASE WHEN rn >= 12 THEN e END", "wilder14": "CASE WHEN rn >= 14 THEN w END",
    "wilder_sum14": "CASE WHEN rn >= 15 THEN s END"}, 3, numbered=_SEEDS, loop_r=loop({
        "e": ("NULL", "CASE WHEN b.rn = 12 THEN b.seed12 ELSE b.close * (2.0/13) + r.e * (11.0/13) END"),
        "w": ("NULL", "CASE WHEN b.rn = 14 THEN b.seed14 ELSE (r.w * 13 + b.vol) / 14 END"),
        "s": ("NULL", "CASE WHEN b.rn = 15 THEN b.total14 ELSE r.s - r.s / 14 + b.vol END")})))
def seeded_recursions(t):
    df = R.decayed_sums(number_bars(t.bars_w()), S, NUMBER, {
        "ema12_seeded": R.mean_seeded("close", 12, NUMBER, S, 2 / 13),
        "wilder14": R.mean_seeded("vol", 14, NUMBER, S),
        "wilder_sum14": R.sum_seeded("vol", 14, NUMBER, S, first=15)})
    return rounded(df, KEYS, ["ema12_seeded", "wilder14", "wilder_sum14"], 3)


_RET = f"SELECT *, least(greatest(close / {ref('close')} - 1, -0.2), 0.2) AS ret FROM bars_w"


@query("cumulative_columns", "E10", _bars_sql({
    "cum_vol": over("sum(vol)", 10**6), "cum_high": over("max(high)", 10**6), "cum_low": over("min(low)", 10**6),
    "compounded": "exp(" + over("sum(ln(1 + ret))", 10**6) + ") - 1"}, 3, ret=_RET))
def cumulative_columns(t):
    ret = F.least(F.greatest(S.pct_change("close"), F.lit(-0.2)), F.lit(0.2))
    df = t.bars_w().withColumn("ret", ret).withColumns({
        "cum_vol": S.cum_sum("vol"), "cum_high": S.cum_max("high"), "cum_low": S.cum_min("low"),
        "compounded": S.compounded("ret")})
    return rounded(df, KEYS, ["cum_vol", "cum_high", "cum_low", "compounded"], 3)


@query("bars_since_high", "E12", _bars_sql({
    "since_high30": f"rn - (SELECT max(p.rn) FROM m p WHERE p.ts_code = m.ts_code AND p.rn BETWEEN m.rn - 29 AND m.rn AND p.high = m.top)"},
    numbered=NUMBERED, m=f"SELECT *, {roll('max(high)', 30)} AS top FROM numbered"))
def bars_since_high(t):
    df = number_bars(t.bars_w()).withColumn("since_high30", S.bars_since_highest("high", 30, NUMBER))
    return rounded(df, KEYS, ["since_high30"])


@query("value_at_volume_peak", "E13", _bars_sql({
    "open_at_peak": "p.o", "close_at_peak": "p.c"}, None, m="SELECT ts_code, trade_date, list_reduce(frame, lambda a, x: "
    "CASE WHEN x.v > a.v THEN x ELSE a END) AS p FROM (SELECT ts_code, trade_date, "
    + roll("list({'v': vol, 'o': open, 'c': close})", 20) + " AS frame FROM bars_w)"))
def value_at_volume_peak(t):
    peak = S.at_highest("vol", 20, NUMBER, ["open", "close"], latest=False)
    df = number_bars(t.bars_w()).withColumn("p", peak)
    df = df.withColumns({"open_at_peak": F.col("p.open"), "close_at_peak": F.col("p.close")})
    return rounded(df, KEYS, ["open_at_peak", "close_at_peak"], None)


@query("exist_and_count", "E14", _bars_sql({
    "up_in_5": "CAST(" + roll("max(CAST(close > open * 1.2 AS INT))", 5) + " AS INT)",
    "ups_in_20": roll("sum(CAST(close > open AS INT))", 20)}))
def exist_and_count(t):
    up = F.col("close") > F.col("open")
    df = t.bars_w().withColumns({
        "up_in_5": S.exists(F.col("close") > F.col("open") * 1.2, 5).cast("int"), "ups_in_20": S.count_if(up, 20)})
    return rounded(df, KEYS, ["up_in_5", "ups_in_20"])


@query("signed_volume", "E15", _bars_sql({
    "signed30": roll("sum(CASE WHEN close > open THEN vol ELSE -vol END)", 30),
    "up30": roll("sum(CASE WHEN close > open THEN vol ELSE 0 END)", 30),
    "down30": roll("sum(CASE WHEN close < open THEN vol ELSE 0 END)", 30)}, 2))
def signed_volume(t):
    o, c, v = F.col("open"), F.col("close"), F.col("vol")
    df = t.bars_w().withColumns({
        "signed30": S.sum(F.when(c > o, v).otherwise(-v), 30),
        "up30": S.sum_if(c > o, "vol", 30), "down30": S.sum_if(c < o, "vol", 30)})
    return rounded(df, KEYS, ["signed30", "up30", "down30"], 2)


@query("offset_frames", "E16", _bars_sql({
    "vol_21_40": over("sum(vol)", 40, 21), "mean6_20_ago": over("avg(close)", 25, 20)}))
def offset_frames(t):
    df = t.bars_w().withColumns({
        "vol_21_40": F.sum("vol").over(S.between(-40, -21)),
        "mean6_20_ago": F.avg("close").over(S.between(-25, -20))})
    return rounded(df, KEYS, ["vol_21_40", "mean6_20_ago"])


@query("falling_runs", "E17", with_views("bars_w", """SELECT ts_code, trade_date, CAST(down3 AS INT) AS down3,
    CAST(CASE WHEN fell THEN row_number() OVER (PARTITION BY ts_code, isle ORDER BY trade_date)
         - CASE WHEN first_fell THEN 0 ELSE 1 END ELSE 0 END AS BIGINT) AS run FROM (
    SELECT *, first_value(fell) OVER (PARTITION BY ts_code, isle ORDER BY trade_date) AS first_fell FROM h)""",
    f=f"SELECT *, coalesce(close < {ref('close')}, false) AS fell FROM bars_w",
    h=f"SELECT *, sum(CASE WHEN fell THEN 0 ELSE 1 END) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS isle, "
      f"coalesce(fell AND {ref('fell')} AND {ref('fell', 2)}, false) AS down3 FROM f"))
def falling_runs(t):
    """Length of the current run of falling closes, and three in a row."""
    df = t.bars_w().withColumn("fell", F.coalesce(S.change("close") < 0, F.lit(False)))
    df = df.withColumns({
        "isle": F.sum(F.when(F.col("fell"), 0).otherwise(1)).over(S.so_far),
        "down3": (F.sum(F.col("fell").cast("int")).over(S.last(3)) == 3).cast("int")})
    run = F.sum(F.col("fell").cast("int")).over(S.__class__(("ts_code", "isle")).so_far)
    return df.select(*KEYS, "down3", run.cast("long").alias("run"))


@query("drawdown_from_peak", "E18", _bars_sql({
    "drawdown": "close / peak - 1", "drawdown_floored": "close / greatest(peak, 3000) - 1"}, 5,
    m=f"SELECT *, {over('max(close)', 10**6)} AS peak FROM bars_w"))
def drawdown_from_peak(t):
    df = t.bars_w().withColumns({"drawdown": S.drawdown("close"), "drawdown_floored": S.drawdown("close", 3000)})
    return rounded(df, KEYS, ["drawdown", "drawdown_floored"], 5)


@query("fill_gaps", "E19", with_views("bars_w", """SELECT code AS ts_code, d AS trade_date,
    last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING) AS filled,
    CAST(coalesce(vol, 0) AS DOUBLE) AS vol0
    FROM (SELECT ts_code AS code, CAST(unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 7 DAY)) AS DATE) AS d
          FROM bars_w GROUP BY ts_code)
    LEFT JOIN bars_w ON bars_w.ts_code = code AND bars_w.trade_date = d"""))
def fill_gaps(t):
    """Weeks without a bar: close carried forward, volume 0."""
    bars = t.bars_w()
    weeks = bars.groupBy("ts_code").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).select(
        "ts_code", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("trade_date"))
    df = weeks.join(bars, KEYS, "left").withColumns({
        "filled": S.fill_forward("close"), "vol0": F.coalesce("vol", F.lit(0.0))})
    return rounded(df, KEYS, ["filled", "vol0"], None)
