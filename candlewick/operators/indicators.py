"""Technical indicators over a bar panel.

Every function takes a panel (one row per key and date) and returns it with the
indicator columns added.  Several established definitions of one indicator
exist; ``flavor`` chooses between them:

``scan``   the daily scan: windows use what is there, recursions start at bar 1
``lib``    the factor library: strict windows, recursions seeded by a mean
``table``  the charting library: strict windows, sample deviations, plain means
``simple`` short forms used by rule strategies
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.functions import recursion as R
from candlewick.functions.series import BARS, Series, ratio

NUMBER = "bar_no"


def number_bars(df: DataFrame, s: Series = BARS) -> DataFrame:
    return df if NUMBER in df.columns else df.withColumn(NUMBER, s.number())


def _rows_in_series(s: Series) -> Column:
    return F.count(F.lit(1)).over(s.whole)


# -- averages ---------------------------------------------------------------

def sma(df: DataFrame, n: int, flavor: str = "lib", value: str = "close",
        out: str | None = None, s: Series = BARS) -> DataFrame:
    return df.withColumn(out or f"sma{n}", s.mean(value, n, strict=flavor != "scan"))


def ema(df: DataFrame, n: int, flavor: str = "table", value: str = "close",
        out: str | None = None, s: Series = BARS) -> DataFrame:
    df = number_bars(df, s)
    rec = (R.mean_seeded(value, n, NUMBER, s, alpha=2 / (n + 1)) if flavor == "lib"
           else R.ema_span(value, n, NUMBER))
    return R.decayed_sums(df, s, NUMBER, {out or f"ema{n}": rec})


def wma(df: DataFrame, n: int, value: str = "close", s: Series = BARS) -> DataFrame:
    return df.withColumn(f"wma{n}", s.weighted_mean(value, n))


def dema(df: DataFrame, n: int = 20, value: str = "close", s: Series = BARS) -> DataFrame:
    """2*E1 - E2; E2 starts after n values of E1."""
    a = 2 / (n + 1)
    df = number_bars(df, s)
    df = R.decayed_sums(df, s, NUMBER, {"_e1": R.mean_seeded(value, n, NUMBER, s, a)})
    df = R.decayed_sums(df, s, NUMBER, {"_e2": R.mean_seeded("_e1", n, NUMBER, s, a, offset=n - 1)})
    return df.withColumn("dema", 2 * F.col("_e1") - F.col("_e2")).drop("_e1", "_e2")


def _seeded_at_start(value: str, n: int, s: Series) -> R.Recursion:
    """Smoothing that begins at bar n with the mean of the n values from there on.

    The seed looks n - 1 bars ahead; it is how the factor library smooths a
    line that itself begins at bar n.  Null for series shorter than 2n - 1.
    """
    a = 2 / (n + 1)
    at = F.col(NUMBER)
    seed = F.avg(value).over(s.between(0, n - 1))
    shown = (at >= n) & (_rows_in_series(s) >= 2 * n - 1)
    return R.Recursion(F.when(at == n, seed).when(at > n, F.col(value) * a), 1 - a, shown)


def tema(df: DataFrame, n: int = 20, value: str = "close", s: Series = BARS) -> DataFrame:
    """3*E1 - 3*E2 + E3, see :func:`_seeded_at_start` for E2 and E3."""
    df = number_bars(df, s)
    df = R.decayed_sums(df, s, NUMBER, {"_e1": R.mean_seeded(value, n, NUMBER, s, 2 / (n + 1))})
    df = R.decayed_sums(df, s, NUMBER, {"_e2": _seeded_at_start("_e1", n, s)})
    df = R.decayed_sums(df, s, NUMBER, {"_e3": _seeded_at_start("_e2", n, s)})
    line = 3 * F.col("_e1") - 3 * F.col("_e2") + F.col("_e3")
    return df.withColumn("tema", line).drop("_e1", "_e2", "_e3")


def _walk_back(span: int, steps: Column, s: Series, longest: int) -> Column:
    """From the newest close back over ``steps`` bars, each older close blended
    in with the larger weight 1 - 2/(span+1)."""
    a = 2 / (span + 1)
    line = F.col("close") * F.pow(F.lit(a), steps)
    for k in range(1, longest + 1):
        line = line + F.when(steps >= k, s.ref("close", k) * (1 - a) * F.pow(F.lit(a), steps - k)).otherwise(0.0)
    return line


def trend_slow_column(s: Series = BARS, value: str = "close") -> Column:
    return (s.mean(value, 14) + s.mean(value, 28) + s.mean(value, 57) + s.mean(value, 114)) / 4


def trend_slow(df: DataFrame, min_bars: int = 0, s: Series = BARS) -> DataFrame:
    """Mean of the 14, 28, 57 and 114 bar averages; with ``min_bars`` null for
    series that are shorter."""
    line = trend_slow_column(s)
    if min_bars:
        line = F.when(_rows_in_series(s) >= min_bars, line)
    return df.withColumn("trend_slow", line)


def trend_fast(df: DataFrame, flavor: str = "scan", s: Series = BARS) -> DataFrame:
    """EMA10 of EMA10.  ``shared``: ten bars walked backwards from the newest,
    each weighing more than the one before it."""
    df = number_bars(df, s)
    if flavor == "shared":
        # bar 1 of the series is never reached; the second pass blends the result
        # of the first with itself and changes nothing
        steps = F.greatest(F.least(F.col(NUMBER) - 2, F.lit(9)), F.lit(0))
        return df.withColumn("trend_fast", _walk_back(10, steps, s, longest=9))
    df = R.decayed_sums(df, s, NUMBER, {"_e1": R.ema_span("close", 10, NUMBER)})
    df = R.decayed_sums(df, s, NUMBER, {"trend_fast": R.ema_span("_e1", 10, NUMBER)})
    return df.drop("_e1")


def bbi(df: DataFrame, s: Series = BARS) -> DataFrame:
    """Mean of the 3, 6, 12 and 24 bar averages, and its value 20 bars ago
    (where one of those averages lacks bars, the close stands for it)."""
    df = number_bars(df, s)
    n = F.col(NUMBER)
    line = sum((s.mean("close", p) for p in (3, 6, 12, 24)), F.lit(0.0)) / 4
    old = F.lit(0.0)
    for p in (3, 6, 12, 24):
        past = F.avg("close").over(s.between(-(p + 19), -20))
        old = old + F.when(n >= p + 20, past).otherwise(F.col("close"))
    return df.withColumns({"bbi": line, "bbi_20_ago": F.when(n >= 21, old / 4).otherwise(line)})


# -- oscillators ------------------------------------------------------------

def macd(df: DataFrame, flavor: str = "scan", fast: int = 12, slow: int = 26, signal: int = 9,
         s: Series = BARS) -> DataFrame:
    """dif, dea, macd_bar.  The bar is twice the distance in ``scan``."""
    df = number_bars(df, s)
    at = F.col(NUMBER)
    if flavor == "lib":
        df = R.decayed_sums(df, s, NUMBER, {
            "_f": R.mean_seeded("close", fast, NUMBER, s, 2 / (fast + 1)),
            "_s": R.mean_seeded("close", slow, NUMBER, s, 2 / (slow + 1))})
        df = df.withColumn("dif", F.col("_f") - F.col("_s")).drop("_f", "_s")
        # the signal line stands at the mean of the first `signal` differences
        # until the differences begin
        a = 2 / (signal + 1)
        seed = F.avg("dif").over(s.between(0, signal - 1))
        df = df.withColumn("_seed", F.max(F.when(
            (at == slow) & (_rows_in_series(s) >= slow + signal - 1), seed)).over(s.whole))
        known = F.col("_seed").isNotNull()
        df = R.decayed_sums(df, s, NUMBER, {"_dea": R.Recursion(
            F.when(at == slow, F.col("_seed") * (1 - a) + F.col("dif") * a)
             .when(at > slow, F.col("dif") * a), 1 - a, shown=known & (at >= slow))})
        dea = F.when(at >= slow, F.col("_dea")).when(at >= signal, F.col("_seed"))
        df = df.withColumn("dea", dea).drop("_dea", "_seed")
        return df.withColumn("macd_bar", F.col("dif") - F.col("dea"))
    if flavor == "shared":
        seen = F.col(NUMBER) - 1
        df = df.withColumns({c: _walk_back(span, F.least(seen, F.lit(span)), s, longest=span)
                             for c, span in (("_f", fast), ("_s", slow))})
        df = df.withColumn("dif", F.col("_f") - F.col("_s")).drop("_f", "_s")
        df = df.withColumn("dea", s.mean("dif", signal))
        return df.withColumn("macd_bar", 2 * (F.col("dif") - F.col("dea")))
    df = R.decayed_sums(df, s, NUMBER, {"_f": R.ema_span("close", fast, NUMBER),
                                        "_s": R.ema_span("close", slow, NUMBER)})
    df = df.withColumn("dif", F.col("_f") - F.col("_s")).drop("_f", "_s")
    df = R.decayed_sums(df, s, NUMBER, {"dea": R.ema_span("dif", signal, NUMBER)})
    factor = 2 if flavor == "scan" else 1
    return df.withColumn("macd_bar", factor * (F.col("dif") - F.col("dea")))


def rsv_column(n: int, s: Series = BARS, strict: bool = False, flat: float | None = 50.0) -> Column:
    low, high = s.lowest("low", n), s.highest("high", n)
    value = ratio((F.col("close") - low) * 100, high - low, flat)
    return F.when(F.count("close").over(s.last(n)) == n, value) if strict else value


def kdj(df: DataFrame, flavor: str = "scan", n: int = 9, m: int = 3, s: Series = BARS) -> DataFrame:
    df = number_bars(df, s)
    at, a = F.col(NUMBER), 1 / m
    if flavor == "lib":
        raw = F.coalesce(rsv_column(n, s, strict=True), F.lit(0.0))
        df = df.withColumn("_rsv", raw)
        df = df.withColumn("k", F.when(at >= m, s.mean("_rsv", m)))
        df = df.withColumn("_k0", F.coalesce("k", F.lit(0.0)))
        df = df.withColumn("d", F.when(at >= m, s.mean("_k0", m))).drop("_rsv", "_k0")
    elif flavor in ("table", "simple"):
        # 50 until the window is full; `table` also stands still on a flat window
        df = df.withColumn("_rsv", rsv_column(n, s, strict=True,
                                              flat=None if flavor == "table" else 50.0))
        df = df.withColumn("_valid", F.count("_rsv").over(s.so_far))
        for source, target in (("_rsv", "k"), ("k", "d")):
            moved = F.col("_rsv").isNotNull()
            begin = F.when(F.col("_valid") == 1, 50 * (1 - a)).otherwise(0.0)
            df = R.decayed_sums(df, s, "_valid", {
                target: R.Recursion(F.when(moved, F.col(source) * a + begin), 1 - a, shown=moved)})
            df = df.withColumn(target, F.coalesce(s.fill_forward(target), F.lit(50.0)))
        df = df.drop("_rsv", "_valid")
    else:
        df = df.withColumn("_rsv", rsv_column(n, s))
        df = R.decayed_sums(df, s, NUMBER, {"k": R.ema("_rsv", a, NUMBER)})
        df = R.decayed_sums(df, s, NUMBER, {"d": R.ema("k", a, NUMBER)}).drop("_rsv")
    return df.withColumn("j", 3 * F.col("k") - 2 * F.col("d"))


def _strength(gain: Column, loss: Column) -> Column:
    """100 - 100/(1 + gain/loss); 100 when there is no loss."""
    return F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))


def rsi_scan_column(n: int, change: str = "_chg", s: Series = BARS) -> Column:
    """Mean rise of the rising bars over mean fall of the falling bars."""
    d = F.col(change)
    gain = F.coalesce(F.avg(F.when(d > 0, d)).over(s.last(n)), F.lit(0.0))
    loss = F.coalesce(F.avg(F.when(d < 0, -d)).over(s.last(n)), F.lit(1e-6))
    return 100 - 100 / (1 + gain / loss)


def rsi(df: DataFrame, n: int = 14, flavor: str = "table", out: str = "rsi",
        s: Series = BARS) -> DataFrame:
    df = number_bars(df, s).withColumn("_chg", s.change("close"))
    at = F.col(NUMBER)
    up = F.when(F.col("_chg") > 0, F.col("_chg")).otherwise(0.0)
    down = F.when(F.col("_chg") < 0, -F.col("_chg")).otherwise(0.0)
    if flavor == "scan":
        return df.withColumn(out, rsi_scan_column(n, "_chg", s)).drop("_chg")
    df = df.withColumns({"_up": up, "_down": down})
    if flavor == "lib":
        df = R.decayed_sums(df, s, NUMBER, {
            "_g": R.mean_seeded("_up", n, NUMBER, s, offset=1),
            "_l": R.mean_seeded("_down", n, NUMBER, s, offset=1)})
        value = F.when(at >= n + 2, _strength(F.col("_g"), F.col("_l")))
    else:
        df = df.withColumns({"_g": s.mean("_up", n), "_l": s.mean("_down", n)})
        g, l = F.col("_g"), F.col("_l")
        if flavor == "simple":
            value = F.when(at < n + 1, 50.0).when(
                l < 1e-10, F.when(g > 0, 100.0).otherwise(50.0)).otherwise(_strength(g, l))
        elif flavor == "shared":
            value = F.when(at < n + 1, 50.0).otherwise(
                100 - 100 / (1 + g / F.when(l != 0, l).otherwise(0.001)))
        else:
            value = F.when((at >= n) & ((l != 0) | (g != 0)), _strength(g, l))
    return df.withColumn(out, value).drop("_chg", "_up", "_down", "_g", "_l")


def cci(df: DataFrame, n: int = 14, s: Series = BARS) -> DataFrame:
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    dev = s.mean_abs_dev("_tp", n)
    value = F.when(dev == 0, 0.0).otherwise((F.col("_tp") - s.mean("_tp", n)) / (0.015 * dev))
    return df.withColumn("cci", F.when(dev.isNotNull(), value)).drop("_tp")


def williams_r(df: DataFrame, n: int = 14, s: Series = BARS) -> DataFrame:
    high, low = s.highest("high", n, strict=True), s.lowest("low", n, strict=True)
    value = ratio((high - F.col("close")) * -100, high - low)
    return df.withColumn("williams_r", F.when(high.isNotNull(), F.coalesce(value, F.lit(0.0))))


def mfi(df: DataFrame, n: int = 14, volume: str = "vol", s: Series = BARS) -> DataFrame:
    df = number_bars(df, s).withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumn("_dtp", s.change("_tp"))
    flow = F.col("_tp") * F.col(volume)
    df = df.withColumns({"_pos": F.when(F.col("_dtp") > 0, flow).otherwise(0.0),
                         "_neg": F.when(F.col("_dtp") < 0, flow).otherwise(0.0)})
    value = _strength(s.sum("_pos", n), s.sum("_neg", n))
    return df.withColumn("mfi", F.when(F.col(NUMBER) > n, value)).drop("_tp", "_dtp", "_pos", "_neg")


# -- bands, ranges ----------------------------------------------------------

def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, flavor: str = "lib",
              s: Series = BARS) -> DataFrame:
    strict, sample = flavor != "scan", flavor == "table"
    mid = s.mean("close", n, strict)
    width = k * s.std("close", n, strict, sample)
    return df.withColumns({"bb_mid": mid, "bb_upper": mid + width, "bb_lower": mid - width})


def true_range_column(s: Series = BARS) -> Column:
    """Largest of high-low and the distances to the previous close; high-low at
    the first bar (greatest ignores nulls)."""
    prev = s.ref("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev),
                      F.abs(F.col("low") - prev))


def atr(df: DataFrame, n: int = 14, flavor: str = "scan", s: Series = BARS) -> DataFrame:
    df = number_bars(df, s).withColumn("_tr", true_range_column(s))
    if flavor == "table":
        df = df.withColumn("atr", s.mean("_tr", n, strict=True))
    else:
        offset = 1 if flavor == "lib" else 0
        df = R.decayed_sums(df, s, NUMBER, {
            "atr": R.mean_seeded("_tr", n, NUMBER, s, offset=offset)})
        if flavor == "scan":
            df = df.withColumn("atr", F.coalesce("atr", F.lit(0.0)))
    return df.drop("_tr")


def adx(df: DataFrame, n: int = 14, flavor: str = "lib", s: Series = BARS) -> DataFrame:
    """adx, plus_di, minus_di.

    ``risk`` smooths the index by running sums, so its values are about n times
    the usual scale; thresholds on it are stated for that scale.
    """
    df = number_bars(df, s).withColumn("_tr", true_range_column(s))
    at = F.col(NUMBER)
    rise, fall = s.change("high"), -s.change("low")
    df = df.withColumns({"_rise": rise, "_fall": fall})
    if flavor == "table":
        df = df.withColumns({"_p": F.when(F.col("_rise") < 0, 0.0).otherwise(F.col("_rise")),
                             "_m": F.abs(F.col("_fall"))})
        mean_tr = s.mean("_tr", n, strict=True)
        df = df.withColumns({"plus_di": 100 * ratio(s.mean("_p", n, strict=True), mean_tr),
                             "minus_di": 100 * ratio(s.mean("_m", n, strict=True), mean_tr)})
        df = df.withColumn("_dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")),
                                              F.col("plus_di") + F.col("minus_di")))
        df = df.withColumn("adx", s.mean("_dx", n, strict=True))
        return df.drop("_tr", "_rise", "_fall", "_p", "_m", "_dx")
    plus = (F.col("_rise") > F.col("_fall")) & (F.col("_rise") > 0)
    minus = (F.col("_fall") > F.col("_rise")) & (F.col("_fall") > 0)
    df = df.withColumns({"_p": F.when(plus, F.col("_rise")).otherwise(0.0),
                         "_m": F.when(minus, F.col("_fall")).otherwise(0.0)})
    df = R.decayed_sums(df, s, NUMBER, {c: R.sum_seeded(src, n, NUMBER, s, n + 1)
                                        for c, src in (("_trs", "_tr"), ("_ps", "_p"), ("_ms", "_m"))})
    df = df.withColumns({"plus_di": 100 * ratio("_ps", "_trs", 0), "minus_di": 100 * ratio("_ms", "_trs", 0)})
    df = df.withColumn("_dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")),
                                          F.col("plus_di") + F.col("minus_di"), 0))
    if flavor == "risk":
        df = R.decayed_sums(df, s, NUMBER, {"adx": R.Recursion(
            F.when(at > n, F.col("_dx")), 1 - 1 / n)})
        df = df.withColumns({c: F.when(at > n, F.col(c)).otherwise(0.0)
                             for c in ("adx", "plus_di", "minus_di")})
    else:
        df = R.decayed_sums(df, s, NUMBER, {"adx": R.mean_seeded("_dx", n, NUMBER, s, offset=n)})
        df = df.withColumns({c: F.when(at > n, F.col(c)) for c in ("plus_di", "minus_di")})
    return df.drop("_tr", "_rise", "_fall", "_p", "_m", "_trs", "_ps", "_ms", "_dx")


def ichimoku(df: DataFrame, tenkan: int = 9, kijun: int = 26, senkou_b: int = 52,
             s: Series = BARS) -> DataFrame:
    def middle(n: int) -> Column:
        return (s.highest("high", n, strict=True) + s.lowest("low", n, strict=True)) / 2
    df = df.withColumns({"tenkan_sen": middle(tenkan), "kijun_sen": middle(kijun), "_b": middle(senkou_b)})
    df = df.withColumn("_a", (F.col("tenkan_sen") + F.col("kijun_sen")) / 2)
    return df.withColumns({"senkou_span_a": s.ref("_a", kijun), "senkou_span_b": s.ref("_b", kijun),
                           "chikou_span": s.ahead("close", kijun)}).drop("_a", "_b")


def kd_position_column(n: int, s: Series = BARS) -> Column:
    """Where the close stands between the n-bar low (0) and high (100)."""
    return rsv_column(n, s)


# -- volume, volatility -----------------------------------------------------

def obv(df: DataFrame, volume: str = "vol", s: Series = BARS) -> DataFrame:
    df = number_bars(df, s).withColumn("_dir", F.signum(s.change("close")))
    step = F.when(F.col(NUMBER) == 1, F.col(volume)).otherwise(F.col("_dir") * F.col(volume))
    return df.withColumn("_step", step).withColumn("obv", s.cum_sum("_step")).drop("_dir", "_step")


def vwap(df: DataFrame, n: int = 20, volume: str = "vol", s: Series = BARS) -> DataFrame:
    money = (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col(volume)
    value = ratio(F.sum(money).over(s.last(n)), s.sum(volume, n))
    return df.withColumn("vwap", F.coalesce(value, F.col("close")))


def volatility(df: DataFrame, n: int = 20, s: Series = BARS) -> DataFrame:
    """Annualised sample deviation of the bar returns."""
    df = df.withColumn("_r", s.pct_change("close"))
    return df.withColumn("volatility", s.std("_r", n, strict=True, sample=True) * math.sqrt(252)).drop("_r")


def volume_means(df: DataFrame, volume: str = "vol", s: Series = BARS) -> DataFrame:
    means = {f"vol_ma{n}": s.mean(volume, n) for n in (5, 10, 20, 60)}
    return df.withColumns({**means, "vol_ratio": ratio(volume, s.mean(volume, 5), 1.0)})


def ref_vol_column(volume: str = "vol", s: Series = BARS) -> Column:
    """Yesterday's volume, or the day before's if yesterday was at most an eighth
    of today's.  Short histories fall back on what there is."""
    v, v1, v2 = F.col(volume), s.ref(volume, 1), s.ref(volume, 2)
    return F.coalesce(F.when(v1 <= v / 8, F.coalesce(v2, v1)).otherwise(v1), v)


def candles(df: DataFrame, s: Series = BARS) -> DataFrame:
    """Change, amplitude, mean range, big up and down bars, reference volume,
    key bar, surge bar, double-volume bar."""
    df = number_bars(df, s)
    n, o, h, l, c, v = (F.col(x) for x in (NUMBER, "open", "high", "low", "close", "vol"))
    prev = F.coalesce(s.ref("close"), c)
    df = df.withColumns({
        "prev_close": prev,
        "chg_pct": ratio((c - prev) * 100, prev, 0),
        "amp_pct": ratio((h - l) * 100, prev, 0),
        "range30": F.when(n >= 30, F.avg(F.abs(h - l)).over(s.last(30))).otherwise(h - l),
        "ref_vol": ref_vol_column(s=s),
        "body": F.abs(c - o), "upper_shadow": h - F.greatest(c, o),
        "lower_shadow": F.least(c, o) - l,
        "shadow_ratio": ratio(h - F.greatest(c, o), h - l, 0),
        "_v40": s.mean("vol", 40), "_v60": s.mean("vol", 60)})
    df = df.withColumn("range30_pct", ratio(F.col("range30") * 100, "prev_close", 0))
    chg = F.col("chg_pct")
    df = df.withColumns({
        "big_up": (c > o) & (chg > F.col("range30_pct") * 1.5) & (chg > 2),
        "big_down": (c < o) & (F.abs(chg) > F.col("range30_pct") * 1.1) & (F.abs(chg) > 2)})
    up_on_volume = (c > F.col("prev_close")) & (v > F.col("ref_vol") * 1.8)
    return df.withColumns({
        "key_bar": (n >= 40) & up_on_volume & F.col("big_up") & (v > F.col("_v40")),
        "surge_bar": (n >= 60) & up_on_volume & (chg > 4)
        & (F.col("upper_shadow") <= (h - l) / 4) & (v > F.col("_v60")),
        "double_vol_bar": (n >= 2) & up_on_volume & (c > o)}).drop("_v40", "_v60")


def j_turns_up_column(s: Series = BARS) -> Column:
    """J above yesterday's raw position, which was below the day before's; needs
    10 bars."""
    return F.coalesce((F.col(NUMBER) >= 10) & (F.col("j") > s.ref("_rsv9", 1))
                      & (s.ref("_rsv9", 1) < s.ref("_rsv9", 2)), F.lit(False))


def momentum_factors(df: DataFrame, turnover: str = "turn_rate", s: Series = BARS) -> DataFrame:
    df = df.withColumns({"price_momentum_20d": s.pct_change("close", 20),
                         "price_momentum_60d": s.pct_change("close", 60),
                         "volume_ratio": ratio("vol", s.mean("vol", 5), 1.0)})
    return df.withColumn("turnover_20d", s.mean(turnover, 20)) if turnover in df.columns else df


# -- the whole row ----------------------------------------------------------

AVERAGES = (3, 5, 6, 10, 12, 14, 20, 24, 28, 30, 50, 57, 60, 114)


def indicator_panel(df: DataFrame, s: Series = BARS) -> DataFrame:
    """The scan's full indicator row for every bar of every code.

    One exchange by key serves all windows and recursions.
    """
    df = candles(number_bars(df, s), s)
    df = df.withColumns({f"ma{n}": s.mean("close", n) for n in AVERAGES})
    df = volume_means(df, s=s)
    df = bollinger(df, flavor="scan", s=s)
    df = vwap(df, s=s)
    df = bbi(df, s)
    df = df.withColumn("trend_slow", (F.col("ma14") + F.col("ma28") + F.col("ma57") + F.col("ma114")) / 4)
    df = df.withColumns({"_chg": s.change("close"), "_tr": true_range_column(s),
                         "_rsv9": rsv_column(9, s)})
    df = df.withColumns({"rsi1": rsi_scan_column(14, "_chg", s), "rsi2": rsi_scan_column(14, "_chg", s),
                         "rsi3": rsi_scan_column(28, "_chg", s), "rsi4": rsi_scan_column(57, "_chg", s)})
    df = R.decayed_sums(df, s, NUMBER, {
        "_e12": R.ema_span("close", 12, NUMBER), "_e26": R.ema_span("close", 26, NUMBER),
        "_e10": R.ema_span("close", 10, NUMBER), "k": R.ema("_rsv9", 1 / 3, NUMBER),
        "_atr": R.mean_seeded("_tr", 14, NUMBER, s)})
    df = df.withColumn("dif", F.col("_e12") - F.col("_e26"))
    df = R.decayed_sums(df, s, NUMBER, {
        "dea": R.ema_span("dif", 9, NUMBER), "d": R.ema("k", 1 / 3, NUMBER),
        "trend_fast": R.ema_span("_e10", 10, NUMBER)})
    df = df.withColumns({"macd_bar": 2 * (F.col("dif") - F.col("dea")),
                         "j": 3 * F.col("k") - 2 * F.col("d"),
                         "atr": F.coalesce("_atr", F.lit(0.0)),
                         "kd_short": kd_position_column(3, s), "kd_long": kd_position_column(21, s)})
    return df.drop("_chg", "_tr", "_e12", "_e26", "_e10", "_atr")
