"""Buy and sell rules scored for every bar of every code in one pass.

All functions take the frame of :func:`indicators.indicator_panel` and add
columns.  Bars before ``MIN_BARS`` have no score.  Scores are sums of fixed
points; the points and limits are stated where they are used.

Several conditions compare *earlier* bars with *today's* limits (mean range,
reference volume, mean volume).  Where one limit is involved this is a rolling
maximum compared with the limit; where two are, only the few candidate bars of
the window (for example bars that rose more than 2 %) are kept in an array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from candlewick.functions.series import BARS, Series, ratio
from candlewick.operators.indicators import NUMBER
from candlewick.operators.split import OWN, SEGMENT

MIN_BARS = 60
FLAT_LIMIT_VOLUME = 10_000_000  # stands in for the volume of a flat limit-up bar
WIDE_BOARDS = ("300", "688", "301")  # boards with a 20 % daily limit


def points(cond: Column, value: float, otherwise: float = 0.0) -> Column:
    return F.when(cond, float(value)).otherwise(float(otherwise))


def total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def limit_factors(code: str = "ts_code") -> tuple[Column, Column]:
    wide = F.substring(code, 1, 3).isin(*WIDE_BOARDS)
    return F.when(wide, 1.2).otherwise(1.1), F.when(wide, 0.8).otherwise(0.9)


def limit_flags(df: DataFrame, s: Series = BARS, code: str = "ts_code") -> DataFrame:
    """limit_up, limit_down and flat variants, with 1 % tolerance."""
    up, down = limit_factors(code)
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    prev = F.col("prev_close") if "prev_close" in df.columns else F.coalesce(s.ref("close"), c)
    return df.withColumns({
        "limit_up": (c >= prev * up) & (c > o),
        "limit_down": (c <= prev * down * 1.01) & (c < o),
        "limit_up_flat": (o == c) & (c == h) & (c >= prev * up * 0.99),
        "limit_down_flat": (o == c) & (c == l) & (c <= prev * down * 1.01)})


def rule_columns(df: DataFrame, s: Series = BARS) -> DataFrame:
    """Per-bar facts the rules look back on (all share the panel's window)."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "vol"))
    n, chg, prev = F.col(NUMBER), F.col("chg_pct"), F.col("prev_close")
    has_prev = n >= 2
    df = limit_flags(df, s).withColumns({
        "_v1": s.ref("vol"), "_h1": s.ref("high"), "_chg1": s.ref("chg_pct"),
        "_mean30": s.mean("vol", 30), "_mean40": s.mean("vol", 40), "_mean60": s.mean("vol", 60),
        "_mean90": s.mean("vol", 90), "_top60": s.highest("vol", 60),
        "_difmax20": F.max("dif").over(s.between(-20, -1)), "_difmax15": F.max("dif").over(s.between(-15, -1)),
        "_hh4": s.highest("high", 4), "_hh60": s.highest("high", 60),
        "_c9": s.ref("close", 9), "_c10": s.ref("close", 10), "_c49": s.ref("close", 49), "_c50": s.ref("close", 50),
        "_high3": s.at_highest("high", 3, NUMBER, ["vol"], latest=False)})
    growth = F.coalesce(ratio(c, "_c10") - 1 > 0.1, F.lit(False)) | F.coalesce(ratio(c, "_c50") - 1 > 0.5, F.lit(False))
    hh20, ll20 = s.highest("high", 20), s.lowest("low", 20)
    return df.withColumns({
        "_adj_vol": F.when(F.col("limit_up_flat"), float(FLAT_LIMIT_VOLUME)).otherwise(v),
        "_div20": (n >= 21) & (F.col("dif") < F.col("_difmax20")),
        "_div15": (n >= 16) & (F.col("dif") < F.col("_difmax15")),
        "_burst": (v > F.col("_mean30") * 4) & (c > o),
        "_range20": ratio((hh20 - ll20) * 100, ll20),
        "_gap": F.when(has_prev & (c >= o) & (l > F.col("_h1")), ratio(l - prev, prev, 0)),
        "_doji": has_prev & (c == o) & ((c != prev * 1.1) | (c <= prev)),
        "_late_rise": (n >= 3) & (c > o) & (chg > F.col("_chg1") * 0.9) & (v < F.col("_v1") * 0.8),
        "_second_high": (n >= 61) & (F.col("_hh4") == F.col("_hh60")) & (h != F.col("_hh60")) & (c < o) & growth,
        "_up_vol": F.when(c > o, v).otherwise(0.0), "_down_vol": F.when(c < o, v).otherwise(0.0),
        "_rise_vol": F.when(has_prev & (chg > 4), v),
        "_rise": F.when(has_prev & (c > o) & (chg > 2), F.struct(n.alias("n"), chg.alias("chg"), v.alias("v"))),
        "_fall": F.when(has_prev & (c < o) & (F.abs(chg) > 2), F.struct(
            F.abs(chg).alias("chg"), v.alias("v"), F.col("_v1").alias("v1")))})


def _peaks(df: DataFrame, spans, s: Series) -> DataFrame:
    """Columns _peak<days>: the latest volume peak of the span."""
    return df.withColumns({f"_peak{d}": s.at_highest("vol", d, NUMBER, ["open", "close"]) for d in spans})


def _peak(days: int) -> tuple[Column, Column, Column]:
    """(older than today and closed up, closed down, older than today)."""
    p = F.col(f"_peak{days}")
    older = p["at"] < F.col(NUMBER)
    return older & (p["close"] > p["open"]), older & (p["close"] < p["open"]), older


def _rose_in(days: int) -> Column:
    """A key bar by today's limits among the last ``days`` bars."""
    floor = F.greatest(F.col("ref_vol") * 1.8, F.col("_mean40"))
    return F.exists("_rises30", lambda x: (x["n"] > F.col(NUMBER) - days)
                    & (x["chg"] > F.col("range30_pct") * 1.5) & (x["v"] > floor))


def _pullback_from_peak(s: Series) -> Column:
    """After a J peak within 15 bars: price stayed within 3 % and a 12 % range.

    J is smoothed from yesterday backwards over 20 bars; the bar next to the
    peak on its newer side must be above 95.
    """
    path = F.aggregate(
        F.reverse("_rsv_back"), F.struct(F.lit(None).cast("double").alias("k"), F.lit(None).cast("double").alias("d"),
                                         F.array().cast("array<double>").alias("js")),
        lambda acc, x: F.struct(
            F.coalesce(acc["k"] * (2 / 3) + x / 3, x).alias("k"),
            F.coalesce(acc["d"] * (2 / 3) + F.coalesce(acc["k"] * (2 / 3) + x / 3, x) / 3, x).alias("d"),
            F.array_append(acc["js"], 3 * F.coalesce(acc["k"] * (2 / 3) + x / 3, x) - 2 * F.coalesce(
                acc["d"] * (2 / 3) + F.coalesce(acc["k"] * (2 / 3) + x / 3, x) / 3, x)).alias("js")),
        lambda acc: acc["js"])
    return path


def b1_score(df: DataFrame, s: Series = BARS, out: str = "score_b1") -> DataFrame:
    """Pull-back buy score: the sum of 39 conditions."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "vol"))
    n, chg, amp = F.col(NUMBER), F.col("chg_pct"), F.col("amp_pct")
    fast, slow = F.col("trend_fast"), F.col("trend_slow")
    calm = chg.between(-2, 1.8)
    df = _peaks(df, (60, 30, 25, 20, 15, 10), s)
    df = df.withColumns({
        "_rises30": F.collect_list("_rise").over(s.last(30)), "_falls10": F.collect_list("_fall").over(s.last(10)),
        "_rsv_back": F.collect_list("_rsv9").over(s.between(-20, -1)),
        "_recent": F.collect_list(F.struct(h.alias("h"), l.alias("l"), c.alias("c"))).over(s.last(16)),
        "_burst_points": F.least(F.sum(F.col("_burst").cast("int")).over(s.between(-19, -1)) * 0.5, F.lit(1.4)),
        "_spread": F.max("_range20").over(s.between(-20, -1)),
        "_gap20": F.max("_gap").over(s.last(20)),
        "_slow_mean": (s.ref(slow, 15) + s.ref(slow, 30) + s.ref(slow, 45) + s.ref(slow, 60)) / 4,
        "_high30": s.at_highest("high", 30, NUMBER, ["_div20", "_div15"])})
    df = df.withColumn("_js", _pullback_from_peak(s))
    # places 6..20 of the path; of equal peaks the newest
    top = F.array_max(F.transform(F.sequence(F.lit(6), F.lit(20)),
                                  lambda i: F.struct(F.element_at("_js", i).alias("j"), (-i).alias("at"))))
    df = df.withColumn("_peak_at", F.when(F.size("_js") >= 20, -top.getField("at")))
    away = F.lit(21) - F.col("_peak_at")  # 1..15 bars ago
    df = df.withColumns({"_since": F.slice("_recent", F.lit(16) - away, away + 1),
                         "_old_close": F.element_at("_recent", F.lit(16) - away)["c"]})
    span = (F.array_max(F.transform("_since", lambda x: x["h"])) - F.array_min(F.transform("_since", lambda x: x["l"])))
    pulled_back = F.coalesce(
        (F.element_at("_js", F.col("_peak_at") - 1) > 95)
        & (F.abs((c - F.col("_old_close")) / F.col("_old_close") * 100) <= 3)
        & (span / F.col("_old_close") * 100 < 12), F.lit(False))

    up = {d: s.sum("_up_vol", d) for d in (20, 30, 40, 50)}
    down = {d: s.sum("_down_vol", d) for d in (20, 30, 40, 50)}
    signed = {d: F.sum(F.when(c > o, v).otherwise(-v)).over(s.last(d)) for d in (50, 40, 30, 20)}
    low_gap, from_top = F.abs(l - slow), F.abs(c - s.highest("high", 10))
    off_fast, off_slow = ratio(c - fast, fast), ratio(c - slow, slow)
    steady = calm & (amp < 4)
    c18 = F.when(fast == 0, 0.0).otherwise(points((off_fast > -0.015) & (off_fast <= 0.023) & steady, 1.5, -0.5))
    main_board = F.substring("ts_code", 1, 2).isin("60", "00")
    c19 = points((c18 <= 0) & ~main_board & (off_fast > -0.015) & (off_fast <= 0.03) & steady, 2)
    c20 = points((c18 <= 0) & (c19 == 0) & (off_slow <= 0.025) & steady, 0.6)
    c21 = points((c18 <= 0) & (c19 == 0) & (c20 == 0) & (c < fast) & (c > slow), -1.5)
    high30 = F.col("_high30")
    past_high = high30.getField("at") < n
    burst = F.col("_burst_points")
    drift = F.when(n >= 114, ratio(slow - F.col("_slow_mean"), "_slow_mean", 0)).otherwise(0.0)
    flat = F.sum(((c == o) & (c == h) & (n >= 2)).cast("int")).over(s.last(20))
    doji = s.count_if("_doji", 60)
    fall_floor = F.greatest(F.col("_mean60"), F.col("_top60") / 1.95)
    v1, v2, v3 = (s.ref("vol", k) for k in (1, 2, 3))
    shrinking = (v < v * 1.1) & (v < v1 * 1.1) & (v1 < v2 * 1.1) & (v2 < v3 * 1.1)
    four_down = s.count_if(c < o, 4) == 4
    second = F.min(F.when(F.col("_second_high"), F.col("_high3")["vol"])).over(s.last(10)) * 0.8

    def fell(times: float) -> Column:
        return F.exists("_falls10", lambda x: (x["chg"] > F.col("range30_pct") * 1.1)
                        & (x["v"] > x["v1"] * times) & (x["v"] > fall_floor))

    terms = [
        points(F.col("dif") >= 0, 0.6), points(c > F.col("ma60"), 0.3), points(calm, 1.5, -3),
        points(amp < 7, 0.5, -1), points(amp < 4, 0.8),
        points(F.col("rsi1") < 20, 0.8), points(F.col("rsi1") < 23, 0.7),
        points((fast > c) & (c > slow), 1.3), points(c < slow, -3), points(c * 1.003 < slow, -3),
        # dry volume
        *[points(v == s.lowest("_adj_vol", d), 0.3) for d in (30, 26, 24, 22, 20, 18, 16, 14, 12, 10)],
        points(v == s.lowest("vol", 18), 0.5),
        # the bar of the volume peak
        *[points(_peak(d)[0], p) for d, p in ((60, 1), (30, 0.5), (20, 0.4), (10, 0.3))],
        *[points(_peak(d)[1], p) for d, p in ((60, -0.5), (30, -0.5), (25, -0.5), (20, -0.6), (15, -0.7), (10, -0.8))],
        # volume of rising and of falling bars
        *[points(signed[d] > 0, 0.4) for d in (50, 40, 30, 20)],
        *[points(up[30] > k * down[30], p) for k, p in ((1.25, 0.4), (1.5, 0.5), (2, 0.6))],
        *[points(down[d] > up[d], -0.4) for d in (50, 40, 30, 20)],
        points(F.col("bbi") > F.col("bbi_20_ago"), 0.5),
        points(low_gap * 2.5 > from_top, -1), points(low_gap * 3 > from_top, -1),
        c18, c19, c20, c21,
        # lower DIF at the price high than before it
        points(past_high & high30.getField("_div20"), -0.5), points(past_high & high30.getField("_div15"), -0.5),
        burst,
        *[points(F.col("_spread") > k, p) for k, p in ((60, -0.8), (70, -0.7), (80, -0.6), (90, -0.5), (100, -0.4))],
        points(F.col("_gap20") > F.least(F.lit(0.032), F.col("range30_pct") * 0.01), -1.2),
        points((F.col("_gap20") > F.least(F.lit(0.032), F.col("range30_pct") * 0.01)) & (burst > 0), -1),
        F.when(burst == 0, F.when(drift < 0.05, -1.0).when(drift < 0.075, -0.8).when(drift < 0.1, -0.5)
               .otherwise(0.0)).otherwise(0.0),
        points(up[20] > F.sum("_up_vol").over(s.between(-40, -21)), 0.5, -1),
        points((n >= 114) & (fast < s.ref(fast)) & (slow < s.ref(slow)), -2),
        points(doji > 2, -1.5),
        points(pulled_back, 2.8),
        points(shrinking & four_down, -1),
        points(_rose_in(20), 1),
        points(s.count_if("_late_rise", 20) >= 2, -1),
        *[points(fell(k), p) for k, p in ((1.2, -1), (1.4, -0.6), (1.6, -0.5), (1.8, -0.4), (2.0, -0.4))],
        points((F.col("rsi2") > F.col("rsi3")) & (F.col("rsi3") > F.col("rsi4")), 1),
        points(flat >= 1, -1), points(flat >= 2, -1.5),
        points(((v > F.col("vol_ma5")) | (v > F.col("vol_ma10"))) & (v >= second), -1),
        points(~(((n >= 90) & F.coalesce(s.highest("_up_vol", 30) > F.col("_mean90") * 1.4, F.lit(False)))
                 | _rose_in(30)
                 | F.coalesce(s.highest("_rise_vol", 30) > F.greatest(F.col("ref_vol") * 1.8, F.col("_mean60")), F.lit(False))), -2),
    ]
    df = df.withColumn(out, F.when(n >= MIN_BARS, F.round(total(terms), 6)))
    return df.drop("_rises30", "_falls10", "_rsv_back", "_recent", "_burst_points", "_spread", "_gap20",
                   "_slow_mean", "_high30", "_js", "_peak_at", "_since", "_old_close",
                   *[f"_peak{d}" for d in (60, 30, 25, 20, 15, 10)])


def _rsi_few(k: int, at: int, s: Series, no_loss: float | None) -> Column:
    """RSI of the k changes that end ``at`` bars ago, from plain means."""
    frame = s.between(-(at + k - 1), -at)
    gain = F.avg(F.greatest(F.col("_d"), F.lit(0.0))).over(frame)
    loss = F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(frame)
    if no_loss is None:
        return F.when(loss > 0, 100 - 100 / (1 + ratio(gain, loss))).when(gain > 0, 100.0)
    return 100 - 100 / (1 + gain / F.when(loss != 0, loss).otherwise(no_loss))


def b2_score(df: DataFrame, s: Series = BARS, out: str = "score_b2") -> DataFrame:
    """Breakout score: 0 unless triggered.

    Items of the rule that cannot fire under its own trigger (they need a
    falling bar, a volume low, or today's volume above itself) add nothing and
    are left out.
    """
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "vol"))
    n = F.col(NUMBER)
    df = df.withColumn("_d", s.change("close"))
    df = df.withColumn("_r3", _rsi_few(3, 0, s, 0.001))
    low10, high10 = s.lowest("low", 10), s.highest("high", 10)
    raw_prev = ratio((F.col("prev_close") - low10) * 100, high10 - low10, 50)
    trigger = (((raw_prev <= 21) | F.coalesce(_rsi_few(3, 1, s, None) <= 21, F.lit(False))) & (v > s.ref("vol"))
               & (F.col("chg_pct") > 3.95) & (v > F.col("vol_ma60")) & (c > o))
    pivot = (F.sum("_r3").over(s.between(-25, -3)) + _rsi_few(2, 2, s, 0.001) + _rsi_few(1, 1, s, 0.001)) / 25
    df = df.withColumns({"_trigger": trigger, "_pivot": pivot, "_high30": s.at_highest("high", 30, NUMBER, ["_div20", "_div15"])})
    df = _peaks(df, (60, 50, 40, 30, 20, 10), s)
    bar, upper, lower = h - l, F.col("upper_shadow"), F.col("lower_shadow")
    j, k, d = F.col("j"), F.col("k"), F.col("d")
    up40, down40 = s.sum("_up_vol", 40), s.sum("_down_vol", 40)
    high30 = F.col("_high30")
    past_high = high30.getField("at") < n
    terms = [
        points(j > 80, -3), points(j > 65, -0.8), points(j > 55, -0.8), points(F.col("dif") >= 0, 0.3),
        points(reduce(lambda a, b: a & b, [F.col(m) > s.ref(m) for m in ("ma10", "ma20", "ma50")]), 0.6),
        points(c > F.col("trend_slow"), 0.3), points(~((j < k) & (j < d)), 0.3), points(c > F.col("bbi"), 0.4),
        points(F.col("rsi1") > F.col("_pivot"), 0.5), points(F.col("rsi1") > F.col("_pivot") - 5, 0.3),
        points((bar > 0) & (upper <= bar / 4), 1.5), points((bar > 0) & (upper >= bar / 4), -1),
        points((bar > 0) & (upper >= bar / 2), -1),
        points((bar > 0) & (upper <= bar / 4) & (lower <= bar / 4), 1.2),
        *[points(v > f * F.col("vol_ma60"), p) for f, p in ((1, 0.4), (1.25, 0.6), (1.5, 0.8))],
        *[points((n >= days) & (c >= s.highest("close", days)), 0.7) for days in (90, 60, 30)],
        points(up40 > down40, 0.3), points(up40 >= 1.25 * down40, 0.4), points(up40 >= 1.5 * down40, 0.5),
        points(s.highest("_up_vol", 20) > s.highest("_down_vol", 20), 0.5),
        points(past_high & high30.getField("_div20"), -0.3), points(past_high & high30.getField("_div15"), -0.3),
        *[points(_peak(days)[0], 0.3) for days in (60, 50, 40)],
        *[F.when(_peak(days)[0], 0.3).when(_peak(days)[2], -2.5).otherwise(0.0) for days in (30, 20, 10)],
        F.lit(0.3),
        points((F.col("rsi2") > F.col("rsi3")) & (F.col("rsi3") > F.col("rsi4")), 0.7),
        *[points(v >= s.highest("vol", days), 0.5) for days in (60, 50, 40, 30)],
        points((j > s.ref("_rsv9", 1)) & (s.ref("_rsv9", 1) < s.ref("_rsv9", 2)), 0.5),
        *[points(v < s.highest("vol", days), -0.3) for days in (13, 12, 11)],
        points(s.count_if("_doji", 60) > 2, -1.5),
    ]
    score = F.when(n >= MIN_BARS, F.when(F.col("_trigger"), F.round(total(terms), 6)).otherwise(0.0))
    return df.withColumn(out, score).drop("_d", "_r3", "_trigger", "_pivot", "_high30")


def surge_columns(df: DataFrame, s: Series = BARS) -> DataFrame:
    """surge (breakout bar after a quiet stretch), surge_scb (its stricter form),
    and the J turn."""
    from candlewick.operators.indicators import j_turns_up_column
    h, l, v, n = F.col("high"), F.col("low"), F.col("vol"), F.col(NUMBER)
    prev, upper = F.col("prev_close"), F.col("upper_shadow")

    def quiet(bars: int, needs: int) -> Column:
        first = s.ref("open", bars)
        return (n < needs) | F.coalesce(ratio((prev - first) * 100, first) < 4, F.lit(True))

    core = ((F.col("close") > prev) & (v > F.col("ref_vol") * 1.8) & (F.col("chg_pct") > 4)
            & (upper <= (h - l) / 3.5) & (v > F.col("vol_ma60")) & (n >= 2))
    return df.withColumns({
        "surge": core & (h > l) & quiet(8, 10) & quiet(3, 5),
        "surge_scb": core & quiet(15, 16) & quiet(9, 10) & quiet(4, 5),
        "j_turns_up": j_turns_up_column(s)})


def dry_volume(df: DataFrame, s: Series = BARS) -> DataFrame:
    """dry_level (0/10/21/31/41) and dry_base, the base for a later surge.

    dry_base judges a bar against the bars before it.
    """
    v, n = F.col("vol"), F.col(NUMBER)
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    at_limit = F.col("limit_up") | F.col("limit_down") | F.col("limit_up_flat") | F.col("limit_down_flat")

    def is_low(days: int) -> Column:
        return (n >= days) & (v * 0.9 <= s.lowest("vol", days))

    level = F.when(at_limit, 0)
    for days in (41, 31, 21, 10):
        level = level.when(is_low(days), days)
    from candlewick.operators.indicators import true_range_column
    twice = F.coalesce(v > F.col("_v1") * 1.8, F.lit(False))
    df = df.withColumns({
        "dry_level": level.otherwise(0),
        "_tr": true_range_column(s),
        "_jump": F.when(twice & (c > o) & (F.col("chg_pct") > 2), F.struct((c - F.col("prev_close")).alias("dc"), v.alias("v"))),
        "_jump_vol": F.when(twice & (F.col("chg_pct") > 4) & (F.col("upper_shadow") <= (h - l) / 4), v),
        "_active": F.when((n >= 2) & (c > o), v)})
    before = s.between(-31, -1)
    df = df.withColumns({
        "_range": F.avg("_tr").over(s.between(-30, -1)),
        "_m40": F.avg("vol").over(s.between(-40, -1)), "_m60": F.avg("vol").over(s.between(-60, -1)),
        "_jumps": F.collect_list("_jump").over(s.between(-60, -2)),
        "_peak": s.at_highest("vol", 60, NUMBER, ["open", "close"], latest=False, start=-60, end=-1)})
    jumped = F.exists("_jumps", lambda x: (x["dc"] > F.col("_range") * 1.5) & (x["v"] > F.col("_m40")))
    surged = F.coalesce(F.max("_jump_vol").over(s.between(-60, -2)) > F.col("_m60"), F.lit(False))
    peak = F.col("_peak")
    base = (~at_limit & (n > 31) & (v * 0.9 <= F.min("vol").over(before)) & (v > 0)
            & ((n <= 60) | (peak.getField("close") >= peak.getField("open")))
            & (jumped | surged)
            & F.coalesce(F.max("_active").over(s.between(-80, -1)) > F.col("_m60") * 2, F.lit(False)))
    df = df.withColumn("dry_base", F.coalesce(base, F.lit(False)))
    return df.drop("_tr", "_jump", "_jump_vol", "_active", "_range", "_m40", "_m60", "_jumps", "_peak")


def dry_then_surge(df: DataFrame, s: Series = BARS) -> DataFrame:
    """score_scb and signal_buy_scb from dry_base, surge_scb and the slow line."""
    based = F.coalesce(F.max("dry_base").over(s.between(-5, -1)), F.lit(False))
    rising = F.coalesce((F.col(NUMBER) >= 114) & (F.col("trend_slow") > s.ref("trend_slow", 60)), F.lit(False))
    surge = F.col("surge_scb")
    score = (F.when(based & surge & rising, 10.0).when(based & surge, 7.0).when(based & rising, 4.0)
             .when(surge & rising, 5.0).when(based, 2.0).when(surge, 3.0).otherwise(0.0))
    ready = F.col(NUMBER) >= MIN_BARS
    return df.withColumns({"score_scb": F.when(ready, score),
                           "signal_buy_scb": ready & based & surge & rising})


def pin30(df: DataFrame, s: Series = BARS) -> DataFrame:
    """A dip inside an uptrend: long position >= 80, short position <= 30."""
    peak = s.at_highest("vol", 18, NUMBER, ["open", "close"], latest=False, start=-18, end=-1)
    buy = ((F.col("kd_long") >= 80) & (F.col("kd_short") <= 30) & (F.col("close") > F.col("trend_fast"))
           & (F.col("trend_fast") > F.col("trend_slow")) & s.exists("double_vol_bar", 20)
           & (peak.getField("close") >= peak.getField("open")) & (F.col(NUMBER) >= MIN_BARS))
    buy = F.coalesce(buy, F.lit(False))
    return df.withColumns({"signal_buy_dz30": buy, "score_dz30": points(buy, 5)})


def s1_score(df: DataFrame, s: Series = BARS, out: str = "score_s1") -> DataFrame:
    """Sell score; 0 before 60 bars."""
    o, h, c, v = (F.col(x) for x in ("open", "high", "close", "vol"))
    top, hh60 = F.col("_top60"), F.col("_hh60")
    first = (c < o) & (h == hh60) & ((ratio(c, "_c9") - 1 > 0.1) | (ratio(c, "_c49") - 1 > 0.5))
    on_volume = F.when(v >= top, 10.0).when(v * 1.1 >= top, 8.0).when(v * 1.25 >= top, 7.5).when(v * 1.42 >= top, 6.5).otherwise(0.0)
    second = ((F.col("_hh4") == hh60) & (h != hh60) & ((v > F.col("vol_ma5")) | (v > F.col("vol_ma10")))
              & (F.col("chg_pct") < -0.03) & (c < o) & (v >= s.ref("vol", 2) * 1.2))
    score = (F.when(first, on_volume + 1.5).otherwise(0.0) + points(second, 12)
             + points((F.col("j") < F.col("k")) & (F.col("k") < F.col("d")), 0.8))
    return df.withColumn(out, F.when(F.col(NUMBER) >= MIN_BARS, F.round(score, 6)).otherwise(0.0))


def line_break(df: DataFrame, s: Series = BARS) -> DataFrame:
    """observing: first close under the slow line; break_slow: a second one the
    bar after.  The state of a bar needs only the bar before it."""
    c, slow = F.col("close"), F.col("trend_slow")
    prev = s.ref("close")
    df = df.withColumn("observing", F.coalesce((c < slow) & (prev >= slow), F.lit(False)))
    broke = (c < slow) & (prev < slow) & s.ref("observing")
    return df.withColumn("break_slow", F.coalesce(broke, F.lit(False)))


def sell_flags(df: DataFrame, s: Series = BARS) -> DataFrame:
    df = line_break(df, s)
    score = F.col("score_s1")
    return df.withColumns({"signal_s1_half": (score >= 5) & (score < 10), "signal_s1_full": score >= 10})


def simple_buy_score(df: DataFrame, out: str = "score_simple") -> DataFrame:
    return df.withColumn(out, points(F.col("j") < 13, 2) + points(F.col("dif") > 0, 1) + points(F.col("rsi1") < 50, 2)
                         + points(F.col("vol") > F.col("vol_ma60"), 2) + points(F.col("chg_pct") > 1, 1))


def buy_signals(df: DataFrame, b1_threshold: float = 8, b2_threshold: float = 8) -> DataFrame:
    """Buy flags of the pull-back, breakout, surge and surge-breakout rules."""
    trend, macd_up = F.col("trend_fast") > F.col("trend_slow"), F.col("dif") >= 0
    ready = F.col(NUMBER) >= MIN_BARS
    df = df.withColumns({
        "signal_buy_b1": F.coalesce((F.col("j") < 13) & macd_up & trend & (F.col("score_b1") >= b1_threshold), F.lit(False)),
        "signal_buy_b2": F.coalesce(macd_up & trend & (F.col("score_b2") >= b2_threshold), F.lit(False)),
        "signal_buy_blk": ready & trend & F.col("surge")})
    both = F.col("signal_buy_b2") & F.col("surge") & F.col("double_vol_bar") & F.col("j_turns_up")
    return df.withColumns({
        "score_blk": points(F.col("signal_buy_blk"), 7), "signal_buy_blkb2": both,
        "score_blkb2": F.when(both, F.round(7 * 0.5 + F.col("score_b2") * 0.6 + 10 * 0.2 + 10 * 0.1, 6)).otherwise(0.0)})


def signal_panel(indicators: DataFrame, s: Series = BARS) -> DataFrame:
    """All scores and flags of the daily signal table, for every bar."""
    df = rule_columns(indicators, s)
    df = b1_score(df, s)
    df = b2_score(df, s)
    df = dry_volume(surge_columns(df, s), s)
    df = dry_then_surge(df, s)
    df = sell_flags(s1_score(pin30(df, s), s), s)
    df = buy_signals(simple_buy_score(df))
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in (SEGMENT, OWN)])


HISTORY = {  # signal name -> (score column, sign)
    "b1": ("score_b1", 1), "b2": ("score_b2", 1), "blk": ("score_blk", 1), "blkb2": ("score_blkb2", 1),
    "dz30": ("score_dz30", 1), "s1": ("score_s1", -1), "scb": ("score_scb", 1)}


def signal_history(panel: DataFrame, name: str, min_rows: int = MIN_BARS) -> DataFrame:
    """One rule as a signal series: null before ``min_rows`` bars; sells negative."""
    column, sign = HISTORY[name]
    value = F.when(F.col(NUMBER) >= min_rows, F.col(column) * sign)
    return panel.select("ts_code", "trade_date", value.alias("signal"))


def signal_series(panel: DataFrame, min_rows: dict[str, int] | None = None, blk_value: float = 7.0, dz30_value: float = 5.0,
                  b2_threshold: float = 8.0, weights: tuple[float, float, float, float] = (0.5, 0.6, 0.2, 0.1)) -> DataFrame:
    """All seven rules as signal series in one pass: ``signal_b1`` .. ``signal_scb``,
    null before a series' ``min_rows`` bars (120, for s1 60), sells negative.

    ``panel`` is a :func:`signal_panel`.  ``weights`` are those of the surge, the
    breakout score, the double volume and the J turn in the combined series.
    """
    blk, b2, double, turn = weights
    gate = (F.col("dif") >= 0) & (F.col("trend_fast") > F.col("trend_slow")) & (F.col("score_b2") >= b2_threshold)
    combined = F.round(F.lit(7.0 * blk) + F.col("score_b2") * b2 + 10.0 * double + 10.0 * turn, 6)
    values = {
        "b1": F.col("score_b1"), "b2": F.col("score_b2"), "blk": points(F.col("surge"), blk_value),
        "blkb2": F.when(gate & F.col("surge") & F.col("double_vol_bar") & F.col("j_turns_up"), combined).otherwise(0.0),
        "dz30": points(F.col("signal_buy_dz30"), dz30_value), "s1": -F.col("score_s1"), "scb": F.col("score_scb")}
    wanted = {name: 60 if name == "s1" else 120 for name in values} | (min_rows or {})
    return panel.select("ts_code", "trade_date", *[
        F.when(F.col(NUMBER) >= wanted[name], value.cast("double") + 0.0).alias(f"signal_{name}") for name, value in values.items()])


def signal_events(panel: DataFrame) -> DataFrame:
    """The fired signals in long form: (date, code, abbreviation, type, score)."""
    kinds = [("B1", "buy", "signal_buy_b1", "score_b1"), ("B2", "buy", "signal_buy_b2", "score_b2"),
             ("BLK", "buy", "signal_buy_blk", "score_blk"), ("BLKB2", "buy", "signal_buy_blkb2", "score_blkb2"),
             ("SCB", "buy", "signal_buy_scb", "score_scb"), ("DZ30", "buy", "signal_buy_dz30", "score_dz30"),
             ("S1", "sell", "signal_s1_full", "score_s1"), ("S1H", "sell", "signal_s1_half", "score_s1"),
             ("LINE", "sell", "break_slow", None)]
    events = F.filter(F.array(*[F.when(F.col(flag), F.struct(
        F.lit(abbrev).alias("signal_abbrev"), F.lit(kind).alias("signal_type"),
        (F.col(score) if score else F.lit(None)).cast("double").alias("score"))) for abbrev, kind, flag, score in kinds]),
        lambda e: e.isNotNull())
    return panel.select("trade_date", "ts_code", F.explode(events).alias("e")).select("trade_date", "ts_code", "e.*")
