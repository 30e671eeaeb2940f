"""Cross-sectional factor work: one group is the codes of one date.

A cross-section holds one row per code, so windows by date are bounded by the
number of instruments; pooled statistics over all dates go through
:mod:`candlewick.operators.ranks` instead.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.functions.series import BARS, Series, ratio
from candlewick.operators.ranks import grouped_quantiles, row_numbers, spearman, value_positions
from candlewick.operators.reports import year_by_month
from candlewick.session import cut, small

DATE = "trade_date"
CODE = "ts_code"
def by_date():
    return Window.partitionBy(DATE)



def future_return(df: DataFrame, period: int = 1, ret: str = "ret", out: str = "future_return",
                  s: Series = BARS) -> DataFrame:
    """The bar return ``period`` bars ahead."""
    return df.withColumn(out, s.ahead(ret, period))


def forward_returns(df: DataFrame, horizons: list[int], price: str = "close", s: Series = BARS) -> DataFrame:
    """close[t+h]/close[t] - 1 as ret_t<h>."""
    return df.withColumns({f"ret_t{h}": ratio(s.ahead(price, h), price) - 1 for h in horizons})


def long_horizons(df: DataFrame, horizons: list[int], keep: list[str]) -> DataFrame:
    """ret_t<h> columns as rows (horizon, ret)."""
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ret_t{h}").alias("ret")) for h in horizons])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.horizon", "p.ret")


# -- outliers, scores, selection --------------------------------------------

def per_date(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows with the statistics of their date.  ``stats`` has a row per date; it is
    written down first, so that its true size decides on how it is joined."""
    return df.join(small(cut(stats)), DATE, "left")


def winsorize_mad(df: DataFrame, factors: list[str], n: float = 3.0) -> DataFrame:
    """Clip each factor to median +- n * 1.4826 * MAD of its date.

    Medians and deviations of all factors together, by ranges of values
    (:func:`candlewick.operators.ranks.grouped_quantiles`): no task holds a date."""
    df = cut(df)
    middle = grouped_quantiles(df, [DATE], factors, [0.5])
    df = per_date(df, middle.select(DATE, *[F.col(f"{f}_q")[0].alias(f"_med_{f}") for f in factors]))
    away = df.select(DATE, *[F.abs(F.col(f) - F.col(f"_med_{f}")).alias(f) for f in factors])
    spread = grouped_quantiles(away, [DATE], factors, [0.5])
    df = per_date(df, spread.select(DATE, *[F.col(f"{f}_q")[0].alias(f"_mad_{f}") for f in factors]))
    width = {f: F.col(f"_mad_{f}") * (n * 1.4826) for f in factors}
    df = df.withColumns({f: F.when(F.col(f).isNotNull(), F.greatest(
        F.least(F.col(f), F.col(f"_med_{f}") + width[f]), F.col(f"_med_{f}") - width[f])) for f in factors})
    return df.drop(*[f"_med_{f}" for f in factors], *[f"_mad_{f}" for f in factors])


def zscore(df: DataFrame, factors: list[str]) -> DataFrame:
    stats = df.groupBy(DATE).agg(*[e for f in factors for e in (F.avg(f).alias(f"_avg_{f}"), F.stddev_samp(f).alias(f"_std_{f}"))])
    df = per_date(df, stats).withColumns({f: ratio(F.col(f) - F.col(f"_avg_{f}"), f"_std_{f}") for f in factors})
    return df.drop(*[f"_{x}_{f}" for x in ("avg", "std") for f in factors])


def composite_score(df: DataFrame, weights: dict[str, float], directions: dict[str, int] | None = None,
                    out: str = "score") -> DataFrame:
    """Weighted sum of winsorised z-scores; a missing factor adds nothing."""
    directions = directions or {}
    names = list(weights)
    scored = zscore(winsorize_mad(df, names), names)
    terms = [F.coalesce(F.col(f) * float(weights[f] * directions.get(f, 1)), F.lit(0.0)) for f in names]
    return scored.withColumn(out, reduce(lambda a, b: a + b, terms))


def top_per_date(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n largest per date, codes in order on ties.

    The constant limit lets every map task keep only its own n best rows before
    the exchange.
    """
    order = by_date().orderBy(F.col(by).desc_nulls_last(), CODE)
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def top_share_per_date(df: DataFrame, by: str, share: float, min_names: int = 5) -> DataFrame:
    """The best max(1, int(count * share)) codes of each date with enough names."""
    placed = row_numbers(df.filter(F.col(by).isNotNull()), [DATE], [F.col(by).desc(), F.col(CODE)])
    wanted = F.greatest(F.lit(1), F.floor(F.col("n_all") * share))
    return placed.filter((F.col("n_all") >= min_names) & (F.col("place") <= wanted)).drop("n_all")


def industry_neutral(df: DataFrame, score: str, n: int, industry: str = "industry") -> DataFrame:
    """Quota max(1, int(n * share of the date's names)) per industry, best scores
    first; industries by size, n names in all.

    No quota is over ``n``: the constant limit lets every map task keep its n best of
    a date and industry, and windows by date see industries or quotas only."""
    best = Window.partitionBy(DATE, industry).orderBy(F.col(score).desc(), CODE)
    top = df.withColumn("_in", F.row_number().over(best)).filter(F.col("_in") <= max(n, 1))
    sizes = df.groupBy(DATE, industry).agg(F.count(F.lit(1)).alias("_names"))
    sizes = sizes.select(DATE, F.col(industry).alias("_industry"), (F.col("_names") / F.sum("_names").over(by_date())).alias("_share"))
    same = (top[DATE] == sizes[DATE]) & top[industry].eqNullSafe(sizes["_industry"])
    rows = top.join(sizes.drop("_n"), same).drop(sizes[DATE]).drop("_industry").filter(F.col("_in") <= F.greatest(F.lit(1), F.floor(F.col("_share") * n)))
    order = by_date().orderBy(F.col("_share").desc(), industry, "_in")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("_share", "_in")


def bucket_column(factor: str, edges: str) -> Column:
    """1..q by edges, right-closed."""
    return F.size(F.filter(edges, lambda e: e < F.col(factor))) + 1


def quantile_buckets(df: DataFrame, factor: str, q: int, min_names: int = 0, out: str = "quantile") -> DataFrame:
    """1..q by the date's linear quantile edges, right-closed."""
    df = cut(df)
    edges = grouped_quantiles(df, [DATE], [factor], [i / q for i in range(1, q)])
    edges = edges.filter(F.col(f"{factor}_n") >= min_names).select(DATE, F.col(f"{factor}_q").alias("_edges"))
    return df.join(small(cut(edges)), DATE).withColumn(out, bucket_column(factor, "_edges")).drop("_edges")


def correlation(x, y) -> Column:
    """Pearson correlation of the pairs present; null where one side is constant
    (the built-in ``corr`` fails on that in ANSI mode)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


# -- factor evaluation ------------------------------------------------------

EXACT_DEGREES = 200  # up to here the p-value is a finite series, of 100 terms at most


def _normal_tails(z: Column) -> Column:
    """P(|Z| > z) of a standard normal Z: a fitted polynomial, relative error under 1.2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    # fixed values: coefficients of the fit, from the highest power down
    fit = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + c
    return t * F.exp(fit - x * x)


def two_sided_p(r: Column, n: Column) -> Column:
    """p-value of a correlation of n pairs: Student t with n-2 degrees of freedom.

    Up to ``EXACT_DEGREES`` by the finite series for whole degrees of freedom, beyond by
    a normal deviate of the same tail (an expansion in 1 / degrees; relative error
    under 2e-7): time and memory do not depend on n.
    """
    nu = (n - 2).cast("double")
    few = F.least(nu, F.lit(float(EXACT_DEGREES))).cast("int")
    t = F.abs(r) * F.sqrt(ratio(nu, 1 - r * r))
    angle = F.atan(t / F.sqrt(nu))
    cos, sin = F.cos(angle), F.sin(angle)
    even = (few % 2) == 0
    terms = F.when(even, few / 2 - 1).otherwise((few - 3) / 2).cast("int")
    start = F.when(even, F.lit(1.0)).otherwise(cos)

    def add(acc, i):
        up = F.when(even, (2 * i - 1) / (2 * i)).otherwise(2 * i / (2 * i + 1))
        term = acc["term"] * up * cos * cos
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(steps, F.struct(start.alias("term"), start.alias("sum")), add, lambda a: a["sum"])
    inside = (F.when(even, sin * series)
              .when(nu == 1, angle * 2 / math.pi)
              .otherwise((angle + sin * series) * 2 / math.pi))
    a = nu - 0.5
    b, y = 48 * a * a, a * F.log1p(t * t / nu)
    z = (((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b + 1) * F.sqrt(y)
    p = F.when(nu <= EXACT_DEGREES, 1 - inside).otherwise(_normal_tails(z))
    return F.when(nu >= 1, F.when(F.abs(r) >= 1, 0.0).otherwise(p))


def daily_ic(df: DataFrame, factor: str, target: str = "future_return", method: str = "pearson",
             min_names: int = 10, groups: list[str] | None = None) -> DataFrame:
    """Correlation of factor and target per date: ic, sample_size, p_value.

    Ranks (``spearman``) come from range partitions, so a date of any size is spread."""
    keys = [DATE, *(groups or [])]
    valid = df.filter(F.col(factor).isNotNull() & F.col(target).isNotNull())
    if method == "spearman":
        ranked = cut(valid.select(*keys, F.col(factor).alias("_x"), F.col(target).alias("_y")))
        out = spearman(ranked, keys, "_x", "_y").withColumnRenamed("n_obs", "sample_size")
    else:
        out = valid.groupBy(*keys).agg(correlation(factor, target).alias("ic"), F.count(F.lit(1)).alias("sample_size"))
    out = out.filter(F.col("sample_size") >= min_names)
    return out.withColumn("p_value", two_sided_p(F.col("ic"), F.col("sample_size")))


def ic_by_month(ic: DataFrame) -> DataFrame:
    """Mean IC per year (row) and month (column)."""
    return year_by_month(ic, DATE, F.avg("ic"))


def place_and_rank(df: DataFrame, by: str) -> DataFrame:
    """Add ``ordinal`` (row number by value, then code) and ``average_rank`` (ties share their
    mean) within the date."""
    rows = row_numbers(df, [DATE], [F.col(by), F.col(CODE)]).withColumnRenamed("place", "ordinal").drop("n_all")
    ranks = value_positions(df, [DATE], by).select(DATE, by, (F.col("n_below") + (F.col("n_equal") + 1) / 2).alias("average_rank"))
    return rows.join(ranks, [DATE, by], "left")


def ic_statistics(ic: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, ratio, share above 0 and above 0.02."""
    valid = ic.filter(F.col("ic").isNotNull() & ~F.isnan("ic"))
    agg = valid.groupBy(*(groups or [])).agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"),
        F.avg((F.col("ic") > 0).cast("int")).alias("ic_positive_ratio"),
        F.avg((F.col("ic") > 0.02).cast("int")).alias("ic_positive_ratio_significant"))
    return agg.withColumn("ic_ir", ratio("ic_mean", "ic_std", 0))


def quantile_returns(df: DataFrame, factor: str, target: str = "future_return", q: int = 5,
                     min_per_bucket: int = 10) -> DataFrame:
    """Mean target per date and factor quantile as columns Q1..Qq, and Qq - Q1."""
    valid = df.filter(F.col(factor).isNotNull() & F.col(target).isNotNull()).select(CODE, DATE, factor, target)
    placed = quantile_buckets(valid, factor, q, min_names=q * min_per_bucket)
    wide = placed.groupBy(DATE).agg(*[F.avg(F.when(F.col("quantile") == i, F.col(target))).alias(f"Q{i}")
                                      for i in range(1, q + 1)])
    return wide.withColumn("long_short", F.col(f"Q{q}") - F.col("Q1"))


def log_growth(ret) -> Column:
    """ln(1 + r): what is summed to compound; a total loss is minus infinity."""
    r = F.col(ret) if isinstance(ret, str) else ret
    return F.when(r > -1, F.log1p(r)).when(r.isNotNull(), F.lit(float("-inf")))


def cumulative_curves(wide: DataFrame, columns: list[str], log: bool = False) -> DataFrame:
    """Compounded curves over the dates (one row per date): returns since the
    start, or with ``log`` the logarithm of the growth, which cannot overflow."""
    upto = Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    grown = {c: F.sum(log_growth(F.coalesce(F.col(c), F.lit(0.0)))).over(upto) for c in columns}
    return wide.select(DATE, *[(g if log else F.expm1(g)).alias(c) for c, g in grown.items()])


def factor_turnover(df: DataFrame, factor: str, n: int = 50) -> DataFrame:
    """1 - |common with the date before| / n of the top-n sets; first date 1.

    Counted by joining each member with its presence on the date before, so no
    set is collected.
    """
    top = top_per_date(df.select(CODE, DATE, factor), factor, n).select(CODE, DATE)
    dates = df.select(DATE).distinct()
    steps = dates.withColumn("_prev", F.lag(DATE).over(Window.orderBy(DATE)))
    before = top.select(CODE, F.col(DATE).alias("_prev"), F.lit(1).alias("_was"))
    counted = (top.join(small(steps), DATE).join(before, [CODE, "_prev"], "left")
               .groupBy(DATE).agg(F.sum(F.coalesce("_was", F.lit(0))).alias("_common"),
                                  F.count(F.lit(1)).alias("stock_count"), F.min("_prev").alias("_prev")))
    turnover = F.when(F.col("_prev").isNull(), 1.0).otherwise(1 - F.col("_common") / n)
    return counted.select(DATE, turnover.alias("turnover"), "stock_count")


def factor_autocorrelation(df: DataFrame, factor: str, lag: int = 1, s: Series = BARS) -> DataFrame:
    df = df.withColumn("_old", s.ref(factor, lag))
    return (df.groupBy(CODE).agg(correlation(factor, "_old").alias("autocorr"), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= lag + 10).drop("_n"))


def factor_correlation(df: DataFrame, factors: list[str]) -> DataFrame:
    """Pearson correlation of every pair over rows where both are present."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i:]]
    agg = df.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = []
    for a, b in pairs:
        value = F.col(f"`{a}|{b}`")
        rows.append(F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), value.alias("corr")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("factor_a"), F.lit(a).alias("factor_b"), value.alias("corr")))
    return agg.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def comoments(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Per group of pairs (x, y) present on both sides: n, means and centred sums of
    squares and products; such rows can be merged (:func:`merged_correlation`)."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y, n = F.when(both, F.col("x")), F.when(both, F.col("y")), F.count(F.when(both, 1))
    return pairs.groupBy(*group).agg(n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.covar_pop(x, y) * n).alias("xy"),
                                     (F.var_pop(x) * n).alias("xx"), (F.var_pop(y) * n).alias("yy"))


def merged_correlation(parts: DataFrame, group: list[str]) -> DataFrame:
    """Correlation of all pairs from the co-moments of parts of them: sums within the
    parts and, about the common mean, between them."""
    whole = parts.groupBy(*group).agg(F.sum("n").alias("_n"), *[(F.sum(F.col("n") * F.col(m)) / F.sum("n")).alias(f"_{m}") for m in ("mx", "my")])
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    sums = parts.join(F.broadcast(whole), group).groupBy(*group).agg(
        *[F.sum(F.col(c) + F.col("n") * a * b).alias(c) for c, a, b in (("xy", dx, dy), ("xx", dx, dx), ("yy", dy, dy))])
    return sums.select(*group, ratio("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("corr"))


def quantile_means(df: DataFrame, factors: list[str], target: str, q: int = 5, min_per_bucket: int = 10) -> DataFrame:
    """(factor, Q1 .. Qq, long_short): mean over the dates of the mean target per date
    and quantile of the factor, for all factors at once.  Dates with fewer than
    ``q * min_per_bucket`` names leave the factor out."""
    paired = df.select(DATE, F.col(target).alias("_y"), *[F.when(F.col(target).isNotNull(), F.col(f)).alias(f) for f in factors])
    edges = grouped_quantiles(paired, [DATE], factors, [i / q for i in range(1, q)])
    edges = edges.select(DATE, *[F.when(F.col(f"{f}_n") >= q * min_per_bucket, F.col(f"{f}_q")).alias(f"_edges_{f}") for f in factors])
    rows = F.array(*[F.struct(F.lit(f).alias("factor"), F.when(F.col(f).isNotNull(), bucket_column(f, f"_edges_{f}")).alias("b")) for f in factors])
    placed = per_date(paired, edges).select(DATE, "_y", F.explode(rows).alias("r")).select(DATE, "_y", "r.*").filter("b >= 1")
    wide = placed.groupBy("factor", DATE).agg(*[F.avg(F.when(F.col("b") == i, F.col("_y"))).alias(f"Q{i}") for i in range(1, q + 1)])
    wide = wide.withColumn("long_short", F.col(f"Q{q}") - F.col("Q1"))
    return wide.groupBy("factor").agg(*[F.avg(c).alias(c) for c in (*[f"Q{i}" for i in range(1, q + 1)], "long_short")])


def factor_report(df: DataFrame, factors: list[str], periods: list[int], ret: str = "ret", q: int = 5,
                  min_names: int = 10, min_per_bucket: int = 10, s: Series = BARS) -> DataFrame:
    """(part, factor, period, name, value): IC statistics of every factor and forward
    period (``ic``), mean return per factor quantile (``quantile``, one period ahead) and
    the correlation of every two factors (``correlation``, ``name`` is the other).

    The panel is built once.  IC and correlations come from one pass: every row
    yields its (factor, target) and (factor, factor) pairs, which the map side
    collapses to co-moments per date; correlations over all dates are merged from
    those.
    """
    ahead = sorted({1, *periods})
    panel = cut(df.withColumns({f"_fut{p}": s.ahead(ret, p) for p in ahead}).select(DATE, *factors, *[f"_fut{p}" for p in ahead]))

    def pair(part, factor, period, name, x, y):
        return F.struct(F.lit(part).alias("part"), F.lit(factor).alias("factor"), F.lit(period).cast("int").alias("period"), F.lit(name).alias("name"), F.col(x).alias("x"), F.col(y).alias("y"))

    grid = [pair("ic", f, p, "", f, f"_fut{p}") for f in factors for p in periods]
    grid += [pair("correlation", a, None, b, a, b) for i, a in enumerate(factors) for b in factors[i:]]
    group = ["part", "factor", "period", "name"]
    daily = cut(comoments(panel.select(DATE, F.explode(F.array(*grid)).alias("g")).select(DATE, "g.*"), [DATE, *group]).filter("n > 0"))

    ic = daily.filter("part = 'ic'").filter(F.col("n") >= min_names).withColumn("ic", ratio("xy", F.sqrt(F.col("xx") * F.col("yy"))))
    stats = ic_statistics(ic, ["factor", "period"])
    names = [c for c in stats.columns if c not in ("factor", "period")]

    def long(wide, part, period, columns):
        rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
        return wide.select(F.lit(part).alias("part"), "factor", period.alias("period"), F.explode(rows).alias("r")).select("part", "factor", "period", "r.*")

    buckets = quantile_means(panel, factors, "_fut1", q, min_per_bucket)
    corr = merged_correlation(daily.filter("part = 'correlation'").drop("part", "period"), ["factor", "name"])
    mirrored = corr.filter("factor <> name").select(F.col("name").alias("factor"), F.col("factor").alias("name"), "corr")
    return (long(stats, "ic", F.col("period"), names)
            .unionByName(long(buckets, "quantile", F.lit(1), [c for c in buckets.columns if c != "factor"]))
            .unionByName(corr.unionByName(mirrored).select(F.lit("correlation").alias("part"), "factor", F.lit(None).cast("int").alias("period"), "name", F.col("corr").alias("value"))))


def exposure(holdings: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """Mean factor value of the codes held, per date."""
    return (factors.join(holdings.select(CODE, DATE).distinct(), [CODE, DATE], "left_semi")
            .groupBy(DATE).agg(*[F.avg(f).alias(f) for f in names], F.count(F.lit(1)).alias("n_held")))


def weighted_exposure(held: DataFrame, weights: dict[str, float]) -> DataFrame:
    """exposure * weight per factor, in long form."""
    rows = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("exposure"), F.lit(float(w)).alias("weight"),
                              (F.col(f) * float(w)).alias("attribution")) for f, w in weights.items()])
    return held.select(DATE, F.explode(rows).alias("r")).select(DATE, "r.*")
