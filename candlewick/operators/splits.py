"""Date splits, cross-validation folds, walk-forward windows, parameter sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from candlewick.functions.series import Series, ratio
from candlewick.operators import evaluate as E, factors as X
from candlewick.operators.ranks import value_positions
from candlewick.session import cut, small


def named_splits(spark: SparkSession, splits: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(split, start, end) as a frame; an open end means up to today."""
    rows = [(k, a, b) for k, (a, b) in splits.items()]
    return spark.createDataFrame(rows, "split string, start string, end string").select(
        "split", F.to_date("start").alias("start"), F.coalesce(F.to_date("end"), F.current_date()).alias("end"))


def assign_split(df: DataFrame, splits: DataFrame, date: str = "trade_date") -> DataFrame:
    """Rows with the split(s) their date lies in.  ``splits`` is configuration, a
    handful of rows."""
    return df.join(F.broadcast(splits), F.col(date).between(F.col("start"), F.col("end"))).drop("start", "end")


def date_folds(df: DataFrame, n_folds: int, min_rows: int = 60) -> DataFrame:
    """Add ``fold`` 0..n-1: contiguous equal runs of the distinct dates, the last
    takes the rest; codes with too few rows in a fold leave it."""
    dates = df.select("trade_date").distinct()
    # one row per date of a market
    order = Window.orderBy("trade_date")
    size = F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / n_folds)
    fold = F.least(F.floor((F.row_number().over(order) - 1) / F.greatest(size, F.lit(1))), F.lit(n_folds - 1))
    folds = dates.select("trade_date", fold.cast("int").alias("fold"))
    out = df.join(small(folds), "trade_date")
    rows = F.count(F.lit(1)).over(Window.partitionBy("ts_code", "fold"))
    return out.withColumn("_rows", rows).filter(F.col("_rows") >= min_rows).drop("_rows")


def capped_sharpe(value, cap: float = 3.0, discount: float = 0.1):
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value > cap, cap + (value - cap) * discount).otherwise(value)


def parameter_grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """Cartesian product of the value lists: one row per parameter set."""
    grid = spark.range(1).select(F.lit(0).alias("_"))
    for name, options in values.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in options])).alias(name))
    return grid.drop("_")


def _thresholds(grid: DataFrame) -> list[float]:
    """The thresholds of a grid, ascending.  A grid is configuration, a handful of rows."""
    return sorted(r[0] for r in grid.select(F.col("threshold").cast("double")).distinct().collect())


def _merged_moments(n: Column, mean: Column, squares: Column) -> list[Column]:
    """Number, sum and sum of squares over parts with mean and centred squares."""
    return [F.sum(n).alias("_n"), F.sum(n * mean).alias("_s"), F.sum(squares + n * mean * mean).alias("_q")]


def _mean() -> Column:
    return F.col("_s") / F.col("_n")


def _std() -> Column:
    return F.sqrt(F.greatest(F.col("_q") - F.col("_s") * _mean(), F.lit(0.0)) / (F.col("_n") - 1))


def _moments(ret: str) -> list[Column]:
    return [F.count(ret).alias("n"), F.coalesce(F.avg(ret), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(ret) * F.count(ret), F.lit(0.0)).alias("sq")]


def _suffix_quantiles(rows: DataFrame, group: str, value: str, thresholds: list[float], probs: dict[str, float]) -> DataFrame:
    """(group, i, one column per entry of ``probs``): quantiles of the values that reach the i-th
    threshold.  All are read from the positions of the values among all of their group:
    those that reach a threshold begin where the ones under it end."""
    places = cut(value_positions(rows, [group], value))
    below = places.groupBy(group).agg(F.max("n_all").alias("_all"), F.array(*[
        F.coalesce(F.sum(F.when(F.col(value) < t, F.col("n_equal"))), F.lit(0)) for t in thresholds]).alias("_below"))
    spots = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("_below")[i].alias("lo"), ((F.col("_all") - F.col("_below")[i] - 1) * F.lit(float(p))).alias("at"))
             for i in range(len(thresholds)) for j, p in enumerate(probs.values())]
    wanted = below.select(group, F.filter(F.array(*spots), lambda s: s["at"] >= 0).alias("_spots"))
    # one row per group (fold)
    near = places.join(F.broadcast(wanted), group).select(group, value, "n_below", "n_equal", F.explode("_spots").alias("s"))

    def covers(k):
        return (F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n_equal"))

    low, high = F.col("s.lo") + F.floor("s.at"), F.col("s.lo") + F.ceil("s.at")
    found = near.filter(covers(low) | covers(high)).groupBy(group, "s.i", "s.j", "s.at").agg(
        F.max(F.when(covers(low), F.col(value))).alias("lo"), F.max(F.when(covers(high), F.col(value))).alias("hi"))
    found = found.withColumn("q", F.col("lo") + (F.col("at") - F.floor("at")) * (F.col("hi") - F.col("lo")))
    return found.groupBy(group, "i").agg(*[F.max(F.when(F.col("j") == j, F.col("q"))).alias(name) for j, name in enumerate(probs)])


def sweep_thresholds(panel: DataFrame, grid: DataFrame, horizon: int, score: str = "score",
                     min_signals: int = 80, min_folds: int = 2, min_samples: int = 30) -> DataFrame:
    """Cross-validated objective of every threshold in one job.

    ``panel`` carries ``fold``; the signal of a parameter set is the score where
    it reaches the threshold.  The panel is not multiplied by the grid: thresholds and
    tercile cuts of a fold are the edges of bins, every row goes to one bin, and each
    threshold adds up the moments of the bins above its cuts.
    """
    thresholds = _thresholds(grid)
    rows = X.forward_returns(panel, [horizon], s=Series(("ts_code", "fold"))).withColumnRenamed(f"ret_t{horizon}", "_ret")
    rows = cut(rows.select("fold", F.col(score).cast("double").alias("_x"), "_ret").filter(F.col("_x") >= thresholds[0]))
    cuts = _suffix_quantiles(rows.filter("_ret IS NOT NULL"), "fold", "_x", thresholds, {"p33": 0.33, "p67": 0.67})
    cuts = cuts.withColumn("threshold", F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("i") + 1))
    edges = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("threshold", "p33", "p67")))))
    by_fold = cut(cuts.groupBy("fold").agg(edges.alias("_edges"), F.collect_list(F.struct("threshold", "p33", "p67")).alias("_cuts")))

    def place(x, edges="_edges"):
        """Twice the number of edges below x, and one more if x is an edge."""
        return F.size(F.filter(edges, lambda e: e < x)) + F.size(F.filter(edges, lambda e: e <= x))

    bins = (rows.join(F.broadcast(by_fold), "fold").groupBy("fold", place(F.col("_x")).alias("_bin"))
            .agg(*_moments("_ret"), F.count_if(F.col("_x") != 0).alias("fired")))
    # bins and cuts of a fold: a few per threshold
    c = by_fold.select("fold", "_edges", F.explode("_cuts").alias("c"))
    c = c.select("fold", "c.threshold", *[place(F.col(f"c.{x}")).alias(f"_{x}") for x in ("threshold", "p33", "p67")])
    both = bins.join(F.broadcast(c), "fold").filter(F.col("_bin") >= F.col("_threshold"))
    top, bottom = (F.col("_bin") >= F.col("_p67")).cast("int"), (F.col("_bin") <= F.col("_p33")).cast("int")
    n = F.col("n") * (top + bottom)
    # a top row counts with its return, a bottom row with minus its return
    sums = both.groupBy("threshold", "fold").agg(
        F.sum("n").alias("n_pairs"), F.sum("fired").alias("n_signals"), F.sum(n).alias("_n"), F.sum(F.col("n") * F.col("mean") * (top - bottom)).alias("_s"),
        F.sum((F.col("sq") + F.col("n") * F.col("mean") * F.col("mean")) * (top + bottom)).alias("_q"))
    folds = sums.withColumn("sharpe", F.when((F.col("n_pairs") >= min_samples) & (F.col("_n") > 1), E.annual_sharpe(_mean(), _std())))
    folds = folds.filter((F.col("n_signals") >= min_signals) & F.col("sharpe").isNotNull())
    out = folds.groupBy("threshold").agg(F.avg("sharpe").alias("score_uncapped"), F.count(F.lit(1)).alias("n_folds"))
    return out.filter(F.col("n_folds") >= min_folds).withColumn("score", capped_sharpe("score_uncapped"))


def sweep_summary(panel: DataFrame, grid: DataFrame, horizon: int, score: str = "score") -> DataFrame:
    """Per threshold: trades, mean return, Sharpe, win rate, and the best flag.  Rows
    go to the bin of the highest threshold they reach; a threshold adds up its bin
    and those above."""
    thresholds = _thresholds(grid)
    rows = X.forward_returns(panel, [horizon]).withColumnRenamed(f"ret_t{horizon}", "_ret").filter("_ret IS NOT NULL")
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col(score)))
    bins = rows.groupBy(reached.alias("_bin")).agg(*_moments("_ret"), F.count_if(F.col("_ret") > 0).alias("won")).filter("_bin > 0")
    each = bins.select("*", F.explode(F.slice(F.array(*[F.lit(t) for t in thresholds]), 1, F.col("_bin"))).alias("threshold"))
    out = each.groupBy("threshold").agg(*_merged_moments(F.col("n"), F.col("mean"), F.col("sq")), F.sum("won").alias("_won"))
    out = out.select("threshold", F.col("_n").alias("total_trades"), _mean().alias("avg_return"),
                     F.when(F.col("_n") > 1, E.annual_sharpe(_mean(), _std())).alias("sharpe_ratio"), (F.col("_won") / F.col("_n")).alias("win_rate"))
    best = out.agg(F.max_by("threshold", F.struct("avg_return", -F.col("threshold"))).alias("_best"))
    return out.crossJoin(F.broadcast(best)).withColumn("is_best", F.col("threshold") == F.col("_best")).drop("_best")  # best is one row


def walk_forward_windows(span: DataFrame, train_months: int = 6, test_months: int = 3) -> DataFrame:
    """Windows from a one-row frame (start, end): trained on [start, cut), tested
    on [cut, test_end); each starts one test length after the one before."""
    months = (F.year("end") - F.year("start")) * 12 + F.month("end") - F.month("start")
    count = F.floor(months / (train_months + test_months)).cast("int")
    windows = span.filter(count >= 1).select("start", F.explode(F.sequence(F.lit(0), count - 1)).alias("window_no"))
    cut = F.add_months("start", train_months + F.col("window_no") * test_months)
    return windows.select("window_no", F.add_months(cut, -train_months).alias("train_start"), cut.alias("cut"),
                          F.add_months(cut, test_months).alias("test_end"))


def walk_forward(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean event return in training and test part of each window, and decay.

    Windows overlap: an event counts in each it lies in.  The dates at which windows
    begin, turn and end part the time into panes; events are summed per pane, and a
    window adds up its panes.  ``windows`` has one row per quarter or so of the span.
    """
    windows = cut(windows)
    dates = windows.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("train_start", "cut", "test_end"))))).alias("_dates"))

    def pane(day):
        return F.size(F.filter("_dates", lambda d: d <= day))

    # the list of dates is one row
    panes = events.crossJoin(F.broadcast(dates)).groupBy(pane(F.col("trade_date")).alias("_pane")).agg(F.sum("ret").alias("_sum"), F.count("ret").alias("_n"))
    placed = windows.crossJoin(F.broadcast(dates)).select(*windows.columns, *[pane(F.col(c)).alias(f"_{c}") for c in ("train_start", "cut", "test_end")])
    parts = placed.select("*", F.explode(F.sequence(F.col("_train_start"), F.col("_test_end") - 1)).alias("_pane")).join(panes, "_pane")
    train = F.col("_pane") < F.col("_cut")

    def mean(where):
        total = F.sum(F.when(where, F.col("_n")))
        return F.coalesce(F.sum(F.when(where, F.col("_sum"))) / F.when(total > 0, total), F.lit(0.0))

    out = parts.groupBy("window_no", "train_start", "cut", "test_end").agg(mean(train).alias("train_return"), mean(~train).alias("test_return"))
    return out.withColumn("decay_rate", ratio(F.col("test_return") - F.col("train_return"), "train_return", 0))
