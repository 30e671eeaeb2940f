"""Operators that split hot keys give what they would give unsplit."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from candlewick.functions import recursion as R
from candlewick.functions.series import Series
from candlewick.operators import asof, ingest, ranks
from candlewick.operators.split import OFFSET, OWN, SEGMENT, split_series

BASE = dt.datetime(2024, 1, 1)


def ticks(spark, n=4000, hot=0.6):
    rng = np.random.default_rng(1)
    keys = np.where(rng.uniform(size=n) < hot, "hot", rng.choice(["a", "b", "c"], n))
    t = [BASE + dt.timedelta(seconds=int(x)) for x in np.sort(rng.integers(0, 400 * 3600, n))]
    pdf = pd.DataFrame({"source": keys, "ts": t, "call_id": np.arange(n), "value": rng.normal(10, 3, n), "failed": rng.uniform(size=n) < 0.3})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("max_rows", [100, 300, 1_000_000])
def test_rolling_and_numbers_over_segments(spark, max_rows):
    pdf, df = ticks(spark)
    rows = split_series(df, ["source"], ("ts", "call_id"), halo=99, max_rows=max_rows)
    w = Window.partitionBy("source", SEGMENT).orderBy("ts", "call_id")
    rows = rows.withColumns({"mean": F.avg("value").over(w.rowsBetween(-99, 0)), "number": F.col(OFFSET) + F.row_number().over(w)})
    got = rows.filter(OWN).select("call_id", "mean", "number").toPandas().sort_values("call_id").reset_index(drop=True)
    assert len(got) == len(pdf)
    g = pdf.sort_values(["ts", "call_id"]).groupby("source")
    want = g["value"].transform(lambda s: s.rolling(100, min_periods=1).mean()).sort_index()
    np.testing.assert_allclose(got["mean"], want, rtol=1e-12)
    np.testing.assert_array_equal(got["number"], g.cumcount().sort_index() + 1)
    if max_rows == 100:
        assert rows.filter("source = 'hot'").select(SEGMENT).distinct().count() > 10


def test_segments_are_bounded_within_an_hour(spark):
    """A hot key with all its rows in three hours, and many at one time."""
    n = 6000
    pdf = pd.DataFrame({"source": "hot", "ts": [BASE + dt.timedelta(seconds=int(i) // 3 if i > 2000 else 0) for i in range(n)], "call_id": np.arange(n)})
    rows = split_series(spark.createDataFrame(pdf), ["source"], ("ts", "call_id"), halo=50, max_rows=100, bins=7)
    sizes = rows.groupBy(SEGMENT).agg(F.count("*").alias("n"), F.count_if(OWN).alias("own"), F.min("call_id").alias("first"), F.first(OFFSET).alias("before")).toPandas()
    assert len(sizes) == 60 and set(sizes["own"]) == {100} and sizes["n"].max() == 150
    assert (sizes["first"] == sizes["before"]).all()


def test_recursion_over_segments(spark):
    pdf, df = ticks(spark)
    halo = R.warm_up(2 / 3)
    rows = split_series(df, ["source"], ("ts", "call_id"), halo=halo, max_rows=400)
    s = Series(("source", SEGMENT), ("ts", "call_id"))
    rows = rows.withColumn("n", s.number())
    rows = R.decayed_sums(rows, s, "n", {"e": R.ema("value", 1 / 3, "n")})
    got = rows.filter(OWN).select("call_id", "e").toPandas().sort_values("call_id")["e"].to_numpy()
    want = pdf.groupby("source")["value"].transform(lambda x: x.ewm(alpha=1 / 3, adjust=False).mean())
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_failure_rate_of_a_hot_source(spark):
    pdf, df = ticks(spark)
    got = ingest.failure_rate(df, max_rows=150).toPandas().sort_values("call_id")
    want = pdf.groupby("source")["failed"].transform(lambda s: s.astype(float).rolling(100, min_periods=1).mean())
    np.testing.assert_allclose(got["failure_rate"], want.to_numpy(), rtol=1e-12)


def values(n=3000):
    rng = np.random.default_rng(3)
    x = rng.normal(size=n).round(2)
    x[: n // 3] = 0.5  # one value holds a third
    return pd.DataFrame({"g": rng.choice(["p", "q"], n), "x": rng.permutation(x), "y": rng.normal(size=n)})


@pytest.mark.parametrize("bins", [2, 7, 256])
def test_ranks_and_quantiles(spark, bins):
    pdf = values()
    df = spark.createDataFrame(pdf)
    got = ranks.average_ranks(df, ["g"], ["x"], bins).toPandas()
    want = pdf.assign(r=pdf.groupby("g")["x"].rank()).groupby(["g", "x"])["r"].agg(["first", "size"]).reset_index()
    both = got.merge(want, on=["g", "x"])
    assert len(both) == len(want)
    np.testing.assert_allclose(both["rank_x"], both["first"])
    np.testing.assert_array_equal(both["n_rows"], both["size"])
    q = ranks.exact_quantiles(df, ["g"], "x", {"p33": 0.33, "p67": 0.67, "lo": 0.0, "hi": 1.0}, bins).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(q.loc[g, ["p33", "p67", "lo", "hi"]].astype(float), np.percentile(part["x"], [33, 67, 0, 100]))


def test_pooled_spearman(spark):
    pdf = values()
    got = ranks.spearman(spark.createDataFrame(pdf), [], "x", "y").first()
    assert got["ic"] == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()), abs=1e-12)
    assert got["n_obs"] == len(pdf)


def test_asof_against_merge_asof(spark):
    rng = np.random.default_rng(5)
    days = pd.date_range("2020-01-01", periods=900)
    left = pd.DataFrame({"k": rng.choice(["hot", "hot", "hot", "x"], 2000), "t": rng.choice(days, 2000), "id": range(2000)})
    right = pd.DataFrame({"k": rng.choice(["hot", "x"], 60), "d": rng.choice(days[100:], 60), "v": rng.normal(size=60)}).drop_duplicates(["k", "d"])
    sl = spark.createDataFrame(left).withColumn("t", F.to_date("t"))
    sr = spark.createDataFrame(right).withColumn("d", F.to_date("d"))
    for age in (None, 20):
        got = asof.asof_join(sl, sr, ["k"], "t", "d", ["v"], age).toPandas().sort_values("id")
        tol = None if age is None else pd.Timedelta(days=age)
        want = pd.merge_asof(left.sort_values("t"), right.sort_values("d"), left_on="t", right_on="d", by="k", tolerance=tol).sort_values("id")
        np.testing.assert_allclose(got["v"], want["v"])


def test_asof_of_one_key_in_many_partitions(spark):
    """One key with nearly all rows: right rows far back are carried over whole partitions."""
    left = pd.DataFrame({"k": ["hot"] * 4000 + ["x"] * 20 + [None, "hot"], "t": [*pd.date_range("2001-01-01", periods=4000), *pd.date_range("2001-01-01", periods=20), pd.Timestamp("2005-01-01"), pd.NaT]})
    left["id"] = range(len(left))
    sl = spark.createDataFrame(left).withColumn("t", F.to_date("t")).withColumn("v", F.lit("left"))
    sl = sl.unionByName(sl.filter("id < 100"))  # repeated rows stay
    days = ["2001-02-01", "2009-05-05", "2009-05-05"]
    sr = spark.createDataFrame([("hot", d, i) for i, d in enumerate(days)] + [("x", "2001-01-10", 9), (None, "2001-01-01", 8), ("hot", None, 7)], "k string, d string, w int").withColumn("d", F.to_date("d"))
    one = asof.asof_join(sl, sr, ["k"], "t", "d", ["w"], bins=16)
    got = one.toPandas()
    assert len(got) == len(left) + 100 and list(got.columns) == ["k", "t", "id", "v", "w"]
    by_id = got.drop_duplicates("id").set_index("id")["w"]
    hot = left[left["k"].eq("hot") & left["t"].notna()]
    want = hot["t"].map(lambda t: 1 if t >= pd.Timestamp("2009-05-05") else 0 if t >= pd.Timestamp("2001-02-01") else None)
    seen = by_id.loc[hot["id"]].replace({2: 1})
    assert (seen.fillna(-1).to_numpy() == want.fillna(-1).to_numpy()).all()
    assert by_id.loc[4000:4008].isna().all() and (by_id.loc[4009:4019] == 9).all() and by_id.loc[4020:].isna().all()
    # of two rows of one day the same wins whatever the partitions
    again = asof.asof_join(sl.repartition(5), sr.repartition(3), ["k"], "t", "d", ["w"], bins=3).toPandas().drop_duplicates("id").set_index("id")["w"]
    assert by_id.sort_index().fillna(-1).equals(again.sort_index().fillna(-1))
    assert asof.asof_join(sl.filter("false"), sr, ["k"], "t", "d", ["w"]).count() == 0
    assert asof.asof_join(sl, sr.filter("false"), ["k"], "t", "d", ["w"]).filter("w IS NULL").count() == len(got)


def test_rows_go_through_no_single_task(spark):
    """The pooled operators never sort all rows in one partition."""
    df = spark.createDataFrame(values())
    places = ranks.value_positions(df, ["g"], "x", bins=8)
    assert "SinglePartition" not in places._jdf.queryExecution().executedPlan().toString()
    # a group spans partitions, and none holds most of its values
    sizes = df.select("g", "x").distinct().repartitionByRange(8, "g", "x").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) >= 6 and sizes.max() < 0.4 * sizes.sum()
