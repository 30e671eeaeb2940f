"""Streams: state over micro-batches, merging into a keyed table."""

import datetime as dt
import os
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.operators import indicators
from candlewick.session import shared_dir
from candlewick.streaming import bars as B, state as T
from candlewick.streaming.tables import last_batch, merge_into

DAY = dt.date(2024, 1, 1)


@pytest.fixture
def path(spark):
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def rows(spark, *values):
    return spark.createDataFrame([(k, DAY + dt.timedelta(days=k // 10), v, n) for k, v, n in values], "k long, day date, v string, n int")


def read(spark, path):
    return {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_batches_are_merged_once(spark, path):
    merge = merge_into(path, ["k"], ["day"], order="n")
    batches = [rows(spark, (1, "a", 1), (2, "b", 1), (11, "c", 1), (2, "later", 2)), rows(spark, (2, "new", 1), (31, "d", 1)), rows(spark, (11, "e", 1))]
    for i, batch in enumerate(batches):
        merge(batch, i)
        merge(batch, i)
        assert last_batch(spark, path) == i
    want = {1: "a", 2: "new", 11: "e", 31: "d"}
    assert read(spark, path) == want
    for i, batch in enumerate(batches):
        merge(batch, i)
    assert read(spark, path) == want


def test_a_batch_whose_note_was_lost(spark, path):
    """Merged, but the run ended before it was noted: merging again, even an older batch, changes nothing."""
    first, second = rows(spark, (1, "a", 1), (2, "b", 1)), rows(spark, (2, "c", 1), (2, "d", 3))
    merge = merge_into(path, ["k"], ["day"], order="n")
    merge(first, 0)
    merge(second, 1)
    for batch, number in ((second, 1), (first, 0)):
        spark.range(0).select(F.lit(0).cast("long").alias("number")).write.mode("overwrite").parquet(f"{path}-merged")
        assert last_batch(spark, path) == -1
        merge(batch, number)
        assert read(spark, path) == {1: "a", 2: "d"}


def test_only_touched_days_are_rewritten(spark, path):
    merge = merge_into(path, ["k"], ["day"])
    merge(rows(spark, *[(k, "x", 1) for k in range(50)]), 0)
    before = files(path)
    merge(rows(spark, (12, "y", 1), (99, "z", 1)), 1)
    after = files(path)
    changed = {f.split("day=")[1][:10] for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {str(DAY + dt.timedelta(days=1)), str(DAY + dt.timedelta(days=9))}
    assert read(spark, path)[12] == "y" and len(read(spark, path)) == 51


def test_empty_batches(spark, path):
    merge = merge_into(path, ["k"], ["day"])
    merge(rows(spark).limit(0), 0)
    assert last_batch(spark, path) == 0
    merge(rows(spark, (1, "a", 1)), 1)
    merge(rows(spark).limit(0), 2)
    assert read(spark, path) == {1: "a"} and last_batch(spark, path) == 2


def walk(n, code, seed):
    rng = np.random.default_rng(seed)
    close = 50 + rng.normal(size=n).cumsum().round(2)
    days = [DAY + dt.timedelta(days=i) for i in range(n)]
    flat = rng.uniform(size=n) < 0.1  # bars without movement
    spread = np.where(flat, 0, rng.uniform(0, 2, n).round(2))
    return pd.DataFrame({"ts_code": code, "trade_date": days, "high": close + spread, "low": close - spread, "close": close})


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_running_kdj(spark, parts):
    """However the bars are dealt to batches, the values are those of the whole series."""
    T.use_rocksdb(spark)
    bars = pd.concat([walk(60, "A", 1), walk(7, "B", 2), pd.DataFrame({"ts_code": "C", "trade_date": [DAY + dt.timedelta(days=i) for i in range(15)], "high": 5.0, "low": 5.0, "close": 5.0})])
    df = spark.createDataFrame(bars).withColumn("trade_date", F.to_date("trade_date"))
    folder = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    for i in range(parts):
        lo, hi = 60 * i // parts, 60 * (i + 1) // parts
        df.filter(F.datediff("trade_date", F.lit(DAY)).between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(folder)
    stream = B.read_stream(spark, folder, "ts_code string, trade_date date, high double, low double, close double", per_batch=1)
    got = spark.read.parquet(B.drain(T.running_kdj(stream), "append")).drop("batch").orderBy("ts_code", "trade_date").toPandas()
    want = indicators.kdj(df).select("ts_code", "trade_date", "k", "d", "j").orderBy("ts_code", "trade_date").toPandas()
    assert len(got) == len(want) == 82
    np.testing.assert_allclose(got[["k", "d", "j"]], want[["k", "d", "j"]], rtol=1e-9, atol=1e-9)
