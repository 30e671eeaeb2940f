"""Streams run to their end; the result must equal the batch query."""

import uuid

from pyspark.sql import functions as F

from candlewick.functions import recursion as R
from candlewick.operators.indicators import trend_slow
from candlewick.operators.split import over_segments
from candlewick.plans.oracle_views import NUMBERED, over, snap as sq, with_views
from candlewick.plans.indicator_queries import _D3, _K3, _KDJ, _RSV
from candlewick.plans.registry import query
from candlewick.plans.rolling import _bars_sql, loop
from candlewick.plans.rule_queries import _upto
from candlewick.plans.shaping import KEYS, rounded, snap
from candlewick.session import cut, shared_dir
from candlewick.streaming import bars as B, state as T
from candlewick.streaming.tables import merge_into

_BARS = ["open", "high", "low", "close", "vol"]


@query("hourly_bars_stream", "L1 L2", with_views("bars_t", "SELECT ts_code, bar_time, open, high, low, close, vol FROM bars_t"))
def hourly_bars_stream(t):
    path = B.drain(B.bars(B.ticks(t.spark, t.folder), late="40 days"), "update")
    return B.latest(t.spark, path, ["ts_code", "bar_time"]).select("ts_code", "bar_time", *_BARS)


@query("sliding_bars_stream", "L1", """SELECT event_type AS ts_code, bar_time, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS vol FROM (
  SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * unnest([0, 1])) AS bar_time FROM events) GROUP BY ALL""")
def sliding_bars_stream(t):
    path = B.drain(B.bars(B.ticks(t.spark, t.folder), "1 hour", "30 minutes", late="40 days"), "update")
    return B.latest(t.spark, path, ["ts_code", "bar_time"]).select("ts_code", "bar_time", *_BARS)


@query("source_health_stream", "L6", f"SELECT event_type AS source, date_trunc('hour', ts) AS bar_time, count(*) AS n_calls, {sq('avg((value > 8)::INT)')} AS failure_rate, count(*) >= 3 AND avg((value > 8)::INT) > 0.3 AS tripped FROM events GROUP BY ALL")
def source_health_stream(t):
    calls = B.ticks(t.spark, t.folder).select(F.col("ts_code").alias("source"), "ts", (F.col("value") > 8).alias("failed"))
    path = B.drain(B.source_health(calls, late="40 days", min_calls=3), "update")
    return B.latest(t.spark, path, ["source", "bar_time"]).select("source", "bar_time", "n_calls", snap("failure_rate").alias("failure_rate"), "tripped")


@query("late_bars_repaired", "L5", with_views("bars_t", "SELECT ts_code, bar_time, open, high, low, close, vol FROM bars_t"))
def late_bars_repaired(t):
    """Bars without some late ticks, repaired by rebuilding the codes they touch."""
    all_ticks = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("ts_code"), "value")
    late = all_ticks.filter((F.col("ts_code") == "error") & (F.hour("ts") == 5))
    on_time = all_ticks.join(late.select("event_id"), "event_id", "left_anti")
    return B.repair(B.bars(on_time), on_time, late).select("ts_code", "bar_time", *_BARS)


def _landed(t, parts):
    """Frames land one after another, a file each."""
    path = f"{shared_dir(t.spark)}/landed-{uuid.uuid4().hex}"
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return path


_LANDINGS = ["trade_date < DATE '1994-01-01'", "trade_date >= DATE '1994-01-01' AND trade_date < DATE '1996-07-01'", "trade_date >= DATE '1996-07-01'"]


def _as_stream(t, df, schema):
    """Bars land in three files by date and are read as three micro-batches, so
    that state is carried between them."""
    df = cut(df)
    return B.read_stream(t.spark, _landed(t, [df.filter(x) for x in _LANDINGS]), schema, per_batch=1)


_LATE = "event_type = 'error' AND hour(ts) = 5 AND ts < TIMESTAMP_NTZ '2024-01-11 00:00:00'"


def _tick_landings(t):
    """Ticks in three parts by time, but those of ``_LATE`` with the last."""
    early, middle = "ts < TIMESTAMP_NTZ '2024-01-11 00:00:00'", "ts >= TIMESTAMP_NTZ '2024-01-11 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-21 00:00:00'"
    return [t.events.filter(f"{early} AND NOT ({_LATE})"), t.events.filter(middle), t.events.filter(f"NOT ({early}) AND NOT ({middle}) OR ({_LATE})")]


@query("appended_bars_stream", "L1 L5", with_views("bars_t", f"""SELECT event_type AS ts_code, date_trunc('hour', ts) AS bar_time, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS vol
  FROM events WHERE NOT ({_LATE.replace("TIMESTAMP_NTZ", "TIMESTAMP")}) GROUP BY 1, 2 HAVING bar_time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"""))
def appended_bars_stream(t):
    """Finished bars only, each written once.  Three micro-batches; ticks of the first
    days that come with the last file are over two hours late and dropped."""
    path = _landed(t, _tick_landings(t))
    out = B.drain(B.bars(B.ticks(t.spark, path, "*.parquet", per_batch=1), late="2 hours"), "append")
    return t.spark.read.parquet(out).select("ts_code", "bar_time", *_BARS)


@query("line_break_stream", "L3", with_views("bars_w", "SELECT ts_code, trade_date, observing, break_slow FROM panel", **_upto("panel")))
def line_break_stream(t):
    T.use_rocksdb(t.spark)
    df = trend_slow(t.bars_w()).select(*KEYS, "close", "trend_slow")
    out = T.line_break_stream(_as_stream(t, df, "ts_code string, trade_date date, close double, trend_slow double"))
    return t.spark.read.parquet(B.drain(out, "append")).drop("batch")


@query("running_indicators_stream", "L4", with_views("bars_w", f"SELECT ts_code, trade_date, {sq('e12', 3)} AS ema12, {sq('e26', 3)} AS ema26, {sq('b2', 3)} AS trend_fast, {sq('obv', 3)} AS obv FROM loop_r JOIN (SELECT ts_code, trade_date, {over('sum(CASE WHEN rn = 1 THEN vol ELSE sign(chg) * vol END)', 10**6)} AS obv FROM (SELECT *, close - lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS chg FROM numbered)) USING (ts_code, trade_date)",
    numbered=NUMBERED, loop_r=loop({"e12": ("close", "b.close * (2.0/13) + r.e12 * (11.0/13)"), "e26": ("close", "b.close * (2.0/27) + r.e26 * (25.0/27)"),
                                    "a1": ("close", "b.close * (2.0/11) + r.a1 * (9.0/11)"), "b2": ("close", "(b.close * (2.0/11) + r.a1 * (9.0/11)) * (2.0/11) + r.b2 * (9.0/11)")})))
def running_indicators_stream(t):
    T.use_rocksdb(t.spark)
    out = T.running_indicators(_as_stream(t, t.bars_w().select(*KEYS, "close", "vol"), "ts_code string, trade_date date, close double, vol double"))
    rows = t.spark.read.parquet(B.drain(out, "append"))
    return rounded(rows, KEYS, ["ema12", "ema26", "trend_fast", "obv"], 3)


@query("running_kdj_stream", "L4", _bars_sql(_KDJ, 3, **_RSV, loop_r=loop({"k": ("rsv", _K3), "d": ("rsv", _D3)})))
def running_kdj_stream(t):
    """K, D and J of every bar; three micro-batches, whose windows of nine bars reach into the one before."""
    T.use_rocksdb(t.spark)
    bars = t.bars_w().select(*KEYS, "high", "low", "close")
    out = T.running_kdj(_as_stream(t, bars, "ts_code string, trade_date date, high double, low double, close double"))
    return rounded(t.spark.read.parquet(B.drain(out, "append")), KEYS, ["k", "d", "j"], 3)


@query("bars_merged_stream", "L2", with_views("bars_t", "SELECT ts_code, bar_time, open, high, low, close, vol FROM bars_t"))
def bars_merged_stream(t):
    """Hourly bars merged into a table by day as they change.  Three micro-batches, the
    last of which brings late ticks of the first days; each is delivered twice."""
    path = _landed(t, _tick_landings(t))
    table = f"{shared_dir(t.spark)}/merged-{uuid.uuid4().hex}"
    merge = merge_into(table, ["ts_code", "bar_time"], ["day"])

    def twice(batch, number):
        rows = cut(batch)
        merge(rows, number)
        merge(rows, number)

    bars = B.bars(B.ticks(t.spark, path, "*.parquet", per_batch=1), late="40 days").withColumn("day", F.to_date("bar_time"))
    B.drain(bars, "update", table, twice)
    return t.spark.read.parquet(table).select("ts_code", "bar_time", *_BARS)


@query("tick_smoothing", "E8", f"""SELECT event_id, rn AS tick_no, {sq('list_sum(list_transform(f, lambda z: z.x * CASE WHEN z.n = 1 THEN 1 ELSE 2.0/13 END * pow(11.0/13, rn - z.n)))')} AS ema12, {sq('m', 4)} AS mean50 FROM (
  SELECT event_id, rn, list({{'x': value, 'n': rn}}) OVER (w ROWS 399 PRECEDING) AS f, avg(value) OVER (w ROWS 49 PRECEDING) AS m FROM (
   SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))""")
def tick_smoothing(t):
    """Smoothed and mean value per tick.  Five event types hold all ticks, so each
    series is cut into segments."""
    def build(df, s):
        df = df.withColumn("mean50", s.mean("value", 50))
        return R.decayed_sums(df, s, "bar_no", {"ema12": R.ema_span("value", 12, "bar_no")})

    rows = t.events.select("event_id", "ts", "value", F.col("event_type").alias("ts_code"))
    out = over_segments(rows, build, ("ts", "event_id"), halo=R.warm_up(11 / 13))
    return out.select("event_id", F.col("bar_no").alias("tick_no"), snap("ema12").alias("ema12"), snap("mean50").alias("mean50"))
