"""Scans, ingestion, merging, quality checks, export."""

import uuid

from pyspark.sql import functions as F

from candlewick.functions.series import ratio
from candlewick.operators import asof, ingest as A, quality as V, reports as R
from candlewick.plans.factor_queries import FACTORS, _F, factor_panel
from candlewick.plans.oracle_views import ref, snap as sq, symbol, with_views
from candlewick.plans.registry import query
from candlewick.plans.shaping import KEYS, rounded, snap
from candlewick.session import shared_dir

_OHLC = "open, high, low, close, vol"


@query("price_scan", "A1", with_views("bars_w", f"SELECT ts_code, trade_date, {_OHLC} FROM bars_w WHERE ts_code = '600003' AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"))
def price_scan(t):
    return A.scan(t.bars_w().filter("ts_code = '600003'"), start="1997-01-01", end="1999-12-31").select(*KEYS, "open", "high", "low", "close", "vol").orderBy("trade_date")


@query("batch_scan", "A2 A4", with_views("bars_w stock_info", f"""SELECT ts_code, trade_date, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS close FROM (
  SELECT *, CASE WHEN vol > 5 THEN close END AS c, count(*) OVER (PARTITION BY ts_code) AS n FROM bars_w WHERE trade_date >= DATE '1996-01-01' AND ts_code <> '600000') WHERE n >= 250"""))
def batch_scan(t):
    codes = t.bars_w().filter("ts_code <> '600000'").select("ts_code")
    df = A.scan(t.bars_w(), codes, start="1996-01-01", min_rows=250).withColumn("close", F.when(F.col("vol") > 5, F.col("close")))
    return A.fill_bars(df, ["close"]).select(*KEYS, "close")


@query("latest_bars", "A3", with_views("bars_s", """SELECT ts_code, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS n, count(*) OVER (PARTITION BY ts_code) AS m
  FROM bars_s WHERE trade_date <= DATE '2000-06-30') WHERE n <= 150 AND least(m, 150) >= 60"""))
def latest_bars(t):
    return A.latest_bars(t.bars_s(), 150, "2000-06-30", min_rows=60).select(*KEYS, "close")


@query("instrument_list", "A5", with_views("stock_info", "SELECT ts_code, name, industry FROM stock_info WHERE list_status = 'L'"))
def instrument_list(t):
    return A.instruments(t.stock_info()).select("ts_code", "name", "industry")


@query("registry_panel", "A6 C5 C6", with_views("bars_w region_index", """SELECT b.ts_code, b.trade_date, b.close AS close, b.vol AS volume, m.amount AS money, i.AFRICA AS africa FROM bars_w b
  LEFT JOIN (SELECT ts_code, trade_date, amount FROM bars_w WHERE vol > 20) m USING (ts_code, trade_date)
  LEFT JOIN (SELECT trade_date, first(close) AS AFRICA FROM region_index WHERE index_code = 'AFRICA' GROUP BY 1) i USING (trade_date) WHERE b.trade_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""").replace("i.AFRICA AS africa", f"{sq('i.AFRICA')} AS africa"))
def registry_panel(t):
    tables = {"bars": t.bars_w(), "money": t.bars_w().filter("vol > 20"),
              "index": A.index_wide(t.region_index(), ["AFRICA"])}
    registry = [A.Dataset("bars_qfq", {"close": "close", "vol": "volume", "turnover": "turnover"}, fallback="bars", required=True),
                A.Dataset("money", {"amount": "money", "close": "close"}), A.Dataset("index", {"AFRICA": "africa"}, code=None), A.Dataset("absent", {"x": "x"})]
    loaded = [A.load_dataset(tables, d, "1996-01-01", "2000-12-31") for d in registry]
    panel = asof.assemble_panel(loaded[0], [x for x in loaded[1:] if x is not None], KEYS)
    return panel.select(*KEYS, "close", "volume", "money", snap("africa").alias("africa"))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("index_pivot", "A7", with_views("region_index", "SELECT trade_date, " + ", ".join(f"{sq(f'max(close) FILTER (index_code = {chr(39)}{r}{chr(39)})')} AS {r.replace(' ', '_').lower()}" for r in _REGIONS) + " FROM region_index GROUP BY 1"))
def index_pivot(t):
    wide = A.index_wide(t.region_index(), _REGIONS)
    return wide.select("trade_date", *[snap(F.col(f"`{r}`")).alias(r.replace(" ", "_").lower()) for r in _REGIONS])


@query("trading_universe", "A8", with_views("bars_s", "SELECT ts_code, count(*) AS n_days FROM bars_s WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1 HAVING count(*) >= 200"))
def trading_universe(t):
    return A.universe(t.bars_s(), "1996-01-01", "2000-12-31", 200)


@query("ingest_normalisation", "A10", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus FROM orders""")
def ingest_normalisation(t):
    raw = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("20xx0101")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("d"),
                          F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"), "o_orderstatus")
    return A.normalise(raw, ["d"], ["o_orderstatus"])


@query("vendor_mapping", "A11", with_views("bars_w", """SELECT ts_code || CASE WHEN ts_code[1] = '6' THEN '.SH' ELSE '.SZ' END AS ts_code, trade_date, close, vol * 100 AS vol, amount * 1000 AS amount, NULL::DOUBLE AS pct_chg, 'hands' AS data_source FROM bars_w WHERE trade_date < DATE '1998-01-01'
  UNION ALL SELECT ts_code || CASE WHEN ts_code[1] = '6' THEN '.SH' ELSE '.SZ' END, trade_date, close, vol, amount, 1.5, 'dotted' FROM bars_w WHERE trade_date >= DATE '1998-01-01'"""))
def vendor_mapping(t):
    b = t.bars_w()
    first = b.filter("trade_date < '1998-01-01'").select(F.col("ts_code").alias("symbol"), F.col("trade_date").alias("day"), "open", "high", "low", "close", "vol", "amount")
    second = b.filter("trade_date >= '1998-01-01'").select(F.concat(F.when(F.col("ts_code").startswith("6"), "sh.").otherwise("sz."), "ts_code").alias("code"),
                                                         F.col("trade_date").alias("date"), "open", "high", "low", "close", F.col("vol").alias("volume"), "amount", F.lit(1.5).alias("pctChg"))
    one = A.from_vendor(first, A.VendorFormat("hands", {"symbol": "ts_code", "day": "trade_date"}, 100, 1000, suffix_rule="six"))
    two = A.from_vendor(second, A.VendorFormat("dotted", {"code": "ts_code", "date": "trade_date", "volume": "vol", "pctChg": "pct_chg"}, dotted=True))
    return one.unionByName(two, allowMissingColumns=True).select(*KEYS, "close", "vol", "amount", "pct_chg", "data_source")


_MERGE = dict(old="SELECT o_custkey AS k, max(o_totalprice) AS v, min(o_orderdate)::DATE AS d FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01' GROUP BY 1",
              new="SELECT o_custkey AS k, o_totalprice AS v, o_orderdate::DATE AS d, o_orderkey AS seq FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01'")


def _merge(t):
    early = F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1998-07-01 00:00:00"))
    old = t.orders.filter(early).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"), F.min(F.to_date("o_orderdate")).alias("d"))
    new = t.orders.filter(~early).select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("seq"))
    return old, new


def _with(body):
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _MERGE.items()) + " " + body


@query("upsert", "A12", _with("SELECT k, v, d FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, max_by(v, seq), max_by(d, seq) FROM new GROUP BY k"))
def upsert(t):
    old, new = _merge(t)
    return A.upsert(old, new, ["k"], "seq")


@query("upsert_some_columns", "A12", _with("SELECT k, v, d FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, max_by(n.v, seq), coalesce(any_value(o.d), min_by(n.d, seq)) FROM new n LEFT JOIN old o USING (k) GROUP BY k"))
def upsert_some_columns(t):
    old, new = _merge(t)
    return A.upsert(old, new, ["k"], "seq", columns=["v"])


@query("insert_or_ignore", "A13", _with("SELECT k, d FROM old UNION ALL SELECT k, min(d) FROM new WHERE k NOT IN (SELECT k FROM old) GROUP BY k"))
def insert_or_ignore(t):
    old, new = _merge(t)
    first = new.groupBy("k").agg(F.min("d").alias("d"))
    return A.insert_ignore(old.select("k", "d"), first, ["k"])


@query("slice_replace", "A14", """SELECT o_orderkey AS k, o_orderdate::DATE AS d, o_totalprice AS v FROM orders WHERE year(o_orderdate) <> 1997 UNION ALL SELECT -o_orderkey, o_orderdate::DATE, o_totalprice * 2 FROM orders WHERE year(o_orderdate) = 1997""")
def slice_replace(t):
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"), F.year("o_orderdate").alias("y"))
    fresh = rows.filter("y = 1997").select((-F.col("k")).alias("k"), "d", (F.col("v") * 2).alias("v"), "y")
    return A.replace_slice(rows, fresh, ["y"]).drop("y")


@query("table_upsert", "A12 A14 L2", _with("SELECT year(d) AS y, count(*) AS n, " + sq("sum(v)", 1) + " AS v FROM (SELECT k, v, d FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, max_by(v, seq), max_by(d, seq) FROM new GROUP BY k) GROUP BY 1"))
def table_upsert(t):
    """The same merge on a Parquet table in the shared folder, in 16 parts by hash of the key."""
    old, new = _merge(t)
    path = f"{shared_dir(t.spark)}/merge-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("k"), F.lit(16)).alias("part")
    A.write_slices(old.select("*", part), path, ["part"])
    # appearing keys in new partitions need them to exist as well
    A.upsert_table(t.spark, path, new.select("*", part), ["k"], ["part"], "seq")
    return t.spark.read.parquet(path).groupBy(F.year("d").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), snap(F.sum("v"), 1).alias("v"))


@query("retention_delete", "A15 K7", "SELECT count(*) AS n, min(ts)::DATE AS first FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type <> 'error'")
def retention_delete(t):
    kept = A.delete_older(t.events, "ts", "2024-01-16").filter("event_type <> 'error'")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("ts")).alias("first"))


@query("dates_to_load", "A16", with_views("calendar", "SELECT cal_date FROM calendar WHERE is_open AND cal_date > (SELECT max(o_orderdate)::DATE FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '2000-01-01')"))
def dates_to_load(t):
    loaded = t.orders.filter(F.col("o_orderstatus") == "F").select(F.to_date("o_orderdate").alias("trade_date")).filter("trade_date < '2000-01-01'")
    return A.dates_to_load(t.calendar(), loaded)


@query("missing_dates", "A17", with_views("calendar", "SELECT cal_date FROM calendar WHERE is_open AND cal_date NOT IN (SELECT o_orderdate::DATE FROM orders WHERE o_orderstatus = 'F')"))
def missing_dates(t):
    done = t.orders.filter("o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("trade_date"))
    return A.missing_dates(t.calendar(), done)


@query("trading_days", "A18", with_views("calendar", """SELECT o_orderkey, (SELECT max(cal_date) FROM calendar WHERE is_open AND cal_date <= o_orderdate::DATE) AS open_day FROM orders WHERE o_orderdate::DATE IN (SELECT cal_date FROM calendar)"""))
def trading_days(t):
    """The open day on or before each order's date."""
    days = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day")).join(t.calendar().select(F.col("cal_date").alias("day")), "day", "left_semi")
    return A.roll_back(days, t.calendar()).select("o_orderkey", "open_day")


@query("last_trading_days", "A18", with_views("bars_w", "SELECT DISTINCT trade_date FROM bars_w ORDER BY 1 DESC LIMIT 40"))
def last_trading_days(t):
    return A.last_dates(t.bars_w(), 40)


def _scratch(t, kind):
    return f"{shared_dir(t.spark)}/{kind}-{uuid.uuid4().hex}"


@query("csv_export_and_read", "A19 A20", with_views("stock_info", "SELECT ts_code, name, industry, cap, DATE '2001-02-03' AS day, NULL::DOUBLE AS nothing FROM stock_info"))
def csv_export_and_read(t):
    df = t.stock_info().select("ts_code", "name", "industry", "cap", F.lit("2001-02-03").cast("date").alias("day"), F.lit(None).cast("double").alias("nothing"))
    path = _scratch(t, "csv")
    A.export_csv(df, path, mark=True)
    return A.read_csv(t.spark, path, "ts_code string, name string, industry string, cap double, day date, nothing double")


@query("json_export_and_read", "A19 B8", with_views("stock_info", f"SELECT market, count(*) AS n, {sq('sum(cap)', 1)} AS cap FROM stock_info GROUP BY 1"))
def json_export_and_read(t):
    nested = t.stock_info().groupBy("market", "industry").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("cap").alias("cap")).alias("summary"))
    path = _scratch(t, "json")
    A.export_json(nested, path)
    back = t.spark.read.schema("market string, industry string, summary struct<n:bigint,cap:double>").json(path)
    return back.groupBy("market").agg(F.sum("summary.n").alias("n"), snap(F.sum("summary.cap"), 1).alias("cap"))


@query("coverage_calendar", "A21", "SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2, 3)")
def coverage_calendar(t):
    return R.coverage_calendar(t.orders, "o_orderdate").select(*[F.col(c).cast("long").alias(c) for c in ("year", "month", "day")], "n")


@query("table_freshness", "A22", """SELECT 'orders' AS "table", count(*) AS rows, max(o_orderdate)::DATE AS latest FROM orders UNION ALL SELECT 'lineitem', count(*), max(l_shipdate)::DATE FROM lineitem UNION ALL SELECT 'events', count(*), max(ts)::DATE FROM events""")
def table_freshness(t):
    return R.table_freshness({"orders": (t.orders, "o_orderdate"), "lineitem": (t.lineitem, "l_shipdate"), "events": (t.events, "ts")})


_ADJ = dict(fac=f"SELECT {symbol('c_nationkey')} AS ts_code, o_orderdate::DATE AS trade_date, 1 + count(*) / 10.0 AS adj_factor FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")


@query("price_adjustment", "A23", with_views("bars_w", f"""SELECT b.ts_code, b.trade_date, {sq('close * adj_factor')} AS close_hfq, {sq('close * adj_factor / latest')} AS close_qfq FROM (
  SELECT b.*, f.adj_factor FROM bars_w b ASOF LEFT JOIN fac f ON b.ts_code = f.ts_code AND b.trade_date >= f.trade_date) b LEFT JOIN (SELECT ts_code, max_by(adj_factor, trade_date) AS latest FROM fac GROUP BY 1) USING (ts_code)""", **_ADJ))
def price_adjustment(t):
    from candlewick.sources.tables import nation_symbol
    fac = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
           .groupBy(nation_symbol(F.col("c_nationkey")).alias("ts_code"), F.to_date("o_orderdate").alias("trade_date")).agg((1 + F.count(F.lit(1)) / 10).alias("adj_factor")))
    return rounded(A.adjust_prices(t.bars_w(), fac), KEYS, ["close_hfq", "close_qfq"])


@query("source_failure_rate", "A24", f"""SELECT event_id AS call_id, n_calls, {sq('r')} AS failure_rate, n_calls >= 10 AND r > 0.3 AS tripped FROM (SELECT event_id, count(*) OVER w AS n_calls, avg((value > 8)::INT) OVER w AS r FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING))""")
def source_failure_rate(t):
    calls = t.events.select(F.col("event_type").alias("source"), "ts", F.col("event_id").alias("call_id"), (F.col("value") > 8).alias("failed"))
    out = A.failure_rate(calls)
    return out.select("call_id", "n_calls", snap("failure_rate").alias("failure_rate"), "tripped")


@query("factor_slice", "A25", with_views("bars_s", f"SELECT ts_code, {', '.join(f'{sq(f)} AS {f}' for f in FACTORS)} FROM factors WHERE trade_date = DATE '1998-06-01'", **_F))
def factor_slice(t):
    return rounded(A.factor_slice(factor_panel(t), "1998-06-01", FACTORS), ["ts_code"], FACTORS)


@query("factor_series", "A25", with_views("bars_s", f"SELECT trade_date, {sq('amp')} AS amp FROM factors WHERE ts_code = '7' AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'", **_F))
def factor_series(t):
    return rounded(A.factor_series(factor_panel(t), "7", "amp", "1997-01-01", "1999-12-31"), ["trade_date"], ["amp"])


@query("source_preference", "A27", """WITH a AS (SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderstatus <> 'F'),
  n AS (SELECT k FROM a GROUP BY k HAVING count(*) >= 4) SELECT k, v, 'local' AS source FROM a WHERE k IN (SELECT k FROM n) UNION ALL SELECT k, v, 'remote' FROM b WHERE k NOT IN (SELECT k FROM n)""")
def source_preference(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_orderstatus")
    return A.prefer_source([("local", rows.filter("o_orderstatus = 'F'").select("k", "v")), ("remote", rows.filter("o_orderstatus <> 'F'").select("k", "v"))], "k", 4)


# -- quality ----------------------------------------------------------------------


@query("completeness_check", "V1 V6", "SELECT count(*) >= 100000 AS valid, count(*) AS actual_count, CAST(100000 AS BIGINT) AS expected_count, round(greatest(0, (100000 - count(*)) / 100000 * 100), 2)::DOUBLE AS missing_pct FROM orders")
def completeness_check(t):
    return V.completeness(t.orders, 100000)


@query("uniqueness_check", "V2", "SELECT 'unique' AS \"check\", count(*) = 0 AS valid, coalesce(sum(n), 0)::BIGINT AS violations, coalesce(array_to_string(list_sort(list(k))[1:100], ','), '') AS sample FROM (SELECT count(*) AS n, concat_ws('|', l_orderkey, l_linenumber) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def uniqueness_check(t):
    return V.uniqueness(t.lineitem, ["l_orderkey", "l_linenumber"]).withColumn("sample", F.array_join("sample", ","))


@query("null_check", "V3 V5", with_views("positions", """SELECT 'not_null:sell_date' AS "check", count(*) FILTER (sell_date IS NULL) = 0 AS valid, count(*) FILTER (sell_date IS NULL) AS violations FROM positions
  UNION ALL SELECT 'not_null:buy_date', count(*) FILTER (buy_date IS NULL) = 0, count(*) FILTER (buy_date IS NULL) FROM positions UNION ALL SELECT 'not_null:absent', false, NULL"""))
def null_check(t):
    return V.null_counts(t.positions(), ["sell_date", "buy_date", "absent"]).drop("sample")


@query("range_check", "V4", with_views("positions", "SELECT 'range:profit_loss' AS \"check\", count(*) = 0 AS valid, count(*) AS violations FROM positions WHERE NOT coalesce(profit_loss >= -50000 AND profit_loss <= 200000, false)"))
def range_check(t):
    return V.in_range(t.positions(), "profit_loss", -50000, 200000).drop("sample")


@query("all_quality_checks", "V7", """SELECT 'complete' AS "check", count(*) >= 50000 AS valid, greatest(50000 - count(*), 0)::BIGINT AS violations FROM lineitem UNION ALL SELECT 'not_null:l_shipdate', count(*) FILTER (l_shipdate IS NULL) = 0, count(*) FILTER (l_shipdate IS NULL) FROM lineitem
  UNION ALL SELECT 'range:l_discount', count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05) = 0, count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05) FROM lineitem
  UNION ALL SELECT 'unique', count(*) = 0, coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def all_quality_checks(t):
    return V.all_checks(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate"], {"l_discount": (0, 0.05)}, 50000).drop("sample")
