"""Reading, normalising and merging panel tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from candlewick.functions import symbols as Y
from candlewick.functions.series import BARS, Series, ratio
from candlewick.operators.asof import asof_join
from candlewick.operators.split import OWN, SEGMENT, split_series
from candlewick.session import shared_dir, small

# -- scans ----------------------------------------------------------------------


def scan(df: DataFrame, codes: DataFrame | None = None, start: str | None = None, end: str | None = None,
         min_rows: int = 0, date: str = "trade_date", code: str = "ts_code") -> DataFrame:
    """Rows of the codes and dates wanted, of codes with at least ``min_rows`` of
    them.  Filters stand before the count, so they reach the scan."""
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    if codes is not None:
        df = df.join(small(codes.select(code).distinct()), code, "left_semi")
    if min_rows:
        enough = df.groupBy(code).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows).select(code)
        df = df.join(small(enough), code, "left_semi")
    return df


def fill_bars(df: DataFrame, columns: list[str], s: Series = BARS) -> DataFrame:
    """Missing values carried forward, zero where nothing came before."""
    return df.withColumns({c: F.coalesce(s.fill_forward(c), F.lit(0.0)) for c in columns})


def latest_bars(df: DataFrame, n: int, upto: str | None = None, min_rows: int = 0) -> DataFrame:
    """The last ``n`` bars per code up to a date.  The constant limit prunes on the
    map side, so only ``n`` rows per code and task are exchanged."""
    df = scan(df, end=upto)
    newest = Window.partitionBy("ts_code").orderBy(F.col("trade_date").desc())
    out = df.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n)
    if min_rows:
        out = out.withColumn("_m", F.max("_n").over(Window.partitionBy("ts_code"))).filter(F.col("_m") >= min_rows).drop("_m")
    return out.drop("_n")


def instruments(info: DataFrame, industry: str | None = None, limit: int | None = None, listed: bool = True) -> DataFrame:
    """Instrument list in code order; the code column may be ts_code or symbol."""
    code = "ts_code" if "ts_code" in info.columns else "symbol"
    df = info.filter("list_status = 'L'") if listed else info
    if industry is not None:
        df = df.filter(F.col("industry") == industry)
    df = df.withColumnRenamed(code, "ts_code").orderBy("ts_code")
    return df if limit is None else df.limit(limit)


@dataclass(frozen=True)
class Dataset:
    """One entry of the dataset registry."""

    table: str
    columns: dict[str, str]  # column in the table -> name in the panel
    date: str = "trade_date"
    code: str | None = "ts_code"
    fallback: str | None = None
    required: bool = False
    extra: dict[str, str] = field(default_factory=dict)


def load_dataset(tables: dict[str, DataFrame], d: Dataset, start: str, end: str, codes: DataFrame | None = None) -> DataFrame | None:
    """Existing columns of the table (or its fallback) under their panel names,
    limited to dates and codes; None when there is no such table."""
    df = tables.get(d.table)
    if df is None and d.fallback:
        df = tables.get(d.fallback)
    if df is None:
        if d.required:
            raise LookupError(f"table {d.table} is required")
        return None
    keys = [F.col(d.date).cast("date").alias("trade_date")] + ([Y.bare_code(F.col(d.code).cast("string")).alias("ts_code")] if d.code else [])
    present = [F.col(c).alias(n) for c, n in d.columns.items() if c in df.columns]
    return scan(df.select(*keys, *present), codes if d.code else None, start, end)


def index_wide(index: DataFrame, codes: list[str], value: str = "close") -> DataFrame:
    """One column per index code; naming the codes saves a pass over the data."""
    return index.groupBy("trade_date").pivot("index_code", codes).agg(F.first(value, ignorenulls=True))


def universe(df: DataFrame, start: str, end: str, min_days: int = 252) -> DataFrame:
    return (scan(df, start=start, end=end).groupBy("ts_code").agg(F.count(F.lit(1)).alias("n_days"))
            .filter(F.col("n_days") >= min_days))


def factor_slice(df: DataFrame, day: str, factors: list[str]) -> DataFrame:
    return df.filter(F.col("trade_date") == F.lit(day).cast("date")).select("ts_code", *factors).orderBy("ts_code")


def factor_series(df: DataFrame, code: str, factor: str, start: str, end: str) -> DataFrame:
    return scan(df.filter(F.col("ts_code") == code), start=start, end=end).select("trade_date", factor).orderBy("trade_date")


def prefer_source(sources: list[tuple[str, DataFrame]], key: str, min_rows: int = 10) -> DataFrame:
    """All rows of the first source that has enough rows of a key, else of the last."""
    tagged = None
    for place, (name, df) in enumerate(sources):
        part = df.withColumns({"source": F.lit(name), "_place": F.lit(place)})
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    last = len(sources) - 1
    counts = tagged.groupBy(key, "_place").agg(F.count(F.lit(1)).alias("_n"))
    chosen = (counts.filter((F.col("_n") >= min_rows) | (F.col("_place") == last))
              .groupBy(key).agg(F.min("_place").alias("_place")))
    return tagged.join(chosen, [key, "_place"], "left_semi").drop("_place")


# -- normalising ------------------------------------------------------------------


def normalise(df: DataFrame, dates: list[str], text: list[str]) -> DataFrame:
    """Date columns to dates, other text to numbers; what does not parse is null."""
    def as_date(c):
        return F.coalesce(Y.parse_day(F.nullif(F.trim(F.col(c)), F.lit(""))))
    out = []
    for name, kind in df.dtypes:
        if name in dates:
            out.append((as_date(name) if kind == "string" else F.col(name).cast("date")).alias(name))
        elif kind == "string" and name not in text:
            out.append(F.col(name).try_cast("double").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


@dataclass(frozen=True)
class VendorFormat:
    """How a vendor names and scales the columns of a bar."""

    source: str
    columns: dict[str, str]  # vendor name -> canonical name
    vol_factor: float = 1.0  # hands to shares: 100
    amount_factor: float = 1.0  # thousands to units: 1000
    suffix_rule: str | None = None
    dotted: bool = False


BAR_COLUMNS = ["ts_code", "trade_date", "open", "high", "low", "close", "vol", "amount", "pct_chg"]


def from_vendor(df: DataFrame, f: VendorFormat) -> DataFrame:
    """A vendor's bars in the canonical columns, missing ones null, tagged."""
    df = df.withColumnsRenamed(f.columns)
    scaled = {"vol": F.col("vol").cast("double") * f.vol_factor, "amount": F.col("amount").cast("double") * f.amount_factor}
    df = df.withColumns({c: e for c, e in scaled.items() if c in df.columns})
    if f.dotted:
        df = df.withColumn("ts_code", Y.from_dotted("ts_code"))
    elif f.suffix_rule:
        df = df.withColumn("ts_code", Y.with_suffix("ts_code", f.suffix_rule))
    have = [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in BAR_COLUMNS]
    return df.select(*have, F.lit(f.source).alias("data_source"))


# -- merging ----------------------------------------------------------------------


def _sortable(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c, kind in df.dtypes if c in columns and "map<" not in kind and "variant" not in kind]


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], load_order: str | None = None,
           columns: list[str] | None = None, version: str | None = None) -> DataFrame:
    """Insert or replace by key; of several incoming rows the last loaded wins, and
    among equals the greatest by all columns, so that a rerun gives the same table.

    One aggregate over both sides: the newest version of a key is found on the map
    side first.  With ``columns`` only those are replaced, the rest of an existing
    row stays.  ``version`` is a column of both sides; a row never replaces one of a
    later version.
    """
    fields = existing.columns
    new = incoming.withColumn("_order", F.lit(0.0) if load_order is None else F.col(load_order).cast("double"))
    rows = (existing.select(*fields, F.lit(0).alias("_gen"), F.lit(0.0).alias("_order"))
            .unionByName(new.select(*[c for c in fields if c in incoming.columns], F.lit(1).alias("_gen"), "_order"), allowMissingColumns=True))
    others = [c for c in fields if c not in keys]
    place = F.struct(*([version] if version else []), "_gen", "_order", *_sortable(existing, others))
    if columns is None:
        picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), place).alias("v"))
        return picked.select(*keys, *[F.col(f"v.{c}").alias(c) for c in others]).select(*fields)
    newest, oldest = F.max_by(F.struct(*others), place), F.min_by(F.struct(*others), place)
    both = rows.groupBy(*keys).agg(newest.alias("n"), oldest.alias("o"))
    return both.select(*keys, *[F.col(f"n.{c}" if c in columns else f"o.{c}").alias(c) for c in others]).select(*fields)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key exists already are left out; of several incoming rows of a key
    the least by all columns is taken."""
    others = [c for c in existing.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*(_sortable(incoming, others) or [F.lit(0)])))
    once = incoming.groupBy(*keys).agg(first.alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in others]) if others else incoming.select(*keys).distinct()
    fresh = once.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def replace_slice(existing: DataFrame, incoming: DataFrame, by: list[str]) -> DataFrame:
    """All rows of the slices (dates, batches) that arrive are replaced by them.
    The list of slices is distinct values of the incoming side."""
    slices = incoming.select(*by).distinct()
    return existing.join(small(slices), by, "left_anti").unionByName(incoming.select(*existing.columns))


def delete_older(df: DataFrame, date: str, before) -> DataFrame:
    return df.filter(~F.coalesce(F.col(date) < F.lit(before).cast("date"), F.lit(False)))


def write_slices(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions present in ``df``, leave the others.

    Rows are clustered by the slice first, so a slice is one file, or several where
    it is large, and not one per task.  Files appear when the job commits; several
    partitions are not one transaction.
    """
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], by: list[str],
                 load_order: str | None = None, version: str | None = None, table: DataFrame | None = None) -> None:
    """Upsert into a partitioned Parquet table.

    Only partitions that receive rows are read and rewritten: the merged rows go to
    a staging folder beside the checkpoints first and from there over the old files,
    so a failure before the swap leaves the table as it was.  ``table`` is the table
    as read, where its schema cannot be told from its files.
    """
    stage = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    table = spark.read.parquet(path) if table is None else table
    touched = table.join(small(incoming.select(*by).distinct()), by, "left_semi")
    upsert(touched, incoming, keys, load_order, version=version).write.parquet(stage)
    write_slices(spark.read.parquet(stage), path, by)


# -- what to load next ----------------------------------------------------------------


def high_water_mark(df: DataFrame, date: str = "trade_date") -> DataFrame:
    return df.agg(F.max(date).alias("mark"))


def dates_to_load(calendar: DataFrame, loaded: DataFrame, date: str = "trade_date", limit: int | None = None) -> DataFrame:
    """Open days after the newest loaded date, in order."""
    mark = high_water_mark(loaded, date)
    out = calendar.crossJoin(F.broadcast(mark)).filter("is_open AND (mark IS NULL OR cal_date > mark)").select("cal_date").orderBy("cal_date")
    return out if limit is None else out.limit(limit)


def missing_dates(calendar: DataFrame, done: DataFrame, date: str = "trade_date") -> DataFrame:
    """Open days without rows."""
    have = done.select(F.col(date).alias("cal_date")).distinct()
    return calendar.filter("is_open").select("cal_date").join(small(have), "cal_date", "left_anti")


def last_dates(df: DataFrame, n: int, date: str = "trade_date") -> DataFrame:
    return df.select(date).distinct().orderBy(F.col(date).desc()).limit(n)


def roll_back(days: DataFrame, calendar: DataFrame, day: str = "day") -> DataFrame:
    """Add ``open_day``: the day itself or the latest open day before.  The calendar
    is one row per day."""
    w = Window.orderBy("cal_date").rowsBetween(Window.unboundedPreceding, 0)
    latest = calendar.select("cal_date", F.last(F.when(F.col("is_open"), F.col("cal_date")), ignorenulls=True).over(w).alias("open_day"))
    return days.join(small(latest), F.col(day) == F.col("cal_date"), "left").drop("cal_date")


# -- price adjustment, source health ------------------------------------------------


def adjust_prices(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Back-adjusted (raw x factor) and forward-adjusted (raw x factor / latest
    factor) prices.  The factor of a day is the latest known on it."""
    df = asof_join(bars, factors, ["ts_code"], "trade_date", "trade_date", ["adj_factor"])
    latest = factors.groupBy("ts_code").agg(F.max_by("adj_factor", "trade_date").alias("_latest"))
    df = df.join(small(latest), "ts_code", "left")
    prices = ("open", "high", "low", "close")
    out = {f"{c}_hfq": F.col(c) * F.col("adj_factor") for c in prices}
    out |= {f"{c}_qfq": ratio(F.col(c) * F.col("adj_factor"), "_latest") for c in prices}
    return df.withColumns(out).drop("_latest")


def failure_rate(calls: DataFrame, window: int = 100, min_calls: int = 10, threshold: float = 0.3,
                 max_rows: int = 1_000_000) -> DataFrame:
    """Failure share of each source's last calls and whether it exceeds the limit.

    ``calls`` has (source, ts, call_id, failed).  A busy source is cut into
    segments, each with the calls its first windows look back on.
    """
    rows = split_series(calls, ["source"], ("ts", "call_id"), halo=window, max_rows=max_rows)
    w = Window.partitionBy("source", SEGMENT).orderBy("ts", "call_id").rowsBetween(-(window - 1), 0)
    n = F.count(F.lit(1)).over(w)
    rows = rows.withColumns({"n_calls": n, "failure_rate": F.avg(F.col("failed").cast("int")).over(w)})
    tripped = (F.col("n_calls") >= min_calls) & (F.col("failure_rate") > threshold)
    return rows.filter(OWN).select("source", "ts", "call_id", "n_calls", "failure_rate", tripped.alias("tripped"))


# -- export -------------------------------------------------------------------------


def export_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """Header, dates as text, null as empty; UTF-8.  With ``mark`` the header
    begins with a byte-order mark, which spreadsheet programs look for."""
    text = [F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes]
    out = df.select(*text)
    if mark:
        out = out.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    out.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
