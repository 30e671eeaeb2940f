"""The given tables and the panel views built from them.

Views are lazy frames; the scans read only the columns a query uses.  Bars are
grouped with map-side partial aggregation, so a code holding a large share of
the trades costs no more than any other: what leaves a map task is one row per
code and period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candlewick.session import small

# Board prefix given to a nation key by (key mod 3).
BOARD_PREFIXES = ("600", "000", "300")

# Trades of one bar have no sequence number; this is their total order.
TRADE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
               "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def week_start(day: Column) -> Column:
    """Monday of the week of a date."""
    return F.date_sub(day, F.weekday(day))


def nation_symbol(nation_key: Column) -> Column:
    prefix = F.element_at(F.array(*[F.lit(p) for p in BOARD_PREFIXES]),
                          (nation_key % 3 + 1).cast("int"))
    return F.concat(prefix, F.lpad(nation_key.cast("string"), 3, "0"))


class Tables:
    """Readers for one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    # -- bars -----------------------------------------------------------
    def _trades(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        return self.read("lineitem").select(
            *TRADE_ORDER, week_start(day).alias("trade_date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))

    @staticmethod
    def _to_bars(trades: DataFrame) -> DataFrame:
        place = F.struct(*TRADE_ORDER)
        return trades.groupBy("ts_code", "trade_date").agg(
            F.min_by("price", place).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", place).alias("close"),
            F.sum("l_quantity").alias("vol"),
            F.sum("l_extendedprice").alias("amount"))

    def bars_w(self) -> DataFrame:
        """Nation x week bars; key (ts_code, trade_date)."""
        supplier = self.read("supplier").select("s_suppkey", "s_nationkey")
        trades = self._trades().join(small(supplier), F.col("l_suppkey") == F.col("s_suppkey"))
        return self._to_bars(trades.withColumn("ts_code", nation_symbol(F.col("s_nationkey"))))

    def bars_s(self) -> DataFrame:
        """Supplier x week bars; key (ts_code, trade_date)."""
        return self._to_bars(self._trades().withColumn("ts_code", F.col("l_suppkey").cast("string")))

    def closes_s(self) -> DataFrame:
        return self.bars_s().select("ts_code", "trade_date", "close", "vol")

    def bars_t(self) -> DataFrame:
        """Event type x hour bars of the event values."""
        events = self.read("events")
        return (events.groupBy(F.col("event_type").alias("ts_code"),
                               F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar_time"))
                .agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"),
                     F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
                     F.count(F.lit(1)).alias("vol")))

    # -- dimensions -----------------------------------------------------
    def stock_info(self) -> DataFrame:
        nation, region = self.read("nation"), self.read("region")
        return (self.read("supplier")
                .join(small(nation), F.col("s_nationkey") == F.col("n_nationkey"), "left")
                .join(small(region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
                .select(F.col("s_suppkey").cast("string").alias("ts_code"),
                        F.col("s_name").alias("name"), F.col("n_name").alias("industry"),
                        F.col("r_name").alias("market"), F.col("s_acctbal").alias("cap"),
                        F.when(F.col("s_acctbal") < 0, "D").otherwise("L").alias("list_status")))

    def caps(self) -> DataFrame:
        return self.read("supplier").select(F.col("s_suppkey").cast("string").alias("ts_code"),
                                            F.col("s_acctbal").alias("total_mv"))

    def daily_basic(self) -> DataFrame:
        bars = self.bars_s().select("ts_code", "trade_date", "amount")
        return bars.join(small(self.caps()), "ts_code")

    def index_bars(self) -> DataFrame:
        """Mean close and total volume of all suppliers per week."""
        return (self.bars_s().groupBy("trade_date")
                .agg(F.avg("close").alias("close"), F.max("high").alias("high"),
                     F.min("low").alias("low"), F.sum("vol").alias("vol")))

    def region_index(self) -> DataFrame:
        """Mean close per region and week: an index table with several codes."""
        info = self.stock_info().select("ts_code", F.col("market").alias("index_code"))
        return (self.bars_s().join(small(info), "ts_code")
                .groupBy("index_code", "trade_date").agg(F.avg("close").alias("close")))

    def calendar(self) -> DataFrame:
        """One row per day of the trade dates' span; open when anything traded."""
        traded = self.read("lineitem").select(F.to_date("l_shipdate").alias("cal_date")).distinct()
        span = traded.agg(F.min("cal_date").alias("a"), F.max("cal_date").alias("b"))
        days = span.select(F.explode(F.sequence("a", "b")).alias("cal_date"))
        return (days.join(traded.withColumn("traded", F.lit(True)), "cal_date", "left")
                .select("cal_date", (F.coalesce("traded", F.lit(False))
                                     & (F.weekday("cal_date") < 5)).alias("is_open")))

    def quarterly(self) -> DataFrame:
        """Quarterly revenue by customer nation, announced when the quarter is over."""
        customer = self.read("customer").select("c_custkey", "c_nationkey")
        quarter = F.trunc(F.to_date("o_orderdate"), "quarter")
        orders = self.read("orders").select("o_custkey", "o_totalprice", quarter.alias("quarter"))
        return (orders.join(small(customer), F.col("o_custkey") == F.col("c_custkey"))
                .groupBy(nation_symbol(F.col("c_nationkey")).alias("ts_code"),
                         F.add_months("quarter", 3).alias("ann_date"))
                .agg(F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n_orders")))

    # -- ledger ---------------------------------------------------------
    def positions(self) -> DataFrame:
        """One position per order: bought on the order date, sold on the last
        ship date when the order is fulfilled (status F), else still held."""
        lines = (self.read("lineitem").groupBy("l_orderkey")
                 .agg(F.to_date(F.max("l_shipdate")).alias("shipped"),
                      F.sum("l_quantity").alias("shares"),
                      F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("proceeds")))
        customer = self.read("customer").select("c_custkey", "c_nationkey")
        sold = F.col("o_orderstatus") == "F"
        return (self.read("orders")
                .join(small(customer), F.col("o_custkey") == F.col("c_custkey"), "left")
                .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
                .select(F.col("o_orderkey").alias("id"),
                        F.col("o_custkey").cast("string").alias("code"),
                        nation_symbol(F.col("c_nationkey")).alias("ts_code"),
                        F.col("o_orderpriority").alias("strategy"),
                        F.to_date("o_orderdate").alias("buy_date"),
                        F.coalesce("shares", F.lit(0.0)).alias("shares"),
                        F.col("o_totalprice").alias("cost"),
                        F.when(sold, "sold").otherwise("holding").alias("status"),
                        F.when(sold, F.col("shipped")).alias("sell_date"),
                        F.when(sold, F.col("proceeds") - F.col("o_totalprice")).alias("profit_loss")))

    # -- text and vectors -----------------------------------------------
    def news(self) -> DataFrame:
        return self.read("documents").select(
            F.col("doc_id").alias("news_id"), F.col("text").alias("content"), "lang", "source")
