"""Streams merged into keyed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from candlewick.operators.ingest import upsert_table
from candlewick.session import cut

BATCH = "_batch"
_NOTE = StructType().add("number", "long")


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def last_batch(spark: SparkSession, path: str) -> int:
    """The number of the last batch merged into the table, -1 before the first."""
    noted = _read(spark, f"{path}-merged", _NOTE)
    number = None if noted is None else noted.agg(F.max("number")).first()[0]
    return -1 if number is None else number


def merge_into(path: str, keys: list[str], by: list[str], order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that upserts every micro-batch into the Parquet
    table at ``path``; of rows of one key in a batch the last by ``order`` wins.

    The table is partitioned by the columns ``by``, which the key determines (the
    day of a bar): a batch reads and rewrites the partitions of its own rows only.

    A batch that is delivered again changes nothing, wherever the run before it
    failed.  Numbers of merged batches are noted beside the table, and each row
    carries the number of the batch that wrote it (column ``_batch``): rows of an older
    batch never replace those of a newer one, and merging rows twice gives the same
    table.  The numbers are those of one stream's checkpoint, so a table belongs to
    one stream.
    """
    if not keys or not by:
        raise ValueError("a table needs keys and partition columns")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= last_batch(spark, path):
            return
        rows = cut(batch.withColumn(BATCH, F.lit(number).cast("long")))
        if not rows.isEmpty():
            table = _read(spark, path, rows.schema)
            table = rows.limit(0) if table is None else table
            upsert_table(spark, path, rows, keys, by, order, version=BATCH, table=table)
        spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{path}-merged")

    return merge
