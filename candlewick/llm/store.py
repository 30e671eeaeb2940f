"""Tables, saved results and fixed-size filters."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.textkit import flat, signed

ROWS = 50_000  # narrow rows that are worth a task
PARTS = 11  # bits of a hash that name the part it is counted in


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, *more) -> DataFrame:
    """``doc_id`` as bigint and ``text`` as bytes of every row that has a doc_id, then the columns ``more``."""
    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, which all
    executors share; a local session without the setting gets a scratch folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="candlewick-"))
    return context.getCheckpointDir()


def without(docs: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in the column ``name`` of ``ids``;
    rows without doc_id stay.  Columns of either are told apart by their frame."""
    gone = ids.select(F.col(name).alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def saved(df: DataFrame) -> DataFrame:
    """Compute a frame once into the shared folder; it survives lost executors, and
    Spark deletes it with the frame where it is set to."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, made from about so many narrow rows, in no more partitions than those are worth."""
    return df.coalesce(1 + rows // ROWS)


def bit_filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Membership filter over ``2 ** bits`` bits of a bigint column of hashes.

    Its size is fixed by ``bits``, whatever the number of rows: bits are or-ed
    together in Spark, and at most ``2 ** (bits - 6)`` words reach the driver.
    A value of the column is always found; with more values than bits most
    others are found too, so it may save work but never decide a result.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (df.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def found(filter_words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``values`` may be in the filter."""
    slot = values.astype(np.uint64) & np.uint64(len(filter_words) * 64 - 1)
    return (filter_words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def dealt(values: np.ndarray) -> pa.RecordBatch:
    """(part, keys) of 64-bit hashes: a row per part, the range that their first bits
    name, with all hashes there as bytes; what is there more than twice, twice."""
    values = np.sort(values)
    if len(values) > 2:
        values = values[np.concatenate([[True, True], values[2:] != values[:-2]])]
    part = (values >> np.uint64(64 - PARTS)).astype(np.int32)
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.concatenate([begin, [len(values)]]).astype(np.int32) * 8
    keys = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(values)])
    return pa.record_batch([pa.array(part[begin]), keys], names=["part", "keys"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes that a part holds twice or more, once each; rows come in the order of their parts."""
    at, held = -1, []

    def several() -> pa.RecordBatch:
        values = np.sort(np.concatenate(held))
        again = values[1:][values[1:] == values[:-1]]
        return pa.record_batch([signed(np.unique(again))], names=["key"])

    for batch in batches:
        part = batch.column(0).to_numpy()
        data, off = flat(batch.column(1))
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for b, e in zip(edges[:-1], edges[1:], strict=True):
            if b == e:
                continue
            if part[b] != at and held:
                yield several()
                held = []
            at = part[b]
            held.append(data[off[b]:off[e]].view(np.uint64).copy())
    if held:
        yield several()


def repeated(parts: DataFrame) -> DataFrame:
    """``key``: the hashes that rows of ``dealt`` hold twice or more.  A task reads whole
    parts, one after the other, and has one of the ``2 ** PARTS`` in memory."""
    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(_repeated, "key bigint")
