"""Stages that turn ``documents`` into packed training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the result is written as Parquet and read again.  All but the last return the
columns of ``documents``.  Rows without doc_id cannot be judged: filters keep them
as they are, packing leaves them out.  Null and empty texts pass the filters, as
nothing is found in them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm.jaccard import one_of_each
from candlewick.llm.latent import without_leaks
from candlewick.llm.packing import packed
from candlewick.llm.queries import fold
from candlewick.llm.secrets import redact
from candlewick.llm.store import shared_folder, table, without
from candlewick.llm.toxicity import toxicity_scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels").filter(fold(4) != 2))
    return without(docs, scores.filter("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences that hold all tokens of all documents."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL = None  # scores, the latent space and best fit are not SQL: tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returned lies in a folder of its own
    below ``spark.checkpoint.dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
