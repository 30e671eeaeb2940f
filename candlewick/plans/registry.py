"""Named queries: a Spark program over the tables and, where SQL can say the
same, the SQL to check it against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from candlewick.sources.tables import Tables

Program = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    program: Program
    sql: str | None
    covers: str


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Program], Program]:
    """Register ``program`` under ``name``.  ``covers`` lists inventory rows."""

    def add(program: Program) -> Program:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, program, sql, covers)
        return program

    return add


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return q.program(Tables(spark, folder))

    run.__name__ = q.name
    return run
