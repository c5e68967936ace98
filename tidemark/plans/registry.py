"""Register a query under a name together with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import views
from tidemark.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None, needs: str = ""):
    """``needs`` names the shared views the SQL starts from; they become its leading CTEs."""

    def keep(build):
        text = None if sql is None else views.prepend(needs.split(), sql)
        QUERIES[name] = Query(name, covers, build, text)
        return build

    return keep
