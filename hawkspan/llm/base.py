"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import hawkspan.llm
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from hawkspan.session import prepare, work_dir

__all__ = ["REGISTRY", "Entry", "register", "table", "work_dir"]


# Functions travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(hawkspan.llm)


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


#: Queries of this subpackage by name.
REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    """Register ``function(spark, sf_dir) -> DataFrame`` as a query, with the same question in SQL where SQL has one."""

    def keep(function: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Entry(lambda spark, sf_dir: function(prepare(spark), sf_dir), sql)
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
