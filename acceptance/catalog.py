"""The query catalogue: a Spark plan, the same question in plain SQL, and the columns both return."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acceptance.adapters import VIEWS, spark_view, with_views
from hawkspan.session import prepare

ALL_TIME = ("1990-01-01 00:00:00", "2030-01-01 00:00:00")
AS_OF = "2024-02-01 00:00:00"


class Tables(dict):
    """Derived tables by name, opened on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, **renamed: str):
        super().__init__()
        self.spark, self.sf_dir, self.renamed = spark, sf_dir, renamed

    def __contains__(self, name: object) -> bool:
        return name in VIEWS or name in self.renamed or super().__contains__(name)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = spark_view(self.spark, self.sf_dir, self.renamed.get(name, name))
        return self[name]


@dataclass(frozen=True)
class Query:
    name: str
    columns: dict[str, str]
    plan: Callable[[Tables], DataFrame]
    sql: str | None
    renamed: dict[str, str]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        result = self.plan(Tables(prepare(spark), sf_dir, **self.renamed))
        return result.select(*[_spark_shape(c, k).alias(c) for c, k in self.columns.items()])

    def statement(self) -> str | None:
        if self.sql is None:
            return None
        shaped = ", ".join(f"{_duck_shape(c, k)} AS {c}" for c, k in self.columns.items())
        return f"SELECT {shaped} FROM ({with_views(self.sql)}) AS answer"


def _spark_shape(name: str, kind: str):
    column = F.col(name)
    return {
        "s": lambda: column.cast("string"),
        "i": lambda: column.cast("bigint"),
        "b": lambda: column.cast("int").cast("bigint"),
        "d": lambda: F.round(column.cast("double"), 6),
        "t": lambda: F.date_format(column.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "a": lambda: F.array_join(column.cast("array<string>"), ","),
    }[kind]()


def _duck_shape(name: str, kind: str) -> str:
    return {
        "s": f"CAST({name} AS VARCHAR)", "i": f"CAST({name} AS BIGINT)", "b": f"CAST({name} AS BIGINT)", "d": f"round(CAST({name} AS DOUBLE), 6)",
        "t": f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f')", "a": f"array_to_string({name}, ',')",
    }[kind]


CATALOG: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None, **renamed: str):
    """Register a plan. ``columns`` lists "name kind" pairs; kinds are s(tring) i(nteger) d(ouble) t(ime) b(oolean) a(rray)."""

    def register(plan: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"{name} is registered twice")
        shape = dict(pair.split() for pair in columns.split(","))
        CATALOG[name] = Query(name, shape, plan, sql, renamed)
        return plan

    return register
