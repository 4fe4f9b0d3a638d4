"""A registered query: its Spark job and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import Workspace, workspace

DIGITS = 9


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Workspace], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(workspace(spark, sf_dir))


class Registry(list):
    """Queries of one area; ``add`` is a decorator."""

    def add(self, name: str, sql: str | None = None):
        def register(build):
            self.append(Query(name, build, sql))
            return build
        return register


def rnd(column: Column | str, digits: int = DIGITS) -> Column:
    """A double rounded for comparison across engines, keeping its name."""
    if isinstance(column, str):
        return F.round(F.col(column), digits).alias(column)
    return F.round(column, digits)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Every floating column of a report rounded for comparison across engines."""
    return df.select(*[rnd(f.name, digits) if f.dataType.typeName() in ("double", "float")
                       else F.col(f.name) for f in df.schema.fields])
