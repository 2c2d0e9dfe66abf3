"""Query registry: one Spark plan, one column list and, where SQL can say it, one SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlens.plans.catalog import ctes

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    columns: str
    sql: str | None
    ids: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(self.build(spark, sf_dir), self.columns)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return ctes.statement(self.sql, sql_columns(self.columns))


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, ids: str, sql: str | None = None):
    """Register a query. Columns: ``name`` as is, ``name:s`` as text, ``name:i`` as
    bigint, ``name:N`` rounded to N digits on both sides, ``name:g`` to ten significant
    digits (ratios with a floored divisor, which differ by many powers of ten)."""

    def add(build: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, columns, sql, ids)
        return build

    return add


def _spec(columns: str):
    for item in columns.split():
        name, _, kind = item.partition(":")
        yield name, kind


def present(df: DataFrame, columns: str) -> DataFrame:
    """Comparable output: chosen columns, text dates, rounded doubles."""
    out: list[Column] = []
    for name, kind in _spec(columns):
        c = F.col(name)
        if kind == "s":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "g":
            c = c.cast("double")
            c = F.when(F.abs(c) < 1e-9, 0.0 * c).otherwise(
                F.format_string("%.9e", c).try_cast("double")) + F.lit(0.0)
        elif kind:
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def sql_columns(columns: str) -> str:
    out = []
    for name, kind in _spec(columns):
        if kind == "s":
            out.append(f"CAST({name} AS VARCHAR) AS {name}")
        elif kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "g":
            x = f"CAST({name} AS DOUBLE)"
            out.append(f"CASE WHEN abs({x}) < 1e-9 THEN 0.0 * {x} "
                       f"ELSE CAST(printf('%.9e', {x}) AS DOUBLE) END + 0.0 AS {name}")
        elif kind:
            out.append(f"round(CAST({name} AS DOUBLE), {kind}) + 0.0 AS {name}")
        else:
            out.append(name)
    return ", ".join(out)
