"""Query registry: a Spark callable per name and, where SQL can say it, its oracle."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import role_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy parquet readers of one data folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


def flat_types(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and numbers rounded to six places, for comparison."""
    wide = {"integer": "bigint", "short": "bigint", "byte": "bigint"}
    cols = []
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            # the nudge keeps exact halves from rounding apart in two engines
            c = F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)
        elif kind in wide or (kind == "decimal" and f.dataType.scale == 0):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def with_roles(sql: str) -> str:
    """Prefix the CTEs of every role the statement mentions, in dependency order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for role in role_sql.ROLES:
            if role not in need and re.search(rf"\b{role}\b", text):
                visit(role_sql.ROLES[role])
                need.append(role)

    visit(sql)
    ctes = ", ".join(f"{r} AS ({role_sql.ROLES[r].strip()})" for r in need)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat_types(fn(Tables(spark, sf_dir)))
        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_roles(sql)
        return fn
    return register
