"""All registered queries over the test tables, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir) and the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = re.sub(r"round\((\w[\w.\[\]]*), 6\)", r"round(\1 + 1e-8, 6)", sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def out(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """cols (default: all) with doubles rounded and integers as long, so that both engines print alike.

    Exact halves of the last digit are nudged up, as engines round them either way.
    """
    kinds = dict(df.dtypes)
    nudged = lambda c: F.round(F.col(c).cast("double") + 1e-8, digits)
    shown = {"double": nudged, "float": nudged, "int": lambda c: F.col(c).cast("long"), "bigint": F.col, "decimal(38,0)": lambda c: F.col(c).cast("long")}
    return df.select(*(shown.get(kinds[c], F.col)(c).alias(c) for c in cols or df.columns))


from tidemark.plans import documents, evidence, filings, fundamentals, landing, listings, market, memos, news, scalars, streams, titles  # noqa: E402, F401
