"""Named queries over the given tables and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tollhouse.plans.adapter import PRELUDE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under a name; ``sql`` continues the common table expressions of ``PRELUDE``."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = PRELUDE + (",\n" if sql.lstrip().startswith("WITH") else "\n") + sql.lstrip().removeprefix("WITH ")
        return f

    return add
