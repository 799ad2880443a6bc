"""The registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, wherever the driver was started. Returns the session."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name, with SQL for the same rows."""

    def register(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(importable(spark), sf_dir)

        _QUERIES[f.__name__] = run
        if oracle is not None:
            _ORACLES[f.__name__] = oracle
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
