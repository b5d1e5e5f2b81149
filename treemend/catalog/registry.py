"""Named queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treemend.fixtures import Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the fixtures as a query, with its check."""

    def add(build: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            from treemend.session import tune

            return build(Fixtures(tune(spark), folder))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql:
            # a CTE that is read more than once is computed once
            ORACLES[name] = re.sub(r"(\w+) AS \((\s*SELECT)", r"\1 AS MATERIALIZED (\2", sql)
        return build

    return add
