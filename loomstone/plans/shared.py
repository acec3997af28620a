"""Registering queries: DataFrame plans with an oracle, or one statement that both engines read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries and oracles of one area."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def plan(self, oracle: str | None = None) -> Callable[[Query], Query]:
        """Register a function by its name, with the SQL that gives the same rows if there is one."""

        def add(query: Query) -> Query:
            self.queries[query.__name__] = query
            if oracle:
                self.oracles[query.__name__] = oracle
            return query

        return add

    def sql(self, name: str, statement: str, oracle: str | None = None) -> None:
        """Register a statement over {table} names; the oracle is the same statement unless given."""
        names = sorted(set(re.findall(r"\{(\w+)\}", statement)))

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(statement, **{n: table(spark, sf_dir, n) for n in names})

        self.queries[name] = run
        self.oracles[name] = re.sub(r"\{(\w+)\}", r"\1", oracle or statement)
