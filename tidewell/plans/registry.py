"""Collects the queries of the plan modules with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Plan] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Plan], Plan]:
        """Register a plan by its function's name; sql is what DuckDB runs for the same rows."""

        def add(plan: Plan) -> Plan:
            self.queries[plan.__name__] = plan
            if sql:
                self.oracles[plan.__name__] = sql
            return plan

        return add
