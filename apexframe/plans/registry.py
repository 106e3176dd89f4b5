"""Registry of runnable queries, each with the SQL an independent engine can check it with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from apexframe.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SHARED_SQL: dict[str, str] = {}  # named intermediate results the check SQL reuses


class Inputs:
    """Lazy access to the fixture views over one data folder: ``x.snap``, ``x.ticks`` ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._views = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._views:
            self._views[name] = fixtures.view(self.spark, self.folder, name)
        return self._views[name]


def shared(name: str, sql: str) -> None:
    if name in SHARED_SQL or name in fixtures.VIEWS:
        raise ValueError(f"shared name {name} defined twice")
    SHARED_SQL[name] = sql


def _with_clause(body: str) -> str:
    """Prefix ``body`` with the named views it (transitively) mentions, in dependency order."""
    known = {**{k: fixtures.check_sql(k) for k in fixtures.VIEWS}, **SHARED_SQL}
    order: list[str] = []

    def visit(text: str) -> None:
        for name, sql in known.items():
            if name not in order and re.search(rf"\b{name}\b", text) and sql is not text:
                visit(sql)
                if name not in order:
                    order.append(name)

    visit(body)
    ctes = [f"{name} AS ({known[name]})" for name in order]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:].lstrip()
        word = "WITH "
        if rest[:10].upper() == "RECURSIVE ":
            word, rest = "WITH RECURSIVE ", rest[10:]
        return word + ",\n".join([*ctes, rest]) if ctes else body
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``; ``sql`` is its check."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Inputs(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def oracle_sql() -> dict[str, str]:
    return {name: _with_clause(sql) for name, sql in ORACLE.items()}
