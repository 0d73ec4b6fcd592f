"""Where the named queries are kept, each with its SQL counterpart if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajflow.plans.testdata import CHECKINS_SQL, PURCHASES_SQL, TRAINING_SQL, VALIDATION_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CTES: dict[str, str] = {"ck": CHECKINS_SQL, "tr": TRAINING_SQL, "va": VALIDATION_SQL, "pur": PURCHASES_SQL}


def cte(name: str, body: str) -> str:
    """Define a common table expression for use in counterparts; returns its name."""
    CTES[name] = f"{name} AS ({body})"
    return name


def sql(names: str, body: str) -> str:
    """A statement over the named expressions, in the given order."""
    return "WITH " + ",\n".join(CTES[n].strip() for n in names.split()) + "\n" + body


def query(name: str, counterpart: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if counterpart is not None:
            SQL[name] = counterpart
        return build

    return register
