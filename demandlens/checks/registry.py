"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def view(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (sql, needs)


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the common table expressions it needs, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][1]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in ordered)
    if ordered and body.startswith("WITH "):  # the body brings more common table expressions
        return f"WITH {ctes}, {body.removeprefix('WITH ')}"
    return f"WITH {ctes}\n{body}" if ordered else body


def check(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
