"""All registered queries of the reconciliation operators and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(name: str, oracle: str | None = None, money: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give its rows where SQL can.

    ``money``: exact decimal columns, returned as doubles on both sides.
    """

    def add(f: Query) -> Query:
        def with_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in money})

        _QUERIES[name] = with_doubles if money else f
        if oracle is not None:
            casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in money)
            _ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({oracle}) exact_rows" if money else oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture: SQL in words that both engines know, its tables in braces."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def plain(sql: str) -> str:
    """The fixture's SQL for the other engine."""
    return sql.format(**{t: t for t in TABLES})


def _load() -> None:
    for name in ("number_queries", "text_queries", "code_queries", "link_queries", "compare_queries", "aggregate_queries", "time_queries", "source_queries", "more_queries", "lookup_queries", "remaining_queries", "finding_queries", "structure_queries"):
        importlib.import_module(f"tallybook.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
