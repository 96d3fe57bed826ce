"""Every registered query of the library, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terracite.sources.model import Model, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, more: str = "") -> Callable:
    """Registers a function of the model as a query. Whole numbers come out as long, as they do from the SQL."""

    def run(spark: SparkSession, sf_dir: str, f: Callable[[Model], DataFrame]) -> DataFrame:
        out = f(Model(spark, sf_dir))
        return out.withColumns({c: out[c].cast("long") for c, kind in out.dtypes if kind == "int"})

    def register(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, f)
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql, more)
        return f

    return register


from terracite.plans import boards, documents, editing, graphs, intake, lookups, names, quality, surface  # noqa: E402, F401  they register their queries
