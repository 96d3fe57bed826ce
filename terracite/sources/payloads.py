"""Reading texts and JSON payloads into typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """One row for each text file of a folder: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def payload_to_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A column with a JSON array of objects as rows of their fields; empty texts become null. A payload that is no such
    array gives no row. schema: the fields as DDL."""
    rows = df.select(*[c for c in df.columns if c != column], F.explode(F.from_json(column, f"array<struct<{_ddl(schema)}>>")).alias("__r"))
    fields = rows.schema["__r"].dataType
    empty = lambda f: F.nullif(F.col(f"__r.{f.name}"), F.lit("")) if f.dataType.simpleString() == "string" else F.col(f"__r.{f.name}")
    return rows.select(*[c for c in rows.columns if c != "__r"], *[empty(f).alias(f.name) for f in fields])


def _ddl(schema: str) -> str:
    return ", ".join(":".join(part.split(None, 1)) for part in map(str.strip, schema.split(",")))


def parse_vector(df: DataFrame, column: str) -> DataFrame:
    """The column's ``[0.1, …]`` texts as arrays of float; null where it is none."""
    return df.withColumn(column, F.from_json(column, "array<float>"))


def legacy_views(tables: dict[str, DataFrame], renames: dict[str, tuple[str, dict[str, str]]]) -> None:
    """Registers tables under old names: view name to (table, column renames)."""
    for view, (table, columns) in renames.items():
        tables[table].withColumnsRenamed(columns).createOrReplaceTempView(view)
