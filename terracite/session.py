"""Session helpers: shared checkpoint folder, column picking, size-checked broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side counts as small enough to be sent to every executor.
BROADCAST_ROWS = 200_000
#: And bytes, where its columns have no fixed width.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where a local session names none (a test), a temporary folder is set; on a cluster that is an error, as its
    machines share no such folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="terracite-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name; other columns, even ones whose names differ in case alone, do not matter."""
    have = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])

    def place(name: str) -> int:
        if name in have:
            return have.index(name)
        return [x.lower() for x in have].index(name.lower())

    return plain.select(*[F.col(f"c{place(name)}").alias(name) for name in names])


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is at most ``limit`` rows and ``most_bytes`` bytes; beyond that Spark joins it by a shuffle.

    Rows and bytes (as JSON) are measured over the whole of ``df``, which should be cheap to read again. ``rows`` saves
    that where the caller knows the number of rows and every column is of fixed width.
    """
    if rows is None:
        size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
        if (size["bytes"] or 0) > most_bytes:
            return df
        rows = size["rows"]
    return F.broadcast(df) if rows <= limit else df
