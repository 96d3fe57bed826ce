"""Balanced contiguous shards from global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracite.session import cut, pick

#: Law that the shards keep: their sizes are near equal.
LAW = "bytes"


def shard_by_bytes(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Cuts documents, in the order of ``doc_id``, into ``n_shards`` contiguous shards of near equal size.

    Size is the UTF-8 length of the text plus 1, so even empty and null texts weigh something. Rows are dealt out by
    range of ``doc_id``; each range sums its own sizes, the few range totals give every range its start in the global
    prefix sum, and a document goes to the shard in which the middle of its own bytes falls. A shard so differs from the
    mean by less than one document. The text itself is never shuffled.

    Null ``doc_id`` sorts first. Null text: size 1, null ``text_crc32``. Rows with equal ``doc_id`` stand side by side,
    by checksum and size; equal rows are interchangeable, and are still dealt over several ranges. An empty table gives
    no rows. Other columns are ignored.

    Returns doc_id, size, text_crc32, law, shard, slot (place in the shard, from 0), grown_shard (null under this law).
    """
    slim = cut(
        pick(docs, "doc_id", "text").select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("tie"),
        )
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    ranged = cut(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))

    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(whole).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumns({"upto": F.sum("size").over(running), "place": F.row_number().over(inside)})
        .join(F.broadcast(starts), "part")  # one row for each shuffle partition
        .withColumn("middle", 2 * (F.col("size_before") + F.col("upto")) - F.col("size"))
        .withColumn("rank", F.col("rows_before") + F.col("place") - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"middle * {n_shards} div (2 * total)")).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # n_shards rows
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
