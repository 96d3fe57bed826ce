"""Tables that a stream writes together, batch by batch, and ingest of documents into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracite.operators.chunks import chunk_structured
from terracite.operators.grounding import ground
from terracite.session import cut, small

CHUNKS = "source_id long, chunk_index int, speaker string, content string, start double, end double, structure string"
MENTIONS = "source_id long, entity_id string, chunk_id string, context string, match_method string, match_confidence string, sentiment string"


class Commits:
    """Batches of rows for several tables under one folder. A batch counts once all its tables are written and its manifest
    stands in ``commits``; one that runs again replaces what it wrote before, so it has one effect wherever it broke off."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark, self.out = spark, out

    def write(self, batch: int, tables: dict[str, DataFrame], files: int = 8) -> None:
        """Each table in ``files`` files at most, its rows dealt out by source or conversation: no folder for each of these."""
        for name, rows in tables.items():
            key = next(c for c in ("source_id", "conversation_id") if c in rows.columns)
            rows.repartition(files, key).write.mode("overwrite").parquet(f"{self.out}/{name}/batch={batch}")
        named = self.spark.createDataFrame([(name,) for name in tables], "name string").coalesce(1)
        named.write.mode("overwrite").parquet(f"{self.out}/commits/batch={batch}")

    def _there(self, name: str) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}")
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)

    def read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """Rows of a table, with their batch, of the batches that are committed (and come before ``before``)."""
        kind = f"{schema}, batch long"
        if not self._there("commits") or not self._there(name):
            return self.spark.createDataFrame([], kind)
        done = self.spark.read.schema("name string, batch long").parquet(f"{self.out}/commits").where(F.col("name") == name).select("batch").distinct()
        done = done if before is None else done.where(F.col("batch") < before)
        return self.spark.read.schema(kind).parquet(f"{self.out}/{name}").join(small(done), "batch", "left_semi")

    def latest(self, name: str, schema: str) -> DataFrame:
        """Rows of a table as each source's last batch left them; ``sources`` says which batch that is."""
        last = self.read("sources", "source_id long").groupBy("source_id").agg(F.max("batch").alias("batch"))
        return self.read(name, schema).join(last, ["source_id", "batch"], "left_semi").drop("batch")


def chunks_and_mentions(docs: DataFrame, names: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of documents (source_id, text), and the mentions in them of their sources' entities (``grounding.ground``)."""
    chunks = cut(chunk_structured(docs))
    placed = chunks.select("source_id", F.concat_ws("-", "source_id", "chunk_index").alias("id"), "content")
    mentions = ground(names, aliases, placed).join(placed.select(F.col("id").alias("chunk_id"), "source_id"), "chunk_id")
    return chunks, mentions.select(*[c.split()[0] for c in MENTIONS.split(", ")])


def ingest(docs: DataFrame, names: DataFrame, aliases: DataFrame, out: str, checkpoint: str):  # noqa: ANN201  StreamingQuery
    """New documents (source_id, text) become chunks and mentions, committed together; a source that comes again replaces both.

    names: source_id, entity_id, name, sentiment; aliases: entity_id, alias. Of texts of one source in a batch the longest, then the greatest, counts.
    Results are read by ``Commits(...).latest("chunks", CHUNKS)`` and ``("mentions", MENTIONS)``.
    """

    def write(batch: DataFrame, number: int) -> None:
        texts = cut(batch.groupBy("source_id").agg(F.max(F.struct(F.length("text").alias("n"), "text"))["text"].alias("text")))
        mine = names.join(texts.select("source_id"), "source_id", "left_semi")
        chunks, mentions = chunks_and_mentions(texts, mine, aliases)
        Commits(batch.sparkSession, out).write(number, {"chunks": chunks, "mentions": mentions, "sources": texts.select("source_id")})

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
