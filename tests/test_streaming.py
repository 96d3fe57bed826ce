"""Streams against their batch twins."""

import tempfile
import time

from pyspark.sql import functions as F

from terracite.operators.chunks import chunk_structured
from terracite.sources.model import Model
from terracite.streaming import board, live, turns
from terracite.streaming import commits as commits_module
from terracite.streaming.commits import CHUNKS, MENTIONS, Commits, chunks_and_mentions


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder()).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return stream.sparkSession.table(name)


def streamed(spark, df, parts=3):
    place = folder() + "/in"
    df.repartition(parts).write.parquet(place)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(place)


def test_ingest(spark, sf_dir):
    docs = Model(spark, sf_dir).documents.where("source_id < 40").select("source_id", "text")
    names = spark.createDataFrame([], "source_id long, entity_id string, name string, sentiment string")
    out = folder() + "/out"
    commits_module.ingest(streamed(spark, docs.unionByName(docs.where("source_id < 5"))), names, names.select("entity_id", F.col("name").alias("alias")), out, folder()).awaitTermination(180)
    columns = ["source_id", "chunk_index", "content"]
    got = Commits(spark, out).latest("chunks", CHUNKS).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunk_structured(docs).select(columns).collect()))


def test_claims(spark, sf_dir):
    events = Model(spark, sf_dir).status_events.withColumn("ts", F.col("ts").cast("timestamp"))
    got = drained(live.claim_completions(streamed(spark, events, 1), "90 days"), "claims")
    assert {r["source_id"] for r in got.collect()} == {r["source_id"] for r in live.claim_completions(events).collect()}
    assert got.count() == got.select("source_id").distinct().count()


def test_windows_and_enrichment(spark, sf_dir):
    m = Model(spark, sf_dir)
    events = m.status_events.withColumn("ts", F.col("ts").cast("timestamp"))
    batch = live.windowed_counts(events, "1 day").where("window_start < '2024-01-20'")
    got = drained(live.windowed_counts(streamed(spark, events.orderBy("ts").coalesce(1), 1), "1 day"), "windows").where("window_start < '2024-01-20'")
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    assert live.windowed_counts(events, "", gap="6 hours").count() > 0
    assert live.windowed_counts(events, "1 day", "12 hours").count() > 0
    columns = ["event_id", "project_id"]
    rich = drained(live.enrich_stream(streamed(spark, events), m.sources, m.projects).select(columns), "rich")
    assert sorted(map(tuple, rich.collect())) == sorted(map(tuple, live.enrich_stream(events, m.sources, m.projects).select(columns).collect()))


def fed(spark, batches, schema):
    """A stream that gives one batch after the other."""
    place = folder() + "/in"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
        df = df.withColumns({c: F.to_timestamp(c) for c in df.columns if f"{c} timestamp" in schema})
        df.coalesce(1).write.mode("append").parquet(place)
        time.sleep(1.1)  # files come in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place)


USERS = "conversation_id long, client_id string, ts timestamp, text string"


def test_one_answer_for_each_turn(spark):
    at = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    users = [
        [(1, "a", at(0), "first"), (1, "a", at(0), "first"), (2, "x", at(0, 5), "other")],
        [(1, "b", at(0, 20), "second"), (1, "a", at(0, 21), "first again")],
        [(1, "c", at(1), "never answered"), (2, "y", at(1, 1), "answered too late")],
        [(3, "z", at(9), "moves the watermark")],
        [(3, "zz", at(12), "again"), (1, "late", at(0, 1), "later than the watermark")],
    ]
    answers = [
        [(1, "a", at(0, 2), "yes"), (1, "a", at(0, 3), "yes, again"), (9, "nobody", at(0, 3), "to nobody")],
        [(1, "b", at(0, 25), "well"), (2, "x", at(0, 29), "so"), (1, "a", at(0, 26), "once more")],
        [(2, "y", at(1, 59), "too late"), (1, "b", at(1, 2), "repeated")],
        [(3, "z", at(9, 1), "now")],
        [(3, "zz", at(12, 1), "and now")],
    ]
    out, checkpoint = folder() + "/log", folder()
    turns.log(fed(spark, users, USERS), fed(spark, answers, USERS), out, checkpoint).awaitTermination(240)
    got = Commits(spark, out).read("turns", turns.TURNS)
    rows = got.collect()
    said = {(r["conversation_id"], r["client_id"], r["role"]): r["text"] for r in rows}
    assert len(said) == len(rows)
    assert said[1, "a", "assistant"] == "yes" and said[1, "b", "assistant"] == "well" and said[2, "x", "assistant"] == "so"
    assert (1, "c", "assistant") not in said and (2, "y", "assistant") not in said and said[1, "c", "user"] == "never answered"
    assert (1, "late", "user") not in said
    for c in (1, 2, 3):
        numbers = sorted(r["sequence"] for r in rows if r["conversation_id"] == c)
        assert numbers == list(range(1, len(numbers) + 1))
    # The same as in one batch, where no batch boundary changes the order.
    flat = lambda batches, keep: spark.createDataFrame([r for b in batches for r in b if keep(r)], USERS.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    whole = turns.as_turns(turns.paired(flat(users, lambda r: r[1] != "late"), flat(answers, lambda r: True)))
    settled = {r["client_id"] for r in rows}
    columns = ["conversation_id", "client_id", "role", "text", "sequence"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, whole.where(F.col("client_id").isin(*settled)).select(columns).collect()))
    assert {"a", "b", "c", "x", "y"} <= settled


def test_board_alarms_and_forgets_by_event_time(spark):
    at = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    batches = [
        [(1, 1, "PROCESSING", at(0)), (2, 2, "EXTRACTING", at(0)), (3, 2, "COMPLETED", at(0, 5))],
        [(4, 3, "UPLOADING", at(0, 30)), (5, 1, "EXTRACTING", at(0, 20))],
        [(6, 3, "PROCESSING", at(3))],
        [(7, 3, "EXTRACTING", at(3, 10))],
        [(8, 3, "COMPLETED", at(9))],
        [(10, 4, "UPLOADING", at(9, 5))],
        [(9, 2, "UPLOADING", at(9, 6))],
    ]
    events = fed(spark, batches, "event_id long, source_id long, status string, ts timestamp")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        got = drained(board.live_board(events, "1 hour", "5 hours"), "live", "update").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    of = lambda s: [(r["status"], r["n_events"], r["n_statuses"], r["alarm"]) for r in got if r["source_id"] == s]
    assert of(1)[:3] == [("PROCESSING", 1, 1, None), ("EXTRACTING", 2, 2, None), ("EXTRACTING", 2, 2, "stuck")]
    assert ("EXTRACTING", 2, 2, "forgotten") in of(1)  # 0:20, an hour to the alarm, five more
    assert of(2)[0] == ("COMPLETED", 2, 2, None) and ("COMPLETED", 2, 2, "forgotten") in of(2)
    again = [r for r in got if r["source_id"] == 2 and r["status"] == "UPLOADING"]
    assert [(r["n_events"], r["n_statuses"]) for r in again if r["alarm"] is None] == [(1, 1)]  # its state was gone
    assert ("COMPLETED", 4, 4, None) in of(3)


def test_chunks_and_mentions_have_one_effect_together(spark, monkeypatch):
    """Also if a batch breaks off between its two tables, and if a source comes again with another text."""
    first = [(1, "Acme Holding met Maria.\n\nThen acme left."), (2, "Maria said nothing.")]
    later = [(1, "Only Maria came again, with a longer text than before, and nobody else."), (3, "Acme.")]
    names = spark.createDataFrame([(s, "e", "Acme Holding", None) for s in (1, 2, 3)] + [(s, "m", "Maria", "positive") for s in (1, 2, 3)], "source_id long, entity_id string, name string, sentiment string")
    aliases = spark.createDataFrame([("e", "Acme")], "entity_id string, alias string")
    docs, out, checkpoint = fed(spark, [first, later], "source_id long, text string"), folder() + "/out", folder()
    whole, broken = Commits.write, []

    def breaks(self, batch, tables, files=8):
        if batch == 1 and not broken:
            broken.append(batch)
            tables["chunks"].write.mode("overwrite").parquet(f"{self.out}/chunks/batch={batch}")
            raise RuntimeError("lost between two tables")
        whole(self, batch, tables, files)

    monkeypatch.setattr(Commits, "write", breaks)
    try:
        commits_module.ingest(docs, names, aliases, out, checkpoint).awaitTermination(240)
    except Exception as error:  # noqa: BLE001
        assert "lost between" in str(error)
    held = Commits(spark, out)
    assert broken and {r["source_id"] for r in held.latest("chunks", CHUNKS).select("source_id").distinct().collect()} == {1, 2}
    assert "Acme" in " ".join(r["content"] for r in held.latest("chunks", CHUNKS).where("source_id = 1").collect())
    commits_module.ingest(docs, names, aliases, out, checkpoint).awaitTermination(240)
    last = spark.createDataFrame([later[0], first[1], later[1]], "source_id long, text string")
    chunks, mentions = chunks_and_mentions(last, names, aliases)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(held.latest("chunks", CHUNKS).select(chunks.columns)) == rows(chunks)
    assert rows(held.latest("mentions", MENTIONS).select(mentions.columns)) == rows(mentions) and mentions.count() == 3
