"""Log of user turns and their answers, from two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracite.operators.ranking import assign_sequence
from terracite.streaming.commits import Commits

TURNS = "conversation_id long, role string, client_id string, ts timestamp, text string, sequence long"


def paired(users: DataFrame, answers: DataFrame, watermark: str = "1 hour", within: str = "30 minutes") -> DataFrame:
    """Each user turn once, with its first answer if one came ``within`` that time.

    users: conversation_id, client_id, ts, text; answers: conversation_id, client_id (of the turn that is answered), ts, text. Repeats of a
    client id, and of an answer to it, are dropped. In a stream both sides have watermarks: a turn waits for its answer until none can come
    any more, and state is kept no longer; what is later than the watermark is dropped. In a batch the earliest counts.

    Returns conversation_id, client_id, ts, text, answered_at, answer.
    """
    key = ["conversation_id", "client_id"]
    if users.isStreaming:
        u = users.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(key)
        a = answers.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(key)
    else:
        first = lambda df: df.groupBy(*key).agg(F.min(F.struct("ts", "text")).alias("m")).select(*key, "m.ts", "m.text")
        u, a = first(users), first(answers)
    u = u.select(*[F.col(c).alias(f"u_{c}") for c in (*key, "ts", "text")])
    a = a.select(*[F.col(c).alias(f"a_{c}") for c in (*key, "ts", "text")])
    same = (F.col("u_conversation_id") == F.col("a_conversation_id")) & (F.col("u_client_id") == F.col("a_client_id"))
    soon = (F.col("a_ts") >= F.col("u_ts")) & (F.col("a_ts") <= F.col("u_ts") + F.expr(f"interval {within}"))
    joined = u.join(a, same & soon, "left_outer")
    return joined.select(*[F.col(f"u_{c}").alias(c) for c in (*key, "ts", "text")], F.col("a_ts").alias("answered_at"), F.col("a_text").alias("answer"))


def as_turns(pairs: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """A row for each user turn and one for its answer, numbered without gaps in the conversation (``ranking.assign_sequence``): by the user
    turns' times, each answer behind its turn."""
    user = F.struct(F.lit(0).alias("place"), F.lit("user").alias("role"), F.col("ts").alias("at"), F.col("text").alias("said"))
    other = F.struct(F.lit(1).alias("place"), F.lit("assistant").alias("role"), F.col("answered_at").alias("at"), F.col("answer").alias("said"))
    rows = pairs.select("conversation_id", "client_id", F.col("ts").alias("asked"), F.explode(F.when(F.col("answered_at").isNull(), F.array(user)).otherwise(F.array(user, other))).alias("t"))
    flat = rows.select("conversation_id", "t.role", "client_id", F.col("t.at").alias("ts"), F.col("t.said").alias("text"), "asked", "t.place")
    return assign_sequence(flat, ["asked", "client_id", "place"], base).drop("asked", "place")


def log(users: DataFrame, answers: DataFrame, out: str, checkpoint: str, watermark: str = "1 hour", within: str = "30 minutes"):  # noqa: ANN201  StreamingQuery
    """Appends settled turns to the table ``turns`` of ``Commits(spark, out)``; every batch goes on numbering after the batches before it."""

    def write(batch: DataFrame, number: int) -> None:
        commits = Commits(batch.sparkSession, out)
        last = commits.read("turns", TURNS, before=number).groupBy("conversation_id").agg(F.max("sequence").alias("last"))
        commits.write(number, {"turns": as_turns(batch, last).select(*[c.split()[0] for c in TURNS.split(", ")])})

    return paired(users, answers, watermark, within).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
