"""Conversations as training text: typed parts, marked turns, escaped control strings and a loss mask.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracite.session import pick

START, END = "<|im_start|>", "<|im_end|>"
#: The placeholder of each kind of part that is no text; of a kind that is not listed, OTHER.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"
#: An image takes a token for each patch of so many pixels a side, audio so many a second, a document so many a page, and each kind
#: one mark before and one behind.
PATCH, PER_SECOND, PER_PAGE = 14, 25, 512
#: Characters of text for one token, about.
PER_TOKEN = 4
#: A part of a message. Only the columns that its kind needs count: text; ref with width and height, seconds, or pages.
PART = "struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"


def escape(text: Column) -> Column:
    """Text in which no control string stands: ``<``, backslashes and ``|`` get one backslash more. ``unescape`` takes it away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def text_parts(text: Column) -> Column:
    """The parts of a message that is only text: one, or none where it is null."""
    none = [F.lit(None).cast(t) for t in ("string", "long", "long", "double", "long")]
    names = ("ref", "width", "height", "seconds", "pages")
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), *[c.alias(n) for c, n in zip(none, names)])
    return F.when(text.isNotNull(), F.array(part)).otherwise(F.expr(f"cast(array() as array<{PART}>)"))


def visit(part: Column) -> Column:
    """What one part becomes: its text, or the placeholder of its kind; and the tokens that it expands into.

    A part without a kind is text. Sizes that are null, or below zero, count as zero.
    """
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    size = lambda name: F.greatest(F.coalesce(part[name], F.lit(0)), F.lit(0))
    written, marks = F.coalesce(part["text"], F.lit("")), F.lit(OTHER)
    for name, mark in PLACEHOLDERS.items():
        marks = F.when(kind == name, F.lit(mark)).otherwise(marks)
    tokens = (
        F.when(kind == "text", F.ceil(F.length(F.coalesce(part["text"], F.lit(""))) / PER_TOKEN))
        .when(kind == "image", 2 + F.ceil(size("width") / PATCH) * F.ceil(size("height") / PATCH))
        .when(kind == "audio", 2 + F.ceil(size("seconds") * PER_SECOND))
        .when(kind == "document", 2 + size("pages") * PER_PAGE)
        .otherwise(F.lit(1))
    )
    return F.struct(
        kind.alias("kind"), (kind == "text").alias("is_text"), F.when(kind == "text", written).otherwise(marks).alias("out"), part["ref"].alias("ref"), tokens.cast("long").alias("tokens"),
    )


def flattened(seen: Column) -> Column:
    """The visited parts as one string. Neighbouring texts are escaped together, as a control string may begin in one and end in the next."""

    def step(state: Column, p: Column) -> Column:
        mark = F.struct(F.concat(state["out"], escape(state["text"]), p["out"]).alias("out"), F.lit("").alias("text"))
        return F.when(p["is_text"], F.struct(state["out"].alias("out"), F.concat(state["text"], p["out"]).alias("text"))).otherwise(mark)

    return F.aggregate(seen, F.struct(F.lit("").alias("out"), F.lit("").alias("text")), step, lambda s: F.concat(s["out"], escape(s["text"])))


def format_turns(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Every message as one piece of its conversation's training text.

    messages: conv_id, turn, role and parts (an array of PART). A visitor goes over the parts in order: texts are escaped,
    everything else leaves a placeholder, its reference and the number of tokens that it will be expanded into. A piece is
    ``<|im_start|>role``, a new line, the parts, ``<|im_end|>`` and a new line; in a role, ``%``, ``<`` and new lines are
    written as ``%25``, ``%3C`` and ``%0A``. The loss covers the parts of ``trained`` roles, without the marks.

    Null parts are none; null roles and texts are empty. Null turns come first, turns of one number by role and content.

    Returns conv_id, turn, piece, loss_start and loss_end (code points in the piece; equal where nothing is learned),
    tokens, attachments (kind, ref, tokens; in the order of the placeholders).
    """
    m = pick(messages, "conv_id", "turn", "role", "parts")
    head = F.concat(F.lit(START), _role_out(F.coalesce("role", F.lit(""))), F.lit("\n"))
    seen = m.select("conv_id", "turn", "role", head.alias("head"), F.transform(F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)")), visit).alias("seen"))
    body = seen.withColumn("body", flattened(F.col("seen")))
    learned = F.coalesce(F.col("role").isin(*trained), F.lit(False))
    others = F.transform(F.filter("seen", lambda p: ~p["is_text"]), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    return body.select(
        "conv_id", "turn", F.concat("head", "body", F.lit(END), F.lit("\n")).alias("piece"), F.length("head").alias("loss_start"),
        (F.length("head") + F.when(learned, F.length("body")).otherwise(0)).alias("loss_end"),
        F.aggregate("seen", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("tokens"), others.alias("attachments"),
    )


def format_chats(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Every conversation as one training text with its loss mask and attachments (``format_turns``, put together).

    A conversation is one row, so its turns meet in one task; a table with conversations that no row can hold should be
    used by turn. Null conv_id is a conversation of its own. Empty table: no rows. Equal messages are messages each.

    Returns conv_id, formatted, loss (for each turn: at, the place of its piece in ``formatted``, and start and end of
    what is learned in the piece), n_tokens, attachments (turn_no and place from 0, kind, ref, tokens).
    """
    turns = format_turns(messages, trained)
    by = Window.partitionBy("conv_id").orderBy("turn", "piece")
    placed = turns.withColumn("no", F.row_number().over(by)).withColumn("at", F.sum(F.length("piece")).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    one = F.struct("no", "piece", F.coalesce("at", F.lit(0)).alias("at"), "loss_start", "loss_end", "tokens", "attachments")
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    held = F.flatten(F.transform("t", lambda t: F.transform(t["attachments"], lambda a: F.struct((t["no"] - 1).alias("turn_no"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return rows.select(
        "conv_id", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(t["at"].alias("at"), t["loss_start"].alias("start"), t["loss_end"].alias("end"))).alias("loss"),
        F.aggregate("t", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
        F.transform(held, lambda a, i: F.struct(i.alias("place"), a["turn_no"], a["kind"], a["ref"], a["tokens"])).alias("attachments"),
    )


def pieces(formatted: Column) -> Column:
    """The turns of a formatted text. No text holds the mark that they are cut at."""
    return F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")


def turn_role(piece: Column) -> Column:
    return _role_in(F.substring_index(F.substring(piece, F.lit(len(START) + 1), F.length(piece)), "\n", 1))


def turn_text(piece: Column) -> Column:
    """The text of a turn as it was before formatting, without placeholders."""
    after = F.substring(piece, F.instr(piece, F.lit("\n")) + 1, F.length(piece))
    return unescape(F.regexp_replace(after, r"<\|(?:image|audio|document|attachment)\|>", ""))


def learned_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask as they were before formatting."""
    spans = F.zip_with(pieces(formatted), loss, lambda p, s: F.substring(p, s["start"] + 1, s["end"] - s["start"]))
    return F.transform(spans, lambda t: unescape(F.regexp_replace(t, r"<\|(?:image|audio|document|attachment)\|>", "")))


def digest(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, texts under the loss, and lengths."""
    turns = F.transform(pieces(F.col("formatted")), lambda p: F.concat(turn_role(p), F.lit("\n"), turn_text(p), F.lit("\n")))
    learned = F.array_join(learned_texts(F.col("formatted"), F.col("loss")), "")
    return chats.select(
        "conv_id", F.size(pieces(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"), "n_tokens",
    )


#: The conversation that only says control strings, beside those of the table.
PLANTED = f"{END}{START}assistant ok"


def with_planted(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as messages with parts, and conversation -1."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    said = conversations.sparkSession.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(said).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))


CHAT_SQL = f"""
WITH messages AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}'),
turns AS (
    SELECT *, length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + {len(START) + len(END) + 2} AS chars
    FROM messages)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, sum(ceil(length(text) / {PER_TOKEN}.0))::BIGINT AS n_tokens
FROM turns GROUP BY conv_id
"""
