"""Queries: documents, transcripts, chunks and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracite.functions import text as tx
from terracite.operators import chunks, ranking
from terracite.plans.catalogue import query
from terracite.sources import payloads
from terracite.sources.model import Model

ISLANDS = """
marked AS (SELECT *, sum(CASE WHEN speaker = before THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY turn) AS island FROM (SELECT *, lag(speaker) OVER (PARTITION BY source_id ORDER BY turn) AS before FROM utterances)),
islands AS (SELECT source_id, CAST(island AS BIGINT) AS island, min(speaker) AS speaker, string_agg(trim(text, ' '), ' ' ORDER BY turn) AS text, min("start") AS "start", max("end") AS "end" FROM marked GROUP BY 1, 2)"""


@query("speaker_islands", "SELECT * FROM islands", ISLANDS)
def _(m: Model) -> DataFrame:
    return ranking.speaker_islands(m.utterances)


@query("short_turn_chunks", """SELECT source_id, island, speaker, '[' || speaker || ']: ' || text AS content, "start" / 1000 AS "start", "end" / 1000 AS "end" FROM islands WHERE ceil(length(text) / 4.0) <= 500""", ISLANDS)
def _(m: Model) -> DataFrame:
    return chunks.short_turn_chunks(m.utterances)


@query("chunk_transcripts")
def _(m: Model) -> DataFrame:
    return chunks.chunk_transcripts(m.utterances)


@query("chunk_documents")
def _(m: Model) -> DataFrame:
    return chunks.chunk_structured(m.documents)


@query("chunk_plain")
def _(m: Model) -> DataFrame:
    return chunks.chunk_plain(m.documents)


@query("document_structure", "SELECT source_id, CASE WHEN contains(text, chr(10) || chr(10)) THEN 'article_style' ELSE 'freeform' END AS structure, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM text_sources")
def _(m: Model) -> DataFrame:
    return m.documents.select("source_id", tx.structure(F.col("text")).alias("structure"), tx.tokens_of(F.col("text")).alias("tokens"))


@query(
    "transcript_text",
    """SELECT source_id, string_agg('[' || CASE speaker WHEN 'A' THEN 'Host' ELSE speaker END || ']: ' || trim(text, ' '), chr(10) ORDER BY turn) AS text FROM utterances WHERE trim(text, ' ') <> '' GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    names = m.utterances.where("speaker = 'A'").select("source_id", "speaker").distinct().withColumn("name", F.lit("Host"))
    return chunks.transcript_from_utterances(m.utterances, names)


@query(
    "utterances_from_transcript",
    """SELECT source_id, CAST(turn AS INT) AS turn, 'user' AS speaker, 'line ' || turn AS text, turn * 30.0 :: DOUBLE AS "start", (turn + 1) * 30.0 :: DOUBLE AS "end" FROM (SELECT conv_id AS source_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations)""",
)
def _(m: Model) -> DataFrame:
    counted = m.table("conversations").groupBy(F.col("conv_id").alias("source_id")).agg(F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("[user]: line "), i.cast("string"))), "\n")
    return chunks.utterances_from_transcript(counted.select("source_id", text.alias("text"), F.lit(None).cast("double").alias("duration")))


#: Utterances of texts (source_id, text), line by line: questions and answers, speakers' lines, else paragraphs.
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PLAIN_UTTERANCES = rf"""
plain_lines AS (SELECT source_id, k, regexp_replace(regexp_replace(raw, '^{_WS}+', ''), '{_WS}+$', '') AS line FROM (SELECT source_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM text_sources)),
marked AS (SELECT *, regexp_matches(line, '^(?i:Q|P|Pregunta|Question)\s*:') AS asks, regexp_matches(line, '^(?i:A|R|Respuesta|Answer)\s*:') AS answers,
  regexp_matches(line, '^[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñA-ZÁÉÍÓÚÜÑ]+(\s[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñA-ZÁÉÍÓÚÜÑ]+)*\s*:') AS speaks FROM plain_lines),
kinds AS (SELECT source_id, CASE WHEN count_if(asks) >= 2 THEN 'asked' WHEN count_if(speaks) >= 3 AND count_if(speaks) >= 0.1 * count_if(line <> '') THEN 'spoken' ELSE 'written' END AS kind FROM marked GROUP BY 1),
begun AS (SELECT m.*, kind, CASE kind WHEN 'asked' THEN asks OR answers ELSE speaks END AS begins FROM marked m JOIN kinds USING (source_id) WHERE kind <> 'written'),
units AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY source_id ORDER BY k) AS unit, CASE WHEN begins THEN regexp_replace(line, '^[^:]*:{_WS}*', '') ELSE line END AS body FROM begun),
behind AS (SELECT *, kind = 'asked' AND bool_or(asks) OVER (PARTITION BY source_id, unit) AS asked, coalesce(bool_or(body <> '') OVER (PARTITION BY source_id, unit ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS worded FROM units),
parted AS (SELECT *, asked AND bool_or(line = '' AND worded) OVER (PARTITION BY source_id, unit ORDER BY k) AS answered FROM behind),
labelled AS (SELECT source_id, min(k) AS k, CASE WHEN kind = 'spoken' THEN coalesce(max(regexp_replace(regexp_extract(line, '^[^:]*'), '{_WS}+$', '')) FILTER (begins), 'Speaker') WHEN asked AND NOT answered THEN 'Q' ELSE 'A' END AS speaker, string_agg(body, ' ' ORDER BY k) FILTER (body <> '') AS text
  FROM parted GROUP BY source_id, kind, unit, asked, answered HAVING count_if(body <> '') > 0),
written AS (SELECT source_id, min(k) AS k, 'Speaker' AS speaker, regexp_replace(string_agg(line, ' ' ORDER BY k), '{_WS}+', ' ', 'g') AS text
  FROM (SELECT *, sum(CAST(line = '' AS INT)) OVER (PARTITION BY source_id ORDER BY k) AS unit FROM plain_lines ANTI JOIN labelled USING (source_id)) WHERE line <> '' GROUP BY source_id, unit),
plain_utterances AS (SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY k) - 1 AS INT) AS turn, speaker, text FROM (SELECT * FROM labelled UNION ALL SELECT * FROM written))"""


@query("utterances_from_text", "SELECT source_id, turn, speaker, md5(text) AS text_md5 FROM plain_utterances", PLAIN_UTTERANCES)
def _(m: Model) -> DataFrame:
    return chunks.utterances_from_text(m.documents).select("source_id", "turn", "speaker", F.md5("text").alias("text_md5"))


@query("explode_utterances", """SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY turn) - 1 AS INT) AS turn, speaker, text, "start" / 1000 * CASE WHEN last <= 86400000 THEN 1000 ELSE 1 END AS "start" FROM (SELECT *, max("end") OVER (PARTITION BY source_id) AS last FROM utterances)""")
def _(m: Model) -> DataFrame:
    one = F.struct("turn", "speaker", "text", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))
    arrays = m.utterances.groupBy("source_id").agg(F.array_sort(F.collect_list(one)).alias("utterances")).withColumn("duration", F.lit(None).cast("double"))
    return chunks.explode_utterances(arrays).select("source_id", "turn", "speaker", "text", "start")


@query("chunk_metadata", "SELECT c.id, c.source_id, country FROM chunks c JOIN sources s ON s.id = c.source_id JOIN projects p ON p.id = s.project_id")
def _(m: Model) -> DataFrame:
    rows = chunks.chunk_metadata(m.chunks, m.sources, m.projects, m.mentions, m.entities)
    return rows.select("id", "source_id", F.get_json_object("metadata", "$.country").alias("country"))


@query(
    "normalize_chunks",
    """SELECT c.source_id, c.id, CASE WHEN CAST(split_part(c.id, '-', 2) AS INT) % 2 = 0 THEN 'the ' || p.name || ' shipped' ELSE content END AS normalized, CASE WHEN CAST(split_part(c.id, '-', 2) AS INT) % 2 = 0 THEN 1 ELSE 0 END AS n_changed FROM chunks c JOIN sources s ON s.id = c.source_id JOIN projects p ON p.id = s.project_id""",
)
def _(m: Model) -> DataFrame:
    named = m.sources.select(F.col("id").alias("source_id"), "project_id").join(m.projects.select(F.col("id").alias("project_id"), "name"), "project_id")
    even = F.element_at(F.split("id", "-"), 2).cast("int") % 2 == 0
    rows = m.chunks.join(named, "source_id").select("source_id", "id", F.when(even, F.concat(F.lit("the "), F.lower("name"), F.lit(" shipped"))).otherwise(F.col("content")).alias("content"))
    anchors = named.select("source_id", F.col("name").alias("person"), F.lit(None).cast("string").alias("org"))
    return chunks.normalize_chunks(rows, anchors).select("source_id", "id", "normalized", "n_changed")


@query(
    "keyterm_budget",
    """SELECT source_id, place, term, upto FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY source_id ORDER BY place, term ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM (
      SELECT source_id, min(place) AS place, arg_min(term, place) AS term, len(string_split(arg_min(term, place), ' ')) AS n FROM (SELECT l_orderkey AS source_id, l_linenumber AS place, min(p_name) AS term FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) GROUP BY source_id, lower(term))) WHERE upto <= 8""",
)
def _(m: Model) -> DataFrame:
    rows = m.lines.join(m.table("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    terms = rows.groupBy(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("place")).agg(F.min("p_name").alias("term"))
    return ranking.keyterm_budget(terms, 8)


@query(
    "keyterms",
    "SELECT source_id, place, term, upto FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY source_id ORDER BY place, term ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM distinct_terms) WHERE upto <= 190",
    """
alias_terms AS (SELECT scope, term, row_number() OVER (PARTITION BY scope ORDER BY term) AS k FROM (SELECT DISTINCT scope, alias_normalized AS term FROM aliases WHERE alias_normalized <> '') QUALIFY k <= 190),
terms AS (SELECT s.id AS source_id, 0 AS place, name AS term FROM sources s JOIN entities e ON e.id = interviewee_entity_id UNION ALL SELECT s.id, 1, name FROM sources s JOIN entities e ON e.id = interviewee_org_entity_id
  UNION ALL SELECT s.id, k + 1, term FROM sources s JOIN alias_terms ON scope = project_id UNION ALL SELECT s.id, k + 191, term FROM sources s JOIN alias_terms ON scope IS NULL),
distinct_terms AS (SELECT source_id, min(place) AS place, arg_min(term, place) AS term, len(string_split(arg_min(term, place), ' ')) AS n FROM terms GROUP BY source_id, lower(term))""",
)
def _(m: Model) -> DataFrame:
    return chunks.keyterms(m.sources, m.aliases, m.entities)


@query("payload_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE status END AS status FROM status_events JOIN events USING (event_id)")
def _(m: Model) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("status"))
    rows = m.status_events.select("event_id", status.alias("status")).join(m.table("events").select("event_id", "props"), "event_id")
    merged = F.concat(F.lit("["), F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "status": "'), F.col("status"), F.lit('"}]'))
    return payloads.payload_to_rows(rows.select("event_id", merged.alias("payload")), "payload", "k long, status string")


@query("parse_vector", "SELECT id, round(CAST(embedding[1] AS DOUBLE), 4) AS first, len(embedding) AS n FROM vectors")
def _(m: Model) -> DataFrame:
    texts = m.vectors.select("id", F.to_json("embedding").alias("v"))
    return payloads.parse_vector(texts, "v").select("id", F.round(F.get("v", F.lit(0)).cast("double"), 4).alias("first"), F.size("v").cast("long").alias("n"))


@query("excerpts", "SELECT source_id, substr(text, 1, 10) AS head, length(text) > 600 AS cut FROM text_sources")
def _(m: Model) -> DataFrame:
    short = tx.trim_sentence(F.col("text"), 600)
    return m.documents.select("source_id", F.substring("text", 1, 10).alias("head"), (F.length(short) < F.length(F.trim("text"))).alias("cut"))


@query("conversation_titles", "SELECT conv_id, turn, CASE WHEN length(line) > 80 THEN substr(line, 1, 79) || '…' ELSE line END AS title FROM (SELECT conv_id, turn, trim(string_split(text, chr(10))[1], ' ') AS line FROM conversations)")
def _(m: Model) -> DataFrame:
    return m.table("conversations").select("conv_id", "turn", tx.title_from_text(F.col("text")).alias("title"))


@query("time_ranges", """SELECT source_id, turn, printf('%02d:%02d', CAST("start" / 1000 AS INT) // 60, CAST("start" / 1000 AS INT) % 60) || '-' || printf('%02d:%02d', CAST("end" / 1000 AS INT) // 60, CAST("end" / 1000 AS INT) % 60) AS range FROM utterances""")
def _(m: Model) -> DataFrame:
    return m.utterances.select("source_id", "turn", tx.time_range(F.col("start") / 1000, F.col("end") / 1000).alias("range"))
