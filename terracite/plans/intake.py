"""Queries: resolution of extracted names, what it teaches, and texts as they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracite.functions import text as tx
from terracite.operators import chunks, filters, resolve
from terracite.plans.catalogue import query
from terracite.plans.names import CREATED, FUZZY, mention_names
from terracite.sources import payloads
from terracite.sources.model import Model

#: Names that a model would extract: six kinds for customers, and parts, of sources without anchors.
EXTRACTED = """
said AS (SELECT c_custkey AS k, c_custkey // 6 * 6 AS source_id, CAST(c_nationkey AS BIGINT) AS project_id, c_name FROM customer),
mention_names AS (SELECT k AS mention_id, project_id, CASE k % 6 WHEN 2 THEN 'PERSON' ELSE 'COMPANY' END AS type, CASE k % 6 WHEN 2 THEN 'Bob Zorn' ELSE c_name END AS name FROM said WHERE k % 6 IN (2, 5)
  UNION ALL SELECT 1000000000 + p_partkey, p_partkey % 25, 'PRODUCT', CASE p_partkey % 2 WHEN 0 THEN p_name ELSE p_brand || ' ' || p_name END FROM part)"""
PORTS = ("Tema", "Lagos", "Dakar")


@query(
    "resolve_entities",
    f"""SELECT k AS mention_id, CASE WHEN k % 6 < 2 THEN 'C' || (source_id + 1) WHEN k % 6 = 3 THEN 'S' || source_id ELSE 'P1' END AS entity_id, 'matched' AS result,
      CASE WHEN k % 6 = 4 THEN 'forced' WHEN k % 6 = 0 OR k % 6 = 3 AND source_id // 6 % 3 = 0 THEN 'exact' ELSE 'anchor_inferred' END AS method, 1.0 :: DOUBLE AS score, false AS needs_review FROM said WHERE k % 6 IN (0, 1, 3, 4)
    UNION ALL SELECT * FROM ({CREATED})""",
    EXTRACTED + "," + FUZZY,
)
def _(m: Model) -> DataFrame:
    k, own = F.col("c_custkey"), F.expr("c_custkey div 6 * 6")
    six = lambda *values: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) or v is None else v for v in values]), (k % 6 + 1).cast("int"))
    company = F.col("c_name")
    people = m.table("customer").select(
        k.alias("mention_id"), own.alias("source_id"), F.col("c_nationkey").cast("long").alias("project_id"),
        six("Dr. Ana Keller", "A. Kellner", "Bob Zorn", "Port Authority Tema", company, company).alias("raw_name"), six("Ana Keller", None, "Bob Zorn", "port authority tema", None, "  ").alias("canonical_name"),
        six("PERSON", "PERSON", "PERSON", "ORGANIZATION", "COMPANY", "COMPANY").alias("type"), F.when(k % 6 == 4, "P1").alias("forced_id"),
    )
    parts = mention_names(m).where("type = 'PRODUCT'").select(
        (F.col("mention_id") - 1000000 + 1000000000).alias("mention_id"), F.lit(-1).cast("long").alias("source_id"), "project_id", F.col("name").alias("raw_name"), F.lit(None).cast("string").alias("canonical_name"),
        "type", F.lit(None).cast("string").alias("forced_id"),
    )
    port = F.element_at(F.array(*[F.lit(p) for p in PORTS]), (F.expr("source_id div 6 % 3") + 1).cast("int"))
    anchors = people.select("source_id").distinct().select(
        "source_id", F.lit("Dr Ana Keller").alias("person"), F.concat(F.lit("C"), F.col("source_id") + 1).alias("person_id"),
        F.concat(F.lit("Port Authority "), port).alias("org"), F.concat(F.lit("S"), "source_id").alias("org_id"),
    )
    return resolve.resolve_entities(people.unionByName(parts), anchors, m.entities, m.aliases)


@query(
    "learn_aliases",
    """SELECT entity_id, alias, coalesce(CAST(scope AS VARCHAR), 'GLOBAL') AS scope, confidence FROM aliases UNION ALL SELECT 'C' || c_custkey, upper(c_name) || ' Ltd', CAST(c_nationkey AS VARCHAR), 0.8 :: DOUBLE FROM customer WHERE c_custkey % 3 = 1""",
)
def _(m: Model) -> DataFrame:
    """Spellings of customers: known ones, new ones with spaces about them, and blank ones."""
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.translate("c_name", "#", " ")).when(k % 3 == 1, F.concat(F.lit(" "), F.upper("c_name"), F.lit(" Ltd "))).otherwise(" - ")
    told = m.table("customer").select(F.concat(F.lit("C"), k).alias("entity_id"), raw.alias("raw_name"), F.col("c_nationkey").cast("long").alias("scope"))
    return resolve.learn_aliases(told, m.aliases).select("entity_id", "alias", F.coalesce(F.col("scope").cast("string"), F.lit("GLOBAL")).alias("scope"), "confidence")


@query(
    "enrich_descriptions",
    "SELECT id, CASE WHEN type = 'PRODUCT' AND CAST(id[2:] AS BIGINT) % 2 = 0 THEN name || ' is ' || description WHEN type = 'COMPANY' THEN 'customer ' || name ELSE description END AS description FROM entities",
)
def _(m: Model) -> DataFrame:
    """Longer texts for every second part, a short one for the others, and two for every customer."""
    name, k = F.col("name"), F.substring("id", 2, 20).cast("long")
    longer = F.when(k % 2 == 0, F.concat(name, F.lit(" is "), "description")).otherwise("x")
    about = m.entities.where("type = 'PRODUCT'").select(F.col("id").alias("entity_id"), longer.alias("description"))
    who = m.entities.where("type = 'COMPANY'").select(F.col("id").alias("entity_id"), F.explode(F.array(F.lit("buyer"), F.concat(F.lit(" customer "), name))).alias("description"))
    return resolve.enrich_descriptions(m.entities, about.unionByName(who)).select("id", "description")


@query("participant_links", "SELECT id AS source_id, interviewee_entity_id AS entity_id, 'participant' AS link_type, 'upload_anchor' AS origin FROM sources")
def _(m: Model) -> DataFrame:
    """Each order's customer as a participant, twice, one that nobody knows and one in an unknown role."""
    named = m.sources.join(m.entities.select(F.col("id").alias("interviewee_entity_id"), "name"), "interviewee_entity_id")
    person = lambda name, role: F.struct(name.alias("name"), F.lit("COMPANY").alias("type"), F.lit(role).alias("link_type"))
    given = F.array(person(F.col("name"), "participant"), person(F.lower("name"), "participant"), person(F.lit("nobody"), "participant"), person(F.col("name"), "boss"))
    return resolve.participant_links(named.select(F.col("id").alias("source_id"), "project_id", given.alias("participants")), m.entities, m.aliases)


@query("parse_relation_types", "SELECT p_partkey, ['works_at,leads','','leads'][p_partkey % 3 + 1] AS kinds FROM part")
def _(m: Model) -> DataFrame:
    given = F.element_at(F.array(*[F.array(*[F.lit(v) for v in vs]) for vs in (("works_at", "bogus", "leads", "works_at"), ("bogus",), ("leads",))]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return filters.parse_relation_types(m.table("part").select("p_partkey", given.alias("kinds")), "kinds").withColumn("kinds", F.array_join("kinds", ","))


@query("metadata_summaries", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Roles: ' || p_brand ELSE 'Roles: ' || p_brand || ' | Facts: ' || p_type || ', ' || p_name END AS summary FROM part")
def _(m: Model) -> DataFrame:
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    roles, facts = F.when(k % 3 > 0, F.array("p_brand")), F.when(k % 3 == 2, F.array("p_type", "p_name")).otherwise(none)
    return m.table("part").select("p_partkey", tx.metadata_summary(F.to_json(F.struct(roles.alias("roles"), facts.alias("facts")))).alias("summary"))


@query("speaker_labels", "SELECT source_id, turn, CASE WHEN turn % 5 = 0 THEN 'Moderator' WHEN speaker = 'A' AND source_id % 2 = 0 THEN 'Ana' ELSE 'Speaker ' || speaker END AS label FROM utterances")
def _(m: Model) -> DataFrame:
    code = F.when(F.col("turn") % 5 == 0, "Moderator").otherwise(F.col("speaker"))
    names = F.when(F.col("source_id") % 2 == 0, F.create_map(F.lit("A"), F.lit(" Ana "), F.lit("B"), F.lit("  ")))
    return m.utterances.select("source_id", "turn", tx.speaker_label(code, names).alias("label"))


@query("view_transcript", "SELECT source_id AS id, CASE WHEN source_id % 4 = 0 THEN 'reviewed ' || source_id WHEN source_id % 4 = 2 THEN '' WHEN source_id % 4 = 1 THEN 'rebuilt' ELSE text END AS text FROM text_sources")
def _(m: Model) -> DataFrame:
    """Of four documents one was reviewed, one has a review that was not finished, one has no text and one only its raw one."""
    k = F.col("source_id")
    rows = m.documents.select(
        k.alias("id"), F.when(k % 4 == 0, F.lit("1998-01-01").cast("date")).alias("reviewed_at"), F.when(k % 4 < 2, F.concat(F.lit("reviewed "), k)).alias("reviewed_text"),
        F.when(k % 4 < 2, "rebuilt").otherwise(" ").alias("rebuilt_text"), F.when(k % 4 != 2, F.col("text")).alias("raw_text"),
    )
    return chunks.view_transcript(rows)


@query("normalize_display", "SELECT s.id AS source_id, 'the ' || name || ' met ' || name || '.' AS text, 2 AS n_replaced FROM sources s JOIN projects p ON p.id = s.project_id")
def _(m: Model) -> DataFrame:
    named = m.sources.select(F.col("id").alias("source_id"), "project_id").join(m.projects.select(F.col("id").alias("project_id"), "name"), "project_id")
    text = F.concat(F.lit("the "), F.lower("name"), F.lit(" met "), F.translate("name", "_", " "), F.lit("."))
    return chunks.normalize_display(named.select("source_id", text.alias("text")), named.select("source_id", F.col("name").alias("person"), F.lit(None).cast("string").alias("org")))


@query("legacy_interviews", "SELECT id AS interview_id, title FROM sources WHERE status = 'COMPLETED'")
def _(m: Model) -> DataFrame:
    payloads.legacy_views({"sources": m.sources}, {"interviews": ("sources", {"id": "interview_id"})})
    return m.spark.sql("SELECT interview_id, title FROM interviews WHERE status = 'COMPLETED'")
