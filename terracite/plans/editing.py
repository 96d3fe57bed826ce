"""Queries: editors' jobs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracite.operators import editorial, joins, reports
from terracite.plans.boards import ROOTS, roots
from terracite.plans.catalogue import query
from terracite.sources.model import Model


@query("upsert_ignore", "SELECT id, o_totalprice AS v FROM (SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderkey % 2 = 0) UNION ALL SELECT o_orderkey, -1.0 :: DOUBLE FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0")
def _(m: Model) -> DataFrame:
    rows = m.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    new = rows.where("id % 3 = 0").select("id", F.lit(-1.0).alias("v"))
    return editorial.upsert_ignore(rows.where("id % 2 = 0"), new.unionByName(new), ["id"])


@query("upsert_update", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN -1.0 :: DOUBLE ELSE o_totalprice END AS v, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS s FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def _(m: Model) -> DataFrame:
    rows = m.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"))
    return editorial.upsert_update(rows.where("id % 2 = 0"), rows.where("id % 3 = 0").select("id", F.lit(-1.0).alias("v")), ["id"], ["v"])


@query(
    "replace_derived",
    """SELECT id, review_status, confidence FROM edges WHERE source_id % 5 <> 0 OR NOT (review_status = 'pending' AND origin = 'llm') UNION ALL SELECT id, 'pending', 0.25 :: DOUBLE FROM edges WHERE source_id % 5 = 0 AND review_status = 'pending' AND origin = 'llm'""",
)
def _(m: Model) -> DataFrame:
    again = m.edges.where("source_id % 5 = 0").withColumn("confidence", F.lit(0.25)).withColumn("review_status", F.lit("pending"))
    touched = m.sources.where("id % 5 = 0").select(F.col("id").alias("source_id"))
    keep = ~((F.col("review_status") == "pending") & (F.col("origin") == "llm"))
    keys = ["source_entity_id", "target_entity_id", "relation_type", "source_id"]
    return editorial.replace_derived(m.edges, again, touched, keys, keep).select("id", "review_status", "confidence")


MERGE = """
to_map AS (SELECT id, 'S' || ((CAST(id[2:] AS BIGINT) - 1) // 4 * 4 + 1) AS target FROM entities WHERE type = 'ORGANIZATION' AND (CAST(id[2:] AS BIGINT) - 1) % 4 > 0),
moved AS (SELECT x.* EXCLUDE (source_entity_id), coalesce(target, source_entity_id) AS source_entity_id FROM edges x LEFT JOIN to_map m ON m.id = source_entity_id)"""


def mapping(m: Model) -> DataFrame:
    k = F.substring("id", 2, 20).cast("long")
    rows = m.entities.where("type = 'ORGANIZATION'").where((k - 1) % 4 > 0)
    return rows.select(F.col("id").alias("from_id"), F.concat(F.lit("S"), k - 1).alias("to_id"))  # chains of up to three


@query(
    "merge_entities",
    "SELECT id, source_entity_id, review_status FROM moved QUALIFY row_number() OVER (PARTITION BY source_entity_id, target_entity_id, relation_type, source_id ORDER BY CASE WHEN review_status = 'pending' THEN 1 ELSE 0 END, confidence DESC NULLS LAST, id) = 1",
    MERGE,
)
def _(m: Model) -> DataFrame:
    out = editorial.merge_entities(m.entities, m.aliases, m.mentions, m.edges, mapping(m))
    return out["edges"].select("id", "source_entity_id", "review_status")


@query("merge_redirects", "SELECT e.id, coalesce(target, canonical_entity_id) AS canonical_entity_id FROM entities e LEFT JOIN to_map m USING (id)", MERGE)
def _(m: Model) -> DataFrame:
    return editorial.merge_entities(m.entities, m.aliases, m.mentions, m.edges, mapping(m))["entities"].select("id", "canonical_entity_id")


#: Requests for other names, and what becomes of them: a name that stays decides, else the first canonical one that asks for it.
RENAMES = """held AS (SELECT normalized_name AS nn, min(id) AS stays FROM entities WHERE type = 'PRODUCT' AND canonical_entity_id IS NULL AND id NOT IN (SELECT id FROM claims) GROUP BY 1),
firsts AS (SELECT nn, min(id) AS first FROM claims WHERE canonical GROUP BY 1),
settled AS (SELECT id, new_name, nn, nullif(coalesce(stays, first), id) AS target_id FROM claims LEFT JOIN held USING (nn) LEFT JOIN firsts USING (nn))"""
CLAIMS = "claims AS (SELECT r.id, new_name, lower(new_name) AS nn, canonical_entity_id IS NULL AS canonical FROM requests r JOIN entities USING (id) WHERE new_name <> name)"


@query(
    "rename_entities",
    "SELECT id, new_name, CASE WHEN target_id IS NULL THEN 'rename' ELSE 'merge' END AS outcome, target_id FROM settled UNION ALL SELECT r.id, new_name, 'same', NULL FROM requests r JOIN entities USING (id) WHERE new_name = name",
    f"requests AS (SELECT 'P' || p_partkey AS id, CASE p_partkey % 2 WHEN 0 THEN p_name ELSE 'Fresh ' || p_partkey END AS new_name FROM part WHERE p_partkey % 10 < 2), {CLAIMS}, {RENAMES}",
)
def _(m: Model) -> DataFrame:
    p = F.col("p_partkey")
    requests = m.table("part").where(p % 10 < 2).select(F.concat(F.lit("P"), p).alias("id"), F.when(p % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("Fresh "), p)).alias("new_name"))
    return editorial.rename_entities(m.entities, requests)


#: Names of others, names that several ask for, and names that are given up.
BATCH = f"""requests AS (SELECT 'P' || p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Fresh ' || (p_partkey // 20) WHEN 1 THEN upper(p_name) WHEN 2 THEN 'Old ' || p_partkey ELSE (SELECT min(x.p_name) FROM part x WHERE x.p_partkey = p.p_partkey + 1) END AS new_name
  FROM part p WHERE p_partkey % 5 < 4 AND p_partkey < (SELECT max(p_partkey) FROM part)), {CLAIMS}, {RENAMES}"""


def batch(m: Model) -> dict[str, DataFrame]:
    p = F.col("p_partkey")
    part = m.table("part").select("p_partkey", "p_name")
    following = part.select((p - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    name = F.when(p % 5 == 0, F.concat(F.lit("Fresh "), F.expr("p_partkey div 20"))).when(p % 5 == 1, F.upper("p_name")).when(p % 5 == 2, F.concat(F.lit("Old "), p)).otherwise(F.col("next"))
    requests = part.join(following, "p_partkey").where(p % 5 < 4).select(F.concat(F.lit("P"), p).alias("id"), name.alias("new_name"))
    return editorial.apply_renames(m.entities, m.aliases, m.mentions, m.edges, requests)


@query(
    "renamed_entities",
    "SELECT e.id, CASE WHEN s.id IS NOT NULL AND target_id IS NULL THEN new_name ELSE name END AS name, CASE WHEN s.id IS NOT NULL AND target_id IS NULL THEN nn ELSE normalized_name END AS normalized_name, coalesce(target_id, canonical_entity_id) AS canonical_entity_id FROM entities e LEFT JOIN settled s USING (id)",
    BATCH,
)
def _(m: Model) -> DataFrame:
    return batch(m)["entities"].select("id", "name", "normalized_name", "canonical_entity_id")


@query(
    "renamed_aliases",
    """SELECT DISTINCT entity_id, alias_normalized, scope FROM (SELECT entity_id, alias_normalized, scope FROM aliases
  UNION ALL SELECT id, normalized_name, project_id FROM settled JOIN entities USING (id) WHERE target_id IS NULL AND nn <> normalized_name
  UNION ALL SELECT target_id, normalized_name, project_id FROM settled JOIN entities USING (id) WHERE target_id IS NOT NULL)""",
    BATCH,
)
def _(m: Model) -> DataFrame:
    return batch(m)["aliases"].select("entity_id", "alias_normalized", "scope").distinct()


@query(
    "renamed_mentions",
    "SELECT DISTINCT coalesce(target_id, entity_id) AS entity_id, source_id, chunk_id, sentiment FROM mentions LEFT JOIN settled ON id = entity_id",
    BATCH,
)
def _(m: Model) -> DataFrame:
    return batch(m)["mentions"].select("entity_id", "source_id", "chunk_id", "sentiment")


@query("editorial_batch", "SELECT id, CASE source_id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' ELSE review_status END AS review_status FROM edges")
def _(m: Model) -> DataFrame:
    k = F.col("source_id") % 4
    first = m.edges.where(k < 2).select("id", F.lit("approve").alias("decision"), F.lit(1).alias("decided_at"))
    then = m.edges.where(k < 2).select("id", F.when(k == 0, "reject").otherwise("restore").alias("decision"), F.lit(2).alias("decided_at"))
    return editorial.apply_decisions(m.edges, first.unionByName(then)).select("id", "review_status")


@query(
    "retype_edges",
    """SELECT id, relation_type, review_status FROM (SELECT id, relation_type, CASE WHEN source_id % 9 = 0 AND relation_type = 'ally' THEN 'rejected' ELSE review_status END AS review_status FROM edges
      WHERE id NOT IN (SELECT source_entity_id || '|' || target_entity_id || '|advisor|' || source_id FROM edges WHERE source_id % 9 = 0 AND relation_type = 'ally')
      UNION ALL SELECT source_entity_id || '|' || target_entity_id || '|advisor|' || source_id, 'advisor', 'approved' FROM edges WHERE source_id % 9 = 0 AND relation_type = 'ally')""",
)
def _(m: Model) -> DataFrame:
    requests = m.edges.where("source_id % 9 = 0 and relation_type = 'ally'").select("id", F.lit("advisor").alias("new_type"))
    return editorial.retype_edges(m.edges, requests).select("id", "relation_type", "review_status")


@query("tenant_orphans", "SELECT 'sources' AS table_name, (SELECT count(*) FROM sources WHERE project_id NOT IN (SELECT id FROM projects WHERE id < 20)) AS n UNION ALL SELECT 'members', (SELECT count(*) FROM members WHERE project_id NOT IN (SELECT id FROM projects WHERE id < 20))")
def _(m: Model) -> DataFrame:
    return editorial.inherit_tenants(m.projects.where("id < 20"), {"sources": m.sources, "members": m.members})["orphans"]


@query("backfill_links", "SELECT count(*) AS expected, count(*) AS actual, true AS ok FROM (SELECT id FROM sources WHERE interviewee_entity_id IS NOT NULL UNION ALL SELECT id FROM sources WHERE interviewee_org_entity_id IS NOT NULL)")
def _(m: Model) -> DataFrame:
    return editorial.backfill_links(joins.anchors_of(m.sources), m.source_entities)[1]


@query("claim_invites", "SELECT project_id, user_id, 'user' || user_id || '@example.org' AS invite_email, CASE WHEN user_id % 2 = 0 THEN 'claimed' ELSE 'pending' END AS status FROM (SELECT project_id, user_id AS u, CASE WHEN user_id % 2 = 0 THEN user_id END AS user_id FROM members WHERE user_id % 2 = 0)")
def _(m: Model) -> DataFrame:
    mail = F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.org"))
    invited = m.members.where("user_id % 2 = 0").select("project_id", F.lit(None).cast("long").alias("user_id"), mail.alias("invite_email"))
    profiles = m.members.select("user_id", F.upper(mail).alias("email")).distinct()
    return editorial.claim_invites(invited, profiles)


@query("delete_sources", "SELECT 'chunks' AS name, (SELECT count(*) FROM chunks WHERE source_id % 3 <> 0) AS n UNION ALL SELECT 'mentions', (SELECT count(*) FROM mentions WHERE source_id % 3 <> 0)")
def _(m: Model) -> DataFrame:
    gone = m.table("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("source_id"))
    left = editorial.delete_sources({"chunks": m.chunks, "mentions": m.mentions}, gone)
    count = lambda name: left[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return count("chunks").unionByName(count("mentions"))


def _requests(m: Model) -> tuple[DataFrame, DataFrame]:
    asked = m.sources.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, "COMPLETED").otherwise("EXTRACTING").alias("new_status"))
    return editorial.guarded_update(m.sources, asked, [("EMBEDDING", "COMPLETED"), ("FAILED", "EXTRACTING"), ("COMPLETED", "EXTRACTING")])


@query("guarded_update", "SELECT id, CASE WHEN id % 8 = 0 AND status = 'EMBEDDING' THEN 'COMPLETED' WHEN id % 8 = 4 AND status IN ('FAILED', 'COMPLETED') THEN 'EXTRACTING' ELSE status END AS status FROM sources")
def _(m: Model) -> DataFrame:
    return _requests(m)[0].select("id", "status")


@query("guarded_update_refused", "SELECT id, CASE WHEN id % 8 = 0 THEN 'COMPLETED' ELSE 'EXTRACTING' END AS new_status, 'not from ' || status AS reason FROM sources WHERE id % 4 = 0 AND NOT ((id % 8 = 0 AND status = 'EMBEDDING') OR (id % 8 = 4 AND status IN ('FAILED', 'COMPLETED')))")
def _(m: Model) -> DataFrame:
    return _requests(m)[1]


@query("merge_metadata", """SELECT id, CAST(id[2:] AS BIGINT) % 2 = 0 AS needs_review, 'system' AS by FROM entities WHERE type = 'PRODUCT'""")
def _(m: Model) -> DataFrame:
    even = F.substring("id", 2, 20).cast("long") % 2 == 0
    rows = m.entities.where("type = 'PRODUCT'").select("id", F.lit('{"needs_review": "false", "by": "system"}').alias("metadata"))
    patches = rows.where(even).select("id", F.lit('{"needs_review": "true"}').alias("patch"))
    out = editorial.merge_metadata(rows, patches)
    return out.select("id", (F.get_json_object("metadata", "$.needs_review") == "true").alias("needs_review"), F.get_json_object("metadata", "$.by").alias("by"))


@query("correct_column", "SELECT o_orderkey AS id, CAST(o_orderkey % 100 AS BIGINT) AS old, CAST(7 AS BIGINT) AS new FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 100 <> 7 AND o_orderkey % 10 > 0")
def _(m: Model) -> DataFrame:
    k = F.col("o_orderkey")
    rows = m.table("orders").select(k.alias("id"), (k % 100).alias("duration"))
    fixes = m.table("orders").where(k % 5 == 0).select(k.alias("id"), F.when(k % 10 > 0, 7.3).otherwise(-1.0).alias("value"))
    return editorial.correct_column(rows, fixes, "duration")[1]


@query("edit_aliases", "SELECT entity_id, alias FROM aliases WHERE NOT (entity_id[1:1] = 'C' AND CAST(entity_id[2:] AS BIGINT) % 10 = 0) UNION ALL SELECT 'P' || p_partkey, 'New name ' || p_partkey FROM part WHERE p_partkey % 4 = 0")
def _(m: Model) -> DataFrame:
    c, p = F.col("c_custkey"), F.col("p_partkey")
    gone = m.table("customer").where(c % 10 == 0).select(F.concat(F.lit("C"), c).alias("entity_id"), F.col("c_name").alias("alias"), F.lit("remove").alias("action"))
    new = m.table("part").select(F.concat(F.lit("P"), p).alias("entity_id"), F.concat(F.lit("New name "), p).alias("alias"), F.lit("add").alias("action"))
    return editorial.edit_aliases(m.aliases, m.entities, gone.unionByName(new).unionByName(new)).select("entity_id", "alias")


LEDGER = """
s AS (SELECT id AS source_id, project_id FROM sources WHERE status = 'COMPLETED'),
seen AS (SELECT m.*, project_id, root_id, content FROM mentions m JOIN s USING (source_id) JOIN walk w ON w.id = entity_id LEFT JOIN chunks c ON c.id = chunk_id),
fame AS (SELECT project_id, root_id, count(*) AS fame FROM seen GROUP BY 1, 2),
groups AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY project_id, root_id, source_id ORDER BY chunk_id NULLS LAST, sentiment) = 1),
candidates AS (
  SELECT g.project_id, 0 AS tier, -CAST(fame AS DOUBLE) AS weight, g.root_id AS tie, source_id, coalesce(content, name) AS excerpt, 'Entity mention with ' || sentiment || ' sentiment' AS note FROM groups g JOIN fame USING (project_id, root_id) JOIN entities e ON e.id = g.root_id
  UNION ALL SELECT project_id, 1, -confidence, id, source_id, coalesce(evidence_text, source_entity_id || ' ' || relation_type || ' ' || target_entity_id), relation_type FROM edges JOIN s USING (source_id) WHERE review_status <> 'rejected'),
once AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY project_id, source_id, trim(regexp_replace(lower(trim(excerpt)), '[!-/:-@\\[-`{-~\\s]+', ' ', 'g')) ORDER BY tier, weight, tie) = 1),
tiered AS (SELECT *, row_number() OVER (PARTITION BY project_id, tier ORDER BY weight, tie, source_id) AS r FROM once),
ledger AS (SELECT project_id, 'EV-' || place AS evidence_id, CASE tier WHEN 0 THEN 'entity_mention' ELSE 'relationship' END AS kind, source_id, excerpt, note, place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY tier, r) AS place FROM tiered WHERE r <= CASE tier WHEN 0 THEN 18 ELSE 30 END) WHERE place <= 30)"""


def ledger(m: Model) -> DataFrame:
    return reports.evidence_ledger(m.mentions, m.edges, m.sources, m.entities, m.chunks, roots(m))


@query("evidence_ledger", "SELECT * EXCLUDE (place) FROM ledger", ROOTS + "," + LEDGER)
def _(m: Model) -> DataFrame:
    return ledger(m)


@query(
    "hydrate_blocks",
    """SELECT project_id, block_id, CASE block_id WHEN 1 THEN 'EV-2,EV-3' ELSE 'EV-1' END AS evidence_ids, count(DISTINCT source_id) AS n_sources FROM ledger, (VALUES (1), (2)) b(block_id) WHERE (block_id = 1 AND place IN (2, 3)) OR (block_id = 2 AND place = 1) GROUP BY 1, 2""",
    ROOTS + "," + LEDGER,
)
def _(m: Model) -> DataFrame:
    refs = F.when(F.col("block_id") == 1, F.array(F.lit("EV-3"), F.lit("EV-2"), F.lit("EV-99"))).otherwise(F.array(F.lit("EV-77")))
    blocks = m.projects.select(F.col("id").alias("project_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("block_id")).select("*", refs.alias("refs"), F.lit("nothing like this").alias("entity"))
    return reports.hydrate_blocks(blocks, ledger(m))


@query(
    "best_chunk",
    """SELECT claim_id, id AS chunk_id FROM (SELECT s.id AS claim_id, c.id, row_number() OVER (PARTITION BY s.id ORDER BY CASE WHEN s.id % 3 = 0 AND c.id = s.id || '-2' THEN 0 WHEN s.id % 3 = 1 AND contains(c.content, 'steel') THEN 1 ELSE 2 END,
      CASE WHEN (s.id % 3 = 0 AND c.id = s.id || '-2') OR (s.id % 3 = 1 AND contains(c.content, 'steel')) THEN 0 ELSE CASE WHEN contains(lower(c.content), 'bolt') THEN -4 ELSE 0 END END, chunk_index, c.id) AS r FROM sources s JOIN chunks c ON c.source_id = s.id) WHERE r = 1""",
)
def _(m: Model) -> DataFrame:
    k = F.col("id")
    claims = m.sources.select(k.alias("claim_id"), k.alias("source_id"), F.when(k % 3 == 0, F.concat(k, F.lit("-2"))).alias("chunk_id"), F.when(k % 3 == 1, "steel").otherwise("").alias("snippet"), F.array(F.lit("Bolt"), F.lit("xy")).alias("terms"))
    return reports.best_chunk(claims, m.chunks).select("claim_id", "chunk_id")


@query(
    "project_brief",
    """SELECT p.id AS project_id, coalesce(n, 0) AS n_sources, name || ' (' || country || ', ' || region || ')' || coalesce(chr(10) || lines, '') AS brief FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n, string_agg('- ' || title || ' [' || array_to_string(topics, ', ') || ']', chr(10) ORDER BY '- ' || title || ' [' || array_to_string(topics, ', ') || ']', id) AS lines FROM sources WHERE status = 'COMPLETED' GROUP BY 1) s ON s.project_id = p.id""",
)
def _(m: Model) -> DataFrame:
    return reports.project_brief(m.projects, m.sources)
