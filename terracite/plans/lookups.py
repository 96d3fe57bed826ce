"""Queries: what is known of entities, lists for a source, pages, scopes, search, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracite.operators import aggregates, filters, joins, ranking, search, vectors
from terracite.plans.catalogue import query
from terracite.sources.model import Model

#: Mentions, links and active edges of every entity, as an expression for SQL.
INTEL = """
ends AS (
  SELECT *, source_entity_id AS entity_id, target_entity_id AS other_id, 'outgoing' AS direction FROM edges
  UNION ALL SELECT *, target_entity_id, source_entity_id, 'incoming' FROM edges WHERE source_entity_id <> target_entity_id),
intel AS (
  SELECT x.*, s.title AS source_title, s.conducted_at, s.created_at FROM (
    SELECT entity_id, m.source_id, 'mention' AS role, 'mention' AS kind, c.content AS evidence, chunk_id, sentiment FROM mentions m LEFT JOIN chunks c ON m.chunk_id = c.id
    UNION ALL SELECT entity_id, source_id, link_type, CASE WHEN origin IN ('upload_anchor','metadata_import','manual_tag','human_review') THEN 'anchor' ELSE 'source_entity' END, evidence, NULL, NULL FROM source_entities
    UNION ALL SELECT entity_id, source_id, 'related_via_relationship', 'relationship', evidence_text, NULL, NULL FROM ends WHERE review_status <> 'rejected') x
  JOIN sources s ON x.source_id = s.id),
roles AS (SELECT * FROM (VALUES ('interviewee',1),('interviewee_org',2),('primary_subject',3),('subject_organization',4),('author',5),('mention',6),('related_via_relationship',7)) t(role, strength))"""
COLUMNS = "entity_id, source_id, source_title, role, kind, evidence, chunk_id, sentiment, conducted_at, created_at"


def intel(m: Model) -> DataFrame:
    return search.entity_intel(m.mentions, m.source_entities, m.edges, m.sources, m.chunks)


def best(m: Model) -> DataFrame:
    return search.best_intel(m.mentions, m.source_entities, m.edges, m.sources, m.chunks)


@query("entity_intel_all", f"SELECT {COLUMNS} FROM intel", INTEL)
def _(m: Model) -> DataFrame:
    return intel(m)


@query("entity_intel_project", f"SELECT {COLUMNS} FROM intel WHERE source_id IN (SELECT id FROM sources WHERE project_id = 3)", INTEL)
def _(m: Model) -> DataFrame:
    return search.entity_intel(m.mentions, m.source_entities, m.edges, m.sources, m.chunks, project_id=3)


BEST = f"""SELECT {COLUMNS} FROM intel JOIN roles USING (role)
QUALIFY row_number() OVER (PARTITION BY entity_id, source_id ORDER BY strength, evidence NULLS LAST, chunk_id NULLS LAST, sentiment NULLS LAST, kind) = 1"""


@query("entity_intel_best_role", BEST, INTEL)
def _(m: Model) -> DataFrame:
    return best(m)


@query(
    "mentions_recency_top30",
    "SELECT entity_id, source_id, role, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY conducted_at DESC NULLS LAST, source_id, chunk_id NULLS LAST, role) AS place FROM best) WHERE place <= 30",
    INTEL + f", best AS ({BEST})",
)
def _(m: Model) -> DataFrame:
    return ranking.mentions_ranked(best(m)).select("entity_id", "source_id", "role", "chunk_id", "place")


@query(
    "mentions_asof_proximity",
    """SELECT entity_id, source_id, role, place FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY abs(epoch(conducted_at) - (epoch(TIMESTAMP '1996-06-15') + 43200)) NULLS LAST, conducted_at DESC NULLS LAST, source_id, chunk_id NULLS LAST, role) AS place
    FROM best) WHERE place <= 30""",
    INTEL + f", best AS ({BEST})",
)
def _(m: Model) -> DataFrame:
    targets = m.entities.select(F.col("id").alias("entity_id"), F.lit("1996-06-15").cast("date").alias("target_date"))
    return ranking.mentions_ranked(best(m), targets).select("entity_id", "source_id", "role", "place")


@query(
    "source_entity_items",
    """SELECT source_id, entity_id, name, type, place, label FROM (
      SELECT source_id, entity_id, CASE WHEN origin = 'upload_anchor' THEN CASE link_type WHEN 'interviewee' THEN 1 WHEN 'interviewee_org' THEN 2 WHEN 'participant' THEN 3 ELSE 4 END ELSE 5 END AS place,
        CASE link_type WHEN 'interviewee' THEN 'Interviewee' WHEN 'author' THEN 'Author' ELSE 'Primary Subject' END AS label FROM source_entities
      UNION ALL SELECT DISTINCT source_id, entity_id, 6, 'Mention' FROM mentions) JOIN entities e ON entity_id = e.id
    QUALIFY row_number() OVER (PARTITION BY source_id, entity_id ORDER BY place, label) = 1""",
)
def _(m: Model) -> DataFrame:
    return ranking.source_entity_items(m.source_entities, m.mentions, m.entities)


@query(
    "edges_by_entity_top30",
    """SELECT entity_id, direction, place, other_id, e.name AS other_name, relation_type, confidence, source_id FROM (
      SELECT *, row_number() OVER (PARTITION BY entity_id, direction ORDER BY confidence DESC NULLS LAST, id) AS place FROM ends WHERE review_status <> 'rejected' AND source_id IN (SELECT id FROM sources)) x
    LEFT JOIN entities e ON e.id = other_id WHERE place <= 30""",
    INTEL,
)
def _(m: Model) -> DataFrame:
    return ranking.entity_edges(m.edges, m.entities, m.sources)


@query("edges_touching", "SELECT entity_id, other_id, direction, x.id FROM ends x WHERE entity_id IN (SELECT id FROM entities WHERE type = 'ORGANIZATION' AND project_id = 7)", INTEL)
def _(m: Model) -> DataFrame:
    return joins.edges_touching(m.edges, m.entities.where("type = 'ORGANIZATION' and project_id = 7")).select("entity_id", "other_id", "direction", "id")


@query(
    "edges_named",
    """SELECT x.id, relation_type, confidence, review_status, coalesce(s.name, 'Unknown entity') AS source_name, coalesce(s.type, 'ORGANIZATION') AS source_type, coalesce(t.name, 'Unknown entity') AS target_name,
    coalesce(t.type, 'ORGANIZATION') AS target_type, title FROM edges x LEFT JOIN entities s ON s.id = source_entity_id LEFT JOIN entities t ON t.id = target_entity_id LEFT JOIN sources d ON d.id = source_id""",
)
def _(m: Model) -> DataFrame:
    return joins.edges_named(m.edges.drop("id"), m.entities, m.sources)


@query(
    "page_offset",
    "SELECT id, name, type, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 25.0) AS BIGINT) AS pages FROM entities WHERE canonical_entity_id IS NULL ORDER BY name, id LIMIT 25 OFFSET 50",
)
def _(m: Model) -> DataFrame:
    return ranking.page(filters.canonical_only(m.entities).select("id", "name", "type"), ["name", "id"], 3, 25)


@query(
    "page_keyset",
    """SELECT conversation_id, sequence, has_more FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence DESC) AS r, count(*) OVER (PARTITION BY conversation_id) > 3 AS has_more FROM (
    SELECT conv_id AS conversation_id, turn AS sequence, max(turn) OVER (PARTITION BY conv_id) AS bound FROM conversations) WHERE sequence < bound) WHERE r <= 3""",
)
def _(m: Model) -> DataFrame:
    messages = m.table("conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("sequence"))
    before = messages.groupBy("conversation_id").agg(F.max("sequence").alias("sequence"))
    return ranking.page_before(messages, before, 3)


@query("assign_sequence", "SELECT conv_id AS conversation_id, turn, 100 + row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS sequence FROM conversations")
def _(m: Model) -> DataFrame:
    messages = m.table("conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "role")
    base = messages.select("conversation_id").distinct().withColumn("last", F.lit(100))
    return ranking.assign_sequence(messages, ["turn", "role"], base).select("conversation_id", "turn", "sequence")


@query("scope_filter", "SELECT id, project_id, title FROM sources WHERE project_id IN (SELECT project_id FROM members WHERE user_id = 3 AND role IN ('owner', 'editor'))")
def _(m: Model) -> DataFrame:
    return filters.scope_to_user(m.sources, m.members, [3], ["owner", "editor"]).select("id", "project_id", "title")


@query("optional_filter", "SELECT id, title FROM sources WHERE project_id IN (1, 2) AND status IN ('FAILED')")
def _(m: Model) -> DataFrame:
    return filters.filter_optional(m.sources, project_id=[1, 2], status=["FAILED"], id=None).select("id", "title")


@query("topic_filter", "SELECT id FROM vectors WHERE topics IS NULL OR list_has_any(topics, ['3', '5'])")
def _(m: Model) -> DataFrame:
    return filters.filter_topics(m.vectors, ["3", "5"]).select("id")


@query("in_country", "SELECT id FROM sources WHERE project_id IN (SELECT id FROM projects WHERE country = 'NATION_3')")
def _(m: Model) -> DataFrame:
    return joins.in_country(m.sources, m.projects, "NATION_3").select("id")


@query("search_entities", "SELECT id, name FROM entities WHERE canonical_entity_id IS NULL AND (contains(lower(name), '#00000012') OR contains(normalized_name, '#00000012'))")
def _(m: Model) -> DataFrame:
    return filters.search_entities(m.entities, "#00000012").select("id", "name")


@query(
    "typeahead",
    """SELECT query_id, place, id, name, type FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, low, id) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY low, id) AS r FROM (
        SELECT query_id, e.*, lower(e.name) AS low, CASE WHEN e.project_id IS NULL THEN 2 ELSE 1 END AS tier FROM (SELECT id AS query_id, id AS asked, lower(name[1:2]) AS p FROM projects UNION ALL SELECT 100 + id, id, 'customer#0000001' FROM projects) q
        JOIN entities e ON starts_with(lower(e.name), p) AND (e.project_id IS NULL OR e.project_id = asked) WHERE canonical_entity_id IS NULL)) WHERE r <= 15) WHERE place <= 20""",
)
def _(m: Model) -> DataFrame:
    short = m.projects.select(F.col("id").alias("query_id"), F.col("id").alias("project_id"), F.substring("name", 1, 2).alias("prefix"))
    long = m.projects.select((F.col("id") + 100).alias("query_id"), F.col("id").alias("project_id"), F.lit("customer#0000001").alias("prefix"))
    return filters.typeahead(m.entities, short.unionByName(long))


@query("filter_edges", "SELECT id FROM edges WHERE review_status = 'pending' AND target_entity_id = 'P10'")
def _(m: Model) -> DataFrame:
    return filters.filter_edges(m.edges, "P10", "incoming", "pending").select("id")


@query(
    "resolve_scope",
    """SELECT l_orderkey AS request_id, r.source_id, coalesce(r.project_id, s.project_id) AS project_id, s.project_id IS NOT NULL AND (r.project_id IS NULL OR r.project_id = s.project_id) AS ok FROM (
      SELECT DISTINCT l_orderkey, l_orderkey AS source_id, CASE WHEN l_orderkey % 3 > 0 THEN l_orderkey % 25 END AS project_id FROM lineitem) r LEFT JOIN sources s ON s.id = r.source_id""",
)
def _(m: Model) -> DataFrame:
    key = F.col("l_orderkey")
    requests = m.lines.select(key.alias("request_id"), key.alias("source_id"), F.when(key % 3 > 0, key % 25).alias("project_id")).distinct()
    return filters.resolve_scope(requests, m.sources)


@query(
    "validate_anchors",
    """SELECT request_id, project_id, entity_id, role, reason IS NULL AS ok, reason FROM (
      SELECT o_orderkey AS request_id, CAST(o_orderkey % 25 AS BIGINT) AS project_id, CASE o_orderkey % 3 WHEN 0 THEN 'C' || o_custkey WHEN 1 THEN 'S' || (o_orderkey % 200) ELSE 'P' || (o_orderkey % 30) END AS entity_id, CASE WHEN o_orderkey % 2 = 0 THEN 'interviewee' ELSE 'interviewee_org' END AS role,
        CASE WHEN e.id IS NULL THEN 'missing' WHEN canonical_entity_id IS NOT NULL THEN 'not canonical' WHEN CASE WHEN o_orderkey % 2 = 1 THEN e.type NOT IN ('COMPANY','GOVERNMENT','ORGANIZATION','PUBLIC_INSTITUTION','STATE_OWNED_ENTERPRISE','MEDIA_OR_PUBLICATION') ELSE e.type <> 'PERSON' END THEN 'wrong type'
          WHEN e.project_id IS NOT NULL AND e.project_id <> o_orderkey % 25 THEN 'other project' END AS reason
      FROM orders LEFT JOIN entities e ON e.id = CASE o_orderkey % 3 WHEN 0 THEN 'C' || o_custkey WHEN 1 THEN 'S' || (o_orderkey % 200) ELSE 'P' || (o_orderkey % 30) END)""",
)
def _(m: Model) -> DataFrame:
    k = F.col("o_orderkey")
    who = F.when(k % 3 == 0, F.concat(F.lit("C"), F.col("o_custkey"))).when(k % 3 == 1, F.concat(F.lit("S"), k % 200)).otherwise(F.concat(F.lit("P"), k % 30))
    role = F.when(k % 2 == 0, "interviewee").otherwise("interviewee_org")
    return filters.validate_anchors(m.table("orders").select(k.alias("request_id"), (k % 25).alias("project_id"), who.alias("entity_id"), role.alias("role")), m.entities)


@query(
    "messages_with_evidence",
    """SELECT conv_id * 1000 + turn AS message_id, coalesce(string_agg(e.position || ':' || e.chunk_id || ':' || coalesce(c.content, ''), '|' ORDER BY e.position), '') AS evidence FROM conversations
    LEFT JOIN (SELECT CAST(l_orderkey * 1000 + l_linenumber AS BIGINT) AS message_id, l_linenumber AS position, l_orderkey || '-' || l_linenumber AS chunk_id FROM lineitem GROUP BY ALL) e ON e.message_id = conv_id * 1000 + turn
    LEFT JOIN chunks c ON c.id = e.chunk_id GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    messages = m.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"))
    evidence = m.lines.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("message_id"), F.col("l_linenumber").alias("position"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id")).distinct()
    listed = F.transform("evidence", lambda e: F.concat_ws(":", e["position"], e["chunk_id"], F.coalesce(e["content"], F.lit(""))))
    return joins.messages_with_evidence(messages, evidence, m.chunks, m.sources).select("message_id", F.coalesce(F.array_join(listed, "|"), F.lit("")).alias("evidence"))


@query("mentions_with_chunk", "SELECT entity_id, m.source_id, chunk_id, content FROM mentions m LEFT JOIN chunks c ON c.id = chunk_id")
def _(m: Model) -> DataFrame:
    return joins.mentions_with_chunk(m.mentions, m.chunks).select("entity_id", "source_id", "chunk_id", "content")


@query("chunks_with_source", "SELECT c.id, c.source_id, title, project_id, status FROM chunks c JOIN sources s ON s.id = c.source_id")
def _(m: Model) -> DataFrame:
    return joins.chunks_with_source(m.chunks, m.sources).select("id", "source_id", "title", "project_id", "status")


@query("bootstrap_members", "SELECT tenant_id, user_id, CASE WHEN bool_or(role = 'owner') THEN 'owner' ELSE 'member' END AS role FROM members, (SELECT DISTINCT tenant_id FROM projects) GROUP BY 1, 2")
def _(m: Model) -> DataFrame:
    return joins.bootstrap_members(m.members, m.projects)


VECTORS = """
asked AS (SELECT id AS query_id, embedding AS q FROM vectors WHERE id % 20 = 0),
sims AS (SELECT query_id, v.id, round(list_sum(list_transform(list_zip(v.embedding, q), lambda x : CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))
  / (sqrt(list_sum(list_transform(v.embedding, lambda x : CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda x : CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS similarity, v.topics FROM vectors v, asked),
top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank, id, similarity FROM sims WHERE similarity > 0.25)"""


def asked(m: Model) -> DataFrame:
    return m.vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


@query("vector_topk", "SELECT * FROM top WHERE rank <= 10", VECTORS)
def _(m: Model) -> DataFrame:
    return search.hybrid_search(m.vectors, asked(m), threshold=0.25, k=10)


@query(
    "vector_topk_filtered",
    "SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank, id, similarity FROM sims WHERE similarity > 0.1 AND (topics IS NULL OR list_has_any(topics, ['1','2'])) AND id % 25 IN (SELECT id FROM projects WHERE region = 'EUROPE' AND country = 'NATION_3')) WHERE rank <= 5",
    VECTORS,
)
def _(m: Model) -> DataFrame:
    return search.hybrid_search(m.vectors, asked(m), m.projects, country="NATION_3", topics=["1", "2"], threshold=0.1, k=5)


QUESTIONS = """
questions AS (SELECT id AS question_id, ['current','timeline','point_in_time','none'][id // 20 % 4 + 1] AS intent, TIMESTAMP '1996-01-01' AS target FROM vectors WHERE id % 20 = 0),
hits AS (SELECT query_id AS question_id, rank, id AS chunk_id, similarity, (SELECT min(id) FROM sources) + id AS source_id FROM top WHERE rank <= 10)"""


def hits(m: Model) -> DataFrame:
    found = search.hybrid_search(m.vectors, asked(m), threshold=0.25, k=10)
    first = m.sources.agg(F.min("id").alias("first"))
    return found.crossJoin(F.broadcast(first)).select(F.col("query_id").alias("question_id"), "rank", F.col("id").alias("chunk_id"), "similarity", (F.col("first") + F.col("id")).alias("source_id"))  # one row


def questions(m: Model) -> DataFrame:
    intent = F.element_at(F.array(*[F.lit(v) for v in ("current", "timeline", "point_in_time", "none")]), (F.expr("id div 20 % 4") + 1).cast("int"))
    return m.vectors.where("id % 20 = 0").select(F.col("id").alias("question_id"), intent.alias("intent"), F.lit("1996-01-01").cast("date").alias("target_date"))


@query(
    "temporal_rerank",
    """SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY CASE intent WHEN 'current' THEN -t WHEN 'timeline' THEN t WHEN 'point_in_time' THEN abs(t - epoch(target)) ELSE 0 END, rank, chunk_id) AS place, chunk_id, source_id, rank FROM (
    SELECT h.*, intent, target, coalesce(epoch(conducted_at), 0) AS t FROM hits h JOIN questions USING (question_id) LEFT JOIN sources s ON s.id = source_id)""",
    VECTORS + "," + QUESTIONS,
)
def _(m: Model) -> DataFrame:
    return ranking.temporal_rerank(hits(m).drop("similarity"), m.sources, questions(m))


@query(
    "citations",
    "SELECT question_id, rank AS position, chunk_id, CAST(round(similarity * 100) AS INT) AS relevance, rank IN (1, 1 + question_id // 20 % 10) AS used_in_text FROM hits",
    VECTORS + "," + QUESTIONS,
)
def _(m: Model) -> DataFrame:
    said = F.concat(F.lit("It was so [1], and later ["), (F.expr("id div 20 % 10") + 1).cast("string"), F.lit("] too."))
    return search.citations(hits(m), m.vectors.where("id % 20 = 0").select(F.col("id").alias("question_id"), said.alias("answer")))


@query("ann_ivf")
def _(m: Model) -> DataFrame:
    return vectors.Index(m.vectors).search(asked(m), 10)


@query("ann_lsh")
def _(m: Model) -> DataFrame:
    return search.ann_search(m.vectors, asked(m), 10)


@query("missing_embeddings", "SELECT id, project_id FROM vectors WHERE embedding IS NULL OR id % 11 = 3")
def _(m: Model) -> DataFrame:
    some = m.vectors.withColumn("embedding", F.when(F.col("id") % 11 != 3, F.col("embedding")))
    return search.missing_embeddings(some).select("id", "project_id")


SOURCES = """counted AS (SELECT s.project_id, m.entity_id, count(*) AS n FROM mentions m JOIN sources s ON s.id = m.source_id GROUP BY 1, 2),
named_used AS (SELECT u.project_id, u.entity_id, n, name, e.project_id AS scope FROM counted u JOIN entities e ON e.id = u.entity_id WHERE canonical_entity_id IS NULL),
own AS (SELECT project_id, entity_id, n FROM named_used QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, entity_id) <= 28),
few AS (SELECT p.project_id FROM (SELECT DISTINCT project_id FROM sources) p LEFT JOIN (SELECT project_id, count(*) AS k FROM own GROUP BY 1) o USING (project_id) WHERE coalesce(k, 0) < 5),
world AS (SELECT entity_id, CAST(sum(n) AS BIGINT) AS n FROM named_used WHERE scope IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 28)"""


@query(
    "candidate_shortlist",
    """SELECT source_id, place, entity_id, name, tier FROM (SELECT source_id, x.entity_id, name, tier, row_number() OVER (PARTITION BY source_id ORDER BY tier, -n, x.entity_id) AS place FROM (
      SELECT * FROM (
        SELECT id AS source_id, interviewee_entity_id AS entity_id, 1 AS tier, 0 AS n FROM sources UNION ALL SELECT id, interviewee_org_entity_id, 1, 0 FROM sources WHERE interviewee_org_entity_id IS NOT NULL
        UNION ALL SELECT s.id, o.entity_id, 2, n FROM sources s JOIN own o USING (project_id) UNION ALL SELECT s.id, w.entity_id, 3, n FROM sources s JOIN few USING (project_id), world w)
      QUALIFY row_number() OVER (PARTITION BY source_id, entity_id ORDER BY tier, -n) = 1) x JOIN entities e ON e.id = x.entity_id WHERE canonical_entity_id IS NULL) WHERE place <= 28""",
    SOURCES,
)
def _(m: Model) -> DataFrame:
    return ranking.candidate_shortlist(m.sources, m.mentions, m.entities)


@query("recent_sources", "SELECT id, title, created_at FROM sources ORDER BY created_at DESC, id LIMIT 6")
def _(m: Model) -> DataFrame:
    return ranking.recent_sources(m.sources).select("id", "title", "created_at")


@query("recent_projects", "SELECT id, name, latest FROM projects JOIN (SELECT project_id, max(created_at) AS latest FROM sources GROUP BY 1) ON project_id = id ORDER BY latest DESC, id LIMIT 10")
def _(m: Model) -> DataFrame:
    latest = m.sources.groupBy(F.col("project_id").alias("id")).agg(F.max("created_at").alias("latest"))
    return ranking.recent(m.projects.join(latest, "id").select("id", "name", "latest"), "latest", 10)


@query(
    "workspace_brief",
    """SELECT user_id, count(*) AS n, string_agg(line, chr(10) ORDER BY place) AS brief FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY user_id ORDER BY place) AS chars FROM (
      SELECT user_id, '- ' || p.name || ': ' || title AS line, row_number() OVER (PARTITION BY user_id ORDER BY p.name, created_at DESC, s.id) AS place FROM members m JOIN projects p ON p.id = m.project_id JOIN sources s ON s.project_id = m.project_id WHERE status = 'COMPLETED') WHERE place <= 24) WHERE chars <= 500 GROUP BY 1""",
)
def _(m: Model) -> DataFrame:
    return ranking.workspace_brief(m.members, m.projects, m.sources, 24, 500)


@query("user_search", "SELECT user_id, email, roles, count(*) OVER () AS total FROM (SELECT user_id, 'user' || user_id || '@example.org' AS email, string_agg(role, ',' ORDER BY role) AS roles FROM members GROUP BY 1) WHERE contains(email, 'user1') ORDER BY email LIMIT 5")
def _(m: Model) -> DataFrame:
    users = m.members.select("user_id").distinct().withColumn("email", F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.org")))
    profiles = users.select("user_id", F.lit(None).cast("string").alias("full_name"))
    return filters.search_users(users, profiles, m.members, "USER1", 1, 5).select("user_id", "email", "roles", "total")


@query("roles_by_user", "SELECT user_id, string_agg(role, ',' ORDER BY role) AS roles FROM members GROUP BY 1")
def _(m: Model) -> DataFrame:
    return aggregates.roles_by_user(m.members)


@query("label_budget", "SELECT project_id AS graph_id, entity_id, mentions, place FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY mentions DESC, entity_id) AS place, least(8, greatest(3, ceil(count(*) OVER (PARTITION BY project_id) * 0.4))) AS allowed FROM (SELECT s.project_id, entity_id, count(*) AS mentions FROM mentions m JOIN sources s ON s.id = m.source_id WHERE status = 'COMPLETED' GROUP BY 1, 2)) WHERE place <= allowed")
def _(m: Model) -> DataFrame:
    return ranking.label_budget(aggregates.mention_counts(m.mentions, m.sources).withColumnRenamed("project_id", "graph_id"))
