"""Queries: counts, boards, indicators, roll-ups and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracite.functions import text as tx
from terracite.operators import aggregates, graph, joins, ranking, reports
from terracite.plans.catalogue import query
from terracite.plans.lookups import INTEL
from terracite.sources.model import Model

#: The canonical end of every entity's chain.
ROOTS = """
walk AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT id, id AS node, canonical_entity_id AS next, 0 AS depth FROM entities UNION ALL SELECT w.id, e.id, e.canonical_entity_id, depth + 1 FROM w JOIN entities e ON e.id = w.next WHERE depth < 20)
  SELECT id, arg_max(node, depth) AS root_id, max(depth) AS depth FROM w GROUP BY 1))"""
CO = """
links AS (SELECT source_id, entity_id, list_sort(list(DISTINCT link_type)) AS link_types FROM source_entities GROUP BY 1, 2),
co AS (SELECT a.entity_id, b.entity_id AS other_id, e.name AS other_name, e.type AS other_type, a.source_id, b.link_types FROM links a JOIN links b ON a.source_id = b.source_id AND a.entity_id <> b.entity_id JOIN entities e ON e.id = b.entity_id)"""


def roots(m: Model) -> DataFrame:
    return graph.canonical_roots(m.entities).select("id", "root_id")


def co(m: Model) -> DataFrame:
    return joins.co_occurrence(m.source_entities, m.sources, m.entities)


@query("count_by_status", "SELECT status, project_id, count(*) AS n FROM sources GROUP BY ALL")
def _(m: Model) -> DataFrame:
    return aggregates.count_by(m.sources, ["status", "project_id"])


@query("status_board", "SELECT project_id, count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status NOT IN ('COMPLETED', 'FAILED')) AS processing FROM sources GROUP BY 1")
def _(m: Model) -> DataFrame:
    return aggregates.status_board(m.sources)


@query("sources_per_project", "SELECT project_id, p.name, count(*) AS n FROM sources s JOIN projects p ON p.id = project_id WHERE status = 'COMPLETED' GROUP BY 1, 2")
def _(m: Model) -> DataFrame:
    return aggregates.sources_per_project(m.sources, m.projects)


@query("topic_top8", "SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM sources) GROUP BY 1 ORDER BY n DESC, topic LIMIT 8")
def _(m: Model) -> DataFrame:
    return aggregates.topic_top(m.sources)


@query("headline_counts", "SELECT (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM entities WHERE canonical_entity_id IS NULL) AS entities, (SELECT count(*) FROM edges WHERE review_status <> 'rejected') AS edges")
def _(m: Model) -> DataFrame:
    return aggregates.headline_counts(m.projects, m.sources, m.entities, m.edges)


@query(
    "governance_list",
    """SELECT e.id, e.name, e.type, p.name AS project_name, coalesce(a.n, 0) AS n_aliases, coalesce(x.n, 0) AS n_mentions FROM entities e LEFT JOIN (SELECT entity_id, count(*) AS n FROM aliases GROUP BY 1) a ON a.entity_id = e.id
    LEFT JOIN (SELECT entity_id, count(*) AS n FROM mentions GROUP BY 1) x ON x.entity_id = e.id LEFT JOIN projects p ON p.id = e.project_id WHERE canonical_entity_id IS NULL""",
)
def _(m: Model) -> DataFrame:
    return aggregates.governance_list(m.entities, m.aliases, m.mentions, m.projects)


@query(
    "entity_detail",
    """SELECT e.id, e.name, c.name AS canonical_name, coalesce(a.n, 0) AS n_aliases, coalesce(x.n, 0) AS n_mentions, coalesce(d.n, 0) AS n_edges, coalesce(a.preview, '') AS preview FROM entities e
    LEFT JOIN (SELECT entity_id, count(*) AS n, string_agg(alias, ', ' ORDER BY alias) FILTER (r <= 3) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY alias) AS r FROM aliases) GROUP BY 1) a ON a.entity_id = e.id
    LEFT JOIN (SELECT entity_id, count(*) AS n FROM mentions GROUP BY 1) x ON x.entity_id = e.id LEFT JOIN (SELECT entity_id, count(*) AS n FROM ends GROUP BY 1) d ON d.entity_id = e.id LEFT JOIN entities c ON c.id = e.canonical_entity_id""",
    INTEL,
)
def _(m: Model) -> DataFrame:
    return aggregates.entity_detail(m.entities, m.aliases, m.mentions, m.edges)


DEALS = """
flat AS (SELECT id, stage, coalesce(deal_type, 'cash') AS deal_type, CASE WHEN deal_type = 'barter' THEN 0 ELSE coalesce(TRY_CAST(amount AS BIGINT), 0) END AS amount, CASE WHEN deal_type = 'barter' THEN 0 ELSE coalesce(TRY_CAST(amount_paid AS BIGINT), 0) END AS paid FROM deals),
deal_rows AS (SELECT *, greatest(amount - paid, 0) AS outstanding FROM flat)"""


@query("deals_flat", "SELECT id, stage, deal_type, amount, paid, outstanding FROM deal_rows", DEALS)
def _(m: Model) -> DataFrame:
    return aggregates.flatten_deals(m.deals)


@query(
    "deal_kpis",
    """SELECT *, least(100.0, round(100.0 * won_amount / 20000000.0, 4)) :: DOUBLE AS progress FROM (SELECT CAST(coalesce(sum(amount) FILTER (stage = 'closed_won'), 0) AS BIGINT) AS won_amount,
    CAST(coalesce(sum(amount) FILTER (stage NOT IN ('closed_won', 'closed_lost')), 0) AS BIGINT) AS open_amount, CAST(coalesce(sum(outstanding) FILTER (stage = 'closed_won'), 0) AS BIGINT) AS outstanding,
    count(*) FILTER (stage = 'closed_won') AS n_won, count(*) FILTER (stage = 'closed_lost') AS n_lost, count(*) FILTER (deal_type = 'barter') AS n_barter FROM deal_rows)""",
    DEALS,
)
def _(m: Model) -> DataFrame:
    return aggregates.deal_kpis(aggregates.flatten_deals(m.deals))


@query(
    "pipeline_health",
    """SELECT place, s.stage, count(id) AS n, CAST(coalesce(sum(amount), 0) AS BIGINT) AS amount FROM (VALUES ('lead',0),('qualified',1),('proposal',2),('negotiation',3),('closed_won',4),('closed_lost',5)) s(stage, place)
    LEFT JOIN (SELECT * FROM deal_rows WHERE stage <> 'proposal') d USING (stage) GROUP BY 1, 2""",
    DEALS,
)
def _(m: Model) -> DataFrame:
    return aggregates.pipeline_health(aggregates.flatten_deals(m.deals).where("stage <> 'proposal'"))


ROLLUP = """SELECT r.root_id, e.name, e.type, r.members, coalesce(a.aliases, '') AS aliases, coalesce(x.n, 0) AS n_mentions, coalesce(s.n, 0) AS n_sources, CASE WHEN coalesce(x.n, 0) = 0 THEN 'unused' WHEN members > 1 THEN 'merged' ELSE 'clean' END AS hygiene
    FROM (SELECT root_id, count(*) AS members FROM walk GROUP BY 1) r LEFT JOIN entities e ON e.id = r.root_id
    LEFT JOIN (SELECT root_id, string_agg(DISTINCT alias, '; ' ORDER BY alias) AS aliases FROM aliases JOIN walk ON id = entity_id GROUP BY 1) a USING (root_id)
    LEFT JOIN (SELECT root_id, count(*) AS n FROM mentions JOIN walk ON id = entity_id GROUP BY 1) x USING (root_id)
    LEFT JOIN (SELECT root_id, count(DISTINCT source_id) AS n FROM (SELECT entity_id, source_id FROM mentions UNION ALL SELECT entity_id, source_id FROM ends) JOIN walk ON id = entity_id GROUP BY 1) s USING (root_id)"""


@query(
    "canonical_rollup",
    ROLLUP,
    INTEL + "," + ROOTS,
)
def _(m: Model) -> DataFrame:
    return aggregates.canonical_rollup(m.entities, m.aliases, m.mentions, m.edges, roots(m))


@query("entity_registry", f"SELECT root_id, name, n_mentions, row_number() OVER (ORDER BY n_mentions DESC, name, root_id) AS place FROM ({ROLLUP})", INTEL + "," + ROOTS)
def _(m: Model) -> DataFrame:
    rollup = aggregates.canonical_rollup(m.entities, m.aliases, m.mentions, m.edges, roots(m))
    return reports.entity_registry(rollup).select("root_id", "name", "n_mentions", "place")


@query("distinct_titles", "SELECT DISTINCT trim(title) AS title FROM positions WHERE trim(title) <> '' ORDER BY 1 LIMIT 200")
def _(m: Model) -> DataFrame:
    return aggregates.distinct_titles(m.positions)


@query("co_occurrence", "SELECT entity_id, other_id, other_name, other_type, source_id, array_to_string(link_types, ',') AS link_types FROM co", CO)
def _(m: Model) -> DataFrame:
    return co(m).withColumn("link_types", F.array_join("link_types", ","))


@query("co_occurrence_by_source", "SELECT entity_id, source_id, count(*) AS n_others, string_agg(other_id || '=' || array_to_string(link_types, '+'), ',' ORDER BY other_id || '=' || array_to_string(link_types, '+')) AS others FROM co GROUP BY 1, 2", CO)
def _(m: Model) -> DataFrame:
    return aggregates.co_occurrence_by_source(co(m))


@query(
    "co_occurrence_context",
    """SELECT entity_id, source_id, others, n_more, place FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY source_id DESC) AS place FROM (SELECT entity_id, source_id, string_agg(other_name, ', ' ORDER BY r) FILTER (r <= 2) AS others, greatest(0, count(*) - 2) AS n_more
    FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, source_id ORDER BY other_name, other_id) AS r FROM co) GROUP BY 1, 2)) WHERE place <= 12""",
    CO,
)
def _(m: Model) -> DataFrame:
    return reports.co_occurrence_context(co(m), 12, 2)


@query(
    "context_edges",
    "SELECT a, b, count(DISTINCT source_id) AS n_sources, array_to_string(list_sort(list_distinct(flatten(list(link_types)))), ',') AS link_types, coalesce(string_agg(DISTINCT title, '; ' ORDER BY title), '') AS source_titles FROM (SELECT least(entity_id, other_id) AS a, greatest(entity_id, other_id) AS b, source_id, link_types, title FROM co LEFT JOIN sources s ON s.id = source_id) GROUP BY 1, 2",
    CO,
)
def _(m: Model) -> DataFrame:
    return aggregates.context_edges(joins.titled_pairs(m.source_entities, m.sources, m.entities))


@query("source_counts", "SELECT entity_id, count(*) AS n_rows, count(DISTINCT source_id) AS n_sources FROM source_entities GROUP BY 1")
def _(m: Model) -> DataFrame:
    return aggregates.source_counts(m.source_entities)


@query(
    "explorer_list",
    """SELECT e.id, e.name, e.type, coalesce(d.n, 0) AS connections, coalesce(x.n, 0) AS mentions FROM entities e LEFT JOIN (SELECT entity_id, count(*) AS n FROM ends WHERE review_status <> 'rejected' GROUP BY 1) d ON d.entity_id = e.id
    LEFT JOIN (SELECT entity_id, count(*) AS n FROM mentions GROUP BY 1) x ON x.entity_id = e.id WHERE canonical_entity_id IS NULL""",
    INTEL,
)
def _(m: Model) -> DataFrame:
    return aggregates.explorer_list(m.entities, m.edges, m.mentions)


@query("mention_counts", "SELECT project_id, entity_id, count(*) AS mentions FROM mentions m JOIN sources s ON s.id = m.source_id WHERE status = 'COMPLETED' GROUP BY 1, 2")
def _(m: Model) -> DataFrame:
    return aggregates.mention_counts(m.mentions, m.sources)


@query(
    "derived_counts",
    """SELECT s.id, coalesce(c.n, 0) AS n_chunks, coalesce(x.n, 0) AS n_mentions, coalesce(e.n, 0) AS n_edges FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.source_id = s.id
    LEFT JOIN (SELECT source_id, count(*) AS n FROM mentions GROUP BY 1) x ON x.source_id = s.id LEFT JOIN (SELECT source_id, count(*) AS n FROM edges GROUP BY 1) e ON e.source_id = s.id""",
)
def _(m: Model) -> DataFrame:
    return aggregates.derived_counts(m.sources, m.chunks, m.mentions, m.edges)


@query(
    "review_freshness",
    """SELECT id, reviewed_at, newest_chunk, CAST(o_orderkey % 5 AS INT) AS n_utterances FROM (SELECT o_orderkey AS id, o_orderkey, o_orderdate AS reviewed_at, newest_chunk FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS newest_chunk FROM lineitem WHERE l_linenumber < 4 GROUP BY 1) ON l_orderkey = o_orderkey)
    WHERE newest_chunk IS NULL OR newest_chunk < reviewed_at""",
)
def _(m: Model) -> DataFrame:
    many = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(i <= F.col("o_orderkey") % 5, F.lit("{}"))), ","), F.lit("]"))
    sources = m.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("reviewed_at"), many.alias("reviewed_utterances"))
    chunks = m.lines.where("l_linenumber < 4").select(F.col("l_orderkey").alias("source_id"), F.col("l_shipdate").alias("created_at"))
    return aggregates.review_freshness(sources, chunks)


AS_OF = """
bounds AS (SELECT *, CASE WHEN valid_from_precision <> 'unknown' THEN valid_from_date END AS lo, CASE WHEN NOT (valid_to_precision = 'unknown' AND state = 'active') THEN valid_to_date END AS hi FROM positions),
days AS (SELECT 'C' || c_custkey AS person_id, DATE '1996-01-01' + CAST(c_custkey % 700 AS INT) AS as_of, c_custkey AS request_id FROM customer)"""


def days(m: Model) -> DataFrame:
    return m.table("customer").select(
        F.concat(F.lit("C"), F.col("c_custkey")).alias("person_id"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int")).alias("as_of"), F.col("c_custkey").alias("request_id")
    )


@query("position_asof", "SELECT request_id, person_id, CAST(as_of AS VARCHAR) AS as_of, id, state, title FROM bounds JOIN days USING (person_id) WHERE (lo IS NULL OR lo <= as_of) AND (hi IS NULL OR as_of <= hi)", AS_OF)
def _(m: Model) -> DataFrame:
    return joins.positions_as_of(m.positions, days(m)).select("request_id", "person_id", F.col("as_of").cast("string").alias("as_of"), "id", "state", "title")


@query("position_current", "SELECT person_id, id, org_id, title, is_main FROM positions WHERE state = 'active' QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY is_main DESC, validated_at DESC, id DESC) = 1")
def _(m: Model) -> DataFrame:
    return ranking.positions_current(m.positions).select("person_id", "id", "org_id", "title", "is_main")


@query("position_timeline", "SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY valid_from_date NULLS LAST, id) AS place, id, org_id, title, state, CAST(valid_from_date AS VARCHAR) AS valid_from_date FROM positions")
def _(m: Model) -> DataFrame:
    return ranking.positions_timeline(m.positions).withColumn("valid_from_date", F.col("valid_from_date").cast("string"))


@query("position_org", "SELECT org_id, person_id, title, is_main, validated_at, id FROM positions WHERE state = 'active'")
def _(m: Model) -> DataFrame:
    return ranking.positions_org(m.positions)


FRESH = "CASE WHEN (year({b}) - year({a})) * 12 + month({b}) - month({a}) < 6 THEN 'fresh' WHEN (year({b}) - year({a})) * 12 + month({b}) - month({a}) < 12 THEN 'stale' ELSE 'old' END"


@query("freshness", f"SELECT id, {FRESH.format(a='validated_at', b='DATE ' + chr(39) + '1998-08-01' + chr(39))} AS freshness, valid_from_precision <> 'exact' OR valid_to_precision <> 'exact' AS degraded FROM positions")
def _(m: Model) -> DataFrame:
    return m.positions.select("id", tx.freshness(F.col("validated_at"), F.lit("1998-08-01").cast("date")).alias("freshness"), tx.degraded(F.col("valid_from_precision"), F.col("valid_to_precision")).alias("degraded"))


@query(
    "positions_for_questions",
    f"""SELECT request_id, intent, person_id, id, org_id, title, state, {FRESH.format(a="validated_at", b="as_of")} AS freshness, valid_from_precision <> 'exact' OR valid_to_precision <> 'exact' AS degraded FROM (
      SELECT q.*, b.* EXCLUDE (person_id) FROM bounds b JOIN (SELECT *, ['current','point_in_time','timeline'][request_id % 3 + 1] AS intent FROM days) q USING (person_id) WHERE intent = 'timeline' OR (intent = 'point_in_time' AND (lo IS NULL OR lo <= as_of) AND (hi IS NULL OR as_of <= hi))
        OR (intent = 'current' AND b.id IN (SELECT id FROM positions WHERE state = 'active' QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY is_main DESC, validated_at DESC, id DESC) = 1)))""",
    AS_OF,
)
def _(m: Model) -> DataFrame:
    intent = F.element_at(F.array(*[F.lit(v) for v in ("current", "point_in_time", "timeline")]), (F.col("request_id") % 3 + 1).cast("int"))
    return reports.positions_for_questions(m.positions, days(m).withColumn("intent", intent))


@query("union_positions", "SELECT DISTINCT id, person_id, org_id FROM positions WHERE person_id IN ('C1','C2','C3') OR org_id IN ('N3','N4')")
def _(m: Model) -> DataFrame:
    from terracite.operators.search import union_positions

    rows = m.positions.select("id", "person_id", "org_id")
    return union_positions(rows.where("person_id in ('C1','C2','C3')"), rows.where("org_id in ('N3','N4')"))


@query("status_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, status, count(*) AS n FROM status_events GROUP BY ALL")
def _(m: Model) -> DataFrame:
    from terracite.streaming.live import windowed_counts

    return windowed_counts(m.status_events, "1 day")


@query("completion_claims", "SELECT source_id, min(ts) AS ts FROM status_events WHERE status = 'COMPLETED' GROUP BY 1")
def _(m: Model) -> DataFrame:
    from terracite.streaming.live import claim_completions

    return claim_completions(m.status_events)


@query(
    "enriched_events",
    "SELECT event_id, v.source_id, v.status, project_id, p.name AS project, p.region FROM status_events v JOIN sources s ON s.id = v.source_id JOIN projects p ON p.id = project_id",
)
def _(m: Model) -> DataFrame:
    from terracite.streaming.live import enrich_stream

    return enrich_stream(m.status_events, m.sources, m.projects).select("event_id", "source_id", "status", "project_id", "project", "region")


@query(
    "turn_log",
    """SELECT conversation_id, role, client_id, ts, text, row_number() OVER (PARTITION BY conversation_id ORDER BY asked, client_id, place) AS sequence FROM (
  SELECT conversation_id, 'user' AS role, client_id, ts, text, ts AS asked, 0 AS place FROM asked_
  UNION ALL SELECT u.conversation_id, 'assistant', u.client_id, a.ts, a.text, u.ts, 1 FROM asked_ u JOIN told a USING (conversation_id, client_id) WHERE a.ts BETWEEN u.ts AND u.ts + INTERVAL 30 MINUTE)""".replace("WITH_TURNS\n", ""),
    """said AS (SELECT conv_id AS conversation_id, turn, role, text, TIMESTAMP '2024-01-01' + to_seconds(CAST(turn * turn * 300 AS BIGINT)) AS ts FROM conversations),
asked_ AS (SELECT conversation_id, conversation_id || '-' || turn AS client_id, ts, text FROM said WHERE role = 'user'),
told AS (SELECT conversation_id, conversation_id || '-' || (turn - 1) AS client_id, ts, text FROM said WHERE role = 'assistant')""",
)
def _(m: Model) -> DataFrame:
    from terracite.streaming.turns import as_turns, paired

    at = F.to_timestamp_ntz(F.lit("2024-01-01")) + F.make_dt_interval(secs=F.col("turn") * F.col("turn") * 300)
    said = m.table("conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "role", "text", at.alias("ts"))
    of = lambda role, turn: said.where(F.col("role") == role).select("conversation_id", F.concat_ws("-", "conversation_id", turn).alias("client_id"), "ts", "text")
    users, answers = of("user", F.col("turn")), of("assistant", F.col("turn") - 1)
    # Every fourth message comes twice; an answer is late where turns are far apart.
    again = lambda df: df.unionByName(df.where(F.crc32("client_id") % 4 == 0))
    return as_turns(paired(again(users), again(answers)))
