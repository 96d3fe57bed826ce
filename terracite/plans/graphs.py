"""Queries: graphs and canonical chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracite.operators import graph
from terracite.plans.boards import CO, ROOTS
from terracite.plans.catalogue import query
from terracite.plans.lookups import INTEL
from terracite.sources.model import Model

NODES = """
nodes AS (SELECT s.project_id, entity_id, e.name, e.type, count(*) AS mentions FROM mentions m JOIN sources s ON s.id = m.source_id JOIN entities e ON e.id = entity_id WHERE status = 'COMPLETED' GROUP BY ALL),
project_edges AS (SELECT s.project_id, x.id, source_entity_id, target_entity_id, relation_type, confidence FROM edges x JOIN sources s ON s.id = x.source_id WHERE review_status <> 'rejected')"""


def nodes(m: Model) -> DataFrame:
    return graph.project_nodes(m.mentions, m.entities, m.sources)


@query("project_graph_nodes", "SELECT * FROM nodes", NODES)
def _(m: Model) -> DataFrame:
    return nodes(m)


@query(
    "project_graph_edges",
    """SELECT p.* FROM project_edges p WHERE EXISTS (SELECT 1 FROM known n WHERE n.project_id = p.project_id AND n.entity_id = source_entity_id) AND EXISTS (SELECT 1 FROM known n WHERE n.project_id = p.project_id AND n.entity_id = target_entity_id)""",
    NODES + ", known AS (SELECT project_id, entity_id FROM nodes UNION SELECT project_id, entity_id FROM source_entities x JOIN sources s ON s.id = x.source_id)",
)
def _(m: Model) -> DataFrame:
    s = m.sources.select(F.col("id").alias("source_id"), "project_id")
    known = nodes(m).select("project_id", "entity_id").union(m.source_entities.join(s, "source_id").select("project_id", "entity_id")).distinct()
    return graph.project_edges(known, m.edges.drop("id"), m.sources)


@query(
    "ego_neighbours",
    """SELECT entity_id, neighbour_id, CAST(sum(e) AS BIGINT) AS n_edges, CAST(sum(c) AS BIGINT) AS n_shared FROM (SELECT entity_id, other_id AS neighbour_id, 1 AS e, 0 AS c FROM ends WHERE review_status <> 'rejected' UNION ALL SELECT entity_id, other_id, 0, 1 FROM co)
    WHERE entity_id <> neighbour_id AND entity_id IN (SELECT id FROM entities WHERE canonical_entity_id IS NULL) GROUP BY 1, 2""",
    INTEL + "," + CO,
)
def _(m: Model) -> DataFrame:
    return graph.ego_neighbours(m.edges, m.source_entities, m.entities)


@query(
    "degree_isolated_hubs",
    """SELECT n.entity_id, n.mentions, coalesce(d, 0) AS degree, coalesce(d, 0) = 0 AS isolated, row_number() OVER (ORDER BY n.mentions DESC, n.entity_id) <= 4 AS hub FROM (SELECT entity_id, count(*) AS mentions FROM mentions GROUP BY 1) n
    LEFT JOIN (SELECT entity_id, count(*) AS d FROM (SELECT unnest([source_entity_id, target_entity_id]) AS entity_id FROM edges WHERE confidence > 0.9) GROUP BY 1) x USING (entity_id)""",
)
def _(m: Model) -> DataFrame:
    return graph.degree(m.mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions")), m.edges.where("confidence > 0.9"))


@query("canonical_roots", "SELECT id, root_id, depth, false AS cyclic FROM walk", ROOTS)
def _(m: Model) -> DataFrame:
    return graph.canonical_roots(m.entities)


@query(
    "canonical_cycles",
    """SELECT CAST(id AS VARCHAR) AS start_id, CASE id % 3 WHEN 1 THEN id || '>' || (id + 1) || '>' || (id + 2) || '>' || id WHEN 2 THEN id || '>' || (id + 1) || '>' || (id - 1) || '>' || id ELSE id || '>' || (id - 2) || '>' || (id - 1) || '>' || id END AS path, 3 AS depth
    FROM (SELECT p_partkey AS id FROM part WHERE p_partkey > 0 AND p_partkey <= (SELECT max(p_partkey) // 3 * 3 FROM part))""",
)
def _(m: Model) -> DataFrame:
    k = F.col("p_partkey")
    last = m.table("part").agg(F.expr("max(p_partkey) div 3 * 3").alias("last"))
    rings = m.table("part").crossJoin(F.broadcast(last)).where("p_partkey > 0 and p_partkey <= last")  # one row
    to = F.when(k % 3 == 0, k - 2).otherwise(k + 1)
    return graph.canonical_cycles(rings.select(k.cast("string").alias("id"), to.cast("string").alias("canonical_entity_id")))


@query(
    "expand_hops",
    """SELECT entity_id, min(hops) AS hops FROM (SELECT 'P10' AS entity_id, 0 AS hops UNION ALL SELECT b, 1 FROM step WHERE a = 'P10' UNION ALL SELECT y.b, 2 FROM step x JOIN step y ON y.a = x.b WHERE x.a = 'P10') GROUP BY 1""",
    "step AS (SELECT DISTINCT a, b FROM (SELECT source_entity_id AS a, target_entity_id AS b FROM edges WHERE review_status <> 'rejected' UNION ALL SELECT target_entity_id, source_entity_id FROM edges WHERE review_status <> 'rejected'))",
)
def _(m: Model) -> DataFrame:
    return graph.expand_hops(m.edges, m.entities.where("id = 'P10'").select(F.col("id").alias("entity_id")), 2)


@query(
    "filter_graph_edges",
    """SELECT id, direction FROM (SELECT id, CASE WHEN source_entity_id LIKE 'S1%' AND target_entity_id LIKE 'P1%' THEN 'bidirectional' WHEN source_entity_id LIKE 'S1%' THEN 'outgoing' WHEN target_entity_id LIKE 'P1%' THEN 'incoming' END AS direction FROM edges WHERE relation_type IN ('supplier', 'ally')) WHERE direction IN ('outgoing', 'bidirectional')""",
)
def _(m: Model) -> DataFrame:
    all_nodes = m.entities.select(F.col("id").alias("entity_id"), "type")
    explored = all_nodes.where("entity_id like 'S1%' or entity_id like 'P1%'")
    return graph.filter_graph(all_nodes, m.edges, ["ORGANIZATION", "PRODUCT"], ["supplier", "ally"], explored, "outgoing")[1].select("id", "direction")
