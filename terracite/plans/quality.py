"""Queries: the audit suite."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracite import vocab
from terracite.operators import audit
from terracite.operators.joins import inherit
from terracite.plans.catalogue import query
from terracite.sources.model import Model

AS_OF = "1998-01-01 00:00:00"
ANCHORS = """
anchors AS (SELECT id AS source_id, interviewee_entity_id AS entity_id, 'interviewee' AS link_type FROM sources WHERE interviewee_entity_id IS NOT NULL UNION ALL SELECT id, interviewee_org_entity_id, 'interviewee_org' FROM sources WHERE interviewee_org_entity_id IS NOT NULL)"""
SQL = {
    "01": "SELECT source_id, entity_id FROM anchors a WHERE link_type = 'interviewee' AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.source_id = a.source_id AND m.entity_id = a.entity_id)",
    "02": "SELECT source_id, entity_id FROM anchors a WHERE link_type = 'interviewee_org' AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.source_id = a.source_id AND m.entity_id = a.entity_id)",
    "03": "SELECT id, name, type FROM entities WHERE canonical_entity_id IS NULL AND id NOT IN (SELECT entity_id FROM mentions)",
    "04": "SELECT source_id, entity_id, title FROM mentions m JOIN sources s ON s.id = m.source_id WHERE chunk_id IS NULL",
    "05": "SELECT x.id FROM edges x LEFT JOIN entities s ON s.id = source_entity_id LEFT JOIN entities t ON t.id = target_entity_id WHERE s.id IS NULL OR t.id IS NULL",
    "06": "SELECT id, relation_type FROM edges WHERE evidence_text IS NULL OR trim(evidence_text) = ''",
    "07": "SELECT id FROM vectors WHERE embedding IS NULL",
    "08": "SELECT id, status, created_at FROM sources WHERE status = 'EMBEDDING' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 1 HOUR",
    "09": "SELECT id, (SELECT count(*) FROM chunks c WHERE c.source_id = s.id) AS n_chunks, (SELECT count(*) FROM mentions c WHERE c.source_id = s.id) AS n_mentions, (SELECT count(*) FROM edges c WHERE c.source_id = s.id) AS n_edges FROM sources s WHERE status = 'COMPLETED'",
    "10": "SELECT normalized_name, type, project_id, count(*) AS n, string_agg(id, ',' ORDER BY created_at, id) AS ids FROM entities WHERE canonical_entity_id IS NULL GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "11": "SELECT entity_id, alias, canonical_entity_id FROM aliases JOIN entities e ON e.id = entity_id WHERE canonical_entity_id IS NOT NULL",
    "12": "SELECT normalized_name, type, count(DISTINCT coalesce(CAST(project_id AS VARCHAR), 'GLOBAL')) AS n_scopes, string_agg(DISTINCT coalesce(CAST(project_id AS VARCHAR), 'GLOBAL'), ',' ORDER BY coalesce(CAST(project_id AS VARCHAR), 'GLOBAL')) AS scopes FROM entities WHERE canonical_entity_id IS NULL GROUP BY 1, 2 HAVING n_scopes > 1",
    "13": "SELECT id FROM sources s WHERE status = 'COMPLETED' AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.source_id = s.id)",
    "14": "SELECT id AS start_id, id AS path, 0 AS depth FROM entities WHERE canonical_entity_id = id",
    "15": "SELECT s.id, interviewee_entity_id, e.type FROM sources s JOIN entities e ON e.id = interviewee_entity_id WHERE e.type <> 'PERSON'",
    "16": "SELECT p.id FROM positions p LEFT JOIN entities a ON a.id = person_id LEFT JOIN entities b ON b.id = org_id WHERE a.id IS NULL OR b.id IS NULL",
    "17": "SELECT origin, link_type, count(*) AS n FROM source_entities GROUP BY 1, 2",
    "18": "SELECT source_id, entity_id, link_type FROM anchors a WHERE NOT EXISTS (SELECT 1 FROM source_entities x WHERE x.source_id = a.source_id AND x.entity_id = a.entity_id AND x.link_type = a.link_type AND origin = 'upload_anchor')",
}


class Damaged(Model):
    """The data model with faults of the kinds that its tables do not have: entities that are gone, companies known both
    in a project and globally, canonical chains that close, and vectors that are missing."""

    @cached_property
    def entities(self) -> DataFrame:
        e, k = super().entities, F.substring("id", 2, 20).cast("long")
        part, company = F.col("type") == "PRODUCT", F.col("type") == "COMPANY"
        ring = F.when(part & (k % 20 == 0), F.concat(F.lit("P"), k + 3)).otherwise(F.col("canonical_entity_id"))
        again = e.where(company & (k % 20 == 1)).withColumns({"id": F.concat(F.lit("D"), k), "project_id": F.lit(None).cast("long")})
        return e.where(~((part | company) & (k % 20 == 7))).withColumn("canonical_entity_id", ring).unionByName(again)

    @cached_property
    def vectors(self) -> DataFrame:
        return super().vectors.withColumn("embedding", F.when(F.col("id") % 11 != 3, F.col("embedding")))


DAMAGED = """
gone AS (SELECT id FROM entities WHERE type IN ('PRODUCT', 'COMPANY') AND CAST(id[2:] AS BIGINT) % 20 = 7),
rings AS (SELECT 'P' || p_partkey AS id, CASE WHEN p_partkey % 20 = 3 THEN 'P' || (p_partkey - 1) WHEN p_partkey % 20 = 0 THEN 'P' || (p_partkey + 3) ELSE 'P' || (p_partkey - 1) END AS next
  FROM part WHERE p_partkey % 20 < 4 AND p_partkey // 20 * 20 + 3 <= (SELECT max(p_partkey) FROM part) AND p_partkey // 20 * 20 >= (SELECT min(p_partkey) FROM part))"""
#: The checks that find nothing in the tables as they are, on the damaged ones.
BROKEN = {
    "05": "SELECT id FROM edges WHERE source_entity_id IN (FROM gone) OR target_entity_id IN (FROM gone)",
    "07": "SELECT id FROM vectors WHERE id % 11 = 3",
    "12": "SELECT normalized_name, type, 2 AS n_scopes, project_id || ',GLOBAL' AS scopes FROM entities WHERE type = 'COMPANY' AND CAST(id[2:] AS BIGINT) % 20 = 1",
    "14": "SELECT a.id AS start_id, concat_ws('>', a.id, b.id, c.id, d.id, a.id) AS path, 4 AS depth FROM rings a JOIN rings b ON b.id = a.next JOIN rings c ON c.id = b.next JOIN rings d ON d.id = c.next",
    "16": "SELECT id FROM positions WHERE person_id IN (FROM gone)",
}
for _name, _check in audit.checks(AS_OF).items():
    if _name in BROKEN:
        query(f"audit_{_name}", BROKEN[_name], DAMAGED)(lambda m, check=_check: check(Damaged(m.spark, m.sf_dir)))
    else:
        query(f"audit_{_name}", SQL[_name], ANCHORS)(_check)

query("audit_summary", "\nUNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM ({s})) AS n_rows" for n, s in SQL.items()), ANCHORS)(lambda m: audit.audit_summary(m, AS_OF))


#: The column that a check's sample is of.
FIRST = {n: "source_id" if n in ("01", "02", "04", "18") else "normalized_name" if n in ("10", "12") else "entity_id" if n == "11" else "start_id" if n == "14" else "origin" if n == "17" else "id" for n in SQL}

query(
    "audit_report",
    "\nUNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows, coalesce(array_to_string(list_sort(list(CAST({FIRST[n]} AS VARCHAR)))[:5], ','), '') AS sample, NULL AS error FROM ({s})" for n, s in SQL.items()),
    ANCHORS,
)(lambda m: audit.audit_report(m, AS_OF).withColumn("sample", F.array_join("sample", ",")))


@query("vocab_violations", f"SELECT relation_type, count(*) AS n FROM edges WHERE relation_type NOT IN ({', '.join(repr(v) for v in vocab.RELATION_TYPES)}) GROUP BY 1")
def _(m: Model) -> DataFrame:
    return audit.vocab_violations(m.edges, "relation_type", vocab.RELATION_TYPES)


@query("unique_key_violations", "SELECT normalized_name, type, coalesce(CAST(project_id AS VARCHAR), 'GLOBAL') AS project_id, count(*) AS n FROM entities GROUP BY 1, 2, 3 HAVING n > 1")
def _(m: Model) -> DataFrame:
    return audit.key_violations(m.entities, ["normalized_name", "type"], "project_id")


@query(
    "tenant_mismatch",
    "SELECT x.id FROM edges x JOIN sources s ON s.id = x.source_id JOIN projects p ON p.id = s.project_id JOIN entities e ON e.id = source_entity_id JOIN projects q ON q.id = e.project_id WHERE p.tenant_id <> q.tenant_id",
)
def _(m: Model) -> DataFrame:
    tenant = m.projects.select(F.col("id").alias("project_id"), "tenant_id")
    edges = m.edges.join(m.sources.select(F.col("id").alias("source_id"), "project_id"), "source_id").join(tenant, "project_id")
    return audit.tenant_mismatch(edges, m.entities.join(tenant, "project_id", "left"), ["source_entity_id", "target_entity_id"]).select("id")


@query("check_violations", "SELECT id, unnest(list_concat(CASE WHEN is_main AND state <> 'active' THEN ['main is active'] ELSE [] END, CASE WHEN valid_to_date < valid_from_date THEN ['ends after start'] ELSE [] END)) AS rule FROM positions")
def _(m: Model) -> DataFrame:
    return audit.check_violations(m.positions, {"main is active": ~F.col("is_main") | (F.col("state") == "active"), "ends after start": F.col("valid_to_date") >= F.col("valid_from_date")})


@query("inherit_tenant", "SELECT s.id, tenant_id FROM sources s LEFT JOIN projects p ON p.id = s.project_id")
def _(m: Model) -> DataFrame:
    parent = m.projects.select(F.col("id").alias("project_id"), "tenant_id", F.lit(0).alias("created_at"))
    return inherit(m.sources.select("id", "project_id"), parent, "project_id", "tenant_id").select("id", "tenant_id")
