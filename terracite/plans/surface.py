"""Queries that are written in SQL, over the functions of ``sources.functions``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terracite.plans.catalogue import query
from terracite.plans.lookups import COLUMNS, INTEL
from terracite.sources.functions import register
from terracite.sources.model import Model


@query("sql_source_project", "SELECT l.source_id, s.project_id AS project FROM (SELECT DISTINCT l_orderkey + l_linenumber AS source_id FROM lineitem) l LEFT JOIN sources s ON s.id = l.source_id")
def _(m: Model) -> DataFrame:
    spark = register(m)
    m.lines.selectExpr("l_orderkey + l_linenumber AS source_id").distinct().createOrReplaceTempView("asked_sources")
    return spark.sql("SELECT source_id, source_project(source_id) AS project FROM asked_sources")


@query(
    "sql_has_role",
    """SELECT u.user_id, p.id AS project_id, coalesce(m.role IS NOT NULL, false) AS views, coalesce(m.role IN ('owner', 'editor'), false) AS edits, coalesce(m.role = 'owner', false) AS owns
FROM (SELECT DISTINCT user_id FROM members) u CROSS JOIN projects p LEFT JOIN members m ON m.user_id = u.user_id AND m.project_id = p.id""",
)
def _(m: Model) -> DataFrame:
    spark = register(m)
    m.projects.createOrReplaceTempView("asked_projects")
    return spark.sql(
        """SELECT user_id, project_id, has_role(user_id, project_id) AS views, has_role(user_id, project_id, 'editor') AS edits, has_role(user_id, project_id, 'owner') AS owns
        FROM (SELECT DISTINCT user_id FROM model_members) CROSS JOIN (SELECT id AS project_id FROM asked_projects)"""
    )


@query("sql_entity_intel", f"SELECT {COLUMNS} FROM intel WHERE entity_id IN ('P10', 'S3', 'P11')", INTEL)
def _(m: Model) -> DataFrame:
    spark = register(m)
    return spark.sql(f"SELECT {COLUMNS} FROM entity_intel('P10') UNION ALL SELECT {COLUMNS} FROM entity_intel('S3') UNION ALL SELECT {COLUMNS} FROM entity_intel(entity => 'P11')")


@query("sql_position_titles", "SELECT DISTINCT trim(title) AS title FROM positions WHERE trim(title) <> '' ORDER BY 1 LIMIT 3")
def _(m: Model) -> DataFrame:
    return register(m).sql("SELECT title FROM list_distinct_position_titles(3)")


@query(
    "sql_hybrid_search",
    """SELECT row_number() OVER (ORDER BY similarity DESC, id) AS rank, id, similarity FROM (
  SELECT v.id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS similarity
  FROM vectors v, (SELECT embedding FROM vectors WHERE id = 7) q WHERE v.topics IS NULL OR list_has_any(v.topics, ['1', '2'])) WHERE similarity > 0.1 QUALIFY rank <= 5""",
)
def _(m: Model) -> DataFrame:
    question = [float(x) for x in m.vectors.where("id = 7").first()["embedding"]]  # one vector, given as a literal as a client would
    said = ", ".join(f"{x!r}D" for x in question)
    return register(m).sql(f"SELECT rank, id, similarity FROM hybrid_search(array({said}), threshold => 0.1D, most => 5, asked => array('1', '2'))")
