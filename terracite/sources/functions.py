"""The data model as SQL functions of a session: scalar ones and table functions, all plain SQL that plans inline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terracite.operators.search import entity_intel
from terracite.sources.model import Model

INTEL = "entity_id STRING, source_id BIGINT, source_title STRING, role STRING, kind STRING, evidence STRING, chunk_id STRING, sentiment STRING, conducted_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ"
#: What a member of a project must be at least: an owner may do what an editor may, and so on.
RANKS = "array('viewer', 'editor', 'owner')"
_LENGTH = "sqrt(aggregate({v}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
_COSINE = f"""aggregate(zip_with(v.embedding, question, (a, b) -> CAST(a AS DOUBLE) * CAST(b AS DOUBLE)), 0D, (s, x) -> s + x)
        / ({_LENGTH.format(v="v.embedding")} * {_LENGTH.format(v="question")})"""

FUNCTIONS = (
    """source_project(source BIGINT) RETURNS BIGINT COMMENT 'Project of a source; null if there is none.'
    RETURN SELECT max(project_id) FROM model_sources WHERE id = source""",
    f"""has_role(who BIGINT, project BIGINT, least STRING DEFAULT 'viewer') RETURNS BOOLEAN COMMENT 'Whether a user is a member of a project, in that role or a stronger one.'
    RETURN array_contains({RANKS}, least) AND coalesce((SELECT max(array_position({RANKS}, role)) FROM model_members m WHERE m.user_id = who AND m.project_id = project), 0) >= greatest(array_position({RANKS}, least), 1)""",
    f"""entity_intel(entity STRING, project BIGINT DEFAULT NULL) RETURNS TABLE ({INTEL}) COMMENT 'Mentions, links and active edges of an entity, in all sources or those of a project.'
    RETURN SELECT {", ".join(c.split()[0] for c in INTEL.split(", "))} FROM model_intel i WHERE i.entity_id = entity AND (project IS NULL OR i.project_id = project)""",
    f"""hybrid_search(question ARRAY<DOUBLE>, threshold DOUBLE DEFAULT 0.7, most INT DEFAULT 10, project BIGINT DEFAULT NULL, asked ARRAY<STRING> DEFAULT NULL)
    RETURNS TABLE (rank BIGINT, id BIGINT, similarity DOUBLE) COMMENT 'Nearest chunks by cosine above a threshold, of a project and of topics where they are given.'
    RETURN SELECT rank, id, similarity FROM (
      SELECT CAST(row_number() OVER (ORDER BY similarity DESC, id) AS BIGINT) AS rank, id, similarity FROM (
        SELECT v.id, round({_COSINE}, 6) AS similarity FROM model_vectors v
        WHERE v.embedding IS NOT NULL AND {_LENGTH.format(v="v.embedding")} > 0 AND {_LENGTH.format(v="question")} > 0
          AND (project IS NULL OR v.project_id = project) AND (asked IS NULL OR v.topics IS NULL OR arrays_overlap(v.topics, asked)))
      WHERE similarity > threshold) WHERE rank <= most""",
    """list_distinct_position_titles(most INT DEFAULT 200) RETURNS TABLE (title STRING) COMMENT 'Titles of positions that are not blank, in order.'
    RETURN SELECT title FROM (SELECT title, row_number() OVER (ORDER BY title) AS place FROM (SELECT DISTINCT trim(title) AS title FROM model_positions WHERE trim(title) <> '')) WHERE place <= most""",
)


def register(m: Model) -> SparkSession:
    """Registers the model's tables as temporary views ``model_…`` and FUNCTIONS as temporary functions of its session.

    A function is expanded where it is called, so filters on what it returns, and its arguments, reach the scans. Another model's call
    replaces both.
    """
    spark = m.spark
    held = entity_intel(m.mentions, m.source_entities, m.edges, m.sources, m.chunks, more=("project_id",), few=True)
    views: dict[str, DataFrame] = {"sources": m.sources, "members": m.members, "vectors": m.vectors, "positions": m.positions, "intel": held}
    for name, df in views.items():
        df.createOrReplaceTempView(f"model_{name}")
    for text in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    return spark
