"""Filters and predicates over the tables of the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracite import vocab


def canonical_only(entities: DataFrame) -> DataFrame:
    """Entities that are not redirected to another one."""
    return entities.where(F.col("canonical_entity_id").isNull())


def active_edges(edges: DataFrame) -> DataFrame:
    """Edges that no editor rejected."""
    return edges.where(F.col("review_status") != "rejected")


def search_entities(entities: DataFrame, q: str) -> DataFrame:
    """Canonical entities with ``q``, taken literally and in any case, in the name or the normalized name."""
    needle = F.lit(q.strip().lower())
    return canonical_only(entities).where(F.contains(F.lower("name"), needle) | F.contains("normalized_name", needle))


def typeahead(entities: DataFrame, queries: DataFrame, types: list[str] | None = None, each: int = 15, k: int = 20) -> DataFrame:
    """For each query (query_id, project_id, prefix): entities whose name begins with it, the project's first, then global.

    Prefixes of under two characters find nothing. At most ``each`` of either scope and ``k`` in all, by name and id.
    Entities are joined on the first two letters, so each query meets only names that could match.
    """
    from pyspark.sql import Window

    found = canonical_only(entities if types is None else entities.where(F.col("type").isin(*types)))
    left = queries.select("query_id", F.col("project_id").alias("asked"), F.lower(F.trim("prefix")).alias("p")).where(F.length("p") >= 2).withColumn("head", F.substring("p", 1, 2))
    right = found.withColumn("low", F.lower("name")).withColumn("head", F.substring("low", 1, 2))
    hits = left.join(right, "head").where(F.startswith("low", "p")).where(F.col("project_id").isNull() | (F.col("project_id") == F.col("asked")))
    hits = hits.withColumn("tier", F.when(F.col("project_id").isNull(), 2).otherwise(1))
    own = Window.partitionBy("query_id", "tier").orderBy("low", "id")
    every = Window.partitionBy("query_id").orderBy("tier", "low", "id")
    return hits.withColumn("r", F.row_number().over(own)).where(F.col("r") <= each).withColumn("place", F.row_number().over(every)).where(F.col("place") <= k).select("query_id", "place", "id", "name", "type")


def filter_optional(df: DataFrame, **wanted: list | None) -> DataFrame:
    """Rows whose columns have one of the wanted values; a column without wanted values is not filtered."""
    for name, values in wanted.items():
        if values is not None:
            df = df.where(F.col(name).isin(*values) if values else F.lit(False))
    return df


def filter_topics(chunks: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """Chunks without topics, and those with a wanted one; all without wanted topics."""
    if not topics:
        return chunks
    return chunks.where(F.col("topics").isNull() | F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics])))


def scope_to_user(df: DataFrame, members: DataFrame, user_ids: list[int], roles: list[str] | None = None) -> DataFrame:
    """Rows of projects in which one of the users is a member (in one of the roles)."""
    mine = filter_optional(members, user_id=user_ids, role=roles).select("project_id")
    return df.join(mine, "project_id", "left_semi")


def stuck_sources(sources: DataFrame, as_of: Column, after: str = "1 hour", column: str = "created_at") -> DataFrame:
    """Sources still in work whose last change is longer ago than ``after``; the clock is a parameter."""
    return sources.where(F.col("status").isin(*vocab.IN_FLIGHT) & (F.col(column) < as_of - F.expr(f"interval {after}")))


def linkable(source_entities: DataFrame, floor: float = 0.9) -> DataFrame:
    """Links that may become project links: uploaded anchors, primary extractions, and those of high confidence."""
    extracted = (F.col("origin") == "extraction") & (F.col("is_primary") | (F.coalesce("confidence", F.lit(0.0)) >= floor))
    return source_entities.where((F.col("origin") == "upload_anchor") | extracted)


def parse_relation_types(df: DataFrame, column: str, known: list[str] | None = None) -> DataFrame:
    """The array column without unknown values and repeats, in order."""
    allowed = F.array(*[F.lit(v) for v in known or vocab.RELATION_TYPES])
    return df.withColumn(column, F.array_distinct(F.filter(column, lambda v: F.array_contains(allowed, v))))


def needs_enrichment(entities: DataFrame, least: int = 150) -> DataFrame:
    """Canonical entities whose description is missing or shorter than ``least`` characters."""
    return canonical_only(entities).where(F.coalesce(F.length(F.trim("description")), F.lit(0)) < least)


def validate_anchors(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """requests: request_id, project_id, entity_id, role. Adds ok and reason: the entity must exist, be canonical, have
    a type that fits the role and be global or of the project."""
    e = entities.select(F.col("id").alias("entity_id"), "type", F.col("project_id").alias("own"), "canonical_entity_id", F.lit(True).alias("there"))
    fits = F.when(F.col("role") == "interviewee_org", F.col("type").isin(*vocab.ORG_TYPES)).otherwise(F.col("type") == "PERSON")
    reason = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("canonical_entity_id").isNotNull(), "not canonical")
        .when(~fits, "wrong type")
        .when(F.col("own").isNotNull() & ~F.col("own").eqNullSafe(F.col("project_id")), "other project")
    )
    joined = requests.join(e, "entity_id", "left").withColumn("reason", reason)
    return joined.select("request_id", "project_id", "entity_id", "role", F.col("reason").isNull().alias("ok"), "reason")


def filter_edges(edges: DataFrame, focus: str | None = None, direction: str = "all", status: str = "all") -> DataFrame:
    """Edges by review status (all, active, pending, approved, rejected) and by direction about a focus entity."""
    if status == "active":
        edges = active_edges(edges)
    elif status != "all":
        edges = edges.where(F.col("review_status") == status)
    if focus is None:
        return edges
    out, into = F.col("source_entity_id") == focus, F.col("target_entity_id") == focus
    return edges.where({"outgoing": out, "incoming": into}.get(direction, out | into))


def search_users(users: DataFrame, profiles: DataFrame, roles: DataFrame, q: str, page: int = 1, size: int = 20) -> DataFrame:
    """Users (user_id, email) with ``q`` in the e-mail or the profile's name, with their sorted roles, by pages."""
    from terracite.operators.aggregates import roles_by_user
    from terracite.operators.ranking import page as paged

    named = users.join(profiles.select("user_id", "full_name"), "user_id", "left")
    needle = F.lit(q.strip().lower())
    hits = named.where(F.contains(F.lower("email"), needle) | F.coalesce(F.contains(F.lower("full_name"), needle), F.lit(False)))
    return paged(hits.join(roles_by_user(roles), "user_id", "left"), ["email", "user_id"], page, size)


def resolve_scope(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """requests: request_id, source_id, project_id. ok unless the source is missing or of another project; the project
    defaults to the source's."""
    s = sources.select(F.col("id").alias("source_id"), F.col("project_id").alias("own"))
    joined = requests.join(s, "source_id", "left")
    ok = F.col("source_id").isNull() | (F.col("own").isNotNull() & (F.col("project_id").isNull() | (F.col("project_id") == F.col("own"))))
    return joined.select("request_id", "source_id", F.coalesce("project_id", "own").alias("project_id"), F.coalesce(ok, F.lit(False)).alias("ok"))
