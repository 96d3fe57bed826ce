"""Aggregations: counts, boards, indicators and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracite import vocab
from terracite.operators.filters import active_edges, canonical_only
from terracite.operators.joins import endpoints


def count_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def duplicate_entities(entities: DataFrame) -> DataFrame:
    """Canonical entities that share a normalized name, type and scope; ids by age."""
    rows = canonical_only(entities).groupBy("normalized_name", "type", "project_id")
    grouped = rows.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("r"))
    return grouped.where("n > 1").select("normalized_name", "type", "project_id", "n", F.array_join(F.transform("r", lambda x: x["id"]), ",").alias("ids"))


def scope_collisions(entities: DataFrame) -> DataFrame:
    """Names of canonical entities that stand in more than one scope, where global (null) is a scope too."""
    scope = F.coalesce(F.col("project_id").cast("string"), F.lit("GLOBAL"))
    grouped = canonical_only(entities).groupBy("normalized_name", "type").agg(F.array_sort(F.collect_set(scope)).alias("s"))
    return grouped.where(F.size("s") > 1).select("normalized_name", "type", F.size("s").cast("long").alias("n_scopes"), F.array_join("s", ",").alias("scopes"))


def review_freshness(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Reviewed sources (reviewed_at, reviewed_utterances as JSON) whose newest chunk is older than the review."""
    newest = chunks.groupBy("source_id").agg(F.max("created_at").alias("newest_chunk"))
    joined = sources.join(newest, sources["id"] == newest["source_id"], "left")
    stale = F.col("reviewed_at").isNotNull() & (F.col("newest_chunk").isNull() | (F.col("newest_chunk") < F.col("reviewed_at")))
    return joined.where(stale).select("id", "reviewed_at", "newest_chunk", F.json_array_length("reviewed_utterances").alias("n_utterances"))


def derived_counts(sources: DataFrame, chunks: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks, mentions and edges of every source; each table is counted before the join, so none multiplies another."""
    out = sources.select("id")
    for name, df in (("n_chunks", chunks), ("n_mentions", mentions), ("n_edges", edges)):
        out = out.join(df.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias(name)), "id", "left")
    return out.na.fill(0)


def mention_counts(mentions: DataFrame, sources: DataFrame, status: str | None = "COMPLETED") -> DataFrame:
    """Mentions of each entity in each project, over sources of a status."""
    s = sources if status is None else sources.where(F.col("status") == status)
    return mentions.join(s.select(F.col("id").alias("source_id"), "project_id"), "source_id").groupBy("project_id", "entity_id").agg(F.count(F.lit(1)).alias("mentions"))


def status_board(sources: DataFrame, by: str = "project_id") -> DataFrame:
    n = lambda c: F.count_if(c)
    return sources.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), n(F.col("status") == "COMPLETED").alias("completed"), n(F.col("status") == "FAILED").alias("failed"),
        n(F.col("status").isin(*vocab.IN_FLIGHT)).alias("processing"),
    )


def sources_per_project(sources: DataFrame, projects: DataFrame) -> DataFrame:
    """Completed sources of each project that has some."""
    n = sources.where("status = 'COMPLETED'").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(projects.select(F.col("id").alias("project_id"), "name"), "project_id").select("project_id", "name", "n")


def topic_top(sources: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent topics; ties by name."""
    n = sources.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "topic").limit(k)


def headline_counts(projects: DataFrame, sources: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(projects, "projects").crossJoin(one(sources, "sources")).crossJoin(one(canonical_only(entities), "entities")).crossJoin(one(active_edges(edges), "edges"))


def governance_list(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, projects: DataFrame) -> DataFrame:
    """Canonical entities with their alias and mention counts and project name."""
    a = aliases.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n_aliases"))
    m = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n_mentions"))
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    joined = canonical_only(entities).join(a, "id", "left").join(m, "id", "left").join(p, "project_id", "left")
    return joined.select("id", "name", "type", "project_name", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"), F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"))


def entity_detail(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, edges: DataFrame, preview: int = 3) -> DataFrame:
    """Every entity with its canonical target's name, its counts and its first aliases by name."""
    rank = Window.partitionBy("entity_id").orderBy("alias")
    a = aliases.withColumn("r", F.row_number().over(rank)).groupBy(F.col("entity_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_aliases"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= preview, F.col("alias")))), ", ").alias("preview")
    )
    m = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n_mentions"))
    d = endpoints(edges).groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"))
    target = entities.select(F.col("id").alias("canonical_entity_id"), F.col("name").alias("canonical_name"))
    joined = entities.select("id", "name", "canonical_entity_id").join(a, "id", "left").join(m, "id", "left").join(d, "id", "left").join(target, "canonical_entity_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("id", "name", "canonical_name", zero("n_aliases"), zero("n_mentions"), zero("n_edges"), F.coalesce("preview", F.lit("")).alias("preview"))


def flatten_deals(raw: DataFrame) -> DataFrame:
    """Deals with numbers for their textual amounts (cents); a barter has no amount. Outstanding is never negative."""
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0))
    barter = F.col("deal_type") == "barter"
    amount = F.when(barter, 0).otherwise(number("amount"))
    paid = F.when(barter, 0).otherwise(number("amount_paid"))
    kind = F.coalesce("deal_type", F.lit("cash"))
    return raw.select("id", "stage", kind.alias("deal_type"), amount.alias("amount"), paid.alias("paid"), F.greatest(amount - paid, F.lit(0)).alias("outstanding"))


def deal_kpis(deals: DataFrame, target: int = 20_000_000) -> DataFrame:
    """Indicators over flattened deals; progress towards the target is capped at 100."""
    won, lost = F.col("stage") == "closed_won", F.col("stage") == "closed_lost"
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    sums = deals.agg(
        total(won, "amount").alias("won_amount"), total(~won & ~lost, "amount").alias("open_amount"), total(won, "outstanding").alias("outstanding"),
        F.count_if(won).alias("n_won"), F.count_if(lost).alias("n_lost"), F.count_if(F.col("deal_type") == "barter").alias("n_barter"),
    )
    progress = F.least(F.lit(100.0), F.round(100.0 * F.col("won_amount") / target, 4)) if target > 0 else F.lit(0.0)
    return sums.withColumn("progress", progress)


def pipeline_health(deals: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """Count and amount of every stage, in order, also of empty ones."""
    order = vocab.words(deals.sparkSession, stages or vocab.STAGES, "stage")
    n = deals.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return order.join(n, "stage", "left").select("place", "stage", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount", F.lit(0)).alias("amount"))


def canonical_rollup(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """One row for each canonical entity with members: their number, all aliases, mentions, and the distinct sources of
    mentions and of edges at either end. roots: id, root_id (see graph.canonical_roots)."""
    of = roots.select(F.col("id").alias("entity_id"), "root_id")
    members = of.groupBy("root_id").agg(F.count(F.lit(1)).alias("members"))
    names = aliases.select("entity_id", "alias").join(of, "entity_id").groupBy("root_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), "; ").alias("aliases"))
    seen = mentions.join(of, "entity_id")
    counted = seen.groupBy("root_id").agg(F.count(F.lit(1)).alias("n_mentions"))
    ends = endpoints(edges).select("entity_id", "source_id").join(of, "entity_id").select("root_id", "source_id")
    sources = seen.select("root_id", "source_id").unionByName(ends).groupBy("root_id").agg(F.countDistinct("source_id").alias("n_sources"))
    out = members.join(entities.select(F.col("id").alias("root_id"), "name", "type"), "root_id", "left")
    out = out.join(names, "root_id", "left").join(counted, "root_id", "left").join(sources, "root_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    hygiene = F.when(F.coalesce("n_mentions", F.lit(0)) == 0, "unused").when(F.col("members") > 1, "merged").otherwise("clean")
    return out.select("root_id", "name", "type", "members", F.coalesce("aliases", F.lit("")).alias("aliases"), zero("n_mentions"), zero("n_sources"), hygiene.alias("hygiene"))


def best_candidate(scored: DataFrame) -> DataFrame:
    """scored: mention_id, entity_id, score. The best entity of each mention by its best score, then the smallest id."""
    top = scored.groupBy("mention_id", "entity_id").agg(F.max("score").alias("score"))
    best = top.groupBy("mention_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("entity_id").alias("e"))).alias("b"))
    return best.select("mention_id", F.col("b.e").alias("entity_id"), (-F.col("b.s")).alias("score"))


def dedupe_resolved(resolved: DataFrame) -> DataFrame:
    """resolved: source_id, entity_id, place, raw_name, description. The first row of each entity in a source; an empty
    description is filled in from the first later row that has one."""
    rows = resolved.groupBy("source_id", "entity_id").agg(
        F.min(F.struct("place", "raw_name")).alias("first"),
        F.min(F.when(F.length(F.trim("description")) > 0, F.struct("place", "description"))).alias("told"),
    )
    return rows.select("source_id", "entity_id", "first.place", "first.raw_name", F.col("told.description").alias("description"))


def gate_stats(gated: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows of each source by outcome (column reason, null for kept)."""
    return gated.groupBy(key, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def distinct_titles(positions: DataFrame, limit: int = 200) -> DataFrame:
    return positions.select(F.trim("title").alias("title")).where("title <> ''").distinct().orderBy("title").limit(limit)


def co_occurrence_by_source(co: DataFrame) -> DataFrame:
    """Rows of joins.co_occurrence by entity and source: the others with all their link types."""
    rows = co.groupBy("entity_id", "source_id", "other_id", "other_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("link_types")))).alias("t"))
    one = F.concat(F.col("other_id"), F.lit("="), F.array_join("t", "+"))
    return rows.groupBy("entity_id", "source_id").agg(F.count(F.lit(1)).alias("n_others"), F.array_join(F.array_sort(F.collect_list(one)), ",").alias("others"))


def source_counts(source_entities: DataFrame) -> DataFrame:
    return source_entities.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source_id").alias("n_sources"))


def roles_by_user(roles: DataFrame) -> DataFrame:
    return roles.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("role")), ",").alias("roles"))


def explorer_list(entities: DataFrame, edges: DataFrame, mentions: DataFrame, kind: str | None = None) -> DataFrame:
    """Canonical entities with connections (active edges) and mentions, ranked by both."""
    d = endpoints(active_edges(edges)).groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("connections"))
    m = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("mentions"))
    e = canonical_only(entities) if kind is None else canonical_only(entities).where(F.col("type") == kind)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return e.join(d, "id", "left").join(m, "id", "left").select("id", "name", "type", zero("connections"), zero("mentions"))


def context_edges(co: DataFrame) -> DataFrame:
    """Unordered pairs of co-occurring entities with the number of sources they share, all link types there and, where they have titles, all of these.

    co: of joins.co_occurrence, or of joins.titled_pairs, which has one row for both directions of a pair in a source.
    """
    types = lambda every: F.array_sort(F.array_distinct(F.flatten(every)))
    if "title" in co.columns:
        once, titles = co.withColumnRenamed("link_types", "t"), [F.array_join(F.array_sort(F.collect_set("title")), "; ").alias("source_titles")]
    else:
        pair = co.select(F.least("entity_id", "other_id").alias("a"), F.greatest("entity_id", "other_id").alias("b"), "source_id", "link_types")
        # Pairs lie by their source: both directions of one become a row before anything is shuffled.
        once, titles = pair.groupBy("source_id", "a", "b").agg(types(F.collect_list("link_types")).alias("t")), []
    return once.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(types(F.collect_set("t")), ",").alias("link_types"), *titles)
