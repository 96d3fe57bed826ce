"""Windows, ranking, top-n, budgets and pages. Every order ends in a column that breaks ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracite import vocab
from terracite.functions.text import role_label, role_order
from terracite.operators.filters import active_edges, canonical_only
from terracite.operators.joins import anchors_of, endpoints
from terracite.session import cut, small


def role_strength(role: Column) -> Column:
    """Place of a role among vocab.ROLES, from 1; any other comes after them."""
    order = F.array_position(F.array(*[F.lit(r) for r in vocab.ROLES]), role)
    return F.when(order > 0, order).otherwise(len(vocab.ROLES) + 1)


def best_role(intel: DataFrame) -> DataFrame:
    """Of each entity in each source the row of the strongest role; then one with evidence, by chunk and text."""
    w = Window.partitionBy("entity_id", "source_id").orderBy(role_strength(F.col("role")), F.asc_nulls_last("evidence"), F.asc_nulls_last("chunk_id"), F.asc_nulls_last("sentiment"), "kind", F.asc_nulls_last("role"))
    return intel.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def source_entity_items(source_entities: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities of every source for display: links by their place, then mentions; an entity's best row only."""
    links = source_entities.select("source_id", "entity_id", role_order(F.col("link_type"), F.col("origin")).alias("place"), role_label(F.col("link_type")).alias("label"))
    seen = mentions.select("source_id", "entity_id").distinct().withColumn("place", F.lit(6)).withColumn("label", F.lit("Mention"))
    best = links.unionByName(seen).groupBy("source_id", "entity_id").agg(F.min(F.struct("place", "label")).alias("b"))
    return best.join(entities.select(F.col("id").alias("entity_id"), "name", "type"), "entity_id").select("source_id", "entity_id", "name", "type", "b.place", "b.label")


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key, with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def mentions_ranked(intel: DataFrame, targets: DataFrame | None = None, cap: int = 30) -> DataFrame:
    """Up to ``cap`` rows of each entity: the latest first, or, with targets (entity_id, target_date), those nearest to
    noon of the date. Rows without a time come last."""
    time, tie = F.col("conducted_at"), ["source_id", F.asc_nulls_last("chunk_id"), "role"]
    if targets is None:
        return top_n(intel, ["entity_id"], [F.desc_nulls_last(time), *tie], cap)
    noon = F.unix_seconds(F.col("target_date").cast("timestamp")) + 43200
    near = intel.join(targets, "entity_id").withColumn("seconds", F.abs(F.unix_seconds(time.cast("timestamp")) - noon))
    return top_n(near, ["entity_id"], [F.asc_nulls_last("seconds"), F.desc_nulls_last(time), *tie], cap)


def temporal_rerank(hits: DataFrame, sources: DataFrame, questions: DataFrame) -> DataFrame:
    """Retrieved chunks (question_id, chunk_id, source_id, rank) in the order of the question's intent: current (latest
    first), timeline (earliest first), point_in_time (nearest to its date), else as retrieved. A missing time counts
    as zero; ties keep the retrieved order."""
    time = F.coalesce(F.unix_seconds(F.col("conducted_at").cast("timestamp")), F.lit(0))
    joined = hits.join(questions, "question_id").join(sources.select(F.col("id").alias("source_id"), "conducted_at"), "source_id", "left")
    by = (
        F.when(F.col("intent") == "current", -time)
        .when(F.col("intent") == "timeline", time)
        .when(F.col("intent") == "point_in_time", F.abs(time - F.unix_seconds(F.col("target_date").cast("timestamp"))))
        .otherwise(F.lit(0))
    )
    w = Window.partitionBy("question_id").orderBy(by, "rank", "chunk_id")
    return joined.withColumn("place", F.row_number().over(w)).select("question_id", "place", "chunk_id", "source_id", "rank")


def entity_edges(edges: DataFrame, entities: DataFrame, sources: DataFrame, project_id: int | None = None, each: int = 30, recency: bool = False) -> DataFrame:
    """Active edges of every entity with the other end's name, up to ``each`` a direction, by confidence or recency."""
    s = sources.select(F.col("id").alias("source_id"), F.col("project_id").alias("of_project"), "created_at")
    ends = endpoints(active_edges(edges).join(s, "source_id"))  # joined before each edge becomes two rows
    if project_id is not None:
        ends = ends.where(F.col("of_project") == project_id)
    order = [F.desc("created_at"), "id"] if recency else [F.desc_nulls_last("confidence"), "id"]
    top = top_n(ends, ["entity_id", "direction"], order, each)
    other = entities.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    return top.join(other, "other_id", "left").select("entity_id", "direction", "place", "other_id", "other_name", "relation_type", "confidence", "source_id")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of the ordered rows, counted from 1, with the exact total and the number of pages.

    The page is found by limit and offset, which sort only what is needed; the total is one aggregate beside it.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))  # the total is one row


def page_before(messages: DataFrame, before: DataFrame, limit: int = 40) -> DataFrame:
    """messages: conversation_id, sequence. before: conversation_id, sequence. The last ``limit`` messages before that
    one, in order, and whether there are more."""
    b = before.select("conversation_id", F.col("sequence").alias("bound"))
    older = messages.join(b, "conversation_id").where("sequence < bound")
    w = Window.partitionBy("conversation_id").orderBy(F.desc("sequence"))
    rows = older.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit + 1)
    more = F.max("r").over(Window.partitionBy("conversation_id")) > limit
    return rows.withColumn("has_more", more).where(F.col("r") <= limit).drop("r", "bound")


def assign_sequence(messages: DataFrame, order: list[str], base: DataFrame | None = None) -> DataFrame:
    """Gapless numbers from 1 in each conversation, after the last number that ``base`` (conversation_id, last) holds."""
    w = Window.partitionBy("conversation_id").orderBy(*order)
    numbered = messages.withColumn("sequence", F.row_number().over(w).cast("long"))
    if base is None:
        return numbered
    return numbered.join(base, "conversation_id", "left").withColumn("sequence", F.col("sequence") + F.coalesce("last", F.lit(0))).drop("last")


def speaker_islands(utterances: DataFrame) -> DataFrame:
    """Runs of utterances by one speaker of a source: texts joined by spaces, first start and last end."""
    w = Window.partitionBy("source_id").orderBy("turn")
    change = F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(w)), 0).otherwise(1)
    numbered = utterances.withColumn("change", change).withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("text")))), lambda x: x["text"]), " ")
    return numbered.groupBy("source_id", "island").agg(F.min("speaker").alias("speaker"), text.alias("text"), F.min("start").alias("start"), F.max("end").alias("end"))


def keyterm_budget(terms: DataFrame, words: int = 190) -> DataFrame:
    """terms: source_id, place, term. Distinct terms in order up to the first that would exceed the words allowed."""
    first = terms.where(F.length(F.trim("term")) > 0).groupBy("source_id", F.lower(F.trim("term")).alias("key")).agg(F.min(F.struct("place", F.trim("term").alias("term"))).alias("f"))
    rows = first.select("source_id", "f.place", "f.term").withColumn("n", F.size(F.split("term", r"\s+")))
    w = Window.partitionBy("source_id").orderBy("place", "term").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") <= words).select("source_id", "place", "term", "upto")


def workspace_brief(members: DataFrame, projects: DataFrame, sources: DataFrame, max_n: int = 24, max_chars: int = 14000) -> DataFrame:
    """A user's latest completed sources as lines, by project name, within limits of number and characters."""
    done = sources.where("status = 'COMPLETED'").select("project_id", F.col("id").alias("source_id"), "title", "created_at")
    rows = members.join(projects.select(F.col("id").alias("project_id"), "name"), "project_id").join(done, "project_id")
    top = top_n(rows, ["user_id"], ["name", F.desc("created_at"), "source_id"], max_n)
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("title"))
    w = Window.partitionBy("user_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    kept = top.withColumn("line", line).withColumn("chars", F.sum(F.length("line") + 1).over(w)).where(F.col("chars") <= max_chars)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), joined.alias("brief"))


def candidate_shortlist(sources: DataFrame, mentions: DataFrame, entities: DataFrame, cap: int = 28, enough: int = 5) -> DataFrame:
    """Names to offer for each source (one row for each id): its anchors, then its project's most mentioned entities, and, where
    those are under ``enough``, the most mentioned global ones. The most mentioned are found once for each project and made a list, which
    a source puts its anchors before; no row of a list is shuffled."""
    named = canonical_only(entities).select(F.col("id").alias("entity_id"), "name", F.col("project_id").alias("scope"))
    s = sources.select(F.col("id").alias("source_id"), "project_id")
    used = mentions.join(s, "source_id").groupBy("project_id", "entity_id").agg(F.count(F.lit(1)).alias("n")).join(named, "entity_id")
    own = cut(top_n(used, ["project_id"], [F.desc("n"), "entity_id"], cap).select("project_id", "entity_id", "name", "n"))
    held = own.groupBy("project_id").agg(F.count(F.lit(1)).alias("k"))
    few = cut(s.select("project_id").where("project_id is not null").distinct().join(held, "project_id", "left").where(F.coalesce("k", F.lit(0)) < enough).select("project_id"))
    tiers = own.withColumn("tier", F.lit(2))
    if not few.isEmpty():
        world = used.where("scope is null").groupBy("entity_id", "name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "entity_id").limit(cap)
        fill = few.crossJoin(F.broadcast(world)).join(own, ["project_id", "entity_id"], "left_anti")  # cap rows
        tiers = tiers.unionByName(fill.select("project_id", "entity_id", "name", "n", F.lit(3).alias("tier")))
    ordered = F.array_sort(F.collect_list(F.struct("tier", (-F.col("n")).alias("less"), "entity_id", "name")))
    lists = tiers.groupBy("project_id").agg(F.transform(ordered, lambda x: F.struct(x["entity_id"].alias("entity_id"), x["name"].alias("name"), x["tier"].alias("tier"))).alias("list"))
    anchors = anchors_of(sources).join(named, "entity_id").select("source_id", F.lit(None).cast(s.schema["project_id"].dataType).alias("project_id"), F.struct("entity_id", "name", F.lit(1).alias("tier")).alias("anchor"))
    every = anchors.unionByName(s, allowMissingColumns=True).groupBy("source_id").agg(F.max("project_id").alias("project_id"), F.array_sort(F.collect_set("anchor")).alias("anchors"))
    known = F.transform("anchors", lambda a: a["entity_id"])
    rest = F.filter("list", lambda x: ~F.array_contains(known, x["entity_id"]))
    offered = every.join(small(cut(lists)), "project_id", "left").select("source_id", F.slice(F.concat("anchors", F.coalesce(rest, F.slice("anchors", 1, 0))), 1, cap).alias("offered"))
    return offered.select("source_id", F.posexplode("offered").alias("at", "one")).select("source_id", (F.col("at") + 1).alias("place"), "one.entity_id", "one.name", "one.tier")


def positions_current(positions: DataFrame) -> DataFrame:
    """The active position of each person: the main one, else the latest validated."""
    return top_n(positions.where("state = 'active'"), ["person_id"], [F.desc("is_main"), F.desc("validated_at"), F.desc("id")], 1).drop("place")


def positions_timeline(positions: DataFrame) -> DataFrame:
    """Positions of each person by start, unknown starts last."""
    w = Window.partitionBy("person_id").orderBy(F.asc_nulls_last("valid_from_date"), "id")
    return positions.withColumn("place", F.row_number().over(w)).select("person_id", "place", "id", "org_id", "title", "state", "valid_from_date")


def positions_org(positions: DataFrame) -> DataFrame:
    """The active people of each organization."""
    return positions.where("state = 'active'").select("org_id", "person_id", "title", "is_main", "validated_at", "id")


def recent_sources(sources: DataFrame, n: int = 6) -> DataFrame:
    return sources.orderBy(F.desc("created_at"), "id").limit(n)


def label_budget(nodes: DataFrame) -> DataFrame:
    """Nodes (graph_id, entity_id, mentions) that get a label: two fifths of a graph, between 3 and 8, most mentioned first."""
    of = Window.partitionBy("graph_id")
    allowed = F.least(F.lit(8), F.greatest(F.lit(3), F.ceil(F.count(F.lit(1)).over(of) * 0.4)))
    w = of.orderBy(F.desc("mentions"), "entity_id")
    return nodes.withColumn("allowed", allowed).withColumn("place", F.row_number().over(w)).where("place <= allowed").drop("allowed")


def recent(df: DataFrame, ts_col: str, n: int, tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(ts_col), tie).limit(n)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place of each row in the whole order, from 1: rows go to ranges of the order, and each range starts
    after the rows of those before it. The order should tell all rows apart."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + inside).drop("__part", "__start")  # one row for each range
