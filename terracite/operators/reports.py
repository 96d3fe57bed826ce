"""Tables for reports: evidence ledgers, best chunks, briefs and position tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracite.functions import text as tx
from terracite.operators.filters import active_edges
from terracite.operators.ranking import numbered, positions_current, top_n
from terracite.session import cut, small


def entity_registry(rollup: DataFrame) -> DataFrame:
    """Canonical entities with their place: most mentioned first."""
    return numbered(rollup, [F.desc("n_mentions"), F.col("name"), F.col("root_id")], "place")


def evidence_ledger(mentions: DataFrame, edges: DataFrame, sources: DataFrame, entities: DataFrame, chunks: DataFrame, roots: DataFrame, most_mentions: int = 18, most: int = 30) -> DataFrame:
    """The evidence of every project: mentions of its best-known entities, then edges by confidence.

    Mentions are grouped by canonical entity and source. A row counts once for each source and excerpt (normalized), the
    strongest first; only then are the ``most_mentions`` best mentions kept and edges added up to ``most``.

    Rows of different sources never repeat each other, so mentions up to a project's n-th source leave n rows at least. Texts are fetched for
    those, and for all mentions of the sources of the first edges, which such a mention may repeat; where too few edges are left, more are taken.
    """
    s = sources.where("status = 'COMPLETED'").select(F.col("id").alias("source_id"), "project_id")
    of = roots.select(F.col("id").alias("entity_id"), "root_id")
    named = entities.select(F.col("id").alias("tie"), "name")
    groups = mentions.select("entity_id", "source_id").join(s, "source_id").join(of, "entity_id").groupBy("project_id", F.col("root_id").alias("tie"), "source_id").agg(F.count(F.lit(1)).alias("n"))
    fame = groups.groupBy("project_id", "tie").agg((-F.sum("n")).cast("double").alias("weight")).join(named.select("tie"), "tie", "left_semi")
    a = cut(groups.join(fame, ["project_id", "tie"]).select("project_id", "tie", "source_id", "weight"))
    met = a.groupBy("project_id", "source_id").agg(F.min(F.struct("weight", "tie")).alias("f")).select("project_id", F.struct("f.weight", "f.tie", "source_id").alias("f"))
    first = met.withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy("f"))).where(F.col("r") <= most_mentions)
    bound = first.groupBy("project_id").agg(F.when(F.count(F.lit(1)) == most_mentions, F.max("f")).alias("bound"))  # null: all rows count
    near = F.col("bound").isNull() | (F.struct("weight", "tie", "source_id") <= F.col("bound"))
    best = a.join(small(cut(bound)), "project_id").where(near).select(a.columns)
    same = tx.normalize_name(F.col("excerpt"))

    def told(rows: DataFrame) -> DataFrame:
        rows = cut(rows)
        few = cut(mentions.join(small(rows.select("source_id").distinct()), "source_id", "left_semi").join(of, "entity_id").withColumnRenamed("root_id", "tie").join(small(rows), ["tie", "source_id"]))
        texts = chunks.select(F.col("id").alias("chunk_id"), "content").join(small(few.select("chunk_id").where("chunk_id is not null").distinct()), "chunk_id", "left_semi")
        full = few.join(small(cut(texts)), "chunk_id", "left")
        m = full.groupBy("project_id", "tie", "source_id", "weight").agg(F.min(F.struct(F.col("chunk_id").isNull().alias("none"), "chunk_id", "content", "sentiment")).alias("m"))
        return cut(m.join(named, "tie").select(
            "project_id", F.lit(0).alias("tier"), "weight", "tie", "source_id", tx.clip(F.coalesce(F.col("m.content"), F.col("name")), 220).alias("excerpt"),
            F.concat(F.lit("Entity mention with "), F.col("m.sentiment"), F.lit(" sentiment")).alias("note"),
        ))

    def once(rows: DataFrame) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(Window.partitionBy("project_id", "source_id", same).orderBy("weight", "tie"))).where("r = 1").drop("r")

    b = active_edges(edges).join(s, "source_id").select(
        "project_id", F.lit(1).alias("tier"), (-F.col("confidence")).alias("weight"), F.col("id").alias("tie"), "source_id",
        tx.clip(F.coalesce("evidence_text", F.concat_ws(" ", "source_entity_id", "relation_type", "target_entity_id")), 220).alias("excerpt"), F.col("relation_type").alias("note"),
    )
    n = 2 * most
    while True:
        top = cut(once(b).withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy("weight", "tie", "source_id"))).where(F.col("r") <= n))
        said = told(best.unionByName(a.join(small(top.select("project_id", "source_id").distinct()), ["project_id", "source_id"], "left_semi")).distinct())
        left = top.withColumn("__k", same).join(said.select("project_id", "source_id", same.alias("__k")), ["project_id", "source_id", "__k"], "left_anti")
        had = top.groupBy("project_id").agg(F.max("r").alias("r")).where(F.col("r") == n).join(left.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")), "project_id", "left")
        if had.where(F.coalesce("n", F.lit(0)) < most).isEmpty():
            break
        n *= 8
    once_each = once(said).unionByName(left.select(said.columns))
    w = Window.partitionBy("project_id", "tier").orderBy("weight", "tie", "source_id")
    ranked = once_each.withColumn("r", F.row_number().over(w)).where((F.col("tier") == 1) & (F.col("r") <= most) | (F.col("r") <= most_mentions))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("tier", "r"))
    kind = F.when(F.col("tier") == 0, "entity_mention").otherwise("relationship")
    return ranked.withColumn("place", place).where(F.col("place") <= most).select("project_id", F.concat(F.lit("EV-"), F.col("place")).alias("evidence_id"), kind.alias("kind"), "source_id", "excerpt", "note")


def best_chunk(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claims: claim_id, source_id, chunk_id, snippet, terms. The chunk of each claim: the one it names, else one that holds
    the snippet, else the one whose matched terms (of three letters or more) are longest together, else the first."""
    c = chunks.select("source_id", F.col("id").alias("found"), "chunk_index", F.lower("content").alias("low"))
    rows = claims.join(c, "source_id")
    score = F.aggregate(F.filter("terms", lambda t: (F.length(t) >= 3) & F.contains(F.col("low"), F.lower(t))), F.lit(0), lambda s, t: s + F.length(t))
    holds = F.length(F.trim("snippet")) > 0
    tier = F.when(F.col("found") == F.col("chunk_id"), 0).when(holds & F.contains("low", F.lower(F.trim("snippet"))), 1).otherwise(2)
    w = Window.partitionBy("claim_id").orderBy("tier", F.desc("score"), "chunk_index", "found")
    best = rows.withColumn("score", F.coalesce(score, F.lit(0))).withColumn("tier", F.coalesce(tier, F.lit(2))).withColumn("score", F.when(F.col("tier") == 2, F.col("score")).otherwise(0))
    return best.withColumn("r", F.row_number().over(w)).where("r = 1").select("claim_id", F.col("found").alias("chunk_id"), "tier", "score")


def hydrate_blocks(blocks: DataFrame, ledger: DataFrame) -> DataFrame:
    """blocks: project_id, block_id, refs (array of evidence ids), entity. The valid refs of each block, else up to two rows
    whose excerpt names the entity, else the project's first row; with the number of distinct sources."""
    l = ledger.select("project_id", "evidence_id", "source_id", "excerpt", F.substring("evidence_id", 4, 9).cast("int").alias("n"))
    rows = blocks.join(l, "project_id")
    tier = F.when(F.array_contains("refs", F.col("evidence_id")), 0).when(F.contains(F.lower("excerpt"), F.lower("entity")), 1).otherwise(2)
    of = Window.partitionBy("project_id", "block_id")
    ranked = rows.withColumn("tier", F.coalesce(tier, F.lit(2))).withColumn("best", F.min("tier").over(of)).where("tier = best")
    place = F.row_number().over(of.orderBy("n"))
    allowed = F.when(F.col("best") == 0, F.lit(10**6)).when(F.col("best") == 1, 2).otherwise(1)
    kept = ranked.withColumn("p", place).where(F.col("p") <= allowed)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "evidence_id"))), lambda x: x["evidence_id"]), ",")
    return kept.groupBy("project_id", "block_id").agg(ids.alias("evidence_ids"), F.countDistinct("source_id").alias("n_sources"))


def project_brief(projects: DataFrame, sources: DataFrame, width: int = 60) -> DataFrame:
    """A text for every project: its attributes and its completed sources, by title, with their topics."""
    done = sources.where("status = 'COMPLETED'").select("project_id", F.concat(F.lit("- "), tx.clip(F.col("title"), width), F.lit(" ["), F.array_join("topics", ", "), F.lit("]")).alias("line"), "id")
    lines = done.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("line", "id"))).alias("r"))
    joined = projects.join(lines, projects["id"] == lines["project_id"], "left")
    head = F.concat(F.col("name"), F.lit(" ("), F.col("country"), F.lit(", "), F.col("region"), F.lit(")"))
    return joined.select(projects["id"].alias("project_id"), F.coalesce("n", F.lit(0)).alias("n_sources"), F.concat_ws("\n", head, F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("brief"))


def positions_for_questions(positions: DataFrame, questions: DataFrame) -> DataFrame:
    """questions: request_id, person_id, intent (current, point_in_time, timeline), as_of. The positions that answer each,
    with freshness on the day and whether their bounds are exact."""
    from terracite.operators.joins import positions_as_of

    current = positions_current(positions).join(questions.where("intent = 'current'"), "person_id")
    then = positions_as_of(positions, questions.where("intent = 'point_in_time'"))
    every = positions.join(questions.where("intent = 'timeline'"), "person_id")
    rows = current.select(then.columns).unionByName(then).unionByName(every.select(then.columns))
    fresh = tx.freshness(F.col("validated_at"), F.col("as_of"))
    return rows.select("request_id", "intent", "person_id", "id", "org_id", "title", "state", fresh.alias("freshness"), tx.degraded(F.col("valid_from_precision"), F.col("valid_to_precision")).alias("degraded"))


def co_occurrence_context(co: DataFrame, max_sources: int = 12, max_entities: int = 8) -> DataFrame:
    """For each entity, its latest sources with the first others named there and the number of the rest."""
    rank = Window.partitionBy("entity_id", "source_id").orderBy("other_name", "other_id")
    rows = co.withColumn("r", F.row_number().over(rank))
    names = F.array_sort(F.collect_list(F.when(F.col("r") <= max_entities, F.struct("r", "other_name"))))
    grouped = rows.groupBy("entity_id", "source_id").agg(F.array_join(F.transform(names, lambda x: x["other_name"]), ", ").alias("others"), F.greatest(F.lit(0), F.count(F.lit(1)) - max_entities).alias("n_more"))
    return top_n(grouped, ["entity_id"], [F.desc("source_id")], max_sources)
