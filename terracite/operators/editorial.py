"""Table-to-table jobs of editors and reprocessing: every job reads the old rows and the changes and gives the new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terracite.functions.text import normalize_name
from terracite.operators.graph import canonical_roots
from terracite.session import cut


def upsert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Old rows, and new ones whose key is not there yet; of several the first by ``order``. Null keys are equal."""
    first = new.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))).where("__r = 1").drop("__r")
    o = old.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return old.unionByName(first.join(o, same, "left_anti"), allowMissingColumns=True)


def upsert_update(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Old rows with the columns of the new row of the same key, and the new rows of other keys (other columns null)."""
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__new")).dropDuplicates(keys)
    joined = old.join(n, keys, "full_outer")
    return joined.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def replace_derived(old: DataFrame, new: DataFrame, source_ids: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """A derived table with the rows of the sources replaced: rows that ``keep`` says (editors' work) stay, new rows come
    in where their key is free. The caller writes the result to a new folder and then switches over."""
    touched = old.join(source_ids, "source_id", "left_semi")
    others = old.join(source_ids, "source_id", "left_anti")
    kept = touched.where(keep) if keep is not None else touched.limit(0)
    return upsert_ignore(others.unionByName(kept), new, keys)


def write_derived(df: DataFrame, path: str, partition: str) -> None:
    """Writes rows so that a repeat writes the same: partitions that occur in ``df`` are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def merge_targets(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping: from_id, to_id, also chains. Returns id, target: the end of each chain."""
    rows = entities.select("id").join(mapping.select(F.col("from_id").alias("id"), F.col("to_id").alias("canonical_entity_id")), "id", "left")
    return canonical_roots(rows).where("id <> root_id").select("id", F.col("root_id").alias("target"))


def merge_entities(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, edges: DataFrame, mapping: DataFrame, keep_editorial: bool = True, drop_self: bool = True) -> dict[str, DataFrame]:
    """Merges entities into others: redirects them, moves mentions and edges, keeps one row for each key, learns aliases.

    Of edges that fall together the most confident stays; with ``keep_editorial`` an editor's decision (not pending)
    wins first. With ``drop_self`` edges between two merged entities go; else they become edges of one with itself.
    """
    to = merge_targets(entities, mapping)

    def moved(df: DataFrame, column: str) -> DataFrame:
        m = to.select(F.col("id").alias(column), F.col("target").alias("__t"))
        return df.join(m, column, "left").withColumn(column, F.coalesce("__t", column)).drop("__t")

    redirected = entities.join(to, "id", "left").withColumn("canonical_entity_id", F.coalesce("target", "canonical_entity_id")).drop("target")
    names = entities.join(to, "id").select(F.col("target").alias("entity_id"), F.col("name").alias("alias"), F.col("project_id").alias("scope"), F.col("normalized_name").alias("alias_normalized"), F.lit(1.0).alias("confidence"))
    learned = upsert_ignore(aliases, names, ["entity_id", "alias_normalized", "scope"], ["alias"])
    said = moved(mentions, "entity_id").distinct()
    ends = moved(moved(edges, "source_entity_id"), "target_entity_id")
    if drop_self:
        ends = ends.where("source_entity_id <> target_entity_id")
    keys = ["source_entity_id", "target_entity_id", "relation_type", "source_id"]
    first = [F.when(F.col("review_status") == "pending", 1).otherwise(0)] if keep_editorial else []
    w = Window.partitionBy(*keys).orderBy(*first, F.desc_nulls_last("confidence"), "id")
    one = ends.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return {"entities": redirected, "aliases": learned, "mentions": said, "edges": one}


def rename_entities(entities: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: id, new_name (of several for one entity the greatest name counts). What becomes of each, as if all were granted at once.

    Every entity that asks for another name gives its own up, so swaps and chains are renames. A name goes to the
    canonical entity of the same type and scope that has it and does not ask for another; else, for an entity of a project, to
    the global one that will have it; else to the first canonical one, by id, that asks for it: ``rename``, and all others that ask
    ``merge`` into it. Merged entities may be renamed but hold no name. ``missing``: no such entity; ``invalid``: nothing is left of the name;
    ``same``: it is the name already.

    Returns id, new_name, outcome, target_id (of a merge).
    """
    asked = requests.groupBy("id").agg(F.max("new_name").alias("new_name")).withColumn("new_name", F.trim("new_name")).withColumn("nn", normalize_name(F.col("new_name")))
    scope = F.coalesce(F.col("project_id").cast("long"), F.lit(-1)).alias("scope")
    known = entities.select("id", F.trim("name").alias("old"), "type", scope, F.col("canonical_entity_id").isNull().alias("canonical"))
    mine = cut(asked.join(known, "id", "left"))
    outcome = F.when(F.col("type").isNull(), "missing").when(F.coalesce("nn", F.lit("")) == "", "invalid").when(F.col("new_name") == F.col("old"), "same")
    claims = mine.where(outcome.isNull())
    key = ["nn", "type", "scope"]
    staying = entities.where("canonical_entity_id is null").join(claims.select("id"), "id", "left_anti").select("id", F.col("normalized_name").alias("nn"), "type", scope)
    wanted = claims.select("nn", "type").distinct()
    stays = staying.join(wanted, ["nn", "type"], "left_semi").groupBy(*key).agg(F.min("id").alias("stays"))
    first = claims.where("canonical").groupBy(*key).agg(F.min("id").alias("first"))
    held = cut(stays.join(first, key, "full"))
    world = held.where("scope = -1").select("nn", "type", F.coalesce("stays", "first").alias("world"))
    met = claims.join(held, key, "left").join(world, ["nn", "type"], "left")
    target = F.coalesce("stays", F.when(F.col("scope") != -1, F.col("world")), "first")
    settled = met.withColumn("target_id", F.when(target != F.col("id"), target)).select("id", "new_name", F.when(F.col("target_id").isNull(), "rename").otherwise("merge").alias("outcome"), "target_id")
    return settled.unionByName(mine.where(outcome.isNotNull()).select("id", "new_name", outcome.alias("outcome"), F.lit(None).cast(entities.schema["id"].dataType).alias("target_id")))


def apply_renames(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, edges: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """The tables after a batch of renames (``rename_entities``): renamed entities keep their old name as an alias in their scope, and those
    that merge are merged (``merge_entities``), their old names becoming the target's. Returns these four and ``outcomes``."""
    outcomes = cut(rename_entities(entities, requests))
    new = outcomes.where("outcome = 'rename'").select("id", F.col("new_name").alias("__name"))
    now = entities.join(new, "id", "left")
    renamed = now.withColumns({"name": F.coalesce("__name", "name"), "normalized_name": F.coalesce(normalize_name(F.col("__name")), F.col("normalized_name"))}).drop("__name")
    old = entities.join(new, "id").where(normalize_name(F.col("__name")) != F.col("normalized_name"))
    learned = old.select(F.col("id").alias("entity_id"), F.col("name").alias("alias"), F.col("project_id").alias("scope"), F.col("normalized_name").alias("alias_normalized"), F.lit(1.0).alias("confidence"))
    kept = upsert_ignore(aliases, learned, ["entity_id", "alias_normalized", "scope"], ["alias"])
    merges = outcomes.where("outcome = 'merge'").select(F.col("id").alias("from_id"), F.col("target_id").alias("to_id"))
    return {**merge_entities(renamed, kept, mentions, edges, merges), "outcomes": outcomes}


def apply_decisions(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: id, decision (approve, reject, restore), decided_at. The latest decision on each edge takes effect."""
    last = decisions.groupBy("id").agg(F.max(F.struct("decided_at", "decision")).alias("d")).select("id", F.col("d.decision").alias("decision"))
    status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "restore", "pending").otherwise(F.col("review_status"))
    return edges.join(last, "id", "left").withColumn("review_status", status).drop("decision")


def retype_edges(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: id, new_type. The old edge is rejected; one of the new type, by an editor and certain, is approved or added.

    An edge meets its requests once, and comes out with its new ones beside it; those of one key then settle where they lie.
    """
    keys, set_by_new = ["source_entity_id", "target_entity_id", "relation_type", "source_id"], ["id", "confidence", "evidence_text", "review_status", "origin"]
    asked = requests.where("new_type is not null").groupBy("id").agg(F.collect_set("new_type").alias("__types"))
    met = edges.join(asked, "id", "left").withColumn("__types", F.coalesce(F.filter("__types", lambda t: t != F.col("relation_type")), F.array().cast("array<string>")))
    rows = met.select(*edges.columns, "__types", F.explode(F.concat(F.array(F.lit(None).cast("string")), "__types")).alias("__type"))
    new = F.col("__type").isNotNull()
    made = {
        "id": F.concat_ws("|", "source_entity_id", "target_entity_id", "__type", "source_id"), "relation_type": F.col("__type"), "confidence": F.lit(1.0), "review_status": F.lit("approved"), "origin": F.lit("human_edited"),
    }
    was = {"review_status": F.when(F.size("__types") > 0, "rejected").otherwise(F.col("review_status"))}
    value = lambda c: F.when(new, made.get(c, F.col(c))).otherwise(was.get(c, F.col(c)))
    out = rows.select(*[value(c).alias(c) for c in edges.columns], new.alias("__new"))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()  # a null names no key that another row could have
    one = Window.partitionBy(*keys)
    told = {f"__{c}": F.max(F.when(F.col("__new"), F.struct(F.struct(*set_by_new).alias("row")))).over(one)["row"][c] for c in set_by_new}
    held = out.withColumns({**told, "__has": F.max("__new").over(one) & whole, "__r": F.row_number().over(one.orderBy("__new"))})
    kept = held.where(~F.col("__new") | (F.col("__r") == 1) | (~whole & F.col("__new")))
    return kept.select(*[F.when(F.col("__has"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in set_by_new else F.col(c) for c in edges.columns])


def inherit_tenants(projects: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with project_id, each with its project's tenant, and ``orphans``: rows of each table without one."""
    p = projects.select(F.col("id").alias("project_id"), "tenant_id")
    out = {name: df.join(p, "project_id", "left") for name, df in tables.items()}
    orphans = None
    for name, df in out.items():
        one = df.where("tenant_id is null").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        orphans = one if orphans is None else orphans.unionByName(one)
    return {**out, "orphans": orphans}


def backfill_links(anchors: DataFrame, source_entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link rows with those that anchors lack, and a check row: expected, actual, ok."""
    new = anchors.withColumn("origin", F.lit("upload_anchor"))
    full = upsert_ignore(source_entities, new, ["source_id", "entity_id", "link_type", "origin"])
    expected = anchors.distinct().agg(F.count(F.lit(1)).alias("expected"))
    there = full.where("origin = 'upload_anchor'").select("source_id", "entity_id", "link_type").distinct().join(anchors, ["source_id", "entity_id", "link_type"], "left_semi").agg(F.count(F.lit(1)).alias("actual"))
    return full, expected.crossJoin(there).withColumn("ok", F.col("expected") == F.col("actual"))


def claim_invites(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """members: project_id, user_id (null while pending), invite_email. Invites whose e-mail a profile has get its user."""
    p = profiles.groupBy(F.lower("email").alias("e")).agg(F.min("user_id").alias("claimed"))
    joined = members.withColumn("e", F.lower("invite_email")).join(p, "e", "left")
    return joined.withColumn("status", F.when(F.col("user_id").isNotNull(), "member").when(F.col("claimed").isNotNull(), "claimed").otherwise("pending")).withColumn("user_id", F.coalesce("user_id", "claimed")).drop("e", "claimed")


def delete_sources(tables: dict[str, DataFrame], source_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table (with source_id) without the rows of the sources."""
    return {name: df.join(source_ids, "source_id", "left_anti") for name, df in tables.items()}


def guarded_update(sources: DataFrame, requests: DataFrame, rules: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """requests: id, new_status. Applies those that ``rules`` (from, to) allow; the rest come back with a reason."""
    spark: SparkSession = sources.sparkSession
    allowed = spark.createDataFrame(rules, "status string, new_status string").withColumn("ok", F.lit(True))
    asked = requests.groupBy("id").agg(F.min("new_status").alias("new_status"))
    joined = asked.join(sources.select("id", "status"), "id", "left").join(F.broadcast(allowed), ["status", "new_status"], "left")  # a few rules
    applied = joined.where("ok").select("id", "new_status")
    refused = joined.where("ok is null").select("id", "new_status", F.when(F.col("status").isNull(), "missing").otherwise(F.concat(F.lit("not from "), F.col("status"))).alias("reason"))
    return sources.join(applied, "id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status"), refused


def merge_metadata(entities: DataFrame, patches: DataFrame) -> DataFrame:
    """Adds a patch (id, patch as JSON object of strings) to the JSON column metadata; the patch's fields win."""
    kind = "map<string,string>"
    joined = entities.join(patches, "id", "left")
    old, new = F.coalesce(F.from_json("metadata", kind), F.create_map().cast(kind)), F.from_json("patch", kind)
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return joined.withColumn("metadata", F.when(new.isNotNull(), F.to_json(F.map_concat(kept, new))).otherwise(F.col("metadata"))).drop("patch")


def correct_column(rows: DataFrame, corrections: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """corrections: id, value. Positive values, rounded, replace the column; also the rows that changed, old and new."""
    c = corrections.groupBy("id").agg(F.max("value").alias("__v"))
    joined = rows.join(c, "id", "left").withColumn("__new", F.when(F.col("__v") > 0, F.round("__v").cast("long")))
    report = joined.where(F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(column))).select("id", F.col(column).alias("old"), F.col("__new").alias("new"))
    return joined.withColumn(column, F.coalesce("__new", column)).drop("__v", "__new"), report


def edit_aliases(aliases: DataFrame, entities: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: entity_id, alias, action (add, remove). Adds only to canonical entities, and nothing twice."""
    r = requests.withColumn("alias_normalized", normalize_name(F.col("alias")))
    gone = r.where("action = 'remove'").select("entity_id", "alias_normalized")
    live = entities.where("canonical_entity_id is null").select(F.col("id").alias("entity_id"), F.col("project_id").alias("scope"))
    new = r.where("action = 'add' and alias_normalized <> ''").join(live, "entity_id").select("entity_id", "alias", "scope", "alias_normalized", F.lit(1.0).alias("confidence"))
    return upsert_ignore(aliases.join(gone, ["entity_id", "alias_normalized"], "left_anti"), new, ["entity_id", "alias_normalized", "scope"], ["alias"])
