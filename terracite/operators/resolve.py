"""Entity resolution, grounding of mentions, gates and links. Model output is an input table, never made here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracite import vocab
from terracite.functions import text as tx
from terracite.operators.aggregates import best_candidate
from terracite.operators.editorial import upsert_ignore, upsert_update
from terracite.operators.filters import canonical_only, linkable
from terracite.operators.grounding import ground
from terracite.operators.joins import anchors_of, gram_join, match_cascade, names_to_ids
from terracite.session import cut

EPSILON = 1e-9


def match_or_create(names: DataFrame, entities: DataFrame, aliases: DataFrame, mode: str = "create", merge: float = 0.9, review: float = 0.8) -> DataFrame:
    """names: mention_id, project_id, type, name. The entity of each name: by exact name or alias; else the most alike in
    the project, or, where no name of the project shares a trigram with it, globally: merged from ``merge`` up; below, a new entity, to be
    reviewed from ``review`` up. With mode match_only nothing is created and fuzzy matches do not count.

    A new entity's id is a hash of scope, type and normalized name, so two new mentions of one name make one entity.
    Returns mention_id, entity_id, result (matched, created, none), method, score, needs_review.
    """
    n = names.withColumn("normalized_name", tx.normalize_name(F.col("name")))
    exact = match_cascade(n, entities, aliases).select("mention_id", "entity_id", F.col("tier").alias("method"))
    exact = cut(exact) if mode != "match_only" else exact  # read by each tier that follows
    rest = n.join(exact, "mention_id", "left_anti")
    if mode == "match_only":
        none = rest.select("mention_id", F.lit(None).cast("string").alias("entity_id"), F.lit("none").alias("result"), F.lit("none").alias("method"), F.lit(0.0).alias("score"), F.lit(False).alias("needs_review"))
        return exact.select("mention_id", "entity_id", F.lit("matched").alias("result"), "method", F.lit(1.0).alias("score"), F.lit(False).alias("needs_review")).unionByName(none)
    e = canonical_only(entities)
    both = e.select("id", "type", "project_id", F.col("normalized_name").alias("name")).unionByName(
        aliases.select(F.col("entity_id").alias("id"), F.col("alias_normalized").alias("name"), "scope").join(e.select("id", "type"), "id").select("id", "type", F.col("scope").alias("project_id"), "name")
    )
    # Names are compared once for each block and spelling; of the entities that share one, the smallest id is the best.
    block = lambda scope: F.concat_ws("|", scope, "type").alias("block")
    targets = cut(both.select(block(F.coalesce(F.col("project_id").cast("string"), F.lit("*"))), "name", "id").groupBy("block", "name").agg(F.min("id").alias("id"))).select(F.struct("block", "name", "id").alias("right_id"), "name", "block")
    ask = cut(rest.where("normalized_name <> ''").select("mention_id", block(F.col("project_id").cast("string")), F.col("normalized_name").alias("name"), "type"))
    asked = lambda df: df.select(F.struct("block", "name").alias("left_id"), "name", "block").distinct()
    mine = asked(ask)
    # A project has something alike if any of its names of the type shares a trigram, however low the score.
    of = lambda df, *more: df.select(*more, "block", F.explode(tx.grams(F.col("name"), 3)).alias("g"))
    alike = of(mine, "left_id").join(of(targets).distinct(), ["block", "g"], "left_semi").select("left_id.*").distinct()
    near = ask.join(alike, ["block", "name"], "left_semi").select("mention_id")
    far = ask.join(near, "mention_id", "left_anti").withColumn("block", F.concat_ws("|", F.lit("*"), "type"))
    own, world = gram_join(mine, targets, review, ["block"]), gram_join(asked(far), targets, review, ["block"])
    scored = own.unionByName(world).groupBy("left_id").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("right_id.id").alias("entity_id"))).alias("b")).select("left_id.*", "b.*")
    every = ask.select("mention_id", "block", "name").unionByName(far.select("mention_id", "block", "name")).join(scored, ["block", "name"])
    best = best_candidate(every.select("mention_id", "entity_id", (-F.col("less")).alias("score")))
    joined = rest.join(best.withColumnRenamed("entity_id", "near"), "mention_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    minted = F.sha2(F.concat_ws("|", F.coalesce(F.col("project_id").cast("string"), F.lit("GLOBAL")), "type", "normalized_name"), 256)
    merged = F.col("score") >= merge - EPSILON
    fuzzy = joined.select(
        "mention_id", F.when(merged, F.col("near")).otherwise(minted).alias("entity_id"), F.when(merged, "matched").otherwise("created").alias("result"),
        F.when(merged, "fuzzy").otherwise("new").alias("method"), "score", (~merged & (F.col("score") >= review - EPSILON)).alias("needs_review"),
    )
    sure = exact.select("mention_id", "entity_id", F.lit("matched").alias("result"), "method", F.lit(1.0).alias("score"), F.lit(False).alias("needs_review"))
    return sure.unionByName(fuzzy)


def resolve_entities(extracted: DataFrame, anchors: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """extracted: mention_id, source_id, project_id, raw_name, canonical_name, type, forced_id. anchors: source_id, person,
    person_id, org, org_id.

    A forced id counts first; then a person or organization that matches its source's anchor is the anchor's entity;
    the rest is matched or created by the canonical name, else the raw one. Returns as ``match_or_create``.
    """
    rows = extracted.join(anchors, "source_id", "left").withColumn("raw", tx.normalize_name(F.col("raw_name"))).withColumn("can", tx.normalize_name(F.col("canonical_name")))
    person = tx.person_anchor_method(F.col("raw"), F.col("can"), tx.normalize_name(F.col("person")))
    org = tx.org_anchor_method(F.col("raw"), F.col("can"), tx.normalize_name(F.col("org")))
    how = F.when(F.col("forced_id").isNotNull(), "forced").when((F.col("type") == "PERSON") & F.col("person_id").isNotNull(), person).when(F.col("type").isin(*vocab.ORG_TYPES) & F.col("org_id").isNotNull(), org)
    # The methods are long expressions, and what follows reads the rows several times.
    rows = cut(rows.withColumn("how", how))
    known = rows.where("how is not null").select(
        "mention_id", F.coalesce("forced_id", F.when(F.col("type") == "PERSON", F.col("person_id")).otherwise(F.col("org_id"))).alias("entity_id"), F.lit("matched").alias("result"),
        F.col("how").alias("method"), F.lit(1.0).alias("score"), F.lit(False).alias("needs_review"),
    )
    name = F.coalesce(F.nullif(F.trim("canonical_name"), F.lit("")), "raw_name")
    return known.unionByName(match_or_create(rows.where("how is null").select("mention_id", "project_id", "type", name.alias("name")), entities, aliases))


def learn_aliases(resolved: DataFrame, aliases: DataFrame, origin: str = "extraction") -> DataFrame:
    """resolved: entity_id, raw_name, scope. Aliases with the new spellings; those known stay as they are."""
    confidence = {"system": 1.0, "extraction": 0.8, "user_correction": 1.0, "admin_governance": 1.0}[origin]
    new = resolved.select("entity_id", F.trim("raw_name").alias("alias"), "scope", tx.normalize_name(F.col("raw_name")).alias("alias_normalized"), F.lit(confidence).alias("confidence")).where("alias_normalized <> ''")
    return upsert_ignore(aliases, new, ["entity_id", "alias_normalized", "scope"], ["alias"])


def enrich_descriptions(entities: DataFrame, resolved: DataFrame, max_len: int = 600) -> DataFrame:
    """Entities whose description is missing or shorter get the longest one that a mention gives, cut at a sentence."""
    told = resolved.where("description is not null").select("entity_id", tx.trim_sentence(F.col("description"), max_len).alias("d"))
    best = told.groupBy(F.col("entity_id").alias("id")).agg(F.max(F.struct(F.length("d").alias("n"), "d")).alias("b"))
    joined = entities.join(best, "id", "left")
    longer = F.col("b.n") > F.coalesce(F.length("description"), F.lit(0))
    return joined.withColumn("description", F.when(longer, F.col("b.d")).otherwise(F.col("description"))).drop("b")


def backfill_mentions(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, chunks: DataFrame, sources: DataFrame, sizes: DataFrame | None = None, keyed: bool = False) -> DataFrame:
    """Mentions (entity_id, source_id, chunk_id, sentiment) without a chunk are grounded in their source's chunks, where the source is in a project;
    a row is replaced only where that finds some. Every method counts here, the context of the source's own anchors among them: its interviewee is a person, the
    interviewee's organization an organization. A mention of that chunk that is there already takes over the sentiment. sizes, keyed: see ``ground``."""
    placed = sources.where("project_id is not null").select(F.col("id").alias("source_id"))
    named = entities.select(F.col("id").alias("entity_id"), "name")
    open_ = mentions.where("chunk_id is null").select("source_id", "entity_id", "sentiment").join(placed, "source_id", "left_semi").join(named, "entity_id")
    anchors = anchors_of(sources).join(named, "entity_id").withColumn("kind", F.when(F.col("link_type") == "interviewee", "person").otherwise("org"))
    found = ground(open_, aliases, chunks, anchors, sizes, keyed).join(chunks.select(F.col("id").alias("chunk_id"), "source_id"), "chunk_id").select("entity_id", "source_id", "chunk_id", "sentiment")
    done = found.select("entity_id", "source_id").distinct()
    kept = mentions.where("chunk_id is not null").unionByName(mentions.where("chunk_id is null").join(done, ["entity_id", "source_id"], "left_anti"))
    return upsert_update(kept, found, ["entity_id", "source_id", "chunk_id"], ["sentiment"])


def backfill_counts(mentions: DataFrame, filled: DataFrame) -> DataFrame:
    """How many mentions without a chunk were grounded in each source that had some, and how many were skipped. filled: of ``backfill_mentions``."""
    open_ = lambda df, name: df.where("chunk_id is null").groupBy("source_id").agg(F.count(F.lit(1)).alias(name))
    left = F.coalesce("left", F.lit(0))
    return open_(mentions, "n").join(open_(filled, "left"), "source_id", "left").select("source_id", (F.col("n") - left).alias("grounded"), left.alias("skipped"))


def persistence_gate(grounded: DataFrame, edges: DataFrame, anchors: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """grounded: source_id, entity_id, chunk_id, match_method. edges: source_id, source_entity_id, target_entity_id,
    relation_type. Mentions stay by exact name or alias; entities with such a mention and anchors (source_id, entity_id)
    persist; an edge stays if both ends persist in its source and no editor rejected the triple. Both tables come back
    whole, with a reason where a row does not stay."""
    ok = F.col("match_method").isin("exact", "alias")
    mentions = grounded.withColumn("reason", F.when(~ok, F.concat(F.lit("method "), F.col("match_method"))))
    alive = grounded.where(ok).select("source_id", "entity_id").unionByName(anchors.select("source_id", "entity_id")).distinct()
    out = edges
    for end, mark in (("source_entity_id", "s"), ("target_entity_id", "t")):
        out = out.join(alive.select("source_id", F.col("entity_id").alias(end), F.lit(True).alias(mark)), ["source_id", end], "left")
    triple = ["source_id", "source_entity_id", "target_entity_id", "relation_type"]
    out = out.join(rejected.select(*triple).distinct().withColumn("no", F.lit(True)), triple, "left")
    reason = F.when(F.col("no"), "rejected by editor").when(F.col("s").isNull() | F.col("t").isNull(), "end not persisted")
    return mentions, out.withColumn("reason", reason).drop("s", "t", "no")


def validate_edges(extracted: DataFrame, known: list[str] | None = None, floor: float = 0.1, high: float = 0.7, lowered: float = 0.5) -> DataFrame:
    """Extracted edges with a reason where they go (unknown type, self, confidence); high confidence without evidence is
    lowered. Evidence is trimmed; blank evidence stays as an empty text."""
    evidence = F.trim("evidence_text")
    bare = evidence.isNull() | (evidence == "")
    self_edge = (F.col("source_name") == F.col("target_name")) | (tx.normalize_name(F.col("source_name")) == tx.normalize_name(F.col("target_name")))
    reason = F.when(~F.col("relation_type").isin(*(known or vocab.RELATION_TYPES)), "unknown type").when(self_edge, "self").when(F.col("confidence") < floor, "low confidence")
    sure = F.when(bare & (F.col("confidence") >= high), lowered).otherwise(F.col("confidence"))
    return extracted.withColumn("reason", reason).withColumn("confidence", sure).withColumn("evidence_text", evidence)


def anchor_links(sources: DataFrame) -> DataFrame:
    """Link rows of both anchors of every source."""
    return anchors_of(sources).select("source_id", "entity_id", "link_type", F.lit("upload_anchor").alias("origin"), F.lit(True).alias("is_primary"))


def participant_links(payload: DataFrame, entities: DataFrame, aliases: DataFrame, known: list[str] | None = None) -> DataFrame:
    """payload: source_id, project_id, participants (array of name, type, link_type). Link rows of those with known types
    whose names are matched; nothing is created."""
    rows = payload.select("source_id", "project_id", F.posexplode("participants").alias("k", "p")).select("source_id", "project_id", "k", "p.*")
    rows = rows.where(F.col("link_type").isin(*(known or vocab.ROLES)) & F.col("type").isin(*vocab.ENTITY_TYPES)).withColumn("mention_id", F.concat_ws("-", "source_id", "k"))
    found = match_or_create(rows.select("mention_id", "project_id", "type", "name"), entities, aliases, "match_only").where("entity_id is not null")
    return rows.join(found, "mention_id").select("source_id", "entity_id", "link_type", F.lit("upload_anchor").alias("origin")).distinct()


def anchor_edges(sources: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Edges from each source's interviewee to its organization, certain and approved: of the types given (source_id, types),
    else by job title (source_id, title), else works_at."""
    rows = sources.where("interviewee_entity_id is not null and interviewee_org_entity_id is not null").select(
        F.col("id").alias("source_id"), F.col("interviewee_entity_id").alias("source_entity_id"), F.col("interviewee_org_entity_id").alias("target_entity_id")
    )
    kinds = F.array(F.lit("works_at"))
    if titles is not None:
        rows = rows.join(titles, "source_id", "left")
        kinds = F.array(F.coalesce(tx.relation_from_title(F.col("title")), F.lit("works_at")))
        if "types" in titles.columns:
            kinds = F.when(F.size("types") > 0, F.col("types")).otherwise(kinds)
    out = rows.select("source_id", "source_entity_id", "target_entity_id", F.explode(kinds).alias("relation_type"))
    return out.distinct().withColumn("confidence", F.lit(1.0)).withColumn("review_status", F.lit("approved"))


def extraction_links(associations: DataFrame, name_map: DataFrame, floor: float = 0.9) -> DataFrame:
    """associations: source_id, place, name, link_type, confidence, evidence_text. Link rows of confidence ``floor`` or more
    whose name has an entity; the first of each entity and type; evidence under ``quote``."""
    known = names_to_ids(associations.where(F.col("confidence") >= floor), "name", name_map).where("entity_id is not null")
    w = Window.partitionBy("source_id", "entity_id", "link_type").orderBy("place", F.desc("confidence"))
    one = known.withColumn("r", F.row_number().over(w)).where("r = 1")
    quote = F.when(F.col("evidence_text").isNotNull(), F.to_json(F.struct(F.col("evidence_text").alias("quote"))))
    return one.select("source_id", "entity_id", "link_type", F.lit("extraction").alias("origin"), "confidence", quote.alias("evidence"))


def project_links(source_entities: DataFrame, sources: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that a project should list: the first linkable row of each, anchors first, then by age and source."""
    rows = linkable(source_entities).join(sources.select(F.col("id").alias("source_id"), "project_id"), "source_id")
    w = Window.partitionBy("project_id", "entity_id").orderBy(F.when(F.col("origin") == "upload_anchor", 0).otherwise(1), "created_at", "source_id", "link_type")
    one = rows.withColumn("r", F.row_number().over(w)).where("r = 1")
    e = entities.select(F.col("id").alias("entity_id"), "description")
    note = tx.trim_sentence(F.coalesce("evidence", "description"), 300)
    return one.join(e, "entity_id", "left").select("project_id", "entity_id", "source_id", "origin", note.alias("note"))


def enrichment_worklist(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, k: int = 8, least: int = 150) -> DataFrame:
    """Entities that need a description, with the number of their sources and chunks and up to k of the latest excerpts."""
    from terracite.operators.filters import needs_enrichment

    need = needs_enrichment(entities, least).select(F.col("id").alias("entity_id"), "name")
    seen = mentions.join(need, "entity_id", "left_semi")
    n = seen.groupBy("entity_id").agg(F.countDistinct("source_id").alias("n_sources"), F.countDistinct("chunk_id").alias("n_chunks"))
    rows = seen.where("chunk_id is not null").select("entity_id", "source_id", "chunk_id").distinct().join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id")
    w = Window.partitionBy("entity_id").orderBy(F.desc("source_id"), "chunk_id")
    top = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", "chunk_id", "content").alias("t")))).alias("x"))
    joined = need.join(n, "entity_id", "left").join(top, "entity_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("entity_id", "name", zero("n_sources"), zero("n_chunks"), F.coalesce(F.array_join(F.transform("x", lambda x: x["t"]), " | "), F.lit("")).alias("excerpts"))


def context_worklist(source_entities: DataFrame, mentions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """For each entity linked to a source, up to k chunks of the source that mention it, in order."""
    pairs = source_entities.select("source_id", "entity_id").distinct()
    seen = mentions.where("chunk_id is not null").select("source_id", "entity_id", "chunk_id").distinct().join(pairs, ["source_id", "entity_id"], "left_semi")
    rows = seen.join(chunks.select(F.col("id").alias("chunk_id"), "content", "chunk_index"), "chunk_id")
    w = Window.partitionBy("source_id", "entity_id").orderBy("chunk_index", "chunk_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("source_id", "entity_id", "place", "chunk_id", "content")


def name_map(resolved: DataFrame, anchors: DataFrame) -> DataFrame:
    """resolved: source_id, place, entity_id, name, raw_name. anchors: source_id, entity_id, name. The entity that each
    spelling means in a source; anchors win, then the later row."""
    spell = lambda df, cols, tier: [
        df.select("source_id", k.alias("key"), "entity_id", F.lit(tier).alias("tier"), "place") for c in cols for k in (F.col(c), tx.normalize_name(F.col(c)))
    ]
    parts = spell(resolved, ["name", "raw_name"], 0) + spell(anchors.withColumn("place", F.lit(0)), ["name"], 1)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.where("key is not null and key <> ''").groupBy("source_id", "key").agg(F.max(F.struct("tier", "place", "entity_id")).alias("b"))
    return best.select("source_id", "key", F.col("b.entity_id").alias("entity_id"))
