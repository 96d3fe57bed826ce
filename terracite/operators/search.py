"""Everything known of entities, and vector search."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracite import vocab
from terracite.functions.text import link_kind, normalize_name
from terracite.operators.filters import active_edges, filter_optional, filter_topics
from terracite.operators.joins import endpoints
from terracite.operators.ranking import role_strength

#: Vectors, and queries, of one task.
PART_ROWS = 20_000


def intel_rows(mentions: DataFrame, source_entities: DataFrame, edges: DataFrame, chunks: DataFrame, few: bool = False) -> DataFrame:
    """Mentions, links and active edges of every entity in one shape: entity_id, source_id, role, kind, evidence, chunk_id, sentiment.

    few: rows of few entities will be asked for. Mentions with a chunk and those without one are then found apart, so that the few may be sent to
    the chunks; a left join would sort all chunks for them.
    """
    none = F.lit(None).cast("string")
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("content").alias("evidence"))
    found = mentions.join(c, "chunk_id", "inner" if few else "left")
    if few:
        found = found.unionByName(mentions.join(found.select("entity_id", "chunk_id"), ["entity_id", "chunk_id"], "left_anti").withColumn("evidence", none))
    seen = found.select("entity_id", "source_id", F.lit("mention").alias("role"), F.lit("mention").alias("kind"), "evidence", "chunk_id", "sentiment")
    linked = source_entities.select("entity_id", "source_id", F.col("link_type").alias("role"), link_kind(F.col("origin")).alias("kind"), "evidence", none.alias("chunk_id"), none.alias("sentiment"))
    related = endpoints(active_edges(edges)).select(
        "entity_id", "source_id", F.lit("related_via_relationship").alias("role"), F.lit("relationship").alias("kind"), F.col("evidence_text").alias("evidence"), none.alias("chunk_id"), none.alias("sentiment")
    )
    return seen.unionByName(linked).unionByName(related)


def entity_intel(mentions: DataFrame, source_entities: DataFrame, edges: DataFrame, sources: DataFrame, chunks: DataFrame, entity_ids: list[str] | None = None, project_id: int | None = None, more: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """Mentions, links and active edges of every entity in one shape.

    Returns entity_id, source_id, source_title, role, kind, evidence, chunk_id, sentiment, conducted_at, created_at, and the columns of sources named in ``more``. few: see ``intel_rows``.
    """
    s = sources if project_id is None else sources.where(F.col("project_id") == project_id)
    s = s.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), "conducted_at", "created_at", *more)
    every = intel_rows(mentions, source_entities, edges, chunks, few)
    if entity_ids is not None:
        every = every.where(F.col("entity_id").isin(*entity_ids))
    return every.join(s, "source_id").select("entity_id", "source_id", "source_title", "role", "kind", "evidence", "chunk_id", "sentiment", "conducted_at", "created_at", *more)


#: Kinds of intel rows, in the order of their names, and the role that goes with one by itself.
KINDS = {"anchor": None, "mention": "mention", "relationship": "related_via_relationship", "source_entity": None}


def best_intel(mentions: DataFrame, source_entities: DataFrame, edges: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """``ranking.best_role`` of ``entity_intel``: one row of each entity in each source.

    Rows lie by source once and are sorted once: the best are picked first, in an order that begins with the source, and only they meet their
    source. Until then a kind is a number, a role that goes with it is left out, and an edge is one row for both its ends. Of a source's id
    that repeats one row counts.
    """
    kinds, number = list(KINDS), {kind: k for k, kind in enumerate(KINDS)}
    none = F.lit(None).cast("string")
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("content").alias("evidence"))
    code = lambda kind: F.lit(number[kind]).cast("byte").alias("kind")
    seen = mentions.join(c, "chunk_id", "left").select("entity_id", none.alias("other_id"), "source_id", none.alias("link"), code("mention"), "evidence", "chunk_id", "sentiment")
    anchor = F.when(link_kind(F.col("origin")) == "anchor", code("anchor")).otherwise(code("source_entity"))
    linked = source_entities.select("entity_id", none.alias("other_id"), "source_id", F.col("link_type").alias("link"), anchor.alias("kind"), "evidence", none.alias("chunk_id"), none.alias("sentiment"))
    related = active_edges(edges).select(
        F.col("source_entity_id").alias("entity_id"), F.col("target_entity_id").alias("other_id"), "source_id", none.alias("link"), code("relationship"), F.col("evidence_text").alias("evidence"), none.alias("chunk_id"), none.alias("sentiment")
    )
    rows = seen.unionByName(linked).unionByName(related).repartition("source_id")
    both = (F.col("kind") == number["relationship"]) & ~F.coalesce(F.col("entity_id") == F.col("other_id"), F.lit(False))
    ends = F.when(both, F.array("entity_id", "other_id")).otherwise(F.array("entity_id"))
    each = rows.select("source_id", F.explode(ends).alias("entity_id"), "link", "kind", "evidence", "chunk_id", "sentiment")
    said = F.element_at(F.array(*[F.lit(role) for role in KINDS.values()]), F.col("kind") + 1)
    w = Window.partitionBy("source_id", "entity_id").orderBy(
        role_strength(F.coalesce(said, "link")), F.asc_nulls_last("evidence"), F.asc_nulls_last("chunk_id"), F.asc_nulls_last("sentiment"), "kind", F.asc_nulls_last("link")
    )
    best = each.withColumn("r", F.row_number().over(w)).where("r = 1")
    best = best.withColumns({"role": F.coalesce(said, "link"), "kind": F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("kind") + 1)})
    s = sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), "conducted_at", "created_at")
    w = Window.partitionBy("source_id").orderBy("created_at", "conducted_at", "source_title")
    one = s.repartition("source_id").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return best.join(one, "source_id").select("entity_id", "source_id", "source_title", "role", "kind", "evidence", "chunk_id", "sentiment", "conducted_at", "created_at")


def anchor_gaps(sources: DataFrame, source_entities: DataFrame) -> DataFrame:
    """Anchors of both kinds that lack their link row."""
    from terracite.operators.joins import anchors_without_link

    return anchors_without_link(sources, source_entities)


def merge_seeds(extracted: DataFrame, seeds: DataFrame) -> DataFrame:
    """extracted: source_id, raw_name, canonical_name, type. Adds a reviewer's seeds (source_id, name, type) whose name
    the extraction has neither as raw nor as canonical name; repeats among the seeds count once."""
    keys = extracted.select("source_id", normalize_name(F.col("raw_name")).alias("k")).unionByName(extracted.select("source_id", normalize_name(F.col("canonical_name")).alias("k")))
    new = seeds.withColumn("k", normalize_name(F.col("name"))).where("k <> ''").join(keys.distinct(), ["source_id", "k"], "left_anti")
    one = new.groupBy("source_id", "k").agg(F.min(F.struct("name", "type")).alias("s")).select("source_id", F.col("s.name").alias("raw_name"), F.col("s.name").alias("canonical_name"), F.col("s.type").alias("type"))
    return extracted.select("source_id", "raw_name", "canonical_name", "type").unionByName(one)


def union_positions(person_rows: DataFrame, org_rows: DataFrame) -> DataFrame:
    """Rows of both, one for each id, those of persons first."""
    return person_rows.unionByName(org_rows.join(person_rows.select("id"), "id", "left_anti")).dropDuplicates(["id"])


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hybrid_search(
    chunks: DataFrame, query_vectors: DataFrame, projects: DataFrame | None = None, project_ids: list[int] | None = None, country: str | None = None,
    topics: list[str] | None = None, threshold: float = 0.7, k: int = 10,
) -> DataFrame:
    """The k nearest chunks of each query by cosine, above the threshold, among those that the filters leave.

    query_vectors: query_id, embedding: a batch of questions. Queries and chunks are dealt into parts of bounded size, each part of one meets
    each part of the other once, and keeps its own k best of a query before anything is shuffled. Every pair is compared, so the work is the
    product of both sizes. Null vectors and those of length zero are left out.

    Returns query_id, rank, id, similarity.
    """
    from terracite.operators.joins import in_country

    rows = filter_topics(filter_optional(chunks, project_id=project_ids), topics).where("embedding is not null")
    if country is not None:
        rows = in_country(rows, projects, country)
    rows = rows.select("id", "embedding", _norm(F.col("embedding")).alias("n")).where("n > 0")
    asked = query_vectors.where("embedding is not null").select("query_id", F.col("embedding").alias("q"), _norm(F.col("embedding")).alias("qn")).where("qn > 0")
    near = _nearest(rows, asked, k, threshold).withColumn("similarity", F.round("similarity", 6)).where(F.col("similarity") > threshold)
    whole = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return near.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def _nearest(rows: DataFrame, asked: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """rows: id, embedding, n. asked: query_id, q, qn. For each query (query_id, id, similarity) at least its k best of each part of the
    rows, by the similarity rounded to six digits; where both have hashes (``h``), only of rows that share one but for a bit at most.

    Rows and queries are dealt into parts of bounded size, and each pair of parts is one task's product of matrices. That product only says which
    pairs may be among the best; those are summed again in the order of the vector, as Spark sums them.
    """
    parts = [-(-df.count() // PART_ROWS) for df in (asked, rows)]
    blocks, pieces = max(1, parts[0]), max(16, parts[1])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = asked.withColumns({"d": F.size("q"), "block": of("query_id", blocks)}).withColumn("piece", each(pieces))
    r = rows.withColumns({"d": F.size("embedding"), "piece": of("id", pieces)}).withColumn("block", each(blocks))
    hashed, kinds = "h" in rows.columns, (asked.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString())

    def best(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": some["query_id"][:0], "id": held["id"][:0], "similarity": np.zeros(0)})]
        if len(some) and len(held) and k > 0:
            q, v = (np.stack(c.tolist()).astype(np.float64) for c in (some["q"], held["embedding"]))
            qn, n, ids, whose = some["qn"].to_numpy(), held["n"].to_numpy(), held["id"].to_numpy(), some["query_id"].to_numpy()
            hq, hv = (np.stack(c.tolist()) for c in (some["h"], held["h"])) if hashed else (None, None)
            with np.errstate(all="ignore"):
                for low in range(0, len(q), 128):
                    some_q = slice(low, low + 128)
                    about = (q[some_q] @ v.T) / (qn[some_q, None] * n)
                    about[np.isnan(about)] = np.inf
                    if hashed:
                        met = np.zeros(about.shape, dtype=bool)
                        for t in range(hv.shape[1]):
                            met |= np.bitwise_count(hq[some_q, t, None] ^ hv[None, :, t]) <= 1
                        about[~met] = -np.inf
                    least = np.partition(about, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))] - 3e-6
                    at, place = np.nonzero((about >= np.maximum(least, -2.0 if threshold is None else threshold - 3e-6)[:, None]) & (about > -np.inf))
                    dot = np.zeros(len(at))
                    for d in range(q.shape[1]):
                        dot += v[place, d] * q[at + low, d]
                    found = pd.DataFrame({"query_id": whose[at + low], "id": ids[place], "similarity": dot / (n[place] * qn[at + low])})
                    # Of equal similarities the smallest ids are best, so copies without end are no load.
                    out.append(found.sort_values(["query_id", "similarity", "id"]).groupby(["query_id", "similarity"], dropna=False).head(k))
        return pd.concat(out)

    keys = ["d", "block", "piece"]
    return a.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(best, f"query_id {kinds[0]}, id {kinds[1]}, similarity double")


def citations(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Retrieved chunks (question_id, rank, chunk_id, similarity) with their relevance in per cent and whether the
    answer's text (question_id, answer) cites their number."""
    cited = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    joined = hits.join(answers.select("question_id", cited.alias("cited")), "question_id", "left")
    used = F.coalesce(F.array_contains("cited", F.col("rank")), F.lit(False))
    return joined.select("question_id", F.col("rank").alias("position"), "chunk_id", F.round(F.col("similarity") * 100).cast("int").alias("relevance"), used.alias("used_in_text"))


def missing_embeddings(chunks: DataFrame) -> DataFrame:
    return chunks.where("embedding is null")


def ann_search(chunks: DataFrame, query_vectors: DataFrame, k: int = 10, tables: int = 12, bits: int = 6, seed: int = 5) -> DataFrame:
    """Approximate nearest chunks: vectors that fall on the same side of ``bits`` random planes, but for one at most, in
    one of ``tables`` hash tables are compared. Planes come from a hash, so that runs agree.

    Each query looks into its own bucket of a table and the ``bits`` buckets that differ in one bit. Which pairs share one is told from their
    hashes where parts of both meet, so no pair is shuffled. Returns query_id, rank, id, similarity; recall depends on tables and bits (see the tests).
    """

    def signed(v: Column, t: int) -> Column:
        side = lambda b: F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (F.pmod(F.xxhash64(F.lit(seed), F.lit(t), F.lit(b), i), F.lit(2001)) - 1000)), F.lit(0.0), lambda s, x: s + x) > 0
        return functools.reduce(Column.bitwiseOR, [F.when(side(b), 1 << b).otherwise(0) for b in range(bits)])

    def hashed(df: DataFrame, name: str, v: str, n: str) -> DataFrame:
        at = F.array(*[signed(F.col(v), t).cast("int") for t in range(tables)])
        return df.select(name, F.col("embedding").alias(v)).where(F.col(v).isNotNull()).select(name, v, _norm(F.col(v)).alias(n), at.alias("h")).where(F.col(n) != 0)

    near = _nearest(hashed(chunks, "id", "embedding", "n"), hashed(query_vectors, "query_id", "q", "qn"), k)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


def bigram_best(queries: DataFrame, entities: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The entity whose name is most like each query (query_id, name) by bigrams."""
    from terracite.operators.aggregates import best_candidate
    from terracite.operators.joins import gram_join

    scored = gram_join(
        queries.select(F.col("query_id").alias("left_id"), F.lower("name").alias("name")), entities.select(F.col("id").alias("right_id"), F.lower("name").alias("name")), threshold, [], 2
    )
    return best_candidate(scored.select(F.col("left_id").alias("mention_id"), F.col("right_id").alias("entity_id"), "score"))
