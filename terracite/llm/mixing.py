"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracite.session import cut, pick, small

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one bucket of ranks holds, about.
BUCKET = 4096
#: Steps in which weights of documents count, to 1, and the largest weight in such steps.
STEPS, HEAVIEST = 100, 1_000_000


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes with source_id, the place of each source by code point (null last) from 1: places in ranges and range totals."""
    ranged = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each shuffle partition
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("place", place).join(F.broadcast(before), "part").withColumn("source_id", (F.col("before") + F.col("place")).cast("int")).drop("part", "place", "before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Target words of each source: ``weights``, repeating over the sources by code point (null last), share all words.

    A target stops at ``most`` times its source's words and the excess goes to the other sources by weight. That is a
    common level per unit of weight, cut off at each source's cap: the level rises, by sums over all sources, until no
    further source is above its cap.

    sizes: source, source_size (one row for each source). Returns source_id, source, source_size, target.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_id") - 1) % len(weights) + 1)
    ranked = cut(numbered(sizes).withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most))
    level, capped = None, -1
    over = F.lit(False)
    while True:
        state = ranked.agg(
            F.sum("source_size").cast("double").alias("total"), F.sum(F.when(over, F.col("cap"))).alias("held"),
            F.sum(F.when(~over, F.col("weight"))).alias("heavy"), F.sum(over.cast("int")).alias("capped"),
        ).first()
        if state["capped"] == capped or not state["heavy"]:
            break
        capped, level = state["capped"], (state["total"] - (state["held"] or 0.0)) / state["heavy"]
        over = F.col("weight") * F.lit(level) >= F.col("cap")
    common = F.lit(level).cast("double")
    return ranked.select("source_id", "source", "source_size", F.when(over, F.col("cap")).otherwise(F.col("weight") * common).alias("target"))


def first_fit(rows: DataFrame, gaps: DataFrame, n_sources: int) -> DataFrame:
    """The rows that are no larger than their source's gap, with goes: whether they and all before them in the order of
    ranks, together, fit into it.

    (source, bucket of ranks) sums find the one bucket in which the gap runs out, and only that bucket is sorted.

    rows: row, source_id, bucket, ratio, doc_id, size and others; gaps: source_id, gap.
    """
    fits = rows.join(small(gaps, n_sources), "source_id").where(F.col("size") <= F.col("gap"))
    upto = Window.partitionBy("source_id").orderBy("bucket")
    sums = fits.groupBy("source_id", "bucket").agg(F.sum("size").alias("words"), F.max("gap").alias("gap"))
    cuts = (
        sums.withColumn("after", F.sum("words").over(upto))
        .where(F.col("after") > F.col("gap"))
        .groupBy("source_id")
        .agg(F.min(F.struct("bucket", (F.col("after") - F.col("words")).alias("before"))).alias("at"))
    )
    split = fits.join(small(cuts, n_sources), "source_id", "left")
    in_order = Window.partitionBy("source_id").orderBy("ratio", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = split.where(F.col("bucket") == F.col("at.bucket")).withColumn("goes", F.col("at.before") + F.sum("size").over(in_order) <= F.col("gap"))
    others = split.where(F.col("at").isNull() | (F.col("bucket") != F.col("at.bucket"))).withColumn("goes", F.col("at").isNull() | (F.col("bucket") < F.col("at.bucket")))
    return cut(others.unionByName(at_edge).drop("at"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 42, weight_col: str | None = None) -> DataFrame:
    """How many copies of each document a mix takes so that each source's words come near its target.

    Documents have unequal odds. A document weighs 1 / sqrt(words + 100), so that a mix is not made of a few very long
    ones, or its ``weight_col`` (counted in steps of 1 / STEPS, up to HEAVIEST steps). Its expected copies are its weight times its
    source's rate, at most ``most``; the rate is the one at which the source's expected words are its target. The whole
    copies are certain. The rest p is the inclusion probability of one more copy: with u uniform in (0, 1) by a hash of
    seed, doc_id and text, documents are ranked by the Pareto ratio (u / (1 - u)) / (p / (1 - p)) and taken in that order,
    past any that do not fit into the source's remaining words, until none is left that fits. Documents are taken whole.

    Ranks are global to a source but no source is sorted as a whole: see ``first_fit``, which goes on in rounds, each with the
    documents that still fit. Every round takes the first document that does, so the rounds end. Reruns agree, as
    nothing depends on the layout of the input.

    Null text: 0 words, taken 0. A null source is a source of its own, the last. Null doc_id and repeated rows are
    rows like others (equal rows are interchangeable). A source without words has target 0. An empty table gives no
    rows. Null or negative document weights count as 0. Other columns are ignored.

    Returns doc_id, size, source_size, target, taken (size times copies), copies, source, text_hash.
    """
    word_count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary"))
    given = F.least(F.lit(float(HEAVIEST)), F.greatest(F.coalesce(F.col(weight_col or "doc_id").cast("double"), F.lit(0.0)), F.lit(0.0)) * STEPS)
    own = F.round(given) if weight_col else F.floor(F.lit(10_000.0) / F.sqrt((F.col("size") + 100).cast("double")))
    needed = ["doc_id", "text", "source"] + ([weight_col] if weight_col else [])
    base = cut(
        pick(docs, *needed)
        .withColumn("size", word_count)
        .select(
            "doc_id",
            "source",
            F.xxhash64("text").alias("text_hash"),
            "size",
            ((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)).alias("u"),
            own.cast("long").alias("own"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    # Few rows for each source: its words by weight of document.
    heavy = cut(base.groupBy("source", "own").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")))
    sums = cut(heavy.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows")))
    n_sources = sums.count()
    placed = source_targets(sums.select("source", "source_size"), weights, most).alias("t")
    by_weight = heavy.alias("h").join(placed, F.col("h.source").eqNullSafe(F.col("t.source"))).select("t.source_id", "t.target", "h.own", "h.words")
    heavier = Window.partitionBy("source_id").orderBy(F.desc("own")).rowsBetween(Window.unboundedPreceding, -1)
    lighter = Window.partitionBy("source_id").orderBy(F.desc("own")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("target") - float(most) * F.coalesce(F.sum("words").over(heavier), F.lit(0))
    rates = (
        by_weight.withColumn("rate", left / F.nullif(F.sum(F.col("words") * F.col("own")).over(lighter).cast("double"), F.lit(0.0)))
        .groupBy(F.col("source_id").alias("rated"))
        .agg(F.max_by("rate", F.when(F.col("rate") * F.col("own") <= float(most), F.col("own"))).alias("rate"))
    )
    targets = cut(
        placed.join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).join(rates, F.col("t.source_id") == F.col("rated")).select("t.*", "s.rows", "rate")
    )
    expected = F.when(F.col("b.own") == 0, 0.0).otherwise(F.least(F.lit(float(most)), F.coalesce(F.col("t.rate") * F.col("b.own"), F.lit(float(most)))))
    known = (
        base.alias("b")
        .join(small(targets).alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("b.*", "t.source_id", "t.source_size", "t.target", "t.rows", expected.alias("expected"))
        .withColumn("sure", F.floor("expected").cast("long"))
        .withColumn("p", F.col("expected") - F.col("sure"))
        .withColumn("ratio", F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("bucket", F.floor(F.col("ratio") / (1 + F.col("ratio")) * (1 + F.floor(F.col("rows") / BUCKET))))
        .drop("rows", "u", "own", "expected")
    )
    may = F.coalesce((F.col("p") > 0) & (F.col("size") > 0), F.lit(False))
    gaps = cut(known.groupBy("source_id").agg((F.first("target") - F.sum(F.col("size") * F.col("sure"))).alias("gap")))
    large = known.where(may).join(small(gaps, n_sources), "source_id").where(F.col("size") > F.col("gap")).drop("gap")
    marked = first_fit(known.where(may), gaps, n_sources)
    rest, further = marked.where("not goes").select("row", "source_id", "bucket", "ratio", "doc_id", "size"), None
    turn = marked
    while not turn.where("goes").isEmpty():
        gaps = turn.groupBy("source_id").agg((F.max("gap") - F.sum(F.when(F.col("goes"), F.col("size")).otherwise(0))).alias("gap"))
        turn = first_fit(rest, gaps, n_sources)
        now = turn.where("goes").select("row")
        further = now if further is None else further.unionByName(now)
        rest = turn.where("not goes").drop("goes", "gap")
    plain = known.where(~may).unionByName(large).withColumn("goes", F.lit(False))
    whole = plain.unionByName(marked.drop("gap")).withColumn("more", F.col("goes").cast("int"))
    if further is not None:
        whole = whole.join(small(further).withColumn("further", F.lit(1)), "row", "left").withColumn("more", F.col("more") + F.coalesce("further", F.lit(0)))
    copies = F.col("sure") + F.col("more")
    return whole.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source", "text_hash")


def mixed_documents(docs: DataFrame, columns: tuple[str, ...], **rules: int) -> DataFrame:
    """The columns of the documents, each row as often as ``mix_sources`` takes it.

    The copies come back to the texts by doc_id, source and a hash of the text. Rows equal in all three are one row
    with the sum of their copies, so they are never multiplied with each other; only such rows are shuffled with their texts to
    make them one. A null text has no words, so it is never taken; nor is a source without words. An empty table gives no rows.
    """
    key = lambda: F.concat_ws(":", F.col("doc_id"), F.col("text_hash"), F.col("source"), F.col("source").isNull())
    docs = pick(docs, *columns).withColumn("text_hash", F.xxhash64("text")).withColumn("row_key", key())
    mixed = cut(mix_sources(docs, **rules).select("copies", key().alias("row_key")))
    copies = cut(mixed.groupBy("row_key").agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("n")))
    taken = docs.join(small(copies.where("copies > 0").select("row_key", "copies")), "row_key")
    again = small(cut(copies.where("n > 1").select("row_key")))
    one = taken.join(again, "row_key", "left_anti").unionByName(taken.join(again, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*columns)


#: The rows of ``mix_sources`` with its default parameters, over the view ``documents``, in DuckDB SQL.
MIX_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_id FROM base GROUP BY source),
ranked AS (SELECT *, [5.0, 2.0, 1.0][1 + (source_id - 1) % 3] :: DOUBLE AS weight, 3.0 :: DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM sums),
levelled AS (
  SELECT *, row_number() OVER w AS place, (total - coalesce(sum(cap) OVER e, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) AS level
  FROM ranked WINDOW w AS (ORDER BY cap / weight, source_id), e AS (ORDER BY cap / weight, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT arg_min(level, place) AS common, min(place) AS free_from FROM levelled WHERE level * weight < cap),
targets AS (SELECT source_id, source, source_size, CASE WHEN place >= free_from THEN weight * common ELSE cap END AS target FROM levelled LEFT JOIN free ON true),
weighed AS (
  SELECT b.*, t.source_id, t.source_size, t.target, CAST(floor(10000.0 :: DOUBLE / sqrt(CAST(size + 100 AS DOUBLE))) AS BIGINT) AS own
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
heavy AS (SELECT source_id, target, own, CAST(sum(size) AS BIGINT) AS words, CAST(sum(size * own) AS DOUBLE) AS heft FROM weighed GROUP BY ALL),
rated AS (
  SELECT source_id, own, (target - 3.0 :: DOUBLE * coalesce(CAST(sum(words) OVER (PARTITION BY source_id ORDER BY own DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
         / nullif(sum(heft) OVER (PARTITION BY source_id ORDER BY own DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rate FROM heavy),
rates AS (SELECT source_id, arg_max(rate, own) AS rate FROM rated WHERE rate * own <= 3 GROUP BY source_id),
known AS (SELECT *, CASE WHEN own = 0 THEN 0 ELSE least(3.0 :: DOUBLE, coalesce(rate * own, 3.0 :: DOUBLE)) END AS expected FROM weighed LEFT JOIN rates USING (source_id)),
sure AS (SELECT *, CAST(floor(expected) AS BIGINT) AS sure, expected - floor(expected) AS p, row_number() OVER () AS row FROM known),
odds AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS ratio, target - sum(size * sure) OVER (PARTITION BY source_id) AS wanted FROM sure),
dealt AS (SELECT row, source_id, size, wanted, row_number() OVER o AS pos, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
          FROM odds WHERE p > 0 AND size > 0 WINDOW o AS (PARTITION BY source_id ORDER BY ratio, doc_id, size)),
ended AS (SELECT source_id, min(pos) AS pos, any_value(wanted) AS wanted FROM dealt WHERE upto > wanted GROUP BY source_id),
chain AS (
  SELECT e.source_id, e.pos, CAST(NULL AS BIGINT) AS row, CAST(wanted - coalesce((SELECT max(d.upto) FROM dealt d WHERE d.source_id = e.source_id AND d.pos < e.pos), 0) AS DOUBLE) AS gap FROM ended e
  UNION ALL
  SELECT source_id, pos, row, gap FROM (
    SELECT c.source_id, d.pos, d.row, c.gap - d.size AS gap, row_number() OVER (PARTITION BY c.source_id ORDER BY d.pos) AS first
    FROM chain c JOIN dealt d ON d.source_id = c.source_id AND d.pos > c.pos AND d.size <= c.gap) WHERE first = 1),
more AS (SELECT d.row FROM dealt d LEFT JOIN ended e USING (source_id) WHERE e.pos IS NULL OR d.pos < e.pos UNION ALL SELECT row FROM chain WHERE row IS NOT NULL),
placed AS (SELECT o.*, sure + CASE WHEN m.row IS NULL THEN 0 ELSE 1 END AS copies FROM odds o LEFT JOIN more m USING (row))
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, source
FROM placed
"""
