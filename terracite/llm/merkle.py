"""Merkle manifest of a dataset by sibling-shift self-joins, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracite.session import cut, pick, small

#: Nodes that one parent stands for.
ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PROOF = "array<struct<before:binary,after:binary>>"


def leaf_hash(*values: Column) -> Column:
    """Hex SHA-256 of the values: ``-`` for null, else UTF-8 byte count, a colon and the value."""
    written = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in written]), 256)


def _hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def _joined(digests: Column) -> Column:
    """Digests of an array, one after the other. (Bytes of a digest are held raw between the levels and hashed as hex.)"""
    return F.aggregate(digests, F.lit(b""), lambda out, d: F.concat(out, d))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (grp, key, digest, tie and others) with idx, the place in the group from 0 by key, and size, the group's rows.

    Rows are dealt out by ranges of group and key; each range counts its own, and the counts of the ranges before give
    every range its start, so that a group of any size is several tasks' work.
    """
    order = ["grp", "key", "digest", "tie"]
    ranged = cut(cut(rows).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = cut(counts.select("grp", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("grp")).alias("size")))
    place = F.row_number().over(Window.partitionBy("part", "grp").orderBy("key", "digest", "tie"))
    return ranged.withColumn("place", place).join(small(starts), ["grp", "part"]).withColumn("idx", F.col("start") + F.col("place") - 1).drop("part", "place", "start", "tie")


def _runs(nodes: DataFrame, arity: int, member: tuple[str, ...]) -> DataFrame:
    """One level: every node computes the index of its sibling at slot zero, by its own slot's offset, and meets it there.

    The self-join and the gathering of a run's members, ``arity`` at most, share one shuffle by group and that index.
    Returns grp, anchor (the index of the run's slot zero), size (nodes of the group at this level) and members, in order.
    """
    shifted = nodes.withColumn("slot", F.col("idx") % arity).withColumn("anchor", F.col("idx") - F.col("slot"))
    zero = shifted.where("slot = 0").select("grp", "anchor", "size")
    met = zero.join(shifted.select("grp", "anchor", F.struct("slot", *member).alias("m")), ["grp", "anchor"])
    return met.groupBy("grp", "anchor").agg(F.first("size").alias("size"), F.array_sort(F.collect_list("m")).alias("members"))


def tree(nodes: DataFrame, arity: int = ARITY, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Folds every group's nodes, ``arity`` consecutive ones at a time, until one node is left.

    nodes: grp, idx (gapless from 0 in the group), size (the group's nodes), digest (bytes) and ``keep``. A group of one
    node is its own top. Going up, slot-zero rows emit the parents; going down again, every run adds to the proof of each
    member what stands before and after it. Only digests travel, and there are as many rounds as the largest group has levels.

    Returns (nodes with grp, idx, digest, keep and proof; tops with grp and digest).
    """
    most = nodes.agg(F.max("size").alias("m")).first()["m"] or 0
    now, levels, tops, member = nodes, [], [], ("digest", *keep)
    while most > 1:
        runs = cut(_runs(now.where("size > 1"), arity, member))
        levels.append((runs, now.where("size = 1").select("grp", "idx", *member)))
        tops.append(now.where("size = 1").select("grp", "digest"))
        parent = F.unhex(F.sha2(_hex(_joined(F.transform("members", lambda m: m["digest"]))), 256))
        now = runs.select("grp", F.expr(f"anchor div {arity}").alias("idx"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"), parent.alias("digest"))
        most, member = -(-most // arity), ("digest",)
    tops.append(now.select("grp", "digest"))
    ended = lambda df: df.withColumn("proof", F.expr(f"cast(array() as {_PROOF})"))
    proofs = ended(now.select("grp", "idx", *(member if levels else ("digest", *keep))))
    for k, (runs, alone) in reversed(list(enumerate(levels))):
        member = ("digest", *keep) if k == 0 else ("digest",)
        above = proofs.select("grp", (F.col("idx") * arity).alias("anchor"), "proof")
        of = F.transform("members", lambda m: m["digest"])
        step = F.struct(_joined(F.slice(of, F.lit(1), F.col("slot"))).alias("before"), _joined(F.slice(of, F.col("slot") + 2, F.lit(arity))).alias("after"))
        each = runs.join(above, ["grp", "anchor"]).select("grp", "anchor", "members", "proof", F.posexplode("members").alias("slot", "m"))
        below = each.select("grp", (F.col("anchor") + F.col("slot")).alias("idx"), *[F.col(f"m.{c}").alias(c) for c in member], F.concat(F.array(step), "proof").alias("proof"))
        proofs = below.unionByName(ended(alone))
    ends = tops[0]
    for t in tops[1:]:
        ends = ends.unionByName(t)
    return proofs, ends


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """The Merkle tree over all rows: a tree for each ``group`` over its leaves by ``key``, and one over the groups' roots.

    A leaf hashes ``fields`` (see ``leaf_hash``); any change of one changes the root. Groups are ordered by UTF-8 bytes,
    null first and a group of its own. Null keys come first; rows of equal key stand by their leaves, and equal rows are leaves of
    their own, interchangeable. Null fields are hashed as nulls, which differ from empty ones. A text of any length is read once, where its leaf
    is made, and never shuffled. Empty table: no rows. Columns that are not named are ignored. ``carry`` adds columns
    computed from the same rows.

    Returns key, group, carried columns, idx (place in the group), leaf, subroot, root (bytes) and proof: for each level from the leaf up to the
    root, the siblings' digests before and after.
    """
    extra = {} if carry is None else carry
    picked = pick(docs, *dict.fromkeys((key, group, *fields)))
    leaves = picked.select(
        F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-")).alias("grp"), F.col(key).alias("key"), F.unhex(leaf_hash(*[F.col(f) for f in fields])).alias("digest"),
        F.struct(F.col(key).alias("key"), F.col(group).alias("group"), *[c.alias(n) for n, c in extra.items()]).alias("row"), F.monotonically_increasing_id().alias("tie"),
    )
    under, subroots = tree(cut(numbered(leaves)), arity, ("row",))
    roots = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest", F.lit(0).alias("tie"))
    over, tops = tree(cut(numbered(roots).select("grp", "idx", "size", "digest", F.col("key").alias("of"))), arity, ("of",))
    ends = over.join(tops.select("grp", F.col("digest").alias("root")), "grp").select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("rest"))
    whole = under.join(small(cut(ends)), "grp")
    return whole.select(
        F.col("row.key").alias(key), F.col("row.group").alias(group), *[F.col(f"row.{n}").alias(n) for n in extra], "idx", F.col("digest").alias("leaf"), "subroot", "root",
        F.concat("proof", "rest").alias("proof"),
    )


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, as hex text."""
    return _hex(F.aggregate(proof, F.lit(b""), lambda out, p: F.concat(out, p["before"], p["after"])))


def folded(leaf: Column, proof: Column) -> Column:
    """The root (hex) to which a leaf (hex) and its proof lead."""
    return F.aggregate(proof, leaf, lambda d, p: F.sha2(F.concat(_hex(p["before"]), d, _hex(p["after"])), 256))


def verified(tampering: str = "crc32(cast(doc_id as string)) % 3 = 0"):
    """A function of documents that makes the manifest and then checks every row against it, as if rows for which
    ``tampering`` holds had had the capital letters A-Z of their text lower-cased since. A null doc_id is not tampered with.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.
    """

    def run(docs: DataFrame) -> DataFrame:
        fields = [F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
        met = F.when(F.expr(tampering), F.unhex(leaf_hash(*fields)))
        made = manifest(docs, carry={"met": met})
        return made.select(
            "doc_id", *[_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"),
            folded(_hex(F.coalesce("met", "leaf")), F.col("proof")).alias("folded_root"),
        ).withColumn("verified", F.col("folded_root") == F.col("root"))

    return run


#: DuckDB has no crc32: it is spelled out, bit by bit, over the digits of doc_id.
MERKLE_SQL = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, lang, source, n_chars, text,
        CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda r, i: xor(r >> 1, (r & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 3 = 0
            THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS met
    FROM documents),
leaves AS (
    SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size,
        {{hash}} AS leaf, {{met}} AS met
    FROM docs),
up(tree, level, idx, size, d) AS (
    SELECT coalesce('=' || lang, '-'), 0, idx, size, leaf FROM leaves
    UNION ALL
    SELECT tree, level + 1, idx // {ARITY}, any_value((size + {ARITY - 1}) // {ARITY}), sha256(string_agg(d, '' ORDER BY idx)) FROM up WHERE size > 1 GROUP BY tree, level, idx // {ARITY}),
subroots AS (SELECT tree AS member, d, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size FROM up WHERE size = 1),
over_(level, idx, size, d) AS (
    SELECT 0, idx, size, d FROM subroots
    UNION ALL
    SELECT level + 1, idx // {ARITY}, any_value((size + {ARITY - 1}) // {ARITY}), sha256(string_agg(d, '' ORDER BY idx)) FROM over_ WHERE size > 1 GROUP BY level, idx // {ARITY}),
runs AS (
    SELECT tree, level, idx // {ARITY} AS run, list(d ORDER BY idx) AS ds, any_value(size) AS size FROM up WHERE size > 1 GROUP BY ALL
    UNION ALL
    SELECT '', level, idx // {ARITY}, list(d ORDER BY idx), any_value(size) FROM over_ WHERE size > 1 GROUP BY ALL),
walk(doc_id, lang, place, tree, level, idx, size, proof, folded) AS (
    SELECT doc_id, lang, idx, coalesce('=' || lang, '-'), 0, idx, size, '', met FROM leaves
    UNION ALL
    SELECT w.doc_id, w.lang, w.place,
        CASE WHEN w.size = 1 THEN '' ELSE w.tree END, CASE WHEN w.size = 1 THEN 0 ELSE w.level + 1 END,
        CASE WHEN w.size = 1 THEN s.idx ELSE w.idx // {ARITY} END, CASE WHEN w.size = 1 THEN s.size ELSE (w.size + {ARITY - 1}) // {ARITY} END,
        CASE WHEN w.size = 1 THEN w.proof ELSE w.proof || array_to_string(r.ds[1:w.idx % {ARITY}], '') || array_to_string(r.ds[w.idx % {ARITY} + 2:], '') END,
        CASE WHEN w.size = 1 THEN w.folded ELSE sha256(array_to_string(r.ds[1:w.idx % {ARITY}], '') || w.folded || array_to_string(r.ds[w.idx % {ARITY} + 2:], '')) END
    FROM walk w
    LEFT JOIN runs r ON w.size > 1 AND r.tree = w.tree AND r.level = w.level AND r.run = w.idx // {ARITY}
    LEFT JOIN subroots s ON w.size = 1 AND s.member = w.tree
    WHERE w.size > 1 OR w.tree <> '')
SELECT l.doc_id, l.leaf, s.d AS subroot, (SELECT d FROM over_ WHERE size = 1) AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root,
    w.folded = (SELECT d FROM over_ WHERE size = 1) AS verified
FROM walk w JOIN leaves l ON w.size = 1 AND w.tree = '' AND l.lang IS NOT DISTINCT FROM w.lang AND l.idx = w.place
JOIN subroots s ON s.member = coalesce('=' || l.lang, '-')
"""


def merkle_sql() -> str:
    def hashed(text: str) -> str:
        values = [f"{f}::VARCHAR" if f != "text" else text for f in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    return MERKLE_SQL.format(hash=hashed("text"), met=hashed("met"))
