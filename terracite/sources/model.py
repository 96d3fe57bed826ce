"""The knowledge-base tables as views of the driver's tables, in DataFrames and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracite.functions.text import normalize_name

#: Above every confidence in 1/10,000 and every tax in 1/100 of the tables.
TOP, TAXES = 10_000_000, 1_000_000


class Model:
    """Every table of the data model, each built when first asked for.

    All are lazy selections and aggregates over the parquet tables in ``sf_dir``; only the columns used are read.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def projects(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(  # five regions
            F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"),
            F.col("n_regionkey").cast("long").alias("tenant_id"),
        )

    @cached_property
    def members(self) -> DataFrame:
        rank = F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(3)
        best = self.table("customer").groupBy((F.col("c_custkey") % 20).alias("user_id"), F.col("c_nationkey").cast("long").alias("project_id")).agg(F.min(rank).alias("r"))
        return best.select("user_id", "project_id", F.element_at(F.array(F.lit("owner"), F.lit("editor"), F.lit("viewer")), F.col("r")).alias("role"))

    @cached_property
    def entities(self) -> DataFrame:
        def part(table: str, letter: str, key: str, name: str, kind: str, scope: Column, canonical: Column, about: Column) -> DataFrame:
            return self.table(table).select(
                F.concat(F.lit(letter), F.col(key)).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"), scope.cast("long").alias("project_id"),
                normalize_name(F.col(name)).alias("normalized_name"), canonical.cast("string").alias("canonical_entity_id"), about.cast("string").alias("description"),
                (F.lit("2020-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col(key).cast("decimal(18,6)"))).alias("created_at"),
            )

        none = F.lit(None)
        chain = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("P"), F.col("p_partkey") - 1))
        return (
            part("customer", "C", "c_custkey", "c_name", "COMPANY", F.col("c_nationkey"), none, none)
            .unionByName(part("supplier", "S", "s_suppkey", "s_name", "ORGANIZATION", F.col("s_nationkey"), none, none))
            .unionByName(part("part", "P", "p_partkey", "p_name", "PRODUCT", none, chain, F.col("p_type")))
            .unionByName(part("nation", "N", "n_nationkey", "n_name", "COUNTRY", none, none, none))
        )

    @cached_property
    def aliases(self) -> DataFrame:
        p = self.table("part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("entity_id"), F.concat_ws(" ", "p_brand", "p_name").alias("alias"), F.lit(None).cast("long").alias("scope"))
        c = self.table("customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("entity_id"), F.translate("c_name", "#", " ").alias("alias"), F.col("c_nationkey").cast("long").alias("scope"))
        return p.unionByName(c).withColumn("alias_normalized", normalize_name(F.col("alias"))).withColumn("confidence", F.lit(1.0))

    @cached_property
    def sources(self) -> DataFrame:
        orders = self.table("orders")
        customer = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "EMBEDDING").otherwise("FAILED")
        return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
            F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("long").alias("project_id"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
            status.alias("status"), F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderdate")).alias("conducted_at"),
            F.col("o_orderdate").alias("created_at"), F.array("o_orderpriority", "c_mktsegment").alias("topics"),
            F.concat(F.lit("C"), F.col("o_custkey")).alias("interviewee_entity_id"),
            F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("N"), F.col("c_nationkey"))).alias("interviewee_org_entity_id"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def mentions(self) -> DataFrame:
        return self._mentions(repeats=False)

    @cached_property
    def repeated_mentions(self) -> DataFrame:
        """Mentions of which some may be equal, for what does not count them: nothing is shuffled."""
        return self._mentions(repeats=True)

    def _mentions(self, repeats: bool) -> DataFrame:
        # distinct over numbers; the texts are made from what is left
        flag = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
        found = self.lines.select("l_partkey", "l_orderkey", F.when(F.col("l_returnflag") != "A", F.col("l_linenumber")).alias("line"), flag.alias("flag"))
        found = found if repeats else found.distinct()
        return found.select(
            F.concat(F.lit("P"), F.col("l_partkey")).alias("entity_id"), F.col("l_orderkey").alias("source_id"),
            F.when(F.col("line").isNotNull(), F.concat_ws("-", "l_orderkey", "line")).alias("chunk_id"),
            F.when(F.col("flag") == 1, "negative").when(F.col("flag") == 2, "neutral").otherwise("positive").alias("sentiment"),
        )

    @cached_property
    def chunks(self) -> DataFrame:
        first = self.lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("partkey"))
        part = self.table("part").select("p_partkey", "p_name")
        return first.join(part, first["partkey"] == part["p_partkey"]).select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("source_id"),
            F.concat(F.col("p_name"), F.lit(" shipped")).alias("content"), F.col("l_linenumber").cast("long").alias("chunk_index"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        # The best line of a key is the smallest of one number, so the aggregate runs on fixed-width values throughout:
        # highest confidence (in 1/10,000), then lowest tax (in 1/100), then status and origin by name.
        status = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 0).otherwise(1)
        origin = F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
        less, tax = TOP - F.round(F.col("l_discount") * 100_000).cast("long"), F.round(F.col("l_tax") * 100).cast("long")
        raw = self.lines.select(
            "l_suppkey", "l_partkey", (F.col("l_linenumber") % 4).alias("kind"), "l_orderkey", ((less * TAXES + tax) * 8 + status * 2 + origin).alias("code"),
        )
        one = raw.groupBy("l_suppkey", "l_partkey", "kind", "l_orderkey").agg(F.min("code").alias("code"))
        kind = F.element_at(F.array(*[F.lit(v) for v in ("manufactured_by", "supplier", "customer_of", "ally")]), F.col("kind") + 1)
        keys = ["source_entity_id", "target_entity_id", "relation_type", "source_id"]
        named = one.select(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias(keys[0]), F.concat(F.lit("P"), F.col("l_partkey")).alias(keys[1]), kind.alias(keys[2]),
            F.col("l_orderkey").alias(keys[3]), F.expr(f"code div {8 * TAXES}").alias("less"), F.expr(f"code div 8 % {TAXES}").alias("tax"), (F.col("code") % 8).alias("rest"),
        )
        return named.select(
            F.concat_ws("|", *keys).alias("id"), *keys, ((TOP - F.col("less")) / 10_000.0).alias("confidence"),
            F.when(F.col("tax") != 0, F.concat(F.lit("tax "), F.col("tax"))).alias("evidence_text"),
            F.when(F.col("rest") < 2, "approved").when(F.col("rest") < 4, "pending").otherwise("rejected").alias("review_status"),
            F.when(F.col("rest") % 2 == 1, "llm").otherwise("human_edited").alias("origin"),
        )

    @cached_property
    def source_entities(self) -> DataFrame:
        found = (
            self.lines.groupBy("l_orderkey", "l_suppkey", (F.col("l_linenumber") % 2 == 1).alias("odd"))
            .agg(F.round(F.max(1 - 2 * F.col("l_tax")), 4).alias("confidence"), F.min("l_shipdate").alias("created_at"))
            .select(
                F.col("l_orderkey").alias("source_id"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("entity_id"),
                F.when(F.col("odd"), "author").otherwise("primary_subject").alias("link_type"), "confidence", "created_at",
                F.lit("extraction").alias("origin"), (F.col("confidence") >= 0.98).alias("is_primary"), F.concat(F.lit("quote S"), F.col("l_suppkey")).alias("evidence"),
            )
        )
        anchors = self.table("orders").where("o_orderkey % 2 = 0").select(
            F.col("o_orderkey").alias("source_id"), F.concat(F.lit("C"), F.col("o_custkey")).alias("entity_id"), F.lit("interviewee").alias("link_type"),
            F.lit(None).cast("double").alias("confidence"), F.col("o_orderdate").alias("created_at"), F.lit("upload_anchor").alias("origin"),
            F.lit(True).alias("is_primary"), F.lit(None).cast("string").alias("evidence"),
        )
        return anchors.unionByName(found)

    @cached_property
    def positions(self) -> DataFrame:
        last = self.lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
        orders = self.table("orders").join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        state = F.when(F.col("o_orderstatus") == "F", "ended").when(F.col("o_orderstatus") == "O", "active").otherwise("pending_review")
        precision = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unknown").otherwise("exact")
        rows = orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), F.col("o_custkey")).alias("person_id"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("org_id"),
            F.col("o_orderpriority").alias("title"), state.alias("state"), F.col("o_orderdate").cast("date").alias("valid_from_date"), precision.alias("valid_from_precision"),
            F.when(F.col("o_orderstatus") == "F", F.col("shipped").cast("date")).alias("valid_to_date"), precision.alias("valid_to_precision"),
            F.col("o_orderdate").alias("validated_at"),
        )
        main = rows.where("state = 'active'").groupBy("person_id").agg(F.max(F.struct("validated_at", "id")).alias("m")).select("person_id", F.col("m.id").alias("main_id"))
        return rows.join(main, "person_id", "left").withColumn("is_main", F.coalesce(F.col("id") == F.col("main_id"), F.lit(False))).drop("main_id")

    @cached_property
    def vectors(self) -> DataFrame:
        topics = F.when(F.col("vec_id") % 10 != 0, F.array(F.col("label").cast("string")))
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", topics.alias("topics"), (F.col("vec_id") % 25).alias("project_id"))

    @cached_property
    def utterances(self) -> DataFrame:
        speaker = F.when(F.expr("(turn div 2) % 2 = 0"), "A").otherwise("B")
        return self.table("conversations").select(
            F.col("conv_id").alias("source_id"), "turn", speaker.alias("speaker"), "text", (F.col("turn") * 5000).cast("double").alias("start"),
            (F.col("turn") * 5000 + 4000).cast("double").alias("end"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("source_id"), "text", (F.col("doc_id") % 25).alias("project_id"), F.col("lang").alias("country"))

    @cached_property
    def deals(self) -> DataFrame:
        open_stage = F.element_at(F.array(*[F.lit(v) for v in ("lead", "qualified", "proposal", "negotiation")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
        stage = F.when(F.col("o_orderstatus") == "F", "closed_won").when(F.col("o_orderstatus") == "P", "closed_lost").otherwise(open_stage)
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        paid = F.when(F.col("o_orderkey") % 2 == 0, F.expr("cast(round(o_totalprice * 100) as long) * 6 div 10")).otherwise(cents)
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), cents.cast("string").alias("amount"), paid.cast("string").alias("amount_paid"), stage.alias("stage"),
            F.when(F.col("o_orderkey") % 7 == 0, "barter").alias("deal_type"),
        )

    @cached_property
    def status_events(self) -> DataFrame:
        names = {"signup": "UPLOADING", "view": "PROCESSING", "click": "EXTRACTING", "purchase": "COMPLETED", "error": "FAILED"}
        status = F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("event_type"))
        return self.table("events").select("event_id", F.col("user_id").alias("source_id"), status.alias("status"), "ts")

    @cached_property
    def extracted_edges(self) -> DataFrame:
        """Edges as a model would name them: by entity names, with self-edges, unknown types and low confidence planted."""
        s, p = self.table("supplier").select("s_suppkey", "s_name"), self.table("part").select("p_partkey", "p_name")
        kind = F.element_at(F.array(*[F.lit(v) for v in ("manufactured_by", "supplier", "customer_of", "knows")]), F.col("l_linenumber") % 4 + 1)
        return self.lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("source_id"), F.col("s_name").alias("source_name"), F.when(F.col("l_linenumber") == 7, F.lower("s_name")).otherwise(F.col("p_name")).alias("target_name"),
            kind.alias("relation_type"), F.round(F.col("l_discount") * 10, 4).alias("confidence"),
            F.when(F.col("l_tax") != 0, F.concat(F.lit(" tax "), F.round(F.col("l_tax") * 100).cast("int"))).alias("evidence_text"),
        )


#: The same tables as common table expressions of DuckDB SQL.
SQL = r"""
projects AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_name AS country, r_name AS region, CAST(n_regionkey AS BIGINT) AS tenant_id FROM nation JOIN region ON n_regionkey = r_regionkey),
members AS (SELECT c_custkey % 20 AS user_id, CAST(c_nationkey AS BIGINT) AS project_id,
  ['owner','editor','viewer'][min(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END)] AS role FROM customer GROUP BY 1, 2),
named AS (
  SELECT 'C' || c_custkey AS id, c_name AS name, 'COMPANY' AS type, CAST(c_nationkey AS BIGINT) AS project_id, CAST(NULL AS VARCHAR) AS canonical_entity_id, CAST(NULL AS VARCHAR) AS description, c_custkey AS k FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'ORGANIZATION', s_nationkey, NULL, NULL, s_suppkey FROM supplier
  UNION ALL SELECT 'P' || p_partkey, p_name, 'PRODUCT', NULL, CASE WHEN p_partkey % 4 <> 0 THEN 'P' || (p_partkey - 1) END, p_type, p_partkey FROM part
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'COUNTRY', NULL, NULL, NULL, n_nationkey FROM nation),
entities AS (SELECT id, name, type, project_id, trim(regexp_replace(lower(trim(name)), '[!-/:-@\[-`{-~\s]+', ' ', 'g')) AS normalized_name, canonical_entity_id, description,
  TIMESTAMP '2020-01-01' + to_seconds(k) AS created_at FROM named),
aliases AS (SELECT *, trim(regexp_replace(lower(trim(alias)), '[!-/:-@\[-`{-~\s]+', ' ', 'g')) AS alias_normalized, 1.0 :: DOUBLE AS confidence FROM (
  SELECT 'P' || p_partkey AS entity_id, p_brand || ' ' || p_name AS alias, CAST(NULL AS BIGINT) AS scope FROM part
  UNION ALL SELECT 'C' || c_custkey, replace(c_name, '#', ' '), c_nationkey FROM customer)),
sources AS (SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS project_id, 'Order ' || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'EMBEDDING' ELSE 'FAILED' END AS status,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate END AS conducted_at, o_orderdate AS created_at, [o_orderpriority, c_mktsegment] AS topics,
  'C' || o_custkey AS interviewee_entity_id, CASE WHEN o_orderkey % 3 = 0 THEN 'N' || c_nationkey END AS interviewee_org_entity_id FROM orders JOIN customer ON o_custkey = c_custkey),
mentions AS (SELECT DISTINCT 'P' || l_partkey AS entity_id, l_orderkey AS source_id, CASE WHEN l_returnflag <> 'A' THEN l_orderkey || '-' || l_linenumber END AS chunk_id,
  CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'neutral' ELSE 'positive' END AS sentiment FROM lineitem),
chunks AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey AS source_id, p_name || ' shipped' AS content, CAST(l_linenumber AS BIGINT) AS chunk_index
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS partkey FROM lineitem GROUP BY 1, 2) JOIN part ON partkey = p_partkey),
edges AS (SELECT source_entity_id || '|' || target_entity_id || '|' || relation_type || '|' || source_id AS id, source_entity_id, target_entity_id, relation_type, source_id,
  conf AS confidence, CASE WHEN tax <> 0 THEN 'tax ' || CAST(round(tax * 100) AS INT) END AS evidence_text, review_status, origin FROM (
  SELECT 'S' || l_suppkey AS source_entity_id, 'P' || l_partkey AS target_entity_id, ['manufactured_by','supplier','customer_of','ally'][l_linenumber % 4 + 1] AS relation_type, l_orderkey AS source_id,
    round(l_discount * 10, 4) AS conf, l_tax AS tax, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'approved' ELSE 'pending' END AS review_status, CASE l_linestatus WHEN 'F' THEN 'llm' ELSE 'human_edited' END AS origin FROM lineitem)
  QUALIFY row_number() OVER (PARTITION BY source_entity_id, target_entity_id, relation_type, source_id ORDER BY conf DESC, tax, review_status, origin) = 1),
source_entities AS (
  SELECT o_orderkey AS source_id, 'C' || o_custkey AS entity_id, 'interviewee' AS link_type, CAST(NULL AS DOUBLE) AS confidence, o_orderdate AS created_at, 'upload_anchor' AS origin, true AS is_primary, CAST(NULL AS VARCHAR) AS evidence FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT source_id, entity_id, link_type, confidence, created_at, 'extraction', confidence >= 0.98, 'quote ' || entity_id FROM (
    SELECT l_orderkey AS source_id, 'S' || l_suppkey AS entity_id, CASE WHEN l_linenumber % 2 = 1 THEN 'author' ELSE 'primary_subject' END AS link_type, round(max(1 - 2 * l_tax), 4) AS confidence, min(l_shipdate) AS created_at FROM lineitem GROUP BY 1, 2, 3)),
positions AS (SELECT o_orderkey AS id, 'C' || o_custkey AS person_id, 'N' || c_nationkey AS org_id, o_orderpriority AS title, CASE o_orderstatus WHEN 'F' THEN 'ended' WHEN 'O' THEN 'active' ELSE 'pending_review' END AS state,
  CAST(o_orderdate AS DATE) AS valid_from_date, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE 'exact' END AS valid_from_precision, CASE WHEN o_orderstatus = 'F' THEN CAST(shipped AS DATE) END AS valid_to_date,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE 'exact' END AS valid_to_precision, o_orderdate AS validated_at,
  o_orderstatus = 'O' AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderdate DESC, o_orderkey DESC) = 1 AS is_main
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
vectors AS (SELECT vec_id AS id, embedding, CASE WHEN vec_id % 10 <> 0 THEN [CAST(label AS VARCHAR)] END AS topics, vec_id % 25 AS project_id FROM embeddings),
utterances AS (SELECT conv_id AS source_id, turn, CASE WHEN (turn // 2) % 2 = 0 THEN 'A' ELSE 'B' END AS speaker, text, CAST(turn * 5000 AS DOUBLE) AS "start", CAST(turn * 5000 + 4000 AS DOUBLE) AS "end" FROM conversations),
text_sources AS (SELECT doc_id AS source_id, text, doc_id % 25 AS project_id, lang AS country FROM documents),
deals AS (SELECT o_orderkey AS id, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS amount,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) * 6 // 10 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS VARCHAR) AS amount_paid,
  CASE o_orderstatus WHEN 'F' THEN 'closed_won' WHEN 'P' THEN 'closed_lost' ELSE ['lead','qualified','proposal','negotiation'][o_orderkey % 4 + 1] END AS stage, CASE WHEN o_orderkey % 7 = 0 THEN 'barter' END AS deal_type FROM orders),
status_events AS (SELECT event_id, user_id AS source_id, CASE event_type WHEN 'signup' THEN 'UPLOADING' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'EXTRACTING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS status, ts FROM events),
extracted_edges AS (SELECT l_orderkey AS source_id, s_name AS source_name, CASE WHEN l_linenumber = 7 THEN lower(s_name) ELSE p_name END AS target_name, ['manufactured_by','supplier','customer_of','knows'][l_linenumber % 4 + 1] AS relation_type,
  round(l_discount * 10, 4) AS confidence, CASE WHEN l_tax <> 0 THEN ' tax ' || CAST(round(l_tax * 100) AS INT) END AS evidence_text
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def oracle(body: str, more: str = "") -> str:
    """A query over the tables above; ``more`` is further expressions that it needs."""
    return f"WITH {SQL.strip()}{', ' + more.strip() if more else ''}\n{body.strip()}"
