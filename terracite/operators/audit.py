"""Data-quality checks: each gives the rows that break a rule; the summary counts them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from terracite import vocab
from terracite.operators import aggregates, filters, graph, joins
from terracite.operators.aggregates import duplicate_entities, scope_collisions
from terracite.sources.model import Model


def anchor_without_mention(m: Model, kind: str) -> DataFrame:
    """Sources whose anchor entity is not among their mentions."""
    a = joins.anchors_of(m.sources).where(F.col("link_type") == kind)
    return a.join(m.mentions, ["source_id", "entity_id"], "left_anti").select("source_id", "entity_id")


def entities_without_mention(m: Model) -> DataFrame:
    return filters.canonical_only(m.entities).join(m.mentions.select(F.col("entity_id").alias("id")), "id", "left_anti").select("id", "name", "type")


def mentions_without_chunk(m: Model) -> DataFrame:
    return m.mentions.where("chunk_id is null").join(m.sources.select(F.col("id").alias("source_id"), "title"), "source_id").select("source_id", "entity_id", "title")


def edges_missing_end(m: Model) -> DataFrame:
    return joins.broken_refs(m.edges, m.entities, ["source_entity_id", "target_entity_id"]).select("id")


def edges_without_evidence(m: Model) -> DataFrame:
    return m.edges.where("evidence_text is null or trim(evidence_text) = ''").select("id", "relation_type")


def vectors_missing(m: Model) -> DataFrame:
    return m.vectors.where("embedding is null").select("id")


def stuck(m: Model, as_of: str) -> DataFrame:
    return filters.stuck_sources(m.sources, F.lit(as_of).cast("timestamp")).select("id", "status", "created_at")


def reviewed_counts(m: Model) -> DataFrame:
    return aggregates.derived_counts(m.sources.where("status = 'COMPLETED'"), m.chunks, m.mentions, m.edges)


def aliases_of_merged(m: Model) -> DataFrame:
    merged = m.entities.where("canonical_entity_id is not null").select(F.col("id").alias("entity_id"), "canonical_entity_id")
    return m.aliases.join(merged, "entity_id").select("entity_id", "alias", "canonical_entity_id")


def completed_without_chunks(m: Model) -> DataFrame:
    return m.sources.where("status = 'COMPLETED'").join(m.chunks.select(F.col("source_id").alias("id")), "id", "left_anti").select("id")


def cycles(m: Model) -> DataFrame:
    return graph.canonical_cycles(m.entities)


def interviewee_wrong_type(m: Model) -> DataFrame:
    typed = m.entities.select(F.col("id").alias("interviewee_entity_id"), "type")
    return m.sources.join(typed, "interviewee_entity_id").where("type <> 'PERSON'").select("id", "interviewee_entity_id", "type")


def positions_missing_entity(m: Model) -> DataFrame:
    return joins.broken_refs(m.positions, m.entities, ["person_id", "org_id"]).select("id")


def links_by_origin(m: Model) -> DataFrame:
    return aggregates.count_by(m.source_entities, ["origin", "link_type"])


def anchor_gaps(m: Model) -> DataFrame:
    return joins.anchors_without_link(m.sources, m.source_entities)


def vocab_violations(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Values of the column that the vocabulary does not have, with their number."""
    listed = vocab.words(df.sparkSession, known, column).select(column)
    return df.where(F.col(column).isNotNull()).join(F.broadcast(listed), column, "left_anti").groupBy(column).agg(F.count(F.lit(1)).alias("n"))  # a vocabulary


def key_violations(df: DataFrame, keys: list[str], scope: str | None = None) -> DataFrame:
    """Keys that more than one row has; a null scope is one shared scope."""
    if scope is not None:
        df = df.withColumn(scope, F.coalesce(F.col(scope).cast("string"), F.lit("GLOBAL")))
        keys = [*keys, scope]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def tenant_mismatch(child: DataFrame, entities: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (with tenant_id) one of whose entities belongs to another tenant; global entities fit every tenant."""
    bad = F.lit(False)
    for k, c in enumerate(columns):
        child = child.join(entities.select(F.col("id").alias(c), F.col("tenant_id").alias(f"__t{k}")), c, "left")
        bad = bad | (F.col(f"__t{k}").isNotNull() & ~F.col(f"__t{k}").eqNullSafe(F.col("tenant_id")))
    return child.where(bad).drop(*[f"__t{k}" for k in range(len(columns))])


def check_violations(df: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """Rows that break a rule, once for each rule they break. A rule that is null for a row is kept."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def checks(as_of: str) -> dict[str, Callable[[Model], DataFrame]]:
    """The eighteen checks by number; ``as_of`` is the clock."""
    return {
        "01": lambda m: anchor_without_mention(m, "interviewee"),
        "02": lambda m: anchor_without_mention(m, "interviewee_org"),
        "03": entities_without_mention,
        "04": mentions_without_chunk,
        "05": edges_missing_end,
        "06": edges_without_evidence,
        "07": vectors_missing,
        "08": lambda m: stuck(m, as_of),
        "09": reviewed_counts,
        "10": lambda m: duplicate_entities(m.entities),
        "11": aliases_of_merged,
        "12": lambda m: scope_collisions(m.entities),
        "13": completed_without_chunks,
        "14": cycles,
        "15": interviewee_wrong_type,
        "16": positions_missing_entity,
        "17": links_by_origin,
        "18": anchor_gaps,
    }


REPORT = "name string, n_rows long, sample array<string>, error string"


def audit_report(m: Model, as_of: str, sample: int = 5, runs: dict[str, Callable[[Model], DataFrame]] | None = None, at_once: int = 6) -> DataFrame:
    """For each check the rows that it finds, the first ``sample`` of their first column in the order of text, and the error of one that fails.

    A check is one job: its rows are counted by an observation on their way to a heap of ``sample`` rows in each task, so neither
    the rows nor a sort of them is ever gathered. A check that fails, in planning or in running, counts -1 and leaves the others alone.
    """

    def run(item: tuple[str, Callable[[Model], DataFrame]]) -> tuple[str, int, list[str] | None, str | None]:
        name, check = item
        try:
            seen, rows = Observation(), check(m)
            text = rows.select(F.col(rows.columns[0]).cast("string").alias("x")).observe(seen, F.count(F.lit(1)).alias("n"))
            first = [r["x"] for r in text.orderBy(F.asc_nulls_last("x")).limit(sample).collect()]
            return name, seen.get["n"], first, None
        except Exception as error:  # noqa: BLE001  a broken check is itself a finding
            return name, -1, None, f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"

    with ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(run, (checks(as_of) if runs is None else runs).items()))
    return m.spark.createDataFrame(found, REPORT)


def audit_summary(m: Model, as_of: str) -> DataFrame:
    """Rows that each check finds, as one table; a check that fails counts -1."""
    return audit_report(m, as_of, 1).select("name", "n_rows")
