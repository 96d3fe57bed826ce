"""The SQL functions of the data model."""

import pytest

from terracite.sources.functions import register
from terracite.sources.model import Model


@pytest.fixture(scope="module")
def sql(spark, sf_dir):
    return register(Model(spark, sf_dir)).sql


def test_filters_reach_the_scans(sql):
    plan = sql("SELECT role, evidence FROM entity_intel('P10') WHERE source_id = 7")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "lineitem" in line]
    assert sum("EqualTo(l_orderkey,7)" in line for line in scans) >= 3  # mentions, links and edges; chunks are then joined by id
    narrow = sql("SELECT id FROM hybrid_search(array(1D, 0D), most => 3)")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<" in narrow


def test_sources_are_joined_once(sql):
    """What an entity's rows are filtered by comes from the join that they have with their sources; a second one would sort all sources for a few rows."""
    plan = sql("SELECT * FROM entity_intel('P10', 3)")._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "customer" in line for line in plan.split("\n")) == 1


def test_functions_are_expanded_where_they_are_called(sql):
    plan = sql("SELECT source_project(7) AS p")._jdf.queryExecution().optimizedPlan().toString()
    assert "source_project" not in plan and "orders" in plan.lower() or "Relation" in plan


def test_defaults_nulls_and_names(sql):
    assert sql("SELECT source_project(-5) AS p").first()["p"] is None and sql("SELECT source_project(NULL) AS p").first()["p"] is None
    assert sql("SELECT has_role(NULL, 3) AS a, has_role(3, -1) AS b, has_role(3, 3, 'emperor') AS c").first().asDict() == {"a": False, "b": False, "c": False}
    everything = sql("SELECT count(*) AS n FROM entity_intel('P10')").first()["n"]
    parts = sql("SELECT sum(n) AS n FROM (SELECT DISTINCT project_id FROM model_sources) p, LATERAL (SELECT count(*) AS n FROM entity_intel('P10', p.project_id))").first()["n"]
    assert everything == parts > 0
    assert sql("SELECT * FROM entity_intel(entity => 'nobody')").count() == 0
    assert sql("SELECT * FROM hybrid_search(NULL)").count() == 0 and sql("SELECT * FROM list_distinct_position_titles(0)").count() == 0


def test_functions_join_laterally(sql):
    got = sql("SELECT e.id, i.role, count(*) AS n FROM VALUES ('P10'), ('P11'), ('S3') AS e(id), LATERAL entity_intel(e.id) i GROUP BY ALL").collect()
    alone = {e: sql(f"SELECT count(*) AS n FROM entity_intel('{e}')").first()["n"] for e in ("P10", "P11", "S3")}
    assert {e: sum(r["n"] for r in got if r["id"] == e) for e in alone} == alone
