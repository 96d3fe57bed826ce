"""Recall of the registered vector searches, and how much they compare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracite.operators import search, vectors
from terracite.sources.model import Model


def both(m, k=10):
    asked = m.vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return asked, {(r["query_id"], r["id"]) for r in search.hybrid_search(m.vectors, asked, threshold=-1.0, k=k).collect()}


def test_ann_recall_of_the_registered_settings(spark):
    m = Model(spark, "/root/testdata/sf0.01")
    asked, exact = both(m)
    near = {(r["query_id"], r["id"]) for r in search.ann_search(m.vectors, asked, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_index_finds_nine_in_ten_and_compares_one_in_ten(spark):
    m = Model(spark, "/root/testdata/sf0.1")
    asked, exact = both(m)
    index = vectors.Index(m.vectors)
    near = {(r["query_id"], r["id"]) for r in index.search(asked).collect()}
    rows, n = m.vectors.count(), asked.count()
    assert index.codes.count() == rows
    compared = index.candidates(asked, 150).count()
    assert len(exact & near) >= 0.9 * len(exact) and compared <= 0.1 * rows * n


@pytest.mark.parametrize("sizes", [(vectors.LIST_ROWS, vectors.LIST_QUERIES), (60, 7)])
def test_index_of_all_lists_and_candidates_is_exact(spark, monkeypatch, sizes):
    """Whatever the cells, and with vectors that are null, hold nulls, have no length, tie, or have another number of dimensions."""
    monkeypatch.setattr(vectors, "LIST_ROWS", sizes[0])
    monkeypatch.setattr(vectors, "LIST_QUERIES", sizes[1])
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = table.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = vectors.Index(table, lists=5)
    got = [(r["query_id"], r["rank"], r["id"], r["similarity"]) for r in index.search(asked, k=5, refine=200, probe=1.0).collect()]
    want = [(r["query_id"], r["rank"], r["id"], r["similarity"]) for r in search.hybrid_search(table.where("id < 2000"), asked.where("query_id < 2000"), threshold=-1.1, k=5).collect()]
    assert index.codes.count() == 420
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in want) and np.allclose(sorted(x[3] for x in got), sorted(x[3] for x in want), atol=1e-5)


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    assert vectors.Index(none).search(none.withColumnRenamed("id", "query_id")).count() == 0


def test_parts_of_any_size_give_the_same_neighbours(spark, monkeypatch):
    """Copies, vectors of other lengths and of no length, several parts of each side; no pair is shuffled that is not among the best of its parts."""
    m = Model(spark, "/root/testdata/sf0.001")
    table = m.vectors.select("id", "embedding").unionByName(m.vectors.where("id < 30").selectExpr("id + 100000 id", "embedding"))
    odd = spark.createDataFrame([(200000, [0.0] * 64), (200001, [1.0, 2.0]), (200002, None)], "id long, embedding array<float>")
    table, asked = table.unionByName(odd), m.vectors.where("id % 20 = 0").selectExpr("id query_id", "embedding").unionByName(odd.selectExpr("id query_id", "embedding"))
    told = lambda df: sorted(tuple(r) for r in df.collect())
    whole, hashes = told(search.hybrid_search(table, asked, threshold=-1.1, k=5)), told(search.ann_search(table, asked, 5))
    assert (200001, 1, 200001, 1.0) in whole and {0, 100000} <= {i for q, _, i, _ in whole if q == 0}
    monkeypatch.setattr(search, "PART_ROWS", 7)
    assert told(search.hybrid_search(table, asked, threshold=-1.1, k=5)) == whole
    assert told(search.ann_search(table, asked, 5)) == hashes
    plan = search.ann_search(table, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "SortMergeJoin" not in plan
