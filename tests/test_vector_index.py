"""The vector index against exact search: recall, crowded cells in parts, filters, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldrift.operators import retrieval, vector_index


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 20))
    rows = [(i, (centres[i % 12] + rng.normal(size=20) * 0.5).tolist()) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 20) for i in range(300)]  # one common vector
    odd = [(3000, None), (3001, []), (3002, [1.0] * 3), (3003, [0.0] * 20), (None, [1.0] * 20)]
    d = spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(4).cache()
    return d, d.filter("id % 40 = 0 and size(v) = 20").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


@pytest.mark.parametrize("part, block", [(50_000, 2048), (40, 7)])
def test_recall_against_exact_search(spark, table, monkeypatch, part, block):
    monkeypatch.setattr(vector_index, "PART", part)
    d, queries = table
    index = vector_index.build(d, pieces=5)
    assert (index.parts.max() > 1) == (part == 40)
    assert index.rows.count() == 1801 and index.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] <= 2 * part
    found = vector_index.search(index, queries, 10, block=block).cache()
    whole = d.filter("id is not null and size(v) = 20")
    r = vector_index.recall(found, retrieval.vector_search(whole, queries, 10)).first()
    assert r.queries == queries.count() and r.recall >= 0.9
    exact = {(x.query_id, x.id): x.score for x in retrieval.vector_search(whole, queries, 2000).collect()}
    assert all(abs(exact[x.query_id, x.id] - x.score) < 1e-9 for x in found.collect())
    # All cells and all of their rows: nothing is missed.
    every = vector_index.search(index, queries.limit(3), 5, probes=10**6, refine=400, block=block)
    want = retrieval.vector_search(whole, queries.limit(3), 5)
    assert sorted(map(tuple, every.select("query_id", "id", "rank").collect())) == sorted(map(tuple, want.select("query_id", "id", "rank").collect()))


def test_filter_comes_first(spark, table):
    d, queries = table
    found = vector_index.search(vector_index.build(d, cells=4), queries, 10, keep=F.col("id") % 3 == 0)
    assert found.filter("id % 3 <> 0").isEmpty() and found.groupBy("query_id").count().agg(F.min("count")).first()[0] == 10


def test_nothing_to_index_is_refused(spark, table):
    with pytest.raises(ValueError):
        vector_index.build(table[0].filter("v is null"))


def test_recall_without_clusters(spark):
    """Vectors spread evenly: the neighbours of a query lie in many cells."""
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(4000, 24)))], "id long, v array<double>").repartition(4)
    queries = d.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = vector_index.search(vector_index.build(d), queries, 10)
    assert vector_index.recall(found, retrieval.vector_search(d, queries, 10)).first().recall >= 0.9
