import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import ann
from flowloom.llm.queries import op10_nearest_neighbours


def exact(ids, x, i, k):
    score = x @ x[i]
    order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
    return ids[order], score[order]


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    found = op10_nearest_neighbours(spark, "/root/testdata/sf0.1").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    hits = 0
    for query, rows in found.groupby("query_id"):
        i = int(np.flatnonzero(ids == query)[0])
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 21))
        assert rows.score.to_numpy() == pytest.approx([x[i] @ x[np.flatnonzero(ids == v)[0]] for v in rows.vec_id], abs=1e-12)
        hits += len(set(exact(ids, x, i, 20)[0]) & set(rows.vec_id))
    assert found.query_id.nunique() == (ids % 20 == 0).sum()
    assert hits / len(found) > 0.95


def test_lengths_differ_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * rng.uniform(0.1, 5, (200, 1))
    x[50:90] = x[50]  # equal vectors
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1020, [0.0] * 8, 1), (1040, [float("nan")] * 8, 1), (1060, [float("inf")] * 8, 1), (1080, [None] * 8, 1), (1100, [1.0], 1), (None, [1.0] * 8, 1)]
    found = ann.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0).toPandas()
    assert sorted(found.query_id.unique()) == list(range(0, 200, 20))
    hits = 0
    for query, part in found.groupby("query_id"):
        ids, score = exact(np.arange(200), x, query, 20)
        hits += len(set(ids) & set(part.vec_id))
        part = part.sort_values("rank")
        assert part.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == part.vec_id.tolist()
    assert hits >= 0.95 * len(found)


def test_few_rows(spark):
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.9, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(three, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 2, 0.9), (0, 2, 1, 0.5)]
    assert ann.nearest(three.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(three.limit(1), F.lit(True)).count() == 0


def test_smallest_ids_of_equal_vectors_in_any_order():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    x[:40] = 3 * x[0]
    order = rng.permutation(60)
    graph = ann.graph_of(order, x[order], float(np.sqrt(np.square(x).sum(axis=1).max())))
    assert ann.search(graph, np.array([0]), x[:1], 20).vec_id.tolist() == list(range(1, 21))


def test_what_a_task_holds_does_not_grow_with_the_queries(spark, monkeypatch):
    """Many shards and slices: every pair of them once, with one graph and a part of the queries; results stay."""
    table = "/root/testdata/sf0.01/embeddings.parquet"
    vectors = spark.read.parquet(table)
    whole = ann.nearest(vectors, F.col("vec_id") % 2 == 0, k=5).toPandas()
    monkeypatch.setattr(ann, "SHARD", 120)
    monkeypatch.setattr(ann, "QUERIES", 60)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        cut = ann.nearest(vectors, F.col("vec_id") % 2 == 0, k=5).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(cut) == len(whole) == 5 * 250
    both = cut.merge(whole, on=["query_id", "vec_id"])
    assert len(both) > 0.97 * len(whole) and (both.score_x == both.score_y).all()


def test_smallest_ids_of_equal_vectors_in_a_shuffled_table(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(i, [0.1, 0.0]) for i in range(400, 440)]
    np.random.default_rng(6).shuffle(rows)
    table = spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(7)
    found = ann.nearest(table, F.col("vec_id") == 40).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == list(range(20))
