import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswerk.llm.ann import distances, group_lists, neighbours, search_group

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_recall_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    x = (rnd.normal(size=(40, 16))[rnd.integers(0, 40, 1500)] + 0.4 * rnd.normal(size=(1500, 16))).astype(np.float32)
    got = neighbours(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA), k=5, every=1, members=64).toPandas()
    d = distances(x.astype(float), x.astype(float))
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, 1, kind="stable")[:, :5]
    assert set(got["vec_id"]) == set(range(1500)) and (got.groupby("vec_id").size() == 5).all()
    hit = sum(b in true[a] for a, b in zip(got["vec_id"], got["neighbour_id"]))
    assert hit / true.size >= 0.95
    np.testing.assert_allclose(got["distance"], np.sqrt(((x[got["vec_id"]].astype(float) - x[got["neighbour_id"]]) ** 2).sum(1)), rtol=1e-6)


def test_edges(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, None, 0), (5, [], 0), (None, [1.0, 1.0], 0), (6, [1.0], 0), (7, [float("nan"), 1.0], 0), (8, [float("inf"), 1.0], None), (9, [None, 1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("list", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("code", F.lit(2)).withColumn("a.b", F.lit(1))
    got = neighbours(df, k=3, probes=1.0, every=1).orderBy("vec_id", "rank").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 0.0), (1, 2, 3, 1.0), (2, 1, 1, 0.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0)]
    assert neighbours(df.limit(0)).count() == 0 and neighbours(df.where("vec_id = 1")).count() == 0


def test_lists_in_parts(spark):
    x = np.random.default_rng(2).normal(size=(300, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    a, b = (neighbours(df, k=4, probes=1.0, rerank=100, chunk=c, every=1, members=10).orderBy("vec_id", "rank").collect() for c in (4096, 3))
    assert a == b
    d = distances(x.astype(float), x.astype(float))
    np.fill_diagonal(d, np.inf)
    assert [r.neighbour_id for r in a] == np.argsort(d, 1, kind="stable")[:, :4].ravel().tolist()


def test_asymmetric_distance_orders():
    x = np.array([[0, 0], [1, 1], [5, 5]], np.float32)
    words = np.array([[[0], [1], [5]], [[0], [1], [5]]], np.float32)
    codes, zero = np.array([[0, 0], [1, 1], [2, 2]], np.uint8), np.zeros(1, int)
    q, near, d = search_group(np.zeros(3, int), np.arange(3), x, codes, np.array([9]), np.array([[0.9, 0.9]], np.float32), zero, zero, np.zeros((1, 2), np.float32), words, 2, 1)
    assert near.tolist() == [1, 0] and q.tolist() == [9, 9]


def test_groups_of_lists():
    assert group_lists({0: 3, 1: 4, 2: 21, 3: 1, 5: 9, 6: 2}, 10) == {(0, 1): [0, 1], (1, 3): [2], (4, 1): [3, 5], (5, 1): [6]}


def test_busy_groups_and_ties(spark, monkeypatch):
    from glosswerk.llm import ann

    monkeypatch.setattr(ann, "_SLICE", 7)
    df = spark.createDataFrame([(i, [float(i % 5), 0.0], 0) for i in range(60)], SCHEMA)
    got = neighbours(df, k=3, every=4, probes=1.0, rerank=50, members=10).orderBy("vec_id", "rank").collect()
    want = [(i, r + 1, x) for i in range(0, 60, 4) for r, x in enumerate([j for j in range(60) if j % 5 == i % 5 and j != i][:3])]
    assert [(r.vec_id, r.rank, r.neighbour_id) for r in got] == want and all(r.distance == 0 for r in got)


def test_ids_are_whole_numbers(spark):
    with pytest.raises(ValueError):
        neighbours(spark.createDataFrame([("a", [1.0], 0)], "vec_id string, embedding array<float>, label int"))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_registered_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    true = {i: set(ids[own]) for i, own in zip(ids, np.argsort(d, 1, kind="stable")[:, :10])}
    for options in ({}, {"every": 1, "members": 100}):
        got = neighbours(df, **options).toPandas()
        asked = [i for i in ids if i % options.get("every", 20) == 0]
        assert (got.groupby("vec_id").size() == 10).all() and set(got["vec_id"]) == set(asked)
        hit = sum(b in true[a] for a, b in zip(got["vec_id"], got["neighbour_id"])) / (10 * len(asked))
        print(sf, options, hit)
        assert hit >= 0.95
