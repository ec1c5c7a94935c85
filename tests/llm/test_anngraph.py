import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import anngraph as ann
from kinfold.llm.queries import QUERIES

from .brute import nearest

SF = "/root/testdata/sf0.1"


def recall(spark, vectors, settings, every=10):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % every == 0, settings).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x, ids, hit, all_ = vectors.astype(np.float32).astype(float), np.arange(len(vectors)), 0, 0
    for q in range(0, len(vectors), every):
        want = nearest(ids, x, q, settings.k)
        have = sorted(got[q])
        assert [r for r, _, _ in have] == list(range(1, len(have) + 1)) and q not in [v for _, v, _ in have]
        for _, v, s in have:
            assert s == pytest.approx(np.sqrt(((x[q] - x[v]) ** 2).sum()), abs=1e-12)
        hit += len({v for v, _ in want} & {v for _, v, _ in have})
        all_ += len(want)
    return hit / all_


def test_query_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    got = {}
    for r in QUERIES["op9_nearest"](spark, SF).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {ids[q]: {v for v, _ in nearest(ids, x, q, 10)} for q in np.flatnonzero(ids % 100 == 0)}
    assert got.keys() == want.keys()
    assert np.mean([len(got[q] & want[q]) / 10 for q in want]) >= 0.97


def test_clusters_in_several_shards(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c * 8, 1, (150, 12)) for c in range(8)])
    assert recall(spark, x, ann.Settings(shard_rows=300)) >= 0.97


def test_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 6))
    x[50:200] = x[50]  # half of the rows are one vector; the smallest ids win
    assert recall(spark, x, ann.Settings(shard_rows=64)) == 1.0


def test_prune_keeps_edges_diverse():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 3], [0, 3.1]], np.float32)
    out = ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, 1, 0, -1]]), 4, 1.2)
    assert out.tolist() == [[1, 3, -1, -1]]


def test_few_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (1, [0.9, 0.0], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [nan, 1.0], "x"), (5, [inf, 1.0], "x"), (6, [1.0, None], "x"), (100, [2.0, 0.0], "x"), (100, [2.0, 0.0], "x"), (None, [1.0, 1.0], "x"), (8, [1.0, 2.0, 3.0], "x"), (200, [1.0, 2.0, 4.0], "x"), (300, [7.0], "x"), (9, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    out = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert out == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1), (200, 1, 8)]
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0
    assert len({r["vec_id"] for r in ann.nearest(df, F.col("vec_id") == 0, ann.Settings(block_queries=1)).collect()}) == 2


def test_doubles_keep_their_precision(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0 + 5e-10]), (2, [1.0, 1.0 + 2e-10]), (3, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(i, abs(rows[0][1][1] - rows[i][1][1])) for i in (2, 1, 3)]
    whole = spark.createDataFrame([(0, [16777217]), (100, [16777216]), (2, [16777219])], "vec_id long, embedding array<int>")
    assert [(r["vec_id"], r["score"]) for r in ann.nearest(whole, F.col("vec_id") == 0).orderBy("rank").collect()] == [(100, 1.0), (2, 2.0)]
