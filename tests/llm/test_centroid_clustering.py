"""Exponion search against the nearest centroid by comparing all; k-means against plain loops and SQL."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from leafmill.llm import centroid_clustering as cc
from leafmill.llm.common import drop_scratch

NAN, INF = float("nan"), float("inf")


def plain(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    at = [v for _, v in first]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        told = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            own = [v for (_, v), t in zip(kept, told, strict=True) if t == j]
            if own:
                at[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return Counter((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), at


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    centers = [[rng.uniform(-4, 4) for _ in range(6)] for _ in range(9)]
    out = [(i, [x + rng.gauss(0, 0.5) for x in rng.choice(centers)]) for i in range(700)]
    out += [(i, [float(rng.randint(-1, 1)) for _ in range(6)]) for i in range(700, 1000)]  # ties
    out += [(2000 + i, [1.0] * 6) for i in range(300)] + [out[3]] * 4
    return out + [(None, [0.5] * 6), (None, [-0.5] * 6), (1, None), (2, [1.0] * 5), (3, [1.0] * 7), (4, [NAN] + [0.0] * 5), (5, [INF] + [0.0] * 5), (6, [None] + [0.0] * 5), (7, [])]


@pytest.mark.parametrize(("k", "rounds"), [(12, 4), (1, 2), (3, 0), (40, 3)])
def test_clusters(spark, rows, k, rounds):
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, cluster int").repartition(3)
    told, at = cc.cluster(df, dims=6, scale=4, k=k, rounds=rounds)
    want, centroids = plain(rows, k, rounds, 6, 4)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in told.collect()) == want and at.tolist() == centroids
    drop_scratch()


def test_search_prunes_and_keeps_ties(spark):
    rng = np.random.default_rng(1)
    centers = rng.integers(-4000, 4000, (50, 8))
    v = (centers[rng.integers(0, 50, 5000)] + rng.integers(-40, 40, (5000, 8))).astype(np.int64)
    c = cc.Centroids(centers.astype(np.int64))
    a, u, low, _ = cc.search(v, np.zeros(5000, np.int64), np.full(5000, np.inf), np.full(5000, -np.inf), c)
    c = c.moved_to(c.at + rng.integers(-3, 3, c.at.shape))
    a, u, low, n = cc.search(v, a, u, low, c)
    d = ((v[:, None] - c.at) ** 2).sum(2)
    assert (a == d.argmin(1)).all() and n.mean() < 3
    d2 = np.sort(np.sqrt(d), 1)
    assert (u >= d2[:, 0] * (1 - 1e-9)).all() and (low <= d2[:, 1] * (1 + 1e-9)).all()
    line = cc.Centroids(np.array([[4], [2], [0], [2]], np.int64))  # 3 and 1 lie between two, 2 on two equal ones
    for start in range(4):
        a, *_ = cc.search(np.array([[3], [1], [2]], np.int64), np.full(3, start), np.full(3, np.inf), np.full(3, -np.inf), line)
        assert a.tolist() == [0, 1, 1]


def test_empty_few_and_too_large(spark):
    schema = "vec_id long, embedding array<float>"
    told, at = cc.cluster(spark.createDataFrame([], schema))
    assert cc.report(told, at).collect() == [] and not len(at)
    told, at = cc.cluster(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), dims=2)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in told.collect()) == [(1, 0, 0), (2, 0, 0)] and len(at) == 2
    with pytest.raises(Exception, match="is beyond"):
        cc.cluster(spark.createDataFrame([(1, [1e30, 0.0])], schema), dims=2)
    with pytest.raises(ValueError, match="numbers"):
        cc.cluster(spark.createDataFrame([], schema), k=10_000)


def test_query_is_its_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    r = con.execute(cc.ORACLE)
    names = [x[0] for x in r.description]
    got = cc.op11_centroid_clustering(spark, path)
    assert Counter(tuple(x[n] for n in names) for x in got.collect()) == Counter(r.fetchall())
    drop_scratch()
