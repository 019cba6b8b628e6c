"""Centroid clustering (k-means on integer vectors) with the Exponion search.

Every vector carries its cluster a, an upper bound u of its distance to that centroid and a lower
bound l of its distance to any other. Let s(a) be the distance of centroid a to the nearest other.
If u < max(l, s(a) / 2) nothing can have changed and no distance is computed. Else u is made exact
and, if that doesn't settle it, only the centroids inside the ball of radius 2u + s(a) around
centroid a are scanned, in the order of a's sorted list of distances: both the nearest and the second
nearest centroid lie in there. The radius is inclusive and bounds are rounded outwards, so ties stay
in and go to the smaller number. When centroids move, u grows by the move of its own centroid and l
shrinks by the largest move of the others.

A round is one scan of the written table of the last round (vector, cluster, bounds) that writes the
next one: no shuffle and no state outside of tables. Of the vectors only those that changed their
cluster enter the sums, added to the new and taken from the old one by partial aggregation, so at most
k rows leave a task. The driver holds k centroids, their sums and their k x k distances (k * (k +
dims) numbers, at most MOST_NUMBERS, which is also what is broadcast).

Results are exact: components are integers, distances are 64-bit integers, means are floored.

Edge cases: vectors with another number of components, a null or a non-finite component, and null
vectors are left out; null ids are kept, and hashed as an empty string; equal rows are vectors of their
own; equal hashes are ordered by components; with fewer than k vectors there are as many centroids as
vectors; an empty cluster keeps its centroid; an empty table gives an empty result; vectors with a
component beyond LARGEST, whose squared distances a 64-bit integer can't hold, raise an error rather
than give wrong results; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, read

DIMS, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, "2:"
LARGEST, MOST_NUMBERS = 1 << 26, 1 << 25
#: Rows that are searched at once, and the slack by which bounds are rounded outwards.
ROWS, SLACK = 8192, 1e-12


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that are kept, each component x as floor(scale * x)."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    fine = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    small = F.forall(F.col("x"), lambda c: F.abs(c * scale) <= LARGEST)
    slim = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
    v = F.when(small, F.transform(F.col("x"), lambda c: F.floor(c * scale).cast("int"))).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")))
    return slim.select("vec_id", v.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of the smallest hashes. Equal (hash, vector) meet as one row with a count, and only
    rows below a threshold of the hash, which rises until enough pass, go on to be sorted."""
    n = vectors.count()
    if not n:
        return np.empty((0, 0), np.int64)
    h = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    hashed, share = vectors.select(h.alias("h"), "v"), min(1.0, 4.0 * k / n)
    while True:
        few = hashed if share >= 1 else hashed.filter(F.substring("h", 1, 8) < F.lit(f"{int(share * 2**32):08x}"))
        found = few.groupBy("h", "v").agg(F.count("*").alias("n")).orderBy("h", "v").limit(k).collect()
        picked = [r.v for r in found for _ in range(min(k, r.n))][:k]
        if len(picked) == min(k, n):
            return np.array(picked, np.int64)
        share = min(1.0, share * 8)


@dataclass
class Centroids:
    """k centroids with what a search needs, and how they moved to get here."""

    at: np.ndarray
    own_move: np.ndarray | None = None
    near: np.ndarray = field(init=False)
    distance: np.ndarray = field(init=False)
    alone: np.ndarray = field(init=False)
    other_move: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        k = len(self.at)
        d = np.sqrt(np.stack([((self.at - c) ** 2).sum(1) for c in self.at]).astype(np.float64)) * (1 - SLACK)
        np.fill_diagonal(d, -1.0)  # a centroid heads its own list, before equal ones
        self.near = np.argsort(d, axis=1, kind="stable")
        self.distance = np.take_along_axis(d, self.near, 1)
        self.alone = self.distance[:, 1] if k > 1 else np.full(k, np.inf)
        if self.own_move is None:
            self.own_move = np.zeros(k)
        most = np.argmax(self.own_move)
        second = np.delete(self.own_move, most).max() if k > 1 else 0.0
        self.other_move = np.where(np.arange(k) == most, second, self.own_move[most])

    def moved_to(self, at: np.ndarray) -> Centroids:
        return Centroids(at, np.sqrt(((at - self.at) ** 2).sum(1).astype(np.float64)) * (1 + SLACK))


def search(v: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroids of the rows of v, given clusters and bounds: clusters, bounds, and how many distances each took."""
    a, n = a.copy(), np.zeros(len(v), np.int32)
    u, low = (u + c.own_move[a]) * (1 + SLACK), low - c.other_move[a]
    low -= np.abs(low) * SLACK
    rest = np.flatnonzero(u >= np.maximum(low, c.alone[a] / 2))
    u[rest] = np.sqrt(((v[rest] - c.at[a[rest]]) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
    n[rest] += 1
    rest = rest[u[rest] >= np.maximum(low[rest], c.alone[a[rest]] / 2)]
    for old in np.unique(a[rest]):
        rows = rest[a[rest] == old]
        radius = (2 * u[rows] + (c.alone[old] if len(c.at) > 1 else 0.0) * (1 + 2 * SLACK)) * (1 + SLACK)
        inside = np.searchsorted(c.distance[old], radius, side="right")
        order = np.argsort(-inside, kind="stable")
        rows, inside = rows[order], inside[order]
        best = np.full(len(rows), np.iinfo(np.int64).max)
        second, which = best.copy(), np.full(len(rows), len(c.at))
        for t in range(inside[0]):
            m = np.searchsorted(-inside, -t)  # rows whose ball holds more than t centroids
            j = c.near[old, t]
            d = ((v[rows[:m]] - c.at[j]) ** 2).sum(1)
            wins = (d < best[:m]) | (d == best[:m]) & (j < which[:m])
            second[:m] = np.where(wins, best[:m], np.minimum(second[:m], d))
            best[:m], which[:m] = np.where(wins, d, best[:m]), np.where(wins, j, which[:m])
        n[rows] += inside.astype(np.int32)
        a[rows] = which
        u[rows] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        low[rows] = np.where(inside > 1, np.sqrt(second.astype(np.float64)) * (1 - SLACK), np.inf)
    return a, u, low, n


_STATE = "vec_id long, v array<int>, cluster int, was int, upper double, lower double, scanned int, distance long"


def assign(state: DataFrame, c: Centroids, measure: bool) -> DataFrame:
    """The state after one search; measure: with exact squared distances."""
    held = state.sparkSession.sparkContext.broadcast(c)
    dims = c.at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b, c = whole.slice(at, ROWS), held.value
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
                was = b.column(2).to_numpy()
                a, u, low, n = search(v, np.maximum(was, 0), b.column(3).to_numpy(), b.column(4).to_numpy(), c)
                d = ((v - c.at[a]) ** 2).sum(1) if measure else np.zeros(len(v), np.int64)
                n += b.column(5).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(a.astype(np.int32)), b.column(2), pa.array(u), pa.array(low), pa.array(n.astype(np.int32)), pa.array(d)], names=["vec_id", "v", "cluster", "was", "upper", "lower", "scanned", "distance"])

    return state.select("vec_id", "v", "cluster", "upper", "lower", "scanned").mapInArrow(run, _STATE)


def change_of_sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What vectors that changed their cluster add to the counts and sums of the clusters: k rows of dims + 2 numbers."""
    sides = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))
    moved = state.filter("cluster <> was").select("v", F.explode(sides).alias("side")).filter("side.c >= 0").select("side.c", F.col("side.sign").cast("long").alias("sign"), "v")
    part: list[Column] = [F.sum(F.col("sign") * F.col("v")[i]).alias(f"s{i}") for i in range(dims)]
    counts, sums = np.zeros(k, object), np.zeros((k, dims), object)
    for r in moved.groupBy("c").agg(F.sum("sign").alias("n"), *part).collect():
        counts[r.c], sums[r.c] = r.n, [int(x) for x in r[2:]]
    return counts, sums


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """One row per kept vector (vec_id, v, cluster, distance, scanned: distances computed for it in all), and the final centroids."""
    spark = vectors.sparkSession
    if k * (k + dims) > MOST_NUMBERS:
        raise ValueError(f"{k} centroids of {dims} components and their distances are more than {MOST_NUMBERS} numbers")
    table = materialize(integer_vectors(vectors, vec_id, embedding, dims, scale), "vectors")
    at = first_centroids(table, k, seed)
    if not len(at):
        return spark.createDataFrame([], "vec_id long, v array<int>, cluster int, distance long, scanned int"), at
    c = Centroids(at)
    counts, sums = np.zeros(len(at), object), np.zeros(at.shape, object)
    fresh = {"cluster": F.lit(-1), "upper": F.lit(float("inf")), "lower": F.lit(float("-inf")), "scanned": F.lit(0)}
    state = table.withColumns(fresh)
    for r in range(rounds):
        state = materialize(assign(state, c, False), f"round-{r}")
        n, s = change_of_sums(state, len(at), dims)
        counts, sums = counts + n, sums + s
        c = c.moved_to(np.array([[x // m for x in row] if m else old.tolist() for row, m, old in zip(sums, counts, c.at, strict=True)], np.int64))
    last = materialize(assign(state, c, True), "assigned")
    return last.select("vec_id", "v", "cluster", "distance", "scanned"), c.at


def report(told: DataFrame, centroids: np.ndarray) -> DataFrame:
    """told with cluster_inertia, inertia and centroid_sha256; what is collected and broadcast is a row for each cluster."""
    sums = {r.cluster: r.d for r in told.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(i, sums.get(i, 0), sum(sums.values()), h) for i, h in enumerate(sha)]
    return told.join(F.broadcast(told.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, centroids = cluster(read(spark, sf_dir, "embeddings"))
    return report(told, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """k-means by comparing each vector with each centroid."""
    floor = "(s - ((s % n) + n) % n) // n"
    near = "SELECT vec_id, r, v, {rn}, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS nth FROM (SELECT e.*, c.c, list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM e, c{i} c)".replace("{rn}", "c")
    parts = [
        "f AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE len(embedding) = 64)",
        "e AS (SELECT vec_id, row_number() OVER () AS r, list_transform(x, lambda y: floor(256 * y)::BIGINT) AS v FROM f WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        "c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM e) ORDER BY h, v LIMIT 40)",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS (SELECT * FROM ({near.format(i=i)}) WHERE nth = 1)")
        if i < ROUNDS:
            parts.append(f"m{i} AS (SELECT c, list({floor} ORDER BY p)::BIGINT[] AS v FROM (SELECT c, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY c, p) GROUP BY c)")
            parts.append(f"c{i + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (c))")
    return f"""WITH {", ".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)}
SELECT a.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.c"""


ORACLE = _oracle()
