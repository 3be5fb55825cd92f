"""Centroid clustering of integer vectors by Exponion search.

Each vector carries its centroid, an upper bound of its distance to it and a lower bound of the distance to all others. After
each round the bounds are widened by how far the centroids moved. A vector whose bounds still part its centroid from all
others is done; for the rest only centroids inside a ball around their own are scanned: its radius is twice the distance to
the own centroid plus that centroid's distance to its nearest neighbour, edge included, so that ties are met and
the second-nearest centroid is inside too. Each centroid has a list of the others sorted by distance, so a ball is a prefix of it.

Bounds are doubles, rounded outwards; distances that decide are integers. A round reads the vectors once and writes them with their
new bounds and, from each task, sums by centroid, which Spark adds up; the driver sees k centroids.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import cut, remove, shared_dir, tidy
from meterlake.sources.bronze import keep

SCALE = 256
#: Components beyond this are an error: squared distances of 64 of them still fit 64-bit integers.
MOST = 1 << 27
#: Rounding of bounds: far more than what double arithmetic loses in a round, far less than any two distances differ by.
SLACK = 1e-9


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64) -> DataFrame:
    """Rows (id, x): vectors of exactly ``size`` components, none null or non-finite, each component floor(256 * value).

    Other vectors, null ones included, are left out. Rows that repeat an id stay apart; a null id stays null.
    """
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    kept = vectors.filter((F.size(v) == size) & finite)
    inside = F.forall(v, lambda x: F.abs(F.floor(x.cast("double") * SCALE)) <= MOST)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    checked = F.when(inside, whole).otherwise(F.raise_error(F.lit(f"a component beyond {MOST // SCALE}")).cast("array<bigint>"))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), checked.alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed and id, in that order; fewer if there are fewer. Null ids come last, rows of one id by components."""
    key = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


class Ball:
    """Centroids, their distances to one another and, for each, the others sorted by distance."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        self.c = centroids
        wide = int(np.abs(centroids).max(initial=0)) >= 1 << 20
        self.kind = np.int64 if wide else np.float64  # products of smaller components are exact in doubles
        self.norms = (centroids**2).sum(axis=1)
        between = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        away = np.take_along_axis(between, self.order, axis=1)
        self.away = away * (1 - SLACK)
        self.nearest = away[:, 1] if len(centroids) > 1 else np.full(len(centroids), np.inf)
        moved = np.zeros(len(centroids)) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64))
        self.moved = moved * (1 + SLACK)
        others = np.sort(self.moved)
        self.others_moved = np.where(np.arange(len(moved)) == int(self.moved.argmax()), others[-2] if len(moved) > 1 else 0.0, others[-1])

    def squared(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows to the centroids numbered ``to``."""
        kind = np.int64 if np.abs(x).max(initial=0) >= 1 << 20 else self.kind
        cross = x.astype(kind) @ self.c[to].T.astype(kind)
        return (x**2).sum(axis=1)[:, None] - 2 * cross.astype(np.int64) + self.norms[to]

    def own(self, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        return ((x - self.c[a]) ** 2).sum(axis=1)

    def search(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Set a, upper and lower (in place) for rows x; returns how many distances were computed."""
        upper += self.moved[a]
        lower -= self.others_moved[a]
        apart = np.maximum(lower, self.nearest[a] / 2) * (1 - SLACK)
        loose = np.flatnonzero(upper >= apart)
        upper[loose] = np.sqrt(self.own(x[loose], a[loose]).astype(np.float64)) * (1 + SLACK)
        loose = loose[upper[loose] >= apart[loose]]
        done = len(loose)
        radius = (2 * upper[loose] + np.where(np.isinf(self.nearest[a[loose]]), 0, self.nearest[a[loose]])) * (1 + SLACK)
        start = a[loose]
        for i in np.unique(start).tolist():
            rows = loose[start == i]
            inside = np.searchsorted(self.away[i], radius[start == i], "right")
            ring = np.ceil(np.log2(np.maximum(inside, 2))).astype(int)  # balls are taken to the next power of two of the list
            for r in np.unique(ring).tolist():
                near = rows[ring == r]
                to = np.sort(self.order[i][: 1 << r])
                d = self.squared(x[near], to)
                done += d.size
                best = d.argmin(axis=1)  # the first of equal ones: the smaller number
                at = np.arange(len(near))
                a[near], upper[near] = to[best], np.sqrt(d[at, best].astype(np.float64)) * (1 + SLACK)
                d[at, best] = np.iinfo(np.int64).max
                lower[near] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK) if d.shape[1] > 1 else np.inf
        return done


STATE = "id long, x binary, a int, upper double, lower double, cluster int, count long, sums array<bigint>"


def _round(state: DataFrame, ball: Ball, size: int) -> DataFrame:
    """Vectors with new bounds (cluster is null), and each task's counts and sums by cluster (cluster is set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(ball.c)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        schema = pa.schema([("id", pa.int64()), ("x", pa.binary()), ("a", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("cluster", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))])
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(-1, size).astype(np.int64)
            a, upper, lower = (batch.column(j).to_numpy(zero_copy_only=False).copy() for j in (2, 3, 4))
            ball.search(x, a, upper, lower)
            order = np.argsort(a, kind="stable")
            found, starts = np.unique(a[order], return_index=True)
            counts += np.bincount(a, minlength=k)
            sums[found] += np.add.reduceat(x[order], starts, axis=0)
            nothing = [pa.nulls(len(a), f.type) for f in list(schema)[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.int32()), pa.array(upper), pa.array(lower), *nothing], schema=schema)
        full = np.flatnonzero(counts)
        blank = [pa.nulls(len(full), f.type) for f in list(schema)[:5]]
        yield pa.RecordBatch.from_arrays([*blank, pa.array(full, pa.int32()), pa.array(counts[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], schema=schema)

    return state.mapInArrow(tidy(run), STATE)


def _packed(vectors: DataFrame) -> DataFrame:
    """The first state: bounds that settle nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            whole = batch.column(1).flatten().to_numpy().astype("<i4").tobytes()
            x = pa.array([whole[i : i + len(whole) // n] for i in range(0, len(whole), len(whole) // n)] if n else [], pa.binary())
            columns = [batch.column(0), x, pa.array(np.zeros(n), pa.int32()), pa.array(np.full(n, np.inf)), pa.array(np.zeros(n))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "a", "upper", "lower"])

    return vectors.mapInArrow(tidy(run), "id long, x binary, a int, upper double, lower double")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:", size: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(rows id, cluster, distance; the final centroids) after ``rounds`` rounds and a last assignment.

    ``vectors`` (id, x) are those of ``integer_vectors``. Ties go to the smaller centroid; centroids become the exact floor of their vectors'
    means, empty ones stay. With fewer than k vectors there are fewer centroids; no vectors give no rows and no centroids.
    """
    spark = vectors.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    state = keep(_packed(vectors), f"{path}-0")
    centroids, before = first_centroids(vectors, k, seed), None
    if not len(centroids):
        remove(spark, f"{path}-0")
        return spark.createDataFrame([], "id long, cluster int, distance long"), centroids
    for r in range(1, rounds + 1):
        out = keep(_round(state, Ball(centroids, before), size), f"{path}-{r}")
        remove(spark, f"{path}-{r - 1}")
        sums = out.filter("cluster is not null").select("cluster", "count", F.posexplode("sums").alias("at", "part"))
        total = sums.groupBy("cluster", "at").agg(F.sum("part").alias("total"), F.sum("count").alias("count"))
        before, centroids = centroids, centroids.copy()
        for row in total.collect():  # k * size rows
            centroids[row["cluster"], row["at"]] = row["total"] // row["count"]
        state = out.filter("cluster is null").select("id", "x", "a", "upper", "lower")
    ball = Ball(centroids, before)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(-1, size).astype(np.int64)
            a, upper, lower = (batch.column(j).to_numpy(zero_copy_only=False).copy() for j in (2, 3, 4))
            if len(a):
                ball.search(x, a, upper, lower)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int32()), pa.array(ball.own(x, a), pa.int64())], names=["id", "cluster", "distance"])

    out = cut(state.mapInArrow(tidy(last), "id long, cluster int, distance long"))
    remove(spark, f"{path}-{rounds}")
    return out, centroids


def digests(centroids: np.ndarray) -> list[str]:
    """sha256 of each centroid's components as decimals joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]


def cluster_report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, seed: str = "2:", size: int = 64) -> DataFrame:
    """Per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows, centroids = cluster(integer_vectors(vectors, id_col, vector_col, size), k, rounds, seed, size)
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    inertia = sum(r["cluster_inertia"] for r in sums)
    names = digests(centroids)
    facts = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], inertia, names[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(facts), "cluster")  # at most k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
