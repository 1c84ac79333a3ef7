"""Centroid clustering of integer vectors: each vector finds its centroid by a tournament of bisector tests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.vectors import is_finite, matrix, scaled
from careflow.session import cut_lineage

#: Vectors that a worker tests at a time.
SLAB = 4096


@dataclass
class Bisectors:
    """The plane halfway between each two centroids a < b, as an integer normal and threshold.

    `normal[a, b] . x - threshold[a, b]` is |x - a|^2 - |x - b|^2: above zero x is nearer to b, below it to a, and zero
    favours a, the smaller number.
    """

    centroids: np.ndarray
    normal: np.ndarray
    threshold: np.ndarray

    @classmethod
    def of(cls, centroids: list[list[int]]) -> Bisectors:
        c = np.array(centroids, np.int64)
        square = (c * c).sum(1)
        return cls(c, 2 * (c[None, :] - c[:, None]), square[None, :] - square[:, None])

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row, after one test less than there are centroids."""
        champion = np.zeros(len(x), np.int64)
        for rival in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", x, self.normal[champion, rival]) - self.threshold[champion, rival]
            champion[side > 0] = rival
        return champion

    def distance(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Squared distance of each row to its centroid."""
        off = x - self.centroids[number]
        return np.einsum("ij,ij->i", off, off)


def _slabs(parts: Iterator[pa.RecordBatch], column: str, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in parts:
        for at in range(0, whole.num_rows, SLAB):
            part = whole.slice(at, SLAB)
            yield part, matrix(part.column(column), dims)


def first_centroids(vectors: DataFrame, id_col: str, vector_col: str, k: int, seed: int) -> list[list[int]]:
    """The vectors whose `<seed>:<id>` have the k smallest SHA-256, in that order; rows of one id go by their components. Null ids start none."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    first = vectors.select(digest.alias("digest"), vector_col).where("digest is not null").orderBy("digest", vector_col).limit(k)
    return [list(r[1]) for r in first.collect()]


def refine(vectors: DataFrame, vector_col: str, centroids: list[list[int]]) -> list[list[int]]:
    """One round: each centroid becomes the floor of the mean of the vectors nearest to it; one without vectors stays.

    Every task adds up its own vectors, so a centroid's partial sums are one row a task; the driver gets k times dims sums.
    """
    bisectors, dims = Bisectors.of(centroids), len(centroids[0])

    def add_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for _, x in _slabs(parts, vector_col, dims):
            number = bisectors.nearest(x)
            count += np.bincount(number, minlength=len(centroids))
            np.add.at(total, number, x)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    partial = vectors.select(vector_col).mapInArrow(add_up, "cluster int, n long, total array<long>")
    sums = partial.select("cluster", "n", F.posexplode("total").alias("place", "total"))
    rows = sums.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = [list(c) for c in centroids]
    for r in rows:
        out[r["cluster"]][r["place"]] = int(r["total"]) // r["n"]
    return out


def assign(vectors: DataFrame, id_col: str, vector_col: str, centroids: list[list[int]]) -> DataFrame:
    """`id_col`, `cluster` and `distance` (squared) of every vector."""
    bisectors, dims = Bisectors.of(centroids), len(centroids[0])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slabs(parts, "v", dims):
            number = bisectors.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(number.astype(np.int32)), pa.array(bisectors.distance(x, number))], names=["id", "cluster", "distance"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"id {kind}, cluster int, distance long").withColumnRenamed("id", id_col)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, factor: int) -> DataFrame:
    """`id_col` and `vector_col` of the vectors with exactly `dims` finite components, scaled to integers."""
    vector: Column = F.col(vector_col)
    return df.where((F.size(vector) == dims) & is_finite(vector)).select(id_col, scaled(vector, factor).alias(vector_col))


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, factor: int = 64, k: int = 16, rounds: int = 3, seed: int = 1,
) -> DataFrame:
    """Cluster vectors around `k` centroids: `id_col`, `cluster`, `distance`, `cluster_inertia`, `inertia`, `centroid_sha256`.

    A component x counts as floor(factor * x). Rows with a null vector, another number of components than `dims`, or a null
    or non-finite component are left out. Centroids start as the vectors with the smallest hash of `seed` and id, are replaced
    `rounds` times by the exact floor of the mean of their vectors, and every vector is then assigned once more. Distances are
    squared; of equal distances the smaller number wins. With fewer vectors than `k` there are as many centroids as vectors; an
    empty table gives no rows. A row with a null id starts no centroid but is clustered like any other, and repeated rows count each;
    if all ids are null, no centroid can start and the answer is empty. Other columns are ignored. Components of 2**27 or more
    after scaling raise an error, since distances would not fit a long.

    Each round reads the table once and sends k * dims sums to the driver, whatever the number of vectors; the centroids and the
    normals of their pairs (k * k * dims longs) travel with the tasks.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, id_col, vector_col, dims, factor)
    centroids = first_centroids(vectors, id_col, vector_col, k, seed)
    kind = df.schema[id_col].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = refine(vectors, vector_col, centroids)
    assigned = cut_lineage(assign(vectors, id_col, vector_col, centroids), "clusters")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame(
        [(i, inertia[i], sum(inertia.values()), digests[i]) for i in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
