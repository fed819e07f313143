"""Lloyd's clustering of integer vectors by annulus search.

The triangle inequality confines a vector's nearest centroid to an annulus: if some centroid lies within u of vector x, the
nearest one has a norm between |x| - u and |x| + u. Centroids are sorted by norm. A binary search finds the one whose
norm is nearest to the vector's; its exact distance is u. Two more binary searches find all centroids within the annulus,
a little widened for rounding so that border ties are in, and these are compared exactly, in 64-bit integers; equal
distances go to the smaller number.

Each round is one scan: tasks assign their vectors and hand on one sum a cluster and component, so what is shuffled and
collected is clusters x components a task and in total, whatever the number of vectors. Hot clusters are thus summed
before any shuffle.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part, nor do those with a component
beyond ``LARGEST``, whose squared distances a long can't hold; repeated rows count each; rows of one id have one hash and start in the order of
their components; a null id is clustered, but starts no centroid; with fewer vectors than centroids each starts one; an
empty table gives no rows; other columns are ignored. A sum of distances beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import stored

SCALE, LARGEST, PAIRS = 64, 2**20, 1 << 15


def whole(vectors: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers floor(SCALE * x)."""
    v = F.col(vector_col)
    sound = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def starts(kept: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order."""
    hashed = kept.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    return np.array([r.v for r in hashed.orderBy("hash", "v").limit(k).collect()], np.int64)


class Annuli:
    """Centroids sorted by norm."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids * centroids).sum(axis=1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.number], centroids[self.number]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid."""
        size = np.sqrt((x * x).sum(axis=1))
        at = np.searchsorted(self.norms, size)
        before, after = np.maximum(at - 1, 0), np.minimum(at, len(self.norms) - 1)
        first = np.where(size - self.norms[before] <= self.norms[after] - size, before, after)
        upper = np.sqrt(((x - self.centroids[first]) ** 2).sum(axis=1))
        slack = 1e-9 * (size + upper + 1)
        low = np.searchsorted(self.norms, size - upper - slack, "left")
        many = np.searchsorted(self.norms, size + upper + slack, "right") - low
        number, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        ends = np.cumsum(many)
        done = 0
        while done < len(x):  # so many rows at once that their candidates are about PAIRS
            stop = max(done + 1, int(np.searchsorted(ends, ends[done] - many[done] + PAIRS, "right")))
            own = many[done:stop]
            begin = np.cumsum(own) - own
            candidate = np.arange(own.sum()) + np.repeat(low[done:stop] - begin, own)
            d = ((x[np.repeat(np.arange(done, stop), own)] - self.centroids[candidate]) ** 2).sum(axis=1)
            least = np.minimum.reduceat(d, begin)
            number[done:stop] = np.minimum.reduceat(np.where(d == np.repeat(least, own), self.number[candidate], len(self.norms)), begin)
            distance[done:stop] = least
            done = stop
        return number, distance


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, dim)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each non-empty centroid becomes the floor of its vectors' mean."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, total = Annuli(centroids), np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            x = matrix(batch, dim)
            if len(x):
                number, _ = annuli.nearest(x)
                order = np.argsort(number, kind="stable")
                own, begin, count = np.unique(number[order], return_index=True, return_counts=True)
                total[own, :dim] += np.add.reduceat(x[order], begin, axis=0)
                total[own, dim] += count
        cluster, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(total[cluster, place], pa.int64())], ["cluster", "place", "total"])

    added = kept.select("v").mapInArrow(sums, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total"))
    total = np.zeros((k, dim + 1), np.int64)
    for r in added.collect():  # clusters x (components + 1) rows at most
        total[r.cluster, r.place] = r.total
    some = total[:, dim] > 0
    out = centroids.copy()
    out[some] = total[some, :dim] // total[some, dim:]
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    dim = centroids.shape[1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for batch in batches:
            number, distance = annuli.nearest(matrix(batch, dim))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(near, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Each vector's cluster, squared distance and sums of distances, and the final centroids."""
    kept = whole(vectors, dim, id_col, vector_col)
    centroids = starts(kept, k).reshape(-1, dim)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    made = stored(assigned(kept, centroids), "clusters")
    inertia = {r.cluster: r.d for r in made.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}  # k rows at most
    whole_sum = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, d, whole_sum, digest[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return made.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
