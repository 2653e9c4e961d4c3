"""Centroid clustering on whole numbers with Ptolemaic pivots.

Components are floor(scale * x). A few vectors are fixed as pivots, and every vector's distances to them are kept beside
it. Ptolemy's inequality over a pair of pivots p, s bounds the distance of a vector v to a centroid c from below:
d(v, c) >= |d(v, p) d(c, s) - d(v, s) d(c, p)| / d(p, s). In each round a vector is measured exactly against the centroid
whose bounds are lowest; centroids whose bound, rounded down by more than all errors of the arithmetic, lies above that
distance are excluded, and the rest is measured exactly in 64-bit integers. Equal distances go to the smaller number.

A round is one pass over the prepared vectors; tasks pass on a sum for each centroid, so a centroid that holds a third
of all vectors costs no more than others. Only centroids and pivots (a few numbers each) come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from tallyframe.llm._shared import materialize, share, shared

#: Greatest component; squared distances and their parts then fit 64 bits.
LIMIT = 1 << 27
#: Pivots, the first of the seeds; bounds take all their pairs.
PIVOTS = 6
#: Relative error left to the bounds: far above that of the few double operations they take.
SLACK = 1e-9


def prepare(vectors: DataFrame, column: str = "embedding", dimensions: int = 64, scale: int = 64) -> DataFrame:
    """``vectors`` with ``column`` as whole numbers; rows of another size, with null, non-finite or huge components go."""
    x = F.transform(column, lambda v: v.cast("double"))
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < LIMIT))
    return vectors.where((F.size(column) == dimensions) & fine).withColumn(column, whole)


def seeds(vectors: DataFrame, n: int, vec_id: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """The vectors of the ``n`` ids with the smallest SHA-256 of ``1:<id>``; rows with a null id come last."""
    h = F.sha2(F.concat(F.lit("1:"), F.col(vec_id).cast("string")), 256)
    rows = vectors.select(h.alias("h"), F.col(column).alias("x")).orderBy(F.col("h").asc_nulls_last(), "x").limit(n).collect()
    return np.array([r[1] for r in rows], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _pivot_distances(pivots):
    """Arrow kernel: adds the distances to the pivots to the rows (own, x)."""

    def run(batches):
        p = shared(pivots)
        for batch in batches:
            x = _matrix(batch.column(1))
            d = np.stack([np.sqrt(_distances(x, q[None, :]).astype(np.float64)) for q in p], axis=1)
            kept = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(p)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], names=["own", "x", "to_pivots"])

    return run


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid, its squared distance, and how many exact distances that took."""
    of = np.sqrt(np.stack([_distances(centroids, q[None, :]) for q in pivots], axis=1).astype(np.float64))
    pairs = [(i, j, d) for i, j in combinations(range(len(pivots)), 2) if (d := float(np.sqrt(_distances(pivots[i : i + 1], pivots[j : j + 1])[0]))) > 0]
    low = np.zeros((len(x), len(centroids)))
    for i, j, d in pairs:
        one, two = to_pivots[:, i, None] * of[None, :, j], to_pivots[:, j, None] * of[None, :, i]
        # the difference loses digits, so the error is taken from what is subtracted
        np.maximum(low, (np.abs(one - two) - SLACK * (one + two)) / d, out=low)
    low *= 1 - SLACK
    best = low.argmin(axis=1)
    distance = _distances(x, centroids[best])
    measured = len(x)
    for c in range(len(centroids)):
        bound = low[:, c] * low[:, c] * (1 - SLACK)
        left = np.flatnonzero((best != c) & (bound <= distance))
        exact = _distances(x[left], centroids[c][None, :])
        measured += len(left)
        closer = (exact < distance[left]) | ((exact == distance[left]) & (c < best[left]))
        best[left[closer]], distance[left[closer]] = c, exact[closer]
    return best, distance, measured


def _sums(model, dimensions: int):
    """Arrow kernel (own, x, to_pivots) -> for every centroid the count and the component sums of this task's vectors."""

    def run(batches):
        centroids, pivots = shared(model)
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dimensions), np.int64)
        for batch in batches:
            x = _matrix(batch.column(1))
            best, _, _ = nearest(x, _matrix(batch.column(2)), centroids, pivots)
            count += np.bincount(best, minlength=len(centroids))
            np.add.at(total, best, x)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(count[some]), *(pa.array(total[some, i]) for i in range(dimensions))],
            names=["cluster", "n", *(f"s{i}" for i in range(dimensions))],
        )

    return run


def _assign(model):
    """Arrow kernel (own, x, to_pivots) -> (own, cluster, distance)."""

    def run(batches):
        centroids, pivots = shared(model)
        for batch in batches:
            best, distance, _ = nearest(_matrix(batch.column(1)), _matrix(batch.column(2)), centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(distance)], names=["own", "cluster", "distance"])

    return run


def cluster(
    vectors: DataFrame, n: int = 16, rounds: int = 3, vec_id: str = "vec_id", column: str = "embedding", dimensions: int = 64, scale: int = 64, keep: Sequence[str] | None = None
) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` (the columns ``keep``, all if None) with cluster and squared distance, and the final centroids.

    Vectors of another size than ``dimensions``, null ones, and those with a null, non-finite or (after scaling) over
    2^27 large component are left out; squared distances beyond would not fit 64 bits. Of fewer than ``n`` vectors each
    is a centroid; without vectors there are no rows. Equal vectors and repeated rows are vectors like others, so equal
    seeds leave the later of them empty; an empty centroid stays where it is. Rows with a null id are clustered, but
    never seeds while others are there. Columns of ``vectors`` named cluster or distance are replaced.
    """
    spark = vectors.sparkSession
    carried = [c for c in (keep or vectors.columns) if c not in ("cluster", "distance")]
    whole = prepare(vectors.withColumn("__x", F.col(column)), "__x", dimensions, scale)
    centroids = seeds(whole, n, vec_id, "__x")
    own = vectors.select(*carried).schema
    if not len(centroids):
        return spark.createDataFrame([], StructType([*own.fields]).add("cluster", IntegerType()).add("distance", LongType())), centroids
    pivots = centroids[:PIVOTS].copy()
    base = StructType().add("own", own).add("x", ArrayType(LongType()))
    ready = whole.select(F.struct(*carried).alias("own"), F.col("__x").alias("x")).mapInArrow(
        _pivot_distances(share(spark, pivots)), StructType([*base.fields]).add("to_pivots", ArrayType(DoubleType()))
    )
    ready = materialize(ready, "vectors")
    columns = [f"s{i}" for i in range(dimensions)]
    for _ in range(rounds):
        part = ready.mapInArrow(_sums(share(spark, (centroids, pivots)), dimensions), ", ".join(["cluster int", "n long", *(f"{c} long" for c in columns)]))
        totals = part.groupBy("cluster").agg(F.sum("n"), *(F.sum(F.col(c).cast("decimal(38,0)")) for c in columns))
        for r in totals.collect():  # one row a centroid
            centroids[r[0]] = [int(s) // r[1] for s in r[2:]]
    out = ready.mapInArrow(_assign(share(spark, (centroids, pivots))), StructType().add("own", own).add("cluster", IntegerType()).add("distance", LongType()))
    return out.select("own.*", "cluster", "distance"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and the SHA-256 of the own centroid's components."""
    import hashlib

    spark = assigned.sparkSession
    assigned = materialize(assigned, "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = sums.join(spark.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster", "left")
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    return assigned.join(F.broadcast(named.crossJoin(F.broadcast(total))), "cluster")
