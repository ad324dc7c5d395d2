"""Centroid clustering (k-means on integers) with annulus search for the nearest centroid.

Vectors of exactly ``dim`` components, none null or non-finite, become integers
``floor(scale * x)``. To find a vector's nearest centroid, centroids are sorted by norm; the exact
distance to the one whose norm is nearest bounds the search to an annulus, as a centroid nearer
than that has a norm within it of the vector's. Binary search gives the run of centroids in the
annulus, those on its edge included, and these are compared exactly in 64-bit integers; of equally
near ones the smaller number wins. The annulus shrinks as nearer centroids are found.

A round is one pass over the written integers: each task adds up its vectors by cluster and sends
a row for each cluster and component, so a cluster that holds a third of all vectors costs no more
than another. The driver gets ``k * dim`` sums a round, whatever the input, and floors them exactly.
Rounds end early where no centroid moves, as all later ones would be the same.

Defined results: vectors that don't qualify are left out; a null id takes part, but never starts a
centroid before those with an id; of rows repeated with an id each takes part, and the one with the
smaller components comes first as a start. With fewer than ``k`` vectors there are as many
centroids. An empty table gives no rows; extra columns aren't read. A component whose integer
reaches 2**26 in size is an error, as distances would no longer be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import scratch

LARGEST = 1 << 26


def integers(vectors: DataFrame, scale: int, dim: int | None, id_column: str, vector_column: str, *more: str) -> DataFrame:
    """vec_id, ``more`` and v: array<int> of ``floor(scale * x)``, of rows that have ``dim`` (if given) finite components."""
    v = vectors[vector_column].cast("array<double>")
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), *(vectors[c] for c in more), v.alias("v"))
    rows = rows.where(F.expr("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"))
    if dim is not None:
        rows = rows.where(F.size("v") == dim)
    fits = F.forall("v", lambda x: F.abs(F.floor(x * F.lit(float(scale)))) < LARGEST)
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    return rows.withColumn("v", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component times {scale} reaches {LARGEST}")).cast("array<int>")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each row's nearest centroid."""
    norms = np.sqrt((centroids * centroids).sum(1).astype(np.float64))
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    own = np.sqrt((x * x).sum(1).astype(np.float64))
    right = np.minimum(np.searchsorted(norms, own), len(norms) - 1)
    left = np.maximum(right - 1, 0)
    begin = np.where(np.abs(norms[left] - own) < np.abs(norms[right] - own), left, right)
    who = order[begin]
    best = ((x - centroids[who]) ** 2).sum(1)
    reach = lambda d: np.sqrt(d.astype(np.float64)) * (1 + 1e-9) + 1e-6  # noqa: E731  rounding never leaves out an edge
    lo = np.searchsorted(norms, own - reach(best), "left")
    hi = np.searchsorted(norms, own + reach(best), "right")
    active, step = np.flatnonzero(lo < hi), 0
    while len(active):
        at = lo[active] + step
        # By now the annulus may have become too narrow for this centroid.
        here = (np.abs(norms[at] - own[active]) <= reach(best[active])) & (at != begin[active])
        rows, number = active[here], order[at[here]]
        d = ((x[rows] - centroids[number]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (number < who[rows]))
        best[rows[better]], who[rows[better]] = d[better], number[better]
        step += 1
        active = active[lo[active] + step < hi[active]]
    return who, best


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each cluster and component of a task's vectors; component -1 counts them."""
    k, dim = centroids.shape
    total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("v"), dim)
            who, _ = nearest(x, centroids)
            order = np.argsort(who, kind="stable")
            found, at = np.unique(who[order], return_index=True)
            total[found] += np.add.reduceat(x[order], at, axis=0)
            count += np.bincount(who, minlength=k)
    used = np.flatnonzero(count)
    table = np.concatenate([count[used, None], total[used]], 1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(used, dim + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, dim), len(used)).astype(np.int32)), pa.array(table.ravel())], names=["cluster", "component", "total"]
    )


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        who, best = nearest(matrix(batch.column("v"), centroids.shape[1]), centroids)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(who.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])


def starts(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of ``seed:vec_id``."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in rows.select(named.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: int = 3, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows = scratch.written(integers(vectors, scale, dim, id_column, vector_column), "integers")
    centroids = np.array(starts(rows, k, seed), np.int64).reshape(-1, dim)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(lambda it, c=centroids: _sums(it, c), "cluster int, component int, total long")
        sums = sums.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        count = {r["cluster"]: int(r["total"]) for r in sums if r["component"] < 0}
        moved = centroids.copy()
        for r in sums:
            if r["component"] >= 0:
                moved[r["cluster"], r["component"]] = int(r["total"]) // count[r["cluster"]]
        if (moved == centroids).all():
            break
        centroids = moved
    assigned = scratch.written(rows.mapInArrow(lambda it: _assigned(it, centroids), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    by_cluster = lambda values: F.get(F.array(*(F.lit(x) for x in values)), F.col("cluster"))  # noqa: E731  k literals
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return assigned.select(
        "vec_id", "cluster", "distance",
        by_cluster([inertia.get(j, 0) for j in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        by_cluster(names).alias("centroid_sha256"),
    )
