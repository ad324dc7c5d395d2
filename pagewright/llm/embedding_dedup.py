"""Embedding near-duplicates: sign hashes in several tables, exact cosines, connected components.

Equal vectors are one class, aggregated before anything is compared. In each table a
class's bucket is the sign pattern of random hyperplanes; the number of signs grows
with the logarithm of the input, so that a bucket of unrelated vectors keeps its
size, and the number of tables is what keeps the chance of missing a pair at the
threshold under ``MISS``. A bucket is compared in blocks of at most ``BLOCK`` rows: a
large one is dealt to as many tasks as it has pairs of blocks, so no group lands in one
task. A pair counts in the first table that brings it together only, so links are
counted without listing pairs; a block passes on a row for each linked class.

Defined results: vectors (or ids) that are null, zero or hold null or non-finite
components link with nothing and stay; vectors of different lengths aren't compared;
repeated rows are vectors of their own. An empty table gives no rows; extra columns
aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import grouped, scratch
from pagewright.llm.components import components

#: Chance that a pair exactly at the threshold meets in no table; pairs above it are missed less.
MISS = 0.002
BLOCK = 2048
SEED = 7


def shape(n: int, threshold: float) -> tuple[int, int]:
    """Signs a table and tables for ``n`` classes."""
    signs = min(24, max(10, math.ceil(math.log2(max(n, 1) / 100))))
    p = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(MISS) / math.log(1 - p))


def _planes(dim: int, signs: int, tables: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((dim, signs * tables))


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))[:-1])


def _signed(batches: Iterator[pa.RecordBatch], signs: int, tables: int) -> Iterator[pa.RecordBatch]:
    weights = 1 << np.arange(signs, dtype=np.int64)
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = _rows(batch.column(2)) if batch.num_rows else []
        buckets = np.zeros((len(vectors), tables), np.int32)
        lengths = np.array([len(v) for v in vectors])
        for dim in np.unique(lengths):
            if dim not in planes:
                planes[dim] = _planes(int(dim), signs, tables)
            at = np.flatnonzero(lengths == dim)
            x = np.stack([vectors[i] for i in at]).astype(np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            buckets[at] = ((x @ planes[dim] > 0).reshape(len(at), tables, signs) * weights).sum(2)
        ends = np.arange(0, buckets.size + 1, tables, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, buckets.ravel())], names=["cid", "n", "v", "buckets"])


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for table in grouped.whole(batches, ["t", "dim", "bucket", "i", "j"]):
        keys = [table[k].to_numpy() for k in ("t", "dim", "bucket", "i", "j")]
        cid, n, block = table["cid"].to_numpy(), table["n"].to_numpy(), table["block"].to_numpy()
        dims = keys[1]
        v, b = table["v"].combine_chunks(), table["buckets"].combine_chunks()
        tables = len(b[0]) if len(b) else 0
        buckets = b.flatten().to_numpy(zero_copy_only=False).reshape(-1, max(tables, 1))
        flat = v.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(dims)])
        cut = grouped.runs(keys)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi - lo < 2:
                continue
            x = flat[at[lo] : at[hi]].reshape(hi - lo, -1).astype(np.float64)
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            link = x @ x.T >= threshold
            np.fill_diagonal(link, False)
            if keys[3][lo] != keys[4][lo]:  # two blocks: pairs between them only
                link &= block[lo:hi, None] != block[None, lo:hi]
            if not link.any():
                continue
            own = np.flatnonzero(link.any(1))
            link = link[np.ix_(own, own)]
            earlier = buckets[lo:hi][own][:, : keys[0][lo]]
            counted = link.copy()
            for k in range(earlier.shape[1]):
                counted &= earlier[:, None, k] != earlier[None, :, k]
            weight = n[lo:hi][own]
            label = np.arange(len(own))
            while True:
                least = np.minimum(label, np.where(link, label[None, :], len(own)).min(1))
                least = np.minimum(least, least[least])
                if (least == label).all():
                    break
                label = least
            ids = cid[lo:hi][own]
            out.append((ids, counted @ weight, ids[label]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["cid", "links", "root"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    # Floats stay floats on their way (half the bytes); cosines are taken in double precision.
    kind = "float" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "double"
    base = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].cast(f"array<{kind}>").alias("v"))
    fit = F.expr("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    base = base.withColumn("v", F.when(fit, F.col("v")))
    classes = scratch.written(base.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")).select(F.xxhash64("v").alias("cid"), "n", "v", "least"), "classes")
    signs, tables = shape(classes.count(), threshold)
    signed = scratch.written(classes.select("cid", "n", "v").mapInArrow(lambda it: _signed(it, signs, tables), f"cid long, n long, v array<{kind}>, buckets array<int>"), "signed")
    rows = signed.select("cid", F.size("v").alias("dim"), F.posexplode("buckets").alias("t", "bucket"))
    large = rows.groupBy("t", "dim", "bucket").agg(F.count(F.lit(1)).alias("m")).where(f"m > {BLOCK}")
    full = signed.select("cid", "n", "v", "buckets", F.size("v").alias("dim"), F.posexplode("buckets").alias("t", "bucket"))
    dealt = (
        full.join(large, ["t", "dim", "bucket"], "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int"))
        .withColumn("block", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "dim", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "n", "v", "buckets")
    )
    key = ["t", "dim", "bucket", "i", "j"]
    links = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda it: _linked(it, threshold), "cid long, links long, root long")
    links = scratch.written(links, "links")
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    found = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    member = classes.select("cid", "v", "n", "least").join(found.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    member = member.select("cid", "v", "n", F.coalesce("component", "cid").alias("component"), F.coalesce("links", F.lit(0)).alias("links"), "least")
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    member = scratch.written(member.join(named, "component").select("v", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id").where("n_links > 0"), "member")
    return base.join(member, "v", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )
