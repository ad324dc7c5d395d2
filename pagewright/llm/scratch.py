"""Written intermediate tables and document lookups that survive lost executors.

Tables go to the shared folder that ``spark.checkpoint.dir`` names, so every
executor can read them again; only where it is unset (tests, one machine) a
folder of our own is made. They are deleted when the application ends.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()
_own: dict[str, str] = {}


#: Rows of an Arrow batch: texts may be long, and both sides of the Python worker hold some batches.
BATCH_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, and bound Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="pagewright-code-"), "pagewright.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or a new one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        found = _own[app]
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    for tables in getattr(_passing, "open", []):
        tables.append(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


#: The tables written so far by the calls of ``settled`` that this thread is in.
_passing = threading.local()


def settled(build: Callable[[], DataFrame], label: str, spark: SparkSession) -> DataFrame:
    """``written`` of what ``build`` returns. Tables written on the way are deleted then: no later job may read them."""
    tables: list = []
    _passing.open = [*getattr(_passing, "open", []), tables]
    try:
        df = build()
    finally:
        _passing.open = _passing.open[:-1]
    out = written(df, label)
    for path in tables:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


#: Bits of the membership map: 4 MB whatever the input; more ids only let more rows through.
MAP_BITS = 25


def maybe_in(ids: DataFrame, column: str) -> "callable":
    """A test for longs that is true for every value of ``ids[column]`` and for few others.

    A fixed-size bit map (two bits an id, 4 MB) is built with one aggregation whose
    result has at most ``2**MAP_BITS / 64`` rows at any input size. It only saves
    shuffling rows that a later join would drop; it never decides a result.
    """
    spark = ids.sparkSession
    mask = (1 << MAP_BITS) - 1
    key = F.col(column).cast("long")
    bits = ids.select(F.explode(F.array(F.xxhash64(key).bitwiseAND(mask), F.shiftrightunsigned(F.xxhash64(key), 32).bitwiseAND(mask))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).toPandas()
    table = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    table[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def probe(hashes: pa.Array) -> pa.Array:
        held, h = shared.value, hashes.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        hit = np.ones(len(h), bool)
        for bit in (h & np.uint64(mask), (h >> np.uint64(32)) & np.uint64(mask)):
            hit &= ((held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
        return pa.array(hit)

    return lambda column: probe(F.xxhash64(column.cast("long")))


#: Buckets of keys that are broadcast: so many short rows at most, whatever the input.
MARKS = 1 << 18


def kept_rows(docs: DataFrame, key: Column, decided: DataFrame) -> DataFrame:
    """One row of each key that ``decided`` (key, kept, n) keeps; n is how many rows have the key.

    Rows whose key falls into no bucket of a dropped or repeated one bypass the join, so their texts aren't shuffled.
    """
    mark = F.pmod(F.col("key"), F.lit(MARKS)).cast("int").alias("mark")
    marks = written(decided.where("not kept or n > 1").select(mark).distinct(), "marks")
    rows = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row")).withColumn("mark", mark)
    alone = rows.join(F.broadcast(marks), "mark", "left_anti").select("row.*")
    keepers = decided.where("kept").withColumn("mark", mark).join(F.broadcast(marks), "mark", "left_semi").select("key")
    some = rows.join(F.broadcast(marks), "mark", "left_semi").join(keepers, "key").dropDuplicates(["key"])
    return alone.unionByName(some.select("row.*"))
