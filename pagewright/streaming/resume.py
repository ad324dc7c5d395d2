"""Batch resume and its streaming form: only documents without an output are processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text


def remaining(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents without an output."""
    return docs.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def run_counts(selected: DataFrame, written: DataFrame, violations: DataFrame) -> DataFrame:
    """selected, written, skipped and invalid documents of a run."""
    one = lambda df, name: df.select(F.lit(name).alias("name"), "doc_id").distinct()
    rows = one(selected, "selected").unionByName(one(written, "written")).unionByName(one(violations, "invalid"))
    counts = rows.agg(*[F.count_if(F.col("name") == n).alias(n) for n in ("selected", "written", "invalid")])
    return counts.withColumn("skipped", F.col("selected") - F.col("written"))


def process_files(spark: SparkSession, source: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]):
    """Each new file of a folder once; the checkpoint keeps which are done. Ends when all are."""
    files = spark.readStream.option("wholetext", True).format("text").load(source)
    docs = files.select(text.stem(F.col("_metadata.file_name")).alias("doc_id"), F.col("value").alias("json"))
    return transform(docs).writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
