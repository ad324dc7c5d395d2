"""Tables that outlive a job: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new one only where that is unset, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="pagewright-runs-"))
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own below ``folder``, deleted when the application ends."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


#: Setting of a session by which Spark deletes what a query has shuffled when the query ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end within leave no shuffle files; the setting of the session is put back."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)
