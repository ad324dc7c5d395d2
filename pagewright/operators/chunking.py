"""Overlapping page chunks whose borders lie on pages with many items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.plans import kernels


def ranges(items: DataFrame, size: int = 50, overlap: int = 1, search: int = 5) -> DataFrame:
    """(doc_id, chunk, start, stop) page ranges of each document's items (doc_id, page).

    Every data page gets its next border: of the pages within ``search`` of page + size
    the one with most items (the lowest of equals), else the next page beyond. From the
    first page the pointers are followed to the last one.
    """
    if size <= search:
        raise ValueError("the chunk size must exceed the search range")
    pages = items.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    ends = Window.partitionBy("doc_id")
    pages = pages.select("doc_id", "page", "n", F.min("page").over(ends).alias("lo"), F.max("page").over(ends).alias("hi"))
    # Candidates come by equality on (doc_id, page), not by a range join.
    near = pages.where("page < hi").select("doc_id", F.col("page").alias("from"), "lo", "hi", F.explode(F.sequence(F.greatest(F.col("lo"), F.col("page") + size - search), F.least(F.col("hi"), F.col("page") + size + search))).alias("page")).where("page between greatest(lo, `from` + %d) and least(hi, `from` + %d)" % (size - search, size + search))
    best = near.join(pages.select("doc_id", "page", "n"), ["doc_id", "page"]).groupBy("doc_id", "from").agg(F.max_by("page", F.struct("n", -F.col("page"))).alias("best"))
    # Pages from page + size + 1 on, in reversed order: a growing frame is kept up row by row.
    later = Window.partitionBy("doc_id").orderBy(F.desc("page")).rangeBetween(Window.unboundedPreceding, -(size + 1))
    beyond = pages.select("doc_id", F.col("page").alias("from"), "lo", "hi", F.coalesce(F.min("page").over(later), F.col("hi")).alias("beyond"))
    following = F.when(F.col("from") < F.col("hi"), F.coalesce("best", "beyond"))
    step = beyond.join(best, ["doc_id", "from"], "left").select("doc_id", F.col("from").alias("page"), following.alias("next"), (F.col("from") == F.col("lo")).alias("first"))
    borders = kernels.followed(step)
    span = pages.select("doc_id", "lo", "hi").distinct()
    w = Window.partitionBy("doc_id").orderBy("page")
    cut = borders.select("doc_id", F.col("page").alias("border"), F.lag("page").over(w).alias("before"), (F.row_number().over(w) - 2).alias("chunk")).where("before is not null")
    out = cut.join(span, "doc_id")
    start = F.when(F.col("before") == F.col("lo"), F.col("lo")).otherwise(F.col("before") - overlap)
    return out.select("doc_id", F.col("chunk").cast("int").alias("chunk"), start.cast("int").alias("start"), F.least(F.col("hi"), F.col("border") + overlap).cast("int").alias("stop"))


def members(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items of each chunk (a chunk's pages are joined by equality)."""
    pages = chunks.select("doc_id", "chunk", "start", "stop", F.explode(F.sequence("start", "stop")).alias("page"))
    return items.join(pages, ["doc_id", "page"])


def chunk_pages(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sorted distinct pages of each chunk."""
    return members(items, chunks).groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_set("page")).alias("pages"))
