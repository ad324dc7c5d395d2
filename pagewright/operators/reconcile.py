"""Answers of overlapping chunks brought together and written back to blocks."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.plans import kernels


def distinct_links(answers: DataFrame) -> DataFrame:
    """(doc_id, src_id, tgt_id, ord): each pair once, in order of first sight (chunk, line_no)."""
    first = answers.groupBy("doc_id", "src_id", "tgt_id").agg(F.min(F.struct("chunk", "line_no")).alias("o"))
    return first.select("doc_id", "src_id", "tgt_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("o.chunk", "o.line_no", "src_id", "tgt_id")).alias("ord"))


def synchronized_levels(answers: DataFrame) -> DataFrame:
    """(doc_id, id, level): title levels of chunks (doc_id, range_sum, line_no, id, level) on one scale.

    Chunks come in order of their range sums. Where a chunk repeats titles, the mean
    difference to the known levels (rounded half to even) is taken off its new ones; of
    titles named twice in one chunk the first counts. One pass over the rows of each
    document, which holds its levels so far and one chunk.
    """
    rows = answers.selectExpr("doc_id", "range_sum", "line_no", "cast(id as int) id", "cast(level as int) level")
    return kernels.by_document(rows, ["range_sum", "line_no", "id", "level"], "id int, level int", _on_one_scale)


def _on_one_scale(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc, of_document in groupby(rows, key=lambda r: r[0]):
        known: dict = {}
        for _, chunk in groupby(of_document, key=lambda r: r[1]):
            lines = [(r[3], r[4]) for r in chunk]
            shared = [level - known[i] for i, level in lines if i in known and level is not None and level >= 0 and known[i] is not None and known[i] >= 0]
            bias = round(Fraction(sum(shared), len(shared))) if shared else 0
            fresh: dict = {}
            for i, level in lines:
                if i not in known:
                    fresh.setdefault(i, level - bias if level is not None and level > 0 else level)
            known |= fresh
            yield from ((doc, i, level) for i, level in fresh.items())


def written_back(blocks: DataFrame, contd: DataFrame, levels: DataFrame, image: DataFrame, contained: DataFrame) -> DataFrame:
    """Blocks with contd, level and image: answers by 0-based place, values as 1-based ids, -1 where there is none.

    The last answer for a source counts; a large block that contains a figure overrides
    its answer; places outside the document are dropped, not wrapped.
    """
    last = lambda links: links.groupBy("doc_id", F.col("src_id").alias("pos")).agg(F.max_by("tgt_id", "ord").alias("tgt"))
    out = blocks.join(last(contd).withColumnRenamed("tgt", "contd_to"), ["doc_id", "pos"], "left")
    out = out.join(last(image).withColumnRenamed("tgt", "image_to"), ["doc_id", "pos"], "left")
    out = out.join(contained.select("doc_id", F.col("src").alias("pos"), F.col("tgt").alias("inside")), ["doc_id", "pos"], "left")
    out = out.join(levels.where("level >= 0").select("doc_id", F.col("id").alias("pos"), F.col("level").alias("new_level")), ["doc_id", "pos"], "left")
    number = lambda c: F.coalesce(F.col(c).cast("long") + 1, F.lit(-1)).cast("long")
    return out.select(*blocks.columns, number("contd_to").alias("contd"), F.coalesce("new_level", F.lit(-1)).alias("level"), F.coalesce((F.col("inside") + 1).cast("long"), number("image_to")).alias("image"))
