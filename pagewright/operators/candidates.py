"""Candidate selection: blocks that a subtask has to judge.

Blocks have doc_id, pos (0-based reading order), page, type, content and x1..y2; a
document is one window partition or join key, never the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry, text

# Types of the subtasks.
TITLES = ("title", "TOC-title", "section-title")
VISUAL = ("image_block", "image", "table", "chart", "table_footnote", "image_footnote", "table_caption", "image_caption", *TITLES, "figure", "fig-title", "fig-caption", "tab-title", "tab-caption")
NESTABLE = ("image", "chart", "image_footnote", "image_caption", "figure", "fig-title", "fig-caption")


def continuation_pairs(blocks: DataFrame) -> DataFrame:
    """(doc_id, src, tgt): each cut-off text with the first later text that may continue it.

    The scan stops at titles and equations. Instead of a theta join, three pointers
    per row: the next eligible text, the next one without a leading digit, the next stop.
    The order is reversed, as a frame that grows is kept up row by row and one that shrinks isn't.
    """
    later = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    body = F.col("type").isin("text", "list_item")
    marked = blocks.select(
        "doc_id", "pos",
        (body & text.may_continue(F.col("content"))).alias("left"),
        (body & text.may_be_continued_by(F.col("content"))).alias("right"),
        F.coalesce(text.starts_with_digit(F.col("content")), F.lit(False)).alias("digit"),
        (F.col("type").contains("equation") | F.col("type").contains("title")).alias("stop"),
    )
    first = lambda cond: F.last(F.when(cond, F.col("pos")), ignorenulls=True).over(later)
    seen = marked.select("doc_id", "pos", "left", "digit", first(F.col("right")).alias("any"), first(F.col("right") & ~F.col("digit")).alias("plain"), first(F.col("stop")).alias("stop"))
    target = F.when(F.col("digit"), F.col("plain")).otherwise(F.col("any"))
    return seen.where(F.col("left")).select("doc_id", F.col("pos").alias("src"), target.alias("tgt"), "stop").where("tgt is not null and (stop is null or tgt < stop)").drop("stop")


def continuation_candidates(blocks: DataFrame) -> DataFrame:
    """Blocks of the pairs with shortened content and their order in the prompt."""
    pairs = continuation_pairs(blocks)
    # A target comes right after the first source that names it; a source at its own place.
    ends = pairs.select("doc_id", F.explode(F.array(F.struct(F.col("src").alias("pos"), F.col("src").alias("a"), F.lit(0).alias("b")), F.struct(F.col("tgt").alias("pos"), F.col("src").alias("a"), F.lit(1).alias("b")))).alias("e")).select("doc_id", "e.*")
    order = ends.groupBy("doc_id", "pos").agg(F.min(F.struct("a", "b")).alias("o"))
    ranked = order.select("doc_id", "pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("o.a", "o.b")).alias("ord"))
    chosen = blocks.join(ranked, ["doc_id", "pos"])
    return chosen.select("doc_id", F.col("pos").alias("idx"), "ord", text.shortened(F.col("content")).alias("content"), "page", geometry.prompt_box(*[F.col(c) for c in geometry.BOX]).alias("box"))


def title_candidates(blocks: DataFrame, chars: int | None = 50) -> DataFrame:
    """Titles with their first ``chars`` characters (None: whole)."""
    body = F.col("content") if chars is None else F.left(F.col("content"), F.lit(chars))
    return blocks.where(F.col("type").isin(*TITLES)).select(
        "doc_id", F.col("pos").alias("idx"), F.col("pos").alias("ord"), body.alias("content"), "page", geometry.prompt_box(*[F.col(c) for c in geometry.BOX]).alias("box")
    )


def visual_blocks(blocks: DataFrame) -> DataFrame:
    kind = F.when(F.col("type") == "seal", F.lit("image")).otherwise(F.col("type"))
    return blocks.withColumn("type", kind).where(F.col("type").isin(*VISUAL))


def containment_links(blocks: DataFrame) -> DataFrame:
    """(doc_id, src, tgt): the first large block that contains a nestable one; pages aren't compared."""
    visual = visual_blocks(blocks)
    small = visual.where(F.col("type").isin(*NESTABLE)).select("doc_id", F.col("pos").alias("src"), *geometry.BOX)
    large = visual.where(F.col("type") == "image_block").select("doc_id", F.col("pos").alias("tgt"), *[F.col(c).alias(f"l{c}") for c in geometry.BOX])
    inside = (F.col("x1") >= 0.95 * F.col("lx1")) & (F.col("y1") >= 0.95 * F.col("ly1")) & (F.col("x2") <= 1.05 * F.col("lx2")) & (F.col("y2") <= 1.05 * F.col("ly2"))
    return small.join(large, "doc_id").where(inside).groupBy("doc_id", "src").agg(F.min("tgt").alias("tgt"))


def visual_candidates(blocks: DataFrame, chars: int | None = 50) -> DataFrame:
    """Visual blocks that no large block contains, with prompt types and the first ``chars`` characters (None: whole)."""
    visual = visual_blocks(blocks)
    open_ = visual.join(containment_links(blocks).select("doc_id", F.col("src").alias("pos")), ["doc_id", "pos"], "left_anti")
    kind = (
        F.when(F.col("type").isin("image_block", "chart", "figure"), "image").when(F.col("type").isin(*TITLES), "title")
        .when(F.col("type").isin("fig-title", "fig-caption"), "image_caption").when(F.col("type").isin("tab-title", "tab-caption"), "table_caption").otherwise(F.col("type"))
    )
    shown = F.col("content") if chars is None else F.left(F.col("content"), F.lit(chars))
    body = F.when(kind.isin("image", "table"), F.lit("None")).otherwise(shown)
    return open_.select("doc_id", F.col("pos").alias("idx"), F.col("pos").alias("ord"), kind.alias("type"), body.alias("content"), "page", geometry.prompt_box(*[F.col(c) for c in geometry.BOX]).alias("box"))


def table_pairs(blocks: DataFrame) -> DataFrame:
    """(doc_id, table1, table2): last table of a page and first table of the next page."""
    pages = blocks.where("type = 'table'").groupBy("doc_id", "page").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    upper = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.col("last").alias("table1"))
    return upper.join(pages.select("doc_id", "page", F.col("first").alias("table2")), ["doc_id", "page"]).select("doc_id", "table1", "table2")


def bbox_violations(blocks: DataFrame, strict: bool = True) -> DataFrame:
    """Blocks whose box has a null or non-finite value, is inverted or (strict) leaves the unit square."""
    box = [F.col(c) for c in geometry.BOX]
    missing = F.lit(False)
    for v in box:
        missing = missing | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    inverted = (F.col("x2") < F.col("x1")) | (F.col("y2") < F.col("y1"))
    outside = (F.least(*box) < -1e-6) | (F.greatest(*box) > 1.000001)
    why = F.when(missing, "not finite").when(inverted, "inverted")
    if strict:
        why = why.when(outside, "outside")
    return blocks.withColumn("violation", why).where("violation is not null").select("doc_id", "pos", "violation")


def page_violations(blocks: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Blocks of unknown type."""
    return blocks.where(~F.col("type").isin(*types)).select("doc_id", "pos", "type")
