"""Nested JSON of documents, built from rows at the end only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry
from pagewright.operators import tree

FORMATS = ("post-processing", "normalized", "pages", "title-blocks")


def pages_json(blocks: DataFrame) -> DataFrame:
    """doc_id, pages: JSON of a map from page to its blocks in order; null fields are left out."""
    block = F.struct(F.col("fine_type").alias("type"), "content", F.array(*geometry.BOX).alias("bbox"), "title_level", "source_label", F.col("block_id").alias("source_id"))
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("order", block.alias("b")))).alias("l")).select("doc_id", "page", F.transform("l", lambda x: x["b"]).alias("blocks"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "blocks"))).alias("l"))
    return docs.select("doc_id", F.to_json(F.map_from_entries(F.transform("l", lambda x: F.struct(x["page"].cast("string"), x["blocks"])))).alias("pages"))


def title_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where("type = 'title'").select("doc_id", "block_id", "page", "order", "content", "title_level", *geometry.BOX)


def serialized(blocks: DataFrame, fmt: str, model: str) -> DataFrame:
    """doc_id and the JSON text of a format."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    if fmt in ("post-processing", "pages"):
        pages = pages_json(blocks)
        if fmt == "pages":
            return pages.select("doc_id", F.col("pages").alias("json"))
        head = F.to_json(F.struct(F.lit(model).alias("model"), "doc_id", F.col("doc_id").cast("string").alias("input_label")))
        return pages.select("doc_id", F.concat(F.left(head, F.length(head) - 1), F.lit(',"pages":'), "pages", F.lit("}")).alias("json"))
    rows = blocks.where("type = 'title'") if fmt == "title-blocks" else blocks
    one = F.struct("block_id", "page", F.array(*geometry.BOX).alias("bbox"), "type", "content", "order", "fine_type", "title_level", "source_label")
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("order", one.alias("b")))).alias("l"))
    return docs.select("doc_id", F.to_json(F.struct(F.lit(model).alias("model_name"), "doc_id", F.lit("ok").alias("status"), F.transform("l", lambda x: x["b"]).alias("blocks"))).alias("json"))


def block_list_json(blocks: DataFrame) -> DataFrame:
    """doc_id, json: the annotated block list of each document in reading order."""
    fields = [c for c in blocks.columns if c not in ("doc_id", "pos", *geometry.BOX)]
    one = F.struct(*fields, F.array(*geometry.BOX).alias("bbox"))
    return blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("b")))).alias("l")).select("doc_id", F.to_json(F.transform("l", lambda x: x["b"])).alias("json"))


def tree_json(nodes: DataFrame) -> DataFrame:
    """doc_id, json: nested trees from the rows of ``tree.whole`` (doc_id, preorder, depth, type and the node's fields).

    Each row opens its object, and closes those that end with it: as many as the depth falls to the next row. So the
    rows of a document, joined in preorder, are its text, whatever the depth. Parts of a text are its ``subnode``; so
    are the children of a figure; furniture has no children.
    """
    w = Window.partitionBy("doc_id").orderBy("preorder")
    rows = nodes.select(
        "doc_id", "preorder", "depth", "type", F.to_json(F.struct("type", "title", "metadata", "content", "level", "location", "block_ids")).alias("own"),
        F.lag("depth").over(w).alias("before"), F.lag("type").over(w).alias("type_before"), F.coalesce(F.lead("depth").over(w), F.lit(0)).alias("after"), F.coalesce(F.lead("type").over(w), F.lit("")).alias("type_after"),
    )
    part, kind = F.col("type") == "sub_text", F.col("type")
    inner = F.col("after") > F.col("depth")
    furniture = kind.isin(*tree.FURNITURE)
    # Parts come before the other children of a text and end its list of subnodes.
    first_child = (F.col("type_before") == "sub_text") & ~part & (F.col("before") == F.col("depth"))
    comma = F.when((F.col("before") >= F.col("depth")) & ~first_child, ",").otherwise("")
    opened = (
        F.when(part, F.concat(F.lit(',"children":[]}'), F.when((F.col("type_after") == "sub_text") & (F.col("after") == F.col("depth")), "").otherwise('],"children":[')))
        .when(furniture, ',"subnode":[]}')
        .when(kind.isin(*tree.FIGURES) & inner, ',"children":[],"subnode":[')
        .when((F.col("type_after") == "sub_text") & inner, ',"subnode":[')
        .otherwise(',"subnode":[],"children":[')
    )
    ends = F.greatest(F.col("depth") - F.col("after") + F.when(part | furniture, 0).otherwise(1), F.lit(0))
    text = F.concat(comma, F.left("own", F.length("own") - 1), opened, F.repeat(F.lit("]}"), ends))
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("preorder", text.alias("text")))).alias("l"))
    return whole.select("doc_id", F.array_join(F.transform("l", lambda x: x["text"]), "").alias("json"))


def write_documents(rows: DataFrame, path: str) -> None:
    """One JSON text a document, by Spark's writer (doc_id, json)."""
    rows.select("doc_id", "json").write.mode("overwrite").json(path)
