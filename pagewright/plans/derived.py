"""Block tables derived from the driver's tables, in Spark and as SQL text, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_blocks(spark: SparkSession, sf_dir: str, open_ends: bool = False) -> DataFrame:
    """A block per line; lines under 60 characters are titles; eight blocks a page."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    if open_ends:
        lines = lines.withColumn("content", F.when(F.col("pos") % 2 == 0, F.left("content", F.greatest(F.length("content") - 1, F.lit(0)))).otherwise(F.col("content")))
    y = (F.col("pos") % 8).cast("double") * 0.125
    return lines.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), (F.col("pos") + 1).cast("long").alias("id"), (F.floor(F.col("pos") / 8) + 1).cast("int").alias("page"),
        F.when(F.length("content") < 60, "title").otherwise("text").alias("type"), "content", F.lit(0.1).alias("x1"), y.alias("y1"), F.lit(0.9).alias("x2"), (y + 0.1).alias("y2"),
    )


def mixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of blocks in turn, with links of captions and notes to what they follow."""
    kinds = F.array(*[F.lit(k) for k in ("title", "text", "image", "image_caption", "image_block", "table", "table_footnote", "header")])
    b = doc_blocks(spark, sf_dir).withColumn("k", ((F.col("pos") + F.col("doc_id")) % 8).cast("int")).withColumn("type", F.get(kinds, F.col("k")))
    x = (F.col("pos") % 5).cast("double") * 0.125
    large = F.col("type") == "image_block"
    return b.select(
        "doc_id", "pos", "id", "page", "type", "content",
        F.when(large, 0.0).otherwise(x).alias("x1"), F.when(large, 0.0).otherwise(x).alias("y1"), F.when(large, x + 0.25).otherwise(x + 0.125).alias("x2"), F.when(large, x + 0.25).otherwise(x + 0.125).alias("y2"),
        F.when(F.col("type") == "title", (F.col("pos") % 3 + 1).cast("int")).otherwise(-1).alias("level"),
        F.when(F.col("type").isin("image_caption", "table_footnote"), F.col("id") - 1).when((F.col("type") == "image") & (F.col("pos") % 3 == 0), F.col("id") + 2).otherwise(-1).cast("long").alias("image"),
        F.when((F.col("type") == "text") & (F.col("pos") % 3 == 0), F.col("id") + 8).otherwise(-1).cast("long").alias("contd"),
    )


TREE_KINDS = ("title", "text", "image", "image_caption", "image_block", "text", "text", "table", "table_footnote", "text", "header", "text")


def tree_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of whole trees: several texts under a title, figures in figures, captions, notes and furniture."""
    kinds = F.array(*[F.lit(k) for k in TREE_KINDS])
    b = doc_blocks(spark, sf_dir).withColumn("type", F.get(kinds, ((F.col("pos") + F.col("doc_id")) % 12).cast("int")))
    kind, pos = F.col("type"), F.col("pos")
    link = F.when(kind.isin("image_caption", "table_footnote"), F.col("id") - 1).when((kind == "image") & (pos % 3 == 0), F.col("id") + 2).when((kind == "image_block") & (pos % 5 < 2), F.col("id") + 3).when((kind == "table") & (pos % 4 == 0), F.col("id") - 1)
    return b.withColumns({
        "level": F.when(kind == "title", (pos % 3 + 1).cast("int")).otherwise(-1), "image": F.coalesce(link, F.lit(-1)).cast("long"),
        "contd": F.when((kind == "text") & (pos % 3 == 0), F.col("id") + 4).otherwise(-1).cast("long"),
    })


def long_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item a line on pages with gaps."""
    p = F.col("pos")
    return doc_blocks(spark, sf_dir).select("doc_id", "pos", (p * 3 - p % 3 * p % 7 + 1).cast("int").alias("page"))


def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_blocks(spark, sf_dir).where("type = 'title'").withColumn("level", (F.col("pos") % 3 + 1).cast("int"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order in a total order, dealt to two pages."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return li.select("*", F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n"))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two HTML tables an order (doc_id, id, pos, page, type, content, x1..y2): a header row and its lines; every fourth order's are linked."""
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    rows = order_rows(spark, sf_dir)
    row = F.concat(F.lit("<tr>"), cell("l_linenumber"), cell("l_partkey"), cell("l_returnflag"), F.lit("</tr>"))
    half = F.when(F.col("rn") <= F.ceil(F.col("n") / 2), 1).otherwise(2)
    got = rows.select(F.col("l_orderkey").alias("doc_id"), half.alias("page"), F.struct("rn", row.alias("row")).alias("r")).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]), "").alias("body"))
    html = F.concat(F.lit("<table><tr><th>line</th><th>part</th><th>flag</th></tr>"), F.col("body"), F.lit("</table>"))
    linked = F.col("doc_id") % 4 == 0
    return got.select(
        "doc_id", F.col("page").cast("long").alias("id"), (F.col("page") - 1).cast("long").alias("pos"), F.col("page").cast("int").alias("page"), F.lit("table").alias("type"), html.alias("content"),
        F.lit(0.1).alias("x1"), F.lit(0.1).alias("y1"), F.lit(0.9).alias("x2"), F.lit(0.9).alias("y2"), F.when(linked, 3 - F.col("page")).otherwise(-1).cast("long").alias("table_merge"), F.lit(-1).cast("long").alias("image"), F.lit(None).cast("array<int>").alias("cell_list"),
    )


def pixel_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout items of documents in page pixels, in reversed order on each page."""
    b = doc_blocks(spark, sf_dir)
    k = F.col("pos") % 8
    return b.select("doc_id", "pos", "page", "content", k.cast("int").alias("k"), (7 - k).cast("int").alias("rank"), F.array(F.lit(100.0), k * 10.0, F.lit(900.0), k * 10.0 + 10.0).alias("bbox"))


# SQL of the same tables.
DOC_BLOCKS = """doc_blocks AS (
  SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(pos + 1 AS BIGINT) AS id, CAST(pos // 8 + 1 AS INTEGER) AS page, CASE WHEN length(content) < 60 THEN 'title' ELSE 'text' END AS type, content,
    CAST(0.1 AS DOUBLE) AS x1, CAST(pos % 8 AS DOUBLE) * CAST(0.125 AS DOUBLE) AS y1, CAST(0.9 AS DOUBLE) AS x2, CAST(pos % 8 AS DOUBLE) * CAST(0.125 AS DOUBLE) + CAST(0.1 AS DOUBLE) AS y2
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
)"""
DOC_BLOCKS_OPEN = DOC_BLOCKS.replace("doc_blocks AS (", "lines AS (") + """, doc_blocks AS (
  SELECT * REPLACE (CASE WHEN pos % 2 = 0 THEN left(content, greatest(length(content) - 1, 0)) ELSE content END AS content, CASE WHEN length(CASE WHEN pos % 2 = 0 THEN left(content, greatest(length(content) - 1, 0)) ELSE content END) < 60 THEN 'title' ELSE 'text' END AS type) FROM lines
)"""
MIXED = DOC_BLOCKS + """, kinds AS (
  SELECT *, ['title', 'text', 'image', 'image_caption', 'image_block', 'table', 'table_footnote', 'header'][(pos + doc_id) % 8 + 1] AS kind, CAST(pos % 5 AS DOUBLE) * CAST(0.125 AS DOUBLE) AS x FROM doc_blocks
), mixed AS (
  SELECT doc_id, pos, id, page, kind AS type, content, CASE WHEN kind = 'image_block' THEN 0.0 ELSE x END AS x1, CASE WHEN kind = 'image_block' THEN 0.0 ELSE x END AS y1,
    CASE WHEN kind = 'image_block' THEN x + 0.25 ELSE x + 0.125 END AS x2, CASE WHEN kind = 'image_block' THEN x + 0.25 ELSE x + 0.125 END AS y2,
    CASE WHEN kind = 'title' THEN pos % 3 + 1 ELSE -1 END AS level,
    CASE WHEN kind IN ('image_caption', 'table_footnote') THEN id - 1 WHEN kind = 'image' AND pos % 3 = 0 THEN id + 2 ELSE -1 END AS image,
    CASE WHEN kind = 'text' AND pos % 3 = 0 THEN id + 8 ELSE -1 END AS contd
  FROM kinds
)"""
TREE_BLOCKS = DOC_BLOCKS + f""", kinds AS (
  SELECT *, [{', '.join(f"'{k}'" for k in TREE_KINDS)}][(pos + doc_id) % 12 + 1] AS kind FROM doc_blocks
), mixed AS (
  SELECT doc_id, pos, id, page, kind AS type, content, x1, y1, x2, y2, CASE WHEN kind = 'title' THEN pos % 3 + 1 ELSE -1 END AS level,
    CASE WHEN kind IN ('image_caption', 'table_footnote') THEN id - 1 WHEN kind = 'image' AND pos % 3 = 0 THEN id + 2 WHEN kind = 'image_block' AND pos % 5 < 2 THEN id + 3 WHEN kind = 'table' AND pos % 4 = 0 THEN id - 1 ELSE -1 END AS image,
    CASE WHEN kind = 'text' AND pos % 3 = 0 THEN id + 4 ELSE -1 END AS contd
  FROM kinds
)"""
LONG_PAGES = DOC_BLOCKS + ", long_pages AS (SELECT doc_id, pos, CAST(pos * 3 - pos % 3 * pos % 7 + 1 AS INTEGER) AS page FROM doc_blocks)"
ORDER_TABLES = """order_rows AS (
  SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
), order_halves AS (SELECT *, CASE WHEN rn <= ceil(n / 2) THEN 1 ELSE 2 END AS page FROM order_rows)"""
PIXELS = DOC_BLOCKS + ", pixels AS (SELECT doc_id, pos, page, content, CAST(pos % 8 AS INTEGER) AS k, CAST(7 - pos % 8 AS INTEGER) AS rank FROM doc_blocks)"
