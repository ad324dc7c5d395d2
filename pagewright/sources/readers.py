"""Vendor layouts to normalized blocks, JVM-side: JSON text in, one row per block out.

A reader takes rows (doc_id, json) of one vendor form and gives (doc_id, page, seq,
item, width, height): every item's JSON in source order. ``blocks`` then types, cleans
and numbers them in one way for all vendors. Documents without a readable source are
rows of ``statuses``, not exceptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry, labels, text

ITEM = (
    "struct<type:string,label:string,block_label:string,content:string,text:string,html:string,words:string,block_content:string,"
    "bbox:array<double>,bbox_2d:array<double>,block_bbox:array<double>,block_order:string,reading_order:string,text_level:int,page_idx:int,"
    "lines:array<struct<spans:array<struct<content:string>>>>,location:struct<left:double,top:double,width:double,height:double>>"
)
#: Of each vendor: label field, box field and the assumed scale of boxes (none: by page size).
FORMS = {
    "paddle": ("block_label", "block_bbox", None), "miner_model": ("type", "bbox", 1000.0), "miner_middle": ("type", "bbox", None), "miner_list": ("type", "bbox", 1000.0),
    "monkey": ("type", "bbox", None), "dolphin": ("label", "bbox", None), "glm_model": ("label", "bbox_2d", 1000.0), "glm_words": ("label", "bbox", None),
}


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (stem), path and json of whole files; a folder is listed by Spark."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("json"), F.input_file_name().alias("path"))
    return files.select(text.stem(F.col("path")).alias("doc_id"), "path", "json")


def doc_ids(paths: DataFrame, limit: int | None = None, column: str = "path") -> DataFrame:
    """Distinct sorted stems; the first ``limit`` if that is positive."""
    ids = paths.select(text.stem(F.col(column)).alias("doc_id")).where("doc_id != ''").distinct().orderBy("doc_id")
    return ids.limit(limit) if limit and limit > 0 else ids


def _listed(c: Column) -> Column:
    return F.from_json(c, "array<string>")


def _sorted(items: Column, key: str) -> Column:
    """By a whole-number field, items without one last, else in source order."""
    numbered = F.transform(items, lambda i, k: F.struct(F.coalesce(F.get_json_object(i, f"$.{key}").try_cast("bigint"), F.lit(2**62)).alias("o"), k.alias("k"), i.alias("i")))
    return F.transform(F.array_sort(numbered), lambda s: s["i"])


def _exploded(pages: DataFrame, items: Column, page: Column, width: Column, height: Column) -> DataFrame:
    rows = pages.select("doc_id", page.cast("int").alias("page"), F.col("p"), width.cast("double").alias("width"), height.cast("double").alias("height"), F.posexplode(items).alias("k", "item"))
    seq = (F.row_number().over(Window.partitionBy("doc_id").orderBy("p", "k")) - 1).alias("seq")
    return rows.select("doc_id", "page", seq, "item", "width", "height")


def paddle(docs: DataFrame) -> DataFrame:
    pages = docs.select("doc_id", F.posexplode(_listed(F.get_json_object("json", "$.result.layoutParsingResults"))).alias("p", "page"))
    at = lambda k: F.get_json_object("page", f"$.prunedResult.{k}")
    return _exploded(pages, _sorted(_listed(at("parsing_res_list")), "block_order"), F.col("p") + 1, at("width"), at("height"))


def _numbered_files(files: DataFrame) -> DataFrame:
    """Page files with their place ``p`` by name and the page of payload or name."""
    number = F.coalesce(F.get_json_object("json", "$.page_index").try_cast("int"), F.nullif(F.regexp_extract("stem", "_([0-9]+)_res$", 1), F.lit("")).try_cast("int"), F.lit(0)) + 1
    return files.withColumn("p", text.page_number_of(F.col("stem"))).withColumn("page", number)


def paddle_page_statuses(files: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, status, message of documents given as page files: missing without any page size, invalid if a page has none."""
    known = sizes.where("width > 0 and height > 0").select("doc_id", "page", F.lit(True).alias("sized")).distinct()
    lacking = F.when(F.col("sized").isNull(), F.col("page"))
    docs = _numbered_files(files).join(known, ["doc_id", "page"], "left").groupBy("doc_id").agg(F.min_by(lacking, F.when(lacking.isNotNull(), F.col("p"))).alias("lacking"))
    got = docs.join(sizes.select("doc_id", F.lit(True).alias("any")).distinct(), "doc_id", "left")
    status = F.when(F.col("any").isNull(), "missing").when(F.col("lacking").isNotNull(), "invalid").otherwise("ok")
    message = F.when(status == "missing", F.concat(F.lit("no page sizes of "), F.col("doc_id"))).when(status == "invalid", F.concat(F.lit("no size of page "), F.col("lacking").cast("string"))).otherwise("")
    return got.select("doc_id", status.alias("status"), message.alias("message"))


def read_paddle_pages(files: DataFrame, sizes: DataFrame, scale: str = "source") -> DataFrame:
    """Blocks of the documents whose page files can all be read."""
    fine = paddle_page_statuses(files, sizes).where("status = 'ok'").select("doc_id")
    return blocks(paddle_pages(files.join(fine, "doc_id", "left_semi"), sizes), "paddle", scale)


def paddle_pages(files: DataFrame, sizes: DataFrame) -> DataFrame:
    """Page files (doc_id, stem, json); boxes are on images of twice the page size (doc_id, page, width, height)."""
    pages = _numbered_files(files).join(sizes.withColumnRenamed("width", "w").withColumnRenamed("height", "h"), ["doc_id", "page"], "left")
    return _exploded(pages, _sorted(_listed(F.get_json_object("json", "$.parsing_res_list")), "block_order"), F.col("page"), F.col("w") * 2, F.col("h") * 2)


def model_pages(docs: DataFrame) -> DataFrame:
    """Lists of lists, lists of page objects, or an object with pages; a page object without items is an item itself."""
    js = F.trim("json")
    whole = F.when(F.startswith(js, F.lit("[")), js).otherwise(F.coalesce(F.get_json_object(js, "$.pages"), F.get_json_object(js, "$.pdf_info")))
    pages = docs.select("doc_id", F.posexplode(_listed(whole)).alias("p", "page"))
    inner = F.coalesce(*[F.nullif(F.get_json_object("page", f"$.{k}"), F.lit("[]")) for k in ("blocks", "items", "elements")])
    is_list = F.startswith(F.trim("page"), F.lit("["))
    items = F.when(is_list, _listed(F.col("page"))).when(F.startswith(inner, F.lit("[")), _listed(inner)).otherwise(F.array("page"))
    own = F.when(~is_list & F.startswith(inner, F.lit("[")), F.coalesce(F.get_json_object("page", "$.page").try_cast("int"), F.get_json_object("page", "$.page_idx").try_cast("int") + 1))
    got = pages.withColumn("own", F.coalesce(own, F.col("p") + 1))
    items = F.filter(items, lambda i: F.startswith(F.trim(i), F.lit("{")))
    return _exploded(got, items, F.col("own"), F.lit(None), F.lit(None))


def middle(docs: DataFrame) -> DataFrame:
    pages = docs.select("doc_id", F.posexplode(_listed(F.get_json_object("json", "$.pdf_info"))).alias("p", "page"))
    at = lambda k: F.get_json_object("page", f"$.{k}")
    return _exploded(pages, _listed(at("para_blocks")), F.coalesce(at("page_idx").try_cast("int"), F.lit(0)) + 1, at("page_size[0]"), at("page_size[1]"))


def content_list(docs: DataFrame) -> DataFrame:
    """Flat items with a box; the page is the item's own."""
    flat = docs.select("doc_id", F.lit(0).alias("p"), F.posexplode(_listed(F.col("json"))).alias("k", "item")).where(F.get_json_object("item", "$.bbox").isNotNull())
    page = F.coalesce(F.get_json_object("item", "$.page_idx").try_cast("int"), F.lit(0)) + 1
    none = F.lit(None).cast("double")
    return flat.select("doc_id", page.alias("page"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1).alias("seq"), "item", none.alias("width"), none.alias("height"))


def dolphin(docs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    pages = docs.select("doc_id", F.posexplode(_listed(F.get_json_object("json", "$.pages"))).alias("p", "body"))
    number = F.get_json_object("body", "$.page_number").try_cast("int")
    pages = pages.withColumn("page", F.when(number > 0, number).otherwise(F.col("p") + 1))
    if sizes is None:
        pages = pages.withColumns({"w": F.lit(None), "h": F.lit(None)})
    else:
        pages = pages.join(sizes.select("doc_id", "page", F.col("width").alias("w"), F.col("height").alias("h")), ["doc_id", "page"], "left")
    return _exploded(pages, _sorted(_listed(F.get_json_object("body", "$.elements")), "reading_order"), F.col("page"), F.col("w"), F.col("h"))


def glm_words(docs: DataFrame) -> DataFrame:
    """Recognized words with left, top, width and height; the page size from three pairs of fields, outer ones first."""
    pages = docs.select("doc_id", F.posexplode(_listed(F.coalesce(F.get_json_object("json", "$.pages"), F.concat(F.lit("["), F.col("json"), F.lit("]"))))).alias("p", "body"))
    response = F.coalesce(F.get_json_object("body", "$.response"), F.col("body"))
    size, width, height = F.lit(None), F.lit(None), F.lit(None)
    for holder in (response, F.col("body")):
        for w, h in (("page_width", "page_height"), ("image_width", "image_height"), ("width", "height")):
            a, b = (F.nullif(F.get_json_object(holder, f"$.{k}").try_cast("double"), F.lit(0.0)) for k in (w, h))
            size = a.isNotNull() & b.isNotNull()
            width, height = F.when(size, a).otherwise(width), F.when(size, b).otherwise(height)
    return _exploded(pages, _listed(F.get_json_object(response, "$.words_result")), F.col("p") + 1, width, height)


def block_text(item: Column) -> Column:
    """The first of content, text, html, words that isn't empty, else the lines' spans."""
    first = F.coalesce(*[F.nullif(item[k], F.lit("")) for k in ("content", "text", "html", "words")])
    lines = F.transform(item["lines"], lambda line: text.normalize_text(F.array_join(F.transform(line["spans"], lambda s: F.coalesce(s["content"], F.lit(""))), "")))
    return F.when(first.isNotNull(), text.normalize_text(first)).otherwise(F.coalesce(F.array_join(F.filter(lines, lambda s: s != ""), " "), F.lit("")))


def blocks(items: DataFrame, form: str, scale: str = "source") -> DataFrame:
    """doc_id, block_id, page, order, type, fine_type, content, title_level, source_label, x1..y2."""
    label_field, box_field, assumed = FORMS[form]
    vendor = {"miner_model": "miner", "miner_middle": "miner", "miner_list": "miner", "glm_model": "glm", "glm_words": "glm"}.get(form, form)
    rows = items.withColumn("i", F.from_json("item", ITEM))
    i = F.col("i")
    label = F.coalesce(i[label_field], F.lit("" if vendor == "dolphin" else "text"))
    if form == "paddle":
        body = text.normalize_text(i["block_content"])
    elif form == "dolphin":
        body = text.normalize_text(i["text"])
    elif form == "glm_words":
        body = text.normalize_text(i["words"])
    else:
        body = block_text(i)
    kind, fine, level = labels.canonical(vendor, label), labels.fine(vendor, label), labels.title_level(vendor, label)
    if form == "glm_words":
        kind = fine = F.lit("text")
    if form == "miner_list":
        is_title = i["text_level"].isNotNull() & (kind != labels.SKIP)
        kind, fine, level = F.when(is_title, "title").otherwise(kind), F.when(is_title, "title").otherwise(fine), F.when(is_title, i["text_level"])
    box = F.coalesce(i[box_field], i["bbox"] if form == "glm_model" else F.lit(None), F.array(*[F.lit(0.0)] * 4))
    if form == "glm_words":
        left, top, w, h = (F.coalesce(i["location"][k], F.lit(0.0)) for k in ("left", "top", "width", "height"))
        box = F.array(left, top, left + w, top + h)
    four = [F.when(F.size(box) >= 4, F.get(box, F.lit(k))).otherwise(0.0) for k in range(4)]
    shown = F.when(i[label_field].isNotNull(), i[label_field]).otherwise("words_result" if form == "glm_words" else "")
    got = rows.select("doc_id", "page", "seq", kind.alias("type"), fine.alias("fine_type"), body.alias("content"), level.cast("int").alias("title_level"), shown.alias("source_label"), *[v.alias(c) for v, c in zip(four, geometry.BOX, strict=True)], "width", "height")
    got = got.where((F.col("fine_type") != labels.SKIP) & ~(F.col("type").isin("text", "title", "caption") & (F.col("content") == "")))
    unit = geometry.to_unit([F.col(c) for c in geometry.BOX], F.col("width"), F.col("height"), assumed)
    got = got.withColumns(dict(zip(geometry.BOX, unit, strict=True)))
    got = got.withColumns(dict(zip(geometry.BOX, geometry.convert([F.col(c) for c in geometry.BOX], F.col("width"), F.col("height"), scale), strict=True)))
    return numbered(got)


def numbered(rows: DataFrame) -> DataFrame:
    """Blocks in page, source and box order with new ids."""
    w = Window.partitionBy("doc_id").orderBy("page", "seq", "y1", "x1")
    got = rows.withColumn("order", (F.row_number().over(w) - 1).cast("int"))
    return got.select("doc_id", F.concat_ws(":", "doc_id", F.col("order").cast("string")).alias("block_id"), "page", "order", F.when(F.col("type").isin(*labels.CANONICAL), F.col("type")).otherwise("text").alias("type"), "fine_type", "content", "title_level", "source_label", *geometry.BOX)


#: Reader of each form.
READERS = {"paddle": paddle, "miner_model": model_pages, "miner_middle": middle, "miner_list": content_list, "monkey": middle, "dolphin": dolphin, "glm_model": model_pages, "glm_words": glm_words}
#: Forms of a vendor in order of precedence.
PRECEDENCE = {"paddle": ("paddle",), "miner": ("miner_model", "miner_middle", "miner_list"), "monkey": ("monkey",), "dolphin": ("dolphin",), "glm": ("glm_model", "glm_words")}


def read(files: DataFrame, vendor: str, scale: str = "source") -> DataFrame:
    """Blocks of documents from rows (doc_id, form, json): each document by its first form in the vendor's precedence."""
    if vendor not in PRECEDENCE:
        raise ValueError(f"unknown vendor: {vendor}")
    chosen = best_form(files, vendor)
    out = None
    for form in PRECEDENCE[vendor]:
        part = blocks(READERS[form](chosen.where(F.col("form") == form).select("doc_id", "json")), form, scale)
        out = part if out is None else out.unionByName(part)
    return out


def best_form(files: DataFrame, vendor: str) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(f) for f in PRECEDENCE[vendor]]), F.col("form"))
    ranked = files.where(rank > 0).withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank)))
    return ranked.where("rn = 1").drop("rn")


def statuses(wanted: DataFrame, files: DataFrame, vendor: str) -> DataFrame:
    """doc_id, status, message of every wanted document: ok, missing, or invalid (no JSON)."""
    got = wanted.join(best_form(files, vendor), "doc_id", "left")
    fine = F.try_parse_json("json").isNotNull()
    status = F.when(F.col("json").isNull(), "missing").when(fine, "ok").otherwise("invalid")
    return got.select("doc_id", status.alias("status"), F.when(status == "missing", F.concat(F.lit("no source of "), F.col("doc_id"))).when(status == "invalid", F.concat(F.lit("not JSON: "), F.col("form"))).otherwise("").alias("message"))


def input_labels(docs: DataFrame, names: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, label: the mapped name, else an existing file's path, else the id."""
    return docs.join(names.select("doc_id", "name"), "doc_id", "left").join(found.select("doc_id", "path"), "doc_id", "left").select("doc_id", F.coalesce("name", "path", F.col("doc_id").cast("string")).alias("label"))


def page_blocks(pages_json: DataFrame) -> DataFrame:
    """Blocks of normalized documents (doc_id, json with ``pages``: page -> list): page order as in the file, then list order.

    Ids count from 1 over the document.
    """
    entry = "array<struct<type:string,content:string,bbox:array<double>,title_level:int,source_label:string>>"
    body = F.coalesce(F.get_json_object("json", "$.pages"), F.col("json"))
    keys = F.json_object_keys(body)
    got = pages_json.select("doc_id", F.from_json(body, f"map<string,{entry}>").alias("m"), F.posexplode(keys).alias("p", "page"))
    rows = got.select("doc_id", F.col("page").try_cast("int").alias("page"), "p", F.posexplode(F.col("m")[F.col("page")]).alias("k", "b"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("p", "k")) - 1
    return rows.select("doc_id", pos.cast("long").alias("pos"), (pos + 1).cast("long").alias("id"), "page", "b.type", "b.content", "b.title_level", "b.source_label", *[F.get("b.bbox", F.lit(k)).alias(c) for k, c in enumerate(geometry.BOX)])
