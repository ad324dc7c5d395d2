"""Document trees as node rows (doc_id, seq, parent, depth, ...); nested JSON is built in sinks only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry
from pagewright.plans import kernels

# Types that aren't running text, and markers between texts.
SPECIAL = ("table_footnote", "table", "chart", "table_caption", "image_footnote", "image", "image_caption", "seal")
LARGE = ("super", "list", "ref_block", "equation_block", "image_block")
FURNITURE = ("page_title", "page_number", "page_footnote", "header", "aside_text", "footer")
FIGURES = ("table", "chart", "image", "seal", "image_block")
CONTINUED, SPLIT = "<|txt_contd|>", "<|txt_split|>"
NO_TITLE = "Default Title"


def place(blocks: DataFrame) -> Column:
    """Box and page of a block; null where the blocks have none."""
    if not {"page", *geometry.BOX} <= set(blocks.columns):
        return F.lit(None).cast("struct<bbox:array<double>,page:int>")
    return F.struct(F.array(*(F.col(c).cast("double") for c in geometry.BOX)).alias("bbox"), F.col("page").cast("int").alias("page"))


def components(blocks: DataFrame) -> DataFrame:
    """(doc_id, comp, title, level, content, block_ids, location): every title opens one; texts are joined by markers.

    Blocks have doc_id, id, pos, type, content, level, contd, and may have page and box. A text
    continues an earlier one if that is linked to it from the same place or before.
    """
    kind = F.when((F.col("type") == "title") & (F.col("level") < 0), "text").otherwise(F.col("type"))
    rows = blocks.select("doc_id", "id", "pos", kind.alias("type"), F.coalesce("content", F.lit("")).alias("content"), "level", "contd", place(blocks).alias("place"))
    # Other blocks only keep the place of a document that has no text: it gets an empty node.
    body_ = ~F.col("type").isin(*SPECIAL, *LARGE, *FURNITURE)
    rows = rows.select("doc_id", "pos", body_.alias("body"), *(F.when(body_, F.col(c)).alias(c) for c in ("id", "type", "content", "level", "contd", "place")))
    title = F.col("type") == "title"
    # Of a node that is left out nothing but these needs to be known, so its texts aren't moved for those who ask for places only.
    rows = rows.withColumn("filled", F.when(title, F.col("content") != NO_TITLE).otherwise(F.col("content") != ""))
    source = rows.where("type != 'title' and contd >= 0").groupBy("doc_id", F.col("contd").alias("id")).agg(F.min("pos").alias("from_pos"))
    known = rows.where("body").select("doc_id", "id", "pos").join(source, ["doc_id", "id"]).where("from_pos <= pos").select("doc_id", "pos", F.lit(True).alias("continues"))
    # Marks meet their rows in a window, so a text is dealt by its document once for all that follows.
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.unionByName(known, allowMissingColumns=True).repartition("doc_id").withColumn("continues", F.max("continues").over(Window.partitionBy("doc_id", "pos"))).where("body is not null")
    rows = rows.withColumn("comp", F.coalesce(F.sum(title.cast("int")).over(w), F.lit(0)))
    marker = F.when(F.col("continues"), F.lit(CONTINUED)).otherwise(F.lit(SPLIT))
    made = rows.groupBy("doc_id", "comp").agg(
        F.max(F.when(title, F.col("content"))).alias("title"),
        F.max(F.when(title, F.col("level"))).alias("level"),
        F.coalesce(F.bool_or("filled"), F.lit(False)).alias("filled"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("body"), F.struct("pos", "id")))), lambda p: p["id"]).alias("block_ids"),
        F.array_sort(F.collect_list(F.when(F.col("body"), F.struct("pos", "id", title.alias("t"), marker.alias("m"), F.col("content").alias("c"), "place")))).alias("parts"),
    )
    made = made.withColumn("texts", F.filter("parts", lambda p: ~p["t"]))
    # Markers stand between texts from the first that isn't empty on.
    first = F.array_position(F.transform("texts", lambda p: p["c"] != ""), F.lit(True)).cast("int")
    body = F.array_join(F.transform(F.slice("texts", F.greatest(first, F.lit(1)), F.size("texts")), lambda p, k: F.when(k == 0, p["c"]).otherwise(F.concat(p["m"], p["c"]))), "")
    body = F.when(first > 0, body).otherwise("")
    made = made.select(
        "doc_id", F.col("comp").cast("int").alias("comp"), F.coalesce("title", F.lit(NO_TITLE)).alias("title"), F.coalesce("level", F.lit(1)).alias("level"),
        body.alias("content"), "block_ids", F.transform("parts", lambda p: p["place"]).alias("location"), "filled",
    )
    last = F.max("comp").over(Window.partitionBy("doc_id"))
    return made.withColumn("last", F.col("comp") == last).where("filled or last").drop("last", "filled")


def nested(components_: DataFrame, order: str = "comp", stop: bool = False) -> DataFrame:
    """Adds parent (order value of the parent; null: the root) and depth; with ``stop`` also the order value of the first node after its subtree."""
    level = F.when(F.col("level") > 0, F.col("level")).otherwise(100)
    places = kernels.nearest_smaller(components_.select("doc_id", F.col(order).alias("k"), level.alias("value")))
    places = places if stop else places.drop("stop")
    return components_.withColumn("k", F.col(order).cast("long")).join(places, ["doc_id", "k"]).drop("k")


def preview(nodes: DataFrame, order: str = "comp") -> DataFrame:
    """(doc_id, seq, line): a text outline, four spaces a level; text trees are in preorder already."""
    body = F.concat(F.left("content", F.lit(30)), F.when(F.length("content") > 30, "...").otherwise(""))
    lines = nodes.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)).alias("seq"), F.concat(F.repeat(F.lit(" "), F.col("depth") * 4), F.col("title"), F.lit("|"), body).alias("line"))
    root = nodes.select("doc_id").distinct().select("doc_id", F.lit(0).alias("seq"), F.lit("|").alias("line"))
    return lines.unionByName(root)


def figures(blocks: DataFrame, whole_: bool = True) -> DataFrame:
    """(doc_id, id, pos, type, level, content, title, metadata, block_ids, location): visual nodes with captions and footnotes in reading order.

    Blocks of merged tables may bring their own ``block_ids`` and ``location``. Without ``whole_``, ids only:
    (doc_id, id, pos, level, block_ids).
    """
    ids = F.col("block_ids") if "block_ids" in blocks.columns else F.array("id").alias("block_ids")
    spots = F.col("location") if "location" in blocks.columns else F.array(place(blocks)).alias("location")
    own = blocks.where(F.col("type").isin(*FIGURES)).select("doc_id", "id", "pos", F.col("image").alias("level"), ids, *(["type", "content", spots] if whole_ else []))
    note = ["pos", F.col("id").alias("note"), *([F.col("type").contains("caption").alias("cap"), "content", place(blocks).alias("place")] if whole_ else [])]
    notes = blocks.where(F.col("type").contains("caption") | F.col("type").contains("footnote")).select("doc_id", F.col("image").alias("id"), F.struct(*note).alias("n"))
    attached = notes.groupBy("doc_id", "id").agg(F.array_sort(F.collect_list("n")).alias("notes"))
    text = lambda cap: F.coalesce(F.array_join(F.transform(F.filter("notes", lambda n: n["cap"] if cap else ~n["cap"]), lambda n: n["content"]), " "), F.lit(""))
    more = lambda own, field: F.when(F.col("notes").isNull(), F.col(own)).otherwise(F.concat(own, F.transform("notes", lambda n: n[field]))).alias(own)
    got = own.join(attached, ["doc_id", "id"], "left")
    if not whole_:
        return got.select("doc_id", "id", "pos", "level", more("block_ids", "note"))
    return got.select("doc_id", "id", "pos", "type", "level", "content", text(True).alias("title"), text(False).alias("metadata"), more("block_ids", "note"), more("location", "place"))


def figure_parents(figures_: DataFrame, components_: DataFrame, titles: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, id, pos, parent_kind, parent, and ``keep`` of a text node): a figure that is named by its link, the text node with its link, or the last title before.

    A figure linked to itself counts as not linked; one that finds no node has null.
    """
    link = F.when((F.col("level") < 0) | F.array_contains("block_ids", F.col("level")), None).otherwise(F.col("level"))
    own = figures_.select("doc_id", "id", "pos", link.alias("link"), F.array_min("block_ids").alias("least"))
    holder = figures_.select("doc_id", F.col("id").alias("holder"), F.explode("block_ids").alias("link"))
    within = own.join(holder, ["doc_id", "link"]).where("holder != id").groupBy("doc_id", "id").agg(F.min("holder").alias("holder"))
    spots = components_.select("doc_id", F.struct("comp", *keep).alias("spot"), F.explode("block_ids").alias("at")).groupBy("doc_id", "at").agg(F.min("spot").alias("spot"))
    # The last title before a figure: a window over titles and figures, no theta join.
    marks = titles.select("doc_id", F.col("id").alias("at"), F.col("id").alias("title_id"), F.lit(None).cast("long").alias("id")).unionByName(own.select("doc_id", F.col("least").alias("at"), F.lit(None).cast("long").alias("title_id"), "id"))
    w = Window.partitionBy("doc_id").orderBy("at", F.col("title_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    former = marks.withColumn("former", F.last("title_id", ignorenulls=True).over(w)).where("id is not null").select("doc_id", "id", "former")
    joined = own.join(within, ["doc_id", "id"], "left").join(former, ["doc_id", "id"], "left").withColumn("at", F.coalesce("link", "former")).join(spots, ["doc_id", "at"], "left")
    kind = F.when(F.col("holder").isNotNull(), "figure").when(F.col("spot").isNotNull(), "text")
    return joined.select("doc_id", "id", "pos", kind.alias("parent_kind"), F.coalesce(F.col("holder"), F.col("spot.comp").cast("long")).alias("parent"), *(F.col(f"spot.{c}").alias(c) for c in keep))


def furniture(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, pos, type, title, content, location): page furniture under the root, repeated names numbered."""
    w = Window.partitionBy("doc_id", "page", "type").orderBy("pos")
    n = F.row_number().over(w) - 1
    name = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" - "), F.col("type"))
    return blocks.where(F.col("type").isin(*FURNITURE)).select("doc_id", "id", "pos", "type", F.concat(name, F.when(n > 0, F.concat(F.lit(" - "), n.cast("string"))).otherwise("")).alias("title"), "content", F.array(place(blocks)).alias("location"))


def with_parts(components_: DataFrame, limit: int = 500, kind: str = "true") -> DataFrame:
    """Adds ``parts`` (part, title, content, block_ids, location) of long text nodes, cut at markers and packed until over the limit; none if there is one only.
    Rows of which ``kind`` isn't true have none.

    Indexes run over non-empty pieces; a title takes the first place and goes with every
    part; a part whose index has no block is left out.
    """
    if "location" not in components_.columns:
        components_ = components_.withColumn("location", F.lit(None).cast("array<struct<bbox:array<double>,page:int>>"))
    pieces = F.filter(F.split("content", r"<\|txt_(?:split|contd)\|>"), lambda p: p != "")
    start = F.expr("named_struct('done', cast(array() as array<struct<c: string, i: array<int>>>), 'c', '', 'i', cast(array() as array<int>))")

    def step(acc, piece):
        c = F.concat(acc["c"], piece["p"])
        i = F.concat(acc["i"], F.array(piece["k"]))
        full = F.length(c) > limit
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.struct(c.alias("c"), i.alias("i"))))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.lit("")).otherwise(c).alias("c"),
            F.when(full, F.expr("cast(array() as array<int>)")).otherwise(i).alias("i"),
        )

    def closed(s):
        return F.filter(F.concat(s["done"], F.array(F.struct(s["c"].alias("c"), s["i"].alias("i")))), lambda p: p["c"] != "")

    numbered = F.transform(pieces, lambda p, k: F.struct(p.alias("p"), (k + 1).alias("k")))
    # Columns of their own, so that no part is packed anew for another.
    rows = components_.withColumn("_packed", F.when(F.expr(kind) & (F.length("content") > limit), F.aggregate(numbered, start, step, closed)))
    untitled = F.col("title") == NO_TITLE
    rows = rows.withColumn("_before", F.when(untitled, F.expr("cast(array() as array<int>)")).otherwise(F.array(F.lit(0)))).withColumn("_off", F.when(untitled, 1).otherwise(0))
    placed = F.transform("_packed", lambda p, k: F.struct((k + 1).alias("part"), p["c"].alias("c"), F.concat("_before", F.transform(p["i"], lambda i: i - F.col("_off"))).alias("at")))
    rows = rows.withColumn("_placed", F.when(F.size("_packed") > 1, placed))
    found = F.filter("_placed", lambda p: F.array_max(p["at"]) < F.size("block_ids"))

    def part(p):
        at = lambda c: F.transform(p["at"], lambda i: F.get(c, i)).alias(c)
        return F.struct(p["part"].alias("part"), F.concat_ws("_", "title", p["part"].cast("string")).alias("title"), p["c"].alias("content"), at("block_ids"), at("location"))

    return rows.withColumn("parts", F.transform(found, part)).drop("_packed", "_before", "_off", "_placed")


def split_texts(components_: DataFrame, limit: int = 500) -> DataFrame:
    """(doc_id, comp, part, title, content, block_ids, location) of the parts of long text nodes."""
    rows = with_parts(components_.where(F.length("content") > limit), limit).select("doc_id", "comp", F.explode("parts").alias("p"))
    return rows.select("doc_id", "comp", "p.*")


#: Sorts after every place of a document.
LAST = 2**62


def whole(blocks: DataFrame, limit: int = 500) -> DataFrame:
    """The whole tree as rows in preorder: (doc_id, preorder, depth, type, title, metadata, content, level, block_ids, location).

    Blocks have doc_id, id, pos, page, box, type, content, level, contd, image, and may have block_ids and location
    of merged tables. A node's children come in this order: parts of its own long text, text nodes, figures, and
    under the root page furniture. A figure hangs on the figure or text node that has the block it is linked to, or
    else on the last title before it; one that finds none, or hangs on itself through others, is left out.

    No tree is walked: text nodes are in preorder already and know where their subtree stops, so figures of a node
    sort before that place (of several nodes that stop there, the deepest first), and one window ranks all nodes.
    Places are found on ids alone; a text is shuffled with its document to its node, and with all nodes to its rank.
    """
    texts = components(blocks)
    level = F.when(F.col("level") > 0, F.col("level")).otherwise(100)
    places = kernels.nearest_smaller(texts.select("doc_id", F.col("comp").alias("k"), level.alias("value")))
    places = places.select("doc_id", "k", F.col("depth").alias("text_depth"), F.coalesce("stop", F.lit(LAST)).alias("stop"))
    held = texts.select("doc_id", "comp", F.col("comp").cast("long").alias("k"), "block_ids").join(places, ["doc_id", "k"])
    hung = figure_parents(figures(blocks, False), held, blocks.where("type = 'title' and level >= 0"), ("text_depth", "stop"))
    on_text = F.col("parent_kind") == "text"
    # What a figure's top hangs on goes down its tree: depth and stop of the text node.
    tops = hung.where("parent_kind is not null").withColumn("top", F.when(on_text, F.struct("stop", "text_depth")))
    ranked = kernels.forest(tops.select("doc_id", F.col("pos").alias("ord"), "id", F.when(~on_text, F.col("parent")).alias("parent"), "top.stop", "top.text_depth"))
    shown = figures(blocks).join(ranked, ["doc_id", "id"])
    fields = ["type", "title", "metadata", "content", "level", "block_ids", "location"]
    sort = lambda a, b, c, d: [x.cast("long").alias(n) for x, n in zip((a, b, c, d), ("a", "b", "c", "d"), strict=True)]
    nothing, none = F.lit("").alias("metadata"), F.lit(0)
    rows = texts.select("doc_id", F.lit(None).cast("int").alias("depth"), F.lit("text").alias("type"), "title", nothing, "content", "level", "block_ids", "location", *sort(F.col("comp"), F.lit(1), none, none))
    shown = shown.select("doc_id", (F.col("text_depth") + 1 + F.col("depth")).alias("depth"), *fields, *sort(F.col("stop"), F.lit(0), -F.col("text_depth"), F.col("rank")))
    named = furniture(blocks).select("doc_id", F.lit(1).alias("depth"), "type", "title", F.col("content").alias("metadata"), "content", F.lit(-1).alias("level"), F.array("id").alias("block_ids"), "location", *sort(F.lit(LAST), F.lit(1), F.col("pos"), none))
    root = blocks.select("doc_id").distinct().select(
        "doc_id", none.alias("depth"), F.lit("root").alias("type"), F.lit("").alias("title"), nothing, F.lit("").alias("content"), none.alias("level"),
        F.array().cast("array<bigint>").alias("block_ids"), F.array().cast("array<struct<bbox:array<double>,page:int>>").alias("location"), *sort(F.lit(-1), none, none, none),
    )
    every = rows
    for more in (shown, named, root):
        every = every.unionByName(more.withColumn("level", F.col("level").cast("int")))
    # The depth of a text node comes beside it; then its parts follow it.
    deep = places.select("doc_id", F.col("k").alias("a"), "text_depth", F.lit(True).alias("beside"))
    every = every.unionByName(deep, allowMissingColumns=True).repartition("doc_id")
    every = every.withColumn("text_depth", F.max("text_depth").over(Window.partitionBy("doc_id", "a"))).where("beside is null")
    every = with_parts(every.withColumn("depth", F.coalesce("depth", "text_depth")), limit, "type = 'text'")
    own = F.struct(F.lit(0).alias("part"), "title", "content", "block_ids", "location")
    every = every.select("doc_id", "depth", "type", "metadata", F.col("level").alias("own_level"), "a", "b", "c", "d", F.explode(F.when(F.col("parts").isNull(), F.array(own)).otherwise(F.concat(F.array(own), "parts"))).alias("p"))
    sub = F.col("p.part") > 0
    order = Window.partitionBy("doc_id").orderBy("a", "b", "c", "d", "p.part")
    return every.select(
        "doc_id", (F.row_number().over(order) - 1).alias("preorder"), (F.col("depth") + sub.cast("int")).alias("depth"), F.when(sub, "sub_text").otherwise(F.col("type")).alias("type"), "p.title",
        "metadata", "p.content", F.when(sub, 1).otherwise(F.col("own_level")).cast("int").alias("level"), "p.block_ids", "p.location",
    )


def enrich(nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """Fill missing title, metadata and content of figures, and metadata of texts, from answers (doc_id, id, answer)."""
    got = nodes.join(answers, ["doc_id", "id"], "left")
    pattern = r"(?s)\[T\](.*?)\[M\](.*?)\[C\](.*)"
    shown = F.col("type").isin(*FIGURES)
    ok = F.coalesce(F.col("answer").rlike(pattern), F.lit(False))
    field = lambda k, name: F.when(ok, F.trim(F.regexp_extract("answer", pattern, k))).otherwise(F.lit(f"Default {name}"))
    fill = lambda c, value: F.coalesce(F.nullif(F.col(c), F.lit("")), value)
    meta = F.when(shown, fill("metadata", field(2, "Metadata"))).when(F.col("type").isin("text", "sub_text") & (F.col("content") != ""), fill("metadata", F.coalesce("answer", F.lit("")))).otherwise(F.col("metadata"))
    return got.select("doc_id", "id", "type", F.when(shown, fill("title", field(1, "Title"))).otherwise(F.col("title")).alias("title"), meta.alias("metadata"), F.when(shown, fill("content", field(3, "Content"))).otherwise(F.col("content")).alias("content"))
