"""Cross-page tables: screening, answers, components and merging.

Cheap relational checks come first; HTML is parsed for the pairs they leave only.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import html_grid, text
from pagewright.operators import tree
from pagewright.plans import kernels

# Continuation markers and caption patterns.
END_MARKERS = ("(续)", "(续表)", "(续上表)", "(continued)", "(cont.)", "(cont'd)", "(…continued)", "续表")
CAPTION_TYPES = ("table_caption", "tab-title", "tab-caption")
CAPTION_LIKE = r"(?i)^(?:(?:table|表|exhibit|figure|图)\s*\p{Nd}+|\p{Nd}+(?:\.\p{Nd}+)*\s+|[一二三四五六七八九十]+、)"
NUMBER_PATTERNS = (
    (r"[Ee]xhibit\s*(\p{Nd}+)", "Exhibit"), (r"EXHIBIT\s*(\p{Nd}+)", "Exhibit"),
    (r"[Tt]able\s*([A-Za-z]?\s*-?\s*[\p{Nd}.]+)", "Table"), (r"[Tt]ab\.?\s*([A-Za-z]?\s*-?\s*[\p{Nd}.]+)", "Table"), (r"TABLE\s*([A-Za-z]?\s*-?\s*[\p{Nd}.]+)", "Table"),
    (r"表\s*([A-Za-z]?\s*-?\s*[\p{Nd}.]+)", "Table"), (r"[Ff]igure\s*(\p{Nd}+)", "Figure"), (r"图\s*(\p{Nd}+)", "Figure"), (r"^([一二三四五六七八九十]+)、", "CN_Num"),
)


def captions(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, caption of every table: the block just before it, if it is or looks like one."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    before, kind = text.stripped(F.coalesce(F.lag("content").over(w), F.lit(""))), F.lag("type").over(w)
    like = (kind == "text") & (F.length(before) < 150) & before.rlike(CAPTION_LIKE)
    got = blocks.select("doc_id", "pos", "type", F.when(kind.isin(*CAPTION_TYPES, "title") | like, before).alias("caption"))
    return got.where("type = 'table'").select("doc_id", "pos", F.nullif("caption", F.lit("")).alias("caption"))


def footnote_counts(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, notes: length of the run of footnotes (captions count too) after each table on its page."""
    w = Window.partitionBy("doc_id", "page").orderBy("pos")
    note = F.col("type").isin("table_footnote", *CAPTION_TYPES)
    # What follows, in reversed order: growing frames are kept up row by row.
    later = Window.partitionBy("doc_id", "page").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    stop = F.last(F.when(~note, F.col("pos")), ignorenulls=True).over(later)
    after = F.count(F.lit(1)).over(later)
    ranked = blocks.select("doc_id", "page", "pos", "type", stop.alias("stop"), after.alias("after"), F.row_number().over(w).alias("rn"))
    own = ranked.where("type = 'table'")
    at = ranked.select("doc_id", F.col("pos").alias("stop"), F.col("rn").alias("stop_rn"))
    return own.join(at, ["doc_id", "stop"], "left").select("doc_id", "pos", F.coalesce(F.col("stop_rn") - F.col("rn") - 1, F.col("after")).cast("long").alias("notes"))


def texts_around(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, and whether a text comes before or after each table on its page."""
    on_page = Window.partitionBy("doc_id", "page")
    before, after = (on_page.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("pos"), F.desc("pos")))
    body = F.col("type").isin("text", "list_item", "list").cast("int")
    seen = blocks.select(
        "doc_id", "pos", "type",
        (F.coalesce(F.max(body).over(before), F.lit(0)) == 1).alias("text_before"),
        (F.coalesce(F.max(body).over(after), F.lit(0)) == 1).alias("text_after"),
    )
    return seen.where("type = 'table'").drop("type")


def caption_number(caption: Column) -> Column:
    """Kind and number of a caption as ``kind:number``; null if it has none."""
    found = F.lit(None).cast("string")
    for pattern, kind in reversed(NUMBER_PATTERNS):
        value = F.upper(F.regexp_replace(F.regexp_extract(caption, pattern, 1), "[ -]", ""))
        found = F.when(caption.rlike(pattern), F.concat(F.lit(kind + ":"), value)).otherwise(found)
    return found


def clean_caption(half: Column) -> Column:
    """Of a caption in NFKC: lower case, without end markers and all but word characters."""
    drop = lambda c, m: F.when(F.endswith(c, m), F.left(c, F.length(c) - F.length(m))).otherwise(c)
    c = F.aggregate(F.array(*[F.lit(m) for m in END_MARKERS]), F.lower(half), drop)
    return F.regexp_replace(c, r"[^\p{L}\p{N}_一-龥]", "")


def has_marker(half: Column) -> Column:
    c, out = F.lower(half), F.lit(False)
    for marker in END_MARKERS:
        out = out | F.endswith(c, F.lit(marker))
    return out | c.contains("(continued)")


@F.arrow_udf(T.StructType([T.StructField("same", T.BooleanType()), T.StructField("upper", T.StringType()), T.StructField("lower", T.StringType())]))
def grids_fit(a: pa.Array, b: pa.Array) -> pa.Array:
    """Do two tables' columns fit, and the rows on both sides of the page break."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if not x or not y:
            out.append({"same": False, "upper": None, "lower": None})
            continue
        g, h = html_grid.parse(x), html_grid.parse(y)
        if not g.rows or not h.rows:
            out.append({"same": False, "upper": None, "lower": None})
            continue
        same = g.total_columns() == h.total_columns() or html_grid.rows_match(g, h)
        out.append({"same": same, "upper": repr(html_grid.last_rows(g)), "lower": repr(html_grid.first_data_rows(h, html_grid.header_rows(g, h)))})
    return pa.array(out, pa.struct([("same", pa.bool_()), ("upper", pa.string()), ("lower", pa.string())]))


@F.arrow_udf(T.StructType([T.StructField(k, T.IntegerType()) for k in ("rows", "columns", "effective_last", "span_last", "visual_last")]))
def measures(source: pa.Array) -> pa.Array:
    out = []
    for x in source.to_pylist():
        g = html_grid.parse(x)
        last = g.rows[-1] if g.rows else []
        out.append({"rows": len(g.rows), "columns": g.total_columns(), "effective_last": (g.effective_columns() or [0])[-1], "span_last": sum(c.cols for c in last), "visual_last": len(last)})
    return pa.array(out, pa.struct([(k, pa.int32()) for k in ("rows", "columns", "effective_last", "span_last", "visual_last")]))


def facts(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, content, w, caption, notes, text_before, text_after) of every table.

    What ``captions``, ``footnote_counts`` and ``texts_around`` say, by windows over blocks that are dealt by document once.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    page = Window.partitionBy("doc_id", "page")
    later, before = (page.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.desc("pos"), F.asc("pos")))
    table, note, body = F.col("type") == "table", F.col("type").isin("table_footnote", *CAPTION_TYPES), F.col("type").isin("text", "list_item", "list").cast("int")
    last, kind = text.stripped(F.coalesce(F.lag("content").over(w), F.lit(""))), F.lag("type").over(w)
    like = (kind == "text") & (F.length(last) < 150) & last.rlike(CAPTION_LIKE)
    caption = F.nullif(F.when(kind.isin(*CAPTION_TYPES, "title") | like, last), F.lit(""))
    rows = blocks.select("doc_id", "page", "pos", "type", F.when(table, F.col("content")).alias("content"), (F.col("x2") - F.col("x1")).alias("w"), caption.alias("caption"))
    rows = rows.withColumns({"rn": F.row_number().over(page.orderBy("pos")), "seen": F.max(body).over(before)})
    stop, after = F.last(F.when(~note, F.col("rn")), ignorenulls=True).over(later), F.count(F.lit(1)).over(later)
    rows = rows.withColumns({"stop": stop, "after": after, "follows": F.max(body).over(later)}).where("type = 'table'")
    notes = F.coalesce(F.col("stop") - F.col("rn") - 1, F.col("after")).cast("long").alias("notes")
    held = lambda c, name: (F.coalesce(F.col(c), F.lit(0)) == 1).alias(name)
    return rows.select("doc_id", "pos", "content", "w", "caption", notes, held("seen", "text_before"), held("follows", "text_after"))


def screened(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, table1, table2, reason: the first check that fails, in the fixed order; null if all pass."""
    tables = facts(blocks).withColumn("half", text.full_to_half(F.col("caption")))
    # Both tables of a pair meet by its ends, so that the tables are worked out once.
    ends = pairs.select("doc_id", "table1", "table2", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("table1").alias("pos")), F.struct(F.lit(2).alias("side"), F.col("table2").alias("pos")))).alias("e"))
    ends = ends.select("doc_id", "table1", "table2", "e.*").join(tables, ["doc_id", "pos"])
    fields = ("content", "w", "caption", "notes", "text_before", "text_after", "half")
    side = lambda k: F.max(F.when(F.col("side") == k, F.struct(*fields))).alias(f"side{k}")
    both = ends.groupBy("doc_id", "table1", "table2").agg(side(1), side(2)).where("side1 is not null and side2 is not null")
    both = both.select("doc_id", "table1", "table2", *[F.col(f"side{k}.{c}").alias(f"{c}{k}") for k in (1, 2) for c in fields])
    one, two = F.col("caption1"), F.col("caption2")
    n1, n2 = caption_number(one), caption_number(two)
    narrow = F.least("w1", "w2")
    reason = (
        F.when(F.col("text_after1") | F.col("text_before2"), "text_between_tables")
        .when(one.isNull() & two.isNotNull(), "caption_consistency")
        .when(one.isNotNull() & two.isNotNull() & n1.isNotNull() & n2.isNotNull() & (n1 != n2), "caption_consistency")
        .when(one.isNotNull() & two.isNotNull() & (n1.isNull() | n2.isNull()) & (clean_caption(F.col("half1")) != clean_caption(F.col("half2"))), "caption_consistency")
        .when(two.isNotNull() & ~has_marker(F.col("half2")), "continuation_marker")
        .when(F.col("notes1") > F.when(two.isNotNull(), 1).otherwise(0), "footnote_count")
        .when((narrow > 0) & (F.abs(F.col("w1") - F.col("w2")) / F.when(narrow > 0, narrow) >= 0.1), "width_difference")
    )
    # Of pairs that failed no content is parsed.
    left = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    cheap = both.withColumn("reason", reason).withColumn("fit", grids_fit(left("content1"), left("content2")))
    reason = F.coalesce("reason", F.when(~F.col("fit.same"), "column_count"))
    return cheap.select("doc_id", "table1", "table2", reason.alias("reason"), F.col("fit.upper").alias("upper_rows"), F.col("fit.lower").alias("lower_rows"))


def last_list(response: str | None) -> list | None:
    """The last balanced ``[...]`` of an answer as a value; null if there is none or it can't be read."""
    s = response or ""
    stop = s.rfind("]")
    depth = 0
    for k in range(stop, -1, -1):
        depth += (s[k] == "]") - (s[k] == "[")
        if depth == 0:
            try:
                return ast.literal_eval(s[k : stop + 1])
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None
    return None


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def cell_flags(response: pa.Array) -> pa.Array:
    """The flags of a table answer; null if it isn't a list of whole numbers."""
    found = [last_list(r) for r in response.to_pylist()]
    return pa.array([v if isinstance(v, list) and all(type(x) is int and -(2**31) <= x < 2**31 for x in v) else None for v in found], pa.list_(pa.int32()))


def _chained(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc, tables in groupby(rows, key=lambda r: r[0]):
        order: list = []
        links: list[tuple] = []
        for _, _, table, partner in tables:
            order.append(table)
            links.append((table, partner))
        up = {t: t for t in order}

        def root(t):
            while up[t] != t:
                up[t] = up[up[t]]
                t = up[t]
            return t

        place = {t: k for k, t in reversed(list(enumerate(order)))}
        linked = set()
        for a, b in links:
            if a != b and b in up:
                linked |= {a, b}
                first, second = sorted((root(a), root(b)), key=place.get)
                up[second] = first
        yield from ((doc, t, root(t)) for t in place if t in linked)


def chains(tables: DataFrame) -> DataFrame:
    """(doc_id, id, base): components of tables (doc_id, id, pos, table_merge) over their links, by the first in reading order.

    One pass: the tables of a document are joined to sets in reading order. Tables without a link are left out.
    """
    rows = tables.selectExpr("doc_id", "cast(pos as bigint) pos", "cast(id as bigint) id", "cast(table_merge as bigint) table_merge")
    return kernels.by_document(rows, ["pos", "id"], "id bigint, base bigint", _chained)


@F.arrow_udf(T.StringType())
def merged_html(parts: pa.Array) -> pa.Array:
    """Left fold of a chain's tables in reading order; each step uses the flags of the previous or the current table."""
    out = []
    for chain in parts.to_pylist():
        body, before = chain[0]["content"] or "", chain[0]
        for part in chain[1:]:
            body = html_grid.merge(body, part["content"] or "", before["cell_list"] or part["cell_list"])
            before = part
        out.append(body)
    return pa.array(out, pa.string())


def merge_tables(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """Blocks with chains merged into their first table: new content, block_ids and location of all parts; links to dropped tables lead to it.

    Further columns of the blocks are kept, those of the first table for a chain.
    """
    rows = blocks.where("type = 'table'").join(members, ["doc_id", "id"])
    merged = rows.groupBy("doc_id", "base").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "content", "cell_list", tree.place(blocks).alias("place")))).alias("parts"))
    of = lambda field: F.transform("parts", lambda p: p[field])
    html = merged_html(F.transform("parts", lambda p: F.struct(p["content"].alias("content"), p["cell_list"].alias("cell_list"))))
    merged = merged.select("doc_id", F.col("base").alias("id"), html.alias("merged"), of("id").alias("merged_ids"), of("place").alias("merged_places"))
    gone = members.where("id != base").select("doc_id", "id", "base")
    kept = blocks.join(gone.select("doc_id", "id"), ["doc_id", "id"], "left_anti").join(merged, ["doc_id", "id"], "left").join(gone.select("doc_id", F.col("id").alias("image"), F.col("base").alias("moved")), ["doc_id", "image"], "left")
    anchor = blocks.select("doc_id", F.col("id").alias("target"), F.col("type").alias("target_type"))
    kept = kept.withColumn("target", F.coalesce("moved", "image")).join(anchor, ["doc_id", "target"], "left")
    lost = (F.col("type") == "table") & ((F.col("target") == F.col("id")) | F.col("target_type").isin("table_caption", "table_footnote"))
    first = ["doc_id", "id", "pos", "page", "type"]
    more = [c for c in blocks.columns if c not in (*first, "content", "image", "table_merge", "cell_list", "block_ids", "location")]
    return kept.select(
        *first, F.coalesce("merged", "content").alias("content"), F.when(F.coalesce(lost, F.lit(False)), F.lit(-1)).otherwise(F.col("target")).cast("long").alias("image"), *more,
        F.coalesce("merged_ids", F.array("id")).alias("block_ids"), F.coalesce("merged_places", F.array(tree.place(blocks))).alias("location"),
    )
