"""All queries of the engine with their oracle SQL, one entry per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry, labels, text
from pagewright.operators import annotate, candidates, chunking, evaluate, prompts, reconcile, responders, staged, tables, tree
from pagewright.plans import derived as D
from pagewright.plans import durable
from pagewright.sources import readers, sinks
from pagewright.streaming import resume

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
C = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


W = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NORMAL = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{W}+', ' ', 'g'))"
STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^{W}+', ''), '{W}+$', '')"
BOX = lambda p="": f"concat_ws(' ', CAST(trunc({p}y1 * 1000) AS INTEGER), CAST(trunc({p}x1 * 1000) AS INTEGER), CAST(trunc({p}y2 * 1000) AS INTEGER), CAST(trunc({p}x2 * 1000) AS INTEGER))"
TERM = "('.', '。', '?', '!', '？', '！', '¿', '¡', '؟', 'ฯ', '۔', ':', '：', ';', '；')"
CLOSE = "('’', '”', '''', '\"', '）', '」', '】', ']', ')')"
LIST = r"(?i)^(?:\p{Nd}+[.)）．、]|[a-z][.)]|[一二三四五六七八九十百千万]+、|[①-⑳㉑-㉟]|[•▪▫]|[ivxlcdm]+\.|-|\$|\\t|[\[(「【（]|第[一二三四五六七八九十百千万][条节章])"
DIGIT = r"^[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]"
ENDS = "[.。?!？！¿¡؟ฯ۔:：;；…]"


# --- scalar transforms ---------------------------------------------------------------------------


@query("prj_01_normalize_text", f"WITH t AS (SELECT doc_id, ' ' || chr(12288) || replace(text, ' ', chr(160) || ' ') AS x FROM documents) SELECT doc_id, {NORMAL('x')} AS content FROM t")
def _(s, d):
    x = F.concat(F.lit(" 　"), F.replace("text", F.lit(" "), F.lit("  ")))
    return D.table(s, d, "documents").select("doc_id", text.normalize_text(x).alias("content"))


_BOXES = "b AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 2000 AS x1, CAST(embedding[2] AS DOUBLE) * 2000 AS y1, CAST(embedding[3] AS DOUBLE) * 2000 AS x2, CAST(embedding[4] AS DOUBLE) * 2000 AS y2, CASE WHEN label % 2 = 0 THEN 800.0 END AS w, CASE WHEN label % 3 <> 0 THEN 600.0 END AS h FROM embeddings)"


def _boxes(s, d):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double") * 2000
    b = D.table(s, d, "embeddings").select("vec_id", *[e(k).alias(c) for k, c in enumerate(geometry.BOX)], F.when(C("label") % 2 == 0, 800.0).alias("w"), F.when(C("label") % 3 != 0, 600.0).alias("h"))
    return b, [C(c) for c in geometry.BOX]


_MOST = "greatest(abs(x1), abs(y1), abs(x2), abs(y2))"
_CL = lambda e: f"least(1.0, greatest(0.0, {e}))"
_DIM = {"x1": "w", "y1": "h", "x2": "w", "y2": "h"}


@query("prj_02_convert_bbox", f"WITH {_BOXES} SELECT vec_id, " + ", ".join(f"CASE WHEN {_MOST} <= 1.5 THEN {c} * 1000.0 WHEN w > 0 AND h > 0 THEN {c} * 1000.0 / {m} ELSE {c} END AS t_{c}, CASE WHEN w > 0 AND h > 0 AND {_MOST} > 1.5 THEN {c} / {m} ELSE {c} END AS r_{c}" for c, m in _DIM.items()) + " FROM b")
def _(s, d):
    b, box = _boxes(s, d)
    t, r = (geometry.convert(box, C("w"), C("h"), k) for k in ("thousand", "relative"))
    return b.select("vec_id", *[v.alias(f"t_{c}") for v, c in zip(t, geometry.BOX, strict=True)], *[v.alias(f"r_{c}") for v, c in zip(r, geometry.BOX, strict=True)])


@query("prj_03_unit_bbox", f"WITH {_BOXES} SELECT vec_id, " + ", ".join(f"CASE WHEN {_MOST} <= 1.5 THEN {_CL(c)} WHEN w > 0 AND h > 0 THEN {_CL(f'{c} / {m}')} ELSE {c} END AS {c}, CASE WHEN {_MOST} <= 1.5 THEN {_CL(c)} ELSE {_CL(f'{c} / 1000.0')} END AS a_{c}" for c, m in _DIM.items()) + " FROM b")
def _(s, d):
    b, box = _boxes(s, d)
    u, a = geometry.to_unit(box, C("w"), C("h")), geometry.to_unit(box, C("w"), C("h"), 1000.0)
    return b.select("vec_id", *[v.alias(c) for v, c in zip(u, geometry.BOX, strict=True)], *[v.alias(f"a_{c}") for v, c in zip(a, geometry.BOX, strict=True)])


def _label_case(vendor: str, k: int) -> str:
    rows = " ".join(f"WHEN '{a}' THEN '{v[k]}'" for a, v in labels.TABLES[vendor].items())
    return f"CASE label {rows} ELSE 'text' END"


def _labelled(s, d, vendor):
    known = sorted({*labels.TABLES[vendor], "other", "sec_0", "sec_1", "sec_12", "sec_x"})
    b = D.doc_blocks(s, d)
    return b.select("doc_id", "pos", F.get(F.array(*[F.lit(k) for k in known]), (C("pos") % len(known)).cast("int")).alias("label")), known


for _number, _vendor in (("04", "paddle"), ("05", "miner"), ("06", "dolphin"), ("07", "glm")):
    _known = sorted({*labels.TABLES[_vendor], "other", "sec_0", "sec_1", "sec_12", "sec_x"})
    _sec = "regexp_matches(label, '^sec_[1-9][0-9]*$')" if _vendor == "dolphin" else "false"
    _level = "CASE WHEN label = 'catalogue' THEN 1 WHEN regexp_matches(label, '^sec_[1-9][0-9]*$') THEN CAST(substr(label, 5) AS INTEGER) END" if _vendor == "dolphin" else "CAST(NULL AS INTEGER)"

    @query(
        f"prj_{_number}_map_{_vendor}_label",
        f"WITH {D.DOC_BLOCKS}, l AS (SELECT doc_id, pos, {_known}[pos % {len(_known)} + 1] AS label FROM doc_blocks) SELECT doc_id, pos, label, CASE WHEN {_sec} THEN 'title' ELSE {_label_case(_vendor, 0)} END AS canonical, CASE WHEN {_sec} THEN 'title' ELSE {_label_case(_vendor, 1)} END AS fine, coalesce({_level}, -1) AS level FROM l",
    )
    def _(s, d, vendor=_vendor):
        b, _ = _labelled(s, d, vendor)
        return b.select("doc_id", "pos", "label", labels.canonical(vendor, C("label")).alias("canonical"), labels.fine(vendor, C("label")).alias("fine"), F.coalesce(labels.title_level(vendor, C("label")).cast("int"), F.lit(-1)).alias("level"))


_FURN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.FURNITURE.items())
_LAB = [*labels.FURNITURE, "text"]


@query("prj_08_furniture_retyping", f"WITH {D.DOC_BLOCKS}, l AS (SELECT doc_id, pos, type, {_LAB}[pos % {len(_LAB)} + 1] AS label FROM doc_blocks) SELECT doc_id, pos, CASE WHEN type = 'text' THEN CASE label {_FURN} ELSE type END ELSE type END AS type FROM l")
def _(s, d):
    return D.doc_blocks(s, d).select("doc_id", "pos", labels.retyped(C("type"), F.get(F.array(*[F.lit(k) for k in _LAB]), (C("pos") % len(_LAB)).cast("int"))).alias("type"))


@query("prj_09_block_ids", "WITH w AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS id FROM conversations) SELECT conv_id, turn, role, id FROM w")
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return D.table(s, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).cast("long").alias("id"))


@query("prj_10_prompt_bbox", f"WITH {D.DOC_BLOCKS} SELECT doc_id, pos, {BOX()} AS box FROM doc_blocks")
def _(s, d):
    return D.doc_blocks(s, d).select("doc_id", "pos", geometry.prompt_box(*[C(c) for c in geometry.BOX]).alias("box"))


_HEAD = f"{STRIP(f'''CASE WHEN regexp_extract(content, '(?s)^(.*?{ENDS})', 1) <> '' THEN regexp_extract(content, '(?s)^(.*?{ENDS})', 1) ELSE content END''')}"
_PARTS = f"list_filter(list_transform(regexp_split_to_array(content, '{ENDS}'), lambda p: {STRIP('p')}), lambda p: p <> '')"
_TAIL = f"CASE WHEN len({_PARTS}) > 0 THEN {_PARTS}[-1] ELSE {STRIP('content')} END"
_SHORT = "CASE WHEN length(joined) <= 103 THEN joined ELSE left(joined, 50) || '...' || right(joined, 50) END"
_SENT = f"sent AS (SELECT *, CASE WHEN head = tail THEN head ELSE head || ' ... ' || tail END AS joined FROM (SELECT *, {_HEAD} AS head, {_TAIL} AS tail FROM doc_blocks))"


@query("prj_11_shorten_content", f"WITH {D.DOC_BLOCKS}, {_SENT} SELECT doc_id, pos, {_SHORT} AS content FROM sent")
def _(s, d):
    return D.doc_blocks(s, d).select("doc_id", "pos", text.shortened(C("content")).alias("content"))


@query("prj_12_compact_text", f"SELECT doc_id, lower(regexp_replace({NORMAL('text')}, '[^0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS content FROM documents")
def _(s, d):
    return D.table(s, d, "documents").select("doc_id", text.compact_text(C("text")).alias("content"))


@query("prj_13_full_to_half", "SELECT event_id, props AS half FROM events")
def _(s, d):  # on ASCII the normal form is the text itself; other characters are covered by tests
    return D.table(s, d, "events").select("event_id", text.full_to_half(C("props")).alias("half"))


@query("prj_14_hyphen_end", f"WITH {D.DOC_BLOCKS}, h AS (SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN replace(content, '.', '- ') ELSE content END AS c FROM doc_blocks) SELECT doc_id, pos, regexp_matches(c, '[A-Za-z]+-{W}*$') AS hyphen FROM h")
def _(s, d):
    c = F.when(C("pos") % 2 == 0, F.replace("content", F.lit("."), F.lit("- "))).otherwise(C("content"))
    return D.doc_blocks(s, d).select("doc_id", "pos", text.ends_with_hyphen(c).alias("hyphen"))


@query("prj_15_safe_names", "SELECT page_id, regexp_replace(url, '[^0-9A-Za-z_.-]+', '_', 'g') AS safe, CASE WHEN regexp_matches(f, '[^.]\\.[^.]*$') THEN regexp_replace(f, '\\.[^.]*$', '') ELSE f END AS stem FROM (SELECT *, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS f FROM pages)")
def _(s, d):
    return D.table(s, d, "pages").select("page_id", text.safe_name(C("url")).alias("safe"), text.stem(C("url")).alias("stem"))


@query("prj_16_head_tail_sentence", f"WITH {D.DOC_BLOCKS}, {_SENT} SELECT doc_id, pos, head, tail FROM sent")
def _(s, d):
    return D.doc_blocks(s, d).select("doc_id", "pos", text.head_sentence(C("content")).alias("head"), text.tail_sentence(C("content")).alias("tail"))


@query("prj_17_optional_int_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id % 10 AS VARCHAR) END AS BIGINT) NULLS LAST, event_id) AS rn FROM events")
def _(s, d):
    key = F.when(C("event_id") % 3 == 0, C("event_type")).otherwise((C("event_id") % 10).cast("string")).try_cast("long")
    return D.table(s, d, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(key.asc_nulls_last(), "event_id")).cast("long").alias("rn"))


# --- filters -------------------------------------------------------------------------------------

_L = f"length(content) >= 10 AND NOT (right({STRIP('content')}, 1) IN {TERM}) AND NOT (length({STRIP('content')}) > 1 AND right({STRIP('content')}, 1) IN {CLOSE} AND substr({STRIP('content')}, -2, 1) IN {TERM}) AND NOT contains(content, chr(9))"
_R = f"length(content) > 0 AND NOT regexp_matches(content, '{LIST}') AND NOT contains(content, chr(9))"


@query("flt_01_02_empty_and_skipped", f"WITH {D.DOC_BLOCKS}, l AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN '' ELSE content END AS content, {sorted(labels.TABLES['miner'])}[pos % {len(labels.TABLES['miner'])} + 1] AS label FROM doc_blocks), m AS (SELECT doc_id, pos, content, {_label_case('miner', 0)} AS canonical FROM l) SELECT doc_id, pos, canonical FROM m WHERE canonical <> '__skip__' AND NOT (canonical IN ('text', 'title', 'caption') AND content = '')")
def _(s, d):
    known = sorted(labels.TABLES["miner"])
    b = D.doc_blocks(s, d).select("doc_id", "pos", F.when(C("pos") % 3 == 0, "").otherwise(C("content")).alias("content"), labels.canonical("miner", F.get(F.array(*[F.lit(k) for k in known]), (C("pos") % len(known)).cast("int"))).alias("canonical"))
    return b.where((C("canonical") != labels.SKIP) & ~(C("canonical").isin("text", "title", "caption") & (C("content") == ""))).select("doc_id", "pos", "canonical")


_STARTS = ["1. ", "2) ", "(3) ", "a. ", "B) ", "一、", "① ", "• ", "iv. ", "- ", "$", "[x] ", "第一章 ", "plain ", "12 ", "½ ", "mild. "]


def _prefixed(s, d):
    return D.doc_blocks(s, d).withColumn("content", F.concat(F.get(F.array(*[F.lit(x) for x in _STARTS]), (C("pos") % len(_STARTS)).cast("int")), C("content")))


_PREFIXED = D.DOC_BLOCKS.replace("doc_blocks AS (", "plain AS (") + f", doc_blocks AS (SELECT * REPLACE ({_STARTS}[pos % {len(_STARTS)} + 1] || content AS content) FROM plain)"


@query("flt_03_list_item", f"WITH {_PREFIXED} SELECT doc_id, pos, regexp_matches(content, '{LIST}') AS item FROM doc_blocks")
def _(s, d):
    return _prefixed(s, d).select("doc_id", "pos", text.is_list_item(C("content")).alias("item"))


@query("flt_04_merge_rules", f"WITH {_PREFIXED} SELECT doc_id, pos, {_L} AS cut, {_R} AS rest, regexp_matches(content, '{DIGIT}') AS digit FROM doc_blocks")
def _(s, d):
    return _prefixed(s, d).select("doc_id", "pos", text.may_continue(C("content")).alias("cut"), text.may_be_continued_by(C("content")).alias("rest"), text.starts_with_digit(C("content")).alias("digit"))


@query("flt_05_title_candidates", f"WITH {D.DOC_BLOCKS} SELECT doc_id, pos AS idx, pos AS ord, left(content, 50) AS content, page, {BOX()} AS box FROM doc_blocks WHERE type = 'title'")
def _(s, d):
    return candidates.title_candidates(D.doc_blocks(s, d))


_CONTAINED = """contained AS (
  SELECT a.doc_id, a.pos AS src, min(b.pos) AS tgt FROM mixed a JOIN mixed b ON a.doc_id = b.doc_id AND b.type = 'image_block' AND a.type IN ('image', 'image_caption')
    AND a.x1 >= CAST(0.95 AS DOUBLE) * b.x1 AND a.y1 >= CAST(0.95 AS DOUBLE) * b.y1 AND a.x2 <= CAST(1.05 AS DOUBLE) * b.x2 AND a.y2 <= CAST(1.05 AS DOUBLE) * b.y2 GROUP BY 1, 2
)"""


@query("flt_06_visual_candidates", f"WITH {D.MIXED}, {_CONTAINED} SELECT doc_id, pos AS idx, pos AS ord, CASE WHEN type = 'image_block' THEN 'image' ELSE type END AS type, CASE WHEN type IN ('image', 'image_block', 'table') THEN 'None' ELSE left(content, 50) END AS content, page, {BOX()} AS box FROM mixed m WHERE type IN ('title', 'image', 'image_caption', 'image_block', 'table', 'table_footnote') AND NOT EXISTS (SELECT 1 FROM contained c WHERE c.doc_id = m.doc_id AND c.src = m.pos)")
def _(s, d):
    return candidates.visual_candidates(D.mixed_blocks(s, d))


@query("flt_07_bbox_violations", f"WITH {_BOXES}, u AS (SELECT vec_id, x1 / 500 AS x1, y1 / 500 AS y1, x2 / 500 AS x2, CASE WHEN w IS NULL THEN NULL ELSE y2 / 500 END AS y2 FROM b) SELECT vec_id AS doc_id, CAST(0 AS BIGINT) AS pos, CASE WHEN y2 IS NULL THEN 'not finite' WHEN x2 < x1 OR y2 < y1 THEN 'inverted' ELSE 'outside' END AS violation FROM u WHERE y2 IS NULL OR x2 < x1 OR y2 < y1 OR least(x1, y1, x2, y2) < -0.000001 OR greatest(x1, y1, x2, y2) > 1.000001")
def _(s, d):
    b, _ = _boxes(s, d)
    b = b.select(C("vec_id").alias("doc_id"), F.lit(0).cast("long").alias("pos"), *[(C(c) / 500).alias(c) for c in ("x1", "y1", "x2")], F.when(C("w").isNotNull(), C("y2") / 500).alias("y2"))
    return candidates.bbox_violations(b)


@query("flt_08_page_violations", f"WITH {D.MIXED} SELECT doc_id, pos, type FROM mixed WHERE type NOT IN {labels.FINE_TYPES}")
def _(s, d):
    return candidates.page_violations(D.mixed_blocks(s, d), labels.FINE_TYPES)


# --- candidates and prompts ----------------------------------------------------------------------

_PAIRS = f"""rules AS (
  SELECT doc_id, pos, type = 'text' AND {_L} AS l, type = 'text' AND {_R} AS r, regexp_matches(content, '{DIGIT}') AS digit, type = 'title' AS stop FROM doc_blocks
), pairs AS (
  SELECT a.doc_id, a.pos AS src, min(b.pos) AS tgt FROM rules a JOIN rules b ON a.doc_id = b.doc_id AND b.pos > a.pos AND a.l AND b.r AND NOT (a.digit AND b.digit)
  WHERE NOT EXISTS (SELECT 1 FROM rules c WHERE c.doc_id = a.doc_id AND c.stop AND c.pos > a.pos AND c.pos < b.pos) GROUP BY 1, 2
)"""


@query("join_01_continuation_pairs", f"WITH {D.DOC_BLOCKS_OPEN}, {_PAIRS} SELECT doc_id, src, tgt FROM pairs")
def _(s, d):
    return candidates.continuation_pairs(D.doc_blocks(s, d, True))


_CONTD = f"""ends AS (SELECT doc_id, src AS pos, src AS a, 0 AS b FROM pairs UNION ALL SELECT doc_id, tgt, src, 1 FROM pairs),
firsts AS (SELECT doc_id, pos, min(a * 2 + b) AS o FROM ends GROUP BY 1, 2),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS ord FROM firsts), {_SENT},
contd AS (SELECT s.doc_id, s.pos AS idx, CAST(ord AS INTEGER) AS ord, {_SHORT} AS content, page, {BOX()} AS box FROM sent s JOIN ranked r ON s.doc_id = r.doc_id AND s.pos = r.pos)"""


@query("join_01_continuation_candidates", f"WITH {D.DOC_BLOCKS_OPEN}, {_PAIRS}, {_CONTD} SELECT * FROM contd")
def _(s, d):
    return candidates.continuation_candidates(D.doc_blocks(s, d, True))


@query("join_02_containment", f"WITH {D.MIXED}, {_CONTAINED} SELECT * FROM contained")
def _(s, d):
    return candidates.containment_links(D.mixed_blocks(s, d))


@query("join_03_agg_01_table_pairs", f"WITH {D.MIXED}, p AS (SELECT doc_id, page, min(pos) AS f, max(pos) AS l FROM mixed WHERE type = 'table' GROUP BY 1, 2) SELECT a.doc_id, a.l AS table1, b.f AS table2 FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.page = a.page + 1")
def _(s, d):
    return candidates.table_pairs(D.mixed_blocks(s, d))


_LINE = "'<|id|>' || idx || '<|page|>' || page || '<|box|>' || box || '<|content|>' || content"


@query("str_01_contd_prompt", f"WITH {D.DOC_BLOCKS_OPEN}, {_PAIRS}, {_CONTD} SELECT doc_id, '<image>' || chr(10) || 'Truncation Detection: ' || string_agg({_LINE}, chr(10) ORDER BY ord) AS prompt FROM contd GROUP BY doc_id")
def _(s, d):
    return prompts.prompts(candidates.continuation_candidates(D.doc_blocks(s, d, True)), "contd")


_TITLES = f"titles AS (SELECT doc_id, pos AS idx, left(content, 50) AS content, page, {BOX()} AS box FROM doc_blocks WHERE type = 'title')"


@query("str_01_title_prompt", f"WITH {D.DOC_BLOCKS}, {_TITLES} SELECT doc_id, '<image>' || chr(10) || 'Title Level Analysis: ' || string_agg({_LINE}, chr(10) ORDER BY idx) AS prompt FROM titles GROUP BY doc_id")
def _(s, d):
    return prompts.prompts(candidates.title_candidates(D.doc_blocks(s, d)), "title")


@query("str_01_image_prompt", f"WITH {D.MIXED}, {_CONTAINED}, v AS (SELECT doc_id, pos AS idx, CASE WHEN type = 'image_block' THEN 'image' ELSE type END AS type, CASE WHEN type IN ('image', 'image_block', 'table') THEN 'None' ELSE left(content, 50) END AS content, page, {BOX()} AS box FROM mixed m WHERE type IN ('title', 'image', 'image_caption', 'image_block', 'table', 'table_footnote') AND NOT EXISTS (SELECT 1 FROM contained c WHERE c.doc_id = m.doc_id AND c.src = m.pos)) SELECT doc_id, '<image>' || chr(10) || 'Image-Text Correlation Analysis: ' || string_agg('<|id|>' || idx || '<|type|>' || type || '<|page|>' || page || '<|box|>' || box || '<|content|>' || content, chr(10) ORDER BY idx) AS prompt FROM v GROUP BY doc_id")
def _(s, d):
    return prompts.prompts(candidates.visual_candidates(D.mixed_blocks(s, d)), "image")


@query("str_03_parse_prompt", f"WITH {D.DOC_BLOCKS}, {_TITLES} SELECT doc_id, CAST(idx AS VARCHAR) AS id, page, box, {STRIP('content')} AS content FROM titles")
def _(s, d):
    return prompts.parsed(prompts.prompts(candidates.title_candidates(D.doc_blocks(s, d)), "title")).drop("ord")


@query("str_03_parse_typed_prompt", f"WITH {D.MIXED}, {_CONTAINED} SELECT doc_id, CAST(pos AS VARCHAR) AS id, CASE WHEN type = 'image_block' THEN 'image' ELSE type END AS type, page, {BOX()} AS box, {STRIP('''CASE WHEN type IN ('image', 'image_block', 'table') THEN 'None' ELSE left(content, 50) END''')} AS content FROM mixed m WHERE type IN ('title', 'image', 'image_caption', 'image_block', 'table', 'table_footnote') AND NOT EXISTS (SELECT 1 FROM contained c WHERE c.doc_id = m.doc_id AND c.src = m.pos)")
def _(s, d):
    return prompts.parsed(prompts.prompts(candidates.visual_candidates(D.mixed_blocks(s, d)), "image"), True).drop("ord")


def _answers(s, d):
    e = D.table(s, d, "events")
    line = F.when(C("event_id") % 7 == 0, F.concat(F.lit("noise "), C("event_type"))).when(C("event_id") % 5 == 0, F.concat(F.lit("<|from|>"), C("event_id").cast("string"), F.lit("<|to|>x"))).when(C("event_id") % 3 == 0, F.concat(F.lit("<|from|>"), (C("event_id") % 50).cast("string"), F.lit("<|to|>"), (C("user_id") % 50).cast("string"))).otherwise(F.concat(F.lit("<|src_id|>"), (C("event_id") % 50).cast("string"), F.lit("<|tgt_id|>"), (C("user_id") % 50).cast("string")))
    rows = e.select((C("event_id") % 100).alias("doc_id"), (F.floor(C("event_id") / 100) % 5).cast("int").alias("chunk"), F.struct("event_id", line.alias("l")).alias("l"))
    return rows.groupBy("doc_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["l"]), "\n").alias("response"))


_LINKS = "ev AS (SELECT event_id % 100 AS doc_id, CAST(event_id // 100 % 5 AS INTEGER) AS chunk, event_id, CAST(event_id % 50 AS INTEGER) AS src_id, CAST(user_id % 50 AS INTEGER) AS tgt_id, row_number() OVER (PARTITION BY event_id % 100, event_id // 100 % 5 ORDER BY event_id) - 1 AS line_no FROM events), links AS (SELECT * FROM ev WHERE event_id % 7 <> 0 AND event_id % 5 <> 0)"


@query("str_04_link_answers", f"WITH {_LINKS} SELECT doc_id, chunk, CAST(line_no AS INTEGER) AS line_no, src_id, tgt_id FROM links")
def _(s, d):
    return prompts.link_answers(_answers(s, d))


def _level_answers(s, d):
    e = D.table(s, d, "events")
    line = F.when(C("event_id") % 7 == 0, F.lit("noise")).otherwise(F.concat(F.lit("<|id|>"), (C("event_id") % 40).cast("string"), F.lit("<|level|>"), (C("event_id") % 6 - 1).cast("string")))
    rows = e.select((C("event_id") % 100).alias("doc_id"), F.floor(C("event_id") / 100).cast("int").alias("range_sum"), F.struct("event_id", line.alias("l")).alias("l"))
    return prompts.level_answers(rows.groupBy("doc_id", "range_sum").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["l"]), "\n").alias("response")))


@query("str_05_level_answers", "SELECT event_id % 100 AS doc_id, CAST(event_id // 100 AS INTEGER) AS range_sum, CAST(row_number() OVER (PARTITION BY event_id % 100, event_id // 100 ORDER BY event_id) - 1 AS INTEGER) AS line_no, CAST(event_id % 40 AS INTEGER) AS id, CAST(event_id % 6 - 1 AS INTEGER) AS level FROM events QUALIFY event_id % 7 <> 0 AND event_id % 6 >= 1")
def _(s, d):
    return _level_answers(s, d)


@query("agg_03_distinct_links", f"WITH {_LINKS}, f AS (SELECT doc_id, src_id, tgt_id, min(chunk * 1000000 + line_no) AS o FROM links GROUP BY 1, 2, 3) SELECT doc_id, src_id, tgt_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS INTEGER) AS ord FROM f")
def _(s, d):
    return reconcile.distinct_links(prompts.link_answers(_answers(s, d)))


def _case_rows(cases, *key):
    turn = lambda k: F.col("case.conversations")[k]["value"]
    return cases.select("doc_id", *key, "case.image", turn(0).alias("prompt"), turn(1).alias("answer"), F.array_join(F.transform("case.conversations", lambda t: t["from"]), ",").alias("speakers"), "case.type")


_SPOKEN = "'human,gpt' AS speakers, 'grounding' AS type"


@query("str_08_training_cases", f"WITH {D.DOC_BLOCKS}, t AS (SELECT doc_id, pos AS idx, content, page, {BOX()} AS box, pos % 3 + 1 AS level FROM doc_blocks WHERE type = 'title') SELECT doc_id, doc_id || '_title.jpeg' AS image, '<image>' || chr(10) || 'Title Level Analysis: ' || string_agg({_LINE}, chr(10) ORDER BY idx) AS prompt, string_agg('<|id|>' || idx || '<|level|>' || level, chr(10) ORDER BY idx) AS answer, {_SPOKEN} FROM t GROUP BY doc_id")
def _(s, d):
    levels = D.doc_titles(s, d).select("doc_id", C("pos").alias("idx"), "level", C("pos").alias("ord"))
    return _case_rows(annotate.title_cases(D.doc_blocks(s, d), levels))


@query("str_08_contd_cases", f"WITH {D.DOC_BLOCKS_OPEN}, {_PAIRS}, {_CONTD}, f AS (SELECT s.doc_id, s.pos AS idx, r.ord, s.joined AS content, s.page, {BOX('s.')} AS box FROM sent s JOIN ranked r ON r.doc_id = s.doc_id AND r.pos = s.pos), a AS (SELECT doc_id, string_agg('<|src_id|>' || src || '<|tgt_id|>' || tgt, chr(10) ORDER BY src) AS answer FROM pairs WHERE src % 2 = 0 GROUP BY 1), p AS (SELECT doc_id, '<image>' || chr(10) || 'Truncation Detection: ' || string_agg({_LINE}, chr(10) ORDER BY ord) AS prompt FROM f GROUP BY 1) SELECT doc_id, doc_id || '_contd.jpeg' AS image, prompt, coalesce(answer, '') AS answer, {_SPOKEN} FROM p LEFT JOIN a USING (doc_id)")
def _(s, d):
    b = D.doc_blocks(s, d, True)
    links = candidates.continuation_pairs(b).where("src % 2 = 0").select("doc_id", C("src").alias("src_id"), C("tgt").alias("tgt_id"), C("src").alias("ord"))
    return _case_rows(annotate.contd_cases(b, links))


@query("str_08_image_cases", f"WITH {D.MIXED}, {_CONTAINED}, v AS (SELECT doc_id, pos AS idx, CASE WHEN type = 'image_block' THEN 'image' ELSE type END AS type, CASE WHEN type IN ('image', 'image_block', 'table') THEN 'None' ELSE content END AS content, page, {BOX()} AS box FROM mixed m WHERE type IN ('title', 'image', 'image_caption', 'image_block', 'table', 'table_footnote') AND NOT EXISTS (SELECT 1 FROM contained c WHERE c.doc_id = m.doc_id AND c.src = m.pos)), p AS (SELECT doc_id, '<image>' || chr(10) || 'Image-Text Correlation Analysis: ' || string_agg('<|id|>' || idx || '<|type|>' || type || '<|page|>' || page || '<|box|>' || box || '<|content|>' || content, chr(10) ORDER BY idx) AS prompt FROM v GROUP BY 1), a AS (SELECT doc_id, string_agg('<|src_id|>' || pos || '<|tgt_id|>' || image, chr(10) ORDER BY pos) AS answer FROM mixed WHERE type = 'table_footnote' GROUP BY 1) SELECT doc_id, doc_id || '_image.jpeg' AS image, prompt, coalesce(answer, '') AS answer, {_SPOKEN} FROM p LEFT JOIN a USING (doc_id)")
def _(s, d):
    m = D.mixed_blocks(s, d)
    links = m.where("type = 'table_footnote'").select("doc_id", C("pos").alias("src_id"), C("image").alias("tgt_id"), C("pos").alias("ord"))
    return _case_rows(annotate.image_cases(m, links))


@query("str_08_table_cases", "SELECT o_orderkey AS doc_id, o_custkey AS src_id, o_custkey + 1 AS tgt_id, o_orderkey || '_table_merge.jpeg' AS image, '<image>' || chr(10) || 'Table Merge Detection: <|id|>' || o_custkey || '<|page|>1<|col_count|>2<|caption|>' || o_orderpriority || '<|last_rows|>[\"a \\\"' || o_orderstatus || '\\\"\", \"' || o_orderpriority || '\"]<|first_rows|>[]' || chr(10) || '<|id|>' || (o_custkey + 1) || '<|page|>2<|col_count|>2<|caption|><|last_rows|>[]<|first_rows|>[\"' || o_orderstatus || '\"]' AS prompt, '<|src_id|>' || o_custkey || '<|tgt_id|>' || (o_custkey + 1) || '<|merge|>' || CASE WHEN o_orderkey % 2 = 0 THEN '1<|cell_list|>1,0' ELSE '0<|cell_list|>' END AS answer, 'human,gpt' AS speakers, 'grounding' AS type FROM orders")
def _(s, d):
    even = C("o_orderkey") % 2 == 0
    table = lambda key, page, caption: F.struct(key.alias("id"), F.lit(page).alias("page"), F.lit(2).alias("col_count"), caption.alias("caption"))
    quoted = F.concat(F.lit('a "'), "o_orderstatus", F.lit('"'))
    pairs = D.table(s, d, "orders").select(
        C("o_orderkey").alias("doc_id"), table(C("o_custkey"), 1, C("o_orderpriority")).alias("upper"), table(C("o_custkey") + 1, 2, F.lit(None).cast("string")).alias("lower"),
        F.array(quoted, C("o_orderpriority")).alias("last_rows"), F.array("o_orderstatus").alias("first_rows"), F.when(even, 1).alias("merge"), F.when(even, F.array(F.lit(1), F.lit(0))).alias("cell_list"),
    )
    return _case_rows(annotate.table_cases(pairs), "src_id", "tgt_id")


@query("ann_01_title_relations", f"WITH {D.DOC_BLOCKS} SELECT doc_id, pos AS ord, repeat('#', CAST(pos % 3 AS INTEGER)) || content AS relation FROM doc_blocks WHERE type = 'title'")
def _(s, d):
    titles = D.doc_blocks(s, d).where("type = 'title'").select("doc_id", C("pos").alias("ord"), (C("pos") % 3).alias("level"), "content")
    return annotate.title_relations(titles)


@query("ann_01_continuation_relations", f"WITH {D.DOC_BLOCKS_OPEN}, {_PAIRS} SELECT p.doc_id, p.src AS ord, a.content || '<|txt_contd|>' || b.content || CASE WHEN EXISTS (SELECT 1 FROM pairs q WHERE q.doc_id = p.doc_id AND q.src = p.tgt) THEN '<|txt_contd|>' ELSE '' END AS relation FROM pairs p JOIN doc_blocks a ON a.doc_id = p.doc_id AND a.pos = p.src JOIN doc_blocks b ON b.doc_id = p.doc_id AND b.pos = p.tgt")
def _(s, d):
    b = D.doc_blocks(s, d, True)
    # Judged from the last source to the first, so a target may have been a source before.
    links = candidates.continuation_pairs(b).select("doc_id", C("src").alias("src_id"), C("tgt").alias("tgt_id"), (-C("src")).alias("ord"))
    return annotate.continuation_relations(b, links).withColumn("ord", -C("ord"))


@query("str_02_06_07_table_answers")
def _(s, d):
    e = D.table(s, d, "events").select("event_id", F.concat(F.lit("so [0] then ["), F.array_join(F.array(C("event_id") % 2, C("user_id") % 2), ", "), F.when(C("event_id") % 5 == 0, "").otherwise("]"), F.lit(" done")).alias("response"))
    return e.select("event_id", F.array_join(tables.cell_flags("response"), ",").alias("flags"), prompts.table_prompt(C("event_id").cast("string"), C("response")).alias("prompt"))


@query("str_10_marked_answers", "SELECT event_id, trim(event_type) AS title, CAST(user_id AS VARCHAR) AS metadata, trim(props) AS content FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'Default Title', 'Default Metadata', 'Default Content' FROM events WHERE event_id % 2 = 1")
def _(s, d):
    e = D.table(s, d, "events").select(C("event_id").alias("doc_id"), C("event_id").alias("id"), F.lit("image").alias("type"), F.lit("").alias("title"), F.lit("").alias("metadata"), F.lit("").alias("content"))
    a = D.table(s, d, "events").select(C("event_id").alias("doc_id"), C("event_id").alias("id"), F.when(C("event_id") % 2 == 0, F.concat(F.lit("x[T] "), C("event_type"), F.lit(" [M]"), C("user_id").cast("string"), F.lit("[C]"), C("props"))).otherwise("none").alias("answer"))
    return tree.enrich(e, a).select(C("id").alias("event_id"), "title", "metadata", "content")


# --- chunks and reconciliation -------------------------------------------------------------------

_CHUNKS = """pc AS (SELECT doc_id, page, count(*) AS n FROM long_pages GROUP BY 1, 2),
lim AS (SELECT doc_id, min(page) AS lo, max(page) AS hi FROM pc GROUP BY 1),
nxt AS (
  SELECT p.doc_id, p.page, coalesce(
    (SELECT arg_max(q.page, q.n * 100000 - q.page) FROM pc q WHERE q.doc_id = p.doc_id AND q.page BETWEEN greatest(lim.lo, p.page + 45) AND least(lim.hi, p.page + 55)),
    (SELECT min(q.page) FROM pc q WHERE q.doc_id = p.doc_id AND q.page > p.page + 50), lim.hi) AS nx, lim.lo, lim.hi
  FROM pc p JOIN lim ON p.doc_id = lim.doc_id WHERE p.page < lim.hi
), walk(doc_id, chunk, before, border, lo, hi) AS (
  SELECT doc_id, 0, page, nx, lo, hi FROM nxt WHERE page = lo UNION ALL SELECT w.doc_id, w.chunk + 1, w.border, n.nx, n.lo, n.hi FROM walk w JOIN nxt n ON n.doc_id = w.doc_id AND n.page = w.border
), chunks AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(CASE WHEN before = lo THEN lo ELSE before - 1 END AS INTEGER) AS start, CAST(least(hi, border + 1) AS INTEGER) AS stop FROM walk)"""


@query("chk_01_topk_01_chunk_ranges", f"WITH RECURSIVE {D.LONG_PAGES}, {_CHUNKS} SELECT * FROM chunks")
def _(s, d):
    return chunking.ranges(D.long_pages(s, d))


@query("join_14_chunk_members", f"WITH RECURSIVE {D.LONG_PAGES}, {_CHUNKS} SELECT c.doc_id, chunk, pos FROM chunks c JOIN long_pages p ON p.doc_id = c.doc_id AND p.page BETWEEN start AND stop")
def _(s, d):
    items = D.long_pages(s, d)
    return chunking.members(items, chunking.ranges(items)).select("doc_id", "chunk", "pos")


@query("chk_02_chunk_pages", f"WITH RECURSIVE {D.LONG_PAGES}, {_CHUNKS} SELECT c.doc_id, chunk, string_agg(DISTINCT page, ',' ORDER BY page) AS pages FROM chunks c JOIN long_pages p ON p.doc_id = c.doc_id AND p.page BETWEEN start AND stop GROUP BY 1, 2")
def _(s, d):
    items = D.long_pages(s, d)
    return chunking.chunk_pages(items, chunking.ranges(items)).select("doc_id", "chunk", F.array_join(C("pages").cast("array<string>"), ",").alias("pages"))


@query("agg_02_page_histogram", f"WITH {D.LONG_PAGES} SELECT doc_id, page, count(*) AS n FROM long_pages GROUP BY 1, 2")
def _(s, d):
    return D.long_pages(s, d).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


def _two_chunks(s, d):
    t = D.doc_titles(s, d)
    half = t.select("doc_id", F.when(C("pos") % 5 == 0, F.lit(2)).otherwise(1).alias("range_sum"), C("pos").cast("int").alias("line_no"), C("pos").cast("int").alias("id"), "level")
    again = t.where("pos % 5 = 1 or pos % 5 = 2").select("doc_id", F.lit(2).alias("range_sum"), C("pos").cast("int").alias("line_no"), C("pos").cast("int").alias("id"), (C("level") + 1 + C("pos").cast("int") % 2).alias("level"))
    return half.unionByName(again)


@query("syn_01_agg_07_level_sync", f"WITH {D.DOC_BLOCKS}, t AS (SELECT doc_id, pos, pos % 3 + 1 AS level FROM doc_blocks WHERE type = 'title'), bias AS (SELECT doc_id, round_even(avg(1 + pos % 2), 0) AS b FROM t WHERE pos % 5 IN (1, 2) GROUP BY 1) SELECT t.doc_id, CAST(pos AS INTEGER) AS id, CAST(CASE WHEN pos % 5 = 0 THEN level - coalesce(b, 0) ELSE level END AS INTEGER) AS level FROM t LEFT JOIN bias ON t.doc_id = bias.doc_id")
def _(s, d):
    return reconcile.synchronized_levels(_two_chunks(s, d))


@query("join_12_write_back", f"WITH {D.MIXED}, {_CONTAINED}, {_LINKS}, f AS (SELECT doc_id, src_id, tgt_id, min(chunk * 1000000 + line_no) AS o FROM links GROUP BY 1, 2, 3), last AS (SELECT doc_id, src_id, arg_max(tgt_id, o) AS tgt FROM f GROUP BY 1, 2) SELECT m.doc_id, m.pos, coalesce(l.tgt + 1, -1) AS contd, CAST(CASE WHEN type = 'title' THEN m.level ELSE -1 END AS INTEGER) AS level, coalesce(c.tgt + 1, l.tgt + 1, -1) AS image FROM mixed m LEFT JOIN last l ON l.doc_id = m.doc_id AND l.src_id = m.pos LEFT JOIN contained c ON c.doc_id = m.doc_id AND c.src = m.pos")
def _(s, d):
    m = D.mixed_blocks(s, d)
    links = reconcile.distinct_links(prompts.link_answers(_answers(s, d)))
    levels = m.where("type = 'title'").select("doc_id", C("pos").alias("id"), "level")
    base = m.select("doc_id", "pos")
    return reconcile.written_back(base, links, levels, links, candidates.containment_links(m))


@query("join_15_agg_06_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return resume.remaining(D.table(s, d, "documents"), D.table(s, d, "labels")).select("doc_id")


@query("agg_06_run_counts", "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS selected, (SELECT count(DISTINCT doc_id) FROM labels) AS written, (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 0) AS invalid, (SELECT count(DISTINCT doc_id) FROM documents) - (SELECT count(DISTINCT doc_id) FROM labels) AS skipped")
def _(s, d):
    lab = D.table(s, d, "labels")
    return resume.run_counts(D.table(s, d, "documents"), lab, lab.where("quality = 0"))


@query("snk_03_replay_log", f"WITH RECURSIVE {D.LONG_PAGES}, {_CHUNKS} SELECT doc_id, chunk, 'title_chunk_' || lpad(CAST(chunk AS VARCHAR), 4, '0') || '.json' AS file, CASE WHEN chunk % 2 = 0 THEN 'even ' || chunk ELSE '' END AS response FROM chunks")
def _(s, d):
    asked = chunking.ranges(D.long_pages(s, d)).select("doc_id", "chunk", F.lit("title").alias("task"))
    record = asked.where("chunk % 2 = 0").withColumn("response", F.concat(F.lit("even "), C("chunk").cast("string")))
    return responders.log_records(responders.replayed(asked, record)).select("doc_id", "chunk", "file", "response")


_JSON_RESPONSE = """CASE event_id % 6 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || '[1, ' || event_id || ']' || chr(10) || '```' || chr(10) || 'or [2]' WHEN 1 THEN 'So [' || user_id || ', [3]] it is' WHEN 2 THEN props WHEN 3 THEN '] none [' WHEN 4 THEN 'Sorry' ELSE '[1, ' || chr(10) || '{"a": "' || event_type || '"}]' END"""


@query(
    "str_07_json_answers",
    f"""WITH r AS (SELECT event_id, {_JSON_RESPONSE} AS response FROM events),
    p AS (SELECT event_id, CASE WHEN regexp_matches(response, '```json\\n(.*?)\\n```', 's') THEN regexp_extract(response, '```json\\n(.*?)\\n```', 1, 's')
      WHEN strpos(response, '[') > 0 AND strpos(response, ']') > 0 AND length(response) - strpos(reverse(response), ']') + 1 > strpos(response, '[')
      THEN substr(response, strpos(response, '['), length(response) - strpos(reverse(response), ']') + 2 - strpos(response, '[')) ELSE response END AS part FROM r)
    SELECT event_id, CASE WHEN json_valid(part) THEN part ELSE '!!LLM_ERROR!!' END AS json FROM p""",
)
def _(s, d):
    return prompts.json_answers(D.table(s, d, "events").select("event_id", F.expr(_JSON_RESPONSE).alias("response"))).select("event_id", "json")


@query("udf_responder_titles", f"WITH {D.DOC_BLOCKS} SELECT doc_id, CAST(pos AS INTEGER) AS id, CAST(1 + (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) % 3 AS INTEGER) AS level FROM doc_blocks WHERE type = 'title'")
def _(s, d):
    asked = prompts.prompts(candidates.title_candidates(D.doc_blocks(s, d)), "title")
    return prompts.level_answers(responders.answered(asked, responders.stub())).select("doc_id", "id", "level")


# --- tables --------------------------------------------------------------------------------------

_PREV = "lag(content) OVER (PARTITION BY doc_id ORDER BY pos) AS pc, lag(type) OVER (PARTITION BY doc_id ORDER BY pos) AS pt"
_LIKE = r"(?i)^(?:(?:table|表|exhibit|figure|图)\s*\p{Nd}+|\p{Nd}+(?:\.\p{Nd}+)*\s+|[一二三四五六七八九十]+、)"
_CAPTIONED = ["Table 3. ", "表 2 ", "EXHIBIT 4 ", "12.1 ", "plain ", "Figure 7 ", "Tab. A-2 "]


def _captioned(s, d):
    b = D.doc_blocks(s, d)
    kind = F.when(C("pos") % 3 == 1, "table").when(C("pos") % 9 == 3, "table_caption").when(C("pos") % 9 == 6, "title").otherwise("text")
    return b.withColumn("type", kind).withColumn("content", F.concat(F.get(F.array(*[F.lit(x) for x in _CAPTIONED]), (C("pos") % 7).cast("int")), F.left("content", F.lit(60)), F.when(C("pos") % 2 == 0, " (continued)").otherwise("")))


_CAP = D.DOC_BLOCKS + f", capped AS (SELECT * REPLACE (CASE WHEN pos % 3 = 1 THEN 'table' WHEN pos % 9 = 3 THEN 'table_caption' WHEN pos % 9 = 6 THEN 'title' ELSE 'text' END AS type, {_CAPTIONED}[pos % 7 + 1] || left(content, 60) || CASE WHEN pos % 2 = 0 THEN ' (continued)' ELSE '' END AS content) FROM doc_blocks)"


@query("join_04_win_05_captions", f"WITH {_CAP}, p AS (SELECT doc_id, pos, type, {_PREV} FROM capped), q AS (SELECT *, {STRIP('pc')} AS t FROM p) SELECT doc_id, pos, nullif(CASE WHEN pt IN ('table_caption', 'title') OR (pt = 'text' AND length(t) < 150 AND regexp_matches(t, '{_LIKE}')) THEN t END, '') AS caption FROM q WHERE type = 'table'")
def _(s, d):
    return tables.captions(_captioned(s, d))


_NUM = "CASE " + " ".join(f"WHEN regexp_matches(content, '{p}') THEN '{k}:' || upper(regexp_replace(regexp_extract(content, '{p}', 1), '[ -]', '', 'g'))" for p, k in tables.NUMBER_PATTERNS) + " END"


@query("flt_10_11_caption_rules", f"WITH {_CAP} SELECT doc_id, pos, {_NUM} AS number, ends_with(lower(content), '(continued)') OR contains(lower(content), '(continued)') AS continued FROM capped")
def _(s, d):
    return _captioned(s, d).select("doc_id", "pos", tables.caption_number(C("content")).alias("number"), tables.has_marker(C("content")).alias("continued"))


@query("join_05_flt_12_footnotes", f"WITH {D.MIXED}, runs AS (SELECT a.doc_id, a.pos, a.page, (SELECT min(b.pos) FROM mixed b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.pos > a.pos AND b.type NOT IN ('table_footnote', 'table_caption')) AS stop, (SELECT max(b.pos) FROM mixed b WHERE b.doc_id = a.doc_id AND b.page = a.page) AS last FROM mixed a WHERE type = 'table') SELECT doc_id, pos, CAST(coalesce(stop - pos - 1, last - pos) AS BIGINT) AS notes FROM runs")
def _(s, d):
    return tables.footnote_counts(D.mixed_blocks(s, d))


@query("flt_09_texts_around", f"WITH {D.MIXED} SELECT doc_id, pos, EXISTS (SELECT 1 FROM mixed b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.pos < a.pos AND b.type = 'text') AS text_before, EXISTS (SELECT 1 FROM mixed b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.pos > a.pos AND b.type = 'text') AS text_after FROM mixed a WHERE type = 'table'")
def _(s, d):
    return tables.texts_around(D.mixed_blocks(s, d))


@query("join_06_page_captions", f"WITH {_CAP}, f AS (SELECT doc_id, page, arg_min(content, pos) AS caption FROM capped WHERE type = 'table_caption' GROUP BY 1, 2) SELECT a.doc_id, a.pos, f.caption FROM capped a LEFT JOIN f ON f.doc_id = a.doc_id AND f.page = a.page WHERE a.type = 'table'")
def _(s, d):
    return annotate.caption_of_page(_captioned(s, d))


@query("tbl_01_02_03_agg_08_grid_measures", f"WITH {D.ORDER_TABLES} SELECT doc_id, CAST(page AS BIGINT) AS id, CAST(count(*) + 1 AS INTEGER) AS rows, 3 AS columns, 3 AS effective_last, 3 AS span_last, 3 AS visual_last FROM order_halves GROUP BY 1, 2")
def _(s, d):
    return D.order_tables(s, d).select("doc_id", "id", tables.measures("content").alias("m")).select("doc_id", "id", "m.*")


@query("flt_13_14_15_screening", f"WITH {D.ORDER_TABLES} SELECT doc_id, CAST(0 AS BIGINT) AS table1, CAST(1 AS BIGINT) AS table2, CAST(NULL AS VARCHAR) AS reason FROM order_halves GROUP BY doc_id HAVING count(DISTINCT page) = 2")
def _(s, d):
    t = D.order_tables(s, d)
    return tables.screened(t, candidates.table_pairs(t)).select("doc_id", "table1", "table2", "reason")


@query("flt_15_screening_reasons")
def _(s, d):
    b = _captioned(s, d).withColumn("x2", F.when(C("pos") % 4 == 0, 0.5).otherwise(0.9)).withColumn("content", F.when(C("type") == "table", F.lit("<table><tr><td>a</td><td>b</td></tr></table>")).otherwise(C("content")))
    return tables.screened(b, candidates.table_pairs(b)).select("doc_id", "table1", "table2", "reason")


@query("tbl_06_07_topk_02_edge_rows", f"WITH {D.ORDER_TABLES}, e AS (SELECT doc_id, max(rn) FILTER (page = 1) AS a, min(rn) FILTER (page = 2) AS b FROM order_halves GROUP BY 1 HAVING count(DISTINCT page) = 2) SELECT e.doc_id, '[[''' || x.l_linenumber || ''', ''' || x.l_partkey || ''', ''' || x.l_returnflag || ''']]' AS upper_rows, '[[''' || y.l_linenumber || ''', ''' || y.l_partkey || ''', ''' || y.l_returnflag || ''']]' AS lower_rows FROM e JOIN order_rows x ON x.doc_id = e.doc_id AND x.rn = a JOIN order_rows y ON y.doc_id = e.doc_id AND y.rn = b")
def _(s, d):
    t = D.order_tables(s, d)
    return tables.screened(t, candidates.table_pairs(t)).select("doc_id", "upper_rows", "lower_rows")


def _chain_tables(s, d):
    """Orders of a customer as tables; each of three in a row is linked to the next."""
    o = D.table(s, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = o.select(C("o_custkey").alias("doc_id"), C("o_orderkey").alias("id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.lead("o_orderkey").over(w).alias("nx"))
    return o.select("doc_id", "id", "pos", F.when(C("pos") % 3 < 2, F.coalesce("nx", F.lit(-1))).otherwise(-1).cast("long").alias("table_merge"))


@query("graph_01_table_chains", "WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), g AS (SELECT *, first_value(id) OVER (PARTITION BY doc_id, pos // 3 ORDER BY pos) AS base, count(*) OVER (PARTITION BY doc_id, pos // 3) AS m FROM o) SELECT doc_id, id, base FROM g WHERE m > 1")
def _(s, d):
    return tables.chains(_chain_tables(s, d))


@query("tbl_08_12_merge_tables", f"WITH {D.ORDER_TABLES}, h AS (SELECT *, doc_id % 4 = 0 AND count(*) FILTER (page = 2) OVER (PARTITION BY doc_id) > 0 AS one FROM order_halves) SELECT doc_id, CAST(CASE WHEN one THEN 1 ELSE page END AS BIGINT) AS id, '<table><tr><th>line</th><th>part</th><th>flag</th></tr>' || string_agg('<tr><td>' || l_linenumber || '</td><td>' || l_partkey || '</td><td>' || l_returnflag || '</td></tr>', '' ORDER BY rn) || '</table>' AS content, CASE WHEN one THEN '1,2' ELSE CAST(page AS VARCHAR) END AS ids FROM h GROUP BY doc_id, one, CASE WHEN one THEN 1 ELSE page END, CASE WHEN one THEN '1,2' ELSE CAST(page AS VARCHAR) END")
def _(s, d):
    t = D.order_tables(s, d)
    return tables.merge_tables(t, tables.chains(t)).select("doc_id", "id", "content", F.array_join(C("block_ids").cast("array<string>"), ",").alias("ids"))


# --- trees ---------------------------------------------------------------------------------------

_COMP = """e AS (SELECT *, sum(CASE WHEN type = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS comp FROM mixed WHERE type IN ('title', 'text')),
src AS (SELECT doc_id, contd AS id, min(pos) AS fp FROM e WHERE type = 'text' AND contd >= 0 GROUP BY 1, 2),
f AS (SELECT doc_id, comp, min(pos) AS f FROM e WHERE type = 'text' AND content <> '' GROUP BY 1, 2),
raw AS (
  SELECT e.doc_id, e.comp, max(CASE WHEN type = 'title' THEN content END) AS title, max(CASE WHEN type = 'title' THEN level END) AS level,
    coalesce(substr(string_agg(CASE WHEN type = 'text' AND pos >= f THEN CASE WHEN fp <= pos THEN '<|txt_contd|>' ELSE '<|txt_split|>' END || content END, '' ORDER BY pos), 14), '') AS content, string_agg(e.id, ',' ORDER BY pos) AS ids
  FROM e LEFT JOIN src ON src.doc_id = e.doc_id AND src.id = e.id LEFT JOIN f ON f.doc_id = e.doc_id AND f.comp = e.comp GROUP BY 1, 2
), comps AS (SELECT doc_id, CAST(comp AS INTEGER) AS comp, coalesce(title, 'Default Title') AS title, CAST(coalesce(level, 1) AS INTEGER) AS level, content, ids FROM raw QUALIFY title IS NOT NULL OR content <> '' OR comp = max(comp) OVER (PARTITION BY doc_id)
  UNION ALL SELECT DISTINCT doc_id, 0, 'Default Title', 1, '', '' FROM mixed WHERE doc_id NOT IN (SELECT doc_id FROM e))"""
_NEST = """placed AS (SELECT a.doc_id, a.comp, max(b.comp) AS parent FROM comps a LEFT JOIN comps b ON b.doc_id = a.doc_id AND b.comp < a.comp AND CASE WHEN b.level > 0 THEN b.level ELSE 100 END < CASE WHEN a.level > 0 THEN a.level ELSE 100 END GROUP BY 1, 2),
deep(doc_id, comp, depth) AS (SELECT doc_id, comp, 1 FROM placed WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.comp, depth + 1 FROM placed p JOIN deep ON deep.doc_id = p.doc_id AND deep.comp = p.parent)"""


@query("tree_01_win_03_agg_05_components", f"WITH {D.MIXED}, {_COMP} SELECT * FROM comps")
def _(s, d):
    got = tree.components(D.mixed_blocks(s, d))
    return got.select("doc_id", "comp", "title", "level", "content", F.array_join(C("block_ids").cast("array<string>"), ",").alias("ids"))


@query("tree_02_win_07_parents", f"WITH RECURSIVE {D.MIXED}, {_COMP}, {_NEST} SELECT p.doc_id, p.comp, CAST(coalesce(parent, -1) AS BIGINT) AS parent, CAST(depth AS INTEGER) AS depth FROM placed p JOIN deep ON deep.doc_id = p.doc_id AND deep.comp = p.comp")
def _(s, d):
    return tree.nested(tree.components(D.mixed_blocks(s, d))).select("doc_id", "comp", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth")


_TITLED = D.DOC_BLOCKS + """, mixed AS (SELECT *, CASE WHEN type = 'title' THEN pos % 3 + 1 ELSE -1 END AS level, -1 AS contd FROM doc_blocks)"""


@query("tree_06_preview", f"WITH RECURSIVE {_TITLED}, {_COMP}, {_NEST} SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY c.comp) AS INTEGER) AS seq, repeat(' ', depth * 4) || title || '|' || left(content, 30) || CASE WHEN length(content) > 30 THEN '...' ELSE '' END AS line FROM comps c JOIN deep ON deep.doc_id = c.doc_id AND deep.comp = c.comp UNION ALL SELECT DISTINCT doc_id, 0, '|' FROM comps")
def _(s, d):
    b = D.doc_blocks(s, d).withColumn("level", F.when(C("type") == "title", (C("pos") % 3 + 1).cast("int")).otherwise(-1)).withColumn("contd", F.lit(-1).cast("long"))
    return tree.preview(tree.nested(tree.components(b)))


@query("tree_03_join_07_figures", f"WITH {D.MIXED}, n AS (SELECT doc_id, image AS id, string_agg(CASE WHEN contains(type, 'caption') THEN content END, ' ' ORDER BY pos) AS t, string_agg(CASE WHEN contains(type, 'footnote') THEN content END, ' ' ORDER BY pos) AS m, string_agg(id, ',' ORDER BY pos) AS ids FROM mixed WHERE contains(type, 'caption') OR contains(type, 'footnote') GROUP BY 1, 2) SELECT v.doc_id, v.id, v.type, coalesce(t, '') AS title, coalesce(m, '') AS metadata, v.id || coalesce(',' || ids, '') AS ids FROM mixed v LEFT JOIN n ON n.doc_id = v.doc_id AND n.id = v.id WHERE v.type IN ('image', 'table', 'image_block')")
def _(s, d):
    return tree.figures(D.mixed_blocks(s, d)).select("doc_id", "id", "type", "title", "metadata", F.array_join(C("block_ids").cast("array<string>"), ",").alias("ids"))


@query("tree_03_join_08_09_10_figure_parents", f"WITH {D.MIXED}, {_COMP}, n AS (SELECT doc_id, image AS v, id FROM mixed WHERE contains(type, 'caption') OR contains(type, 'footnote')), vis AS (SELECT doc_id, id, type, image FROM mixed WHERE type IN ('image', 'table', 'image_block')), held AS (SELECT doc_id, id AS v, id FROM vis UNION ALL SELECT n.doc_id, n.v, n.id FROM n JOIN vis ON vis.doc_id = n.doc_id AND vis.id = n.v), lnk AS (SELECT v.doc_id, v.id, CASE WHEN image >= 0 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = v.doc_id AND h.v = v.id AND h.id = v.image) THEN image END AS link, (SELECT min(h.id) FROM held h WHERE h.doc_id = v.doc_id AND h.v = v.id) AS least FROM vis v), r AS (SELECT l.*, (SELECT min(h.v) FROM held h WHERE h.doc_id = l.doc_id AND h.id = l.link AND h.v <> l.id) AS holder, coalesce(link, (SELECT max(m.id) FROM mixed m WHERE m.doc_id = l.doc_id AND m.type = 'title' AND m.id < l.least)) AS at FROM lnk l), spots AS (SELECT c.doc_id, c.comp, CAST(unnest(string_split(ids, ',')) AS BIGINT) AS at FROM comps c WHERE ids <> '') SELECT r.doc_id, r.id, CASE WHEN holder IS NOT NULL THEN 'figure' WHEN s.comp IS NOT NULL THEN 'text' END AS parent_kind, CAST(coalesce(holder, s.comp, -1) AS BIGINT) AS parent FROM r LEFT JOIN spots s ON s.doc_id = r.doc_id AND s.at = r.at")
def _(s, d):
    m = D.mixed_blocks(s, d)
    got = tree.figure_parents(tree.figures(m), tree.components(m), m.where("type = 'title'"))
    return got.select("doc_id", "id", "parent_kind", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("tree_04_win_04_furniture", f"WITH {D.MIXED}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, type ORDER BY pos) - 1 AS n FROM mixed WHERE type = 'header') SELECT doc_id, id, type, 'Page ' || page || ' - ' || type || CASE WHEN n > 0 THEN ' - ' || n ELSE '' END AS title, content FROM f")
def _(s, d):
    return tree.furniture(D.mixed_blocks(s, d)).select("doc_id", "id", "type", "title", "content")


# Parts of long texts: pieces are packed until a part is over the limit, one piece a step.
_PARTS = """texts AS (
  SELECT e.doc_id, e.comp, e.id, e.content, row_number() OVER (PARTITION BY e.doc_id, e.comp ORDER BY e.pos) AS k
  FROM e JOIN comps c ON c.doc_id = e.doc_id AND c.comp = e.comp WHERE type = 'text' AND e.content <> '' AND length(c.content) > 500
), packed(doc_id, comp, k, size, part) AS (
  SELECT doc_id, comp, 1, length(content), 1 FROM texts WHERE k = 1
  UNION ALL SELECT t.doc_id, t.comp, p.k + 1, CASE WHEN size > 500 THEN 0 ELSE size END + length(t.content), part + CASE WHEN size > 500 THEN 1 ELSE 0 END
  FROM packed p JOIN texts t ON t.doc_id = p.doc_id AND t.comp = p.comp AND t.k = p.k + 1
), parts AS (
  SELECT t.doc_id, t.comp, part, string_agg(content, '' ORDER BY t.k) AS content, list(t.id ORDER BY t.k) AS ids
  FROM texts t JOIN packed p ON t.doc_id = p.doc_id AND t.comp = p.comp AND t.k = p.k GROUP BY 1, 2, 3 QUALIFY count(*) OVER (PARTITION BY t.doc_id, t.comp) > 1
), subs AS (
  SELECT p.doc_id, p.comp, part, title || '_' || part AS title, p.content, CASE WHEN title = 'Default Title' THEN p.ids ELSE list_prepend(CAST(split_part(c.ids, ',', 1) AS BIGINT), p.ids) END AS ids
  FROM parts p JOIN comps c ON c.doc_id = p.doc_id AND c.comp = p.comp
)"""
# Figures with captions and notes, and the node each hangs on.
_FIGURES = """vis AS (SELECT doc_id, id, pos, type, image, content FROM mixed WHERE type IN ('image', 'table', 'image_block')),
n AS (SELECT m.doc_id, m.image AS v, m.id, m.pos, m.content, contains(m.type, 'caption') AS cap FROM mixed m JOIN vis ON vis.doc_id = m.doc_id AND vis.id = m.image WHERE contains(m.type, 'caption') OR contains(m.type, 'footnote')),
held AS (SELECT doc_id, id AS v, id, -1 AS at FROM vis UNION ALL SELECT doc_id, v, id, pos FROM n),
lnk AS (SELECT v.*, CASE WHEN image >= 0 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = v.doc_id AND h.v = v.id AND h.id = v.image) THEN image END AS link, (SELECT min(h.id) FROM held h WHERE h.doc_id = v.doc_id AND h.v = v.id) AS least FROM vis v),
r AS (SELECT l.*, (SELECT min(h.v) FROM held h WHERE h.doc_id = l.doc_id AND h.id = l.link AND h.v <> l.id) AS holder, coalesce(link, (SELECT max(m.id) FROM mixed m WHERE m.doc_id = l.doc_id AND m.type = 'title' AND m.id < l.least)) AS at FROM lnk l),
spots AS (SELECT doc_id, comp, CAST(unnest(string_split(ids, ',')) AS BIGINT) AS at FROM comps WHERE ids <> ''),
figs AS (
  SELECT r.doc_id, r.id, r.pos, r.type, r.content, r.image, CASE WHEN holder IS NOT NULL THEN 'f' || holder WHEN s.comp IS NOT NULL THEN 't' || s.comp END AS up,
    coalesce((SELECT string_agg(n.content, ' ' ORDER BY n.pos) FROM n WHERE n.doc_id = r.doc_id AND n.v = r.id AND cap), '') AS title, coalesce((SELECT string_agg(n.content, ' ' ORDER BY n.pos) FROM n WHERE n.doc_id = r.doc_id AND n.v = r.id AND NOT cap), '') AS metadata,
    (SELECT list(h.id ORDER BY h.at) FROM held h WHERE h.doc_id = r.doc_id AND h.v = r.id) AS ids
  FROM r LEFT JOIN spots s ON s.doc_id = r.doc_id AND s.at = r.at
), named AS (
  SELECT doc_id, id, pos, type, content, 'Page ' || page || ' - ' || type || CASE WHEN k > 1 THEN ' - ' || (k - 1) ELSE '' END AS title
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, type ORDER BY pos) AS k FROM mixed WHERE type = 'header')
)"""
# All nodes under their parents; the path of places from the root sorts them in preorder.
_TREE = f"""{_COMP}, {_NEST}, {_PARTS}, {_FIGURES}, nodes AS (
  SELECT c.doc_id, 't' || c.comp AS node, coalesce('t' || parent, 'root') AS up, 1 AS kind, CAST(c.comp AS BIGINT) AS ord, 'text' AS type, title, '' AS metadata, content, level, list_transform(list_filter(string_split(ids, ','), lambda x: x <> ''), lambda x: CAST(x AS BIGINT)) AS ids FROM comps c JOIN placed p ON p.doc_id = c.doc_id AND p.comp = c.comp
  UNION ALL SELECT doc_id, 's' || comp || '_' || part, 't' || comp, 0, part, 'sub_text', title, '', content, 1, ids FROM subs
  UNION ALL SELECT doc_id, 'f' || id, up, 2, pos, type, title, metadata, content, image, ids FROM figs
  UNION ALL SELECT doc_id, 'h' || id, 'root', 3, pos, type, title, content, content, -1, [id] FROM named
), walk(doc_id, node, depth, path) AS (
  SELECT DISTINCT doc_id, 'root', 0, CAST([] AS BIGINT[]) FROM mixed
  UNION ALL SELECT n.doc_id, n.node, depth + 1, path || [CAST(n.kind AS BIGINT), n.ord] FROM walk w JOIN nodes n ON n.doc_id = w.doc_id AND n.up = w.node
), ranked AS (
  SELECT w.doc_id, CAST(row_number() OVER (PARTITION BY w.doc_id ORDER BY path) - 1 AS INTEGER) AS preorder, CAST(depth AS INTEGER) AS depth, coalesce(type, 'root') AS type, coalesce(title, '') AS title,
    coalesce(metadata, '') AS metadata, coalesce(n.content, '') AS content, CAST(coalesce(n.level, 0) AS INTEGER) AS level, coalesce(ids, []) AS ids
  FROM walk w LEFT JOIN nodes n ON n.doc_id = w.doc_id AND n.node = w.node
)"""
_SPOT = "(SELECT string_agg(m.page || ':' || trunc(m.x1 * 1000)::INTEGER || ' ' || trunc(m.y1 * 1000)::INTEGER || ' ' || trunc(m.x2 * 1000)::INTEGER || ' ' || trunc(m.y2 * 1000)::INTEGER, ',' ORDER BY k) FROM (SELECT unnest(ids) AS i, generate_subscripts(ids, 1) AS k) u JOIN mixed m ON m.doc_id = r.doc_id AND m.id = u.i)"


@query("tree_03_05_07_whole_tree", f"WITH RECURSIVE {D.TREE_BLOCKS}, {_TREE} SELECT doc_id, preorder, depth, type, title, metadata, content, level, array_to_string(ids, ',') AS ids, coalesce({_SPOT}, '') AS location FROM ranked r")
def _(s, d):
    n = tree.whole(D.tree_blocks(s, d))
    spot = F.transform("location", lambda p: F.concat(p["page"].cast("string"), F.lit(":"), F.array_join(F.transform(p["bbox"], lambda x: (x * 1000).cast("int").cast("string")), " ")))
    ids = F.array_join(C("block_ids").cast("array<string>"), ",").alias("ids")
    return n.select("doc_id", "preorder", "depth", "type", "title", "metadata", "content", "level", ids, F.array_join(spot, ",").alias("location"))


_NODE_JSON = """SELECT doc_id, preorder, depth, type, lag(depth) OVER w AS before, lag(type) OVER w AS type_before, coalesce(lead(depth) OVER w, 0) AS after, coalesce(lead(type) OVER w, '') AS type_after,
  to_json({'type': type, 'title': title, 'metadata': metadata, 'content': content, 'level': level, 'location': coalesce((SELECT list({'bbox': [m.x1, m.y1, m.x2, m.y2], 'page': m.page} ORDER BY k) FROM (SELECT unnest(ids) AS i, generate_subscripts(ids, 1) AS k) u JOIN mixed m ON m.doc_id = r.doc_id AND m.id = u.i), []), 'block_ids': ids})::VARCHAR AS own
FROM ranked r WINDOW w AS (PARTITION BY doc_id ORDER BY preorder)"""
_TREE_JSON = f"""WITH RECURSIVE {D.TREE_BLOCKS}, {_TREE}, own AS ({_NODE_JSON}), text AS (
  SELECT doc_id, preorder, CASE WHEN before >= depth AND NOT (type_before = 'sub_text' AND type <> 'sub_text' AND before = depth) THEN ',' ELSE '' END || left(own, length(own) - 1)
    || CASE WHEN type = 'sub_text' THEN ',"children":[]}}' || CASE WHEN type_after = 'sub_text' AND after = depth THEN '' ELSE '],"children":[' END
      WHEN type = 'header' THEN ',"subnode":[]}}' WHEN type IN ('image', 'table', 'image_block') AND after > depth THEN ',"children":[],"subnode":['
      WHEN type_after = 'sub_text' AND after > depth THEN ',"subnode":[' ELSE ',"subnode":[],"children":[' END
    || repeat(']}}', greatest(depth - after + CASE WHEN type IN ('sub_text', 'header') THEN 0 ELSE 1 END, 0)) AS t FROM own
) SELECT doc_id, string_agg(t, '' ORDER BY preorder) AS json FROM text GROUP BY doc_id"""


@query("tree_05_snk_05_tree_json", _TREE_JSON)
def _(s, d):
    return sinks.tree_json(tree.whole(D.tree_blocks(s, d)))


_SPLIT = D.DOC_BLOCKS + """, mixed AS (SELECT *, CASE WHEN type = 'title' AND pos % 9 = 0 THEN pos % 3 + 1 ELSE -1 END AS level, -1 AS contd FROM (SELECT * REPLACE (CASE WHEN type = 'title' AND pos % 9 <> 0 THEN 'text' ELSE type END AS type) FROM doc_blocks))"""


@query("tree_07_split_texts", f"WITH RECURSIVE {_SPLIT}, {_COMP}, {_PARTS} SELECT doc_id, comp, CAST(part AS INTEGER) AS part, title, content, array_to_string(ids, ',') AS ids FROM subs")
def _(s, d):
    b = D.doc_blocks(s, d).withColumn("type", F.when(C("pos") % 9 == 0, C("type")).otherwise("text"))
    b = b.withColumn("level", F.when(C("type") == "title", (C("pos") % 3 + 1).cast("int")).otherwise(-1)).withColumn("contd", F.lit(-1).cast("long"))
    got = tree.split_texts(tree.components(b))
    return got.select("doc_id", "comp", "part", "title", "content", F.array_join(C("block_ids").cast("array<string>"), ",").alias("ids"))


# --- staged runs ---------------------------------------------------------------------------------

_RUN_TABLE = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"


def _run_files(s, d):
    """Documents as vendor files: lines, and two tables on pages of their own at the end of every third; some files are cut off, some missing."""
    b = D.doc_blocks(s, d).select("doc_id", "pos", "page", F.when(C("type") == "title", "paragraph_title").otherwise("text").alias("label"), "content")
    ends = b.where("doc_id % 3 = 0").groupBy("doc_id").agg(F.max("pos").alias("last"), F.max("page").alias("page"))
    more = ends.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), "last", "page").select("doc_id", (C("last") + C("k")).alias("pos"), (C("page") + C("k")).cast("int").alias("page"), F.lit("table").alias("label"), F.lit(_RUN_TABLE).alias("content"))
    at = C("pos") % 8
    item = F.struct(C("label").alias("block_label"), C("content").alias("block_content"), F.array(F.lit(100.0), at * 10.0, F.lit(900.0), at * 10.0 + 10.0).alias("block_bbox"), C("pos").alias("block_order"))
    lists = lambda df, keys, o, v: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(C(o).alias("o"), v.alias("v")))), lambda x: x["v"]).alias("l"))
    page = F.struct(F.struct(F.lit(1000).alias("width"), F.lit(100).alias("height"), C("l").alias("parsing_res_list")).alias("prunedResult"))
    docs = lists(lists(b.unionByName(more), ["doc_id", "page"], "pos", item), ["doc_id"], "page", page)
    js = F.to_json(F.struct(F.struct(C("l").alias("layoutParsingResults")).alias("result")))
    js = F.when(C("doc_id") % 11 == 4, F.left(js, F.length(js) - 1)).otherwise(js)
    return docs.where("doc_id % 13 != 5").select(C("doc_id").cast("string").alias("doc_id"), F.lit("paddle").alias("form"), js.alias("json"))


def _run_client():
    """Levels by place; tables are one; a document whose first title is its fourth block can't be answered."""

    def call(prompt: str) -> str:
        if prompt.startswith(prompts.HEADS["title"]):
            ids = [int(line.split("<|page|>")[0]) for line in prompt.split("<|id|>")[1:]]
            if ids[0] == 3:
                raise RuntimeError("no answer")
            return "\n".join(f"<|id|>{i}<|level|>{i % 3 + 1}" for i in ids)
        return "" if prompt.startswith("<image>") else "flags: [0, 0]"

    return call


_RUN_SQL = f"""WITH RECURSIVE {D.DOC_BLOCKS}, lines AS (
  -- Titles of one page are no chunk, so no levels are asked for.
  SELECT * REPLACE ({NORMAL('content')} AS content), coalesce(min(page) FILTER (type = 'title') OVER d < max(page) FILTER (type = 'title') OVER d, false) AS asked FROM doc_blocks WINDOW d AS (PARTITION BY doc_id)
), state AS (
  SELECT doc_id, CASE WHEN doc_id % 13 = 5 THEN 'missing' WHEN doc_id % 11 = 4 THEN 'invalid' WHEN min(pos) FILTER (type = 'title') = 3 AND asked THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM lines GROUP BY 1, asked
), mixed AS (SELECT * REPLACE (CASE WHEN asked THEN type ELSE 'text' END AS type), CASE WHEN type = 'title' AND asked THEN pos % 3 + 1 ELSE -1 END AS level, -1 AS contd FROM lines WHERE doc_id IN (SELECT doc_id FROM state WHERE status = 'ok')), {_COMP}, {_NEST}, {_PARTS},
size AS (SELECT placed.doc_id, count(*) AS texts, max(depth) AS depth FROM placed JOIN deep ON deep.doc_id = placed.doc_id AND deep.comp = placed.comp GROUP BY 1), cut AS (SELECT doc_id, count(*) AS parts, max(depth) + 1 AS depth FROM subs JOIN deep USING (doc_id, comp) GROUP BY 1),
hung AS (SELECT doc_id, arg_max(depth, comp) + 1 AS depth FROM deep JOIN comps USING (doc_id, comp) WHERE title <> 'Default Title' AND doc_id % 3 = 0 GROUP BY 1)
SELECT CAST(s.doc_id AS VARCHAR) AS doc_id, CASE status WHEN 'ok' THEN 'trees' WHEN 'failed' THEN 'answers' ELSE 'blocks' END AS stage, status,
  CASE WHEN status IN ('missing', 'invalid') THEN 0 ELSE n + CASE WHEN s.doc_id % 3 = 0 THEN 2 ELSE 0 END END AS blocks, coalesce(texts, 0) AS texts, coalesce(parts, 0) AS parts,
  CASE WHEN h.depth IS NULL THEN 0 ELSE 1 END AS tables, CASE WHEN h.depth IS NULL THEN 0 ELSE 2 END AS table_places, CAST(coalesce(greatest(z.depth, coalesce(c.depth, 0), coalesce(h.depth, 0)), 0) AS INTEGER) AS depth
FROM state s LEFT JOIN size z ON z.doc_id = s.doc_id LEFT JOIN cut c ON c.doc_id = s.doc_id LEFT JOIN hung h ON h.doc_id = s.doc_id"""


@query("run_01_staged_documents", _RUN_SQL)
def _(s, d):
    run = staged.Run(s, durable.new_folder(s, "staged"), "paddle", _run_client, tries=2)
    report = run.go(D.table(s, d, "documents").select(C("doc_id").cast("string").alias("doc_id")), _run_files(s, d))
    count = lambda cond, name: F.count_if(cond).alias(name)
    kind = C("type")
    trees = run.table("trees").groupBy("doc_id").agg(count(kind == "text", "texts"), count(kind == "sub_text", "parts"), count(kind == "table", "tables"), F.sum(F.when(kind == "table", F.size("location")).otherwise(0)).alias("table_places"), F.max("depth").alias("depth"))
    rows = run.ledger().where("stage = 'blocks'").select("doc_id", C("rows").alias("blocks"))
    got = report.join(rows, "doc_id").join(trees, "doc_id", "left")
    number = lambda c, t: F.coalesce(c, F.lit(0)).cast(t).alias(c)
    return got.select("doc_id", "stage", "status", "blocks", *(number(c, "long") for c in ("texts", "parts", "tables", "table_places")), number("depth", "int"))


@query("enr_01_enrichment", f"WITH {D.MIXED} SELECT doc_id, id, type, CASE WHEN type = 'image' THEN 'T' || id WHEN type = 'text' THEN '' END AS title, CASE WHEN type = 'image' THEN 'M' ELSE '[T]T' || id || '[M]M[C]C' END AS metadata, content FROM mixed WHERE type IN ('image', 'text') AND content <> ''")
def _(s, d):
    m = D.mixed_blocks(s, d).where("type in ('image', 'text') and content != ''").select("doc_id", "id", "type", F.lit("").alias("title"), F.lit("").alias("metadata"), "content")
    return tree.enrich(m, m.select("doc_id", "id", F.concat(F.lit("[T]T"), C("id").cast("string"), F.lit("[M]M[C]C")).alias("answer")))


@query("ann_01_title_parents", f"WITH {D.DOC_BLOCKS}, t AS (SELECT doc_id, pos, pos % 3 + 1 AS level FROM doc_blocks WHERE type = 'title') SELECT a.doc_id, a.pos, coalesce(max(b.pos), -1) AS parent FROM t a LEFT JOIN t b ON b.doc_id = a.doc_id AND b.pos > 0 AND b.pos < a.pos AND b.level < a.level GROUP BY 1, 2")
def _(s, d):  # also join_11
    return annotate.title_parents(D.doc_titles(s, d)).select("doc_id", "pos", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("ann_01_full_sentences", f"WITH {D.DOC_BLOCKS_OPEN}, {_PAIRS}, {_CONTD} SELECT s.doc_id, s.pos AS idx, r.ord, s.joined AS content, s.page, {BOX('s.')} AS box FROM sent s JOIN (SELECT doc_id, pos, CAST(ord AS INTEGER) AS ord FROM ranked) r ON r.doc_id = s.doc_id AND r.pos = s.pos")
def _(s, d):
    return annotate.full_sentences(D.doc_blocks(s, d, True))


# --- sources and sinks ---------------------------------------------------------------------------


def _vendor_json(s, d, form):
    """Documents in a vendor's form, built from their lines."""
    p = D.pixel_items(s, d)
    known = sorted(labels.TABLES[{"miner_middle": "miner", "miner_list": "miner", "miner_model": "miner", "glm_model": "glm"}.get(form, form)])
    label = F.get(F.array(*[F.lit(k) for k in known]), C("k") % len(known))
    thousand = F.transform("bbox", lambda v: v * F.lit(1.0))
    if form == "paddle":
        item = F.struct(label.alias("block_label"), C("content").alias("block_content"), C("bbox").alias("block_bbox"), C("rank").alias("block_order"))
    elif form == "dolphin":
        item = F.struct(label.alias("label"), C("content").alias("text"), "bbox", C("rank").alias("reading_order"))
    elif form == "miner_middle":
        item = F.struct(label.alias("type"), "bbox", F.array(F.struct(F.array(F.struct("content")).alias("spans"))).alias("lines"))
    elif form == "miner_list":
        item = F.struct(label.alias("type"), thousand.alias("bbox"), C("content").alias("text"), (C("page") - 1).alias("page_idx"), F.when(C("k") == 2, C("page")).alias("text_level"))
    elif form == "miner_model":
        item = F.struct(label.alias("type"), thousand.alias("bbox"), "content")
    else:
        item = F.struct(label.alias("label"), thousand.alias("bbox_2d"), "content")
    lists = lambda df, keys, o, v: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(C(o).alias("o"), v.alias("v")))), lambda x: x["v"]).alias("l"))
    if form == "miner_list":
        return lists(p, ["doc_id"], "pos", item).select(C("doc_id").cast("string").alias("doc_id"), F.to_json("l").alias("json"))
    pages = lists(p, ["doc_id", "page"], "pos", item)
    if form == "paddle":
        page = F.struct(F.struct(F.lit(1000).alias("width"), F.lit(100).alias("height"), C("l").alias("parsing_res_list")).alias("prunedResult"))
    elif form == "dolphin":
        page = F.struct(C("page").alias("page_number"), C("l").alias("elements"))
    elif form == "miner_middle":
        page = F.struct((C("page") - 1).alias("page_idx"), F.array(F.lit(1000), F.lit(100)).alias("page_size"), C("l").alias("para_blocks"))
    else:
        page = C("l")
    docs = lists(pages, ["doc_id"], "page", page)
    if form == "paddle":
        body = F.to_json(F.struct(F.struct(C("l").alias("layoutParsingResults")).alias("result")))
    elif form == "dolphin":
        body = F.to_json(F.struct(C("l").alias("pages")))
    elif form == "miner_middle":
        body = F.to_json(F.struct(C("l").alias("pdf_info")))
    else:
        body = F.to_json("l")
    return docs.select(C("doc_id").cast("string").alias("doc_id"), body.alias("json"))


def _reader_sql(form: str, vendor: str, by: str, box: str) -> str:
    known = sorted(labels.TABLES[vendor])
    canonical, fine = _label_case(vendor, 0), _label_case(vendor, 1)
    level = "CASE WHEN label = 'catalogue' THEN 1 END" if vendor == "dolphin" else "CAST(NULL AS INTEGER)"
    if form == "miner_list":
        titled = f"k = 2 AND {canonical} <> '__skip__'"
        canonical, fine, level = f"CASE WHEN {titled} THEN 'title' ELSE {canonical} END", f"CASE WHEN {titled} THEN 'title' ELSE {fine} END", f"CASE WHEN {titled} THEN page END"
    y = {"px": ("k * 10.0 / 100.0", "(k * 10.0 + 10.0) / 100.0"), "th": ("k * 10.0 / 1000.0", "(k * 10.0 + 10.0) / 1000.0"), "raw": ("k * 10.0", "k * 10.0 + 10.0")}[box]
    x = ("100.0", "900.0") if box == "raw" else ("100.0 / 1000.0", "900.0 / 1000.0")
    if box == "px":
        x = ("100.0 / 1000.0", "900.0 / 1000.0")
    return f"""WITH {D.PIXELS}, l AS (SELECT doc_id, pos, page, k, rank, {NORMAL('content')} AS content, {known}[k % {len(known)} + 1] AS label FROM pixels),
m AS (SELECT *, {canonical} AS type, {fine} AS fine_type, {level} AS title_level FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, {by}) - 1 AS o FROM m WHERE fine_type <> '__skip__' AND NOT (type IN ('text', 'title', 'caption') AND content = ''))
SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id || ':' || o AS block_id, page, CAST(o AS INTEGER) AS "order", type, fine_type, content, CAST(coalesce(title_level, -1) AS INTEGER) AS title_level, label AS source_label,
  CAST({x[0]} AS DOUBLE) AS x1, CAST({y[0]} AS DOUBLE) AS y1, CAST({x[1]} AS DOUBLE) AS x2, CAST({y[1]} AS DOUBLE) AS y2 FROM r"""


for _id, _form, _vendor, _by, _box in (("src_03_paddle", "paddle", "paddle", "rank", "px"), ("src_08_15_miner_model", "miner_model", "miner", "pos", "th"), ("src_09_11_16_miner_middle", "miner_middle", "miner", "pos", "px"), ("src_10_miner_content_list", "miner_list", "miner", "pos", "th"), ("src_12_dolphin", "dolphin", "dolphin", "rank", "raw"), ("src_13_glm_model", "glm_model", "glm", "pos", "th")):

    @query(_id, _reader_sql(_form, _vendor, _by, _box))
    def _(s, d, form=_form):
        return readers.blocks(readers.READERS[form](_vendor_json(s, d, form)), form).withColumn("title_level", F.coalesce("title_level", F.lit(-1)))


@query("src_14_glm_words", f"WITH {D.PIXELS}, l AS (SELECT doc_id, page, pos, k, {NORMAL('content')} AS content FROM pixels), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS o FROM l WHERE content <> '') SELECT CAST(doc_id AS VARCHAR) AS doc_id, page, CAST(o AS INTEGER) AS \"order\", content, CAST(0.1 AS DOUBLE) AS x1, k * 10.0 / 100.0 AS y1, CAST(0.9 AS DOUBLE) AS x2, (k * 10.0 + 10.0) / 100.0 AS y2 FROM r")
def _(s, d):
    p = D.pixel_items(s, d)
    word = F.struct(C("content").alias("words"), F.struct(F.lit(100).alias("left"), (C("k") * 10).alias("top"), F.lit(800).alias("width"), F.lit(10).alias("height")).alias("location"))
    pages = p.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))), lambda x: x["w"]).alias("words_result"))
    docs = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", F.struct(F.lit(1000).alias("width"), F.lit(100).alias("height"), "words_result").alias("p")))), lambda x: x["p"]).alias("pages"))
    js = docs.select(C("doc_id").cast("string").alias("doc_id"), F.to_json(F.struct("pages")).alias("json"))
    return readers.blocks(readers.glm_words(js), "glm_words").select("doc_id", "page", "order", "content", *geometry.BOX)


@query("src_07_17_precedence_and_status", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 4 = 3 THEN 'missing' WHEN doc_id % 8 = 2 THEN 'invalid' ELSE 'ok' END AS status FROM documents")
def _(s, d):
    docs = D.table(s, d, "documents").select(C("doc_id"))
    forms = docs.where("doc_id % 4 != 3").select(C("doc_id").cast("string").alias("doc_id"), F.explode(F.when(C("doc_id") % 4 == 0, F.array(F.lit("miner_list"), F.lit("miner_model"))).otherwise(F.array(F.lit("miner_middle")))).alias("form"), F.when(C("doc_id") % 8 == 2, "{broken").otherwise("[]").alias("json"))
    return readers.statuses(docs.select(C("doc_id").cast("string").alias("doc_id")), forms, "miner").select("doc_id", "status")


def _page_files(s, d):
    """Files of pages, odd ones with the page in the payload, and page sizes: none for a fifth of documents, none of page 2 for another."""
    b = D.doc_blocks(s, d).withColumn("doc_id", C("doc_id").cast("string"))
    title = C("type") == "title"
    block = F.struct(F.when(title, "paragraph_title").otherwise("text").alias("block_label"), F.array(*[F.lit(v) for v in (100.0, 80.0, 500.0, 400.0)]).alias("block_bbox"), C("content").alias("block_content"), C("pos").alias("block_order"))
    pages = b.groupBy("doc_id", "page").agg(F.reverse(F.array_sort(F.collect_list(F.struct("pos", block.alias("b"))))).alias("l"))
    body = F.to_json(F.struct(F.when(C("page") % 2 == 1, C("page") - 1).alias("page_index"), F.transform("l", lambda x: x["b"]).alias("parsing_res_list")))
    files = pages.select("doc_id", F.concat("doc_id", F.lit("_"), (C("page") - 1).cast("string"), F.lit("_res")).alias("stem"), body.alias("json"))
    fifth = C("doc_id").cast("long") % 5
    sizes = pages.where((fifth != 0) & ~((fifth == 1) & (C("page") == 2))).select("doc_id", "page", F.lit(500.0).alias("width"), F.lit(400.0).alias("height"))
    return files, sizes


_PAGE_STATUS = "st AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR (doc_id % 5 = 1 AND min(page) = 2 AND max(page) = 2) THEN 'missing' WHEN doc_id % 5 = 1 AND bool_or(page = 2) THEN 'invalid' ELSE 'ok' END AS status FROM doc_blocks GROUP BY 1)"


@query("src_04_06_page_file_status", f"WITH {D.DOC_BLOCKS}, {_PAGE_STATUS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, status, CASE status WHEN 'missing' THEN 'no page sizes of ' || doc_id WHEN 'invalid' THEN 'no size of page 2' ELSE '' END AS message FROM st")
def _(s, d):
    return readers.paddle_page_statuses(*_page_files(s, d))


@query("src_04_06_page_files", f"WITH {D.DOC_BLOCKS}, {_PAGE_STATUS}, l AS (SELECT doc_id, page, pos, type, {NORMAL('content')} AS content FROM doc_blocks SEMI JOIN (SELECT doc_id FROM st WHERE status = 'ok') USING (doc_id)) SELECT CAST(doc_id AS VARCHAR) AS doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS INTEGER) AS \"order\", type, content, CAST(0.1 AS DOUBLE) AS x1, CAST(0.1 AS DOUBLE) AS y1, CAST(0.5 AS DOUBLE) AS x2, CAST(0.5 AS DOUBLE) AS y2 FROM l WHERE content <> ''")
def _(s, d):
    return readers.read_paddle_pages(*_page_files(s, d)).select("doc_id", "page", "order", "type", "content", *geometry.BOX)


@query("src_18_doc_ids", "SELECT DISTINCT doc_id FROM (SELECT CASE WHEN regexp_matches(f, '[^.]\\.[^.]*$') THEN regexp_replace(f, '\\.[^.]*$', '') ELSE f END AS doc_id FROM (SELECT regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS f FROM pages)) WHERE doc_id <> ''")
def _(s, d):
    return readers.doc_ids(D.table(s, d, "pages"), column="url")


@query("src_19_input_labels", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality WHEN d.doc_id % 2 = 0 THEN '/pdf/' || d.doc_id || '.pdf' ELSE CAST(d.doc_id AS VARCHAR) END AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(s, d):
    docs = D.table(s, d, "documents").select("doc_id")
    names = D.table(s, d, "labels").select("doc_id", F.concat(F.lit("q"), C("quality").cast("string")).alias("name"))
    found = docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("/pdf/"), C("doc_id").cast("string"), F.lit(".pdf")).alias("path"))
    return readers.input_labels(docs, names, found).select("doc_id", C("label").cast("string").alias("label"))


@query("snk_01_02_src_20_pages_round_trip", f"WITH {D.DOC_BLOCKS} SELECT doc_id, pos, id, page, type, content, x1, y1, x2, y2 FROM doc_blocks")
def _(s, d):
    b = D.doc_blocks(s, d)
    rows = b.select("doc_id", F.concat_ws(":", C("doc_id").cast("string"), C("pos").cast("string")).alias("block_id"), "page", C("pos").alias("order"), C("type").alias("fine_type"), "content", F.lit(None).cast("int").alias("title_level"), F.lit("x").alias("source_label"), *geometry.BOX)
    js = sinks.serialized(rows, "post-processing", "m")
    return readers.page_blocks(js).select("doc_id", "pos", "id", "page", "type", "content", *geometry.BOX)


@query("snk_02_title_blocks", f"WITH {D.DOC_BLOCKS} SELECT doc_id, doc_id || ':' || pos AS block_id, page, CAST(pos AS INTEGER) AS \"order\", content FROM doc_blocks WHERE type = 'title'")
def _(s, d):
    b = D.doc_blocks(s, d).select("doc_id", F.concat_ws(":", C("doc_id").cast("string"), C("pos").cast("string")).alias("block_id"), "page", C("pos").cast("int").alias("order"), "type", "content", F.lit(None).cast("int").alias("title_level"), *geometry.BOX)
    return sinks.title_blocks(b).select("doc_id", "block_id", "page", "order", "content")


@query("snk_04_07_block_list_json", f"""WITH {D.MIXED} SELECT doc_id, to_json(list({{'id': id, 'page': page, 'type': type, 'content': content, 'level': CAST(level AS INTEGER), 'image': image, 'contd': contd, 'bbox': [x1, y1, x2, y2]}} ORDER BY pos))::VARCHAR AS json FROM mixed GROUP BY doc_id""")
def _(s, d):
    return sinks.block_list_json(D.mixed_blocks(s, d))


@query("win_02_srt_01_renumbering", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_partkey, l_suppkey) - 1 AS INTEGER) AS o FROM lineitem")
def _(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")
    return D.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) - 1).cast("int").alias("o"))


@query("win_06_edge_tables", f"WITH {D.MIXED} SELECT doc_id, page, pos, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS INTEGER) AS first, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) AS INTEGER) AS last FROM mixed WHERE type = 'table'")
def _(s, d):
    w = Window.partitionBy("doc_id", "page")
    return D.mixed_blocks(s, d).where("type = 'table'").select("doc_id", "page", "pos", F.row_number().over(w.orderBy("pos")).alias("first"), F.row_number().over(w.orderBy(F.desc("pos"))).alias("last"))


@query("lim_01_first_items", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def _(s, d):
    return D.table(s, d, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(50)


# --- evaluation ----------------------------------------------------------------------------------

_PAIR = "WITH b AS (SELECT vec_id, label, least(abs(embedding[1]), abs(embedding[2])) AS ax, least(abs(embedding[3]), abs(embedding[4])) AS ay, greatest(abs(embedding[1]), abs(embedding[2])) AS bx, greatest(abs(embedding[3]), abs(embedding[4])) AS by_ FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(a.ax AS DOUBLE) AS x1, CAST(a.ay AS DOUBLE) AS y1, CAST(a.bx AS DOUBLE) AS x2, CAST(a.by_ AS DOUBLE) AS y2, CAST(b.ax AS DOUBLE) AS u1, CAST(b.ay AS DOUBLE) AS v1, CAST(b.bx AS DOUBLE) AS u2, CAST(b.by_ AS DOUBLE) AS v2 FROM b a JOIN b ON b.vec_id = a.vec_id + 1), q AS (SELECT *, greatest(0.0, least(x2, u2) - greatest(x1, u1)) * greatest(0.0, least(y2, v2) - greatest(y1, v1)) AS i, greatest(0.0, x2 - x1) * greatest(0.0, y2 - y1) AS s, greatest(0.0, u2 - u1) * greatest(0.0, v2 - v1) AS t FROM p) SELECT a, b, round(i, 9) AS inter, round(CASE WHEN s + t - i > 0 THEN i / (s + t - i) ELSE 0.0 END, 9) AS iou, round(CASE WHEN least(s, t) > 0 THEN i / least(s, t) ELSE 0.0 END, 9) AS smaller FROM q"


@query("evl_01_box_scores", _PAIR)
def _(s, d):
    e = lambda k: F.abs(F.get("embedding", F.lit(k)).cast("double"))
    b = D.table(s, d, "embeddings").select("vec_id", F.least(e(0), e(1)).alias("x1"), F.least(e(2), e(3)).alias("y1"), F.greatest(e(0), e(1)).alias("x2"), F.greatest(e(2), e(3)).alias("y2"))
    n = b.select(*[C(c).alias(f"n_{c}") for c in b.columns])
    p, q = [C(c) for c in geometry.BOX], [C(f"n_{c}") for c in geometry.BOX]
    return b.join(n, C("n_vec_id") == C("vec_id") + 1).select(C("vec_id").alias("a"), C("n_vec_id").alias("b"), F.round(geometry.intersection(p, q), 9).alias("inter"), F.round(geometry.iou(p, q), 9).alias("iou"), F.round(geometry.overlap_of_smaller(p, q), 9).alias("smaller"))


@query("evl_02_text_similarity")
def _(s, d):
    b = D.doc_titles(s, d).select("doc_id", "pos", text.compact_text(C("content")).alias("a"), text.compact_text(F.lead("content").over(Window.partitionBy("doc_id").orderBy("pos"))).alias("b"))
    return b.select("doc_id", "pos", F.round(text.similarity("a", "b"), 9).alias("similarity"))


def _cases(s, d):
    t = candidates.title_candidates(D.doc_blocks(s, d))
    lab = D.doc_titles(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("<|id|>"), C("pos").cast("string"), F.lit("<|level|>"), C("level").cast("string")).alias("l")))), lambda x: x["l"]), "\n").alias("labels"))
    return prompts.prompts(t, "title").join(lab, "doc_id").select(C("doc_id").cast("string").alias("doc_id"), "prompt", "labels")


@query("str_09_title_truth", f"WITH {D.DOC_BLOCKS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(pos AS VARCHAR) AS gt_id, page, {NORMAL('left(content, 50)')} AS content, CAST(trunc(x1 * 1000) AS DOUBLE) AS x1, CAST(trunc(y1 * 1000) AS DOUBLE) AS y1, CAST(pos % 3 + 1 AS INTEGER) AS level FROM doc_blocks WHERE type = 'title'")
def _(s, d):
    c = _cases(s, d)
    return evaluate.truth_blocks(c).join(evaluate.truth_levels(c).drop("ord"), ["doc_id", "gt_id"]).select("doc_id", "gt_id", "page", "content", "x1", "y1", "level")


def _predicted(s, d):
    """Titles as a reader would give them: boxes in thousandths, every fifth missing, levels off by one now and then."""
    t = D.doc_titles(s, d).where("pos % 5 != 4")
    return t.select(C("doc_id").cast("string").alias("doc_id"), F.concat_ws(":", C("doc_id").cast("string"), C("pos").cast("string")).alias("block_id"), C("pos").cast("int").alias("order"), "page", "type", "content", F.when(C("pos") % 7 != 0, C("level") + (C("pos") % 11 == 0).cast("int")).alias("title_level"), *[(C(c) * 1000).alias(c) for c in geometry.BOX])


@query("join_13_evl_03_match_01_alignment")
def _(s, d):
    return evaluate.matches(evaluate.candidates(evaluate.truth_blocks(_cases(s, d)), _predicted(s, d)))


# Pairs of titles on a page with scores in tenths, so that many are equal; taken one by one in the order of the task.
_GREEDY_SQL = f"""WITH RECURSIVE {D.DOC_BLOCKS}, t AS (SELECT * FROM doc_blocks WHERE type = 'title'), c AS (
  SELECT CAST(a.doc_id AS VARCHAR) AS doc_id, CAST(a.pos AS VARCHAR) AS gt_id, CAST(b.pos AS VARCHAR) AS pred_id, CAST((a.pos * 7 + b.pos * 3) % 10 AS DOUBLE) / 10 AS score
  FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page WHERE (a.pos + b.pos) % 4 <> 1
), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, gt_id DESC, pred_id DESC) AS k FROM c),
walk(doc_id, k, gts, preds, taken) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false FROM k
  UNION ALL SELECT w.doc_id, k.k, CASE WHEN list_contains(gts, gt_id) OR list_contains(preds, pred_id) THEN gts ELSE list_append(gts, gt_id) END,
    CASE WHEN list_contains(gts, gt_id) OR list_contains(preds, pred_id) THEN preds ELSE list_append(preds, pred_id) END, NOT (list_contains(gts, gt_id) OR list_contains(preds, pred_id))
  FROM walk w JOIN k ON k.doc_id = w.doc_id AND k.k = w.k + 1
) SELECT k.doc_id, gt_id, pred_id, score FROM walk w JOIN k ON k.doc_id = w.doc_id AND k.k = w.k WHERE taken"""


@query("match_01_greedy_pairs", _GREEDY_SQL)
def _(s, d):
    t = D.doc_blocks(s, d).where("type = 'title'").select(C("doc_id").cast("string").alias("doc_id"), "page", "pos")
    both = t.withColumnRenamed("pos", "a").join(t.withColumnRenamed("pos", "b"), ["doc_id", "page"])
    score = ((C("a") * 7 + C("b") * 3) % 10).cast("double") / 10
    return evaluate.matches(both.select("doc_id", C("a").cast("string").alias("gt_id"), C("b").cast("string").alias("pred_id"), score.alias("score"), ((C("a") + C("b")) % 4 != 1).alias("close")))


@query("evl_04_06_07_title_scores")
def _(s, d):
    cases, predicted = _cases(s, d), _predicted(s, d)
    truth = evaluate.truth_blocks(cases)
    nodes = evaluate.prediction_nodes(predicted, evaluate.matches(evaluate.candidates(truth, predicted)))
    return evaluate.scores(evaluate.labelled(evaluate.truth_levels(cases), truth, "content_aware"), evaluate.labelled(nodes, truth, "content_aware"))


@query("evl_07_document_details")
def _(s, d):
    cases = _cases(s, d)
    number = C("doc_id").cast("long")
    statuses = cases.where(number % 7 != 0).select("doc_id", F.when(number % 5 == 0, "invalid").otherwise("ok").alias("status"), F.when(number % 5 == 0, "not JSON").otherwise("").alias("message"))
    return evaluate.details(cases, _predicted(s, d), statuses)


@query("evl_05_title_tree", f"WITH RECURSIVE {D.DOC_BLOCKS}, comps AS (SELECT doc_id, pos AS comp, pos % 3 + 1 AS level FROM doc_blocks WHERE type = 'title'), {_NEST} SELECT p.doc_id, p.comp AS pos, coalesce(parent, -1) AS parent, CAST(depth AS INTEGER) AS depth FROM placed p JOIN deep ON deep.doc_id = p.doc_id AND deep.comp = p.comp")
def _(s, d):
    return tree.nested(D.doc_titles(s, d), "pos").select("doc_id", "pos", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth")


@query("agg_04_snk_06_summary", "WITH x AS (SELECT d.doc_id, l.quality IS NOT NULL AS ok, n_chars % 7 / 7.0 AS score, n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) SELECT count(*) AS total_docs, count(*) FILTER (ok) AS usable_docs, count(*) FILTER (NOT ok) AS missing_docs, round(coalesce(avg(score) FILTER (ok), 0.0), 9) AS avg_score_usable, round(avg(CASE WHEN ok THEN score ELSE 0.0 END), 9) AS avg_score_with_missing_zero, round(avg(n_chars) FILTER (ok), 6) AS avg_gt_count FROM x")
def _(s, d):
    x = D.table(s, d, "documents").join(D.table(s, d, "labels"), "doc_id", "left").select("doc_id", F.when(C("quality").isNotNull(), "ok").otherwise("missing").alias("status"), ((C("n_chars") % 7) / 7.0).alias("score"), C("n_chars").alias("gt_count"), C("n_chars").alias("pred_count"), C("n_chars").alias("match_count"))
    got = evaluate.summary(x)
    return got.select("total_docs", "usable_docs", "missing_docs", F.round("avg_score_usable", 9).alias("avg_score_usable"), F.round("avg_score_with_missing_zero", 9).alias("avg_score_with_missing_zero"), F.round("avg_gt_count", 6).alias("avg_gt_count"))
