"""Vendor labels to canonical and fine types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label tables, vendor label -> (canonical type, fine type).
CANONICAL = ("title", "text", "image", "table", "caption")
SKIP = "__skip__"
FURNITURE = {
    "page_title": "page_title", "page_number": "page_number", "number": "page_number", "page_footnote": "page_footnote", "footnote": "page_footnote",
    "header": "header", "aside_text": "aside_text", "footer": "footer",
}
FINE_TYPES = (
    "title", "text", "image", "table", "image_caption", "table_caption", "image_footnote", "table_footnote", "equation", "list_item",
    "page_title", "page_number", "page_footnote", "header", "aside_text", "footer",
)
_SUPPLEMENT = {k: ("text", v) for k, v in FURNITURE.items()}
_CAPTIONS = {k: ("caption", k) for k in ("image_caption", "table_caption", "image_footnote", "table_footnote")}
TABLES: dict[str, dict[str, tuple[str, str]]] = {
    "paddle": {
        "paragraph_title": ("title", "title"), "doc_title": ("title", "title"), **_SUPPLEMENT,
        **{k: ("image", "image") for k in ("image", "chart", "footer_image", "header_image", "seal")},
        "table": ("table", "table"), "figure_title": ("caption", "image_caption"), "vision_footnote": ("caption", "image_footnote"),
        "inline_formula": ("text", "equation"), "display_formula": ("text", "equation"),
    },
    "miner": {
        "title": ("title", "title"), **_SUPPLEMENT, "image": ("image", "image"), "table": ("table", "table"), **_CAPTIONS,
        **{k: ("text", "equation") for k in ("equation", "interline_equation", "inline_equation")},
        "list": ("text", "list_item"), **{k: (SKIP, SKIP) for k in ("discarded", "image_body", "table_body")},
    },
    "dolphin": {
        "catalogue": ("title", "title"), "header": ("text", "header"), "foot": ("text", "footer"), "fnote": ("text", "page_footnote"), "fig": ("image", "image"),
        "tab": ("table", "table"), "cap": ("caption", "image_caption"), "list": ("text", "list_item"), "equ": ("text", "equation"),
    },
    "glm": {
        "doc_title": ("title", "title"), "paragraph_title": ("title", "title"), **{k: ("image", "image") for k in ("image", "chart", "seal")},
        "table": ("table", "table"), "figure_title": ("caption", "image_caption"), "vision_footnote": ("caption", "image_footnote"),
        **{k: ("text", "equation") for k in ("display_formula", "inline_formula", "formula")},
    },
}
TABLES["monkey"] = TABLES["miner"]


def lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    """Value of a small constant table, folded into the plan."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], default)


def canonical(vendor: str, label: Column) -> Column:
    found = lookup({k: v[0] for k, v in TABLES[vendor].items()}, label, F.lit("text"))
    return F.when(label.rlike("^sec_[1-9][0-9]*$"), F.lit("title")).otherwise(found) if vendor == "dolphin" else found


def fine(vendor: str, label: Column) -> Column:
    found = lookup({k: v[1] for k, v in TABLES[vendor].items()}, label, F.lit("text"))
    return F.when(label.rlike("^sec_[1-9][0-9]*$"), F.lit("title")).otherwise(found) if vendor == "dolphin" else found


def title_level(vendor: str, label: Column) -> Column:
    """Level that a dolphin label carries; null elsewhere."""
    if vendor != "dolphin":
        return F.lit(None).cast("int")
    return F.when(label == "catalogue", F.lit(1)).when(label.rlike("^sec_[1-9][0-9]*$"), F.regexp_extract(label, "^sec_([0-9]+)$", 1).try_cast("int"))


def retyped(kind: Column, source_label: Column) -> Column:
    """Page furniture among texts gets its own type by the source label."""
    return F.when(kind == "text", lookup(FURNITURE, source_label, kind)).otherwise(kind)
