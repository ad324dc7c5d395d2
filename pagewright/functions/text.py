"""Text expressions over block contents; all JVM-side but for normal forms and similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes, by code point.
WHITE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
TERMINATORS = ".。?!？！¿¡؟ฯ۔:：;；"
SENTENCE_ENDS = TERMINATORS + "…"
CLOSERS = "’”'\"）」】])"
CHINESE_NUMERALS = "一二三四五六七八九十百千万"
DIGIT_LIKE = r"\p{Nd}\u00B2\u00B3\u00B9\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468\u2474-\u247C\u2488-\u2490\u24EA\u24F5-\u24FD\u24FF\u2776-\u277E\u2780-\u2788\u278A-\u2792"
LIST_ITEM = (
    r"(?i)^(?:\p{Nd}+[.)）．、]|[a-z][.)]|[" + CHINESE_NUMERALS + r"]+、|[①-⑳㉑-㉟]|[•▪▫]|[ivxlcdm]+\.|-|\$|\\t|[\[(「【（]|第[" + CHINESE_NUMERALS + "][条节章])"
)


def stripped(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def normalize_text(c: Column) -> Column:
    """Null as empty, runs of white space as one space, ends stripped."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"[{WHITE}]+", " "))


def compact_text(c: Column) -> Column:
    """Only ASCII letters and digits and CJK ideographs of the normalized text, in lower case."""
    return F.lower(F.regexp_replace(normalize_text(c), r"[^0-9A-Za-z一-鿿]", ""))


def head_sentence(c: Column) -> Column:
    """The text through its first sentence end."""
    ends = f"(?s)^(.*?[{SENTENCE_ENDS}])"
    head = F.regexp_extract(c, ends, 1)
    return stripped(F.when(head != "", head).otherwise(c))


def tail_sentence(c: Column) -> Column:
    """The last piece between sentence ends that isn't blank."""
    parts = F.filter(F.transform(F.split(c, f"[{SENTENCE_ENDS}]"), stripped), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(stripped(c))


def shortened(c: Column) -> Column:
    """Head and tail sentence; over 103 characters the outer 50 of each end."""
    head, tail = head_sentence(c), tail_sentence(c)
    both = F.when(head == tail, head).otherwise(F.concat(head, F.lit(" ... "), tail))
    return F.when(F.length(both) <= 103, both).otherwise(F.concat(F.left(both, F.lit(50)), F.lit("..."), F.right(both, F.lit(50))))


def is_list_item(c: Column) -> Column:
    return c.rlike(LIST_ITEM)


def starts_with_digit(c: Column) -> Column:
    return c.rlike(f"^[{DIGIT_LIKE}]")


def may_continue(c: Column) -> Column:
    """Can the text be cut off at its end? (the left side of a continuation)"""
    t = stripped(c)
    ends = F.right(t, F.lit(1)).isin(list(TERMINATORS))
    closed = (F.length(t) > 1) & F.right(t, F.lit(1)).isin(list(CLOSERS)) & F.substring(t, -2, 1).isin(list(TERMINATORS))
    return F.coalesce((F.length(c) >= 10) & ~ends & ~closed & ~c.contains("\t"), F.lit(False))


def may_be_continued_by(c: Column) -> Column:
    """Can the text be the rest of an earlier one? (the right side)"""
    return F.coalesce((F.length(c) > 0) & ~is_list_item(c) & ~c.contains("\t"), F.lit(False))


def ends_with_hyphen(c: Column) -> Column:
    return c.rlike(f"[A-Za-z]+-[{WHITE}]*$")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9A-Za-z_.-]+", "_")


def stem(c: Column) -> Column:
    """File name without directory and last extension."""
    name = F.regexp_extract(F.regexp_replace(c, r"/+$", ""), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def page_number_of(stem_column: Column) -> Column:
    """Number at the end of a page file's stem; 10**9 if there is none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(stem_column, r"_([0-9]+)(?:_res)?$", 1), F.lit("")), F.lit("9999999999")).cast("long"), F.lit(10**9).cast("long"))


@F.arrow_udf(T.StringType())
def full_to_half(texts: pa.Array) -> pa.Array:
    """NFKC normal form."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def similarity_of(a: str, b: str) -> float:
    """Matching-block ratio of two compact texts; containment gives 0.9 at least, two empty texts 1."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    ratio = SequenceMatcher(None, a, b).ratio()
    return max(ratio, 0.9) if a in b or b in a else ratio


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similarity_of(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)])
