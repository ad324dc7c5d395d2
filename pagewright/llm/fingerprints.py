"""Document fingerprints: sketches of all shingle hashes below a fixed fraction, in DataFrame functions only.

A text's shingles are its runs of ``width`` words (runs of anything but 0x20 and 0x09-0x0D, A-Z
lower-cased); a text with fewer words is one shingle, one without words has none. A shingle's hash
is the first 16 hex digits of its MD5, and a sketch is the sorted set of all hashes below
``fraction`` of their range, so its size follows the text's. A text none of whose hashes is that
low keeps its lowest one. Both rules hold for unions as well: ``merged`` sketches are the sketch of
the merged texts, and short texts meet long ones without either being resized. ``containment`` is
the share of one sketch found in the other, ``likeness`` that of their union.

``edited_and_next`` needs each document's successor by id. Ids are cut into ranges of some
``ROWS`` rows (by quantiles, and evenly between two quantiles); the first rows of a range are sent
to the range before it as well, and a window in each range hands every row the next one. So a text
is shuffled once, no task has all rows, and the only table that is broadcast has a row a range
(``QUANTILES * SPLITS`` at most).

Defined results: null text counts as empty; texts without words are alike to each other (1.0) and
to nothing else (0.0); null ids come last, ordered by a hash of their texts; rows repeated with an
id are neighbours, ordered by the same hash, and stay in one range; a single document is its own
successor. Texts are used whole whatever their length; an empty table gives no rows; extra columns
aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH, FRACTION = 5, 1 / 8
#: Rows a range of ids has; quantiles of the ids; ranges between two quantiles at most.
ROWS, QUANTILES, SPLITS = 4096, 128, 2048
_UPPER, _BLANK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\t\n\x0b\x0c\r"


def limit(fraction: float) -> str:
    """The lowest hash that isn't kept."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    return f"{int(fraction * 2**64):016x}"


def with_sketch(df: DataFrame, text: str, name: str, width: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """``df`` with the sketch of column ``text`` as array<string> ``name``."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER + _BLANK, _UPPER.lower() + " " * len(_BLANK))
    words, hashes, low = f"{name}_words", f"{name}_hashes", f"{name}_low"
    # Each step is a column of its own, so that none is computed anew for each shingle.
    df = df.withColumn(words, F.filter(F.split(plain, " "), lambda w: w != ""))
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))
    shingle = F.transform(places, lambda i: F.md5(F.array_join(F.slice(F.col(words), i, F.lit(width)), " ")))
    df = df.withColumn(hashes, F.when(F.size(words) > 0, shingle).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(low, F.filter(hashes, lambda h: h < limit(fraction)))
    kept = F.when((F.size(low) > 0) | (F.size(hashes) == 0), F.col(low)).otherwise(F.array(F.array_min(hashes)))
    return df.withColumn(name, F.sort_array(F.array_distinct(F.transform(kept, lambda h: F.left(h, F.lit(16)))))).drop(words, hashes, low)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of both sketches' shingles together."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda h: h < limit(fraction))
    return F.when((F.size(low) > 0) | (F.size(both) == 0), F.sort_array(low)).otherwise(F.array(F.array_min(both)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 if neither has any, 0 if one has none."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated shared part of both texts' shingles; 1 if neither has any, 0 if one has none."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def _ranged(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, ...) with at (their order among equals of ``part``), part and sub (their range)."""
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.percentile_approx("doc_id", [k / QUANTILES for k in range(1, QUANTILES)], 10_000).alias("cuts")).first()
    cuts = sorted(set(known["cuts"] or []))
    splits = min(SPLITS, max(1, math.ceil(known["n"] / ROWS / QUANTILES)))
    if known["ids"] == known["n"]:
        at = F.col("doc_id")
    else:
        at = F.coalesce("doc_id", F.xxhash64("text"))
    rows = rows.withColumn("at", at)
    lo, hi = known["lo"] or 0, known["hi"] or 0
    edges = F.array(*(F.lit(float(x)) for x in [lo, *cuts, hi]))
    part = F.size(F.filter(F.array(*(F.lit(x) for x in cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(part))
    spot = (F.col("at").cast("double") - F.get(edges, F.col("part"))) / (F.get(edges, F.col("part") + 1) - F.get(edges, F.col("part")) + 1.0)
    null_spot = (F.col("at").cast("double") + 2.0**63) / 2.0**64
    sub = F.when(F.col("doc_id").isNull(), F.floor(null_spot * (splits * QUANTILES))).otherwise(F.floor(spot * splits))
    return rows.withColumn("sub", F.greatest(F.lit(0), F.least(sub, F.lit(splits * QUANTILES))).cast("int"))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (doc_id, text, ...) with next_<column> of the row with the next larger id; the first follows the last."""
    rows = _ranged(rows)
    ranges = rows.groupBy("part", "sub").agg(F.min("at").alias("first"))
    order = Window.orderBy("part", "sub")
    here = F.struct("part", "sub")
    final = F.last(here).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = ranges.withColumn("before", F.coalesce(F.lag(here).over(order), final))
    own = F.struct("part", "sub", F.lit(False).alias("guest"))
    guest = F.struct(F.col("before.part").alias("part"), F.col("before.sub").alias("sub"), F.lit(True).alias("guest"))
    sent = rows.join(F.broadcast(ranges), ["part", "sub"])
    sent = sent.withColumn("to", F.explode(F.when(F.col("at") == F.col("first"), F.array(own, guest)).otherwise(F.array(own)))).drop("part", "sub", "first", "before")
    sent = sent.select("*", "to.*").drop("to").withColumn("tie", F.xxhash64("text"))
    w = Window.partitionBy("part", "sub").orderBy("guest", "at", "tie")
    got = sent.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return got.where("not guest").drop("part", "sub", "guest", "at", "tie")


def edited_and_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, held_edited, held_next."""
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    rows = with_next(with_sketch(rows, "text", "sketch", width, fraction), ["text", "sketch"])
    rows = rows.withColumn("n_chars", F.char_length("text")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars") - F.col("cut")), F.left("next_text", F.col("cut")))).drop("text", "next_text", "cut")
    rows = with_sketch(rows, "edited", "edited_sketch", width, fraction)
    sketch, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"),
        F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        likeness(sketch, edited).alias("near_edited"),
        likeness(sketch, following).alias("near_next"),
        containment(sketch, edited).alias("held_edited"),
        containment(sketch, following).alias("held_next"),
    )
