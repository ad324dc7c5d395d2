"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame functions only.

Every scan partition is a run: its rows, sorted by digest, give one entry a text with the
smallest identifier and the number of rows. Runs are then exchanged in rounds of a binomial
tree: 2 ** FAN_BITS runs whose numbers agree in the upper bits become one. In a round, a task
takes a range of digests of all runs of a group, sorts their entries into one order (digest,
then identifier) and passes over them once with a window: the first of equal entries has the
smallest identifier and stays, with the number of rows of all. The window needs that order, so
the sort stays in the plan that runs. Entries are equal if SHA-256, length and a second,
independent hash agree, which is checked anew in every round. The last round has one run.

The way back down hands each run the root's answers for the entries it brought, round by round,
so an entry meets at most 2 ** FAN_BITS partners and a document looks up its own run: the rows
of a text that fills a third of the table are as many tasks' as they were in the scan. Rounds
shuffle digests only, never texts.

Defined results: null text counts as empty (its normal form is the empty string, unlike that of
blanks, one space); a null id is never the smallest unless all ids of the group are null. In
``decisions`` rows repeated with the same id share one answer; ``deduplicate`` keeps exactly one
row of each text, decided by row: a row whose id also occurs with another text doesn't share its
fate, and of repeated rows (same id and text) one, whichever, stays. Texts are hashed whole
whatever their length. Other columns, whatever their names, are ignored by ``decisions`` and kept
by ``deduplicate``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm import scratch

#: Bits of the run number that a round takes away; bits of the digest that name a range within a run.
FAN_BITS, RANGE_BITS = 4, 12
#: Buckets of digests with a repeated text that are broadcast: so many short rows at most, whatever the input.
MARKS = 1 << 18
SAME = ["digest", "size", "second"]


def normal_text(text: Column) -> Column:
    """Null as empty; each run of 0x20, 0x09-0x0D as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """Struct of digest, size and second of a text's normal form."""
    normal = normal_text(text)
    return F.struct(F.unhex(F.sha2(normal, 256)).alias("digest"), F.octet_length(normal).cast("long").alias("size"), F.xxhash64(normal).alias("second"))


def entries_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, run, digest, size, second) of every row; run is the scan partition."""
    hashed = docs.select(docs[id_column].alias("doc_id"), digest(docs[text_column]).alias("of"), F.spark_partition_id().alias("run"))
    return scratch.written(hashed.select("doc_id", "run", "of.*"), "digests")


def merged(level: DataFrame, bits: int) -> DataFrame:
    """Runs whose numbers agree but for the lower ``bits`` merged into one, sorted by digest within ranges."""
    part = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    moved = level.withColumn("run", F.shiftright("run", bits)).withColumn("range", F.shiftright(part, 16 - RANGE_BITS))
    equal = Window.partitionBy("run", "range", *SAME)
    runs = moved.repartition("run", "range").select(
        "run", *SAME, "doc_id", F.row_number().over(equal.orderBy(F.asc_nulls_last("doc_id"))).alias("place"), F.sum("n").over(equal).alias("n")
    )
    return runs.where("place = 1").drop("place")


def rounds(entries: DataFrame) -> list[DataFrame]:
    """The tables (run, digest, size, second, doc_id, n) of all rounds; the last has one run."""
    last = entries.agg(F.max("run")).first()[0] or 0
    levels = [scratch.written(merged(entries.withColumn("n", F.lit(1).cast("long")), 0), "run-0")]
    while last:
        levels.append(scratch.written(merged(levels[-1], FAN_BITS), f"run-{len(levels)}"))
        last >>= FAN_BITS
    return levels


def decisions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    entries = entries_of(docs, id_column, text_column)
    levels = rounds(entries)
    answer = levels[-1].where("n > 1").select("run", *SAME, F.col("doc_id").alias("keep_id"), F.col("n").alias("size_of_group"))
    for level in levels[-2::-1]:
        asked = level.select(F.col("run").alias("own"), F.shiftright("run", FAN_BITS).alias("run"), *SAME)
        answer = asked.join(answer, ["run", *SAME]).drop("run").withColumnRenamed("own", "run")
    found = entries.join(answer, ["run", *SAME], "left")
    return found.select(
        "doc_id",
        F.when(F.col("size_of_group").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size_of_group", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size_of_group").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts: one with the smallest id.

    A row whose digest falls into no bucket of a repeated text is alone and bypasses the joins.
    The others meet the keeper of their text by digest and id, so a frequent text is no hot key.
    """
    root = rounds(entries_of(docs, id_column, text_column))[-1]
    mark = F.pmod(F.col("second"), F.lit(MARKS)).cast("int").alias("mark")
    marks = scratch.written(root.where("n > 1").select(mark).distinct(), "marks")
    rows = docs.select(F.struct(docs[id_column].alias("doc_id"), digest(docs[text_column]).alias("of")).alias("key"), F.struct(*docs.columns).alias("row"))
    rows = rows.select(F.col("key.doc_id").alias("doc_id"), "key.of.*", "row").withColumn("mark", mark)
    alone = rows.join(F.broadcast(marks), "mark", "left_anti").select("row.*")
    keepers = root.join(F.broadcast(marks), mark == marks["mark"], "left_semi").select(*(F.col(c).alias(f"k_{c}") for c in [*SAME, "doc_id"]))
    some = rows.join(F.broadcast(marks), "mark", "left_semi")
    first = some.join(keepers, [*(F.col(c) == F.col(f"k_{c}") for c in SAME), F.col("doc_id").eqNullSafe(F.col("k_doc_id"))])
    return alone.unionByName(first.dropDuplicates([*SAME, "doc_id"]).select("row.*"))
