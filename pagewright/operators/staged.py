"""Staged runs over documents: vendor JSON, blocks, answers, annotated blocks, merged tables, trees.

Each stage takes all documents that are ready for it, a slice of them after another, and is written to a table of
its own in the run's folder; a ledger gets a row for each document and stage: ok, or why not. A document
that can't be read, whose boxes break the rules, or for which a call failed stops at that stage and
holds up no other. Called again with the same folder, a run goes on: documents that a stage has done
are left out by an anti join with the ledger, those that failed are tried again, and new ones join in.

Rows of a stage carry the attempt that wrote them, and only rows of documents that the ledger calls ok
for that attempt are read. So an attempt that ended before its ledger rows were written leaves nothing
behind but unread rows, and answers are asked for once: later stages read them from their table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry, labels
from pagewright.operators import candidates, chunking, prompts, reconcile, responders, tables, tree
from pagewright.plans import durable
from pagewright.sources import readers
from pagewright.streaming import resume

STAGES = ("blocks", "answers", "annotated", "tables", "trees")
LEDGER = "doc_id string, stage string, status string, message string, rows long, attempt string, at timestamp"
#: Slices of a stage's documents at most, and documents of a slice that are worth one: only one slice's shuffles lie on disk at a time.
SLICES, SLICE_DOCS = 4, 16_384
#: Attempts that are named to the reader of a stage's files, which then passes over those of others.
NAMED = 1_000


@dataclass
class Run:
    """A run in a folder: ``vendor`` of the files, the ``client`` that answers prompts, and whether boxes must lie on the page."""

    spark: SparkSession
    folder: str
    vendor: str
    client: Callable[[], Callable[[str], str]]
    strict: bool = True
    tries: int = responders.TRIES

    def __post_init__(self) -> None:
        self._append("ledger", self.spark.createDataFrame([], LEDGER))

    def ledger(self) -> DataFrame:
        """All rows that were written, of all attempts."""
        return self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger")

    def table(self, stage: str) -> DataFrame:
        """The rows of a stage, of documents it has done."""
        return self._rows(stage, self._done(stage))

    def report(self) -> DataFrame:
        """doc_id, stage, status, message: how far each document has come; what stopped it, if it isn't ok."""
        place = F.array_position(F.array(*(F.lit(s) for s in STAGES)), F.col("stage"))
        last = Window.partitionBy("doc_id").orderBy(place.desc(), F.desc("at"))
        return self.ledger().withColumn("n", F.row_number().over(last)).where("n = 1").select("doc_id", "stage", "status", "message")

    def counts(self) -> DataFrame:
        """selected, written, skipped and invalid documents of the run so far."""
        got = self.report()
        return resume.run_counts(got, got.where("stage = 'trees' and status = 'ok'"), got.where("status = 'invalid'"))

    def go(self, wanted: DataFrame, files: DataFrame, until: str = STAGES[-1]) -> DataFrame:
        """All stages up to ``until`` for ``wanted`` (doc_id) from ``files`` (doc_id, form, json); gives the report."""
        steps = {"answers": self._answers, "annotated": self._annotated, "tables": self._tables, "trees": self._trees}
        with durable.shuffles_dropped(self.spark):
            self._sliced(self._left(wanted.select("doc_id").distinct(), "blocks"), lambda todo: self._blocks(todo, files))
            for before, stage in zip(STAGES, STAGES[1 : STAGES.index(until) + 1], strict=False):
                self._sliced(self._left(self._done(before), stage), lambda todo, step=steps[stage], before=before: step(todo, before))
        return self.report()

    def _sliced(self, todo: DataFrame, step: Callable[[DataFrame], None]) -> None:
        """``step`` for all documents of ``todo``, one slice after another."""
        slices = max(1, min(SLICES, todo.count() // SLICE_DOCS))
        for k in range(slices):
            step(todo if slices == 1 else todo.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == k))

    def _done(self, stage: str) -> DataFrame:
        """Documents that a stage has done, each with the attempt that did."""
        return self.ledger().where((F.col("stage") == stage) & (F.col("status") == "ok")).select("doc_id", "attempt")

    def _left(self, docs: DataFrame, stage: str) -> DataFrame:
        """Which of ``docs`` a stage has still to do, as a table of ids."""
        return self._kept(resume.remaining(docs, self._done(stage)), f"todo-{stage}")

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows of one attempt only, written and read again."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _rows(self, stage: str, docs: DataFrame) -> DataFrame:
        """Rows of a stage for ``docs`` (doc_id, attempt)."""
        rows = self.spark.read.parquet(f"{self.folder}/{stage}")
        named = [r.attempt for r in docs.select("attempt").distinct().limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            rows = rows.where(F.col("attempt").isin(named))
        return rows.join(docs, ["doc_id", "attempt"], "left_semi").drop("attempt")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/{name}")

    def _write(self, stage: str, todo: DataFrame, rows: DataFrame, failures: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Write the rows of a stage, then its ledger: ``failures`` (doc_id, status, message) of the written rows aren't ok."""
        attempt = uuid.uuid4().hex
        self._append(stage, rows.withColumn("attempt", F.lit(attempt)))
        written = self.spark.read.parquet(f"{self.folder}/{stage}").where(F.col("attempt") == attempt)
        entries = todo.select("doc_id").join(written.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "doc_id", "left")
        if failures is None:
            entries = entries.withColumns({"status": F.lit("ok"), "message": F.lit("")})
        else:
            entries = entries.join(failures(written), "doc_id", "left").withColumns({"status": F.coalesce("status", F.lit("ok")), "message": F.coalesce("message", F.lit(""))})
        self._append("ledger", entries.select("doc_id", F.lit(stage).alias("stage"), "status", "message", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at")))

    def _blocks(self, todo: DataFrame, files: DataFrame) -> None:
        files = files.join(todo, "doc_id", "left_semi")
        status = self._kept(readers.statuses(todo, files, self.vendor), "status")
        rows = readers.read(files.join(status.where("status = 'ok'"), "doc_id", "left_semi"), self.vendor)
        rows = rows.select("doc_id", F.col("order").cast("long").alias("pos"), (F.col("order") + 1).cast("long").alias("id"), "page", F.col("fine_type").alias("type"), "content", "source_label", *geometry.BOX)

        def failures(written: DataFrame) -> DataFrame:
            wrong = candidates.bbox_violations(written, self.strict)
            first = wrong.groupBy("doc_id").agg(F.min(F.struct("pos", "violation")).alias("v"))
            boxes = first.select("doc_id", F.lit("invalid").alias("status"), F.concat(F.lit("box "), F.col("v.violation"), F.lit(" at "), F.col("v.pos").cast("string")).alias("message"))
            return status.where("status != 'ok'").unionByName(boxes)

        self._write("blocks", todo, rows, failures)

    def _answers(self, todo: DataFrame, before: str) -> None:
        b = self._rows(before, todo)
        # The three tasks are chunked at once: a task's part of a document counts as a document.
        lines = None
        tasks = (("contd", candidates.continuation_candidates(b)), ("title", candidates.title_candidates(b)), ("image", candidates.visual_candidates(b)))
        for task, rows in tasks:
            got = rows.select(F.concat(F.lit(f"{task}:"), "doc_id").alias("doc_id"), "page", F.struct("ord", prompts.line(task == "image").alias("line")).alias("l"))
            lines = got if lines is None else lines.unionByName(got)
        lines = self._kept(lines, "lines")
        members = chunking.members(lines, chunking.ranges(lines.select("doc_id", "page")))
        grouped = members.groupBy("doc_id", "chunk", (F.col("start") + F.col("stop")).alias("range_sum")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("body"))
        task = F.split_part("doc_id", F.lit(":"), F.lit(1))
        none = F.lit(None).cast("long")
        asked = grouped.select(F.expr("substr(doc_id, instr(doc_id, ':') + 1)").alias("doc_id"), task.alias("task"), "chunk", "range_sum", none.alias("table1"), none.alias("table2"), F.concat(labels.lookup(prompts.HEADS, task, F.lit("")), "body").alias("prompt"))
        pairs = tables.screened(b, candidates.table_pairs(b)).where("reason is null")
        number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("table1")) - 1).alias("chunk")
        merge = pairs.select("doc_id", F.lit("table_merge").alias("task"), number, F.lit(None).cast("int").alias("range_sum"), "table1", "table2", prompts.table_prompt(F.col("upper_rows"), F.col("lower_rows")).alias("prompt"))
        answered = responders.answered(asked.unionByName(merge), self.client, tries=self.tries)

        def failures(written: DataFrame) -> DataFrame:
            why = F.min(F.when(F.col("error").isNotNull(), F.struct("task", "chunk", "error"))).alias("w")
            failed = written.groupBy("doc_id").agg(why).where("w is not null")
            return failed.select("doc_id", F.lit("failed").alias("status"), F.concat_ws(" ", "w.task", F.col("w.chunk").cast("string"), "w.error").alias("message"))

        self._write("answers", todo, answered, failures)

    def _annotated(self, todo: DataFrame, before: str) -> None:
        answers = self._rows(before, todo)
        b = self._rows("blocks", self._done("blocks").join(todo.select("doc_id"), "doc_id", "left_semi"))
        of = lambda task: answers.where(F.col("task") == task).select("doc_id", "chunk", "range_sum", "table1", "table2", "response")
        links = lambda task: reconcile.distinct_links(prompts.link_answers(of(task)))
        levels = reconcile.synchronized_levels(prompts.level_answers(of("title")))
        got = reconcile.written_back(b, links("contd"), levels, links("image"), candidates.containment_links(b))
        # A table of two pairs keeps the later one's partner and flags.
        merges = of("table_merge").withColumn("cell_list", tables.cell_flags("response")).where("size(cell_list) > 0")
        both = F.array(F.struct(F.col("table1").alias("pos"), F.col("table2").alias("to")), F.struct(F.col("table2").alias("pos"), F.col("table1").alias("to")))
        ends = merges.select("doc_id", "chunk", "cell_list", F.explode(both).alias("e")).groupBy("doc_id", F.col("e.pos").alias("pos"))
        ends = ends.agg(F.max_by(F.struct((F.col("e.to") + 1).alias("table_merge"), "cell_list"), "chunk").alias("m")).select("doc_id", "pos", "m.*")
        got = got.join(ends, ["doc_id", "pos"], "left").withColumn("table_merge", F.coalesce("table_merge", F.lit(-1)).cast("long"))
        self._write("annotated", todo, got)

    def _tables(self, todo: DataFrame, before: str) -> None:
        b = self._rows(before, todo)
        self._write("tables", todo, tables.merge_tables(b, tables.chains(b.where("type = 'table'"))))

    def _trees(self, todo: DataFrame, before: str) -> None:
        b = self._rows(before, todo)
        self._write("trees", todo, tree.whole(b.withColumn("type", labels.retyped(F.col("type"), F.col("source_label")))))
