"""Staged runs: what a second call does, what one failing document does, and responders with slow clients."""

import json
import threading
import time
from pathlib import Path

from pyspark.sql import functions as F

from pagewright.operators import responders, staged
from pagewright.sources import readers, sinks

TABLE = "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>"


def paddle(doc, pages):
    """A vendor file of pages of (label, content)."""
    items = lambda page: [{"block_label": k, "block_content": c, "block_bbox": [100, 10 * n, 900, 10 * n + 8], "block_order": n} for n, (k, c) in enumerate(page)]
    return doc, "paddle", json.dumps({"result": {"layoutParsingResults": [{"prunedResult": {"width": 1000, "height": 100, "parsing_res_list": items(p)}} for p in pages]}})


def files(spark, *names):
    pages = lambda name: [[("paragraph_title", f"{name} one"), ("text", "some text"), ("image", "")], [("paragraph_title", f"{name} two"), ("text", "more"), ("table", TABLE)], [("table", TABLE), ("text", "end.")]]
    rows = [paddle(n, pages(n)) for n in names]
    return spark.createDataFrame(rows, "doc_id string, form string, json string")


def client(bad: str = "", flags: str = "[0]"):
    def make():
        def call(prompt):
            if bad and bad in prompt:
                raise RuntimeError("down")
            if "Title Level" in prompt:
                return "\n".join(f"<|id|>{line.split('<|page|>')[0]}<|level|>{k + 1}" for k, line in enumerate(prompt.split("<|id|>")[1:]))
            return "" if prompt.startswith("<image>") else flags

        return call

    return make


def states(run):
    return {r.doc_id: (r.stage, r.status) for r in run.report().collect()}


def test_a_failing_document_holds_up_no_other_and_is_tried_again(spark, tmp_path):
    source = files(spark, "a", "b", "c").unionByName(spark.createDataFrame([("broken", "paddle", "{")], "doc_id string, form string, json string"))
    wanted = source.select("doc_id").unionByName(spark.createDataFrame([("gone",)], "doc_id string"))
    first = staged.Run(spark, str(tmp_path), "paddle", client("b one"), tries=2)
    first.go(wanted, source)
    assert states(first) == {"a": ("trees", "ok"), "b": ("answers", "failed"), "c": ("trees", "ok"), "broken": ("blocks", "invalid"), "gone": ("blocks", "missing")}
    message = {r.doc_id: r.message for r in first.report().collect()}
    assert message["b"] == "image 0 RuntimeError: down" and message["gone"] == "no source of gone" and message["a"] == ""
    before = {(r.doc_id, r.stage, r.attempt) for r in first.ledger().where("status = 'ok'").collect()}
    trees = {(r.doc_id, r.preorder, r.type, r.title, r.depth) for r in first.table("trees").collect()}
    assert {d for d, *_ in trees} == {"a", "c"} and ("a", 1, "text", "a one", 1) in trees and ("a", 2, "text", "a two", 2) in trees
    merged = first.table("trees").where("type = 'table' and doc_id = 'a'").collect()
    assert [(r.block_ids, [p.page for p in r.location]) for r in merged] == [([6, 7], [2, 3])]

    # The same folder again: only what isn't done runs; a new document joins in.
    again = staged.Run(spark, str(tmp_path), "paddle", client())
    more = files(spark, "a", "b", "c", "d")
    again.go(more.select("doc_id"), more)
    assert states(again) | {"broken": 0, "gone": 0} == {"a": ("trees", "ok"), "b": ("trees", "ok"), "c": ("trees", "ok"), "d": ("trees", "ok"), "broken": 0, "gone": 0}
    after = {(r.doc_id, r.stage, r.attempt) for r in again.ledger().where("status = 'ok'").collect()}
    assert before < after and len(after) == 4 * len(staged.STAGES)  # each document did each stage once
    assert {r.doc_id for r in again.table("trees").collect()} == {"a", "b", "c", "d"}
    assert again.table("answers").where("doc_id = 'b'").where("error is not null").count() == 0
    counts = again.counts().first()
    assert (counts.selected, counts.written, counts.invalid, counts.skipped) == (6, 4, 1, 2)


def test_rows_of_an_attempt_without_ledger_are_not_read(spark, tmp_path):
    source = files(spark, "a")
    run = staged.Run(spark, str(tmp_path), "paddle", client(flags="none"))
    run.go(source.select("doc_id"), source, until="blocks")
    assert states(run) == {"a": ("blocks", "ok")}
    lost = run.spark.read.parquet(f"{tmp_path}/blocks").withColumn("attempt", F.lit("lost")).collect()
    spark.createDataFrame(lost, spark.read.parquet(f"{tmp_path}/blocks").schema).write.mode("append").parquet(f"{tmp_path}/blocks")
    assert run.table("blocks").count() == 8
    run.go(source.select("doc_id"), source)
    assert states(run) == {"a": ("trees", "ok")} and run.table("annotated").count() == 8
    # Without flags the tables stay apart.
    assert run.table("trees").where("type = 'table'").count() == 2
    assert run.go(source.select("doc_id").limit(0), source.limit(0)).count() == 1


def test_calls_are_made_together_and_answers_keep_their_order(spark):
    def slow():
        lock, open_, most = threading.Lock(), [0], [0]

        def call(prompt):
            with lock:
                open_[0] += 1
                most[0] = max(most[0], open_[0])
            time.sleep(0.1)
            with lock:
                open_[0] -= 1
            return f"{prompt} {most[0]}"

        return call

    asked = spark.range(32).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")).coalesce(1)
    got = responders.answered(asked, slow, in_flight=6).collect()
    assert [(r.id, r.response.split()[0]) for r in got] == [(k, f"p{k}") for k in range(32)]
    assert max(int(r.response.split()[1]) for r in got) == 6


def test_a_call_that_hangs_counts_as_failed(spark):
    def hanging():
        def call(prompt):
            if prompt == "p1":
                time.sleep(3)
            return "ok"

        return call

    asked = spark.range(3).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")).coalesce(1)
    got = {r.id: (r.response, r.tries, r.error) for r in responders.answered(asked, hanging, tries=2, pause=0.01, seconds=0.3).collect()}
    assert got == {0: ("ok", 1, None), 1: ("", 2, "TimeoutError: no answer in 0.3 s"), 2: ("ok", 1, None)}


def test_a_run_of_no_documents(spark, tmp_path):
    none = files(spark, "a").limit(0)
    assert staged.Run(spark, str(tmp_path), "paddle", client()).go(none.select("doc_id"), none, "blocks").count() == 0


def test_slices_give_the_same_rows_and_leave_no_shuffles(spark, tmp_path, monkeypatch):
    source = files(spark, *"abcdefgh")
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {str(f) for d in dirs for f in Path(d).rglob("shuffle_*")}
    monkeypatch.setattr(staged, "SLICE_DOCS", 1, raising=False)
    got = []
    for slices in (1, 3):
        monkeypatch.setattr(staged, "SLICES", slices, raising=False)
        run = staged.Run(spark, str(tmp_path / str(slices)), "paddle", client())
        before, setting = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
        run.go(source.select("doc_id"), source)
        assert not shuffled() - before
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
        assert states(run) == dict.fromkeys("abcdefgh", ("trees", "ok"))
        assert run.ledger().where("stage = 'trees'").select("attempt").distinct().count() == slices
        got.append({stage: sorted(map(repr, run.table(stage).collect())) for stage in staged.STAGES})
    assert got[0] == got[1]


def test_vendor_files_of_a_folder_and_written_documents(spark, tmp_path):
    """Whole files by stem, through a reader, to one JSON text a document that can be read again."""
    for doc, _, body in (paddle("x.1", [[("text", "one"), ("paragraph_title", "T")]]), paddle("y", [[("text", "two")]])):
        (tmp_path / f"{doc}.json").write_text(body, encoding="utf-8")
    found = readers.json_files(spark, str(tmp_path))
    assert {r.doc_id for r in found.collect()} == {"x.1", "y"}
    blocks = readers.read(found.withColumn("form", F.lit("paddle")), "paddle")
    sinks.write_documents(sinks.serialized(blocks, "normalized", "m"), str(tmp_path / "out"))
    got = {r.doc_id: [b["content"] for b in json.loads(r.json)["blocks"]] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {"x.1": ["one", "T"], "y": ["two"]}
