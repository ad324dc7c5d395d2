"""Answers to prompts by a pluggable responder; all around it is deterministic."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a prompt that are sent, and tries for an answer.
PROMPT_LIMIT, TRIES = 100_000, 5


def replayed(prompts: DataFrame, record: DataFrame) -> DataFrame:
    """Answers from a record (doc_id, task, chunk, response); no answer is an empty one."""
    return prompts.join(record.select("doc_id", "task", "chunk", "response"), ["doc_id", "task", "chunk"], "left").withColumn("response", F.coalesce("response", F.lit("")))


def _within(call: Callable[[str], str], prompt: str, seconds: float | None) -> str:
    """The answer, or an error after ``seconds``; a call that hangs is left behind in a thread of its own."""
    if seconds is None:
        return call(prompt)
    got: list = []

    def ask() -> None:
        try:
            got.append((call(prompt), None))
        except Exception as e:  # noqa: BLE001  told to the caller
            got.append((None, e))

    thread = threading.Thread(target=ask, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        raise TimeoutError(f"no answer in {seconds:g} s")
    text, error = got[0]
    if error is not None:
        raise error
    return text


def answered(
    prompts: DataFrame, client: Callable[[], Callable[[str], str]], limit: int = PROMPT_LIMIT, tries: int = TRIES, accept: Callable[[str], bool] | None = None,
    in_flight: int = 8, pause: float = 0.05, seconds: float | None = None,
) -> DataFrame:
    """Answers of a client; ``client`` is called once a task and gives a function prompt -> text that threads may share.

    A task has up to ``in_flight`` calls open at a time; answers keep the order of prompts. A call that fails,
    takes longer than ``seconds``, or whose answer ``accept`` refuses, is tried again after ``pause`` seconds, twice
    as long each time; after the last try the answer is empty. Further columns: ``tries`` that were made, the last
    ``error`` (null if an answer was accepted) and whether the prompt was ``cut`` to ``limit`` characters.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = client()

        def one(prompt: str | None) -> tuple[str, int, str | None, bool]:
            error, made = None, 0
            for made in range(1, tries + 1):
                try:
                    got = _within(call, (prompt or "")[:limit], seconds)
                    if accept is None or accept(got):
                        return got, made, None, len(prompt or "") > limit
                    error = "answer refused"
                except Exception as e:  # noqa: BLE001  whatever the client raises counts as a failed try
                    error = f"{type(e).__name__}: {e}"
                if made < tries:
                    time.sleep(pause * 2 ** (made - 1))
            return "", made, error, len(prompt or "") > limit

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                out = list(pool.map(one, batch.column("prompt").to_pylist()))
                more = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "response", "tries", "error", "cut"])

    return prompts.mapInArrow(ask, ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes) + ", response string, tries int, error string, cut boolean")


def stub(levels: int = 3) -> Callable[[], Callable[[str], str]]:
    """A rule that answers title prompts by line number; for tests, not a model's behaviour."""

    def make() -> Callable[[str], str]:
        def call(prompt: str) -> str:
            ids = [line.split("<|page|>")[0] for line in prompt.split("<|id|>")[1:]]
            return "\n".join(f"<|id|>{i}<|level|>{1 + k % levels}" for k, i in enumerate(ids))

        return call

    return make


def log_records(answered_: DataFrame) -> DataFrame:
    """Rows of the call log: one file name a chunk."""
    return answered_.withColumn("file", F.concat("task", F.lit("_chunk_"), F.lpad(F.col("chunk").cast("string"), 4, "0"), F.lit(".json")))
