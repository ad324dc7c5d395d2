"""Tagged-line prompts and the answers to them."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prompt heads and tags.
HEADS = {"contd": "<image>\nTruncation Detection: ", "title": "<image>\nTitle Level Analysis: ", "image": "<image>\nImage-Text Correlation Analysis: ", "table_merge": "<image>\nTable Merge Detection: "}


def line(typed: bool) -> Column:
    kind = [F.lit("<|type|>"), F.col("type")] if typed else []
    return F.concat(F.lit("<|id|>"), F.col("idx").cast("string"), *kind, F.lit("<|page|>"), F.col("page").cast("string"), F.lit("<|box|>"), F.col("box"), F.lit("<|content|>"), F.col("content"))


def prompts(candidates: DataFrame, task: str, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One prompt a group, lines in candidate order."""
    rows = candidates.select(*by, F.struct("ord", line(task == "image").alias("line")).alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    return rows.groupBy(*by).agg(F.concat(F.lit(HEADS[task]), text).alias("prompt"))


def parsed(prompts_: DataFrame, typed: bool = False) -> DataFrame:
    """doc_id, ord, id, (type,) page, box, content of prompt lines."""
    body = F.col("prompt")
    for head in HEADS.values():
        body = F.when(F.startswith(F.col("prompt"), F.lit(head)), F.substr(F.col("prompt"), F.lit(len(head) + 1))).otherwise(body)
    parts = F.split(F.concat(F.lit("\n"), body), r"\n<\|id\|>")
    rows = prompts_.select("doc_id", F.posexplode(parts).alias("ord", "part")).where("trim(part) != ''")
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    after = lambda tag, c: F.element_at(F.split(c, rf"<\|{tag}\|>"), 2)
    before = lambda tag, c: F.element_at(F.split(c, rf"<\|{tag}\|>"), 1)
    p = F.col("part")
    kind = [trim(before("page", after("type", p))).alias("type")] if typed else []
    return rows.select(
        "doc_id", "ord", trim(before("type" if typed else "page", p)).alias("id"), *kind,
        trim(before("box", after("page", p))).cast("int").alias("page"), trim(before("content", after("box", p))).alias("box"),
        trim(F.coalesce(F.try_element_at(F.split(p, r"<\|content\|>"), F.lit(2)), F.lit(""))).alias("content"),
    )


def link_answers(responses: DataFrame, column: str = "response") -> DataFrame:
    """Lines ``<|src_id|>A<|tgt_id|>B`` (or from/to); other lines are dropped."""
    raw = F.regexp_replace(F.regexp_replace(F.col(column), r"<\|from\|>", "<|src_id|>"), r"<\|to\|>", "<|tgt_id|>")
    lines = responses.select(*[c for c in responses.columns if c != column], F.posexplode(F.split(F.trim(raw), "\n")).alias("line_no", "line"))
    number = lambda tag: F.regexp_extract("line", rf"<\|src_id\|>\s*([+-]?[0-9]+)\s*<\|tgt_id\|>\s*([+-]?[0-9]+)\s*$", tag).try_cast("int")
    return lines.select("*", number(1).alias("src_id"), number(2).alias("tgt_id")).where("src_id is not null and tgt_id is not null").drop("line")


def level_answers(responses: DataFrame, column: str = "response") -> DataFrame:
    """Lines ``<|id|>A<|level|>L`` with L >= 0."""
    lines = responses.select(*[c for c in responses.columns if c != column], F.posexplode(F.split(F.trim(F.col(column)), "\n")).alias("line_no", "line"))
    number = lambda tag: F.regexp_extract("line", r"<\|id\|>\s*([+-]?[0-9]+)\s*<\|level\|>\s*([+-]?[0-9]+)\s*$", tag).try_cast("int")
    return lines.select("*", number(1).alias("id"), number(2).alias("level")).where("id is not null and level >= 0").drop("line")


#: What stands for an answer that is no JSON (a fixed value).
NO_JSON = "!!LLM_ERROR!!"


def json_part(response: Column) -> Column:
    """The JSON text of an answer: what a ``json`` fence holds, else from the first ``[`` to the last ``]``, else all."""
    fence = r"(?s)```json\n(.*?)\n```"
    start, end = F.locate("[", response), F.length(response) - F.locate("]", F.reverse(response)) + 1
    listed = (start > 0) & (end <= F.length(response)) & (end > start)
    return F.when(response.rlike(fence), F.regexp_extract(response, fence, 1)).when(listed, F.substr(response, start, end - start + 1)).otherwise(response)


def json_answers(responses: DataFrame, column: str = "response") -> DataFrame:
    """``responses`` with the JSON text of each answer as ``json``, or ``NO_JSON`` if it can't be parsed.

    With ``responders.answered(..., accept=is_json)`` such an answer is asked for again first.
    """
    part = json_part(F.coalesce(F.col(column), F.lit("")))
    return responses.withColumn("json", part).withColumn("json", F.when(F.try_parse_json("json").isNotNull(), F.col("json")).otherwise(F.lit(NO_JSON)))


def is_json(response: str) -> bool:
    """Whether the JSON part of one answer can be parsed; for a responder's ``accept``."""
    fenced = re.search(r"```json\n(.*?)\n```", response, re.DOTALL)
    start, end = response.find("["), response.rfind("]")
    part = fenced[1] if fenced else response[start : end + 1] if 0 <= start < end else response
    try:
        json.loads(part)
    except ValueError:
        return False
    return True


def training_case(image: Column, prompt: Column, answer: Column) -> Column:
    """One conversation of a training set as a struct."""
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return F.struct(image.alias("image"), F.array(turn("human", prompt), turn("gpt", answer)).alias("conversations"), F.lit("grounding").alias("type"))


def table_prompt(upper: Column, lower: Column) -> Column:
    # The text of the table prompt.
    return F.concat(
        F.lit('\n## Table 1 (Previous Page - Last Table)\n\n**Caption:** :""\n**Last Row(s) Data:**\n'), upper,
        F.lit('\n\n---\n\n## Table 2 (Current Page - First Table)\n\n**Caption:** :""\n**First Data Row(s):**\n'), lower, F.lit("\n"),
    )
