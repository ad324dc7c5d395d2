"""Training cases of the four subtasks from blocks and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry, text
from pagewright.operators import candidates, prompts, tree
from pagewright.plans import kernels


def full_sentences(blocks: DataFrame) -> DataFrame:
    """Continuation candidates with head and tail sentence in full length."""
    chosen = candidates.continuation_candidates(blocks).select("doc_id", F.col("idx").alias("pos"), "ord")
    head, tail = text.head_sentence(F.col("content")), text.tail_sentence(F.col("content"))
    body = F.when(head == tail, head).otherwise(F.concat(head, F.lit(" ... "), tail))
    return blocks.join(chosen, ["doc_id", "pos"]).select("doc_id", F.col("pos").alias("idx"), "ord", body.alias("content"), "page", geometry.prompt_box(*[F.col(c) for c in geometry.BOX]).alias("box"))


def title_parents(titles: DataFrame) -> DataFrame:
    """(doc_id, pos, parent): the nearest earlier title of lower level; the block at place 0 is never a parent."""
    up = kernels.nearest_smaller(titles.where("pos > 0").select("doc_id", F.col("pos").alias("k"), F.col("level").alias("value")))
    return titles.select("doc_id", "pos").join(up.select("doc_id", F.col("k").alias("pos"), "parent"), ["doc_id", "pos"], "left")


def _lines(rows: DataFrame, line: Column, name: str, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The lines of each group in the order of ``ord``, as one text."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias(name))


def link_text(links: DataFrame) -> DataFrame:
    """(doc_id, answer): links as answer lines in order."""
    line = F.concat(F.lit("<|src_id|>"), F.col("src_id").cast("string"), F.lit("<|tgt_id|>"), F.col("tgt_id").cast("string"))
    return _lines(links, line, "answer")


def level_text(levels: DataFrame) -> DataFrame:
    """(doc_id, answer): titles (idx, level, ord) with their levels as answer lines in order."""
    line = F.concat(F.lit("<|id|>"), F.col("idx").cast("string"), F.lit("<|level|>"), F.col("level").cast("string"))
    return _lines(levels, line, "answer")


def _case(task: str) -> Column:
    image = F.concat(F.col("doc_id").cast("string"), F.lit(f"_{task}.jpeg"))
    return prompts.training_case(image, F.col("prompt"), F.coalesce("answer", F.lit(""))).alias("case")


def cases(rows: DataFrame, task: str, answers: DataFrame) -> DataFrame:
    """doc_id, case: one training case for each document with rows; without answer lines the answer is empty.

    A document whose answer failed is no case: leave its rows out.
    """
    return prompts.prompts(rows, task).join(answers, "doc_id", "left").select("doc_id", _case(task))


def contd_cases(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Cases of text continuation from answers (doc_id, src_id, tgt_id, ord)."""
    return cases(full_sentences(blocks), "contd", link_text(links))


def title_cases(blocks: DataFrame, levels: DataFrame) -> DataFrame:
    """Cases of title levels, with whole titles, from answers (doc_id, idx, level, ord)."""
    return cases(candidates.title_candidates(blocks, None), "title", level_text(levels))


def image_cases(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Cases of figures and their texts, with whole texts, from answers (doc_id, src_id, tgt_id, ord)."""
    return cases(candidates.visual_candidates(blocks, None), "image", link_text(links))


def _json_list(items: Column) -> Column:
    """A list of strings as JSON with a space after each comma."""
    one = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), one), ", "), F.lit("]"))


def table_cases(pairs: DataFrame) -> DataFrame:
    """doc_id, src_id, tgt_id, case: one case for each pair of tables.

    A pair has upper and lower (structs of id, page, col_count, caption), last_rows of the upper and first_rows
    of the lower table, and the answer: merge (null: 0) and cell_list (null: empty).
    """
    empty = F.lit("[]")

    def line(table: str, last: Column, first: Column) -> Column:
        t = F.col(table)
        parts = [("id", t["id"].cast("string")), ("page", t["page"].cast("string")), ("col_count", t["col_count"].cast("string")), ("caption", F.coalesce(t["caption"], F.lit(""))), ("last_rows", last), ("first_rows", first)]
        return F.concat(*[c for tag, value in parts for c in (F.lit(f"<|{tag}|>"), value)])

    text_ = F.concat(F.lit(prompts.HEADS["table_merge"]), line("upper", _json_list(F.col("last_rows")), empty), F.lit("\n"), line("lower", empty, _json_list(F.col("first_rows"))))
    flags = F.array_join(F.coalesce(F.col("cell_list").cast("array<string>"), F.array().cast("array<string>")), ",")
    answer = F.concat(F.lit("<|src_id|>"), F.col("upper.id").cast("string"), F.lit("<|tgt_id|>"), F.col("lower.id").cast("string"), F.lit("<|merge|>"), F.coalesce("merge", F.lit(0)).cast("string"), F.lit("<|cell_list|>"), flags)
    asked = pairs.select("doc_id", F.col("upper.id").alias("src_id"), F.col("lower.id").alias("tgt_id"), text_.alias("prompt"), answer.alias("answer"))
    return asked.select("doc_id", "src_id", "tgt_id", _case("table_merge"))


def title_relations(titles: DataFrame) -> DataFrame:
    """(doc_id, ord, relation) of judged titles (doc_id, ord, level, content): a number sign a level; null levels give none."""
    return titles.where("level is not null").select("doc_id", "ord", F.concat(F.repeat(F.lit("#"), F.greatest("level", F.lit(0)).cast("int")), F.col("content")).alias("relation"))


def continuation_relations(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, ord, relation) of links (doc_id, src_id, tgt_id, ord): the source's text, a marker and the target's text.

    Links are taken in order; a text keeps one marker for each time it was a source so far.
    """
    end = lambda k, c: F.struct(F.lit(k).alias("role"), F.col(c).alias("pos"))
    ends = links.select("doc_id", "ord", F.explode(F.array(end(0, "src_id"), end(1, "tgt_id"))).alias("e")).select("doc_id", "ord", "e.*")
    so_far = F.count(F.when(F.col("role") == 0, 1)).over(Window.partitionBy("doc_id", "pos").orderBy("ord", "role"))
    marked = ends.withColumn("marks", so_far.cast("int")).join(blocks.select("doc_id", "pos", "content"), ["doc_id", "pos"])
    shown = F.concat(F.coalesce("content", F.lit("")), F.repeat(F.lit(tree.CONTINUED), F.col("marks")))
    both = marked.withColumn("shown", shown).groupBy("doc_id", "ord").agg(F.min_by("shown", "role").alias("a"), F.max_by("shown", "role").alias("b"))
    return both.select("doc_id", "ord", F.concat("a", "b").alias("relation"))


def caption_of_page(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, caption): for each table the first table caption on its page."""
    first = blocks.where(F.col("type").isin("table_caption", "tab-title", "tab-caption")).groupBy("doc_id", "page").agg(F.min_by("content", "pos").alias("caption"))
    return blocks.where("type = 'table'").join(first, ["doc_id", "page"], "left").select("doc_id", "pos", "caption")
