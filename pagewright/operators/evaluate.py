"""Title hierarchy scores: alignment of predicted titles with the truth and tree edit similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry, text
from pagewright.plans import kernels

# Weights and thresholds of the alignment.
BOX_WEIGHT, TEXT_WEIGHT, TYPE_WEIGHT, OTHER_TYPE = 0.45, 0.35, 0.20, 0.4
LEAST_SCORE, LEAST_TEXT, LEAST_BOX = 0.35, 0.45, 0.8
MODES = ("id_aware", "structure_only", "content_aware")


def box_score(a: list[Column], b: list[Column]) -> Column:
    return F.greatest(geometry.iou(a, b), geometry.overlap_of_smaller(a, b))


def truth_blocks(cases: DataFrame) -> DataFrame:
    """doc_id, gt_id, ord, page, box and content of title prompts (boxes there are y1 x1 y2 x2)."""
    body = F.regexp_replace("prompt", r"^<image>\nTitle Level Analysis: ", "")
    rows = cases.select("doc_id", F.posexplode(F.split(F.concat(F.lit("\n"), body), r"\n<\|id\|>")).alias("ord", "part"))
    pattern = r"(?s)^([^<]+)<\|page\|>(\p{Nd}+)<\|box\|>([^<]+)<\|content\|>(.*)"
    got = rows.where(F.col("part").rlike(pattern))
    part = lambda k: F.regexp_extract("part", pattern, k)
    nums = F.transform(F.slice(F.split(F.trim(part(3)), r"\s+"), 1, 4), lambda v: v.try_cast("double"))
    got = got.select("doc_id", F.trim(part(1)).alias("gt_id"), "ord", part(2).cast("int").alias("page"), nums.alias("n"), text.normalize_text(part(4)).alias("content"))
    at = lambda k: F.when(F.size("n") == 4, F.get("n", F.lit(k))).otherwise(0.0)
    return got.select("doc_id", "gt_id", "ord", "page", at(1).alias("x1"), at(0).alias("y1"), at(3).alias("x2"), at(2).alias("y2"), "content")


def truth_levels(cases: DataFrame) -> DataFrame:
    """doc_id, ord, gt_id, level >= 0 of title labels."""
    rows = cases.select("doc_id", F.posexplode(F.split("labels", "\n")).alias("ord", "line"))
    pattern = r"^\s*<\|id\|>([^<]+)<\|level\|>(-?[0-9]+)"
    return rows.where(F.col("line").rlike(pattern)).select("doc_id", "ord", F.trim(F.regexp_extract("line", pattern, 1)).alias("gt_id"), F.regexp_extract("line", pattern, 2).try_cast("int").alias("level")).where("level >= 0")


def candidates(truth: DataFrame, predicted: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Scored pairs on equal pages; whether a pair may be matched at all is ``close``.

    Texts are compared only where that can still matter: a ratio is at most twice the shorter length over both
    lengths (unless one contains the other), and pairs whose bound gives neither the least score nor closeness are
    left out before.
    """
    p = predicted.select("doc_id", "page", F.col("block_id").alias("pred_id"), F.col("type").alias("p_type"), text.compact_text(F.col("content")).alias("p_text"), *[F.col(c).alias(f"p_{c}") for c in geometry.BOX])
    both = truth.withColumn("gt_text", text.compact_text(F.col("content"))).drop("content").join(p, ["doc_id", "page"])
    scored = both.withColumn("box", box_score([F.col(c) for c in geometry.BOX], [F.col(f"p_{c}") for c in geometry.BOX]))
    score = lambda t: BOX_WEIGHT * F.col("box") + TEXT_WEIGHT * t + TYPE_WEIGHT * F.when(F.col("p_type") == "title", 1.0).otherwise(OTHER_TYPE)
    close = lambda t: ~((t < LEAST_TEXT) & (F.col("box") < LEAST_BOX))
    a, b = F.char_length("gt_text"), F.char_length("p_text")
    within = F.contains("gt_text", "p_text") | F.contains("p_text", "gt_text")
    # A little room, so that rounding leaves out no pair.
    scored = scored.withColumn("most", F.when(F.coalesce(within, F.lit(True)), 1.0).otherwise(2.0 * F.least(a, b) / (a + b)) + 1e-9)
    scored = scored.where((score(F.col("most")) + 1e-9 >= least) & close(F.col("most")))
    scored = scored.withColumn("text", text.similarity(F.col("gt_text"), F.col("p_text"))).withColumn("score", score(F.col("text")))
    return scored.where(F.col("score") >= least).select("doc_id", "gt_id", "pred_id", "score", close(F.col("text")).alias("close"))


def greedy(rows: list[tuple[float, str, str]]) -> list[tuple[str, str, float]]:
    """One-to-one pairs, best scores (then larger ids) first."""
    used_a, used_b, out = set(), set(), []
    for score, a, b in sorted(rows, reverse=True):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b, score))
    return out


def matches(candidates_: DataFrame) -> DataFrame:
    """doc_id, gt_id, pred_id, score: greedy one-to-one matches of each document."""

    order = [F.desc("score"), F.desc("gt_id"), F.desc("pred_id")]
    rows = candidates_.where("close").select("doc_id", "score", "gt_id", "pred_id")
    return kernels.by_document(rows, order, "gt_id string, pred_id string, score double", kernels.greedy)


def prediction_nodes(predicted: DataFrame, matches_: DataFrame) -> DataFrame:
    """doc_id, ord, gt_id, level of matched titles in reading order; no level counts as 1."""
    got = predicted.join(matches_.select("doc_id", F.col("pred_id").alias("block_id"), "gt_id"), ["doc_id", "block_id"])
    return got.select("doc_id", F.col("order").alias("ord"), "gt_id", F.when(F.col("title_level") > 0, F.col("title_level")).otherwise(1).alias("level"))


def labelled(nodes: DataFrame, truth: DataFrame, mode: str) -> DataFrame:
    """doc_id, ord, label, level by mode: ids, one name for all, or compact contents."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "content_aware":
        got = nodes.join(truth.select("doc_id", "gt_id", "content"), ["doc_id", "gt_id"], "left")
        return got.select("doc_id", "ord", text.compact_text(F.col("content")).alias("label"), "level")
    return nodes.select("doc_id", "ord", F.lit("NODE").alias("label") if mode == "structure_only" else F.col("gt_id").alias("label"), "level")


def postorder(nodes: list[tuple[str, int]]) -> tuple[list[str], list[int]]:
    """Labels in postorder under a root, and for each the first leaf of its subtree."""
    base = min((level for _, level in nodes), default=0)
    children: list[list[int]] = [[]]
    stack = [(0, -1)]
    for k, (_, level) in enumerate(nodes, 1):
        children.append([])
        while stack[-1][1] >= level - base:
            stack.pop()
        children[stack[-1][0]].append(k)
        stack.append((k, level - base))
    post = _post(children)
    size = [1] * len(children)
    for n in post:  # children come before their parent
        size[n] += sum(size[c] for c in children[n])
    return ["ROOT" if n == 0 else str(nodes[n - 1][0]) for n in post], [k - size[n] + 1 for k, n in enumerate(post)]


def _post(children: list[list[int]]) -> list[int]:
    """Postorder: the reverse of a preorder that takes the last child first."""
    order, todo = [], [0]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += children[n]
    return order[::-1]


def edit_distance(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> int:
    """Unit-cost edit distance of two title trees (Zhang and Shasha 1989)."""
    la, fa = postorder(a)
    lb, fb = postorder(b)
    keys = lambda first: sorted({f: k for k, f in enumerate(first)}.values())
    d = [[0] * len(lb) for _ in la]
    for i in keys(fa):
        for j in keys(fb):
            m, n = i - fa[i] + 2, j - fb[j] + 2
            f = [[0] * n for _ in range(m)]
            for x in range(1, m):
                f[x][0] = x
            for y in range(1, n):
                f[0][y] = y
            for x in range(1, m):
                for y in range(1, n):
                    p, q = fa[i] + x - 1, fb[j] + y - 1
                    drop = min(f[x - 1][y], f[x][y - 1]) + 1
                    if fa[p] == fa[i] and fb[q] == fb[j]:
                        f[x][y] = d[p][q] = min(drop, f[x - 1][y - 1] + (la[p] != lb[q]))
                    else:
                        f[x][y] = min(drop, f[fa[p] - fa[i]][fb[q] - fb[j]] + d[p][q])
    return d[-1][-1]


def similarity_of_trees(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> float:
    return max(0.0, min(1.0, 1.0 - edit_distance(a, b) / (max(len(a), len(b)) or 1)))


def scores(truth_nodes: DataFrame, predicted_nodes: DataFrame) -> DataFrame:
    """doc_id, score, gt_count, pred_count of labelled nodes (doc_id, ord, label, level)."""
    side = lambda df, k: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "level"))).alias(k))
    both = side(truth_nodes, "a").join(side(predicted_nodes, "b"), "doc_id", "left")

    @F.pandas_udf("double")
    def teds(a: pd.Series, b: pd.Series) -> pd.Series:
        nodes = lambda rows: [(r["label"], r["level"]) for r in (rows if rows is not None else [])]
        return pd.Series([similarity_of_trees(nodes(x), nodes(y)) for x, y in zip(a, b, strict=True)])

    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return both.select("doc_id", F.round(teds("a", "b"), 6).alias("score"), size("a").alias("gt_count"), F.when(F.col("b").isNull(), F.lit(0)).otherwise(F.size("b")).cast("long").alias("pred_count"))


def details(cases: DataFrame, predicted: DataFrame, statuses: DataFrame, mode: str = "content_aware") -> DataFrame:
    """One row a case: doc_id, status, message, score, gt_count, pred_count, match_count, candidate_count, raw_title_count.

    Documents that aren't ok (those without a status are missing) score 0 with their counts of the truth only; where
    neither side has a title, the trees are equal. Predictions of other documents aren't compared.
    """
    truth, levels = truth_blocks(cases), truth_levels(cases)
    known = cases.select("doc_id").distinct().join(statuses.select("doc_id", "status", "message"), "doc_id", "left")
    known = known.select("doc_id", F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce("message", F.lit("")).alias("message"))
    usable = predicted.join(known.where("status = 'ok'"), "doc_id", "left_semi")
    found = matches(candidates(truth, usable))
    nodes = prediction_nodes(usable, found)
    got = known.join(scores(labelled(levels, truth, mode), labelled(nodes, truth, mode)).select("doc_id", "score"), "doc_id", "left")
    for rows, name in ((levels, "gt_count"), (nodes, "pred_count"), (found, "match_count"), (truth, "candidate_count"), (usable, "raw_title_count")):
        got = got.join(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    blank = F.when((F.col("gt_count") == 0) & (F.col("pred_count") == 0), 1.0).otherwise(0.0)
    return got.withColumn("score", F.when(F.col("status") == "ok", F.coalesce("score", blank)).otherwise(0.0))


def summary(details: DataFrame) -> DataFrame:
    """Counts and means over documents (doc_id, status, score, gt_count, pred_count, match_count)."""
    ok = F.col("status") == "ok"
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c).cast("double"))), F.lit(0.0))
    return details.agg(
        F.count(F.lit(1)).alias("total_docs"), F.count_if(ok).alias("usable_docs"), F.count_if(~ok).alias("missing_docs"), mean("score").alias("avg_score_usable"),
        F.coalesce(F.avg(F.when(ok, F.col("score").cast("double")).otherwise(0.0)), F.lit(0.0)).alias("avg_score_with_missing_zero"),
        mean("gt_count").alias("avg_gt_count"), mean("pred_count").alias("avg_pred_count"), mean("match_count").alias("avg_match_count"),
    )
