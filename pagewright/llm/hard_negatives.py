"""Hard-negative mining: vantage-point trees over norm-augmented vectors, searched by score windows.

Vectors become integers ``floor(scale * x)``; a row's score is its inner product with an anchor.
Within a block of rows each vector gets one more component, sqrt(M*M - |x|*|x|) with the largest
norm M of the block; anchors are stretched to the norm M and get zero there. Then d*d = 2*M*M -
2*score*M/|a|, so scores in a window are distances in an annulus, and the highest score is the
nearest row. The block's
vantage-point tree halves its rows by distance from a vantage point and keeps the range of
distances of each half. A search takes the nodes nearest first by the bound that the triangle
inequality gives, leaves out those wholly outside the annulus, and ends when ``k`` rows are found
and no open node can hold a row that comes before the last of them. Bounds are taken with room for
rounding; scores themselves are exact integers.

Rows and anchors are dealt to blocks by a hash of the row; a task has one block of each, so its
memory is bounded (``ROWS`` vectors each) whatever label or vector is frequent, and it passes on
``k`` rows for each of its anchors (and windows), which are ranked by a window that limits before
the shuffle. The anchors are the query set, each compared with all rows, in blocks. Two rounds: the
first finds each anchor's positives, the second the negatives in their windows.

Defined results: rows with a null id, a null label, a null vector, or null or non-finite components
take no part; vectors of different lengths aren't compared; rows repeated with an id are rows of
their own, and an anchor is never its own positive, though another row with its id can be.
An anchor without positives, or a positive without negatives in its window (as any with a score
below zero), gives no rows; an empty table gives none. Equal scores are ordered by id. Extra columns
aren't read. A component whose integer reaches 2**26 in size is an error.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm import grouped, scratch
from pagewright.llm.centroid_clustering import integers

#: Vectors of a block at most (in the mean); a smaller input is dealt to up to SPREAD blocks.
ROWS, SPREAD, LEAST = 16384, 32, 1024
LEAF = 256


def blocks(n: int) -> int:
    return max(1, math.ceil(n / ROWS), min(SPREAD, math.ceil(n / LEAST)))


class Tree:
    """A vantage-point tree over the augmented rows of an integer matrix; each leaf is a slice of ``order``."""

    def __init__(self, x: np.ndarray) -> None:
        f = x.astype(np.float64)
        squares = (f * f).sum(1)
        self.largest = float(squares.max(initial=0.0))
        extra = np.sqrt(np.maximum(self.largest - squares, 0.0))
        self.order = np.arange(len(x))
        self.vantage: list[int] = []  # row of each inner node
        self.halves: list[tuple] = []  # of each inner node: (nearest, farthest, child) twice
        self.leaves: list[tuple[int, int]] = []
        rng = np.random.Generator(np.random.PCG64(len(x)))

        def built(lo: int, hi: int) -> int:
            """Number of the node of order[lo:hi]; leaves count down from -1."""
            if hi - lo <= LEAF:
                self.leaves.append((lo, hi))
                return -len(self.leaves)
            own = self.order[lo:hi]
            p = int(own[rng.integers(len(own))])
            d = np.sqrt(np.maximum(2 * self.largest - 2 * (f[own] @ f[p] + extra[own] * extra[p]), 0.0))
            half = len(own) // 2
            by = np.argpartition(d, half)  # by count, so equal distances still halve
            self.order[lo:hi], d = own[by], d[by]
            number = len(self.vantage)
            self.vantage.append(p)
            self.halves.append(())
            near, far = built(lo, lo + half), built(lo + half, hi)
            self.halves[number] = ((d[:half].min(), d[:half].max(), near), (d[half:].min(), d[half:].max(), far))
            return number

        self.root = built(0, len(x))
        # Products of floats are exact below 2**53; larger ones stay integers.
        self.exact = self.largest < 2**52
        self.x = (f if self.exact else x)[self.order]

    def distances(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each anchor is stretched by to the norm M, and its distance to each vantage point then, in augmented space."""
        a = anchors.astype(np.float64)
        norms = np.sqrt((a * a).sum(1))
        stretch = np.where(norms > 0, math.sqrt(self.largest) / np.maximum(norms, 1e-300), 1.0)
        stretch[stretch == 0] = 1.0
        a *= stretch[:, None]
        points = self.x[np.argsort(self.order)[self.vantage]].astype(np.float64) if self.vantage else np.zeros((0, a.shape[1]))
        return stretch, np.sqrt(np.maximum((a * a).sum(1)[:, None] + self.largest - 2 * (a @ points.T), 0.0))

    def search(self, q: np.ndarray, stretch: float, away: np.ndarray, fits: np.ndarray, ids: np.ndarray, lo: float, hi: float, k: int) -> list[tuple[int, int, int]]:
        """The first ``k`` rows (-score, id, place) of those that fit and whose score is in [lo, hi]; fits and ids are in ``order``."""
        square = float((q.astype(np.float64) ** 2).sum())
        top = square * stretch * stretch + self.largest
        room = 1e-9 * top / stretch + 1.0
        whole = self.exact and square < 2**52
        asked = q.astype(self.x.dtype if whole else np.int64)
        best: list[tuple[int, int, int]] = []
        queue: list[tuple[float, int]] = [(-(top / 2 / stretch + room), self.root)]
        while queue:
            bound, node = heapq.heappop(queue)
            if len(best) == k and bound > best[-1][0]:
                break
            if node < 0:
                a, b = self.leaves[-node - 1]
                x = self.x[a:b] if whole or not self.exact else self.x[a:b].astype(np.int64)
                score = x @ asked
                at = np.flatnonzero(fits[a:b] & (score >= lo) & (score <= hi))
                if len(best) == k:
                    at = at[score[at] >= -best[-1][0]]
                if len(at):
                    s = -score[at].astype(np.int64)
                    first = np.lexsort((ids[a + at], s))[:k]
                    best = sorted([*best, *zip(s[first].tolist(), ids[a + at[first]].tolist(), (a + at[first]).tolist(), strict=True)])[:k]
                continue
            d = away[node]
            for nearest, farthest, child in self.halves[node]:
                least, most = max(0.0, nearest - d, d - farthest), d + farthest
                upper = (top - least * least) / 2 / stretch + room
                if upper >= lo and (top - most * most) / 2 / stretch - room <= hi:
                    heapq.heappush(queue, (max(bound, -upper), child))
        return best


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, pa.Table]]:
    """Columns, integer matrix and table of each (block of anchors, block of rows, length)."""
    keys = ["i", "j", "dim"]
    for table in grouped.whole(batches, keys):
        cut = grouped.runs([table[c].to_numpy() for c in keys])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            part = table.slice(int(a), int(b - a))
            dim = part["dim"][0].as_py()
            v = part["v"].combine_chunks()
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), dim)
            yield {c: part[c].to_numpy() for c in ("kind", "rid", "vec_id", "label")}, x, part


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(anchor, positive, place of the window, found row, its id and score): rows with the anchor's label where ``lo`` is null, others in [lo, hi]."""
    names = ["anchor", "window", "found", "found_id", "score"]
    for c, x, part in _groups(batches):
        asks, rows = np.flatnonzero(c["kind"] == 0), np.flatnonzero(c["kind"] == 1)
        if not len(asks) or not len(rows):
            continue
        tree = Tree(x[rows])
        own = rows[tree.order]
        rid, ids, label = c["rid"][own], c["vec_id"][own], c["label"][own]
        stretch, away = tree.distances(x[asks])
        windows = part["windows"].combine_chunks()
        out: list[tuple[int, int, int, int, int]] = []
        same: dict[int, np.ndarray] = {}
        for n, at in enumerate(asks):
            if c["label"][at] not in same:
                same[c["label"][at]] = label == c["label"][at]
            fits = same[c["label"][at]]
            ask = windows[int(at)].as_py()
            if ask is None:
                # The anchor's own row is among them: one more is taken and it is left out.
                for s, i, place in tree.search(x[at], stretch[n], away[n], fits, ids, -math.inf, math.inf, k + 1):
                    if rid[place] != c["rid"][at]:
                        out.append((c["rid"][at], 0, rid[place], i, -s))
            else:
                for w, (lo, hi) in enumerate((r["lo"], r["hi"]) for r in ask):
                    out += [(c["rid"][at], w, rid[place], i, -s) for s, i, place in tree.search(x[at], stretch[n], away[n], ~fits, ids, lo, hi, k)]
        if out:
            cols = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])], names=names)


def _compared(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, k: int) -> DataFrame:
    """Found rows of each anchor and window in every block of rows."""
    a, b = max(1, math.ceil(n_anchors / ROWS)), blocks(n_rows)
    block = lambda n: F.expr(f"cast(pmod(xxhash64(rid), {n}) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["rid", "vec_id", "label", "v"]
    asked = anchors.select(block(a).alias("i"), every(b).alias("j"), F.lit(0).alias("kind"), *cols, "windows")
    held = rows.select(every(a).alias("i"), block(b).alias("j"), F.lit(1).alias("kind"), *cols, F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("windows"))
    both = asked.unionByName(held).withColumn("dim", F.size("v"))
    dealt = both.repartition("i", "j", "dim").sortWithinPartitions("i", "j", "dim", "kind")
    return dealt.mapInArrow(lambda it: _searched(it, k), "anchor long, window int, found long, found_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and window with their rank, by score, then id."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "found_id", "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    vectors: DataFrame, is_anchor: Column, label: Column, low: int = 80, high: int = 100, positives: int = 5, negatives: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``label`` and ``is_anchor`` are expressions on the columns of ``vectors``. A negative's score is at least ``low``
    and at most ``high`` hundredths of the positive's.
    """
    marked = vectors.select(vectors[id_column].alias("vec_id"), vectors[vector_column].alias("embedding"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = integers(marked.where("vec_id is not null and label is not null"), scale, None, "vec_id", "embedding", "label", "anchor")
    rows = scratch.written(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    n_rows = rows.count()
    anchors = rows.where("anchor")
    n_anchors = anchors.count()
    windows = "array<struct<lo:bigint,hi:bigint>>"
    found = _compared(anchors.withColumn("windows", F.lit(None).cast(windows)), rows, n_anchors, n_rows, positives)
    likes = scratch.written(_first(found, positives).select("anchor", (F.col("rank") - 1).alias("window"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Whole bounds: the ceiling of low and the floor of high hundredths.
    hundredths = lambda c: f"(({c}) - pmod({c}, 100)) div 100"
    lo = -F.expr(hundredths(f"-{low} * positive_score"))
    hi = F.expr(hundredths(f"{high} * positive_score"))
    asked = likes.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("window", lo.alias("lo"), hi.alias("hi")))).alias("w"))
    asked = anchors.join(asked.select(F.col("anchor").alias("rid"), F.transform("w", lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"))).alias("windows")), "rid")
    found = scratch.written(_first(_compared(asked, rows, n_anchors, n_rows, negatives), negatives), "negatives")
    named = anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(likes, ["anchor", "window"]).join(named, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
