"""Document quality by regularised quadratic discriminant analysis.

A document becomes a short vector of transformed statistics (lengths, shares of
character classes, repetition of words, lines and shingles, function words). Class
means and covariances come from sums over all labelled training rows, added up by
Spark; the driver gets one vector of fixed size a class. A class covariance is shrunk
towards the pooled one and towards its diagonal; scores are class posteriors from the
difference of log-densities, with Mahalanobis terms by cached Cholesky factors. The
log-odds are tempered, as the densities of correlated statistics are overconfident.

Defined results: null texts count as empty and are scored like any other; null ids
and labels aren't learnt from; a document labelled twice counts twice; if a class has
no rows, every score is the share of the other (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import kernels as K
from pagewright.llm import scratch

U = np.uint64
NAMES = ["words", "word_length", "long_words", "distinct", "top_word", "repeated_pairs", "same_next", "alpha", "upper", "digit", "punct", "symbol", "non_ascii", "lines", "line_length", "repeated_lines", "stops", "ends_plain"]
_CLASS = np.zeros(256, np.int64)  # 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 6 beyond ASCII, 7 newline, 0 other
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[128:] = 6
_CLASS[10] = 7


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of statistics a document, already transformed."""
    n = len(offs) - 1
    doc_of = lambda first: np.repeat(np.arange(n), np.diff(first))
    h, starts, ends, first = K.words(data, offs)
    doc = doc_of(first)
    per = lambda rows, weight=None: np.bincount(rows, weight, n).astype(float)
    count = np.maximum(np.diff(first), 1).astype(float)
    length = ends - starts
    body = data[offs[0] : offs[-1]]
    kinds = np.bincount(np.repeat(np.arange(n), np.diff(offs)) * 8 + _CLASS[body], minlength=8 * n).reshape(n, 8).astype(float)
    size = np.maximum(np.diff(offs), 1).astype(float)
    order = np.lexsort((h, doc))
    sd, sh = doc[order], h[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sd[1:] != sd[:-1]) | (sh[1:] != sh[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(sh)))
    top = np.zeros(n)
    np.maximum.at(top, sd[at], run)
    pair, ok = K.shingles(h, first, 2)
    pd, ph = doc[ok], pair[ok]
    distinct_pairs = np.unique(K.mixed(ph ^ (pd.astype(U) * U(0x9E3779B97F4A7C15))), return_index=True)[1]
    pairs = per(pd)
    same = np.zeros(len(h), bool)
    same[:-1] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    # Lines: runs between newlines.
    breaks = np.flatnonzero(body == 10) + offs[0]
    line_start = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    line_start = line_start[line_start < offs[-1]]
    line_doc = np.searchsorted(offs, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], offs[-1]), offs[line_doc + 1])
    # A line's content: the first and last words and their number.
    a, b = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    full = b > a
    total = np.concatenate([np.zeros(1, U), np.cumsum(h * U(3))])
    mark = K.mixed((total[b] - total[a]) ^ (line_doc.astype(U) << U(40)))[full]
    lines = np.maximum(per(line_doc[full]), 1)
    unique_lines = per(line_doc[full][np.unique(mark, return_index=True)[1]])
    last = np.zeros(len(h), bool)
    if len(h):
        last = _CLASS[data[ends - 1]] == 5
    share = lambda x, of: np.sqrt(np.clip(x / of, 0, 1))
    out = [
        np.log1p(np.diff(first)),
        np.log1p(per(doc, length) / count),
        share(per(doc, length > 20), count),
        share(per(sd[at]), count),
        share(top, count),
        share(pairs - per(pd[distinct_pairs]), np.maximum(pairs, 1)),
        share(per(doc, same), count),
        share(kinds[:, 1] + kinds[:, 2] + kinds[:, 6], size),
        share(kinds[:, 2], size),
        share(kinds[:, 3], size),
        share(kinds[:, 4], size),
        share(kinds[:, 5], size),
        share(kinds[:, 6], size),
        np.log1p(lines),
        np.log1p(size / lines),
        share(lines - unique_lines, lines),
        share(per(doc, length <= 3), count),
        share(per(doc, last), count),
    ]
    return np.stack(out, 1)


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and offsets for labels 0 and 1."""

    mean: list[np.ndarray]
    factor: list[np.ndarray]
    offset: list[float]
    temper: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.mean, self.factor, self.offset, strict=True)]
        return 1 / (1 + np.exp(np.clip(-(logs[1] - logs[0]) * self.temper, -500, 500)))


def fitted(sums: dict[int, np.ndarray], shrink: float = 0.1, ridge: float = 1e-3, temper: float = 0.06) -> Discriminant:
    """From vectors (n, sum of x, sum of products) of each class."""
    d = len(NAMES)
    n = {c: sums.get(c, np.zeros(1 + d + d * d))[0] for c in (0, 1)}
    if not n[0] or not n[1]:
        return Discriminant([], [], [], temper, 0.5 if n[0] == n[1] else float(n[1] > 0))
    mean, cov = {}, {}
    for c in (0, 1):
        mean[c] = sums[c][1 : d + 1] / n[c]
        cov[c] = sums[c][d + 1 :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    out = Discriminant([], [], [], temper)
    for c in (0, 1):
        alpha = max(shrink, d / (d + n[c]))  # few rows: closer to the pooled one
        s = (1 - alpha) * cov[c] + alpha * pooled
        s = (1 - shrink) * s + shrink * np.diag(np.diag(s)) + ridge * np.eye(d)
        low = np.linalg.cholesky(s)
        out.mean.append(mean[c])
        out.factor.append(np.linalg.inv(low))
        out.offset.append(float(np.log(n[c] / (n[0] + n[1])) - np.log(np.diag(low)).sum()))
    return out


FEATURES = "doc_id long, x array<double>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offs, data = K.buffers(batch.column(1))
        for a, b in K.slices(offs):
            x = features(data, offs[a : b + 1])
            ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, x.ravel())], names=["doc_id", "x"])


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and statistics of every document."""
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(_measured, FEATURES)


def fit(stats: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id", train: str = "crc32(cast(doc_id as string)) % 5 != 0") -> Discriminant:
    """Learn from all labelled rows of ``train``."""
    d = len(NAMES)
    rows = stats.where(train).join(labels.select(labels[id_column].cast("long").alias("doc_id"), labels[label_column].cast("int").alias("label")).where("label in (0, 1)"), "doc_id").select("label", "x")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c, v in total.items():
                own = x[label == c]
                v += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for c, v in total.items():
            if v[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["label", "k", "v"])

    # At most 2 * (1 + d + d * d) rows reach the driver, at any input size.
    got = rows.mapInArrow(moments, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).toPandas()
    return fitted({int(c): own.sort_values("k")["v"].to_numpy() for c, own in got.groupby("label")})


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = scratch.written(measured(docs), "stats")
    model = fit(stats, labels)

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))))

    return (
        stats.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(True)).alias("held_out"), score("x").alias("score"))
        .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns.

    The texts are measured twice (to learn, to decide), never shuffled.
    """
    model = fit(scratch.written(measured(docs), "stats"), labels)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        offs, data = K.buffers(text)
        parts = [model.score(features(data, offs[a : b + 1])) >= threshold for a, b in K.slices(offs)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(good(F.coalesce(F.col("text"), F.lit(""))))
