"""MinHash near-duplicates by an LSH forest.

Texts with equal shingle sets are one class from the start. Each class has ``TREES``
signature orders of ``DEPTH`` min-hashes. A region of a tree is the classes that share
the first ``MIN_DEPTH`` of them. Candidates come in two steps:

1. In a few trees, kept in sorted order, each class meets its next neighbour, i.e. one
   with the longest common prefix. Confirmed links give preliminary components; a large
   group of near copies mostly becomes one here, with a handful of pairs a class.
2. In all trees, every region that still holds several components yields pairs between
   different components. First each class meets the nearest signature of another one, where
   a region of more than ``CROWD`` classes is taken one min-hash deeper (adaptive depth),
   down to ``DEPTH``; that joins most of a crowd cheaply. Then all that a region, whatever
   its size, still holds apart is compared on full sets inside its task, which passes on
   links, never pairs. Regions larger than ``BLOCK`` are dealt as pairs of blocks to many tasks.

Pairs inside one component need no test, as only components are asked for; so no
candidate is dropped, though none is listed for a group that is known to be joined.
All links are confirmed on full shingle sets (52-bit fingerprints). A pair at
similarity 0.8 shares no region of depth 4 in 20 trees with a chance of 3e-5, however
many others are alike.

Sets are read from the texts again for candidates only, behind a bounded membership map.

Defined results: null and empty texts and those without words have no shingles, link
with nothing and stay; shorter texts than a shingle are one shingle; rows repeated
with the same id share a component; null ids link with nothing. An empty table gives
no rows; extra columns aren't read. Any length of text is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import grouped, scratch
from pagewright.llm import kernels as K
from pagewright.llm.components import components

U = np.uint64
TREES, DEPTH, MIN_DEPTH, FIRST_TREES = 20, 6, 4, 6
WIDTH = 4 * DEPTH  # bytes of one tree's order
CROWD, BLOCK = 512, 1024
LEAST_AGREE = 0.66
_rng = np.random.Generator(np.random.PCG64(11))
_FLIP = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints (52 bits) of each document, one after the other, and where each begins."""
    h, _, _, first = K.words(data, offs)
    n = len(offs) - 1
    whole, ok = K.shingles(h, first, width)
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    words = np.diff(first)
    short = np.flatnonzero((words > 0) & (words < width))
    extra = np.array([K.spans_hash(h[first[i] : first[i + 1]], np.array([0]), np.array([words[i]]))[0] for i in short], U)
    key = np.concatenate([doc[ok] << U(52) | whole[ok] >> U(12), short.astype(U) << U(52) | extra >> U(12)])
    key = np.unique(key)
    begin = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << U(52))
    return key & U((1 << 52) - 1), begin


def signature(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Min-hashes of documents with at least one shingle: rows of TREES * DEPTH big-endian uint32."""
    n = len(begin) - 1
    out = np.zeros((n, TREES * DEPTH), np.uint32)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out.astype(">u4")
    spread = K.mixed(sets)
    halves = (spread >> U(32)).astype(np.uint32), spread.astype(np.uint32)
    at = begin[:-1][full]
    for k in range(TREES * DEPTH):
        out[full, k] = np.minimum.reduceat((halves[k % 2] ^ _FLIP[k]) * _TIMES[k], at)
    return out.astype(">u4")


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offs, data = K.buffers(batch.column(1))
        for a, b in K.slices(offs):
            sets, begin = shingle_sets(data, offs[a : b + 1], width)
            size = np.diff(begin)
            total = lambda v: (lambda c: c[begin[1:]] - c[begin[:-1]])(np.concatenate([np.zeros(1, U), np.cumsum(v)]))
            sig = signature(sets, begin)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(size),
                    pa.array(total(K.mixed(sets)).view(np.int64)),
                    pa.array(total(K.mixed(sets ^ U(0x5DEECE66D1234567))).view(np.int64)),
                    pa.array([row.tobytes() if n else None for row, n in zip(sig, size, strict=True)], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offs, data = K.buffers(batch.column(1))
        for a, b in K.slices(offs):
            sets, begin = shingle_sets(data, offs[a : b + 1], width)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([sets[i:j].tobytes() for i, j in zip(begin[:-1], begin[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])


def _next_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours in the order of their tree that share MIN_DEPTH min-hashes."""
    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, rep = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        key = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WIDTH)[:, : 4 * MIN_DEPTH]
        if tail is not None:
            t, rep, key = np.append(tail[0], t), np.append(tail[1], rep), np.concatenate([tail[2], key])
        same = (t[1:] == t[:-1]) & (key[1:] == key[:-1]).all(1) & (rep[1:] != rep[:-1])
        at = np.flatnonzero(same)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[at], rep[at + 1])), pa.array(np.maximum(rep[at], rep[at + 1]))], names=["a", "b"])
        tail = t[-1:], rep[-1:], key[-1:]


def _subregions(rows: np.ndarray, deeper: list[np.ndarray]) -> Iterator[np.ndarray]:
    """A region, or where it has more than CROWD rows what agrees in further min-hashes."""
    if len(rows) <= CROWD or not deeper:
        yield rows
        return
    order = np.argsort(deeper[0][rows], kind="stable")
    rows = rows[order]
    ends = grouped.runs([deeper[0][rows]])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield from _subregions(rows[a:b], deeper[1:])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of a region (t, region, i, j, block, rep, label, sig) the nearest signature of another component."""
    agree = int(LEAST_AGREE * TREES * DEPTH)
    for table in grouped.whole(batches, ["t", "region", "i", "j"]):
        keys = [table[k].to_numpy() for k in ("t", "region", "i", "j")]
        rep, label = table["rep"].to_numpy(), table["label"].to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), ">u4").astype(np.uint32).reshape(-1, TREES * DEPTH)
        cut = grouped.runs(keys)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            t = int(keys[0][lo])
            for rows in _subregions(np.arange(lo, hi), [sig[:, t * DEPTH + d] for d in range(MIN_DEPTH, DEPTH)]):
                if len(rows) < 2 or (label[rows] == label[rows[0]]).all():
                    continue
                for a in range(0, len(rows), 64):
                    left = rows[a : a + 64]
                    x, y = np.nonzero(label[left][:, None] != label[rows][None, :])
                    same = np.concatenate([np.zeros(0, np.int64)] + [(sig[left[x[k : k + 100_000]]] == sig[rows[y[k : k + 100_000]]]).sum(1) for k in range(0, len(x), 100_000)])
                    order = np.lexsort((rep[rows[y]], -same, x))
                    first = np.ones(len(order), bool)
                    first[1:] = x[order][1:] != x[order][:-1]
                    pick = order[first]
                    pick = pick[same[pick] >= agree]
                    p, q = rep[left[x[pick]]], rep[rows[y[pick]]]
                    found.append((np.minimum(p, q), np.maximum(p, q)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])


def common_counts(sets: list[np.ndarray], some: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of ``some`` sets (by number) with all, by products of incidence matrices over slices of the shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.concatenate(sets)
    _, spot, times = np.unique(flat, return_inverse=True, return_counts=True)
    chosen = np.zeros(len(sets), bool)
    chosen[some] = True
    shared = (times > 1) & (np.bincount(spot, chosen[owner], len(times)) > 0)
    place = np.cumsum(shared) - 1
    keep = shared[spot]
    owner, column = owner[keep], place[spot[keep]]
    out = np.zeros((len(some), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = 2048
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (lo, lo + step))
        m = np.zeros((len(sets), step), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m[some] @ m.T
    return out.astype(np.int64)


def _links_between(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components in regions (t, region, i, j, rep, label, shingles), compared on full sets in the task.

    All classes of a region are compared but those of its largest component with each other. Passes on a forest
    over the components of each region, never its pairs.
    """
    for table in grouped.whole(batches, ["t", "region", "i", "j"]):
        keys = [table[k].to_numpy() for k in ("t", "region", "i", "j")]
        label = table["label"].to_numpy()
        shingles = table["shingles"].combine_chunks() if isinstance(table["shingles"], pa.ChunkedArray) else table["shingles"]
        found: set[tuple[int, int]] = set()
        cut = grouped.runs(keys)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            own, kind, times = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
            if len(own) < 2:
                continue
            sets = [np.frombuffer(shingles[r].as_buffer(), U) for r in range(int(lo), int(hi))]
            size = np.array([len(x) for x in sets])
            rest = np.flatnonzero(kind != times.argmax())
            common = common_counts(sets, rest)
            x, y = np.nonzero((100 * common >= percent * (size[rest][:, None] + size[None, :] - common)) & (kind[rest][:, None] != kind[None, :]))
            if not len(x):
                continue
            pairs = np.unique(np.sort(np.stack([own[kind[rest[x]]], own[kind[y]]], 1), axis=1), axis=0)
            root: dict[int, int] = {}

            def top(n: int) -> int:
                while root.get(n, n) != n:
                    n = root[n]
                return n

            for p, q in (map(int, pq) for pq in pairs):
                u, v = top(p), top(q)
                if u != v:
                    root[max(u, v)] = min(u, v)
                    found.add((min(p, q), max(p, q)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sorted(found), strict=True)], names=["a", "b"])


def full_sets(needed: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """doc_id and shingles of the documents of ``needed``, from their texts."""
    needed = scratch.written(needed.select("doc_id").distinct(), "needed")
    # Dealt out between the two Python steps, so that a task has one worker at a time.
    some = docs.where(scratch.maybe_in(needed, "doc_id")(F.col("doc_id"))).repartition("doc_id")
    sets = some.join(needed, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lambda it: _sets(it, width), "doc_id long, shingles binary")
    return scratch.written(sets, "sets").dropDuplicates(["doc_id", "shingles"])


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have percent * union <= 100 * intersection."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, width)

    @F.arrow_udf("boolean")
    def similar(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            u, v = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
            if len(u) > len(v):
                u, v = v, u
            common = 0
            if 100 * len(u) >= percent * len(v) and len(v):
                at = np.searchsorted(v, u)
                common = int((v[np.minimum(at, len(v) - 1)] == u).sum())
            out.append(100 * common >= percent * (len(u) + len(v) - common) and common > 0)
        return pa.array(out, pa.bool_())

    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.where(similar("x", "y")).select("a", "b")


def labels_of(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, label) of every class: the smallest id of its component so far."""
    found = components(links)
    return scratch.written(classes.select("rep").distinct().join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("label")), "label")


def star_of(label: DataFrame) -> DataFrame:
    """The links that say what ``label`` says."""
    return label.where("rep != label").select(F.col("rep").alias("a"), F.col("label").alias("b"))


def mixed_regions(members: DataFrame, label: DataFrame) -> DataFrame:
    """The rows (t, region, rep, label, m) of regions that hold more than one component."""
    own = members.join(label, "rep")
    mixed = own.groupBy("t", "region").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("t", "region", "m")
    return scratch.written(own.join(mixed, ["t", "region"]), "regions")


def dealt(rows: DataFrame, *extra: str) -> DataFrame:
    """Rows sorted by (t, region, i, j): a region of more than BLOCK rows goes to as many groups as it has pairs of blocks."""
    key = ["t", "region", "i", "j"]
    got = (
        rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        .withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "label", *extra)
    )
    return got.repartition(*key).sortWithinPartitions(*key)


def components_of(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    signed = scratch.written(docs.mapInArrow(lambda it: _signed(it, width), "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "signed")
    same = ["n_shingles", "d1", "d2"]
    classes = scratch.written(signed.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "sig")).alias("m")).select(*same, F.col("m.doc_id").alias("rep"), F.col("m.sig").alias("sig")), "classes")

    def orders(trees: int) -> DataFrame:
        return classes.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t"), "rep", "sig").withColumn("key", F.expr(f"substring(sig, t * {WIDTH} + 1, {WIDTH})"))

    # Step 1: next neighbours in sorted order.
    ordered = orders(FIRST_TREES).select("t", "key", "rep").repartitionByRange("t", "key", "rep").sortWithinPartitions("t", "key", "rep")
    pairs = scratch.written(ordered.mapInArrow(_next_neighbours, "a long, b long").distinct(), "pairs")
    links = scratch.written(confirmed(pairs, docs, width, percent), "links")
    label = labels_of(classes, links)

    # Step 2: regions that hold several components; first the nearest pairs, then all by full sets.
    region = F.xxhash64(F.expr(f"substring(key, 1, {4 * MIN_DEPTH})")).alias("region")
    members = scratch.written(orders(TREES).select("t", region, "rep"), "members")
    rows = mixed_regions(members, label)
    near = dealt(rows.join(classes.select("rep", "sig").dropDuplicates(["rep"]), "rep"), "sig").mapInArrow(_nearest, "a long, b long").distinct()
    near = scratch.written(near.join(pairs, ["a", "b"], "left_anti"), "near")
    if near.take(1):
        label = labels_of(classes, star_of(label).union(scratch.written(confirmed(near, docs, width, percent), "more")))
        rows = mixed_regions(members, label)
    if rows.take(1):
        sets = full_sets(rows.select(F.col("rep").alias("doc_id")), docs, width).withColumnRenamed("doc_id", "rep")
        rest = dealt(rows.join(sets, "rep"), "shingles").mapInArrow(lambda it: _links_between(it, percent), "a long, b long").distinct()
        rest = scratch.written(rest, "rest")
        if rest.take(1):
            label = labels_of(classes, star_of(label).union(rest))
    found = scratch.written(classes.select(*same, "rep").join(label, "rep").select(*same, F.col("label").alias("component_id")), "found")
    out = signed.select("doc_id", *same).join(found, same, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every near-duplicate group: one with the smallest id (null ids last).

    Decided by row: a row is known by a hash of its id and text, so rows of one id with different texts are
    documents of their own, rows with a null id are compared like others, and of repeated rows one stays.
    """
    key = F.xxhash64("doc_id", "text")
    # Of all tables that the components take, only they are read again.
    found = scratch.settled(lambda: components_of(docs.select(key.alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias("key"), "component_id"), "found", docs.sparkSession)
    member = found.groupBy("key", "component_id").agg(F.count(F.lit(1)).alias("n"))
    member = scratch.written(member.join(docs.select(key.alias("key"), "doc_id").dropDuplicates(["key"]), "key"), "member")
    first = member.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("m")).select(F.col("m.key").alias("key"), F.lit(True).alias("first"))
    decided = scratch.written(member.join(first, "key", "left").select("key", F.coalesce("first", F.lit(False)).alias("kept"), "n"), "decided")
    return scratch.kept_rows(docs, key, decided)
