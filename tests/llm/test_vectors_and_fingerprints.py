"""Hard negatives, centroid clusters and fingerprints against brute force, with odd rows."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import centroid_clustering, fingerprints, hard_negatives, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster string, rid string, windows string"


def vector_rows(n, dim, seed):
    """Ties, repeated rows, copies that fill a third, and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = np.round(rng.normal(0, 0.4, dim) + (i % 5) * 0.3, 2) if i % 3 else np.full(dim, 0.25)
        rows.append((i, [float(v) for v in x], int(rng.integers(0, 10)), "", "", "", ""))
    rows += [rows[7], (None, rows[1][1], 1, "", "", "", ""), (n + 1, None, 1, "", "", "", ""), (n + 2, [1.0] * (dim - 1), 2, "", "", "", ""), (100 * n, [float("nan")] + [0.0] * (dim - 1), 3, "", "", "", "")]
    rows += [(n + 3, [float("inf")] + [0.0] * (dim - 1), 3, "", "", "", ""), (n + 4, [None] + [0.0] * (dim - 1), 3, "", "", "", ""), (n + 5, [], 3, "", "", "", ""), (n + 6, rows[2][1], None, "", "", "", ""), (n + 7, [0.0] * dim, 4, "", "", "", "")]
    return rows


def whole(x, scale):
    """Integers of a vector as Spark holds it (32-bit floats)."""
    return [math.floor(scale * float(np.float32(v))) for v in x]


def finite(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x)


def test_annulus_search_equals_comparing_with_all():
    rng = np.random.default_rng(5)
    for k, dim, span in ((1, 3, 5), (8, 64, 2000), (40, 2, 4), (200, 5, 30)):
        c = rng.integers(-span, span + 1, (k, dim))
        x = rng.integers(-span, span + 1, (700, dim))
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
        who, best = centroid_clustering.nearest(x, c)
        assert (who == d.argmin(1)).all() and (best == d.min(1)).all()  # argmin: the first of equals


def clusters_by_loop(rows, k, rounds, dim):
    kept = [(i, whole(x, 1024)) for i, x, *_ in rows if finite(x) and len(x) == dim]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), f in zip(kept, found) if f == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    final = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in final)
    by = {j: sum(d for _, d, f in final if f == j) for j in range(len(centroids))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((repr(i), j, d, by[j], total, name[j]) for i, d, j in final)


@pytest.mark.parametrize("n, rounds", [(150, 10), (3, 2), (60, 0)])
def test_clusters_equal_a_loop(spark, n, rounds):
    rows = vector_rows(n, 64, 1) if n > 3 else vector_rows(150, 64, 2)[:n]
    got = centroid_clustering.clusters(spark.createDataFrame(rows, VECTORS).repartition(5), rounds=rounds).collect()
    assert sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == clusters_by_loop(rows, 8, rounds, 64)


def test_vectors_of_no_rows_and_too_large_ones(spark):
    none = spark.createDataFrame([], VECTORS)
    assert centroid_clustering.clusters(none).count() == 0
    assert hard_negatives.mined(none, F.lit(True), F.col("label")).count() == 0
    large = spark.createDataFrame([(1, [1e9] * 64, 1, "", "", "", "")], VECTORS)
    with pytest.raises(Exception, match="reaches 67108864"):
        centroid_clustering.clusters(large).count()


def negatives_by_loop(rows, every):
    kept = [(k, i, (lab + 1) % 10 if i % 7 == 0 else lab, whole(x, 256)) for k, (i, x, lab, *_) in enumerate(rows) if i is not None and lab is not None and finite(x)]
    out = []
    for k, i, lab, v in kept:
        if i % every:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, other, w in kept if len(w) == len(v)]
        for ps, p, m, _ in sorted(r for r in others if r[3] == lab and r[2] != k)[:5]:
            fit = sorted((s, j, mm) for s, j, mm, other in others if other != lab and -80 * ps <= -100 * s <= -100 * ps)
            out += [(i, p, rank + 1, j, -ps, -s) for rank, (s, j, _) in enumerate(fit[:5])]
    return sorted(out)


@pytest.mark.parametrize("block", [16384, 90])
def test_hard_negatives_equal_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ROWS", block)  # several blocks of anchors and rows
    rows = vector_rows(600, 64, 3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mined(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 4 == 0, label).collect()
    want = negatives_by_loop(rows, 4)
    assert len(want) > 1000
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) == want


@pytest.mark.parametrize("size", [1, 200, 3000])
def test_tree_search_equals_sorting(size):
    rng = np.random.default_rng(size)
    centres = rng.integers(-200, 200, (6, 16))
    x = centres[rng.integers(0, 6, size)] + rng.integers(-20, 20, (size, 16))
    x[: size // 3] = x[0]  # a third are copies
    tree = hard_negatives.Tree(x)
    assert sorted(tree.order.tolist()) == list(range(size)) and max(b - a for a, b in tree.leaves) <= hard_negatives.LEAF
    ids = rng.permutation(size)[tree.order]
    fits = rng.random(size) < 0.7
    stretch, away = tree.distances(x[:20])
    visited = 0
    for n in range(min(20, size)):
        score = x[tree.order] @ x[n]
        for lo, hi in ((-math.inf, math.inf), (np.quantile(score, 0.5), np.quantile(score, 0.9)), (score.max(), score.max()), (score.max() + 1, math.inf)):
            want = sorted((-int(score[p]), int(ids[p]), p) for p in np.flatnonzero(fits & (score >= lo) & (score <= hi)))[:5]
            assert tree.search(x[n], stretch[n], away[n], fits, ids, lo, hi, 5) == want
            visited += len(want)
    assert visited or size == 1


def test_tree_leaves_out_far_nodes(monkeypatch):
    """On separate clusters a search opens few leaves."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (40, 16))
    centres = np.rint(4000 * centres / np.linalg.norm(centres, axis=1, keepdims=True)).astype(np.int64)
    x = centres[np.arange(8000) % 40] + rng.integers(-9, 9, (8000, 16))
    tree = hard_negatives.Tree(x)
    opened = []

    class Rows:
        dtype = tree.x.dtype

        def __getitem__(self, part):
            opened.append(part)
            return held[part]

    stretch, away = tree.distances(x[:10])
    held, tree.x = tree.x, Rows()
    for n in range(10):
        tree.search(x[n], stretch[n], away[n], np.ones(8000, bool), np.arange(8000), -math.inf, math.inf, 5)
    assert len(opened) < 10 * len(tree.leaves) / 4


def sketch_by_loop(text):
    w = WORD.findall((text or "").translate(LOWER))
    h = {hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(w) - 4))} if w else set()
    return {x for x in h if x < "2000000000000000"} or set(sorted(h)[:1])


def fingerprints_by_loop(rows):
    ordered = [(i, t or "") for i, t in rows]
    out = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        a, b, c = sketch_by_loop(t), sketch_by_loop(edited), sketch_by_loop(following)
        like = lambda p, q: 1.0 if not p and not q else len(p & q) / len(p | q)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(a)), "".join(sorted(b)), like(a, b), like(a, c)))
    return out


def documents(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeFGH", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [None, "", "  \n", "one", "One", "é … ß \x1c x", "a b c d", "a b c d e", "😀" * 9 + " tail words here now"]
    texts += [" ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 40, 300]))) for _ in range(n)]
    texts[20] = texts[19]
    texts.append(" ".join(rng.choices(vocabulary, k=60_000)))
    return [(rng.randint(0, 3) + 7 * i, t) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, part string, guest string, at string, next_text string"


@pytest.mark.parametrize("per_range, quantiles", [(4096, 128), (2, 4), (1, 2)])
def test_fingerprints_equal_a_loop(spark, monkeypatch, per_range, quantiles):
    monkeypatch.setattr(fingerprints, "ROWS", per_range)
    monkeypatch.setattr(fingerprints, "QUANTILES", quantiles)
    rows = documents(120, 8)
    df = spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA).repartition(6)
    got = sorted(fingerprints.edited_and_next(df).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got] == fingerprints_by_loop(rows)


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [(5, "b b"), (5, "b b"), (None, "x y z"), (None, "p q"), (1, "first words of all")]
    got = fingerprints.edited_and_next(spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA))
    assert sorted(r.n_chars for r in got.collect()) == [3, 3, 3, 5, 18]
    lone = fingerprints.edited_and_next(spark.createDataFrame([(9, "a b c d e f g h", "", "", "", "")], SCHEMA)).collect()
    assert [r.near_next for r in lone] == [1.0]  # its own successor
    assert fingerprints.edited_and_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_merge_and_contain(spark):
    rng = random.Random(3)
    rows = []
    for n, m in ((2000, 60), (4, 4), (3000, 3000), (0, 5), (0, 0), (1, 900)):
        long_ = [f"w{rng.randrange(500)}" for _ in range(n)]
        rows.append((" ".join(long_), " ".join(long_[100 : 100 + m] or [f"u{k}" for k in range(m)])))
    df = spark.createDataFrame(rows, "a string, b string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "sa"), "b", "sb")
    for r in df.select("a", "b", "sa", "sb", fingerprints.merged(F.col("sa"), F.col("sb")).alias("m"), fingerprints.containment(F.col("sb"), F.col("sa")).alias("c")).collect():
        sa, sb = sketch_by_loop(r.a), sketch_by_loop(r.b)
        assert set(r.sa) == sa and set(r.sb) == sb
        low = {x for x in sa | sb if x < "2000000000000000"}
        assert set(r.m) == (low or set(sorted(sa | sb)[:1])) and r.m == sorted(r.m)
        assert r.c == (len(sa & sb) / len(sb) if sb else float(not sa))


def test_fingerprint_plan_is_native(spark):
    df = fingerprints.edited_and_next(spark.createDataFrame([(1, "a", "", "", "", "")], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_centroid_clustering", "op13_fingerprints"])
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = registry.queries()[name](spark, sf).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()[list(got.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))
