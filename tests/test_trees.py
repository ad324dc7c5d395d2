"""Whole trees, kernels over sorted rows and matching against plain loops."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from pagewright.operators import annotate, evaluate, reconcile, tables, tree
from pagewright.plans import kernels
from pagewright.sources import sinks

BLOCKS = "doc_id long, id long, pos long, page int, type string, content string, level int, contd long, image long, x1 double, y1 double, x2 double, y2 double"
KINDS = ["title", "title", "text", "text", "text", "list_item", "image", "table", "image_block", "image_caption", "table_footnote", "header", "page_number", "list", "chart"]


def document(rng, doc, n):
    rows = []
    for k in range(n):
        kind = rng.choice(KINDS)
        body = rng.choice(["", "word " * rng.randint(1, 60), "x" * rng.randint(1, 300), 'quote " and \\ and é\t'])
        level = rng.choice([-1, 0, 1, 1, 2, 3, 5]) if kind == "title" else -1
        shown = kind in tree.FIGURES or "caption" in kind or "footnote" in kind
        image = rng.randint(1, n) if shown and rng.random() < 0.7 else -1
        rows.append((doc, k + 1, k, k // 6 + 1, kind, body, level, rng.randint(1, n) if rng.random() < 0.3 else -1, image, 0.1 * (k % 7), 0.2, 0.5, 0.25))
    return rows


def place(r):
    return {"bbox": list(r[9:13]), "page": r[3]}


def tree_by_loop(rows, limit=500):
    """A tree of dicts by walking: text nodes on a stack, figures by search, furniture last."""
    rows = [list(r) for r in rows]
    for r in rows:
        if r[4] == "title" and r[6] < 0:
            r[4] = "text"
    node = lambda **k: {"type": "text", "title": "", "metadata": "", "content": "", "level": 1, "location": [], "block_ids": [], "subnode": [], "children": []} | k
    texts, seen = [node(title="Default Title")], set()
    for r in rows:
        if r[4] == "title":
            if texts[-1]["title"] == "Default Title" and texts[-1]["content"] == "":
                texts.pop()
            texts.append(node(title=r[5], level=r[6], location=[place(r)], block_ids=[r[1]]))
        elif r[4] not in tree.SPECIAL + tree.LARGE + tree.FURNITURE:
            if r[7] >= 0:
                seen.add(r[7])
            mark = "<|txt_contd|>" if r[1] in seen else "<|txt_split|>"
            t = texts[-1]
            t["content"] = t["content"] + mark + r[5] if t["content"] else r[5]
            t["location"].append(place(r))
            t["block_ids"].append(r[1])
    root = node(type="root", level=0)
    stack = [(0, root)]
    for t in texts:
        level = t["level"] if t["level"] > 0 else 100
        while stack[-1][0] >= level:
            stack.pop()
        stack[-1][1]["children"].append(t)
        stack.append((level, t))
    shown = {}
    for r in rows:
        if r[4] in tree.FIGURES:
            notes = [n for n in rows if n[8] == r[1] and ("caption" in n[4] or "footnote" in n[4])]
            join = lambda part: " ".join(n[5] for n in notes if part in n[4])
            shown[r[1]] = node(type=r[4], content=r[5], level=r[8], title=join("caption"), metadata=join("footnote"), location=[place(r), *map(place, notes)], block_ids=[r[1], *(n[1] for n in notes)])
    for i, f in shown.items():
        link = f["level"] if f["level"] >= 0 and f["level"] not in f["block_ids"] else None
        holders = [j for j, g in shown.items() if j != i and link in g["block_ids"]]
        if holders:
            shown[min(holders)]["children"].append(f)
            continue
        before = [r[1] for r in rows if r[4] == "title" and r[1] < min(f["block_ids"])]
        at = link if link is not None else max(before, default=None)
        for t in texts:
            if at in t["block_ids"]:
                t["children"].append(f)
                break
    names = set()
    for r in rows:
        if r[4] in tree.FURNITURE:
            name, k = f"Page {r[3]} - {r[4]}", 0
            while (name if not k else f"{name} - {k}") in names:
                k += 1
            name = name if not k else f"{name} - {k}"
            names.add(name)
            root["children"].append({k: v for k, v in node(type=r[4], title=name, metadata=r[5], content=r[5], level=-1, location=[place(r)], block_ids=[r[1]]).items() if k != "children"})
    for t in texts:
        pieces = [p for p in t["content"].replace("<|txt_contd|>", "<|txt_split|>").split("<|txt_split|>") if p]
        if len(t["content"]) <= limit:
            continue
        parts, now = [], []
        for k, p in enumerate(pieces, 1):
            now.append((k, p))
            if sum(len(q) for _, q in now) > limit:
                parts.append(now)
                now = []
        parts += [now] if now else []
        for k, part in enumerate(parts, 1) if len(parts) > 1 else ():
            at = [i - 1 for i, _ in part] if t["title"] == "Default Title" else [0, *(i for i, _ in part)]
            if max(at) < len(t["block_ids"]):
                t["subnode"].append({k: v for k, v in node(type="sub_text", title=f"{t['title']}_{k}", content="".join(p for _, p in part), location=[t["location"][i] for i in at], block_ids=[t["block_ids"][i] for i in at]).items() if k != "subnode"})
    for f in shown.values():
        if f["children"]:
            f["subnode"], f["children"] = f["children"], []
    return root


@pytest.mark.parametrize("seed, n, docs", [(1, 12, 30), (2, 60, 12), (3, 1, 3)])
def test_whole_trees_equal_a_walk(spark, seed, n, docs):
    rng = random.Random(seed)
    rows = {d: document(rng, d, n) for d in range(docs)}
    blocks = spark.createDataFrame([r for own in rows.values() for r in own], BLOCKS).repartition(3)
    got = {r.doc_id: r.json for r in sinks.tree_json(tree.whole(blocks)).collect()}
    assert set(got) == set(rows)
    for d, own in rows.items():
        assert json.loads(got[d]) == tree_by_loop(own)


def test_preorder_and_depth(spark):
    rng = random.Random(9)
    own = document(rng, 5, 80)
    flat, todo = [], [(tree_by_loop(own), 0)]
    while todo:
        node, depth = todo.pop()
        flat.append((node["title"], node["type"], depth))
        todo += [(c, depth + 1) for c in reversed([*node.get("subnode", []), *node.get("children", [])])]
    got = tree.whole(spark.createDataFrame(own, BLOCKS)).orderBy("preorder").collect()
    assert [(r.title, r.type, r.depth) for r in got] == flat and [r.preorder for r in got] == list(range(len(flat)))
    assert tree.whole(spark.createDataFrame([], BLOCKS)).count() == 0


def test_nearest_smaller_equals_a_scan(spark):
    rng = random.Random(2)
    rows = [(d, k * 3, rng.randint(1, 6)) for d in ("a", "b", None) for k in range(200)]
    got = {(r.doc_id, r.k): (r.parent, r.stop) for r in kernels.nearest_smaller(spark.createDataFrame(rows, "doc_id string, k long, value int").repartition(4)).collect()}
    for d, k, v in rows:
        same = [(j, w) for e, j, w in rows if e == d]
        assert got[d, k] == (max((j for j, w in same if j < k and w < v), default=None), min((j for j, w in same if j > k and w <= v), default=None))


def test_forest_leaves_out_circles(spark):
    rows = [(1, 5, 10, None, 7, 2), (1, 6, 11, 10, None, None), (1, 1, 12, 11, None, None), (1, 2, 13, 10, None, None), (1, 3, 20, 21, None, None), (1, 4, 21, 20, None, None), (1, 7, 30, None, None, None)]
    got = kernels.forest(spark.createDataFrame(rows, "doc_id int, ord int, id int, parent int, stop long, text_depth int")).orderBy("rank").collect()
    assert [(r.id, r.stop, r.text_depth, r.depth) for r in got] == [(10, 7, 2, 0), (13, 7, 2, 1), (11, 7, 2, 1), (12, 7, 2, 2)]


def test_matches_equal_the_greedy_loop(spark):
    rng = random.Random(6)
    rows = [(f"d{d}", f"g{rng.randint(0, 15)}", f"p{rng.randint(0, 15)}", rng.randint(0, 9) / 10, rng.random() < 0.8) for d in range(8) for _ in range(120)]
    got = evaluate.matches(spark.createDataFrame(rows, "doc_id string, gt_id string, pred_id string, score double, close boolean").repartition(5)).collect()
    want = {(d, *g) for d in {r[0] for r in rows} for g in evaluate.greedy([(s, a, b) for e, a, b, s, c in rows if e == d and c])}
    assert {(r.doc_id, r.gt_id, r.pred_id, r.score) for r in got} == want and len(got) == len(want)


def test_bounds_leave_out_no_match(spark):
    """Pairs are left out before their texts are compared only if they couldn't be matched."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcd", k=rng.randint(0, 12)))
    box = lambda: tuple(sorted([rng.random(), rng.random()]) + sorted([rng.random(), rng.random()]))
    side = [(f"d{k % 3}", f"i{k}", 1, rng.choice(["", word(), word() + " " + word() * 4]), rng.choice(["title", "text"]), *box()) for k in range(90)]
    other = [(d, f"p{k}", page, rng.choice([c, c[:5], word()]), t, x1, x2, y1, y2) for k, (d, _, page, c, t, x1, x2, y1, y2) in enumerate(side)]
    boxes = "x1 double, x2 double, y1 double, y2 double"
    truth = spark.createDataFrame([r[:4] + r[5:] for r in side], f"doc_id string, gt_id string, page int, content string, {boxes}")
    predicted = spark.createDataFrame(other, f"doc_id string, block_id string, page int, content string, type string, {boxes}")
    got = {(r.gt_id, r.pred_id): r.score for r in evaluate.candidates(truth, predicted).where("close").collect()}
    from pagewright.functions.text import similarity_of

    def box_score(a, b):
        w, h = max(0.0, min(a[1], b[1]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[2], b[2]))
        area = lambda q: max(0.0, q[1] - q[0]) * max(0.0, q[3] - q[2])
        both, small = area(a) + area(b) - w * h, min(area(a), area(b))
        return max(w * h / both if both > 0 else 0.0, w * h / small if small > 0 else 0.0)

    want = {}
    for d, g, _, c, _, *a in side:
        for e, p, _, k, t, *b in other:
            if d == e:
                box_, like = box_score(a, b), similarity_of("".join(c.split()), "".join(k.split()))
                score = 0.45 * box_ + 0.35 * like + 0.2 * (1.0 if t == "title" else 0.4)
                if score >= 0.35 and not (like < 0.45 and box_ < 0.8):
                    want[g, p] = score
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_chains_equal_a_search(spark):
    rng = random.Random(4)
    rows = [(d, k + 1, rng.random() * 0 + k, rng.choice([-1, rng.randint(1, 15), k + 1])) for d in range(6) for k in range(14)]
    rows = [(d, i, int(p), m) for d, i, p, m in rows]
    got = {(r.doc_id, r.id): r.base for r in tables.chains(spark.createDataFrame(rows, "doc_id int, id long, pos long, table_merge long")).collect()}
    want = {}
    for d in range(6):
        ids = {i for e, i, _, _ in rows if e == d}
        links = [(i, m) for e, i, _, m in rows if e == d and m in ids and m != i]
        label = {i: i for p in links for i in p}
        for _ in ids:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        want |= {(d, i): b for i, b in label.items()}
    assert got == want


def test_one_long_document(spark):
    """100,000 blocks of one document: trees, parents, levels and chunk borders in seconds."""
    from pagewright.operators import chunking

    n = 100_000
    kind = F.when(F.col("pos") % 4 == 0, "title").when(F.col("pos") % 9 == 0, "image").otherwise("text")
    blocks = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") + 1).alias("id"), F.col("id").alias("pos"), F.floor(F.col("id") / 8).cast("int").alias("page"), F.concat(F.lit("words "), F.col("id").cast("string")).alias("content"))
    blocks = blocks.withColumns({"type": kind, "level": (F.col("pos") % 7 + 1).cast("int"), "contd": F.lit(-1).cast("long"), "image": F.lit(-1).cast("long"), "x1": F.lit(0.1), "y1": F.lit(0.1), "x2": F.lit(0.2), "y2": F.lit(0.2)})
    began = time.time()
    assert tree.whole(blocks).count() > n / 4
    assert annotate.title_parents(blocks.where("type = 'title'")).where("parent is not null").count() > n / 8
    levels = blocks.select("doc_id", F.floor(F.col("pos") / 1000).cast("int").alias("range_sum"), F.col("pos").cast("int").alias("line_no"), F.floor(F.col("pos") * 0.9).cast("int").alias("id"), "level")
    assert reconcile.synchronized_levels(levels).count() == levels.select("id").distinct().count()
    assert chunking.ranges(spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page"))).count() > n / 60
    body = blocks.withColumn("type", F.when(F.col("pos") == 0, "title").otherwise("text"))
    assert tree.components(body).select(F.length("content")).first()[0] > n * 10
    assert time.time() - began < 90
