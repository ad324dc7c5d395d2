"""The ten operators against the tokenizers library, SQL-like loops and brute force on small fixtures with odd rows."""

import hashlib
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter
from math import log, log10
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import bpe, embedding_dedup, exact_dedup, kernels, language_id, lm_scoring, near_dedup, packing, quality, substring_dedup, url_filter
from pagewright.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [None, "", " ", "\n\t ", "a", "A", "é", "…", "x" * 5000, "a b", "A  B", "a\nb", "same text here", "same text here"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(400)]
    texts = list(ODD)
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 400))) for _ in range(60)]
    texts += base
    for t in base[:25]:  # near copies and passages inside other texts
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
        texts.append(" ".join(rng.choices(vocabulary, k=80)) + " " + " ".join(t.split()[:70]) + " " + " ".join(rng.choices(vocabulary, k=40)))
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "s", 5, "", ""), (14, texts[14], "en", "s", 0, "", "")]  # a null id, a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def grouped(links, ids):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_words_and_hashes_match_the_pattern():
    texts = [*ODD, "Ünï côdé \x0b x", "\x1c\x85 b"]
    offs, data = kernels.buffers(pa.array(texts))
    h, starts, ends, first = kernels.words(data, offs)
    got = [data[a:b].tobytes().decode().translate(LOWER) for a, b in zip(starts, ends)]
    want = [w for t in texts for w in words(t)]
    assert got == want and np.diff(first).tolist() == [len(words(t)) for t in texts]
    assert len(set(h.tolist())) == len(set(want)) and len({*zip(want, h.tolist())}) == len(set(want))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + k, 401 + k) for k in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    used = {x for p in links if p[0] != p[1] for x in p}
    want = grouped(links, {x for p in links for x in p})
    assert got == {k: want[k] for k in used}


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://A.org/x", "https://example.org/es/1?x", "http://w.example.org/en/12", "http://example.org", "http://a.com/de/", "ftp://com/fr/x#y", "http://xorg/", "http://é.org/é"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://a.org/", "")], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, [("org/", False), ("example.org/es/", True), ("example.org/en/1", True), ("com/fr/", False), ("com/de/", True)]).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.org", "/x", "org/", "allow") and got[4][2:] == ("example.org/es/", "block") and got[5][2:] == ("example.org/en/1", "block")
    assert got[6] == ("example.org", "", None, "allow") and got[7][2:] == ("com/de/", "block") and got[8][:3] == ("com", "/fr/x", "com/fr/") and got[9][2] is None
    assert url_filter.judge_urls(pages.limit(0), [("a/", True)]).count() == 0 and url_filter.judge_urls(pages, []).where("verdict = 'allow'").count() == 12


def test_digest_collisions_are_confirmed(tmp_path):
    path = str(tmp_path / "r.bin")
    url_filter.DigestArray.write(path, [("a.b/", True), ("c.d/", False)])
    array = url_filter.DigestArray(path)
    for text in (b"a.b/", b"c.d/", b"not stored/"):  # as if all digests were that of the text
        array.keys = np.full(2, xxhash.xxh64_intdigest(text), np.uint64)
        k = int(array.find([text])[0])
        assert (array.stored(k) if k >= 0 else None) == (None if text == b"not stored/" else text)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(docs, width):
    rows = [p for p in pairs(docs) if p[0] is not None]
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = grouped(links, sets)
    got = near_dedup.components_of(docs, width).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_dedup.components_of(docs.limit(0)).count() == 0


def test_word_bpe_equals_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    k = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.digests(docs, path).collect()}
    for i, t in pairs(docs):
        ids = k.encode(t or "", add_special_tokens=False).ids
        r = got[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(k.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("name", ["word", "byte"])
def test_tokenizers_on_mixed_characters(name):
    own = bpe.word_bpe(public_tokenizers.path("word_bpe_49k.json")) if name == "word" else packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    k = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json" if name == "word" else "byte_bpe_50k.json"))
    rng = random.Random(2)
    parts = ["a", "B", " ", "  ", "'s", "'", "''", "'LL", "'re", "é", "ß", "İ", "Σ", "ς", "1", "½", "²", "\n", "\t", "\x85", "　", "\x1c", "😀", "é", "<|endoftext|>", "<|startoftext|>", "中文", "the", "--", "​", "\x00", "한", "ﬁ", "Ɤ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    assert [i.tolist() for i in own.ids(texts)] == [e.ids for e in k.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_of_ids_and_texts(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    k = Tokenizer.from_file(path)
    got = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs, path), path).collect()}
    assert all(got[i] == k.decode(k.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in pairs(docs))


def test_packing_places_every_id_once(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    k = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path).collect()
    ids = {}
    for i, t in pairs(docs):
        ids.setdefault(i, []).append([*k.encode(t or "", add_special_tokens=False).ids, 0])
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        own = ids[p.doc_id][0][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id][0]) and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    for i, own in by_doc.items():
        assert sum(p.length for p in own) == sum(map(len, ids[i]))
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0
    assert packing.pack(docs.limit(0), path).count() == 0


def test_exact_duplicates_match_a_loop(docs):
    rows = pairs(docs)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    want = Counter((i, min((x for x in groups[normal(t)] if x is not None), default=None), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)
    got = exact_dedup.decisions(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and {normal(r.text) for r in kept.collect()} == set(groups)
    assert exact_dedup.decisions(docs.limit(0)).count() == 0


def test_exact_duplicates_go_by_row(spark):
    """Repeated ids with different texts, null ids, repeated rows, clashing columns; many runs."""
    rows = [(3, "same", "a"), (5, "same", "b"), (5, "only here", "c"), (None, "same", "d"), (None, "nobody", "e"), (None, "nobody", "f"), (7, None, "g"), (8, "", "h"), (8, "", "h"), (9, " ", "i")]
    rows += [(100 + k, "frequent  text", "j") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(23)
    kept = Counter((r.doc_id, r.text) for r in exact_dedup.deduplicate(df).collect())
    assert kept == Counter({(3, "same"): 1, (5, "only here"): 1, (None, "nobody"): 1, (7, None): 1, (9, " "): 1, (100, "frequent  text"): 1})
    assert exact_dedup.deduplicate(df).columns == df.columns and exact_dedup.deduplicate(df.limit(0)).count() == 0
    got = exact_dedup.decisions(df).where("group_size = 300").collect()
    assert len(got) == 300 and {r.keep_id for r in got} == {100} and [r.doc_id for r in got if r.kept] == [100]
    plan = exact_dedup.deduplicate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_runs_are_sorted_and_merged_in_the_plan_that_runs(spark):
    """A round sorts its entries by digest and id and passes over them once; no hash aggregation does it instead."""
    df = spark.createDataFrame([(k, f"text {k % 7}") for k in range(60)], "doc_id long, text string").repartition(5)
    entries = exact_dedup.entries_of(df, "doc_id", "text").withColumn("n", F.lit(1).cast("long"))
    merged = exact_dedup.merged(entries, 0)
    held = merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Sort \[run.*digest.*size.*second.*doc_id", plan) and "Window" in plan and "HashAggregate" not in plan
    assert len({(r.run, bytes(r.digest)) for r in held}) == len(held) > 7 and sum(r.n for r in held) == 60
    levels = exact_dedup.rounds(entries.drop("n"))
    assert {(r.doc_id, r.n) for r in levels[-1].collect()} == {(k, 9 if k < 4 else 8) for k in range(7)}


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in np.float32(base[i % 40] + 0.25 * rng.standard_normal(16) * (i % 3))], 0) for i in range(200)]
    rows += [(200, rows[0][1], 1), (201, None, 0), (202, [0.0] * 16, 0), (203, [float("nan")] + [1.0] * 15, 0), (204, [None] + [1.0] * 15, 0), (205, [1.0, 2.0], 0), (206, [], 0), (None, rows[1][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    x = np.array([r[1] for r in rows[:201]], np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    want = grouped([(int(a), int(b)) for a, b in zip(*np.nonzero(link))], range(207))
    found = 0
    for r in embedding_dedup.near_duplicates(df).collect():
        if r.vec_id is not None:
            n = int(link[r.vec_id].sum()) if r.vec_id < 201 else 0
            found += r.n_links
            assert r.n_links <= n and r.component_id == want[r.vec_id] and r.kept == (r.vec_id == want[r.vec_id])
    assert found >= 0.98 * link.sum()
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_crowded_region_is_compared_whole():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 2**52, 120).astype(np.uint64)
    sets = []
    for k in range(700):  # more than CROWD; a hundred of them carry one label already
        own = base.copy()
        n = int(rng.integers(4, 45))
        own[rng.choice(120, n, replace=False)] = rng.integers(1, 2**52, n).astype(np.uint64)
        sets.append(np.unique(own))
    label = np.where(np.arange(700) % 7, np.arange(700), 0).astype(np.int64)
    zero = pa.array(np.zeros(700, np.int32))
    batch = pa.RecordBatch.from_arrays([zero, zero.cast(pa.int64()), zero, zero, pa.array(np.arange(700)), pa.array(label), pa.array([x.tobytes() for x in sets], pa.binary())], names=["t", "region", "i", "j", "rep", "label", "shingles"])
    got = [(r["a"], r["b"]) for out in near_dedup._links_between(iter([batch]), 80) for r in out.to_pylist()]
    plain = [set(x.tolist()) for x in sets]
    links = [(a, b) for a in range(700) for b in range(a) if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])]
    nodes = set(label.tolist())
    want = grouped([(int(label[a]), int(label[b])) for a, b in links], nodes)
    assert grouped(got, nodes) == want and 1 < len(set(want.values())) < 600 and len(got) < 600


def test_language_spans_and_held_out_accuracy(spark):
    rng = random.Random(6)
    syllables = {"aa": ["the", "ing", "wh", "ou"], "bb": ["der", "sch", "ung", "ei"], "cc": ["привет", "мир", "да"]}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(n))
    rows = [(i, make(lang, 30), lang) for i, lang in enumerate(rng.choices(["aa", "bb", "cc"], k=300))]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 !?", "bb"), (None, make("aa", 9), "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predictions(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:300]) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == "und" for i in (1000, 1001, 1002)) and got[5].held_out == (zlib.crc32(b"5") % 5 == 0)
    model = language_id.fit(df)
    assert [s[2] for s in model.spans(make("aa", 20) + " " + make("bb", 20))] == ["aa", "bb"]
    assert language_id.predictions(df.where("lang is null")).where("lang_pred = 'und'").count() == 1


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    model = language_id.Model(["a", "b", "c"], np.ones((3, (1 << language_id.BITS) + len(language_id.SCRIPTS))))
    scores = rng.standard_normal((23, 3)).astype(np.float32) * 3
    first = np.array([0, 6, 6, 13, 23])
    path = model.paths(scores, first, 2.0)
    worth = lambda p, s: sum(s[k][x] for k, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
    import itertools

    for a, b in zip(first[:-1], first[1:]):
        best = max((worth(p, scores[a:b]) for p in itertools.product(range(3), repeat=min(b - a, 8))), default=0) if b - a <= 8 else None
        if best is not None and b > a:
            assert abs(worth(path[a:b].tolist(), scores[a:b]) - best) < 1e-4


@pytest.mark.parametrize("block", [1, 3, 512])
def test_viterbi_in_blocks_is_as_good_as_word_by_word(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], np.ones((3, (1 << language_id.BITS) + len(language_id.SCRIPTS))))
    first = np.concatenate([[0], np.cumsum(rng.integers(0, 40, 60))])
    scores = (rng.standard_normal((first[-1], 3)) * 3).astype(np.float32)
    barred = rng.random(scores.shape) < 0.2
    barred[np.arange(len(scores)), rng.integers(0, 3, len(scores))] = False
    scores[barred] = -np.inf
    path = model.paths(scores, first, 2.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        best = [0.0] * 3
        for k in range(a, b):
            best = [max(v - 2.0 * (m != n and k > a) for m, v in enumerate(best)) + float(scores[k][n]) for n in range(3)]
        worth = sum(float(scores[k][path[k]]) for k in range(a, b)) - 2.0 * sum(path[k] != path[k - 1] for k in range(a + 1, b))
        assert abs(worth - max(best)) < 1e-3


def test_scripts_are_those_of_the_code_points():
    import unicodedata

    names = {"LATIN": "latin", "GREEK": "greek", "CYRILLIC": "cyrillic", "ARMENIAN": "armenian", "HEBREW": "hebrew", "ARABIC": "arabic", "DEVANAGARI": "indic", "TAMIL": "indic", "THAI": "thai", "GEORGIAN": "georgian", "HIRAGANA": "kana", "KATAKANA": "kana", "CJK": "han", "HANGUL": "hangul", "LAO": "other", "ETHIOPIC": "other"}
    letters = [(c, names[name]) for c in map(chr, range(0x30000)) if c.isalpha() and (name := unicodedata.name(c, "?").split()[0]) in names and ord(c) not in range(0x10000, 0x20000)]
    text = "".join(c for c, _ in letters).encode()
    got = language_id.scripts(np.frombuffer(text, np.uint8))
    got = got[[k for k, b in enumerate(text) if b & 0xC0 != 0x80]]
    wrong = [(hex(ord(c)), want, language_id.SCRIPTS[k]) for (c, want), k in zip(letters, got, strict=True) if language_id.SCRIPTS[k] != want]
    assert len(letters) > 100_000 and len(wrong) < 0.001 * len(letters), wrong
    assert not language_id.scripts(np.frombuffer("12 … × ÷ 😀 •".encode(), np.uint8)).any()


def test_word_scores_are_a_plain_count_and_narrowed(spark):
    rows = [(1, "abba abc", "x"), (2, "bca ab ภาษา", "y"), (3, "мир Abc", "z")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "true")
    cells = 1 << language_id.BITS

    def grams(word):
        w = b" " + word.encode().lower() + b" "
        return [(((w[k - 1] << 16 | w[k] << 8 | w[k + 1]) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - language_id.BITS) for k in range(1, len(w) - 1)]

    count = {lang: Counter(g for w in text.split() for g in grams(w)) for _, text, lang in rows}
    script = {"abc": ["x", "y", "z"], "ภา": ["y"], "да": ["z"], "ქართ": ["x", "y", "z"], "12": ["x", "y", "z"]}
    for word, candidates in script.items():
        data = np.frombuffer(word.encode(), np.uint8)
        cell, begin, _, of, _ = language_id.trigrams(data, np.array([0, len(data)]))
        got = dict(zip(model.langs, model.word_scores(cell, begin, of)[0], strict=True))
        want = {lang: sum(log((count[lang][g] + 0.2) / (sum(count[lang].values()) + 0.2 * cells)) for g in grams(word)) for lang in candidates}
        for lang in model.langs:
            assert abs(got[lang] - (want[lang] - max(want.values()))) < 1e-3 if lang in want else got[lang] == -np.inf


def test_language_of_no_rows_and_of_very_long_texts(spark):
    rows = [(i, ("the wing " if i % 2 else "der sprung ") * 20, "aa" if i % 2 else "bb") for i in range(40)]
    df = spark.createDataFrame(rows + [(100, "the wing " * 150_000 + "sprung", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.predictions(df).collect()}[100] == "aa"
    assert language_id.predictions(df.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark, docs):
    rng = random.Random(7)
    good = lambda: " ".join("".join(rng.choices("etaoin", k=rng.randint(2, 8))) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(["###", "$$", "buy"]) for _ in range(60))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)]
    df = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.scores(df, labels).collect()}
    assert len(got) == 402 and all(got[i].predicted == int(i % 4 > 0) for i in range(400)) and all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in quality.accepted(df, labels).collect()} >= {i for i in range(400) if i % 4}
    assert {r.score for r in quality.scores(df, labels.limit(0)).collect()} == {0.5}
    assert quality.scores(docs.limit(0), labels).count() == 0


def test_discriminant_equals_a_plain_computation():
    """Tempered Gaussian log densities with shrunken covariances, by determinants and inverses instead of Cholesky factors."""
    rng = np.random.default_rng(5)
    d = len(quality.NAMES)
    x = {c: rng.standard_normal((60 + 200 * c, d)) * (1 + c) + c for c in (0, 1)}
    model = quality.fitted({c: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]) for c, v in x.items()})
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / sum(map(len, x.values()))

    def log_density(row, c):
        alpha = max(0.1, d / (d + len(x[c])))
        s = (1 - alpha) * np.cov(x[c].T, bias=True) + alpha * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 1e-3 * np.eye(d)
        gap = row - x[c].mean(0)
        return np.log(len(x[c]) / 320) - 0.5 * (np.linalg.slogdet(s)[1] + gap @ np.linalg.inv(s) @ gap)

    rows = rng.standard_normal((40, d)) * 2
    want = [1 / (1 + np.exp(-0.06 * (log_density(r, 1) - log_density(r, 0)))) for r in rows]
    assert np.allclose(model.score(rows), want, atol=1e-9)


def test_lm_counts_match_a_loop(docs):
    rows = pairs(docs)
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    count = Counter(w for i, t in rows if train(i) for w in [*words(t), ("end",)])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        own = [*words(t), ("end",)]
        want[i, not train(i), len(own), sum(count[w] > 0 for w in own), n, round(sum(log10((count[w] + 1) / (n + v + 1)) for w in own), 6)] += 1
    got = lm_scoring.scores(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.scores(docs.limit(0)).count() == 0


def lm_weight(count, total, types):
    """The backoff weight of a token after its context, by the definition."""

    def p(g):
        if len(g) == 1:
            return (count[g] + 1) / (total + types + 1)
        c = count[g[:-1]]
        if not c:
            return p(g[1:])
        passed = lm_scoring.PAIR_MASS * c**-lm_scoring.PAIR_FALL if len(g) == 2 else lm_scoring.TRIPLE_MASS
        return (1 - passed) * count[g] / c + passed * p(g[1:])

    return p


def lm_want(rows, learn):
    count = Counter()
    for i, w in rows:
        if learn(i):
            for n in (1, 2, 3):
                for k in range(len(w) - n + 1):
                    count[tuple(w[k : k + n])] += 1
    total = sum(len(w) - 1 for i, w in rows if learn(i))
    types = sum(len(g) == 1 and g != ("<",) for g in count)
    p = lm_weight(count, total, types)
    return Counter((i, round(sum(log10(p(tuple(w[max(0, k - 2) : k + 1]))) for k in range(1, len(w))), 5)) for i, w in rows), p, count


@pytest.mark.parametrize(("stretch", "part"), [(512, 2_000_000), (3, 700)])
def test_lm_scores_equal_a_direct_backoff_computation(docs, monkeypatch, stretch, part):
    """In one part or many, and where the walk is cut into short stretches."""
    monkeypatch.setattr(lm_scoring, "STRETCH", stretch)
    rows = [(i, ["<", *words(t), None]) for i, t in pairs(docs)]
    want, p, count = lm_want(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2)
    assert Counter((r.doc_id, round(r.score, 5)) for r in lm_scoring.scores(docs, part_tokens=part).collect()) == want
    every = [g for g in count if len(g) == 1 and g != ("<",)]
    for context in [("<",), *[g for g in count if len(g) == 2 and None not in g][:5]]:
        assert abs(sum(p((*context, *g)) for g in every) + p((*context, "no such word")) - 1) < 1e-9


def test_held_out_texts_move_no_other_score(spark, docs):
    rows = [r for r in pairs(docs) if r[0] is not None]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    other = spark.createDataFrame([(i, "other words here " * 50 if i in held else t) for i, t in rows], "doc_id long, text string")
    of = lambda d: Counter((r.doc_id, round(r.score, 9)) for r in lm_scoring.scores(d).where("not held_out").collect())
    assert len(held) > 5 and of(spark.createDataFrame(rows, "doc_id long, text string")) == of(other)


def test_counts_over_one_byte_and_long_texts(spark):
    """A word of over 255 occurrences in a part, a text beyond one slice, one that occurs twice."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["the", "of", f"w{rng.randrange(3000)}"]) for _ in range(120_000))
    rows = [(1, long), (2, "the " * 900), (3, "the of"), (4, "w1 w2 unseen")]
    want, _, _ = lm_want([(i, ["<", *words(t), None]) for i, t in rows], lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    got = Counter((r.doc_id, round(r.score, 5)) for r in lm_scoring.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert dict(got.keys()) == {i: pytest.approx(s, abs=1e-4) for i, s in want}


def test_repeated_passages_match_brute_force(docs):
    text = {i: words(t) for i, t in pairs(docs) if i is not None}
    covered = {}
    for r in substring_dedup.repeats(docs).collect():
        a, b = text[r.doc_id][r.start : r.start + r.length], text[r.source_id][r.source_start : r.source_start + r.length]
        assert r.source_id < r.doc_id and len(a) == len(b) == r.length >= 50
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    seen = {}
    for i in sorted(text):
        for k in range(len(text[i]) - 49):
            window = tuple(text[i][k : k + 50])
            if seen.setdefault(window, i) != i:
                assert set(range(k, k + 50)) <= covered.get(i, set())
    assert substring_dedup.repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("size", "cut"), [(60, 0), (80, 0), (98, 0), (60, 1), (98, 3)])
def test_inserted_and_deleted_words_stay_in_a_passage(size, cut):
    """One word put in, or ``cut`` words taken out, in the middle, where each half is under 50 words."""
    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**63, 64 + size + 64, dtype=np.uint64)
    mid = 64 + size // 2
    other = np.concatenate([rng.integers(0, 2**63, 70, dtype=np.uint64), base[64:mid], base[mid + cut : 64 + size] if cut else np.append(np.uint64(7), base[mid : 64 + size]), rng.integers(0, 2**63, 70, dtype=np.uint64)])
    for x, y, off in ((base, other, -6), (other, base, 6)):
        ((a, b, c),), equal = substring_dedup.passages(x, y, off)
        assert not equal
        assert (a, c) == ((64, 70) if x is base else (70, 64)) and b == (64 + size if x is base else len(other) - 70)


def test_copies_with_an_inserted_word_are_found(spark):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(100):
        p = text(98)
        rows += [(2 * k, " ".join(text(80) + p + text(80))), (2 * k + 1, " ".join(text(90) + p[:49] + ["more"] + p[49:] + text(70)))]
    got = {r.doc_id for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("start <= 92 and start + length >= 187").collect()}
    assert len(got) >= 90


def test_a_smaller_document_with_a_part_hides_no_pair(spark):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(0, 600, 3):
        p, lead = text(52), text(60)
        # The middle alone, twice, stands in a smaller document; then two documents have the whole passage.
        rows += [(k, text(40) + p[3:49] + text(30) + p[3:49] + text(40)), (k + 1, text(70) + p + text(70)), (k + 2, lead + p + text(50))]
        want[k + 2] = (60, 112)
    got = {}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    for r in substring_dedup.repeats(frame).collect():
        assert rows[r.doc_id][1][r.start : r.start + r.length] == rows[r.source_id][1][r.source_start : r.source_start + r.length]
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    assert got == {i: set(range(*span)) for i, span in want.items()}


def test_numbers_of_runs_come_back():
    rng = np.random.default_rng(8)
    values = rng.integers(-(2**62), 2**62, 1000)
    values[:300] %= 1000
    ends = np.sort(np.concatenate([[0, 0, 1000], rng.integers(0, 1000, 40)]))
    column = substring_dedup.blobs(values, ends)
    assert (substring_dedup.unblobbed(column, np.int64) == values).all()
    assert (substring_dedup.unblobbed(column.slice(5, 10), np.int64) == values[ends[5] : ends[15]]).all()
    assert not len(substring_dedup.unblobbed(substring_dedup.blobs(values[:0], np.zeros(1, np.int64)), np.int64))


def test_pairs_verified_together_equal_those_alone():
    rng = np.random.default_rng(9)
    pairs = []
    for k in range(120):  # copies with edits, moved by some words; repeated words; texts with nothing in common
        x = rng.integers(0, [2**60, 40][k % 2], rng.integers(5, 300)).astype(np.uint64)
        moved = int(rng.integers(0, 9))
        y = np.concatenate([rng.integers(0, 2**60, moved).astype(np.uint64), np.delete(x, rng.integers(0, len(x), k % 4))])
        if len(y) < substring_dedup.WIDTH or k % 10 == 9:
            y = rng.integers(0, 2**60, 80).astype(np.uint64)
        pairs.append((x, y, -moved))
    shingled = [[kernels.shingles(w, np.array([0, len(w)]), substring_dedup.WIDTH)[0][: len(w) - substring_dedup.WIDTH + 1] for w in p[:2]] for p in pairs]
    x, y = zip(*shingled, strict=True)
    sizes = [np.array([len(w) for w in side]) for side in (x, y)]
    near, equal = substring_dedup.passages_of(np.concatenate(x), sizes[0], np.concatenate(y), sizes[1], np.array([p[2] for p in pairs]))
    for k, pair in enumerate(pairs):
        alone = substring_dedup.passages(*pair)
        for together, found in zip((near, equal), alone, strict=True):
            assert [tuple(r) for r in together[together[:, 0] == k][:, 1:].tolist()] == found
    assert len(near) > 30 and len(equal) > 10


def test_windows_are_the_wide_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 700, dtype=np.uint64)
    begin, end = np.repeat([0, 500, 510], [500, 10, 190]), np.repeat([500, 510, 700], [500, 10, 190])
    left, centre, right = substring_dedup.windows(h, begin, end, np.uint64(5))
    key = kernels.mixed(h ^ np.uint64(5)) >> np.uint64(27)

    def nodes(lo, hi):
        if hi - lo < 46:
            return []
        c = lo + int(np.argmin(key[lo:hi]))
        return [(lo, c, hi - 1), *nodes(lo, c), *nodes(c + 1, hi)]

    want = sorted([*nodes(0, 500), *nodes(500, 510), *nodes(510, 700)], key=lambda x: x[1])
    assert list(zip(left.tolist(), centre.tolist(), right.tolist())) == want


def test_cutting_keeps_the_first_copy(docs):
    whole = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    cut = substring_dedup.without_repeats(whole, 20_000)
    assert cut.columns == docs.columns and cut.count() == whole.count()
    before, after = {r.doc_id: r.text for r in whole.collect()}, {r.doc_id: r for r in cut.collect()}
    assert sum(before[i] != after[i].text for i in before) > 10
    assert all(after[i].n_chars == len(after[i].text) for i in before if before[i] is not None and before[i] != after[i].text)
    assert substring_dedup.repeats(cut).count() == 0 or substring_dedup.repeats(cut).count() < substring_dedup.repeats(whole).count()


def test_cutting_goes_by_row(spark):
    """Two texts of one id, repeated rows, a null id, null texts and clashing columns."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p, other, lead = text(60), text(120), text(20)
    rows = [(1, p + " " + text(30), 0), (2, lead + " " + p, 0), (2, other, 0), (2, other, 1), (None, p, 0), (3, None, 0), (4, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({"__spans": F.lit("x"), "cut": F.lit(1), "part": F.lit("y")})
    got = substring_dedup.without_repeats(df)
    assert got.columns == df.columns and substring_dedup.without_repeats(df.limit(0)).count() == 0
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, rows[0][1]), (2, lead + " "), (2, other), (2, other), (None, p), (3, None), (4, "")])


def test_a_passage_of_one_word_is_whole(spark):
    rows = [(0, "x " + "the " * 90 + "y"), (1, "z " * 3 + "the " * 200 + "u"), (2, "v " + "the " * 60)]
    got = {i: set() for i in range(3)}
    for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id] |= set(range(r.start, r.start + r.length))
    assert got[0] == set() and got[1] == set(range(3, 203)) and got[2] == set(range(1, 61))


def test_many_documents_share_a_passage(spark):
    """Rows follow the texts, not the pairs; parts and buckets of few rows."""
    rng = random.Random(10)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p = text(70)
    df = spark.createDataFrame([(i, f"{text(rng.randrange(30, 60))} {p} {text(30)}") for i in range(400)], "doc_id long, text string")
    for size in (12_000_000, 30_000):
        got = substring_dedup.repeats(df, part_bytes=size).collect()
        assert len(got) == 399 and {r.doc_id for r in got} == set(range(1, 400)) and all(70 <= r.length <= 72 for r in got)


def test_decoys_with_both_ends_hide_no_near_copy(spark):
    """Before each of two near copies stands a smaller document with both ends of the passage, but not next to each other."""
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(0, 800, 4):
        one, two = text(47), text(47)
        decoy = lambda: text(40) + one + text(rng.randrange(30, 60)) + two + text(40)  # noqa: B023, E731
        lead = text(60)
        rows += [(k, decoy()), (k + 1, text(70) + one + text(4) + two + text(70)), (k + 2, decoy()), (k + 3, lead + one + text(4) + two + text(50))]
        want[k + 3] = (60, 158)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    for size in (8_000_000, 40_000):
        got = {}
        for r in substring_dedup.repeats(frame, part_bytes=size).collect():
            got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
        whole = sum(set(range(a, b)) <= got.get(i, set()) for i, (a, b) in want.items())
        assert whole >= 0.97 * len(want) and set(got) <= set(want)


@pytest.mark.parametrize("size", [8_000_000, 60_000])
def test_decoys_on_all_sides_hide_no_near_copy(spark, size):
    """Many smaller documents hold an edited passage with more edits: each partner by signatures, or by pairs of them, may be one of them."""
    rng = random.Random(31)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for _ in range(40):
        one, two = text(42), text(42)

        def decoy():  # a word in twelve is another one
            p = one + text(1) + two
            for at in range(rng.randrange(12), len(p), 12):
                p[at : at + 1] = text(1)
            return text(40) + p + text(40)

        decoys = lambda n: [decoy() for _ in range(n)]  # noqa: B023, E731
        whole = lambda lead: text(lead) + one + text(1) + two + text(40)  # noqa: B023, E731
        rows += [*decoys(6), whole(70), *decoys(24)]
        want[len(rows)] = (60, 145)
        rows += [whole(60), *decoys(2)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {}
    for r in substring_dedup.repeats(frame, part_bytes=size).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    assert all(set(range(x, y)) <= got.get(i, set()) for i, (x, y) in want.items()) and set(got) == set(want)


def test_a_near_copy_that_its_document_repeats_is_found_at_both_places(spark):
    """Decoys hide a near copy from all partners; the second place of it equals the first one, which has no equal passage elsewhere."""
    rng = random.Random(51)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for _ in range(30):
        one, two = text(42), text(42)

        def decoy():  # a word in twelve is another one
            p = one + text(1) + two
            for at in range(rng.randrange(12), len(p), 12):
                p[at : at + 1] = text(1)
            return text(40) + p + text(40)

        twice = one + text(1) + two
        rows += [*(decoy() for _ in range(6)), text(70) + one + text(1) + two + text(40), *(decoy() for _ in range(24))]
        want[len(rows)] = {*range(60, 145), *range(175, 260)}
        rows.append(text(60) + twice + text(30) + twice + text(40))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {}
    for r in substring_dedup.repeats(frame, part_bytes=60_000).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    assert all(w <= got.get(i, set()) for i, w in want.items()) and set(got) == set(want)


def test_a_decoy_in_the_part_of_a_copy_hides_no_near_copy(spark):
    """Two parts: one has the first copy of an edited passage, the other a decoy that stands for the second copy there."""
    rng = random.Random(41)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    families, want, rows = [], {}, []
    for _ in range(60):
        one, two = text(42), text(42)
        whole = lambda lead: text(lead) + one + text(1) + two + text(40)  # noqa: B023, E731
        families.append((whole(70), text(40) + one + text(60) + two + text(40), whole(60)))
    size = sum(len(" ".join(w)) for f in families for w in f)
    parts = [r.part for r in spark.range(6000).selectExpr("pmod(xxhash64(id), 2) as part").collect()]
    at = 0
    for first, *others in families:
        for k, words in enumerate([first, *others]):
            at = next(i for i in range(at + 1, 6000) if parts[i] == (k > 0))
            rows.append((at, " ".join(words)))
        want[at] = (60, 145)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in substring_dedup.repeats(frame, part_bytes=size // 2 + 200).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    assert all(set(range(x, y)) <= got.get(i, set()) for i, (x, y) in want.items()) and set(got) == set(want)


def test_families_of_edited_copies_against_brute_force(spark):
    """Ten edited copies each, none with 50 equal words in a row: every copy near an earlier one, by comparison of all pairs, is found."""
    rng = random.Random(22)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, passage = [], {}
    for _ in range(40):
        base = text(rng.randrange(60, 200))
        for _ in range(10):
            p = list(base)
            for at in range(rng.randrange(10, 45), len(p), 45):
                if rng.random() < 0.6:
                    p[at] = text(1)[0]
            i = len(rows)
            rows.append((i, " ".join(text(rng.randrange(20, 80)) + p + text(30))))
            passage[i] = (i // 10, shingles(p))
    want = {i for i, (f, x) in passage.items() if any(g == f and len(x & y) >= 0.8 * len(x | y) for j, (g, y) in passage.items() if f * 10 <= j < i)}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (8_000_000, 60_000):
        got = {r.doc_id for r in substring_dedup.repeats(frame, part_bytes=size).collect()}
        assert len(want & got) >= 0.97 * len(want)


def test_no_part_is_asked_for_what_all_share(spark):
    """Candidates of a passage that all documents have are spread over the parts."""
    rng = random.Random(23)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p = text(70)
    df = spark.createDataFrame([(i, f"{text(40)} {p} {text(30)}") for i in range(3000)], "doc_id long, text string")
    per_part = sorted(r["count"] for r in substring_dedup.candidates(df, part_bytes=30_000)[1].where(f"kind = {substring_dedup.CANDIDATE}").groupBy("part").count().collect())
    assert len(per_part) > 30 and per_part[-1] <= 3 * per_part[len(per_part) // 2]


def test_near_duplicates_go_by_row(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p, other = text(90), text(50)
    rows = [(3, p), (5, p + " more"), (5, other), (None, p), (None, text(40)), (7, None), (8, ""), (8, ""), (9, "one"), (9, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__maybe": F.lit(1), "key": F.lit("x"), "kept": F.lit("y")})
    got = near_dedup.deduplicate(df)
    assert got.columns == df.columns and near_dedup.deduplicate(df.limit(0)).count() == 0
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(3, p), (5, other), rows[4], (7, None), (8, ""), (9, "one")])


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < got.select("doc_id").distinct().count() < d.count()
    assert got.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` != `max(doc_tokens)`").count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Repeated ids with other texts, null ids and texts, repeated rows, clashing columns: what must stay, stage by stage."""
    import corpus_pipeline

    rng = random.Random(12)
    good = lambda n=60: " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(n)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(["###", "$$", "buy"]) for _ in range(60))
    rows = [(i, good() if i % 4 else bad()) for i in range(200)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(200)]
    same, near, passage = good(), good(120), good(70)
    first, second = f"{good(40)} {passage} {good(40)}", f"{good(50)} {passage} {good(50)}"
    odd = [(303, same), (305, same), (305, good()), (305, near), (306, near + " end"), (None, same), (None, good()), (307, good()), (308, first), (309, second)]
    odd += [(307, odd[7][1])]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumns({"__maybe": F.lit("m"), "key": F.lit(1), "n_chars": F.length("text").cast("long")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(Counter((r.doc_id, r.text) for r in docs.collect()))
    assert kept[0] == Counter([r for r in rows if r[0] % 4] + odd)
    exact = kept[0] - Counter([(305, same), (None, same), (307, odd[7][1])])
    assert kept[1] == exact
    assert kept[2] == exact - Counter([(306, near + " end")])
    cut = second.replace(passage + " ", "")
    assert kept[3] == kept[2] - Counter([(309, second)]) + Counter([(309, cut)])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {r[0] for r in kept[3]}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_duplicates_leave_no_table_of_the_way(spark):
    from pathlib import Path

    from pagewright.llm import near_dedup, scratch

    folder = Path(scratch.shared_folder(spark).removeprefix("file:").replace("//", "/"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    df = spark.createDataFrame([(i, " ".join(f"w{i % 3}x{k}" for k in range(40))) for i in range(9)], "doc_id long, text string")
    rows = near_dedup.deduplicate(df)
    kinds = {p.name.split("-")[0] for p in folder.iterdir() if p.name not in before}
    assert kinds == {"found", "member", "decided", "marks"}
    assert sorted(r.doc_id for r in rows.collect()) == [0, 1, 2]


def test_lm_automaton_costs_no_more_than_its_ngrams():
    rng = np.random.default_rng(5)
    h = kernels.mixed(rng.zipf(1.1, 1_000_000).astype(np.uint64))
    first = np.arange(0, len(h) + 1, 500)
    took = []
    for _ in range(2):
        began = time.process_time()
        g = lm_scoring.Grams.of(h, first, 10, 6)
        middle = time.process_time()
        a = lm_scoring.Automaton.of(g, g.seen(np.ones(len(first) - 1, np.int32)), len(h), 1000)
        took.append((time.process_time() - middle) / (middle - began))
    assert min(took) < 3, took
    assert (a.failure[1 + g.pair[lm_scoring._inner(first, 1)]] == 1 + g.word[lm_scoring._inner(first, 1)]).all()


def test_substring_dedup_loads_no_pandas_into_its_workers():
    said = subprocess.run([sys.executable, "-c", "import sys, pagewright.llm.substring_dedup; print('pandas' in sys.modules)"], capture_output=True, text=True, check=True)
    assert said.stdout.split()[-1] == "False"


def test_repeated_passages_get_what_their_first_places_met():
    rng = np.random.default_rng(6)
    n, least = 40, substring_dedup.LEAST
    ids = rng.integers(0, 5, n)
    found = [ids, rng.integers(0, 2, n), rng.integers(0, 30, n) + 200, rng.integers(least, least + 6, n), np.where(rng.random(n) < 0.7, ids, 9), rng.integers(0, 30, n)]
    met = [rng.integers(0, 5, 60), rng.integers(0, 34, 60), rng.integers(-5, 0, 60), rng.integers(0, 99, 60)]
    want = Counter()
    for d, variant, start, length, source, first in zip(*(c.tolist() for c in found), strict=True):
        for k in range(length - least + 1 if d == source else 0):
            for i, place, *other in zip(*(c.tolist() for c in met), strict=True):
                want[d, variant << 32 | start + k, *other] += (i, place) == (d, first + k)
    assert Counter(zip(*(c.tolist() for c in substring_dedup.met_again(found, met)), strict=True)) == +want and len(+want) > 20
    none = [np.zeros(0, np.int64)] * 4
    assert [len(c) for c in substring_dedup.met_again(found, none)] == [0] * 4


def test_open_words_are_sent_once_a_part_however_many_have_their_runs(spark, monkeypatch):
    """A large family of heavily edited copies: rows sent to be compared follow documents and parts, not pairs, and what all pairs would find is found."""
    rng = random.Random(61)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, rows = text(150), []
    for i in range(240):
        rows.append((i, " ".join(text(1)[0] if rng.random() < 0.06 else w for w in base)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sent = []
    grouped_ = type(frame.groupBy("doc_id").cogroup(frame.groupBy("doc_id")))
    original = grouped_.applyInArrow

    def counted(self, func, schema):
        out = original(self, func, schema)
        if getattr(func, "__name__", "") in ("_asking", "_further"):
            sent.append(out)
        return out

    monkeypatch.setattr(grouped_, "applyInArrow", counted)
    size = sum(len(t) for _, t in rows) // 3
    got = {}
    for r in substring_dedup.repeats(frame, part_bytes=size).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    assert sent and all(0 < d.count() <= 4 * 2 * len(rows) for d in sent)
    # All pairs, seeded at the same place, as copies are edited in place.
    h = [np.array([zlib.crc32(w.encode()) for w in t.split()], np.uint64) for _, t in rows]
    missed = wanted = 0
    for i, x in enumerate(h):
        want = set()
        for y in h[:i]:
            for a, b, _ in substring_dedup.passages(x, y, 0)[0]:
                want.update(range(a, b))
        wanted += len(want)
        missed += len(want - got.get(i, set()))
    assert wanted > 1000 and missed <= 0.03 * wanted


def test_reachable_words_against_all_windows():
    rng = np.random.default_rng(62)
    span = substring_dedup.SPAN
    for n in (span - 1, span, span + 1, 120, 200):
        shared = np.array([np.repeat(rng.random(n // 8 + 1) < p, 8)[:n] for p in (0.6, 0.75, 0.8, 0.85, 0.9, 1)])
        want = np.zeros((len(shared), n + 4), bool)
        for k, row in enumerate(shared):
            for i in range(n):
                for j in range(i + span, n + 1):
                    if 5 * row[i:j].sum() >= 4 * (j - i):
                        want[k, i : j + 4] = True
        at = np.flatnonzero(rng.random(n + 4) < 0.7)
        assert (substring_dedup.reachable(shared, at) == want[:, at]).all()


def test_open_runs_are_asked_for_when_the_candidates_shuffles_are_gone(spark):
    words = [f"w{k}" for k in range(120)]
    docs = spark.createDataFrame([(k, " ".join(words[: 80 + k])) for k in range(6)], "doc_id long, text string")
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    size = lambda: sum(f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data"))
    before = size()
    found = substring_dedup.repeats(docs, part_bytes=1000)
    # What was verified is a table by now; but for the count of bytes nothing is left of what made it.
    assert any("/verified-" in f for f in found.inputFiles())
    assert size() - before < 2_000
    assert {(r.doc_id, r.start) for r in found.collect()} == {(k, 0) for k in range(1, 6)}
