"""Language identification: script ranges, per-word scores, and Viterbi over words.

Training counts hashed byte trigrams of padded words for each language over all
training documents (sums of fixed-size tables, added up by Spark), and how often a
language's words are in each script (by code point). A word's candidates are the
languages that have at least a thousandth of their words in its script, others can't be
chosen; its scores are smoothed trigram log-probabilities. Viterbi over the words
of a document, with a penalty for each switch, labels spans of mixed text. The
document gets the language with most labelled bytes; the score is its share of them,
weighed with the word-score margin.

Viterbi runs over all documents of a slice at once, in blocks of 512 words: one step for
the k-th words of all blocks and one for the k-th blocks of all documents, so no Python
code runs per word, in long texts neither.

Defined results: null texts and texts without a letter give ``und`` and 0; for words in a
script that no language uses all are candidates; without training rows all is ``und``;
rows are judged one by one, so repeats, null ids and any length need no care; extra
columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import kernels as K

U = np.uint64
BITS = 14
SWITCH = 8.0
FLOOR = -50.0  # of a word's part in the margin, so a word in a script that isn't the language's doesn't decide alone
BLOCK = 512  # words of a document that are stepped through one after the other
#: Scripts, and the code points (first, last) of their letters. Of a word's scripts the last one named here counts.
RANGES = {
    "latin": "41-5A 61-7A AA-AA BA-BA C0-D6 D8-F6 F8-2AF 1D00-1DBF 1E00-1EFF 2C60-2C7F A722-A7FF AB30-AB6F FB00-FB06 FF21-FF3A FF41-FF5A",
    "greek": "370-3FF 1F00-1FFF",
    "cyrillic": "400-52F 1C80-1C8F 2DE0-2DFF A640-A69F",
    "armenian": "531-58F FB13-FB17",
    "hebrew": "591-5FF FB1D-FB4F",
    "arabic": "600-6FF 750-77F 870-8FF FB50-FDFF FE70-FEFE",
    "indic": "900-DFF A8E0-A8FF",
    "thai": "E00-E7F",
    "georgian": "10A0-10FF 1C90-1CBF 2D00-2D2F",
    "han": "2E80-2FDF 3005-3007 3400-4DBF 4E00-9FFF F900-FAFF 20000-323AF",
    "kana": "3041-30FF 31F0-31FF FF66-FF9F",
    "hangul": "1100-11FF 3130-318F A960-A97F AC00-D7FF FFA0-FFDC",
    "other": "700-74F 780-86F E80-109F 1200-1C7F 2D30-2DDF 3100-312F A000-A4CF A500-A63F A800-A82F A840-A8DF 10000-1CFFF",
}
SCRIPTS = ["none", *RANGES]
_SPANS = sorted((*(int(x, 16) for x in span.split("-")), k) for k, name in enumerate(RANGES, 1) for span in RANGES[name].split())
_FIRST, _LAST, _SCRIPT = (np.array(column) for column in zip(*_SPANS, strict=True))


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    found = _LETTER.search(text)
    return found is not None and (found[0].isalpha() or any(c.isalpha() for c in text[found.start() :]))


def script_of(points: np.ndarray) -> np.ndarray:
    """Script (place in SCRIPTS) of code points; 0 outside all ranges."""
    at = np.maximum(np.searchsorted(_FIRST, points, "right") - 1, 0)
    return np.where((points >= _FIRST[at]) & (points <= _LAST[at]), _SCRIPT[at], 0)


_ASCII = np.concatenate([script_of(np.arange(128)), np.zeros(128, np.int64)])


def scripts(data: np.ndarray) -> np.ndarray:
    """Script of the character that begins at each byte of UTF-8; 0 at bytes inside one."""
    out = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        first = data[lead].astype(np.int64)
        second, third, fourth = (data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 63 for k in (1, 2, 3))
        two = (first & 31) << 6 | second
        three = (first & 15) << 12 | second << 6 | third
        four = (first & 7) << 18 | second << 12 | third << 6 | fourth
        out[lead] = script_of(np.where(first < 0xE0, two, np.where(first < 0xF0, three, four)))
    return out


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cell of each byte of a word, first byte index of each word, bytes and script of each word, first word of each document."""
    _, starts, ends, first = K.words(data, offs)
    size = ends - starts
    total = int(size.sum())
    begin = np.cumsum(size) - size
    at = np.repeat(starts - begin, size) + np.arange(total)
    raw = data[at]
    body = raw.astype(np.uint32)
    upper = (body >= 65) & (body <= 90)
    body[upper] += 32
    before = np.full(total, 32, np.uint32)
    before[1:] = body[:-1]
    before[begin] = 32
    after = np.full(total, 32, np.uint32)
    after[:-1] = body[1:]
    after[begin + size - 1] = 32
    cell = (((before << np.uint32(16)) | (body << np.uint32(8)) | after) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    script = np.maximum.reduceat(scripts(raw), begin) if total else np.zeros(0, np.int64)
    return cell, begin, size, script, first


def _counted(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    cells = 1 << BITS
    table = np.zeros((len(langs), cells + len(SCRIPTS)), np.int64)
    code = {lang: k for k, lang in enumerate(langs)}
    for batch in batches:
        offs, data = K.buffers(batch.column(1))
        lang = np.array([code.get(x, -1) for x in batch.column(0).to_pylist()])
        for a, b in K.slices(offs):
            cell, begin, size, script, first = trigrams(data, offs[a : b + 1])
            own = np.repeat(lang[a:b], np.diff(first))
            for k in np.unique(own[own >= 0]):
                table[k, :cells] += np.bincount(cell[np.repeat(own, size) == k], minlength=cells)
                table[k, cells:] += np.bincount(script[own == k], minlength=len(SCRIPTS))
    lang, cell = np.nonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(table[lang, cell])], names=["lang", "cell", "n"])


class Model:
    """Languages, log-probabilities of cells and which languages are candidates in a script."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        cells = 1 << BITS
        self.langs = langs
        grams = counts[:, :cells] + 0.2
        self.cell = np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32).T.copy()
        scripts = counts[:, cells:]
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        used = share >= 0.001
        used[:, 0] = True
        used[:, ~used.any(0)] = True  # a script that no language uses narrows nothing
        self.candidates = used.T.copy()

    def word_scores(self, cell: np.ndarray, begin: np.ndarray, script: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language against the best candidate's; minus infinity where it is none."""
        scores = np.where(self.candidates[script], np.add.reduceat(self.cell[cell], begin, axis=0), np.float32(-np.inf))
        return scores - scores.max(1, keepdims=True)

    def paths(self, scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
        """The best language of each word, document by document.

        A document is cut into blocks that are stepped through side by side. A later block is
        stepped once for each language before it; the best chain of blocks is chosen after that.
        """
        n = scores.shape[1]
        parts = np.maximum(-(-np.diff(first) // BLOCK), 1)
        head = np.cumsum(parts) - parts
        doc = np.repeat(np.arange(len(parts)), parts)
        which = np.arange(len(doc)) - head[doc]
        begin = first[:-1][doc] + which * BLOCK
        size = np.minimum(first[1:][doc] - begin, BLOCK)
        copies = np.where(which == 0, 1, n)
        run = np.cumsum(copies) - copies  # a block's first run
        block = np.repeat(np.arange(len(doc)), copies)
        before = np.arange(len(block)) - run[block]
        start = np.where((np.arange(n) == before[:, None]) | (which[block] == 0)[:, None], 0, -switch)

        order = np.argsort(-size[block], kind="stable")
        at, length = begin[block][order], size[block][order]
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(1, steps + 1), "right")
        best = start[order].astype(np.float32)
        moved: list[np.ndarray] = []  # of each step: the language to switch from
        stay: list[np.ndarray] = []
        for k in range(steps):
            d = int(active[k])
            v = best[:d]
            if k:
                top = v.argmax(1)
                leap = v[np.arange(d), top][:, None] - np.float32(switch)
                keep = v >= leap
                moved.append(top.astype(np.int16))
                stay.append(keep)
                v = np.maximum(v, leap)
            best[:d] = v + scores[at[:d] + k]

        ends = np.zeros((len(block), n))
        ends[order] = best
        value = ends[run[head]]
        came: list[tuple[np.ndarray, np.ndarray]] = []  # of each place in a document: documents, and the language before by the one at the end
        for k in range(1, int(parts.max(initial=1))):
            far = np.flatnonzero(parts > k)
            chain = value[far][:, :, None] + ends[run[head[far] + k][:, None] + np.arange(n)]
            came.append((far, chain.argmax(1)))
            value[far] = chain.max(1)
        last = np.zeros(len(doc), np.int64)
        entry = np.zeros(len(doc), np.int64)
        state = value.argmax(1)
        for k in range(len(came), 0, -1):
            far, chosen = came[k - 1]
            last[head[far] + k] = state[far]
            state[far] = entry[head[far] + k] = chosen[np.arange(len(far)), state[far]]
        last[head] = state

        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place = place[run + entry]
        by_size = np.argsort(place)
        place, state = place[by_size], last[by_size]
        out = np.zeros(len(scores), np.int16)
        for k in range(steps - 1, -1, -1):
            d = int(np.searchsorted(place, active[k]))
            rows, now = place[:d], state[:d]
            out[at[rows] + k] = now
            if k:
                state[:d] = np.where(stay[k - 1][rows, now], now, moved[k - 1][rows])
        return out

    def judge(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language (index, or -1) and score of each document."""
        cell, begin, size, script, first = trigrams(data, offs)
        docs, n = len(offs) - 1, len(self.langs)
        if not len(begin):
            return np.full(docs, -1), np.zeros(docs)
        scores = self.word_scores(cell, begin, script)
        path = self.paths(scores, first)
        doc = np.repeat(np.arange(docs), np.diff(first))
        weight = np.bincount(doc * n + path, size * (script > 0) + 1e-3, docs * n).reshape(docs, n)
        pick = weight.argmax(1)
        share = weight.max(1) / np.maximum(weight.sum(1), 1e-9)
        total = np.stack([np.bincount(doc, np.maximum(scores[:, k], FLOOR), docs) for k in range(n)], 1)
        total -= total.max(1, keepdims=True)
        odds = np.exp(np.maximum(total, -700) / np.maximum(np.sqrt(np.diff(first)), 1)[:, None])
        sure = odds[np.arange(docs), pick] / odds.sum(1)
        return np.where(np.diff(first) > 0, pick, -1), np.clip(share * sure, 0, 1)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start byte, end byte, language) of the spans of one text."""
        data = np.frombuffer(text.encode(), np.uint8)
        offs = np.array([0, len(data)])
        cell, begin, size, script, first = trigrams(data, offs)
        if not len(begin):
            return []
        _, starts, ends, _ = K.words(data, offs)
        path = self.paths(self.word_scores(cell, begin, script), first)
        cut = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        return [(int(starts[a]), int(ends[b - 1]), self.langs[path[a]]) for a, b in zip(cut, np.append(cut[1:], len(path)), strict=True)]


TRAIN = "crc32(cast(doc_id as string)) % 5 != 0"


def fit(docs: DataFrame, train: str = TRAIN) -> Model:
    """Counts of all training documents; the driver gets one table of fixed size a language."""
    rows = docs.where(train).where("lang is not null")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    got = rows.select("lang", "text").mapInArrow(lambda it: _counted(it, langs), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), (1 << BITS) + len(SCRIPTS)))
    counts[got["lang"], got["cell"]] = got["n"]
    return Model(langs, counts)


def _judged(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.langs, "und"], object)
    for batch in batches:
        offs, data = K.buffers(batch.column(1))
        for a, b in K.slices(offs, 1 << 20):  # few steps of Viterbi: long documents share them
            texts = batch.column(1).slice(a, b - a)
            letters = np.fromiter((t is not None and has_letter(t) for t in texts.to_pylist()), bool, b - a)
            if model.langs:
                pick, score = model.judge(data, offs[a : b + 1])
            else:
                pick, score = np.full(b - a, -1), np.zeros(b - a)
            pick = np.where(letters, pick, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[pick], pa.string()), pa.array(np.where(pick >= 0, score, 0.0))], names=["doc_id", "lang_pred", "score"])


def predictions(docs: DataFrame, train: str = TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs, train)
    out = docs.select("doc_id", "text").mapInArrow(lambda it: _judged(it, model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(F.expr(f"not ({train})"), F.lit(True)).alias("held_out"), "lang_pred", "score")
