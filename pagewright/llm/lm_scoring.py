"""Language-model scores by a weighted backoff automaton over all words, pairs and triples.

Weights. With c a count in the training documents, N their tokens and V their different
tokens (the end of a text is a token; a start mark is a context only):

  p1(w) = (c(w) + 1) / (N + V + 1)
  p2(w | v) = (1 - b(v)) c(vw) / c(v) + b(v) p1(w),     b(v) = PAIR_MASS c(v) ** -PAIR_FALL
  p3(w | uv) = (1 - TRIPLE_MASS) c(uvw) / c(uv) + TRIPLE_MASS p2(w | v)

(Jelinek-Mercer interpolation; the weight passed on depends on the context's count only.)
An unseen context passes everything on. As an automaton: the states are the root, each word
and each pair of the training documents. A state has an arc for each word seen after it, with
its log10 weight, and a failure arc to the state of its shorter context, with log10 of the
mass it passes on. Every n-gram has its arc, whatever its count.

Counts. Documents are dealt into parts of about ``PART_TOKENS`` tokens. A part sends each of
its different n-grams once, with its number in the part's training documents, to the buckets
of ``keyruns``; a bucket adds up the parts' numbers and answers each part. So the tables grow
with the input, a frequent n-gram costs one entry a part, and no key is hot. N-grams are told
apart by 52 and more bits: two of n keys agree with a chance of about n * 2**-bits.

Traversal. From the answers a part builds the states and arcs that its own texts can meet, and
walks each text once from left to right: the state is carried from token to token, failure
arcs are followed until an arc fits, and the logarithms are added up. All texts of a part walk
at the same time; a text of over ``STRETCH`` tokens is cut into stretches, each of which starts
in the state that its predecessor's last two tokens lead to.

Defined results: null and empty texts are the end token alone; a training set without rows
gives every token 1 (base: 1 / (V + 1)); rows are scored one by one, repeats included; a null id is
held out; extra columns aren't read. An empty table gives no rows. Texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import grouped, keyruns
from pagewright.llm import kernels as K

U = np.uint64
#: Masses passed on by contexts, chosen on training rows (one seventh of them held back).
PAIR_MASS, PAIR_FALL, TRIPLE_MASS = 0.75, 0.06, 0.5
PART_TOKENS, STRETCH = 2_000_000, 512
END_HASH, START_HASH = K.mixed(np.array([0xE0D, 0x57A], U))
K.keep_blocks()
TRAIN = "crc32(cast(doc_id as string)) % 7 != 2"


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with a start mark before and an end token after each document, and where documents begin."""
    h, _, _, first = K.words(data, offs)
    n = len(first) - 1
    both = np.concatenate([first[1:], first[:-1]])
    return np.insert(h, both, np.repeat([END_HASH, START_HASH], n)), first + 2 * np.arange(n + 1)


#: Buckets of words (bits) and bytes of the rest: 64 bits a word.
WORD_BITS, WORD_WIDTH, WORDS_HELD = 8, 7, 1 << 20


def _words_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the different words (and ends), with their number in the training documents; the bucket -1 has the number of all tokens."""
    held, counts, every = np.zeros(0, U), np.zeros(0, np.int64), 0

    def sent() -> pa.RecordBatch:
        bucket, ends, high, low = keyruns.runs(held, WORD_BITS, WORD_WIDTH)
        byte, large = keyruns.small(counts, ends)
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), high, low, byte, large, pa.nulls(len(bucket), pa.int64())], names=["bucket", "high", "low", "byte", "large", "n"])

    for batch in batches:
        offs, data = K.buffers(batch.column(1))
        learn = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in K.slices(offs, 8 * K.SLICE):
            h, _, _, first = K.words(data, offs[a : b + 1])
            every += len(h) + b - a
            if learn[a:b].any():
                own = np.append(h[np.repeat(learn[a:b], np.diff(first)) > 0], END_HASH)
                uniq, n = np.unique(own, return_counts=True)
                n[np.searchsorted(uniq, END_HASH)] += int(learn[a:b].sum()) - 1
                held, back = np.unique(np.concatenate([held, uniq]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(held)).astype(np.int64)
            if len(held) > WORDS_HELD:
                yield sent()
                held, counts = np.zeros(0, U), np.zeros(0, np.int64)
    if len(held):
        yield sent()
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *[pa.array([b""], pa.binary())] * 4, pa.array([every])], names=["bucket", "high", "low", "byte", "large", "n"])


def _words_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket: different words, their number, and the number of all tokens of the parts."""
    for table in grouped.whole(batches, ["bucket"], 64):
        keys, _ = keyruns.keys_of(table["high"], table["low"], WORD_WIDTH)
        bucket = table["bucket"].to_numpy().astype(U)
        ends = keyruns.spans(table["byte"])[0]
        words = np.unique(keys | (np.repeat(bucket, np.diff(ends)) << U(8 * WORD_WIDTH)))
        tokens_, every = int(keyruns.counts_of(table["byte"], table["large"]).sum()), pa.compute.sum(table["n"]).as_py() or 0
        yield pa.RecordBatch.from_arrays([pa.array([len(words)]), pa.array([tokens_]), pa.array([every])], names=["types", "tokens", "every"])


@dataclass
class Grams:
    """The n-grams of some documents: sorted different keys, and for each token the places of the word, pair and triple that end there."""

    keys: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    first: np.ndarray  # where documents begin, with their start mark
    seen: Callable[[np.ndarray], np.ndarray]  # numbers of each key in the documents that a 0/1 array marks

    @staticmethod
    def of(h: np.ndarray, first: np.ndarray, bits: int, width: int) -> Grams:
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        two = np.flatnonzero(place >= 1)
        three = np.flatnonzero(place >= 2)
        turned = (h << U(23)) | (h >> U(41))
        pair = K.mixed(h[two - 1] * U(0x9E3779B97F4A7C15) + turned[two])
        triple = K.mixed(K.mixed(h[three - 2] * U(0xD6E8FEB86659FD93) + turned[three - 1]) + h[three])
        every = keyruns.cut(np.concatenate([K.mixed(h ^ U(0x1F)), pair, triple]), bits, width)
        del pair, triple, turned, place
        order = K.order_of(every, bits + 8 * width)
        every = every[order]
        new = np.append(True, every[1:] != every[:-1])
        keys = every[new]
        back = np.empty(len(every), np.int32)
        back[order] = np.cumsum(new, dtype=np.int32) - 1
        del every, order, new
        spot = np.zeros((2, len(h)), np.int32)
        spot[0, two] = back[len(h) : len(h) + len(two)]
        spot[1, three] = back[len(h) + len(two) :]

        def seen(learn: np.ndarray) -> np.ndarray:
            own = np.repeat(learn, np.diff(first)).astype(bool)
            return np.bincount(back[np.concatenate([own, own[two], own[three]])], minlength=len(keys))

        return Grams(keys, back[: len(h)], spot[0], spot[1], first, seen)


@dataclass
class Automaton:
    """States and arcs of the n-grams with the places of ``Grams``: state 0 is the root, 1 + place that of a word or pair.

    arc: log10 weight of the arc that ends with the n-gram, from the state of its context; failure: the state of a
    state's shorter context; passed: log10 of the mass it passes on; count: of each n-gram.
    """

    arc: np.ndarray
    failure: np.ndarray
    passed: np.ndarray
    count: np.ndarray
    root: np.ndarray  # log10 weight of each word from the root

    @staticmethod
    def of(g: Grams, count: np.ndarray, n: int, v: int) -> Automaton:
        size = len(g.keys)
        two, three = _inner(g.first, 1), _inner(g.first, 2)
        words, pairs, triples = (_different(x, size) for x in (g.word, g.pair[two], g.triple[three]))
        p = np.zeros(size)
        p[words] = (count[words] + 1.0) / (n + v + 1)
        root = np.zeros(size)
        root[words] = np.log10(p[words])
        keep = np.ones(size)
        c = count[words]
        keep[words] = np.where(c > 0, PAIR_MASS * np.maximum(c, 1) ** -PAIR_FALL, 1.0)
        keep[pairs] = np.where(count[pairs] > 0, TRIPLE_MASS, 1.0)
        failure = np.zeros(size + 1, np.int64)
        # Some token of each n-gram tells its parts.
        at = np.zeros(size, np.int64)
        at[g.pair[two]] = two
        at[g.triple[three]] = three
        for grams, context, shorter in ((pairs, g.word, g.word), (triples, g.pair, g.pair)):
            own, low = context[at[grams] - 1], shorter[at[grams]]
            p[grams] = (1 - keep[own]) * count[grams] / np.maximum(count[own], 1) + keep[own] * p[low]
        failure[pairs + 1] = g.word[at[pairs]] + 1
        arc = np.log10(np.maximum(p, 1e-300))
        return Automaton(arc, failure, np.append(0.0, np.log10(keep)), count, root)

    def walk(self, g: Grams) -> np.ndarray:
        """log10 weight of each text."""
        docs = len(g.first) - 1
        length = np.diff(g.first) - 1
        cuts = -(-length // STRETCH)
        doc = np.repeat(np.arange(docs), cuts)
        begin = g.first[:-1][doc] + 1 + STRETCH * (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        steps = np.minimum(STRETCH, g.first[1:][doc] - begin)
        order = np.argsort(-steps, kind="stable")
        doc, begin, steps = doc[order], begin[order], steps[order]
        state = self.reached(g, begin - 1, begin - 1 > g.first[:-1][doc])
        total = np.zeros(len(doc))
        awake = np.searchsorted(-steps, -np.arange(int(steps[0]) if len(steps) else 0), "left")
        for k, m in enumerate(awake.tolist()):
            at = begin[:m] + k
            s, word, pair, triple = state[:m], g.word[at], g.pair[at], g.triple[at]
            deep = self.failure[s] > 0  # a pair: its failure is a word's state
            fits = deep & (self.count[triple] > 0)
            gain = np.where(fits, self.arc[triple], 0.0)
            fails = deep & ~fits
            gain[fails] += self.passed[s[fails]]
            s = np.where(fails, self.failure[s], s)
            shallow = ~fits & (s > 0)
            two = shallow & (self.count[pair] > 0)
            gain[two] += self.arc[pair[two]]
            fails = shallow & ~two
            gain[fails] += self.passed[s[fails]]
            bottom = ~fits & ~two
            gain[bottom] += self.root[word[bottom]]
            total[:m] += gain
            # The arc's target: the longest context that is a state.
            state[:m] = np.where(self.count[pair] > 0, pair + 1, np.where(self.count[word] > 0, word + 1, 0))
        return np.bincount(doc, total, docs)

    def reached(self, g: Grams, at: np.ndarray, has_pair: np.ndarray) -> np.ndarray:
        """The state after the token ``at``."""
        pair, word = g.pair[at], g.word[at]
        return np.where(has_pair & (self.count[pair] > 0), pair + 1, np.where(self.count[word] > 0, word + 1, 0))


def _different(places: np.ndarray, size: int) -> np.ndarray:
    """The different ones of places below ``size``, ascending: marked, as they are dense (np.unique hashes each of them)."""
    met = np.zeros(size, bool)
    met[places] = True
    return np.flatnonzero(met)


def _inner(first: np.ndarray, least: int) -> np.ndarray:
    """Tokens with at least so many before them in their document."""
    place = np.arange(int(first[-1])) - np.repeat(first[:-1], np.diff(first))
    return np.flatnonzero(place >= least)


def _sent(table: pa.Table, bits: int, width: int) -> pa.Table:
    """The n-grams of a part (part, doc_id, train, text) as runs for the buckets."""
    part = table["part"][0].as_py()
    offs, data = K.buffers(table["text"])
    g = Grams.of(*tokens(data, offs), bits, width)
    bucket, ends, high, low = keyruns.runs(g.keys, bits, width)
    byte, large = keyruns.small(g.seen(table["train"].to_numpy()), ends)
    K.release()
    return pa.table({"bucket": pa.array(bucket.astype(np.int32)), "part": pa.array(np.full(len(bucket), part, np.int32)), "high": high, "low": low, "byte": byte, "large": large})


def _answered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """For each run (bucket, part, high, low, byte, large) the counts of its keys over all parts."""
    for table in grouped.whole(batches, ["bucket"], 200):
        bucket = table["bucket"].to_numpy()
        keys, ends = keyruns.keys_of(table["high"], table["low"], width)
        count = keyruns.counts_of(table["byte"], table["large"])
        cut = grouped.runs([bucket])
        out = np.zeros(len(keys), np.int64)
        for lo, hi in zip(ends[cut[:-1]], ends[cut[1:]], strict=True):
            uniq, back = np.unique(keys[lo:hi], return_inverse=True)
            out[lo:hi] = np.bincount(back, count[lo:hi], len(uniq)).astype(np.int64)[back]
        byte, large = keyruns.small(out, ends)
        yield pa.RecordBatch.from_arrays([table["part"].combine_chunks(), table["bucket"].combine_chunks(), byte, large], names=["part", "bucket", "byte", "large"])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(texts: pa.Table, answers: pa.Table, bits: int, width: int, n: int, v: int) -> pa.Table:
    offs, data = K.buffers(texts["text"])
    g = Grams.of(*tokens(data, offs), bits, width)
    answers = answers.sort_by("bucket")
    model = Automaton.of(g, keyruns.counts_of(answers["byte"], answers["large"]), n, v)
    score = model.walk(g)
    docs = texts.num_rows
    counted = _inner(g.first, 1)
    doc = np.repeat(np.arange(docs), np.diff(g.first))[counted]
    c = model.count[g.word[counted]]
    known, base = np.bincount(doc, c > 0, docs).astype(np.int64), np.bincount(doc, np.log10((c + 1.0) / (n + v + 1)), docs)
    K.release()
    columns = [texts["doc_id"].combine_chunks(), pa.array(~texts["train"].to_numpy().astype(bool)), pa.array(np.diff(g.first) - 1), pa.array(known), pa.array(np.full(docs, n)), pa.array(base), pa.array(score)]
    return pa.Table.from_arrays(columns, names=[f.split()[0] for f in SCORED.split(", ")])


def scores(docs: DataFrame, rule: str = TRAIN, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    flagged = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    flagged = flagged.select("doc_id", F.coalesce(F.expr(f"cast({rule} as int)"), F.lit(0)).alias("train"), "text")
    words = flagged.select("train", "text").mapInArrow(_words_sent, "bucket int, high binary, low binary, byte binary, large binary, n long").repartition("bucket").sortWithinPartitions("bucket")
    v, n, every = words.mapInArrow(_words_counted, "types long, tokens long, every long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "tokens", "every"))).first()
    parts = -(-every // part_tokens) or 1
    bits, width = keyruns.shape(2 * every)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part")
    dealt = flagged.select(part, "doc_id", "train", "text").repartition(parts, "part")
    sent = dealt.groupBy("part").applyInArrow(lambda t: _sent(t, bits, width), "bucket int, part int, high binary, low binary, byte binary, large binary")
    answers = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _answered(it, width), "part int, bucket int, byte binary, large binary")
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda t, a: _scored(t, a, bits, width, n, v), SCORED)
