"""Exact BPE by backtracking over longest matches, and decoding by an offset table.

A word is a string of base symbols (bytes; the last one with the end-of-word mark).
One Aho-Corasick pass gives the longest vocabulary token at every position. The
encoder takes the longest token that may stand beside the one before it; if none
fits or the rest was found impossible, it goes back one token and tries the next
shorter one. Each position is given up at most once, so time is linear in the word.

Two tokens may be neighbours if merging their concatenation yields just these two.
Where the vocabulary has one merge per token this is decided by unfolding the later
merged one at the boundary and looking whether an earlier merge would have crossed
it. Decisions are kept in a pair table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagewright.llm import kernels as K
from pagewright.llm import pieces

_loaded: dict[str, "WordBpe"] = {}


class Backtracker:
    """BPE over symbol strings. tokens: symbol string by id, base symbols first; merges in rank order as id pairs."""

    def __init__(self, tokens: list[str], merges: list[tuple[int, int, int]]):
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.parts: list[tuple[int, int] | None] = [None] * len(tokens)
        self.rank = [-1] * len(tokens)
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (a, b, new) in enumerate(merges):
            if self.parts[new] is not None:
                raise ValueError("a token that two merges make")
            self.parts[new], self.rank[new], self.merge[a, b] = (a, b), rank, rank
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(tokens)
        for t, i in self.ids.items():
            for k in range(len(t) - 1, 0, -1):
                if (j := self.ids.get(t[:k])) is not None:
                    self.shorter[i] = j
                    break
        self.pairs: dict[tuple[int, int], bool] = {}

    def beside(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` in an encoding?"""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self._beside(left, right)
        return known

    def _beside(self, left: int, right: int) -> bool:
        # Walk back in time: before merge number `time`, the boundary lies between `left` and `right`.
        time = len(self.length)
        while True:
            crossing = self.merge.get((left, right))
            if crossing is not None and crossing < time:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            # Undo the later merge of the two. Of equal ranks the left one came first, and
            # a crossing merge of a rank has precedence over the same rank to its right.
            if a > b:
                time, left = a, self.parts[left][1]
            else:
                time, right = b + 1 if a != b else b, self.parts[right][0]

    def encode(self, word: str) -> list[int]:
        n = len(word)
        longest = [-1] * n
        length = self.length
        for end, i in self.automaton.iter(word):
            at = end - length[i] + 1
            longest[at] = i  # ends grow, so the last is the longest
        if length[longest[0]] == n:
            return [longest[0]]
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and (dead[at + length[token]] or out and not self.beside(out[-1], token)):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out


class WordBpe:
    """The tokenizer of a file with word ends: ids of texts and texts of ids."""

    def __init__(self, path: str):
        vocab, merges, self.specials = pieces.read_model(path)
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        letters = pieces.byte_letters()
        mark = "</w>"
        symbols = [letters[b] for b in range(256)] + [letters[b] + mark for b in range(256)]
        code = {s: chr(0x100 + k) for k, s in enumerate(symbols)}

        def coded(t: str) -> str:
            body, last = (t[: -len(mark)], True) if t.endswith(mark) and len(t) > len(mark) else (t, False)
            return "".join(code[c] for c in (body[:-1] if last else body)) + (code[body[-1] + mark] if last else "")

        order = sorted(symbols, key=lambda s: vocab[s]) + [a + b for a, b in merges]
        own = {t: k for k, t in enumerate(order)}
        self.public = np.array([vocab[t] for t in order], np.int32)
        self.core = Backtracker([coded(t) for t in order], [(own[a], own[b], own[a + b]) for a, b in merges])
        self.inner, self.last = [chr(0x100 + b) for b in range(256)], [chr(0x200 + b) for b in range(256)]
        self.public_list = self.public.tolist()
        self.encoder = pieces.PieceEncoder(self.piece, leading_space=False)
        # Decoding: token texts in one block, each followed by the space that joins tokens.
        texts = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for t, i in (vocab | self.specials).items():
            texts[i] = t.encode() + b" "
        self.block = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        word = "".join([self.inner[b] for b in raw[:-1]]) + self.last[raw[-1]]
        return [self.public_list[i] for i in self.core.encode(word)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, as the tokenizers library gives them without added tokens."""
        plain: list[str] = []
        plan: list[list[int]] = []  # of each text: indexes of plain parts, or ~id of a special token
        for text in texts:
            if "<|" in text:
                parts = pieces.around_specials(text, self.specials, self.special_pattern)
            else:
                parts = [text]
            mine = []
            for p in parts:
                if isinstance(p, str):
                    mine.append(len(plain))
                    plain.append(pieces.lowered(p))
                else:
                    mine.append(~p)
            plan.append(mine)
        ids, begin = self.encoder.ids(plain)
        out = []
        for mine in plan:
            got = [ids[begin[k] : begin[k + 1]] if k >= 0 else np.array([~k], np.int32) for k in mine]
            out.append(got[0] if len(got) == 1 else np.concatenate(got))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with a space between, in UTF-8."""
        if not len(ids):
            return b""
        size = self.offsets[ids + 1] - self.offsets[ids]
        end = np.cumsum(size)
        return self.block[np.repeat(self.offsets[ids] - (end - size), size) + np.arange(int(end[-1]))][:-1].tobytes()


def word_bpe(path: str) -> WordBpe:
    """The tokenizer of ``path``, loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = word_bpe(path)
    for batch in batches:
        texts = batch.column(1)
        offs, _ = K.buffers(texts)
        for a, b in K.slices(offs):
            ids = model.ids([t or "" for t in texts.slice(a, b - a).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([sha256(np.ascontiguousarray(i, "<u4")).hexdigest() for i in ids], pa.string()),
                    pa.array([sha256(model.decode(i)).hexdigest() for i in ids], pa.string()),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the ids (array of int) of every text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(path)
        for batch in batches:
            texts = batch.column(1)
            offs, _ = K.buffers(texts)
            for a, b in K.slices(offs):
                ids = model.ids([t or "" for t in texts.slice(a, b - a).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, np.concatenate(ids))], names=["doc_id", "ids"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(path)
        for batch in batches:
            texts = [model.decode(np.array(i or [], np.int64)).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token count and digests of ids and of decoded text of every document; texts never leave their task.

    Null and empty texts have no ids; texts of any length, repeated rows and null ids are
    encoded row by row; other columns aren't read.
    """
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(lambda it: _digested(it, path), SCHEMA)
