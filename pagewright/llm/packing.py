"""Packing documents into token sequences of bounded length, balanced by attention cost.

Each scan partition packs its own documents in blocks, so nothing is shuffled and a
lost task is simply run again with the same sequence numbers. In a block, a document
gives full sequences first; the remaining piece of under ``limit`` tokens is a
"small" one. Small pieces, longest first, each go to the sequence of lowest cost
(``LINEAR * n + QUADRATIC * n**2`` over its pieces) among those with room; pieces
that find no room are cut to fill the gaps. The last, partly filled sequence is cut at
powers of two, which need no padding.

Defined results: null and empty texts are one piece of the end token; a text of any
length is cut freely; repeated rows are packed each; an empty table gives no rows;
extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pagewright.llm import kernels as K
from pagewright.llm import pieces

LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Documents whose small pieces are packed together; bounds a task's memory.
BLOCK_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_loaded: dict[str, "ByteBpe"] = {}


class ByteBpe:
    """Ids of texts by a byte-level vocabulary file: pieces are found here, new ones merged by tiktoken."""

    def __init__(self, path: str):
        vocab, _, self.specials = pieces.read_model(path)
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        back = {letter: b for b, letter in pieces.byte_letters().items()}
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in vocab.items() if t not in self.specials}
        merger = tiktoken.Encoding("packing", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.encoder = pieces.PieceEncoder(merger.encode_ordinary, leading_space=True)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        plain: list[str] = []
        plan: list[list[int]] = []
        for text in texts:
            mine = []
            for p in pieces.around_specials(text, self.specials, self.special_pattern) if "<|" in text else [text]:
                if isinstance(p, str):
                    mine.append(len(plain))
                    plain.append(p)
                else:
                    mine.append(~p)
            plan.append(mine)
        ids, begin = self.encoder.ids(plain)
        out = []
        for mine in plan:
            got = [ids[begin[k] : begin[k + 1]] if k >= 0 else np.array([~k], np.int32) for k in mine]
            out.append(got[0] if len(got) == 1 else np.concatenate(got))
        return out


def byte_bpe(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def assign(lengths: np.ndarray, limit: int) -> list[tuple[int, int, int, int, int]]:
    """Places of small pieces: (piece, start in it, length, sequence, offset).

    Sequences are filled without gaps; all but those of the last remainder have
    ``limit`` tokens, and the latter have powers of two.
    """
    total = int(lengths.sum())
    full, rest = divmod(total, limit)
    room = np.full(full, limit)
    used = np.zeros(full, np.int64)
    cost = np.zeros(full)
    out: list[tuple[int, int, int, int, int]] = []
    left: list[tuple[int, int, int]] = []

    def put(piece: int, start: int, n: int, where: int) -> None:
        out.append((piece, start, n, where, int(used[where])))
        used[where] += n
        room[where] -= n
        cost[where] += LINEAR * n + QUADRATIC * n * n

    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        where = int(np.argmin(np.where(room >= n, cost, np.inf))) if full else -1
        if where >= 0 and room[where] >= n:
            put(piece, 0, n, where)
        elif n:
            left.append((piece, 0, n))
    # What found no room fills the gaps, cut where it must be; then the remainder.
    gaps = [(w, int(room[w])) for w in np.argsort(cost, kind="stable").tolist() if room[w]]
    for piece, start, n in left:
        while n and gaps:
            where, free = gaps.pop()
            take = min(n, free)
            put(piece, start, take, where)
            start, n = start + take, n - take
            if free > take:
                gaps.append((where, free - take))
        if n:
            rest_at = len(out)
            out.append((piece, start, n, -1, rest_at))
    tail = [x for x in out if x[3] < 0]
    out = [x for x in out if x[3] >= 0]
    sizes = [1 << k for k in range(limit.bit_length(), -1, -1) if rest >> k & 1]
    bins = [[full + k, size, 0] for k, size in enumerate(sizes)]
    for piece, start, n, _, _ in tail:
        while n:
            b = bins[0]
            take = min(n, b[1] - b[2])
            out.append((piece, start, take, b[0], b[2]))
            b[2] += take
            start, n = start + take, n - take
            if b[2] == b[1]:
                bins.pop(0)
    return out


def _packed(batches: Iterator[pa.RecordBatch], path: str, limit: int, end_id: int) -> Iterator[pa.RecordBatch]:
    model = byte_bpe(path)
    base = TaskContext.get().partitionId() << 36
    made = 0
    end = np.array([end_id], np.int32)
    small: list[tuple[int | None, int, int, np.ndarray]] = []  # id, start, tokens of the document, ids
    waiting = 0
    rows: list[tuple] = []

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(np.ascontiguousarray(ids, "<u4"))

    def flush() -> None:
        nonlocal made, waiting
        places = assign(np.array([len(x[3]) for x in small], np.int64), limit)
        for piece, start, n, where, offset in places:
            doc, at, tokens, ids = small[piece]
            rows.append((doc, at + start, n, crc(ids[start : start + n]), tokens, base + made + where, offset))
        made += max((p[3] for p in places), default=-1) + 1
        small.clear()
        waiting = 0

    def out() -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])
            rows.clear()

    for batch in batches:
        texts = batch.column(1)
        offs, _ = K.buffers(texts)
        docs = batch.column(0).to_pylist()
        for a, b in K.slices(offs):
            found = model.ids([t or "" for t in texts.slice(a, b - a).to_pylist()])
            for doc, ids in zip(docs[a:b], found, strict=True):
                ids = np.concatenate([ids, end])
                n = len(ids)
                whole = n - n % limit
                for at in range(0, whole, limit):
                    rows.append((doc, at, limit, crc(ids[at : at + limit]), n, base + made, 0))
                    made += 1
                if n > whole:
                    small.append((doc, whole, n, ids[whole:].copy()))
                    waiting += n - whole
            if waiting >= BLOCK_TOKENS:
                flush()
            yield from out()
    flush()
    yield from out()


def pack(docs: DataFrame, path: str, limit: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(lambda it: _packed(it, path, limit, end_id), SCHEMA)
