"""Splitting text into tokenizer pieces and encoding them, vectorised over a slice of documents.

``Splitter`` finds the pieces that the two public split patterns (with or without
a leading space) match, from character classes in one pass over code points.
``PieceEncoder`` hashes every piece, encodes each different piece once and copies
its ids to all places. Known pieces are kept in a bounded table per worker.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from pagewright.llm import kernels as K

U = np.uint64
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """Class of each code point (letter, number, white space or other), as the library's own patterns see it."""
    if "cls" not in _tables:
        table = np.zeros(0x110000, np.uint8)
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        place, every = np.array(points), "".join(map(chr, points))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
                table[place[a:b]] = kind
        _tables["cls"] = table
        _tables["mix"] = K.mixed(np.arange(0x110000, dtype=np.uint64) + U(77)) | U(1)
    return _tables["cls"]


def split(codes: np.ndarray, doc_at: np.ndarray, leading_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces in ``codes``; ``doc_at``: where documents begin, and the end.

    With ``leading_space``, one space joins the run after it, white space makes pieces
    and runs of numbers stay together; without it, white space is dropped and each
    number stands alone.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[doc_at] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, cls[:-1]
    before[first[:n]] = 9
    run = cls != before
    blank = cls == SPACE
    start = np.zeros(n + 4, bool)
    if leading_space:
        start[:n] = run
        after = np.flatnonzero(run & ~blank & (before == SPACE))  # a run after white space
        start[after - 1] = True
        start[after[codes[after - 1] == 32]] = False
        joined = np.zeros(n, bool)
        joined[after[codes[after - 1] == 32]] = True
        mark = np.flatnonzero(run & (codes == 39) & ~joined)
    else:
        start[:n] = run | (cls == NUMBER)
        mark = np.flatnonzero(run & (codes == 39))
    if len(mark):
        pad = np.concatenate([codes, np.zeros(3, codes.dtype)])
        fence = np.concatenate([first, np.ones(3, bool)])
        one, two = pad[mark + 1], pad[mark + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~fence[mark + 1]
        long = ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~fence[mark + 1] & ~fence[mark + 2]
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    starts = np.flatnonzero(start[:n])
    ends = np.append(starts[1:], n)
    if not leading_space:
        keep = ~blank[starts]
        starts, ends = starts[keep], ends[keep]
    return starts, ends


class PieceEncoder:
    """Ids of documents; ``encode`` gives the ids of one piece. At most ``most`` pieces stay known."""

    def __init__(self, encode: Callable[[str], list[int]], leading_space: bool, most: int = 1 << 18):
        self.encode, self.leading_space, self.most = encode, leading_space, most
        self.forget()

    def forget(self) -> None:
        self.keys, self.at = np.zeros(0, U), np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each begins (one more at the end)."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        doc_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=doc_at[1:])
        starts, ends = split(codes, doc_at, self.leading_space)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        classes()
        hashes = K.spans_hash(_tables["mix"][codes], starts, ends)
        uniq, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool) if not len(self.keys) else self.keys[np.minimum(spot, len(self.keys) - 1)] == uniq
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.most:
                self.forget()
                known[:] = False
            fresh = where[~known]
            got = [self.encode(joined[a:b]) for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
            size = np.fromiter(map(len, got), np.int32, len(got))
            at = len(self.pool) + np.concatenate([[0], np.cumsum(size[:-1], dtype=np.int64)])
            self.pool = np.concatenate([self.pool, np.fromiter((i for g in got for i in g), np.int32, int(size.sum()))])
            keys = np.concatenate([self.keys, uniq[~known]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at, self.size = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
            spot = np.searchsorted(self.keys, uniq)
        size, at = self.size[spot][back].astype(np.int64), self.at[spot][back]
        end = np.cumsum(size)
        out = self.pool[np.repeat(at - (end - size), size) + np.arange(int(end[-1]))]
        begin = np.concatenate([[0], end])[np.searchsorted(starts, doc_at)]
        return out, begin


def read_model(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Vocabulary, merges in rank order and special tokens of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in found["model"]["merges"]]
    return found["model"]["vocab"], merges, {t["content"]: t["id"] for t in found.get("added_tokens", [])}


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def around_specials(text: str, specials: dict[str, int], pattern) -> list[str | int]:
    """Plain parts of a text and the ids of special strings between them."""
    out: list[str | int] = []
    at = 0
    for m in pattern.finditer(text):
        out += [text[at : m.start()], specials[m[0]]]
        at = m.end()
    return [*out, text[at:]]


#: Below this code point, NFC of composed text and lower case have long been the same in every Unicode version.
SETTLED = "\u0300"
_library_form = Sequence([NFC(), Lowercase()])


def lowered(text: str) -> str:
    """NFC, each character lower-cased by itself. (White space only separates pieces, so its runs can stay.)"""
    if text.isascii() or max(text) < SETTLED:
        return text.lower()
    return _library_form.normalize_str(text)
