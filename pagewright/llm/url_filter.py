"""URL rules in a sorted array of 64-bit digests, memory-mapped on every executor.

A rule is a host with a path prefix, such as ``example.org/es/``. Its key is the
xxhash64 of the rule string; keys are sorted in one file, with the strings and
verdicts beside them. The file is sent with ``addFile`` (each executor fetches one
copy, a new executor fetches it again) and memory-mapped. A batch of urls gives all
its candidate strings (host suffixes x rule path lengths), whose digests are
searched by one vectorised binary search; a hit counts only if the stored string
is equal, so a digest collision can't give a wrong verdict.

Size: 8 + 4 + 1 bytes a rule and the strings; ``MAX_FILE`` bounds the file, as each
executor holds a copy.

Defined results: null urls and urls without ``://`` have empty host and path, fit no
rule and get the default verdict; empty tables give empty results; clashing extra
columns are not read. Of rules that fit, the longest string wins (equal strings:
the first given).
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest rule file that is sent to executors, in bytes.
MAX_FILE = 2 << 30

_open: dict[str, "DigestArray"] = {}
_published: set[tuple[str, str]] = set()


def host_of(rest: Column) -> Column:
    """The host of what follows ``://``, A-Z lower-cased."""
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_urls(pages: DataFrame, url_column: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep columns, host and path of every url."""
    base = pages.select(*[F.col(c) for c in keep], F.coalesce(F.col(url_column), F.lit("")).alias("__u"))
    rest = F.when(F.instr(F.col("__u"), "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise(F.lit(""))
    return base.withColumn("__r", rest).select(*keep, host_of(F.col("__r")).alias("host"), F.regexp_extract("__r", r"^[^/?#]*([^?#]*)", 1).alias("path"))


class DigestArray:
    """The file's three parts; ``keys`` is a memory map."""

    def __init__(self, path: str):
        head = np.fromfile(path, np.int64, 3)
        n, text_bytes, n_lengths = map(int, head)
        at = 24
        self.lengths = np.fromfile(path, np.int32, n_lengths, offset=at).tolist()
        at += 4 * n_lengths
        self.keys = np.memmap(path, np.uint64, "r", at, (n,)) if n else np.zeros(0, np.uint64)
        at += 8 * n
        self.offsets = np.memmap(path, np.int64, "r", at, (n + 1,))
        at += 8 * (n + 1)
        self.block = np.memmap(path, np.int8, "r", at, (n,)) if n else np.zeros(0, np.int8)
        at += n
        self.text = np.memmap(path, np.uint8, "r", at, (text_bytes,)) if text_bytes else np.zeros(0, np.uint8)

    @staticmethod
    def write(path: str, rules: list[tuple[str, bool]]) -> None:
        """rules: (host + path, block?); the path starts with the first ``/``."""
        first: dict[bytes, bool] = {}
        for rule, block in rules:
            first.setdefault(rule.encode(), block)
        rows = sorted((xxhash.xxh64_intdigest(r), r, b) for r, b in first.items())
        lengths = sorted({len(r.decode()) - r.decode().find("/") for r in first})
        size = sum(len(r) for r in first) + 17 * len(first)
        if size > MAX_FILE:
            raise ValueError(f"{size} bytes of rules; at most {MAX_FILE} are sent to each executor")
        with open(path, "wb") as f:
            np.array([len(rows), sum(len(r) for _, r, _ in rows), len(lengths)], np.int64).tofile(f)
            np.array(lengths, np.int32).tofile(f)
            np.array([k for k, _, _ in rows], np.uint64).tofile(f)
            np.concatenate([[0], np.cumsum([len(r) for _, r, _ in rows])]).astype(np.int64).tofile(f)
            np.array([b for _, _, b in rows], np.int8).tofile(f)
            f.write(b"".join(r for _, r, _ in rows))

    def stored(self, k: int) -> bytes:
        return self.text[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """Index of each string in the array, or -1."""
        want = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        out = np.full(len(want), -1)
        if not len(self.keys) or not len(want):
            return out
        lo = np.searchsorted(self.keys, want)
        hit = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == want)
        for i in hit.tolist():
            k = int(lo[i])
            while k < len(self.keys) and self.keys[k] == want[i]:  # strings that share a digest
                if self.stored(k) == candidates[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """The longest rule that fits each url."""
        where: dict[bytes, int] = {}
        tried: list[list[int]] = []
        for host, path in zip(hosts, paths, strict=True):
            ends = [path[:n] for n in self.lengths if n <= len(path)]
            labels, mine, at = host, [], 0
            while ends:
                mine += [where.setdefault((labels[at:] + e).encode(), len(where)) for e in ends]
                dot = labels.find(".", at)
                if dot < 0:
                    break
                at = dot + 1
            tried.append(mine)
        found = self.find(list(where))
        texts = {int(k): self.stored(int(k)).decode() for k in np.unique(found[found >= 0])}
        out = []
        for mine in tried:
            best = max(((texts[k], k) for i in mine if (k := int(found[i])) >= 0), key=lambda x: (len(x[0]), x[0]), default=None)
            out.append(best and (best[0], bool(self.block[best[1]])))
        return out


def publish(spark: SparkSession, rules: list[tuple[str, bool]]) -> str:
    """Send the rule file to the executors, once an application; its name."""
    name = "rules-" + hashlib.sha256(repr(rules).encode()).hexdigest()[:24] + ".bin"
    known = (spark.sparkContext.applicationId, name)
    if known not in _published:
        path = os.path.join(tempfile.mkdtemp(prefix="pagewright-rules-"), name)
        DigestArray.write(path, rules)
        spark.sparkContext.addFile(path)
        _published.add(known)
    return name


def judge_urls(pages: DataFrame, rules: list[tuple[str, bool]], url_column: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """keep columns, host, path, rule (null if none fits) and verdict of every url; other columns aren't read."""
    name = publish(pages.sparkSession, rules)

    @F.arrow_udf("struct<rule: string, block: boolean>")
    def probe(host: pa.Array, path: pa.Array) -> pa.Array:
        if name not in _open:
            _open.clear()
            _open[name] = DigestArray(SparkFiles.get(name))
        got = _open[name].judge(host.to_pylist(), path.to_pylist())
        return pa.array([g and {"rule": g[0], "block": g[1]} for g in got], pa.struct([("rule", pa.string()), ("block", pa.bool_())]))

    judged = split_urls(pages, url_column, keep).withColumn("__hit", probe("host", "path"))
    verdict = F.when(F.col("__hit.block"), "block").when(~F.col("__hit.block"), "allow").otherwise(F.lit(default))
    return judged.select(*keep, "host", "path", F.col("__hit.rule").alias("rule"), verdict.alias("verdict"))
