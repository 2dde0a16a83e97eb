"""Exact byte-pair-encoding token counts of texts, by merging in the engine.

A text is cut by the encoding's pattern into pre-tokens; each is merged on its own: the neighbouring
parts whose joined bytes have the lowest rank become one part (the leftmost of equal ones), until no pair has a rank.
The parts form a linked list and the pairs a heap, so a pre-token of n bytes takes n log n steps, however long.
Counts of short pre-tokens are remembered in two generations of bounded bytes.

The rank table (a line ``<base64 bytes> <rank>`` per entry; its size is the vocabulary's) is read where the
query is planned and broadcast; NULL counts 0. ``text.pre_token_count`` is the native estimate.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Pre-tokenizer pattern of the cl100k-style encodings (fixed value).
CL100K_PATTERN = (r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*"""
                  r"""|\s*[\r\n]+|\s+(?!\S)|\s+""")
#: Pre-tokens of at most so many bytes are remembered, and bytes of one generation of them.
MEMO_WORD, MEMO_BYTES = 64, 16 << 20


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Rank table of a file on any file system of the session."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path if "://" in path else f"file://{path}")
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        lines = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).split(b"\n")
    finally:
        stream.close()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of a pre-token after all merges."""
    if word in ranks:
        return [word]
    n = len(word)
    end = list(range(1, n + 1))     # end of the part that starts here; 0: no part starts here
    before = list(range(-1, n - 1))  # start of the part before

    def pair(at: int) -> tuple[int, int, int] | None:
        right = end[at]
        if right >= n:
            return None
        rank = ranks.get(word[at:end[right]])
        return None if rank is None else (rank, at, end[right])

    heap = [p for p in map(pair, range(n)) if p is not None]
    heapq.heapify(heap)
    while heap:
        _, at, stop = heapq.heappop(heap)
        right = end[at]
        if not right or right >= n or end[right] != stop:  # one of the two parts has changed since
            continue
        end[at], end[right] = stop, 0
        if stop < n:
            before[stop] = at
        for left in (at, before[at]):
            if left >= 0 and (p := pair(left)) is not None:
                heapq.heappush(heap, p)
    parts, at = [], 0
    while at < n:
        parts.append(word[at:end[at]])
        at = end[at]
    return parts


class Counter:
    """Token counts of texts with a memo of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.cut = ranks, regex.compile(pattern)
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.size = 0

    def word(self, word: str) -> int:
        n = self.new.get(word)
        if n is not None:
            return n
        n = self.old.get(word)
        raw = word.encode("utf-8", "replace")
        if n is None:
            n = 1 if raw in self.ranks else len(merge(raw, self.ranks))
        if len(raw) <= MEMO_WORD:
            if self.size > MEMO_BYTES:
                self.old, self.new, self.size = self.new, {}, 0
            self.new[word] = n
            self.size += len(raw) + 100
        return n

    def text(self, text: str | None) -> int:
        return sum(self.word(m.group()) for m in self.cut.finditer(text)) if text else 0


_COUNTERS: dict[tuple, Counter] = {}


def bpe_token_count(spark: SparkSession, col, rank_file: str, pattern: str = CL100K_PATTERN) -> Column:
    """Token count of each value under the ranks in ``rank_file``; NULL counts 0."""
    ranks = spark.sparkContext.broadcast(read_ranks(spark, rank_file))
    key = (rank_file, pattern)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(ranks.value, pattern)
        for s in batches:
            yield s.map(_COUNTERS[key].text).astype("int64")
    return count(F.col(col) if isinstance(col, str) else col)
