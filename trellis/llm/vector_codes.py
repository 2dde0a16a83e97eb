"""Vector code compression (product quantisation) by per-dimension value dictionaries.

A vector's components become integers ``floor(scale * x)`` and are cut into
consecutive parts; every part is coded as the index of its nearest codebook
entry. The integers of one dimension repeat (a unit vector's lie within
``2 * scale + 1`` values), so a block of rows is stored as one dictionary of
distinct integers per dimension and a column of dictionary codes. A round
tabulates the squared difference of every distinct integer to all entries'
component of that dimension; the distance of a part to all entries is then a
gather from each of its dimensions' tables and an add. No difference is squared
per row.

Blocks are checkpointed rows of at most ``BLOCK_CELLS`` components; a dictionary
never has more values than its block has rows, so it needs no bound on the
range of the data and nothing that grows with the data is broadcast or
collected. A round reads the blocks once and shuffles one row per task and
codebook component; the driver holds the codebooks (``entries`` times
the vector length) alone.

The codebook of a part starts as that part of the first ``entries`` rows by key
(null keys last, repeated keys by vector); with fewer rows it has as many
entries. Distances are exact integers, ties go to the lower index. Each round
replaces an entry by the floor of its parts' componentwise mean; unused entries
stay.

Defined cases: rows whose vector is null or has null or non-finite components
are left out. Coded are the vectors of the most frequent length (ties: the
longer); rows of another length stay, with null code and error. Parts are as
equal as the length allows, the first ones longer; a length of 0 has
error 0. Repeated rows count as often as they occur. Components so large that
integer arithmetic would overflow are an error. An empty table
gives an empty result. Only the key and the group column pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import prepare, spread_lookup
from trellis.llm.vectors import BLOCK_CELLS, floors, pieces_of, small_batches, spread, usable
from trellis.session import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def part_bounds(dims: int, parts: int) -> list[tuple[int, int]]:
    """First and last dimension (exclusive) of each part."""
    size, more = divmod(dims, parts)
    ends = [0]
    for i in range(parts):
        ends.append(ends[-1] + size + (i < more))
    return list(zip(ends, ends[1:]))


def most_component(dims: int) -> int:
    """Largest integer whose squared differences sum to a 64-bit integer over ``dims`` dimensions."""
    return int(((1 << 62) // max(dims, 1)) ** 0.5) // 2


def encode_block(ints: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Codes (dimension by dimension), dictionary values and dictionary sizes of a block of rows."""
    codes, values, sizes = [], [], []
    for column in ints.T:
        distinct, code = np.unique(column, return_inverse=True)
        codes.append(code.astype("<u4"))
        values.append(distinct.astype("<i8"))
        sizes.append(len(distinct))
    return b"".join(c.tobytes() for c in codes), b"".join(v.tobytes() for v in values), np.array(sizes, "<i4").tobytes()


def decode_block(codes: bytes, values: bytes, sizes: bytes, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes as ``(dimension, row)`` and each dimension's dictionary."""
    ends = np.cumsum(np.frombuffer(sizes, "<i4"))
    flat = np.frombuffer(values, "<i8")
    return np.frombuffer(codes, "<u4").reshape(len(ends), rows), np.split(flat, ends[:-1]) if len(ends) else []


def assign(codes: np.ndarray, dictionary: list[np.ndarray], book: np.ndarray, bounds: list[tuple[int, int]],
           rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance, ``(row, part)`` each; ``book`` is ``(entry, dimension)``."""
    index, least = np.zeros((rows, len(bounds)), np.int64), np.zeros((rows, len(bounds)), np.int64)
    for p, (lo, hi) in enumerate(bounds):
        distance = np.zeros((rows, len(book)), np.int64)
        for d in range(lo, hi):
            table = np.square(dictionary[d][:, None] - book[:, d])
            distance += table[codes[d]]
        index[:, p] = distance.argmin(axis=1)  # the first of equal ones
        least[:, p] = np.take_along_axis(distance, index[:, p, None], axis=1)[:, 0]
    return index, least


def gathered(codes: np.ndarray, dictionary: list[np.ndarray], index: np.ndarray, bounds: list[tuple[int, int]],
             entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the parts' components and number of parts by entry: ``(entry, dimension)`` both."""
    total = np.zeros((entries, len(codes)), np.int64)
    count = np.zeros((entries, len(codes)), np.int64)
    for p, (lo, hi) in enumerate(bounds):
        members = [np.flatnonzero(index[:, p] == e) for e in range(entries)]
        for d in range(lo, hi):
            values = dictionary[d][codes[d]]
            for e, at in enumerate(members):
                total[e, d] = values[at].sum()
                count[e, d] = len(at)
    return total, count


BLOCK = "codes binary, dict binary, sizes binary, n bigint"


def _to_blocks(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, max(1, BLOCK_CELLS // max(dims, 1))):
            ints = floors(b.column(2), scale, most_component(dims)).reshape(b.num_rows, dims)
            codes, values, sizes = encode_block(ints)
            one = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(i)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*one, *[pa.array([x], pa.binary()) for x in (codes, values, sizes)], pa.array([b.num_rows], pa.int64())],
                ["key", "grp", "codes", "dict", "sizes", "n"])
    return run


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray], int]]:
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            codes, values, sizes, n = (row.column(c)[0].as_py() for c in ("codes", "dict", "sizes", "n"))
            yield row, *decode_block(codes, values, sizes, n), n


def _sums(book: np.ndarray, bounds: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(book.shape, object), np.zeros(book.shape, np.int64)
        for _, codes, dictionary, n in _block_rows(batches):
            index, _ = assign(codes, dictionary, book, bounds, n)
            t, c = gathered(codes, dictionary, index, bounds, len(book))
            total, count = total + t, count + c
        e, d = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(e, pa.int32()), pa.array(d, pa.int32()), pa.array([str(x) for x in total[e, d]], pa.string()), pa.array(count[e, d], pa.int64())],
            ["e", "d", "total", "n"])
    return run


def _coded(book: np.ndarray, bounds: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, codes, dictionary, n in _block_rows(batches):
            index, least = assign(codes, dictionary, book, bounds, n)
            text = index.astype(np.uint8).tobytes().hex()
            width = 2 * len(bounds)
            yield pa.RecordBatch.from_arrays(
                [row.column("key").flatten(), row.column("grp").flatten(),
                 pa.array([text[i:i + width] for i in range(0, n * width, width)], pa.string()), pa.array(least.sum(axis=1), pa.int64())],
                ["key", "grp", "code", "error"])
    return run


def train(blocks: DataFrame, book: np.ndarray, bounds: list[tuple[int, int]], rounds: int) -> np.ndarray:
    """Codebooks ``(entry, dimension)`` after the rounds over the blocks."""
    for _ in range(rounds):
        with small_batches(blocks.sparkSession):
            sums = (blocks.select("codes", "dict", "sizes", "n").mapInArrow(_sums(book, bounds), "e int, d int, total string, n bigint")
                    .groupBy("e", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect())
        book = book.copy()
        for r in sums:
            book[r.e, r.d] = int(r.total) // r.n
    return book


def book_digest(book: np.ndarray, bounds: list[tuple[int, int]]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for lo, hi in bounds for e in book for x in e[lo:hi].tolist()).encode()).hexdigest()


def code_vectors(df: DataFrame, key: str = "vec_id", vec: str = "embedding", group: str = "label", scale: int = SCALE,
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``(key, group, code, error, group_error)`` of every usable vector, and the codebooks ``(entry, dimension)``."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    spark = df.sparkSession
    prepare(spark)
    rows = df.where(usable(F.col(vec))).select(F.col(key).alias("key"), F.col(group).alias("grp"), F.col(vec).cast("array<double>").alias("v"))
    top = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = top.dims if top else 0
    bounds = part_bounds(dims, parts)
    same = rows.where(F.size("v") == dims)
    first = same.orderBy(F.asc_nulls_last("key"), "v").limit(entries).collect()
    book = floors(pa.array([r.v for r in first], pa.list_(pa.float64())), scale, most_component(dims)).reshape(len(first), dims)
    kinds = f"key array<{rows.schema['key'].dataType.simpleString()}>, grp array<{rows.schema['grp'].dataType.simpleString()}>"
    blocks = cut_lineage(spread(same).mapInArrow(_to_blocks(dims, scale), f"{kinds}, {BLOCK}"))
    book = train(blocks, book, bounds, rounds) if len(first) else book
    with small_batches(spark):
        flat = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("key", "grp"))
        coded = blocks.mapInArrow(_coded(book, bounds), f"{flat}, code string, error bigint")
        other = rows.where(F.size("v") != dims).select("key", "grp", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
        coded = cut_lineage(coded.unionByName(other).withColumn("same", F.to_json(F.struct("grp"))))
    sums = cut_lineage(coded.groupBy("same").agg(F.sum("error").alias("group_error"), F.count(F.lit(1)).alias("n")))
    out = spread_lookup(coded, sums, ["same"], "n", coded.count())
    return out.select(F.col("key").alias(key), F.col("grp").alias(group), "code", "error", "group_error"), book
