"""Exact top-k by integer inner product: norm-bucketed retrieval.

Vectors become integers ``floor(scale * x)``. Candidates are sorted by length
(range partitions, longest first) and cut into buckets of bounded size whose
lengths differ by at most a tenth; queries are cut into blocks in the same way. The
partitions are searched in waves of 1, 4, 16, ... partitions. After a wave
each query keeps its ``k`` best so far, and the worst of them is its floor
``f`` for the next wave. For a query ``q`` and a bucket whose longest vector
has length ``l`` the local cosine threshold is ``f / (|q| l)``:

- above 1, no vector of the bucket can reach the floor: the pair is skipped, and
  a block of queries is not even sent to a partition that it cannot use;
- high thresholds use *coordinate* pruning: a unit vector within the angle of
  cosine ``t`` around ``q`` is within that angle, more or less, of each axis
  that ``q`` is from it, which bounds its coordinates. Sorted lists of the bucket's coordinates give the rows in the range of the
  query's largest coordinates; the narrowest list is taken, the others filter it;
- else *length* pruning: only the prefix of vectors with ``|p| >= f / |q|``.

What is left is verified by its exact product. So the result is exact: bounds
have a margin above the rounding of the lengths, and products are whole
numbers (in floating point only where every partial sum is an exact integer).

Memory and skew: blocks hold at most ``BLOCK_CELLS`` components and a task
holds one pair of blocks. Pairs of a wave are dealt by partition and a salt of
the query block, so few partitions still fill the cluster. Only per
partition one row of lengths (at most ``MAX_PARTITIONS``) is collected and broadcast.
Ties on length are split by the row's number, so equal vectors don't meet in
one partition.

Defined cases: null vectors and vectors with null or non-finite components take
no part; a query is scored against vectors of its own length alone. Every row but the query's
own is a candidate, also one with the same key; equal scores rank by smaller
key (null last). Fewer than ``k`` candidates give all of them. Components
whose products could overflow are an error. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import prepare
from trellis.llm.vectors import BLOCK_CELLS, floors, parallelism, small_batches, spread, usable
from trellis.session import cut_lineage

SCALE, K = 64, 20
MAX_PARTITIONS = 10_000
#: A bucket ends where a vector is shorter than this share of its longest.
NARROW = 0.9
#: From this local cosine threshold coordinates are tried, the FOCUS largest of the query's.
COORD_FROM, FOCUS = 0.6, 4
#: Coordinates are used if their narrowest list has at most this share of the rows that length pruning leaves.
WORTH = 0.25
EPS = 1e-9
ROWS_AT_ONCE = 512


@dataclass
class Block:
    """Integer vectors, longest first, with their lengths, row numbers and keys."""
    no: int
    v: np.ndarray
    uid: np.ndarray
    keys: pa.Array
    length: np.ndarray = field(init=False)

    def __post_init__(self):
        self.length = np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1))
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._tie = None

    def unit(self) -> np.ndarray:
        return self.v / np.maximum(self.length, 1e-300)[:, None]

    def coordinate(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted values of a coordinate of the unit vectors, and their rows."""
        if i not in self._lists:
            x = self.v[:, i] / np.maximum(self.length, 1e-300)
            order = np.argsort(x, kind="stable")
            self._lists[i] = x[order], order
        return self._lists[i]

    @property
    def tie(self) -> np.ndarray:
        """Place of each row by key (null last), then row number."""
        if self._tie is None:
            order = pa.Table.from_arrays([self.keys, pa.array(self.uid)], ["k", "u"])
            order = pa.compute.sort_indices(order, [("k", "ascending"), ("u", "ascending")], null_placement="at_end").to_numpy()
            self._tie = np.empty(len(order), np.int64)
            self._tie[order] = np.arange(len(order))
        return self._tie


def _exact(q: Block, c: Block) -> type:
    """Number type in which the products of two blocks, and all their partial sums, are exact."""
    most = float(q.length.max(initial=0)) * float(c.length.max(initial=0))
    if most >= 2.0 ** 62:
        raise ValueError("vector components so large that their products overflow")
    return np.float32 if most < 2 ** 23 else np.float64 if most < 2 ** 52 else np.int64


def _best(score: np.ndarray, at: np.ndarray, floor: float, c: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``at`` of one query that reach the floor, at most the ``k`` best."""
    keep = score >= floor
    score, at = score[keep], at[keep]
    if len(at) > k:
        first = np.lexsort((c.tie[at], -score))[:k]
        score, at = score[first], at[first]
    return score, at


def search_pair(q: Block, c: Block, floor: np.ndarray, k: int, coord_from: float = COORD_FROM, focus: int = FOCUS,
                used: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query of ``q`` its ``k`` best rows of ``c`` that reach its floor: query row, candidate row, score.

    ``floor`` is -inf where a query has none. ``used`` counts the (query, bucket) pairs by the way taken.
    """
    used = {} if used is None else used
    kind = _exact(q, c)
    own: dict[int, int] = {}
    _, mine, theirs = np.intersect1d(q.uid, c.uid, assume_unique=True, return_indices=True)
    own.update(zip(mine.tolist(), theirs.tolist()))
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(q.length > 0, floor / q.length, np.where(floor <= 0, -np.inf, np.inf)) * (1 - EPS)
        cosine = np.where(reach > 0, reach / c.length[0] if c.length[0] > 0 else np.inf, -1.0)
    prefix = np.searchsorted(-c.length, -reach, side="right")
    alive = (prefix > 0) & (cosine <= 1)
    used["skipped"] = used.get("skipped", 0) + int((~alive).sum())
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    by_length = []
    whole = c.v.astype(np.int64) if (cosine[alive] >= coord_from).any() else None
    for i in np.flatnonzero(alive).tolist():
        rows = _by_coordinates(q, c, i, float(cosine[i]), int(prefix[i]), focus) if cosine[i] >= coord_from else None
        if rows is None:
            by_length.append(i)
            continue
        used["coordinate"] = used.get("coordinate", 0) + 1
        rows = rows[rows != own.get(i, -1)]
        s, at = _best(whole[rows] @ q.v[i].astype(np.int64), rows, floor[i], c, k)
        out.append((np.full(len(at), i), at, s))
    used["length"] = used.get("length", 0) + len(by_length)
    for lo in range(0, len(by_length), ROWS_AT_ONCE):
        part = np.array(by_length[lo:lo + ROWS_AT_ONCE])
        n = int(prefix[part].max())
        score = q.v[part].astype(kind) @ c.v[:n].astype(kind).T
        least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        for row, i in enumerate(part.tolist()):
            if own.get(i, n) < n:
                score[row, own[i]] = least
        bar = floor[part]
        if n > k:
            bar = np.maximum(bar, np.partition(score, n - k, axis=1)[:, n - k])
        hit = (score >= bar[:, None]) & (score > least)
        row, at = np.nonzero(hit)
        s = score[row, at].astype(np.int64)
        order = np.lexsort((c.tie[at], -s, row))
        row, at, s = row[order], at[order], s[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        out.append((part[row[place < k]], at[place < k], s[place < k]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([np.asarray(o[j], np.int64) for o in out]) for j in range(3))


def _by_coordinates(q: Block, c: Block, i: int, cosine: float, prefix: int, focus: int) -> np.ndarray | None:
    """Rows of the bucket that the query's largest coordinates leave, or None if that isn't worth it."""
    unit = q.v[i] / q.length[i]
    apart = np.arccos(min(1.0, cosine))
    ranges = []
    for d in np.argsort(-np.abs(unit), kind="stable")[:focus].tolist():
        angle = np.arccos(np.clip(unit[d], -1, 1))
        low, high = np.cos(min(np.pi, angle + apart)) - 1e-7, np.cos(max(0.0, angle - apart)) + 1e-7
        values, order = c.coordinate(d)
        a, b = np.searchsorted(values, low, side="left"), np.searchsorted(values, high, side="right")
        ranges.append((int(b - a), d, low, high, order[a:b]))
    if not ranges:
        return None
    ranges.sort(key=lambda r: r[:2])
    if ranges[0][0] > WORTH * prefix:
        return None
    rows = ranges[0][4]
    rows = rows[rows < prefix]
    for _, d, low, high, _ in ranges[1:]:
        x = c.v[rows, d] / np.maximum(c.length[rows], 1e-300)
        rows = rows[(x >= low) & (x <= high)]
    return rows


def _integer_rows(scale: int):
    """Rows ``(key, v, asks)`` with their vectors as integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = floors(b.column(1), scale, (1 << 31) - 1)
            dims = np.diff(np.asarray(b.column(1).offsets)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(dims)])
            square = np.concatenate([[0.0], np.cumsum(np.square(flat, dtype=np.float64))])  # of the sort key only
            whole = flat.astype("<i4").tobytes()
            v = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(dims), pa.array(np.sqrt(np.maximum(square[ends[1:]] - square[ends[:-1]], 0))), v, b.column(2)],
                ["key", "dims", "length", "v", "asks"])
    return run


def _to_blocks(most_rows: int):
    """Sorted rows ``(key, dims, length, v, uid, part)`` into bucket rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first, n, made = None, 0, 0

        def flush():
            nonlocal held, n, made
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            dims, part = t.column("dims")[0].as_py(), t.column("part")[0].as_py()
            v = np.frombuffer(b"".join(t.column("v").to_pylist()), "<i4").reshape(t.num_rows, dims)
            exact = (v.astype(np.float64) ** 2).sum(axis=1)
            order = np.argsort(-exact, kind="stable")
            t, v = t.take(pa.array(order)), v[order]
            row = {"part": [part], "block": [(part << 32) + made], "dims": [dims], "n": [t.num_rows], "longest": [float(np.sqrt(exact[order[0]]))],
                   "uid": [np.asarray(t.column("uid")).astype("<i8").tobytes()], "v": [v.tobytes()]}
            keys = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column("key"))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
            held, n, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([*[pa.array(x, k) for x, k in zip(row.values(), kinds)], keys], [*row, "keys"])

        for b in batches:
            dims, length = np.asarray(b.column("dims")), np.asarray(b.column("length"))
            at = 0
            while at < b.num_rows:
                if not n:
                    first = (dims[at], length[at])
                full = max(1, min(most_rows, BLOCK_CELLS // max(1, int(first[0]))))
                other = (dims[at:] != first[0]) | (length[at:] < NARROW * first[1])
                stop = int(other.argmax()) if other.any() else len(other)
                take = min(stop, full - n)
                if take:
                    held.append(b.slice(at, take))
                    n, at = n + take, at + take
                if n and (n == full or at < b.num_rows):
                    yield flush()
        if n:
            yield flush()
    return run


def _blocks(rows: DataFrame, n_rows: int, most_rows: int) -> DataFrame:
    """Bucket rows, numbered so that ``part`` (the range partition) runs from the longest to the shortest of each vector length."""
    parts = max(1, min(MAX_PARTITIONS, -(-n_rows // most_rows)))
    order = [F.col("dims"), F.desc("length"), F.col("uid")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("bigint"))
    kind = rows.schema["key"].dataType.simpleString()
    return cut_lineage(dealt.mapInArrow(_to_blocks(most_rows), f"part bigint, block bigint, dims bigint, n bigint, longest double, uid binary, v binary, keys array<{kind}>"))


def _block_of(row: pa.RecordBatch, side: str) -> Block:
    no, n, dims, uid, v = (row.column(f"{side}_{x}")[0].as_py() for x in ("block", "n", "dims", "uid", "v"))
    return Block(no, np.frombuffer(v, "<i4").reshape(n, dims), np.frombuffer(uid, "<i8"), row.column(f"{side}_keys").flatten())


def _search(k: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, Block] = {}
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                for side in ("q", "c"):
                    if side not in last or last[side].no != row.column(f"{side}_block")[0].as_py():
                        last[side] = _block_of(row, side)
                q, c = last["q"], last["c"]
                floor = np.full(len(q.uid), -np.inf)
                known = row.column("floors")[0].as_py() or []
                floor[[x["pos"] for x in known]] = [x["floor"] for x in known]
                i, j, score = search_pair(q, c, floor, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), q.no), pa.int64()), pa.array(i, pa.int64()), q.keys.take(pa.array(i)),
                     pa.array(c.uid[j], pa.int64()), c.keys.take(pa.array(j)), pa.array(score, pa.int64())], names)
    return run


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vec: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, <key>, score)``: the ``k`` best rows of ``df`` for each row for which ``is_query`` holds."""
    spark = df.sparkSession
    prepare(spark)
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(usable(F.col(vec))).select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v"),
                                               F.coalesce(is_query, F.lit(False)).alias("asks"))
    ints = spread(rows).select("key", "v", "asks")
    whole = ints.mapInArrow(_integer_rows(scale), f"key {kind}, dims bigint, length double, v binary, asks boolean")
    whole = cut_lineage(whole.withColumn("uid", F.monotonically_increasing_id()))
    counts = whole.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("bigint")).alias("asked")).first()
    tasks = 4 * parallelism(spark)
    cand = _blocks(whole.drop("asks"), counts.n, max(512, -(-counts.n // tasks)))
    asked = _blocks(whole.where("asks").drop("asks"), counts.asked or 0, max(64, -(-(counts.asked or 0) // tasks)))
    asked = asked.drop("part")
    sizes = cand.groupBy("part", "dims").agg(F.max("longest").alias("longest")).collect()
    names = ["q_block", "pos", "query_id", "uid", "key", "score"]
    schema = f"q_block bigint, pos bigint, query_id {kind}, uid bigint, key {kind}, score bigint"
    best = spark.createDataFrame([], schema)
    place = Window.partitionBy("q_block", "pos").orderBy(F.desc("score"), F.asc_nulls_last("key"), "uid")
    parts = sorted({r.part for r in sizes})
    start, width = 0, 1
    while start < len(parts):
        wave = parts[start:start + width]
        found = _wave(asked, cand, best, [r for r in sizes if wave[0] <= r.part <= wave[-1]], wave, tasks, k).mapInArrow(_search(k, names), schema)
        with small_batches(spark):
            best = cut_lineage(best.unionByName(found).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).drop("rank"))
        start, width = start + width, 4 * width
    return best.withColumn("rank", F.row_number().over(place)).select("query_id", "rank", F.col("key").alias(key), "score")


def _wave(asked: DataFrame, cand: DataFrame, best: DataFrame, sizes: list, wave: list[int], tasks: int, k: int) -> DataFrame:
    """Pairs of a query block (with its floors) and a bucket of the wave's partitions that it may use."""
    spark = asked.sparkSession
    floors_ = (best.groupBy("q_block", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
               .groupBy("q_block").agg(F.collect_list(F.struct("pos", "floor")).alias("floors"), F.min("floor").alias("least"), F.count(F.lit(1)).alias("have")))
    known = asked.join(floors_, asked.block == floors_.q_block, "left")
    lengths = spark.createDataFrame([(r.part, r.dims, r.longest) for r in sizes], "part bigint, c_dims bigint, c_longest double")
    # a whole block can skip a partition only if all its queries have a floor
    usable_ = (F.col("dims") == F.col("c_dims")) & (
        F.col("have").isNull() | (F.col("have") < F.col("n")) | (F.col("c_longest") * F.col("longest") * (1 + EPS) >= F.col("least")))
    salts = max(1, -(-tasks // len(wave)))
    n = min(len(wave) * salts, 4 * tasks)
    q = (known.join(F.broadcast(lengths), usable_)
         .select("part", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), "floors", *[F.col(x).alias(f"q_{x}") for x in ("block", "n", "dims", "uid", "v", "keys")]))
    c = (cand.where(F.col("part").between(wave[0], wave[-1])).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
         .select("part", "salt", *[F.col(x).alias(f"c_{x}") for x in ("block", "n", "dims", "uid", "v", "keys")]))
    return (q.repartition(n, "part", "salt").hint("merge").join(c.repartition(n, "part", "salt"), ["part", "salt"])
            .where("q_dims = c_dims").drop("part", "salt"))
