"""SimHash near-duplicates by multi-index hashing.

The 64-bit fingerprint takes the majority of every bit over the XXH64 (seed 42)
of the 3-word shingles. Fingerprints that differ in at most 3 bits have one
32-bit half that differs in at most 1 (pigeonhole). So each distinct
fingerprint is stored under both halves, and looks up the Hamming ball of
radius 1 around each half; the complete distance is verified in the join.
Of two halves one bit apart, only the one without the bit looks up the other,
which halves the probes. Equal fingerprints are one node before
any lookup, so a group of exact copies costs one row.

A half shared by many fingerprints is handled without all its pairs. First its members that are within one bit of a common
value are linked to the smallest of them (so a cluster of near copies becomes one component). Then a crowded bucket is
searched by the same method on the other half: its halves, with balls of radius 1, and so on down to 8 bits; pairs
inside the bucket's largest component are left out, for only links between components are needed. Buckets that are
not crowded are joined and verified at once.

Defined cases: null text counts as empty; texts without words have
fingerprint zero, linked like any other; fewer than three words are one
shingle; null ``doc_id`` rows are linked too and get their component's smallest
id (null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import components, prepare, spread_lookup, with_row_key, without_rows
from trellis.session import cut_lineage

SEED, BITS, RADIUS = 42, 64, 3
BLOCK = 1 << 16
#: A bucket with more fingerprints is crowded; bits of the narrowest value that is split; fingerprints of a task that makes balls.
CROWD, LAST, TASK_ROWS = 64, 16, 50_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None) -> int:
    """Majority fingerprint of the 3-word shingles, as a signed 64-bit integer. Works in blocks of words."""
    w = (text or b"").translate(_LOWER).split()
    if not w:
        return 0
    if len(w) < 3:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(w), SEED)).astype(np.int64))
    hash_, join = xxhash.xxh64_intdigest, b" ".join
    n, ones = len(w) - 2, np.zeros(BITS, np.int64)
    for lo in range(0, n, BLOCK):
        part = w[lo:lo + BLOCK + 2]
        h = np.array([hash_(s, SEED) for s in map(join, zip(part, part[1:], part[2:]))], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([fingerprint(t) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], [*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """``ids`` and ``fp`` per row."""
    prepare(docs.sparkSession)
    src = docs.select(*ids, F.col(text).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(_fingerprints, f"{kept}, fp bigint")


def _shift(value: Column, n: Column, left: bool = True) -> Column:
    return F.call_function("shiftleft" if left else "shiftrightunsigned", value, n)


def _part(value: str, width: int, seg: int) -> Column:
    """The lower (0) or upper (1) half of the lowest ``width`` bits."""
    low = F.lit((1 << width // 2) - 1).cast("bigint")
    return (F.col(value) if seg == 0 else F.shiftrightunsigned(value, width // 2)).bitwiseAND(low)


def _close_stars(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints within one bit of a common value."""
    ball = fps.select("fp", F.explode(F.concat(
        F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)),
                                   lambda i: F.col("fp").bitwiseXOR(_shift(F.lit(1).cast("bigint"), i))))).alias("key"))
    least = F.min("fp").over(Window.partitionBy("key"))
    return ball.select("fp", least.alias("b")).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def _halves(rows: DataFrame, width: int) -> DataFrame:
    """Both halves of ``value`` as ``seg, key``, with the other one as ``rest``."""
    each = F.array(*[F.struct(F.lit(s).alias("seg"), _part("value", width, s).alias("key"), _part("value", width, 1 - s).alias("rest")) for s in (0, 1)])
    return rows.select("path", "fp", "c", F.explode(each).alias("k")).select("path", "fp", "c", "k.*")


def _balls(rows: DataFrame, width: int, up: bool) -> DataFrame:
    """Rows of ``_halves`` for every key of at most one bit's difference (``up``: a bit more, not less)."""
    one, key = F.lit(1).cast("bigint"), F.col("key")
    bits = F.sequence(F.lit(0), F.lit(width // 2 - 1))
    if up:
        bits = F.filter(bits, lambda i: _shift(key, i, left=False).bitwiseAND(one) == 0)
    ball = F.concat(F.array(key), F.transform(bits, lambda i: key.bitwiseXOR(_shift(one, i))))
    return _halves(rows, width).withColumn("key", F.explode(ball))


BUCKET = ["path", "seg", "key"]


def _far_links(nodes: DataFrame) -> list[DataFrame]:
    """Links ``(a, b)`` between the components ``c`` of ``nodes (fp, c)`` whose fingerprints are within the radius."""
    out = []
    asked = stored = nodes.select(F.lit(0).cast("bigint").alias("path"), F.col("fp").alias("value"), "fp", "c")
    width = BITS
    while True:
        probes, held = _balls(asked, width, up=width == BITS), _halves(stored, width)
        last = width == LAST
        if not last:
            of = held.groupBy(*BUCKET, "c").agg(F.count(F.lit(1)).alias("n"))
            crowded = cut_lineage(of.groupBy(*BUCKET).agg(F.sum("n").alias("n"), F.max_by("c", "n").alias("most")).where(F.col("n") > CROWD).drop("n"))
            last = crowded.isEmpty()
        light = held if last else held.join(crowded.select(*BUCKET), BUCKET, "left_anti")
        out.append(probes.alias("p").join(light.alias("s"), BUCKET).where(f"p.c <> s.c AND bit_count(p.fp ^ s.fp) <= {RADIUS}")
                   .select(F.least("p.c", "s.c").alias("a"), F.greatest("p.c", "s.c").alias("b")).distinct())
        if last:
            return out
        # the rest of a crowded bucket is searched by its other half, without pairs inside its largest component
        def lane(rows, no):
            return rows.select(F.xxhash64(*BUCKET, F.lit(no)).alias("path"), F.col("rest").alias("value"), "fp", "c")
        p, s = probes.join(crowded, BUCKET), held.join(crowded, BUCKET)
        asked = cut_lineage(lane(p.where("c = most"), 0).unionByName(lane(p.where("c <> most"), 1)))
        stored = cut_lineage(lane(s.where("c <> most"), 0).unionByName(lane(s, 1)))
        width //= 2


def near_links(fps: DataFrame) -> DataFrame:
    """Links between distinct fingerprints with the same components as all links of at most 3 bits."""
    spark = fps.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, fps.count() // TASK_ROWS)
    whole = fps.select(F.lit(0).cast("bigint").alias("path"), F.col("fp").alias("value"), "fp", F.col("fp").alias("c"))
    halves = _halves(whole, BITS)
    crowded = cut_lineage(halves.groupBy("seg", "key").count().where(F.col("count") > CROWD).select("seg", "key"))
    if crowded.isEmpty():
        close, nodes = None, whole.select("fp", "c")
    else:
        members = halves.join(crowded, ["seg", "key"], "left_semi").select("fp").distinct()
        close = cut_lineage(_close_stars(members.repartition(tasks)))
        groups = cut_lineage(components(close))
        nodes = (fps.join(groups.select(F.col("node").alias("fp"), F.col("root").alias("c")), "fp", "left")
                 .withColumn("c", F.coalesce("c", "fp")).select("fp", "c"))
    links = _far_links(cut_lineage(nodes.repartition(tasks)))
    for more in links[1:] + ([close] if close is not None else []):
        links[0] = links[0].unionByName(more.select("a", "b"))
    return links[0]


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ids: list[str] | None = None) -> DataFrame:
    """Per row: ``doc_id`` (and ``ids``), ``fp``, ``component_id``, ``root`` (its component's smallest fingerprint)."""
    ids = ids or []
    rows = cut_lineage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), *ids, F.col(text).alias("__t")),
                                    ["doc_id", *ids], "__t"))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    comp = components(near_links(fps.select("fp")))
    nodes = cut_lineage(fps.join(comp.select(F.col("node").alias("fp"), "root"), "fp", "left")
                        .withColumn("root", F.coalesce("root", "fp")))
    tops = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = cut_lineage(nodes.join(tops, "root").select("fp", "n", "root", "component_id"))
    return spread_lookup(rows, nodes, ["fp"], "n", rows.count()).drop("n")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of its smallest id, else its first row; columns unchanged."""
    prepare(docs.sparkSession)
    keyed, keys = with_row_key(docs)
    out = cut_lineage(near_components(keyed, doc_id, text, keys).withColumn("__uid", F.monotonically_increasing_id()))
    stay = out.groupBy("root").agg(F.coalesce(F.min_by("__uid", "doc_id"), F.min("__uid")).alias("__uid"))
    gone = cut_lineage(out.join(stay.select("__uid"), "__uid", "left_anti").select(*keys))
    return without_rows(keyed, gone, keys).select(*docs.columns)
