"""Exact dedup by content-defined chunk recipes.

A text is normalised (each run of ``[\\x20\\x09-\\x0D]`` becomes one space) and
cut where a rolling gear hash of its last 32 bytes hits a mask. A recipe is the
ordered list of its chunks' 64-bit identifiers. Every identifier is verified:
over all chunks of the corpus, one identifier must stand for one SHA-256 value
and one length, else its chunks take an identifier from the SHA-256 instead.
Texts are equal when their recipes and their SHA-256 are equal. Only
identifiers and digests are shuffled; the texts never move.

Defined cases: a null text counts as empty; an empty text has an empty recipe;
rows that repeat both ``doc_id`` and text form a group of which one row is kept;
a null ``doc_id`` is kept only if its group has no other; an empty table gives
an empty result; extra columns are ignored by ``exact_groups`` and kept by
``dedup_rows``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import prepare, spread_lookup, with_row_key, without_rows
from trellis.session import cut_lineage

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 2048, 16384, 12
SEGMENT = 1 << 20

_SPACES = bytes(0x20 if b == 0x20 or 9 <= b <= 13 else b for b in range(256))
_RUNS = re.compile(b"  +")
#: Gear values: the first words of SHA-256 of each byte.
_GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)

RECIPE = ("array<bigint>", "array<struct<fp:bigint,v1:bigint,v2:bigint,len:bigint>>")


def normalise(text: bytes) -> bytes:
    """Each run of white space becomes one space."""
    return _RUNS.sub(b" ", text.translate(_SPACES))


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; each depends on nearby content only. Works in blocks of 1 MiB."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    raw, marks = np.frombuffer(data, np.uint8), []
    for lo in range(0, n, SEGMENT):
        h = _GEAR[raw[max(0, lo - 31):lo + SEGMENT]]
        for s in (1, 2, 4, 8, 16):
            h[s:] = h[s:] + (h[:-s] << np.uint32(s))
        at = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + max(0, lo - 31) + 1
        marks.extend(at[at > lo].tolist())
    ends, last = [], 0
    for m in marks:
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m - last >= MIN_CHUNK:
            ends.append(m)
            last = m
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    return ends if last == n else [*ends, n]


def recipe(text: bytes | None) -> tuple[str, list[dict]]:
    """SHA-256 of the normalised text, and its chunks: identifier, 128 bits of SHA-256, length."""
    data = normalise(text or b"")
    out, start = [], 0
    for end in cut_points(data):
        chunk = data[start:end]
        d = hashlib.sha256(chunk).digest()
        out.append({"fp": xxhash.xxh3_64_intdigest(chunk) - (1 << 63), "v1": int.from_bytes(d[:8], "little", signed=True),
                    "v2": int.from_bytes(d[8:16], "little", signed=True), "len": end - start})
        start = end
    return hashlib.sha256(data).hexdigest(), out


def _recipes(text_at: int, n_cols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("fp", "v1", "v2", "len")]))
        for b in batches:
            done = [recipe(t) for t in b.column(text_at).cast(pa.binary()).to_pylist()]
            rest = [b.column(i) for i in range(n_cols) if i != text_at]
            names = [b.schema.names[i] for i in range(n_cols) if i != text_at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([d[0] for d in done], pa.string()),
                                              pa.array([d[1] for d in done], kind)],
                                             [*names, "text_sha256", "chunks"])
    return run


def recipes(docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """Per row: ``ids``, ``text_sha256`` and ``chunks``; the only step that reads the texts."""
    prepare(docs.sparkSession)
    src = docs.select(*ids, F.col(text).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(_recipes(len(ids), len(ids) + 1), f"{kept}, text_sha256 string, chunks {RECIPE[1]}")


def chunk_store(rec: DataFrame) -> DataFrame:
    """One row per identifier: references, and whether it stands for one content (``verified``)."""
    c = rec.select(F.explode("chunks").alias("c")).select("c.*")
    spread = [F.min(k) == F.max(k) for k in ("v1", "v2", "len")]
    return c.groupBy("fp").agg(F.count(F.lit(1)).alias("n_refs"), F.max("len").alias("len"),
                               (spread[0] & spread[1] & spread[2]).alias("verified"))


def _verified_recipes(rec: DataFrame) -> DataFrame:
    """``rec`` with the column ``ids``: the ordered list of verified identifiers."""
    clashes = cut_lineage(chunk_store(rec).where(~F.col("verified")).select("fp"))
    plain = F.transform("chunks", lambda c: c["fp"])
    if clashes.isEmpty():
        return rec.withColumn("ids", plain)
    flags = (rec.select("__uid", F.explode("chunks.fp").alias("fp")).join(clashes, "fp").groupBy("__uid")
             .agg(F.collect_set("fp").alias("bad")))
    fixed = F.flatten(F.transform("chunks", lambda c: F.when(F.array_contains("bad", c["fp"]),
                                                             F.array(c["fp"], c["v1"], c["v2"], c["len"]))
                                  .otherwise(F.array(c["fp"]))))
    return rec.join(flags, "__uid", "left").withColumn("ids", F.when(F.col("bad").isNull(), plain).otherwise(fixed))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ids: list[str] | None = None) -> DataFrame:
    """Per row: ``doc_id`` (and ``ids``), ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    ids = ids or []
    src = docs.select(F.col(doc_id).alias("doc_id"), *ids, F.col(text).alias("__t"))
    rec = recipes(src, ["doc_id", *ids], "__t").withColumn("__uid", F.monotonically_increasing_id())
    rec = cut_lineage(rec)
    rec = cut_lineage(_verified_recipes(rec).select("__uid", "doc_id", *ids, "text_sha256", "ids"))
    groups = cut_lineage(rec.groupBy("text_sha256", "ids").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
        F.coalesce(F.min_by("__uid", "doc_id"), F.min("__uid")).alias("__keep")))
    out = spread_lookup(rec, groups, ["text_sha256", "ids"], "group_size", rec.count())
    return out.select("doc_id", *ids, "keep_id", "group_size", (F.col("__uid") == F.col("__keep")).alias("kept"), "text_sha256")


def dedup_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another kept row has; columns unchanged."""
    prepare(docs.sparkSession)
    keyed, keys = with_row_key(docs)
    gone = cut_lineage(exact_groups(keyed, doc_id, text, keys).where(~F.col("kept")).select(*keys))
    return without_rows(keyed, gone, keys).select(*docs.columns)
