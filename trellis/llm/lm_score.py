"""LM scoring with a log-frequency Bloom filter.

Counting. Training texts give unigrams and bigrams (with a begin mark) as 64-bit hashes, made with
numpy over whole buffers. Tasks send sorted partial counts, packed by hash range (*shard*), and each
shard merges its own; a frequent n-gram is one entry per task and flush.

Filter (Talbot and Osborne 2007). A count is quantised to its level q on a scale whose steps are 1 up to 20 and a
tenth of the count beyond (``LOWS``), and the n-gram is stored ``q`` times, as (n-gram, 1) to (n-gram, q), in the Bloom filter
of its shard. A reader probes (n-gram, 1), (n-gram, 2), ... until one is missing, and knows the least and the largest
count of that level. Bigrams are told apart within their shard by 40 bits of their hash, which is what the counting
sends. Each shard's filter has ``BITS`` bits for each of its real entries, at every corpus size, so its error rate stays.
Filters of at most ``MAX_BITS`` bits in all are written to the shared checkpoint folder, from which each worker reads
them once; they never pass through the driver. Larger ones stay in their shards: texts are read
in groups of about ``GROUP`` bytes, a group sends its distinct n-grams to the shards once, and the levels
come back to the group's texts, which go along as one compressed cell. A shard probes what its groups ask
together, up to ``FLUSH`` n-grams at a time, each distinct one once: groups and shards both grow with the corpus, so work
for each pair of them would grow with its square. Both ways give the same scores.

Score. ``p(w | v) = L * c(v w) / C(v) + (1 - L) * (c(w) + 0.5) / (S + 0.5 (V + 1))``, all counts
by probes: c is the least count of a level, C the largest, S the sum of c over the vocabulary; L is 0 where v was not
seen, and a bigram counts at most as often as its words. So over all words, the end mark and one unknown word the
probabilities sum to 1 or less; missing entries that seem present (``Model.error_rate``) can only add to that.

Base score. Exact unigram counts: words with at least ``N / HEAVY`` occurrences (so at most ``HEAVY`` of
them) are broadcast; the others' counts are looked up in their shards, to which tasks send packed hashes.
Where the filters stay in their shards, the exact counts come back with the levels.

Defined cases: null text is empty (its end mark is its one token); a null ``doc_id`` is neither
held out nor learned from; without training texts N = V = 0 and all base scores are 0; a
giant text is worked in pieces of ``SLICE`` bytes cut between words; repeated rows score alike; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trellis.llm.common import prepare, with_row_key
from trellis.session import cut_lineage, ensure_checkpoint_dir
from trellis.sources.tree import _open, _qualified

SLICE = 1 << 21
FLUSH = 1 << 21
GROUP = 1 << 24
BITS, HASHES, MAX_BITS = 10, 4, 1 << 31
LEAST_SHARDS, SHARD_BYTES = 128, 1 << 24
PAIR_BITS = 40
SHARD_BITS = (1 << 32) - 8  # what ``positions`` can address; ``SHARD_BYTES`` of text have far fewer entries
HEAVY = 1_000_000
DEEP, MEMO = 4, 1_000_000
MERGE = 1 << 17
MIX_WEIGHT = 0.7

U = np.uint64
_M1, _M2, _STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_RADIX = 0x5851F42D4C957F2D
_INVERSE = pow(_RADIX, -1, 1 << 64)
END, BEGIN = mix(np.array([1, 2], U) * _STEP)
_UNIGRAM = U(0xD6E8FEB86659FD93)
_byte = np.arange(256)
_IS_WORD = ~((_byte == 32) | ((_byte >= 9) & (_byte <= 13)))
_VALUE = mix((np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(U) + U(17)) * _STEP)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * SLICE)
        _POWERS[:] = [np.cumprod(_ones(size, r), dtype=U) for r in (_RADIX, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def _ones(size: int, r: int) -> np.ndarray:
    out = np.full(size, U(r))
    out[0] = U(1)
    return out


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another in ``buf``, and each word's text."""
    if not len(buf):
        return np.zeros(0, U), np.zeros(0, np.int64)
    w = _IS_WORD[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], w[:-1]])
    after = np.concatenate([w[1:], [False]])
    start = np.flatnonzero(w & (~before | first[:-1]))
    end = np.flatnonzero(w & (~after | first[1:])) + 1
    power, inverse = _powers(len(buf))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(_VALUE[buf] * power[:len(buf)], dtype=U)])
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * _STEP)
    return h, np.searchsorted(offsets, start, "right") - 1


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    lo, n = 0, len(text)
    while lo < n:
        hi = min(n, lo + SLICE)
        while hi < n and not (text[hi] == 32 or 9 <= text[hi] <= 13):
            hi += 1
        yield text[lo:hi]
        lo = hi


def token_streams(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(tokens, previous tokens, text numbers)`` of groups of texts, end marks included."""
    group: list[int] = []
    held = 0

    def flush():
        parts = [texts[i] or b"" for i in group]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        h, d = word_hashes(np.frombuffer(b"".join(parts), np.uint8), offsets)
        n = len(parts)
        ends = np.cumsum(np.bincount(d, minlength=n)) + np.arange(n)
        tokens, doc = np.full(len(h) + n, END), np.empty(len(h) + n, np.int64)
        at = np.arange(len(h)) + d
        tokens[at], doc[at], doc[ends] = h, d, np.arange(n)
        prev = np.concatenate([[BEGIN], tokens[:-1]])
        prev[ends[:-1] + 1] = BEGIN
        return tokens, prev, np.array(group)[doc]

    for i, t in enumerate(texts):
        if t is not None and len(t) > SLICE:
            last = BEGIN
            for piece in _pieces(t):
                h, _ = word_hashes(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]))
                if len(h):
                    yield h, np.concatenate([[last], h[:-1]]), np.full(len(h), i)
                    last = h[-1]
            yield np.array([END]), np.array([last]), np.array([i])
            continue
        group.append(i)
        held += len(t or b"")
        if held >= SLICE:
            yield flush()
            group, held = [], 0
    if group:
        yield flush()


def bigrams(prev: np.ndarray, tokens: np.ndarray, shift: int) -> np.ndarray:
    """Hashes of bigrams: the bits of the shard and ``PAIR_BITS`` more."""
    drop = U(max(0, shift - PAIR_BITS))
    return mix(prev * _STEP + (tokens ^ _M2)) >> drop << drop


def pack_pairs(h: np.ndarray, shift: int) -> bytes:
    """Bigram hashes of one shard, without its bits."""
    return (h >> U(max(0, shift - PAIR_BITS))).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PAIR_BITS // 8].tobytes()


def unpack_pairs(data: bytes, shard: int, shift: int) -> np.ndarray:
    raw = np.zeros((len(data) // (PAIR_BITS // 8), 8), np.uint8)
    raw[:, :PAIR_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, PAIR_BITS // 8)
    low = U(max(0, shift - PAIR_BITS))
    mask = U((1 << min(shift, PAIR_BITS)) - 1)
    return (raw.reshape(-1).view("<u8") & mask) << low | U(shard) << U(shift)


def tally(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and their summed counts."""
    if not len(h):
        return np.zeros(0, U), np.zeros(0, np.int64)
    if n is None:
        h = np.sort(h)
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[at], np.diff(np.concatenate([at, [len(h)]]))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.add.reduceat(n, at)


PACKED = "shard int, kind string, hashes binary, counts binary"
_PACKED = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _pack(rows: list[tuple], schema: pa.Schema = _PACKED) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def _by_shard(h: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """``(shard, from, to)`` of sorted hashes."""
    s = (h >> U(shift)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(h) else np.zeros(0, np.int64)
    for lo, hi in zip(at, [*at[1:], len(h)]):
        yield int(s[lo]), int(lo), int(hi)


def _counter(shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"b": [], "u": []}

        def send(kind: str) -> list[tuple]:
            parts, held[kind] = held[kind], []
            if not parts:
                return []
            h, n = tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            n = n.astype("<u4")  # a flush holds far fewer tokens
            if kind == "u":
                return [(s, kind, h[lo:hi].tobytes(), n[lo:hi].tobytes()) for s, lo, hi in _by_shard(h, shift)]
            rows = []
            for once in (True, False):  # most bigrams of a flush are there once: they go without a count
                x, c = h[(n == 1) == once], n[(n == 1) == once]
                rows += [(s, kind, pack_pairs(x[lo:hi], shift), b"" if once else c[lo:hi].tobytes()) for s, lo, hi in _by_shard(x, shift)]
            return rows

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                for tokens, prev, _ in token_streams(b.slice(lo, 1024).column(0).cast(pa.binary()).to_pylist()):
                    held["u"].append(tally(tokens))
                    held["b"].append(tally(bigrams(prev, tokens, shift)))
                    starts = np.count_nonzero(prev == BEGIN)
                    if starts:
                        held["u"].append((np.array([BEGIN]), np.array([starts])))
                    for kind in held:
                        if sum(len(p[0]) for p in held[kind]) >= FLUSH:
                            yield _pack(send(kind))
        yield _pack(send("b") + send("u"))
    return run


def _level(level: int) -> np.uint64:
    return U(level * int(_STEP) & (1 << 64) - 1)


def positions(keys: np.ndarray, level: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """Places of (key, level) in a filter of ``bits`` bits (under 2**32)."""
    x = keys + _level(level)
    for _ in range(HASHES):
        x = mix(x + _M1)
        yield ((x >> U(32)) * np.asarray(bits).astype(U)) >> U(32)


def unigram_key(h: np.ndarray) -> np.ndarray:
    return mix(h ^ _UNIGRAM)


def _lows() -> np.ndarray:
    """Least count of every level from 1 on: steps of 1, then of a tenth, up to what a 64-bit count can be."""
    out = [1]
    while out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, out[-1] * 11 // 10))
    return np.array(out, np.int64)


LOWS = _lows()
_LEAST = np.concatenate([[0], LOWS]).astype(float)  # by level, 0 for none
_MOST = np.concatenate([[0], LOWS[1:] - 1, [LOWS[-1]]]).astype(float)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOWS, counts, "right")


def build_filter(keys: np.ndarray, q: np.ndarray, bits_per_entry: float, most_bits: int) -> bytes:
    """The packed filter of a shard."""
    bits = int(min(max(64, q.sum() * bits_per_entry), most_bits)) // 8 * 8
    flags = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        keys, q = keys[q >= level], q[q >= level]
        for at in positions(keys, level, bits):
            flags[at] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _merger(shift: int):
    """Rows sorted by (shard, kind), kind b before u: merged unigrams (u) and the shard's filter (f)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, fresh = None, {"b": [], "u": []}, {"b": 0, "u": 0}
        none = (np.zeros(0, U), np.zeros(0, np.int64))

        def close() -> list[tuple]:
            (bh, bn), (uh, un) = (tally(np.concatenate([p[0] for p in parts[k]]), np.concatenate([p[1] for p in parts[k]])) if parts[k] else none for k in ("b", "u"))
            f = build_filter(np.concatenate([bh, unigram_key(uh)]), levels(np.concatenate([bn, un])), BITS, SHARD_BITS)
            real = uh != BEGIN
            return [(now, "u", uh[real].tobytes(), un[real].astype("<i8").tobytes()), (now, "f", f, b"")]

        for b in batches:
            for shard, kind, h, n in zip(*[c.to_pylist() for c in b.columns]):
                if shard != now:
                    if now is not None:
                        yield _pack(close())
                    now, parts, fresh = shard, {"b": [], "u": []}, {"b": 0, "u": 0}
                mine = parts[kind]
                h = unpack_pairs(h, shard, shift) if kind == "b" else np.frombuffer(h, "<u8")
                mine.append((h, np.frombuffer(n, "<u4").astype(np.int64) if n else np.ones(len(h), np.int64)))
                fresh[kind] += len(h)
                # what a shard holds stays near its distinct n-grams; it is merged as it doubles, not after so many parts
                if fresh[kind] >= max(MERGE, sum(len(p[0]) for p in mine) // 2):
                    mine[:] = [tally(np.concatenate([p[0] for p in mine]), np.concatenate([p[1] for p in mine]))]
                    fresh[kind] = 0
        if now is not None:
            yield _pack(close())
    return run


def read_filters(uri: str, begin: np.ndarray, size: int) -> np.ndarray:
    """The shards' filters of a folder of ``(shard, hashes)`` rows, one after another; a row is held at a time."""
    from pyarrow.fs import FileSelector
    out = np.zeros(size, np.uint8)
    system, top = _open(uri)
    for f in system.get_file_info(FileSelector(top)):
        if f.base_name.endswith(".parquet"):
            with system.open_input_file(f.path) as source:
                for b in pq.ParquetFile(source).iter_batches(1, columns=["shard", "hashes"]):
                    for shard, data in zip(b.column(0).to_pylist(), b.column(1)):
                        at = int(begin[shard]) // 8
                        part = np.frombuffer(data.as_buffer(), np.uint8)
                        out[at:at + len(part)] = part
    return out


@dataclass
class Model:
    """Scalars and the place of the filters, of bounded size, as broadcast to the workers."""

    shift: int
    total: int  # sum of the least counts of the vocabulary's levels
    v: int  # distinct training tokens
    data: np.ndarray | None  # the shards' filters, packed, one after another (None: not read yet)
    begin: np.ndarray  # first bit of each shard's filter
    bits: np.ndarray
    heavy: np.ndarray  # sorted hashes of frequent words
    heavy_n: np.ndarray
    light_from: int
    stored: str = ""  # folder of the filters

    @property
    def filters(self) -> np.ndarray:
        """The filters, read once in each worker."""
        if self.data is None:
            self.data = read_filters(self.stored, self.begin, int(self.bits.sum()) // 8)
        return self.data

    @property
    def error_rate(self) -> float:
        """Chance that a missing entry seems present: share of set bits to the power of the hashes."""
        data = self.filters
        ones = int(np.bitwise_count(data).sum()) if hasattr(np, "bitwise_count") else int(np.unpackbits(data).sum())
        return (ones / max(1, 8 * len(data))) ** HASHES

    def __post_init__(self):
        self.known, self.level = np.zeros(0, U), np.zeros(0, np.int64)  # sorted keys of deep levels that a worker has found

    def probe(self, shard_of: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Stored level of each distinct key (0: none), by repeated membership probes.

        Keys of a level of ``DEEP`` or more, which take most probes, are remembered up to ``MEMO`` of them.
        """
        out = np.zeros(len(keys), np.int64)
        new = np.ones(len(keys), bool)
        if len(self.known):
            i = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            new = self.known[i] != keys
            out[~new] = self.level[i[~new]]
        shard = (shard_of[new] >> U(self.shift)).astype(np.int64)
        found = out[new] = probe_filter(self.filters, self.begin[shard], self.bits[shard], keys[new])
        deep = found >= DEEP
        if 20 * np.count_nonzero(deep) > len(self.known):
            old = (self.known, self.level) if len(self.known) + np.count_nonzero(deep) <= MEMO else (self.known[:0], self.level[:0])
            key, level = np.concatenate([old[0], keys[new][deep]]), np.concatenate([old[1], found[deep]])
            order = np.argsort(key)
            self.known, self.level = key[order], level[order]
        return out

    def log_probs(self, prev: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        # each distinct n-gram of the group is probed once: frequent ones have many levels
        pairs, at = np.unique(bigrams(prev, tokens, self.shift), return_inverse=True)
        words, back = np.unique(np.concatenate([tokens, prev]), return_inverse=True)
        seen = self.probe(words, unigram_key(words))[back]
        return interpolate(seen[:len(tokens)], seen[len(tokens):], self.probe(pairs, pairs)[at], self.total, self.v)


def probe_shard(data: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Stored level of each distinct key in the one filter ``data``; keys may repeat, and are probed once."""
    order = np.argsort(keys)
    h = keys[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    found = probe_filter(data, np.zeros(len(at), U), np.full(len(at), 8 * len(data), U), h[at])
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(found, np.diff(np.concatenate([at, [len(h)]])))
    return out


def probe_filter(data: np.ndarray, begin: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Stored level of each key in the filter of ``bits`` bits that starts at bit ``begin`` of ``data``."""
    out = np.zeros(len(keys), np.int64)
    if not len(data):
        return out
    alive = np.flatnonzero(bits > 0)
    for level in range(1, len(LOWS) + 1):
        x, start, size = keys[alive] + _level(level), begin[alive], bits[alive]
        for _ in range(HASHES):
            x = mix(x + _M1)
            at = (start + (((x >> U(32)) * size) >> U(32))).astype(np.int64)
            ok = (data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            if not ok.all():
                alive, x, start, size = alive[ok], x[ok], start[ok], size[ok]
        if not len(alive):
            break
        out[alive] = level
    return out


def interpolate(q: np.ndarray, qv: np.ndarray, qb: np.ndarray, total: int, v: int) -> np.ndarray:
    """Log probabilities from the levels of the words, of the words before and of the bigrams."""
    c, cv, cb = _LEAST[q], _MOST[qv], _LEAST[qb]
    uni = (c + 0.5) / (total + 0.5 * (v + 1))
    weight = np.where(cv > 0, MIX_WEIGHT, 0.0)
    return np.log10(weight * np.minimum(np.minimum(cb, c), cv) / np.maximum(cv, 1) + (1 - weight) * uni)


def is_training():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1


@contextmanager
def _shuffles_dropped(spark) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect garbage: those of the
    counts are as large as the input, and of no use beside the checkpoint."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def train(docs: DataFrame) -> tuple[Model | None, DataFrame, int, int, int, int]:
    """The model of ``docs (doc_id, text)``'s training rows (None: too large for a worker), the exact unigram
    counts (u) and filters (f) by shard, the shards' shift, the numbers of tokens and distinct tokens, and the sum of the
    levels' least counts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = LEAST_SHARDS
    while shards * SHARD_BYTES < size:
        shards *= 2
    shift = 64 - (shards - 1).bit_length()
    part = docs.where(is_training()).select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counter(shift), PACKED)
    with _shuffles_dropped(docs.sparkSession):
        merged = cut_lineage(part.repartition("shard").sortWithinPartitions("shard", "kind")
                             .mapInArrow(_merger(shift), PACKED))
    unigrams = merged.where("kind = 'u'")

    def sizes(batches):
        for b in batches:
            n = [np.frombuffer(x, "<i8") for x in b.column("counts").to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": [int(x.sum()) for x in n], "v": [len(x) for x in n], "s": [int(LOWS[levels(x) - 1].sum()) for x in n]},
                                             pa.schema([(c, pa.int64()) for c in "nvs"]))
    n, v, total = (x or 0 for x in unigrams.mapInArrow(sizes, "n bigint, v bigint, s bigint").agg(F.sum("n"), F.sum("v"), F.sum("s")).first())
    least = n // HEAVY + 1
    bits = merged.where("kind = 'f'").agg(F.sum(8 * F.octet_length("hashes"))).first()[0] or 0
    if bits > MAX_BITS:
        return None, merged, shift, n, v, total

    def frequent(batches):
        for b in batches:
            out = []
            for s, _, h, c in zip(*[x.to_pylist() for x in b.columns]):
                h, c = np.frombuffer(h, "<u8"), np.frombuffer(c, "<i8")
                out.append((s, "h", h[c >= least].tobytes(), c[c >= least].tobytes()))
            yield _pack(out)
    top = unigrams.mapInArrow(frequent, PACKED).collect()  # at most HEAVY words
    hh = np.concatenate([np.zeros(0, U), *[np.frombuffer(r.hashes, "<u8") for r in top]])
    hn = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r.counts, "<i8") for r in top]])
    order = np.argsort(hh)
    filters = merged.where("kind = 'f'").select("shard", "hashes")
    stored = f"{ensure_checkpoint_dir(docs.sparkSession)}/lm-{uuid.uuid4().hex}"
    filters.write.parquet(stored)
    parts = {r.shard: r.n for r in filters.select("shard", F.octet_length("hashes").alias("n")).collect()}
    lens = np.array([parts.get(s, 0) for s in range(shards)], np.int64)
    model = Model(shift, total, v, None, (np.cumsum(lens) - lens).astype(U) * U(8),
                  lens.astype(U) * U(8), hh[order], hn[order], least, _qualified(docs.sparkSession, stored))
    return model, merged, shift, n, v, total


_LOCAL = "kind string, key bigint, doc_id {id}, held_out boolean, n_tokens bigint, known bigint, base double, score double, at bigint, pid bigint, hashes binary, places binary"


def _local(shared, shift: int):
    """Scores and heavy base sums per row (kind d, key: the task), and packed light words by shard (kind q)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        pid, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                n = part.num_rows
                tokens_n, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                light, where = [], []
                for tokens, prev, doc in token_streams(part.column(2).cast(pa.binary()).to_pylist()):
                    tokens_n += np.bincount(doc, minlength=n)
                    score += np.bincount(doc, m.log_probs(prev, tokens), minlength=n)
                    i = np.searchsorted(m.heavy, tokens)
                    i[i == len(m.heavy)] = 0
                    hit = m.heavy[i] == tokens if len(m.heavy) else np.zeros(len(tokens), bool)
                    base += np.bincount(doc[hit], np.log10(m.heavy_n[i[hit]] + 0.5), minlength=n)
                    known += np.bincount(doc[hit], minlength=n)
                    light.append(tokens[~hit])
                    where.append(doc[~hit] + at)
                rows = [("d", pid, d, h, t, k, s, x, at + j, pid, None, None) for j, (d, h, t, k, s, x) in enumerate(zip(
                    part.column(0).to_pylist(), part.column(1).to_pylist(), tokens_n.tolist(), known.tolist(), base.tolist(), score.tolist()))]
                words, places = np.concatenate(light), np.concatenate(where)
                order = np.argsort(words, kind="stable")
                words, places = words[order], places[order].astype("<i4")
                rows += [("q", s, None, None, None, None, None, None, None, pid, words[a:z].tobytes(), places[a:z].tobytes()) for s, a, z in _by_shard(words, shift)]
                kinds = [pa.string(), pa.int64(), part.column(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                names = [c.split()[0] for c in _LOCAL.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)
                at += n
    return run


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, kind), the counts (a) before requests (q): packed partial sums for each task's rows."""
    now, h, c = None, np.zeros(0, U), np.zeros(0, np.int64)
    for b in batches:
        out = []
        for kind, shard, pid, hashes, data in zip(*[x.to_pylist() for x in b.columns]):
            if kind == "a":
                now, h, c = shard, np.frombuffer(hashes, "<u8"), np.frombuffer(data, "<i8")
                continue
            if shard != now:
                now, h, c = shard, np.zeros(0, U), np.zeros(0, np.int64)
            w, at = np.frombuffer(hashes, "<u8"), np.frombuffer(data, "<i4")
            i = np.searchsorted(h, w)
            i[i == len(h)] = 0
            hit = h[i] == w if len(h) else np.zeros(len(w), bool)
            n = np.where(hit, c[i], 0) if len(h) else np.zeros(len(w), np.int64)
            rows, back = np.unique(at, return_inverse=True)
            sums = np.bincount(back, np.log10(n + 0.5), minlength=len(rows))
            known = np.bincount(back, hit, minlength=len(rows)).astype("<i4")
            out.append((pid, rows.astype("<i4").tobytes(), sums.tobytes(), known.tobytes()))
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                         ["pid", "places", "sums", "known"])


def _streams(texts: list[bytes]):
    """The groups of ``token_streams``, to be gone through more than once; those of a giant text are made again each time."""
    return list(token_streams(texts)) if sum(map(len, texts)) <= 2 * GROUP else _Again(texts)


@dataclass
class _Again:
    texts: list[bytes]

    def __iter__(self):
        return token_streams(self.texts)


def _distinct(streams, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the words (and the begin mark) and of the bigrams of a group's texts."""
    held: tuple[list, list] = ([np.array([BEGIN])], [])
    fresh = [0, 0]
    for tokens, prev, _ in streams:
        for i, h in enumerate((tokens, bigrams(prev, tokens, shift))):
            held[i].append(tally(h)[0])
            fresh[i] += len(held[i][-1])
            if fresh[i] >= max(FLUSH, sum(map(len, held[i])) // 2):
                held[i][:], fresh[i] = [tally(np.concatenate(held[i]))[0]], 0
    return tuple(tally(np.concatenate([np.zeros(0, U), *parts]))[0] for parts in held)


def _found(h: np.ndarray, known: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values of each of ``h`` in sorted ``known``, which has them all."""
    order = np.argsort(h)
    x = h[order]
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    i, times = np.searchsorted(known, x[at]), np.diff(np.concatenate([at, [len(x)]]))
    out = []
    for v in values:
        out.append(np.empty(len(h), v.dtype))
        out[-1][order] = np.repeat(v[i], times)
    return out


def _thin(a: np.ndarray) -> bytes:
    """Counts or levels in as few bytes each as the largest needs, and how many these are."""
    width = next(w for w in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _to_cell(rows: list[tuple], id_type: pa.DataType) -> bytes:
    """``(doc_id, held_out, text)`` of a group as one compressed cell."""
    kinds = [id_type, pa.bool_(), pa.large_binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "held_out", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


_ASK = "key bigint, kind string, pid bigint, grp bigint, words binary, pairs binary, counts binary"
_ASKED = pa.schema(list(zip([c.split()[0] for c in _ASK.split(", ")], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])))


def _asker(shift: int, id_type: pa.DataType, group: int):
    """Groups of texts (kind t, the texts in ``words``), and per group and shard its distinct n-grams (kind q), packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, grp, held, size = TaskContext.get().partitionId(), 0, [], 0

        def send() -> pa.RecordBatch:
            words, pairs = _distinct(token_streams([t for *_, t in held]), shift)
            asked: dict[int, list[bytes]] = {}
            for s, lo, hi in _by_shard(words, shift):
                asked.setdefault(s, [b"", b""])[0] = words[lo:hi].tobytes()
            for s, lo, hi in _by_shard(pairs, shift):
                asked.setdefault(s, [b"", b""])[1] = pack_pairs(pairs[lo:hi], shift)
            spread = (pid * 31 + grp) % (1 << 64 - shift)  # texts pass the shards on their way, evenly dealt
            rows = [(spread, "t", pid, grp, _to_cell(held, id_type), None, None)]
            rows += [(s, "q", pid, grp, w, p, None) for s, (w, p) in asked.items()]
            return _pack(rows, _ASKED)

        for b in batches:
            for d, out, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                held.append((d, out, t.as_py()))
                size += len(held[-1][2])
                if size >= group or len(held) >= 1 << 16:
                    yield send()
                    grp, held, size = grp + 1, [], 0
        if held:
            yield send()
    return run


def _answers(shift: int):
    """Rows sorted by (key, kind), counts (c) and filter (f) of a shard before requests (q): the words' levels
    (words) and exact counts (counts), and the bigrams' levels (pairs). Texts pass as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, n, data = None, np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        asked: list[tuple] = []
        size = 0

        def reply() -> list[tuple]:
            w, p = (np.concatenate([a[i] for a in asked]) for i in (2, 3))
            q, qb = probe_shard(data, unigram_key(w)), probe_shard(data, p)
            i = np.searchsorted(h, w)
            i[i == len(h)] = 0
            counts = np.where(h[i] == w, n[i], 0) if len(h) else np.zeros(len(w), np.int64)
            rows, a, c = [], 0, 0
            for pid, grp, x, y in asked:
                b, d = a + len(x), c + len(y)
                rows.append((now, "a", pid, grp, _thin(q[a:b]), _thin(qb[c:d]), _thin(counts[a:b])))
                a, c = b, d
            asked.clear()
            return rows

        for b in batches:
            out = []
            for row in zip(*[x.to_pylist() for x in b.columns]):
                key, kind, pid, grp, words, pairs, counts = row
                if asked and (key != now or size >= FLUSH):
                    out += reply()
                    size = 0
                if key != now:
                    now, h, n, data = key, np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.uint8)
                if kind == "c":
                    h, n = np.frombuffer(words, "<u8"), np.frombuffer(counts, "<i8")
                elif kind == "f":
                    data = np.frombuffer(words, np.uint8)
                elif kind == "t":
                    out.append(row)
                else:
                    asked.append((pid, grp, np.frombuffer(words, "<u8"), unpack_pairs(pairs, key, shift)))
                    size += len(asked[-1][2]) + len(asked[-1][3])
            yield _pack(out, _ASKED)
        if asked:
            yield _pack(reply(), _ASKED)
    return run


def _group_scores(total: int, v: int, shift: int, id_type: pa.DataType):
    """Rows sorted by (pid, grp, kind, key), a group's answers (a) before its texts (t): the texts' sums."""
    kinds = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "score"]

    def close(cell: bytes, answers: list[tuple]) -> pa.RecordBatch:
        group = pa.ipc.open_stream(cell).read_next_batch()
        streams, k = _streams(group.column(2).to_pylist()), group.num_rows
        words, pairs = _distinct(streams, shift)  # in the order of the shards, as the answers are
        q, qb, exact = (np.concatenate([np.zeros(0, np.int64), *[_wide(a[i]) for a in answers]]) for i in range(3))
        begin = q[np.searchsorted(words, BEGIN)]
        tokens_n, known, base, score = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
        for tokens, prev, doc in streams:
            # the word before is the begin mark, the token before, or (first of a later piece of a giant text) neither
            level, n = _found(tokens, words, q, exact)
            before = np.where(prev == BEGIN, begin, np.concatenate([q[np.searchsorted(words, prev[:1])], level[:-1]]))
            lp = interpolate(level, before, *_found(bigrams(prev, tokens, shift), pairs, qb), total, v)
            tokens_n += np.bincount(doc, minlength=k)
            score += np.bincount(doc, lp, minlength=k)
            base += np.bincount(doc, np.log10(n + 0.5), minlength=k)
            known += np.bincount(doc[n > 0], minlength=k)
        cols = (group.column(0), group.column(1), tokens_n, known, base, score)
        return pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(cols, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers = None, []
        for b in batches:
            for key, kind, pid, grp, words, pairs, counts in zip(*[c.to_pylist() for c in b.columns]):
                if (pid, grp) != now:
                    now, answers = (pid, grp), []
                if kind == "a":
                    answers.append((words, pairs, counts))
                else:
                    yield close(words, answers)
    return run


def _score_in_shards(src: DataFrame, merged: DataFrame, shift: int, total: int, v: int) -> DataFrame:
    """Sums per row where the filters stay in their shards; one flow through the shards and back to the groups."""
    fixed, _ = with_row_key(src)  # a file scan, or checkpointed: groups are named by task and place
    rows = fixed.select("doc_id", F.coalesce(~is_training(), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    arrow_id = to_arrow_type(src.schema["doc_id"].dataType)
    asked = rows.mapInArrow(_asker(shift, arrow_id, GROUP), _ASK)
    none = F.lit(None)
    sides = merged.select(F.col("shard").cast("bigint").alias("key"), F.when(F.col("kind") == "u", "c").otherwise("f").alias("kind"),
                          none.cast("bigint").alias("pid"), none.cast("bigint").alias("grp"), F.col("hashes").alias("words"), none.cast("binary").alias("pairs"), "counts")
    back = sides.unionByName(asked).repartition("key").sortWithinPartitions("key", "kind").mapInArrow(_answers(shift), _ASK)
    return (back.repartition("pid", "grp").sortWithinPartitions("pid", "grp", "kind", "key")
            .mapInArrow(_group_scores(total, v, shift, arrow_id), f"doc_id {id_type}, held_out boolean, n_tokens bigint, known bigint, base double, score double"))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    model, merged, shift, n, v, total = train(src)
    joined = _score_in_shards(src, merged, shift, total, v) if model is None else _score_by_broadcast(src, model, merged.where("kind = 'u'"))
    fixed = float(np.log10(n + 0.5 * (v + 1)))
    return joined.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
                         (F.col("base") - F.col("n_tokens") * F.lit(fixed)).alias("base_score"), "score")


def _score_by_broadcast(src: DataFrame, model: Model, unigrams: DataFrame) -> DataFrame:
    """Sums per row with the filters in each worker; the base score's light words go to their shards."""
    shared = src.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(~is_training(), F.lit(False))
    local = cut_lineage(src.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
                        .mapInArrow(_local(shared, model.shift), _LOCAL.format(id=src.schema["doc_id"].dataType.simpleString())))
    counts = unigrams.select(F.lit("a").alias("kind"), F.col("shard").cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("pid"),
                             "hashes", F.col("counts").alias("data"))
    asked = local.where("kind = 'q'").select("kind", "key", "pid", "hashes", F.col("places").alias("data"))
    sums = (counts.unionByName(asked).repartition("key").sortWithinPartitions("key", "kind")
            .mapInArrow(_lookup, "pid bigint, places binary, sums binary, known binary"))
    docs_ = local.where("kind = 'd'").select("pid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "at")
    return _merge(docs_, sums)


def _merge(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Add each task's light sums to its rows; both are grouped by the task that read the rows."""
    cols = ["pid", "kind", "doc_id", "held_out", "n_tokens", "known", "base", "score", "at", "places", "sums", "n"]
    none = F.lit(None)
    a = rows.select("pid", F.lit("b").alias("kind"), "doc_id", "held_out", "n_tokens", "known", "base", "score", "at",
                    none.cast("binary").alias("places"), none.cast("binary").alias("sums"), none.cast("binary").alias("n"))
    kinds = {f.name: f.dataType for f in a.schema.fields}
    b = sums.select("pid", F.lit("a").alias("kind"), *[none.cast(kinds[c]).alias(c) for c in cols[2:9]], "places", "sums", F.col("known").alias("n"))
    both = a.unionByName(b).select(*cols).repartition("pid").sortWithinPartitions("pid", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, known = None, np.zeros(0), np.zeros(0, np.int64)
        for x in batches:
            v = {c: x.column(i) for i, c in enumerate(cols)}
            pid, kind, at = v["pid"].to_pylist(), v["kind"].to_pylist(), v["at"].to_pylist()
            keep, add, more = [], [], []
            for i in range(x.num_rows):
                if pid[i] != now:
                    now, base, known = pid[i], np.zeros(0), np.zeros(0, np.int64)
                if kind[i] == "a":
                    p = np.frombuffer(v["places"][i].as_py(), "<i4")
                    if len(p) and p[-1] >= len(base):
                        grow = int(p[-1]) + 1 - len(base) + len(base) // 2
                        base, known = np.concatenate([base, np.zeros(grow)]), np.concatenate([known, np.zeros(grow, np.int64)])
                    base[p] += np.frombuffer(v["sums"][i].as_py(), float)
                    known[p] += np.frombuffer(v["n"][i].as_py(), "<i4")
                else:
                    keep.append(i)
                    add.append(base[at[i]] if at[i] < len(base) else 0.0)
                    more.append(int(known[at[i]]) if at[i] < len(base) else 0)
            y = x.take(pa.array(keep, pa.int64()))
            cols_ = {c: y.column(i) for i, c in enumerate(cols)}
            total = np.array(cols_["base"].to_pylist(), float) + np.array(add)
            seen = np.array(cols_["known"].to_pylist(), np.int64) + np.array(more, np.int64)
            yield pa.RecordBatch.from_arrays([cols_["doc_id"], cols_["held_out"], cols_["n_tokens"], pa.array(seen, pa.int64()), pa.array(total, pa.float64()), cols_["score"]],
                                             ["doc_id", "held_out", "n_tokens", "known", "base", "score"])
    kind = kinds["doc_id"].simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double")
