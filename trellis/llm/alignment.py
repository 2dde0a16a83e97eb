"""Cross-tokenizer alignment scores by inverted pair bitmaps.

A text is encoded by a byte-level BPE (A) and a piece BPE with byte fallback
(B). Both spell the same bytes; where an A token and a B token end at the same
byte they are *linked*, and these ends cut the text into groups. An id pair's
count is the number of links of the whole corpus that hold it.

Documents are encoded once, in blocks of at most ``BLOCK_DOCS`` documents and
about ``BLOCK_LINKS`` links. Of every block and pair the index holds compressed
bitmaps over the block's document numbers: plane 0 marks the documents with the
pair, plane ``1 + j`` those whose number of further links has bit ``j`` set. A
bitmap is a list of 16-bit numbers or, where shorter, plain bits. A batch of
documents yields partial bitmaps; they are OR-merged when the block is closed.
Popcounts of plane 0 sum to a pair's document count, and popcounts of all
planes, weighted by 1 and ``2^j``, to its link count. The scored pairs then go
back along the postings: a block's postings, joined to their counts, are
multiplied out over its bitmaps into sums per document.

Memory and skew: a pair has one row per block and plane, however frequent it is,
so counts are pre-aggregated and no key is hot; a block's postings are bounded
with the block, and a task holds one block. A B id has at most as many partners
as A has ids. Nothing of the corpus is collected or broadcast. A single text is
encoded whole in one task.

Defined cases: null and empty texts, and texts whose A or B bytes are not a
space and the text (as with a literal U+2581), have no tokens: zeros and an
empty digest. Special tokens' strings are plain text. Repeated rows are documents of their
own. An empty table gives an empty result. Only the columns named in ``ids`` pass through.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import prepare
from trellis.session import cut_lineage

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BLOCK_DOCS, BLOCK_LINKS = 4096, 4_000_000
#: Texts are encoded in batches of at most so many, and of about so many bytes.
BATCH_DOCS, BATCH_BYTES = 256, 1 << 20
#: Pre-token pattern of byte-level BPE files (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Piece types of the model format that a text can yield (fixed values).
NORMAL, BYTE = 1, 6


def byte_alphabet() -> dict[str, int]:
    """Character to byte of the byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """Token bytes and lengths by id, and the parts of a group's text."""

    def __init__(self, spelled: dict[int, bytes], between: str, after: str):
        size = max(spelled) + 1
        self.bytes = [spelled.get(i, b"") for i in range(size)]
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.inner = np.array([f"{i}{between}" for i in range(size)], object)
        self.last = np.array([f"{i}{after}" for i in range(size)], object)


def byte_level_encoder(raw: bytes, spelled: dict[int, bytes]):
    """Function from texts to lists of ids, special tokens' strings as plain text.

    Where the file is a plain byte-level BPE whose merges stand in the order of their ids, a token's id is its
    rank, and the rank-based library gives the same ids in a third of the time (the tests hold it to the other one).
    """
    file = json.loads(raw)
    model, cut = file["model"], file["pre_tokenizer"] or {}
    joined = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    plain = (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not file["normalizer"]
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    if plain and None not in joined and joined == sorted(joined) and {bytes([i]) for i in range(256)} <= set(spelled.values()):
        import tiktoken
        lib = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks={s: i for i, s in spelled.items()}, special_tokens={})
        return lambda texts: [lib.encode_ordinary(t) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    other = Tokenizer.from_str(raw.decode())
    other.encode_special_tokens = True
    return lambda texts: [x.ids for x in other.encode_batch_fast(texts, add_special_tokens=False)]


class Pair:
    """Both tokenizers."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        alphabet = byte_alphabet()
        file = json.loads(a)
        special = {t["id"] for t in file["added_tokens"]}
        spelled = {i: bytes(alphabet[c] for c in t) for t, i in file["model"]["vocab"].items() if i not in special}
        self.a_ids = byte_level_encoder(a, spelled)
        self.a = Side(spelled, ",", "|")
        self.b_lib = sentencepiece.SentencePieceProcessor(model_proto=b)
        model = pb.ModelProto()
        model.ParseFromString(b)
        spelled = {i: bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode()
                   for i, p in enumerate(model.pieces) if p.type in (NORMAL, BYTE)}
        self.b = Side(spelled, ",", ";")

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A and B ids of each text; none where the bytes don't join to a space and the text."""
        out = []
        for t, a, b in zip(texts, self.a_ids([" " + t for t in texts]), self.b_lib.encode(texts, num_threads=1)):
            whole = b" " + t.encode()
            same = t and b"".join([self.a.bytes[i] for i in a]) == whole and b"".join([self.b.bytes[i] for i in b]) == whole
            out.append((np.array(a if same else [], np.int64), np.array(b if same else [], np.int64)))
        return out

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
        """Linked A and B ids in order, and the groups as text ``a1,a2|b1;a3|b2``."""
        if not len(a):
            return a, b, ""
        a_end, b_end = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        at = np.zeros(a_end[-1] + 1, np.int8)
        at[a_end] = 1
        at[b_end] += 2
        a_last, b_last = at[a_end] == 3, at[b_end] == 3
        # tokens before each token: its own side's, and the other side's of earlier groups (for B: of its group too)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        a_stop, b_stop = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + np.concatenate([[0], b_stop])[a_group]] = np.where(a_last, self.a.last[a], self.a.inner[a])
        words[np.arange(len(b)) + a_stop[b_group]] = np.where(b_last, self.b.last[b], self.b.inner[b])
        return a[a_last], b[b_last], "".join(words.tolist())[:-1]


_LOADED: dict[int, Pair] = {}


def _pair(files: tuple[bytes, bytes]) -> Pair:
    key = hash(files)
    if key not in _LOADED:
        _LOADED[key] = Pair(*files)
    return _LOADED[key]


# ---- bitmaps ----

def counted(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(key, document)`` and how often each occurs; keys below 2^48, documents below 2^16."""
    both, times = np.unique((keys.astype(np.int64) << 16) | docs, return_counts=True)
    return both >> 16, both & 0xFFFF, times


def merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """OR of partial bitmaps of different documents: sorted by key, then document."""
    key, doc, times = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((doc, key))
    return key[order], doc[order], times[order]


def planes(key: np.ndarray, doc: np.ndarray, times: np.ndarray, docs: int) -> Iterator[dict]:
    """Rows of one plane each: arrays ``key``, ``weight``, ``n`` and the bitmaps ``sparse`` or ``dense``."""
    bits = (docs + 7) // 8
    plane = 0
    while True:
        hit = np.ones(len(key), bool) if plane == 0 else ((times - 1) >> (plane - 1)) & 1 == 1
        if not hit.any():
            if plane and not ((times - 1) >> plane).any():
                return
            plane += 1
            continue
        k, d = key[hit], doc[hit]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.diff(np.append(start, len(k)))
        numbers = d.astype("<u2").tobytes()
        sparse, dense = [], []
        for s, m in zip(start.tolist(), n.tolist()):
            if 2 * m <= bits:
                sparse.append(numbers[2 * s:2 * (s + m)])
                dense.append(None)
            else:
                line = np.zeros(8 * bits, np.uint8)
                line[d[s:s + m]] = 1
                sparse.append(None)
                dense.append(np.packbits(line, bitorder="little").tobytes())
        weight = 1 if plane == 0 else 1 << (plane - 1)
        yield {"key": k[start], "first": plane == 0, "weight": weight, "n": n, "sparse": sparse, "dense": dense}
        plane += 1


def add_up(docs: int, n: np.ndarray, value: np.ndarray, sparse: pa.Array, dense: pa.Array) -> np.ndarray:
    """Sum over bitmaps of each one's ``value`` (a column per sum) at its documents."""
    out = np.zeros((docs, value.shape[1]), np.int64)
    listed = np.asarray(sparse.is_valid())
    at = np.frombuffer(b"".join(sparse.drop_null().to_pylist()), "<u2")
    for c in range(value.shape[1]):
        np.add.at(out[:, c], at, np.repeat(value[listed, c], n[listed]))
    lines, rest = dense.drop_null().to_pylist(), value[~listed]
    for lo in range(0, len(lines), 256):
        bits = np.frombuffer(b"".join(lines[lo:lo + 256]), np.uint8).reshape(len(lines[lo:lo + 256]), -1)
        out += np.unpackbits(bits, axis=1, bitorder="little")[:, :docs].astype(np.int64).T @ rest[lo:lo + 256]
    return out


# ---- index, counts, scores ----

DOC = ("n_a", "n_b", "n_groups", "n_links")
ROW = "posting boolean, block bigint, doc int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, " \
      "a int, b int, first boolean, weight bigint, n bigint, sparse binary, dense binary"
_KINDS = [pa.bool_(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_NAMES = [c.split()[0] for c in ROW.split(", ")]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Whole texts in encoding batches, with the first one's row; what is no UTF-8 counts as empty."""
    def text(raw):
        try:
            return (raw or b"").decode()
        except UnicodeDecodeError:
            return ""
    held, size, first = [], 0, 0
    for i, raw in enumerate(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()):
        held.append(text(raw))
        size += len(raw or b"")
        if len(held) == BATCH_DOCS or size >= BATCH_BYTES:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _index(files, id_types: list[pa.DataType], id_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(files.value)
        wide = len(pair.b.length)
        block, docs, links = TaskContext.get().partitionId() << 32, 0, 0
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rows(n: int, values: dict, ids: list[pa.Array] | None) -> pa.RecordBatch:
            columns = [pa.array(values[c], k) if c in values else pa.nulls(n, k) for c, k in zip(_NAMES, _KINDS)]
            return pa.RecordBatch.from_arrays([*(ids or [pa.nulls(n, k) for k in id_types]), *columns], [*id_names, *_NAMES])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, docs, links, parts
            for p in planes(*merge(parts), docs) if links else ():
                m = len(p["key"])
                for lo in range(0, m, 8192):
                    x = slice(lo, lo + 8192)
                    size = len(p["key"][x])
                    yield rows(size, {"posting": np.ones(size, bool), "block": np.full(size, block), "a": p["key"][x] // wide, "b": p["key"][x] % wide,
                                      "first": np.full(size, p["first"]), "weight": np.full(size, p["weight"]), "n": p["n"][x],
                                      "sparse": p["sparse"][x], "dense": p["dense"][x]}, None)
            block, docs, links, parts = block + 1, 0, 0, []

        for b in batches:
            for first, texts in _texts(b):
                if docs + len(texts) > BLOCK_DOCS or links >= BLOCK_LINKS:
                    yield from close()
                keys, of, about = [], [], []
                for i, (x, y) in enumerate(pair.encode(texts)):
                    la, lb, spelled = pair.groups(x, y)
                    keys.append(la * wide + lb)
                    of.append(np.full(len(la), docs + i))
                    about.append((len(x), len(y), len(la), len(la), hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""))
                parts.append(counted(np.concatenate(keys), np.concatenate(of)))
                n = len(texts)
                values = dict(zip([*DOC, "groups_sha256"], zip(*about)))
                yield rows(n, values | {"posting": np.zeros(n, bool), "block": np.full(n, block), "doc": np.arange(docs, docs + n)},
                           [c.slice(first, n) for c in b.columns[:-1]])
                docs, links = docs + n, links + sum(map(len, keys))
        if docs:
            yield from close()
    return run


def build_index(docs: DataFrame, ids: list[str], text: str = "text", a_path: str = A_PATH, b_path: str = B_PATH) -> tuple[DataFrame, DataFrame]:
    """Document rows ``(block, doc, <ids>, n_a, n_b, n_groups, n_links, groups_sha256)`` and postings
    ``(block, a, b, first, weight, n, sparse, dense)``, both of one checkpointed pass over the texts."""
    spark = docs.sparkSession
    prepare(spark)
    files = spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (a_path, b_path)))
    held = [f"__id{i}" for i in range(len(ids))]
    src = docs.select(*[F.col(c).alias(h) for c, h in zip(ids, held)], F.col(text).cast("string").cast("binary").alias("__text"))
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in src.schema.fields[:-1]]
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    both = cut_lineage(src.mapInArrow(_index(files, types, held), kept + ROW))
    about = both.where("NOT posting").select("block", "doc", *held, *DOC, "groups_sha256")
    return about, both.where("posting").select("block", "a", "b", "first", "weight", "n", "sparse", "dense")


def pair_counts(postings: DataFrame) -> DataFrame:
    """``(a, b, docs, links, best)`` of every linked id pair; ``best``: no pair of its B id has more links."""
    pairs = postings.groupBy("a", "b").agg(F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("docs"),
                                           F.sum(F.col("weight") * F.col("n")).alias("links"))
    return pairs.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def _scores(key, postings: pa.Table, docs: pa.Table) -> pa.Table:
    n = docs.num_rows
    value = np.zeros((postings.num_rows, 2), np.int64)
    value[:, 0] = np.asarray(postings["weight"]) * np.asarray(postings["links"])
    value[:, 1] = np.asarray(postings["weight"]) * np.asarray(postings["best"])
    sparse, dense = (postings[c].combine_chunks() for c in ("sparse", "dense"))
    sums = add_up(n, np.asarray(postings["n"]), value, sparse, dense)[np.asarray(docs["doc"])]
    return docs.append_column("count_sum", pa.array(sums[:, 0])).append_column("n_best", pa.array(sums[:, 1])).drop_columns(["block", "doc"])


def align(docs: DataFrame, ids: list[str], text: str = "text", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """Per document ``ids``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``count_sum``, ``n_best``."""
    about, postings = build_index(docs, ids, text, a_path, b_path)
    pairs = pair_counts(postings).drop("docs")
    scored = postings.drop("first").join(pairs, ["a", "b"]).drop("a", "b")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in about.schema.fields if f.name not in ("block", "doc"))
    about = about.select(*[F.col(c).alias(c) for c in about.columns])  # both sides are of one frame: columns of its own
    out = scored.groupBy("block").cogroup(about.groupBy("block")).applyInArrow(_scores, f"{kinds}, count_sum bigint, n_best bigint")
    return out.withColumnsRenamed({f"__id{i}": c for i, c in enumerate(ids)})
