"""SentencePiece encoding and decoding by a max-plus scan.

The model is a BPE model with byte fallback. Its result for a text is the one
path through the lattice of vocabulary pieces in which every two neighbours
are *compatible*: merging the characters of both, best score first, gives just
these two. (No merge crosses a final border, and the first merge that would
cross one can be seen from the two pieces at it.) So an arc weighs -1 (one
piece) if it is compatible with its predecessor, and minus infinity if not, and
dynamic programming over positions finds the path: each position has at most
one piece that ends there.

A giant text is split into chunks of ``CHUNK`` characters. The state at a
border is the last piece that starts before it. A chunk yields a transfer
matrix, the best weight from each entry state to each exit state (sparse:
missing entries are minus infinity). Max-plus products of the matrices are
associative: blocks of ``FAN`` neighbours are combined level by level until a
text has one matrix, then the states at all borders are read off downwards, and
every chunk is backtraced on its own between its two states. All three steps
are Spark stages over chunk rows; no task holds more than ``FAN`` matrices or
one chunk.

Shorter texts are cut before each run of spaces and at newlines where the
vocabulary has no piece across (checked at load); each word's path is
found once per worker in a bounded memo.

The result equals the library's ``encode`` for this model. Decoding joins the
pieces, turns byte pieces into UTF-8 and drops the added first space; a literal
U+2581 decodes as a space, as in the library.

Defined cases: null and empty texts give no pieces; unknown characters give
their bytes; repeated rows are encoded alike; an empty table gives an empty
result; all other columns pass through (``token_ids`` replaces a column of that name).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import prepare, with_row_key
from trellis.session import cut_lineage

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, GIANT, FAN = 16_384, 65_536, 64
MEMO_WORDS, MEMO_PAIRS = 300_000, 400_000
MARK = "▁"
#: Piece types of the model format (fixed values).
NORMAL, BYTE = 1, 6


class Memo(dict):
    """Word to the bytes of its ids, in two generations: when this one is full it becomes the old one, from
    which words in use come back."""

    def __init__(self, fill):
        super().__init__()
        self.fill = fill
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            out = self.fill(word)
        self[word] = out
        return out


class Pieces:
    """Vocabulary, compatibility of neighbours, and paths."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        m.ParseFromString(model)
        norm = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not (norm.add_dummy_prefix and m.trainer_spec.byte_fallback):
            raise ValueError("needs a BPE model with byte fallback, a first space and no normalisation")
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.longest = max(map(len, self.ids))
        self.text_of = np.array([p.piece.replace(MARK, " ") if p.type == NORMAL else "" for p in m.pieces], object)
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.is_byte = np.zeros(len(m.pieces), bool)
        self.is_byte[list(self.byte_of)] = True
        self.pair: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.ids)
        self.memo = Memo(lambda w: self.id_bytes(self.path(w)))
        self.words = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    def merged(self, s: str) -> list[str]:
        """Merge the characters of a short string, best score first, leftmost on ties."""
        syms = list(s)
        while True:
            best, at = None, -1
            for i in range(len(syms) - 1):
                sc = self.score.get(syms[i] + syms[i + 1])
                if sc is not None and (best is None or sc > best):
                    best, at = sc, i
            if best is None:
                return syms
            syms[at:at + 2] = [syms[at] + syms[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        """Whether ``a`` then ``b`` may be neighbours; ``a`` empty: ``b`` may be first."""
        row = self.pair.get(a)
        if row is None:
            row = self.row(a)
        ok = row.get(b)
        if ok is None:
            ok = row[b] = self.merged(a + b) == ([a, b] if a else [b])
            self.n_pairs += 1
        return ok

    def ends(self, s: str, begin: int, length: int, stop: int, starts_before: int) -> list[int]:
        """``last[i]``: length of the piece that ends at ``i`` on the path from a first piece, 0 if none.

        The first piece has ``length`` characters and ends at ``begin`` (length 0: the text's start).
        """
        last = [0] * (stop + 1)
        last[begin] = length or -1
        for i in range(begin + 1, stop + 1):
            last[i] = self.step(s, last, begin, i, starts_before)
        return last

    def step(self, s: str, last: list[int], begin: int, i: int, starts_before: int) -> int:
        ids, ok = self.ids, self.compatible
        for n in range(1, min(self.longest, i - begin) + 1):
            j = i - n
            if j >= starts_before or not last[j]:
                continue
            piece = s[j:i]
            if (n == 1 or piece in ids) and ok(s[j - last[j]:j] if last[j] > 0 else "", piece):
                return n
        return 0

    def path(self, s: str) -> list[str]:
        """Pieces of a whole string: ``ends`` and ``back`` in one loop, for the many short words."""
        ids, pair, longest = self.ids, self.pair, self.longest
        piece_at: list[str | None] = [""] + [None] * len(s)
        row_at = [pair.get("") or self.row("")] + [None] * len(s)
        for i in range(1, len(s) + 1):
            for j in range(i - 1, max(-1, i - longest - 1), -1):
                row = row_at[j]
                if row is None:
                    continue
                piece = s[j:i]
                ok = row.get(piece)
                if ok is None and (j == i - 1 or piece in ids):
                    ok = self.compatible(piece_at[j], piece)
                if ok:
                    piece_at[i] = piece
                    row_at[i] = pair.get(piece) or self.row(piece)
                    break
        out, end = [], len(s)
        while end > 0:
            out.append(piece_at[end])
            end -= len(out[-1])
        return out[::-1]

    def row(self, a: str) -> dict[str, bool]:
        if self.n_pairs > MEMO_PAIRS:
            self.pair.clear()
            self.n_pairs = 0
        return self.pair.setdefault(a, {})

    @staticmethod
    def back(s: str, last: list[int], begin: int, end: int) -> list[str]:
        out = []
        while end > begin:
            out.append(s[end - last[end]:end])
            end -= last[end]
        return out[::-1]

    def id_bytes(self, pieces: list[str]) -> bytes:
        out, get = array("i"), self.ids.get
        for p in pieces:
            i = get(p)
            if i is not None:
                out.append(i)
            else:
                out.extend([self.byte_id[b] for b in p.encode("utf-8", "replace")])
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as bytes of 32-bit integers."""
        if not text:
            return b""
        s = MARK + text.replace(" ", MARK)
        return b"".join(map(self.memo.__getitem__, self.words.findall(s))) if self.cuts else self.id_bytes(self.path(s))

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        flags = self.is_byte[ids]
        if not flags.any():
            out = "".join(self.text_of[ids].tolist())
        else:
            raw = [self.byte_of[i] if f else self.text_of[i].encode() for i, f in zip(ids.tolist(), flags.tolist())]
            out = b"".join(raw).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out

    # ---- chunks of giant texts; a chunk row has its text with `longest` characters of context on both sides ----

    def states(self, s: str, border: int) -> list[tuple[int, int]]:
        """Candidates ``(a, n)`` at a border: a piece of ``n`` characters that starts ``a`` before it and reaches it."""
        return [(a, n) for a in range(1, min(self.longest, border) + 1) for n in range(a, self.longest + 1)
                if border - a + n <= len(s) and (n == 1 or s[border - a:border - a + n] in self.ids)]

    def transfer(self, s: str, b: int, e: int, first: bool, final: bool) -> list[tuple[int, int, int, int, int]]:
        """Matrix of the chunk ``s[b:e]``: entries ``(a, n, a2, n2, weight)``; the start state is (0, 0)."""
        stop = e if final else min(len(s), e + self.longest - 1)
        whole: list[tuple[list[int], int]] = []
        out = []
        for a, n in ([(0, 0)] if first else self.states(s, b)):
            begin = b - a + n
            if begin >= e and n:  # the entry piece covers the whole chunk
                if not final or begin == e:
                    out.append((a, n, a + e - b, n, 0))
                continue
            last = [0] * (stop + 1)
            last[begin] = n or -1
            for i in range(begin + 1, stop + 1):
                last[i] = self.step(s, last, begin, i, e)
                if i >= begin + 2 * self.longest and i % 16 == 0:
                    twin = next((w for w, at in whole if i >= at + self.longest and w[i - self.longest:i + 1] == last[i - self.longest:i + 1]), None)
                    if twin is not None:  # equal over the longest piece: equal from here on
                        last[i:] = twin[i:]
                        break
            whole.append((last, begin))
            for i in range(e, stop + 1):
                if last[i] > 0 and i > begin and i - last[i] < e:
                    count = sum(1 for _ in self.walk(last, begin, i))
                    out.append((a, n, e - (i - last[i]), last[i], -count))
        return out

    @staticmethod
    def walk(last: list[int], begin: int, end: int) -> Iterator[int]:
        while end > begin:
            yield end
            end -= last[end]

    def traced(self, s: str, b: int, e: int, entry: tuple[int, int], leave: tuple[int, int]) -> bytes:
        """Ids of the pieces that start in the chunk, between its two border states."""
        begin, end = b - entry[0] + entry[1], e - leave[0] + leave[1]
        last = self.ends(s, begin, entry[1], end, e)
        return self.id_bytes(self.back(s, last, begin, end))


def combine(left: list[tuple], right: list[tuple]) -> list[tuple]:
    """Max-plus product of two sparse matrices."""
    by: dict[tuple, list] = {}
    for a, n, a2, n2, w in right:
        by.setdefault((a, n), []).append((a2, n2, w))
    best: dict[tuple, int] = {}
    for a, n, a2, n2, w in left:
        for a3, n3, w2 in by.get((a2, n2), ()):
            k = (a, n, a3, n3)
            best[k] = max(best.get(k, w + w2), w + w2)
    return [(*k, w) for k, w in best.items()]


_LOADED: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    key = hash(model)
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _model(df: DataFrame, path: str):
    """The model's bytes (a fixed file of under 1 MB) as a broadcast value."""
    prepare(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _id_lists(blobs: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(b) // 4 for b in blobs]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def _slices(b: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [extra])


MATRIX = "array<struct<a:int,n:int,a2:int,n2:int,w:bigint>>"


def _entries(m) -> list[tuple]:
    return [(x["a"], x["n"], x["a2"], x["n2"], x["w"]) for x in m]


def _rows(m: list[tuple]) -> list[dict]:
    return [dict(zip(("a", "n", "a2", "n2", "w"), map(int, x))) for x in m]


def _chunk_rows(longest: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, uid2, text in zip(*[c.to_pylist() for c in b.columns]):
                s = MARK + text.replace(" ", MARK)
                marks = list(range(0, len(s), size))
                for k, lo in enumerate(marks):
                    left = min(lo, longest)
                    part = s[lo - left:lo + size + longest]
                    yield pa.RecordBatch.from_pydict({
                        "u": [uid], "v": [uid2], "no": [k], "chunks": [len(marks)], "s": [part], "b": [left],
                        "e": [left + min(size, len(s) - lo)]})
    return run


def giant_ids(texts: DataFrame, model, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``(u, v, token_ids)`` of giant texts ``(u, v, text)`` by the chunked scan."""
    longest = _pieces(model.value).longest
    chunks = texts.mapInArrow(_chunk_rows(longest, chunk), "u bigint, v bigint, no bigint, chunks bigint, s string, b bigint, e bigint")
    chunks = cut_lineage(chunks.repartition("u", "v", "no"))
    most = chunks.agg(F.max("chunks")).first()[0] or 0

    def matrices(frames):
        p = _pieces(model.value)
        for f in frames:
            m = [_rows(p.transfer(s, b, e, no == 0, no == n - 1)) for s, b, e, no, n in zip(f.s, f.b, f.e, f.no, f.chunks)]
            yield pd.DataFrame({"u": f.u, "v": f.v, "no": f.no, "m": m})

    def product(key, f):
        f = f.sort_values("no")
        m = _entries(f.m.iloc[0])
        for x in f.m.iloc[1:]:
            m = combine(m, _entries(x))
        return pd.DataFrame({"u": [key[0]], "v": [key[1]], "no": [key[2]], "m": [_rows(m)]})

    levels = [cut_lineage(chunks.mapInPandas(matrices, f"u bigint, v bigint, no bigint, m {MATRIX}"))]
    n = most
    while n > 1:
        up = levels[-1].groupBy("u", "v", F.expr(f"no DIV {fan}").alias("no")).applyInPandas(product, f"u bigint, v bigint, no bigint, m {MATRIX}")
        levels.append(cut_lineage(up))
        n = -(-n // fan)

    # downwards: a block's entry and exit state give the states at its inner borders
    def inner(key, f):
        f = f.sort_values("no")
        parts = [_entries(x) for x in f.m]
        at = (int(f.a.iloc[0]), int(f.n.iloc[0]))
        best: list[dict[tuple, tuple]] = []
        front: dict[tuple, int] = {at: 0}
        for m in parts:
            seen: dict[tuple, tuple] = {}
            for a, n_, a2, n2, w in m:
                if (a, n_) in front and ((a2, n2) not in seen or front[a, n_] + w > seen[a2, n2][0]):
                    seen[a2, n2] = (front[a, n_] + w, (a, n_))
            best.append(seen)
            front = {k: x[0] for k, x in seen.items()}
        state, rows = (int(f.a2.iloc[0]), int(f.n2.iloc[0])), []
        for seen in reversed(best):
            before = seen[state][1]
            rows.append((*before, *state))
            state = before
        out = pd.DataFrame(rows[::-1], columns=["a", "n", "a2", "n2"])
        return out.assign(u=key[0], v=key[1], no=f.no.to_numpy())[["u", "v", "no", "a", "n", "a2", "n2"]]

    states_of = "u bigint, v bigint, no bigint, a bigint, n bigint, a2 bigint, n2 bigint"
    known = levels[-1].select("u", "v", "no", F.explode("m").alias("x")).select(
        "u", "v", "no", *[F.col(f"x.{c}").cast("bigint").alias(c) for c in ("a", "n", "a2", "n2")])
    for level in reversed(levels[:-1]):
        part = level.withColumn("up", F.expr(f"no DIV {fan}")).join(known.withColumnRenamed("no", "up"), ["u", "v", "up"])
        known = cut_lineage(part.groupBy("u", "v", "up").applyInPandas(inner, states_of))

    def trace(frames):
        p = _pieces(model.value)
        for f in frames:
            ids = [np.frombuffer(p.traced(s, b, e, (a, n_), (a2, n2)), "<i4").tolist()
                   for s, b, e, a, n_, a2, n2 in zip(f.s, f.b, f.e, f.a, f.n, f.a2, f.n2)]
            yield pd.DataFrame({"u": f.u, "v": f.v, "no": f.no, "ids": ids})

    done = chunks.join(known, ["u", "v", "no"]).mapInPandas(trace, "u bigint, v bigint, no bigint, ids array<int>")
    return done.groupBy("u", "v").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("token_ids"))


def encode(docs: DataFrame, text: str = "text", model_path: str = MODEL_PATH,
           giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``token_ids``; texts of more than ``giant`` characters go through the chunked scan.

    With ``decoded`` the ids' text is added as a column of that name in the same pass.
    """
    model = _model(docs, model_path)
    keyed, keys = with_row_key(docs.drop("token_ids", *([decoded] if decoded else [])))
    size = F.coalesce(F.length(F.col(text).cast("string")), F.lit(0))
    short = keyed.where(size <= giant).drop(*keys)
    at = short.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(model.value)
        for whole in batches:
            for b in _slices(whole):
                blobs = [p.encode(t or "") for t in b.column(at).cast(pa.string()).to_pylist()]
                more = [pa.array([p.decode(np.frombuffer(x, "<i4")) for x in blobs], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*b.columns, _id_lists(blobs), *more], [*b.schema.names, "token_ids", *([decoded] if decoded else [])])

    out = short.mapInArrow(run, _schema(short, "token_ids array<int>" + (f", `{decoded}` string" if decoded else "")))
    giants = keyed.where(size > giant)
    ids = giant_ids(giants.select(F.col(keys[0]).alias("u"), F.col(keys[1]).alias("v"), F.col(text).cast("string").alias("text")), model, chunk, fan)
    ids = ids.select(F.col("u").alias(keys[0]), F.col("v").alias(keys[1]), "token_ids")
    long = giants.join(ids, keys).select(*short.columns, "token_ids")
    return out.unionByName(decode(long, "token_ids", decoded, model_path) if decoded else long)


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", model_path: str = MODEL_PATH) -> DataFrame:
    """``df`` with the decoded text of ``ids``."""
    model = _model(df, model_path)
    df = df.drop(out)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(model.value)
        for whole in batches:
            for b in _slices(whole):
                col = b.column(at).cast(pa.list_(pa.int32()))
                ends, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
                texts = [p.decode(values[i:j]) for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return df.mapInArrow(run, _schema(df, f"`{out}` string"))
