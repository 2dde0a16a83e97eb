"""Exact top-k search and vector codes against brute force, with odd rows planted."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from conftest import SF001
from trellis.llm import queries, top_k, vector_codes, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"
ODD = [(900, None, 1), (901, [1.0, None, 0.5, 0.0], 1), (902, [float("nan")] * 4, 2), (903, [float("inf"), 0.0, 0.0, 0.0], 2)]


def made(spark, rows):
    """Rows with extra columns whose names clash with those used inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("*", "vec_id AS key", "'x' AS score", "1 AS rank", "2 AS part", "'c' AS code", "0 AS n", "0 AS block")


def clusters(n, dims, seed, near=0.05):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[rnd.integers(6)] + near * rnd.normal(size=dims)
        out.append((i, [float(np.float32(x)) for x in v * rnd.choice([0.2, 1.0, 3.0])], int(rnd.integers(3)) or None))
    return out


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top(rows, k, scale, asks):
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if good(v)]
    out = []
    for at, (i, q) in enumerate(ints):
        if not asks(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0) for other, (j, c) in enumerate(ints) if other != at and len(c) == len(q))
        out += [(i, rank + 1, None if null else j, -s) for rank, (s, null, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_top_k_against_brute_force(spark):
    rows = clusters(700, 12, 3) + ODD
    got = top_k.top_k(made(spark, rows), F.col("vec_id") % 20 == 0, k=7)
    assert found(got) == brute_top(rows, 7, 64, lambda i: i % 20 == 0)


def test_top_k_ties_repeats_lengths_and_few_rows(spark):
    same = [(i, [0.5, -0.25, 0.0, 1.0], 0) for i in range(0, 60, 2)]
    rows = same + same[:4] + ODD + [(100, [1.0, 2.0], 0), (101, [2.0, 1.0], 0), (200, [], 0), (220, [], 0), (300, [9.0] * 5, 0), (40, [0.0] * 4, 0)]
    got = top_k.top_k(made(spark, rows), F.col("vec_id") % 20 == 0, k=5)
    want = brute_top(rows, 5, 64, lambda i: i % 20 == 0)
    assert found(got) == want and (300, 1) not in {w[:2] for w in want}
    assert top_k.top_k(made(spark, rows).limit(0), F.lit(True)).count() == 0
    assert top_k.top_k(made(spark, rows), F.lit(False)).count() == 0
    assert top_k.top_k(made(spark, [(1, [1.0], 0)]), F.lit(True)).count() == 0


def test_top_k_null_keys(spark):
    rows = [(None, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.5, 0.0], 0)]
    got = top_k.top_k(made(spark, rows), F.col("vec_id") == 2, k=3)
    assert found(got) == sorted([(2, 1, 1, 4096), (2, 2, None, 4096), (2, 3, 3, 2048)], key=repr)


def test_top_k_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="overflow"):
        top_k.top_k(made(spark, [(0, [1e12], 0), (1, [1e12], 0)]), F.lit(True)).collect()


def block(no, v, first):
    v = np.asarray(v, "<i4")
    v = v[np.argsort(-(v.astype(float) ** 2).sum(axis=1), kind="stable")]
    uid = np.arange(first, first + len(v))
    return top_k.Block(no, v, uid, pa.array(uid))


def test_every_pruning_is_used_and_exact():
    """Both prunings and the skip give the same rows as all products, at several floors."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 24))
    def some(n):
        v = centres[rnd.integers(40, size=n)] + 0.02 * rnd.normal(size=(n, 24))
        return np.floor(4096 * v / np.linalg.norm(v, axis=1)[:, None] * rnd.choice([0.6, 0.999, 1.0], n)[:, None])
    q, c = block(0, some(60), 0), block(1, some(4000), 1000)
    every = q.v.astype(np.int64) @ c.v.astype(np.int64).T
    used = {}
    for share in (-1.0, 0.3, 0.9, 0.97, 0.99, 0.997, 1.2):
        floor = np.floor(share * q.length * c.length[0])
        i, j, s = top_k.search_pair(q, c, floor, 20, used=used)
        got = {}
        for a, b, x in zip(i.tolist(), j.tolist(), s.tolist()):
            got.setdefault(a, []).append((-x, c.uid[b]))
        for a in range(60):
            want = sorted((-x, u) for x, u in zip(every[a].tolist(), c.uid.tolist()) if x >= floor[a])[:20]
            assert sorted(got.get(a, [])) == want
    assert all(used[way] > 50 for way in ("coordinate", "length", "skipped")), used


def test_a_row_is_not_its_own_neighbour_in_any_way():
    b = block(0, [[60, 20], [59, 21], [58, 22], [10, 60]], 0)
    for floor in (-np.inf, 3500.0):
        i, j, _ = top_k.search_pair(b, b, np.full(4, floor), 3)
        assert not (b.uid[i] == b.uid[j]).any()


# ---- vector codes ----

def brute_codes(rows, parts, entries, rounds, scale):
    kept = sorted(((i, v, g) for i, v, g in rows if good(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(scale * x) for x in v] for _, v, _ in kept]
    bounds = vector_codes.part_bounds(len(ints[0]), parts)
    books = [[v[lo:hi] for v in ints[:entries]] for lo, hi in bounds]
    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[lo:hi], e)), n) for n, e in enumerate(books[p])) for p, (lo, hi) in enumerate(bounds)] for v in ints]
    for _ in range(rounds):
        now = assign()
        for p, (lo, hi) in enumerate(bounds):
            for n in range(len(books[p])):
                mine = [v[lo:hi] for v, a in zip(ints, now) if a[p][1] == n]
                if mine:
                    books[p][n] = [sum(x) // len(mine) for x in zip(*mine)]
    last = assign()
    errors = [sum(d for d, _ in a) for a in last]
    by = {}
    for (_, _, g), e in zip(kept, errors):
        by[g] = by.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{n:02x}" for _, n in a), e, by[g]) for (i, _, g), a, e in zip(kept, last, errors)], key=repr), digest


def coded(df, **kw):
    out, book = vector_codes.code_vectors(df, **kw)
    rows = sorted((tuple(r) for r in out.select("vec_id", "code", "error", "group_error").collect()), key=repr)
    return rows, vector_codes.book_digest(book, vector_codes.part_bounds(book.shape[1], kw.get("parts", 8)))


@pytest.mark.parametrize("n, dims, parts", [(300, 16, 8), (5, 16, 8), (90, 11, 4), (40, 3, 8)])
def test_codes_against_brute_force(spark, n, dims, parts):
    rows = clusters(n, dims, n, 0.4)
    rows += [(i + 5000, v, g) for i, v, g in rows[:7]] + [(rows[0][0], rows[0][1], 2)] + ODD
    assert coded(made(spark, rows), parts=parts) == brute_codes(rows, parts, 16, 6, 4096)


def test_codes_ties_unused_entries_and_empty_table(spark):
    rows = [(i, [float(i % 2)] * 4, None) for i in range(40)]  # entries repeat: lower index wins, the others are never used
    got = coded(made(spark, rows), parts=2)
    assert got == brute_codes(rows, 2, 16, 6, 4096) and {r[1] for r in got[0]} == {"0000", "0101"}
    out, book = vector_codes.code_vectors(made(spark, rows).limit(0))
    assert out.count() == 0 and book.shape == (0, 0)


def test_codes_of_other_lengths_are_null(spark):
    rows = [(i, [0.1 * i, 1.0, -0.5, 0.0], 1) for i in range(20)] + [(50, [1.0], 1), (51, [], 3)]
    got, _ = coded(made(spark, rows), parts=2)
    by = {r[0]: r for r in got}
    assert by[50][1:3] == (None, None) and by[51] == (51, None, None, None) and by[50][3] == by[0][3]


def test_blocks_decode_to_their_rows():
    rnd = random.Random(2)
    ints = np.array([[rnd.randrange(-9, 9), rnd.randrange(-1 << 40, 1 << 40), 7] for _ in range(50)], np.int64)
    codes, values = vector_codes.decode_block(*vector_codes.encode_block(ints), 50)
    assert (np.stack([v[c] for v, c in zip(values, codes)], axis=1) == ints).all() and [len(v) for v in values][2] == 1


def test_pieces_are_of_exact_size():
    batches = [pa.RecordBatch.from_pydict({"a": list(range(lo, lo + n))}) for lo, n in ((0, 3), (3, 0), (3, 9), (12, 1))]
    got = [b.column(0).to_pylist() for b in vectors.pieces_of(iter(batches), 4)]
    assert got == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12]]


def test_queries_over_the_given_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    assert found(queries.QUERIES["op12_top_k"](spark, SF001)) == brute_top(rows, 20, 64, lambda i: i % 20 == 0)
    got = queries.QUERIES["op13_vector_codes"](spark, SF001).collect()
    want, digest = brute_codes(rows, 8, 16, 6, 4096)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want and {r.codebooks_sha256 for r in got} == {digest}
