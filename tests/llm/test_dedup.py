import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from conftest import SF001
from trellis.llm import exact_dedup, queries, simhash
from trellis.llm.common import components

W = re.compile(r"[^\x20\x09-\x0D]+")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(rows):
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    return {(i, min(by[norm(t)]), len(by[norm(t)]), i == min(by[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())
            for i, t in rows}


def test_exact_against_brute_force(spark):
    got = queries.QUERIES["op9_exact_dedup"](spark, SF001)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert {tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()} == brute_exact(rows)


def test_exact_cases(spark, make_docs):
    long = " ".join(f"w{i * 7919 % 1000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "a  b"), (4, "a\tb"), (4, "a b"), (5, "A b"), (6, long), (7, long.replace(" ", "\n")), (8, long + "x"), (None, "z"), (None, "z")]
    out = exact_dedup.exact_groups(make_docs(rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.text_sha256, []).append(r)
    assert sorted(len(g) for g in by.values()) == [1, 1, 2, 2, 2, 3]
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    assert {r.keep_id for r in out if r.doc_id in (6, 7)} == {6}
    kept = exact_dedup.dedup_rows(make_docs(rows))
    assert kept.columns[-2:] == ["fp", "kept"] and kept.count() == 6
    assert exact_dedup.exact_groups(make_docs(rows).limit(0)).count() == 0


def test_cut_points_follow_content():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(97, 123) for _ in range(200_000))
    ends = exact_dedup.cut_points(data)
    assert ends[-1] == len(data) and max(b - a for a, b in zip([0, *ends], ends)) <= exact_dedup.MAX_CHUNK
    moved = exact_dedup.cut_points(b"q" * 3000 + data)
    assert len({e + 3000 for e in ends} & set(moved)) > 0.7 * len(ends)
    big = data * 12
    exact_dedup.SEGMENT, keep = 1 << 18, exact_dedup.SEGMENT
    try:
        assert exact_dedup.cut_points(big) == (setattr(exact_dedup, "SEGMENT", 1 << 30) or exact_dedup.cut_points(big))
    finally:
        exact_dedup.SEGMENT = keep


def test_clashing_identifiers_fall_back(spark, make_docs, monkeypatch):
    rec = exact_dedup.recipes(make_docs([(1, "a"), (2, "b"), (3, "a")]), ["doc_id"])
    rec = rec.selectExpr("doc_id AS __uid", "doc_id", "text_sha256",
                         "transform(chunks, c -> struct(7L AS fp, c.v1, c.v2, c.len)) AS chunks")
    ids = {r.doc_id: r.ids for r in exact_dedup._verified_recipes(rec).collect()}
    assert ids[1] == ids[3] != ids[2]
    assert [r.verified for r in exact_dedup.chunk_store(rec).collect()] == [False]


def brute_fp(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = W.findall(t)
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_near(rows):
    fps = [brute_fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_simhash_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = queries.QUERIES["op10_simhash_near_dedup"](spark, SF001)
    assert {tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()} == brute_near(rows)


@pytest.mark.parametrize("n,flips", [(300, 2), (400, 4)])
def test_links_give_the_components_of_all_pairs(spark, n, flips):
    rnd = random.Random(n)
    seeds = [rnd.getrandbits(64) for _ in range(5)] + [0, 2**64 - 1]
    fps = set(seeds)
    while len(fps) < n:
        x = rnd.choice(seeds)
        for _ in range(rnd.randint(0, flips)):
            x ^= 1 << rnd.choice([0, 1, 2, 3, 30, 31, 32, 33, 62, 63, rnd.randrange(64)])
        fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    up = {f: f for f in signed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = {r.node: r.root for r in components(simhash.near_links(df)).collect()}
    assert {f: got.get(f, f) for f in signed} == {f: find(f) for f in signed}


def close_pairs(fps, of):
    """All links of the fingerprints at ``of`` to others, by comparing them with every one."""
    every = np.array(fps, np.uint64)
    return [(fps[i], fps[j]) for i in of for j in np.flatnonzero(np.bitwise_count(every ^ every[i]) <= 3).tolist() if j != i]


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("mask", [0xFFFFFFFF, 0xFFFFFFFF00000000, 0xFFFF0000])
def test_crowded_buckets_without_all_pairs(spark, mask):
    """50,000 fingerprints with one half (or only 16 random bits and a cluster) in common: linear work, and no link is lost."""
    import time
    rnd = random.Random(mask)
    common = rnd.getrandbits(64) & ~mask
    n = 50_000 if mask != 0xFFFF0000 else 12_000
    fps = list({common | rnd.getrandbits(64) & mask for _ in range(n)})
    fps += list({fps[0] ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(1500)} - set(fps))  # near copies of one
    near = [f ^ (7 << rnd.randrange(60)) for f in fps[1:200]]  # three bits away
    fps = list(dict.fromkeys(fps + near))
    t = time.time()
    got = {r.node: r.root for r in components(simhash.near_links(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint"))).collect()}
    assert time.time() - t < 120
    pairs = close_pairs(fps, range(0, len(fps), len(fps) // 300)) + close_pairs(fps, range(1, 200))
    root = lambda f: got.get(signed(f), signed(f))
    assert len(pairs) > 200 and all(root(a) == root(b) for a, b in pairs)
    # and nothing is joined that no chain of links joins
    if mask != 0xFFFF0000:
        sizes = {}
        for f in fps:
            sizes.setdefault(root(f), []).append(f)
        for group in [g for g in sizes.values() if 1 < len(g) < 50][:100]:
            reach, edge = {group[0]}, [group[0]]
            while edge:
                edge = [b for a in edge for b in group if b not in reach and (a ^ b).bit_count() <= 3 and not reach.add(b)]
            assert reach == set(group)


def test_simhash_cases(spark, make_docs):
    words = " ".join(f"w{i}" for i in range(70_000))
    rows = [(9, None), (8, " \n"), (7, "one"), (6, "ONE"), (5, "one two"), (4, words), (3, words.upper()), (None, "one"), (4, words)]
    out = simhash.near_components(make_docs(rows)).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(9, 8), (8, 8), (7, 6), (6, 6), (5, 5), (4, 3), (3, 3), (None, 6)}
    assert len(out) == len(rows)
    assert simhash.keep_one(make_docs(rows)).count() == 4
    assert simhash.near_components(make_docs(rows).limit(0)).count() == 0
    assert simhash.fingerprint(words.encode()) == brute_fp(words) - (brute_fp(words) >> 63 << 64)
