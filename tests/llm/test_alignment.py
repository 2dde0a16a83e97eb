"""Token alignment against a plain scan of the libraries' encodings."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF001
from trellis.llm import alignment, queries

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def decoded():
    """Token bytes: A's from the rank file of the same vocabulary, B's from the piece texts."""
    a = {}
    with open(alignment.A_PATH.replace(".json", ".tiktoken"), "rb") as f:
        for line in f:
            spelled, rank = line.split()
            a[int(rank)] = base64.b64decode(spelled)
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)
    b = {i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(3, sp.get_piece_size())}
    return a, b, sp


def brute(texts):
    """All columns of every text by counting links in plain dictionaries."""
    a_bytes, b_bytes, sp = decoded()
    lib = Tokenizer.from_file(alignment.A_PATH)
    lib.encode_special_tokens = True
    per, counts = [], Counter()
    for t in texts:
        t = t or ""
        x, y = lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        if not t or b"".join(a_bytes[i] for i in x) != (" " + t).encode() or b"".join(b_bytes.get(i, b"") for i in y) != (" " + t).encode():
            per.append(([], [], [], ""))
            continue
        ends = []
        for ids, spelled in ((x, a_bytes), (y, b_bytes)):
            at, out = 0, {}
            for n, i in enumerate(ids):
                at += len(spelled[i])
                out[at] = n
            ends.append(out)
        links, groups, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            links.append((x[ends[0][end]], y[ends[1][end]]))
            groups.append(",".join(map(str, x[i:ends[0][end] + 1])) + "|" + ",".join(map(str, y[j:ends[1][end] + 1])))
            i, j = ends[0][end] + 1, ends[1][end] + 1
        counts.update(links)
        per.append((x, y, links, ";".join(groups)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(len(x), len(y), len(links), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if x else "") for x, y, links, g in per]


CASES = [None, "", " ", "  two  spaces ", "a", "<|endoftext|> and <s> </s> <unk> <0x41>", "mark ▁ inside", "naïve café 東京 \U0001f600\U0001f600 é",
         "tab\tline\nnew\r\n\x00\x01", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40, "the the the the the", "the the the the the", "x" * 20_000 + " end", "​﻿ ",
         "word " * 30_000]


def test_cases_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string").repartition(3)
    docs = docs.selectExpr("*", "'x' AS block", "1 AS doc", "2 AS n", "3 AS a", "4 AS b", "5 AS links", "6 AS n_a", "text AS __text")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, ["doc_id"]).collect()}
    want = brute(CASES)
    assert [got[i] for i in range(len(CASES))] == want
    assert want[6] == (0, 0, 0, 0, 0, 0, "") and want[5][0] > 0
    both = alignment.align(docs, ["doc_id", "block"])  # an id column named like one inside
    assert both.count() == len(CASES)
    assert alignment.align(docs.limit(0), ["doc_id"]).count() == 0


def test_query_over_the_given_table(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_token_alignment"](spark, SF001).collect()}
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows])


def test_pair_counts_against_brute_force(spark):
    texts = ["the cat sat", "the cat", "the the the", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    _, postings = alignment.build_index(docs, [])
    got = {(r.a, r.b): (r.docs, r.links) for r in alignment.pair_counts(postings).collect()}
    docs_of, links = Counter(), Counter()
    pair = alignment.Pair(open(alignment.A_PATH, "rb").read(), open(alignment.B_PATH, "rb").read())
    for x, y in pair.encode([t or "" for t in texts]):
        la, lb, _ = pair.groups(x, y)
        found = list(zip(la.tolist(), lb.tolist()))
        links.update(found)
        docs_of.update(set(found))
    assert got == {p: (docs_of[p], n) for p, n in links.items()}


@pytest.mark.parametrize("docs", [1, 9, 4096])
def test_planes_add_up_to_what_was_counted(docs):
    """Sparse and dense bitmaps of all planes give every document's exact sums back."""
    rnd = random.Random(docs)
    n = 6000
    keys = np.array([rnd.choice([1, 2, 3, 4 + rnd.randrange(40)]) for _ in range(n)])
    of = np.array([rnd.randrange(docs) for _ in range(n)])
    cut = sorted(rnd.sample(range(docs + 1), min(2, docs)))
    parts = [alignment.counted(keys[m], of[m]) for m in ((of < cut[0]), (of >= cut[0]))]
    value = {k: (k * 7, k % 2) for k in range(60)}
    want = np.zeros((docs, 2), np.int64)
    for k, d in zip(keys.tolist(), of.tolist()):
        want[d] += value[k]
    got, kinds, links = np.zeros((docs, 2), np.int64), set(), Counter()
    for p in alignment.planes(*alignment.merge(parts), docs):
        v = np.array([value[k] for k in p["key"].tolist()]) * p["weight"]
        got += alignment.add_up(docs, p["n"], v, pa.array(p["sparse"], pa.binary()), pa.array(p["dense"], pa.binary()))
        kinds |= {s is None for s in p["sparse"]}
        for k, m in zip(p["key"].tolist(), p["n"].tolist()):
            links[k] += m * p["weight"]
    assert (got == want).all() and links == Counter(keys.tolist())
    assert docs < 4096 or kinds == {True, False}
