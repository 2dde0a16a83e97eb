import random

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF001
from trellis.llm import pieces, queries
from llm.test_dedup import brute_exact, brute_near
from llm.test_mixing_quality import brute_counts, water_fill

LIB = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
BITS = ["the", "▁", " ", "  ", "a", "in", "er", "\n", "\t", "é", "漢", "😀", "ing", "#", "0", "tion", "ab"]


def test_query_round_trip_and_library(spark):
    rows = queries.QUERIES["op3_sentencepiece"](spark, SF001).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.round_trip for r in rows)
    assert {r.doc_id: r.n_pieces for r in rows} == {d: len(LIB.encode(t or "")) for d, t in docs.items()}


def test_chunked_scan_equals_library(spark, make_docs):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(60, 900))) for _ in range(40)]
    texts += ["aaaa" * 200, "▁" * 500, " " * 333, "inginging" * 90, "the" * 300, "漢" * 150, "ererererer" * 77]
    docs = make_docs([(i, t) for i, t in enumerate(texts)]).selectExpr("*", "1 AS u", "2 AS v", "3 AS no")
    out = pieces.encode(docs, giant=50, chunk=40, fan=3)
    assert out.columns == [*docs.columns, "token_ids"]
    got = {r.doc_id: r.token_ids for r in out.collect()}
    assert got == {i: LIB.encode(t) for i, t in enumerate(texts)}
    both = pieces.encode(docs, giant=200, chunk=40, fan=3, decoded="back").collect()
    assert {r.doc_id: r.token_ids for r in both} == got and {r.doc_id: r.back for r in both} == {i: t.replace("▁", " ") for i, t in enumerate(texts)}
    back = {r.doc_id: r.decoded for r in pieces.decode(out).collect()}
    assert back == {i: t.replace("▁", " ") for i, t in enumerate(texts)}


def test_products_are_associative():
    p = pieces.Pieces(open(pieces.MODEL_PATH, "rb").read())
    s = pieces.MARK + "thinneredtionabouts" * 12
    cut = [0, 40, 80, 120, 160, len(s)]
    m = [p.transfer(s, a, b, a == 0, b == len(s)) for a, b in zip(cut, cut[1:])]
    left = m[0]
    for x in m[1:]:
        left = pieces.combine(left, x)
    right = m[-1]
    for x in m[-2::-1]:
        right = pieces.combine(x, right)
    assert left == right == [(0, 0, *left[0][2:4], -len(LIB.encode(s[1:])))]


def test_cases(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "\x00\x01 a"), (4, "a b"), (4, "a b"), (None, "x")]
    got = sorted((r.doc_id or 0, r.token_ids) for r in pieces.encode(make_docs(rows)).collect())
    assert got == sorted((d or 0, LIB.encode(t or "")) for d, t in rows)
    assert pieces.encode(make_docs(rows).limit(0)).count() == 0
    mine = pieces.Pieces(open(pieces.MODEL_PATH, "rb").read())
    assert mine.decode(np.array([], int)) == ""


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        out.write.parquet(str(tmp_path / name))
        kept.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in spark.read.parquet(str(tmp_path / name)).collect()]))
        docs = spark.read.parquet(str(tmp_path / name))
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(o[0]) == cols for _, _, o in kept[:-1]) and list(kept[-1][2][0]) == [*cols, "token_ids"]
    _, before, after = kept[0]
    failed = {r["doc_id"] for r in before if (c := brute_counts(r["text"]))[0] < 20 or 100 * c[4] > 30 * c[0]}
    assert not failed & {r["doc_id"] for r in after} and len(after) > 0.7 * len(before)
    _, before, after = kept[1]
    assert sorted(r["doc_id"] for r in after) == sorted(x[0] for x in brute_exact([(r["doc_id"], r["text"]) for r in before]) if x[3])
    _, before, after = kept[2]
    assert sorted(r["doc_id"] for r in after) == sorted({x[2] for x in brute_near([(r["doc_id"], r["text"]) for r in before])})
    _, before, after = kept[3]
    size = {}
    for r in before:
        size[r["source"]] = size.get(r["source"], 0) + brute_counts(r["text"])[0]
    want, most = water_fill(size), max(brute_counts(r["text"])[0] for r in before)
    for s, t in want.items():
        assert abs(sum(brute_counts(r["text"])[0] for r in after if r["source"] == s) - t) <= most
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    assert all(r["token_ids"] == LIB.encode(r["text"]) for r in kept[4][2]) and len(kept[4][2]) == len(after)
    assert corpus_pipeline.run(spark, SF001).count() == len(after)


def test_pipeline_on_empty_and_odd_rows(spark, make_docs, tmp_path):
    for k, rows in enumerate(([], [(1, None), (1, None), (None, "a b"), (2, " ".join(f"w{i}" for i in range(90)), None, None)])):
        docs = make_docs(rows)
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{k}{name}")
            stage(spark, docs, SF001).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.where(F.col("doc_id").isNotNull()).count() <= 3
