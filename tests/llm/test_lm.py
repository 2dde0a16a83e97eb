import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import SF001
from trellis.llm import lm_score, queries

W = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]


def fold(d):
    return None if d is None else zlib.crc32(str(d).encode()) % 5


def brute_base(rows):
    c = Counter(w for d, t in rows if fold(d) not in (None, 1) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {d: (fold(d) == 1, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
                sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for d, t in rows}


def check(rows, got):
    want = brute_base(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9, abs=1e-9) and r.score <= 0


def test_base_score_and_held_out_gain(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = queries.QUERIES["op5_lm_score"](spark, SF001).collect()
    assert len(got) == len(rows)
    check(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the bigram model predicts unseen texts better
    monkeypatch.setattr(lm_score, "HEAVY", 50)  # most words through the shards
    check(rows, lm_score.score(spark.read.parquet(f"{SF001}/documents.parquet")).collect())


def test_cases(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "A a  b\x0bc"), (4, "a b"), (5, "a b a b"), (6, "é É x"), (7, "a b" * 400), (7, "a b" * 400)]
    check(rows, lm_score.score(make_docs(rows)).collect())
    out = lm_score.score(make_docs([(None, "a"), *rows])).collect()
    assert len(out) == 9 and [r.held_out for r in out if r.doc_id is None] == [False]
    assert lm_score.score(make_docs(rows).limit(0)).count() == 0
    alone = lm_score.score(make_docs([(None, "a b")])).collect()[0]
    assert (alone.train_tokens, alone.base_score, alone.n_known) == (0, 0.0, 0)


def test_token_streams_cut_anywhere(monkeypatch):
    texts = [b"One  two\nthree", b"", None, b"x" * 50 + b" yy " * 40, b" ", b"end"]
    def flat():
        out = {}
        for t, p, d in lm_score.token_streams(texts):
            for a, b, c in zip(t.tolist(), p.tolist(), d.tolist()):
                out.setdefault(c, []).append((a, b))
        return out
    whole = flat()
    assert [len(whole[i]) for i in range(6)] == [4, 1, 1, 42, 1, 2]
    for size in (1, 7, 30, 64):
        monkeypatch.setattr(lm_score, "SLICE", size)
        assert flat() == whole
    h = lambda w: lm_score.word_hashes(np.frombuffer(b"q " + w, np.uint8), np.array([0, 2 + len(w)]))[0][1]
    assert len({int(h(w)) for w in (b"a", b"aa", b"ab", b"ba", b"\x00", b"\x00\x00")}) == 6 and h(b"AbC") == h(b"abc")


def test_filter_has_no_misses_and_few_errors():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 60_000).astype(np.uint64) * np.uint64(2)
    counts = rng.integers(1, 300, 60_000)
    data = lm_score.build_filter(keys, lm_score.levels(counts), lm_score.BITS, 1 << 30)
    m = lm_score.Model(63, 1, 1, np.frombuffer(data, np.uint8), np.zeros(2, np.uint64), np.full(2, 8 * len(data), np.uint64), keys[:0], counts[:0], 1)
    q = m.probe(keys, keys)
    assert (q >= lm_score.levels(counts)).all() and (q > lm_score.levels(counts)).mean() < 0.03
    other = rng.integers(0, 1 << 63, 60_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert (m.probe(other, other) > 0).mean() < 0.03 and m.error_rate < 0.03


def test_levels():
    """Exact up to 20, steps of at most a tenth beyond, up to the largest counts."""
    low = lm_score.LOWS
    assert low[:21].tolist() == [*range(1, 21), 22] and low[-1] >= 1 << 62 and (low[1:] > low[:-1]).all()
    assert (low[20:-1] * 1.1 + 1 >= low[21:]).all()
    counts = np.array([1, 2, 20, 21, 22, 23, 24, 1000, 1 << 40, (1 << 62) - 1])
    q = lm_score.levels(counts)
    assert (lm_score._LEAST[q] <= counts).all() and (lm_score._MOST[q] >= counts.astype(float)).all() and (lm_score._MOST[q] <= 1.1 * counts + 1).all()


def test_pairs_are_packed_by_shard():
    rng = np.random.default_rng(1)
    for shift in (57, 44, 40, 33):
        h = np.sort(lm_score.bigrams(rng.integers(0, 1 << 63, 999).astype(np.uint64), rng.integers(0, 1 << 63, 999).astype(np.uint64), shift))
        back = [lm_score.unpack_pairs(lm_score.pack_pairs(h[a:b], shift), s, shift) for s, a, b in lm_score._by_shard(h, shift)]
        assert (np.concatenate(back) == h).all() and len(np.unique(h)) == 999


def exact_model(rows):
    """Counts of the training rows, and the probability as the filter would give it without errors."""
    uni, pair = Counter(), Counter()
    for d, t in rows:
        if fold(d) not in (None, 1):
            w = tokens(t)
            uni.update(w)
            pair.update(zip(["<begin>", *w[:-1]], w))
            uni["<begin>"] += 1
    least = lambda c: float(lm_score._LEAST[lm_score.levels(np.array([c]))[0]])
    most = lambda c: float(lm_score._MOST[lm_score.levels(np.array([c]))[0]])
    words = [w for w in uni if w != "<begin>"]
    total, v = sum(least(uni[w]) for w in words), len(words)

    def p(w, before):
        cv, c, cb = most(uni[before]), least(uni[w]), least(pair[before, w])
        weight = lm_score.MIX_WEIGHT if cv else 0.0
        return weight * min(cb, c, cv) / max(cv, 1) + (1 - weight) * (c + 0.5) / (total + 0.5 * (v + 1))
    return words, p


def test_probabilities_sum_to_one_at_most():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices([f"w{int(rnd.paretovariate(0.7))}" for _ in range(40)], k=rnd.randrange(0, 60))) for _ in range(400)]
    words, p = exact_model(list(enumerate(texts)))
    for before in ["<begin>", "never seen", *rnd.sample([w for w in words if w], 60), "w1", "w2"]:
        assert 0.29 < sum(p(w, before) for w in [*words, "unknown"]) <= 1 + 1e-6


def test_scores_against_exact_counts(spark):
    """The score is the brute-force one, but for entries that seem present by the filter's error."""
    frame = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    _, p = exact_model(rows)
    got = {r.doc_id: r for r in lm_score.score(frame).collect()}
    model = lm_score.train(frame.select("doc_id", "text"))[0]
    assert model.error_rate < 0.03
    off, seen, n = [], 0, 0
    for d, t in rows:
        w = tokens(t)
        want = sum(math.log10(p(a, b)) for a, b in zip(w, ["<begin>", *w[:-1]]))
        off.append((got[d].score - want) / len(w))
        n += len(w)
    # an error makes a level one higher: an unseen pair that of a pair seen once, or the word before more frequent
    assert abs(np.mean(off)) < 4 * model.error_rate and min(off) > -10 * model.error_rate
    trained = [o for (d, _), o in zip(rows, off) if fold(d) != 1]
    assert np.median(trained) < 0.01


@pytest.mark.parametrize("most", [0, 1 << 16])
def test_scores_do_not_depend_on_the_broadcast_bound(spark, monkeypatch, make_docs, most):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows += [(900_001, None), (900_002, ""), (None, "a b"), (900_003, "a b " * 400), (900_003, "a b " * 400)]
    frames = [spark.read.parquet(f"{SF001}/documents.parquet"), make_docs(rows)]  # a file scan, and a frame that is none
    def run():
        return [sorted(lm_score.score(d).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens)) for d in frames]
    want = run()
    monkeypatch.setattr(lm_score, "MAX_BITS", most)
    monkeypatch.setattr(lm_score, "GROUP", 20_000)  # many groups a task
    for a, b in zip(want, run()):
        assert len(a) == len(b) and [r[:5] for r in a] == [r[:5] for r in b]
        assert [r.base_score for r in b] == pytest.approx([r.base_score for r in a], rel=1e-9)
        assert [r.score for r in b] == pytest.approx([r.score for r in a], rel=1e-9)


def test_filters_do_not_pass_the_driver(spark):
    """The driver's model names the folder of the filters and is small, whatever their size."""
    import pickle
    frame = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    model = lm_score.train(frame)[0]
    size = int(model.bits.sum()) // 8
    assert model.data is None and len(pickle.dumps(model)) < size / 2 + 20_000 + 16 * len(model.heavy)
    assert len(model.filters) == size and model.filters.any()


def test_shards_answer_many_groups_together(monkeypatch):
    """What groups ask of a shard is probed together, each distinct n-gram once, and its answers are those of each group alone."""
    rng = np.random.default_rng(5)
    shift, shard = 60, 3
    def hashes(n):
        return lm_score.unpack_pairs(lm_score.pack_pairs(rng.integers(0, 1 << 63, n).astype(np.uint64), shift), shard, shift)
    words, pairs = (np.unique(hashes(400)) for _ in "wp")
    counts = rng.integers(1, 70_000, len(words))
    data = lm_score.build_filter(np.concatenate([lm_score.unigram_key(words), pairs]), lm_score.levels(np.concatenate([counts, rng.integers(1, 5000, len(pairs))])), lm_score.BITS, 1 << 30)
    asks = [[np.sort(np.concatenate([rng.choice(h, 60, replace=False), hashes(5)])) for h in (words, pairs)] for _ in range(200)]
    rows = [(shard, "c", None, None, words.tobytes(), None, counts.astype("<i8").tobytes()), (shard, "f", None, None, data, None, b"")]
    rows += [(shard, "q", 1, g, w.tobytes(), lm_score.pack_pairs(p, shift), None) for g, (w, p) in enumerate(asks)]
    rows += [(shard, "q", 1, 200, words[:3].tobytes(), b"", None), (shard + 1, "q", 1, 201, words[:3].tobytes(), b"", None), (shard + 1, "t", 1, 0, b"cell", None, None)]
    probed, real = [], lm_score.probe_filter
    monkeypatch.setattr(lm_score, "probe_filter", lambda data, begin, bits, keys: probed.append(len(keys)) or real(data, begin, bits, keys))
    out = [r for b in lm_score._answers(shift)(iter([lm_score._pack(rows[:70], lm_score._ASKED), lm_score._pack(rows[70:], lm_score._ASKED)])) for r in b.to_pylist()]
    assert len(probed) < 10 and sum(probed) < sum(len(h) for a in asks for h in a) / 5
    assert [(r["kind"], r["words"]) for r in out if r["kind"] == "t"] == [("t", b"cell")]
    got = {r["grp"]: [lm_score._wide(r[c]).tolist() for c in ("words", "pairs", "counts")] for r in out if r["kind"] == "a"}
    assert len(got) == 202 and got[201] == [[0, 0, 0], [], [0, 0, 0]] and got[200][2] == counts[:3].tolist()
    for g, (w, p) in enumerate(asks):
        alone = [real(np.frombuffer(data, np.uint8), np.zeros(len(x), np.uint64), np.full(len(x), 8 * len(data), np.uint64), x).tolist() for x in (lm_score.unigram_key(w), p)]
        assert got[g] == [*alone, [dict(zip(words.tolist(), counts.tolist())).get(x, 0) for x in w.tolist()]]


def test_a_shard_is_merged_as_it_doubles(monkeypatch):
    """The work of merging what many tasks send is in proportion to it, not to its square."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(lm_score, "MERGE", 100, raising=False)
    rows, want, sent = [], Counter(), 0
    for _ in range(2000):
        h = np.unique(lm_score.unpack_pairs(lm_score.pack_pairs(rng.integers(0, 1 << 57, 20).astype(np.uint64), 57), 5, 57))
        rows.append((5, "b", lm_score.pack_pairs(h, 57), np.full(len(h), 2, "<u4").tobytes()))
        want.update(dict.fromkeys(h.tolist(), 2))
        sent += len(h)
    merged, real = [], lm_score.tally
    monkeypatch.setattr(lm_score, "tally", lambda h, n=None: merged.append(len(h)) or real(h, n))
    out = [r for b in lm_score._merger(57)(iter([lm_score._pack(rows)])) for r in b.to_pylist()]
    assert [r["kind"] for r in out] == ["u", "f"] and sum(merged) < 8 * sent
    keys, counts = np.array([*want], np.uint64), np.array([*want.values()])
    data = np.frombuffer(out[1]["hashes"], np.uint8)
    assert (lm_score.probe_filter(data, np.zeros(len(keys), np.uint64), np.full(len(keys), 8 * len(data), np.uint64), keys) >= lm_score.levels(counts)).all()


def test_giant_texts_in_shards(spark, monkeypatch, make_docs):
    """A text of many pieces, beside small ones, scores alike either way; its words are gone through again, not held."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices([f"w{j}" for j in range(300)], k=k))) for i, k in enumerate([3, 30_000, 0, 50, 20_000, 7])]
    monkeypatch.setattr(lm_score, "SLICE", 5_000)
    def run():
        return sorted(lm_score.score(make_docs(rows)).collect(), key=lambda r: r.doc_id)
    want = run()
    monkeypatch.setattr(lm_score, "MAX_BITS", 0)
    monkeypatch.setattr(lm_score, "GROUP", 1_000)
    for a, b in zip(want, run(), strict=True):
        assert a[:5] == b[:5] and b.score == pytest.approx(a.score, rel=1e-9) and b.base_score == pytest.approx(a.base_score, rel=1e-9)
    texts = [t.encode() for _, t in rows]
    streams = lm_score._streams(texts)
    assert not isinstance(streams, list) and isinstance(lm_score._streams(texts[:1]), list)
    words, pairs = lm_score._distinct(streams, 57)
    parts = list(lm_score.token_streams(texts))
    assert (words == np.unique(np.concatenate([x for t, p, _ in parts for x in (t, p)]))).all()
    assert (pairs == np.unique(np.concatenate([lm_score.bigrams(p, t, 57) for t, p, _ in parts]))).all()
