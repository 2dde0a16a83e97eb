"""Record logs by byte offsets, tree listing, count-or-time batches, skip stream, answer ledger, exact tokens."""

import io
import json
import os
import random
import sys
import tempfile

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from trellis.functions import bpe
from trellis.operators import analyze
from trellis.operators.ledger import AnswerLedger, call
from trellis.sources import record_log, tree
from trellis.streaming import batching, skip_stream
from trellis.streaming.topics import drain, publish, run_folder, state_stores, subscribe

from conftest import SF001

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers know the engine, not this module
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def folder():
    return tempfile.mkdtemp(prefix="trellis-logs-", dir="/tmp")


# ---- record logs ----

@pytest.mark.parametrize("seed", range(40))
def test_every_record_is_in_one_range(seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(record_log, "TAIL", rnd.choice([1, 7, 64]))
    lines = [bytes(rnd.choices(b"ab\xc3\xa9", k=rnd.randrange(0, 25))) for _ in range(rnd.randrange(0, 12))]
    data = b"".join(x + b"\n" for x in lines) + rnd.choice([b"", b"tail"])
    want, at = [], 0
    for x in data.split(b"\n"):
        want.append((at, x))
        at += len(x) + 1
    if not want[-1][1]:
        want.pop()
    step = rnd.randrange(1, 30)
    got = [r for lo in range(0, len(data), step) for r in record_log.records(io.BytesIO(data), lo, min(len(data), lo + step))]
    assert got == want
    assert record_log.line_end(io.BytesIO(data), 0, len(data)) == data.rfind(b"\n") + 1


def test_a_long_record_takes_linear_time():
    import time
    data = b"x" * (64 << 20) + b"\ny\n"
    t = time.time()
    assert [len(r) for _, r in record_log.records(io.BytesIO(data), 0, len(data))] == [64 << 20, 1]
    assert [r for _, r in record_log.records(io.BytesIO(data), 1 << 20, len(data))] == [b"y"] and time.time() - t < 5


EVENT = "id long, name string"


def _consume(spark, top, out, ck, **kw):
    schema = spark.createDataFrame([], EVENT).schema
    rows = record_log.typed(record_log.stream_records(spark, top, **kw), schema, ("id",))
    drain(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
    return spark.read.parquet(out)


def test_growing_logs_stop_and_resume(spark):
    """No record is lost or doubled: logs grow, a record is written in two parts, the query stops in between."""
    top, base = folder(), folder()
    log = os.path.join(top, "p0.log")
    put = lambda text, path=log: open(path, "a", encoding="utf-8", newline="").write(text)
    put("".join(json.dumps({"id": i, "name": f"é{i}"}) + "\n" for i in range(500)) + '{"id": 500, "na')
    go = lambda **kw: _consume(spark, top, f"{base}/out", f"{base}/ck", range_bytes=700, group="g", **kw)
    assert go().count() == 500
    size = os.path.getsize(log)
    assert record_log.lag(spark, top, "g") == size and record_log.lag(spark, top, "other") == size  # noted when the next batch begins
    put('me": "late"}\n{"id": "x"}\nnothing\n{"name": "no id"}\n[1]\n\n')
    put('{"id": 900, "name": null}\n', os.path.join(top, "p1.log"))
    put("hidden\n", os.path.join(top, ".p2.log"))
    got = go().collect()
    good = [r for r in got if r.reason is None]
    assert sorted(r.id for r in good) == [*range(501), 900] and {r.name for r in good if r.id == 500} == {"late"}
    assert sorted(r.value for r in got if r.reason) == ["", "[1]", "nothing", '{"id": "x"}', '{"name": "no id"}']
    put('{"id": 901}\n')
    assert go().count() == len(got) + 1
    assert record_log.lag(spark, top, "g") == len('{"id": 901}\n')
    assert record_log.read_records(spark, top, 100).count() == len(got) + 1


def test_a_batch_that_fails_is_read_again_whole(spark):
    top, base = folder(), folder()
    open(f"{top}/a.log", "w").write("".join(f'{{"id": {i}, "name": "n"}}\n' for i in range(50)))
    seen = []
    def crash(batch, batch_id):
        seen.append((batch_id, sorted(r.offset for r in batch.select("offset").collect())))
        if len(seen) == 1:
            raise RuntimeError("stopped during the batch")
    start = lambda: drain(record_log.stream_records(spark, top, range_bytes=64).writeStream.option("checkpointLocation", f"{base}/ck")
                          .trigger(availableNow=True).foreachBatch(crash).start())
    with pytest.raises(Exception, match="stopped during the batch"):
        start()
    open(f"{top}/a.log", "a").write('{"id": 50, "name": "n"}\n')
    start()
    start()  # a run that resumes a batch may end with it
    assert seen[0] == seen[1] and sum(len(o) for _, o in seen[1:]) == 51


def test_bounded_batches(tmp_path):
    """With a limit every batch is at most a share of each file (a longer record whole), also after a restart."""
    (tmp_path / "a.log").write_bytes(b"0123456789\n" * 100)
    (tmp_path / "b.log").write_bytes(b"x" * 500 + b"\n" + b"y\n")
    options = {"path": f"file://{tmp_path}", "maxBytesPerTrigger": "100", "group": "g"}
    reader, last, steps = record_log.RecordLogStreamReader(options), {}, 0
    while True:
        if steps == 5:
            reader = record_log.RecordLogStreamReader(options)
        now = reader.latestOffset()
        if now == last:
            break
        assert all(now[p] >= n for p, n in last.items())
        assert all(n - last.get(p, 0) <= (501 if p.endswith("b.log") else 100) for p, n in now.items())
        last, steps = now, steps + 1
    assert sorted(last.values()) == [503, 1100] and steps > 10
    with pytest.raises(ValueError):
        record_log.RecordLogStreamReader({"path": "file:///x", "maxBytesPerTrigger": "5"})


# ---- tree ----

def test_tree_is_listed_by_levels_and_read_in_ranges(spark, monkeypatch):
    root = folder()
    want = {}
    def put(rel, content):
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)
        want[rel] = content.decode("utf-8", "replace")
    for i in range(40):  # one project holds most folders, at several depths
        put(f"hot/{'/'.join(f'd{i % (k + 2)}' for k in range(i % 7))}/f{i}.txt".replace("//", "/"), b"z" * (i * 100))
    put("small/.hidden/_x y/é%20.txt", "ünï".encode())
    put("small/bytes.bin", b"\xff\xfe ok")
    put("small/empty", b"")
    open(os.path.join(root, "no project"), "w").write("x")
    os.makedirs(os.path.join(root, "bare/folder"))
    os.symlink(root, os.path.join(root, "small/loop"))
    listed = tree.list_tree(spark, root)
    assert {f"{r.project}/{r.rel_path}": r.size for r in listed.collect()} == {k: os.path.getsize(os.path.join(root, k)) for k in want}
    monkeypatch.setattr(tree, "READ_BYTES", 10_000)
    read = tree.scan_tree(spark, root)
    tasks = read.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum(F.length("content")).alias("n")).collect()
    assert len([t for t in tasks if t.n]) >= 6 and max(t.n for t in tasks) < 20_000
    assert {f"{r.project}/{r.rel_path}": r.content for r in read.collect()} == want
    assert tree.scan_tree(spark, folder()).count() == 0


@pytest.mark.parametrize("path, want", [("a/b", "a/b"), ("./a//b/", "a/b"), ("a/../b", "b"), ("a/b/c/d/e/../../../../../x", "x"), ("../a", "../a"),
                                        ("a/../../b", "../b"), ("../../a/./..", "../.."), (" a ", "a"), ("", ""), ("/a/../b", "/b"), ("./././a/./.", "a")])
def test_normal_path(spark, path, want):
    assert spark.range(1).select(tree.normal_path(F.lit(path))).first()[0] == want


# ---- batches ----

class Clock:
    def __init__(self):
        self.now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Handle:
    """State of one key in memory, with timers; stands in for the engine's."""

    def __init__(self):
        self.timers = set()

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

        put = update

        def clear(self):
            self.v = None

    def getValueState(self, *_):
        return Handle.Value()

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_batches_under_a_manual_clock():
    """Three rows or two seconds: whichever is first closes the batch; the timer closes what no row closes."""
    handle, clock, out = Handle(), Clock(), []
    p = batching.CountOrTime("k", 3, 2.0, event_time=False)
    p.init(handle)
    class Fired:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at
    def tell(frames):
        out.extend((int(f.batch_no.iloc[0]), f.closed_by.iloc[0], f.body.tolist()) for f in frames)
    def at(ms, bodies=()):
        clock.now = ms
        if bodies:
            tell(p.handleInputRows(("a",), iter([pd.DataFrame({"at_us": 0, "body": list(bodies)})]), clock))
        for t in sorted(t for t in handle.timers if t <= ms):
            tell(p.handleExpiredTimer(("a",), clock, Fired(t)))
            handle.timers.discard(t)
    at(0, "ab")
    at(1999)
    assert out == []
    at(2000)
    assert out == [(0, "time", ["a", "b"])] and not handle.timers
    at(5000, "cdefghi")  # two full batches and one open row
    assert out[1:] == [(1, "count", ["c", "d", "e"]), (2, "count", ["f", "g", "h"])] and handle.timers == {7000}
    at(6000, "jk")
    assert out[3:] == [(3, "count", ["i", "j", "k"])] and not handle.timers
    at(6500, "l")
    at(8600, "m")  # the row comes after the due time, before the timer was served
    assert out[4:] == [(4, "time", ["l"])] and handle.timers == {10600}
    at(20_000)
    assert out[5:] == [(5, "time", ["m"])] and p.held.v is None


def test_closed_batches_leave_together():
    """Many closed batches are few frames, with the rows of a frame a batch; ties go by their text."""
    rnd = random.Random(5)
    rows = pd.DataFrame({"at_us": [rnd.randrange(2_000_000_000) for _ in range(9_000)] * 2, "body": [f"é{i % 977}" for i in range(18_000)]})
    def run(*frame_rows):
        p = batching.CountOrTime("k", 20, 3.0, True, *frame_rows)
        p.init(Handle())
        return list(p.handleInputRows(("a",), iter([rows[:5_000], rows[5_000:]]), Clock()))
    each, few = run(), run(batching.FRAME_ROWS)
    assert len(each) > 600 and len(few) == 2 and {len(f.batch_no.unique()) for f in each} == {1}
    assert pd.concat(each).to_dict("list") == pd.concat(few).to_dict("list")
    came, want, no, due = sorted(zip(rows.at_us, rows.body)), [], 0, None
    for at, body in came:
        if want and want[-1][0] == no and (at >= due or sum(w[0] == no for w in want[-20:]) == 20):
            no += 1
        if not want or want[-1][0] != no:
            due = at + 3_000_000
        want.append((no, body))
    assert list(zip(pd.concat(few).batch_no, pd.concat(few).body)) == want[:sum(map(len, few))]


def test_batches_by_event_time_in_several_micro_batches(spark):
    """The stream's batches are those of one pass over the rows, however they fall into micro-batches."""
    rnd = random.Random(3)
    rows, now = [], 0
    for i in range(300):
        now += rnd.choice([1] * 12 + [50, 400])
        rows.append((i % 3, now, f"e{i}"))
    want = {}
    for shard in range(3):
        batch, no, start = [], 0, None
        for _, at, name in [r for r in rows if r[0] == shard]:
            if batch and at >= start + 500:
                want[shard, no] = ("time", batch)
                batch, no = [], no + 1
            start = start if batch else at
            batch.append(name)
            if len(batch) == 7:
                want[shard, no] = ("count", batch)
                batch, no = [], no + 1
        if batch:
            want[shard, no] = ("time", batch)
    run = run_folder(spark, "batches")
    frame = lambda part: spark.createDataFrame(part, "shard long, s long, name string").select("shard", F.timestamp_seconds("s").alias("ts"), "name").coalesce(1)
    with state_stores(spark):
        for lo in range(0, 300, 75):
            publish(frame(rows[lo:lo + 75] + [(None, 1, "no shard")]), f"{run}/t")
            drain(batching.batch_stream(subscribe(spark, f"{run}/t", frame([]).schema, 1), "shard", 7, 500, f"{run}/out", f"{run}/ck", "ts"))
        publish(frame([(9, now + 100_000, "beat")]), f"{run}/t")
        drain(batching.batch_stream(subscribe(spark, f"{run}/t", frame([]).schema, 1), "shard", 7, 500, f"{run}/out", f"{run}/ck", "ts"))
    got = {}
    for r in spark.read.parquet(f"{run}/out").orderBy("shard", "batch_no", "place").collect():
        got.setdefault((r.shard, r.batch_no), (r.closed_by, []))[1].append(r.name)
    assert got == want and {len(b) for why, b in got.values() if why == "count"} == {7}


# ---- skip stream ----

def test_skip_stream_tells_files_and_drops_replays(spark):
    run = run_folder(spark, "skip")
    events = spark.createDataFrame([("file", "f1"), ("file", "f2"), ("package", "p1"), ("package", "p2"), ("file", "f1"), (None, "x"), ("file", None)], skip_stream.LEVEL_EVENT)
    fresh = spark.createDataFrame([("file", "f1"), ("package", "p1")], skip_stream.LEVEL_EVENT)
    publish(events, f"{run}/t")
    for _ in range(2):
        with state_stores(spark):
            drain(skip_stream.skip_stream(subscribe(spark, f"{run}/t", skip_stream.LEVEL_EVENT), fresh, f"{run}/out", f"{run}/ck"))
        publish(events, f"{run}/t")  # a replay within the window
    got = sorted((r.topic, r.level, r.entity_id) for r in spark.read.parquet(f"{run}/out").collect())
    assert got == [("analyze", "file", "f2"), ("analyze", "package", "p2"), ("analyzed", "file", "f1")]


# ---- ledger ----

class Counting:
    """Writes a line per call, so that calls can be counted across tasks."""

    def __init__(self, path, bad=()):
        self.path, self.bad = path, bad

    def __call__(self, system, user):
        with open(self.path, "a") as f:
            f.write(user + "\n")
        if user in self.bad:
            raise ValueError("bad prompt")
        return f"{system}:{user}"


def requests(spark, users):
    return spark.createDataFrame([(i, "s", u) for i, u in enumerate(users)], "id long, system_prompt string, user_prompt string").checkpoint()


def test_ledger_asks_each_request_once(spark):
    base = folder()
    log = f"{base}/calls"
    ledger = AnswerLedger(spark, f"{base}/answers")
    calls = lambda: open(log).read().split()
    got = ledger.ask(requests(spark, ["a", "b", "a", "bad"]), Counting(log, ("bad",)), "id", parallelism=3, retries=2)
    assert sorted((r.id, r.analysis, r.status, r.attempts) for r in got.collect()) == [(0, "s:a", "ok", 1), (1, "s:b", "ok", 1), (2, "s:a", "ok", 1), (3, None, "failed", 2)]
    assert sorted(calls()) == ["a", "b", "bad", "bad"]
    got = ledger.ask(requests(spark, ["c", "b", "bad"]), Counting(log, ("bad",)), "id", retries=1, again=False)
    assert sorted((r.id, r.status) for r in got.collect()) == [(0, "ok"), (1, "ok"), (2, "failed")] and sorted(calls()) == ["a", "b", "bad", "bad", "c"]
    got = ledger.ask(requests(spark, ["bad"]), Counting(log), "id")
    assert [r.status for r in got.collect()] == ["ok"] and calls()[-1] == "bad"
    n = len(calls())
    ledger.compact()
    assert {r.status for r in ledger.ask(requests(spark, ["a", "b", "c", "bad"]), Counting(log), "id").collect()} == {"ok"} and len(calls()) == n
    assert ledger.ask(requests(spark, ["a"]).limit(0).checkpoint(), Counting(log), "id").count() == 0


class DiesOnce(Counting):
    """Kills its worker process at one request, the first time."""

    def __call__(self, system, user):
        mark = self.path + ".died"
        if user == "r5" and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return super().__call__(system, user)


def test_a_lost_worker_repeats_no_written_answer(spark):
    """The process dies amid a task; what the task had written is not asked again by whoever goes on."""
    base = folder()
    log = f"{base}/calls"
    ledger = AnswerLedger(spark, f"{base}/answers")
    reqs = requests(spark, [f"r{i}" for i in range(10)])
    fn = DiesOnce(log)
    try:
        ledger.ask(reqs, fn, "id", parallelism=1, flush=1)
    except Exception:  # noqa: BLE001 - in local mode a task is not run again: the job fails, and the next one resumes
        pass
    got = ledger.ask(reqs, fn, "id", parallelism=1, flush=1)
    assert got.where("status = 'ok'").count() == 10
    calls = open(log).read().split()
    assert sorted(calls) == sorted(f"r{i}" for i in range(10))


def test_analyze_prompts_with_a_ledger(spark):
    base = folder()
    ledger = AnswerLedger(spark, f"{base}/answers")
    rows = spark.createDataFrame([("u", 0, "head", "sys"), ("u", 1, "body", None), ("v", 0, "x", "sys")], "id string, section int, text string, system_prompt string")
    first = analyze.analyze_prompts(rows, Counting(f"{base}/calls"), ["id"], ["section"], ledger=ledger).collect()
    again = analyze.analyze_prompts(rows, Counting(f"{base}/calls"), ["id"], ["section"], ledger=ledger).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) == [("u", "sys:headbody", "ok", None), ("v", "sys:x", "ok", None)]
    assert len(open(f"{base}/calls").read().split()) == 2


def test_call_reports_what_failed():
    assert call(lambda s, u: 1 / 0, "", "", 2, 0.0) == (None, "failed", "ZeroDivisionError: division by zero", 2)


# ---- exact tokens ----

def plain_merge(word, ranks):
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_against_plain_merging_and_a_library(spark):
    import tiktoken
    ranks = bpe.read_ranks(spark, RANKS)
    lib = tiktoken.Encoding("x", pat_str=bpe.CL100K_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    counter = bpe.Counter(ranks, bpe.CL100K_PATTERN)
    for _ in range(400):
        text = "".join(rnd.choices("abcdetsr  'éñ東\U0001f600\n\t0123.,!", k=rnd.randrange(0, 60)))
        words = [m.group().encode() for m in counter.cut.finditer(text)]
        for w in words:
            assert bpe.merge(w, ranks) == (plain_merge(w, ranks) if w not in ranks else [w])
        assert counter.text(text) == len(lib.encode_ordinary(text))
    few = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300}
    assert bpe.merge(b"abcabbc", few) == plain_merge(b"abcabbc", few) == [b"abc", b"ab", b"bc"]
    texts = ["hello world", "def f(x):\n    return x + 1\n", "", None, "x" * 5000, "<|endoftext|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(bpe.bpe_token_count(spark, "t", RANKS)).collect()] == [len(lib.encode_ordinary(t)) if t else 0 for t in texts]


def test_bpe_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 5000)
    counter = bpe.Counter({bytes([i]): i for i in range(256)}, bpe.CL100K_PATTERN)
    assert sum(counter.text(f"w{i}x") for i in range(2000)) > 0 and len(counter.new) + len(counter.old) < 200
    assert counter.text("y" * 1000) == 1000 and all(len(w) <= bpe.MEMO_WORD for w in counter.new)


def test_bpe_query_over_the_given_table(spark):
    import tiktoken
    from trellis.plans import registry
    from trellis.plans.corpus_views import code_corpus
    lib = tiktoken.Encoding("x", pat_str=bpe.CL100K_PATTERN, mergeable_ranks=bpe.read_ranks(spark, RANKS), special_tokens={})
    got = {r.file_id: r.tokens for r in registry.all_queries()["bpe_tokens"](spark, SF001).collect()}
    texts = {r.file_id: r.content for r in code_corpus(spark, SF001).files.select("file_id", "content").collect()}
    assert got == {i: len(lib.encode_ordinary(t or "")) for i, t in texts.items()}
