"""Properties: template fill = chained str.replace; barrier replay-safety; stream = batch."""

import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trellis.functions.text import fill_template
from trellis.operators import barrier
from trellis.plans.corpus_views import code_corpus
from trellis.streaming import barrier_stream
from trellis.plans.stream_queries import barrier_run
from trellis.streaming.topics import drain, publish, read_batches, release, run_folder, state_stores, subscribe, write_batch

from trellis.session import path_exists

from conftest import SF001

ALPHABET = string.ascii_letters + "{}ab "
PLACEHOLDERS = ["{a}", "{b}", "{ab}"]


@settings(max_examples=25, deadline=None)
@given(template=st.text(alphabet=ALPHABET, max_size=30),
       values=st.lists(st.text(alphabet=ALPHABET, max_size=8), min_size=3, max_size=3))
def test_fill_template_equals_python_replace(spark, template, values):
    df = spark.createDataFrame([tuple(values)], "v0 string, v1 string, v2 string")
    pairs = [(PLACEHOLDERS[i], F.col(f"v{i}")) for i in range(3)]
    got = df.select(fill_template(F.lit(template), pairs)).first()[0]
    want = template
    for i, p in enumerate(PLACEHOLDERS):
        want = want.replace(p, values[i])
    assert got == want


def _scan(c, scan):
    return c.files.select(F.lit(scan).alias("scan_id"), "file_id", "project_id", "module_id", "dir", "analysed")


def _run(spark, c, files, events, discovered, batches=1, unit_files=2, max_files=None):
    """The package barrier over ``events`` published as several files; with ``batches`` > 1 it is stopped and resumed."""
    run = run_folder(spark, "prop")
    scans = files.select("scan_id").distinct()
    add = lambda df: df.join(F.broadcast(scans))
    publish(spark.createDataFrame([], barrier_stream.SUMMARY_EVENT), f"{run}/topics/summary_stored")
    publish(discovered.select("scan_id", F.lit("package").alias("level"), F.col("package_id").alias("entity_id")), f"{run}/topics/announced")
    for b in range(batches):
        publish(events.where(F.coalesce(F.col("file_id"), F.lit(0)) % batches == b).repartition(3), f"{run}/topics/file_analyzed")
        sink = barrier_run(spark, run, f"{run}/topics", add(c.packages), add(c.modules), add(c.projects), files, ("package",), unit_files, max_files)
    keys = [(r.scan_id, r.entity_id) for r in barrier_stream.ready_keys(spark, sink).collect()]
    assert len(keys) == len(set(keys))
    state = lambda operator, name: (spark.read.format("statestore").option("path", f"{run}/checkpoints/ready").option("operatorId", operator)
                                    .option("stateVarName", name).load().count())
    left = (state(1, "open"), state(0, "todo"))
    release(spark, run)
    assert not path_exists(spark, f"{run}/topics") and path_exists(spark, f"{run}/sink")
    return set(keys), left


def _events(files):
    return files.select("scan_id", F.col("file_id").cast("long").alias("file_id"), "project_id", "module_id", "dir")


def test_barrier_stream_equals_batch_under_replay_restart_and_missing_keys(spark):
    c = code_corpus(spark, SF001)
    files = _scan(c, "s1")
    ev = _events(files.where("analysed"))
    disc = c.packages.select(F.lit("s1").alias("scan_id"), "package_id")
    batch = {("s1", r.package_id) for r in barrier.package_ready(
        c.files.select("module_id", "dir", "analysed"), c.packages).where("ready").collect()}
    keyless = ev.limit(3).withColumn("file_id", F.lit(None).cast("long"))
    unknown = ev.withColumn("file_id", F.col("file_id") + 1_000_000).unionByName(ev.withColumn("dir", F.lit("nowhere")))
    got, (units, waiting) = _run(spark, c, files, ev, disc)
    assert got == batch and 0 < len(batch) < c.packages.count()
    assert waiting == c.packages.count() - len(batch)  # the state holds what is open, and nothing else
    n_open = files.where("NOT analysed").count()
    assert 0 < units <= n_open
    one = sorted(batch)[0][1]  # is never announced
    got, left = _run(spark, c, files, ev.unionByName(ev).unionByName(keyless).unionByName(unknown), disc.where(F.col("package_id") != one), batches=2, unit_files=50)
    assert got == batch - {("s1", one)} and left[1] == waiting + 1
    everything, left = _run(spark, c, files, _events(files), disc, unit_files=1000)
    assert everything == {("s1", r.package_id) for r in c.packages.collect()} and left == (0, 0)


def test_rescan_opens_new_barriers(spark):
    c = code_corpus(spark, SF001)
    files = _scan(c, "s1").unionByName(_scan(c, "s2"))
    ev = _events(files.where("analysed"))
    disc = files.select("scan_id").distinct().join(c.packages.select("package_id"))
    batch = {r.package_id for r in barrier.package_ready(
        c.files.select("module_id", "dir", "analysed"), c.packages).where("ready").collect()}
    assert _run(spark, c, files, ev, disc)[0] == {(s, p) for s in ("s1", "s2") for p in batch}


def test_empty_module_and_project_open_with_their_announcement(spark):
    run = run_folder(spark, "empty")
    frame = spark.createDataFrame
    packages = frame([], "scan_id string, package_id string, module_id string, dir string, parent_package_id string")
    modules = frame([("s", "m", "p")], "scan_id string, module_id string, project_id string")
    projects = frame([("s", "p"), ("s", "q"), ("s", "silent")], "scan_id string, project_id string")
    files = frame([], "scan_id string, file_id long, project_id string, module_id string, dir string")
    publish(_events(files), f"{run}/topics/file_analyzed")
    publish(frame([], barrier_stream.SUMMARY_EVENT), f"{run}/topics/summary_stored")
    publish(frame([("s", "module", "m"), ("s", "project", "p"), ("s", "project", "q"), ("s", "project", "unknown")], barrier_stream.ANNOUNCEMENT), f"{run}/topics/announced")
    go = lambda: {(r.level, r.entity_id) for r in barrier_stream.ready_keys(spark, barrier_run(
        spark, run, f"{run}/topics", packages, modules, projects, files, barrier_stream.LEVELS)).collect()}
    assert go() == {("module", "m"), ("project", "q")}
    publish(frame([("s", "module", "m", "p")] * 2, barrier_stream.SUMMARY_EVENT), f"{run}/topics/summary_stored")
    assert go() == {("module", "m"), ("project", "q"), ("project", "p")}


def test_metrics_dedup_state_is_released(spark):
    """Replays within the window count once; after it the dedup state is gone."""
    import time
    from trellis.streaming import metrics_stream
    run = run_folder(spark, "metrics")
    rows = [(i, "p", "m", "j", 10, 1, 1) for i in range(50)]
    def go(rows):
        publish(spark.createDataFrame(rows, metrics_stream.FILE_SCANNED).coalesce(1), f"{run}/topics")
        with state_stores(spark):
            q = metrics_stream.metrics_stream(subscribe(spark, f"{run}/topics", metrics_stream.FILE_SCANNED), f"{run}/out", f"{run}/ck", replay_window="2 seconds")
            drain(q)
        return q.lastProgress["stateOperators"]
    go(rows + rows[:20])
    go(rows[:20])
    got = metrics_stream.latest_metrics(spark, f"{run}/out").collect()
    assert {(r.level, r.file_count, r.lines_of_code) for r in got} == {(x, 50, 500) for x in ("package", "module", "project")}
    time.sleep(4)
    go([(99, "p", "m", "j", 1, 1, 1)])
    time.sleep(3)
    state = go([(100, "p", "m", "j", 1, 1, 1)])
    dedup = [s for s in state if "dedupe" in s["operatorName"].lower()]
    assert dedup and dedup[0]["numRowsTotal"] < 50


def test_a_repeated_batch_replaces_its_folder(spark):
    run = run_folder(spark, "again")
    write_batch(spark.range(5), f"{run}/out", 0)
    write_batch(spark.range(5, 9), f"{run}/out", 1)
    write_batch(spark.range(5, 9), f"{run}/out", 1)  # the write was done, the commit was not
    assert sorted(r.id for r in read_batches(spark, f"{run}/out").collect()) == list(range(9))


def test_a_failed_barrier_batch_is_replayed_once(spark):
    """A stream that fails after its sink was written, before the commit, writes nothing twice."""
    from trellis.streaming import command_stream
    import datetime as dt
    run = run_folder(spark, "crash")
    body = '{{"project_name": "p{0}", "github_url": "https://github.com/u/r{0}", "import_id": "i{0}"}}'
    rows = [(i, dt.datetime(2024, 1, 1), body.format(i)) for i in range(6)] + [(9, dt.datetime(2024, 1, 1), "broken")]
    schema = "event_id long, ts timestamp, body string"
    publish(spark.createDataFrame(rows, schema).coalesce(1), f"{run}/topics")
    lines = lambda: subscribe(spark, f"{run}/topics", spark.createDataFrame([], schema).schema, 1)
    real = command_stream.write_batch
    def crash(df, path, batch_id, *more):
        real(df, path, batch_id, *more)
        if path.endswith("bad"):
            raise RuntimeError("lost after the write")
    command_stream.write_batch = crash
    try:
        with pytest.raises(Exception, match="lost after the write"):
            drain(command_stream.command_stream(lines(), 0, f"{run}/good", f"{run}/bad", f"{run}/ck"))
    finally:
        command_stream.write_batch = real
    assert read_batches(spark, f"{run}/good").count() == 6
    drain(command_stream.command_stream(lines(), 0, f"{run}/good", f"{run}/bad", f"{run}/ck"))
    assert read_batches(spark, f"{run}/good").count() == 6 and read_batches(spark, f"{run}/bad").count() == 1


def test_status_feed_in_any_arrival_order(spark):
    from trellis.streaming import status_stream
    rows = [("a", 1, 1, "pending"), ("a", 2, 2, "failed"), ("a", 3, 3, "completed"), ("b", 4, 1, "pending"), (None, 5, 1, "failed")]
    schema = "import_id string, seq long, ts long, status string"
    run = run_folder(spark, "feed")
    for r in reversed(rows):  # the latest update arrives first, each in its own file and run
        publish(spark.createDataFrame([r], schema).coalesce(1), f"{run}/topics")
        up = subscribe(spark, f"{run}/topics", spark.createDataFrame([], schema).schema, 1)
        drain(status_stream.feed_stream(up, f"{run}/feed", f"{run}/c1"))
        drain(status_stream.stop_stream(up, f"{run}/stops", f"{run}/c2"))
    got = sorted((r.import_id, r.seq) for r in status_stream.read_feed(spark, f"{run}/feed", f"{run}/stops").collect())
    assert got == [("a", 1), ("a", 2), ("b", 4)]


def test_late_commands_are_kept(spark):
    from trellis.streaming import command_stream
    run = run_folder(spark, "late")
    body = '{{"project_name": "p{0}", "github_url": "https://github.com/u/r{0}", "import_id": "i{0}"}}'
    schema = "event_id long, ts timestamp, body string"
    import datetime as dt
    for day, ids in ((20, [1, 2]), (1, [3, 1])):  # the second file is 19 days older; event 1 is replayed
        rows = [(i + (10 if day == 1 and i == 1 else 0), dt.datetime(2024, 1, day), body.format(i)) for i in ids]
        publish(spark.createDataFrame(rows, schema).coalesce(1), f"{run}/topics")
        lines = subscribe(spark, f"{run}/topics", spark.createDataFrame([], schema).schema, 1)
        drain(command_stream.command_stream(lines, 0, f"{run}/good", f"{run}/bad", f"{run}/ck"))
    out = command_stream.read_routed(spark, f"{run}/good", f"{run}/bad")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3]
    assert command_stream.read_routed(spark, f"{run}/nothing", f"{run}/none") is None


def test_release_runs(spark):
    from trellis.streaming.topics import release_runs
    run = run_folder(spark, "gone")
    publish(spark.range(3), f"{run}/topics")
    release_runs(spark)
    assert not path_exists(spark, run)
