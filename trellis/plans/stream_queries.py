"""Streaming queries, replayed to completion with ``trigger(availableNow=True)``.

Each call publishes the corpus events into a fresh run folder under the
shared checkpoint location, drains the stream, and returns the sink as a
DataFrame. The result must equal the batch form of the same operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import barrier
from trellis.plans.corpus_views import code_corpus, file_level
from trellis.plans.oracle_base import with_vc
from trellis.plans.ops_queries import AS_OF_MS, _json_commands_sql, command_bodies
from trellis.plans.registry import register
from trellis.plans.summary_queries import fresh_entities, skip_fresh_sql
from trellis.plans.state_queries import LOG_SQL, PAIRS_SQL, status_log, with_failures
from trellis.sources.tables import read_table
from trellis.sources import record_log
from trellis.streaming import barrier_stream, batching, command_stream, metrics_stream, request_stream, skip_stream, status_stream
from trellis.session import path_exists
from trellis.streaming.topics import drain, publish, release, run_folder, state_stores, subscribe


def barrier_run(spark, run, topics, packages, modules, projects, files, levels, unit_files=barrier_stream.UNIT_FILES, max_files=None):
    """The barrier stream of one run over its topics, drained; the sink's folder.

    The sides made of the files are written once to the run folder (a lineage cut in shared storage) instead
    of being recomputed in every micro-batch; a resumed run finds them there.
    """
    def kept(name, build):
        path = f"{run}/static/{name}"
        if not path_exists(spark, path):
            build().write.parquet(path)
        return spark.read.parquet(path)
    dirs = kept("directories", lambda: barrier_stream.directories(files, unit_files))
    units = kept("units", lambda: barrier_stream.open_units(files, dirs))
    waiting = kept("waiting", lambda: barrier_stream.expected(units, packages, modules, projects, levels))
    with state_stores(spark):
        read = lambda name, schema: subscribe(spark, f"{topics}/{name}", schema, max_files)
        drain(barrier_stream.barrier_stream(
            read("file_analyzed", barrier_stream.FILE_EVENT), read("summary_stored", barrier_stream.SUMMARY_EVENT), read("announced", barrier_stream.ANNOUNCEMENT),
            dirs, units, packages, waiting, f"{run}/sink/ready", f"{run}/checkpoints/ready", levels))
    return f"{run}/sink/ready"


#: Fixture: an empty module in the first project, and a project that has no module.
EMPTY_MODULE, EMPTY_PROJECT = "module without files", "project without modules"


def _run_barrier(spark, sf_dir, levels):
    c = code_corpus(spark, sf_dir)
    run = run_folder(spark, "barrier")
    scan = F.lit(f"scan:{sf_dir}").alias("scan_id")  # one scan of the corpus per run
    files = c.files.select(scan, "file_id", "project_id", "module_id", "dir", "analysed")
    here = files.where("analysed").select("scan_id", F.col("file_id").cast("long").alias("file_id"), "project_id", "module_id", "dir")
    # per package: an event that the scan doesn't know (another directory, an id without a file) and events without a key
    nobody = (F.xxhash64("package_id") % 1_000_000 - 2_000_000).alias("file_id")
    known = c.packages.select(scan, nobody, "project_id", "module_id", "dir")
    noise = known.unionByName(known.withColumn("dir", F.concat(F.lit("elsewhere/"), F.col("dir"))))
    noise = noise.unionByName(known.withColumn("module_id", F.lit(None).cast("string"))).unionByName(known.withColumn("file_id", F.lit(None).cast("bigint")))
    publish(here.unionByName(noise.coalesce(2)), f"{run}/topics/file_analyzed")
    packages, modules = with_failures(c.packages, c.modules)
    first = c.projects.agg(F.min("project_id").alias("project_id"))
    modules = modules.select("module_id", "project_id", "analysis").unionByName(
        first.select(F.lit(EMPTY_MODULE).alias("module_id"), "project_id", F.lit("empty").alias("analysis")))
    projects = c.projects.select("project_id").unionByName(spark.createDataFrame([(EMPTY_PROJECT,)], "project_id string"))
    done = (packages.where(F.col("parent_package_id").isNull() & F.col("analysis").isNotNull())
            .select(scan, F.lit("package").alias("level"), F.col("package_id").alias("entity_id"), F.col("module_id").alias("parent_id"))
            .unionByName(modules.where(F.coalesce("analysis", F.lit("")) != "").select(
                scan, F.lit("module").alias("level"), F.col("module_id").alias("entity_id"), F.col("project_id").alias("parent_id"))))
    publish(done, f"{run}/topics/summary_stored")
    publish(packages.select(scan, F.lit("package").alias("level"), F.col("package_id").alias("entity_id"))
            .unionByName(modules.select(scan, F.lit("module").alias("level"), F.col("module_id").alias("entity_id")))
            .unionByName(projects.select(scan, F.lit("project").alias("level"), F.col("project_id").alias("entity_id"))), f"{run}/topics/announced")
    sink = barrier_run(spark, run, f"{run}/topics", c.packages.select(scan, "*"), modules.select(scan, "module_id", "project_id"),
                       projects.select(scan, "project_id"), files, levels)
    release(spark, run)
    return c, barrier_stream.ready_keys(spark, sink)


@register("stream_package_ready", lambda: with_vc(PAIRS_SQL + """
SELECT package_id, module_id, subtree_files, done_files, true AS ready FROM pr WHERE done_files = subtree_files"""))
def stream_package_ready(spark, sf_dir):
    """Package barrier as a stream of file-analysed and discovery events (stateful, built-in state)."""
    c, ready = _run_barrier(spark, sf_dir, ("package",))
    return (ready.join(c.packages.select(F.col("package_id").alias("entity_id"), "module_id"), "entity_id")
            .select(F.col("entity_id").alias("package_id"), "module_id", F.col("n_files").alias("subtree_files"),
                    F.col("n_files").alias("done_files"), F.lit(True).alias("ready")))


@register("stream_levels_ready", lambda: with_vc(PAIRS_SQL + """
SELECT 'package' AS level, package_id AS entity_id, subtree_files AS expected, 0 AS parts FROM pr
  WHERE done_files = subtree_files
UNION ALL SELECT 'module', module_id, n_files, n_roots FROM mr WHERE ready
UNION ALL SELECT 'project', project_id, n_files, n_modules + extra FROM (
  SELECT *, (project_id = min(project_id) OVER ())::BIGINT AS extra FROM jr) WHERE ready
UNION ALL VALUES ('module', 'module without files', 0, 0), ('project', 'project without modules', 0, 0)"""))
def stream_levels_ready(spark, sf_dir):
    """Package, module and project barriers from files, summaries and announcements; the scan also has a module
    without files and a project without modules, which open too."""
    _, ready = _run_barrier(spark, sf_dir, barrier_stream.LEVELS)
    return ready.select("level", "entity_id", F.col("n_files").alias("expected"), F.col("n_parts").alias("parts"))


def _run_metrics(spark, sf_dir, levels):
    c = code_corpus(spark, sf_dir)
    run = run_folder(spark, "metrics")
    ev = file_level(c.text_files).select(
        F.col("file_id").cast("long"), "package_id", "module_id", "project_id",
        F.col("lines_of_code").cast("long"), F.col("code_token_count").cast("long"),
        F.col("analysis_token_count").cast("long"))
    publish(ev, f"{run}/topics/module_file_scanned")
    with state_stores(spark):
        q = metrics_stream.metrics_stream(
            subscribe(spark, f"{run}/topics/module_file_scanned", metrics_stream.FILE_SCANNED),
            f"{run}/out", f"{run}/checkpoints/metrics", levels)
        drain(q)
    release(spark, run)
    return c, metrics_stream.latest_metrics(spark, f"{run}/out")


@register("stream_metrics", lambda: with_vc("SELECT * FROM pm", metrics=True))
def stream_metrics(spark, sf_dir):
    """Package metrics maintained by a stream (update mode, fan-out sink); newest snapshot = batch metrics."""
    c, latest = _run_metrics(spark, sf_dir, ("package",))
    latest = latest.withColumnRenamed("entity_id", "package_id")
    own = c.packages.select("package_id", "module_id", "project_id",
                            F.coalesce("analysis_token_count", F.lit(0)).cast("bigint")
                            .alias("package_analysis_token_count"))
    z = lambda col: F.coalesce(F.col(col), F.lit(0)).cast("bigint")
    return (own.join(latest, "package_id", "left")
            .select("package_id", "module_id", "project_id", z("file_count").alias("file_count"),
                    z("lines_of_code").alias("lines_of_code"), "package_analysis_token_count",
                    (F.col("package_analysis_token_count") + z("files_analysis_token_count"))
                    .alias("combined_analysis_token_count"),
                    z("code_token_count").alias("code_token_count")))


@register("stream_level_metrics", lambda: with_vc("""
SELECT 'module' AS level, module_id AS entity_id, count(*) AS file_count, sum(lines_of_code)::BIGINT AS lines_of_code,
  sum(analysis_token_count)::BIGINT AS files_analysis_token_count, sum(code_token_count)::BIGINT AS code_token_count FROM vc GROUP BY module_id
UNION ALL SELECT 'project', project_id, count(*), sum(lines_of_code)::BIGINT, sum(analysis_token_count)::BIGINT,
  sum(code_token_count)::BIGINT FROM vc GROUP BY project_id"""))
def stream_level_metrics(spark, sf_dir):
    """Module and project metrics maintained by the same stream."""
    return _run_metrics(spark, sf_dir, ("module", "project"))[1]


@register("stream_status_feed", LOG_SQL + """
SELECT l.import_id, l.seq, l.status, l.progress FROM log l
LEFT JOIN (SELECT import_id, min((ts, seq)) AS stop FROM log WHERE status IN ('completed', 'failed')
           GROUP BY 1) t ON t.import_id = l.import_id
WHERE t.stop IS NULL OR (l.ts, l.seq) <= t.stop""")
def stream_status_feed(spark, sf_dir):
    """Import status feed as a stream in any arrival order, cut after each import's first terminal state."""
    run = run_folder(spark, "status_feed")
    log = status_log(spark, sf_dir).select("import_id", "seq", "ts", "status", "progress")
    publish(log, f"{run}/topics/status")
    with state_stores(spark):
        updates = subscribe(spark, f"{run}/topics/status", log.schema)
        drain(status_stream.feed_stream(updates, f"{run}/sink/feed", f"{run}/checkpoints/feed"))
        drain(status_stream.stop_stream(updates, f"{run}/sink/stops", f"{run}/checkpoints/stops"))
    release(spark, run)
    return status_stream.read_feed(spark, f"{run}/sink/feed", f"{run}/sink/stops").select("import_id", "seq", "status", "progress")


@register("stream_json_commands", _json_commands_sql)
def stream_json_commands(spark, sf_dir):
    """Import commands as a stream: parse, route bad rows aside, resolve replays on read."""
    run = run_folder(spark, "commands")
    events = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    bodies = command_bodies(spark, sf_dir).join(events, "event_id")
    publish(bodies, f"{run}/topics/commands")
    q = command_stream.command_stream(subscribe(spark, f"{run}/topics/commands", bodies.schema), AS_OF_MS,
                                      f"{run}/sink/good", f"{run}/sink/quarantine", f"{run}/checkpoints/commands")
    drain(q)
    release(spark, run)
    return (command_stream.read_routed(spark, f"{run}/sink/good", f"{run}/sink/quarantine")
            .select("event_id", "cmd_project_name", "cmd_github_url", "cmd_project_context",
                    "cmd_import_id", "cmd_ts_ms", "reason", "status"))


@register("stream_project_requests", lambda: with_vc(PAIRS_SQL + """,
asked AS (
  SELECT module_id, 'barrier' AS origin FROM mr WHERE ready
  UNION ALL SELECT CASE WHEN c_custkey % 5 = 0 THEN 'no-such-module' ELSE p.lang || '/src' || cast(c_custkey % 20 AS varchar) END, 'command'
  FROM customer JOIN (SELECT DISTINCT lang FROM documents WHERE lang IN ('de', 'en')) p ON true)
SELECT m.project_id, count(DISTINCT m.module_id) AS n_modules, count(DISTINCT CASE WHEN origin = 'command' THEN m.module_id END) AS n_commanded
FROM asked a JOIN vmod m ON m.module_id = a.module_id GROUP BY 1"""))
def stream_project_requests(spark, sf_dir):
    """Project analysis requests from two merged streams (opened module barriers, direct commands),
    enriched module → project by a stream-static join; unknown modules are set aside."""
    c = code_corpus(spark, sf_dir)
    run = run_folder(spark, "requests")
    pk, md = with_failures(c.packages, c.modules)
    ready = barrier.module_ready(c.files.select("module_id", "analysed"), pk, md).where("ready").select("module_id")
    publish(ready, f"{run}/topics/module_ready")
    k = F.col("c_custkey")
    cmd = read_table(spark, sf_dir, "customer").select(F.explode(F.array(F.lit("de"), F.lit("en"))).alias("lang"), "c_custkey").select(
        F.when(k % 5 == 0, F.lit("no-such-module")).otherwise(F.concat("lang", F.lit("/src"), (k % 20).cast("string"))).alias("module_id"))
    publish(cmd, f"{run}/topics/commands")
    drain(request_stream.request_stream(
        subscribe(spark, f"{run}/topics/module_ready", request_stream.MODULE_EVENT),
        subscribe(spark, f"{run}/topics/commands", request_stream.MODULE_EVENT),
        c.modules, f"{run}/sink/requests", f"{run}/checkpoints/requests"))
    release(spark, run)
    return request_stream.project_requests(spark, f"{run}/sink/requests")


def _skip_stream_sql() -> str:
    return f"""WITH decided AS ({skip_fresh_sql()})
SELECT level, entity_id, CASE WHEN fresh THEN 'analyzed' ELSE 'analyze' END AS topic FROM decided WHERE NOT fresh OR level = 'file'
UNION ALL VALUES ('package', 'unknown package', 'analyze')"""


@register("stream_skip_fresh", _skip_stream_sql)
def stream_skip_fresh(spark, sf_dir):
    """What the analysis stages are asked for by a stream of entity events, each sent twice: fresh files still
    tell that they are analysed, fresh entities of other levels tell nothing."""
    run = run_folder(spark, "skip")
    state = fresh_entities(spark, sf_dir)
    state.where("fresh").select("level", "entity_id").write.parquet(f"{run}/static/fresh")
    events = state.select("level", "entity_id").unionByName(spark.createDataFrame([("package", "unknown package")], skip_stream.LEVEL_EVENT))
    publish(events.unionByName(events), f"{run}/topics/entities")
    with state_stores(spark):
        drain(skip_stream.skip_stream(subscribe(spark, f"{run}/topics/entities", skip_stream.LEVEL_EVENT), spark.read.parquet(f"{run}/static/fresh"),
                                      f"{run}/sink/skip", f"{run}/checkpoints/skip"))
    release(spark, run)
    return spark.read.parquet(f"{run}/sink/skip").select("level", "entity_id", F.col("topic").cast("string").alias("topic"))


#: Fixture: consumers of the batch stream, and the wait of a batch (events come about this far apart).
SHARDS, BATCH_WAIT_S = 16, 24 * 3600


@register("stream_batches", f"""
WITH RECURSIVE e AS (SELECT event_id, user_id % {SHARDS} AS shard, ts::TIMESTAMP AS ts FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ts, event_id) AS k,
        count(*) OVER (PARTITION BY shard ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '{BATCH_WAIT_S * 1000000 - 1} microseconds' FOLLOWING) AS within
      FROM e),
b AS (SELECT shard, 0::BIGINT AS batch_no, k AS first, least(k + {batching.EVENTS[0]}, within + 1) AS after,
        CASE WHEN within + 1 < k + {batching.EVENTS[0]} THEN 'time' ELSE 'count' END AS closed_by FROM r WHERE k = 1
      UNION ALL
      SELECT b.shard, b.batch_no + 1, r.k, least(r.k + {batching.EVENTS[0]}, r.within + 1),
        CASE WHEN r.within + 1 < r.k + {batching.EVENTS[0]} THEN 'time' ELSE 'count' END
      FROM b JOIN r ON r.shard = b.shard AND r.k = b.after)
SELECT b.shard, b.batch_no, b.closed_by, count(*) AS n, sum(r.event_id)::BIGINT AS event_ids
FROM b JOIN r ON r.shard = b.shard AND r.k >= b.first AND r.k < b.after GROUP BY 1, 2, 3""")
def stream_batches(spark, sf_dir):
    """Count-or-time batches per consumer as a stream: 20 rows or a day after the first, whichever is first."""
    run = run_folder(spark, "batches")
    ts = F.col("ts").cast("timestamp")
    e = read_table(spark, sf_dir, "events").select((F.col("user_id") % SHARDS).alias("shard"), ts.alias("ts"), "event_id")
    beat = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("shard"), (F.col("ts") + F.expr(f"INTERVAL {10 * BATCH_WAIT_S} SECONDS")).alias("ts"),
                                                 F.lit(None).cast("bigint").alias("event_id"))
    e = e.select(F.col("shard").cast("bigint").alias("shard"), "ts", F.col("event_id").cast("bigint").alias("event_id"))
    publish(e.unionByName(beat), f"{run}/topics/events")  # the last row moves the watermark on, which closes the open batches
    with state_stores(spark):
        drain(batching.batch_stream(subscribe(spark, f"{run}/topics/events", e.schema, 1_000_000), "shard", batching.EVENTS[0], BATCH_WAIT_S,
                                    f"{run}/sink/batches", f"{run}/checkpoints/batches", "ts"))
    release(spark, run)
    return (spark.read.parquet(f"{run}/sink/batches").groupBy("shard", "batch_no", "closed_by")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("event_ids")))


@register("stream_record_log", """
SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS event_ids, count(DISTINCT event_type) AS n_types, max(epoch_us(ts::TIMESTAMP))::BIGINT AS last_us, false AS broken
FROM events GROUP BY user_id
UNION ALL SELECT NULL, (SELECT count(*) FROM region) * 2, NULL, 0, NULL, true""")
def stream_record_log(spark, sf_dir):
    """Typed events from record logs by byte offsets (small ranges, so that records cross them); broken records set aside."""
    run = run_folder(spark, "log")
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    record_log.append_records(e, f"{run}/topics/log")
    r = F.col("r_regionkey").cast("string")
    broken = read_table(spark, sf_dir, "region").select(F.explode(F.array(F.concat(F.lit('{"event_id": "no number ') , r, F.lit('"}')), F.concat(F.lit("no record "), r))).alias("value"))
    broken.write.mode("append").text(f"{run}/topics/log")
    raw = record_log.stream_records(spark, f"{run}/topics/log", range_bytes=1 << 16, group="counts")
    out = record_log.typed(raw, e.schema, ("event_id",))
    drain(out.writeStream.outputMode("append").format("parquet").option("path", f"{run}/sink/log").option("checkpointLocation", f"{run}/checkpoints/log")
          .trigger(availableNow=True).start())
    release(spark, run)
    got = spark.read.parquet(f"{run}/sink/log").withColumn("broken", F.col("reason").isNotNull())
    return (got.groupBy(F.when(~F.col("broken"), F.col("user_id")).alias("user_id"), "broken")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("broken"), F.col("event_id"))).alias("event_ids"),
                 F.countDistinct(F.when(~F.col("broken"), F.col("event_type"))).alias("n_types"), F.max(F.when(~F.col("broken"), F.unix_micros("ts"))).alias("last_us")))
