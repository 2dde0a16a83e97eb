"""Readiness barriers (batch form) and import-status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import barrier, snapshots, status
from trellis.plans.corpus_views import code_corpus
from trellis.operators.ordered_text import ordinals
from trellis.plans.oracle_base import q, with_vc
from trellis.plans.registry import register
from trellis.sources.tables import read_table

# Fixture: the summaries of some packages (NULL) and modules ('') failed, by a digit of their id's md5.
def with_failures(packages, modules):
    digit = lambda c, at: F.conv(F.substring(F.md5(c), at, 1), 16, 10).cast("int")
    return (packages.withColumn("analysis", F.when(digit("package_id", 6) % 8 != 0, F.col("analysis"))),
            modules.withColumn("analysis", F.when(digit("module_id", 6) % 8 == 0, F.lit("")).otherwise(F.col("analysis"))))


PAIRS_SQL = """,
fpk AS (SELECT * REPLACE (CASE WHEN (instr('0123456789abcdef', substr(md5(package_id), 6, 1)) - 1) % 8 <> 0 THEN analysis END AS analysis) FROM vpk),
fmod AS (SELECT * REPLACE (CASE WHEN (instr('0123456789abcdef', substr(md5(module_id), 6, 1)) - 1) % 8 = 0 THEN '' ELSE analysis END AS analysis) FROM vmod),
pairs AS (SELECT p.package_id, f.file_id, f.analysed AS done
  FROM vc f JOIN vpk p ON p.module_id = f.module_id AND (f.dir = p.dir OR starts_with(f.dir, p.dir || '/'))),
pr AS (SELECT p.package_id, p.module_id, coalesce(a.n, 0)::BIGINT AS subtree_files,
         coalesce(a.d, 0)::BIGINT AS done_files
       FROM vpk p LEFT JOIN (SELECT package_id, count(*) AS n, count(*) FILTER (WHERE done) AS d
                             FROM pairs GROUP BY 1) a ON a.package_id = p.package_id),
mr0 AS (SELECT m.module_id, m.project_id, coalesce(a.n, 0)::BIGINT AS n_files, coalesce(a.d, 0)::BIGINT AS done_files,
          coalesce(r.n, 0)::BIGINT AS n_roots, coalesce(r.d, 0)::BIGINT AS done_roots
       FROM vmod m LEFT JOIN (SELECT module_id, count(*) AS n, count(*) FILTER (WHERE analysed) AS d FROM vc GROUP BY 1) a USING (module_id)
       LEFT JOIN (SELECT module_id, count(*) AS n, count(analysis) AS d FROM fpk WHERE parent_package_id IS NULL GROUP BY 1) r USING (module_id)),
mr AS (SELECT *, n_files = done_files AND n_roots = done_roots AS ready FROM mr0),
jr0 AS (SELECT p.project_id, coalesce(a.n, 0)::BIGINT AS n_files, coalesce(a.d, 0)::BIGINT AS done_files,
          coalesce(r.n, 0)::BIGINT AS n_modules, coalesce(r.d, 0)::BIGINT AS done_modules
       FROM vproj p LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE analysed) AS d FROM vc GROUP BY 1) a USING (project_id)
       LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE coalesce(analysis, '') <> '') AS d FROM fmod GROUP BY 1) r USING (project_id)),
jr AS (SELECT *, n_files = done_files AND n_modules = done_modules AS ready FROM jr0)
"""


def _vc_state(body: str) -> str:
    return with_vc(PAIRS_SQL + body)


@register("package_ready", lambda: _vc_state(
    "SELECT *, done_files = subtree_files AS ready FROM pr"))
def package_ready(spark, sf_dir):
    """Package barrier: every file in the package's subtree has been analysed."""
    c = code_corpus(spark, sf_dir)
    return barrier.package_ready(c.files.select("module_id", "dir", "analysed"), c.packages)


@register("module_ready", lambda: _vc_state("SELECT * FROM mr"))
def module_ready(spark, sf_dir):
    """Module barrier: every file under the module is analysed, every root package has its summary."""
    c = code_corpus(spark, sf_dir)
    pk, md = with_failures(c.packages, c.modules)
    return barrier.module_ready(c.files.select("module_id", "analysed"), pk, md)


@register("project_ready", lambda: _vc_state("SELECT * FROM jr"))
def project_ready(spark, sf_dir):
    """Project barrier: every file is analysed and every module has a non-empty summary."""
    c = code_corpus(spark, sf_dir)
    pk, md = with_failures(c.packages, c.modules)
    return barrier.project_ready(c.files.select("project_id", "analysed"), md, c.projects)


@register("open_children", lambda: with_vc("""
SELECT p.package_id, coalesce(a.n, 0)::BIGINT AS open_children
FROM vpk p LEFT JOIN (SELECT parent_package_id AS package_id,
                             count(*) FILTER (WHERE analysis IS NULL) AS n
                      FROM (SELECT parent_package_id,
                              CASE WHEN (instr('0123456789abcdef', substr(md5(package_id), 5, 1)) - 1) % 3 = 0
                                   THEN NULL ELSE analysis END AS analysis
                            FROM vpk WHERE parent_package_id IS NOT NULL) t GROUP BY 1) a
ON a.package_id = p.package_id"""))
def open_children(spark, sf_dir):
    """Child packages still without analysis, per parent (the barrier's conditional count)."""
    c = code_corpus(spark, sf_dir)
    gap = (F.conv(F.substring(F.md5("package_id"), 5, 1), 16, 10).cast("int") % 3) == 0
    pk = c.packages.withColumn("analysis", F.when(gap, F.lit(None).cast("string")).otherwise(F.col("analysis")))
    return barrier.unfinished_children(pk)


# ------------------------------------------------------------------ import status

PROJECT_TYPES = ["maven", "gradle", "ant", "sbt", "java"]  # detection outcomes, by user id mod 5


def status_log(spark, sf_dir):
    """Status changelog from ``events``: each user's events, in time order, walk the import
    status machine; every 10 events start a new import; an ``error`` event fails its step.

    (The walk is this fixture's mapping of 10 events to one import.) The per-user position is an exact ordinal from a global range sort
    (``ordinals``), so a very active user is not sorted in one task.
    """
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    r = ordinals(e, ["user_id"], ["ts", "event_id"])
    step = (F.col("ordinal") % len(status.STATUS_MACHINE)).cast("int")
    ptype = F.element_at(F.array(*[F.lit(t) for t in PROJECT_TYPES]), (F.col("user_id") % 5).cast("int") + 1)
    fail = F.when(F.col("event_type") == "error", F.concat(F.lit("error "), F.col("event_id").cast("string")))
    st, msg, prog, err = status.machine_step(step, ptype, fail)
    return r.select(F.concat(F.lit("imp-"), F.col("user_id").cast("string"), F.lit("-"),
                             F.floor(F.col("ordinal") / len(status.STATUS_MACHINE)).cast("string")).alias("import_id"),
                    F.col("event_id").alias("seq"), "ts", st.alias("status"), prog.cast("int").alias("progress"),
                    msg.alias("message"), err.alias("error"))


def _log_sql() -> str:
    n = len(status.STATUS_MACHINE)
    sts = ", ".join(q(x[0]) for x in status.STATUS_MACHINE)
    msgs = ", ".join(q(x[1]) for x in status.STATUS_MACHINE)
    progs = ", ".join(str(x[2]) for x in status.STATUS_MACHINE)
    types = ", ".join(q(t) for t in PROJECT_TYPES)
    return f"""
WITH o AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ordinal FROM events),
log AS (
  SELECT 'imp-' || cast(user_id AS varchar) || '-' || cast(ordinal // {n} AS varchar) AS import_id,
    event_id AS seq, ts,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE [{sts}][ordinal % {n} + 1] END AS status,
    CASE WHEN event_type = 'error' THEN 0 ELSE [{progs}][ordinal % {n} + 1] END::INT AS progress,
    CASE WHEN event_type = 'error' THEN 'Import failed: error ' || cast(event_id AS varchar)
      ELSE replace([{msgs}][ordinal % {n} + 1], '{{TYPE}}', upper([{types}][user_id % 5 + 1])) END AS message,
    CASE WHEN event_type = 'error' THEN 'error ' || cast(event_id AS varchar) END AS error
  FROM o),
latest AS (
  SELECT import_id, last(status ORDER BY ts, seq) AS status, last(message ORDER BY ts, seq) AS message,
    last(progress ORDER BY ts, seq) AS progress,
    last(error ORDER BY ts, seq) FILTER (WHERE error IS NOT NULL) AS error,
    epoch_us(min(ts)) // 1000 AS created_at_ms, epoch_us(max(ts)) // 1000 AS updated_at_ms,
    count(*)::BIGINT AS n_updates
  FROM log GROUP BY import_id)
"""


LOG_SQL = _log_sql()


def _latest(spark, sf_dir):
    s = status.latest_status(status_log(spark, sf_dir))
    return s.select("import_id", "status", "message", "progress", "error",
                    snapshots.epoch_ms("created_at").alias("created_at_ms"),
                    snapshots.epoch_ms("updated_at").alias("updated_at_ms"), "n_updates")


@register("import_status_latest", LOG_SQL + "SELECT * FROM latest")
def import_status_latest(spark, sf_dir):
    """Current state per import from the append-only status changelog."""
    return _latest(spark, sf_dir)


@register("import_status_feed", LOG_SQL + """
SELECT l.import_id, l.seq, l.status, l.progress FROM log l
LEFT JOIN (SELECT import_id, min((ts, seq)) AS stop FROM log WHERE status IN ('completed', 'failed')
           GROUP BY 1) t ON t.import_id = l.import_id
WHERE t.stop IS NULL OR (l.ts, l.seq) <= t.stop""")
def import_status_feed(spark, sf_dir):
    """Status feed per import, cut after the first terminal state."""
    return status.status_feed(status_log(spark, sf_dir)).select("import_id", "seq", "status", "progress")


@register("progress_step", LOG_SQL + """
SELECT import_id, progress, CASE WHEN progress < 20 THEN -1 WHEN progress < 50 THEN 0 WHEN progress < 80 THEN 1
  WHEN progress < 100 THEN 2 ELSE 3 END AS step FROM latest""")
def progress_step(spark, sf_dir):
    """Active UI step of each import's current progress."""
    return _latest(spark, sf_dir).select("import_id", "progress",
                                         status.progress_step("progress").alias("step"))


# The answer for an import id that does not exist.
UNKNOWN_IMPORT = ("failed", "Import not found", 0, "No import with the provided ID exists")


@register("import_status_lookup", LOG_SQL + f"""
SELECT a.import_id, coalesce(l.status, {q(UNKNOWN_IMPORT[0])}) AS status, coalesce(l.message, {q(UNKNOWN_IMPORT[1])}) AS message,
  coalesce(l.progress, {UNKNOWN_IMPORT[2]}) AS progress, CASE WHEN l.import_id IS NULL THEN {q(UNKNOWN_IMPORT[3])} ELSE l.error END AS error
FROM (SELECT DISTINCT 'imp-' || cast(c_custkey AS varchar) || '-0' AS import_id FROM customer) a
LEFT JOIN latest l ON l.import_id = a.import_id""")
def import_status_lookup(spark, sf_dir):
    """Status of asked-for imports (the first import of every customer); an unknown id gives one error row."""
    asked = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("imp-"), F.col("c_custkey").cast("string"), F.lit("-0")).alias("import_id")).distinct()
    st, msg, prog, err = UNKNOWN_IMPORT
    known = _latest(spark, sf_dir).select("import_id", "status", "message", "progress", "error", F.lit(True).alias("known"))
    return asked.join(known, "import_id", "left").select(
        "import_id", F.coalesce("status", F.lit(st)).alias("status"), F.coalesce("message", F.lit(msg)).alias("message"),
        F.coalesce("progress", F.lit(prog)).alias("progress"),
        F.when(F.col("known").isNull(), F.lit(err)).otherwise(F.col("error")).alias("error"))
