"""Read views: project list/detail over snapshot logs, module/package detail, breadcrumbs.

Snapshot logs come from ``events`` (one event = one metrics snapshot):
project = ``proj-<user_id div 10>``, module = ``mod-<user_id>``; every event
is a snapshot of both. Nations are projects and modules without any snapshot.
``file_count`` is the JSON field ``k`` through a safe integer conversion.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import paths, text
from trellis.operators import metrics, snapshots
from trellis.plans.corpus_views import code_corpus, file_level
from trellis.plans.oracle_base import with_vc
from trellis.plans.registry import register
from trellis.sources.tables import read_table

SNAP_COLS = ["snapshot_id", "ts_ms", "file_count", "lines_of_code"]
ORDER = ["ts", "snapshot_id"]


def event_snapshots(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("snapshot_id"), "ts", snapshots.epoch_ms("ts").alias("ts_ms"),
        F.concat(F.lit("proj-"), F.expr("user_id div 10").cast("string")).alias("project_id"),
        F.concat(F.lit("mod-"), F.col("user_id").cast("string")).alias("module_id"),
        "event_type", "user_id",
        text.safe_int(F.get_json_object("props", "$.k")).alias("file_count"),
        F.round(F.col("value") * 100).cast("bigint").alias("lines_of_code"))


def level_keys(spark, sf_dir, s):
    """Distinct (project_id, module_id): those with snapshots, and one per nation without."""
    n = read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("proj-n"), F.col("n_regionkey").cast("string")).alias("project_id"),
        F.concat(F.lit("mod-n"), F.col("n_nationkey").cast("string")).alias("module_id"))
    return s.select("project_id", "module_id").distinct().unionByName(n)


SNAP_SQL = """
WITH s AS (
  SELECT event_id AS snapshot_id, ts, epoch_us(ts) // 1000 AS ts_ms,
    'proj-' || cast(user_id // 10 AS varchar) AS project_id, 'mod-' || cast(user_id AS varchar) AS module_id,
    event_type, user_id,
    coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) AS file_count,
    cast(round(value * 100) AS BIGINT) AS lines_of_code
  FROM events),
lk AS (SELECT DISTINCT project_id, module_id FROM s
  UNION ALL SELECT 'proj-n' || cast(n_regionkey AS varchar), 'mod-n' || cast(n_nationkey AS varchar) FROM nation),
ml AS (SELECT module_id, snapshot_id, ts_ms, file_count, lines_of_code, n_snapshots FROM (
  SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY ts DESC, snapshot_id DESC) AS rn,
    count(*) OVER (PARTITION BY module_id) AS n_snapshots FROM s) t WHERE rn = 1),
pl AS (SELECT project_id, snapshot_id, ts_ms, file_count, lines_of_code, n_snapshots FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, snapshot_id DESC) AS rn,
    count(*) OVER (PARTITION BY project_id) AS n_snapshots FROM s) t WHERE rn = 1)
"""


@register("latest_snapshot", SNAP_SQL + "SELECT * FROM ml")
def latest_snapshot(spark, sf_dir):
    """Newest module metrics snapshot per module (ties broken by snapshot id)."""
    return snapshots.pick_per_key(event_snapshots(spark, sf_dir), ["module_id"], ORDER, SNAP_COLS)


@register("oldest_snapshot", SNAP_SQL + """
SELECT module_id, snapshot_id, ts_ms, file_count, lines_of_code, n_snapshots FROM (
  SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY ts, snapshot_id) AS rn,
    count(*) OVER (PARTITION BY module_id) AS n_snapshots FROM s) t WHERE rn = 1""")
def oldest_snapshot(spark, sf_dir):
    """First snapshot in natural (time, id) order per module."""
    return snapshots.pick_per_key(event_snapshots(spark, sf_dir), ["module_id"], ORDER,
                                  SNAP_COLS, newest=False)


@register("project_list", SNAP_SQL + """
SELECT p.project_id, coalesce(l.n_snapshots, 0)::BIGINT AS n_snapshots,
  coalesce(l.file_count, 0)::INT AS file_count, coalesce(l.lines_of_code, 0)::BIGINT AS lines_of_code,
  l.ts_ms AS latest_ts_ms
FROM (SELECT DISTINCT project_id FROM lk) p LEFT JOIN pl l ON l.project_id = p.project_id""")
def project_list(spark, sf_dir):
    """Every project with its newest metrics snapshot; zero record when it has none."""
    s = event_snapshots(spark, sf_dir)
    projects = level_keys(spark, sf_dir, s).select("project_id").distinct()
    out = snapshots.latest_left(projects, s, ["project_id"], ORDER, SNAP_COLS,
                                defaults={"n_snapshots": 0, "file_count": 0, "lines_of_code": 0})
    return out.select("project_id", F.col("n_snapshots").cast("bigint"),
                      F.col("file_count").cast("int"), F.col("lines_of_code").cast("bigint"),
                      F.col("ts_ms").alias("latest_ts_ms"))


@register("project_detail", SNAP_SQL + """
SELECT m.project_id, m.module_id, pl.file_count AS project_file_count, pl.ts_ms AS project_ts_ms,
  ml.file_count AS module_file_count, ml.lines_of_code AS module_lines_of_code, ml.ts_ms AS module_ts_ms
FROM lk m
LEFT JOIN pl ON pl.project_id = m.project_id LEFT JOIN ml ON ml.module_id = m.module_id""")
def project_detail(spark, sf_dir):
    """Project → its modules, each with the newest snapshot (NULL when none); flat rows."""
    s = event_snapshots(spark, sf_dir)
    mods = level_keys(spark, sf_dir, s)
    pl = snapshots.pick_per_key(s, ["project_id"], ORDER, SNAP_COLS)
    ml = snapshots.pick_per_key(s, ["module_id"], ORDER, SNAP_COLS)
    return (mods.join(pl.select("project_id", F.col("file_count").alias("project_file_count"),
                                F.col("ts_ms").alias("project_ts_ms")), "project_id", "left")
            .join(ml.select("module_id", F.col("file_count").alias("module_file_count"),
                            F.col("lines_of_code").alias("module_lines_of_code"),
                            F.col("ts_ms").alias("module_ts_ms")), "module_id", "left")
            .select("project_id", "module_id", "project_file_count", "project_ts_ms",
                    "module_file_count", "module_lines_of_code", "module_ts_ms"))


@register("module_detail", lambda: with_vc("""
SELECT m.module_id, m.module_name, p.package_id, p.package_name, pm.file_count, pm.lines_of_code,
  pm.combined_analysis_token_count
FROM vmod m LEFT JOIN vpk p ON p.module_id = m.module_id LEFT JOIN pm ON pm.package_id = p.package_id""",
    metrics=True))
def module_detail(spark, sf_dir):
    """Module ⟕ packages ⟕ package metrics (unwind keeps modules without packages)."""
    c = code_corpus(spark, sf_dir)
    pm = metrics.package_metrics(file_level(c.text_files), c.packages)
    return (c.modules.select("module_id", "module_name")
            .join(c.packages.select("module_id", "package_id", "package_name"), "module_id", "left")
            .join(pm.select("package_id", "file_count", "lines_of_code", "combined_analysis_token_count"),
                  "package_id", "left")
            .select("module_id", "module_name", "package_id", "package_name", "file_count",
                    "lines_of_code", "combined_analysis_token_count"))


@register("package_detail", lambda: with_vc("""
SELECT p.package_id, p.package_name, coalesce(p.analysis, '') AS analysis,
  coalesce(nullif(f.valid_files, 0), f.files_listed)::BIGINT AS file_count,
  f.files_listed::BIGINT AS files_listed, f.total_lines::BIGINT AS total_lines, f.first_file
FROM vpk p JOIN (
  SELECT package_id, count(*) FILTER (WHERE is_valid) AS valid_files, count(*) AS files_listed,
    coalesce(sum(coalesce(try_cast(lines_of_code AS INTEGER), 0)), 0) AS total_lines,
    min(string_split(file_path, '/')[-1]) AS first_file
  FROM vc GROUP BY package_id) f ON f.package_id = p.package_id"""))
def package_detail(spark, sf_dir):
    """Package page: projected fields, metric with zero-as-missing fallback, lenient line sum."""
    c = code_corpus(spark, sf_dir)
    f = (c.text_files.groupBy("package_id")
         .agg(F.count_if("is_valid").alias("valid_files"),
              F.count(F.lit(1)).alias("files_listed"),
              F.coalesce(F.sum(text.safe_int("lines_of_code")), F.lit(0)).alias("total_lines"),
              F.min(paths.basename("file_path")).alias("first_file")))
    return (c.packages.select("package_id", "package_name", "analysis").join(f, "package_id")
            .select("package_id", "package_name", F.coalesce("analysis", F.lit("")).alias("analysis"),
                    text.zero_is_missing("valid_files", "files_listed").cast("bigint").alias("file_count"),
                    F.col("files_listed").cast("bigint"), F.col("total_lines").cast("bigint"),
                    "first_file"))


def stable_id(*cols) -> F.Column:
    """Deterministic 24-hex id from natural keys, so re-runs are idempotent."""
    return F.substring(F.sha2(F.concat_ws("/", *cols), 256), 1, 24)


@register("breadcrumb", lambda: with_vc("""
SELECT package_id, project_key, module_key, package_key,
  concat_ws(' > ', project_name, module_name, package_name) AS labels,
  concat_ws(' ', '/project/' || project_key, '/project/' || project_key || '/module/' || module_key,
    '/project/' || project_key || '/module/' || module_key || '/package/' || package_key) AS hrefs
FROM (SELECT p.package_id, p.package_name, m.module_name, pr.project_name,
        substr(sha256(pr.project_id), 1, 24) AS project_key,
        substr(sha256(concat_ws('/', pr.project_id, m.module_id)), 1, 24) AS module_key,
        substr(sha256(concat_ws('/', pr.project_id, m.module_id, p.package_id)), 1, 24) AS package_key
      FROM vpk p JOIN vmod m ON m.module_id = p.module_id JOIN vproj pr ON pr.project_id = m.project_id) t"""))
def breadcrumb(spark, sf_dir):
    """Project → module → package label/href trail per package, with stable ids."""
    c = code_corpus(spark, sf_dir)
    t = (c.packages.select("package_id", "package_name", "module_id")
         .join(c.modules.select("module_id", "module_name", "project_id"), "module_id")
         .join(c.projects.select("project_id", "project_name"), "project_id")
         .withColumn("project_key", stable_id("project_id"))
         .withColumn("module_key", stable_id("project_id", "module_id"))
         .withColumn("package_key", stable_id("project_id", "module_id", "package_id")))
    p_href = F.concat(F.lit("/project/"), F.col("project_key"))
    m_href = F.concat(p_href, F.lit("/module/"), F.col("module_key"))
    k_href = F.concat(m_href, F.lit("/package/"), F.col("package_key"))
    return t.select("package_id", "project_key", "module_key", "package_key",
                    F.concat_ws(" > ", "project_name", "module_name", "package_name").alias("labels"),
                    F.concat_ws(" ", p_href, m_href, k_href).alias("hrefs"))


@register("module_nested", lambda: with_vc("""
SELECT m.module_id, any_value(m.module_name) AS module_name, count(p.package_id) AS n_packages,
  coalesce(string_agg(p.package_id || '|' || p.package_name || '|' || cast(pm.file_count AS varchar) || '|' || cast(pm.lines_of_code AS varchar),
    ';' ORDER BY p.package_id), '') AS packages
FROM (SELECT module_id, module_name FROM vmod UNION ALL SELECT 'empty/' || n_name, n_name FROM nation) m
LEFT JOIN vpk p ON p.module_id = m.module_id LEFT JOIN pm ON pm.package_id = p.package_id
GROUP BY m.module_id""", metrics=True))
def module_nested(spark, sf_dir):
    """Module with its packages re-nested as an ordered array of structs (empty for a module without packages).

    The array is the module page's one value; it is rendered as text so that the oracle can state it.
    """
    c = code_corpus(spark, sf_dir)
    empty = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("empty/"), "n_name").alias("module_id"), F.col("n_name").alias("module_name"))
    mods = c.modules.select("module_id", "module_name").unionByName(empty)
    pm = metrics.package_metrics(file_level(c.text_files), c.packages)
    out = metrics.nest_packages(mods, c.packages, pm)
    line = lambda p: F.concat_ws("|", p["package_id"], p["package_name"], p["file_count"].cast("string"), p["lines_of_code"].cast("string"))
    return out.select("module_id", "module_name", F.size("packages").cast("bigint").alias("n_packages"),
                      F.array_join(F.transform("packages", line), ";").alias("packages"))
