"""Operational counters and string/validation queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import text
from trellis.plans.oracle_base import q
from trellis.plans.registry import register
from trellis.sources.commands import FIELD_PATTERNS, parse_commands
from trellis.sources.tables import read_table


@register("event_counters", """
SELECT 'svc-' || cast(user_id % 5 AS varchar) AS service, strftime(ts, '%Y-%m-%d') AS day,
  count(*)::BIGINT AS processed, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors,
  count(*) FILTER (WHERE event_type IN ('view', 'click'))::BIGINT AS requests,
  count(*) FILTER (WHERE event_type = 'error' AND value > 50)::BIGINT AS failures,
  sum(cast(round(value * 100) AS BIGINT))::BIGINT AS usage_units
FROM events GROUP BY 1, 2""")
def event_counters(spark, sf_dir):
    """Tagged counters per service and day: processed, errors, requests, failures, usage."""
    e = read_table(spark, sf_dir, "events")
    t = F.col("event_type")
    return (e.groupBy(F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"),
                      F.date_format("ts", "yyyy-MM-dd").alias("day"))
            .agg(F.count(F.lit(1)).alias("processed"),
                 F.count_if(t == "error").alias("errors"),
                 F.count_if(t.isin("view", "click")).alias("requests"),
                 F.count_if((t == "error") & (F.col("value") > 50)).alias("failures"),
                 F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("usage_units")))


CANDIDATE_SQL = """
c AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)/', 1) AS host,
        regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS seg FROM pages),
cand AS (SELECT page_id, seg AS project_name, CASE page_id % 4 WHEN 0 THEN url
          WHEN 1 THEN 'https://github.com/' || host || '/' || seg
          WHEN 2 THEN 'https://github.com/' || host || '/' || seg || '.git'
          ELSE 'https://github.com/' || host || '/x/' || seg END AS github_url FROM c)"""


def _candidates(spark, sf_dir):
    """Repository URL candidates from page URLs (valid, .git, extra segment, raw)."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    seg = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1)
    base = F.concat(F.lit("https://github.com/"), host, F.lit("/"))
    k = F.col("page_id") % 4
    url = (F.when(k == 0, F.col("url")).when(k == 1, F.concat(base, seg))
           .when(k == 2, F.concat(base, seg, F.lit(".git"))).otherwise(F.concat(base, F.lit("x/"), seg)))
    return p.select("page_id", seg.alias("project_name"), url.alias("github_url"))


@register("url_validate", f"""
WITH {CANDIDATE_SQL.strip()}
SELECT page_id, github_url,
  regexp_matches(github_url, {q(text.GITHUB_URL_REGEX)}) AS is_valid,
  CASE WHEN coalesce(project_name, '') = '' THEN 'Project name is required'
       WHEN coalesce(github_url, '') = '' THEN 'GitHub URL is required'
       WHEN NOT regexp_matches(github_url, {q(text.GITHUB_URL_REGEX)}) THEN 'Invalid GitHub URL format'
  END AS error
FROM cand""")
def url_validate(spark, sf_dir):
    """Import-request validation: required fields, repository URL format; reason per row."""
    c = _candidates(spark, sf_dir)
    valid = text.is_valid_repo_url("github_url")
    err = (F.when(~text.non_empty("project_name"), "Project name is required")
           .when(~text.non_empty("github_url"), "GitHub URL is required")
           .when(~valid, "Invalid GitHub URL format"))
    return c.select("page_id", "github_url", valid.alias("is_valid"), err.alias("error"))


@register("repo_name", f"""
WITH {CANDIDATE_SQL.strip()}
SELECT page_id, github_url, regexp_extract(github_url, {q(text.REPO_NAME_REGEX)}, 1) AS repo_name FROM cand""")
def repo_name(spark, sf_dir):
    """Repository name from the URL (greedy, so a ``.git`` suffix stays)."""
    c = _candidates(spark, sf_dir)
    return c.select("page_id", "github_url", text.repo_name("github_url").alias("repo_name"))


@register("truncate_text", f"""
SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN '' WHEN length(text) <= 100 THEN text
  ELSE regexp_replace(substr(text, 1, 100), {q(text.UI_TRIM_REGEX)}, '', 'g') || '... ' END AS description
FROM documents""")
def truncate_text(spark, sf_dir):
    """Card description: 100 chars, trimmed, ``'... '`` appended; NULL → ''."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", text.truncate_text("text").alias("description"))


@register("format_numbers", """
SELECT doc_id, format('{:,}', n_chars) AS n_chars_fmt, format('{:,}', doc_id) AS id_fmt,
  regexp_replace(format('{:,.3f}', n_chars / 8.0), '[.]?0+$', '') AS eighths_fmt, '0' AS text_fmt
FROM documents""")
def format_numbers(spark, sf_dir):
    """Display numbers: integers, a JSON number, fractions, and text (shown as ``0``)."""
    d = read_table(spark, sf_dir, "documents")
    js = F.concat(F.lit('{"k": '), F.col("doc_id").cast("string"), F.lit("}"))
    return d.select("doc_id", text.format_count("n_chars").alias("n_chars_fmt"),
                    text.format_count(F.from_json(js, "k bigint")["k"]).alias("id_fmt"),
                    text.format_count(F.col("n_chars") / F.lit(8.0)).alias("eighths_fmt"),
                    text.format_count(F.col("doc_id").cast("string")).alias("text_fmt"))


def _command_json_sql() -> str:
    return """
cmd AS (SELECT event_id,
  '{' || '"project_name": "proj-' || cast(user_id AS varchar) || '", ' ||
  '"github_url": "https://github.com/u' || cast(user_id AS varchar) || '/r' || cast(event_id AS varchar) || '"' ||
  CASE WHEN event_type = 'view' THEN ', "project_context": "ctx ' || props || '"' ELSE '' END ||
  CASE WHEN event_type <> 'click' THEN ', "timestamp": "' || cast(epoch_us(ts) // 1000 AS varchar) || '"' ELSE '' END ||
  CASE WHEN event_type <> 'error' THEN ', "import_id": "imp-' || cast(event_id AS varchar) || '"' ELSE '' END ||
  '}' AS body FROM events)"""


def command_bodies(spark, sf_dir):
    """Import commands as JSON text, one per event; error events lack ``import_id``."""
    e = read_table(spark, sf_dir, "events")
    t = F.col("event_type")
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    body = F.concat(
        F.lit('{"project_name": "proj-'), F.col("user_id").cast("string"), F.lit('", '),
        F.lit('"github_url": "https://github.com/u'), F.col("user_id").cast("string"), F.lit("/r"),
        F.col("event_id").cast("string"), F.lit('"'),
        F.when(t == "view", F.concat(F.lit(', "project_context": "ctx '), F.col("props"), F.lit('"')))
        .otherwise(F.lit("")),
        F.when(t != "click", F.concat(F.lit(', "timestamp": "'), ms, F.lit('"'))).otherwise(F.lit("")),
        F.when(t != "error", F.concat(F.lit(', "import_id": "imp-'), F.col("event_id").cast("string"),
                                      F.lit('"'))).otherwise(F.lit("")),
        F.lit("}"))
    return e.select("event_id", body.alias("body"))


AS_OF_MS = 1706745600000  # 2024-02-01T00:00:00Z, the run's "now"


def _json_commands_sql() -> str:
    f = {k: f"nullif(regexp_extract(body, {q(v)}, 1), '')" for k, v in FIELD_PATTERNS.items()}
    return f"""
WITH {_command_json_sql().strip()}
SELECT event_id, {f['project_name']} AS cmd_project_name, {f['github_url']} AS cmd_github_url,
  coalesce({f['project_context']}, '') AS cmd_project_context, {f['import_id']} AS cmd_import_id,
  coalesce(try_cast({f['timestamp']} AS BIGINT), {AS_OF_MS}) AS cmd_ts_ms,
  CASE WHEN {f['project_name']} IS NULL THEN 'Missing required field: project_name'
       WHEN {f['github_url']} IS NULL THEN 'Missing required field: github_url'
       WHEN {f['import_id']} IS NULL THEN 'Missing required field: import_id' END AS reason,
  CASE WHEN {f['project_name']} IS NULL OR {f['github_url']} IS NULL OR {f['import_id']} IS NULL
       THEN 'quarantined' ELSE 'ok' END AS status
FROM cmd"""


@register("json_commands", _json_commands_sql)
def json_commands(spark, sf_dir):
    """Parse import commands; rows missing a required field go to the quarantine with a reason."""
    parsed = parse_commands(command_bodies(spark, sf_dir), "body", F.lit(AS_OF_MS).cast("bigint"))
    return parsed.select("event_id", "cmd_project_name", "cmd_github_url", "cmd_project_context",
                         "cmd_import_id", "cmd_ts_ms", "reason", "status")
