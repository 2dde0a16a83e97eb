"""Shared DuckDB SQL fragments for the oracle queries.

The oracle is an independent restatement in plain SQL over the same
parquet tables; only the fixed values (extension lists, directory slots)
are taken from the engine's constant tables so both sides agree on them.
"""

from __future__ import annotations

from trellis.functions.paths import EXTENSION_LANGUAGE, SOURCE_EXTENSIONS
from trellis.functions.text import PRE_TOKEN_REGEX
from trellis.sources.corpus import VC_DIRS, VC_EXTENSIONS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def file_type_sql(path: str) -> str:
    ext = f"regexp_extract({path}, '(\\.[^.]*)$', 1)"
    whens = " ".join(f"WHEN {q(e)} THEN {q(lang)}" for e, lang in EXTENSION_LANGUAGE.items())
    return f"(CASE {ext} {whens} ELSE 'unknown' END)"


def valid_sql(path: str) -> str:
    suffix = "|".join(e[1:] for e in SOURCE_EXTENSIONS)
    return (f"(regexp_matches({path}, '\\.({suffix})$') AND NOT "
            f"(contains(lower({path}), 'test') OR contains(lower({path}), 'target')))")


def lines_sql(t: str) -> str:
    return (f"(CASE WHEN {t} IS NULL THEN NULL WHEN {t} = '' THEN 0 ELSE "
            f"len(regexp_extract_all({t}, '\\r\\n|\\r|\\n')) + "
            f"CASE WHEN right({t}, 1) IN (chr(10), chr(13)) THEN 0 ELSE 1 END END)::BIGINT")


def tokens_sql(t: str) -> str:
    return f"coalesce(len(regexp_extract_all({t}, {q(PRE_TOKEN_REGEX)})), 0)::BIGINT"


def _digit(pos: int) -> str:
    return f"(instr('0123456789abcdef', substr(md5(cast(doc_id AS varchar)), {pos}, 1)) - 1)"


def vc_cte() -> str:
    """CTEs ``vc`` (files + metadata), ``vpk``, ``vmod``, ``vproj`` of the code corpus."""
    dirs = " ".join(f"WHEN {i} THEN {q(d)}" for i, d in enumerate(VC_DIRS))
    exts = " ".join(f"WHEN {i} THEN {q(e)}" for i, e in enumerate(VC_EXTENSIONS))
    return f"""
vc0 AS (
  SELECT doc_id AS file_id, project_id, module_id, module_name, dir,
    concat(module_id, '/', dir) AS package_id, replace(dir, '/', '.') AS package_name,
    concat('/repos/', module_id, '/', dir, CASE WHEN doc_id % 19 = 0 THEN '/target/' ELSE '/' END,
      CASE WHEN doc_id % 17 = 0 THEN 'Test' WHEN doc_id % 13 = 0 THEN 'Record' ELSE 'Doc' END,
      cast(doc_id AS varchar), ext) AS file_path,
    text AS content,
    doc_id % 50 <> 7 AS analysed,
    CASE WHEN doc_id % 50 = 7 THEN NULL ELSE 'Lines ' || cast({lines_sql("coalesce(text, '')")} AS varchar) ||
      ', characters ' || cast(length(coalesce(text, '')) AS varchar) || ', digest ' || md5(coalesce(text, '')) || '.'
    END AS short_analysis
  FROM (SELECT doc_id, text, lang AS project_id, concat(lang, '/', source) AS module_id,
          source AS module_name,
          CASE {_digit(2)} % 4 {dirs} END AS dir,
          CASE {_digit(1)} {exts} END AS ext
        FROM documents) t),
vc AS (
  SELECT *, {file_type_sql('file_path')} AS file_type, {valid_sql('file_path')} AS is_valid,
    {lines_sql('content')} AS lines_of_code, {tokens_sql('content')} AS code_token_count,
    {tokens_sql('short_analysis')} AS analysis_token_count
  FROM vc0),
vpk0 AS (
  SELECT package_id, any_value(module_id) AS module_id, any_value(project_id) AS project_id,
         any_value(dir) AS dir, any_value(package_name) AS package_name
  FROM vc0 GROUP BY package_id),
vpk AS (
  SELECT p.*,
    (SELECT q.package_id FROM vpk0 q WHERE q.module_id = p.module_id AND starts_with(p.dir, q.dir || '/')
     ORDER BY length(q.dir) DESC LIMIT 1) AS parent_package_id,
    concat('Package ', p.package_name, ' of ', p.module_id, '.') AS analysis,
    {tokens_sql("concat('Package ', p.package_name, ' of ', p.module_id, '.')")} AS analysis_token_count
  FROM vpk0 p),
vmod AS (
  SELECT module_id, any_value(project_id) AS project_id, any_value(module_name) AS module_name,
    concat('/repos/', module_id) AS module_path,
    concat('Module ', any_value(module_name), ' of project ', any_value(project_id), '.') AS analysis,
    {tokens_sql("concat('Module ', any_value(module_name), ' of project ', any_value(project_id), '.')")}
      AS analysis_token_count
  FROM vc0 GROUP BY module_id),
vproj AS (
  SELECT project_id, project_id AS project_name, concat('/repos/', project_id) AS project_location,
    concat('Project ', project_id, ' summary.') AS analysis,
    {tokens_sql("concat('Project ', project_id, ' summary.')")} AS analysis_token_count
  FROM (SELECT DISTINCT project_id FROM vc0) t)"""


def metrics_cte() -> str:
    """CTEs ``pm``, ``mm``, ``prm`` (package/module/project metrics) on top of ``vc_cte``."""
    return """
pm AS (
  SELECT p.package_id, p.module_id, p.project_id,
    coalesce(f.file_count, 0)::BIGINT AS file_count,
    coalesce(f.lines_of_code, 0)::BIGINT AS lines_of_code,
    p.analysis_token_count::BIGINT AS package_analysis_token_count,
    (p.analysis_token_count + coalesce(f.fa, 0))::BIGINT AS combined_analysis_token_count,
    coalesce(f.code_token_count, 0)::BIGINT AS code_token_count
  FROM vpk p LEFT JOIN (
    SELECT package_id, count(*) AS file_count, sum(lines_of_code) AS lines_of_code,
      sum(analysis_token_count) AS fa, sum(code_token_count) AS code_token_count
    FROM vc GROUP BY package_id) f ON f.package_id = p.package_id),
mm AS (
  SELECT m.module_id, m.project_id,
    coalesce(a.package_count, 0)::BIGINT AS package_count,
    coalesce(a.file_count, 0)::BIGINT AS file_count,
    coalesce(a.lines_of_code, 0)::BIGINT AS lines_of_code,
    (m.analysis_token_count + coalesce(a.pc, 0))::BIGINT AS combined_analysis_token_count,
    coalesce(a.cc, 0)::BIGINT AS combined_code_token_count
  FROM vmod m LEFT JOIN (
    SELECT module_id, count(*) AS package_count, sum(file_count) AS file_count,
      sum(lines_of_code) AS lines_of_code, sum(combined_analysis_token_count) AS pc,
      sum(code_token_count) AS cc
    FROM pm GROUP BY module_id) a ON a.module_id = m.module_id),
prm AS (
  SELECT p.project_id,
    coalesce(a.module_count, 0)::BIGINT AS module_count,
    coalesce(a.package_count, 0)::BIGINT AS package_count,
    coalesce(a.file_count, 0)::BIGINT AS file_count,
    coalesce(a.lines_of_code, 0)::BIGINT AS lines_of_code,
    (p.analysis_token_count + coalesce(a.mc, 0))::BIGINT AS combined_analysis_token_count,
    coalesce(a.cc, 0)::BIGINT AS combined_code_token_count
  FROM vproj p LEFT JOIN (
    SELECT project_id, count(*) AS module_count, sum(package_count) AS package_count,
      sum(file_count) AS file_count, sum(lines_of_code) AS lines_of_code,
      sum(combined_analysis_token_count) AS mc, sum(combined_code_token_count) AS cc
    FROM mm GROUP BY project_id) a ON a.project_id = p.project_id)"""


def with_vc(body: str, metrics: bool = False) -> str:
    ctes = vc_cte() + ("," + metrics_cte() if metrics else "")
    return "WITH " + ctes.strip() + "\n" + body
