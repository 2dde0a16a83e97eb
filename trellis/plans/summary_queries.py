"""Prompt, digest and analysis queries over the code corpus.

Prompts and digest are long tables in a stated order; prompt texts are compared
by md5 and length per row, so the oracle checks exact text without shipping it.
The SQL states the order in which placeholders are filled on its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions.prompts import PROMPTS
from trellis.functions.text import pre_token_count
from trellis.operators import analyze, sinks, summaries
from trellis.plans.corpus_views import as_of_literal, code_corpus
from trellis.plans.oracle_base import lines_sql, q, tokens_sql, with_vc
from trellis.plans.registry import register
from trellis.plans.state_queries import PAIRS_SQL, with_failures
from trellis.session import cut_lineage

NL = "chr(10)"
CTX_SQL = "ctx AS (SELECT project_id, arg_min(content, file_id) AS context FROM vc GROUP BY 1)"


def _halves(level: str, list_key: str, *fills: tuple[str, str]) -> tuple[str, str]:
    """SQL of the template's text before and after the child list, filled in the order given here."""
    out = []
    for text in PROMPTS[level]["user"].split(list_key):
        sql = q(text)
        for key, value in fills:
            sql = f"replace({sql}, {q(key)}, coalesce({value}, ''))"
        out.append(sql)
    return out[0], out[1]


def _package_prompt_sql() -> str:
    head, tail = _halves("package", "{fileAnalyses}", ("{packageName}", "p.package_name"), ("{projectContext}", "c.context"))
    return with_vc(f""", {CTX_SQL},
k AS (SELECT *, count(*) OVER g AS n, row_number() OVER (g ORDER BY file_path, file_id) AS rn
      FROM vc WINDOW g AS (PARTITION BY module_id, package_name)),
pp AS (SELECT p.*, coalesce(n.n, 0)::BIGINT AS n_files FROM vpk p LEFT JOIN
       (SELECT module_id, package_name, count(*) AS n FROM vc GROUP BY 1, 2) n USING (module_id, package_name)),
parts AS (
  SELECT p.package_id, 0 AS section, '' AS file_path, NULL::BIGINT AS file_id, CASE WHEN n_files > 1 THEN {head} END AS t,
    n_files, n_files > 1 AS needs_analysis, CASE WHEN n_files > 1 THEN md5({q(PROMPTS["package"]["system"])}) END AS system_md5
  FROM pp p LEFT JOIN ctx c ON c.project_id = p.project_id
  UNION ALL
  SELECT p.package_id, 1, k.file_path, k.file_id, replace(CASE WHEN rn = 1 THEN '' ELSE {NL} || {NL} END || 'File: ' ||
    k.file_path || {NL} || 'Analysis: ' || coalesce(k.short_analysis, 'null'), '{{projectContext}}', c.context), NULL, NULL, NULL
  FROM pp p JOIN k ON k.module_id = p.module_id AND k.package_name = p.package_name LEFT JOIN ctx c ON c.project_id = p.project_id
  WHERE p.n_files > 1
  UNION ALL
  SELECT p.package_id, 2, '', NULL, {tail}, NULL, NULL, NULL
  FROM pp p LEFT JOIN ctx c ON c.project_id = p.project_id WHERE n_files > 1)
SELECT package_id, section, file_path, file_id, md5(t) AS text_md5, length(t) AS text_len, n_files, needs_analysis, system_md5 FROM parts""")


def _part_digests(p, *cols):
    return p.select(*cols, F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("text_len"))


@register("package_prompt", _package_prompt_sql)
def package_prompt(spark, sf_dir):
    """Package prompts as long tables: head, one row per file, tail; singletons need none."""
    c = code_corpus(spark, sf_dir)
    p = summaries.package_prompts(c.text_files, c.packages, c.contexts).withColumn("system_md5", F.md5("system_prompt"))
    return _part_digests(p, "package_id", "section", "file_path", "file_id", "n_files", "needs_analysis", "system_md5")


ENTRY_PATTERN = r"File: ([^\n]*)\nAnalysis: ([^\n]*)"
TALLY_PATTERN = r"tally (\d+) of (\d+) files"


def tally_analyzer(system: str, user: str) -> str:
    """Deterministic stand-in for the remote model: counts the files it was shown and sums their
    digests; a combine request adds up its parts, so one answer results however a prompt was packed."""
    import hashlib
    import re
    if user.startswith(analyze.COMBINE_PREFIX):
        pairs = [(int(a), int(b)) for a, b in re.findall(TALLY_PATTERN, user)]
    else:
        pairs = [(int(hashlib.md5(f"{p}|{a}".encode()).hexdigest()[:8], 16), 1) for p, a in re.findall(ENTRY_PATTERN, user)]
    return f"tally {sum(a for a, _ in pairs)} of {sum(b for _, b in pairs)} files"


@register("package_analysis", lambda: with_vc("""
SELECT p.package_id, 'tally ' || cast(sum(('0x' || substr(md5(f.file_path || '|' || coalesce(f.short_analysis, 'null')), 1, 8))::BIGINT)
    AS varchar) || ' of ' || cast(count(*) AS varchar) || ' files' AS analysis, 'ok' AS status
FROM vpk p JOIN vc f ON f.module_id = p.module_id AND f.package_name = p.package_name
GROUP BY p.package_id HAVING count(*) > 1"""))
def package_analysis(spark, sf_dir):
    """Package prompts through the pluggable batch analyzer (packing by size, Arrow batches, retries,
    bounded parallelism) with a deterministic function in place of the remote model."""
    c = code_corpus(spark, sf_dir)
    p = summaries.package_prompts(c.text_files, c.packages, c.contexts)
    out = analyze.analyze_prompts(p, tally_analyzer, ["package_id"], ["section", "file_path", "file_id"],
                                  parallelism=spark.sparkContext.defaultParallelism)
    return out.select("package_id", "analysis", "status")


def _module_prompt_sql() -> str:
    head, tail = _halves("module", "{packageAnalyses}", ("{moduleName}", "m.module_name"),
                         ("{projectName}", "coalesce(pr.project_name, 'unknown-project')"), ("{projectContext}", "c.context"))
    system = f"replace(replace({q(PROMPTS['module']['system'])}, '{{moduleName}}', m.module_name), '{{projectName}}', coalesce(pr.project_name, 'unknown-project'))"
    outer = """FROM vmod m LEFT JOIN vproj pr ON pr.project_id = m.project_id LEFT JOIN ctx c ON c.project_id = m.project_id"""
    return with_vc(f""", {CTX_SQL},
rootp AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY package_id) AS rn FROM vpk WHERE parent_package_id IS NULL),
rf AS (SELECT r.module_id, r.package_id, f.file_path, f.file_id, f.short_analysis,
         row_number() OVER (PARTITION BY r.package_id ORDER BY f.file_path, f.file_id) AS rn
       FROM rootp r JOIN vc f ON f.package_id = r.package_id),
parts AS (
  SELECT m.module_id, 0 AS section, '' AS package_id, 0 AS kind, '' AS file_path, NULL::BIGINT AS file_id, {head} AS t, md5({system}) AS system_md5 {outer}
  UNION ALL SELECT module_id, 1, package_id, 0, '', NULL, CASE WHEN rn = 1 THEN '' ELSE {NL} || {NL} END ||
    'Package: ' || package_name || {NL} || 'Analysis: ' || coalesce(analysis, ''), NULL FROM rootp
  UNION ALL SELECT module_id, 1, package_id, 1, file_path, file_id, CASE WHEN rn = 1 THEN '' ELSE {NL} END || {NL} || '  File: ' ||
    string_split(file_path, '/')[-1] || {NL} || '  Analysis: ' || coalesce(short_analysis, ''), NULL FROM rf
  UNION ALL SELECT m.module_id, 2, '', 0, '', NULL, {tail}, NULL {outer})
SELECT module_id, section, package_id, kind, file_path, file_id, md5(t) AS text_md5, length(t) AS text_len, system_md5 FROM parts""")


@register("module_prompt", _module_prompt_sql)
def module_prompt(spark, sf_dir):
    """Module prompts as long tables: root packages (with their own files) in package order."""
    c = code_corpus(spark, sf_dir)
    m = summaries.module_prompts(c.text_files, c.packages, c.modules, c.projects, c.contexts).withColumn("system_md5", F.md5("system_prompt"))
    return _part_digests(m, "module_id", "section", "package_id", "kind", "file_path", "file_id", "system_md5")


def _project_prompt_sql() -> str:
    head, tail = _halves("project", "{moduleAnalyses}", ("{projectName}", "p.project_name"), ("{projectContext}", "c.context"))
    system = f"replace({q(PROMPTS['project']['system'])}, '{{projectName}}', p.project_name)"
    return with_vc(f""", {CTX_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY module_id) AS rn FROM vmod),
parts AS (
  SELECT p.project_id, 0 AS section, '' AS module_id, {head} AS t, md5({system}) AS system_md5 FROM vproj p LEFT JOIN ctx c ON c.project_id = p.project_id
  UNION ALL SELECT project_id, 1, module_id, CASE WHEN rn = 1 THEN '' ELSE {NL} || {NL} END || 'Module: ' || module_name || {NL} ||
    'Analysis: ' || coalesce(analysis, 'null'), NULL FROM k
  UNION ALL SELECT p.project_id, 2, '', {tail}, NULL FROM vproj p LEFT JOIN ctx c ON c.project_id = p.project_id)
SELECT project_id, section, module_id, md5(t) AS text_md5, length(t) AS text_len, system_md5 FROM parts""")


@register("project_prompt", _project_prompt_sql)
def project_prompt(spark, sf_dir):
    """Project prompts as long tables over module summaries (with the project context; see README on parity)."""
    c = code_corpus(spark, sf_dir)
    p = summaries.project_prompts(c.modules, c.projects, c.contexts).withColumn("system_md5", F.md5("system_prompt"))
    return _part_digests(p, "project_id", "section", "module_id", "system_md5")


def _file_user_sql(level: str) -> str:
    sql = q(PROMPTS[level]["user"])
    for key, value in (("{fileContent}", "f.content"), ("{projectContext}", "c.context")):
        sql = f"replace({sql}, {q(key)}, coalesce({value}, ''))"
    return sql


def file_prompt_ctes(body: str) -> str:
    """``body`` over ``prompts (file_id, user_prompt)``, the short prompts of all files."""
    return with_vc(f""", {CTX_SQL},
prompts AS (SELECT f.file_id, {_file_user_sql('fileShort')} AS user_prompt FROM vc f LEFT JOIN ctx c ON c.project_id = f.project_id)
{body}""")


def _file_prompt_sql() -> str:
    return with_vc(f""", {CTX_SQL},
p AS (SELECT f.file_id, {_file_user_sql('fileShort')} AS short, {_file_user_sql('file')} AS long FROM vc f LEFT JOIN ctx c ON c.project_id = f.project_id)
SELECT file_id, md5(short) AS short_md5, md5(long) AS full_md5, length(long) AS full_len,
  md5({q(PROMPTS['fileShort']['system'])}) AS short_system_md5, md5({q(PROMPTS['file']['system'])}) AS full_system_md5 FROM p""")


@register("file_prompt", _file_prompt_sql)
def file_prompt(spark, sf_dir):
    """Both prompts of every file (short and full template), with the project context."""
    c = code_corpus(spark, sf_dir)
    a = summaries.file_prompts(c.text_files, c.contexts, short=True).select(
        "file_id", F.md5("user_prompt").alias("short_md5"), F.md5("system_prompt").alias("short_system_md5"))
    b = summaries.file_prompts(c.text_files, c.contexts, short=False).select(
        "file_id", F.md5("user_prompt").alias("full_md5"), F.length("user_prompt").cast("bigint").alias("full_len"),
        F.md5("system_prompt").alias("full_system_md5"))
    return a.join(b, "file_id")


def _digest_sql(body: str) -> str:
    na = "'" + summaries.NO_ANALYSIS + "'"
    title = summaries.DIGEST_TITLE
    return with_vc(f""",
blocks AS (
  SELECT project_id, '' AS module_key, '' AS package_key, '' AS file_key, -1::BIGINT AS file_id,
    '# ' || project_name || ' - {title}' || {NL} || {NL} || '## Project: ' || project_name || {NL} || {NL} ||
    coalesce(analysis, {na}) || {NL} || {NL} AS block FROM vproj
  UNION ALL
  SELECT project_id, module_id, '', '', -1::BIGINT,
    '## Module: ' || module_name || {NL} || {NL} || coalesce(analysis, {na}) || {NL} || {NL} FROM vmod
  UNION ALL
  SELECT project_id, module_id, package_id, '', -1::BIGINT,
    '### Package: ' || package_name || {NL} || {NL} || coalesce(analysis, {na}) || {NL} || {NL} FROM vpk
  UNION ALL
  SELECT project_id, module_id, package_id, file_path, file_id::BIGINT,
    '#### File: ' || string_split(file_path, '/')[-1] || {NL} || {NL} || coalesce(short_analysis, {na}) ||
    {NL} || {NL} FROM vc)
{body}""")


@register("digest_markdown", lambda: _digest_sql("SELECT * FROM blocks"))
def digest_markdown(spark, sf_dir):
    """Project digest as ordered markdown blocks (project → module → package → file)."""
    c = code_corpus(spark, sf_dir)
    return summaries.digest_rows(c.text_files, c.packages, c.modules, c.projects)


def _export_sql() -> str:
    na = q(summaries.NO_ANALYSIS)
    v = lambda c: f"coalesce(nullif({c}, ''), {na})"
    title = summaries.DIGEST_TITLE
    return with_vc(f"""{PAIRS_SQL},
cached AS (SELECT project_id, CASE WHEN project_id IN ('en', 'fr') THEN '# stored ' || project_id ELSE '' END AS context FROM vproj WHERE project_id IN ('en', 'es', 'fr')),
fresh AS (
  SELECT project_id, '' AS module_key, '' AS package_key, '' AS file_key, -1::BIGINT AS file_id,
    '# ' || project_name || ' - {title}' || {NL} || {NL} || '## Project: ' || project_name || {NL} || {NL} || {v('analysis')} || {NL} || {NL} AS block FROM vproj
  UNION ALL SELECT project_id, module_id, '', '', -1, '## Module: ' || module_name || {NL} || {NL} || {v('analysis')} || {NL} || {NL} FROM fmod
  UNION ALL SELECT project_id, module_id, package_id, '', -1, '### Package: ' || package_name || {NL} || {NL} || {v('analysis')} || {NL} || {NL} FROM fpk
  UNION ALL SELECT project_id, module_id, package_id, file_path, file_id, '#### File: ' || string_split(file_path, '/')[-1] || {NL} || {NL} ||
    {v('short_analysis')} || {NL} || {NL} FROM vc)
SELECT project_id, '' AS module_key, '' AS package_key, '' AS file_key, -1::BIGINT AS file_id, context AS block FROM cached WHERE context <> ''
UNION ALL SELECT * FROM fresh WHERE project_id NOT IN (SELECT project_id FROM cached WHERE context <> '')""")


@register("export_context", _export_sql)
def export_context(spark, sf_dir):
    """Exported context: the stored copy of a project if it is not empty, else the digest rendered
    anew, where an empty or missing analysis shows the placeholder."""
    c = code_corpus(spark, sf_dir)
    pk, md = with_failures(c.packages, c.modules)
    blocks = summaries.digest_rows(c.text_files, pk, md, c.projects, empty_is_missing=True)
    cached = (c.projects.where(F.col("project_id").isin("en", "es", "fr")).select(
        "project_id", F.when(F.col("project_id") == "es", F.lit("")).otherwise(F.concat(F.lit("# stored "), "project_id")).alias("context")))
    return sinks.export_context(blocks, cached)


@register("digest_stats", lambda: _digest_sql(f"""
SELECT project_id, count(*)::BIGINT AS n_blocks, sum(length(block))::BIGINT AS digest_len,
  sum({tokens_sql('block')})::BIGINT AS token_count
FROM blocks GROUP BY project_id"""))
def digest_stats(spark, sf_dir):
    """Per-project digest size and token count (blocks end in a break, so token counts add up)."""
    c = code_corpus(spark, sf_dir)
    b = summaries.digest_rows(c.text_files, c.packages, c.modules, c.projects)
    return (b.groupBy("project_id")
            .agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("block")).cast("bigint").alias("digest_len"),
                 F.sum(pre_token_count("block")).cast("bigint").alias("token_count")))


AS_OF = "2024-02-01 00:00:00"
HOURS_SQL = "(instr('0123456789abcdef', substr(md5({k}), 3, 1)) - 1) * 16 + instr('0123456789abcdef', substr(md5({k}), 4, 1)) - 1"


def _age_units(key: str):
    h = F.md5(F.col(key))
    return F.conv(F.substring(h, 3, 2), 16, 10).cast("int")


def _with_dates(df, key: str, unit_s: int, modulo: int):
    """Synthetic analysis dates: ``as_of`` minus (md5 byte of the key mod ``modulo``) units."""
    age = _age_units(key) % modulo
    return (df.withColumn("__age", age)
            .withColumn("analysis_date",
                        F.timestamp_seconds(F.unix_seconds(as_of_literal(AS_OF)) - F.col("__age") * unit_s))
            .withColumn("analysis", F.when(F.col("__age") % 7 == 0, F.lit(""))
                        .when(F.col("__age") % 11 == 0, F.lit(None).cast("string"))
                        .otherwise(F.col("analysis"))))


def skip_fresh_sql() -> str:
    def lvl(name, table, key, unit, modulo, window):
        age = f"(({HOURS_SQL.format(k=key)}) % {modulo})"
        return f"""
  SELECT '{name}' AS level, {key} AS entity_id,
    coalesce(CASE WHEN {age} % 7 = 0 THEN '' WHEN {age} % 11 = 0 THEN NULL ELSE analysis END, '') <> ''
    AND (TIMESTAMP '{AS_OF}' - to_seconds({age} * {unit})) > TIMESTAMP '{AS_OF}' - to_seconds({window})
    AS fresh FROM {table}"""
    body = (lvl("package", "vpk", "package_id", 3600, 48, 86400) + "\n  UNION ALL" +
            lvl("module", "vmod", "module_id", 60, 120, 3600) + "\n  UNION ALL" +
            lvl("project", "vproj", "project_id", 60, 120, 3600) + "\n  UNION ALL" + """
  SELECT 'file', cast(file_id AS varchar), coalesce(short_analysis, '') <> '' FROM vc""")
    return with_vc(f"""
SELECT level, entity_id, fresh, CASE WHEN fresh THEN 'skip' ELSE 'analyze' END AS action FROM ({body}) t""")


@register("skip_fresh", skip_fresh_sql)
def skip_fresh(spark, sf_dir):
    """Which entities the analysis stages skip: fresh analysis per level window, analysed files."""
    return fresh_entities(spark, sf_dir).withColumn("action", F.when(F.col("fresh"), "skip").otherwise("analyze"))


def fresh_entities(spark, sf_dir):
    """``(level, entity_id, fresh)`` of every file, package, module and project, with the fixture's dates."""
    c = code_corpus(spark, sf_dir)
    as_of = as_of_literal(AS_OF)
    parts = []
    for level, df, key, unit, modulo in (("package", c.packages, "package_id", 3600, 48),
                                         ("module", c.modules, "module_id", 60, 120),
                                         ("project", c.projects, "project_id", 60, 120)):
        d = _with_dates(df, key, unit, modulo)
        parts.append(d.select(F.lit(level).alias("level"), F.col(key).alias("entity_id"),
                              analyze.is_fresh("analysis", "analysis_date", as_of, level).alias("fresh")))
    parts.append(c.files.select(F.lit("file").alias("level"), F.col("file_id").cast("string").alias("entity_id"),
                                analyze.is_file_analysed("short_analysis").alias("fresh")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("record_skip", lambda: with_vc(f"""
SELECT file_id, contains(file_path, 'Record') AS skipped,
  CASE WHEN contains(file_path, 'Record') THEN 'not analyzed' ELSE short_analysis END AS short_analysis,
  CASE WHEN contains(file_path, 'Record') THEN 0 ELSE code_token_count END::BIGINT AS code_token_count,
  CASE WHEN contains(file_path, 'Record') THEN 0 ELSE analysis_token_count END::BIGINT AS analysis_token_count
FROM vc"""))
def record_skip(spark, sf_dir):
    """Files whose path contains ``Record`` are not analysed: placeholder text, zero tokens."""
    f = code_corpus(spark, sf_dir).text_files
    rec = analyze.is_record_file("file_path")
    zero = F.lit(0).cast("bigint")
    return f.select("file_id", rec.alias("skipped"),
                    F.when(rec, F.lit(analyze.NOT_ANALYZED)).otherwise(F.col("short_analysis")).alias("short_analysis"),
                    F.when(rec, zero).otherwise(F.col("code_token_count")).alias("code_token_count"),
                    F.when(rec, zero).otherwise(F.col("analysis_token_count")).alias("analysis_token_count"))


def _level_sql(level: str, name: str) -> str:
    z = lambda c: f"cast(coalesce(k.{c}, 0) AS varchar)"
    return f"'This {level} ' || {name} || ' has ' || {z('n')} || ' parts of ' || {z('t')} || ' tokens, digest ' || {z('d')} || '.'"


def _analyze_levels_sql() -> str:
    def sums(text):
        return f"count(*) AS n, sum({tokens_sql(text)})::BIGINT AS t, sum(('0x' || substr(md5(coalesce({text}, '')), 1, 8))::BIGINT)::BIGINT AS d"
    whole = f"""'Lines ' || cast({lines_sql("coalesce(content, '')")} AS varchar) || ', characters ' ||
      cast(length(coalesce(content, '')) AS varchar) || ', digest ' || md5(coalesce(content, '')) || '.'"""
    return with_vc(f""",
fa AS (SELECT *, CASE WHEN contains(file_path, 'Record') THEN 'not analyzed'
                      WHEN coalesce(short_analysis, '') <> '' THEN short_analysis ELSE {whole} END AS sa FROM vc),
pk AS (SELECT module_id, package_name, {sums('sa')} FROM fa GROUP BY 1, 2),
pa AS (SELECT p.package_id, p.module_id, p.parent_package_id,
         CASE WHEN coalesce(k.n, 0) <= 1 THEN '' ELSE {_level_sql('package', 'p.package_name')} END AS analysis
       FROM vpk p LEFT JOIN pk k ON k.module_id = p.module_id AND k.package_name = p.package_name),
mk AS (SELECT module_id, {sums('analysis')} FROM pa WHERE parent_package_id IS NULL GROUP BY 1),
ma AS (SELECT m.module_id, m.project_id, {_level_sql('module', 'm.module_name')} AS analysis
       FROM vmod m LEFT JOIN mk k ON k.module_id = m.module_id),
jk AS (SELECT project_id, {sums('analysis')} FROM ma GROUP BY 1),
ja AS (SELECT p.project_id, {_level_sql('project', 'p.project_name')} AS analysis
       FROM vproj p LEFT JOIN jk k ON k.project_id = p.project_id),
allv AS (
  SELECT 'file' AS level, cast(file_id AS varchar) AS entity_id, sa AS analysis,
    CASE WHEN contains(file_path, 'Record') THEN 0 ELSE {tokens_sql('sa')} END AS analysis_token_count FROM fa
  UNION ALL SELECT 'package', package_id, analysis, {tokens_sql('analysis')} FROM pa
  UNION ALL SELECT 'module', module_id, analysis, {tokens_sql('analysis')} FROM ma
  UNION ALL SELECT 'project', project_id, analysis, {tokens_sql('analysis')} FROM ja)
SELECT level, entity_id, analysis, analysis_token_count::BIGINT AS analysis_token_count FROM allv""")


@register("analyze_levels", _analyze_levels_sql)
def analyze_levels(spark, sf_dir):
    """The four analysis stages in level order with the default analyzer, from one scan of the texts.

    The file stage's narrow rows are written once to shared storage; the upper levels read those.
    """
    c = code_corpus(spark, sf_dir)
    f = cut_lineage(analyze.analyze_files(c.text_files).select("file_id", "module_id", "package_name", "short_analysis", "analysis_token_count"))
    p = analyze.analyze_packages(f, c.packages.drop("analysis", "analysis_token_count"))
    m = analyze.analyze_modules(p, c.modules)
    j = analyze.analyze_projects(m, c.projects)
    out = f.select(F.lit("file").alias("level"), F.col("file_id").cast("string").alias("entity_id"),
                   F.col("short_analysis").alias("analysis"), "analysis_token_count")
    for level, df, key in (("package", p, "package_id"), ("module", m, "module_id"), ("project", j, "project_id")):
        out = out.unionByName(df.select(F.lit(level).alias("level"), F.col(key).alias("entity_id"), "analysis", "analysis_token_count"))
    return out


@register("keyed_update", lambda: with_vc("""
SELECT file_id, CASE WHEN file_id % 10 = 3 THEN 'patched ' || cast(file_id AS varchar) || ' v2' ELSE short_analysis END AS short_analysis,
  CASE WHEN file_id % 10 = 3 THEN 2 ELSE analysis_token_count END AS analysis_token_count FROM vc"""))
def keyed_update(spark, sf_dir):
    """Keyed field update of the file rows; some keys come with two patch rows, of which the newest wins."""
    f = code_corpus(spark, sf_dir).files.select("file_id", "short_analysis", "analysis_token_count")
    hit = f.where(F.col("file_id") % 10 == 3)
    patch = hit.select("file_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("v")).select(
        "file_id", "v", F.concat(F.lit("patched "), F.col("file_id").cast("string"), F.lit(" v"), F.col("v").cast("string")).alias("short_analysis"),
        F.col("v").cast("bigint").alias("analysis_token_count"))
    return analyze.apply_patch(f, patch, ["file_id"], ["short_analysis", "analysis_token_count"], newest_by="v")
