"""Source-level metadata over the code corpus: documents wrapped as Java sources, build files and READMEs.

The wrapping is this fixture's mapping: a Java file has a package line, comments, methods, and the
document's whole text as a block comment or a text block; a project's build and settings
files are assembled from its modules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import paths
from trellis.operators import java_meta
from trellis.plans.corpus_views import code_corpus
from trellis.plans.oracle_base import q, with_vc
from trellis.plans.registry import register
from trellis.sources import tree as T
from trellis.sources.tables import read_table

JAVA_HEAD = "/* generated\n * file **/ // two\n"
JAVA_BODY = '''
public class Doc {
    // a line comment with "quotes" and /* a marker
    public String run(final Map<String, List<Integer>> a, int[] b) { return "/* no comment */ // none"; }
    public String getName() { return n; } /* one line */
    public void setName(String n) { this.n = n; }
    public int getAt(int i) { char c = '"'; return i; }
    public static <T> T pick(T x, @Nullable String y , long z[]) { return x; }
    void hidden() {}
}
'''


#: A method whose parameters nest 1 to 8 deep and have 1 to 12 type arguments, by the file's id; annotations have arguments.
DEEP = ("class Deep {\n    public <K extends Comparable<K>> Map<K, int[]> deep(@Size(min = 1, max = {2, (3)}) final ", " a, Tuple<", "> b) { return null; }\n}\n")


def java_sources(files):
    """``.java`` files with ``content`` as Java: every third has no package line, every second a text block."""
    depth, width = (F.col("file_id") % 8 + 1).cast("int"), F.col("file_id") % 12 + 1
    deep = F.concat(F.lit(DEEP[0]), F.repeat(F.lit("Box<"), depth), F.lit("A"), F.repeat(F.lit(">"), depth), F.lit(DEEP[1]),
                    F.array_join(F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("T"), i.cast("string"))), ","), F.lit(DEEP[2]))
    t = F.coalesce(F.col("content"), F.lit(""))
    fid = F.col("file_id")
    pkg = F.when(fid % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("package x."), "package_name", F.lit(";\n")))
    body = F.when(fid % 2 == 0, F.concat(F.lit('String s = """\n'), t, F.lit('\n""";'))).otherwise(
        F.concat(F.lit("/*\n"), F.replace(t, F.lit("*/"), F.lit("* /")), F.lit("\n*/")))
    return files.where(F.col("file_path").endswith(".java")).withColumn(
        "content", F.concat(F.lit(JAVA_HEAD), pkg, F.lit(JAVA_BODY), deep, body))


def _java_sql() -> str:
    lit = r'''("""[\s\S]*?"""|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*')'''
    comment = r"//[^\n]*|/\*[^*\n]*(?:\*+[^*/\n][^*\n]*)*(?:\*+(\n)|(\n))?[\s\S]*?(?:\*/|\z)"
    head, body = q(JAVA_HEAD), q(JAVA_BODY)
    return with_vc(f""",
src AS (
  SELECT file_id, module_id, file_path, 'deep(' || nested || ', Tuple<' || array_to_string(args, ', ') || '>)' AS deep, {head} || CASE WHEN file_id % 3 = 0 THEN '' ELSE 'package x.' || package_name || ';' || chr(10) END ||
    {body} || {q(DEEP[0])} || nested || {q(DEEP[1])} || array_to_string(args, ',') || {q(DEEP[2])} || CASE WHEN file_id % 2 = 0 THEN 'String s = \"\"\"' || chr(10) || coalesce(content, '') || chr(10) || '\"\"\";'
      ELSE '/*' || chr(10) || replace(coalesce(content, ''), '*/', '* /') || chr(10) || '*/' END AS t
  FROM (SELECT *, repeat('Box<', (file_id % 8 + 1)::INT) || 'A' || repeat('>', (file_id % 8 + 1)::INT) AS nested,
          list_transform(range(1, file_id % 12 + 2), lambda i: 'T' || i) AS args FROM vc WHERE file_path LIKE '%.java')),
code AS (SELECT *, regexp_replace(t, {q(lit + '|' + comment)}, '\\1\\2\\3', 'g') AS c FROM src),
meta AS (
  SELECT *, regexp_extract(regexp_replace(c, {q(lit)}, '\"\"', 'g'), '(?m)^\\s*package\\s+([\\w.]+)\\s*;', 1) AS pkg,
    regexp_replace(file_path, '/[^/]*$', '') AS dir_path FROM code),
dirs AS (SELECT module_id, dir_path, arg_min(CASE WHEN pkg <> '' THEN pkg ELSE string_split(dir_path, '/')[-1] END, file_path) AS dir_package FROM meta GROUP BY 1, 2)
SELECT m.file_id, len(regexp_extract_all(c, '[^\\r\\n]*\\S[^\\r\\n]*')) AS code_lines, nullif(pkg, '') AS declared_package,
  'run(Map<String, List<Integer>>, int[]);getAt(int);pick(T, String, long[]);' || deep AS public_methods, dir_package
FROM meta m JOIN dirs d ON d.module_id = m.module_id AND d.dir_path = m.dir_path""")


@register("java_metadata", _java_sql)
def java_metadata(spark, sf_dir):
    """Code lines, declared package and public methods of every ``.java`` file, plus the
    directory package chosen by the first file (declared package, else directory name)."""
    f = java_sources(code_corpus(spark, sf_dir).files.select("file_id", "module_id", "package_name", "file_path", "content"))
    fm = (java_meta.with_java_metadata(f).drop("content")
          .withColumn("dir_path", F.concat_ws("/", "module_id", paths.dirname("file_path"))))
    dir_pkg = java_meta.directory_packages(fm).withColumnRenamed("package_name", "dir_package")
    return (fm.join(dir_pkg, "dir_path", "left")
            .select("file_id", "code_lines", "declared_package",
                    F.array_join("public_methods", ";").alias("public_methods"), "dir_package"))


# ------------------------------------------------------------------ build files

# Fixture: every (language, source) is a project; its kind is the second md5 digit of its name, modulo 8.
# Each document is a README candidate or a source file of its project.
POM = "<project><modules><module>core</module><module>./web/</module><module>core</module><module>a/../api</module></modules></project>"
BUILD_FILES = {
    0: [("pom.xml", POM), ("build.gradle", "x")], 1: [("pom.xml", "<project><modules>")],
    2: [("build.gradle", "x"), ("settings.gradle", "include ':api', ':impl'\ninclude \":core\"\n")],
    3: [("build.gradle.kts", "x"), ("settings.gradle.kts", "include(\":x\")\ninclude ':late'\n")],
    4: [("build.xml", "x")], 5: [("build.sbt", "x")], 6: [("Main.java", "class Main {}")], 7: [("notes.txt", "x")]}


def build_tree(spark, sf_dir):
    """(project, rel_path, abs_path, content): build files per project, and the documents as its files."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("-", "lang", "source").alias("project"))
    kind = F.conv(F.substring(F.md5("project"), 2, 1), 16, 10).cast("int") % 8
    built = F.create_map(*[x for k, v in BUILD_FILES.items() for x in (F.lit(k), F.array(*[
        F.struct(F.lit(n).alias("rel_path"), F.lit(c).alias("content")) for n, c in v]))])
    made = d.select("project").distinct().select("project", F.explode(built[kind]).alias("f")).select("project", "f.rel_path", "f.content")
    names = F.array(*[F.lit(n) for n in T.README_NAMES])
    n = F.col("doc_id") % 40  # nine of forty documents are README candidates; of those with one name the smallest id has it
    name = F.when(n < len(T.README_NAMES), F.element_at(names, (n + 1).cast("int")))
    first = d.select("project", name.alias("name"), "doc_id").where("name IS NOT NULL").groupBy("project", "name").agg(F.min("doc_id").alias("first_id"))
    files = (d.withColumn("name", name).join(first, ["project", "name"], "left")
             .select("project", F.when(F.col("doc_id") == F.col("first_id"), F.col("name"))
                     .otherwise(F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("rel_path"),
                     F.coalesce("text", F.lit("")).alias("content")))
    return made.unionByName(files).withColumn("abs_path", F.concat_ws("/", "project", "rel_path"))


def _projects_sql(body: str) -> str:
    return f"""
WITH p AS (SELECT DISTINCT concat_ws('-', lang, source) AS project FROM documents),
k AS (SELECT project, (instr('0123456789abcdef', substr(md5(project), 2, 1)) - 1) % 8 AS kind FROM p)
{body}"""


@register("project_type", _projects_sql(f"""
SELECT project, ['maven', NULL, 'gradle', 'gradle', 'ant', 'sbt', 'java', NULL][kind + 1] AS project_type,
  CASE kind WHEN 1 THEN 'Invalid pom.xml file' WHEN 7 THEN {q(T.UNKNOWN_TYPE)} END AS error,
  'Project detected as ' || upper(['maven', NULL, 'gradle', 'gradle', 'ant', 'sbt', 'java', NULL][kind + 1]) || ' project' AS message
FROM k"""))
def project_type(spark, sf_dir):
    """Build system of every project, with the reason where it has none."""
    return T.project_types(build_tree(spark, sf_dir))


@register("maven_modules", _projects_sql("""
SELECT project, CASE kind WHEN 0 THEN 'core,web,api' END AS modules FROM k WHERE kind IN (0, 1)"""))
def maven_modules(spark, sf_dir):
    """Modules of the root poms, normalised and distinct; NULL for a malformed pom."""
    return T.maven_modules(build_tree(spark, sf_dir)).select("project", F.array_join("modules", ",").alias("modules"))


@register("gradle_modules", _projects_sql("""
SELECT project, CASE kind WHEN 2 THEN 'api,core' ELSE 'late' END AS modules FROM k WHERE kind IN (2, 3)"""))
def gradle_modules(spark, sf_dir):
    """Modules included by the settings files (the pattern finds the first of a list, and quoted includes)."""
    return T.gradle_modules(build_tree(spark, sf_dir)).select("project", F.array_join("modules", ",").alias("modules"))


@register("project_modules", _projects_sql("""
, m AS (SELECT project, unnest(CASE kind WHEN 0 THEN ['core', 'web', 'api'] WHEN 2 THEN ['api', 'core'] WHEN 3 THEN ['late'] ELSE ['default'] END) AS module,
  unnest(range(CASE kind WHEN 0 THEN 3 WHEN 2 THEN 2 ELSE 1 END)) AS ordinal FROM k WHERE kind NOT IN (1, 7))
SELECT project, ordinal::INT AS ordinal, module, CASE module WHEN 'default' THEN project ELSE project || '/' || module END AS location FROM m"""))
def project_modules(spark, sf_dir):
    """One row per module with its location; ``default`` at the root when none is declared."""
    tree = build_tree(spark, sf_dir)
    return T.project_modules(tree, T.project_types(tree)).select("project", "ordinal", "module", "location")


@register("readme_context", """
WITH d AS (SELECT concat_ws('-', lang, source) AS project, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT project, doc_id % 40 AS rank, arg_min(t, doc_id) AS t FROM d WHERE doc_id % 40 < 9 GROUP BY 1, 2),
b AS (SELECT project, arg_min(t, rank) AS t FROM f GROUP BY 1)
SELECT p.project, md5(coalesce(b.t, '')) AS context_md5, length(coalesce(b.t, '')) AS context_len
FROM (SELECT DISTINCT project FROM d) p LEFT JOIN b ON b.project = p.project""")
def readme_context(spark, sf_dir):
    """Whole text of each project's first README by the fixed name order, else ''."""
    out = T.readme_context(build_tree(spark, sf_dir))
    return out.select("project", F.md5("context").alias("context_md5"), F.length("context").cast("bigint").alias("context_len"))
