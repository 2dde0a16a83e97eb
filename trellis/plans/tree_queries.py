"""Directory hierarchy queries over the code corpus (ancestors, subtree tests, module tree)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import paths
from trellis.operators import hierarchy
from trellis.plans.corpus_views import code_corpus
from trellis.plans.oracle_base import with_vc
from trellis.plans.registry import register
from trellis.sources.corpus import VC_ROOT

KEY = ["module_id"]


def _files_rel(spark, sf_dir, text: bool = False):
    """Files with their directory relative to the module root (``text``: line/token counts used)."""
    c = code_corpus(spark, sf_dir)
    f = c.text_files if text else c.files
    module_path = F.concat(F.lit(VC_ROOT), F.col("module_id"))
    return f.withColumn("rel_dir", paths.relative_to(module_path, paths.dirname("file_path")))


REL_SQL = ("f AS (SELECT *, substr(regexp_extract(file_path, '^(.*)/[^/]*$', 1), "
           "length('/repos/' || module_id) + 2) AS rel_dir FROM vc), "
           "ex AS (SELECT file_id, module_id, is_valid, rel_dir, i::INT AS anc_depth, "
           "array_to_string(list_slice(string_split(rel_dir, '/'), 1, i), '/') AS anc_dir, "
           "i = len(string_split(rel_dir, '/')) AS is_self "
           "FROM (SELECT *, unnest(generate_series(1, len(string_split(rel_dir, '/')))) AS i FROM f) t)")


def _with_rel(body: str) -> str:
    base = with_vc("")
    return base.rstrip() + ",\n" + REL_SQL + "\n" + body


@register("ancestor_dirs", lambda: _with_rel(
    "SELECT file_id, module_id, anc_dir, anc_depth, is_self FROM ex"))
def ancestor_dirs(spark, sf_dir):
    """Every ancestor-or-self directory of every file (closed form of the directory recursion)."""
    f = _files_rel(spark, sf_dir)
    return (hierarchy.explode_ancestors(f, "rel_dir", ["file_id", "module_id"])
            .select("file_id", "module_id", "anc_dir", F.col("anc_depth").cast("int"), "is_self"))


SUBTREE_SQL = """
st AS (SELECT module_id, anc_dir AS dir, anc_depth AS depth, bool_or(is_valid) AS has_source,
  count(*)::BIGINT AS subtree_files, count(*) FILTER (WHERE is_valid)::BIGINT AS subtree_valid_files
  FROM ex GROUP BY 1, 2, 3)"""


@register("subtree_has_source", lambda: _with_rel(
    "," + SUBTREE_SQL + " SELECT * FROM st"))
def subtree_has_source(spark, sf_dir):
    """Per directory: does any file below it pass the validity test (existential semi-join)."""
    f = _files_rel(spark, sf_dir)
    return (hierarchy.subtree_flags(f, KEY, "rel_dir", "is_valid")
            .select("module_id", "dir", F.col("depth").cast("int"), "has_source",
                    F.col("subtree_files").cast("bigint"), F.col("subtree_valid_files").cast("bigint")))


@register("child_dir_counts", lambda: _with_rel("," + SUBTREE_SQL + """
SELECT s.module_id, s.dir, s.has_source, coalesce(c.child_dirs, 0)::BIGINT AS child_dirs
FROM st s LEFT JOIN (
  SELECT module_id, regexp_extract(dir, '^(.*)/[^/]*$', 1) AS parent, count(*) AS child_dirs
  FROM st WHERE has_source AND depth > 1 GROUP BY 1, 2) c
ON c.module_id = s.module_id AND c.parent = s.dir"""))
def child_dir_counts(spark, sf_dir):
    """Number of direct child directories with a valid file somewhere below."""
    f = _files_rel(spark, sf_dir)
    flags = hierarchy.subtree_flags(f, KEY, "rel_dir", "is_valid")
    return hierarchy.child_dir_counts(flags, KEY)


@register("modules_with_source", lambda: with_vc("""
SELECT module_id, project_id FROM vmod m
WHERE EXISTS (SELECT 1 FROM vc WHERE vc.module_id = m.module_id AND vc.is_valid)"""))
def modules_with_source(spark, sf_dir):
    """Modules whose tree holds at least one valid source file (left-semi join)."""
    c = code_corpus(spark, sf_dir)
    valid = c.files.where("is_valid").select("module_id")
    return c.modules.join(valid, "module_id", "left_semi").select("module_id", "project_id")


MODTREE_SQL = """
nodes AS (SELECT DISTINCT module_id, rel_dir AS dir FROM f WHERE is_valid),
tree AS (SELECT n.module_id, n.dir,
  (SELECT p.dir FROM nodes p WHERE p.module_id = n.module_id AND starts_with(n.dir, p.dir || '/')
   ORDER BY length(p.dir) DESC LIMIT 1) AS parent_dir FROM nodes n)"""


@register("module_parent", lambda: _with_rel("," + MODTREE_SQL + """
SELECT t.module_id, t.dir, t.parent_dir,
  (SELECT count(*) FROM tree c WHERE c.module_id = t.module_id AND c.parent_dir = t.dir)::BIGINT
    AS child_count
FROM tree t"""))
def module_parent(spark, sf_dir):
    """Directory modules (dirs with direct valid files), nearest module ancestor, child count."""
    f = _files_rel(spark, sf_dir)
    nodes = f.where("is_valid").select("module_id", F.col("rel_dir").alias("dir")).distinct()
    tree = hierarchy.nearest_ancestor(nodes, KEY, "dir")
    return hierarchy.child_counts(tree, KEY, "dir").select("module_id", "dir", "parent_dir", "child_count")


@register("module_metrics_direct", lambda: _with_rel("," + MODTREE_SQL + """
SELECT m.module_id, m.project_id,
  coalesce(a.file_count, 0)::BIGINT AS file_count, coalesce(a.lines_of_code, 0)::BIGINT AS lines_of_code,
  coalesce(a.directory_count, 0)::BIGINT AS directory_count,
  (SELECT count(*) FROM tree t WHERE t.module_id = m.module_id AND t.parent_dir IS NULL)::BIGINT
    AS child_module_count,
  coalesce(a.cc, 0)::BIGINT AS combined_code_token_count,
  coalesce(a.ac, 0)::BIGINT AS combined_analysis_token_count
FROM vmod m LEFT JOIN (
  SELECT module_id, count(*) AS file_count, sum(lines_of_code) AS lines_of_code,
    count(DISTINCT rel_dir) AS directory_count, sum(code_token_count) AS cc,
    sum(analysis_token_count) AS ac
  FROM f GROUP BY 1) a ON a.module_id = m.module_id"""))
def module_metrics_direct(spark, sf_dir):
    """Module metrics straight from files: counts, sums, distinct directories, top-level child modules."""
    c = code_corpus(spark, sf_dir)
    f = _files_rel(spark, sf_dir, text=True)
    agg = (f.groupBy("module_id")
           .agg(F.count(F.lit(1)).alias("file_count"),
                F.sum("lines_of_code").alias("lines_of_code"),
                F.count_distinct("rel_dir").alias("directory_count"),
                F.sum("code_token_count").alias("combined_code_token_count"),
                F.sum("analysis_token_count").alias("combined_analysis_token_count")))
    nodes = f.where("is_valid").select("module_id", F.col("rel_dir").alias("dir")).distinct()
    roots = (hierarchy.nearest_ancestor(nodes, KEY, "dir").where(F.col("parent_dir").isNull())
             .groupBy("module_id").agg(F.count(F.lit(1)).alias("child_module_count")))
    z = lambda c_: F.coalesce(F.col(c_), F.lit(0)).cast("bigint").alias(c_)
    return (c.modules.select("module_id", "project_id")
            .join(agg, "module_id", "left").join(roots, "module_id", "left")
            .select("module_id", "project_id", z("file_count"), z("lines_of_code"),
                    z("directory_count"), z("child_module_count"),
                    z("combined_code_token_count"), z("combined_analysis_token_count")))
