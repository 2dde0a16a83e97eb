"""Metric rollups, path predicates and per-file counts over the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import paths
from trellis.operators import metrics
from trellis.plans.corpus_views import code_corpus, file_level
from trellis.plans.oracle_base import with_vc
from trellis.plans.registry import register
from trellis.sources.tables import read_table
from trellis.session import size_checked_broadcast


def _levels(spark, sf_dir):
    c = code_corpus(spark, sf_dir)
    pm = metrics.package_metrics(file_level(c.text_files), c.packages)
    mm = metrics.module_metrics(pm, c.modules)
    prm = metrics.project_metrics(mm, c.projects)
    return pm, mm, prm


@register("project_rollup", lambda: with_vc("SELECT * FROM prm", metrics=True))
def project_rollup(spark, sf_dir):
    """Files, lines and tokens per project, rolled up package → module → project."""
    return _levels(spark, sf_dir)[2]


@register("package_metrics", lambda: with_vc("SELECT * FROM pm", metrics=True))
def package_metrics(spark, sf_dir):
    return _levels(spark, sf_dir)[0]


@register("module_metrics", lambda: with_vc("SELECT * FROM mm", metrics=True))
def module_metrics(spark, sf_dir):
    return _levels(spark, sf_dir)[1]


@register("project_metrics", lambda: with_vc("SELECT * FROM prm", metrics=True))
def project_metrics(spark, sf_dir):
    return _levels(spark, sf_dir)[2]


RELATIONAL_SQL = """
WITH vr AS (
  SELECT o.o_orderkey AS file_id, c.c_custkey AS package_id, n.n_nationkey AS module_id,
         r.r_regionkey AS project_id, count(l.l_orderkey) AS lines_of_code
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2, 3, 4)
SELECT project_id::BIGINT AS project_id, count(DISTINCT module_id)::BIGINT AS module_count,
  count(DISTINCT package_id)::BIGINT AS package_count, count(*)::BIGINT AS file_count,
  sum(lines_of_code)::BIGINT AS lines_of_code
FROM vr GROUP BY project_id"""


@register("relational_rollup", RELATIONAL_SQL)
def relational_rollup(spark, sf_dir):
    """Region → nation → customer → order rollup of lineitem rows.

    Plan: lineitem is reduced to one row per order before it meets orders;
    orders are reduced to one row per customer before they meet customer;
    nation and region are size-checked broadcasts. The only full-size
    shuffles are lineitem→order-key and orders→customer-key, both with
    map-side partial aggregation, so a hot customer or region never lands
    whole in one task.
    """
    li = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_lines")))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per_order = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    per_customer = (per_order.groupBy("o_custkey")
                    .agg(F.count(F.lit(1)).alias("file_count"),
                         F.sum(F.coalesce("n_lines", F.lit(0))).alias("lines_of_code")))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = size_checked_broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    r = size_checked_broadcast(read_table(spark, sf_dir, "region").select("r_regionkey"))
    packages = (per_customer.join(c, per_customer.o_custkey == c.c_custkey)
                .join(n, F.col("c_nationkey") == n.n_nationkey)
                .join(r, F.col("n_regionkey") == r.r_regionkey)
                .select(F.col("c_custkey").alias("package_id"),
                        F.col("n_nationkey").alias("module_id"),
                        F.col("r_regionkey").cast("bigint").alias("project_id"),
                        "file_count", "lines_of_code"))
    modules = (packages.groupBy("module_id", "project_id")
               .agg(F.count(F.lit(1)).alias("package_count"),
                    F.sum("file_count").alias("file_count"),
                    F.sum("lines_of_code").alias("lines_of_code")))
    return (modules.groupBy("project_id")
            .agg(F.count(F.lit(1)).cast("bigint").alias("module_count"),
                 F.sum("package_count").cast("bigint").alias("package_count"),
                 F.sum("file_count").cast("bigint").alias("file_count"),
                 F.sum("lines_of_code").cast("bigint").alias("lines_of_code")))


@register("valid_source_files", lambda: with_vc("""
SELECT file_id, file_path, file_type,
  CASE WHEN len(string_split(file_path, '/')) >= 2
       THEN string_split(file_path, '/')[-2] ELSE '' END AS dir_package,
  string_split(file_path, '/')[-1] AS file_name
FROM vc WHERE is_valid"""))
def valid_source_files(spark, sf_dir):
    """Files passing the supported-suffix test and the test/target exclusion."""
    f = code_corpus(spark, sf_dir).files
    return (f.where(paths.is_valid_source_file("file_path"))
            .select("file_id", "file_path", "file_type",
                    paths.parent_dir_name("file_path").alias("dir_package"),
                    paths.basename("file_path").alias("file_name")))


@register("file_type_counts", lambda: with_vc("""
SELECT file_type, is_source, is_valid, count(*)::BIGINT AS file_count
FROM (SELECT file_type, regexp_matches(file_path, '\\.(java|scala|js|ts|tsx|py|cpp|hs)$') AS is_source,
        is_valid FROM vc) t
GROUP BY 1, 2, 3"""))
def file_type_counts(spark, sf_dir):
    f = code_corpus(spark, sf_dir).files
    return (f.groupBy("file_type", paths.is_source_file("file_path").alias("is_source"), "is_valid")
            .agg(F.count(F.lit(1)).alias("file_count")))


@register("line_counts", lambda: with_vc("SELECT file_id, lines_of_code FROM vc"))
def line_counts(spark, sf_dir):
    return code_corpus(spark, sf_dir).text_files.select("file_id", "lines_of_code")


@register("token_counts", lambda: with_vc(
    "SELECT file_id, code_token_count, analysis_token_count FROM vc"))
def token_counts(spark, sf_dir):
    return code_corpus(spark, sf_dir).text_files.select("file_id", "code_token_count", "analysis_token_count")


@register("token_summary", lambda: with_vc("""
SELECT project_id, count(*)::BIGINT AS n_files,
  sum(code_token_count)::BIGINT AS code_tokens, max(code_token_count)::BIGINT AS max_code_tokens,
  sum(analysis_token_count)::BIGINT AS analysis_tokens,
  max(analysis_token_count)::BIGINT AS max_analysis_tokens,
  sum(lines_of_code)::BIGINT AS lines
FROM vc GROUP BY project_id"""))
def token_summary(spark, sf_dir):
    """Distribution summary of token counts per project (count, sum, max)."""
    f = code_corpus(spark, sf_dir).text_files
    return (f.groupBy("project_id")
            .agg(F.count(F.lit(1)).alias("n_files"),
                 F.sum("code_token_count").alias("code_tokens"),
                 F.max("code_token_count").alias("max_code_tokens"),
                 F.sum("analysis_token_count").alias("analysis_tokens"),
                 F.max("analysis_token_count").alias("max_analysis_tokens"),
                 F.sum("lines_of_code").alias("lines")))
