"""Hierarchical metrics: package → module → project (level-wise partial aggregation).

Each level aggregates the level below (never the raw files again), so the
shuffle at every step carries one partial-aggregate row per key and task;
a hot project or package only lengthens the map-side combine, not a reducer.
Levels without children get an explicit zero row via a left join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _z(c: str):
    return F.coalesce(F.col(c), F.lit(0)).cast("bigint")


def package_metrics(files: DataFrame, packages: DataFrame) -> DataFrame:
    """File count, lines, analysis and code tokens per package; combined = own + files."""
    fm = (files.groupBy("package_id")
          .agg(F.count(F.lit(1)).alias("file_count"),
               F.sum("lines_of_code").alias("lines_of_code"),
               F.sum("analysis_token_count").alias("files_analysis_token_count"),
               F.sum("code_token_count").alias("code_token_count")))
    own = packages.select("package_id", "module_id", "project_id",
                          F.coalesce(F.col("analysis_token_count"), F.lit(0)).cast("bigint")
                          .alias("package_analysis_token_count"))
    return (own.join(fm, "package_id", "left")
            .select("package_id", "module_id", "project_id",
                    _z("file_count").alias("file_count"),
                    _z("lines_of_code").alias("lines_of_code"),
                    F.col("package_analysis_token_count"),
                    (F.col("package_analysis_token_count") + _z("files_analysis_token_count"))
                    .alias("combined_analysis_token_count"),
                    _z("code_token_count").alias("code_token_count")))


def module_metrics(pkg_metrics: DataFrame, modules: DataFrame) -> DataFrame:
    """Package count and sums over package metrics; combined = own + packages."""
    agg = (pkg_metrics.groupBy("module_id")
           .agg(F.count(F.lit(1)).alias("package_count"),
                F.sum("file_count").alias("file_count"),
                F.sum("lines_of_code").alias("lines_of_code"),
                F.sum("combined_analysis_token_count").alias("packages_combined"),
                F.sum("code_token_count").alias("combined_code_token_count")))
    own = modules.select("module_id", "project_id",
                         F.coalesce(F.col("analysis_token_count"), F.lit(0)).cast("bigint").alias("own"))
    return (own.join(agg, "module_id", "left")
            .select("module_id", "project_id",
                    _z("package_count").alias("package_count"),
                    _z("file_count").alias("file_count"),
                    _z("lines_of_code").alias("lines_of_code"),
                    (F.col("own") + _z("packages_combined")).alias("combined_analysis_token_count"),
                    _z("combined_code_token_count").alias("combined_code_token_count")))


def project_metrics(mod_metrics: DataFrame, projects: DataFrame) -> DataFrame:
    """Module count and sums over module metrics; combined = own + modules."""
    agg = (mod_metrics.groupBy("project_id")
           .agg(F.count(F.lit(1)).alias("module_count"),
                F.sum("package_count").alias("package_count"),
                F.sum("file_count").alias("file_count"),
                F.sum("lines_of_code").alias("lines_of_code"),
                F.sum("combined_analysis_token_count").alias("modules_combined"),
                F.sum("combined_code_token_count").alias("combined_code_token_count")))
    own = projects.select("project_id",
                          F.coalesce(F.col("analysis_token_count"), F.lit(0)).cast("bigint").alias("own"))
    return (own.join(agg, "project_id", "left")
            .select("project_id",
                    _z("module_count").alias("module_count"),
                    _z("package_count").alias("package_count"),
                    _z("file_count").alias("file_count"),
                    _z("lines_of_code").alias("lines_of_code"),
                    (F.col("own") + _z("modules_combined")).alias("combined_analysis_token_count"),
                    _z("combined_code_token_count").alias("combined_code_token_count")))


def count_rollup(files: DataFrame, levels: list[str], measure: str = "lines_of_code") -> DataFrame:
    """Level-wise count/sum chain for a plain id hierarchy (the relational corpus).

    ``levels`` is ordered leaf-parent first, e.g. ``[package_id, module_id,
    project_id]``; the result has one row per top-level key with the number of
    distinct keys of every lower level, the file count and the measure sum.
    Each step groups the previous (already reduced) step.
    """
    cur = (files.groupBy(*levels)
           .agg(F.count(F.lit(1)).alias("file_count"), F.sum(measure).alias(measure)))
    counts = ["file_count", measure]
    for i, lvl in enumerate(levels[:-1]):
        name = lvl.replace("_id", "") + "_count"
        keep = levels[i + 1:]
        aggs = [F.count(F.lit(1)).alias(name)] + [F.sum(c).alias(c) for c in counts]
        cur = cur.groupBy(*keep).agg(*aggs)
        counts = [name] + counts
    return cur.select(levels[-1], *[F.col(c).cast("bigint").alias(c) for c in counts])


def token_distribution(files: DataFrame, key: str = "project_id", col: str = "code_token_count",
                       accuracy: int = 10000) -> DataFrame:
    """Count, sum, max and approximate p50/p90/p99 of a token count per key.

    ``percentile_approx`` keeps a bounded sketch per group (exact percentiles
    would hold every distinct value of a hot group in one buffer).
    """
    return (files.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(col).alias("total"), F.max(col).alias("max"),
                 F.percentile_approx(col, [0.5, 0.9, 0.99], accuracy).alias("p")))


def nest_packages(modules: DataFrame, packages: DataFrame, package_metrics: DataFrame) -> DataFrame:
    """``module_id, module_name, packages``: packages with their metrics as an array ordered by id.

    One array per module: the number of packages of one module, not of files. A module
    without packages has an empty array.
    """
    p = (packages.select("module_id", "package_id", "package_name")
         .join(package_metrics.select("package_id", "file_count", "lines_of_code"), "package_id", "left"))
    kids = p.groupBy("module_id").agg(F.array_sort(F.collect_list(
        F.struct("package_id", "package_name", "file_count", "lines_of_code"))).alias("packages"))
    j = modules.select("module_id", "module_name").join(kids, "module_id", "left")
    none = F.array().cast(kids.schema["packages"].dataType)
    return j.withColumn("packages", F.coalesce("packages", none))
