"""Completeness barriers in closed form (batch side).

A package is ready when every file in its subtree is analysed (its own
files and, recursively, its child packages' files); a module when every
file under it is analysed and every root package has a stored summary ('' is
one: a singleton package's empty summary is finished); a project when every file
under it is analysed and every module has a non-empty summary.

Files are counted per directory first; each distinct directory is exploded to
the existing packages on its ancestor path (bounded by depth) and the counts
are summed. There is no counter that can pass zero early, and replays or
reorderings give the same answer. Frames of files carry a boolean ``analysed``,
so no barrier reads a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions import paths


def directory_counts(files: DataFrame) -> DataFrame:
    """Files and analysed files per (module, directory)."""
    return files.groupBy("module_id", "dir").agg(F.count(F.lit(1)).alias("n"), F.count_if("analysed").alias("done"))


def subtree_counts(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(package_id, subtree_files, done_files) of packages with files below them."""
    ex = directory_counts(files).select("module_id", "n", "done", F.explode(paths.ancestors("dir")).alias("dir"))
    return (ex.join(packages.select("package_id", "module_id", "dir"), ["module_id", "dir"])
            .groupBy("package_id").agg(F.sum("n").alias("subtree_files"), F.sum("done").alias("done_files")))


def package_ready(files: DataFrame, packages: DataFrame) -> DataFrame:
    agg = subtree_counts(files, packages)
    return (packages.select("package_id", "module_id").join(agg, "package_id", "left")
            .select("package_id", "module_id",
                    F.coalesce("subtree_files", F.lit(0)).cast("bigint").alias("subtree_files"),
                    F.coalesce("done_files", F.lit(0)).cast("bigint").alias("done_files"))
            .withColumn("ready", F.col("done_files") == F.col("subtree_files")))


def _file_counts(files: DataFrame, key: str) -> DataFrame:
    return files.groupBy(key).agg(F.count(F.lit(1)).alias("n_files"), F.count_if("analysed").alias("done_files"))


def _ready(df: DataFrame, key: list[str], parts: str, done_parts: str) -> DataFrame:
    cols = ["n_files", "done_files", parts, done_parts]
    return (df.select(*key, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in cols])
            .withColumn("ready", (F.col("n_files") == F.col("done_files")) & (F.col(parts) == F.col(done_parts))))


def module_ready(files: DataFrame, packages: DataFrame, modules: DataFrame) -> DataFrame:
    roots = (packages.where(F.col("parent_package_id").isNull()).groupBy("module_id")
             .agg(F.count(F.lit(1)).alias("n_roots"), F.count_if(F.col("analysis").isNotNull()).alias("done_roots")))
    return _ready(modules.select("module_id", "project_id").join(_file_counts(files, "module_id"), "module_id", "left")
                  .join(roots, "module_id", "left"), ["module_id", "project_id"], "n_roots", "done_roots")


def project_ready(files: DataFrame, modules: DataFrame, projects: DataFrame) -> DataFrame:
    """A project without modules is ready."""
    mods = (modules.groupBy("project_id")
            .agg(F.count(F.lit(1)).alias("n_modules"), F.count_if(F.coalesce("analysis", F.lit("")) != "").alias("done_modules")))
    return _ready(projects.select("project_id").join(_file_counts(files, "project_id"), "project_id", "left")
                  .join(mods, "project_id", "left"), ["project_id"], "n_modules", "done_modules")


def unfinished_children(packages: DataFrame) -> DataFrame:
    """Per package: child packages still without analysis (the anti-join form of the barrier)."""
    kids = packages.where(F.col("parent_package_id").isNotNull()).select(
        F.col("parent_package_id").alias("package_id"), F.col("analysis").isNull().alias("open"))
    agg = kids.groupBy("package_id").agg(F.count_if("open").alias("open_children"))
    return (packages.select("package_id").join(agg, "package_id", "left")
            .withColumn("open_children", F.coalesce("open_children", F.lit(0)).cast("bigint")))
