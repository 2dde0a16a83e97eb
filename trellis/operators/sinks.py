"""Table writes: append, keyed update, replace-upsert, export with cached copy, command batches.

Plain parquet has no ``MERGE``; updates are expressed as joins and written
as a new version of the table (write to a fresh folder, then readers switch
to it), and per-key replacement uses dynamic partition overwrite, which
replaces only the partitions present in the written data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.analyze import apply_patch
from trellis.operators.summaries import DIGEST_ORDER


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_version(df: DataFrame, base: str, version: int) -> str:
    """Write a full new version of a table; returns its folder (readers move to it)."""
    path = f"{base.rstrip('/')}/v{version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def keyed_update(spark, base_path: str, patch: DataFrame, key: list[str], cols: list[str],
                 out_base: str, version: int, newest_by: str | None = None) -> str:
    """``$set`` of ``cols`` by ``key`` as a new table version (the old version stays readable)."""
    base = spark.read.parquet(base_path)
    return write_version(apply_patch(base, patch, key, cols, newest_by), out_base, version)


def replace_upsert(df: DataFrame, path: str, key: str) -> None:
    """Replace every row of the keys present in ``df``; other keys stay (partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).parquet(path))


def export_context(blocks: DataFrame, cached: DataFrame | None) -> DataFrame:
    """Digest per project: the cached copy when a non-empty one exists, else the rendered blocks.

    ``cached`` has ``project_id, context``; the result keeps the block layout,
    a cached project contributing a single block.
    """
    if cached is None:
        return blocks
    cached = cached.where(F.coalesce(F.col("context"), F.lit("")) != "")
    cached_blocks = cached.select(
        "project_id", F.lit("").alias("module_key"), F.lit("").alias("package_key"),
        F.lit("").alias("file_key"), F.lit(-1).cast("bigint").alias("file_id"), F.col("context").alias("block"))
    fresh = blocks.join(cached.select("project_id"), "project_id", "left_anti")
    return cached_blocks.unionByName(fresh).select("project_id", *DIGEST_ORDER[1:], "block")


def analyze_commands(modules: DataFrame, project_ids: DataFrame, as_of_ms: int) -> DataFrame:
    """One analyze-module command per module of the requested projects."""
    return (modules.join(project_ids.select("project_id").distinct(), "project_id", "left_semi")
            .select("module_id", "project_id", F.lit(as_of_ms).cast("bigint").alias("timestamp")))
