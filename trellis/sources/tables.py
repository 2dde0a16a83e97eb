"""Readers for the provided parquet tables.

Each reader returns a lazy DataFrame; Catalyst prunes columns and pushes
filters into the parquet scan, so callers select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def point_read(spark: SparkSession, sf_dir: str, name: str, condition, newest_by: str | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """``find`` / ``findOne``: filter pushed into the parquet scan, optional newest-first pick.

    With ``newest_by`` the single newest matching row is returned (``orderBy desc + limit 1``,
    planned as a top-k, so only one row per task reaches the final merge).
    """
    df = read_table(spark, sf_dir, name).where(condition)
    if columns:
        df = df.select(*columns)
    if newest_by:
        from pyspark.sql import functions as F
        df = df.orderBy(F.col(newest_by).desc()).limit(1)
    return df
