"""Helpers shared by the operators: session preparation, row keys, skew-safe lookups, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.session import cut_lineage, ensure_checkpoint_dir, ship_package

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A broadcast lookup never holds more rows than this; longer tables go through a shuffle join.
MAX_BROADCAST_ROWS = 200_000
MAX_HEAVY_KEYS = 10_000
LEAST_HEAVY = 64


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers and make sure a checkpoint folder is set."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (a one-element ``transform``)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_row_key(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with two bigint columns that identify a row across scans, and their names.

    File scans use the file path and the row's place in the file, which do not
    depend on how the scan is split. Other frames are checkpointed first, so
    that their partitions and row order are fixed.
    """
    keys = ["__row_f", "__row_i"]
    try:
        out = df.withColumns({keys[0]: F.xxhash64("_metadata.file_path"), keys[1]: F.col("_metadata.row_index")})
        out.schema  # resolves
        return out, keys
    except AnalysisException:
        fixed = cut_lineage(df)
        return fixed.withColumns({keys[0]: F.lit(0).cast("bigint"), keys[1]: F.monotonically_increasing_id()}), keys


def small_side(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the (already materialised) frame holds at most ``limit`` rows, else no hint."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def without_rows(df: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose row key is not in ``dropped`` (materialised, unique keys)."""
    return df.join(small_side(dropped.select(*keys)), keys, "left_anti")


def spread_lookup(rows: DataFrame, groups: DataFrame, key: list[str], n_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to their group's row without a hot key in the shuffle.

    ``groups`` has one row per key and counts its rows in ``n_col``. Keys with
    more than ``t = max(64, total / 10000)`` rows are fewer than ``total / t``,
    so at most 10,000: they are broadcast. The rest are joined by
    shuffle with at most ``t`` rows a key. Both frames must be materialised.
    """
    t = max(LEAST_HEAVY, total // MAX_HEAVY_KEYS)
    heavy, light = groups.where(F.col(n_col) > t), groups.where(F.col(n_col) <= t)
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(light, key)
    return hot.unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: one row ``(node, root)`` per linked node.

    Large-star and small-star rounds (Kiveris et al. 2014) until the links no
    longer change. ``root`` is the smallest node of the component. Each round
    is a grouping and a join on the node; its links are checkpointed, so a lost
    executor repeats one round at most. No links give no rows.
    """
    links = (edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
             .where("v <> u").distinct())
    links = cut_lineage(links)
    state = None
    while True:
        # large star: the larger neighbours of each node go to its smallest neighbour
        both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
            links.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = (both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
                 .where("v <> u").distinct())
        # small star: the smaller neighbours and the node itself go to the smallest
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = (large.join(least, "v")
                 .select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u"))
                 .where("v <> u").distinct())
        links = cut_lineage(moved)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            break
        state = tuple(now)
    stars = links.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
