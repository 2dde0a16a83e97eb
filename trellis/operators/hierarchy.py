"""Directory-tree operators in closed form (no recursion, no feedback loop).

The reference walks directories recursively and re-publishes a scan
command per child directory. Here every file is exploded once to its
ancestor directories (bounded by path depth) and the questions become
grouped aggregates and equi-joins:

* subtree existence (any valid file below a directory) → ``bool_or`` per
  (key, directory), partially aggregated before the shuffle;
* child-directory counts → group the qualifying directories by their parent;
* nearest ancestor that is itself a node → ancestor explode + inner join to
  the node set + ``max_by(depth)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions import paths


def explode_ancestors(df: DataFrame, dir_col: str, keep: list[str]) -> DataFrame:
    """One row per (input row, ancestor-or-self directory); depth is 1-based."""
    return (df.select(*keep, F.posexplode(paths.ancestors(dir_col)).alias("pos", "anc_dir"),
                      paths.depth(dir_col).alias("self_depth"))
            .select(*keep, "anc_dir", (F.col("pos") + 1).alias("anc_depth"),
                    (F.col("pos") + 1 == F.col("self_depth")).alias("is_self")))


def subtree_flags(files: DataFrame, key: list[str], dir_col: str, flag_col: str) -> DataFrame:
    """Per (key, directory): does any file in the subtree satisfy ``flag_col``; file counts."""
    ex = explode_ancestors(files, dir_col, key + [flag_col])
    return (ex.groupBy(*key, F.col("anc_dir").alias("dir"), F.col("anc_depth").alias("depth"))
            .agg(F.bool_or(flag_col).alias("has_source"),
                 F.count(F.lit(1)).alias("subtree_files"),
                 F.count_if(F.col(flag_col)).alias("subtree_valid_files")))


def child_dir_counts(flags: DataFrame, key: list[str]) -> DataFrame:
    """Number of direct child directories whose subtree has a valid file."""
    kids = (flags.where(F.col("has_source") & (F.col("depth") > 1))
            .select(*key, paths.dirname("dir").alias("parent"), "dir"))
    counts = (kids.groupBy(*key, "parent").agg(F.count(F.lit(1)).alias("child_dirs")))
    base = flags.select(*key, "dir", "has_source")
    cond = [base[k] == counts[k] for k in key] + [base["dir"] == counts["parent"]]
    return (base.join(counts, cond, "left")
            .select(*[base[k] for k in key], base["dir"], base["has_source"],
                    F.coalesce(counts["child_dirs"], F.lit(0)).cast("bigint").alias("child_dirs")))


def nearest_ancestor(nodes: DataFrame, key: list[str], dir_col: str) -> DataFrame:
    """Attach ``parent_dir``: the closest proper ancestor directory that is also a node."""
    ex = (explode_ancestors(nodes.select(*key, dir_col), dir_col, key + [dir_col])
          .where(~F.col("is_self")))
    cand = nodes.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(dir_col).alias("__cand"))
    cond = [ex[k] == cand[f"__{k}"] for k in key] + [ex["anc_dir"] == cand["__cand"]]
    parent = (ex.join(cand, cond)
              .groupBy(*key, dir_col)
              .agg(F.max_by("anc_dir", "anc_depth").alias("parent_dir")))
    return nodes.join(parent, key + [dir_col], "left")


def child_counts(tree: DataFrame, key: list[str], dir_col: str) -> DataFrame:
    """Attach ``child_count``: number of nodes whose parent is this node."""
    kids = (tree.where(F.col("parent_dir").isNotNull())
            .groupBy(*key, "parent_dir").agg(F.count(F.lit(1)).alias("child_count"))
            .withColumnRenamed("parent_dir", dir_col))
    return (tree.join(kids, key + [dir_col], "left")
            .withColumn("child_count", F.coalesce("child_count", F.lit(0)).cast("bigint")))
