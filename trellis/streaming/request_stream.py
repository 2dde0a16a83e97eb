"""Analysis requests: module events and direct commands merged, enriched with their project.

Two streams ask for a project's analysis: modules whose barrier opened, and commands that name a
module directly (no barrier). Both carry only a module id; a stream-static join with the module table
adds the project. Unknown modules go to the quarantine topic. The stream keeps no state;
the read view gives one request per project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.session import size_checked_broadcast

MODULE_EVENT = T.StructType([T.StructField("module_id", T.StringType())])


def request_stream(ready: DataFrame, commands: DataFrame, modules: DataFrame, out_dir: str, checkpoint_dir: str):
    """``ready`` and ``commands`` are streams of ``MODULE_EVENT``; ``modules`` is the static table."""
    asked = (ready.select("module_id", F.lit("barrier").alias("origin"))
             .unionByName(commands.select("module_id", F.lit("command").alias("origin")))
             .where(F.col("module_id").isNotNull()))
    side = size_checked_broadcast(modules.select("module_id", "project_id"))
    enriched = asked.join(side, "module_id", "left")
    routed = enriched.withColumn("topic", F.when(F.col("project_id").isNull(), "quarantine").otherwise("analyze_project"))
    return (routed.writeStream.outputMode("append").format("parquet").partitionBy("topic")
            .option("path", out_dir).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def project_requests(spark, out_dir: str) -> DataFrame:
    """One row per asked project: distinct modules asked by either origin."""
    r = spark.read.parquet(out_dir).where(F.col("topic") == "analyze_project")
    return r.groupBy("project_id").agg(F.countDistinct("module_id").alias("n_modules"),
                                       F.countDistinct(F.when(F.col("origin") == "command", F.col("module_id"))).alias("n_commanded"))
