"""Streaming status feed: each import's updates up to its first terminal state, in any arrival order.

Two streams over one topic, both without user state code:

* every update is appended to the feed sink;
* the earliest terminal update of each import is a running ``min(ts, seq)`` (update mode): one
  small state row per finished import, and a batch's changed rows go to its own folder of the stop sink.

The order lies in the compared ``(ts, seq)``, not in the arrival of files, so an update that comes after a
later terminal one is still placed rightly. ``read_feed`` joins the two sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.status import TERMINAL
from trellis.session import path_exists
from trellis.streaming.topics import read_batches, write_batch


def feed_stream(updates: DataFrame, feed_dir: str, checkpoint_dir: str):
    return (updates.where(F.col("import_id").isNotNull()).writeStream.outputMode("append").format("parquet")
            .option("path", feed_dir).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


def stop_stream(updates: DataFrame, stop_dir: str, checkpoint_dir: str):
    stops = (updates.where(F.col("status").isin(*TERMINAL) & F.col("import_id").isNotNull())
             .groupBy("import_id").agg(F.min(F.struct("ts", "seq")).alias("stop")))

    def emit(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, stop_dir, batch_id)

    return (stops.writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).foreachBatch(emit).start())


def read_feed(spark, feed_dir: str, stop_dir: str) -> DataFrame:
    """Updates up to and with the first terminal one of each import."""
    feed = spark.read.parquet(feed_dir)
    if not path_exists(spark, stop_dir):
        return feed
    stops = read_batches(spark, stop_dir).groupBy("import_id").agg(F.min("stop").alias("stop"))
    j = feed.join(stops, "import_id", "left")
    return j.where(F.col("stop").isNull() | (F.struct("ts", "seq") <= F.col("stop"))).drop("stop")
