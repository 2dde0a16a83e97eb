"""Event-in / metrics-out: file events give running package, module and project metrics.

The stream drops replays of file events by id within ``replay_window`` of their first arrival (by arrival
time, so no event is late and lost, and the dedup state of older events is released), counts each
file towards its package, module and project, and keeps one running aggregate
per level and id in Spark's state store (update mode: only touched keys are
emitted per micro-batch). ``foreachBatch`` appends one metrics snapshot per
touched key plus an analysed event to a second topic: one input, two topics,
written together by ``partitionBy("topic")``. The newest snapshot per key equals
the batch metrics. State: one entry per file of the last ``replay_window`` and one row per key. A batch
that is run again replaces its own folder, so no snapshot or event is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.streaming.topics import read_batches, write_batch

FILE_SCANNED = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("package_id", T.StringType()),
    T.StructField("module_id", T.StringType()),
    T.StructField("project_id", T.StringType()),
    T.StructField("lines_of_code", T.LongType()),
    T.StructField("code_token_count", T.LongType()),
    T.StructField("analysis_token_count", T.LongType()),
])
LEVELS = ("package", "module", "project")
KEY = ["level", "entity_id"]
SUMS = ["file_count", "lines_of_code", "files_analysis_token_count", "code_token_count"]


def metrics_stream(events: DataFrame, out_dir: str, checkpoint_dir: str, levels=LEVELS, replay_window: str = "1 day"):
    keys = F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"{x}_id").alias("entity_id")) for x in levels])
    running = (events.where(F.col("file_id").isNotNull())
               .withColumn("arrived", F.current_timestamp()).withWatermark("arrived", replay_window).dropDuplicatesWithinWatermark(["file_id"])
               .select("*", F.explode(keys).alias("k")).where(F.col("k.entity_id").isNotNull())
               .groupBy(F.col("k.level").alias("level"), F.col("k.entity_id").alias("entity_id"))
               .agg(F.count(F.lit(1)).alias("file_count"),
                    F.sum("lines_of_code").alias("lines_of_code"),
                    F.sum("analysis_token_count").alias("files_analysis_token_count"),
                    F.sum("code_token_count").alias("code_token_count")))

    def emit(batch: DataFrame, batch_id: int) -> None:
        snap = F.struct(*KEY, *SUMS)
        event = F.struct(*KEY, *[F.lit(None).cast("bigint").alias(c) for c in SUMS])
        fan = batch.select(F.explode(F.array(
            F.struct(F.lit("metrics").alias("topic"), snap.alias("r")),
            F.struct(F.lit("analyzed_events").alias("topic"), event.alias("r")))).alias("m"))
        write_batch(fan.select("m.topic", "m.r.*"), out_dir, batch_id, ["topic"])

    return (running.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start())


def latest_metrics(spark, out_dir: str) -> DataFrame:
    """Newest snapshot per level and id from the metrics topic."""
    snaps = read_batches(spark, out_dir).where(F.col("topic") == "metrics")
    return (snaps.groupBy(*KEY).agg(F.max_by(F.struct(*SUMS), "batch_id").alias("s"))
            .select(*KEY, *[F.col(f"s.{c}").alias(c) for c in SUMS]))
