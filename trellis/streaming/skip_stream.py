"""Idempotent skip as a stream: what is fresh is not analysed again, yet a skipped file still tells so.

Events name an entity of a level. A stream-static join with the current state (the entities that are
fresh now, by the rules of ``operators.analyze``) decides:

* not fresh, or unknown: a request on the ``analyze`` topic;
* a fresh file: its event on the ``analyzed`` topic at once, so that the barriers behind it go on;
* fresh entities of the other levels: nothing.

Replays within ``replay_window`` of an event's first arrival are dropped (arrival time, so no event is late); the dedup
state of older events is released. The sink is a file sink: each row appears once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

LEVEL_EVENT = T.StructType([T.StructField("level", T.StringType()), T.StructField("entity_id", T.StringType())])


def skip_stream(events: DataFrame, fresh: DataFrame, sink: str, checkpoint: str, replay_window: str = "1 day") -> StreamingQuery:
    """``events`` is a stream of ``LEVEL_EVENT``; ``fresh (level, entity_id)`` holds what is fresh, one row each."""
    first = (events.where("level IS NOT NULL AND entity_id IS NOT NULL").withColumn("arrived", F.current_timestamp())
             .withWatermark("arrived", replay_window).dropDuplicatesWithinWatermark(["level", "entity_id"]))
    known = first.join(fresh.select("level", "entity_id", F.lit(True).alias("fresh")), ["level", "entity_id"], "left")
    topic = F.when(F.col("fresh").isNull(), "analyze").when(F.col("level") == "file", "analyzed")
    routed = known.select("level", "entity_id", topic.alias("topic")).where("topic IS NOT NULL")
    return (routed.writeStream.outputMode("append").format("parquet").partitionBy("topic").option("path", sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
