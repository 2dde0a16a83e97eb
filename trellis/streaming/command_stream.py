"""Import-command stream: JSON text in, parsed commands and a quarantine out.

Commands arrive as text lines in a topic folder. Each micro-batch is parsed
with the command patterns; good rows and quarantined rows (with their reason)
go to two sinks by one ``foreachBatch``, so a bad row never stops the
stream; a batch that is run again replaces its own rows in both. The stream keeps no state and drops no row, however late: a replay (the
same body again) is resolved by the read view, which keeps its first event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import path_exists
from trellis.sources.commands import parse_commands
from trellis.streaming.topics import read_batches, write_batch


def command_stream(lines: DataFrame, as_of_ms: int, good_dir: str, bad_dir: str, checkpoint_dir: str):
    """``lines`` is a streaming frame with ``event_id``, ``ts`` and ``body``."""
    parsed = parse_commands(lines, "body", F.lit(as_of_ms).cast("bigint"))

    def route(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.where(F.col("status") == "ok"), good_dir, batch_id)
        write_batch(batch.where(F.col("status") != "ok"), bad_dir, batch_id)

    return (parsed.writeStream.option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).foreachBatch(route).start())


def read_routed(spark, good_dir: str, bad_dir: str) -> DataFrame | None:
    """Both sinks, one row per command body: replays collapse to the first event.

    A sink without rows has no folder; any other read error is raised. None before the first batch.
    """
    frames = [read_batches(spark, d) for d in (good_dir, bad_dir) if path_exists(spark, d)]
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    rest = [c for c in out.columns if c not in ("body", "event_id")]
    return (out.groupBy("body").agg(F.min(F.struct("event_id", *rest)).alias("r"))
            .select("body", "r.*"))
