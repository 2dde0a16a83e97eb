"""Topic directories, run folders and stream drivers.

Topics are directories of parquet files in the shared storage the cluster
names in ``spark.checkpoint.dir`` (never a machine-local folder). Each run
gets its own sub-folder, so checkpoints, topics and sinks of different runs
never collide and a restarted run resumes from its own checkpoint. A finished
run's topics and checkpoints go with ``release``; its sinks stay until
``release_runs``.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trellis.session import ensure_checkpoint_dir, remove_path


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_stores(spark: SparkSession):
    """Queries started inside keep keyed state in RocksDB (off-heap and spillable), one store per core of the cluster.

    The session's own settings come back afterwards.
    """
    ours = {"spark.sql.shuffle.partitions": str(max(spark.sparkContext.defaultParallelism, 1)),
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER}
    old = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_RUNS: list[str] = []


def run_folder(spark: SparkSession, name: str, run_id: str | None = None) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/trellis-runs/{name}/{run_id or uuid.uuid4().hex}"
    _RUNS.append(run)
    return run


def release(spark: SparkSession, run: str) -> None:
    """Delete the topics and checkpoints of a finished run (its sinks and static sides stay readable)."""
    for part in ("topics", "checkpoints"):
        remove_path(spark, f"{run}/{part}")


def release_runs(spark: SparkSession) -> None:
    """Delete every run folder this process made; frames over their sinks can no longer be read."""
    while _RUNS:
        remove_path(spark, _RUNS.pop())


def publish(df: DataFrame, topic_dir: str) -> None:
    """Append records to a topic directory, one file per task, as the rows are partitioned."""
    df.write.mode("append").parquet(topic_dir)


def subscribe(spark: SparkSession, topic_dir: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of a topic: explicit schema, bounded files per micro-batch (default: two per core)."""
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger or 2 * max(spark.sparkContext.defaultParallelism, 1))
            .parquet(topic_dir))


BATCH = "batch_id"


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: list[str] | None = None) -> None:
    """A micro-batch's rows in a folder of its own: a batch that is run again replaces what it wrote before."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``write_batch`` wrote, each once, with their ``batch_id``."""
    return spark.read.option("basePath", path).parquet(path).withColumn(BATCH, F.col(BATCH).cast("bigint"))


def drain(query: StreamingQuery, timeout_s: int | None = None) -> None:
    """Wait for an ``availableNow`` query to finish; surface its failure. No limit unless the caller sets one."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream {query.name} did not finish in {timeout_s}s")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def subscribe_kafka(spark: SparkSession, servers: str, topic: str, schema,
                    max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Typed events from a Kafka topic whose values are JSON records of ``schema``.

    Needs the Kafka connector on the cluster's classpath (it is not part of
    this installation); the folder-backed ``subscribe`` is the default.
    ``maxOffsetsPerTrigger`` bounds each micro-batch like ``maxFilesPerTrigger``.
    """
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic)
              .option("startingOffsets", "earliest"))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    raw = reader.load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e"),
                      F.col("partition"), F.col("offset")).select("e.*", "partition", "offset")
