"""Typed events from append-only record logs: a streaming data source with byte offsets per log file.

A topic is a folder of log files, one JSON record a line; files may be added and may grow. The source
(``spark.readStream.format("record_log")``) gives the raw records with their place:

* an offset is the number of bytes read of every file, always up to a line end, so a record that is
  still being written waits for the next batch;
* a batch is cut into byte ranges of at most ``rangeBytes``, each read by a task of its own. A record
  belongs to the range in which it starts, so a single large log is read by many tasks;
* at most about ``maxBytesPerTrigger`` are taken a batch, dealt evenly over the files that have more. The source is not told
  where a restarted query stands, so the limit needs a ``group``: the offsets it plans are noted
  first and never go back. (A query with ``availableNow`` is one batch: give it no limit.)
* ``commit`` notes the offsets of a finished batch in ``<folder>/_offsets/<group>.done.json`` for ``lag`` (the engine calls it
  when the next batch begins). The
  checkpoint of the query, not this note, decides where a restarted query goes on.

``typed`` parses the records on the JVM against the event's schema and sets broken ones aside with a reason. Python
handles byte ranges and line ends only. Files are opened through pyarrow by their URI, on any
file system that it knows, so driver and executors need no common local folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from trellis.sources.tree import _open, _qualified

RAW = "log string, offset bigint, value string"
RANGE_BYTES = 64 << 20
TAIL = 1 << 16
ROWS = 4096


class Range(InputPartition):
    """Bytes ``[start, end)`` of a log."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def line_end(stream, start: int, size: int) -> int:
    """The place after the last line end in ``[start, size)`` of an open file, or ``start``."""
    at = size
    while at > start:
        low = max(start, at - TAIL)
        stream.seek(low)
        found = stream.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return start


def next_line_end(stream, start: int, size: int) -> int:
    """The place after the first line end in ``[start, size)`` of an open file, or ``start``."""
    stream.seek(start)
    at = start
    while at < size:
        chunk = stream.read(min(TAIL, size - at))
        found = chunk.find(b"\n")
        if found >= 0 or not chunk:
            return at + found + 1 if chunk else start
        at += len(chunk)
    return start


def records(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of every line that starts in ``[start, end)``; a last line without an end is one too."""
    at, held = start, []
    stream.seek(max(0, start - 1))
    rest = b""
    if start:  # a line that began before the range is its neighbour's
        passed = 0
        while True:
            chunk = stream.read(TAIL)
            cut = chunk.find(b"\n")
            if cut >= 0:
                at, rest = start + passed + cut, chunk[cut + 1:]
                break
            if not chunk:
                return
            passed += len(chunk)
    while at < end:
        first, *lines = rest.split(b"\n")
        held.append(first)
        for line in lines:
            whole = b"".join(held)
            yield at, whole
            at, held = at + len(whole) + 1, [line]
            if at >= end:
                return
        rest = stream.read(TAIL)
        if not rest:
            whole = b"".join(held)
            if whole:
                yield at, whole
            return


class _Logs:
    def __init__(self, options: dict):
        self.root = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.most = int(options.get("maxBytesPerTrigger", 0))
        self.group = options.get("group", "")

    def sizes(self) -> dict[str, int]:
        from pyarrow.fs import FileSelector, FileType
        system, top = _open(self.root)
        found = system.get_file_info(FileSelector(top, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == FileType.File and f.base_name[0] not in "._"}

    def _note(self, kind: str) -> str:
        return f"{_open(self.root)[1]}/_offsets/{self.group}.{kind}.json"

    def note(self, kind: str) -> dict[str, int]:
        """Offsets that the group has planned or done."""
        from pyarrow.fs import FileType
        system, _ = _open(self.root)
        if system.get_file_info(self._note(kind)).type != FileType.File:
            return {}
        with system.open_input_stream(self._note(kind)) as f:
            return json.loads(f.read())

    def put_note(self, kind: str, offsets: dict[str, int]) -> None:
        system, top = _open(self.root)
        system.create_dir(f"{top}/_offsets", recursive=True)
        temp = f"{top}/_offsets/.{self.group}.{kind}.tmp"
        with system.open_output_stream(temp) as out:
            out.write(json.dumps(offsets).encode())
        system.move(temp, self._note(kind))

    def ranges(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            for low in range(start.get(path, 0), stop, self.range_bytes):
                out.append(Range(path, low, min(stop, low + self.range_bytes)))
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()),
                                               pa.array([r[1].decode("utf-8", "replace") for r in rows], pa.string())], ["log", "offset", "value"])
        if not part.path:
            return
        system, _ = _open(self.root)
        rows = []
        with system.open_input_file(part.path) as stream:
            for row in records(stream, part.start, part.end):
                rows.append(row)
                if len(rows) == ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class RecordLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.logs = _Logs(options)

    def partitions(self) -> list[Range]:
        return self.logs.ranges({}, self.logs.sizes())

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.logs.read(partition)


class RecordLogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.logs = _Logs(options)
        if self.logs.most and not self.logs.group:
            raise ValueError("maxBytesPerTrigger needs a group")
        self.known: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        logs = self.logs
        if self.known is None:
            self.known = logs.note("planned") if logs.most else {}
        grown = {p: n for p, n in logs.sizes().items() if n > self.known.get(p, 0)}
        share = -(-logs.most // len(grown)) if logs.most and grown else 0
        system, _ = _open(logs.root)
        out = dict(self.known)
        for path, size in grown.items():
            low = self.known.get(path, 0)
            with system.open_input_file(path) as stream:
                stop = line_end(stream, low, min(size, low + share) if share else size)
                if stop == low and share:  # a record longer than the share
                    stop = next_line_end(stream, low, size)
            if stop > low:
                out[path] = stop
        if logs.most:
            logs.put_note("planned", out)
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.logs.ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.logs.read(partition)

    def commit(self, end: dict) -> None:
        if self.logs.group:
            self.logs.put_note("done", end)


class RecordLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordLogReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RecordLogStreamReader(self.options)


# ---- use ----

def append_records(df: DataFrame, folder: str) -> None:
    """Add a frame's rows to a topic as JSON records, one new log per task."""
    stamp = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    df.select(F.to_json(F.struct(*df.columns), stamp)).write.mode("append").text(folder)


def _options(spark: SparkSession, folder: str, options: dict) -> dict:
    spark.dataSource.register(RecordLogSource)
    return {"path": _qualified(spark, folder)} | {k: str(v) for k, v in options.items() if v is not None}


def stream_records(spark: SparkSession, folder: str, max_bytes: int | None = None, range_bytes: int = RANGE_BYTES, group: str | None = None) -> DataFrame:
    """Raw records of a topic as a stream: ``log, offset, value``."""
    return spark.readStream.format("record_log").options(
        **_options(spark, folder, {"maxBytesPerTrigger": max_bytes, "rangeBytes": range_bytes, "group": group})).load()


def read_records(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All raw records of a topic as a batch."""
    return spark.read.format("record_log").options(**_options(spark, folder, {"rangeBytes": range_bytes})).load()


def typed(raw: DataFrame, schema: StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """``log, offset``, the event's columns, ``value`` and ``reason``: NULL, or why the record is set aside.

    A record is broken if it is no JSON object, holds a value that is not of its column's type, or lacks a required column.
    """
    stamp = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}
    parsed = raw.withColumn("e", F.from_json("value", StructType([*schema.fields, StructField("__broken", StringType())]), stamp))
    reason = F.when(F.col("e.__broken").isNotNull() | F.col("e").isNull(), F.lit("not a record of the event's schema"))
    for c in required:
        reason = F.coalesce(reason, F.when(F.col(f"e.{c}").isNull(), F.lit(f"{c} is missing")))
    return parsed.select("log", "offset", *[F.col(f"e.{c}").alias(c) for c in schema.names], "value", reason.alias("reason"))


def lag(spark: SparkSession, folder: str, group: str) -> int:
    """Bytes of a topic that a consumer group has not finished, as of its last noted batch."""
    logs = _Logs({"path": _qualified(spark, folder), "group": group})
    done = logs.note("done")
    return sum(n - done.get(p, 0) for p, n in logs.sizes().items())
