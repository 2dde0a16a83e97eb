"""Answer ledger: every answer of the analyzer is kept once, by the digest of its request.

A model's calls are slow, costly and not repeatable. ``ask`` therefore sends only requests that the ledger has
no good answer for, each distinct one once, and its tasks write answers as they come: a file after ``flush``
answers or ``flush_s`` seconds, renamed into place. So

* a task that is run again (a lost executor) reads what its earlier attempt wrote and asks the rest;
* a job that is run again (a lost driver) goes on where the ledger ends;
* equal prompts of several entities are one call, also across runs and levels.

Failures are kept with their error and number of attempts; they are asked again by the next ``ask`` unless it is told not
to. Below the folder: ``run=<id>/part=<task>/<n>.parquet``. ``compact`` joins the small files. Files are written
through pyarrow by URI, to any shared file system that it opens.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.session import make_folder, path_exists, remove_path
from trellis.sources.tree import _open, _qualified

SCHEMA = "digest string, analysis string, status string, error string, attempts int"
ARROW = pa.schema([("digest", pa.string()), ("analysis", pa.string()), ("status", pa.string()), ("error", pa.string()), ("attempts", pa.int32())])


def request_digest(system: str = "system_prompt", user: str = "user_prompt") -> Column:
    """Digest of both prompts, lengths included, so that no two requests share it."""
    s, u = F.coalesce(F.col(system), F.lit("")), F.coalesce(F.col(user), F.lit(""))
    return F.sha2(F.concat(F.length(s).cast("string"), F.lit("\n"), s, u), 256)


def call(fn: Callable[[str, str], str], system: str, user: str, retries: int, backoff_s: float) -> tuple:
    """``(analysis, status, error, attempts)`` of one request; any failure is retried, then reported."""
    for n in range(1, retries + 1):
        try:
            return fn(system, user), "ok", None, n
        except Exception as e:  # noqa: BLE001 - whatever the analyzer raises
            error = f"{type(e).__name__}: {e}"
            if backoff_s and n < retries:
                time.sleep(backoff_s * n)
    return None, "failed", error, retries


def _asker(uri: str, run: str, fn, retries: int, backoff_s: float, flush: int, flush_s: float):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector
        system_, top = _open(uri)
        folder = f"{top}/run={run}/part={TaskContext.get().partitionId()}"
        system_.create_dir(folder, recursive=True)
        mine = [f.path for f in system_.get_file_info(FileSelector(folder)) if f.base_name[0] not in "._"]
        known = {d for p in mine for d in pq.read_table(p, filesystem=system_, columns=["digest"], partitioning=None)["digest"].to_pylist()}
        held, since, asked = [], time.monotonic(), 0

        def write() -> None:
            nonlocal held, since
            if held:
                name = f"{uuid.uuid4().hex}.parquet"
                table = pa.Table.from_pylist([dict(zip(ARROW.names, h)) for h in held], ARROW)
                pq.write_table(table, f"{folder}/.{name}", filesystem=system_)
                system_.move(f"{folder}/.{name}", f"{folder}/{name}")
            held, since = [], time.monotonic()

        for b in batches:
            for digest, system, user in zip(*[c.to_pylist() for c in b.columns]):
                if digest in known:
                    continue
                known.add(digest)
                held.append((digest, *call(fn, system, user, retries, backoff_s)))
                asked += 1
                if len(held) >= flush or time.monotonic() - since >= flush_s:
                    write()
        write()
        yield pa.RecordBatch.from_pydict({"asked": pa.array([asked], pa.int64())})
    return ask


class AnswerLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def answers(self) -> DataFrame:
        """One row per digest: its good answer, else its latest number of failures with an error."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)
        row = F.struct(F.col("status") == "ok", "attempts", "analysis", "status", "error")
        return rows.groupBy("digest").agg(F.max(row).alias("a")).select("digest", "a.analysis", "a.status", "a.error", "a.attempts")

    def ask(self, requests: DataFrame, fn: Callable[[str, str], str], id_col: str, parallelism: int = 5, retries: int = 3,
            backoff_s: float = 0.0, again: bool = True, flush: int = 64, flush_s: float = 30.0) -> DataFrame:
        """``id_col, analysis, status, error, attempts`` of all ``requests`` (``id_col, system_prompt, user_prompt``).

        At most ``parallelism`` calls run at once. ``again``: requests that failed before are asked again.
        ``requests`` is read twice: give a stored frame.
        """
        make_folder(self.spark, self.path)
        keyed = requests.select(F.col(id_col), "system_prompt", "user_prompt", request_digest().alias("digest"))
        known = self.answers()
        # the request that asks for a digest is picked on narrow rows; the prompts move once, to the task that asks
        first = (keyed.groupBy("digest").agg(F.min(id_col).alias("__first"))
                 .join((known.where("status = 'ok'") if again else known).select("digest"), "digest", "left_anti"))
        # by digest, so that a task that is run again gets the requests of its first attempt
        todo = (keyed.repartition(parallelism, "digest").join(first.repartition(parallelism, "digest").hint("shuffle_hash"), "digest")
                .where(F.col(id_col).eqNullSafe(F.col("__first"))))
        asker = _asker(_qualified(self.spark, self.path), uuid.uuid4().hex, fn, retries, backoff_s, flush, flush_s)
        todo.select("digest", "system_prompt", "user_prompt").mapInArrow(asker, "asked bigint").agg(F.sum("asked")).collect()
        return keyed.select(id_col, "digest").join(self.answers(), "digest", "left").select(id_col, "analysis", "status", "error", "attempts")

    def compact(self, files: int = 1) -> None:
        """Join all runs into one of ``files`` files; no ``ask`` may be at work."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [s.getPath().toString() for s in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.path))]
        self.answers().repartition(files, "digest").write.parquet(f"{self.path}/run={uuid.uuid4().hex}")
        for p in old:
            remove_path(self.spark, p)
