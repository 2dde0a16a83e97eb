"""Streaming completeness barrier: emit a package, module or project once all that it waits for has come.

One query with two stateful operators (``transformWithState``), both started from the scan's own lists as initial
state; state holds what is still *open* and goes when a key closes:

* ``closed_units``: the files of a directory are dealt into *units* of about ``UNIT_FILES`` files by a hash
  of their id, so a directory with a third of all files is many keys. A unit's state is the list of
  its files that have not come. A file-analysed event takes its id out; the unit that has none left emits one row.
* ``complete_keys``: per package, module and project the number of open units below it, the summaries it
  waits for (one map entry each) and whether it was announced. Unit rows (expanded to the ancestor packages),
  summary events (of root packages for their module, of modules for their project) and announcements
  take from it. The key that waits for nothing more emits its row.

So replays, events for closed keys, events of files, directories or children that the scan doesn't
know, and events without a key find no entry and change nothing: no separate dedup state is kept. A
package is announced by its discovery, modules and projects by the scan; one without files and
children opens with its announcement. The output is a file sink, whose log makes every row
appear once, also when a batch is run again. The shuffled rows are one per file event and one per unit and level.

A scan has its own run and checkpoint. Keys carry the scan id, so several scans of one run don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trellis.functions import paths

FILE_EVENT = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("file_id", T.LongType()),
    T.StructField("project_id", T.StringType()),
    T.StructField("module_id", T.StringType()),
    T.StructField("dir", T.StringType()),
])
SUMMARY_EVENT = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("level", T.StringType()),      # whose summary: package or module
    T.StructField("entity_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),  # module of a root package, project of a module
])
ANNOUNCEMENT = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("entity_id", T.StringType()),
])
LEVELS = ("package", "module", "project")
KEY = ["scan_id", "level", "entity_id"]
UNIT = ["scan_id", "module_id", "dir", "unit"]
UNIT_FILES = 1024
READY = "scan_id string, level string, entity_id string, n_files bigint, n_parts bigint"
CLOSED = "scan_id string, module_id string, dir string, unit int, project_id string, n bigint"


# ---- initial state ----

def directories(files: DataFrame, unit_files: int = UNIT_FILES) -> DataFrame:
    """``(scan_id, module_id, dir, project_id, n, units)`` of the scan's files, and into how many units each directory is dealt."""
    return (files.groupBy("scan_id", "module_id", "dir").agg(F.min("project_id").alias("project_id"), F.count(F.lit(1)).alias("n"))
            .withColumn("units", F.ceil(F.col("n") / unit_files).cast("int")))


def _unit():
    return F.pmod(F.xxhash64("file_id"), F.col("units")).cast("int")


def open_units(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """``(scan_id, module_id, dir, unit, project_id, ids)`` of the files that are to come."""
    at = dirs.select("scan_id", "module_id", "dir", "project_id", "units")
    return (files.select("scan_id", "module_id", "dir", "file_id").join(at, ["scan_id", "module_id", "dir"])
            .groupBy("scan_id", "module_id", "dir", _unit().alias("unit"))
            .agg(F.min("project_id").alias("project_id"), F.collect_set("file_id").alias("ids")))


def expected(units: DataFrame, packages: DataFrame, modules: DataFrame, projects: DataFrame, levels=LEVELS) -> DataFrame:
    """What every key waits for: rows ``(scan_id, level, entity_id, part, n_files, units)``.

    One row with NULL ``part`` per key, with its files and open units, and one row per summary it waits for.
    ``packages (scan_id, package_id, module_id, dir, parent_package_id)``, ``modules (scan_id, module_id, project_id)``
    and ``projects (scan_id, project_id)`` are the scan's own lists.
    """
    n = units.select("scan_id", "module_id", "dir", "project_id", F.size("ids").cast("bigint").alias("n"))
    d = n.groupBy("scan_id", "module_id", "dir", "project_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("units"))
    sums = [F.sum("n").alias("n_files"), F.sum("units").alias("units")]
    zero = F.lit(0).cast("bigint")

    def whole(level: str, every: DataFrame, key: str, below: DataFrame) -> DataFrame:
        return (every.select("scan_id", F.col(key).alias("entity_id")).join(below, ["scan_id", "entity_id"], "left")
                .select("scan_id", F.lit(level).alias("level"), "entity_id", F.lit(None).cast("string").alias("part"),
                        F.coalesce("n_files", zero).alias("n_files"), F.coalesce("units", zero).alias("units")))

    def parts(level: str, children: DataFrame, key: str, child: str) -> DataFrame:
        return children.select("scan_id", F.lit(level).alias("level"), F.col(key).alias("entity_id"), F.col(child).alias("part"),
                               zero.alias("n_files"), zero.alias("units"))

    out = []
    if "package" in levels:
        below = (d.select("scan_id", "module_id", "n", "units", F.explode(paths.ancestors("dir")).alias("dir"))
                 .join(packages.select("scan_id", "package_id", "module_id", "dir"), ["scan_id", "module_id", "dir"])
                 .groupBy("scan_id", F.col("package_id").alias("entity_id")).agg(*sums))
        out.append(whole("package", packages, "package_id", below))
    if "module" in levels:
        out.append(whole("module", modules, "module_id", d.groupBy("scan_id", F.col("module_id").alias("entity_id")).agg(*sums)))
        out.append(parts("module", packages.where("parent_package_id IS NULL"), "module_id", "package_id"))
    if "project" in levels:
        out.append(whole("project", projects, "project_id", d.groupBy("scan_id", F.col("project_id").alias("entity_id")).agg(*sums)))
        out.append(parts("project", modules, "project_id", "module_id"))
    first, *rest = out
    for o in rest:
        first = first.unionByName(o)
    return first


# ---- state ----

class OpenUnit(StatefulProcessor):
    """Files of a unit that have not come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "ids array<bigint>, n bigint, project_id string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        ids = [int(i) for x in initialState["ids"] for i in x]
        self.open.update((ids, len(ids), initialState["project_id"].iloc[0]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = {int(i) for pdf in rows for i in pdf["file_id"]}
        if not self.open.exists():
            return
        ids, n, project = self.open.get()
        left = [i for i in ids if i not in came]
        if left:
            if len(left) < len(ids):
                self.open.update((left, n, project))
            return
        self.open.clear()
        yield pd.DataFrame([[*key, project, n]], columns=[c.split()[0] for c in CLOSED.split(", ")])


class OpenBarrier(StatefulProcessor):
    """What a package, module or project still waits for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.todo = handle.getValueState("todo", "units bigint, parts bigint, announced boolean, n_files bigint, n_parts bigint")
        self.parts = handle.getMapState("parts", "part string", "open boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        units, parts, announced, n_files, _ = self.todo.get() if self.todo.exists() else (0, 0, False, 0, 0)
        for part in initialState["part"].dropna():
            if not self.parts.containsKey((part,)):
                self.parts.updateValue((part,), (True,))
                parts += 1
        self.todo.update((units + int(initialState["units"].sum()), parts, announced, n_files + int(initialState["n_files"].sum()), parts))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.todo.exists():
            for _ in rows:
                pass
            return
        before = units, parts, announced, n_files, n_parts = self.todo.get()
        for pdf in rows:
            units -= int((pdf["kind"] == "unit").sum())
            announced = announced or bool((pdf["kind"] == "announced").any())
            for part in pdf.loc[pdf["kind"] == "part", "part"].drop_duplicates():
                if self.parts.containsKey((part,)):
                    self.parts.removeKey((part,))
                    parts -= 1
        if units <= 0 and parts <= 0 and announced:
            self.todo.clear()
            self.parts.clear()
            yield pd.DataFrame([[*key, n_files, n_parts]], columns=[c.split()[0] for c in READY.split(", ")])
        elif (units, parts, announced, n_files, n_parts) != tuple(before):
            self.todo.update((units, parts, announced, n_files, n_parts))


# ---- stream ----

def closed_units(file_events: DataFrame, dirs: DataFrame, units: DataFrame) -> DataFrame:
    """File-analysed events in, one row per closed unit out."""
    at = dirs.select("scan_id", "module_id", "dir", "units")
    events = (file_events.where("file_id IS NOT NULL AND module_id IS NOT NULL").select("scan_id", "module_id", "dir", "file_id")
              .join(at, ["scan_id", "module_id", "dir"]).select("scan_id", "module_id", "dir", _unit().alias("unit"), "file_id"))
    return events.groupBy(*UNIT).transformWithStateInPandas(OpenUnit(), CLOSED, "append", "None", units.groupBy(*UNIT))


def complete_keys(closed: DataFrame, summary_events: DataFrame, announcements: DataFrame, packages: DataFrame, waiting: DataFrame,
                  levels=LEVELS) -> DataFrame:
    """Closed units, summaries and announcements in, one row per complete key out."""
    none = F.lit(None).cast("string")
    key = lambda level, entity: F.struct(F.lit(level).alias("level"), entity.alias("entity_id"), none.alias("dir"))
    up = F.transform(paths.ancestors("dir"), lambda d: F.struct(F.lit("package").alias("level"), none.alias("entity_id"), d.alias("dir")))
    by_level = F.concat(*[x for level, x in (("package", up), ("module", F.array(key("module", F.col("module_id")))),
                                             ("project", F.array(key("project", F.col("project_id"))))) if level in levels])
    pk = packages.select("scan_id", "package_id", "module_id", F.col("dir").alias("d"))
    each = closed.select("scan_id", "module_id", F.explode(by_level).alias("k")).select("scan_id", "module_id", "k.level", "k.entity_id", F.col("k.dir").alias("d"))
    units = each.join(pk, ["scan_id", "module_id", "d"], "left").select(
        "scan_id", "level", F.coalesce("entity_id", "package_id").alias("entity_id"), F.lit("unit").alias("kind"), none.alias("part"))
    parent = F.when(F.col("level") == "package", "module").when(F.col("level") == "module", "project")
    parts = summary_events.where("entity_id IS NOT NULL").select(
        "scan_id", parent.alias("level"), F.col("parent_id").alias("entity_id"), F.lit("part").alias("kind"), F.col("entity_id").alias("part"))
    opened = announcements.select(*KEY, F.lit("announced").alias("kind"), none.alias("part"))
    merged = units.unionByName(parts).unionByName(opened).where("entity_id IS NOT NULL").where(F.col("level").isin(*levels))
    return merged.groupBy(*KEY).transformWithStateInPandas(OpenBarrier(), READY, "append", "None", waiting.groupBy(*KEY))


def barrier_stream(file_events: DataFrame, summary_events: DataFrame, announcements: DataFrame, dirs: DataFrame, units: DataFrame,
                   packages: DataFrame, waiting: DataFrame, sink: str, checkpoint: str, levels=LEVELS) -> StreamingQuery:
    """Start the barrier query over the three event streams (``availableNow`` trigger)."""
    out = complete_keys(closed_units(file_events, dirs, units), summary_events, announcements, packages, waiting, levels)
    return (out.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ready_keys(spark, sink: str) -> DataFrame:
    """The complete keys, one row each, through the sink's log."""
    return spark.read.schema(READY).parquet(sink)
