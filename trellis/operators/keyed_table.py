"""Keyed table with merge-on-read updates: small patches beside the base rows, one manifest per version.

Plain parquet has no ``MERGE``. Here a field update writes only the patched keys and
columns; the base rows stay where they are until a compaction folds the patches in.
Below the table's folder:

* ``base/<id>/__bucket=<b>/``: rows, dealt into buckets by a hash of the key;
* ``patch/__patch=<id>/__bucket=<b>/``: the key and one nullable struct per patched column (NULL: not set), one row a key;
* ``manifest/<version>.json``: the base folder of every bucket, the patches in order with their rows
  per bucket, and the last batch of every streaming writer.

A version is one manifest, renamed into place when all its files are written: readers see
all of it or nothing, and files without a manifest are left to ``vacuum``. Renaming fails if the version
exists, so of two writers one retries on top of the other (a patch) or gives up (a compaction of the
same buckets). This needs a file system whose rename is atomic, as Structured Streaming's checkpoints do.

Reading joins the buckets that have patches to their newest values per key and takes the other buckets
as they are. Patches are combined per key before the join (partial aggregates), so a key that is
patched in every batch is no hot key; the join's strategy is left to AQE, which broadcasts patches only while small.

Defined cases: patch rows whose key has a NULL part are ignored. Of several rows of one key in a patch the
newest by ``newest_by`` counts, else the greatest. NULL in a patch keeps the value unless ``set_nulls``.
``update`` changes rows that are there, all of a repeated key, and nothing else; ``upsert`` adds unknown keys.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from trellis.session import path_exists, remove_path


BUCKET, PATCH = "__bucket", "__patch"


class Conflict(RuntimeError):
    """Another writer has published the version first."""


@dataclass(frozen=True)
class Manifest:
    version: int
    key: list[str]
    schema: str
    buckets: int
    base: dict[str, str] = field(default_factory=dict)       # bucket -> base folder; none: no rows
    base_rows: dict[str, int] = field(default_factory=dict)  # bucket -> rows in it
    patches: list[dict] = field(default_factory=list)        # {id, upsert, rows: {bucket: rows}}, oldest first
    done: dict[str, int] = field(default_factory=dict)       # streaming writer -> last batch

    @property
    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- manifests ----

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not path_exists(self.spark, f"{self.path}/manifest"):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path("manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, the newest by default."""
        if version is None:
            version = max(self.versions(), default=None)
            if version is None:
                raise FileNotFoundError(f"no table at {self.path}")
        stream = self._fs().open(self._path("manifest", f"{version:012d}.json"))
        try:
            return Manifest(**json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        finally:
            stream.close()

    def _publish(self, m: Manifest) -> int:
        """The version appears whole or not at all; one that exists is a ``Conflict``."""
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        temp, target = self._path("manifest", f".{uuid.uuid4().hex}.tmp"), self._path("manifest", f"{m.version:012d}.json")
        out = self._fs().create(temp, False)
        out.write(json.dumps(asdict(m)).encode())
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(self._fs().getUri(), conf).rename(temp, target, plain)
        except Py4JJavaError as e:
            self._fs().delete(temp, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {m.version} of {self.path} is there already") from None
            raise
        return m.version

    # ---- writes ----

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, key: list[str], buckets: int | None = None,
               files_per_bucket: int = 1) -> KeyedTable:
        """A new table of ``rows``; take so many buckets that one of them is a task's work, or several files a bucket."""
        table = cls(spark, path)
        m = Manifest(0, key, rows.schema.json(), buckets or 2 * max(1, spark.sparkContext.defaultParallelism))
        base, n = table._write_base(rows, m, files_per_bucket)
        table._publish(replace(m, base=dict.fromkeys(n, base), base_rows=n))
        return table

    def _bucket(self, m: Manifest) -> Column:
        return F.pmod(F.xxhash64(*m.key), F.lit(m.buckets)).cast("int").alias(BUCKET)

    def _rows_by_bucket(self, frame: DataFrame) -> dict[str, int]:
        return {str(r[BUCKET]): r["count"] for r in frame.groupBy(BUCKET).count().collect()}  # at most one row a bucket

    def _write_base(self, rows: DataFrame, m: Manifest, files: int = 1) -> tuple[str, dict[str, int]]:
        name = uuid.uuid4().hex
        salt = [F.pmod(F.monotonically_increasing_id(), F.lit(files))] if files > 1 else []
        (rows.withColumn(BUCKET, self._bucket(m)).repartition(m.buckets * files, BUCKET, *salt)
         .write.partitionBy(BUCKET).parquet(f"{self.path}/base/{name}"))
        return name, self._rows_by_bucket(self.spark.read.schema(f"{BUCKET} int").parquet(f"{self.path}/base/{name}"))

    def update(self, patch: DataFrame, cols: list[str] | None = None, **how) -> int:
        """``$set`` of ``cols`` (default: all but the key) in the rows whose key the patch has; the new version."""
        return self._patch(patch, cols, False, **how)

    def upsert(self, rows: DataFrame, cols: list[str] | None = None, **how) -> int:
        """Like ``update``; keys that no row has become new rows."""
        return self._patch(rows, cols, True, **how)

    def _patch(self, patch: DataFrame, cols: list[str] | None, upsert: bool, newest_by: str | None = None,
               set_nulls: bool = False, batch: tuple[str, int] | None = None) -> int:
        """``batch``: a streaming writer and its batch number; a batch that is published already changes nothing."""
        m = self.manifest()
        if batch and m.done.get(batch[0], -1) >= batch[1]:
            return m.version
        cols = [c for c in m.struct.names if c not in m.key and c in patch.columns] if cols is None else cols
        row = F.struct(*[F.col(c).cast(m.struct[c].dataType).alias(c) for c in cols])
        pick = F.max_by(row, newest_by) if newest_by else F.max(row)
        value = lambda c: F.struct(F.col(f"__p.{c}").alias("v"))
        small = (patch.where(" AND ".join(f"`{k}` IS NOT NULL" for k in m.key))
                 .groupBy(*[F.col(k).cast(m.struct[k].dataType).alias(k) for k in m.key]).agg(pick.alias("__p"))
                 .select(*m.key, *[(value(c) if set_nulls else F.when(F.col(f"__p.{c}").isNotNull(), value(c))).alias(c) for c in cols],
                         self._bucket(m)))
        name = uuid.uuid4().hex
        small.repartition(m.buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/patch/{PATCH}={name}")
        rows = self._rows_by_bucket(self.spark.read.schema(f"{BUCKET} int").parquet(f"{self.path}/patch/{PATCH}={name}"))
        while True:
            done = m.done | ({batch[0]: batch[1]} if batch else {})
            try:
                return self._publish(replace(m, version=m.version + 1, done=done,
                                             patches=[*m.patches, {"id": name, "upsert": upsert, "rows": rows}]))
            except Conflict:  # patches commute with what the other writer did
                m = self.manifest()
                if batch and m.done.get(batch[0], -1) >= batch[1]:
                    return m.version

    def compact(self, share: float = 0.2) -> int:
        """Fold the patches into the buckets where they have more than ``share`` of the base's rows; the newest version."""
        m = self.manifest()
        rows: dict[str, int] = {}
        for p in m.patches:
            for b, n in p["rows"].items():
                rows[b] = rows.get(b, 0) + n
        full = {b for b, n in rows.items() if n > share * m.base_rows.get(b, 0)}
        if not full:
            return m.version
        base, n = self._write_base(self._merged(m, full), m)
        now = m
        while True:
            mine = {p["id"] for p in m.patches}
            left = [p | {"rows": {b: x for b, x in p["rows"].items() if p["id"] not in mine or b not in full}} for p in now.patches]
            keep = lambda d: {b: x for b, x in d.items() if b not in full}
            try:
                return self._publish(replace(now, version=now.version + 1, base=keep(now.base) | dict.fromkeys(n, base),
                                             base_rows=keep(now.base_rows) | n, patches=[p for p in left if p["rows"]]))
            except Conflict:
                now = self.manifest()
                if any(now.base.get(b) != m.base.get(b) for b in full):
                    raise

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all but the newest ``keep`` versions and every folder that they don't name; no writer may be at work."""
        versions = self.versions()
        for v in versions[:-keep]:
            remove_path(self.spark, f"{self.path}/manifest/{v:012d}.json")
        used = set()
        for v in versions[-keep:]:
            m = self.manifest(v)
            used |= {f"base/{x}" for x in m.base.values()} | {f"patch/{PATCH}={p['id']}" for p in m.patches}
        gone = []
        for kind in ("base", "patch"):
            if path_exists(self.spark, f"{self.path}/{kind}"):
                found = [f"{kind}/{s.getPath().getName()}" for s in self._fs().listStatus(self._path(kind))]
                gone += [f for f in found if f not in used]
        for f in gone:
            remove_path(self.spark, f"{self.path}/{f}")
        return gone

    # ---- reads ----

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        m = self.manifest(version)
        touched = {b for p in m.patches for b in p["rows"]}
        return self._base_rows(m, set(m.base) - touched).unionByName(self._merged(m, touched)) if touched else self._base_rows(m, set(m.base))

    def _base_rows(self, m: Manifest, buckets: set[str]) -> DataFrame:
        paths = [f"{self.path}/base/{m.base[b]}/{BUCKET}={b}" for b in sorted(buckets & set(m.base), key=int)]
        return self.spark.read.schema(m.struct).parquet(*paths) if paths else self.spark.createDataFrame([], m.struct)

    def _merged(self, m: Manifest, buckets: set[str]) -> DataFrame:
        """The rows of some buckets with their patches applied."""
        values = [f for f in m.struct.fields if f.name not in m.key]
        kinds = StructType([*[m.struct[k] for k in m.key], *[StructField(f.name, StructType([StructField("v", f.dataType)])) for f in values],
                            StructField(PATCH, StringType()), StructField(BUCKET, IntegerType())])
        paths = [f"{self.path}/patch/{PATCH}={p['id']}/{BUCKET}={b}" for p in m.patches for b in p["rows"] if b in buckets]
        base = self._base_rows(m, buckets).withColumn("__old", F.lit(True))
        if not paths:
            return base.drop("__old")
        places = self.spark.createDataFrame([(p["id"], n, p["upsert"]) for n, p in enumerate(m.patches)], f"{PATCH} string, __n int, __up boolean")
        adds = any(p["upsert"] for p in m.patches)
        patch = self.spark.read.schema(kinds).option("basePath", f"{self.path}/patch").parquet(*paths).join(F.broadcast(places), PATCH)  # one row a patch
        # a new row takes what was set from its first upsert on
        first = F.min(F.when(F.col("__up"), F.col("__n"))).over(Window.partitionBy(*m.key)) if adds else F.lit(None).cast("int")
        patch = patch.withColumn("__first", first)
        newest = lambda c, since: F.max_by(F.col(c), F.when(F.col(c).isNotNull() & since, F.col("__n")))
        aggs = [newest(f.name, F.lit(True)).alias(f"__p_{f.name}") for f in values]
        if adds:
            aggs += [newest(f.name, F.col("__n") >= F.col("__first")).alias(f"__i_{f.name}") for f in values]
            aggs.append(F.max("__first").isNotNull().alias("__adds"))
        per_key = patch.groupBy(*m.key).agg(*aggs) if aggs else patch.select(*m.key).distinct().withColumn("__adds", F.lit(adds))
        out = base.join(per_key, m.key, "full" if adds else "left")
        if adds:
            out = out.where("__old OR __adds")
        def value(f):
            patched = F.col(f"__p_{f.name}")
            old = F.when(patched.isNotNull(), patched["v"]).otherwise(F.col(f.name))
            return (F.when(F.col("__old"), old).otherwise(F.col(f"__i_{f.name}")["v"]) if adds else old).alias(f.name)
        by_name = {f.name: value(f) for f in values}
        return out.select(*[by_name.get(c, F.col(c)) for c in m.struct.names])
