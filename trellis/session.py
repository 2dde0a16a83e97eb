"""Session construction and a few cluster-safety helpers.

The engine never hard-codes a scratch location: lineage is cut with
``DataFrame.checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``; a local default is only installed when the
session has none (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Conservative ceiling for a broadcast side. Small lookup sides (region,
# nation) are checked against it before a broadcast hint is added; all other
# joins are left to Catalyst/AQE.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "trellis") -> SparkSession:
    """A session for tests and laptops; a submitted master, driver memory or partition count is kept."""
    from pyspark import SparkConf
    cpus = os.environ.get("BENCH_CPUS", "8")
    given = SparkConf()
    builder = SparkSession.builder.appName(app)
    if master or not given.contains("spark.master"):
        builder = builder.master(master or f"local[{cpus}]")
    ours = BASE_CONF | {"spark.ui.enabled": "false", "spark.driver.memory": "16g",
                        "spark.sql.shuffle.partitions": str(shuffle_partitions or int(cpus))}
    for k, v in ours.items():
        if k in BASE_CONF or shuffle_partitions and k.endswith("shuffle.partitions") or not given.contains(k):
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Install the engine's SQL settings on an existing session (idempotent)."""
    for k, v in BASE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: keep the cluster's value
            pass
    ensure_checkpoint_dir(spark)
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``trellis`` importable in Python workers (Arrow UDFs, mapInPandas, state functions).

    The package is zipped once on the driver and added with ``addPyFile``;
    Spark's file server distributes it to every executor.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="trellis-pyfiles-"), "trellis.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, names in os.walk(pkg):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(dirpath, n)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a local default is installed only on a local master.

    On a cluster a machine-local folder would be lost with its machine, so there an unset
    ``spark.checkpoint.dir`` is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="trellis-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file exists, asked of the path's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder and its parents, if missing, through its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this engine's own runs, through its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def size_checked_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast ``df`` only when the optimizer's size estimate is under ``limit``.

    The estimate comes from the optimized plan statistics (file sizes after
    pruning), so nothing is executed; above the limit the frame is returned
    unchanged and Catalyst/AQE choose a shuffle join.
    """
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        size = int(str(stats.sizeInBytes()))
    except Exception:
        return df
    return F.broadcast(df) if size <= limit else df


_SCAN_PARTITIONS: dict[tuple, int] = {}


def ensure_parallelism(df: DataFrame, factor: int = 1, cache_key: tuple | None = None) -> DataFrame:
    """Spread a narrow scan over the cluster when it yields too few input partitions.

    Large inputs already split into far more partitions than there are cores,
    and are returned unchanged (no shuffle). Small inputs stored as one row
    group per file arrive in one task; a round-robin repartition of the
    (already column-pruned) rows lets CPU-heavy text expressions use every core.
    """
    spark = df.sparkSession
    par = spark.sparkContext.defaultParallelism * factor
    n = _SCAN_PARTITIONS.get(cache_key) if cache_key else None
    if n is None:
        try:
            n = df.rdd.getNumPartitions()  # planning only, no job
        except Exception:
            return df
        if cache_key:
            _SCAN_PARTITIONS[cache_key] = n
    return df.repartition(par) if n < par else df
