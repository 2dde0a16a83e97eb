"""Source-tree scan and build-file rules over a directory of repositories.

Every repository directory under ``root`` is one project. Listing (a job per
level of the tree) and content read (ranges of equal bytes) are Spark jobs of their own (Spark's file sources leave out
names that start with ``_`` or ``.``); all rules below are jobs over one table of (project,
relative path, absolute path, content):

* project type: maven > gradle (``build.gradle`` or ``.kts``) > ant > sbt >
  any ``.java`` file > error, via ``bool_or`` flags per project;
* pom well-formedness gates ``xpath`` (which raises on malformed XML);
* Maven modules: every ``modules/module`` at any depth, distinct, in order;
* Gradle modules: ``settings.gradle`` else ``settings.gradle.kts``, include
  regex, leading ``:`` dropped; nothing found → one ``default`` module;
* README pick: first existing of nine names in a fixed order.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from trellis.functions import paths
from trellis.operators.ordered_text import running_totals
from trellis.session import cut_lineage

# README names in preference order, include pattern, messages.
README_NAMES = ["README.md", "Readme.md", "readme.md", "README.txt", "Readme.txt", "readme.txt",
                "README", "Readme", "readme"]
GRADLE_INCLUDE = r"""include\s*['"](:[^'"]+)['"]"""
DEFAULT_MODULE = "default"
INVALID_POM = "Invalid pom.xml file"
UNKNOWN_TYPE = "Unable to determine project type. No recognized build files found and no Java files detected."
DETECTED = ("Project detected as ", " project")


LISTING = "project string, rel_path string, abs_path string"
#: Bytes of the files that one task reads, of a batch of contents, and entries of a batch of listings.
READ_BYTES, BATCH_BYTES, LIST_ROWS = 64 << 20, 8 << 20, 8192


def _qualified(spark: SparkSession, root: str) -> str:
    """The root as a URI of its own file system; names in it are as stored."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    u = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return f"{u.getScheme()}://{u.getAuthority() or ''}{u.getPath()}"


def _open(uri: str):
    """pyarrow's file system of a URI and the path in it."""
    from urllib.parse import quote

    from pyarrow import fs
    if uri.startswith("file://"):
        return fs.LocalFileSystem(), uri.removeprefix("file://")
    return fs.FileSystem.from_uri(quote(uri, safe=":/@"))


def list_folders(folders: DataFrame, uri: str) -> DataFrame:
    """``(path, is_dir, size)`` of the entries of every folder (column ``path``), a listing call each; links are left out."""
    def walk(batches):
        import os

        from pyarrow.fs import FileSelector, FileType, LocalFileSystem
        system, _ = _open(uri)
        local = isinstance(system, LocalFileSystem)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = [f for f in system.get_file_info(FileSelector(folder)) if f.type in (FileType.File, FileType.Directory)
                         and not (local and os.path.islink(f.path))]
                for lo in range(0, len(found), LIST_ROWS):
                    part = found[lo:lo + LIST_ROWS]
                    yield pa.RecordBatch.from_pydict({
                        "path": pa.array([f.path for f in part], pa.string()), "is_dir": pa.array([f.type == FileType.Directory for f in part], pa.bool_()),
                        "size": pa.array([f.size or 0 for f in part], pa.int64())})
    return folders.select("path").mapInArrow(walk, "path string, is_dir boolean, size bigint")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(project, rel_path, abs_path, size) of every file under ``root/<project>/``, hidden names included.

    ``root`` is a path or a URI of any scheme that pyarrow's file systems open; a path is
    qualified by the cluster's default file system. The tree is listed level by level: the folders found at one
    level are dealt over all tasks for the next, so a project with a third of all folders
    is no task's work. One job per level, its rows written to the checkpoint folder. Paths
    are names as stored, never URI-encoded; symbolic links are not followed.
    """
    uri = _qualified(spark, root)
    top = _open(uri)[1].rstrip("/")
    most = 4 * spark.sparkContext.defaultParallelism
    level, files = spark.createDataFrame([(top,)], "path string"), []
    while True:
        found = cut_lineage(list_folders(level, uri))
        files.append(found.where("NOT is_dir"))
        folders = found.where("is_dir").select("path")
        n = folders.count()
        if not n:
            break
        level = folders.repartition(min(n, most))
    every = files[0].limit(0)
    for f in files[1:]:  # what lies at the root itself is in no project
        every = every.unionByName(f)
    below = F.substring("path", len(top) + 2, 1 << 30)
    return every.select(F.substring_index(below, "/", 1).alias("project"), F.expr(f"substring(path, {len(top) + 2} + instr(substring(path, {len(top) + 2}), '/'))").alias("rel_path"),
                        F.col("path").alias("abs_path"), "size")


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(project, rel_path, abs_path, content) of every file.

    Files are read in ranges of about ``READ_BYTES`` (less where that gives fewer than two tasks a
    core), cut by a running total of their sizes in path order; a larger file is a range of its own.
    """
    files = list_tree(spark, root)
    uri = _qualified(spark, root)
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, files.count()), -(-total // READ_BYTES))
    each = max(1, -(-total // tasks))
    placed = running_totals(files.withColumn("__all", F.lit(0)), ["__all"], ["abs_path"], "size", "__before")
    ranged = placed.withColumn("__range", F.floor(F.col("__before") / each)).repartitionByRange(tasks, "__range", "abs_path")

    def read(batches):
        system, _ = _open(uri)
        for b in batches:
            low, size, texts = 0, 0, []
            sizes = b.column(3).to_pylist()
            for i, path in enumerate(b.column(2).to_pylist()):
                with system.open_input_stream(path) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
                size += sizes[i]
                if size >= BATCH_BYTES or i == b.num_rows - 1:
                    part = b.slice(low, i + 1 - low)
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(texts, pa.string())], [*part.schema.names[:3], "content"])
                    low, size, texts = i + 1, 0, []
    return ranged.select("project", "rel_path", "abs_path", "size").mapInArrow(read, LISTING + ", content string")


def source_files(tree: DataFrame) -> DataFrame:
    """Valid source files (supported suffix, no test/target in the absolute path)."""
    return tree.where(paths.is_valid_source_file("abs_path"))


@F.pandas_udf(BooleanType())
def well_formed_xml(s: pd.Series) -> pd.Series:
    def ok(x):
        if x is None:
            return False
        try:
            ET.fromstring(x)
            return True
        except ET.ParseError:
            return False
    return s.map(ok)


def project_types(tree: DataFrame) -> DataFrame:
    """(project, project_type, error, message) with the detection priority."""
    r = F.col("rel_path")
    flags = tree.groupBy("project").agg(
        F.bool_or(r == "pom.xml").alias("maven"),
        F.bool_or(r.isin("build.gradle", "build.gradle.kts")).alias("gradle"),
        F.bool_or(r == "build.xml").alias("ant"),
        F.bool_or(r == "build.sbt").alias("sbt"),
        F.bool_or(r.endswith(".java")).alias("java"))
    # only the root poms pass the Python check
    poms = tree.where(r == "pom.xml").select("project", "content").withColumn("pom_ok", well_formed_xml("content"))
    flags = flags.join(poms.groupBy("project").agg(F.bool_or("pom_ok").alias("pom_ok")), "project", "left")
    t = (F.when(F.col("maven"), F.lit("maven")).when(F.col("gradle"), F.lit("gradle"))
         .when(F.col("ant"), F.lit("ant")).when(F.col("sbt"), F.lit("sbt"))
         .when(F.col("java"), F.lit("java")))
    err = (F.when(F.col("maven") & ~F.coalesce(F.col("pom_ok"), F.lit(False)), F.lit(INVALID_POM))
           .when(t.isNull(), F.lit(UNKNOWN_TYPE)))
    return flags.select("project", F.when(err.isNull(), t).alias("project_type"), err.alias("error"),
                        F.when(err.isNull(), F.concat(F.lit(DETECTED[0]), F.upper(t), F.lit(DETECTED[1]))).alias("message"))


def normal_path(path) -> F.Column:
    """A declared module path without empty and ``.`` segments; ``..`` takes its parent away, however deep.

    One fold over the segments; a ``..`` without a parent stays.
    """
    def step(done, part):
        up = (part == "..") & (F.size(done) > 0) & (F.get(done, F.size(done) - 1) != "..")
        return (F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1))
                .otherwise(F.concat(done, F.array(part))))
    path = F.trim(path)
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda done: F.array_join(done, "/"))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), kept)


def maven_modules(tree: DataFrame) -> DataFrame:
    """(project, modules array) from the root pom; malformed or none → NULL array."""
    pom = tree.where(F.col("rel_path") == "pom.xml").withColumn("ok", well_formed_xml("content"))
    found = F.transform(F.xpath("content", F.lit("//modules/module/text()")), normal_path)
    mods = F.when(F.col("ok"), F.array_distinct(F.filter(found, lambda x: x != "")))
    return pom.select("project", mods.alias("modules"))


def gradle_modules(tree: DataFrame) -> DataFrame:
    """(project, modules array) from settings.gradle, else settings.gradle.kts."""
    s = tree.where(F.col("rel_path").isin("settings.gradle", "settings.gradle.kts"))
    pick = s.groupBy("project").agg(
        F.min_by("content", F.when(F.col("rel_path") == "settings.gradle", 0).otherwise(1)).alias("content"))
    found = F.regexp_extract_all("content", F.lit(GRADLE_INCLUDE), 1)
    return pick.select("project", F.transform(found, lambda x: F.substring(x, 2, 1 << 30)).alias("modules"))


def project_modules(tree: DataFrame, types: DataFrame) -> DataFrame:
    """One row per (project, module, location); ``default`` at the root when nothing is declared."""
    mv = maven_modules(tree).withColumnRenamed("modules", "mv")
    gr = gradle_modules(tree).withColumnRenamed("modules", "gr")
    t = types.where(F.col("error").isNull()).join(mv, "project", "left").join(gr, "project", "left")
    declared = (F.when(F.col("project_type") == "maven", F.col("mv"))
                .when(F.col("project_type") == "gradle", F.col("gr")))
    mods = F.when(F.coalesce(F.size(declared), F.lit(0)) > 0, declared).otherwise(F.array(F.lit(DEFAULT_MODULE)))
    ex = t.select("project", F.posexplode(mods).alias("ordinal", "module"))
    return ex.withColumn("location", F.when(F.col("module") == DEFAULT_MODULE, F.col("project"))
                         .otherwise(paths.module_location("project", "module")))


def modules_with_sources(modules: DataFrame, tree: DataFrame) -> DataFrame:
    """Modules whose directory holds a valid source file at any depth (ancestor explode + semi-join)."""
    src = source_files(tree).select("project", paths.dirname("rel_path").alias("d"))
    anc = (src.where(F.col("d") != "").select("project", F.explode(paths.ancestors("d")).alias("module"))
           .distinct())
    rooted = modules.where(F.col("module") == DEFAULT_MODULE).join(src.select("project").distinct(), "project",
                                                                   "left_semi")
    nested = modules.where(F.col("module") != DEFAULT_MODULE).join(anc, ["project", "module"], "left_semi")
    return rooted.unionByName(nested)


def readme_context(tree: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """Project context: first README by fixed name order, else the command's context, else ''."""
    rank = F.array_position(F.array(*[F.lit(n) for n in README_NAMES]), F.col("rel_path"))
    r = (tree.where(rank > 0).groupBy("project")
         .agg(F.min_by("content", rank).alias("readme")))
    base = tree.select("project").distinct()
    out = base.join(r, "project", "left")
    if commands is not None:
        out = out.join(commands.select("project", F.col("context").alias("cmd_context")), "project", "left")
        ctx = F.coalesce("readme", "cmd_context", F.lit(""))
    else:
        ctx = F.coalesce("readme", F.lit(""))
    return out.select("project", ctx.alias("context"))
