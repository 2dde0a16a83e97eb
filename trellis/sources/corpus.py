"""Virtual corpora over the provided tables.

``VC`` turns ``documents`` into a repository of source files
(project = language, module = language/source, package = one of four
directories picked by an md5 digit). ``VR`` turns the relational tables
into a four-level hierarchy (region → nation → customer → order, one
lineitem = one line) and is the scale corpus.

Every frame here is lazy and built from the given tables only, so all work
grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import paths, text
from trellis.session import ensure_parallelism, size_checked_broadcast
from trellis.sources.tables import read_table

# Fixed values of the VC mapping: directory by (second md5 hex digit % 4),
# extension by the first md5 hex digit (16 slots).
VC_DIRS = ["core", "core/api", "core/api/impl", "util"]
VC_EXTENSIONS = [".java", ".java", ".java", ".scala", ".scala", ".js", ".ts", ".tsx",
                 ".py", ".py", ".cpp", ".hs", ".kt", ".yml", ".md", ""]
VC_ROOT = "/repos/"


def _hex_digit(h, pos: int):
    return F.conv(F.substring(h, pos, 1), 16, 10).cast("int")


def stored_summary(content: str) -> F.Column:
    """The stored summary of a file: one short sentence over its whole text (NULL text counts as empty)."""
    t = F.coalesce(F.col(content), F.lit(""))
    return F.concat(F.lit("Lines "), text.raw_line_count(t).cast("string"), F.lit(", characters "),
                    F.length(t).cast("string"), F.lit(", digest "), F.md5(t), F.lit("."))


def vc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the virtual code corpus, one row per document (narrow, no shuffle)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    h = F.md5(F.col("doc_id").cast("string"))
    doc = F.col("doc_id")
    fid = F.col("file_id")
    module_id = F.concat(F.col("lang"), F.lit("/"), F.col("source"))
    dir_ = F.element_at(F.array(*[F.lit(x) for x in VC_DIRS]), _hex_digit(h, 2) % 4 + 1)
    ext = F.element_at(F.array(*[F.lit(x) for x in VC_EXTENSIONS]), _hex_digit(h, 1) + 1)
    stem = (F.when(doc % 17 == 0, F.lit("Test"))
            .when(doc % 13 == 0, F.lit("Record"))
            .otherwise(F.lit("Doc")))
    return (d.select(
        doc.alias("file_id"),
        F.col("lang").alias("project_id"),
        module_id.alias("module_id"),
        F.col("source").alias("module_name"),
        dir_.alias("dir"),
        ext.alias("ext"),
        stem.alias("stem"),
        F.col("text").alias("content"))
        .select(
            "file_id", "project_id", "module_id", "module_name", "dir",
            F.concat(F.col("module_id"), F.lit("/"), F.col("dir")).alias("package_id"),
            F.regexp_replace("dir", "/", ".").alias("package_name"),
            F.concat(F.lit(VC_ROOT), F.col("module_id"), F.lit("/"), F.col("dir"),
                     F.when(fid % 19 == 0, F.lit("/target/")).otherwise(F.lit("/")),
                     F.col("stem"), fid.cast("string"), F.col("ext")).alias("file_path"),
            "content",
            (fid % 50 != 7).alias("analysed"),
            F.when(fid % 50 == 7, F.lit(None).cast("string"))
            .otherwise(stored_summary("content")).alias("short_analysis")))


def with_file_metrics(files: DataFrame, cache_key: tuple | None = None, spread: bool = False) -> DataFrame:
    """Per-file derived metadata: type, validity, raw lines, code and analysis tokens.

    With ``spread`` the rows pass the scan-parallelism guard first (for
    queries whose work is the text expressions themselves).
    """
    if spread:
        files = ensure_parallelism(files, cache_key=cache_key)
    return files.select(
        "*",
        paths.file_type("file_path").alias("file_type"),
        paths.is_valid_source_file("file_path").alias("is_valid"),
        text.raw_line_count("content").alias("lines_of_code"),
        text.pre_token_count("content").alias("code_token_count"),
        text.pre_token_count("short_analysis").alias("analysis_token_count"))


def vc_packages(files: DataFrame) -> DataFrame:
    """Distinct packages with their nearest existing ancestor as parent.

    The package list is one partial+final aggregate over files; the parent
    search explodes each package's ancestor directories and joins back to the
    (small, per-module) package list — no recursion.
    """
    # descriptive columns are functions of the package id: grouping by all of
    # them is a plain hash distinct (no first() buffers, no sort aggregate)
    pk = files.select("package_id", "module_id", "project_id", "dir", "package_name").distinct()
    anc = (pk.select("package_id", "module_id",
                     F.posexplode(paths.ancestors("dir")).alias("pos", "anc_dir"),
                     paths.depth("dir").alias("d"))
           .where(F.col("pos") < F.col("d") - 1))
    cand = pk.select(F.col("module_id").alias("m2"), F.col("dir").alias("anc_dir"),
                     F.col("package_id").alias("parent_package_id"))
    parent = (anc.join(cand, (anc.module_id == cand.m2) & (anc.anc_dir == cand.anc_dir))
              .groupBy("package_id")
              .agg(F.max_by("parent_package_id", "pos").alias("parent_package_id")))
    return pk.join(parent, "package_id", "left")


def vc_modules(files: DataFrame) -> DataFrame:
    return (files.select("module_id", "project_id", "module_name").distinct()
            .withColumn("module_path", F.concat(F.lit(VC_ROOT), F.col("module_id"))))


def vc_projects(files: DataFrame) -> DataFrame:
    return (files.select("project_id").distinct()
            .withColumn("project_name", F.col("project_id"))
            .withColumn("project_location", F.concat(F.lit(VC_ROOT), F.col("project_id"))))


def level_analysis(df: DataFrame, level: str) -> DataFrame:
    """Stored analysis text of a level row (result of an earlier analysis run).

    Packages/modules/projects of the virtual corpus carry a short deterministic
    summary so that own-token counts and freshness rules have input.
    """
    if level == "package":
        a = F.concat(F.lit("Package "), F.col("package_name"), F.lit(" of "), F.col("module_id"), F.lit("."))
    elif level == "module":
        a = F.concat(F.lit("Module "), F.col("module_name"), F.lit(" of project "), F.col("project_id"), F.lit("."))
    else:
        a = F.concat(F.lit("Project "), F.col("project_id"), F.lit(" summary."))
    return df.withColumn("analysis", a).withColumn("analysis_token_count", text.pre_token_count("analysis"))


def vc_contexts(files: DataFrame) -> DataFrame:
    """Project context: the whole text of the project's first file (by id), like a README.

    The first ids are found on narrow columns; one row per project is then read back with its
    text (the id list holds one row per project and the scan is filtered by it).
    """
    first = files.groupBy("project_id").agg(F.min("file_id").alias("file_id"))
    return files.join(first, ["project_id", "file_id"], "left_semi").select("project_id", F.col("content").alias("context"))


# ---------------------------------------------------------------- VR corpus

def vr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as files; lines = lineitem rows per order (0 when none).

    lineitem is pre-aggregated by order key before the join, so the big
    side shuffles one partial-aggregate row per order rather than every line.
    """
    li = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.count("*").alias("lines_of_code")))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = size_checked_broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    r = size_checked_broadcast(read_table(spark, sf_dir, "region").select("r_regionkey"))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(n, F.col("c_nationkey") == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey)
            .join(li, o.o_orderkey == li.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("file_id"),
                    F.col("c_custkey").alias("package_id"),
                    F.col("n_nationkey").cast("bigint").alias("module_id"),
                    F.col("r_regionkey").cast("bigint").alias("project_id"),
                    F.coalesce("lines_of_code", F.lit(0)).cast("bigint").alias("lines_of_code")))
