"""Level tables of a real source tree: projects → modules → packages → files.

Built from one recursive scan (``tree.scan_tree``) with the same closed-form
operators the rest of the engine uses, so every query over the virtual
corpus runs unchanged over real repositories:

* modules: declared by the build files (Maven/Gradle), else one ``default``
  module at the project root; modules without a valid file below are dropped;
* files: valid source files, each assigned to the deepest module whose
  location contains it (ancestor explode + join + ``max_by`` depth);
* packages: directories with direct valid files, named by the first file's
  declared package (Java) or the directory name; parent = nearest ancestor
  directory that is itself a package; each file keeps its own package name
  (declared, '' when absent, or the directory name for non-Java files);
* ids are deterministic digests of natural keys, so a re-scan is idempotent;
* project context: the README pick.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import paths
from trellis.operators import hierarchy, java_meta
from trellis.sources import tree as T


@dataclass
class RepoCorpus:
    files: DataFrame
    packages: DataFrame
    modules: DataFrame
    projects: DataFrame
    contexts: DataFrame

    @property
    def text_files(self) -> DataFrame:
        return self.files


def _id(*cols) -> F.Column:
    return F.substring(F.sha2(F.concat_ws("/", *cols), 256), 1, 24)


def repository_corpus(spark: SparkSession, root: str) -> RepoCorpus:
    tree = T.scan_tree(spark, root)
    types = T.project_types(tree)
    mods = T.modules_with_sources(T.project_modules(tree, types), tree)
    # module directory relative to the project ('' for the root module)
    mods = mods.withColumn("mod_dir", F.when(F.col("module") == T.DEFAULT_MODULE, F.lit(""))
                           .otherwise(F.col("module")))

    # metadata comes from one pass over the contents; everything below is narrow, contents are attached last
    texts = java_meta.with_java_metadata(T.source_files(tree).select(
        "project", "rel_path", "content", F.col("rel_path").alias("file_path"), paths.dirname("rel_path").alias("file_dir")))
    src = texts.select("project", "rel_path", "file_path", "file_dir", "declared_package")
    # candidate module dirs of each file: '' plus every ancestor of its directory
    anc = src.select("project", "rel_path", F.explode(
        F.concat(F.array(F.lit("")), F.when(F.col("file_dir") == "", F.array().cast("array<string>"))
                 .otherwise(paths.ancestors("file_dir")))).alias("mod_dir"))
    owner = (anc.join(mods.select("project", "module", "mod_dir"), ["project", "mod_dir"])
             .groupBy("project", "rel_path")
             .agg(F.max_by(F.struct("module", "mod_dir"), F.length("mod_dir")).alias("m")))
    files = (src.join(owner, ["project", "rel_path"])
             .withColumns({"module_name": F.col("m.module"), "mod_dir": F.col("m.mod_dir")}).drop("m"))
    files = files.withColumn(
        "dir", F.when(F.col("mod_dir") == "", F.col("file_dir"))
        .otherwise(F.expr("substr(file_dir, length(mod_dir) + 2)")))
    files = (files.withColumn("project_id", F.col("project"))
             .withColumn("module_id", _id("project", "module_name"))
             .withColumn("package_id", _id("project", "module_name", "dir"))
             .withColumn("file_id", _id("project", "rel_path"))
             .withColumn("short_analysis", F.lit(None).cast("string")))

    # a file row carries its own package name (declared package for Java, '' when
    # absent; directory name otherwise) — the (module, package name) file lookup of
    # the package stage depends on it; the package row carries the directory's name,
    # from its first file (declared package, else directory name)
    pkg_names = java_meta.directory_packages(files, dir_key="package_id")
    own = F.when(F.col("file_path").endswith(".java"), F.coalesce(F.col("declared_package"), F.lit(""))) \
        .otherwise(paths.parent_dir_name("file_path"))
    files = files.withColumn("file_package", own).join(pkg_names.withColumnRenamed("package_name", "dir_package"), "package_id")
    pk = files.select("package_id", "module_id", "project_id", "dir",
                      F.col("dir_package").alias("package_name")).distinct()
    files = (files.join(texts.select("project", "rel_path", "content"), ["project", "rel_path"])
             .select("file_id", "project_id", "module_id", "module_name", "dir", "package_id",
                     F.col("file_package").alias("package_name"), "file_path", "content", "short_analysis",
                     F.lit(False).alias("analysed")))

    tree_pk = hierarchy.nearest_ancestor(pk.select("module_id", "dir"), ["module_id"], "dir")
    parents = (tree_pk.where(F.col("parent_dir").isNotNull())
               .join(pk.select("module_id", F.col("dir").alias("parent_dir"),
                               F.col("package_id").alias("parent_package_id")), ["module_id", "parent_dir"])
               .select("module_id", "dir", "parent_package_id"))
    packages = (pk.join(parents, ["module_id", "dir"], "left")
                .withColumn("analysis", F.lit(None).cast("string"))
                .withColumn("analysis_token_count", F.lit(None).cast("bigint")))
    modules = (mods.select(F.col("project").alias("project_id"), F.col("module").alias("module_name"),
                           F.col("location").alias("module_path"))
               .withColumn("module_id", _id("project_id", "module_name"))
               .withColumn("analysis", F.lit(None).cast("string"))
               .withColumn("analysis_token_count", F.lit(None).cast("bigint")))
    projects = (types.where(F.col("error").isNull())
                .select(F.col("project").alias("project_id"), F.col("project").alias("project_name"),
                        F.col("project").alias("project_location"), "project_type")
                .withColumn("analysis", F.lit(None).cast("string"))
                .withColumn("analysis_token_count", F.lit(None).cast("bigint")))
    contexts = T.readme_context(tree).select(F.col("project").alias("project_id"), "context")
    return RepoCorpus(files, packages, modules, projects, contexts)
