"""Assembled level tables of the two corpora, shared by the registered queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.sources import corpus


class CodeCorpus:
    """Level tables of the code corpus, built lazily from one shared scan plan.

    ``files``/``text_files`` are lazy plans over the scan; the small level
    tables are persisted once per session (see ``_dimension``). An eager
    ``checkpoint()`` of them was measured and cost more than it saved.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf = spark, sf_dir
        self._raw = corpus.vc_files(spark, sf_dir)
        self._base = self._raw.select("package_id", "module_id", "module_name", "project_id", "dir",
                                      "package_name")

    @cached_property
    def files(self) -> DataFrame:
        """File rows with derived metadata (lazy plan; unused metric columns are pruned)."""
        return corpus.with_file_metrics(self._raw)

    @cached_property
    def text_files(self) -> DataFrame:
        """Same rows, for queries that compute line/token counts over whole contents.

        These go through the scan-parallelism guard so the text expressions
        use every core; other queries read ``files`` and never shuffle the text.
        """
        return corpus.with_file_metrics(self._raw, cache_key=("documents", self._sf), spread=True)

    @cached_property
    def packages(self) -> DataFrame:
        """Package rows incl. parent and stored analysis."""
        return _dimension(self._spark, self._sf, "packages",
                          lambda: corpus.level_analysis(corpus.vc_packages(self._base), "package"))

    @cached_property
    def modules(self) -> DataFrame:
        return _dimension(self._spark, self._sf, "modules",
                          lambda: corpus.level_analysis(corpus.vc_modules(self._base), "module"))

    @cached_property
    def projects(self) -> DataFrame:
        return _dimension(self._spark, self._sf, "projects",
                          lambda: corpus.level_analysis(corpus.vc_projects(self._base), "project"))

    @cached_property
    def contexts(self) -> DataFrame:
        """project_id, context."""
        return _dimension(self._spark, self._sf, "contexts",
                          lambda: corpus.vc_contexts(self._raw.select("project_id", "file_id", "content")))


_DIMENSIONS: dict[tuple, dict[str, DataFrame]] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Modification time and size of a table's files, so that a changed folder is not answered from old rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(p)))


def _dimension(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Persist a small derived dimension once per session and source folder.

    Level tables (packages with parents, modules, projects, contexts) are
    referenced by many branches of one plan and by many queries; persisting
    them (memory, spilling to disk) lets every branch read one copy instead
    of re-deriving it. They are recomputed from lineage if blocks are lost.
    """
    where = (spark.sparkContext.applicationId, id(spark), sf_dir)
    key = (*where, _stamp(spark, f"{sf_dir}/documents.parquet"))
    for old in [k for k in _DIMENSIONS if k[:3] == where and k != key]:  # the folder changed
        for df in _DIMENSIONS.pop(old).values():
            df.unpersist()
    memo = _DIMENSIONS.setdefault(key, {})
    if name not in memo:
        memo[name] = build().persist()
    return memo[name]


def release_dimensions() -> None:
    """Unpersist every memoised dimension (e.g. after the source folder changed)."""
    for memo in _DIMENSIONS.values():
        for df in memo.values():
            df.unpersist()
    _DIMENSIONS.clear()


def code_corpus(spark: SparkSession, sf_dir: str) -> CodeCorpus:
    return CodeCorpus(spark, sf_dir)


def file_level(files: DataFrame) -> DataFrame:
    """Column subset used by the metric chain (keeps the scan narrow)."""
    return files.select("file_id", "package_id", "module_id", "project_id", "lines_of_code",
                        "code_token_count", "analysis_token_count")


def relational_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.vr_files(spark, sf_dir)


def as_of_literal(as_of: str = "2024-02-01 00:00:00") -> F.Column:
    return F.lit(as_of).cast("timestamp")
