"""Sinks (replace-upsert, versions, export, command batch), direct module analysis."""

import os
import tempfile

from pyspark.sql import functions as F

from trellis.operators import analyze, sinks
from trellis.plans.corpus_views import code_corpus

from conftest import SF001


def _dir():
    return tempfile.mkdtemp(prefix="trellis-sink-", dir="/tmp")


def test_replace_upsert_keeps_other_keys(spark):
    out = os.path.join(_dir(), "ctx")
    sinks.replace_upsert(spark.createDataFrame([("a", "v1", 1), ("b", "v1", 2)], "project_id string, context string, n int"),
                         out, "project_id")
    sinks.replace_upsert(spark.createDataFrame([("a", "v2", 3)], "project_id string, context string, n int"),
                         out, "project_id")
    got = {r.project_id: r.context for r in spark.read.parquet(out).collect()}
    assert got == {"a": "v2", "b": "v1"}


def test_keyed_update_new_version(spark):
    base = _dir()
    v1 = sinks.write_version(spark.createDataFrame([("f1", None, 0), ("f2", "x", 5)],
                                                   "file_id string, short_analysis string, n int"), base, 1)
    patch = spark.createDataFrame([("f1", "done", 7)], "file_id string, short_analysis string, n int")
    v2 = sinks.keyed_update(spark, v1, patch, ["file_id"], ["short_analysis", "n"], base, 2)
    got = {r.file_id: (r.short_analysis, r.n) for r in spark.read.parquet(v2).collect()}
    assert got == {"f1": ("done", 7), "f2": ("x", 5)}
    assert spark.read.parquet(v1).count() == 2


def test_export_prefers_cached(spark):
    from trellis.operators.summaries import digest_rows
    c = code_corpus(spark, SF001)
    blocks = digest_rows(c.files, c.packages, c.modules, c.projects)
    pid = c.projects.orderBy("project_id").first().project_id
    cached = spark.createDataFrame([(pid, "# cached\n")], "project_id string, context string")
    out = sinks.export_context(blocks, cached)
    mine = out.where(F.col("project_id") == pid).collect()
    assert [r.block for r in mine] == ["# cached\n"]
    assert out.where(F.col("project_id") != pid).count() == blocks.where(F.col("project_id") != pid).count()


def test_write_digest_streams_in_order(spark):
    from trellis.operators.summaries import DIGEST_ORDER, digest_rows, write_digest
    c = code_corpus(spark, SF001)
    blocks = digest_rows(c.files, c.packages, c.modules, c.projects)
    out = os.path.join(_dir(), "digest")
    write_digest(blocks, out, n_files=3)
    pid = c.projects.orderBy("project_id").first().project_id
    pdir = os.path.join(out, f"project_id={pid}")
    text = "".join(open(os.path.join(pdir, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(pdir)) if f.startswith("part-"))
    expected = "".join(r.block for r in blocks.where(F.col("project_id") == pid).orderBy(*DIGEST_ORDER).collect())
    assert text == expected and text.startswith("# ")


def test_analyze_commands(spark):
    c = code_corpus(spark, SF001)
    pid = c.projects.orderBy("project_id").first().project_id
    cmds = sinks.analyze_commands(c.modules, spark.createDataFrame([(pid,)], "project_id string"), 1)
    assert cmds.count() == c.modules.where(F.col("project_id") == pid).count()


def test_direct_module_analysis(spark):
    c = code_corpus(spark, SF001)
    mid = c.modules.orderBy("module_id").first().module_id
    cmds = spark.createDataFrame([(mid,)], "module_id string")
    mods, projs = analyze.analyze_modules_direct(cmds, c.packages, c.modules, c.projects)
    rows = mods.collect()
    assert len(rows) == 1 and rows[0].analysis.startswith("This module ")
    assert projs.count() == 1


def test_export_ignores_empty_cached_copy(spark):
    from trellis.operators.summaries import digest_rows
    c = code_corpus(spark, SF001)
    blocks = digest_rows(c.files, c.packages, c.modules, c.projects, empty_is_missing=True)
    pid = c.projects.orderBy("project_id").first().project_id
    cached = spark.createDataFrame([(pid, "")], "project_id string, context string")
    assert sinks.export_context(blocks, cached).count() == blocks.count()


def test_digest_of_one_project_leaves_the_others(spark):
    from trellis.operators.summaries import digest_rows, write_digest
    c = code_corpus(spark, SF001)
    blocks = digest_rows(c.files, c.packages, c.modules, c.projects)
    out = os.path.join(_dir(), "digest")
    write_digest(blocks, out, n_files=2)
    pid = c.projects.orderBy("project_id").first().project_id
    before = sorted(os.listdir(out))
    write_digest(blocks.where(F.col("project_id") == pid), out, n_files=2)
    assert sorted(x for x in os.listdir(out) if x.startswith("project_id")) == [x for x in before if x.startswith("project_id")]


def test_format_count_as_the_page_shows_it(spark):
    from trellis.functions.text import format_count
    df = spark.createDataFrame([(1234.5, "7", 1234567, None), (1.0, "x", 0, None)], "d double, s string, n long, z long")
    got = [tuple(r) for r in df.select(*[format_count(c) for c in ("d", "s", "n", "z")]).collect()]
    assert got == [("1,234.5", "0", "1,234,567", "0"), ("1", "0", "0", "0")]


def test_checkpoint_folder_must_be_set_on_a_cluster():
    import pytest
    from types import SimpleNamespace
    from trellis.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)
