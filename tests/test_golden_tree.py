"""Hand-computed answers on the small repository tree of FIXTURES.md §5."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from trellis.functions import paths
from trellis.operators import java_meta
from trellis.sources import tree as T

APP = """package com.acme.core;

/* block
   comment */
public class App {
    // line comment
    public String run(String a, int b) { return "/* not a comment */"; }
    public String getName() { return n; }
    public void setName(String n) { this.n = n; }
    public int getAt(int i) { return i; }
    void hidden() {}
}
"""

FILES = {
    "acme/pom.xml": "<project><modules><module>core</module><module>web</module><module>core</module>"
                    "</modules><profiles><profile><modules><module>extra</module></modules></profile>"
                    "</profiles></project>",
    "acme/README.md": "Acme\n",
    "acme/readme.txt": "ignored\n",
    "acme/core/src/App.java": APP,
    "acme/core/src/Empty.java": "class Empty {}\n",
    "acme/core/src/util/helper.py": "x = 1\n\nprint(x)\n",
    "acme/core/src/util/HelperTest.java": "class HelperTest {}\n",
    "acme/core/target/Gen.java": "class Gen {}\n",
    "acme/web/src/index.tsx": "export {}",
    "acme/web/src/notes.kt": "val x = 1\n",
    "acme/web/src/UserRecord.scala": "case class UserRecord(id: Int)\n",
    "acme/extra/README.md": "nothing\n",
    "broken/pom.xml": "<project><modules>",
    "gradle1/build.gradle": "apply plugin: 'java'\n",
    "gradle1/settings.gradle": "include ':api', ':impl'\ninclude \":core\"\n",
    "gradle2/build.gradle.kts": "plugins {}\n",
    "gradle2/settings.gradle.kts": "include(\":x\")\n",
    "gradle2/src/A.java": "class A {}\n",
}


@pytest.fixture(scope="module")
def root():
    base = tempfile.mkdtemp(prefix="trellis-golden-", dir="/tmp")
    assert "test" not in base.lower() and "target" not in base.lower()
    for rel, content in FILES.items():
        p = os.path.join(base, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8", newline="") as fh:
            fh.write(content)
    return base


@pytest.fixture(scope="module")
def tree(spark, root):
    return T.scan_tree(spark, root).cache()


def test_project_types(tree):
    got = {r.project: (r.project_type, r.error) for r in T.project_types(tree).collect()}
    assert got["acme"] == ("maven", None)
    assert got["broken"] == (None, "Invalid pom.xml file")
    assert got["gradle1"][0] == "gradle" and got["gradle2"][0] == "gradle"
    msg = T.project_types(tree).where("project = 'acme'").first().message
    assert msg == "Project detected as MAVEN project"


def test_modules_in_order(tree):
    types = T.project_types(tree)
    mods = T.project_modules(tree, types)
    acme = [r.module for r in mods.where("project = 'acme'").orderBy("ordinal").collect()]
    assert acme == ["core", "web", "extra"]
    g1 = [r.module for r in mods.where("project = 'gradle1'").orderBy("ordinal").collect()]
    assert g1 == ["api", "core"]
    g2 = [r.module for r in mods.where("project = 'gradle2'").collect()]
    assert g2 == ["default"]
    kept = {r.module for r in T.modules_with_sources(mods, tree).where("project = 'acme'").collect()}
    assert kept == {"core", "web"}


def test_readme_context(tree):
    ctx = {r.project: r.context for r in T.readme_context(tree).collect()}
    assert ctx["acme"] == "Acme\n"
    assert ctx["gradle1"] == ""


def test_valid_files_and_types(tree):
    valid = T.source_files(tree).where("project = 'acme'").select(
        paths.basename("rel_path").alias("n"), paths.file_type("rel_path").alias("t")).collect()
    got = {r.n: r.t for r in valid}
    assert got == {"App.java": "java", "Empty.java": "java", "helper.py": "python",
                   "index.tsx": "typescript-react", "UserRecord.scala": "scala"}
    kt = tree.where(F.col("rel_path").endswith("notes.kt")).select(
        paths.file_type("rel_path").alias("t"), paths.is_valid_source_file("abs_path").alias("v")).first()
    assert kt.t == "kotlin" and kt.v is False


def test_raw_lines(tree):
    from trellis.functions.text import raw_line_count
    rows = T.source_files(tree).where("project = 'acme'").select(
        paths.basename("rel_path").alias("n"), raw_line_count("content").alias("l")).collect()
    assert {r.n: r.l for r in rows} == {"App.java": 12, "Empty.java": 1, "helper.py": 3, "index.tsx": 1,
                                        "UserRecord.scala": 1}


def test_java_metadata(spark, tree):
    files = (T.source_files(tree).where("project = 'acme'")
             .select(F.monotonically_increasing_id().alias("file_id"), F.col("rel_path").alias("file_path"),
                     "content"))
    meta = java_meta.java_metadata(files).join(files.select("file_id", "file_path"), "file_id")
    got = {os.path.basename(r.file_path): r for r in meta.collect()}
    assert got["App.java"].code_lines == 8
    assert got["App.java"].declared_package == "com.acme.core"
    assert list(got["App.java"].public_methods) == ["run(String, int)", "getAt(int)"]
    assert got["Empty.java"].code_lines == 1 and got["Empty.java"].declared_package is None


def test_directory_packages(spark, tree):
    files = (T.source_files(tree).where("project = 'acme'")
             .select(F.monotonically_increasing_id().alias("file_id"), F.col("rel_path").alias("file_path"),
                     "content"))
    meta = java_meta.java_metadata(files).select("file_id", "declared_package")
    fm = (files.join(meta, "file_id", "left")
          .withColumn("dir_path", paths.dirname("file_path")))
    got = {r.dir_path: r.package_name for r in java_meta.directory_packages(fm).collect()}
    assert got == {"core/src": "com.acme.core", "core/src/util": "util", "web/src": "src"}
    missing = [os.path.basename(r.file_path) for r in java_meta.files_without_package(fm).collect()]
    assert missing == ["Empty.java"]


def test_repository_corpus_end_to_end(spark, root):
    from trellis.operators import metrics, summaries
    from trellis.plans.corpus_views import file_level
    from trellis.sources.corpus import with_file_metrics
    from trellis.sources.repo_corpus import repository_corpus

    c = repository_corpus(spark, root)
    acme_pk = {r.package_name: r for r in c.packages.where("project_id = 'acme'").collect()}
    assert set(acme_pk) == {"com.acme.core", "util", "src"}
    assert acme_pk["util"].parent_package_id == acme_pk["com.acme.core"].package_id
    assert acme_pk["com.acme.core"].parent_package_id is None and acme_pk["src"].parent_package_id is None
    mods = {r.module_name for r in c.modules.where("project_id = 'acme'").collect()}
    assert mods == {"core", "web"}

    files = with_file_metrics(c.files)
    pm = {r.package_id: r for r in metrics.package_metrics(file_level(files), c.packages).collect()}
    by_name = {n: pm[p.package_id].file_count for n, p in acme_pk.items()}
    assert by_name == {"com.acme.core": 2, "util": 1, "src": 2}
    assert pm[acme_pk["com.acme.core"].package_id].lines_of_code == 13

    ctx = {r.project_id: r.context for r in c.contexts.collect()}
    assert ctx["acme"] == "Acme\n"
    prompts = summaries.package_prompts(c.files, c.packages, c.contexts)
    names = {r.package_id: n for n, r in acme_pk.items()}
    needs = {names[r.package_id]: r.needs_analysis for r in prompts.where("section = 0").collect() if r.package_id in names}
    # files per package by (module, package name): com.acme.core 1 (Empty declares none), util 1, src 2
    assert needs == {"com.acme.core": False, "util": False, "src": True}
    blocks = summaries.digest_rows(c.files, c.packages, c.modules, c.projects).where("project_id = 'acme'")
    text = "".join(r.block for r in blocks.orderBy(*summaries.DIGEST_ORDER).collect())
    assert text.startswith("# acme - ") and "#### File: App.java" in text and "No analysis available" in text


def test_scan_finds_hidden_names_and_keeps_paths(spark, tmp_path):
    from trellis.sources.repo_corpus import repository_corpus
    base = tmp_path / "repos here"
    for rel, content in {"p 1/pom.xml": "<project><modules><module>./core</module><module>web/</module></modules></project>",
                         "p 1/core/__init__.py": "x = 1\n", "p 1/core/_priv/a b.py": "y = 2\n", "p 1/web/_app.tsx": "export {}\n",
                         "p 1/.hidden/c%20d.py": "z\n", "loose.txt": "no project\n"}.items():
        f = base / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(content.encode() + b"\xff")
    for root in (str(base), f"file://{base}", f"{base}/"):
        got = {(r.project, r.rel_path) for r in T.scan_tree(spark, root).collect()}
        assert got == {("p 1", "pom.xml"), ("p 1", "core/__init__.py"), ("p 1", "core/_priv/a b.py"), ("p 1", "web/_app.tsx"), ("p 1", ".hidden/c%20d.py")}
    mods = T.maven_modules(spark.createDataFrame([("p", "pom.xml", "<m><modules><module>./a//b/</module><module>x/../c</module><module>../d</module></modules></m>")],
                                                 "project string, rel_path string, content string")).collect()[0].modules
    assert mods == ["a/b", "c", "../d"]


def test_no_python_over_file_contents_but_poms(spark):
    df = spark.createDataFrame([("p", "a.java", "class A {}")], "project string, rel_path string, content string")
    plan = T.project_types(df)._jdf.queryExecution().executedPlan().toString()
    udf = plan[plan.index("ArrowEvalPython"):]
    assert "pom.xml" in udf.split("LocalTableScan")[0].split("Scan")[0]
