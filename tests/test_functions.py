"""Small value fixtures (FIXTURES.md §6) for the scalar functions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.functions import paths, text
from trellis.operators import analyze, status
from trellis.sources.commands import parse_commands


def one_col(spark, values, fn, dtype=T.StringType()):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("x", dtype)]))
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_raw_lines(spark):
    got = one_col(spark, ["", "a", "a\n", "a\n\nb", "a\r\nb", "a\rb", None], text.raw_line_count)
    assert got == [0, 1, 1, 3, 2, 2, None]


def test_package_dir_and_basename(spark):
    assert one_col(spark, ["/a/b/C.java", "C.java"], paths.parent_dir_name) == ["b", ""]
    assert one_col(spark, ["/a/b/C.java", "C.java"], paths.basename) == ["C.java", "C.java"]


def test_extension_rules(spark):
    vals = ["A.java", "a.JAVA", "x.tsx", "x.ts", "noext", "a.b/c", ".java", "x.kt"]
    assert one_col(spark, vals, paths.is_source_file) == [True, False, True, True, False, False, True, False]
    assert one_col(spark, vals, paths.file_type) == ["java", "unknown", "typescript-react", "typescript",
                                                     "unknown", "unknown", "java", "kotlin"]
    assert one_col(spark, ["/src/latest/A.java", "/src/A.java", "/x/Target/B.py"],
                   paths.is_valid_source_file) == [False, True, False]


def test_ancestors(spark):
    assert one_col(spark, ["a/b/c"], paths.ancestors) == [["a", "a/b", "a/b/c"]]


def test_template_fill_is_sequential(spark):
    df = spark.createDataFrame([("has {p}", "CTX")], "f string, p string")
    got = df.select(text.fill_template("{p} {f}", [("{f}", F.col("f")), ("{p}", F.col("p"))])).first()[0]
    assert got == "CTX has CTX"
    assert got == "{p} {f}".replace("{f}", "has {p}").replace("{p}", "CTX")


def test_truncate(spark):
    s100, s101 = "x" * 100, "y" * 99 + " z"
    got = one_col(spark, [s100, s101, None, ""], text.truncate_text)
    assert got == [s100, "y" * 99 + "... ", "", ""]


def test_url_rules(spark):
    vals = ["https://github.com/a/b", "https://github.com/a/b.git", "http://github.com/a/b",
            "https://github.com/a/b/c"]
    assert one_col(spark, vals, text.is_valid_repo_url) == [True, True, False, False]
    assert one_col(spark, ["https://github.com/a/b.git"], text.repo_name) == ["b.git"]


def test_zero_is_missing_and_safe_int(spark):
    df = spark.createDataFrame([(0, 3), (5, 3), (None, 3)], "a int, b int")
    assert [r[0] for r in df.select(text.zero_is_missing("a", "b")).collect()] == [3, 5, 3]
    assert one_col(spark, ["12", "x", None], text.safe_int) == [12, 0, 0]


def test_freshness_windows(spark):
    df = spark.sql("""SELECT 'a' AS analysis, timestamp'2024-01-31 01:00:00' AS d23,
                             timestamp'2024-01-31 00:00:00' AS d24, timestamp'2024-02-01 00:00:00' AS as_of""")
    as_of = F.col("as_of")
    r = df.select(analyze.is_fresh("analysis", "d23", as_of, "package").alias("p23"),
                  analyze.is_fresh("analysis", "d23", as_of, "module").alias("m23"),
                  analyze.is_fresh("analysis", "d24", as_of, "package").alias("p24"),
                  analyze.is_fresh(F.lit(""), "d23", as_of, "package").alias("empty")).first()
    assert (r.p23, r.m23, r.p24, r.empty) == (True, False, False, False)


def test_progress_step(spark):
    assert one_col(spark, [0, 20, 50, 80, 100], status.progress_step, T.IntegerType()) == [-1, 0, 1, 2, 3]


def test_status_latest_keeps_error(spark):
    log = spark.createDataFrame([
        ("i", 1, "2024-01-01 00:00:00", "in_progress", 5, "m", None),
        ("i", 2, "2024-01-01 00:00:01", "failed", 0, "m", "boom"),
        ("i", 3, "2024-01-01 00:00:02", "in_progress", 10, "m", None)],
        "import_id string, seq long, ts string, status string, progress int, message string, error string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    r = status.latest_status(log).first()
    assert (r.status, r.progress, r.error, r.n_updates) == ("in_progress", 10, "boom", 3)
    feed = [x.seq for x in status.status_feed(log).orderBy("seq").collect()]
    assert feed == [1, 2]


def test_command_parse(spark):
    df = spark.createDataFrame([
        ('{"project_name": "p", "github_url": "u", "import_id": "i", "timestamp": "5"}',),
        ('{"project_name": "p", "github_url": "u"}',),
        ('{"project_name": "p", "github_url": "u", "import_id": "i", "project_context": "c"}',)], "body string")
    rows = parse_commands(df, "body", F.lit(99).cast("bigint")).collect()
    assert (rows[0].status, rows[0].cmd_ts_ms, rows[0].cmd_project_context) == ("ok", 5, "")
    assert (rows[1].status, rows[1].reason) == ("quarantined", "Missing required field: import_id")
    assert (rows[2].cmd_ts_ms, rows[2].cmd_project_context) == (99, "c")


def test_point_read_pushes_filter(spark):
    from trellis.sources.tables import point_read
    df = point_read(spark, "/root/testdata/sf0.01", "events", F.col("user_id") == 7, newest_by="ts",
                    columns=["event_id", "ts", "user_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan
    rows = df.collect()
    assert len(rows) == 1 and rows[0].user_id == 7


def test_token_distribution_close_to_numpy(spark):
    import numpy as np
    from trellis.operators.metrics import token_distribution
    from trellis.plans.corpus_views import code_corpus
    f = code_corpus(spark, "/root/testdata/sf0.01").files.select("project_id", "code_token_count")
    got = {r.project_id: r for r in token_distribution(f).collect()}
    pdf = f.toPandas()
    for pid, g in pdf.groupby("project_id"):
        vals = np.sort(g["code_token_count"].to_numpy())
        assert got[pid].n == len(vals) and got[pid].max == vals[-1]
        p50 = got[pid].p[0]
        rank = np.searchsorted(vals, p50, side="right") / len(vals)
        assert abs(rank - 0.5) <= 0.02


def test_truncate_trims_like_the_ui(spark):
    s = "x" * 99 + "\n" + "tail that is cut"
    t = " " + "y" * 120
    assert one_col(spark, [s, t], text.truncate_text) == ["x" * 99 + "... ", "y" * 99 + "... "]


def test_latest_left_defaults_and_nulls(spark):
    from trellis.operators import snapshots
    base = spark.createDataFrame([("p1",), ("p2",)], "project_id string")
    snaps = spark.createDataFrame([("p1", 1, 10, "2024-01-01 00:00:00"), ("p1", 2, 20, "2024-01-02 00:00:00"),
                                   ("p1", 3, 5, "2024-01-01 12:00:00")],
                                  "project_id string, snapshot_id long, file_count int, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.project_id: r for r in snapshots.latest_left(base, snaps, ["project_id"], ["ts", "snapshot_id"],
                                                          ["snapshot_id", "file_count"],
                                                          defaults={"file_count": 0, "n_snapshots": 0}).collect()}
    assert (got["p1"].snapshot_id, got["p1"].file_count, got["p1"].n_snapshots) == (2, 20, 3)
    assert (got["p2"].snapshot_id, got["p2"].file_count, got["p2"].n_snapshots) == (None, 0, 0)
    oldest = snapshots.pick_per_key(snaps, ["project_id"], ["ts", "snapshot_id"], ["snapshot_id"], newest=False)
    assert oldest.first().snapshot_id == 1
