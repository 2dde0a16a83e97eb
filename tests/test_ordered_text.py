"""Packed requests hold all rows in order; ordinals and running totals are exact."""

from pyspark.sql import functions as F

from trellis.operators.ordered_text import ordinals, requests, running_totals


def test_ordinals_exact(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 501).alias("o"))
    got = ordinals(df, ["k"], ["o"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.o, r.ordinal))
    for k, pairs in by.items():
        pairs.sort()
        assert [p[1] for p in pairs] == list(range(len(pairs)))


def test_requests_hold_every_row_once_in_order(spark):
    rows = [("hot" if i % 3 else f"cold{i % 5}", i, f"entry-{i:04d};") for i in range(600)]
    df = spark.createDataFrame(rows, "k string, o long, t string")
    for limit in (100, 500, 1 << 20):
        by = {}
        for r in requests(df, ["k"], ["o"], "t", limit).collect():
            assert len(r.text) <= limit
            by.setdefault(r.k, []).append((r.piece, r.text, r.n_pieces))
        for k, parts in by.items():
            parts.sort()
            assert len(parts) == parts[0][2]
            assert "".join(t for _, t, _ in parts) == "".join(t for kk, o, t in sorted(rows, key=lambda x: x[1]) if kk == k)
        assert (len(by["hot"]) > 1) == (limit <= 500)


def test_running_totals(spark):
    df = spark.range(500).selectExpr("id % 3 AS k", "id AS o", "id % 7 AS w")
    want = {}
    for i in range(500):
        want[i] = sum(j % 7 for j in range(i % 3, i, 3))
    assert {r.o: r.before for r in running_totals(df, ["k"], ["o"], "w").collect()} == want


def test_ordinals_stable_when_branches_prune_differently(spark):
    from pyspark.sql import Window
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id", "ts", "user_id", "event_type")
    r = ordinals(e, ["user_id"], ["ts", "event_id"])
    ref = e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    j = r.select("event_id", "event_type", (F.col("ordinal") % 10).alias("step"), "ordinal").join(
        ref.select("event_id", "rn"), "event_id")
    assert j.where(F.col("ordinal") != F.col("rn")).count() == 0
    assert j.agg(F.min("step")).first()[0] == 0


def test_file_texts_are_not_gathered_by_project(spark, monkeypatch):
    """Contexts go to the files, not the files to their project's task; the prompts are those of the join."""
    from trellis.operators import summaries
    files = spark.createDataFrame([(i, None if i == 7 else f"p{i % 3}", f"text {i} {{projectContext}}") for i in range(40)], "file_id long, project_id string, content string") \
        .selectExpr("file_id", "project_id", "'m' AS module_id", "'k' AS package_id", "'f' AS file_path", "content")
    contexts = spark.createDataFrame([("p0", "first"), ("p1", None)], "project_id string, context string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with sizes that Spark takes for large
    try:
        got = summaries.file_prompts(files, contexts)
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        rows = sorted(got.collect(), key=lambda r: r.file_id)
        monkeypatch.setattr(summaries, "BROADCAST_LIMIT_BYTES", 0)
        joined = summaries.file_prompts(files, contexts)
        assert "hashpartitioning" in joined._jdf.queryExecution().executedPlan().toString() and sorted(joined.collect(), key=lambda r: r.file_id) == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_texts_that_fit_move_once(spark, monkeypatch):
    """Keys under the limit are packed by one shuffle of their texts; long ones and null keys are as ever."""
    from trellis.operators import ordered_text
    rows = [("a", 1, "x" * 10), ("a", 2, None), ("b", 1, "y" * 30), ("c", 2, "2" * 9), ("c", 1, "1" * 9), (None, 1, "z")]
    rows += [("d", i, str(i % 10) * 9) for i in range(8)]
    parts = spark.createDataFrame(rows, "k string, i int, t string")
    def run(frame):
        return {(r.k, r.piece): (r.n_pieces, r.text, r.n_parts) for r in ordered_text.requests(frame, ["k"], ["i"], "t", 20).collect()}
    want = {("a", 0): (1, "x" * 10, 2), ("b", 0): (1, "y" * 30, 1), ("c", 0): (1, "1" * 9 + "2" * 9, 2),
            **{("d", p): (7, t, n) for p, t, n in [(0, "0" * 9 + "1" * 9, 2), *[(p, str(p + 1) * 9, 1) for p in range(1, 7)]]}}
    assert run(parts) == want
    monkeypatch.setattr(ordered_text, "FEW_KEYS", 0)
    assert run(parts) == want
    short = ordered_text.requests(parts.where("k <> 'd'"), ["k"], ["i"], "t", 20)
    assert short._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
