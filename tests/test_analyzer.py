"""Pluggable analyzer: batch function with retries; keyed patch; prompts for a fake LLM."""

from trellis.operators.analyze import apply_patch, run_analyzer


def test_run_analyzer_retries_and_failures(spark):
    prompts = spark.createDataFrame(
        [(1, "sys", "ok please"), (2, "sys", "flaky"), (3, "sys", "always fail")],
        "id long, system_prompt string, user_prompt string")
    state = {}

    def fn(system, user):
        if user == "always fail":
            raise RuntimeError("down")
        if user == "flaky":
            state[user] = state.get(user, 0) + 1
            if state[user] < 2:
                raise TimeoutError("slow")
        return "This " + user.split()[0]

    got = {r.id: r for r in run_analyzer(prompts, fn, "id", parallelism=2, retries=3).collect()}
    assert (got[1].analysis, got[1].status, got[1].attempts) == ("This ok", "ok", 1)
    assert got[2].status == "ok" and got[2].attempts == 2
    assert (got[3].status, got[3].attempts, got[3].analysis) == ("failed", 3, None)
    assert "down" in got[3].error


def test_apply_patch(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, s string, n int")
    patch = spark.createDataFrame([("a", "new", None)], "id string, s string, n int")
    got = {r.id: (r.s, r.n) for r in apply_patch(base, patch, ["id"], ["s", "n"]).collect()}
    assert got == {"a": ("new", 1), "b": ("y", 2)}


def test_patch_with_several_rows_per_key(spark):
    base = spark.createDataFrame([("a", "x", 1)], "id string, s string, n int")
    patch = spark.createDataFrame([("a", "old", 9, 1), ("a", "new", 2, 2)], "id string, s string, n int, v int")
    got = apply_patch(base, patch, ["id"], ["s", "n"], newest_by="v").collect()
    assert [(r.s, r.n) for r in got] == [("new", 2)]
    assert apply_patch(base, patch, ["id"], ["s", "n"]).count() == 1


def test_one_answer_whatever_the_request_size(spark):
    from trellis.operators.analyze import analyze_prompts
    from trellis.operators.summaries import package_prompts
    from trellis.plans.corpus_views import code_corpus
    from trellis.plans.summary_queries import tally_analyzer
    c = code_corpus(spark, "/root/testdata/sf0.001")
    prompts = package_prompts(c.files, c.packages, c.contexts)
    order = ["section", "file_path", "file_id"]
    longest = prompts.selectExpr("max(length(text))").first()[0]
    runs = [sorted(map(tuple, analyze_prompts(prompts, tally_analyzer, ["package_id"], order, parallelism=2, limit=n).collect()))
            for n in (1 << 20, 2 * longest + 1)]
    assert runs[0] == runs[1] and all(r[2] == "ok" for r in runs[0])
    needs = {r.package_id for r in prompts.where("needs_analysis").select("package_id").distinct().collect()}
    assert {r[0] for r in runs[0]} == needs


def _unit(n, text="x" * 30):
    return [("u1", 0, "head ", "sys")] + [("u1", i + 1, f"{text}{i} ", None) for i in range(n)] + [("u2", 0, "small unit", "sys")]


PARTS = "unit string, i long, text string, system_prompt string"


def test_long_prompt_is_combined_until_one_answer_is_left(spark):
    from trellis.operators.analyze import COMBINE_PREFIX, analyze_prompts
    limit = 200

    def fn(system, user):
        assert system == "sys" and len(user) <= limit
        return "c" if user.startswith(COMBINE_PREFIX) else "leaf"

    out = {r.unit: r for r in analyze_prompts(spark.createDataFrame(_unit(400), PARTS), fn, ["unit"], ["i"], parallelism=2, limit=limit).collect()}
    assert out["u2"].analysis == "leaf" and (out["u1"].analysis, out["u1"].status) == ("c", "ok") and len(out) == 2


def test_answers_that_cannot_be_combined_raise(spark):
    import pytest
    from trellis.operators.analyze import analyze_prompts
    with pytest.raises(ValueError, match="do not get fewer"):
        analyze_prompts(spark.createDataFrame(_unit(50), PARTS), lambda s, u: "y" * 150, ["unit"], ["i"], parallelism=2, limit=200)


def test_failed_part_fails_its_unit_only(spark):
    from trellis.operators.analyze import analyze_prompts

    def fn(system, user):
        if "x7 " in user:
            raise RuntimeError("down")
        return "a"

    out = {r.unit: r for r in analyze_prompts(spark.createDataFrame(_unit(40, "x"), PARTS), fn, ["unit"], ["i"], retries=1, parallelism=2, limit=120).collect()}
    assert out["u1"].status == "failed" and "down" in out["u1"].error and out["u2"].status == "ok"


def test_model_called_once_per_prompt(spark):
    from trellis.operators.analyze import analyze_prompts
    acc = spark.sparkContext.accumulator(0)
    rows = [(f"u{i}", 0, f"prompt {i}", "sys") for i in range(30)]

    def fn(system, user):
        acc.add(1)
        return "x"

    out = analyze_prompts(spark.createDataFrame(rows, PARTS), fn, ["unit"], ["i"], parallelism=2)
    assert out.count() == 30 and len(out.collect()) == 30
    assert acc.value == 30


def test_prompts_from_a_file(spark, tmp_path):
    import json
    from trellis.functions.prompts import PROMPTS, as_prompts, load_prompt_table
    from trellis.operators.summaries import project_prompts
    own = {k: {"userPrompt": v["user"], "systemPrompt": f"own {k}"} for k, v in PROMPTS.items()}
    own["project"]["userPrompt"] = "P {projectName} [{moduleAnalyses}] {projectContext}"
    (tmp_path / "p.json").write_text(json.dumps(own))
    prompts = as_prompts(load_prompt_table(spark, str(tmp_path / "p.json")))
    assert as_prompts(load_prompt_table(spark)) == PROMPTS and prompts["file"]["system"] == "own file"
    modules = spark.createDataFrame([("p", "m1", "one", "a {projectContext}"), ("p", "m2", "two", None)], "project_id string, module_id string, module_name string, analysis string")
    projects = spark.createDataFrame([("p", "Proj")], "project_id string, project_name string")
    contexts = spark.createDataFrame([("p", "CTX")], "project_id string, context string")
    rows = project_prompts(modules, projects, contexts, prompts=prompts).orderBy("section", "module_id").collect()
    assert "".join(r.text for r in rows) == "P Proj [Module: one\nAnalysis: a CTX\n\nModule: two\nAnalysis: null] CTX"
    assert rows[0].system_prompt == "own project"
