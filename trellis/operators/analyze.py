"""The analysis step: skip rules, the default extractive analyzer, a pluggable batch analyzer.

* Freshness (per level window) and "already analysed" tests decide what is
  skipped; ``Record`` files get a fixed placeholder and zero tokens.
* The default analyzer is native: a sentence over the whole file text, and per
  level a sentence over every child (count, tokens, and a sum of the children's
  digests, which partial aggregation combines), so tests need no network.
* ``run_analyzer`` runs any user function ``fn(system, user) -> str`` over
  prompt rows with ``mapInPandas`` (Arrow batches), ``parallelism`` tasks
  (the reference's bounded in-flight calls) and bounded retries; failures
  become status/error columns, never a job failure.
* ``apply_patch`` is the keyed ``$set``: left join + coalesce, then the
  caller rewrites the table atomically.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions.text import non_empty, pre_token_count
from trellis.operators.ledger import AnswerLedger
from trellis.operators.ordered_text import REQUEST_CHARS, requests
from trellis.session import cut_lineage
from trellis.sources.corpus import stored_summary

# Freshness windows per level, the Record rule and its placeholder.
FRESH_WINDOW_SECONDS = {"package": 24 * 3600, "module": 3600, "project": 3600}
RECORD_MARKER = "Record"
NOT_ANALYZED = "not analyzed"


def is_fresh(analysis, analysis_date, as_of: Column, level: str) -> Column:
    """Non-empty analysis and analysed strictly less than the window ago (exactly W → stale)."""
    w = FRESH_WINDOW_SECONDS[level]
    a = F.col(analysis) if isinstance(analysis, str) else analysis
    d = F.col(analysis_date) if isinstance(analysis_date, str) else analysis_date
    cutoff = as_of - F.expr(f"INTERVAL {w} SECONDS")
    return F.coalesce(non_empty(a) & (d > cutoff), F.lit(False))


def is_file_analysed(short_analysis) -> Column:
    """File already analysed: short analysis present and non-empty (no date cutoff)."""
    return non_empty(short_analysis)


def is_record_file(path) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return p.contains(RECORD_MARKER)


def text_digest(text) -> Column:
    """The first eight hex digits of a text's md5 as a number; sums of it identify a set of texts."""
    t = F.col(text) if isinstance(text, str) else text
    return F.conv(F.substring(F.md5(F.coalesce(t, F.lit(""))), 1, 8), 16, 10).cast("bigint")


def child_sums(children: DataFrame, key: list[str], text: str) -> DataFrame:
    """Per key: number, tokens and digest sum of all child texts."""
    return children.groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"), F.sum(pre_token_count(text)).alias("child_tokens"),
                                      F.sum(text_digest(text)).alias("child_digest"))


def level_summary(level: str, name: Column) -> Column:
    """One sentence over all children of a row joined with ``child_sums`` (none: zeros)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").cast("string")
    return F.concat(F.lit(f"This {level} "), name, F.lit(" has "), z("n_children"), F.lit(" parts of "), z("child_tokens"),
                    F.lit(" tokens, digest "), z("child_digest"), F.lit("."))


def analyze_files(files: DataFrame) -> DataFrame:
    """File stage: Record files skipped with a placeholder; analysed files kept; others summarised."""
    rec = is_record_file("file_path")
    done = is_file_analysed("short_analysis")
    new_short = (F.when(rec, F.lit(NOT_ANALYZED))
                 .when(done, F.col("short_analysis"))
                 .otherwise(stored_summary("content")))
    return (files.withColumn("short_analysis", new_short)
            .withColumn("code_token_count", F.when(rec, F.lit(0).cast("bigint")).otherwise(F.col("code_token_count")))
            .withColumn("analysis_token_count",
                        F.when(rec, F.lit(0).cast("bigint")).otherwise(pre_token_count("short_analysis")))
            .withColumn("action", F.when(rec, "skip_record").when(done, "skip_fresh").otherwise("analyze")))


def _with_summary(df: DataFrame, analysis: Column) -> DataFrame:
    return (df.withColumn("analysis", analysis).withColumn("analysis_token_count", pre_token_count("analysis"))
            .drop("n_children", "child_tokens", "child_digest"))


def analyze_packages(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Package stage: at most one file by (module, package name) gives ''; else a summary of all files."""
    kids = child_sums(files, ["module_id", "package_name"], "short_analysis")
    p = packages.join(kids, ["module_id", "package_name"], "left")
    n = F.coalesce("n_children", F.lit(0))
    return _with_summary(p.withColumn("n_files", n), F.when(n <= 1, F.lit("")).otherwise(level_summary("package", F.col("package_name"))))


def analyze_modules(packages: DataFrame, modules: DataFrame) -> DataFrame:
    """Module stage over all root packages."""
    kids = child_sums(packages.where(F.col("parent_package_id").isNull()), ["module_id"], "analysis")
    m = modules.drop("analysis", "analysis_token_count").join(kids, "module_id", "left")
    return _with_summary(m.withColumn("n_roots", F.coalesce("n_children", F.lit(0))), level_summary("module", F.col("module_name")))


def analyze_projects(modules: DataFrame, projects: DataFrame) -> DataFrame:
    """Project stage over all modules."""
    kids = child_sums(modules, ["project_id"], "analysis")
    p = projects.drop("analysis", "analysis_token_count").join(kids, "project_id", "left")
    return _with_summary(p.withColumn("n_modules", F.coalesce("n_children", F.lit(0))), level_summary("project", F.col("project_name")))


def analyze_modules_direct(commands: DataFrame, packages: DataFrame, modules: DataFrame,
                           projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Command bypass: re-analyse the commanded modules now (no barrier), then their projects.

    ``commands`` has ``module_id``; only those modules are recomputed, and the
    project stage runs for the projects they belong to, over all their modules.
    """
    wanted = modules.join(commands.select("module_id").distinct(), "module_id", "left_semi")
    fresh = analyze_modules(packages, wanted)
    all_mods = apply_patch(modules, fresh.select("module_id", "analysis", "analysis_token_count"),
                           ["module_id"], ["analysis", "analysis_token_count"])
    touched = projects.join(fresh.select("project_id").distinct(), "project_id", "left_semi")
    return fresh, analyze_projects(all_mods, touched)


def apply_patch(base: DataFrame, patch: DataFrame, key: list[str], cols: list[str],
                newest_by: str | None = None) -> DataFrame:
    """Keyed field update: patched columns win where the patch has a row and a value.

    A key with several patch rows takes the newest by ``newest_by`` (without it, the
    greatest row), so a base row is never multiplied.
    """
    row = F.struct(*[F.col(c) for c in cols])
    pick = F.max_by(row, newest_by) if newest_by else F.max(row)
    p = (patch.groupBy(*key).agg(pick.alias("__p"))
         .select(*key, *[F.col("__p")[c].alias(f"__p_{c}") for c in cols]))
    out = base.join(p, key, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"__p_{c}"), F.col(c)))
    return out.drop(*[f"__p_{c}" for c in cols])


def run_analyzer(prompts: DataFrame, fn: Callable[[str, str], str], id_col: str,
                 parallelism: int = 5, retries: int = 3, backoff_s: float = 0.0) -> DataFrame:
    """Apply ``fn(system_prompt, user_prompt)`` to each prompt row in Arrow batches.

    Returns ``id_col, analysis, status ('ok'|'failed'), error, attempts``. The
    input is spread over ``parallelism`` tasks, which bounds concurrent calls.
    """
    id_type = prompts.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, analysis string, status string, error string, attempts int"

    def part(batches):
        for pdf in batches:
            out_a, out_s, out_e, out_n = [], [], [], []
            for sp, up in zip(pdf["system_prompt"], pdf["user_prompt"]):
                result, err, n = None, None, 0
                while n < retries:
                    n += 1
                    try:
                        result = fn(sp, up)
                        err = None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure is retried then reported
                        err = f"{type(e).__name__}: {e}"
                        if backoff_s:
                            time.sleep(backoff_s * n)
                out_a.append(result)
                out_s.append("ok" if err is None else "failed")
                out_e.append(err)
                out_n.append(n)
            yield pd.DataFrame({id_col: pdf[id_col], "analysis": out_a, "status": out_s,
                                "error": out_e, "attempts": out_n})

    return (prompts.select(id_col, "system_prompt", "user_prompt")
            .repartition(parallelism)
            .mapInPandas(part, schema))


COMBINE_PREFIX = "Combine these partial analyses of one unit, in order, into a single analysis:\n\n"


def analyze_prompts(parts: DataFrame, fn: Callable[[str, str], str], key: list[str], order: list[str],
                    parallelism: int = 5, retries: int = 3, limit: int = REQUEST_CHARS, ledger: AnswerLedger | None = None) -> DataFrame:
    """Run the analyzer over prompts given as long tables (``key, *order, text, system_prompt``).

    The rows of each prompt are packed into requests under ``limit`` characters. A prompt that fits
    is one request. The answers of a longer one become the rows of a combine prompt, and so
    on until it has one answer; a round that does not reduce a prompt's requests raises, for then
    the answers are too long to combine. With a ``ledger``, requests that it knows are not sent, and answers
    are kept as they come. Returns ``key + [analysis, status, error]``, one row per prompt.
    """
    def rid(cols):
        return F.concat_ws("\u0001", *[F.col(k).cast("string") for k in cols])

    rows = parts.where(F.col("text").isNotNull())
    system = rows.where(F.col("system_prompt").isNotNull()).groupBy(*key).agg(F.max("system_prompt").alias("system_prompt"))
    packed = requests(rows.select(*key, *order, "text", "system_prompt"), key, order, "text", limit, "system_prompt")
    done, most, prefix = None, None, ""
    while True:
        asked = (packed.withColumn("user_prompt", F.concat(F.lit(prefix), F.col("text")))
                 .withColumn("__rid", rid(key + ["piece"])))
        # model calls are costly and not repeatable: each round's answers are written
        # once (reliable checkpoint) and every later step reads them from there
        asked = cut_lineage(asked.drop("text"))
        answers = ledger.ask(asked, fn, "__rid", parallelism, retries) if ledger else run_analyzer(asked, fn, "__rid", parallelism, retries)
        cur = cut_lineage(asked.select(*key, "piece", "n_pieces", "__rid").join(answers, "__rid"))
        if done is not None:
            cur = cur.join(failed, key, "left").withColumn("error", F.coalesce("error", "part_error")) \
                .withColumn("status", F.when(F.col("part_error").isNull(), F.col("status")).otherwise("failed")).drop("part_error")
        finished = cur.where("n_pieces = 1").select(*key, "analysis", "status", "error")
        done = finished if done is None else done.unionByName(finished)
        open_ = cur.where("n_pieces > 1")
        n = open_.agg(F.max("n_pieces")).first()[0]
        if n is None:
            return done
        if most is not None and n >= most:
            raise ValueError(f"{n} partial answers do not get fewer under a limit of {limit} characters")
        most, prefix = n, COMBINE_PREFIX
        failed = cut_lineage(open_.where("status <> 'ok'").groupBy(*key).agg(F.min("error").alias("part_error")))
        entries = open_.select(*key, "piece", F.concat(F.lit("Part "), (F.col("piece") + 1).cast("string"), F.lit(":\n"),
                                                       F.coalesce("analysis", F.lit("")), F.lit("\n\n")).alias("text"))
        packed = requests(entries, key, ["piece"], "text", limit - len(COMBINE_PREFIX)).join(system, key, "left")
