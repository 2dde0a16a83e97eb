"""Level prompts (file, package, module, project) and the markdown digest.

Prompt = level template with sequential placeholder fill + the ordered,
separator-joined child summaries. Child order is the stated contract
(path, then id). A prompt over children is a long table, one row per child
between the template's head and tail, at every group size: no task ever
holds a group. Placeholders inside child texts are filled as in a sequential
fill of the whole prompt.

The digest is produced as a long table — one row per heading block with a
composite sort key — so no project is ever assembled into one value; the
writer streams it in key order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions import paths
from trellis.functions.prompts import CHILD_SEPARATOR, PROMPTS, SYSTEM_FILL_ORDER, USER_FILL_ORDER
from trellis.functions.text import fill_template
from trellis.session import BROADCAST_LIMIT_BYTES, cut_lineage

NO_ANALYSIS = "No analysis available"  # fixed value: digest placeholder for a missing analysis
DIGEST_TITLE = "Analysis Context"      # heading suffix of the project digest (configurable)


def _fill(level: str, values: dict, prompts: dict | None = None) -> tuple[F.Column, F.Column]:
    p = (prompts or PROMPTS)[level]
    user = fill_template(p["user"], [(k, values[k]) for k in USER_FILL_ORDER[level]])
    system = fill_template(p["system"], [(k, values[k]) for k in SYSTEM_FILL_ORDER[level]])
    return user, system


def _with_context(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """File rows with their project's context; contexts small enough, as measured, come to the files,
    so that no task gets the texts of a whole project."""
    row = F.coalesce(F.octet_length("context"), F.lit(0)) + 100
    small = (contexts.agg(F.sum(row.cast("long"))).first()[0] or 0) <= BROADCAST_LIMIT_BYTES
    return files.join(F.broadcast(contexts) if small else contexts, "project_id", "left")


def file_prompts(files: DataFrame, contexts: DataFrame, short: bool = True,
                 prompts: dict | None = None) -> DataFrame:
    """Per-file prompt (short or full template) with the project context filled in."""
    f = _with_context(files, contexts)
    user, system = _fill("fileShort" if short else "file",
                         {"{fileContent}": F.col("content"), "{projectContext}": F.col("context")}, prompts)
    return f.select("file_id", "project_id", "module_id", "package_id", "file_path",
                    user.alias("user_prompt"), system.alias("system_prompt"))


def _parts(level: str, list_key: str, values: dict, prompts: dict | None = None) -> tuple[F.Column, F.Column, F.Column]:
    """Text before the child list, text after it, and the system prompt, with all other placeholders filled."""
    p = (prompts or PROMPTS)[level]
    before, found, after = p["user"].partition(list_key)
    if not found or list_key in after:
        raise ValueError(f"the {level} template needs {list_key} once")
    pairs = [(k, values[k]) for k in USER_FILL_ORDER[level] if k != list_key]
    system = fill_template(p["system"], [(k, values[k]) for k in SYSTEM_FILL_ORDER[level]])
    return fill_template(before, pairs), fill_template(after, pairs), system


def _with_later_fills(entries: DataFrame, contexts: DataFrame) -> DataFrame:
    """The context is filled last, so a child text that holds its placeholder is filled too.

    Only such entries (hardly any) are joined to the long context texts.
    """
    key = "{projectContext}"
    holds = F.col("text").contains(key)
    filled = (entries.where(holds).join(contexts, "project_id", "left")
              .withColumn("text", fill_template(F.col("text"), [(key, F.col("context"))])).select(*entries.columns))
    return entries.where(~holds).unionByName(filled)


def _first_of(entries: DataFrame, key: list[str], order: list[str]) -> F.Column:
    """Whether a row is the first of its key; ``entries`` was joined with ``__first`` by ``_mark_first``."""
    first = F.lit(True)
    for c in order:
        first = first & F.col(f"__first.{c}").eqNullSafe(F.col(c))
    return first


def _mark_first(entries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    first = entries.groupBy(*key).agg(F.min(F.struct(*order)).alias("__first"))
    return entries.join(first, key)


def package_prompts(files: DataFrame, packages: DataFrame, contexts: DataFrame,
                    prompts: dict | None = None) -> DataFrame:
    """Package prompts as a long table over the files sharing (module, package name).

    Rows ``package_id, section, file_path, file_id, text``: section 0 is the template up to the
    child list, section 1 one row per file, section 2 the rest. Their texts, joined in
    (section, file_path, file_id) order, are the prompt, whatever the size of the group.
    Section 0 also carries ``n_files``, ``needs_analysis`` and ``system_prompt``. Packages with
    at most one file need no analysis; they have only section 0, with no text.
    """
    # narrow rows, written once: the marks, counts and texts below all read them, not the file texts
    own = cut_lineage(files.select("module_id", "package_name", "file_path", "file_id", "short_analysis"))
    key, order = ["module_id", "package_name"], ["file_path", "file_id"]
    marked = _mark_first(own, key, order)
    entry = F.concat(F.when(_first_of(marked, key, order), F.lit("")).otherwise(F.lit(CHILD_SEPARATOR)),
                     F.lit("File: "), F.col("file_path"), F.lit("\nAnalysis: "),
                     F.coalesce(F.col("short_analysis"), F.lit("null")))
    n_files = own.groupBy(*key).agg(F.count(F.lit(1)).alias("n_files"))
    pk = (packages.select("package_id", "module_id", "project_id", "package_name")
          .join(n_files, key, "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)).cast("bigint"))
          .withColumn("needs_analysis", F.col("n_files") > 1))
    kids = (marked.select(*key, *order, entry.alias("text"))
            .join(pk.where("needs_analysis").select("package_id", "project_id", *key), key)
            .select("package_id", "project_id", *order, "text"))
    kids = _with_later_fills(kids, contexts)
    head, tail, system = _parts("package", "{fileAnalyses}", {
        "{packageName}": F.col("package_name"), "{projectContext}": F.col("context")}, prompts)
    outer = pk.join(contexts, "project_id", "left")
    path, fid = F.lit("").alias("file_path"), F.lit(None).cast(files.schema["file_id"].dataType).alias("file_id")
    needs = F.col("needs_analysis")
    none = F.lit(None)
    heads = outer.select("package_id", F.lit(0).alias("section"), path, fid, F.when(needs, head).alias("text"), "n_files", "needs_analysis",
                         F.when(needs, system).alias("system_prompt"))
    extra = [none.cast("bigint").alias("n_files"), none.cast("boolean").alias("needs_analysis"), none.cast("string").alias("system_prompt")]
    tails = outer.where(needs).select("package_id", F.lit(2).alias("section"), path, fid, tail.alias("text"), *extra)
    rows = kids.select("package_id", F.lit(1).alias("section"), *order, "text", *extra)
    return heads.unionByName(rows).unionByName(tails)


def module_prompts(files: DataFrame, packages: DataFrame, modules: DataFrame, projects: DataFrame,
                   contexts: DataFrame, prompts: dict | None = None) -> DataFrame:
    """Module prompts as a long table over root packages and each root package's own files.

    Rows ``module_id, section, package_id, kind, file_path, file_id, text`` in that order; kind 0 is
    the package's block, kind 1 one of its files. Section 0 carries ``system_prompt``.
    """
    roots = packages.where(F.col("parent_package_id").isNull()).select(
        "module_id", "project_id", "package_id", "package_name", "analysis")
    fid = files.schema["file_id"].dataType
    marked = _mark_first(roots, ["module_id"], ["package_id"])
    pkg_entries = marked.select(
        "module_id", "project_id", "package_id", F.lit(0).alias("kind"), F.lit("").alias("file_path"),
        F.lit(None).cast(fid).alias("file_id"),
        F.concat(F.when(_first_of(marked, ["module_id"], ["package_id"]), F.lit("")).otherwise(F.lit(CHILD_SEPARATOR)),
                 F.lit("Package: "), F.col("package_name"), F.lit("\nAnalysis: "),
                 F.coalesce(F.col("analysis"), F.lit(""))).alias("text"))
    # narrow rows, written once: the marks and texts below all read them, not the file texts
    own = cut_lineage(files.select("package_id", "file_path", "file_id", "short_analysis").join(
        roots.select("package_id", "module_id", "project_id"), "package_id"))
    order = ["file_path", "file_id"]
    listed = _mark_first(own, ["package_id"], order)
    file_entries = listed.select(
        "module_id", "project_id", "package_id", F.lit(1).alias("kind"), *order,
        F.concat(F.when(_first_of(listed, ["package_id"], order), F.lit("")).otherwise(F.lit("\n")),
                 F.lit("\n  File: "), paths.basename("file_path"), F.lit("\n  Analysis: "),
                 F.coalesce(F.col("short_analysis"), F.lit(""))).alias("text"))
    kids = _with_later_fills(pkg_entries.unionByName(file_entries), contexts)
    head, tail, system = _parts("module", "{packageAnalyses}", {
        "{moduleName}": F.col("module_name"), "{projectName}": F.coalesce(F.col("project_name"), F.lit("unknown-project")),
        "{projectContext}": F.col("context")}, prompts)
    outer = (modules.select("module_id", "project_id", "module_name")
             .join(projects.select("project_id", "project_name"), "project_id", "left").join(contexts, "project_id", "left"))
    blank = [F.lit("").alias("package_id"), F.lit(0).alias("kind"), F.lit("").alias("file_path"), F.lit(None).cast(fid).alias("file_id")]
    no_system = F.lit(None).cast("string").alias("system_prompt")
    rows = kids.select("module_id", F.lit(1).alias("section"), "package_id", "kind", *order, "text", no_system)
    heads = outer.select("module_id", F.lit(0).alias("section"), *blank, head.alias("text"), system.alias("system_prompt"))
    tails = outer.select("module_id", F.lit(2).alias("section"), *blank, tail.alias("text"), no_system)
    return heads.unionByName(rows).unionByName(tails)


def project_prompts(modules: DataFrame, projects: DataFrame, contexts: DataFrame,
                    parity: bool = False, prompts: dict | None = None) -> DataFrame:
    """Project prompts as a long table over the modules' summaries (``parity`` leaves the context empty).

    Rows ``project_id, section, module_id, text`` in that order; section 0 carries ``system_prompt``.
    """
    if parity:
        contexts = contexts.withColumn("context", F.lit(""))
    marked = _mark_first(modules.select("project_id", "module_id", "module_name", "analysis"), ["project_id"], ["module_id"])
    kids = marked.select("project_id", "module_id", F.concat(
        F.when(_first_of(marked, ["project_id"], ["module_id"]), F.lit("")).otherwise(F.lit(CHILD_SEPARATOR)),
        F.lit("Module: "), F.col("module_name"), F.lit("\nAnalysis: "), F.coalesce(F.col("analysis"), F.lit("null"))).alias("text"))
    kids = _with_later_fills(kids, contexts)
    head, tail, system = _parts("project", "{moduleAnalyses}", {
        "{projectName}": F.col("project_name"), "{projectContext}": F.col("context")}, prompts)
    outer = projects.select("project_id", "project_name").join(contexts, "project_id", "left")
    no_system = F.lit(None).cast("string").alias("system_prompt")
    blank = F.lit("").alias("module_id")
    rows = kids.select("project_id", F.lit(1).alias("section"), "module_id", "text", no_system)
    heads = outer.select("project_id", F.lit(0).alias("section"), blank, head.alias("text"), system.alias("system_prompt"))
    tails = outer.select("project_id", F.lit(2).alias("section"), blank, tail.alias("text"), no_system)
    return heads.unionByName(rows).unionByName(tails)


def digest_rows(files: DataFrame, packages: DataFrame, modules: DataFrame, projects: DataFrame,
                title: str = DIGEST_TITLE, empty_is_missing: bool = False) -> DataFrame:
    """Markdown digest as ordered blocks: (project_id, module_key, package_key, file_key, file_id, block).

    Concatenating ``block`` per project in key order gives the digest text.
    Files are attached by package id (every file of a package, not just roots).
    With ``empty_is_missing`` (the export route) an empty analysis shows the placeholder too.
    """
    def na(c):
        v = F.nullif(F.col(c), F.lit("")) if empty_is_missing else F.col(c)
        return F.coalesce(v, F.lit(NO_ANALYSIS))
    empty = F.lit("")
    none_id = F.lit(-1).cast("bigint")
    proj = projects.select(
        "project_id", empty.alias("module_key"), empty.alias("package_key"), empty.alias("file_key"),
        none_id.alias("file_id"),
        F.concat(F.lit("# "), F.col("project_name"), F.lit(f" - {title}\n\n## Project: "),
                 F.col("project_name"), F.lit("\n\n"), na("analysis"), F.lit("\n\n")).alias("block"))
    mods = modules.select(
        "project_id", F.col("module_id").alias("module_key"), empty.alias("package_key"),
        empty.alias("file_key"), none_id.alias("file_id"),
        F.concat(F.lit("## Module: "), F.col("module_name"), F.lit("\n\n"), na("analysis"),
                 F.lit("\n\n")).alias("block"))
    pkgs = packages.select(
        "project_id", F.col("module_id").alias("module_key"), F.col("package_id").alias("package_key"),
        empty.alias("file_key"), none_id.alias("file_id"),
        F.concat(F.lit("### Package: "), F.col("package_name"), F.lit("\n\n"), na("analysis"),
                 F.lit("\n\n")).alias("block"))
    fls = files.select(
        "project_id", F.col("module_id").alias("module_key"), F.col("package_id").alias("package_key"),
        F.col("file_path").alias("file_key"),
        F.coalesce(F.col("file_id").cast("string").try_cast("bigint"), none_id).alias("file_id"),
        F.concat(F.lit("#### File: "), paths.basename("file_path"), F.lit("\n\n"), na("short_analysis"),
                 F.lit("\n\n")).alias("block"))
    return proj.unionByName(mods).unionByName(pkgs).unionByName(fls)


DIGEST_ORDER = ["project_id", "module_key", "package_key", "file_key", "file_id"]


def write_digest(blocks: DataFrame, out_dir: str, n_files: int | None = None) -> None:
    """Write one markdown stream per project: range-partitioned by the block key, sorted inside.

    Reading a project's part files in name order yields its digest in order;
    no project is materialised as a single value.
    """
    n = n_files or max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # every block ends in a line break; the writer's line separator restores it
    value = F.when(F.col("block").endswith("\n"), F.expr("substr(block, 1, length(block) - 1)")) \
        .otherwise(F.col("block"))
    (blocks.repartitionByRange(n, *DIGEST_ORDER).sortWithinPartitions(*DIGEST_ORDER)
     .select("project_id", value.alias("value"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("project_id").text(out_dir))
