"""Queries over what the engine stores and reads itself: merge-on-read tables, a source tree, exact token counts, the answer ledger."""

from __future__ import annotations

import hashlib
import posixpath
import re

import pyarrow as pa
from pyspark.sql import functions as F

from trellis.functions.bpe import bpe_token_count
from trellis.operators import analyze, sinks, status, summaries
from trellis.operators.keyed_table import KeyedTable
from trellis.operators.ledger import AnswerLedger
from trellis.plans.corpus_views import code_corpus
from trellis.plans.oracle_base import with_vc
from trellis.plans.registry import register
from trellis.plans.state_queries import LOG_SQL, status_log
from trellis.plans.summary_queries import file_prompt_ctes
from trellis.session import cut_lineage, make_folder
from trellis.sources import tree as T
from trellis.sources.tables import point_read, read_table
from trellis.streaming.topics import run_folder


@register("merge_update", lambda: with_vc("""
SELECT file_id, project_id, CASE WHEN file_id % 10 = 3 THEN 'patched ' || cast(file_id AS varchar) || ' v2' ELSE short_analysis END AS short_analysis,
  CASE WHEN file_id % 20 = 3 THEN 7 WHEN file_id % 10 = 3 THEN 2 ELSE analysis_token_count END AS analysis_token_count FROM vc"""))
def merge_update(spark, sf_dir):
    """Field updates of a merge-on-read table: three patches, a compaction between them, one patch twice (a repeated batch)."""
    f = code_corpus(spark, sf_dir).files.select("file_id", "project_id", "short_analysis", "analysis_token_count")
    t = KeyedTable.create(spark, f"{run_folder(spark, 'merge')}/files", f, ["file_id"])
    text = lambda v: F.concat(F.lit("patched "), F.col("file_id").cast("string"), F.lit(f" v{v}"))
    ids = f.select("file_id").where(F.col("file_id") % 10 == 3)
    absent = ids.select((-1 - F.col("file_id")).alias("file_id"))
    t.update(ids.unionByName(absent).select("file_id", text(1).alias("short_analysis"), F.lit(1).cast("bigint").alias("analysis_token_count")), batch=("analysis", 0))
    t.compact(share=0.0)
    second = ids.select("file_id", text(2).alias("short_analysis"), F.lit(2).cast("bigint").alias("analysis_token_count"))
    t.update(second, batch=("analysis", 1))
    t.update(ids.where(F.col("file_id") % 20 == 3).select("file_id", F.lit(7).cast("bigint").alias("analysis_token_count")))
    t.update(second, batch=("analysis", 1))  # published already: changes nothing
    return t.read()


@register("merge_upsert", LOG_SQL + "SELECT import_id, status, message, progress, error FROM latest")
def merge_upsert(spark, sf_dir):
    """Import status kept by upserts: each slice of the changelog, in time order, adds new imports and sets
    what is known of the others (an error stays until another is set)."""
    log = cut_lineage(status_log(spark, sf_dir))
    at, t = F.unix_micros(F.col("ts").cast("timestamp")), None
    cuts = log.agg(F.percentile_approx(at, [0.25, 0.5, 0.75]).alias("at")).first().at
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = log.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        rows = status.latest_status(part).select("import_id", "status", "message", "progress", "error")
        if t is None:
            t = KeyedTable.create(spark, f"{run_folder(spark, 'status')}/imports", rows, ["import_id"])
        else:
            t.upsert(rows)
    return t.read()


@register("replace_upsert", lambda: with_vc("""
SELECT project_id, file_id, 'v1' AS version FROM vc WHERE project_id NOT IN ('de', 'en')
UNION ALL SELECT project_id, file_id, 'v2' FROM vc WHERE project_id IN ('de', 'en') AND analysed"""))
def replace_upsert(spark, sf_dir):
    """Rows of whole projects replaced: all files as a first version, then two projects with their analysed files."""
    f = code_corpus(spark, sf_dir).files.select("project_id", "file_id", "analysed")
    out = f"{run_folder(spark, 'replace')}/contexts"
    sinks.replace_upsert(f.select("project_id", "file_id", F.lit("v1").alias("version")), out, "project_id")
    sinks.replace_upsert(f.where(F.col("analysed") & F.col("project_id").isin("de", "en")).select("project_id", "file_id", F.lit("v2").alias("version")), out, "project_id")
    return spark.read.parquet(out).select(F.col("project_id").cast("string").alias("project_id"), "file_id", "version")


@register("analyze_commands", lambda: with_vc("SELECT module_id, project_id, 1700000000000::BIGINT AS timestamp FROM vmod WHERE project_id IN ('de', 'en')"))
def analyze_commands(spark, sf_dir):
    """One analyze-module command per module of the asked projects (asked for twice, commanded once)."""
    c = code_corpus(spark, sf_dir)
    asked = c.projects.where(F.col("project_id").isin("de", "en")).select("project_id")
    return sinks.analyze_commands(c.modules, asked.unionByName(asked), 1700000000000)


@register("newest_event", """
SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND ts = (SELECT max(ts) FROM events WHERE event_type = 'error')""")
def newest_event(spark, sf_dir):
    """The newest row that matches a filter: pushed into the scan, then a top-1."""
    return point_read(spark, sf_dir, "events", F.col("event_type") == "error", "ts").select("event_id", "user_id", "event_type")


#: Fixture: a document is a file three folders deep; every sixth lies in a hidden folder, every fifth at its project's root.
def tree_path(doc_id):
    digit = doc_id % 30
    return F.concat(F.when(digit % 5 == 0, F.lit("")).when(digit % 6 == 0, F.lit(".hidden/_a/"))
                    .otherwise(F.concat(F.lit("src/d"), digit.cast("string"), F.lit("/x y/"))), F.lit("d"), doc_id.cast("string"), F.lit(".py"))


@register("scan_tree", """
SELECT concat_ws('-', lang, source) AS project,
  CASE WHEN doc_id % 30 % 5 = 0 THEN '' WHEN doc_id % 30 % 6 = 0 THEN '.hidden/_a/' ELSE 'src/d' || cast(doc_id % 30 AS varchar) || '/x y/' END
    || 'd' || cast(doc_id AS varchar) || '.py' AS rel_path,
  strlen(coalesce(text, '')) AS size, md5(coalesce(text, '')) AS content_md5 FROM documents""")
def scan_tree(spark, sf_dir):
    """The documents written as files of project folders, listed level by level and read back in ranges of equal bytes."""
    root = f"{run_folder(spark, 'tree')}/root"
    make_folder(spark, root)
    uri = T._qualified(spark, root)
    d = read_table(spark, sf_dir, "documents").select(F.concat_ws("-", "lang", "source").alias("project"), tree_path(F.col("doc_id")).alias("rel_path"),
                                                      F.coalesce("text", F.lit("")).alias("text"))

    def write(batches):
        system, top = T._open(uri)
        for b in batches:
            for project, rel, text in zip(*[c.to_pylist() for c in b.columns]):
                path = posixpath.join(top, project, rel)
                system.create_dir(posixpath.dirname(path), recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})
    d.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return T.scan_tree(spark, root).select("project", "rel_path", F.octet_length("content").cast("bigint").alias("size"), F.md5("content").alias("content_md5"))


#: Vocabulary of the exact counts: a parameter, read where it lies.
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@register("bpe_tokens")  # SQL has no byte-pair merging: tests hold it against a plain merge and a library
def bpe_tokens(spark, sf_dir):
    """Exact token counts of whole texts by byte-pair merging over a given vocabulary."""
    f = code_corpus(spark, sf_dir).text_files
    return f.select("file_id", bpe_token_count(spark, "content", RANK_FILE).alias("tokens"))


# ------------------------------------------------------------------ answer ledger

ENTRY = r"(?:Package|File|Module): ([^\n]*)\n *Analysis: ([^\n]*)"
TALLY = r"entries (\d+) digest (\d+)"


class Unsteady:
    """Stand-in for the remote model: a digest of a file's prompt, and for the upper levels a tally of the children's
    entries, which a combine request adds up. By a digit of their digest, file requests fail at first, or always."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, system: str, user: str) -> str:
        if user.startswith(analyze.COMBINE_PREFIX):
            pairs = [(int(n), int(d)) for n, d in re.findall(TALLY, user)]
        else:
            pairs = [(1, int(hashlib.md5(f"{a}|{b}".encode()).hexdigest()[:8], 16)) for a, b in re.findall(ENTRY, user)]
            if not pairs:
                digest = hashlib.md5(user.encode()).hexdigest()
                self.seen[digest] = self.seen.get(digest, 0) + 1
                if digest[0] == "0":
                    raise RuntimeError("refused")
                if digest[0] in "12" and self.seen[digest] <= int(digest[0]):
                    raise TimeoutError("slow")
                return f"seen {digest}"
        return f"entries {sum(n for n, _ in pairs)} digest {sum(d for _, d in pairs)}"


def level_prompts(c):
    """Prompts of all files, modules and projects as one long table ``(level, entity_id, section, k1..k4, text, system_prompt)``."""
    none = lambda kind: F.lit(None).cast(kind)
    def rows(level, df, entity, k1, k2, k3, k4, text="text"):
        return df.select(F.lit(level).alias("level"), F.col(entity).cast("string").alias("entity_id"), *[
            x.alias(n) for x, n in zip((F.col("section"), k1, k2, k3, k4), LEVEL_ORDER)], F.col(text).alias("text"), "system_prompt")
    f = summaries.file_prompts(c.text_files, c.contexts).withColumn("section", F.lit(0))
    m = summaries.module_prompts(c.text_files, c.packages, c.modules, c.projects, c.contexts)
    p = summaries.project_prompts(c.modules, c.projects, c.contexts)
    return (rows("file", f, "file_id", none("string"), none("int"), none("string"), none("bigint"), "user_prompt")
            .unionByName(rows("module", m, "module_id", F.col("package_id"), F.col("kind"), F.col("file_path"), F.col("file_id").cast("bigint")))
            .unionByName(rows("project", p, "project_id", F.col("module_id"), none("int"), none("string"), none("bigint"))))


LEVEL_ORDER = ["section", "k1", "k2", "k3", "k4"]


def _ledger_sql() -> str:
    entry = lambda name, text: f"sum(('0x' || substr(md5({name} || '|' || {text}), 1, 8))::BIGINT)"
    return file_prompt_ctes(f"""
SELECT 'file' AS level, cast(file_id AS varchar) AS entity_id, CASE WHEN substr(md5(user_prompt), 1, 1) <> '0' THEN 'seen ' || md5(user_prompt) END AS analysis,
  CASE WHEN substr(md5(user_prompt), 1, 1) = '0' THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN substr(md5(user_prompt), 1, 1) = '0' THEN 'RuntimeError: refused' END AS error FROM prompts
UNION ALL
SELECT 'module' AS level, module_id AS entity_id, 'entries ' || cast(sum(n) AS varchar) || ' digest ' || cast(sum(d)::BIGINT AS varchar), 'ok', NULL FROM (
  SELECT module_id, count(*) AS n, {entry("package_name", "coalesce(analysis, '')")} AS d FROM vpk WHERE parent_package_id IS NULL GROUP BY 1
  UNION ALL
  SELECT p.module_id, count(*), {entry("string_split(f.file_path, '/')[-1]", "coalesce(f.short_analysis, '')")}
  FROM vpk p JOIN vc f ON f.package_id = p.package_id WHERE p.parent_package_id IS NULL GROUP BY 1) GROUP BY module_id
UNION ALL
SELECT 'project', project_id, 'entries ' || cast(count(*) AS varchar) || ' digest ' || cast({entry("module_name", "coalesce(analysis, 'null')")}::BIGINT AS varchar), 'ok', NULL
FROM vmod GROUP BY project_id""")


@register("analysis_ledger", _ledger_sql)
def analysis_ledger(spark, sf_dir):
    """File, module and project prompts through the pluggable analyzer with an answer ledger; some requests are retried, some fail.
    A first round asks the file level alone; the second, over all levels, finds its answers in the ledger."""
    prompts = cut_lineage(level_prompts(code_corpus(spark, sf_dir)))
    ledger = AnswerLedger(spark, f"{run_folder(spark, 'ledger')}/answers")
    ask = lambda rows: analyze.analyze_prompts(rows, Unsteady(), ["level", "entity_id"], LEVEL_ORDER,
                                               parallelism=spark.sparkContext.defaultParallelism, ledger=ledger)
    ask(prompts.where("level = 'file'"))
    return ask(prompts).select("level", "entity_id", "analysis", "status", "error")
