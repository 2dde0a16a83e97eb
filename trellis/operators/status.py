"""Import status: changelog, latest state per import, status feed, progress step.

Status updates are appended (never updated in place); the current state is
the newest row per import (``max_by`` over ``(ts, seq)``). ``error`` is only
written when present, so the newest non-null error survives later updates.
The feed stops at the first terminal state of an import.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Terminal states, the UI's progress steps, and the import status
# machine (status, message, progress) in the order an import passes through it.
TERMINAL = ("completed", "failed")
PROGRESS_STEPS = (20, 50, 80, 100)
STATUS_MACHINE = [
    ("pending", "Import request received", 0),
    ("in_progress", "Processing import...", 5),
    ("in_progress", "Initiating GitHub repository clone", 10),
    ("in_progress", "Cloning repository...", 20),
    ("in_progress", "Repository cloned successfully", 40),
    ("in_progress", "Detecting project type...", 50),
    ("in_progress", "Project detected as {TYPE} project", 60),
    ("in_progress", "Importing project...", 70),
    ("in_progress", "Project imported, starting analysis...", 80),
    ("completed", "Analysis complete", 100),
]
FAILED = ("failed", "Import failed: ", 0)


def machine_step(step, project_type, failure_message=None):
    """(status, message, progress, error) columns for a 0-based machine step; a failure wins."""
    st = F.element_at(F.array(*[F.lit(x[0]) for x in STATUS_MACHINE]), step + 1)
    msg = F.replace(F.element_at(F.array(*[F.lit(x[1]) for x in STATUS_MACHINE]), step + 1),
                    F.lit("{TYPE}"), F.upper(project_type))
    prog = F.element_at(F.array(*[F.lit(x[2]) for x in STATUS_MACHINE]), step + 1)
    if failure_message is None:
        return st, msg, prog, F.lit(None).cast("string")
    failed = failure_message.isNotNull()
    return (F.when(failed, F.lit(FAILED[0])).otherwise(st),
            F.when(failed, F.concat(F.lit(FAILED[1]), failure_message)).otherwise(msg),
            F.when(failed, F.lit(FAILED[2])).otherwise(prog),
            F.when(failed, failure_message))


def latest_status(log: DataFrame) -> DataFrame:
    """Newest status per import; error = newest non-null error; created = first update."""
    order = F.struct("ts", "seq")
    err_order = F.when(F.col("error").isNotNull(), order)
    return (log.groupBy("import_id")
            .agg(F.max_by(F.struct("status", "message", "progress"), order).alias("s"),
                 F.max_by("error", err_order).alias("error"),
                 F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
                 F.count(F.lit(1)).alias("n_updates"))
            .select("import_id", "s.status", "s.message", "s.progress", "error", "created_at",
                    "updated_at", "n_updates"))


def status_feed(log: DataFrame) -> DataFrame:
    """Updates up to and including the first terminal one per import."""
    term = (log.where(F.col("status").isin(*TERMINAL))
            .groupBy("import_id").agg(F.min(F.struct("ts", "seq")).alias("__stop")))
    j = log.join(term, "import_id", "left")
    keep = F.col("__stop").isNull() | (F.struct("ts", "seq") <= F.col("__stop"))
    return j.where(keep).drop("__stop")


def progress_step(progress) -> F.Column:
    """Index of the active step: the step before the first whose threshold exceeds progress."""
    p = F.col(progress) if isinstance(progress, str) else progress
    out = F.lit(len(PROGRESS_STEPS) - 1)
    for i, s in reversed(list(enumerate(PROGRESS_STEPS))):
        out = F.when(p < s, F.lit(i - 1)).otherwise(out)
    return out
