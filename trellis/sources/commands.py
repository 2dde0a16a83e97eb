"""Import-command parsing: five fields pulled from JSON text, bad rows quarantined.

Fields are extracted with the same per-field patterns as the reference
(so an escaped quote ends a value exactly as it does there). Missing
``project_name``, ``github_url`` or ``import_id`` sends the row to the
quarantine with a reason; ``project_context`` defaults to '' and
``timestamp`` to the run's ``as_of``. No row ever fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field patterns of the command parser.
FIELD_PATTERNS = {
    "project_name": r'"project_name"\s*:\s*"([^"]+)"',
    "github_url": r'"github_url"\s*:\s*"([^"]+)"',
    "project_context": r'"project_context"\s*:\s*"([^"]*?)"',
    "timestamp": r'"timestamp"\s*:\s*"(\d+)"',
    "import_id": r'"import_id"\s*:\s*"([^"]+)"',
}
REQUIRED = ("project_name", "github_url", "import_id")


def _field(text: Column, name: str) -> Column:
    v = F.regexp_extract(text, FIELD_PATTERNS[name], 1)
    return F.when(v == "", F.lit(None).cast("string")).otherwise(v)


def parse_commands(df: DataFrame, text_col: str, as_of_ms: Column) -> DataFrame:
    """Adds parsed fields, ``status`` ('ok' | 'quarantined') and ``reason``."""
    t = F.col(text_col)
    out = df
    for name in FIELD_PATTERNS:
        out = out.withColumn(f"cmd_{name}", _field(t, name))
    reason = F.lit(None).cast("string")
    for name in reversed(REQUIRED):
        reason = F.when(F.col(f"cmd_{name}").isNull(), F.lit(f"Missing required field: {name}")).otherwise(reason)
    return (out.withColumn("cmd_project_context", F.coalesce("cmd_project_context", F.lit("")))
            .withColumn("cmd_ts_ms", F.coalesce(F.col("cmd_timestamp").try_cast("bigint"), as_of_ms))
            .drop("cmd_timestamp")
            .withColumn("reason", reason)
            .withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("quarantined")))

