"""Latest / oldest snapshot per key and the read views built on them.

Metrics tables are append-only snapshot logs. Picking the newest (or the
first in natural order) per key is done with ``max_by`` / ``min_by`` over a
``(ts, id)`` struct: an aggregate with a map-side partial step, so a key
with millions of snapshots is reduced inside every task before the shuffle
(a ``row_number`` window would sort the whole hot key in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_ms(ts) -> Column:
    """Milliseconds since the epoch (truncating), for TIMESTAMP or TIMESTAMP_NTZ input."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(c.cast("timestamp"))


def pick_per_key(snaps: DataFrame, key: list[str], order: list[str], cols: list[str],
                 newest: bool = True) -> DataFrame:
    """One row per key: the snapshot with the greatest (or least) ``order`` tuple."""
    ordering = F.struct(*[F.col(c) for c in order])
    payload = F.struct(*[F.col(c) for c in cols])
    pick = F.max_by(payload, ordering) if newest else F.min_by(payload, ordering)
    return (snaps.groupBy(*key).agg(pick.alias("__s"), F.count(F.lit(1)).alias("n_snapshots"))
            .select(*key, *[F.col(f"__s.{c}").alias(c) for c in cols], "n_snapshots"))


def latest_left(base: DataFrame, snaps: DataFrame, key: list[str], order: list[str],
                cols: list[str], defaults: dict | None = None) -> DataFrame:
    """``base`` left-joined to its newest snapshot; missing snapshot → NULL or ``defaults``."""
    latest = pick_per_key(snaps, key, order, cols)
    out = base.join(latest, key, "left")
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out
