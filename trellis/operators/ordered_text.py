"""Order over large groups without a window or a list per group.

``ordinals`` and ``running_totals`` number the rows of a group, or sum a
weight over the rows before them, from a global range sort: a hot group is
split over tasks, and the offsets table has one row per partition.
``requests`` packs the ordered rows of a group into texts of a bounded size.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.session import cut_lineage

FEW_KEYS = 100_000  # keys over the limit that are broadcast; more are joined by a shuffle
REQUEST_CHARS = 128 * 1024  # about 32k tokens, the analyzer's input


def running_totals(df: DataFrame, key: list[str], order: list[str], weight: str | None = None,
                   out: str = "before") -> DataFrame:
    """Sum of ``weight`` (1 without) over the rows of the same ``key`` before each row in ``order``.

    ``order`` must be unique per key. Rows are range-sorted globally, summed by partition
    offset and place, and rebased by the group's first row.
    """
    spark = df.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cols = key + order
    w_col = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    s = (df.withColumn("__w", w_col).repartitionByRange(n_parts, *cols).sortWithinPartitions(*cols)
         .withColumn("__pid", F.spark_partition_id())
         .withColumn("__pos", F.monotonically_increasing_id()))
    # The layout (range bounds are sampled with a per-RDD seed) must be computed
    # once: the sums, offsets and group minimums below all read the same rows.
    # A reliable checkpoint in the shared folder fixes it, also across executor loss.
    s = cut_lineage(s)
    sums = s.groupBy("__pid").agg(F.sum("__w").alias("__n"))
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition: a proven size bound for the broadcast
    offsets = F.broadcast(sums.withColumn("__off", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
                          .select("__pid", "__off"))
    if weight is None:
        s = s.withColumn("__in", F.col("__pos") - F.shiftleft(F.col("__pid").cast("bigint"), 33))
    else:  # a window over one partition of the range sort, whatever its keys
        place = Window.partitionBy("__pid").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
        s = s.withColumn("__in", F.coalesce(F.sum("__w").over(place), F.lit(0)))
    ranked = s.join(offsets, "__pid").withColumn("__rank", F.col("__off") + F.col("__in"))
    first = ranked.groupBy(*key).agg(F.min("__rank").alias("__first"))
    return (ranked.join(first, key)
            .withColumn(out, F.col("__rank") - F.col("__first"))
            .drop("__w", "__pid", "__pos", "__off", "__in", "__rank", "__first"))


def ordinals(df: DataFrame, key: list[str], order: list[str], out: str = "ordinal") -> DataFrame:
    """Exact 0-based rank of each row within ``key`` by ``order`` (unique per key)."""
    return running_totals(df, key, order, None, out)


def requests(parts: DataFrame, key: list[str], order: list[str], text: str,
             limit: int = REQUEST_CHARS, system: str | None = None) -> DataFrame:
    """``key + [piece, n_pieces, text, n_parts]``: the ordered rows of each key, packed into texts.

    A piece holds rows until half of ``limit`` is reached, so it stays under ``limit``
    if no single row is longer than the other half (rows are never cut). Every row is in
    exactly one piece. With ``system``, the greatest value of that column per key comes as ``system_prompt``.

    Texts move once, to their group: the sizes are summed on narrow rows, and only rows of keys over ``limit`` need places.
    """
    rows = parts.where(reduce(and_, [F.col(c).isNotNull() for c in key]))
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    carried = ["system_prompt"] if system else []
    half = max(limit // 2, 1)
    entry = F.struct(*[F.col(c) for c in order], F.coalesce(F.col(text), F.lit("")).alias("__t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["__t"]), "")
    out = [*key, "piece", "n_pieces", "text", "n_parts", *carried]
    # a group that fits is one piece; the size decides only how many requests the analyzer sees
    long_keys = cut_lineage(rows.groupBy(*key).agg(F.sum(size).alias("__total"), F.count(F.lit(1)).alias("__rows"))
                            .where((F.col("__total") > limit) & (F.col("__rows") > 1)).select(*key))
    n_long = long_keys.count()
    few = F.broadcast(long_keys) if n_long <= FEW_KEYS else long_keys
    whole = ((rows.join(few, key, "left_anti") if n_long else rows).groupBy(*key)
             .agg(joined.alias("text"), F.count(F.lit(1)).alias("n_parts"), *[F.max(system).alias(c) for c in carried])
             .withColumn("piece", F.lit(0).cast("bigint")).withColumn("n_pieces", F.lit(1).cast("bigint")).select(*out))
    if not n_long:
        return whole
    long_ = rows.join(few, key, "left_semi")
    placed = running_totals(long_.withColumn("__len", size), key, order, "__len", "__before")
    packed = (placed.withColumn("piece", F.floor(F.col("__before") / half).cast("bigint")).groupBy(*key, "piece")
              .agg(joined.alias("text"), F.count(F.lit(1)).alias("n_parts")))
    of_key = packed.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pieces"))
    if system:
        of_key = of_key.join(long_.groupBy(*key).agg(F.max(system).alias("system_prompt")), key)
    return whole.unionByName(packed.join(of_key, key).select(*out))
