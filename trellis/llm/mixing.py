"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a target number of words: weights ``WEIGHTS`` repeat over the
sources in code point order (null last), share all words, and no target passes
``MAX_REPEAT`` times its source's words (the excess goes to the others by weight).
A document is taken ``floor(target / words)`` times, and once more with the
remaining fraction as inclusion probability. Those draws are balanced (Deville
and Tillé 2004): the flight moves the probabilities of three documents along
the one direction that changes neither the number of documents nor the words
taken of their source, until one of the three is decided.

Flights run in parallel over hashed groups of about ``GROUP`` documents; each
leaves at most two undecided, of its shortest documents as the long ones fly
first. These fly again in groups of the next round, so
the number of rounds is the logarithm of the largest source. The last round has
one group per source; its last two documents land: the word balance is dropped,
then the count balance. A flight streams over sorted rows and holds two, so
neither a large source nor a large group needs memory. All randomness is a hash
of the document and round: reruns and retries agree.

Defined cases: null text has no words; null source is a source of its own;
documents without words have size 0 and are drawn like others (``taken`` 0);
repeated rows are drawn separately; sources without words have target 0; an empty
table gives an empty result; extra columns pass through ``mix_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import WORD, prepare, small_side, with_row_key
from trellis.operators.ordered_text import ordinals
from trellis.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
GROUP = 128
EPS = 1e-9


def source_targets(sized: DataFrame) -> DataFrame:
    """Per source: ``source``, ``sid``, ``source_size``, ``n_docs``, ``target``. One row per source; only scalars reach the driver."""
    per = cut_lineage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
                      .withColumns({"__k": F.lit(0), "__null": F.col("source").isNull()}))
    ranked = cut_lineage(ordinals(per, ["__k"], ["__null", "source"], "sid").select("source", "sid", "source_size", "n_docs")
                         .withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))))
    cap = MAX_REPEAT * F.col("source_size")
    level, total = None, ranked.agg(F.sum("source_size")).first()[0] or 0
    while True:  # the level only rises, so a capped source stays capped
        over = F.lit(False) if level is None else F.col("w") * F.lit(level) > cap
        c, w = ranked.agg(F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("w")))).first()
        found = (total - (c or 0)) / w if w else level or 0.0
        if found == level or not w:
            break
        level = found
    share = F.col("w") * F.lit(float(level or 0.0))
    return ranked.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share)).drop("w")


def _fly(names: list[str], last_at: int):
    """Streaming flight over rows sorted by (sid, group); the columns ``p`` and ``state`` are rewritten.

    state 0: undecided, 1: decided. ``last`` marks groups that land at their end.
    """
    at = {n: i for i, n in enumerate(names)}
    sid, group, size, p, u, state = (at[k] for k in ("sid", "grp", "size", "p", "u", "state"))

    def settle(row):
        if row[p] <= EPS or row[p] >= 1 - EPS:
            row[p], row[state] = float(row[p] > 0.5), 1
            return True
        return False

    def move(rows, direction, draw):
        up = down = float("inf")
        for r, d in zip(rows, direction):
            if d > 0:
                up, down = min(up, (1 - r[p]) / d), min(down, r[p] / d)
            elif d < 0:
                up, down = min(up, r[p] / -d), min(down, (1 - r[p]) / -d)
        step = up if draw * (up + down) < down else -down
        for r, d in zip(rows, direction):
            r[p] = min(1.0, max(0.0, r[p] + step * d))

    def land(held, out):
        while held:
            draw = held[-1][u]
            if len(held) == 2:
                move(held, (1.0, -1.0), draw)
            else:
                move(held, (1.0,), draw)
            out.extend(r for r in held if settle(r))
            held[:] = [r for r in held if not r[state]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        where = None

        def close(out):
            if held and held[0][last_at]:
                land(held, out)
            out.extend(held)
            held.clear()

        def packed(out, schema):
            cols = zip(*out) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

        schema = None
        for b in batches:
            schema = b.schema
            out: list[list] = []
            for row in map(list, zip(*[c.to_pylist() for c in b.columns])):
                if where != (row[sid], row[group]):
                    close(out)
                    where = (row[sid], row[group])
                if settle(row):
                    out.append(row)
                    continue
                held.append(row)
                while len(held) == 3 or len(held) == 2 and held[0][size] == held[1][size]:
                    if len(held) == 3:
                        a, b_, c = (float(r[size]) for r in held)
                        d = (b_ - c, c - a, a - b_)
                        top = max(map(abs, d)) or 1.0
                        move(held, tuple(x / top for x in d), row[u])
                    else:
                        move(held, (1.0, -1.0), row[u])
                    out.extend(r for r in held if settle(r))
                    held[:] = [r for r in held if not r[state]]
            yield packed(out, schema)
        out = []
        close(out)
        if out:
            yield packed(out, schema)
    return run


def draw(docs: DataFrame, ids: list[str], text: str = "text", source: str = "source", seed_on: str = "doc_id") -> DataFrame:
    """Per document: ``ids``, ``size``, ``source_size``, ``target``, ``copies`` (times taken) and ``taken`` (words).

    The draw is a hash of ``seed_on`` and the text, wherever the row is stored.
    """
    prepare(docs.sparkSession)
    text_ = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sized = cut_lineage(docs.select(
        F.struct(*ids).alias("ids") if ids else F.lit(None).alias("ids"), F.col(source).cast("string").alias("source"),
        F.regexp_count(text_, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(seed_on, text).alias("h")))
    targets = cut_lineage(source_targets(sized))
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    t = small_side(targets.withColumnRenamed("source", "__source"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (sized.join(t, sized["source"].eqNullSafe(F.col("__source"))).drop("__source", "source")
            .withColumn("base", F.floor(ratio + EPS)).withColumn("p", F.greatest(ratio - F.col("base"), F.lit(0.0)))
            .withColumns({"left": F.col("n_docs"), "state": F.lit(0)}))
    done, rounds, max_left = [], 0, most
    while max_left > 0:
        rounds += 1
        k = F.ceil(F.col("left") / GROUP)
        mix = F.xxhash64("h", F.lit(rounds))
        todo = rows.withColumns({
            "k": k, "grp": F.pmod(mix, k), "last": k == 1,
            "u": F.call_function("shiftrightunsigned", F.xxhash64(mix), F.lit(11)) / F.lit(float(1 << 53)),
        }).repartition("sid", "grp").sortWithinPartitions("sid", "grp", F.desc("size"), "h")
        names = todo.columns
        out = cut_lineage(todo.mapInArrow(_fly(names, names.index("last")), todo.schema))
        done.append(out.where("state = 1").drop("k", "grp", "last", "u", "left", "state", "h"))
        rows = out.where("state = 0").withColumn("left", 2 * F.col("k")).drop("k", "grp", "last", "u")
        groups = -(-max_left // GROUP)
        max_left = 0 if groups == 1 else 2 * groups
    if not done:
        done = [rows.drop("left", "state", "h")]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("base") + F.round("p")).cast("bigint")
    return out.select("ids.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns unchanged."""
    prepare(docs.sparkSession)
    keyed, keys = with_row_key(docs)
    taken = draw(keyed, keys).where("copies > 0").select(*keys, F.col("copies").cast("int").alias("__copies"))
    return (keyed.join(taken, keys).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*docs.columns))
