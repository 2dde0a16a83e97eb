"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text gives integer counts (``measures``). Four ratios of them are
sketched per language and source as histograms with logarithmic buckets of
relative width 1/32 (``bucket``; the layout of DDSketch and HDR histograms):
counting is exact, so sketches merge by adding counts, over partitions, over
the sources of a language and over all languages, and any order of merging
gives the same thresholds. A ratio passes if it lies within the Tukey fences
``q25 - k * w`` to ``q75 + k * w`` of its sketch, where ``w`` is the
interquartile range, but at least the rule's least width (a constant metric
has no range). A (language, source) with fewer than ``MIN_DOCS`` documents
uses its language's merged sketch, a small language the global one.

Rows are joined to the thresholds of their (language, source), null-safe, and
filtered. Documents that fail the base rules (under 20 words, over 30 % of the
words in repeated 8-word windows) are not part of any sketch by word count and
are never kept.

Defined cases: null text counts as empty (no words, base rules fail); null
language or source is a group of its own; ties at a fence pass; repeated rows
are judged alike; an empty table gives an empty result; other columns pass
through ``keep_good`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import SPACE, WORD, let, small_side
from trellis.session import cut_lineage

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
MIN_DOCS = 100
SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: metric: (numerator, denominator, k, least width of the range in thousandths)
RULES = {
    "word_len": ("word_chars", "n_words", 6, 250),
    "symbols": ("n_symbols", "word_chars", 4, 12),
    "dup_lines": ("n_dup_lines", "n_lines", 4, 100),
    "upper": ("n_upper", "word_chars", 4, 75),
}


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows whose 64-bit hash occurs twice or more in the array."""
    n = F.size(words)

    def windows(h: Column) -> Column:
        for step in (1, 2, 4):  # hashes of 2, 4, then 8 words in a row
            h = _paired(h, step)
        return F.slice(h, 1, n - (WINDOW - 1))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(ranked, lambda s: let(_repeated_places(s), _covered))

    return F.when(n > WINDOW, let(windows(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))).otherwise(F.lit(0).cast("bigint"))


def _paired(h: Column, step: int) -> Column:
    return let(h, lambda x: F.zip_with(x, F.slice(x, step + 1, F.size(x)), lambda a, b: F.xxhash64(a, b)))


def _repeated_places(ranked: Column) -> Column:
    """Sorted window positions whose neighbour in hash order has the same hash."""
    same = F.filter(ranked, lambda e, k: F.coalesce(F.get(ranked, k - 1)["x"] == e["x"], F.lit(False))
                    | F.coalesce(F.get(ranked, k + 1)["x"] == e["x"], F.lit(False)))
    return F.sort_array(F.transform(same, lambda e: e["i"]))


def _covered(places: Column) -> Column:
    part = F.transform(places, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - v, F.lit(WINDOW))))
    return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)


def measures(text: str = "text", repeats: bool = True) -> Column:
    """A struct of the counts of one text; without ``repeats`` the costly window count is left out."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    whole = [
        F.length(_without(t, _WHITE)).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.length(t) - F.length(_without(t, _UPPER))).cast("bigint").alias("n_upper"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"),
                                      F.size(x).cast("bigint").alias("n"))).alias("lines"),
    ]
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeat_words(w).alias("rep"))) if repeats \
        else F.struct(F.regexp_count(t, F.lit(WORD)).cast("bigint").alias("n"))
    return F.struct(*whole, counted.alias("words"))


def _flat(df: DataFrame, text: str, repeats: bool) -> DataFrame:
    """``df`` with the counts as ``__q`` (a struct of longs)."""
    m = df.withColumn("__m", measures(text, repeats))
    cols = {"n_words": "__m.words.n", "word_chars": "__m.word_chars", "n_symbols": "__m.n_symbols", "n_upper": "__m.n_upper",
            "n_dup_lines": "__m.lines.dup", "n_lines": "__m.lines.n"} | ({"n_repeat_words": "__m.words.rep"} if repeats else {})
    return m.withColumn("__q", F.struct(*[F.col(v).alias(k) for k, v in cols.items()])).drop("__m")


def ratio(metric: str) -> Column:
    """The metric of ``__q`` in thousandths, rounded down."""
    num, den, _, _ = RULES[metric]
    return F.expr(f"(1000 * __q.{num}) DIV greatest(__q.{den}, 1)")


def bucket(v: Column) -> Column:
    """Lower bound of the logarithmic bucket of a count: exact below 64, else 6 leading bits."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, e), e))


def sketches(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Bucket counts ``(lang, source, metric, bucket, n)`` of all documents with enough words."""
    m = _flat(df.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("__t")), "__t", repeats=False)
    rows = m.where(F.col("__q.n_words") >= MIN_WORDS).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(ratio(k)).alias("bucket"))
                                              for k in RULES])).alias("m"))
    return rows.groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def _fences(sk: DataFrame, by: list[str]) -> DataFrame:
    """Per group and metric: documents, lower and upper fence, from merged sketches."""
    merged = sk.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "metric")
    seen = merged.withColumns({"cum": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
    q = seen.groupBy(*by, "metric").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("cum") >= F.col("total"), F.col("bucket"))).alias("q25"),
        F.min(F.when(4 * F.col("cum") >= 3 * F.col("total"), F.col("bucket"))).alias("q75"))
    least = F.create_map(*[x for k, r in RULES.items() for x in (F.lit(k), F.lit(r[3]))])[F.col("metric")]
    k = F.create_map(*[x for m, r in RULES.items() for x in (F.lit(m), F.lit(r[2]))])[F.col("metric")]
    width = k * F.greatest(F.col("q75") - F.col("q25"), least)
    return q.select(*by, "metric", F.col("total").alias("n_docs"),
                    (F.col("q25") - width).alias("low"), (F.col("q75") + width).alias("high"))


def thresholds(sk: DataFrame) -> DataFrame:
    """One row per (lang, source): ``low_*`` and ``high_*`` of every metric, from the finest sketch with enough documents."""
    own, lang, every = _fences(sk, ["lang", "source"]), _fences(sk, ["lang"]), _fences(sk, [])
    enough = F.col("o.n_docs") >= MIN_DOCS
    wide = F.col("l.n_docs") >= MIN_DOCS
    pick = lambda c: F.when(enough, F.col(f"o.{c}")).when(wide, F.col(f"l.{c}")).otherwise(F.col(f"e.{c}"))
    j = (own.alias("o").join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.metric") == F.col("l.metric")))
         .join(every.alias("e"), F.col("o.metric") == F.col("e.metric"))
         .select("o.lang", "o.source", "o.metric", pick("low").alias("low"), pick("high").alias("high")))
    return j.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m in RULES for side in ("low", "high")])


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``df`` with ``__q`` (counts), ``__failed`` (base rules) and ``__kept`` (verdict)."""
    sk = cut_lineage(sketches(df, text, lang, source))
    limits = cut_lineage(thresholds(sk))
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"),
                           F.struct(*limits.columns[2:]).alias("__limits"))
    m = _flat(df, text, repeats=True)
    j = m.join(small_side(limits), F.col(lang).cast("string").eqNullSafe(F.col("__lang"))
               & F.col(source).cast("string").eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")
    failed = (F.col("__q.n_words") < MIN_WORDS) | (100 * F.col("__q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__q.n_words"))
    within = F.lit(True)
    for k in RULES:
        within = within & F.coalesce(ratio(k).between(F.col(f"__limits.low_{k}"), F.col(f"__limits.high_{k}")), F.lit(True))
    return j.withColumn("__failed", failed).withColumn("__kept", ~F.col("__failed") & within).drop("__limits")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass; columns unchanged."""
    return judge(docs).where("__kept").select(*docs.columns)
