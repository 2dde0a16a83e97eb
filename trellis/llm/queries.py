"""Contract queries of the operators: thin digests of their results over whole tables, with SQL oracles where SQL has them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import alignment, chat, exact_dedup, html_text, lm_score, mixing, pieces, quality, simhash, top_k, toxicity, vector_codes, warc
from trellis.llm.common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced draw of every document against its source's target."""
    out = mixing.draw(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")


def _quality_sql() -> str:
    """Counts, bucket sketches and fences of the quality rules, stated on their own."""
    return r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
c AS (
  SELECT doc_id, lang, source, w, len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines
  FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, n_words - 6)) AS i FROM c WHERE n_words > 8)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit) GROUP BY doc_id),
m AS (
  SELECT c.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         1000 * word_chars // greatest(n_words, 1) AS m1, 1000 * n_symbols // greatest(word_chars, 1) AS m2,
         1000 * n_dup_lines // greatest(n_lines, 1) AS m3, 1000 * n_upper // greatest(word_chars, 1) AS m4
  FROM c LEFT JOIN rep USING (doc_id)),
v AS (SELECT lang, source, unnest(['a', 'b', 'c', 'd']) AS metric, unnest([m1, m2, m3, m4]) AS x FROM m WHERE n_words >= 20),
b AS (SELECT lang, source, metric, CASE WHEN x < 64 THEN x ELSE (x >> (length(bin(x)) - 6)) << (length(bin(x)) - 6) END AS x FROM v),
f1 AS (SELECT lang, source, metric, count(*) AS n, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM b GROUP BY ALL),
f2 AS (SELECT lang, metric, count(*) AS n, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM b GROUP BY ALL),
f3 AS (SELECT metric, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM b GROUP BY ALL),
q AS (SELECT f1.lang, f1.source, f1.metric,
             CASE WHEN f1.n >= 100 THEN f1.q1 WHEN f2.n >= 100 THEN f2.q1 ELSE f3.q1 END AS q1,
             CASE WHEN f1.n >= 100 THEN f1.q3 WHEN f2.n >= 100 THEN f2.q3 ELSE f3.q3 END AS q3
      FROM f1 JOIN f2 ON f1.lang IS NOT DISTINCT FROM f2.lang AND f1.metric = f2.metric JOIN f3 ON f1.metric = f3.metric),
r AS (SELECT lang, source, metric, q1 - k * greatest(q3 - q1, least_w) AS low, q3 + k * greatest(q3 - q1, least_w) AS high
      FROM q JOIN (VALUES ('a', 6, 250), ('b', 4, 12), ('c', 4, 100), ('d', 4, 75)) AS z(metric, k, least_w) USING (metric)),
t AS (SELECT lang, source, max(low) FILTER (metric = 'a') AS la, max(high) FILTER (metric = 'a') AS ha,
             max(low) FILTER (metric = 'b') AS lb, max(high) FILTER (metric = 'b') AS hb,
             max(low) FILTER (metric = 'c') AS lc, max(high) FILTER (metric = 'c') AS hc,
             max(low) FILTER (metric = 'd') AS ld, max(high) FILTER (metric = 'd') AS hd FROM r GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND coalesce(m1 BETWEEN la AND ha, true) AND coalesce(m2 BETWEEN lb AND hb, true)
       AND coalesce(m3 BETWEEN lc AND hc, true) AND coalesce(m4 BETWEEN ld AND hd, true) AS kept
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source"""


@query("op2_quality_rules", _quality_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[F.col(f"__q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                      F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether decoding them gives the text back."""
    out = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.length(text).cast("bigint").alias("n_chars"), F.size("token_ids").cast("bigint").alias("n_pieces"),
                      F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"),
                      (F.col("decoded") == F.translate(text, pieces.MARK, " ")).alias("round_trip"))


@query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op5_lm_score")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return lm_score.score(table(spark, sf_dir, "documents"))


@query("op6_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    path = warc.write_archive(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _turn_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digests of the conversations, piece by piece; holds one turn."""
    now, type_, state = None, pa.int64(), None

    def row():
        return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def packed(out):
        cols = list(zip(*out)) or [[]] * 6
        kinds = (type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                          ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    for b in batches:
        out, type_ = [], b.column(0).type
        for conv, piece, spans in zip(*[c.to_pylist() for c in b.columns]):
            if state is None or conv != now:
                if state is not None:
                    out.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns, learnt = chat.read_back(piece, [(s["start"], s["end"]) for s in spans])
            for role, said in turns:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            state[2] += len(learnt)
            state[3].update(learnt.encode())
            state[4] += len(piece)
        yield packed(out)
    if state is not None:
        yield packed([row()])


@query("op7_chat_format", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(role, '([\\<>#])', '_\1', 'g')) + length(regexp_replace(text, '([\\<>#])', '_\1', 'g')) + 15 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted turn by turn, and read back from its format as a stream of turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    out = chat.streamed(chat.format_turns(rows.unionByName(extra))).select("conv_id", "piece", "spans")
    return out.mapInArrow(_turn_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labelled rows outside the held-out fold."""
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query("op9_exact_dedup", r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM h""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts by chunk recipes."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers in every document."""
    out = alignment.align(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op12_top_k", f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every vector whose id is divisible by 20."""
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def _codes_sql(rounds: int) -> str:
    """Every round of the codebooks as two steps: assignment, then floors of the means."""
    nearest = """
a{i} AS MATERIALIZED (
  SELECT r, part, v, n % 16 AS entry, n // 16 AS dist FROM (
    SELECT p.r, p.part, any_value(p.v) AS v,
           min(16 * list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT + b.entry) AS n
    FROM p JOIN b{i} b USING (part) GROUP BY p.r, p.part)),"""
    replaced = """
b{j} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN (
    SELECT part, entry, list(floored ORDER BY pos) AS c FROM (
      SELECT part, entry, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floored
      FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM a{i}) GROUP BY part, entry, pos)
    GROUP BY part, entry) m USING (part, entry)),"""
    steps = "".join((nearest + replaced).format(i=i, j=i + 1) for i in range(rounds)) + nearest.format(i=rounds)
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (SELECT r, part, v[part * len(v) // 8 + 1:(part + 1) * len(v) // 8] AS v FROM e, range(8) t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v AS c FROM p WHERE r <= 16),{steps}
k AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
o AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN e USING (r), k"""


@query("op13_vector_codes", _codes_sql(vector_codes.ROUNDS))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector, with the digest of the codebooks."""
    out, book = vector_codes.code_vectors(table(spark, sf_dir, "embeddings"))
    digest = vector_codes.book_digest(book, vector_codes.part_bounds(book.shape[1], vector_codes.PARTS))
    return out.select("vec_id", "code", "error", F.col("group_error").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
