"""Toxicity scores: a lexicon trie intersected with Levenshtein automata, and context windows.

1. Lexicon. Over all labelled training rows (one count per distinct text), words are counted in toxic
   and clean texts. A word of any length joins the lexicon if it is in ``MIN_TEXTS`` toxic texts, its
   share of them is ``ODDS`` times its share of the clean ones, and its own counts are significant:
   by Chernoff's bound, less than one word of all those tested would get such counts by chance. So
   the size of a language or of the table does not matter. A
   prefix common to ``STEM_WORDS`` such words with odds of ``STEM_ODDS`` becomes a stem, which
   matches any ending. The lexicon holds the ``MAX_TERMS`` most significant words, far more than any
   list of abusive words.
2. Matching. The trie of the lexicon and the Levenshtein automaton of distance 1 (terms of at least
   ``MIN_FUZZY`` characters) run as one automaton: a state is the set of (trie node, edits) pairs, made
   deterministic as words ask for it, and forgotten when there are ``MAX_STATES``. One pass over all texts gives the hits as
   rows. Misspelt forms that clean training texts use, measured by their
   shares of the clean and the toxic texts, are ordinary words and don't count: those hits are taken out by an anti-join
   with the counted words, which stay a table however many there are.
3. Context. Each hit has a window of ``WINDOW`` words on both sides. Other hits in the window raise
   it; a hit inside a quotation (someone else's words) counts ``QUOTED``. Quotations run from an opening to a closing
   mark of a line, however long; single marks, which apostrophes share, within two windows.
4. Calibration. A logistic curve over log(1 + sum of the hits), fitted on the histogram of the
   training rows' logarithms.

Scores use the text alone. Defined cases: null and empty texts have no hits and get the curve's base
score; rows without a label or with a null ``doc_id`` are scored, not learned from; repeated rows
score alike; without labels every score is 0; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import prepare, small_side, with_row_key
from trellis.session import cut_lineage

MIN_TEXTS, ODDS, STEM_ODDS = 3, 25.0, 100.0
MAX_TERMS = 50_000
STEM_WORDS, STEM_LEN = 3, 4
MIN_FUZZY, WINDOW = 5, 8
FUZZY, NEIGHBOUR, QUOTED = 0.8, 0.25, 0.2
BIN = 0.02
#: States of the automaton, bytes of remembered tokens, and characters of a token that is remembered.
MAX_STATES, MEMO_BYTES, MEMO_WORD = 20_000, 32 << 20, 64
THRESHOLD = 0.7
#: Opening marks and what closes each; those of ``_SHORT`` are apostrophes too.
_MARKS = {"«": "»", "„": "“”", "“": "”", "‘": "’", "‹": "›", '"': '"', "'": "'", "`": "`'"}
_SHORT, _BEFORE, _AFTER = "‘'`", "([{", ".,;:!?)]}…"


def bare(token: str) -> str:
    """A lower-case token without marks at its ends; marks inside stay (they may hide a letter)."""
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return unicodedata.normalize("NFC", token[i:j])


class Automaton:
    """Trie of words and stems, run together with the Levenshtein automaton of distance 1.

    ``match`` gives 0 (no term), 1 (a term) or 2 (a misspelt term).
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[int] = [0]  # at a node's end: 0 no term, 1 a term to be spelt as it is, 2 a term that may be misspelt
        self.stem: list[int] = [0]
        for term, ends in [(w, self.word) for w in words] + [(s, self.stem) for s in stems]:
            node = 0
            for ch in term:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.word.append(0)
                    self.stem.append(0)
                node = self.next[node][ch]
            ends[node] = 2 if len(term) >= MIN_FUZZY else 1
        self.bends = [False] * len(self.next)  # whether a term that may be misspelt is at or below a node
        for node in range(len(self.next) - 1, -1, -1):
            self.bends[node] = 2 in (self.word[node], self.stem[node]) or any(self.bends[k] for k in self.next[node].values())
        self.forget()

    def forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stemmed: list[int] = []
        self.first = self.state({(0, 0)})

    def state(self, pairs: set[tuple[int, int]]) -> int:
        """The deterministic state of a set, closed under skipping a term's character (one edit)."""
        best: dict[int, int] = {}
        for node, e in pairs:
            best[node] = min(e, best.get(node, 2))
        for node, e in list(best.items()):
            if e == 0 and self.bends[node]:
                for k in self.next[node].values():
                    best[k] = min(best.get(k, 2), 1)
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            # a stem is complete: 1 as written, 2 with an edit
            self.stemmed.append(min((e + 1 for n, e in key if self.stem[n] > e), default=0))
        return self.states[key]

    def step(self, state: int, ch: str) -> int:
        """Next state (-1: none), made on first use."""
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if ch in self.next[node]:
                out.add((self.next[node][ch], e))
            if e == 0 and self.bends[node]:
                out.add((node, 1))
                out.update((k, 1) for k in self.next[node].values())
        new = self.moves[state][ch] = self.state(out) if out else -1
        return new

    def match(self, word: str) -> int:
        if len(self.sets) >= MAX_STATES:
            self.forget()
        state, stem = self.first, 0
        for ch in word:
            state_ = self.moves[state].get(ch)
            state = self.step(state, ch) if state_ is None else state_
            if state < 0:
                break
            s = self.stemmed[state]
            if s and (not stem or s < stem):
                stem = s
        found = 0
        if state >= 0:
            found = min((e + 1 for n, e in self.sets[state] if self.word[n] > e), default=0)
        if stem and (not found or stem < found):
            found = stem
        return found


class Matcher(dict):
    """Raw token to its class, in a memo of bounded bytes."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.size = automaton, 0

    def __missing__(self, token: str) -> int:
        out = self.automaton.match(bare(token))
        if len(token) <= MEMO_WORD:
            if self.size >= MEMO_BYTES:
                self.clear()
                self.size = 0
            self[token] = out
            self.size += 100 + 4 * len(token)
        return out


def quotations(lines: list[list[str]]) -> list[tuple[int, int]]:
    """First and last token of every quotation; the tokens of all lines are numbered on."""
    spans, at = [], 0
    for tokens in lines:
        start, mark = -1, ""
        for i, t in enumerate(tokens, at):
            inner = t.lstrip(_BEFORE)
            opens = inner[:1] if len(inner) > 1 or inner[:1] not in ('"', "'", "`") else ""
            if mark in _SHORT and start >= 0 and i - start > 2 * WINDOW:
                start = -1
            if start < 0 and opens in _MARKS and opens:
                start, mark = i, opens
                inner = inner[1:]
            elif start < 0:
                continue
            if inner.rstrip(_AFTER)[-1:] in tuple(_MARKS[mark]):
                spans.append((start, i))
                start = -1
        at += len(tokens)
    return spans


def find_hits(text: str | None, matcher: Matcher) -> tuple[list[int], list[str | None], list[bool]]:
    """Places of the hits among the text's words, the misspelt word (None where a term stands as it is), and whether each is quoted."""
    lines = [line.split() for line in (text or "").lower().split("\n")]
    tokens = [t for line in lines for t in line]
    codes = bytes(map(matcher.__getitem__, tokens))
    if not codes.strip(b"\0"):
        return [], [], []
    at = np.flatnonzero(np.frombuffer(codes, np.uint8))
    spans = quotations(lines)
    starts, ends = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    k = np.searchsorted(starts, at, "right") - 1
    inside = (ends[k] >= at) & (k >= 0) if len(spans) else np.zeros(len(at), bool)
    return at.tolist(), [bare(tokens[i]) if codes[i] == 2 else None for i in at], inside.tolist()


def is_training(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            part = b.slice(lo, 2000)
            by = (Counter(), Counter())
            for t, toxic in zip(*[c.to_pylist() for c in part.columns]):
                by[toxic].update({bare(x) for x in set((t or "").lower().split())} - {""})
            words = sorted(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "toxic": pa.array([by[1][w] for w in words], pa.int64()),
                                              "clean": pa.array([by[0][w] for w in words], pa.int64())})


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """From the training rows of ``labels``: the lexicon (``words``, ``stems``), the table ``ordinary (word)`` of misspelt-looking
    words in ordinary use, and ``marked (doc_id, toxic)``."""
    spark = docs.sparkSession
    prepare(spark)
    marked = cut_lineage(labels.where(is_training() & F.col("toxic").isNotNull()).groupBy("doc_id")
                         .agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    train = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small_side(marked), "doc_id")
    once = train.groupBy(F.xxhash64("text", F.length("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    once = cut_lineage(once.select("doc_id"))
    alone = cut_lineage(marked.join(once, "doc_id").distinct())
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small_side(alone), "doc_id").select("text", "toxic")
    n_toxic, n_clean = alone.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    n_toxic, n_clean = n_toxic or 0, n_clean or 0
    if not n_toxic or not n_clean:
        return {"words": [], "stems": [], "ordinary": None, "marked": None}
    counts = cut_lineage(texts.mapInArrow(_word_counts, "word string, toxic bigint, clean bigint")
                         .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    odd = (F.col("toxic") / F.lit(float(n_toxic))) >= F.lit(ODDS) * (F.col("clean") / F.lit(float(n_clean)))
    often = counts.where(F.col("toxic") >= MIN_TEXTS)
    tested = often.count()
    # log of Chernoff's bound on the chance of so many toxic texts among the word's texts
    n, share = F.col("toxic") + F.col("clean"), n_toxic / (n_toxic + n_clean)
    sure = (F.col("toxic") * F.log(F.col("toxic") / n / F.lit(share))
            + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / F.lit(1 - share))).otherwise(0.0))
    words = sorted(r.word for r in often.where(odd).select("word", sure.alias("sure")).where(F.col("sure") > math.log(max(tested, 1)))
                   .orderBy(F.desc("sure"), "word").limit(MAX_TERMS).collect())
    # prefixes of lexicon words, with the counts of all words that start with them
    shared = Counter(w[:n] for w in words for n in range(STEM_LEN, len(w) + 1))
    tries = sorted(p for p, n in shared.items() if n >= STEM_WORDS)
    stems: list[str] = []
    if tries:
        pre = F.broadcast(spark.createDataFrame([(p,) for p in tries], "p string"))
        sums = (counts.select("toxic", "clean", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(STEM_LEN), F.lit(max(map(len, tries)))), lambda n: F.substr("word", F.lit(1), n)))).alias("p"))
            .join(pre, "p").groupBy("p").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
                .where(F.col("toxic") / F.lit(float(n_toxic)) >= F.lit(STEM_ODDS) * F.col("clean") / F.lit(float(n_clean))))
        for p in sorted((r.p for r in sums.collect()), key=lambda x: (len(x), x)):
            if not any(p.startswith(s) for s in stems):
                stems.append(p)
    words = [w for w in words if not any(w.startswith(s) for s in stems)]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Automaton(words, stems)
        for b in batches:
            keep = [w for w in b.column(0).to_pylist() if m.match(w) == 2]
            yield pa.RecordBatch.from_pydict({"word": pa.array(keep, pa.string())})
    usual = F.lit(ODDS) * (F.col("clean") / F.lit(float(n_clean))) > F.col("toxic") / F.lit(float(n_toxic))
    ordinary = cut_lineage(counts.where((F.col("clean") > 0) & usual).select("word").mapInArrow(close, "word string"))
    return {"words": words, "stems": stems, "ordinary": ordinary, "marked": marked}


def fit(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Ridge logistic curve over log(1 + sum) by Newton steps; balanced classes."""
    x = np.array([r[0] for r in rows])
    y = np.array([r[1] for r in rows], float)
    n = np.array([r[2] for r in rows], float)
    w = np.where(y > 0, n / max(n[y > 0].sum(), 1), n / max(n[y == 0].sum(), 1)) * 1000
    z, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (y - p)) - np.array([0.0, 1.0]) * beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1e-6, 1.0])
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


_MADE: dict[int, Matcher] = {}


def _matcher(parts: tuple[list[str], list[str]]) -> Matcher:
    key = xxhash.xxh64_intdigest("\1".join("\0".join(p) for p in parts).encode())
    if key not in _MADE:
        _MADE[key] = Matcher(Automaton(*parts))
    return _MADE[key]


def hit_rows(rows: DataFrame, keys: list[str], words: list[str], stems: list[str]) -> DataFrame:
    """``keys, pos, word, quoted``: a row per hit of the texts of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast((words, stems))
    src = rows.select("text", *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                of, pos, word, quoted = [], [], [], []
                for i, t in enumerate(part.column(0).cast(pa.string()).to_pylist()):
                    at, w, inside = find_hits(t, m)
                    of += [i] * len(at)
                    pos, word, quoted = pos + at, word + w, quoted + inside
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(of, pa.int64())) for c in part.columns[1:]], pa.array(pos, pa.int64()),
                                                  pa.array(word, pa.string()), pa.array(quoted, pa.bool_())], [*part.schema.names[1:], "pos", "word", "quoted"])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:]]
    return src.mapInArrow(run, ", ".join([*kept, "pos bigint, word string, quoted boolean"]))


def weighed(hits: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, abuse``: the sum of every row's hits, each weighed by its window."""
    near = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy("pos").rangeBetween(-WINDOW, WINDOW)) - 1
    one = F.when(F.col("word").isNull(), 1.0).otherwise(FUZZY) * (1 + NEIGHBOUR * F.least(F.col("near"), F.lit(WINDOW))) * F.when(F.col("quoted"), QUOTED).otherwise(1.0)
    return hits.withColumn("near", near).groupBy(*keys).agg(F.sum(one).alias("abuse"))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score``, ``predicted``, ``abuse``."""
    docs, keys = with_row_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")))
    model = learn(docs, labels)
    held = F.coalesce(~is_training(), F.lit(False))
    rows = docs.select(*keys, "doc_id", held.alias("held_out"))
    if model["marked"] is None:
        out, value = rows.withColumn("abuse", F.lit(0.0)), F.lit(0.0)
    else:
        hits = hit_rows(docs, keys, model["words"], model["stems"])
        sums = cut_lineage(weighed(hits.join(small_side(model["ordinary"]), "word", "left_anti"), keys))
        out = rows.join(small_side(sums), keys, "left").withColumn("abuse", F.coalesce("abuse", F.lit(0.0)))
        bins = (out.join(small_side(model["marked"]), "doc_id")
                .groupBy("toxic", F.round(F.log1p("abuse") / BIN).cast("int").alias("bin")).count().collect())  # few: the logarithm of a sum
        a, b = fit([(r["bin"] * BIN, r["toxic"], r["count"]) for r in bins])
        value = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p("abuse"))))
    return (out.select("doc_id", "held_out", value.alias("score"), "abuse")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", "abuse"))
