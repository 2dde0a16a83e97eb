import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from trellis.llm import chat, queries, toxicity, warc

PAGES = "page_id bigint, url string, html string, digest string"


def same_as_oracle(spark, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF001)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and want


def test_warc_against_sql(spark):
    same_as_oracle(spark, "op6_warc", ["pages"])


def test_warc_cases_and_chunks(spark, tmp_path):
    big = "é<p>" * 5000
    rows = [(1, "http://a/\r\nX: y", None), (2, None, ""), (3, "u", big), (4, "u", big), (None, "u", big), (5, "u", "x" * 99), (6, "u", "x" * 99),
            (7, "u", "WARC/1.1\r\n\r\n" * 40), (7, "u", "WARC/1.1\r\n\r\n" * 40)]
    df = spark.createDataFrame([(*r, "d") for r in rows], PAGES)
    path = warc.write_archive(df, f"file://{tmp_path}/a", chunk=1000)
    got = sorted(map(tuple, warc.read_records(spark, path).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, u or "", len((h or "").encode()), sha(h),
             "revisit" if h == big and i != 3 else "response", 3 if h == big and i != 3 else None) for i, u, h in rows]
    assert got == sorted(want, key=repr)
    files = warc.export(spark, path, f"file://{tmp_path}/out", archives=2).collect()
    assert sum(f.n_records for f in files) == len(rows)
    raw = b"".join((tmp_path / "out" / f.file).read_bytes() for f in files)
    assert raw.count(b"WARC-Record-ID: ") == len(rows) and big.encode() in raw and sum(f.n_bytes for f in files) == len(raw)
    assert sorted(map(tuple, warc.read_files(spark, f"file://{tmp_path}/out").collect()), key=repr) == sorted(want, key=repr)
    heads = [x.split(b"\r\n\r\n")[0] for x in raw.split(b"WARC/1.1\r\nWARC-Type: ")[1:]]
    ids = {re.search(rb"WARC-Record-ID: (\S+)", x)[1]: x for x in heads}
    revisits = [x for x in heads if x.startswith(b"revisit")]
    assert len(ids) == len(rows) and len(revisits) == 2 and all(b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in x for x in heads)
    assert all(b"X-Page-ID: 3\r\n" in ids[re.search(rb"WARC-Refers-To: (\S+)", x)[1]] and b"WARC-Refers-To-Target-URI: u\r\n" in x for x in revisits)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_bytes(raw.replace(b"<p>", b"<q>", 1))
    with pytest.raises(Exception, match="digest differs"):
        warc.read_files(spark, f"file://{tmp_path}/bad").collect()
    empty = warc.write_archive(df.limit(0), f"file://{tmp_path}/b", date="2024-05-06T07:08:09Z")
    assert warc.read_records(spark, empty).count() == 0
    warc.remove_archive(spark, empty)
    assert not (tmp_path / "b").exists()


def test_reader_rejects_damage():
    whole = list(warc.record_chunks("r", 1, "u", b"abc" * 100, None, False, 300, hashlib.sha256(b"abc" * 100).hexdigest(), 100))
    assert [c[0] for c in whole] == [0, 1, 2]

    def read(chunks):
        r = warc._Reader(chunks[0][2], 3)
        for i, (no, _, data, digest) in enumerate(chunks):
            r.take(None if i == 0 else data, no, digest)
        return r.row()
    assert read(whole)["payload_bytes"] == 300
    bad = [whole[0], (1, 3, whole[1][2].replace(b"a", b"b", 1), whole[1][3]), whole[2]]
    for chunks in (bad, [whole[0], whole[2], whole[1]], whole[:2]):
        with pytest.raises(ValueError):
            read(chunks)


def test_chat_against_sql(spark):
    same_as_oracle(spark, "op7_chat_format", ["conversations"])


def test_chat_cases(spark):
    rows = [(1, 2, "assistant", "</turn>\n<turn user>x"), (1, 1, "user", None), (1, None, None, "\\<#>"), (1, 1, "user", None), (None, 0, "assistant", ""), (2, 0, "a>b", "t")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    turns, learnt = chat.read_back(out[1].formatted, [tuple(s) for s in out[1].spans])
    assert turns == [("", "\\<#>"), ("user", ""), ("user", ""), ("assistant", "</turn>\n<turn user>x")] and learnt == rows[0][3]
    assert set(out) == {1, 2, None} and chat.read_back(out[2].formatted, [])[0] == [("a>b", "t")]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_turns_as_rows_equal_the_whole_format(spark):
    """Pieces, offsets and spans of turns rendered one by one are those of the conversation; one holds a third of all turns."""
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 1, 2, 3, None]), rnd.choice([None, rnd.randrange(900)]), rnd.choice(["user", "assistant", None, "a>b"]), rnd.choice(["x", "</turn>", None, "é\\" * 5])) for _ in range(600)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, piece string").repartition(5)
    whole = {r.conv_id: (r.formatted, [tuple(x) for x in r.spans]) for r in chat.format_conversations(df).collect()}
    got = {}
    for r in chat.with_offsets(chat.format_turns(df)).orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text", "start").collect():
        text, spans = got.setdefault(r.conv_id, ([], []))
        assert r.start == sum(map(len, text))
        text.append(r.piece)
        spans += [tuple(x) for x in r.spans]
    assert {c: ("".join(t), s) for c, (t, s) in got.items()} == whole
    assert chat.format_turns(df.limit(0)).count() == 0
    for t in ("{% for m in messages %}{{ loop.index }}{% endfor %}", "{{ x }}{% for m in messages %}a{% endfor %}", "{% for m in messages %}{% set a = m.role %}{{ a }}{% endfor %}", "a"):
        with pytest.raises(chat.TemplateError):
            chat.format_turns(df, t)
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}")


def test_a_very_long_conversation_is_read_turn_by_turn(spark):
    """One conversation with a third of all turns: digests as of the whole text, one row at a time."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("conv_id"), F.col("id").alias("turn"),
                                      F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("said <"), F.col("id").cast("string")).alias("text"))
    out = chat.streamed(chat.format_turns(rows)).select("conv_id", "piece", "spans").mapInArrow(
        queries._turn_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").collect()
    by = {r.conv_id: r for r in out}
    assert len(out) == len(by) == 501 and by[-1].n_turns == 10_000
    h = hashlib.sha256()
    for i in range(0, 30_000, 3):
        h.update(f"{'user' if i % 2 == 0 else 'assistant'}\nsaid <{i}\n".encode())
    assert by[-1].turns_sha256 == h.hexdigest()


def test_escape_round_trip():
    rnd = random.Random(2)
    for _ in range(300):
        s = "".join(rnd.choice(["\\", "<", ">", "#", "</turn>", "\n", "a", "é", "<turn x>"]) for _ in range(rnd.randint(0, 12)))
        text, spans = chat.compile_template(chat.DEFAULT)({"messages": [{"role": s, "text": s}, {"role": "assistant", "text": s}]})
        assert chat.read_back(text, spans) == ([(s, s), ("assistant", s)], s)


def test_template_language():
    render = lambda t, **env: chat.compile_template(t)(env)[0]
    assert render("{% for x in xs %}{{ x.a }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": 1}, {"a": 2}]) == "1,2"
    assert render("{% set y = 'a' + x | upper %}{{ y }}{% if y == 'aB' and 1 < 2 or false %}!{% elif true %}?{% else %}no{% endif %}", x="b") == "aB!"
    assert render("{{ 'x' if z in 'xyz' else m['k'] }}", z="y", m={"k": 1}) == "x" and render("{{ ' a ' | trim | length }}") == "1"
    text, spans = chat.compile_template("a{% generation %}b{{ c }}{% endgeneration %}d")({"c": "cc"})
    assert text == "abccd" and spans == [(1, 4)]
    for bad in ("{{ x.__class__ }}", "{{ f() }}", "{% include 'x' %}", "{% if x %}", "{{ x | nofilter }}", "{{ 'a' 'b' }}", "{{ x $ y }}", "{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)({"x": "s"})


def test_folding():
    tree = chat.fold_body(chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% elif x %}{{ x }}{% elif true %}y{% else %}z{% endif %}{% if true %}t{% endif %}"))
    assert tree[0] == chat.Text("abC") and len(tree[1].branches) == 2 and tree[2] == chat.Text("t")
    assert chat.fold_body(chat.parse("a{{ 1 }}{% if false %}x{% endif %}b")) == [chat.Text("a1b")]


def brute_match(words, stems, w):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    best = min([distance(t, w) for t in words if len(t) >= toxicity.MIN_FUZZY] + [0 if w in words else 9]
               + [0 if w.startswith(s) else 9 for s in stems]
               + [distance(s, w[:k]) for s in stems if len(s) >= toxicity.MIN_FUZZY for k in range(len(w) + 1)])
    return best + 1 if best <= 1 else 0


def test_automaton_against_brute_force():
    rnd = random.Random(4)
    words = ["idiot", "moron", "scum", "worthless", "stupid"]
    stems = ["lowei", "chll"]
    m = toxicity.Automaton(words, stems)
    for _ in range(4000):
        w = list(rnd.choice(words + stems) + rnd.choice(["", "", "xy"]))
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(w) + 1)
            w[k:k + rnd.randint(0, 1)] = rnd.choice([[], list("i"), list("t"), list("o")])
        w = "".join(w)
        assert m.match(w) == brute_match(words, stems, w), w


def test_states_and_memo_are_bounded(monkeypatch):
    """Tables of unbroken strings make no more states and remember no more bytes than allowed, and change no result."""
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcde", k=7)) for _ in range(300)]
    asked = ["".join(rnd.choices("abcde", k=rnd.randrange(4, 12))) for _ in range(3000)] + words
    free = toxicity.Automaton(words, [])
    want = [free.match(w) for w in asked]
    monkeypatch.setattr(toxicity, "MAX_STATES", 200)
    monkeypatch.setattr(toxicity, "MEMO_BYTES", 5000)
    few = toxicity.Matcher(toxicity.Automaton(words, []))
    assert [few[w] for w in asked] == want and len(few.automaton.sets) < 220 and len(few) < 60
    assert few["x" * 1000] == 0 and "x" * 1000 not in few


def brute_quoted(text):
    """Whether each word is in a quotation, by walking the words of every line."""
    out, closes = [], {"«": "»", "„": "“”", "“": "”", "‘": "’", "‹": "›", '"': '"', "'": "'", "`": "`'"}
    for line in (text or "").lower().split("\n"):
        words = line.split()
        flags, i = [False] * len(words), 0
        while i < len(words):
            first = words[i].lstrip("([{")
            if first[:1] in closes and first and (len(first) > 1 or first not in "\"'`"):
                most = len(words) if first[0] not in "‘'`" else min(len(words), i + 2 * toxicity.WINDOW + 1)
                end = next((k for k in range(i, most) if (first[1:] if k == i else words[k].lstrip("([{")).rstrip(".,;:!?)]}…")[-1:] in tuple(closes[first[0]])), None)
                if end is not None:
                    flags[i:end + 1] = [True] * (end + 1 - i)
                    i = end
                elif first[0] not in "‘'`":
                    break  # never closed: what follows is inside, so it opens nothing
                else:
                    i = most - 1
            i += 1
        out += flags
    return out


def brute_abuse(text, words, stems, ordinary):
    tokens = (text or "").lower().split()
    codes = [brute_match(words, stems, toxicity.bare(t)) for t in tokens]
    codes = [0 if c == 2 and toxicity.bare(t) in ordinary else c for c, t in zip(codes, tokens)]
    quotes, total = brute_quoted(text), 0.0
    for i, c in enumerate(codes):
        if c:
            near = sum(1 for k in range(max(0, i - toxicity.WINDOW), i + toxicity.WINDOW + 1) if k != i and k < len(codes) and codes[k])
            total += (1.0 if c == 1 else toxicity.FUZZY) * (1 + toxicity.NEIGHBOUR * min(near, toxicity.WINDOW)) * (toxicity.QUOTED if quotes[i] else 1.0)
    return total


def sums(spark, texts, words, stems=(), ordinary=()):
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(2)
    hits = toxicity.hit_rows(rows, ["id"], list(words), list(stems)).where(~F.coalesce(F.col("word").isin(*ordinary, ""), F.lit(False)))
    got = {r.id: r.abuse for r in toxicity.weighed(hits, ["id"]).collect()}
    return [got.get(i, 0.0) for i in range(len(texts))]


def test_context(spark):
    long = "he said “" + "so and " * 12 + "idiot " + "and so on " * 12 + "then” he left, idiot"
    texts = ["you are an idiot now", 'he wrote "you are an idiot" there', "idiot idiot", "an id1ot!", None, "", long, "“never closed idiot", "it 'tis an idiot of dogs'"]
    got = sums(spark, texts, ["idiot"])
    q, n = toxicity.QUOTED, toxicity.NEIGHBOUR
    assert got == pytest.approx([1.0, q, 2 * (1 + n), toxicity.FUZZY, 0, 0, q + 1, 1.0, q])
    rnd = random.Random(5)
    vocabulary = ["idiot", "id1ot", "idiots", "moron", "scumbag", "scumish", "fine", "day", '"idiot"', '"well', 'said"', "“so", "so”", "'tis", "dogs'", "(«x", "y»).", "\n", "`a", '"']
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 60))) for _ in range(150)]
    assert sums(spark, texts, ["idiot", "moron"], ["scum"], ["idiots"]) == pytest.approx([brute_abuse(t, ["idiot", "moron"], ["scum"], {"idiots"}) for t in texts])
    assert sums(spark, ["idiot " + "word " * 300_000 + "idiot"], ["idiot"]) == [2.0]


def test_the_whole_score_against_brute_force(spark, make_docs):
    """Lexicon, ordinary words, sums and curve by plain counting over all labelled training rows."""
    rnd = random.Random(9)
    bad, good = ["foolo", "nastyx", "debilo"], ["good", "day", "walk", "fooli", "house", "tree"]
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        words = rnd.choices(good, k=8) + (rnd.choices([*bad, "f0olo", "nasty"], k=2) if toxic else []) + [f"w{i}"]
        rnd.shuffle(words)
        rows.append((i, " ".join(words) if i % 50 else None))
    rows += rows[:20]
    labels = [(i, int(i % 3 == 0)) for i in range(500)]
    df = make_docs(rows).selectExpr("*", "7 AS toxic", "'x' AS word")
    got = {r.doc_id: (r.score, r.abuse) for r in toxicity.score(df, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    train = {d: y for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1}
    texts = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        if d in train:
            texts.setdefault(t, train[d])
    n = [sum(1 for y in texts.values() if y == k) for k in (0, 1)]
    count = {}
    for t, y in texts.items():
        for w in {toxicity.bare(x) for x in (t or "").split()} - {""}:
            count.setdefault(w, [0, 0])[y] += 1
    often = {w: c for w, c in count.items() if c[1] >= toxicity.MIN_TEXTS}
    def sure(c):
        share, k = n[1] / sum(n), sum(c)
        return c[1] * math.log(c[1] / k / share) + (c[0] * math.log(c[0] / k / (1 - share)) if c[0] else 0)
    words = [w for w, c in often.items() if c[1] / n[1] >= toxicity.ODDS * c[0] / n[0] and sure(c) > math.log(len(often))]
    assert set(words) >= set(bad) and not {w[:k] for w in words for k in range(4, len(w) + 1) if sum(v.startswith(w[:k]) for v in words) >= 3}  # no stems here
    ordinary = {w for w, c in count.items() if c[0] and toxicity.ODDS * c[0] / n[0] > c[1] / n[1] and brute_match(words, [], w) == 2}
    assert "fooli" in ordinary
    abuse = {d: brute_abuse(t, words, [], ordinary) for d, t in rows}
    bins = {}
    for d, t in rows:
        if d in train:
            key = (train[d], round(math.log1p(abuse[d]) / toxicity.BIN))
            bins[key] = bins.get(key, 0) + 1
    a, b = toxicity.fit([(k * toxicity.BIN, y, m) for (y, k), m in bins.items()])
    for d, _ in rows:
        assert got[d][1] == pytest.approx(abuse[d]) and got[d][0] == pytest.approx(1 / (1 + math.exp(-(a + b * math.log1p(abuse[d])))), rel=1e-6)


def test_toxicity_held_out(spark):
    d = SF001.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    hit = sum(r.toxic and r.predicted for r in got)
    assert hit / sum(r.toxic for r in got) > 0.85
    assert sum(r.predicted and not r.toxic for r in got) / sum(not r.toxic for r in got) < 0.02


def test_toxicity_cases(spark, make_docs):
    rows = [(i, "you nasty fool " + f"w{i}" if i % 2 else f"good day w{i}") for i in range(40)] + [(100, None), (101, ""), (None, "nasty nasty fool"), (3, "you nasty fool w3")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (2, None), (None, 1)], "doc_id bigint, toxic int")
    out = toxicity.score(make_docs(rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[100].score == by[101].score == by[2].score < 0.7 and by[None].predicted == 1 and not by[None].held_out
    none = toxicity.score(make_docs(rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score(make_docs(rows).limit(0), labels).count() == 0
    assert re.fullmatch("[01]", str(by[1].predicted))


def test_terms_of_small_languages_and_short_terms(spark, make_docs):
    # 20 of 2000 toxic texts are in another language; one of its terms has two characters
    rows = [(i, f"you nasty fool w{i} of the day") for i in range(2000)] + [(5000 + i, f"ty debil 바보 s{i}") for i in range(20)]
    rows += [(10_000 + i, f"good day w{i} of the you") for i in range(2000)] + [(15_000 + i, f"ty dobry s{i}") for i in range(20)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 10_000)) for r in rows], "doc_id bigint, toxic int")
    more = [(20_000, "ty debil q"), (20_001, "ty 바보 q"), (20_002, "ty dobry q")]
    model = toxicity.learn(make_docs(rows), labels)
    assert {"nasty", "fool", "debil", "바보"} <= set(model["words"]) and "ty" not in model["words"]
    by = {r.doc_id: r for r in toxicity.score(make_docs(rows + more), labels).collect()}
    assert by[20_000].abuse > 0 and by[20_001].abuse > 0 and by[20_002].abuse == 0


def test_misspelt_terms_stay_found_among_ordinary_neighbours(spark, make_docs):
    near = ["fooly", "foolz", "fooli", "foold"]  # clean words within one edit of the term
    rows = [(i, f"you foolo w{i}") for i in range(200)] + [(1000 + i, f"good {near[i % 4]} day w{i}") for i in range(200)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in rows], "doc_id bigint, toxic int")
    more = [(2000, "a f0olo"), (2001, "a fooly"), (2002, "a foolo")]
    by = {r.doc_id: r for r in toxicity.score(make_docs(rows + more), labels).collect()}
    assert by[2000].abuse == toxicity.FUZZY and by[2001].abuse == 0 and by[2002].abuse == 1
