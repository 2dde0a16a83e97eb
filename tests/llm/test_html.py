import re
from html import unescape

from conftest import SF001
from trellis.llm import html_text, queries
from trellis.llm.html_text import main_text

SHELL = "<html><head><title>T</title></head><body>{}</body></html>"


def plain_article(html):
    """The article of a generated page, by plain string work: its blocks are h1 and p."""
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|h3|ul|li|div|blockquote|pre)\b[^>]*>", body)
    texts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).replace("\xa0", " ")).strip() for p in parts]
    return "\n".join(t for t in texts if t)


def test_query_against_plain_extraction(spark):
    got = {r.page_id: r for r in queries.QUERIES["op4_html_text"](spark, SF001).collect()}
    pages = spark.read.parquet(f"{SF001}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == plain_article(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text) > 0


def test_main_text():
    assert main_text(None) == main_text("") == "" and main_text("plain &amp; &#x41;\n b") == "plain & A b"
    page = SHELL.format("<nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>A  B</h1><p>one<br>two<p>th<b>r</b>ee &lt;p&gt;"
                        "<ul><li>x<li>y</ul><script>if (a < b) '</p>'</script><div id=comments>bad</div><form>f</form></article><aside>s</aside><footer>c</footer>")
    assert main_text(page) == "A B\none two\nthree <p>\nx\ny"
    assert main_text(SHELL.format("<div class=content><p>a</p></div><div class='cookie-notice'>c</div><table><tr><td>1<td>2</table>")) == "a\n1\n2"
    assert main_text(SHELL.format("<p title='a>b'>x</p><!-- <p>no</p> --><p>y<p>z<!-- open")) == "x\ny\nz"
    assert main_text("a < b and <3 <p class=\"x>y</p>z") != ""
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert main_text(deep) == "x"
    assert main_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert main_text(SHELL.format("<div class='broadside'>kept</div><div class='main nav'>gone</div>")) == "kept"


def test_style_tree_removes_templates(spark):
    def page(i, shared):
        return SHELL.format(f"<div class=box><p>Same words on each page</p></div><div class=story><p>{shared}</p><p>story {i} of this host</p></div>")
    rows = [(i, "http://h.example/a", page(i, "a passage of many pages" if i % 2 else f"own {i}")) for i in range(20)]
    rows += [(100 + i, "http://h.example/b", rows[0][2]) for i in range(30)]  # copies of one page are no template
    rows += [(200 + i, "http://few.example/", page(i, "q")) for i in range(3)] + [(300, None, page(1, "n")), (301, "odd", None), (302, "http://h.example/", "")]
    df = spark.createDataFrame([(*r, "text") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df, ["page_id"]).collect()}
    assert len(got) == len(rows)
    assert got[1] == "a passage of many pages\nstory 1 of this host" and got[2] == "own 2\nstory 2 of this host" and got[110] == got[0]
    assert got[200] == "Same words on each page\nq\nstory 0 of this host" and got[301] == got[302] == "" and got[300].endswith("story 1 of this host")
    assert html_text.extract(df.limit(0), ["page_id"]).count() == 0


def test_importance_values(spark):
    html = lambda a, b: f"<div class=x><p>{a}</p></div><div class=y><p>{b}</p></div>"
    df = spark.createDataFrame([("h", html("same", f"own {i}")) for i in range(10)], "host string, html string")
    got = sorted((r.m, round(r.importance, 6)) for r in html_text.importances(df).collect())
    # leaf and parent of the same text: content 0, one style; of own texts: content 1
    assert [m for m, _ in got] == [10] * 4 and [v for _, v in got][:2] == [0.0, 0.0] and min(v for _, v in got[2:]) > 0.6


def extracted(spark, pages):
    df = spark.createDataFrame([(i, "http://h.example/x", h) for i, h in enumerate(pages)], "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in html_text.extract(df, ["page_id"]).collect()}


def test_shared_headings_of_articles_stay(spark):
    recipe = "<h2>Ingredients</h2><table><tr><th>Amount<td>{0} grams of item {0}</table><ul><li>salt<li>item {0}</ul><h2>Method</h2><p>cook item {0} for long</p>"
    for shell in ("<article>{}</article>", "<div class=story>{}</div>"):
        got = extracted(spark, [SHELL.format("<div class=box><p>Same words on each page</p></div>" + shell.format(recipe.format(i))) for i in range(12)])
        assert got == {i: f"Ingredients\nAmount\n{i} grams of item {i}\nsalt\nitem {i}\nMethod\ncook item {i} for long" for i in range(12)}


def test_one_article_under_many_urls_stays(spark):
    text = "<p>The first paragraph of the one article</p><p>The second paragraph of the one article</p>"
    want = "The first paragraph of the one article\nThe second paragraph of the one article"
    for shell in ("<article>{}</article>", "<div class=story>{}</div>"):
        got = extracted(spark, [SHELL.format(f"<script>var id = {i}</script><nav><a>menu {i}</a></nav><div class='ad'>buy {i}</div>" + shell.format(text)) for i in range(12)])
        assert got == dict.fromkeys(range(12), want)
    got = extracted(spark, [SHELL.format(f"<div class=story>{text}</div><div class=x1><p>buy {i}</p></div>") for i in range(12)])  # an unmarked advert
    assert all(t.startswith(want) for t in got.values())


def test_class_names_of_wrappers():
    for names in ("class='content-sidebar-wrap'", "class='has-sidebar'", "class=no-sidebar", "class='with-side-nav'", "class='page header-fixed'",
                  "id='search-engine-history'", "class='has-comments'"):
        for inner in ("<article><h1>A</h1><p>the text</p></article>", "<main><h1>A</h1><p>the text</p></main>", "<div><h1>A</h1><p>the text</p></div>"):
            page = f"<div {names}>{inner}<div class=sidebar>s</div><aside>t</aside></div>"
            assert main_text(SHELL.format(page)) == "A\nthe text", (names, inner)
            assert main_text(f"<html {names}><body>{inner}</body></html>") == "A\nthe text"
    assert main_text(SHELL.format("<main><h1>A</h1><div class='has-sidebar'><p>the text of it</p></div></main>")) == "A\nthe text of it"
    assert main_text(SHELL.format("<main><div class=sidebar>links</div></main><p>the text outside</p>")) == "the text outside"
    assert main_text(SHELL.format("<p>the text</p><nav><article>menu</article></nav>")) == "the text"
    # articles among comments and related links are not the page's
    assert main_text(SHELL.format("<article>own text</article><div id=comments><article>a comment, longer than the text</article></div>")) == "own text"
    assert main_text(SHELL.format("<article>own text<div id=comments><article>a comment, longer than the text</article></div></article>")) == "own text"


def stripped(html):
    """A page whose elements and names tell nothing: sections are divs without class, id and role."""
    html = re.sub(r"<(/?)(article|main|nav|aside|header|footer)\b[^>]*>", r"<\1div>", html)
    return re.sub(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", html)


def test_the_tree_decides_where_names_tell_nothing(spark):
    """On hosts with enough pages at least 80 % of the pages without telling names give the marked article; without the tree none does."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html", html_text.host_of("url").alias("host"), "url").collect()
    df = spark.createDataFrame([(p.page_id, p.url, stripped(p.html)) for p in pages], "page_id bigint, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_text.extract(df, ["page_id"]).collect()}
    want = {p.page_id: plain_article(p.html) for p in pages}
    texts = {}
    for p in pages:
        texts.setdefault(p.host, set()).add(want[p.page_id])
    big = [p for p in pages if len(texts[p.host]) >= html_text.MIN_PAGES]
    assert len(big) > 50 and sum(got[p.page_id] == want[p.page_id] for p in big) >= 0.8 * len(big)
    assert not any(main_text(stripped(p.html)) == want[p.page_id] for p in big)


def test_slots_are_found_by_place(spark):
    """Menus, adverts and footers with other words on every page, some missing on some pages; titles and short articles stay."""
    def page(i):
        menu = "<div><ul>" + "".join(f"<li><a href=/{i}/{k}>menu {i * k}</a>" for k in range(5)) + "</ul></div>"
        advert = f"<div>buy number {i * 31}</div>" if i % 3 else ""
        return SHELL.format(f"{menu}{advert}<div><h1>Title {i}</h1>" + "".join(f"<p>paragraph {k} of story {i}</p>" for k in range(2 + i % 4)) + f"</div><div>made by hand {i * 17}</div>")
    got = extracted(spark, [page(i) for i in range(24)])
    assert got == {i: "\n".join([f"Title {i}", *(f"paragraph {k} of story {i}" for k in range(2 + i % 4))]) for i in range(24)}
    few = extracted(spark, [page(i) for i in range(7)])
    assert all("menu" in t for t in few.values())  # the prior alone knows nothing here


def test_the_tree_outvotes_the_prior(spark):
    """A template box inside marked articles goes; a trunk whose class sounds like an advert's is the article."""
    box = "<div class=z><p>Read more of our best stories here</p></div>"
    got = extracted(spark, [SHELL.format(f"<article><h1>T{i}</h1><p>text {i} of it</p>{box}<p>more {i}</p></article>") for i in range(10)])
    assert got == {i: f"T{i}\ntext {i} of it\nmore {i}" for i in range(10)}
    def page(i):
        return SHELL.format("<div class=box><p>Same words on each page of this host, always</p></div><div class='related'>" + "".join(f"<p>story {i} line {k}</p>" for k in range(4 + i % 5))
                            + f"</div><div class=end>{i} at the end</div>")
    got = extracted(spark, [page(i) for i in range(20)])
    assert got == {i: "\n".join(f"story {i} line {k}" for k in range(4 + i % 5)) for i in range(20)}
    assert "story" not in main_text(page(0))


def test_controls_and_fallbacks_are_no_text():
    assert main_text(SHELL.format("<p>a <button>Go</button> b</p><p><label>Name</label> c <select><option>x<option>y</select>d</p>")) == "a b\nc d"
    assert main_text(SHELL.format("<p>a</p><video><p>no video</p></video><object>no object</object><canvas>no canvas</canvas><svg><text>t</text></svg><p>b<button>open</p><p>c</p>")) == "a\nb\nc"
    for name in ("class='cookieBanner'", "id=CommentList", "class=adsbox", "class='x adUnit'", "class=ad-slot"):
        assert main_text(SHELL.format(f"<p>{'text ' * 20}</p><div {name}>noise</div>")) == ("text " * 20).strip(), name
    page = SHELL.format("<div><p>" + "long text of the page " * 9 + "</p><div><p>Get our letters</p><input type=email><button>Send</button></div><input type=hidden></div>")
    assert main_text(page) == ("long text of the page " * 9).strip()
    assert main_text("<div><p>all there is</p><input></div>") == "all there is"


def test_any_markup_takes_linear_time_and_memory():
    import time
    import tracemalloc
    n = 2_000_000
    for piece in ('<a "', "<a ", "<!--", "</x>", '<a b="', "<p class='", "</script", '<a b=">x', "<table><td>", "<div></p></div>", "<button>x", "<a<", "&amp"):
        t = time.time()
        page = html_text.Page(piece * (n // len(piece)))
        assert sum(1 for _ in html_text.tree_rows(page)) < 1000 and time.time() - t < 5, piece
    tracemalloc.start()
    assert main_text("<div>" * 50_000 + "x" + "</div>" * 50_000 + "<p>y") == "x\ny"
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    assert main_text("<div>" * 5000 + "<p>a" + "<div><td><b>z</td>" * 5000).split("\n")[:2] == ["a", "z"]
    assert main_text("<p a=\"never closed>x</p><p b='>'>y</p>") == "x\ny" and main_text("<p>x</p><p b='>y") == "x\ny"


def test_low_nodes_beyond_the_broadcast_bound(spark, monkeypatch):
    pages = [SHELL.format(f"<div class=box><p>Same words on each page</p></div><div class=story><p>story {i} of this host</p></div>") for i in range(12)]
    want = extracted(spark, pages)
    monkeypatch.setattr(html_text, "MOST_BROADCAST", -1)
    assert extracted(spark, pages) == want and want[3] == "story 3 of this host"
