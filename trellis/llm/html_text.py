"""Main text of web pages by a site style tree.

Pages of a host are merged into one style tree. A node is the path of block elements from the root; it gathers,
over the host's distinct pages, its presentation styles (the sequence of its children) and, at leaves, its content
features (the texts of its blocks). Following Yi, Liu and Li (2003):

* presentation importance of a node seen on m pages: the entropy of its styles, to base m;
* content importance of a leaf: one minus the mean entropy, to base m, of its features' spread over
  the pages (a text on every page has entropy 1, a text on one page 0);
* composite importance of an inner node: its leaves' mean and its own presentation, weighed ``GAMMA``.

Menus, adverts and footers may have other words on every page, so content alone does not show them; their place does. The
*trunk* of a page runs from the root into the child with most of the text outside links (paragraphs and headings
weigh more), as long as there is one; what stands before and after it is a *slot*, told apart by its side and by the
elements in it, not by its number, so pages with and without an advert share their slots. A slot's composite importance is
multiplied by the share of its text outside links and by its place: the larger of its presentation
importance and its size relative to the trunk. A branch whose importance on at least ``MIN_PAGES`` distinct pages of its host
is under ``LEAST`` is template and is removed from every page of the host, whatever its tag or class.

Elements and class names that HTML and custom reserve for navigation, adverts, forms and comments (``NOT_TEXT``, ``NOISE``)
and marked ``<article>`` and ``<main>`` elements are a prior. It decides alone on hosts with fewer pages. The tree outvotes it both
ways: a template branch inside an article goes (containers only), and a trunk of importance ``SPARED`` or more whose class
sounds like noise stays. A class name is a weak sign also on one page: an article inside a so named branch stays, and a branch
with most of the page's text is no noise (``Page.settle``).

Importance belongs to nodes, so a paragraph that many articles share stays. Headings and the parts of tables and
lists (``PART``) go only with a branch above them, and a slot with a title (``h1``) is not judged by its place.
Pages are distinct by their content: those whose longest blocks, outside what the prior drops, agree and hold
``BULK`` of that text are one page, whatever their scripts, menus or adverts.

Counting is two groupings on (host, node, feature); a host with a third of all pages is combined
before the shuffle. Only the topmost low nodes are kept, and joined back by host.

The scanner reads every character a bounded number of times, whatever the markup: a quote that is never closed ends quoting for the
rest of the page. Elements nested deeper than ``DEPTH`` belong to their ancestor of that depth, and nodes know their
parent alone, so time and memory are linear in the page.

Defined cases: null html gives empty text; null or odd urls form one host each for null and for no
host; unclosed tags end where their parent ends; a page without markup is one block; repeated rows
count once in the tree and are all extracted; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import prepare
from trellis.session import cut_lineage

GAMMA, LEAST, SPARED, MIN_PAGES = 0.9, 0.25, 0.5, 8
BULK = 0.8
#: Deepest node of the tree; share of a parent's weight that makes a child its trunk; weight of a block of a text element.
DEPTH, TRUNK, TEXT_WEIGHT = 64, 0.5, 40
#: Low nodes that are broadcast at most (16 bytes each and their host); more are joined by a shuffle.
MOST_BROADCAST = 500_000
ROWS = 8192

#: Elements by the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never part of an article: blocks, and elements inside a line (controls, and what is shown in place of media).
NOT_TEXT = frozenset("head nav footer aside form menu dialog fieldset header".split())
MUTE = frozenset("button select option label datalist template svg video audio object canvas".split())
#: Elements that hold others: they may be a trunk, and be removed inside an article.
CONTAINER = frozenset("html body article aside center details div dl fieldset figure footer form header main menu nav ol section table tbody tr td ul".split())
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
#: Elements that are removed with a branch above them only.
PART = frozenset("h1 h2 h3 h4 h5 h6 hgroup caption thead tbody tfoot tr th td li dt dd".split())
#: A word of a class or id that marks such a branch: by its place on the page, which wrappers name too, or by its matter.
PLACE = r"banner|sidebar|side|nav\w*|menu|breadcrumbs?|footer|header|masthead|search|toolbar|pagination"
MATTER = (r"ads?|ads?(?:box|slot|unit|space|block|banner|wrap\w*|container)|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|overlay|share|sharing"
          r"|social|related|newsletter|subscribe|signup|login|comments?|replies|discuss\w*|disqus")
NOISE, OF_MATTER = (re.compile(rf"(?:^|[\s_-])(?:{w})(?:$|[\s_-])", re.I) for w in (f"{PLACE}|{MATTER}", MATTER))
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Share of a page's text from which a branch of either kind is no noise, and up to which one with input fields is a form.
MOST_PLACE, MOST_MATTER, MOST_FORM = 0.5, 0.9, 0.2
_CLOSES_P = BLOCK - {"body", "html", "head"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)),
          "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table"))}
_NOT_P = BLOCK - {"p"}

_SIMPLE = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)([^<>"'=]*)>""")
_QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*')|["'=])*+)>""")
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\btype\s*=\s*["']?hidden""", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D\xa0]+")
_END_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Node:
    """A block element: its parent, label, whether the elements above drop it, whether it is article.

    ``noise``: the branch by class name that is nearest above, ``inner``: the same inside its article (-1: none).
    ``mass``, ``links``: characters outside and in links, ``texts``: text blocks, ``fields``: input fields; all with what is below.
    """

    __slots__ = ("tag", "label", "parent", "depth", "low", "main", "noise", "inner", "kids", "mass", "links", "texts", "fields", "title", "path", "side", "cut")

    def __init__(self, tag: str, label: str, parent: int, depth: int, low: bool, main: bool, noise: int, inner: int):
        self.tag, self.label, self.parent, self.depth = tag, label, parent, depth
        self.low, self.main, self.noise, self.inner = low, main, noise, inner
        self.kids: list[str] = []
        self.mass = self.links = self.texts = self.fields = self.path = 0
        self.title, self.side, self.cut = False, "", False


class Page:
    """Nodes and blocks of one page in one pass over its characters.

    ``blocks``: ``(text, node)``; ``kept``: whether the prior keeps each; ``branches``: the branches by class
    name, ``(node, by matter, branch above, branch above inside its article)``.
    """

    def __init__(self, html: str):
        self.nodes = [Node("", "", -1, 0, False, False, -1, -1)]
        self.blocks: list[tuple[str, int]] = []
        self.branches: list[tuple[int, bool, int, int]] = []
        self.stack = [0]
        self.open_tags: dict[str, int] = {}
        self.deep: list[str] = []  # elements below DEPTH
        self.text: list[str] = []
        self.link = False
        self.link_chars = 0
        self.mute: list[tuple[str, int]] = []  # muted elements, and the depth they were opened at
        self.names: dict[str, tuple[str, str]] = {}
        self.scan(html)
        while len(self.stack) > 1:
            self.pop()
        self.flush()
        for n in reversed(self.nodes[1:]):
            up = self.nodes[n.parent]
            up.mass, up.links, up.texts, up.fields, up.title = up.mass + n.mass, up.links + n.links, up.texts + n.texts, up.fields + n.fields, up.title or n.title
        self.place()

    # ---- scanner ----

    def scan(self, html: str) -> None:
        at, end, last, quotes = 0, len(html), html.rfind(">"), True
        while at < end:
            i = html.find("<", at)
            if i < 0 or i > last and not html.startswith("<!--", i):
                self.add(html[at:])
                return
            if i > at:
                self.add(html[at:i])
            after = html[i + 1:i + 2]
            if after in ("!", "?"):
                comment = html.startswith("<!--", i)
                stop = html.find("-->", i + 4) if comment else html.find(">", i)
                at = end if stop < 0 else stop + (3 if comment else 1)
                continue
            m = None
            if after == "/" or after.isalpha():
                m = _SIMPLE.match(html, i)
                if m is None and quotes:
                    m = _QUOTED.match(html, i)
                    if m is None and _BARE.match(html, i):
                        quotes = False  # a quote that is never closed
                m = m or _BARE.match(html, i)
            if m is None:
                self.add("<")
                at = i + 1
                continue
            at = m.end()
            closing, tag, attrs = m[1], m[2].lower(), m[3]
            if tag in RAW:
                if not closing:
                    if not attrs.endswith("/"):
                        stop = _END_RAW[tag].search(html, at) if at <= last else None
                        at = stop.end() if stop else end
                    self.add(" ")
            elif tag == "a":
                self.link = not closing
            elif tag == "br":
                self.add(" ")
            elif tag == "hr":
                self.flush()
            elif tag == "input":
                if not _HIDDEN.search(attrs):
                    self.nodes[self.stack[-1]].fields += 1
            elif tag in MUTE:
                if closing:
                    self.unmute(tag)
                elif not attrs.endswith("/"):
                    if tag == "select":
                        self.nodes[self.stack[-1]].fields += 1
                    if len(self.mute) < DEPTH:
                        self.mute.append((tag, len(self.stack)))
                    self.add_space()
            elif tag in BLOCK:
                if closing:
                    self.close(tag)
                else:
                    self.open(tag, attrs)

    def add(self, s: str) -> None:
        if not self.mute:
            self.text.append(s)
            if self.link:
                self.link_chars += len(s)

    def add_space(self) -> None:
        self.text.append(" ")

    def unmute(self, tag: str) -> None:
        for k in range(len(self.mute) - 1, -1, -1):
            if self.mute[k][0] == tag:
                del self.mute[k:]
                return

    def marks(self, attrs: str) -> tuple[str, str]:
        """Classes and role as a label, and all names as words."""
        found = self.names.get(attrs)
        if found is None:
            pairs = [(x[0].lower(), x[1] or x[2] or x[3]) for x in _ATTR.findall(attrs)]
            found = self.names[attrs] = (" ".join(sorted(v.strip().lower() for k, v in pairs if k != "id")).strip(),
                                         _CAMEL.sub(" ", " ".join(v for _, v in pairs)))
        return found

    def open(self, tag: str, attrs: str) -> None:
        if tag in _CLOSES_P:
            self.end_within("p", _NOT_P)
        for same in _SAME.get(tag, ()):
            self.end_within(same, _SCOPE[tag])
        if tag == "body":
            self.end_within("head", frozenset())
        self.flush()
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        if len(self.stack) > DEPTH:
            self.deep.append(tag)
            return
        mark, names = self.marks(attrs) if attrs else ("", "")
        at = self.stack[-1]
        top = self.nodes[at]
        own = tag in ("article", "main")
        low = top.low or (tag in NOT_TEXT and not (tag == "header" and top.main))
        noise, inner = top.noise, -1 if own else top.inner
        here = len(self.nodes)
        if names and not low and not own and tag not in ("body", "html") and NOISE.search(names):
            self.branches.append((here, bool(OF_MATTER.search(names)), noise, inner))
            noise = inner = len(self.branches) - 1
        label = f"{tag}.{mark}" if mark else tag
        top.kids.append(label)
        node = Node(tag, label, at, len(self.stack), low, top.main or (own and not low), noise, inner)
        node.title = tag == "h1"
        self.nodes.append(node)
        self.stack.append(here)

    def end_within(self, tag: str, scope: frozenset) -> None:
        """Close the nearest open ``tag`` unless an element of ``scope`` is nearer."""
        if not self.open_tags.get(tag):
            return
        for name in reversed(self.deep[-DEPTH:]):
            if name == tag:
                return self.close(tag)
            if name in scope:
                return
        if len(self.deep) > DEPTH:
            return
        for i in reversed(self.stack[1:]):
            name = self.nodes[i].tag
            if name == tag:
                return self.close(tag)
            if name in scope:
                return

    def close(self, tag: str) -> None:
        if self.open_tags.get(tag):
            while self.pop() != tag:
                pass

    def pop(self) -> str:
        self.flush()
        if self.deep:
            tag = self.deep.pop()
        else:
            tag = self.nodes[self.stack.pop()].tag
            while self.mute and self.mute[-1][1] > len(self.stack):
                self.mute.pop()  # not closed within its block
        self.open_tags[tag] -= 1
        return tag

    def flush(self) -> None:
        if self.text:
            s = "".join(self.text)
            self.text.clear()
            s = _SPACE.sub(" ", unescape(s)).strip(" ")
            if s:
                i = self.stack[-1]
                node = self.nodes[i]
                self.blocks.append((s, i))
                linked = min(len(s), self.link_chars)
                node.links += linked
                node.mass += len(s) - linked
                node.texts += node.tag in TEXT
        self.link, self.link_chars = False, 0

    # ---- place in the tree ----

    def place(self) -> None:
        """Trunk, sides and path of every node."""
        nodes = self.nodes
        weight = [n.mass + TEXT_WEIGHT * n.texts if n.mass else 0 for n in nodes]
        best: dict[int, int] = {}
        for i in range(len(nodes) - 1, 0, -1):
            up = nodes[i].parent
            if nodes[i].tag != "head" and (up not in best or weight[i] >= weight[best[up]]):
                best[up] = i
        trunk = {}
        at = 0
        while at in best:
            child = best[at]
            if nodes[child].tag not in CONTAINER or weight[child] <= TRUNK * weight[at] or not weight[child]:
                break
            trunk[at] = child
            at = child
        paths: dict[tuple[int, str], int] = {}
        self.slots: list[tuple[int, float, float]] = []
        for i, n in enumerate(nodes[1:], 1):
            label = n.label
            if n.parent in trunk:
                h = trunk[n.parent]
                n.side = "=" if i == h else "<" if i < h else ">"
                label += n.side
                if i != h:
                    shape = sorted({k.partition(".")[0] for k in n.kids})
                    link = n.links / (n.mass + n.links) if n.links else 0.0
                    label += " ".join(shape) + (" a" if link > 0.5 else "")
                    if n.mass + n.links:
                        self.slots.append((i, min(1.0, n.mass / nodes[h].mass) if nodes[h].mass else 1.0, link))
            key = (nodes[n.parent].path, label)
            path = paths.get(key)
            if path is None:
                path = paths[key] = _hash(f"{key[0]}/{label}")
            n.path = path

    def settle(self, spared: frozenset = frozenset()) -> list[bool]:
        """Which blocks the prior keeps, known at the page's end; ``spared``: paths of branches that the tree keeps.

        A branch by place with over ``MOST_PLACE`` of the text that elements keep is a wrapper, no noise. If
        article text outside all branches by matter is left (branches by place count inside the article
        only), that is the article; else article text in any branch; else a branch by
        matter is noise up to ``MOST_MATTER`` of the text. A container with input fields and at most ``MOST_FORM`` of
        the text is a form.
        """
        nodes = self.nodes
        size = [0] * len(self.branches)
        total = 0
        for s, i in self.blocks:
            if not nodes[i].low:
                total += len(s)
                if nodes[i].noise >= 0:
                    size[nodes[i].noise] += len(s)
        for b in range(len(self.branches) - 1, -1, -1):
            if self.branches[b][2] >= 0:
                size[self.branches[b][2]] += size[b]
        form = [False] * len(nodes)
        for i, n in enumerate(nodes[1:], 1):
            form[i] = form[n.parent] or bool(n.fields) and n.tag in CONTAINER and n.mass + n.links <= MOST_FORM * total
        # whether a branch, and all those above it, is no noise
        wrap, most, calm, inside = [], [], [], []
        for b, (i, matter, above, inner) in enumerate(self.branches):
            kept = nodes[i].path in spared
            one = kept or not matter and size[b] > MOST_PLACE * total
            any_ = one or matter and size[b] > MOST_MATTER * total
            inside.append(one and (inner < 0 or inside[inner]))
            wrap.append(one)
            most.append(any_ and (above < 0 or most[above]))
            calm.append((not matter or kept) and (above < 0 or calm[above]))
        marked, first, plain = [], [], []
        for _, i in self.blocks:
            n = nodes[i]
            ok = not n.low and not form[i]
            marked.append(ok and n.main and (n.inner < 0 or inside[n.inner]))
            first.append(marked[-1] and (n.noise < 0 or calm[n.noise]))
            plain.append(ok and (n.noise < 0 or most[n.noise]))
        self.inside = any(marked)
        return first if any(first) else marked if self.inside else plain


def main_text(html: str | None, low: frozenset = frozenset(), spared: frozenset = frozenset()) -> str:
    """Blocks of the article, joined by newlines; ``low`` and ``spared`` hold the host's nodes by importance."""
    p = Page(html or "")
    kept = p.settle(spared)
    if low:
        for n in p.nodes[1:]:
            # inside an article containers alone are removed
            n.cut = p.nodes[n.parent].cut or n.path in low and n.tag not in PART and n.side != "=" and (not p.inside or n.tag in CONTAINER)
    return "\n".join(s for (s, i), k in zip(p.blocks, kept) if k and not p.nodes[i].cut)


def content_key(p: Page, kept: list[bool]) -> int:
    """What makes a page distinct on its host: its longest blocks up to ``BULK`` of the text that the prior keeps."""
    texts = sorted((s for (s, _), k in zip(p.blocks, kept) if k), key=lambda s: (-len(s), s))
    left, bulk = BULK * sum(map(len, texts)), []
    for s in texts:
        if left <= 0:
            break
        bulk.append(s)
        left -= len(s)
    return _hash("\n".join(sorted(bulk)))


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


# ---- style tree ----

STYLE, FEATURE, SLOT, NODE = 0, 1, 2, 3


def tree_rows(p: Page) -> Iterator[tuple]:
    """``(kind, node, feature, size, link, above, class)`` of a page, each once: styles of its nodes, features of its leaves,
    place of its slots, and its nodes with those above (``class``: 1 removable, 2 trunk of a noisy name, 0 neither)."""
    nodes = p.nodes
    noisy = {b[0] for b in p.branches}
    seen, above = set(), {}
    for i, n in enumerate(nodes[1:], 1):
        if n.path not in above:
            up = nodes[n.parent]
            above[n.path] = (*above[up.path], up.path) if n.parent else ()
            kind = (2 if i in noisy else 0) if n.side == "=" else int(n.tag not in PART)
            yield NODE, n.path, 0, None, None, list(above[n.path]), kind
        row = (STYLE, n.path, _hash(" ".join(n.kids)))
        if row not in seen:
            seen.add(row)
            yield *row, None, None, None, None
    for s, i in p.blocks:
        row = (FEATURE, nodes[i].path, _hash(s))
        if row not in seen:
            seen.add(row)
            yield *row, None, None, None, None
    slots: dict[int, list] = {}
    for i, size, link in p.slots:
        total = slots.setdefault(nodes[i].path, [0.0, 0.0, 0.0])
        total[0], total[1], total[2] = total[0] + (1.0 if nodes[i].title else size), total[1] + link, total[2] + 1
    for path, (size, link, n) in slots.items():
        yield SLOT, path, 0, min(1.0, size), link / n, None, None


_KINDS = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.int32())
_NAMES = ["host", "h", "kind", "node", "feature", "size", "link", "above", "class"]


def _tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS)], _NAMES)
    for b in batches:
        out = []
        for host, html in zip(*[c.to_pylist() for c in b.columns]):
            p = Page(html)
            h = content_key(p, p.settle())
            for row in tree_rows(p):
                out.append((host, h, *row))
                if len(out) == ROWS:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)


def importances(pages: DataFrame) -> DataFrame:
    """Style tree of every host of ``(host, html)``: ``host, node, m`` (distinct pages), ``importance, above, class``."""
    src = pages.where("html IS NOT NULL").select("host", "html")
    rows = src.mapInArrow(_tree_batches, "host string, h bigint, kind int, node bigint, feature bigint, size double, link double, above array<bigint>, class int")
    once = cut_lineage(rows.groupBy("host", "h", "kind", "node", "feature").agg(
        F.any_value("above").alias("above"), F.min("class").alias("class"), F.avg("size").alias("size"), F.avg("link").alias("link")))
    seen = once.where(f"kind = {NODE}").groupBy("host", "node").agg(F.count(F.lit(1)).alias("m"), F.any_value("above").alias("above"), F.max("class").alias("class"))
    slots = once.where(f"kind = {SLOT}").groupBy("host", "node").agg(F.avg("size").alias("size"), F.avg("link").alias("link"))
    spread = once.where(f"kind IN ({STYLE}, {FEATURE})").groupBy("host", "kind", "node", "feature").agg(F.count(F.lit(1)).alias("f"))
    f = F.col("f").cast("double")
    sums = spread.groupBy("host", "kind", "node").agg(
        F.count(F.lit(1)).alias("l"), F.sum(F.log(f)).alias("s"), F.sum(f).alias("t"), F.sum(f * F.log(f)).alias("ff"))
    sums = cut_lineage(sums.join(seen, ["host", "node"]))
    base = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    single = F.col("m") == 1
    entropy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log("t") - F.col("ff") / F.col("t")) / base))
    shown = sums.where(f"kind = {STYLE}").select("host", "node", "m", "above", "class", F.when(single, 1.0).otherwise(entropy).alias("shown"))
    leaf = sums.where(f"kind = {FEATURE}").select("host", "l", F.when(single, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1 - F.col("s") / F.col("l") / base)).alias("content"), F.explode(F.concat("above", F.array("node"))).alias("node"))
    below = leaf.groupBy("host", "node").agg(F.sum("l").alias("l"), (F.sum(F.col("l") * F.col("content")) / F.sum("l")).alias("content"))
    weight = F.pow(F.lit(GAMMA), F.coalesce("l", F.lit(0)))
    whole = (1 - weight) * F.coalesce("content", F.lit(0.0)) + weight * F.col("shown")
    place = F.when(F.col("size").isNull(), 1.0).otherwise(F.greatest(F.when(single, 1.0).otherwise(F.col("shown")), "size") * (1 - F.col("link")))
    return (shown.join(below, ["host", "node"], "left").join(slots, ["host", "node"], "left")
            .select("host", "node", "m", (whole * place).alias("importance"), "above", "class"))


def judged_nodes(pages: DataFrame) -> DataFrame:
    """``(host, low, spared)``: the topmost template nodes of hosts that have any, and their trunks whose names sound like noise."""
    known = importances(pages).where(F.col("m") >= MIN_PAGES)
    judged = cut_lineage(known.select("host", "node", "above", F.when((F.col("class") == 1) & (F.col("importance") < LEAST), True).when(
        (F.col("class") == 2) & (F.col("importance") >= SPARED), False).alias("low")).where("low IS NOT NULL"))
    low = judged.where("low").select("host", "node", "above")
    below = (low.select("host", "node", F.explode("above").alias("up")).join(low.select("host", F.col("node").alias("up")), ["host", "up"])
             .select("host", "node").distinct())
    top = low.join(below, ["host", "node"], "left_anti").select("host", "node", F.lit(True).alias("low"))
    both = top.unionByName(judged.where("NOT low").select("host", "node", "low"))
    return both.groupBy("host").agg(F.collect_set(F.when(F.col("low"), F.col("node"))).alias("low"), F.collect_set(F.when(~F.col("low"), F.col("node"))).alias("spared"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            html, low, spared = (part.columns[k].to_pylist() for k in (-3, -2, -1))
            text = [main_text(h, frozenset(n or ()), frozenset(s or ())) for h, n, s in zip(html, low, spared)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-3], pa.array(text, pa.string())], [*part.schema.names[:-3], "text"])


def extract(pages: DataFrame, ids: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """``ids`` and the main ``text`` of every page."""
    prepare(pages.sparkSession)
    src = pages.select(*ids, F.coalesce(host_of(url), F.lit("")).alias("__host"), F.col(html).cast("string").alias("__html"))
    judged = cut_lineage(judged_nodes(src.select(F.col("__host").alias("host"), F.col("__html").alias("html"))))
    n = judged.agg(F.sum(F.size("low") + F.size("spared"))).first()[0] or 0
    judged = judged.select(F.col("host").alias("__host"), F.col("low").alias("__low"), F.col("spared").alias("__spared"))
    out = src.join(F.broadcast(judged) if n <= MOST_BROADCAST else judged, "__host", "left").select(*ids, "__html", "__low", "__spared")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-3])
    return out.mapInArrow(_texts, f"{kept}, text string")
