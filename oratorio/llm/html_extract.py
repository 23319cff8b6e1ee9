"""Main text of web pages by consensus host paths.

A page is read into a light tree. Its containers are scored by the text of their blocks, less what is
in links, fading with depth. A class or id that names what surrounds a text makes a container suspect; how
much of the page's text it holds decides whether it goes. Each page votes for the generalised path (tags and classes, digits left
out) of its best container; votes are summed per host in Spark, and each host's winning path is taken
to all of its pages again. A page without that path, and a host that cannot be read, use the page's
own best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, table, written

RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("html body div section article main td center blockquote span".split())
#: Never part of the main text, with all that is in them.
DROPPED = frozenset((*RAW, *"head nav footer aside form button select option input svg math canvas audio video object embed menu dialog label fieldset datalist".split()))
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that name what is around the text, not the text. A name of such words and of PLACES
#: alone ("site-footer") is a strong hint, one with other words too ("content-sidebar-wrap") a weak one.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs crumbs pager pagination paging sidebar sidebars side aside widget widgets rail footer foot footers masthead topbar toolbar header headers comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations trending popular toc skip hidden copyright legal disclaimer form search tags taglist author-box".split()
)
PLACES = frozenset("site page main top bottom left right upper lower inner outer primary secondary global block box list item items area region container wrapper wrap section bar links link text js the".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Shares of the page's text outside links from which a container stays in spite of a weak or a strong hint.
WEAK, STRONG = 0.5, 0.9
#: Closed by the start of the tags named.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
P_CLOSERS = BLOCK - {"html", "head", "body"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+(?:-box)?")
FADE = 0.75


def hint(names: str) -> tuple[int, bool]:
    """How strongly a class or id says that a container is not the text (0 not, 1 weakly, 2 strongly), and
    whether it names comments."""
    most, comments = 0, False
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        about = [w for w in words if w in AROUND]
        if about:
            strong = name in AROUND or all(w in AROUND or w in PLACES for w in words)
            most = max(most, 1 + strong)
            comments = comments or strong and any(w in COMMENTS for w in words)
    return most, comments


class Node:
    __slots__ = ("attrs", "block", "comments", "dropped", "hint", "items", "key", "mark", "own", "parent", "tag", "titled")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []
        self.block: Node = self if tag in BLOCK or parent is None else parent.block
        self.titled = False
        inside = parent is not None and parent.own
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().strip()
        self.hint, self.comments = hint(named) if named and tag not in ("html", "body", "article", "main") else (0, False)
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        # a header inside the article holds its title; outside it is the site's
        header = tag == "header" and not inside
        if tag == "form":
            self.hint = 2  # some sites put the whole page into one
        self.dropped = (parent is not None and parent.dropped) or (tag in DROPPED and tag != "form") or hidden or header or self.comments or attrs.get("role", "").lower() in ROLES
        self.own = inside or tag in ("article", "main") or attrs.get("role") == "main"
        classes = sorted({re.sub(r"[\d_-]+$|\d+", "", c) for c in attrs.get("class", "").lower().split()} - {""})
        self.key = ".".join([tag, *classes])
        # the path, as a number that a child makes of its parent's: a path as text is made where one is voted for
        self.mark = xxhash.xxh64_intdigest(self.key, seed=parent.mark if parent is not None else 0)

    @property
    def path(self) -> str:
        keys, x = [], self
        while x is not None:
            keys.append(x.key)
            x = x.parent
        return ">".join(reversed(keys))


def mark_of(path: str) -> int:
    """The mark of the nodes with a path."""
    mark = 0
    for key in path.split(">"):
        mark = xxhash.xxh64_intdigest(key, seed=mark)
    return mark


def parse(source: str) -> Node:
    """The tree of a page: items of a node are nodes and decoded text. Broken markup never fails: end
    tags that fit nothing are passed over, and what is open at the end is closed. What surrounds the text
    is marked as dropped. Each step's work is bounded by the tags that it closes."""
    root = here = Node("#", {}, None)
    nodes, opened = [root], Counter()
    at, n = 0, len(source)

    def close(until: Node | None) -> None:
        nonlocal here
        while here is not until:
            opened[here.tag] -= 1
            here = here.parent

    def pop_to(tags: set[str], scope: set[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        x = here
        while x is not root and x.tag not in scope:
            if x.tag in tags:
                close(x.parent)
                return
            x = x.parent

    for m in TOKEN.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at:
            here.items.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[1]:
            pop_to({m[1].lower()}, {"#"})
        elif m[2]:
            tag = m[2].lower()
            if not m[4]:
                break  # cut inside a tag
            if tag in P_CLOSERS:
                pop_to({"p"}, {"#", "td", "th", "div", "section", "article", "body", "li", "table"})
            if tag in CLOSES:
                pop_to(CLOSES[tag], SCOPE.get(tag, set()) | {"#"})
            attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
            node = Node(tag, attrs, here)
            nodes.append(node)
            here.items.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                at = n if end is None else source.find(">", end.start()) + 1 or n
            elif tag not in VOID and (not m[3].endswith("/") or tag in BLOCK):  # HTML has no self-closing block
                here = node
                opened[tag] += 1
    if at < n and not re.match(r"</?[a-zA-Z!]", source[at:]):
        here.items.append(html.unescape(source[at:]))
    _judge(nodes)
    return root


def _judge(nodes: list[Node]) -> None:
    """Drops suspect containers by the share of the page's text that they hold, and notes which containers
    have a h1. nodes are in page order."""
    place = {id(x): k for k, x in enumerate(nodes)}
    held, link = [0] * len(nodes), [False] * len(nodes)
    for k, x in enumerate(nodes):
        link[k] = x.tag == "a" or (x.parent is not None and link[place[id(x.parent)]])
        if not x.dropped and not link[k]:
            held[k] = sum(len(i.strip()) for i in x.items if isinstance(i, str))
    for k in range(len(nodes) - 1, 0, -1):
        held[place[id(nodes[k].parent)]] += held[k]
    for k, x in enumerate(nodes[1:], 1):
        if x.parent.dropped or x.hint and held[k] < (WEAK if x.hint == 1 else STRONG) * held[0]:
            x.dropped = True
    for x in nodes:
        up: Node | None = x if x.tag == "h1" and not x.dropped else None
        while up is not None and not up.titled:
            up.titled, up = True, up.parent


def blocks(node: Node) -> list[tuple[str, int, Node]]:
    """(text, characters in links, block element) of the blocks under a node, in page order."""
    out: list[tuple[str, int, Node]] = []
    parts: list[str] = []
    linked = 0

    def flush(of: Node) -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked, of))
        parts.clear()
        linked = 0

    stack: list[tuple[Node, Iterator, bool]] = [(node, iter(node.items), False)]
    while stack:
        x, items, link = stack[-1]
        for item in items:
            if isinstance(item, str):
                parts.append(item)
                linked += len(item.strip()) if link else 0
                continue
            if item.dropped:
                if item.tag in BLOCK:
                    flush(x.block)
                continue
            if item.tag == "br":
                parts.append(" ")
            if item.tag in BLOCK:
                flush(x.block)
            stack.append((item, iter(item.items), link or item.tag == "a"))
            break
        else:
            stack.pop()
            if x.tag in BLOCK or x is node:
                flush(x.block)
    return out


def scores(root: Node) -> list[tuple[float, Node]]:
    """The score of each container that holds text, best first; equal scores in page order. A container's
    score is what its blocks are worth, less for each container between."""
    worth: dict[int, list] = {}  # of a node: what has come up to it, its first block
    order: list[Node] = [root]
    for x in order:
        order += [i for i in x.items if not isinstance(i, str) and not i.dropped]
    for k, (text, linked, block) in enumerate(blocks(root)):
        entry = worth.setdefault(id(block), [0.0, k])
        entry[0] += len(text) - 2 * linked
    found = []
    for x in reversed(order):
        if (entry := worth.get(id(x))) is None:
            continue
        passed, k = entry
        if x.tag in CONTAINER or x is root:
            named = 3.0 if x.tag in ("article", "main") or x.attrs.get("role") == "main" or x.attrs.get("itemprop") == "articleBody" else 0.5 if x.tag in ("#", "html", "body") else 1.0
            if any(w in ("content", "article", "post", "entry", "story", "body", "main", "text") for w in WORDS.findall(f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}".lower())):
                named *= 1.5
            if passed > 0:
                found.append((passed * named, k, x))
            passed *= FADE
        if x.parent is not None:
            up = worth.setdefault(id(x.parent), [0.0, k])
            up[0] += passed
            up[1] = min(up[1], k)
    return [(s, x) for s, _, x in sorted(found, key=lambda e: (-e[0], e[1]))]


def best_container(root: Node) -> Node | None:
    """The container with the best score, or the smallest around it that also has the page's h1."""
    found = scores(root)
    if not found:
        return None
    x: Node | None = found[0][1]
    while x is not None and x.tag not in ("#", "html", "body"):
        if x.titled:
            return x
        x = x.parent
    return found[0][1]


def extract(source: str | None, path: str | None = None) -> str:
    """The main text: of all containers with the path, else of the page's best one, else of the page."""
    root = parse(source or "")
    chosen: list[Node] = []
    if path is not None:
        stack, mark = [root], mark_of(path)
        while stack:
            x = stack.pop()
            if not x.dropped and x.mark == mark and x.path == path:
                chosen.append(x)
            else:
                stack += [i for i in reversed(x.items) if not isinstance(i, str)]
    found = [b for x in chosen for b in blocks(x)]
    if not found:
        found = blocks(best_container(root) or root)
    return "\n".join(t for t, _, _ in found)


def host(url):
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        votes: dict[tuple[str, str], float] = {}
        for name, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if best := best_container(parse(source.as_py() or "")):
                key = (name, best.path)
                votes[key] = votes.get(key, 0.0) + 1.0
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.float64())], ["host", "path", "votes"])


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(s.as_py(), p) for s, p in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """Rows (host, path): the path with most votes of the host's pages, of equal ones the first."""
    votes = pages.where("host <> ''").select("host", "html").mapInArrow(_vote, "host string, path string, votes double").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return written(votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path"))["path"].alias("path")), "host-paths")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one a row of pages.

    Null and empty html have the empty text; pages with a null url or one without a host vote for
    nothing and use their own best container; repeated rows vote and come out as often as they stand.
    Text is that of the blocks in page order, white space within a block one space, blocks joined by
    a line feed.
    """
    own = own_columns(pages, page_id, url, source).toDF("page_id", "url", "html").withColumn("host", F.coalesce(host(F.col("url")), F.lit("")))
    paths = winning_paths(own).withColumnRenamed("host", "of")
    joined = own.join(paths, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "path")
    kind = own.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_take, f"page_id {kind}, url string, text string, n_chars bigint")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by main_text; nulls, empty and repeated rows as it says."""
    return main_text(table(spark, sf_dir, "pages"))
