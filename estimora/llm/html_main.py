"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of styles: a node is the path of block elements and
their classes. Over the distinct pages that have a node, the entropy of what it holds (content)
and of the elements it has below (presentation) says how important it is: menus, notices and
footers repeat from page to page, articles don't. Branches of low importance are removed from
each page, along with those that their element, class or role marks as no part of an article.
Class names are evidence only, of blocks: whole names of telling words count, those of words that
articles use, too, only with a second sign (the tree's, or text that is mostly links). Within an
article the tree needs a second sign as well: a telling name, mostly links, or that a branch holds no
running text (paragraphs, headings, lists, quotes, captions, tables), so that what articles of a host
share, such as equal headings, stays. No branch that holds most of an article's text goes by its
name, nor does the tree remove most of an article, or all that a page has.

The text is what is left of the page's article (or main element, or else its body): block by
block, white space as one blank, blocks joined by an empty line.

Defined results: null and empty pages have an empty text; a null url has no host, whose pages
aren't merged; repeated rows have equal texts and count once; a node that two pages have is never
judged; an article within an article is a comment, unless the outer one has no text beside it;
time and memory follow a page's length, however deep it is nested; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estimora.llm.arrays import mixed, powers, row_chunks
from estimora.llm.shared import bounded, saved

#: Nodes are removed below this importance, to which they get DOUBT / pages for the pages that have
#: them: on two pages nothing is certain, on three what is equal on all. The square of these pages
#: must be LEAST_SHARE times the host's: a few of many may be versions of one article.
LEAST_IMPORTANCE, DOUBT, LEAST_SHARE = 0.3, 0.6, 2.25
#: Part of a branch's characters in links from which it is mostly links.
MOSTLY_LINKS = 0.5
#: Rows of removed nodes that are sent to all executors at most; more are joined by host.
BROADCAST_ROWS = 100_000

# Fixed values of HTML: elements that make blocks, that hold no markup, that have no end, and what ends what.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = frozenset("table ul ol dl select".split())
CELLS, TABLE = ("td", "th", "caption"), frozenset("table tr td th tbody thead tfoot caption html body".split())
# Elements, roles and words of classes and ids that are no part of an article, and words
# that may stand beside these in a name; elements that are never judged.
DROPPED = frozenset("aside button canvas datalist dialog footer form head iframe input menu nav noembed noframes noscript object option script search select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
KEPT = frozenset(("", "html", "body", "main", "article"))
PLAIN = frozenset("area article bar block body bottom box btn button buttons center close column container content count desktop entry feed form group header icon icons inner item items left link links list main mobile module new outer page panel post posts primary right row secondary section site slot sticky text thread top unit wrap wrapper".split())
WORDS = frozenset("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion promoted recommended related reply replies share sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget".split())
# Those of the words that an article may use of its own matter, and elements of running text.
WEAK = frozenset("banner comment consent gdpr login menu modal navigation notice notices promotion promoted recommended related reply replies share sharing social widget".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote figcaption figure caption table thead tbody tfoot tr td th pre".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'<>]+)")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@dataclass
class Page:
    """Block elements in the order in which they open, the page itself first, and blocks of text."""

    parents: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])
    paths: list[int] = field(default_factory=lambda: [0])  # hashes of the styles from the root down
    shapes: list[int] = field(default_factory=lambda: [0])  # hashes of the styles below
    dropped: list[bool] = field(default_factory=lambda: [False])  # by element or role
    doubted: list[int] = field(default_factory=lambda: [0])  # by class or id: 1 by a word that an article may use, 2 by others
    opened: list[int] = field(default_factory=lambda: [0])  # blocks before
    closed: list[int] = field(default_factory=lambda: [0])  # blocks up to the end
    holders: list[int] = field(default_factory=list)  # the element of each block
    blocks: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters of each block that are in links

    def passed_down(self, own: list) -> list:
        """For each element the first true value from the root down to it."""
        out: list = []
        for parent, x in zip(self.parents, own, strict=True):
            out.append(parent >= 0 and out[parent] or x)
        return out


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        name = (m[1] or m[5]).lower()
        found.setdefault(name, html.unescape(next((g for g in m.groups()[1:4] if g is not None), "")))
    return found


@lru_cache(10_000)
def telling(name: str) -> int:
    """Whether a class or id says that it is no part of an article: all its words must fit. 1 if its
    words have a meaning in articles, too, else 2; two such words leave no doubt."""
    words = [w.lower() for w in _PARTS.findall(name)]
    found = [w for w in words if w in WORDS]
    if not found or not all(w in WORDS or w in PLAIN or w.isdigit() for w in words):
        return 0
    return 2 if len(words) > 1 or any(w not in WEAK for w in found) else 1


def unwanted(name: str, found: dict[str, str], within: bool) -> bool:
    """Whether an element is no part of an article; within: an article or main is open."""
    if name in DROPPED or name == "header" and not within:
        return True
    return bool(found) and ("hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", found.get("style", "")) is not None)


def page_of(source: str) -> Page:
    """Block elements and blocks of text of a page. Elements that aren't closed end where HTML ends them."""
    page = Page()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, nearest block element, and whether its text is lost
    places: dict[str, list[int]] = defaultdict(list)  # where on the stack each name is open
    blocks: list[int] = []  # where block elements are
    held: list[str] = []
    in_links: list[str] = []
    hidden = 0  # open elements of one line whose text is lost

    def last(names) -> int:
        return max((places[x][-1] for x in names if places[x]), default=0)

    def close_block() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            linked = sum(map(len, in_links))
            held.clear()
            in_links.clear()
            if text:
                page.linked.append(min(len(text), linked))
                page.holders.append(stack[-1][1])
                page.blocks.append(text)

    def pop_to(k: int) -> None:
        nonlocal hidden
        if blocks and blocks[-1] >= k:
            close_block()
        while len(stack) > k:
            name, node, lost = stack.pop()
            places[name].pop()
            hidden -= lost
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
                page.closed[node] = len(page.blocks)

    at, n = 0, len(source)
    while at < n:
        m = _MARKUP.search(source, at)
        if not m:
            if not hidden:
                held.append(source[at:])
            break
        if m.start() > at and not hidden:
            held.append(source[at : m.start()])
            if places["a"]:
                in_links.append(held[-1].strip())
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            k, cell = last((name,)), last(CELLS)
            if k and (k >= cell or name in TABLE):
                pop_to(k)
            elif not k and not cell and name in ("p", "br"):
                close_block()
            continue
        if name in BLOCKS:
            near = blocks[-1] if blocks else 0
            if near and stack[near][0] == "p" and name not in ("option", "optgroup"):
                pop_to(near)
            while name in ENDS and (k := last(ENDS[name])) > last(SCOPES):
                pop_to(k)
            close_block()
        if name == "br":
            held.append(" ")
        if name in VOID:
            continue
        found = attributes(m[3]) if m[3].strip(" /") else {}
        bad = unwanted(name, found, bool(places["article"] or places["main"]))
        doubt = 0 if name in KEPT else max(map(telling, [*found.get("class", "").split(), *found.get("id", "").split()]), default=0)
        node, lost = stack[-1][1], False
        places[name].append(len(stack))
        if name in BLOCKS:
            style = ".".join([name, *sorted(found.get("class", "").split())])
            page.shapes[node] = (page.shapes[node] * _STEP + xxhash.xxh64_intdigest(style)) & _MASK
            page.paths.append(xxhash.xxh64_intdigest(style, page.paths[node]))
            page.parents.append(node)
            page.names.append(name)
            page.dropped.append(bad)
            page.doubted.append(doubt)
            page.shapes.append(0)
            page.opened.append(len(page.blocks))
            page.closed.append(len(page.blocks))
            blocks.append(len(stack))
            node = len(page.names) - 1
        else:
            lost = bad
        stack.append((name, node, lost))
        hidden += lost
        if name in RAW:
            end = raw_end(name).search(source, at)
            at = end.end()
            pop_to(len(stack) - 1)
    pop_to(1)
    close_block()
    page.closed[0] = len(page.blocks)
    return page


@lru_cache(64)
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I)


def style_rows(page: Page) -> list[tuple[int, int, int]]:
    """(path, content, presentation) of each path of a page that can be removed."""
    up, down = powers(len(page.blocks) + 1)
    a, b = np.array(page.opened), np.array(page.closed)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(page.blocks) + 1, np.uint64)
        np.cumsum(np.array([xxhash.xxh64_intdigest(t) for t in page.blocks], np.uint64) * up[:-1], out=sums[1:])
        content = np.where(b > a, mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)), np.uint64(0)).tolist()
    # elements of one path follow one another
    found: dict[int, tuple[int, int]] = {}
    for name, path, c, shape in zip(page.names, page.paths, content, page.shapes, strict=True):
        if name not in KEPT:
            held = found.get(path, (0, 0))
            found[path] = ((held[0] * _STEP + c) & _MASK, (held[1] * _STEP + shape + 1) & _MASK)
    return [(signed(path), signed(c), signed(shape)) for path, (c, shape) in found.items()]


#: The path of the root, which counts a host's pages.
ROOT = 0


def root_name(page: Page, kept: list[bool]) -> str | None:
    """article or main, whichever holds the text; main where it has more text beside its articles than in them."""
    found = {name for name, ok in zip(page.names, kept, strict=True) if ok}
    if "article" not in found or "main" not in found:
        return next((r for r in ("article", "main") if r in found), None)
    article, main = (page.passed_down([name == r for name in page.names]) for r in ("article", "main"))
    within = sum(len(t) for k, t in zip(page.holders, page.blocks, strict=True) if kept[k] and article[k])
    beside = sum(len(t) for k, t in zip(page.holders, page.blocks, strict=True) if kept[k] and main[k] and not article[k])
    return "main" if beside > within else "article"


def main_text(page: Page, removed: frozenset | set) -> str:
    """The blocks of the article that are in no removed or dropped branch."""
    n = len(page.names)
    dropped, doubted = page.passed_down(page.dropped), page.passed_down([x > 0 for x in page.doubted])
    root = root_name(page, [not x and not y for x, y in zip(dropped, doubted, strict=True)]) or root_name(page, [not x for x in dropped])
    # the outermost article or main of each element, -1 outside of all
    top: list[int] = []
    nested: list[bool] = []
    for k, parent in enumerate(page.parents):
        above = top[parent] if parent >= 0 else -1
        top.append(above if above >= 0 else k if root is None or page.names[k] == root else -1)
        nested.append(page.names[k] == "article" and above >= 0 and page.names[above] == "article" or parent >= 0 and nested[parent])
    # text of each element: all that isn't dropped, and of the articles what no inner one holds
    size = np.array([0 if dropped[k] else len(t) for k, t in zip(page.holders, page.blocks, strict=True)], np.int64)
    before = np.concatenate([[0], np.cumsum(size)])
    whole = (before[page.closed] - before[page.opened]).tolist()
    own = before.copy()
    own[1:] = np.cumsum(size * ~np.array([nested[k] for k in page.holders], bool))
    alone = (own[page.closed] - own[page.opened]).tolist()
    if root is not None:
        dropped = [d or x and alone[t] > 0 for d, x, t in zip(dropped, nested, top, strict=True)]
    links = before.copy()
    links[1:] = np.cumsum(np.minimum(size, np.array(page.linked, np.int64)))
    links = (links[page.closed] - links[page.opened]).tolist()
    running = before.copy()
    running[1:] = np.cumsum(size * np.array([page.names[k] in RUNNING for k in page.holders], bool))
    running = (running[page.closed] - running[page.opened]).tolist()
    doubted, judged = [False] * n, [False] * n
    for k, t in enumerate(top):
        if t < 0 or k == t or page.names[k] in KEPT:
            continue
        frequent = signed(page.paths[k]) in removed
        if root is None:  # without an article names and the tree each decide alone
            doubted[k], judged[k] = page.doubted[k] > 0, frequent
        elif page.names[k] not in RUNNING or page.names[k] in ("ul", "ol", "table"):
            linked = links[k] > 0 and links[k] >= MOSTLY_LINKS * whole[k]
            sure = page.doubted[k] == 2 and page.names[k] not in RUNNING
            doubted[k] = 2 * whole[k] <= whole[t] and (sure or page.doubted[k] > 0 and (linked or frequent))
            judged[k] = frequent and (linked or page.doubted[k] > 0 or not running[k])
    doubted, judged = page.passed_down(doubted), page.passed_down(judged)
    if root is not None:
        # an article whose text is removed for the most part is one that other pages have, too
        lost = before.copy()
        lost[1:] = np.cumsum(size * np.array([judged[k] for k in page.holders], bool))
        lost = (lost[page.closed] - lost[page.opened]).tolist()
        judged = [x and t >= 0 and 2 * lost[t] <= whole[t] for x, t in zip(judged, top, strict=True)]
    kept = [(k, t) for k, t in zip(page.holders, page.blocks, strict=True) if top[k] >= 0 and not dropped[k] and not doubted[k]]
    return "\n\n".join([t for k, t in kept if not judged[k]] or [t for _, t in kept])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def removed_styles(pages: DataFrame) -> DataFrame:
    """host and path of the nodes of low importance: normalised entropies over the host's distinct
    pages that have the node, of its content for the most part and of its presentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in row_chunks(batches, "html"):
            hosts, rows = [], []
            for host, source in zip(chunk.column("host").to_pylist(), chunk.column("html").to_pylist(), strict=True):
                page = signed(xxhash.xxh64_intdigest(source or ""))
                some = [(page, ROOT, 0, 0), *((page, *row) for row in style_rows(page_of(source or "")))]
                rows += some
                hosts += [host] * len(some)
            x = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x[:, k]) for k in range(4))], ["host", "page", "path", "content", "shape"])

    nodes = pages.filter("host != ''").select("host", "html").mapInArrow(run, "host string, page long, path long, content long, shape long")
    # copies of a page count once
    kinds = nodes.distinct().selectExpr("host", "path", "stack(2, 0, content, 1, shape) AS (kind, v)")
    counts = kinds.groupBy("host", "path", "kind", "v").agg(F.count("*").alias("c"))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    weight = F.when(F.col("kind") == 0, 0.7).otherwise(0.3)
    judged = sums.groupBy("host", "path").agg(F.max("m").alias("m"), F.sum(entropy * weight).alias("importance"))
    root, m = F.col("path") == ROOT, F.col("m")
    few = judged.filter(root | (F.col("importance") + DOUBT / m < LEAST_IMPORTANCE))
    few = few.withColumn("pages", F.max(F.when(root, m)).over(Window.partitionBy("host")))
    return few.filter(~root & (m * m >= F.col("pages") * LEAST_SHARE)).select("host", "path")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages(page_id, url, html)."""
    pages = bounded(pages).select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    removed = saved(removed_styles(pages), "styles")
    spark = pages.sparkSession
    known = None
    if removed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found: dict[str, set] = {}
        for r in removed.collect():
            found.setdefault(r["host"], set()).add(r["path"])
        known = spark.sparkContext.broadcast(found)
    else:
        pages = pages.join(removed.groupBy("host").agg(F.collect_set("path").alias("paths")), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in row_chunks(batches, "html"):
            paths = [known.value.get(h, ()) for h in chunk.column("host").to_pylist()] if known else [set(p or ()) for p in chunk.column("paths").to_pylist()]
            texts = [main_text(page_of(s or ""), p) for s, p in zip(chunk.column("html").to_pylist(), paths, strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column("page_id"), chunk.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
