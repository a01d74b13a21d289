"""Main text of downloaded web pages, by wrappers induced from the pages of a host.

Where a model file is expected, a download may hold a web page instead; these bodies
(``url``, ``body``) are the records.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.base import join_small

# HTML elements by role.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol option p pre script section select style summary
svg table tbody td template textarea tfoot th thead title tr ul button canvas audio video""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CHROME = frozenset("""head nav footer aside form script style noscript template svg iframe button select option textarea dialog menu object title
canvas audio video fieldset legend""".split())
CHROME_NAMES = frozenset("""ad ads adsense advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist
consent cookie cookies discussion disqus footer gdpr header masthead menu menus nav navbar navigation newsletter notice notices notification pagination
pager popup promo promos promotion recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe
toolbar topbar widget widgets alert modal overlay hidden""".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
CONTENT_NAMES = frozenset("article articlebody main maincontent postcontent entrycontent articlecontent storybody".split())
P_ENDS = frozenset("""address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
h6 header hgroup hr li main menu nav ol p pre section summary table ul""".split())
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"),
        "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "body": ("head", "html")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}

# Every alternative is possessive and stops at "<" where it may, so a broken tag costs no more than its own length.
TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|</([a-zA-Z][^\s/<>]*+)[^<>]*+>|<([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
DEPTH = 150
MIN_PAGES = 5
#: A node with more slots than this forgets those on at most a twentieth of its pages; no such slot is template.
MAX_SLOTS = 512
#: Two lists of slots whose lengths have a greater product are aligned between slots that are unique in both.
WIDE = 65_536
#: Blocks that a name hides only if it is the whole name; of others, a part of it will do.
TEXTUAL = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption".split())
#: Names that begin so tell what a block goes without or beside.
NEUTRAL = frozenset("no not with without has is show hide js".split())


class Node:
    """A block of a page: label, whether it is chrome or a content landmark, texts and blocks in order.

    ``named`` is 1 if a part of a name suggests chrome and 2 if a whole name does; ``holds`` is 1 with an article
    and 2 with the main content below (or for html and body). A name hides what holds less than it says.
    """

    __slots__ = ("chrome", "content", "holds", "kids", "label", "named", "tag")

    def __init__(self, tag: str, label: str, chrome: bool = False, content: int = 0, named: int = 0):
        self.tag, self.label, self.chrome, self.content, self.named, self.kids = tag, label, chrome, content, named, []
        self.holds = 2 if tag in ("html", "body") else 0

    def hidden(self) -> bool:
        return self.chrome or self.named > self.holds or self.named == 2 and self.holds < 2


def _named(tag: str, name: str, inside: bool) -> int:
    """How much a class or id suggests chrome: 0, 1 for a part of it, 2 for all of it."""
    if inside and name in ("header", "entry-header", "article-header", "post-header"):
        return 0
    parts = [p for p in re.split(r"[-_\d]+", name) if p]
    if "".join(parts) in CHROME_NAMES:
        return 2
    return int(tag not in TEXTUAL and bool(parts) and parts[0] not in NEUTRAL and not CHROME_NAMES.isdisjoint(parts))


def _node(tag: str, attrs: str, inside: bool) -> Node:
    """``inside``: within an article, where a header is part of it."""
    chrome, label, named = tag in CHROME or tag == "header" and not inside, tag, 0
    content = 2 if tag == "main" else int(tag == "article")
    if attrs and attrs.strip("/ "):
        names: list[str] = []
        for m in ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key in ("class", "id"):
                names += value.split()
            elif key == "role":
                chrome, content = chrome or value in CHROME_ROLES, max(content, 2 * (value == "main"), int(value == "article"))
            elif key == "itemprop":
                content = max(content, 2 * (value == "articlebody"))
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                chrome = True
        for n in names:
            named = max(named, _named(tag, n, inside))
            plain = re.sub(r"[-_]", "", n)
            content = max(content, int(plain in CONTENT_NAMES) + (plain in ("main", "maincontent")))
        label += "".join(sorted({"." + re.sub(r"\d+", "", n) for n in names}))
    return Node(tag, label, chrome, 0 if chrome or named else content, named)


def parse_page(html: str) -> Node:
    """The tree of a page's blocks. Inline elements melt into text; character references are decoded.

    Time follows the length of the page, whatever is left open in it. Below ``DEPTH`` blocks melt into the one above them.
    """
    root = Node("#root", "#root")
    root.holds = 2
    stack, at, size = [root], 0, len(html)
    inside = 0

    def text(part: str) -> None:
        if part:
            stack[-1].kids.append(unescape(part) if "&" in part else part)

    def pop_to(n: int) -> None:
        nonlocal inside
        for x in stack[n:]:
            inside -= x.content > 0
        del stack[n:]
    # Behind the last ">" no tag ends.
    ends = html.rfind(">") + 1
    while at < size:
        m = TAG.search(html, at, ends) if at < ends else None
        if not m:
            rest = html[at:]
            open_tag = re.search(r"<[a-zA-Z/!?]", html[max(at, ends):])
            text(rest if open_tag is None else rest[:max(at, ends) - at + open_tag.start()])
            break
        if m[0].startswith("<!--") and not m[0].endswith(">"):
            text(html[at:m.start()])
            break  # a comment that never ends
        text(html[at:m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            block = tag in BLOCKS
            if tag == "br" or block:
                stack[-1].kids.append(" ")
            if block:
                if tag in P_ENDS:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == "p":
                            pop_to(i)
                            break
                        if stack[i].tag in ("td", "th", "caption", "button", "object", "template"):
                            break
                if tag in ENDS:
                    close, stop = ENDS[tag]
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in stop:
                            break
                        if stack[i].tag in close:
                            pop_to(i)
            if tag in VOID:
                continue
            node = None
            if block or m[3] and ("class" in m[3] or "hidden" in m[3] or "style" in m[3] or "role" in m[3]):
                node = _node(tag, m[3], inside > 0)
                if not block and not node.chrome:
                    node = None
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if node is not None and len(stack) < DEPTH:
                stack[-1].kids.append(node)
                for above in reversed(stack if node.content else []):
                    if above.holds >= node.content:
                        break
                    above.holds = node.content
                stack.append(node)
                inside += node.content > 0
        elif m[1]:
            tag = m[1].lower()
            if tag in BLOCKS:
                stack[-1].kids.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
    return root


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def groups(node: Node) -> list[tuple[str, list]]:
    """The node's content by runs: ("#", [text]) and (label, blocks with that label in a row)."""
    out: list[tuple[str, list]] = []
    texts: list[str] = []
    for kid in node.kids:
        if isinstance(kid, str):
            texts.append(kid)
            continue
        if (t := _clean(texts)):
            out.append(("#", [t]))
        texts = []
        if out and out[-1][0] == kid.label:
            out[-1][1].append(kid)
        else:
            out.append((kid.label, [kid]))
    if (t := _clean(texts)):
        out.append(("#", [t]))
    return out


# A wrapper slot: [label, pages, digest of its text or 0, varies, slots below]

def fold(node: Node) -> list:
    """A page as a wrapper of one page; blocks with one label in a row share a slot."""
    kids = []
    for label, items in groups(node):
        if label == "#":
            kids.append(["#", 1, zlib.crc32(items[0].encode("utf-8", "surrogatepass")), 0, []])
        else:
            slot = fold(items[0])
            for other in items[1:]:
                slot = merge(slot, fold(other), pages=False)
            kids.append(slot)
    return [node.label, 1, 0, 0, kids]


def matched(a: list, b: list) -> int:
    """Simple tree matching: the most slots two trees share in order, roots alike."""
    if a[0] != b[0]:
        return 0
    return 1 + sum(w for *_, w in align(a[4], b[4]))


def align(a: list, b: list) -> list[tuple[int, int, int]]:
    """Pairs (index in a, index in b, slots matched) of the best order-preserving matching of two lists of slots."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [(i, i, 1) for i in range(len(a))]
    if len(a) * len(b) > WIDE:
        return _align_wide(a, b)
    w = [[matched(x, y) for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[i][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j, w[i][j]))
    return out[::-1]


def _align_wide(a: list, b: list) -> list[tuple[int, int, int]]:
    """Slots with a label and text that is unique on both sides anchor the alignment; what lies between is aligned by itself.

    Without such anchors, slots of one label are paired in order.
    """
    name = lambda k: (k[0], k[2])
    times, where = Counter(map(name, b)), {name(k): j for j, k in enumerate(b)}
    own = Counter(map(name, a))
    pairs = [(i, where[name(k)]) for i, k in enumerate(a) if own[name(k)] == 1 and times.get(name(k)) == 1]
    tails, links, before = [], [], {}
    for i, j in pairs:  # longest run that grows on both sides
        at = bisect_left(tails, j)
        before[j] = links[at - 1] if at else None
        tails[at:at + 1], links[at:at + 1] = [j], [j]
    chosen, j, back = [], links[-1] if links else None, {j: i for i, j in pairs}
    while j is not None:
        chosen.append((back[j], j))
        j = before[j]
    out, i0, j0 = [], 0, 0
    for i, j in [*chosen[::-1], (len(a), len(b))]:
        x, y = a[i0:i], b[j0:j]
        if len(x) * len(y) <= WIDE:
            out += [(i0 + p, j0 + q, w) for p, q, w in align(x, y)]
        else:
            spots: dict[str, deque] = {}
            for q, k in enumerate(y):
                spots.setdefault(k[0], deque()).append(q)
            last = -1
            for p, k in enumerate(x):
                free = spots.get(k[0], ())
                while free and free[0] <= last:
                    free.popleft()
                if free:
                    last = free.popleft()
                    out.append((i0 + p, j0 + last, 1))
        if i < len(a):
            out.append((i, j, 1))
        i0, j0 = i + 1, j + 1
    return out


def merge(a: list, b: list, pages: bool = True) -> list:
    """One wrapper for what both cover; slots without a partner keep their place."""
    kids, i, j = [], 0, 0
    for x, y, _ in [*align(a[4], b[4]), (len(a[4]), len(b[4]), 0)]:
        kids += a[4][i:x] + b[4][j:y]
        if x < len(a[4]):
            kids.append(merge(a[4][x], b[4][y], pages))
        i, j = x + 1, y + 1
    if len(kids) > MAX_SLOTS:
        kids = [k for k in kids if 20 * k[1] > a[1] + b[1]]
    return [a[0], a[1] + b[1] if pages else max(a[1], b[1]), a[2], int(a[3] or b[3] or a[2] != b[2]), kids]


def varies(slot: list) -> bool:
    return bool(slot[3]) or any(varies(k) for k in slot[4])


def main_text(html: str | None, wrapper: list | None) -> str:
    """Blocks of the page's varying slots outside menus, notices and the like, joined by blank lines.

    Content landmarks bound the article where a page has them. Template is what the wrapper
    saw on at least five pages and half of the host's, always with one text, unless nothing on the host varies.
    """
    root = parse_page(html or "")
    known = wrapper is not None and wrapper[1] >= MIN_PAGES and varies(wrapper)
    out: list[tuple[bool, str]] = []

    def walk(node: Node, slot: list | None, inside: bool) -> None:
        if node.hidden():
            return
        inside = inside or node.content > 0
        runs = groups(node)
        below: dict[int, list] = {}
        if slot is not None:
            page = [[label, 0, 0, 0, fold(items[0])[4] if label != "#" else []] for label, items in runs] if [r[0] for r in runs] != [k[0] for k in slot[4]] else slot[4]
            below = {i: slot[4][j] for i, j, _ in align(page, slot[4])}
        for i, (label, items) in enumerate(runs):
            under = below.get(i)
            if label != "#":
                for item in items:
                    walk(item, under, inside)
            elif not (known and under is not None and not under[3] and under[1] >= max(MIN_PAGES, wrapper[1] / 2)):
                out.append((inside, items[0]))
    walk(root, wrapper, False)
    marked = [t for inside, t in out if inside]
    return "\n\n".join(marked or [t for _, t in out])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge sorted rows of one host after another."""
    host, held, seat = None, None, 0
    for part in parts:
        for h, s, w in zip(part["host"], part["seat"], part["wrapper"]):
            if held is not None and (h, s) == (host, seat):
                held = merge(held, json.loads(w))
                continue
            if held is not None:
                yield pd.DataFrame({"host": [host], "seat": [seat], "wrapper": [json.dumps(held)]})
            host, seat, held = h, s, json.loads(w)
    if held is not None:
        yield pd.DataFrame({"host": [host], "seat": [seat], "wrapper": [json.dumps(held)]})


def induce_wrappers(bodies: DataFrame, url: str = "url", body: str = "body", most_hosts: int = 2000, seats: int = 64) -> DataFrame:
    """``host`` and ``wrapper``: the aligned tree of all pages of a host, with what is constant in it.

    Each task folds its pages into one wrapper per host (handing on what it has after
    ``most_hosts`` hosts); the partial wrappers of a host meet in ``seats`` groups and then in one,
    so a host with most of the pages sends a wrapper per task, not its pages. Null bodies teach nothing, null urls belong to the
    empty host, repeated pages count as often as they come, an empty table gives no wrapper.
    """
    shape = "host string, seat int, wrapper string"

    def fold_pages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict[str, list] = {}
        seat = TaskContext.get().partitionId() % seats

        def give():
            yield pd.DataFrame({"host": list(held), "seat": seat, "wrapper": [json.dumps(w) for w in held.values()]})
            held.clear()
        for part in parts:
            for host, html in zip(part["host"], part["html"]):
                page = fold(parse_page(html))
                held[host] = merge(held[host], page) if host in held else page
                if len(held) >= most_hosts:
                    yield from give()
        if held:
            yield from give()
    pages = bodies.where(F.col(body).isNotNull()).select(host_of(F.col(url)).alias("host"), F.col(body).alias("html"))
    partial = pages.mapInPandas(fold_pages, shape)
    for by in (("host", "seat"), ("host",)):
        if by == ("host",):
            partial = partial.withColumn("seat", F.lit(0))
        partial = partial.repartition(*by).sortWithinPartitions(*by, "wrapper").mapInPandas(_joined, shape)
    return partial.select("host", "wrapper")


def extract_pages(bodies: DataFrame, url: str = "url", body: str = "body", name: str = "main_text") -> DataFrame:
    """Downloaded web pages with the article's text in ``main_text``.

    Pages of a host are aligned by simple tree matching into a wrapper. Slots with one text
    throughout are template; varying slots outside menus, headers, footers, sidebars,
    notices, adverts, forms, scripts and comments are content. Character references are decoded, white space within a
    block becomes one space, blocks are joined by a blank line in page order. Hosts with under five
    pages have no template. A null body gives an empty text; a null url belongs to the empty host; repeated rows
    all stay; a column named like ``main_text`` is replaced.
    """
    wrappers = induce_wrappers(bodies, url, body).select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))

    @F.pandas_udf(T.StringType())
    def extract(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        read: dict[str, list] = {}
        for pages, trees in parts:
            out = []
            for html, tree in zip(pages, trees):
                if tree is not None and tree not in read:
                    if len(read) > 500:
                        read.clear()
                    read[tree] = json.loads(tree)
                out.append(main_text(html, read.get(tree)))
            yield pd.Series(out, dtype=object)
    rows = bodies.withColumn("__host", host_of(F.col(url)))
    joined = join_small(rows, wrappers, ["__host"], F.xxhash64(F.col(url), F.col(body)), "left", max_bytes=16 << 20)
    return joined.withColumn(name, extract(F.col(body).cast("string"), F.col("__wrapper"))).drop("__host", "__wrapper")
