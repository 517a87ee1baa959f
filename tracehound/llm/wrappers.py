"""Main text of HTML pages by wrappers: union-free regular expressions over the pages of a host.

A page becomes a tree of block elements. Neighbouring children that repeat fold into one repeated
child or group. Two trees are aligned child by child; what only one of them has becomes optional,
what matches is aligned in turn. Texts that meet in one place are counted by a majority vote: where
they differ the place is a text slot, where nearly all pages have the same it is the host's template.
Doing so page after page gives the host's wrapper, which also sums how much text each place held. The
place of the article is chosen once for a host, from the wrapper; each page is matched with it and
gives the blocks found there, without the template's. What varies from page to page and still isn't
article (adverts, comments) no alignment can tell from article text: such elements are known by tag,
role and the words of their class and id.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, written

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object select math canvas audio video".split())
BLOCK = frozenset("html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary dialog center hr menu search hgroup legend".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NOISE_TAGS = frozenset("head nav footer aside form header dialog menu search button label noscript template".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class and id that mark what isn't the article.
NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb
    breadcrumbs header masthead topbar footer sidebar sidenav rail widget widgets related recommended share sharing social cookie cookies
    consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup comment comments disqus
    replies respond reply discussion login search pagination pager skip toolbar legal copyright disclaimer hidden""".split()
)
MAIN_WORDS = frozenset("article content post story entry main body text prose".split())
STEMS = frozenset("html body article main".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


#: Places of hosts are sent to every task up to so many bytes, joined beyond.
BROADCAST_BYTES = 16 << 20
#: Pages that a host needs before equal text in one place counts as its template, and the votes for that text, in per cent of the pages that have the place.
LEAST_PAGES, TEMPLATE_VOTES = 8, 80
#: Children of two elements are aligned by the longest common subsequence up to this product of their numbers, by an increasing one beyond.
ALIGN = 20_000


@dataclass
class Node:
    """An element, or the place of such elements in a wrapper.

    text: characters of its own, links: those inside links. value: hash of its own text (0: none);
    votes: pages with that text less pages with another (a majority vote), so a text slot has few and
    the template's text as many as pages. blocks: its text blocks in a page.
    """

    label: str
    noise: bool = False
    text: int = 0
    links: int = 0
    pages: int = 1
    optional: bool = False
    repeated: bool = False
    value: int = 0
    votes: int = 0
    children: list[Node] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """The tree, parents before children, in order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))

    def dump(self) -> list:
        """A row for each node, parents first; flat, so depth doesn't matter."""
        return [[n.label, int(n.noise), n.text, n.links, n.pages, int(n.optional), int(n.repeated), n.value, n.votes, len(n.children)] for n in self.walk()]

    @staticmethod
    def load(rows: list) -> Node:
        top = Node("")
        open_ = [[top, 1]]
        for label, noise, text, links, pages, optional, repeated, value, votes, inner in rows:
            while not open_[-1][1]:
                open_.pop()
            open_[-1][1] -= 1
            node = Node(label, bool(noise), text, links, pages, bool(optional), bool(repeated), value, votes)
            open_[-1][0].children.append(node)
            open_.append([node, inner])
        return top.children[0]


def _label(tag: str, attrs: str) -> tuple[str, bool]:
    """Name of an element for alignment, and whether it can't hold article text (the name tells that, too).

    Digits right behind letters of a class stay; numbers in ids differ from page to page.
    """
    found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)} if attrs.strip(" /\t\n") else {}
    parts = lambda v, digits: re.findall(r"[a-z]+[0-9]*" if digits else r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", v).lower())
    named = set(parts(found.get("class", ""), True)) | set(parts(found.get("id", ""), False))
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "") == "true" or "display:none" in style
    noise = hidden or tag in NOISE_TAGS or found.get("role", "").lower() in NOISE_ROLES
    noise = noise or tag not in STEMS and any(w.rstrip("0123456789") in NOISE_WORDS for w in named)
    return ".".join([tag, *sorted(named | ({f"role-{found['role'].lower()}"} if "role" in found else set())), *(["!hidden"] if hidden else [])]), noise


def _both(a: int, b: int) -> int:
    """Hash of two texts side by side, each given by its hash."""
    return a or b if not a or not b else (a * 0x9E3779B97F4A7C15 + b) % (1 << 64) | 1


def parse(page: str) -> tuple[Node, list[str]]:
    """The page's tree, folded, and its text blocks in order; nodes tell their blocks.

    Broken markup is read leniently: what is never closed ends with its parent or the page, stray
    end tags are ignored, a cut-off tag is dropped.
    """
    import xxhash

    root = Node("")
    stack: list[Node] = [root]
    tags = [""]
    open_tags: dict[str, list[int]] = {}
    blocks: list[str] = []
    held: list[str] = []
    in_link = 0
    at = 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            own = stack[-1]
            own.blocks.append(len(blocks))
            own.value, own.votes = _both(own.value, xxhash.xxh3_64_intdigest(text) | 1), 1
            own.text += len(text)
            blocks.append(text)

    def pop(to: int) -> None:
        flush()
        while len(stack) > to:
            _fold(stack.pop())
            open_tags[tags.pop()].pop()

    while at < len(page):
        m = _TOKEN.search(page, at)
        raw = page[at : m.start() if m else len(page)]
        if raw:
            text = html.unescape(raw)
            held.append(text)
            if in_link:
                stack[-1].links += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[0].endswith(">"):
            continue
        if not m[1] and tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif m[1]:
            if tag in BLOCK or tag in NOISE_TAGS:
                if open_tags.get(tag):
                    pop(open_tags[tag][-1])
                else:
                    flush()
            elif tag == "a":
                in_link = 0
        elif tag == "br":
            held.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in BLOCK or tag in NOISE_TAGS:
            flush()
            if tag in VOID:
                continue
            if tag != "button" and tag != "label" and tags[-1] == "p":
                pop(len(tags) - 1)
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] in CLOSES.get(tag, ()):
                    pop(k)
                elif tags[k] in BLOCK:
                    break
            node = Node(*_label(tag, m[3]))
            stack[-1].children.append(node)
            open_tags.setdefault(tag, []).append(len(tags))
            stack.append(node)
            tags.append(tag)
            in_link = 0
    flush()
    while len(stack) > 1:
        _fold(stack.pop())
    _fold(root)
    return root, blocks


def _fold(node: Node) -> None:
    """Children that repeat side by side become one repeated child, runs of up to four one repeated group."""
    groups: list[list[Node]] = []
    for c in node.children:
        if groups and groups[-1][0].label == c.label:
            groups[-1].append(c)
        else:
            groups.append([c])
    for size in (2, 3, 4):
        out: list[list[Node]] = []
        last: list[int] = []  # where the group that ended the list began, if one did
        k = 0
        while k < len(groups):
            run = groups[k : k + size]
            begin = last[-1] if last and len(out) - last[-1] == size else None
            if len(run) == size and begin is not None and [g[0].label for g in run] == [g[0].label for g in out[begin:]]:
                for g, more in zip(out[begin:], run):
                    g.extend(more)
                k += size
                continue
            if len(run) == size and [g[0].label for g in run] == [g[0].label for g in groups[k + size : k + 2 * size]]:
                last.append(len(out))
                out += [list(g) for g in run]
                k += size
                continue
            out.append(groups[k])
            k += 1
        groups = out
    node.children = [g[0] if len(g) == 1 else _united(g, within=True) for g in groups]


def _aligned(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence of labels."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    a, b = x[head : len(x) - tail], y[head : len(y) - tail]
    middle: list[tuple[int, int]] = []
    if len(a) * len(b) <= ALIGN:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                middle.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        # The k-th of a label meets the k-th of the other side; of these pairs the longest increasing run counts.
        where: dict[str, list[int]] = {}
        for j in range(len(b) - 1, -1, -1):
            where.setdefault(b[j], []).append(j)
        pairs = [(i, where[t].pop()) for i, t in enumerate(a) if where.get(t)]
        ends: list[int] = []
        tops: list[int] = []
        before = [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(ends, j)
            ends[at : at + 1], tops[at : at + 1] = [j], [k]
            before[k] = tops[at - 1] if at else -1
        k = tops[-1] if tops else -1
        while k >= 0:
            middle.append(pairs[k])
            k = before[k]
        middle.reverse()
    return [(i, i) for i in range(head)] + [(head + i, head + j) for i, j in middle] + [(len(x) - tail + i, len(y) - tail + i) for i in range(tail)]


def _united(same: list[Node], within: bool) -> Node:
    """One node for nodes with one label, their children aligned in turn; within: all are from one page."""
    top: list[Node] = []
    todo = [(same, False, False, top)]
    while todo:
        nodes, optional, repeated, into = todo.pop()
        out = Node(nodes[0].label, nodes[0].noise)
        out.text, out.links = sum(n.text for n in nodes), sum(n.links for n in nodes)
        out.pages = max(n.pages for n in nodes) if within else sum(n.pages for n in nodes)
        out.optional = optional or any(n.optional for n in nodes)
        out.repeated = repeated or any(n.repeated for n in nodes) or within and len(nodes) > 1
        for n in nodes:
            out.blocks += n.blocks
            if within:
                out.value = _both(out.value, n.value)
                out.votes = int(out.value > 0)
            elif n.value == out.value or not n.votes:
                out.votes += n.votes
            elif n.votes > out.votes:
                out.value, out.votes = n.value, n.votes - out.votes
            else:
                out.votes -= n.votes
        groups: list[tuple[list[Node], bool, bool]] = [([c], False, False) for c in nodes[0].children]
        for n in nodes[1:]:
            groups = _spread(groups, n.children)
        into.append(out)
        out.children = [out] * len(groups)  # places, filled below
        todo += [(g, opt, rep, _Slot(out.children, k)) for k, (g, opt, rep) in enumerate(groups)]
    return top[0]


class _Slot:
    """Takes a node into its place among its parent's children."""

    def __init__(self, children: list[Node], place: int):
        self.children, self.place = children, place

    def append(self, node: Node) -> None:
        self.children[self.place] = node


def _spread(groups: list, children: list[Node]) -> list:
    """Groups of aligned children (nodes, optional, repeated) with the children of one more element."""
    met = _aligned([g[0][0].label for g in groups], [c.label for c in children])
    out: list = []

    def alone(nodes: list[Node], repeated: bool) -> None:
        if out and out[-1][0][0].label == nodes[0].label:  # an optional twin is a repetition
            out[-1] = (out[-1][0] + nodes, True, True)
        else:
            out.append((nodes, True, repeated))

    i = j = 0
    for p, q in [*met, (len(groups), len(children))]:
        for g in groups[i:p]:
            alone(g[0], g[2])
        for c in children[j:q]:
            alone([c], False)
        if p < len(groups):
            out.append((groups[p][0] + [children[q]], *groups[p][1:]))
        i, j = p + 1, q + 1
    return out


def merge(a: Node, b: Node) -> Node:
    """Alignment of the trees of two pages, or wrappers."""
    return _united([a, b], within=False)


def expression(root: Node) -> str:
    """The wrapper as a regular expression over labels; # is text, a slot or the template's."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        mark = "*" if n.optional and n.repeated else "?" if n.optional else "+" if n.repeated else ""
        parts: list = [x for c in ([*(["#"] if n.text else []), *n.children]) for x in (" ", c)][1:]
        if n.label:
            parts = [f"<{n.label}>", *parts, "</>"]
        todo.extend(reversed([f"(" if mark else "", *parts, f"){mark}" if mark else ""]))
    return "".join(out)


def template(root: Node) -> list[tuple[str, int]]:
    """Place (hash of its path of labels) and hash of every text that nearly all pages with the place have.

    Where a host has few pages, or nothing but such text, nothing counts as its template.
    """
    import xxhash

    found: list[tuple[str, int]] = []
    slots = 0
    for n, place in _places(root, xxhash):
        if n.noise:
            continue
        if n.value and root.pages >= LEAST_PAGES and 2 * n.pages >= root.pages and 100 * n.votes >= TEMPLATE_VOTES * n.pages:
            found.append((place, n.value))
        else:
            slots += n.text
    return found if slots else []


def _places(root: Node, xxhash) -> Iterator[tuple[Node, str]]:
    todo = [(root, "")]
    while todo:
        n, place = todo.pop()
        yield n, place
        todo.extend((c, xxhash.xxh3_64_hexdigest(f"{place} {c.label}")) for c in reversed(n.children) if not n.noise)


def _sizes(root: Node) -> dict[int, int]:
    """Characters outside links and noise, below each node."""
    sizes: dict[int, int] = {}
    for n in reversed(list(root.walk())):
        sizes[id(n)] = 0 if n.noise else max(0, n.text - n.links) + sum(sizes[id(c)] for c in n.children)
    return sizes


def main_path(root: Node) -> tuple[str, ...]:
    """Labels down to the element that holds the article; empty: the whole page."""
    sizes = _sizes(root)
    up: dict[int, Node] = {}
    named: list[tuple[Node, int]] = []
    todo = [root]
    while todo:
        n = todo.pop()
        if n.noise:
            continue
        parts = n.label.split(".")
        rank = 3 if parts[0] == "article" else 2 if parts[0] == "main" or "role-main" in parts else 1 if parts[0] in ("div", "section") and any(w.rstrip("0123456789") in MAIN_WORDS for w in parts[1:]) else 0
        if rank and sizes[id(n)]:
            named.append((n, rank))
        for c in reversed(n.children):
            up[id(c)] = n
            todo.append(c)

    def path(n: Node) -> tuple[str, ...]:
        out = []
        while n is not root:
            out.append(n.label)
            n = up[id(n)]
        return tuple(reversed(out))

    total = sizes[id(root)]
    for rank in (3, 2, 1):
        own = [x for x in named if x[1] == rank]
        if own:
            most = max(own, key=lambda x: sizes[id(x[0])])
            if 2 * sizes[id(most[0])] >= total:
                return path(most[0])
    if named:
        most = max(named, key=lambda x: (sizes[id(x[0])], -x[1]))
        if 2 * sizes[id(most[0])] >= total:
            return path(most[0])
    node = root
    while True:  # down while one child holds nearly all text
        best = max((c for c in node.children if not c.noise), key=lambda c: sizes[id(c)], default=None)
        if best is None or best.repeated or not best.children or 10 * sizes[id(best)] < 9 * sizes[id(node)] or not sizes[id(best)]:
            return path(node)
        node = best


def _inside(root: Node, path: tuple[str, ...], fixed: set) -> list[int]:
    """Blocks at path outside noise and the host's template, in page order."""
    import xxhash

    out: list[int] = []
    todo = [(root, 0, "")]
    while todo:
        n, depth, place = todo.pop()
        if n.noise:
            continue
        if depth == len(path) and (place, n.value) not in fixed:
            out += n.blocks
        for c in n.children:
            if depth == len(path) or c.label == path[depth]:
                todo.append((c, min(depth + 1, len(path)), xxhash.xxh3_64_hexdigest(f"{place} {c.label}") if fixed else ""))
    return sorted(out)


def article(page: str, path: tuple[str, ...], fixed: set = frozenset()) -> str:
    """The blocks at path that are neither noise nor the host's template.

    Where the page's own place of the article holds more than twice as much, that place counts instead.
    """
    tree, blocks = parse(page)
    picks = _inside(tree, path, fixed)
    own = main_path(tree)
    if own != path:
        others = _inside(tree, own, fixed)
        size = lambda k: sum(len(blocks[i]) for i in k)
        if size(others) > 2 * size(picks):
            picks = others
    return "\n\n".join(blocks[i] for i in picks)


def _host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON of the tree) from all pages (url, html).

    Pages of a host are merged within each task, the tasks' wrappers in up to 64 shares a host, and
    these last; so no task sees more of a host than its own rows, or one wrapper for each other task.
    """

    def fold_up(found: dict[str, Node], host: str, tree: Node) -> None:
        found[host] = merge(found[host], tree) if host in found else tree

    def rows(found: dict[str, Node], share: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([share] * len(found), pa.int64()), pa.array([json.dumps(t.dump(), separators=(",", ":")) for t in found.values()], pa.string())], ["host", "share", "wrapper"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, found = TaskContext.get().partitionId() % 64, {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fold_up(found, host, parse(page)[0])
            if len(found) > 5000:
                yield rows(found, share)
                found = {}
        yield rows(found, share)

    def join(key, t):
        found: dict[str, Node] = {}
        for w in sorted(t.column("wrapper").to_pylist()):
            fold_up(found, key[0].as_py(), Node.load(json.loads(w)))
        return pa.Table.from_batches([rows(found, 0)])

    kind = "host string, share long, wrapper string"
    source = pages.select(_host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    parts = source.mapInArrow(scan, kind).groupBy("host", "share").applyInArrow(join, kind)
    return parts.groupBy("host").applyInArrow(join, kind).select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null html is empty, null urls are one host. Text is blocks of the article, white space runs as
    one space, joined by an empty line. Repeated rows give repeated rows (and count as pages of their
    host), an empty table an empty result.
    """
    arrow_rows(pages.sparkSession)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [Node.load(json.loads(w)) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps([main_path(t), template(t)]) for t in trees], pa.string())], ["host", "path"])

    places = written(infer(pages).mapInArrow(choose, "host string, path string"), "places")
    few = (places.agg(F.sum(F.length("path") + F.length("host") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
    both = rows.join(F.broadcast(places) if few else places, "host", "left").select("page_id", "url", "html", "path")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = {p: json.loads(p or "[[], []]") for p in set(b.column(3).to_pylist())}
            read = {p: (tuple(x[0]), {tuple(y) for y in x[1]}) for p, x in read.items()}
            texts = [article(h, *read[p]) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema
    return both.mapInArrow(cut, f"page_id {kind['page_id'].dataType.simpleString()}, url {kind['url'].dataType.simpleString()}, text string, n_chars long")
