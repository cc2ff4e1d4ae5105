"""Main text of web pages by wrappers inferred for each host.

A page is parsed into a tree of block elements whose leaves are runs of text. Its union-free
expression comes from folding neighbours: siblings with one label, or short sequences of
labels that recur, become a repeated group whose members are aligned with each other. Two
expressions of a host are aligned the same way: labels in common order match, the others
become optional, and where texts of matched leaves differ a constant becomes a text slot.
Aligning is applied to expressions again and again, first inside a task, then by (host,
salt), then by host, so that all pages of a host take part and no task meets more than a
bounded number of expressions at a time.

A page is then read through its host's wrapper: text that is a constant of the template is
dropped where the rest of the wrapper has slots, and so are regions whose elements say what
they are (navigation, forms, adverts, comments and the like). What is left inside the
regions of the article is the main text.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import by_bytes, frugal, saved

#: Elements by their role in HTML.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style".split())
NO_TEXT = set("head title noscript template svg math iframe object canvas audio video select textarea button datalist nav footer aside form menu dialog".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table div section article body main".split())
#: Words in class, id or role that name a region which is not the article.
ASIDE = set(
    "ad ads adv advert adverts advertisement advertising banner promo promoted sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "sidebar aside widget footer foot masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments commentlist disqus reply replies respond related recommended recommendations teaser search toolbar skip copyright".split()
)
#: Words in class, id or role that name the article.
MAIN = set("main content article post entry story".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

CONSTANT_PAGES = 2  # pages with a text make it a constant of the template
SALTS = 32


class Region:
    """A part of a page that says it is the article: its tag, its node and the node it stands in."""

    __slots__ = ("node", "parent", "tag")

    def __init__(self, tag: str, node: Node, parent: Node):
        self.tag, self.node, self.parent = tag, node, parent


class Leaf:
    """A block of text: kept by its region or not, in which article, how much of it is links."""

    __slots__ = ("article", "linked", "parts", "text", "wanted")

    def __init__(self, wanted: bool, article: Region | None):
        self.wanted, self.article, self.parts, self.linked, self.text = wanted, article, [], 0, ""


class Node:
    """An element of a page or of an expression; label # is text.

    pages: how many pages have it; many: it is a repeated group; const: its text as made by
    `constant` while all are equal, else None.
    """

    __slots__ = ("const", "kids", "label", "leaves", "many", "pages")

    def __init__(self, label: str, pages: int = 1, many: bool = False, const: str | None = None, kids=None):
        self.label, self.pages, self.many, self.const, self.kids, self.leaves = label, pages, many, const, kids or [], []

    def preorder(self) -> list[Node]:
        """All nodes, parents before children, siblings in order. No recursion: pages nest as deep as they like."""
        out, left = [], [self]
        while left:
            node = left.pop()
            out.append(node)
            left += reversed(node.kids)
        return out

    def plain(self) -> list:
        """One row for each node in preorder, with its number of children."""
        return [[x.label, x.pages, int(x.many), x.const, len(x.kids)] for x in self.preorder()]

    @staticmethod
    def of(rows: list) -> Node:
        root, open_ = None, []
        for label, pages, many, const, kids in rows:
            node = Node(label, pages, bool(many), const)
            if root is None:
                root = node
            else:
                while not open_[-1][1]:
                    open_.pop()
                open_[-1][0].kids.append(node)
                open_[-1][1] -= 1
            open_.append([node, kids])
        return root


def parse(page: str) -> tuple[Node, list[Leaf]]:
    """Tree of block elements and its leaves in page order. Never fails, whatever the text holds."""
    root = Node("")
    stack: list[tuple[str, Node, bool, Region | None]] = [("", root, True, None)]  # (tag, node, wanted, article)
    leaves: list[Leaf] = []
    current: list[Leaf | None] = [None]
    links, at = 0, 0
    opened: dict[str, int] = {}  # elements on the stack by tag, so that nothing is sought in vain

    def text(raw: str) -> None:
        if not raw or (current[0] is None and raw.isspace()):
            return
        _, node, wanted, article = stack[-1]
        leaf = current[0]
        if leaf is None:
            leaf = current[0] = Leaf(wanted, article)
            leaves.append(leaf)
            kid = Node("#")
            kid.leaves.append(leaf)
            node.kids.append(kid)
        leaf.parts.append(raw)
        if links:
            leaf.linked += len(raw)

    def close(tags: set[str] | frozenset[str], within: set[str]) -> None:
        if tags.isdisjoint(opened):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                for other, *_ in stack[i:]:
                    opened[other] -= 1
                    if not opened[other]:
                        del opened[other]
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    for m in iter(lambda: _TOKEN.search(page, at), None):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in RAW:
            if not ends and not attrs.endswith("/"):
                end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            links = max(0, links + (-1 if ends else 1))
        if tag == "br":
            text(" ")
            continue
        if tag in INLINE:
            continue
        current[0], links = None, 0
        if ends:
            close({tag}, set())
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE - {"p"})
        if tag in CLOSED_BY_OWN_KIND:
            close(CLOSED_BY_OWN_KIND[tag], {"ul", "ol", "dl", "table"})
        names = " ".join(a or b or c for _, a, b, c in _NAMES.findall(attrs)) if attrs else ""
        words = set(_PARTS.findall(_CAMEL.sub(" ", names).lower())) if names else set()
        _, node, wanted, article = stack[-1]
        holds = tag in ("article", "main") or bool(words & MAIN)
        if tag not in ("html", "body"):
            wanted = wanted and tag not in NO_TEXT and (not words & ASIDE or tag in ("article", "main") and not words & {"comment", "reply", "teaser", "ad", "related"})
            wanted = wanted and not (tag == "header" and not article)
        kid = Node(label_of(tag, words))
        node.kids.append(kid)
        if wanted and holds and (tag in ("article", "main") or not article):
            article = Region(tag, kid, node)
        if not attrs.endswith("/"):
            opened[tag] = opened.get(tag, 0) + 1
            stack.append((tag, kid, wanted, article))
    text(page[at:])
    for leaf in leaves:
        leaf.text = " ".join(html.unescape("".join(leaf.parts)).split())
    return root, leaves


def constant(text: str) -> str:
    """Stands for the whole text: a long one by its begin, length and hash."""
    return text if len(text) <= 400 else f"{text[:400]}\n{len(text)} {hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def label_of(tag: str, words: set[str]) -> str:
    """An element's tag with all words of its names; very many by their hash."""
    names = "".join(f".{w}" for w in sorted(words))
    return tag + (names if len(names) <= 80 else f".{hashlib.blake2b(names.encode(), digest_size=12).hexdigest()}")


def fold(root: Node) -> Node:
    """Expression of a page: recurring neighbours become repeated groups, children before their parents."""
    for node in reversed(root.preorder()):
        if node.label == "#":
            node.const = constant(" ".join(x.text for x in node.leaves))
        elif len(node.kids) > 1:
            node.kids = folded(node.kids)
    return root


_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def folded(kids: list[Node]) -> list[Node]:
    """Siblings with sequences of labels that follow themselves joined, whatever their length.

    A sequence that ends with a new sibling is sought at the places where the last two labels
    stood before, by hashes of label sequences.
    """
    if len({k.label for k in kids}) == len(kids):
        return kids
    out: list[Node] = []
    sums = [0]  # hash of the labels up to each place
    pairs: dict[tuple[str, str], list[int]] = {}

    def same(u: int) -> bool:
        n = len(out)
        power = pow(_BASE, u, _PRIME)
        one, two = ((sums[j] - sums[j - u] * power) % _PRIME for j in (n, n - u))
        return one == two and all(out[n - u + i].label == out[n - 2 * u + i].label for i in range(u))

    for kid in kids:
        out.append(kid)
        sums.append((sums[-1] * _BASE + hash(kid.label)) % _PRIME)
        n, unit = len(out), 0
        if n > 1:
            at = pairs.setdefault((out[-2].label, kid.label), [])
            if out[-2].label == kid.label:
                unit = 1
            else:
                for place in reversed(at):
                    u = n - 1 - place
                    if 2 * u > n:
                        break
                    if same(u):
                        unit = u
                        break
            at.append(n - 1)
        if unit:
            tail = out[n - unit :]
            for i in range(n - unit, n):
                pairs[out[i - 1].label, out[i].label].pop()
            del out[n - unit :], sums[n - unit + 1 :]
            for i, extra in enumerate(tail):
                out[n - 2 * unit + i] = align(out[n - 2 * unit + i], extra, True)
    return out


def _matches(a: list[Node], b: list[Node]) -> Iterator[tuple[Node | None, Node | None]]:
    """Children of two nodes side by side, in order; a lone one has no partner.

    What begins and ends alike is matched first, then labels that each side has once, in
    their longest common order; between these a label meets the next like it. The time is
    n log n, however many unlike siblings there are.
    """
    one, two = [k.label for k in a], [k.label for k in b]
    if one == two:
        yield from zip(a, b, strict=True)
        return
    i, j = 0, 0
    for x, y in _common(one, two):
        yield from ((k, None) for k in a[i:x])
        yield from ((None, k) for k in b[j:y])
        yield a[x], b[y]
        i, j = x + 1, y + 1
    yield from ((k, None) for k in a[i:])
    yield from ((None, k) for k in b[j:])


def _common(one: list[str], two: list[str]) -> list[tuple[int, int]]:
    """Places of equal labels, rising on both sides."""
    head = 0
    while head < min(len(one), len(two)) and one[head] == two[head]:
        head += 1
    tail = 0
    while tail < min(len(one), len(two)) - head and one[-1 - tail] == two[-1 - tail]:
        tail += 1
    out = [(k, k) for k in range(head)]
    end_one, end_two = len(one) - tail, len(two) - tail
    n_one, n_two = Counter(one[head:end_one]), Counter(two[head:end_two])
    where = {x: j for j, x in enumerate(two[head:end_two], head) if n_two[x] == 1}
    pairs = [(i, where[x]) for i, x in enumerate(one[head:end_one], head) if n_one[x] == 1 and x in where]
    anchors = [*_rising(pairs), (end_one, end_two)]
    i, j = head, head
    places: dict[str, list[int]] = {}
    for k, x in enumerate(two[head:end_two], head):
        places.setdefault(x, []).append(k)
    for x, y in anchors:
        while i < x:  # a label between anchors meets the next like it
            at = places.get(one[i], [])
            k = bisect_left(at, j)
            if k < len(at) and at[k] < y:
                out.append((i, at[k]))
                j = at[k] + 1
            i += 1
        if x < end_one:
            out.append((x, y))
        i, j = x + 1, y + 1
    return out + [(end_one + k, end_two + k) for k in range(tail)]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of the pairs, which rise on the first side, that rises on the second."""
    ends: list[int] = []
    held: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(ends, y)
        before.append(held[at - 1] if at else -1)
        if at == len(ends):
            ends.append(y)
            held.append(k)
        else:
            ends[at], held[at] = y, k
    out, k = [], held[-1] if held else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: Node, b: Node, one_page: bool = False) -> Node:
    """Union-free expression of two nodes with one label. one_page: both are parts of one page."""

    def joined(x: Node, y: Node) -> Node:
        out = Node(x.label, max(x.pages, y.pages) if one_page else x.pages + y.pages, x.many or y.many or one_page)
        if x.label == "#":
            out.const = x.const if x.const == y.const else None
            out.leaves = x.leaves + y.leaves
        return out

    root = joined(a, b)
    left = [(a, b, root)]
    while left:
        x, y, out = left.pop()
        for p, q in _matches(x.kids, y.kids):
            if p is None or q is None:
                out.kids.append(p or q)
            else:
                out.kids.append(joined(p, q))
                left.append((p, q, out.kids[-1]))
    return root


def template_leaves(page: Node, wrapper: Node) -> tuple[set[int], set[int]]:
    """What the wrapper says of a page: id() of leaves that are template, and of nodes in repeated groups.

    A leaf is template if its own whole text is a constant of the wrapper, a text that at
    least two pages have, and half of the host's, where the wrapper has slots to compare with.
    """
    found: set[int] = set()
    repeated: set[int] = set()
    slots = 0
    left = [(page, wrapper)]
    while left:
        p, w = left.pop()
        if w.many:
            repeated.add(id(p))
        if p.label == "#":
            if w.const is None:
                slots += any(x.wanted for x in p.leaves)
            elif w.pages >= CONSTANT_PAGES and 2 * w.pages >= wrapper.pages:
                found.update(id(x) for x in p.leaves if constant(x.text) == w.const)
            continue
        left += [(x, y) for x, y in _matches(p.kids, w.kids) if x is not None and y is not None]
    return found if slots else set(), repeated


def _linked(leaves: list[Leaf]) -> bool:
    """Whether most of a text is links."""
    return 2 * sum(x.linked for x in leaves) > sum(sum(map(len, x.parts)) for x in leaves)


def article_regions(regions: dict[Region, list[Leaf]], best: Region, repeated: set[int]) -> set[Region]:
    """Regions of the article: the largest and all others that are no teasers.

    A teaser is one of several regions of a kind side by side, on this page or in a repeated
    group of the host's wrapper, with a line that is a link, its title. Where the largest is
    one of several itself, the page is a list and all of them stay.
    """
    kinds = Counter((r.tag, id(r.parent)) for r in regions)
    titled = {r for r, leaves in regions.items() if any(_linked([x]) for x in leaves)}
    teasers = {r for r in titled if kinds[r.tag, id(r.parent)] > 1}
    if best in teasers:
        return set(regions)
    return set(regions) - teasers - {r for r in titled if id(r.node) in repeated and r is not best}


def main_text(page: str, wrapper: Node | None) -> str:
    root, leaves = parse(page)
    dropped, repeated = template_leaves(fold(root), wrapper) if wrapper is not None else (set(), set())
    left = [x for x in leaves if x.wanted and x.text and id(x) not in dropped]
    regions: dict[Region, list[Leaf]] = {}
    for x in left:
        if x.article is not None:
            regions.setdefault(x.article, []).append(x)
    if regions:
        best = max(regions, key=lambda r: sum(len(x.text) for x in regions[r]))
        kept = article_regions(regions, best, repeated)
        # outside the largest region and those of its kind lists of links go
        left = [x for x in left if x.article in kept and ((x.article.tag, x.article.parent) == (best.tag, best.parent) or not _linked([x]))]
    else:  # no article is marked: lists of links go
        left = [x for x in left if not _linked([x])]
    return "\n".join(x.text for x in left)


def _merged(batches: Iterator[pa.RecordBatch], read) -> Iterator[pa.RecordBatch]:
    """Expressions by key (first column) from what `read` makes of the second: one each if rows come sorted by key."""
    held: dict = {}

    def flush(last: str | None):
        keys = [k for k in held if k != last]
        out = [json.dumps(held.pop(k).plain(), ensure_ascii=False) for k in keys]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], ["host", "wrapper"])

    for b in batches:
        for key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            new = read(value)
            held[key] = align(held[key], new) if key in held else new
        if len(held) > 2000:
            yield flush(key)
    if held:
        yield flush(None)


def _from_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _merged(by_bytes(batches, "html"), lambda page: fold(parse(page or "")[0]))


def _from_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _merged(batches, lambda x: Node.of(json.loads(x)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Node] = {}
    for b in by_bytes(batches, "html"):
        out = []
        for page, wrapper in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if len(known) > 500:
                known.clear()
            if wrapper is not None and wrapper not in known:
                known[wrapper] = Node.of(json.loads(wrapper))
            out.append(main_text(page or "", known[wrapper] if wrapper is not None else None))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def host_of(url):
    """Host of a url column in lower case; null without one."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): the expression of all pages of every host."""
    by_host = pages.select(host_of(F.col("url")).alias("host"), "html").where("host is not null and html is not null")
    made = saved(by_host.mapInArrow(frugal(_from_pages), "host string, wrapper string"))
    kind = "host string, wrapper string"
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))
    salted = made.repartition("host", salt).sortWithinPartitions("host").mapInArrow(frugal(_from_wrappers), kind)
    # by now a host has at most as many expressions as there are salts
    return saved(salted.repartition("host").sortWithinPartitions("host").mapInArrow(frugal(_from_wrappers), kind))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    text holds the article's blocks in page order, joined by line feeds, with character
    references decoded and white space inside a block made one space. A null or empty html
    gives an empty text; a page with a null url or a url without a host is read without a
    wrapper, by its own elements. Repeated rows are read alike. Further columns are ignored;
    an empty table gives an empty result.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    return (
        src.join(wrappers(pages), "host", "left").select("page_id", "url", "html", "wrapper")
        .mapInArrow(frugal(_extract), "page_id long, url string, text string, n_chars long")
    )
