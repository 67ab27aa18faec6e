"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page's token stream is read as nested elements. Adjacent repeats of elements fall together into repeated groups; the
rest is its structure. The structures of a host are aligned one after another, level by level: what only one side has
becomes an optional group, adjacent repeats that arise become repeated groups, texts become slots. The result is the
host's wrapper. Wrappers of a host's structures are made in groups of FAN and merged in further rounds, so a host of
any number of pages is never gathered; within a group the order is that of the structures' hashes, so that the wrapper
depends on the pages alone.

Every page is then matched with its host's wrapper, which places each of its texts at a node. Over all pages a text
that most pages with the node share is a constant of the template; other texts fill the node as a slot. The article is
the region that holds the most of varying text: from the root the way leads to the element that holds more than MOST of
it, and ends where none does or where an article begins. The page's texts in that region, less the constants, are its text.

Elements that HTML itself sets apart (nav, footer, form, ...) are left out, and within the region those whose class
names say nothing else than advert, comment, notice and the like. Pages without other pages of their host are read by
their own masses of text; there container elements decide where masses don't.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsida.llm.common import materialize
from subsida.llm.url_filter import host_of

#: A text is the template's if it stands on so many different pages of a host, and on such a share of those that have its node.
LEAST, SHARE = 3, 0.8
#: Share of the varying text that leads on to an element, and share that a container needs where masses don't decide.
MOST, ENOUGH = 0.6, 0.3
#: Longest period of a repeated group, in elements.
PERIOD = 8
#: Structures that are aligned in one group.
FAN = 64
#: Elements of a level beyond which its order is given up: elements of a name become one repeated group.
WIDTH = 64
#: Depth below which elements are no more told apart.
DEPTH = 48

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|textarea|title|iframe|noscript|template|svg|xmp|noembed)\b(?:[^>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*?>.*?(?:</\1\s*>|\Z)"
    r"|<[a-zA-Z/!?](?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*>",
    re.S | re.I,
)
NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend "
    "li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul br".split()
)
CLOSES_P = BLOCK - {"br", "html", "body", "head", "td", "th", "tr", "li", "option", "optgroup"}
CLOSED_BY_OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("table ul ol dl div article section main body html aside nav header footer form td th blockquote select".split())
#: Elements that hold other elements; the other blocks hold running text.
FRAMES = frozenset("html body div section article main center form fieldset table tbody thead tfoot tr td th ul ol dl nav aside header footer figure details menu dir blockquote dialog select".split())
GENERIC = frozenset("div section ul ol table".split())

#: Elements and roles that are set apart from the article.
OUT_TAGS = frozenset("nav footer aside header head select button dialog menu object audio video canvas map datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: A class or id sets an element apart if all its words are of these two lists and one at least of the first.
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert nav navbar navigation breadcrumb breadcrumbs menu sidebar footer masthead "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe subscription popup modal overlay widget pagination pager login signup toolbar skip".split()
)
PLAIN_WORDS = frozenset(
    "a all aside area bar block bottom box btn button buttons card cards col column container content form global group header heading icons id inner item items js left level line link links list main message "
    "module more nd no of outer page pane panel policy post posts primary right row secondary section site slot small sticky text title to top unit user users view wrap wrapper".split()
)
SOFT_WORDS = frozenset("header sidebar menu banner widget overlay".split())  # also wrap whole pages; an article inside counts
ARTICLE_WORDS = frozenset("comment comments reply replies respond related recommended".split())  # all that sets apart an <article>
#: Containers of an article, best first.
CONTAINERS = ("article", "main", "role-main", "content")
CONTENT_WORDS = frozenset("article-body articlebody article-content post-content post-body entry-content main-content page-content story-body content article post".split())


# --- pages as elements -------------------------------------------------------


class Element:
    __slots__ = ("name", "names", "hard", "soft", "inside", "owner", "kids", "depth")

    def __init__(self, name, names=(), parent=None, hard=False, soft=False, kind=None, own=True):
        self.name, self.names, self.kids = name, names, []
        self.hard = hard or parent is not None and parent.hard
        self.soft = soft or parent is not None and parent.soft and not (kind and not soft)
        self.inside = parent.inside | {kind} if kind else parent.inside if parent else frozenset()
        self.depth = parent.depth + 1 if parent else 0
        self.owner = self if own and self.depth <= DEPTH else parent.owner
        if self.owner is self and parent is not None:
            parent.owner.kids.append(self)

    @property
    def out(self) -> bool:
        return self.hard or self.soft


def says_out(name: str) -> set[str]:
    """The words by which a class or id sets its element apart; none if it says anything else."""
    words = {w for w in re.split(r"[_\-\d]+", name) if w}
    return words & OUT_WORDS if words <= OUT_WORDS | PLAIN_WORDS else set()


@lru_cache(maxsize=1 << 14)
def role(name: str, tag: str) -> tuple[tuple[str, ...], bool, bool, str | None]:
    """Of a start tag: its class names, whether it is set apart, whether only softly, and the container it is."""
    found = {a.lower(): html.unescape(b or c or d) for a, b, c, d in ATTRIBUTE.findall(tag)} if "=" in tag else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    words = set().union(*map(says_out, names)) if names and name not in ("html", "body") else set()
    if name in ("article", "main"):
        words &= ARTICLE_WORDS
    its_role = found.get("role", "").lower()
    soft = name == "form" or bool(words & SOFT_WORDS)
    hard = name in OUT_TAGS or its_role in OUT_ROLES or bool(words - SOFT_WORDS)
    content = name in ("div", "section", "td") and not CONTENT_WORDS.isdisjoint(names)
    kind = None if hard else name if name in ("article", "main") else "role-main" if its_role == "main" else "content" if content else None
    shown = tuple(sorted({re.sub(r"\d{2,}", "#", n) for n in names})) if name in FRAMES and name not in ("html", "body") else ()
    return shown, hard, soft and not hard, kind


class Page:
    """The blocks of a page: their texts, elements, and the tree of elements."""

    def __init__(self, page: str, keep_out: bool = False):
        self.root = Element("")
        self.texts: list[str] = []
        self.elements: list[Element] = []
        self.opened: set[str] = set()
        self.others: list[str] = []  # texts set apart, for infer() only
        stack, at = [self.root], 0
        held: dict[bool, list[str]] = {False: [], True: []}
        first: dict[bool, Element | None] = {False: None, True: None}

        def flush():
            for out in (False, True):
                if first[out] is not None:
                    text = " ".join("".join(held[out]).split())
                    if text and not out:
                        first[out].owner.kids.append(len(self.texts))
                        self.texts.append(text)
                        self.elements.append(first[out])
                    elif text:
                        first[out].owner.kids.append(-1 - len(self.others))
                        self.others.append(text if keep_out else "")
                    held[out], first[out] = [], None

        def say(text):
            element = stack[-1]
            out = element.hard or element.soft
            if first[out] is None:
                if text.isspace():
                    return
                first[out] = element
            elif first[out].owner is not element.owner and not text.isspace():  # one block over several elements: each has a text
                element.owner.kids.append(-1 - len(self.others))
                self.others.append(text if keep_out else "")
            held[out].append(html.unescape(text) if "&" in text else text)

        for m in TOKEN.finditer(page):
            if m.start() > at:
                say(page[at : m.start()])
            at = m.end()
            if m.group(1):  # raw text: its content is no text of the page
                continue
            tag = m.group()
            name = NAME.match(tag)
            if not name:
                continue
            name = name.group(1).lower()
            if name in BLOCK:
                flush()
            if tag[1] == "/":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
                    if stack[i].name in SCOPES and name not in SCOPES:
                        break
                continue
            closed = CLOSED_BY_OWN_KIND.get(name, {"p"} if name in CLOSES_P else None)
            if closed:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in closed:
                        del stack[i:]
                        if name != "tr":
                            break
                    elif stack[i].name in SCOPES and not (name == "tr" and stack[i].name in closed):
                        break
            if name in VOID or tag.endswith("/>") and name not in BLOCK:
                continue
            names, hard, soft, kind = role(name, tag)
            top = stack[-1]
            element = Element(name, names, top, hard, soft, kind, name in BLOCK or name == "a" and top.name in FRAMES)
            if kind and not element.out:
                self.opened.add(kind)
            stack.append(element)
        if at < len(page):
            say(page[at:])
        flush()


# --- wrappers: structures and their alignment ----------------------------------


class Node:
    """A part of a wrapper: an element, a text "#" or a group "()" of parts, once, optional or repeated.

    `at` holds what stands here: of a page its blocks, of a structure to be matched its nodes. `of` is the node's number in a wrapper.
    """

    __slots__ = ("name", "names", "optional", "repeated", "loose", "kids", "at", "of", "text")

    def __init__(self, name, names=(), optional=False, repeated=False, loose=False, kids=(), at=(), of=None, text=None):
        self.name, self.names, self.optional, self.repeated, self.loose = name, names, optional, repeated, loose
        self.kids, self.at, self.of, self.text = list(kids), list(at), of, text

    @property
    def kind(self):
        return (self.name, self.names) if self.name != "()" else ("()", tuple(k.kind for k in self.kids))

    def walk(self) -> Iterator[Node]:
        yield self
        for k in self.kids:
            yield from k.walk()

    def pack(self) -> list:
        return [self.name, self.names, self.optional + 2 * self.repeated + 4 * self.loose, [k.pack() for k in self.kids]]


def unpack(packed: list) -> Node:
    name, names, flags, kids = packed
    return Node(name, tuple(names), bool(flags & 1), bool(flags & 2), bool(flags & 4), map(unpack, kids))


def merged(a: Node, b: Node, side_by_side: bool = False) -> Node:
    """One node for two of a name. Side by side they stand in one page and make a repeated group; else they stand for each other."""
    a.names = a.names if a.names == b.names else tuple(n for n in a.names if n in b.names)
    a.optional = (a.optional and b.optional) if side_by_side else (a.optional or b.optional)
    a.repeated = side_by_side or a.repeated or b.repeated
    a.text = a.text if a.text == b.text else None
    a.at += b.at
    a.of = a.of if b.of is None else b.of if a.of is None else min(a.of, b.of)
    if a.kids or b.kids:
        a.kids, a.loose = aligned(a.kids, b.kids, a.loose or b.loose)
    return a


def folded(kids: list[Node]) -> list[Node]:
    """Adjacent repeats, of one node or of up to PERIOD nodes, become a repeated node or group."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].kind == k.kind:
            merged(out[-1], k, True)
        else:
            out.append(k)
    for p in range(2, PERIOD + 1):
        if len(out) < 2 * p:
            break
        kinds, done, i = [k.kind for k in out], [], 0
        while i < len(out):
            n = 1
            while kinds[i : i + p] == kinds[i + n * p : i + (n + 1) * p] and i + (n + 1) * p <= len(out):
                n += 1
            if n > 1:
                body = out[i : i + p]
                for j in range(1, n):
                    body = [merged(x, y) for x, y in zip(body, out[i + j * p : i + (j + 1) * p])]
                done.append(Node("()", repeated=True, kids=body))
                i += n * p
            else:
                done.append(out[i])
                i += 1
        out = done
    return out


def regrouped(kids: list[Node], groups: Iterable[Node]) -> list[Node]:
    """kids with every run that has the kinds of one of the groups made such a group."""
    for g in groups:
        want, p, out, i = [k.kind for k in g.kids], len(g.kids), [], 0
        if any(k.kind == g.kind for k in kids):
            continue
        while i < len(kids):
            if [k.kind for k in kids[i : i + p]] == want:
                out.append(Node("()", kids=kids[i : i + p]))
                i += p
            else:
                out.append(kids[i])
                i += 1
        kids = out
    return kids


def alike(x: Node, y: Node) -> bool:
    """Whether two nodes in a gap of the alignment are one element under different names."""
    if x.name != y.name or x.name in ("#", "()"):
        return x.kind == y.kind
    return not set(x.names).isdisjoint(y.names) or x.name not in GENERIC


def aligned(xs: list[Node], ys: list[Node], loose: bool = False) -> tuple[list[Node], bool]:
    """One level for two: what both have is merged, the rest is optional; a level that gets too wide gives up its order."""
    if not loose:
        if [x.kind for x in xs] == [y.kind for y in ys]:
            return [merged(x, y) for x, y in zip(xs, ys)], False
        xs, ys = regrouped(xs, [y for y in ys if y.name == "()"]), regrouped(ys, [x for x in xs if x.name == "()"])
        out, i, j = [], 0, 0
        for m in SequenceMatcher(None, [x.kind for x in xs], [y.kind for y in ys], autojunk=False).get_matching_blocks():
            left = xs[i : m.a]
            for y in ys[j : m.b]:
                n = next((n for n, x in enumerate(left) if alike(x, y)), None)
                if n is None:
                    y.optional = True
                    out.append(y)
                else:
                    for x in left[:n]:
                        x.optional = True
                    out += [*left[:n], merged(left[n], y)]
                    left = left[n + 1 :]
            for x in left:
                x.optional = True
            out += left
            out += [merged(x, y) for x, y in zip(xs[m.a : m.a + m.size], ys[m.b : m.b + m.size])]
            i, j = m.a + m.size, m.b + m.size
        out = folded(out)
        if len(out) <= WIDTH:
            return out, False
        xs, ys = out, []
    one: dict[str, Node] = {}
    for k in (k for x in [*xs, *ys] for k in (x.kids if x.name == "()" else [x])):
        if k.name in one:
            merged(one[k.name], k, True)
        else:
            k.optional = True
            one[k.name] = k
    return list(one.values()), True


def structure(page: Page, with_texts: bool = False) -> Node:
    """The page's structure: its elements with repeats folded; texts' nodes hold the numbers of their blocks."""

    def build(element: Element) -> Node:
        kids = []
        for k in element.kids:
            if isinstance(k, Element):
                kids.append(build(k))
            else:
                text = (page.texts[k] if k >= 0 else page.others[-1 - k]) if with_texts else None
                kids.append(Node("#", at=[k] if k >= 0 else [], text=text))
        return Node(element.name, element.names, kids=folded(kids))

    return build(page.root)


def infer(pages: Iterable[str]) -> Node:
    """The wrapper of same-host pages, with the texts that are the same on all of them."""
    wrapper: Node | None = None
    for page in pages:
        own = structure(Page(page, True), True)
        wrapper = own if wrapper is None else merged(wrapper, own)
    return wrapper or Node("")


def as_regex(node: Node) -> str:
    """The wrapper as text: <tag>, "text", # for a slot, (...)+, (...)? and (...)*."""
    inner = "".join(map(as_regex, node.kids))
    if node.name == "#":
        shown = "#" if node.text is None else json.dumps(node.text, ensure_ascii=False)
    else:
        shown = inner if node.name in ("", "()") else f"<{'.'.join([node.name, *node.names])}>{inner}</{node.name}>"
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[node.optional, node.repeated]
    return f"({shown}){mark}" if mark else shown


def places(wrapper: Node, own: Node) -> dict[int, int]:
    """The wrapper's node of each node of a structure, both by their number in reading order."""
    for n, node in enumerate(wrapper.walk()):
        node.of = n
    for n, node in enumerate(own.walk()):
        node.at, node.of = [n], None
    return {n: node.of for node in merged(wrapper, own).walk() for n in node.at if node.of is not None}


# --- regions -------------------------------------------------------------------


def region(root: Node, mass: dict[int, float], chars: dict[int, float]) -> tuple[set[int], bool]:
    """The texts' nodes of the article, by number, and whether masses led to one element.

    `mass` holds the varying text of the texts' nodes, `chars` all their text (which counts if none varies). A heading h1
    of varying text that stands beside the way belongs to the article.
    """
    if not sum(mass.values()):
        mass = chars
    number = {id(node): n for n, node in enumerate(root.walk())}
    total: dict[int, float] = {}

    def weigh(node) -> float:
        total[id(node)] = mass.get(number[id(node)], 0.0) + sum(map(weigh, node.kids))
        return total[id(node)]

    weigh(root)
    node, chosen, led = root, [], False
    while True:
        frames = [k for g in node.kids for k in (g.kids if g.name == "()" else [g]) if k.name in FRAMES]
        best = max(frames, key=lambda k: total[id(k)], default=None)
        if best is None or total[id(best)] <= MOST * total[id(node)] or not total[id(node)]:
            break
        final = best.name == "article" or not CONTENT_WORDS.isdisjoint(best.names)
        if best.repeated and not final or node.name == "main" and not final:
            break
        chosen += [k for k in node.kids if k.name == "h1" and total[id(k)]]
        node, led = best, True
        if final:
            break
    return {number[id(k)] for top in [*chosen, node] for k in top.walk() if k.name == "#"}, led


def of_its_own(page: Page, root: Node) -> set[int]:
    """The blocks of the article of a page that is read without a wrapper."""
    if not any(e.inside for e in page.elements) and page.opened & {"article", "main"}:
        return set()  # the page's article has no text
    leaves = {n: node.at for n, node in enumerate(root.walk()) if node.at}
    chars = {n: float(sum(len(page.texts[b]) for b in at)) for n, at in leaves.items()}
    nodes, led = region(root, chars, chars)
    found = {b for n in nodes for b in leaves.get(n, ())}
    size = sum(len(page.texts[b]) for b in found)
    held = {c: sum(len(page.texts[b]) for b in found if c in page.elements[b].inside) for c in CONTAINERS}
    most = max(held.values())
    if most < ENOUGH * size:
        return found
    kind = next(c for c in CONTAINERS if held[c] >= MOST * most)
    return {b for b in found if kind in page.elements[b].inside}


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


class Wrapper:
    """A host's wrapper with the varying and all text of its nodes, and its constants: certain, and those of two pages only."""

    def __init__(self, packed: str, nodes: Iterable[tuple[int, float, float]], constants: Iterable[tuple[int, int, bool]]):
        self.packed, self.known = json.loads(packed), {}
        self.mass, self.chars = {}, {}
        for p, mass, chars in nodes:
            self.mass[p], self.chars[p] = mass, chars
        self.fixed: dict[bool, set] = {False: set(), True: set()}
        for p, t, weak in constants:
            self.fixed[weak].add((p, t))

    def plan(self, root: Node) -> tuple[dict[int, int], set[int]]:
        """The wrapper's nodes of a structure's nodes, and those of its texts' nodes that are in the region; by structure."""
        packed = json.dumps(root.pack())
        if packed not in self.known:
            if len(self.known) >= 1000:
                self.known.clear()
            to = places(unpack(self.packed), unpack(json.loads(packed)))
            leaves = [n for n, node in enumerate(root.walk()) if node.name == "#"]
            chars = {n: self.chars.get(to.get(n), 0.0) for n in leaves}
            self.known[packed] = to, region(root, {n: self.mass.get(to.get(n), 0.0) for n in leaves}, chars)[0]
        return self.known[packed]

    def blocks(self, page: Page, root: Node) -> set[int]:
        to, within = self.plan(root)
        found = {b: (to.get(n), _hash(page.texts[b])) for n, node in enumerate(root.walk()) if n in within for b in node.at}
        kept = {b for b, spot in found.items() if spot not in self.fixed[False]}
        sure = {b for b in kept if found[b] not in self.fixed[True]}
        size = lambda s: sum(len(page.texts[b]) for b in s)
        return sure if 2 * size(sure) > size(kept) else kept  # two pages that share most of their text are copies


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of a page; empty for null, empty or text-free pages."""
    if not page:
        return ""
    read = Page(page)
    root = structure(read)
    found = wrapper.blocks(read, root) if wrapper else of_its_own(read, root)
    return " ".join(read.texts[b] for b in sorted(found))


# --- over all pages ------------------------------------------------------------


def structures(pages: DataFrame, url_col="url", html_col="html") -> DataFrame:
    """(host, page, sid, structure, spots) of every page with a host: spots are its different (node, text hash, characters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = pa.list_(pa.struct([("p", pa.int32()), ("t", pa.int64()), ("n", pa.int64())]))
        for b in batches:
            rows = []
            for value in b.column(1):
                page = Page(value.as_py())
                root = structure(page)
                packed = json.dumps(root.pack())
                spots: dict[tuple[int, int], int] = defaultdict(int)
                for n, node in enumerate(root.walk()):
                    for block in node.at:
                        spots[n, _hash(page.texts[block])] += len(page.texts[block])
                own = [{"p": p, "t": t, "n": c} for (p, t), c in spots.items()]
                rows.append((_hash(packed + repr(sorted(spots.items()))), _hash(packed), packed, own))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], spot)], names=["host", "page", "sid", "structure", "spots"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).where("host <> '' and html <> ''")
    return rows.mapInArrow(run, "host string, page long, sid long, structure string, spots array<struct<p: int, t: long, n: long>>")


def infer_wrappers(found: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper) of (host, sid, structure): alignments in groups of about `fan`, in rounds until each host has one."""

    def align_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["sid", "structure"])
        wrapper: Node | None = None
        for packed in group["structure"]:
            own = unpack(json.loads(packed))
            wrapper = own if wrapper is None else merged(wrapper, own)
        return pd.DataFrame({"host": [key[0]], "sid": [int(group["sid"].iloc[0])], "structure": [json.dumps(wrapper.pack())]})

    parts, turn = found, 0
    while True:
        sizes = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if turn and (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            return parts.select("host", F.col("structure").alias("wrapper"))
        dealt = parts.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "sid"), F.ceil(F.col("n") / fan)))
        parts = materialize(dealt.select("host", "part", "sid", "structure").groupBy("host", "part").applyInPandas(align_group, "host string, sid long, structure string"), "wrappers")
        turn += 1


def _placed(found: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, sid, to): the wrapper's node of each node of a structure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for packed, wrapper in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                own = unpack(json.loads(packed))
                n, to = sum(1 for _ in own.walk()), places(unpack(json.loads(wrapper)), own)
                out.append([to.get(k) for k in range(n)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["host", "sid", "to"])

    return found.join(wrappers, "host").select("host", "sid", "structure", "wrapper").mapInArrow(run, "host string, sid long, to array<int>")


def wrappers_of(pages: DataFrame, url_col="url", html_col="html", share: float = SHARE) -> DataFrame:
    """(host, wrapper, nodes, constants) of every host with two different pages or more; equal pages of a host count once.

    A text is a constant at its node if it stands on LEAST pages at least and on `share` of the pages that have the node:
    a part that only some pages have, or a second layout, is judged by its own pages. A text of both of two pages is a
    weak constant. All counts are sums that combine before the shuffle.
    """
    read = materialize(structures(pages, url_col, html_col), "structures")
    once = read.groupBy("host", "page").agg(F.first("sid").alias("sid"), F.first("spots").alias("spots"))
    several = read.groupBy("host").agg((F.min("page") < F.max("page")).alias("several")).where("several").select("host")
    found = materialize(read.groupBy("host", "sid").agg(F.first("structure").alias("structure")).join(several, "host", "left_semi"), "host-structures")
    wrappers = infer_wrappers(found)
    to = materialize(_placed(found, wrappers), "places")
    spots = F.array_distinct(F.transform("spots", lambda s: F.struct(F.get("to", s["p"]).alias("p"), s["t"].alias("t"), s["n"].alias("n"))))
    spots = F.filter(spots, lambda s: s["p"].isNotNull())
    node = lambda s: F.aggregate(F.filter("spots", lambda x: x["p"] == s), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    whole = F.transform(F.array_distinct(F.col("spots.p")), lambda p: F.struct(p.alias("p"), F.lit(None).cast("long").alias("t"), node(p).alias("n")))
    entries = once.join(to, ["host", "sid"]).select("host", spots.alias("spots")).select("host", F.inline(F.concat("spots", whole)))
    counts = entries.groupBy("host", "p", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"))
    counts = materialize(counts.where("n > 1 or t is null"), "spots")
    have = counts.where("t is null").select("host", "p", F.col("n").alias("of"), F.col("chars").alias("all"))
    sure = (F.col("n") >= LEAST) & (F.col("n") >= F.lit(share) * F.col("of"))
    constants = counts.where("t is not null").join(have, ["host", "p"]).where(sure | (F.col("of") == 2)).select("host", "p", "t", "chars", (~sure).alias("weak"))
    gone = constants.groupBy("host", "p").agg(F.sum("chars").alias("gone"))
    nodes = have.join(gone, ["host", "p"], "left").select("host", F.struct("p", ((F.col("all") - F.coalesce("gone", F.lit(0))) / F.col("of")).alias("mass"), (F.col("all") / F.col("of")).alias("chars")).alias("node"))
    nodes = nodes.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # as many as the wrapper has
    constants = constants.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("p", "t", "weak"))).alias("constants"))
    return wrappers.join(nodes, "host", "left").join(constants, "host", "left")


def extract_pages(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; rows are returned as often as they occur.

    Null and empty html have an empty text. Pages without a host, and the only page of a host, are read without a wrapper.
    Wrappers meet their pages in a join that Spark broadcasts only while the wrappers are small.
    """
    wrappers = materialize(wrappers_of(pages, url_col, html_col, share).withColumnRenamed("host", "__host"), "host-wrappers")  # of known size
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    joined = rows.join(wrappers, F.col("host") == F.col("__host"), "left").select("page_id", "url", "html", "host", "wrapper", "nodes", "constants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, Wrapper] = {}
        for b in batches:
            out = []
            for i, (page, host) in enumerate(zip(b.column(2), b.column(3).to_pylist())):
                if host not in read and b.column(4)[i].is_valid:
                    if len(read) >= 1000:
                        read.clear()
                    nodes, constants = b.column(5)[i].as_py() or (), b.column(6)[i].as_py() or ()
                    read[host] = Wrapper(b.column(4)[i].as_py(), [(x["p"], x["mass"], x["chars"]) for x in nodes], [(x["p"], x["t"], x["weak"]) for x in constants])
                out.append(extract(page.as_py(), read.get(host)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")


def op10_html_extract(pages: DataFrame) -> DataFrame:
    return extract_pages(pages.select("page_id", "url", "html"))
