"""Operator 10, HTML extraction by union-free regular-expression inference.

A page becomes a tree of elements and text slots. Siblings that repeat become one repeated group, and a run of flow content
(paragraphs, headings, lists, bare text) a repeated group of optional members. The trees of one host are then aligned, one after
another: what both have is merged, what only one has becomes optional. The result is the host's wrapper, a regular expression
without unions, whose text slots are numbered. Each page is matched with its host's wrapper, which decides first:

- a text that stands in the same slot on every page of the host is the host's own and goes, wherever it stands;
- of the wrapper's containers, the smallest that holds nearly all of the host's text is the region of the article; other slots go.

The roles of elements (menus, adverts, articles by tag and class) decide among what is left, on hosts with fewer than
``LEAST_PAGES`` different pages alone. Only the distinct trees of a host are folded, in groups dealt by their hash, then the
groups' wrappers, so neither the partitioning of the input nor a host with a third of all pages matters. No page, text or
tree is cut or left out for its size.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import attached, durable, written

#: Different pages of a host from which on its wrapper decides.
LEAST_PAGES = 3
#: Wrappers that a task folds, about.
FAN = 32
#: Share of the text in a container that a part of it must hold to be the region.
REGION_SHARE = 0.95
#: Elements nested deeper stand, for wrappers, in their ancestor at this depth.
DEPTH = 100
#: Children of an element are aligned at once up to this product of their numbers, longer ones in pieces.
ALIGN_CELLS = 1 << 28

#: Elements of flow content, which may come in any order and number.
FLOW = set("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table thead tbody tfoot tr td th caption colgroup col blockquote pre figure figcaption picture img hr address details summary option optgroup br center".split())
#: Elements that carry no article text, inline elements, elements whose content is not markup, empty elements.
NO_TEXT = set("head nav footer aside form script style noscript template iframe object svg math canvas audio video select button textarea dialog menu input label fieldset".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title noscript iframe xmp".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role that name what is not the article; and those that name it.
_ASIDE = re.compile(
    r"(ads?|adverts?|advertisements?|advertising|adsense|adslot|banners?|sponsor(ed)?|promos?|promotions?|sidebars?|side|menus?|nav|navbar|navigation|"
    r"breadcrumbs?|footers?|masthead|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlay|newsletters?|subscribe|subscription|signup|"
    r"login|comments?|replies|reply|respond|disqus|social|share|sharing|related|recommended|widgets?|toolbar|pagination|pager|copyright|legal|disclaimer|"
    r"contentinfo|complementary|search|form|dialog|skip)"
)
_TOP = re.compile(r"(headers?|banner|topbar)")
_MAIN = re.compile(r"(article|main|content|post|entry|story|maincontent|articlebody|articlecontent|postcontent|entrycontent|articletext)")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Block(NamedTuple):
    """A text slot: its whole text, and the roles around it."""

    text: str
    aside: bool
    main: int  # 2 in an article, 1 in a container named as content, else 0


class Page(NamedTuple):
    """``tree``: the children of the root, each an element (label, children) or the number of a block."""

    tree: list
    blocks: list[Block]


class _Open(NamedTuple):
    tag: str
    aside: bool
    main: int
    children: list
    depth: int


def _names(attrs: str) -> tuple[set[str], bool]:
    """Words of class, id and role, whole and without hyphens; whether the element is hidden."""
    names, hidden = set(), False
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key in ("class", "id", "role"):
                names.update(_html.unescape(value).split())
            hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value) is not None)
    return names, hidden


def _is_aside(tag: str, names: set[str], in_article: bool) -> bool:
    if tag in NO_TEXT or (tag == "header" and not in_article):
        return True
    for n in names:
        parts = re.split(r"[-_]+", n)
        if _ASIDE.fullmatch(n) or (parts[0] != "no" and not _MAIN.fullmatch(parts[-1]) and any(_ASIDE.fullmatch(x) for x in (parts[0], parts[-1]))):
            return True
        if not in_article and (_TOP.fullmatch(n) or _TOP.fullmatch(parts[-1])):
            return True
    return False


def _label(tag: str, names: set[str]) -> str:
    """What an element is aligned by: its tag, and its names with their numbers made equal."""
    return ".".join([tag, *sorted({re.sub(r"[0-9]+", "0", x) for x in names})])


def parse(html: str | None) -> Page:
    """Tree and text slots of a page, in one pass; broken markup is read as browsers close it."""
    root = _Open("", False, 0, [], 0)
    blocks: list[Block] = []
    stack: list[_Open] = []
    opened: Counter = Counter()
    held: list[str] = []
    html = html or ""

    def top() -> _Open:
        return stack[-1] if stack else root

    def drop(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def last_block() -> int:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag not in INLINE), -1)

    def flush() -> None:
        if held:
            text = " ".join(_html.unescape("".join(held)).split())
            held.clear()
            if text:
                x = top()
                x.children.append(len(blocks))
                blocks.append(Block(text, x.aside, x.main))

    at = 0
    n = len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            held.append(_html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        inline = tag in INLINE
        if tag == "br":
            held.append(" ")
            continue
        above = top()
        if inline and not attrs and not above.aside:
            continue
        if closing:
            if opened[tag]:
                if not inline or above.aside != (stack[-2].aside if len(stack) > 1 else False):
                    flush()
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                drop(k)
            elif not inline:
                flush()
            continue
        names, hidden = _names(attrs)
        if inline:
            aside = hidden or any(_ASIDE.fullmatch(x) for x in names)
            if tag not in EMPTY and not (attrs.endswith("/") and tag != "a"):
                if aside and not above.aside:
                    flush()
                stack.append(_Open(tag, above.aside or aside, above.main, above.children, above.depth))
                opened[tag] += 1
            continue
        flush()
        if tag in CLOSES:
            k = last_block()
            while k >= 0 and stack[k].tag in CLOSES[tag]:
                drop(k)
                k = last_block()
        elif opened["p"] and tag not in ("title", "meta", "link", "base"):
            k = last_block()
            if stack[k].tag == "p":
                drop(k)
        above = top()
        if above.tag == "head" and tag == "body":
            drop(len(stack) - 1)
            above = top()
        children: list = []
        if above.depth < DEPTH:
            above.children.append((_label(tag, names), children))
        else:
            children = above.children
        if tag in EMPTY:
            continue
        aside = above.aside or hidden or _is_aside(tag, names, above.main == 2)
        main = 2 if above.main == 2 or tag == "article" or "article" in names else 1 if above.main or tag == "main" or any(_MAIN.fullmatch(x.replace("-", "").replace("_", "")) for x in names) else 0
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        stack.append(_Open(tag, aside, main, children, above.depth + 1))
        opened[tag] += 1
    flush()
    return Page(root.children, blocks)


# A wrapper is a list of nodes:
#   ["e", label, nodes, optional, repeated]   an element
#   ["f", {label: node}, optional]            flow content: a repeated group of optional members, by label; "#" is a text slot
#   ["+", nodes, optional]                    a repeated group
#   ["s", marks]                              a text slot; its marks are blocks in a page, slot numbers in a wrapper


def _key(node: list) -> str:
    """What a node is aligned by."""
    return node[1] if node[0] == "e" else "#" if node[0] == "f" else "+ " + " ".join(map(_key, node[1]))


def _merge(a: list, b: list) -> list:
    """What matches both nodes, which have one key; ``a`` may be changed."""
    if a[0] == "s":
        a[1].extend(b[1])
        return a
    if a[0] == "e":
        return ["e", a[1], align(a[2], b[2]), a[3] or b[3], a[4] or b[4]]
    if a[0] == "f":
        for label, node in b[1].items():
            a[1][label] = _merge(a[1][label], node) if label in a[1] else node
        return ["f", a[1], a[2] or b[2]]
    return ["+", align(a[1], b[1]), a[2] or b[2]]


def _plain(node: list) -> list:
    """A node without its marks, as it is written."""
    if node[0] == "s":
        return ["s", []]
    if node[0] == "e":
        return ["e", node[1], [_plain(x) for x in node[2]], *node[3:]]
    if node[0] == "f":
        return ["f", {k: _plain(node[1][k]) for k in sorted(node[1])}, node[2]]
    return ["+", [_plain(x) for x in node[1]], node[2]]


def _repeats(codes: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(start, times) of adjacent equal groups of ``size``, from left to right."""
    equal = np.concatenate([[False], codes[:-size] == codes[size:], [False]])
    ends = np.flatnonzero(equal[1:] != equal[:-1]).reshape(-1, 2)
    return [(int(a), int(b - a) // size + 1) for a, b in ends if b - a >= size]


def collapse(nodes: list[list]) -> list[list]:
    """Adjacent equal groups as one repeated group, the shortest first. Elements without a name are equal if all below is."""
    size = 1
    while 2 * size <= len(nodes):
        often = Counter(map(_key, nodes))
        exact = [json.dumps(_plain(x)) if x[0] == "e" and "." not in x[1] and often[x[1]] > 1 else _key(x) for x in nodes]
        number = {k: i for i, k in enumerate(dict.fromkeys(exact))}
        codes = np.array([number[k] for k in exact])
        if len(number) == len(codes):
            break
        found = [(i, times) for i, times in _repeats(codes, size) if any(x[0] == "e" for x in nodes[i : i + size])]
        if not found:
            size += 1
            continue
        out, at = [], 0
        for i, times in found:
            group = nodes[i : i + size]
            for k in range(1, times):
                group = [_merge(x, y) for x, y in zip(group, nodes[i + k * size : i + (k + 1) * size], strict=True)]
            out += nodes[at:i]
            out.append([*group[0][:4], True] if size == 1 and group[0][0] == "e" else ["+", group, False])
            at = i + times * size
        nodes = out + nodes[at:]
        size += 1
    return nodes


def nodes_of(children: list) -> list[list]:
    """A page's tree as a wrapper of itself, marked with its blocks."""
    out: list[list] = []
    run: dict | None = None
    for x in children:
        label = "#" if isinstance(x, int) else x[0]
        if label == "#" or label.split(".", 1)[0] in FLOW:
            if run is None:
                run = {}
                out.append(["f", run, False])
            node = ["s", [x]] if label == "#" else ["e", label, nodes_of(x[1]), False, False]
            if label in run:
                run[label] = _merge(run[label], node)
                if label != "#":
                    run[label][4] = True
            else:
                run[label] = node
        else:
            run = None
            out.append(["e", label, nodes_of(x[1]), False, False])
    return collapse(out) if len(out) > 1 else out


def _grouped(nodes: list[list], groups: list[list]) -> list[list]:
    """Occurrences of groups that are repeated elsewhere, as these repeated groups."""
    for g in groups:
        inner, own = [_key(x) for x in g[1]], _key(g)
        keys = [_key(x) for x in nodes]
        if inner[0] not in keys:
            continue
        out, i = [], 0
        while i < len(nodes):
            if keys[i : i + len(inner)] == inner:
                more = ["+", nodes[i : i + len(inner)], False]
                i += len(inner)
            elif keys[i] == own:
                more = nodes[i]
                i += 1
            else:
                out.append(nodes[i])
                i += 1
                continue
            if out and out[-1][0] == "+" and _key(out[-1]) == own:
                out[-1] = _merge(out[-1], more)
            else:
                out.append(more)
        nodes = out
    return nodes


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: equal starts and ends first, the rest by rows of bits."""
    if len(a) * len(b) > ALIGN_CELLS:  # in pieces
        n = -(-len(a) * len(b) // ALIGN_CELLS)
        cut = [(len(a) * k // n, len(b) * k // n) for k in range(n + 1)]
        return [(i + x, j + y) for (i, j), (k, m) in zip(cut, cut[1:]) for x, y in common(a[i:k], b[j:m])]
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    places: dict[str, int] = {}
    for i, k in enumerate(x):
        places[k] = places.get(k, 0) | 1 << i
    full = (1 << len(x)) - 1
    rows = [full]  # a zero in row j, bit i: one more of x[:i + 1] than of x[:i] is common with y[:j]
    for k in y:
        hit = rows[-1] & places.get(k, 0)
        rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)
    middle = []
    i, j = len(x), len(y)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            middle.append((start + i, start + j))
    return [*((i, i) for i in range(start)), *reversed(middle), *((len(a) - k, len(b) - k) for k in range(end, 0, -1))]


def _optional(node: list) -> list:
    return ["e", *node[1:3], True, node[4]] if node[0] == "e" else [node[0], node[1], True]


def align(a: list[list], b: list[list]) -> list[list]:
    """One wrapper for what two wrappers match."""
    x, y = [_key(n) for n in a], [_key(n) for n in b]
    if x == y:
        return [_merge(m, n) for m, n in zip(a, b, strict=True)]
    a, b = _grouped(a, [n for n in b if n[0] == "+"]), _grouped(b, [n for n in a if n[0] == "+"])
    out: list[list] = []
    i = j = 0
    for k, m in [*common([_key(n) for n in a], [_key(n) for n in b]), (len(a), len(b))]:
        out += [_optional(n) for n in (*a[i:k], *b[j:m])]
        if k < len(a):
            out.append(_merge(a[k], b[m]))
        i, j = k + 1, m + 1
    return out


def slots(nodes: list[list]) -> Iterator[list]:
    """The text slots of a wrapper, in its order."""
    for x in nodes:
        if x[0] == "s":
            yield x
        else:
            yield from slots(x[2] if x[0] == "e" else x[1] if x[0] == "+" else [x[1][k] for k in sorted(x[1])])


def _numbered(wrapper: str) -> list[list]:
    nodes = json.loads(wrapper)
    for i, x in enumerate(slots(nodes)):
        x[1] = [i]
    return nodes


@lru_cache(maxsize=256)
def _known(wrapper: str) -> list[list]:
    return _numbered(wrapper)


def matched(shape: str, wrapper: str) -> list[int]:
    """For each slot of a page's shape the slot of the wrapper that it matches, or -1."""
    nodes = _numbered(shape)
    of = [-1] * sum(1 for _ in slots(nodes))

    def walk(a: list[list], b: list[list]) -> None:
        x, y = [_key(n) for n in a], [_key(n) for n in b]
        if x != y:
            a = _grouped(a, [n for n in b if n[0] == "+"])
            x = [_key(n) for n in a]
        for i, j in common(x, y):
            pair(a[i], b[j])

    def pair(a: list, b: list) -> None:
        if a[0] == "s":
            for i in a[1]:
                of[i] = b[1][0]
        elif a[0] == "f":
            for label in a[1].keys() & b[1].keys():
                pair(a[1][label], b[1][label])
        else:
            walk(a[-3] if a[0] == "e" else a[1], b[-3] if b[0] == "e" else b[1])

    walk(nodes, _known(wrapper))
    return of


def region(wrapper: str, mass: dict[int, int]) -> list[bool]:
    """For each slot of a wrapper whether it is in the article's region, given how much of the host's text stands in each slot.

    From the root down: as long as one container, which is neither flow content nor repeated, holds nearly all of the text.
    """
    nodes = _known(wrapper)
    weigh = lambda at: sum(mass.get(x[1][0], 0) for x in slots(at))
    inside = nodes
    while (total := weigh(inside)) > 0:
        parts = [x[2] for x in inside if x[0] == "e" and not x[4]]
        best = max(parts, key=weigh, default=[])
        if weigh(best) <= REGION_SHARE * total:
            break
        inside = best
    held = {x[1][0] for x in slots(inside)}
    return [x[1][0] in held for x in slots(nodes)]


def expression(wrapper: str) -> str:
    """The wrapper as a regular expression over tokens: ``<tag>``, ``#`` for a text, groups with ``?``, ``+`` and ``*``, no unions."""

    def one(x: list) -> str:
        if x[0] == "s":
            return "#"
        if x[0] == "e":
            inner = f"<{x[1]}>{text(x[2])}</{x[1]}>"
            return f"({inner}){'*' if x[3] and x[4] else '?' if x[3] else '+'}" if x[3] or x[4] else inner
        inner = text(x[1]) if x[0] == "+" else "".join(f"({one(x[1][k])})?" for k in sorted(x[1]))
        return f"({inner}){'*' if x[2] else '+'}"

    def text(nodes: list[list]) -> str:
        return "".join(map(one, nodes))

    return text(json.loads(wrapper))


def main_text(page: Page) -> str:
    """The article's blocks in page order, joined by one space, by the roles of elements alone: see ``extract``."""
    blocks = [b for b in page.blocks if not b.aside]
    best = max((b.main for b in blocks), default=0)
    return " ".join(b.text for b in blocks if b.main == best)


def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


BLOCK = "array<struct<text: string, slot: int, aside: boolean, main: int>>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, shape, blocks (text, slot of the shape, aside, main) of every row of ``pages``, in one pass over the whole html."""
    struct = pa.struct([("text", pa.string()), ("slot", pa.int32()), ("aside", pa.bool_()), ("main", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, ends, found, places = [], [0], [], []
            for html in batch.column(3).to_pylist():
                page = parse(html)
                nodes = nodes_of(page.tree)
                slot = [0] * len(page.blocks)
                for i, x in enumerate(slots(nodes)):
                    for b in x[1]:
                        slot[b] = i
                # written anew, so that equal shapes are equal texts
                shapes.append(json.dumps([_plain(x) for x in nodes]))
                found += page.blocks
                places += slot
                ends.append(len(found))
            values = pa.StructArray.from_arrays([pa.array([b.text for b in found], pa.string()), pa.array(places, pa.int32()), pa.array([b.aside for b in found], pa.bool_()), pa.array([b.main for b in found], pa.int32())], fields=list(struct))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shapes, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["page_id", "url", "host", "shape", "blocks"])

    ids = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", F.col("url").cast("string").alias("url"), _host().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {ids}, url string, host string, shape string, blocks {BLOCK}")


def wrappers(shapes: DataFrame) -> DataFrame:
    """host, wrapper: one row for each host of ``shapes`` (host, shape), whatever their order and partitions.

    Distinct shapes are dealt into groups of about ``FAN`` by their hash and each group is folded in the order of its texts; then
    the groups' wrappers, until a host has few enough for one group.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(set(pdf["wrapper"]))
        nodes = json.loads(texts[0])
        for x in texts[1:]:
            nodes = align(nodes, json.loads(x))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps([_plain(x) for x in nodes])]})

    schema = "host string, wrapper string"
    now = shapes.select("host", F.col("shape").alias("wrapper")).distinct()
    level = 0
    while True:
        now = durable(now)
        sizes = now.groupBy("host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= FAN:
            return now.groupBy("host").applyInPandas(fold, schema)
        group = F.pmod(F.xxhash64("wrapper", F.lit(level)), F.ceil(F.col("n") / F.lit(FAN)))
        now = now.join(sizes, "host").withColumn("g", group).groupBy("host", "g").applyInPandas(fold, schema).distinct()
        level += 1


def _places(known: DataFrame) -> DataFrame:
    """host, shape, at: for each slot of a host's shape (host, shape, wrapper) the slot of its wrapper."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"host": pdf["host"], "shape": pdf["shape"], "at": [matched(x, w) for x, w in zip(pdf["shape"], pdf["wrapper"], strict=True)]})

    return known.mapInPandas(run, "host string, shape string, at array<int>")


def _regions(known: DataFrame) -> DataFrame:
    """host, region: for each slot of a host's wrapper (host, wrapper, mass) whether it is in the article's region."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"host": pdf["host"], "region": [region(w, {r["slot"]: r["n"] for r in m}) for w, m in zip(pdf["wrapper"], pdf["mass"], strict=True)]})

    return known.select("host", "wrapper", "mass").mapInPandas(run, "host string, region array<boolean>")


def _filled() -> Column:
    """slot of the wrapper and digest, as one string, for each block that matches the wrapper."""
    return F.array_distinct(F.transform(F.filter("blocks", lambda b: F.get(F.col("at"), b["slot"]) >= 0), lambda b: F.concat_ws(" ", F.get(F.col("at"), b["slot"]).cast("string"), F.md5(b["text"]))))


def inferred(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the wrappers say of ``found`` (see ``parsed``): places (host, shape, at), and hosts (host, region, own).

    ``own`` holds the texts that stand in one slot on every page of the host. Only hosts of ``LEAST_PAGES`` different pages are in
    them. Pages are counted by aggregation, equal ones once.
    """
    different = found.select("host", F.xxhash64("shape", "blocks").alias("page")).distinct().groupBy("host").count().where(F.col("count") >= LEAST_PAGES).select("host")
    shapes = durable(found.select("host", "shape").distinct().join(different, "host", "left_semi"))
    wrapper = durable(wrappers(shapes))
    places = written(_places(shapes.join(wrapper, "host")), "page-places")
    placed = attached(found, places, ["host", "shape"])
    here = F.transform(F.filter("blocks", lambda b: ~b["aside"]), lambda b: F.struct(F.get(F.col("at"), b["slot"]).alias("slot"), F.length(b["text"]).alias("n")))
    mass = placed.select("host", F.explode(here).alias("b")).groupBy("host", "b.slot").agg(F.sum("b.n").alias("n")).groupBy("host").agg(F.collect_list(F.struct("slot", "n")).alias("mass"))
    regions = _regions(wrapper.join(mass, "host"))
    # what stands on every page stands on any one; that with the smallest hash is asked
    any_page = placed.groupBy("host").agg(F.min_by(_filled(), F.xxhash64("blocks")).alias("candidates"), F.count("*").alias("pages"))
    any_page = written(any_page, "page-candidates")
    hits = attached(placed, any_page, ["host"]).select("host", "pages", F.explode(F.array_intersect(_filled(), "candidates")).alias("own"))
    own = hits.groupBy("host", "own").agg(F.count("*").alias("n"), F.first("pages").alias("pages")).where("n = pages").groupBy("host").agg(F.collect_list("own").alias("own"))
    hosts = regions.join(own, "host", "left").select("host", "region", F.coalesce("own", F.array().cast("array<string>")).alias("own"))
    return places, written(hosts, "page-hosts")


def extract(pages: DataFrame, *, infer: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Of a page's blocks outside of menus and the like (those in an article element; on a page without one, in a container named as
    content; without that, all) those stay that the host's wrapper has in its region and not as the host's own text; all, if none
    would stay. ``infer=False`` leaves the wrappers out.

    A null or empty html gives ''. A null url belongs to the host ''. Repeated rows each get a row; other columns are left out. An
    empty table gives no row.
    """
    found = written(parsed(pages), "pages-parsed")
    blocks = F.filter("blocks", lambda b: ~b["aside"])
    best = F.array_max(F.transform(blocks, lambda b: b["main"]))
    base = F.filter(blocks, lambda b: b["main"] == best)
    if infer:
        places, hosts = inferred(found)
        found = attached(attached(found, places, ["host", "shape"]), hosts, ["host"])
        at = lambda b: F.get(F.col("at"), b["slot"])
        outside = lambda b: (at(b) >= 0) & ~F.get(F.col("region"), at(b))
        own = lambda b: (F.size("own") > 0) & F.array_contains(F.col("own"), F.concat_ws(" ", at(b).cast("string"), F.md5(b["text"])))
        found = found.withColumn("base", base).withColumn("kept", F.filter("base", lambda b: ~F.coalesce(outside(b) | own(b), F.lit(False))))
        chosen = F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("base"))
    else:
        chosen = base
    out = found.select("page_id", "url", F.array_join(F.transform(chosen, lambda b: b["text"]), " ").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
