"""Main text of web pages, by wrappers inferred from pages of the same host.

A page is a stream of tags and texts. A wrapper is a regular expression without
unions over such streams: elements in order, each of them once, optional or
repeated, and text slots. Pages of one host are aligned with the host's wrapper
one after the other; where they differ

* in a text, the text becomes a slot;
* in how often neighbours of one kind come, they become a repeated group;
* otherwise, what only one of them has becomes optional.

The wrapper tells which texts vary from page to page and which are the host's
own, and where in the pages the varying text stands. A page's blocks are read
from that region.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re
from collections import Counter
from collections.abc import Generator, Iterator
from math import isqrt
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomset.operators.joins import lookup_join
from loomset.storage import materialise

# Elements whose content never is main text, and words that mark such elements in their class, id or role. Inside an
# article or main element, and in ids of sections, only whole names made of these words mark one; ids of headings never do.
NEVER = frozenset(
    "nav footer aside form script style noscript template iframe svg button select option textarea "
    "input dialog menu head title object canvas audio video map datalist".split()
)
MARKS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "sidebar footer header masthead cookie cookies notice consent gdpr popup modal overlay newsletter subscribe signup "
    "comment comments disqus reply replies related recommended share sharing social breadcrumb breadcrumbs pagination "
    "contentinfo complementary search dialog alert toolbar widget".split()
)
MARKS_INSIDE = MARKS - frozenset("header masthead notice alert dialog consent search".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An open element that a start tag of the same kind, or of one of these, ends.
ENDED_BY = {
    "p": BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SAME_ON = 20  # a text is the host's own if this many different pages have it, and none differs
_SHORT = 64  # longer texts are kept by a hash of the whole
SALTS = 32
_BROADCAST_CHARS = 4_000_000
_LONGEST_PATH = 1000  # characters; a longer path begins with a hash of what stands above

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")

Steps = Generator["Steps", Any, Any]


def deep(steps: Steps) -> Any:
    """The result of steps that yield the steps they need the result of: pages may be nested deeper than calls can be."""
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def below(path: str, sign: str) -> str:
    """The path of an element of that sign inside the element at ``path``."""
    if len(path) > _LONGEST_PATH:
        path = "#" + hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=16).hexdigest()
    return f"{path}/{sign}"


class Element:
    __slots__ = ("tag", "sign", "never", "inside", "items")

    def __init__(self, tag: str, sign: str, never: bool, inside: bool = False):
        self.tag, self.sign, self.never, self.items = tag, sign, never, []
        self.inside = inside or tag in ("article", "main")  # an article or main element


def _start(tag: str, rest: str, inside: bool) -> Element:
    """An element with its sign: the tag and the words of its class, which pages of one template share."""
    words: list[str] = []
    marks: set[str] = set()
    names: list[list[str]] = []
    hidden = False
    for name, a, b, c in _ATTRIBUTE.findall(rest) if rest.strip() else ():
        value = (a or b or c).lower()
        name = name.lower()
        if name in ("hidden", "aria-hidden"):
            hidden |= name == "hidden" or value == "true"
            continue
        parts = [w for w in _SPLIT.split(value) if w]
        if name != "id" or tag not in HEADINGS and tag != "section":
            marks.update(parts)
        if name != "id" or tag not in HEADINGS and not (inside and tag == "section"):
            names += [[w for w in _SPLIT.split(x) if w] for x in value.split()]
        if name == "class":
            words += parts
    if tag in ("html", "body", "main"):
        never = False
    elif tag == "article":
        never = bool(marks & {"comment", "comments", "reply", "replies"})
    else:
        known = MARKS_INSIDE if inside else MARKS
        marked = any(parts and known.issuperset(parts) for parts in names) or not inside and bool(marks & MARKS)
        never = tag in NEVER or hidden or marked or (tag == "header" and not inside)
    return Element(tag, ".".join([tag, *sorted(set(words))]), never, inside)


def parse(page: str | None) -> Element:
    """The elements of a page; tags left open end with their parent, end tags without a start are skipped."""
    root = Element("#page", "#page", False)
    stack = [root]
    opened: Counter[str] = Counter()  # tags on the stack
    page = page or ""
    at = 0

    def close(k: int) -> None:
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def text(value: str) -> None:
        if value and not value.isspace():
            stack[-1].items.append(value)
        elif value:
            stack[-1].items.append(" ")

    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        if found["close"] or found["close2"]:
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        while len(stack) > 1 and tag in ENDED_BY.get(stack[-1].tag, ()):
            close(len(stack) - 1)
        if tag in BLOCKS and opened["p"] > 0:  # a block ends an open paragraph, whatever is still open inside it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
        element = _start(tag, found["rest"] or found["rest2"] or "", stack[-1].inside)
        stack[-1].items.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(element)
        opened[tag] += 1
    return root


# --- wrappers: {"t": sign, "q": "1", "?", "+" or "*", "c": [...]} and texts
# {"t": "#", "q": ..., "x": text or None, "m": characters, "d": pages that have the text, up to ``SAME_ON``}


def _often(a: str, b: str, repeated: bool = False) -> str:
    many = repeated or a in "+*" or b in "+*"
    maybe = a in "?*" or b in "?*"
    return ("*" if maybe else "+") if many else ("?" if maybe else "1")


def _maybe(item: dict) -> dict:
    return item | {"q": "*" if item["q"] in "+*" else "?"}


def _fold(items: list[dict]) -> Steps:
    """Neighbours of one kind become one repeated item; texts between them stay apart from elements."""
    out: list[dict] = []
    for item in items:
        if out and out[-1]["t"] == item["t"]:
            both = yield _merge(out[-1], item)
            out[-1] = both | {"q": _often(both["q"], "1", repeated=True)} if item["t"] != "#" else both | {"q": "1"}
        else:
            out.append(item)
    return out


def _kept(value: str) -> str:
    """The text itself if it is short, or a hash of the whole."""
    return value if len(value) <= _SHORT else "#" + hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=16).hexdigest() + "#" * _SHORT


def of_page(element: Element, digest: int = 0) -> dict:
    """The wrapper of one page: the page itself, its repeated neighbours folded."""
    return deep(_of_page(element, digest))


def _of_page(element: Element, digest: int) -> Steps:
    items = []
    for item in element.items:
        if isinstance(item, str):
            if not item.isspace():
                value = " ".join(references.unescape(item).split())
                items.append({"t": "#", "q": "1", "x": _kept(value), "m": len(value), "d": [digest & 0xFFFFFFFF]})
        elif not item.never:
            items.append((yield _of_page(item, digest)))
    return {"t": element.sign, "q": "1", "c": (yield _fold(items))}


def merge(a: dict, b: dict) -> dict:
    """Two items of one kind as one."""
    return deep(_merge(a, b))


def _merge(a: dict, b: dict) -> Steps:
    if a["t"] == "#":
        same = {"t": "#", "q": _often(a["q"], b["q"]), "x": None, "m": a["m"] + b["m"], "d": []}
        if a["x"] is not None and a["x"] == b["x"]:
            same["x"] = a["x"]
            same["d"] = a["d"] if len(a["d"]) >= SAME_ON else sorted({*a["d"], *b["d"]})[:SAME_ON]
        return same
    return {"t": a["t"], "q": _often(a["q"], b["q"]), "c": (yield _align(a["c"], b["c"]))}


def _common(a: np.ndarray, b: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Row i, place j: the longest common run of ``a[i:]`` and ``b[j:]``, given the row under the last."""
    rows = np.empty((a.size + 1, b.size + 1), np.int32)
    rows[-1] = under
    for i in range(a.size - 1, -1, -1):
        rows[i] = rows[i + 1]
        np.maximum(rows[i, :-1], np.where(b == a[i], rows[i + 1, 1:] + 1, 0), out=rows[i, :-1])
        rows[i] = np.maximum.accumulate(rows[i, ::-1])[::-1]
    return rows


def _pairs(a: list[str], b: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """Places of the two sequences of kinds in common order, those of the longest common run as pairs.

    One row in ``step`` is kept, and the rows between are made again when the
    way reaches them: memory grows with the root of one length times the other.
    """
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(t, len(number)) for t in kinds], np.int32) for kinds in (a, b))
    step = isqrt(x.size) + 1
    under = {}
    row = np.zeros(y.size + 1, np.int32)
    for at in range((x.size - 1) // step * step, -1, -step):
        under[at] = row
        row = _common(x[at : at + step], y, row)[0].copy()
    i = j = at = 0
    best = None
    while i < x.size or j < y.size:
        if i < x.size and (best is None or i >= at + step):
            at = i // step * step
            best = _common(x[at : at + step], y, under[at])
        if i < x.size and j < y.size and x[i] == y[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif j == y.size or (i < x.size and best[i + 1 - at, j] >= best[i - at, j + 1]):
            yield i, None
            i += 1
        else:
            yield None, j
            j += 1


def _align(a: list[dict], b: list[dict]) -> Steps:
    """The two sequences as one: the longest common run of kinds is merged, all else becomes optional."""
    kinds = [x["t"] for x in a], [x["t"] for x in b]
    same = kinds[0] == kinds[1]
    out: list[dict] = []
    for i, j in ((i, i) for i in range(len(a))) if same else _pairs(*kinds):
        out.append(_maybe(b[j]) if i is None else _maybe(a[i]) if j is None else (yield _merge(a[i], b[j])))
    if same:
        return out
    folded: list[dict] = []
    for item in out:  # optional neighbours of one kind are one repeated group
        if folded and folded[-1]["t"] == item["t"] and item["t"] != "#":
            both = yield _merge(folded[-1], item)
            folded[-1] = both | {"q": "*" if both["q"] in "?*" else "+"}
        else:
            folded.append(item)
    return folded


def _own(text: dict) -> bool:
    """Whether so many different pages have the text, and no other in its place, that it is the host's own."""
    return text["x"] is not None and len(text["d"]) >= SAME_ON


class Wrapper:
    """A host's wrapper and how many different pages it was made from (counted up to ``SAME_ON``)."""

    def __init__(self, tree: dict | None = None, seen: list[int] | tuple[int, ...] = ()):
        self.tree, self.seen = tree, set(seen)

    def add(self, tree: dict, seen: set[int]) -> None:
        self.tree = tree if self.tree is None else merge(self.tree, tree)
        self.seen = set(sorted(self.seen | seen)[:SAME_ON])

    def dump(self) -> str:
        """The nodes in order, an element with the number of its children: JSON of any depth would not be read again."""
        nodes: list[list] = []
        stack = [] if self.tree is None else [self.tree]
        while stack:
            item = stack.pop()
            if item["t"] == "#":
                nodes.append(["#", item["q"], item["x"], item["m"], item["d"]])
            else:
                nodes.append([item["t"], item["q"], len(item["c"])])
                stack.extend(reversed(item["c"]))
        return json.dumps({"nodes": nodes, "seen": sorted(self.seen)}, ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def load(cls, dumped: str) -> Wrapper:
        given = json.loads(dumped)
        top: dict = {"c": []}
        stack = [(top, 1)]  # elements that miss children, and how many
        for kind, often, *rest in given["nodes"]:
            holder, missing = stack.pop()
            if missing > 1:
                stack.append((holder, missing - 1))
            if kind == "#":
                holder["c"].append({"t": "#", "q": often, "x": rest[0], "m": rest[1], "d": rest[2]})
            else:
                holder["c"].append({"t": kind, "q": often, "c": []})
                if rest[0]:
                    stack.append((holder["c"][-1], rest[0]))
        return cls(top["c"][0] if top["c"] else None, given["seen"])

    def own_texts(self) -> set[tuple[str, str]]:
        """(path, text) of blocks that are one and the same text in each of many different pages that have them."""
        out: set[tuple[str, str]] = set()
        stack = [] if self.tree is None else [(self.tree, "")]
        while stack:
            item, path = stack.pop()
            for child in item["c"]:
                if child["t"] == "#":
                    alone = len(item["c"]) == 1 and item["q"] in "1?" and item["t"].split(".")[0] in BLOCKS
                    if alone and _own(child):
                        out.add((path, child["x"]))
                else:
                    stack.append((child, below(path, child["t"])))
        return out

    def _masses(self) -> dict[int, float]:
        """By id of the item: characters of varying text, those in links, lists and tables at a fifth."""
        found: dict[int, float] = {}

        def mass(item: dict) -> Steps:
            if item["t"] == "#":
                weight = 0.0 if _own(item) else item["m"]
            else:
                weight = 0.0
                for child in item["c"]:
                    weight += yield mass(child)
                weight *= 0.2 if item["t"].split(".")[0] in ("a", "ul", "ol", "table") else 1.0
            found[id(item)] = weight
            return weight

        deep(mass(self.tree))
        return found

    def region(self) -> str:
        """The path of the element that holds the main text: article, main, or the smallest block that holds all varying text."""
        if self.tree is None:
            return ""
        masses = self._masses()
        named: list[tuple[float, str]] = []
        stack = [(self.tree, "")]
        while stack:
            item, path = stack.pop()
            if item["t"].split(".")[0] in ("article", "main"):
                named.append((masses[id(item)], path))
            else:
                stack.extend((child, below(path, child["t"])) for child in item["c"] if child["t"] != "#")
        if named:
            return max(named)[1]
        item, path = self.tree, ""
        while True:
            holders = [c for c in item["c"] if masses[id(c)] > 0]
            if len(holders) != 1 or holders[0]["t"].split(".")[0] not in BLOCKS or holders[0]["q"] not in "1?":
                return path
            item, path = holders[0], below(path, holders[0]["t"])


def blocks(page: Element, region: str, own: set[tuple[str, str]]) -> list[str]:
    """The blocks of text in a page's region, in page order.

    A page without the region is read from its article or main element, and
    from the whole page if it has none. An article that the region holds inside
    is part of it. The host's own texts are left out, but not inside an article
    or main element, and no headings of a region.
    """
    named: list[tuple[Element, str]] = []
    exact: list[tuple[Element, str]] = []
    stack = [(page, "")]
    while stack:
        element, path = stack.pop()
        if element.never:
            continue
        if path == region and region:
            exact.append((element, path))
        elif element.tag in ("article", "main"):
            named.append((element, path))
        else:
            stack.extend((item, below(path, item.sign)) for item in reversed(element.items) if isinstance(item, Element))

    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        value = " ".join(references.unescape("".join(now)).split())
        if value:
            out.append(value)
        now.clear()

    def read(element: Element, path: str, whole: bool) -> Steps:
        if element.never:
            return
        whole = whole or element.tag in ("article", "main")
        several = sum(not isinstance(item, str) or not item.isspace() for item in element.items) > 1
        keep = not own or whole or several or (bool(exact) and element.tag in HEADINGS)
        block = element.tag in BLOCKS
        if block:
            end()
        elif element.tag == "br":
            now.append(" ")
        for item in element.items:
            if isinstance(item, str):
                if keep or (path, _kept(" ".join(references.unescape(item).split()))) not in own:
                    now.append(item)
            else:
                yield read(item, below(path, item.sign), whole)
        if block:
            end()

    for element, path in exact or named or [(page, "")]:
        deep(read(element, path, False))
        end()
    return out


# --- pages ---------------------------------------------------------------------------


def host(url: Column) -> Column:
    """The host of an address in lower case; '' for NULL and for what has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)`` from all rows of ``pages`` (host, html).

    Every task aligns its own pages of a host first, so at most one wrapper per
    host and task is shuffled; these meet in two steps, salted and then whole,
    so a host that holds a third of all pages is one wrapper per salt at last.
    """

    def joined(rows: Iterator[tuple[str, Wrapper]]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for name, wrapper in rows:
            if wrapper.tree is not None:
                held.setdefault(name, Wrapper()).add(wrapper.tree, wrapper.seen)
            if len(held) > 2000:
                yield out(held)
                held = {}
        yield out(held)

    def out(held: dict[str, Wrapper]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([w.dump() for w in held.values()], pa.string())], names=["host", "wrapper"]
        )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, Wrapper]]:
            for batch in batches:
                for name, digest, page in zip(*[batch.column(c) for c in ("host", "digest", "html")], strict=True):
                    yield name.as_py(), Wrapper(of_page(parse(page.as_py()), digest.as_py()), [digest.as_py()])

        yield from joined(rows())

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by host, so only one wrapper is held
        name, wrapper = None, Wrapper()
        for batch in batches:
            for key, dumped in zip(*[batch.column(c).to_pylist() for c in ("host", "wrapper")], strict=True):
                if key != name:
                    if wrapper.tree is not None:
                        yield out({name: wrapper})
                    name, wrapper = key, Wrapper()
                more = Wrapper.load(dumped)
                wrapper.add(more.tree, more.seen)
        if wrapper.tree is not None:
            yield out({name: wrapper})

    schema = "host string, wrapper string"
    first = pages.select("host", F.xxhash64("html").alias("digest"), "html").mapInArrow(learn, schema)
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt")
    salted = first.select("host", salt, "wrapper").repartition("host", "salt").sortWithinPartitions("host", "wrapper")
    half = salted.select("host", "wrapper").mapInArrow(combine, schema)
    return half.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(combine, schema)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row: the main text of its whole html, by its host's wrapper.

    Character references are decoded, blanks inside a block become one space,
    blocks are joined by two line feeds. NULL and empty pages, and pages
    without main text, have an empty text. Pages without a host share one
    wrapper. Repeated rows are returned as often as they come; an empty table
    gives an empty one. Wrappers go to the tasks if their counted size is
    small, and are joined by host and salt otherwise.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host(F.col(url)).alias("host")
    )
    wrappers = materialise(infer(rows), "wrappers")
    n, size = wrappers.agg(F.count("*"), F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()
    schema = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, str, set]] = {}
        for batch in batches:
            texts = []
            for name, dumped, page in zip(*[batch.column(c) for c in ("host", "wrapper", "html")], strict=True):
                key, value = name.as_py(), dumped.as_py()
                if key not in known or known[key][0] != value:
                    if len(known) > 1000:
                        known.clear()
                    wrapper = Wrapper.load(value) if value else Wrapper()
                    known[key] = (value, wrapper.region(), wrapper.own_texts())
                _, region, own = known[key]
                texts.append("\n\n".join(blocks(parse(page.as_py()), region, own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    small = n if size <= _BROADCAST_CHARS else None
    joined = lookup_join(rows, wrappers, "host", "left", table_rows=small)
    return joined.select("page_id", "url", "host", "wrapper", "html").mapInArrow(read, schema)
