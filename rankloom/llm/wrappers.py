"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

``infer(pages)`` gives (host, wrapper, n_pages). A wrapper is a tree of items, each an
element, a text slot or a group, and each may be optional or repeated: an expression
of concatenation, ``?`` and ``+`` alone. It accepts every page that it was inferred from.
``extract(pages)`` parses each page by its host's wrapper and adds ``text`` (see below).

How. A page is read as a token stream with the end tags that HTML implies; what it has at
one place is a sequence of items. An item's name is its tag, and whether class, id and role
say that it is something besides the text; other attributes are slots. A page's
sequences are folded (tandem repeats become repeated groups), and two expressions are
aligned item by item along their longest common subsequence of names: equal items are aligned inside,
texts that differ become slots, what only one has becomes optional, and the result is
folded again. A sequence that stays longer than ``MOST_ITEMS`` becomes one repeated
group of its optional items, in which any order is accepted. Pages are folded
into one expression per host within each input partition, and these meet in a tree of
aligners, ``FAN`` at a time: no task sees a whole host, however large, and what is shuffled are
expressions, whose size does not grow with the pages.

The text. On the wrapper the region of the article is chosen: ``article`` elements, or else
``main`` ones, or else the innermost container that holds ``SHARE`` of the text of links and
marked parts aside. Slots in it that lie in no marked part (tags of ``ASIDE``, class, id or role
of ``MARKS``) are the text. Where a wrapper's region is optional, a page without it takes
the next one. In a region of the last kind, a text that is the same on all of at least
``TEMPLATE`` pages belongs to the template. A ``header`` within the article is left out unless it
holds a heading. Character references are decoded (as HTML 5 has them), white space within a block,
line breaks too, becomes one space, and blocks are joined by an empty line.

Defined results: null and empty pages have the empty text; null addresses, and those
without a host, share the host ''; repeated rows each get theirs; elements nested deeper than ``DEPTH``
are siblings at that depth, with their text; other columns are handed on, but for
one named ``text``, which is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import html as references
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeing, in_small_batches, stored

FAN = 64
MOST_ITEMS = 48
DEPTH = 100
SHARE = 0.7
TEMPLATE = 5
#: Wrappers of so many bytes together are sent to all executors; beyond, pages meet them by host and one of SALTS.
BROADCAST_BYTES, SALTS = 32 << 20, 64

# Tags of HTML by what they are, and words that mark parts which are no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("head nav footer aside form menu dialog button select option datalist object svg canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section main td tr table tbody center article".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent gdpr notice notices alert banner popup modal overlay newsletter subscribe subscription signup login "
    "comment comments disqus respond reply replies discussion share sharing social related recommended recommendations widget toolbar pagination pager search skip complementary contentinfo".split()
)
#: Open elements that a start tag closes, and those that it does not look past.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "tr": (frozenset(["tr"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select"])),
}

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)""", re.S)
MARKED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}

#: Fields of an item. A text's name is TEXT, a group's starts with "("; ANY is a group in any order.
NAME, OPTIONAL, MANY, INSIDE, LITERAL, CHARS = range(6)
TEXT, ANY = "#", "(*)"


# -- pages as trees -----------------------------------------------------------


@functools.lru_cache(4096)
def _name(tag: str, attributes: str) -> str:
    """The tag, with ! if its attributes mark it."""
    if tag in ("html", "body"):
        return tag
    words = set()
    for found in MARKED.finditer(attributes):
        words.update(PARTS.findall((found[1] or found[2] or found[3] or "").lower()))
    return f"{tag}!" if words & MARKS or ("header" in words and not words & {"article", "post", "entry", "content", "story"}) else tag


def parse(page: str) -> list:
    """The page as [name, inside], inside being texts and such lists."""
    root: list = ["", []]
    stack, tags, at, n = [root], [""], 0, len(page)
    deeper: dict[str, int] = {}  # elements open beyond DEPTH, by tag
    while at < n:
        found = TAG.search(page, at)
        begin = found.start() if found else n
        if begin > at:
            _text(stack[-1][1], page[at:begin])
        if not found:
            break
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag = tag.lower()
        if len(stack) < DEPTH:
            deeper.clear()
        if found[1] or found[4]:
            if deeper.get(tag):
                deeper[tag] -= 1
            else:
                _close(stack, tags, tag)
            continue
        if tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag not in INLINE:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] == "p":
                    del stack[k:], tags[k:]
                    break
                if tags[k] not in INLINE:
                    break
            closed, border = CLOSES.get(tag, (None, ()))
            if closed:
                for k in range(len(tags) - 1, 0, -1):
                    if tags[k] in border:
                        break
                    if tags[k] in closed:
                        del stack[k:], tags[k:]
                        break
        element = [_name(tag, found[3] or found[6] or ""), []]
        stack[-1][1].append(element)
        if tag in VOID:
            continue
        if len(stack) < DEPTH:
            stack.append(element)
            tags.append(tag)
        else:
            deeper[tag] = deeper.get(tag, 0) + 1
    return root


def _text(inside: list, text: str) -> None:
    if inside and isinstance(inside[-1], str):
        inside[-1] += text
    else:
        inside.append(text)


def _close(stack: list, tags: list, tag: str) -> None:
    """Ends the innermost open element of the tag; an inline one only within its block."""
    for k in range(len(tags) - 1, 0, -1):
        if tags[k] == tag:
            del stack[k:], tags[k:]
            return
        if tag in INLINE and tags[k] not in INLINE:
            return


# -- expressions --------------------------------------------------------------


def expression(element: list) -> list:
    """The item of an element of a page."""
    inside = []
    for x in element[1]:
        if not isinstance(x, str):
            inside.append(expression(x))
        elif not x.isspace():
            plain = " ".join(x.split())
            inside.append([TEXT, 0, 0, [], zlib.crc32(plain.encode()), len(plain)])
    return [element[0], 0, 0, folded(inside), None, 0]


def merged(a: list, b: list, optional: int) -> list:
    """One item for two of the same name."""
    literal = a[LITERAL] if a[LITERAL] == b[LITERAL] else None
    inside = aligned(a[INSIDE], b[INSIDE]) if a[INSIDE] or b[INSIDE] else []
    if a[NAME] == ANY:
        inside = _any_order(a[INSIDE] + b[INSIDE])[0][INSIDE]
    return [a[NAME], optional, a[MANY] | b[MANY], inside, literal, a[CHARS] + b[CHARS]]


def folded(items: list) -> list:
    """The items with tandem repeats of their names as repeated items and groups."""
    out: list = []
    for x in items:  # of one item
        if out and out[-1][NAME] == x[NAME]:
            out[-1] = merged(out[-1], x, out[-1][OPTIONAL] & x[OPTIONAL])
            out[-1][MANY] = 1
        else:
            out.append(x)
    k = 2
    while 2 * k <= len(out):  # of k items: the number of places at which a name stands k places on tells where
        names, i, done = [x[NAME] for x in out], 0, []
        while i < len(out):
            end = i + k
            while end + k <= len(out) and names[i : i + k] == names[end : end + k]:
                end += k
            if end == i + k:
                done.append(out[i])
                i += 1
                continue
            group = [f"({' '.join(names[i : i + k])})", int(all(x[OPTIONAL] for x in out[i:end])), 1, out[i : i + k], None, 0]
            for j in range(i + k, end, k):
                group[INSIDE] = [merged(a, b, a[OPTIONAL] | b[OPTIONAL]) for a, b in zip(group[INSIDE], out[j : j + k], strict=True)]
            done.append(group)
            i = end
        k, out = (k + 1, out) if len(done) == len(out) else (2, done)
        if len(out) > MOST_ITEMS and k > MOST_ITEMS:
            break
    return _any_order(out) if len(out) > MOST_ITEMS else out


def _any_order(items: list) -> list:
    """One repeated group of the items, each optional, in any order."""
    by_name: dict[str, list] = {}
    rest = list(items)[::-1]
    while rest:
        x = rest.pop()
        if x[NAME][0] == "(":
            rest += x[INSIDE][::-1]
        else:
            held = by_name.get(x[NAME])
            by_name[x[NAME]] = merged(held, x, 1) if held else [x[NAME], 1, *x[2:]]
    return [[ANY, 1, 1, [by_name[k] for k in sorted(by_name)], None, 0]]


def aligned(a: list, b: list) -> list:
    """One sequence that accepts what either accepts."""
    if [x[NAME] for x in a] == [x[NAME] for x in b]:
        return [merged(x, y, x[OPTIONAL] | y[OPTIONAL]) for x, y in zip(a, b, strict=True)]
    if any(x[NAME] == ANY for x in a + b):
        return _any_order(a + b)
    a, b = _grouped_like(a, b), _grouped_like(b, a)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]  # of at most MOST_ITEMS each
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i][NAME] == b[j][NAME] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][NAME] == b[j][NAME]:
            out.append(merged(a[i], b[j], a[i][OPTIONAL] | b[j][OPTIONAL]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][NAME], 1, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][NAME], 1, *b[j][2:]])
            j += 1
    return folded(out)


def _grouped_like(items: list, other: list) -> list:
    """``items`` with what stands there once, but is a repeated group of the other sequence, as that group."""
    names = [x[NAME] for x in items]
    for group in other:
        if group[NAME][0] != "(" or group[NAME] in names:
            continue
        wanted = [x[NAME] for x in group[INSIDE]]
        k = next((k for k in range(len(names) - len(wanted) + 1) if names[k : k + len(wanted)] == wanted), None)
        if k is not None:
            items = [*items[:k], [group[NAME], 0, 0, items[k : k + len(wanted)], None, 0], *items[k + len(wanted) :]]
            names = [x[NAME] for x in items]
    return items


# -- slots --------------------------------------------------------------------


def _inside(element: list) -> list:
    return [x for x in element[1] if not (isinstance(x, str) and x.isspace())]


def _name_of(x: str | list) -> str:
    return TEXT if isinstance(x, str) else x[0]


class _Node:
    """An element of a wrapper, ready to parse by."""

    def __init__(self, item: list):
        self.name = item[NAME]
        self.tag = self.name.rstrip("!")
        self.first, self.follow, self.last, self.leaves = [], {}, set(), []
        self.first, self.last, self.nullable = self._sequence(item[INSIDE])
        names = [x.name if isinstance(x, _Node) else TEXT for x in self.leaves]
        self.at: dict[str, list[int]] = {}
        for k, x in enumerate(names):
            self.at.setdefault(x, []).append(k)

    def _leaf(self, item: list) -> tuple[list, set, bool]:
        k = len(self.leaves)
        self.leaves.append(item if item[NAME] == TEXT else _Node(item))
        self.follow[k] = {k} if item[MANY] else set()
        return [k], {k}, bool(item[OPTIONAL])

    def _sequence(self, items: list) -> tuple[list, set, bool]:
        first, last, nullable = [], set(), True
        for x in items:
            if x[NAME][0] != "(":
                f, e, none = self._leaf(x)
            else:
                f, e, none = self._sequence(x[INSIDE])
                if x[NAME] == ANY:
                    f = sorted(e)
                if x[MANY]:
                    for k in e:
                        self.follow[k].update(f)
                none = none or bool(x[OPTIONAL])
            for k in last:
                self.follow[k].update(f)
            first = first + f if nullable else first
            last = last | e if none else e
            nullable = nullable and none
        return first, last, nullable

    def places(self, inside: list, fits: dict) -> list[int | None]:
        """The item that each text and element at this place of a page is parsed by; None for those of no item."""
        names = list(map(_name_of, inside))
        if all(len(self.at.get(x, ())) == 1 for x in set(names)):
            return [self.at[x][0] for x in names]
        steps = self._steps(inside, names, fits)
        at = next((k for k in steps[-1] if k in self.last), None) if len(steps) == len(inside) else None
        if at is None:  # not of this wrapper: the first item of the name
            return [self.at[x][0] if x in self.at else None for x in names]
        out = []
        for here in steps[::-1]:
            out.append(at)
            at = here[at]
        return out[::-1]

    def _steps(self, inside: list, names: list[str], fits: dict) -> list[dict]:
        """For each place the items that may parse it, with an item before; fewer places where it ends in none."""
        steps: list[dict] = []
        for i, (x, name) in enumerate(zip(inside, names, strict=True)):
            here = {}
            for k in self.at.get(name, ()):
                before = [None] if not i and k in self.first else [q for q in steps[-1] if k in self.follow[q]] if i else []
                if before and (name == TEXT or self.leaves[k].accepts(x, fits)):
                    here[k] = before[0]
            if not here:
                break
            steps.append(here)
        return steps

    def accepts(self, element: list, fits: dict) -> bool:
        """Whether the expression accepts what is in an element; ``fits`` holds what is known of the page."""
        key = id(element), id(self)
        if key not in fits:
            inside = _inside(element)
            steps = self._steps(inside, list(map(_name_of, inside)), fits)
            fits[key] = not self.last.isdisjoint(steps[-1]) if inside and len(steps) == len(inside) else not inside and self.nullable
        return fits[key]

    def chars(self) -> int:
        """Characters of the texts in it, links and marked parts aside."""
        if not hasattr(self, "_chars"):
            self._chars = 0 if self.aside() or self.tag == "a" else sum(x.chars() if isinstance(x, _Node) else x[CHARS] for x in self.leaves)
        return self._chars

    def aside(self) -> bool:
        return self.tag in ASIDE or self.name[-1:] == "!"

    def heads(self) -> bool:
        return any(isinstance(x, _Node) and (x.tag in HEADINGS or x.heads()) for x in self.leaves)

    def found(self, tag: str, marked: bool) -> list[_Node]:
        """The outermost elements of the tag that are not marked themselves, within unmarked parts or anywhere."""
        out = []
        for x in self.leaves:
            if isinstance(x, _Node):
                if x.tag == tag and not x.aside():
                    out.append(x)
                elif marked or not (x.aside() or x.tag == "header"):
                    out += x.found(tag, marked)
        return out


class Wrapper:
    """A wrapper, ready to extract by."""

    def __init__(self, item: list, pages: int):
        self.root, self.pages = _Node(item), pages
        regions = [self.root.found("article", False), self.root.found("main", False), self.root.found("article", True)]
        self.regions = [({id(x) for x in r}, False) for r in regions if r] + [({id(self._densest())}, True)]

    def _densest(self) -> _Node:
        node = self.root
        while True:
            inside = [x for x in node.leaves if isinstance(x, _Node) and x.tag in CONTAINERS and not x.aside()]
            top = max(inside, key=_Node.chars, default=None)
            if top is None or top.chars() < SHARE * max(1, node.chars()) or top.chars() == 0:
                return node
            node = top

    def text(self, page: str) -> str:
        tree, fits = parse(page), {}
        for region, densest in self.regions:
            blocks: list[list[str]] = [[]]
            if self._walk(tree, self.root, region, densest, id(self.root) in region, blocks, fits):
                return "\n\n".join(y for x in blocks if (y := " ".join(references.unescape("".join(x)).split())))
        return ""

    def _walk(self, element: list, node: _Node, region: set, densest: bool, within: bool, blocks: list, fits: dict) -> bool:
        """Adds the texts in the region's slots to ``blocks``; whether the page has the region."""
        places = iter(node.places(_inside(element), fits))
        seen = within
        for x in element[1]:
            k = None if isinstance(x, str) and x.isspace() else next(places)
            leaf = node.leaves[k] if k is not None else None
            if isinstance(x, str):
                if within and not (densest and leaf and leaf[LITERAL] is not None and self.pages >= TEMPLATE):
                    blocks[-1].append(x)
                continue
            tag = x[0].rstrip("!")
            if tag in ("br", "wbr"):
                if within and tag == "br":
                    blocks[-1].append(" ")
                continue
            leaf = leaf or _Node([x[0], 0, 0, [], None, 0])
            chosen = id(leaf) in region
            if within and (leaf.aside() or (tag == "header" and (densest or not leaf.heads()))):
                blocks.append([])
                continue
            if tag not in INLINE:
                blocks.append([])
            seen = self._walk(x, leaf, region, densest, within or chosen, blocks, fits) or seen
            if tag not in INLINE:
                blocks.append([])
        return seen


# -- jobs ---------------------------------------------------------------------

_STATE = T.StructType([T.StructField("host", T.StringType()), T.StructField("part", T.LongType()), T.StructField("wrapper", T.StringType()), T.StructField("n_pages", T.LongType())])


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _states(rows: dict[str, tuple[list, int]], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(rows)), pa.array([part] * len(rows), pa.int64()), pa.array([json.dumps(w, separators=(",", ":")) for w, _ in rows.values()], pa.string()), pa.array([n for _, n in rows.values()], pa.int64())], names=_STATE.names)


def infer(pages: DataFrame, *, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, wrapper, n_pages) of all hosts."""
    given = pages.select(host_of(pages[f"`{url_column}`"]).alias("host"), F.coalesce(pages[f"`{html_column}`"], F.lit("")).alias("html"), F.spark_partition_id().cast("long").alias("part"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, int]] = {}
        part = 0
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = expression(parse(page.as_py()))
                old = held.get(host)
                held[host] = (merged(old[0], new, 0), old[1] + 1) if old else (new, 1)
            if len(held) > 10_000:  # hosts without end: what there is of them goes on
                yield _states(held, part)
                held = {}
        if held:
            yield _states(held, part)

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["wrapper"]))
        wrapper = functools.reduce(lambda a, b: merged(a, b, 0), (json.loads(r["wrapper"]) for r in rows))
        return pa.table({"host": [rows[0]["host"]], "part": pa.array([rows[0]["part"]], pa.int64()), "wrapper": [json.dumps(wrapper, separators=(",", ":"))], "n_pages": pa.array([sum(r["n_pages"] for r in rows)], pa.int64())})

    states = in_small_batches(given).mapInArrow(freeing(local), _STATE)
    for level in (FAN, FAN * FAN):
        states = states.groupBy("host", F.floor(F.col("part") / level)).applyInArrow(meet, _STATE)
    return states.groupBy("host").applyInArrow(meet, _STATE).select("host", "wrapper", "n_pages")


@functools.lru_cache(256)
def _ready(wrapper: str, pages: int) -> Wrapper:
    return Wrapper(json.loads(wrapper), pages)


def extract(pages: DataFrame, wrappers: DataFrame | None = None, *, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``pages`` with ``text``, by the wrappers given or inferred from the pages themselves."""
    wrappers = wrappers or stored(infer(pages, url_column=url_column, html_column=html_column))
    rest = [c for c in pages.columns if c.lower() != "text"]
    plain = [f"c{k}" for k in range(len(rest))]
    given = pages.select(*(pages[f"`{c}`"].alias(p) for c, p in zip(rest, plain, strict=True)), host_of(pages[f"`{url_column}`"]).alias("host"), F.coalesce(pages[f"`{html_column}`"], F.lit("")).alias("html"))
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = given.join(F.broadcast(wrappers), "host", "left")
    else:
        salted = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = given.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    schema = T.StructType([*(T.StructField(p, pages.schema[c].dataType) for c, p in zip(rest, plain, strict=True)), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, wrapper, n in zip(batch.column(len(rest)), batch.column(len(rest) + 1), batch.column(len(rest) + 2), strict=True):
                page = page.as_py()
                texts.append(_ready(wrapper.as_py(), n.as_py()).text(page) if page and wrapper.is_valid else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], names=[*plain, "text"])

    out = in_small_batches(met.select(*plain, "html", "wrapper", "n_pages")).mapInArrow(freeing(run), schema)
    return out.select(*(F.col(p).alias(c) for c, p in zip(rest, plain, strict=True)), "text")
