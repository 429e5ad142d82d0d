"""Operator 4: main text of pages by wrappers, one union-free expression for each host.

A page is a stream of block tags and text slots. Folding equal neighbours into repeated groups gives its
own expression. A host's places are the paths of labels that its pages have; at each place the streams of the
children are aligned tag by tag, what only some of them have becomes optional, and a slot whose texts differ is
content, one whose texts are equal so far belongs to the template. Together that is the host's wrapper, kept as a
table of places, so none is too large. Streams of one shape are summed up first, in any order; the shapes are then
aligned along the bits of their hashes, which gives the same for any layout, for any number of groups and beside
any other hosts. The wrapper tells where the host's pages hold their articles: by their tags, and by the place in
which the text that differs between pages lies. Every page is read from the first of these places that holds text
in it; nothing inside is dropped for being equal on other pages.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionline.llm.common import table, written

#: Tags within a line of text, tags without an end, tags whose content isn't text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed".split())
#: Elements that are never article text, and names (class, id or role) that say so.
OUTSIDE = RAW | frozenset("head nav header footer aside form button select option input menu dialog".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside header footer masthead cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments commentlist reply replies respond disqus widget toolbar pagination".split())
#: What may stand beside such a word in a compound name; in the second set, beside reader comments too.
BESIDE = frozenset("site page top bottom left right upper lower inner outer main global primary secondary mobile desktop box wrapper wrap container list bar area section block item items link links group holder panel row col column slot unit content widget icons buttons button form text title".split())
OF_READERS, PARTS = frozenset("comment comments commentlist reply replies respond disqus".split()), frozenset("article post entry story user reader the".split())
#: Names of articles that only point to another one.
TEASERS = frozenset("teaser teasers card cards preview previews promo related recommended".split())
#: An opening tag of the first kind ends an open element of the second, up to the third.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPES = frozenset("table td th button body html".split())

#: Elements nested deeper than this are read as children of the element at this depth.
DEEP = 200
#: Shapes of a place that are aligned in one group; groups are aligned in groups again until a place has one.
FAN = 1000
#: Items of an overview (``merged``) from which on those with less than a thousandth of its characters are summed up.
MANY = 2000
OTHERS = "~"

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


@dataclass(slots=True)
class Node:
    """An element of a page, or a text slot (label '#'). The label of what is outside begins with '-', so
    boilerplate and content never fold or align into one item."""

    label: str
    outside: bool = False
    children: list = field(default_factory=list)
    text: list = field(default_factory=list)
    tag: str = ""
    linked: int = 0  # characters of a slot that are inside of links
    teaser: bool = False


def _tokens(text: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name, rest, end) of each piece of a page: text, or a tag that opens or closes.

    The reader may send a position to go on from, past content that is no markup. A tag ends at the first '>'
    outside of quotes; quotes that are never closed, and all of a page that has many such, are plain signs."""
    pos, last, plain, astray = 0, text.rfind(">"), set(), 0
    while pos < len(text):
        at = text.find("<", pos)
        if at != pos:
            at = len(text) if at < 0 else at
            yield "text", "", text[pos:at], at
            pos = at
            continue
        if at > last:  # no tag ends any more
            yield "text", "", text[at:], len(text)
            return
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            pos = len(text) if end < 0 else end + 3
            continue
        m = _OPEN.match(text, at)
        if not m:
            if text[at + 1] in "!?/":
                pos = text.find(">", at) + 1
            else:
                yield "text", "", "<", at + 1
                pos = at + 1
            continue
        end, step = text.find(">", m.end()), m.end()
        if '"' in (rest := text[step:end]) or "'" in rest:
            end = -1
        while end < 0 and (stop := _STOP.search(text, step)):
            sign, step = stop[0], stop.end()
            if sign == ">":
                end = stop.start()
            elif sign not in plain:
                close = text.find(sign, step)
                if close < 0:
                    plain.add(sign)
                else:
                    step = close + 1
        if end < 0:
            end, astray = text.find(">", m.end()), astray + 1
            if astray > 20:
                plain |= {'"', "'"}
        pos = (yield "close" if m[1] else "open", m[2].lower(), text[m.end() : end], end + 1) or end + 1


def says_outside(names: str) -> bool:
    """Whether one of the names, parted by blanks, is that of boilerplate: such a word as a whole, or a compound of
    such words and of what only says where they are. 'site-footer' is, 'article-header' and 'share-price' are not."""
    for name in names.split():
        parts = set(re.findall("[a-z]+", name))
        if parts & WORDS and (parts <= WORDS | BESIDE or parts & OF_READERS and parts <= WORDS | BESIDE | PARTS):
            return True
    return False


def parse(source: str | None) -> Node:
    """The block elements and text slots of a page; lenient about missing and stray end tags."""
    root = Node("")
    stack, opened = [root], Counter()
    text = source or ""

    def slot() -> Node:
        here = stack[-1].children
        k = len(here) - 1
        while k >= 0 and here[k].outside and here[k].tag in INLINE:
            k -= 1  # what is outside within a line doesn't end the line
        if k < 0 or here[k].label != "#":
            here.append(Node("#"))
            k = len(here) - 1
        return here[k]

    def pop(tags: set | frozenset, stop: set | frozenset) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for n in stack[max(i, DEEP) :]:
                    n.children.append(Node("-", True))  # its text ends here
                opened.subtract(n.tag for n in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    tokens, go, link = _tokens(text), None, False
    while True:
        try:
            kind, tag, rest, pos = tokens.send(go)
        except StopIteration:
            return root
        go = None
        if kind == "text":
            here = slot()
            here.text.append(rest)
            here.linked += len(rest.strip()) if link else 0
            continue
        if tag == "br":
            slot().text.append(" ")
            continue
        link = kind == "open" if tag == "a" else link and tag not in OUTSIDE | {"article", "section", "li", "td"}
        if kind == "close":
            if tag not in INLINE or opened[tag]:
                pop({tag}, SCOPES - {tag} if tag == "p" else frozenset())
            continue
        names, outside, teaser = "", tag in OUTSIDE, False
        if "=" in rest:
            found = {k.lower(): v.strip("\"'").lower() for k, v in _NAMED.findall(rest)}
            # long numbers name one page alone, short ones count columns
            names = re.sub(r"\d{3,}", "", " ".join(sorted(found.get("class", "").split())))
            outside = outside or says_outside(" ".join(found.values()))
            teaser = tag == "article" and bool(TEASERS & set(re.findall("[a-z]+", found.get("class", ""))))
        if tag in INLINE and not outside:
            continue
        if tag not in INLINE:
            pop({"p"}, SCOPES | frozenset(("li", "article", "section", "div")) if tag != "p" else SCOPES)
        if tag in ENDS:
            pop(*ENDS[tag])
        if tag in VOID:
            stack[-1].children.append(Node(f"-{tag}" if outside else tag, outside, tag=tag))
            continue
        node = Node(f"{'-' if outside else ''}{tag} {names}".strip(), outside, tag=tag, teaser=teaser)
        stack[-1].children.append(node)
        if tag in RAW:  # its content is not markup
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, pos)
            go = len(text) if end is None else (text.find(">", end.start()) + 1 or len(text))
            continue
        if len(stack) >= DEEP:
            node = Node(node.label, outside, node.children if outside else stack[-1].children, tag=tag)
        stack.append(node)
        opened[tag] += 1


def slot_text(node: Node) -> str:
    """The text of a slot: references decoded, white space as one blank each, trimmed."""
    return " ".join("".join(entities.unescape(x) for x in node.text).split())


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) >> 1 | 1


# An expression is a list of items [label, optional, repeated, outside, characters, items, value]. The value of
# a slot is the hash of its text, or 0 where texts differ.


def expression(node: Node) -> list:
    out: list = []
    for c in node.children:
        value = 0
        if c.label == "#":
            words = slot_text(c)
            if not words:
                continue
            value = _hash(words)
        item = [c.label, False, False, c.outside, sum(map(len, c.text)), [] if c.outside else expression(c), value]
        if out and out[-1][0] == c.label and c.label != "#":
            out[-1] = _joined(out[-1], item, _both)
            out[-1][2] = True
        else:
            out.append(item)
    return out


def _both(a: int, b: int) -> int:
    """The value of two texts of one page in one slot: that of the pair, as each page may have the same."""
    return _hash(f"{a} {b}") if a and b else 0


def _same(a: int, b: int) -> int:
    return a if a == b else 0


def _joined(a: list, b: list, value: Callable[[int, int], int] = _same) -> list:
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] or b[3], a[4] + b[4], align(a[5], b[5], value), value(a[6], b[6])]


def align(a: list, b: list, value: Callable[[int, int], int] = _same) -> list:
    """The expression that covers both: common items in order, all others optional, equal neighbours folded.

    At a mismatch the nearer one counts of the next place in b of a's label and the next place in a of b's,
    and what lies before it is optional; so the time grows with the length alone. value tells the value of
    a slot from those of two: of pages, or of neighbours within a page."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [_joined(x, y, value) for x, y in zip(a, b, strict=True)]
    places: tuple[dict, dict] = {}, {}
    for where, items in zip(places, (a, b), strict=True):
        for k, x in enumerate(items):
            where.setdefault(x[0], []).append(k)

    def ahead(where: dict, label: str, k: int) -> int:
        found = where.get(label, ())
        at = bisect_left(found, k)
        return found[at] - k if at < len(found) else 1 << 60

    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b):
            in_b, in_a = ahead(places[1], a[i][0], j), ahead(places[0], b[j][0], i)
            if not in_b:
                out.append(_joined(a[i], b[j], value))
                i, j = i + 1, j + 1
                continue
            mine = in_a <= in_b and in_a < 1 << 60 or in_b == 1 << 60
        else:
            mine = i < len(a)
        x = a[i] if mine else b[j]
        i, j = i + mine, j + (not mine)
        out.append([x[0], True, *x[2:]])
    folded: list = []
    for x in out:
        if folded and folded[-1][0] == x[0] and x[0] != "#":
            both = folded[-1][1] and x[1]
            folded[-1] = _joined(folded[-1], x, value)
            folded[-1][1], folded[-1][2] = both, True
        else:
            folded.append(x)
    return folded


def _size(items: list) -> int:
    return len(items) + sum(_size(x[5]) for x in items)


def thinned(items: list) -> list:
    """An expression of more than MANY items with all that have less than a thousandth of its characters, what they
    hold included, summed up as one item of others at each place. For overviews: no result of the operator reads it."""
    if _size(items) <= MANY:
        return items
    whole: dict[int, int] = {}

    def weigh(x: list) -> int:
        whole[id(x)] = x[4] + sum(map(weigh, x[5]))
        return whole[id(x)]

    least = sum(map(weigh, items)) / 1000

    def keep(level: list) -> list:
        out, small = [], 0
        for x in level:
            if x[0] == OTHERS or whole[id(x)] < least:
                small += 0 if x[3] else whole[id(x)]
            else:
                out.append([*x[:5], keep(x[5]), x[6]])
        return [*out, [OTHERS, True, True, False, small, [], 0]] if small else out

    return keep(items)


def merged(parts: Iterator[list]) -> list:
    """An overview of many expressions, aligned two and two in a tree and thinned. The operator's wrappers are whole:
    it aligns the streams of each place by ``aligned``."""
    stack: list[tuple[int, list]] = []
    for one in parts:
        rank = 0
        while stack and stack[-1][0] == rank:
            one, rank = thinned(align(stack.pop()[1], one)), rank + 1
        stack.append((rank, one))
    out = stack.pop()[1]
    while stack:
        out = thinned(align(stack.pop()[1], out))
    return out


def aligned(parts: Iterator[tuple[int, list]]) -> list:
    """The expression that covers all of (hash, expression), in ascending order of the hashes.

    Those whose hashes have most of their first bits in common are aligned first. So the tree is that of the bits,
    and groups of equal first bits, aligned each by itself and then by these bits, give the same."""
    stack: list[tuple[int, list]] = []

    def fold() -> None:
        right = stack.pop()[1]
        common, left = stack.pop()
        stack.append((common, align(left, right)))

    last = 0
    for h, one in parts:
        common = -(last ^ h).bit_length()
        while len(stack) > 1 and stack[-1][0] > common:
            fold()
        stack.append((common, one))
        last = h
    while len(stack) > 1:
        fold()
    return stack[0][1]


def places(items: list) -> dict[tuple[str, ...], list]:
    """The streams of children at each place of an expression, by the labels that lead there.

    Elements of one place that are no neighbours are folded like neighbours, so a page has one stream of each."""
    found: dict[tuple[str, ...], list] = {}

    def walk(items: list, path: tuple[str, ...]) -> None:
        level = [[*x[:5], [], x[6]] for x in items]
        found[path] = align(found[path], level, _both) if path in found else level
        for x in items:
            if not x[3] and x[0] != "#":
                walk(x[5], (*path, x[0]))

    walk(items, ())
    return found


def _told(path: tuple[str, ...], items: list) -> bool:
    """Whether a place tells something: it holds text, is an article or main, or is the page."""
    return not path or path[-1].split(" ")[0] in ("article", "main") or any(x[0] == "#" for x in items)


def _shape(items: list, counts: list, values: list) -> list:
    """An expression without its characters and values, which go to the two lists in the order of the items."""
    out = []
    for label, _, repeated, outside, n, inner, value in items:
        counts.append(n)
        values.append(value)
        out.append([label, int(repeated), int(outside), _shape(inner, counts, values)])
    return out


def _filled(shape: list, counts: Iterator[int], values: Iterator[int]) -> list:
    """The reverse of _shape."""
    return [[label, False, bool(repeated), bool(outside), next(counts), *(_filled(inner, counts, values), value)] for label, repeated, outside, inner in shape for value in [next(values)]]


def _mass(items: list, without: tuple, differing: bool) -> int:
    """The characters of text outside boilerplate, or only of text that differs between pages."""
    return sum((x[4] if not differing or x[0] != "#" or not x[6] else 0) + _mass(x[5], without, differing) for x in items if not x[3] and x[0].split(" ")[0] not in without)


def descents(rows: Iterator[tuple]) -> Iterator[tuple[str, list]]:
    """Which elements hold the article of each host, first choice first: article and main, where the host has them,
    and at last the path to the element that the descent by three fifths or more of the other text outside
    boilerplate ends in. rows: (host, path, weight, article, main), sorted; those of a host begin with the page."""
    for host, level in groupby(rows, key=lambda r: r[0]):
        _, path, total, article, main = next(level)
        for _, here, weight, *_ in level:
            if here[:-1] == path and 10 * weight >= 6 * total and here[-1].split(" ")[0] not in ("p", "li", "td"):
                path, total = here, weight
        yield host, [*(t for t, has in (("article", article), ("main", main)) if has), path]


def _within(page: Node, hit: Callable[[Node, list[str]], bool] | None, header: bool = False, teasers: bool = True) -> str:
    """The text outside boilerplate in the elements that hit names by node and path, or in all for None.
    Headers in there count, those of the whole page only if header says so; teasers only if teasers does."""
    blocks: list[str] = []

    def walk(node: Node, path: list[str], inside: bool) -> None:
        for c in node.children:
            if c.label == "#":
                if inside and (words := slot_text(c)):
                    blocks.append(words)
            elif not teasers and points_on(c):
                continue
            elif not c.outside or (inside and c.tag == "header" and (header or node.tag not in ("", "html", "body"))):
                here = [*path, c.label]
                walk(c, here, inside or hit(c, here))

    walk(page, [], hit is None)
    return "\n".join(blocks)


def points_on(node: Node) -> bool:
    """Whether an article is a teaser of another one: so it is named, or most of its text is links."""
    if node.tag != "article":
        return False
    linked = total = 0
    todo = [node]
    while todo:
        n = todo.pop()
        if n.label == "#":
            linked, total = linked + n.linked, total + sum(len(x.strip()) for x in n.text)
        elif not n.outside:
            todo += n.children
    return node.teaser or 2 * linked > total


def _in_order(some: list[str], others: list[str]) -> bool:
    """Whether others has all of some in order, and the same end."""
    rest = iter(others)
    return some[-1] == others[-1] and all(x in rest for x in some)


def read(source: str | None, roots: list) -> str:
    """The article text of a page: what the first of its host's roots that holds text in this page holds.

    Of several articles those that only point to others don't count, if any other has text. A page that has no
    root is read from the nearest thing to the path, the longest beginning of it first, with elements more or
    fewer around, that holds three fifths of the text outside boilerplate, and else as a whole; but bare
    paragraphs alone are no article on a host that has article or main.
    """
    page = parse(source)
    *tags, path = roots
    for tag in tags:
        hit = lambda c, _, tag=tag: c.tag == tag
        if words := _within(page, hit, True, teasers=False) or _within(page, hit, True):
            return words
    if not tags and (words := _within(page, (lambda _, here: here == path) if path else None, True)):
        return words
    whole = _within(page, None)
    for n in range(len(path), 0, -1):
        part = path[:n]
        for hit in (lambda _, here, part=part: here == part, lambda _, here, part=part: _in_order(part, here) or _in_order(here, part)):
            words = _within(page, hit)
            if words and 10 * len(words) >= 6 * len(whole):
                return words
    if tags and {c.tag for c in page.children if not c.outside and (c.label != "#" or slot_text(c))} == {"p"}:
        return ""
    return whole


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _added(a: tuple, b: tuple) -> tuple:
    """Two sums (characters, values) of one shape; the order doesn't matter."""
    return [x + y for x, y in zip(a[0], b[0], strict=True)], [x if x == y else 0 for x, y in zip(a[1], b[1], strict=True)]


def infer(pages: DataFrame) -> DataFrame:
    """(host, roots) from all pages (host, html). Tasks sum up the shapes of their pages and cut them into places, then
    equal streams of a place meet and are aligned in groups of FAN or so, the groups in groups again until one is
    left: a task holds the shapes of its own pages, or the few expressions of a group. Where articles are is told by
    sums over places. A host's result depends on its rows alone, and groups don't change it."""
    dump = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple] = {}

        def out() -> pa.RecordBatch:
            rows: dict[tuple, tuple] = {}
            for (host, shape), (counts, values) in found.items():
                for path, items in places(_filled(json.loads(shape), iter(counts), iter(values))).items():
                    if _told(path, items):
                        c: list = []
                        v: list = []
                        key = host, path, dump(_shape(items, c, v))
                        rows[key] = _added(rows[key], (c, v)) if key in rows else (c, v)
            kinds = [pa.string(), pa.list_(pa.string()), pa.string(), *[pa.list_(pa.int64())] * 2]
            cols = zip(*((*key, *sums) for key, sums in rows.items()), strict=True) if rows else [[]] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "path", "shape", "counts", "values"])
            found.clear()
            return batch

        for host, source in _rows(batches):
            counts: list = []
            values: list = []
            key = host, dump(_shape(expression(parse(source)), counts, values))
            found[key] = _added(found[key], (counts, values)) if key in found else (counts, values)
            if len(found) >= 10_000:
                yield out()
        yield out()

    def grouped(batches: Iterator[pa.RecordBatch], one: Callable[[Iterator[tuple]], Iterator[tuple[int, list]]]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.string()]
        for (host, path, g), rows in groupby(_rows(batches), key=lambda r: r[:3]):
            cols = [host], [path], [g], [dump(aligned(one(r[3:] for r in rows)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "path", "g", "wrapper"])

    def of_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(rows: Iterator[tuple]) -> Iterator[tuple[int, list]]:
            for (h, shape), same in groupby(rows, key=lambda r: r[:2]):
                c, v = reduce(_added, (r[2:] for r in same))
                yield h, _filled(json.loads(shape), iter(c), iter(v))

        return grouped(batches, one)

    def of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return grouped(batches, lambda rows: ((g, json.loads(wrapper)) for g, wrapper in rows))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = [[x for x in json.loads(w) if x[0] == "#"] for w in b.column(2).to_pylist()]
            every, differing = ([sum(x[4] for x in s if not d or not x[6]) for s in slots] for d in (False, True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(every, pa.int64()), pa.array(differing, pa.int64())], ["host", "path", "every", "differing"])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, found in descents(_rows(batches)):
            yield pa.RecordBatch.from_pydict({"host": [host], "roots": [dump(found)]})

    streams = written(pages.select("host", "html").mapInArrow(own, "host string, path array<string>, shape string, counts array<long>, values array<long>"), "shapes")
    streams = streams.withColumn("h", F.shiftrightunsigned(F.xxhash64("shape"), 1))
    most = streams.groupBy("host", "path").agg(F.count_distinct("h").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, step = max(0, -(-most // FAN) - 1).bit_length(), max(1, FAN.bit_length() - 1)
    out = streams.select("host", "path", F.shiftright("h", 63 - bits).alias("g"), "h", "shape", "counts", "values").repartition("host", "path", "g").sortWithinPartitions("host", "path", "h", "shape")
    kinds = "host string, path array<string>, g long, wrapper string"
    out = out.mapInArrow(of_shapes, kinds)
    while bits:
        less = min(bits, step)
        bits -= less
        out = out.select("host", "path", F.shiftright("g", less).alias("into"), "g", "wrapper").repartition("host", "path", "into").sortWithinPartitions("host", "path", "g")
        out = out.mapInArrow(of_groups, kinds)
    out = out.select("host", "path", "wrapper").mapInArrow(sums, "host string, path array<string>, every long, differing long")
    # each place adds to all that it lies in; text inside of article and main doesn't count, as the host has these tags
    of_tag = lambda tag: F.exists("path", lambda x: F.substring_index(x, " ", 1) == tag)
    out = out.withColumn("article", of_tag("article")).withColumn("main", of_tag("main"))
    inside, page = F.col("article") | F.col("main"), F.array().cast("array<string>")
    above = F.when(inside, F.array(page)).otherwise(F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", F.lit(1), k)))
    out = out.select("host", F.explode(above).alias("path"), *(F.when(inside, 0).otherwise(F.col(c)).alias(c) for c in ("every", "differing")), "article", "main")
    out = written(out.groupBy("host", "path").agg(F.sum("every").alias("every"), F.sum("differing").alias("differing"), F.max("article").alias("article"), F.max("main").alias("main")), "places")
    whole = out.where(F.size("path") == 0).select("host", (F.col("differing") > 0).alias("differs"), F.greatest(F.lit(1), F.when(F.col("differing") > 0, F.col("differing")).otherwise(F.col("every"))).alias("total"))
    out = out.join(whole, "host").withColumn("weight", F.when(F.col("differs"), F.col("differing")).otherwise(F.col("every")))
    # each step of the descent keeps three fifths at least, so places with less than all steps would leave are off it
    out = out.where((F.size("path") == 0) | (F.col("weight") >= F.col("total") * F.pow(F.lit(0.599), F.size("path"))))
    out = out.select("host", "path", "weight", "article", "main").repartition("host").sortWithinPartitions("host", "path")
    return out.mapInArrow(roots, "host string, roots string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text): a row for each row of pages, from its whole html.

    Null or empty html and pages without article text: empty text, 0. Null urls, and urls without a host,
    share one wrapper. Where the host's roots hold nothing in a page, its other text outside boilerplate
    counts. Nothing in an article goes for being equal on other pages. Null page_id and repeated rows: kept. Ties
    don't occur: shapes are aligned in the order of their hashes, then texts. Very long pages take time in proportion; elements
    nested deeper than DEEP are read at that depth. Other columns, clashing names among them, are ignored; an
    empty table gives an empty result. Host tables are joined by size: a small one is broadcast, a large one
    makes Spark split hot hosts.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    p = p.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))
    wrappers = written(infer(p), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for b in batches:
            texts = []
            for source, roots in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                if roots not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[roots] = json.loads(roots)
                texts.append(read(source.as_py(), known[roots]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = p.join(wrappers, "host").select("page_id", "url", "html", "roots").mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each row of pages; null and empty html, null page_id and url, very long and deep pages, repeated
    rows, ties, clashing columns and empty tables as main_text states."""
    return main_text(table(spark, sf_dir, "pages"))
