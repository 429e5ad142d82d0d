"""Page structure and visual changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actionline.operators.membership import not_in
from actionline.sources.shared import stored

#: Elements that a user can act on, input types among them, roles, parts of class names.
TAGS = frozenset(("button", "a", "select", "textarea", "label"))
INPUTS = frozenset("button submit reset radio checkbox range file color date time month week email tel password text search number url".split())
ROLES, CLASSES = frozenset(("button", "link", "menuitem", "tab")), ("cursor-pointer", "btn", "button")
#: Fixed values: (zone, tag, parts of id or class); the first that fits counts.
ZONES = (("header", "header", ("header",)), ("footer", "footer", ("footer",)), ("nav", "nav", ("nav",)), ("sidebar", "aside", ("sidebar",)), ("modal", "dialog", ("modal", "dialog")), ("main", "main", ("main",)), ("form", "form", ("form",)))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Input types that hold no typed text.
UNTYPED = frozenset("button submit reset radio checkbox range file color hidden image".split())
NODES = (
    "page_id long, node_id int, parent_id int, depth int, tag string, attrs map<string,string>, text string, zone string, can_interact boolean, "
    "input_value string, options array<struct<value:string,text:string,selected:boolean>>, address string"
)


def _tree(source: str) -> tuple[dict, list[str]]:
    """The root of a page's elements, and all its texts; an element's own are those from its first to its last."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.texts: list[str] = []
            self.root = {"tag": "", "attrs": {}, "children": [], "first": 0, "last": None}
            self.stack, self.skip = [self.root], 0
            self.open: dict[str, int] = {}

        def cut(self, i: int) -> None:
            for n in self.stack[i:]:
                n["last"] = len(self.texts)
                self.open[n["tag"]] -= 1
            del self.stack[i:]

        def handle_starttag(self, tag, attrs):
            if tag == "script":
                self.skip += 1
                return
            if tag in ("p", "li", "option") and self.stack[-1]["tag"] == tag:
                self.cut(len(self.stack) - 1)
            node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "children": [], "first": len(self.texts), "last": len(self.texts)}
            self.stack[-1]["children"].append(node)
            if tag not in VOID:
                self.stack.append(node)
                self.open[tag] = self.open.get(tag, 0) + 1

        def handle_endtag(self, tag):
            if tag == "script":
                self.skip = max(0, self.skip - 1)
            elif self.open.get(tag):
                self.cut(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i]["tag"] == tag))

        def handle_data(self, data):
            if not self.skip:
                self.texts.append(data)

    t, end = Tree(), source.rfind(">") + 1
    t.feed(source[:end])
    t.close()
    t.handle_data(source[end:])  # where no tag ends any more, all is text
    t.cut(1)
    t.root["last"] = len(t.texts)
    return t.root, t.texts


def _interactive(n: dict) -> bool:
    a = n["attrs"]
    if n["tag"] in TAGS or n["tag"] == "input" and (a.get("type") or "text").lower() in INPUTS:
        return True
    return any(c in a.get("class", "").lower() for c in CLASSES) or a.get("role") in ROLES or "onclick" in a


def _page(source: str) -> list[tuple]:
    root, texts = _tree(source)
    body, found = root, [root]
    while found:  # the body element, if there is one
        n = found.pop()
        if n["tag"] == "body":
            body = n
            break
        found += n["children"]
    words = lambda n: " ".join("".join(texts[n["first"] : n["last"]]).split())
    rows: list[list] = []

    def listed(n: dict) -> list[tuple]:
        """The options of a select box: value (its text where there is none), text, and whether it is chosen."""
        out, todo = [], [n]
        while todo:
            c = todo.pop()
            todo += reversed(c["children"])
            if c["tag"] == "option":
                out.append((c["attrs"].get("value", words(c)), words(c), "selected" in c["attrs"]))
        return out

    def row(n: dict, zone: str, depth: int, keep: bool) -> list:
        a, tag = n["attrs"], n["tag"]
        if not keep:
            return [len(rows), None, depth, tag.upper(), a, None, None, False, None, None, None]
        free = "hidden" not in a and "disabled" not in a
        typed = a.get("value", "") if tag == "input" and (a.get("type") or "text").lower() not in UNTYPED else "".join(texts[n["first"] : n["last"]]) if tag == "textarea" else None
        return [len(rows), None, depth, tag.upper(), a, words(n), zone, free, typed, listed(n) if tag == "select" else None, zone + "--"]

    # down the page, then up: an element gets its number after those in it
    todo: list[tuple] = [(body, "body", 0, None)]
    above: list[list[int]] = []
    while todo:
        n, zone, depth, keep = todo.pop()
        if keep is None:
            names = f"{n['attrs'].get('id', '')} {n['attrs'].get('class', '')}".lower()
            zone = next((z for z, tag, parts in ZONES if n["tag"] == tag or any(p in names for p in parts)), zone)
            todo.append((n, zone, depth, _interactive(n)))
            above.append([])
            todo += [(c, zone, depth + 1, None) for c in reversed(n["children"])]
            continue
        children = above.pop()
        if keep or children:
            rows.append(row(n, zone, depth, keep))
            for c in children:
                rows[c][1] = len(rows) - 1
            if above:
                above[-1].append(len(rows) - 1)
    return rows


def page_nodes(pages: DataFrame) -> DataFrame:
    """The flat node table of each page: interactive elements and what holds them, numbered post-order.

    Scripts are left out; zones go down to what has none itself. input_value is what a text field holds at
    first, options what a select box offers. Without a browser an element can be acted on unless it is hidden
    or disabled, and an address is the zone without coordinates. Deep and long pages take time in proportion,
    but for the texts of interactive elements in each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "node_id", "parent_id", "depth", "tag", "attrs", "text", "zone", "can_interact", "input_value", "options", "address"]
        option = pa.struct([("value", pa.string()), ("text", pa.string()), ("selected", pa.bool_())])
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(option), pa.string()]
        for b in batches:
            rows = [(i, *r) for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True) for r in _page(x.as_py() or "")]
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names]
            cols[5] = [list(a.items()) for a in cols[5]]
            cols[10] = [None if o is None else [dict(zip(("value", "text", "selected"), x, strict=True)) for x in o] for o in cols[10]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, NODES)


def nodes_by_tag(nodes: DataFrame, *tags: str) -> DataFrame:
    """Nodes with one of the tags, in any case."""
    return nodes.where(F.lower("tag").isin([t.lower() for t in tags]))


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes named by (page_id, node_id)."""
    return nodes.join(ids.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi")


def options_of(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, pos, value, text of the options of page_nodes' select boxes."""
    return nodes.select("page_id", "node_id", F.posexplode("options").alias("pos", "o")).select("page_id", "node_id", "pos", "o.value", "o.text")


def select_values(options: DataFrame) -> DataFrame:
    """The values of each select box in order; an empty value gives its text. options: page_id, node_id, pos, value, text."""
    value = F.coalesce(F.when(F.col("value") != "", F.col("value")), F.col("text"))
    listed = F.sort_array(F.collect_list(F.struct("pos", value.alias("v"))))
    return options.groupBy("page_id", "node_id").agg(F.transform(listed, lambda x: x["v"]).alias("values"))


def can_operate(nodes: DataFrame) -> DataFrame:
    """Per page whether it has a form element and whether it has something to click."""
    tag = F.lower("tag")
    return nodes.groupBy("page_id").agg(F.bool_or(tag.isin("input", "textarea", "select")).alias("has_form"), F.bool_or(tag.isin("a", "button")).alias("has_click"))


def distinct_clickables(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """Of a page's buttons and links that can be acted on, the first of each text; those without text
    are told apart by their attributes. nodes: page_id, order, tag, text, attrs, can_interact."""
    attrs = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attrs"))))
    text = F.trim(F.coalesce("text", F.lit("")))
    key = F.when(text != "", F.concat(F.lit("t:"), text)).otherwise(F.concat(F.lit("a:"), F.coalesce(attrs, F.lit(""))))
    kind = F.lower("tag")
    button = kind.isin("button", "a") | ((kind == "input") & F.lower(F.coalesce(F.col("attrs")["type"], F.lit(""))).isin("button", "submit"))
    w = Window.partitionBy("page_id", "__key").orderBy(order)
    out = nodes.where(button & F.coalesce("can_interact", F.lit(True))).withColumn("__key", key)
    return out.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__key")


def state_hash(nodes: DataFrame, order: str = "node_id", *fields: str) -> DataFrame:
    """One md5 for each page over its nodes in order."""
    listed = F.sort_array(F.collect_list(F.struct(order, *fields)))
    return nodes.groupBy("page_id").agg(F.md5(F.to_json(listed).cast("binary")).alias("state"))


def dedup_states(states: DataFrame, seen: DataFrame | None = None, large: bool = False) -> DataFrame:
    """The first page of each state, without those of states seen before. large: for seen states that no
    task can hold; states that are surely new are not shuffled again."""
    w = Window.partitionBy("state").orderBy("page_id")
    out = states.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    if seen is None:
        return out
    return not_in(out, seen, "state") if large else out.join(seen.select("state"), "state", "left_anti")


def rematch(actions: DataFrame, nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """X11: page_id, old_id, new_id for actions on nodes that a page no longer has.

    actions: page_id, node_id, text, tag. The first node of equal text and tag is taken, else the first of
    equal text; without any, new_id is null."""
    a = actions.join(nodes.select("page_id", "node_id"), ["page_id", "node_id"], "left_anti")
    both = nodes.groupBy("page_id", "text", "tag").agg(F.min(order).alias("same_tag"))
    text = both.groupBy("page_id", "text").agg(F.min("same_tag").alias("same_text"))
    out = a.join(both, ["page_id", "text", "tag"], "left").join(text, ["page_id", "text"], "left")
    return out.select("page_id", F.col("node_id").alias("old_id"), F.coalesce("same_tag", "same_text").alias("new_id"))


#: Elements of a text in a stripe from which on the stripe is cut by the other measures too.
CROWD = 2000


def visual_changes(old: DataFrame, new: DataFrame, tolerance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Elements of new (page_id, el, text, tag, x, y, w, h) that no element of old matches.

    A match has the same text and tag and lies within ``tolerance`` in every measure. The band on y stays an
    equality join: old places go under their stripe and both neighbours. A first count tells the stripes in
    which one text has more than ``crowd`` elements; these are cut by x, w and h as well, so at most
    (4 * tolerance + 1) ** 4 old places ever meet in a cell, however often a text is repeated. Null measures
    match nothing."""
    width = 4 * tolerance + 1
    keys, sides, spot = ["page_id", "text", "tag"], [-1, 0, 1], ["x", "y", "w", "h"]
    stripe = lambda c: F.floor(F.col(c) / width)
    o = old.select(*keys, *spot).withColumn("stripe", F.explode(F.array(*[stripe("y") + k for k in sides])))
    n = new.withColumn("stripe", stripe("y"))
    count = o.select(*keys, "stripe", F.lit(1).alias("o"), F.lit(0).alias("n")).union(n.select(*keys, "stripe", F.lit(0), F.lit(1))).groupBy(*keys, "stripe").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    full = stored(count.where(F.greatest("o", "n") > crowd).select(*[F.col(c).alias(f"__{c}") for c in [*keys, "stripe"]]), "crowds")
    n_full = full.count()

    def celled(d: DataFrame, around: bool) -> DataFrame:
        if not n_full:
            return d.withColumn("cell", F.lit(""))
        f = F.broadcast(full) if n_full <= 100_000 else full
        d = d.join(f.withColumn("__crowded", F.lit(True)), [d[c].eqNullSafe(f[f"__{c}"]) for c in [*keys, "stripe"]], "left")
        at = [stripe(c) for c in ("x", "w", "h")]
        cells = [F.concat_ws(",", at[0] + a, at[1] + b, at[2] + c) for a in sides for b in sides for c in sides] if around else [F.concat_ws(",", *at)]
        d = d.withColumn("cell", F.explode(F.when(F.col("__crowded"), F.array(*cells)).otherwise(F.array(F.lit("")))))
        return d.drop("__crowded", *[f"__{c}" for c in [*keys, "stripe"]])

    o = celled(o.distinct() if n_full else o, True).select(*[F.col(c).alias(f"o_{c}") for c in [*keys, "stripe", "cell", *spot]])
    n = celled(n, False)
    cond = (n["page_id"] == o["o_page_id"]) & n["text"].eqNullSafe(o["o_text"]) & n["tag"].eqNullSafe(o["o_tag"]) & (n["stripe"] == o["o_stripe"])
    if n_full:
        cond = cond & (n["cell"] == o["o_cell"])
    for c in spot:
        cond = cond & (F.abs(n[c] - o[f"o_{c}"]) <= tolerance)
    return n.join(o, cond, "left_anti").drop("stripe", "cell")


def change_clusters(changes: DataFrame, viewport: int = 720, margin: int = 100) -> DataFrame:
    """Changes outside the viewport, in clusters down the page: page_id, cluster, n, top, bottom, centre, scroll_to.

    A new cluster begins half a viewport or more below the bottom of the change before it."""
    out = changes.where((F.col("y") + F.col("h") < -margin) | (F.col("y") > viewport + margin))
    w = Window.partitionBy("page_id").orderBy("y", "el")
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(w)
    out = out.withColumn("cluster", F.sum(F.coalesce(gap >= viewport / 2, F.lit(False)).cast("int")).over(w))
    g = out.groupBy("page_id", "cluster").agg(F.count("*").alias("n"), F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    centre = (F.col("top") + F.col("bottom")) / 2
    return g.withColumn("centre", centre).withColumn("scroll_to", F.greatest(F.lit(0.0), F.col("centre") - viewport / 2))
