"""Main text of web pages by wrapper induction (operator 2).

A page becomes a tree of its block elements; neighbours of one kind are one repeating node. Trees of a
host that look alike are one layout, whose reference is its most frequent tree; a host has as many as it
takes until every tree is like one. Every distinct tree
of the host is aligned with its nearest reference by simple tree matching, so that each block of each
page belongs to a slot of the reference, and every slot is judged by all distinct pages of the layout:
a text that stands there on nearly all of them is template; text in links is navigation; what varies is
content, and the content of a layout lies in the innermost element that holds the varying prose while
what stands beside it is template, links, or a line or two of its own. Names of elements and
classes decide only where a layout has fewer than ``FEWEST`` distinct pages or shows no such element;
besides, they take forms, comments and the like out of the content, and widen it to an article or
main element around it.

Every distinct page of a host takes part in the counts: blocks are counted by host, tree, slot and
text, combined before they are shuffled; a host's trees, not its pages, meet its references.

Defined results: null or empty html gives an empty text; a null url is a host of its own; equal pages
of a host count once; where all texts of a layout of fewer than ``FEWEST_INSIDE`` pages are alike,
they are no template; elements nested deeper than ``MAX_DEPTH`` count as siblings; repeated rows
each get their row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import json
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import map_batches, schema_with, settle

#: Kinds of elements by name.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template textarea title iframe svg select option button object audio video canvas math".split())
DROPPED = frozenset("nav footer aside form menu dialog fieldset head".split())
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments respond replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager toolbar search toc".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
MAIN = frozenset(["article", "main"])
#: Elements that stand for a part of the page, besides those of names of one's own (with a hyphen):
#: neighbours of one kind stay apart.
PARTS = frozenset("div section article main aside header footer nav form details figure fieldset address center".split())
#: An element of the left ends open elements of the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl td th body article main section div".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
MAX_DEPTH = 60
#: So many neighbours of the same shape that stand for parts are a repeating node after all.
RUN = 5
#: A text is template if it stands in its slot on this share of so many distinct pages of the layout;
#: inside the element that holds the content, of so many.
SAME_SHARE, FEWEST, FEWEST_INSIDE = 0.9, 3, 20
#: Trees of a host that its references are first chosen from, and references in a row; how many it gives
#: at once of those that are like none so far; how alike trees of one layout are.
TREES, MOST_TREES, ALIKE = 64, 1024, 0.5
#: Beside the content stand slots of at most so many letters in so many blocks a page, or elements
#: with at most this share of it; a slot whose text is in links to this share is navigation.
SHORT, FEW_BLOCKS, BESIDE, LINKED = 200, 2, 0.2, 0.6
#: Cells of an alignment that are held at once.
CELLS = 1 << 22
#: Flags of a block: dropped by a name, inside an article or main element, the first of its text on its page.
DROP, INSIDE, FIRST = 1, 2, 4


class Node:
    __slots__ = ("label", "kids", "texts", "main", "dropped")

    def __init__(self, label: str, main: bool, dropped: bool):
        self.label, self.main, self.dropped = label, main, dropped
        self.kids: list[Node] = []
        self.texts: list[int] = []  # places in the page's list of blocks


def marked(attributes: str) -> tuple[str, bool]:
    """The first class, and whether class, id or role tell of what is not main text."""
    first, dropped = "", False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "class":
            first = re.sub(r"\d+", "0", (value.split() or [""])[0])
        words = WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
        dropped = dropped or any(w in (DROPPED_ROLES if name == "role" else DROPPED_WORDS) for w in words)
    return first, dropped


def parse(html: str) -> tuple[Node, list[str], list[int]]:
    """The tree of block elements, the page's blocks of text, and how much of each is in links."""
    root = Node("#", False, False)
    stack, names, opened = [root], ["#"], Counter()
    blocks: list[str] = []
    links: list[int] = []
    piece: list[str] = []
    linked = inside = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(references.unescape("".join(piece)).split())
        piece.clear()
        if text:
            stack[-1].texts.append(len(blocks))
            blocks.append(text)
            links.append(min(linked, len(text)))
        linked = 0

    def close(depth: int) -> None:
        for name in names[depth:]:
            opened[name] -= 1
        del names[depth:], stack[depth:]

    at, last = 0, html.rfind(">") + 1
    while True:
        m = TOKEN.search(html, at) if at < last or html.startswith("<!--", at) else None
        text = html[at : m.start() if m else len(html)]
        piece.append(text)
        if inside:
            linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        block = name in BLOCKS or "-" in name
        if m[1]:
            if name == "a":
                inside = 0
            if not block:
                continue
            if opened[name]:
                flush()
                depth = len(names) - 1
                while names[depth] != name:
                    depth -= 1
                close(depth)
                inside = 0
            elif name == "p":
                flush()
            continue
        if name == "a":
            inside = 1
            continue
        if name in RAW or name == "head":
            if name == "head":  # what a head holds is no text; it ends with it, or where a body begins
                end = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(html, at)
            else:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if not m[3].endswith("/"):
                at = end.end() if end else len(html)
            if name in ("textarea", "button", "select"):
                piece.append(" ")
            continue
        if name == "br":
            piece.append(" ")
            continue
        if not block:
            continue
        flush()
        if name == "hr":
            continue
        if opened["p"] and names[-1] == "p":
            close(len(names) - 1)
        for k in range(len(names) - 1, 0, -1) if name in ENDS else ():
            if names[k] in ENDS[name]:
                close(k)
                break
            if names[k] in SCOPE and names[k] != name:
                break
        first, dropped = marked(m[3]) if m[3] else ("", False)
        up = stack[-1]
        main = up.main or name in MAIN or 'role="main"' in m[3]
        dropped = up.dropped or name in DROPPED or name == "header" and not up.main or (dropped and name not in ("html", "body", "article", "main"))
        node = Node(f"{name}.{first}" if first else name, main, dropped)
        stack[min(len(stack) - 1, MAX_DEPTH)].kids.append(node)
        stack.append(node)
        names.append(name)
        opened[name] += 1
    flush()
    return root, blocks, links


def shape(node: Node) -> str:
    return f"{node.label}!{node.dropped:d}({','.join(map(shape, node.kids))})"


def part(label: str) -> bool:
    name = label.split(".")[0]
    return name in PARTS or "-" in name


def merged(nodes: list[Node]) -> list[Node]:
    """Neighbours of one kind become one repeating node; those that stand for parts of the page only if
    they are many of one shape."""
    out: list[Node] = []
    for (label, dropped), run in groupby(nodes, key=lambda n: (n.label, n.dropped)):
        run = list(run)
        if not part(label):
            groups = [run]
        else:
            for node in run:
                node.kids = merged(node.kids)
            alike = [list(g) for _, g in groupby(run, key=shape)] if len(run) >= RUN else [[n] for n in run]
            groups = [g for some in alike for g in ([some] if len(some) >= RUN else [[n] for n in some])]
        for group in groups:
            first = group[0]
            for node in group[1:]:
                first.kids += node.kids
                first.texts += node.texts
            if len(group) > 1 or not part(label):
                first.kids = merged(first.kids)
            out.append(first)
    return out


def numbered(tree: list) -> list[list]:
    """The nodes of a tree of [label, kids] in page order; a node's number is its place."""
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node[1])
    return out


def read_page(html: str | None) -> tuple[list, list[str], list[int], list[int], list[int]]:
    """The tree as [label, kids]; of each block its text, letters in links, number of node, and flags."""
    root, blocks, links = parse(html or "")
    root.kids = merged(root.kids)
    slots, flags = [0] * len(blocks), [0] * len(blocks)
    stack, number, plain, seen = [(root, None)], 0, None, set()
    while stack:
        node, up = stack.pop()
        own = [node.label + "!" * node.dropped, []]
        if up is None:
            plain = own
        else:
            up[1].append(own)
        for i in node.texts:
            slots[i], flags[i] = number, DROP * node.dropped + INSIDE * node.main + FIRST * (blocks[i] not in seen)
            seen.add(blocks[i])
        number += 1
        stack += [(k, own) for k in reversed(node.kids)]
    return plain, blocks, links, slots, flags


class Shapes:
    """Trees by number of their shape; what equal shapes match is computed once."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.kids: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def add(self, tree: list) -> list[int]:
        """The shape of each node of the tree, by its number."""
        nodes = numbered(tree)
        found: dict[int, int] = {}
        for node in reversed(nodes):
            kids = tuple(found[id(k)] for k in node[1])
            key = (node[0], kids)
            if key not in self.ids:
                self.ids[key] = len(self.labels)
                self.labels.append(node[0])
                self.kids.append(np.array(kids, np.int64))
                self.sizes.append(1 + sum(self.sizes[k] for k in kids))
            found[id(node)] = self.ids[key]
        return [found[id(n)] for n in nodes]

    def weight(self, a: int, b: int) -> int:
        """Simple tree matching: most pairs of nodes with equal labels, in order and under paired parents."""
        if self.labels[a] != self.labels[b]:
            return 0
        if a == b:
            return self.sizes[a]
        if (a, b) not in self.known:
            x, y = self.kids[a], self.kids[b]
            head, tail = self.ends(x, y)
            even = sum(self.sizes[k] for k in [*x[:head], *x[len(x) - tail :]])
            self.known[a, b] = 1 + even + int(self.row(x[head : len(x) - tail], y[head : len(y) - tail])[-1])
        return self.known[a, b]

    @staticmethod
    def ends(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
        """How many equal shapes both lists begin and end with; pairing these is best in any case."""
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        head = int(differ[0]) if len(differ) else n
        differ = np.flatnonzero(x[len(x) - n + head :][::-1] != y[len(y) - n + head :][::-1])
        return head, int(differ[0]) if len(differ) else n - head

    def weights(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, at = np.unique(x, return_inverse=True)
        b, to = np.unique(y, return_inverse=True)
        return np.array([[self.weight(int(i), int(j)) for j in b] for i in a], np.int64).reshape(len(a), len(b)), at, to

    def row(self, x: np.ndarray, y: np.ndarray, every: bool = False) -> np.ndarray:
        """Best totals of x with each beginning of y; every: of each beginning of x, too."""
        best = np.zeros((len(x) + 1 if every else 1, len(y) + 1), np.int64)
        if len(x) and len(y):
            table, at, to = self.weights(x, y)
            now = best[0].copy()
            for i in range(len(x)):
                now[1:] = np.maximum(now[1:], now[:-1] + table[at[i], to])
                now = np.maximum.accumulate(now)
                if every:
                    best[i + 1] = now
            if not every:
                best[0] = now
        return best if every else best[0]

    def pairs(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """Places in x and y that a best pairing puts together."""
        out: list[tuple[int, int]] = []
        todo = [(0, len(x), 0, len(y))]
        while todo:
            a, b, c, d = todo.pop()
            head, tail = self.ends(x[a:b], y[c:d])
            out += [(a + i, c + i) for i in range(head)] + [(b - 1 - i, d - 1 - i) for i in range(tail)]
            a, b, c, d = a + head, b - tail, c + head, d - tail
            if a == b or c == d:
                continue
            if b - a > 1 and (b - a) * (d - c) > CELLS:  # halve x, where the two best rows say
                mid = (a + b) // 2
                both = self.row(x[a:mid], y[c:d]) + self.row(x[mid:b][::-1], y[c:d][::-1])[::-1]
                cut = c + int(both.argmax())
                todo += [(a, mid, c, cut), (mid, b, cut, d)]
                continue
            best, i, j = self.row(x[a:b], y[c:d], True), b - a, d - c
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j))
        return out


def spans(tree: list) -> list[list[int]]:
    """The numbers of each node's kids, by its own."""
    nodes = numbered(tree)
    place = {id(n): i for i, n in enumerate(nodes)}
    return [[place[id(k)] for k in n[1]] for n in nodes]


def aligned(shapes: Shapes, reference: list, page: list) -> list[int]:
    """For each node of the page the number of its node in the reference; one without a partner
    belongs to the partner of what it stands in."""
    ours, theirs = shapes.add(page), shapes.add(reference)
    kids, partners = spans(page), spans(reference)
    to = [0] * len(ours)
    todo = [(0, 0, ours[0] is not None and shapes.labels[ours[0]] == shapes.labels[theirs[0]])]
    while todo:
        node, partner, met = todo.pop()
        to[node] = partner
        if not met:
            todo += [(k, partner, False) for k in kids[node]]
            continue
        found = dict(shapes.pairs(np.array([ours[k] for k in kids[node]], np.int64), np.array([theirs[k] for k in partners[partner]], np.int64)))
        for i, k in enumerate(kids[node]):
            good = i in found and shapes.labels[ours[k]] == shapes.labels[theirs[partners[partner][found[i]]]]
            todo.append((k, partners[partner][found[i]], True) if good else (k, partner, False))
    return to


def alike(shapes: Shapes, a: list, b: list) -> float:
    x, y = shapes.add(a)[0], shapes.add(b)[0]
    return 2 * shapes.weight(x, y) / (shapes.sizes[x] + shapes.sizes[y])


def layouts(trees: list[list]) -> list[list]:
    """The references of a host: of its trees, most frequent first, those like none before."""
    shapes, chosen = Shapes(), []
    for tree in trees:
        if all(alike(shapes, tree, r) < ALIKE for r in chosen):
            chosen.append(tree)
    return chosen


def content_slots(tree: list, pages: int, slots: dict[int, dict]) -> tuple[list[int], bool, bool] | None:
    """The reference's slots with content, whether the names of the element that holds them are to be
    passed over, and whether it is the whole page. slots: by number, sums over the layout's distinct
    pages of blocks, letters, linked letters, and letters in template. None: names have to tell."""
    nodes, kids = numbered(tree), spans(tree)
    total = {i: s["chars"] - s["link"] for i, s in slots.items()}
    fixed = {i: min(s["same"], total[i]) for i, s in slots.items()}
    if pages < FEWEST_INSIDE and sum(fixed.values()) > sum(total.values()) / 2:
        fixed = dict.fromkeys(fixed, 0)  # pages alike but for their menus
    linked = {i for i, s in slots.items() if s["link"] >= LINKED * s["chars"]}
    own = {i: 0 if i in linked else (total[i] - fixed[i]) / pages for i in slots}
    blocks = {i: s["blocks"] / pages for i, s in slots.items()}
    weight, count, under = [0.0] * len(nodes), [0.0] * len(nodes), [False] * len(nodes)
    for i in reversed(range(len(nodes))):
        weight[i] = own.get(i, 0.0) + sum(weight[k] for k in kids[i])
        count[i] = blocks.get(i, 0.0) * (own.get(i, 0) > 0) + sum(count[k] for k in kids[i])
        under[i] = any(weight[k] > 0 for k in kids[i])
    if weight[0] <= 0:
        return None
    up = {k: i for i, some in enumerate(kids) for k in some}
    small = lambda letters, n: letters <= SHORT and n <= FEW_BLOCKS
    at = 0
    while True:
        inner = [k for k in kids[at] if under[k]]
        best = max(inner, key=lambda k: weight[k], default=None)
        if best is None or weight[best] < weight[at] / 2 or not small(own.get(at, 0.0), blocks.get(at, 0.0)):
            break
        if not all(small(weight[k], count[k]) or under[k] and weight[k] <= BESIDE * weight[best] for k in kids[at] if k != best):
            break
        at = best
    named = at
    while named and nodes[named][0].split(".")[0].rstrip("!") not in MAIN:
        named = up[named]
    if named:
        at = named
    inside, stack = [], [at]
    while stack:
        i = stack.pop()
        inside.append(i)
        stack += kids[i]
    if any(nodes[i][0].split(".")[0].rstrip("!") in MAIN for i in inside if i != at):
        return None
    dropped = nodes[at][0].endswith("!")
    keep = [i for i in inside if i not in linked and (dropped or not nodes[i][0].endswith("!"))]
    if not any(nodes[i][0].startswith("h1") for i in keep):  # a headline above
        keep += [i for i in slots if nodes[i][0].split(".")[0] == "h1" and i not in inside and own[i] > 0]
    return sorted(keep), dropped, nodes[at][0].split(".")[0].rstrip("!") in ("#", "html", "body")


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


BLOCK = "array<struct<slot: int, h: long, chars: int, link: int, flag: int>>"


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (digest of the html), skel (number of its tree), tree, named (whether an
    article or main element holds text that no other name drops), texts, blocks."""

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("page", "skel", "tree", "named", "texts")}
        edges, columns = [0], ([], [], [], [], [])
        for html in batch.column("html").to_pylist():
            tree, blocks, links, slots, flags = read_page(html)
            plain = json.dumps(tree, separators=(",", ":"), ensure_ascii=False)
            out["page"].append(xxhash.xxh3_128_digest((html or "").encode("utf-8", "replace")))
            out["skel"].append(np.uint64(xxhash.xxh3_64_intdigest(plain.encode("utf-8", "replace"))).astype(np.int64))
            out["tree"].append(plain.encode("utf-8", "replace").decode())
            out["named"].append(any(f & (DROP | INSIDE) == INSIDE for f in flags))
            out["texts"].append([x.encode("utf-8", "replace").decode() for x in blocks])
            columns[0].extend(slots)
            columns[1].extend(np.uint64(xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace"))).astype(np.int64) for x in blocks)
            columns[2].extend(map(len, blocks))
            columns[3].extend(links)
            columns[4].extend(flags)
            edges.append(len(columns[0]))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        inner = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["slot", "h", "chars", "link", "flag"])
        return {c: batch.column(c) for c in ("page_id", "url", "host")} | out | {"blocks": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), inner)}

    rows = pages.select("page_id", "url", host_of().alias("host"), "html")
    return settle(map_batches(rows, schema_with(rows, ["page_id", "url", "host"], f"page binary, skel long, tree string, named boolean, texts array<string>, blocks {BLOCK}"), each), "pages-read")


def choose_references(trees: DataFrame, many: int, fewest: int, chunk: int) -> DataFrame:
    """of, chunk and references: of the most frequent trees of each host, so many at most, those like none
    before, TREES in a row; rows of a host are numbered from chunk on. Hosts of fewer pages have none."""
    order = Window.partitionBy("host").orderBy(F.desc("pages"), "skel")
    top = trees.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= many)
    hosts = top.groupBy("host").agg(F.sum("pages").alias("pages"), F.array_sort(F.collect_list(F.struct("place", "tree"))).alias("trees")).filter(F.col("pages") >= fewest)

    def choose(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"of": [], "chunk": [], "references": []}
        for host, some in zip(batch.column("host").to_pylist(), batch.column("trees").to_pylist()):
            found = [json.dumps(t, separators=(",", ":"), ensure_ascii=False) for t in layouts([json.loads(t["tree"]) for t in some])]
            for at in range(0, len(found), TREES):
                out["of"].append(host)
                out["chunk"].append(chunk + at // TREES)
                out["references"].append(found[at : at + TREES])
        return out

    return settle(map_batches(hosts.select("host", "trees"), "of string, chunk int, references array<string>", choose), "page-references")


def align_trees(trees: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each tree with each row of its host's references: like, and ref and to of the nearest (null: like none)."""

    def align(batch: pa.RecordBatch) -> dict:
        known: dict[tuple[str, ...], tuple[Shapes, list[list]]] = {}
        near, ref, to = [], [], []
        for tree, chunk, some in zip(*(batch.column(c).to_pylist() for c in ("tree", "chunk", "references"))):
            if tuple(some) not in known:
                known[tuple(some)] = Shapes(), [json.loads(r) for r in some]
            shapes, held = known[tuple(some)]
            page = json.loads(tree)
            like = [alike(shapes, page, r) for r in held]
            best = int(np.argmax(like))
            near.append(like[best])
            ref.append(chunk * TREES + best if like[best] >= ALIKE else None)
            to.append(aligned(shapes, held[best], page) if like[best] >= ALIKE else None)
        return {c: batch.column(c) for c in ("host", "skel", "pages")} | {"like": near, "ref": ref, "to": to}

    met = trees.join(chosen, F.col("host") == F.col("of")).select("host", "skel", "pages", "tree", "chunk", "references")
    return settle(map_batches(met, "host string, skel long, pages long, like double, ref int, to array<int>", align), "trees-aligned")


def nearest_references(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references of all hosts, and each tree of a host of FEWEST pages with its nearest reference: host,
    skel, pages, ref and to. Trees like none of the references so far give more, until none is left: what
    taking all trees of a host in turn would choose."""
    chosen = choose_references(trees, TREES, FEWEST, 0)
    placed = align_trees(trees, chosen)
    rest, many, chunk = placed.filter("ref is null"), TREES, 1
    if not rest.isEmpty():
        left = trees
        while not rest.isEmpty():
            gone = rest.select(F.col("host").alias("of"), F.col("skel").alias("of_skel"))
            left = settle(left.join(gone, (F.col("host") == F.col("of")) & (F.col("skel") == F.col("of_skel")), "left_semi"), "trees-left")
            many = min(4 * many, MOST_TREES)
            more = choose_references(left, many, 1, chunk)
            chosen, chunk = chosen.unionByName(more), chunk + -(-many // TREES)
            rest = align_trees(left, more).filter("ref is null")
        chosen = settle(chosen, "page-references")
        best = F.max_by(F.struct("ref", "to"), F.struct("like", -F.col("ref"))).alias("best")  # of equals the first
        placed = align_trees(trees, chosen).filter("ref is not null").groupBy("host", "skel").agg(F.first("pages").alias("pages"), best)
        placed = settle(placed.select("host", "skel", "pages", "best.ref", "best.to"), "trees-placed")
    return chosen, placed


def induce_wrappers(read: DataFrame) -> DataFrame:
    """of, of_skel: a host and one of its trees; slots: the tree's nodes with content; template: hashes of
    the texts that are none; passed: whether names inside are to be passed over."""
    once = F.transform(F.filter("blocks", lambda b: b["flag"] >= FIRST), lambda b: F.struct(b["slot"].alias("slot"), b["h"].alias("h"), b["chars"].alias("chars"), b["link"].alias("link")))
    full = read.filter(F.size("blocks") > 0).select("host", "page", "skel", "tree", once.alias("blocks"))  # a text counts once a page
    distinct = full.groupBy("host", "page").agg(F.first("skel").alias("skel"), F.first("tree").alias("tree"), F.first("blocks").alias("blocks"))
    distinct = settle(distinct, "distinct-pages")
    trees = settle(distinct.groupBy("host", "skel").agg(F.count("*").alias("pages"), F.min("tree").alias("tree")), "page-trees")
    chosen, placed = nearest_references(trees)
    texts = distinct.select("host", "skel", F.explode("blocks").alias("b")).groupBy("host", "skel", "b.slot", "b.h").agg(F.count("*").alias("n"), F.first("b.chars").alias("chars"), F.first("b.link").alias("link"))
    own = placed.select(F.col("host").alias("of"), F.col("skel").alias("of_skel"), "ref", "to")
    slots = texts.join(own, (F.col("host") == F.col("of")) & (F.col("skel") == F.col("of_skel"))).select("host", "ref", F.col("to")[F.col("slot")].alias("slot"), "h", "n", "chars", "link")
    counted = slots.groupBy("host", "ref", "slot", "h").agg(F.sum("n").alias("n"), F.max("chars").alias("chars"), F.max("link").alias("link"))
    sizes = placed.groupBy(F.col("host").alias("of"), F.col("ref").alias("of_ref")).agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= FEWEST)
    judged = counted.join(sizes, (F.col("host") == F.col("of")) & (F.col("ref") == F.col("of_ref"))).drop("of", "of_ref")
    same = (F.col("n") >= FEWEST) & (F.col("n") >= SAME_SHARE * F.col("pages"))
    each = lambda c: F.sum(F.col("n") * F.col(c))
    sums = judged.groupBy("host", "ref", "pages", "slot").agg(F.sum("n").alias("blocks"), each("chars").alias("chars"), each("link").alias("link"), F.coalesce(F.sum(F.when(same, F.col("n") * (F.col("chars") - F.col("link")))), F.lit(0)).alias("same"), F.collect_list(F.when(same, F.col("h"))).alias("template"))
    told = sums.groupBy("host", "ref", "pages").agg(F.collect_list(F.struct("slot", "blocks", "chars", "link", "same", "template")).alias("slots"))  # a template holds what stands on nearly all pages: no more than a page
    here = (F.col("host") == F.col("of")) & (F.floor(F.col("ref") / TREES) == F.col("chunk"))
    told = told.join(chosen, here).select("host", "ref", "pages", "slots", F.col("references")[F.col("ref") % TREES].alias("tree"))

    def decide(batch: pa.RecordBatch) -> dict:
        out = {"keep": [], "passed": [], "template": []}
        for pages, some, tree in zip(*(batch.column(c).to_pylist() for c in ("pages", "slots", "tree"))):
            verdict = content_slots(json.loads(tree), pages, {s["slot"]: s for s in some})
            keep, passed, whole = verdict or (None, None, None)
            enough = verdict and pages >= (FEWEST if whole else FEWEST_INSIDE)
            out["keep"].append(keep)
            out["passed"].append(passed)
            out["template"].append(sorted({h for s in some for h in s["template"]}) if enough else [])
        return {"at": batch.column("host"), "at_ref": batch.column("ref")} | out

    decided = map_batches(told, "at string, at_ref int, keep array<int>, passed boolean, template array<long>", decide).filter("keep is not null")
    both = own.join(decided, (F.col("of") == F.col("at")) & (F.col("ref") == F.col("at_ref")))
    kept = F.transform(F.filter(F.transform("to", lambda s, i: F.struct(F.array_contains("keep", s).alias("good"), i.alias("i"))), lambda x: x["good"]), lambda x: x["i"])
    return settle(both.select("of", "of_skel", kept.alias("slots"), "template", "passed"), "wrappers")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    read = read_pages(pages)
    return page_texts(read, induce_wrappers(read))


def page_texts(read: DataFrame, wrappers: DataFrame) -> DataFrame:
    rows = read.join(wrappers, (F.col("host") == F.col("of")) & (F.col("skel") == F.col("of_skel")), "left")
    named = lambda b: b["flag"].bitwiseAND(DROP) == DROP
    main = lambda b: b["flag"].bitwiseAND(INSIDE) == INSIDE
    by_wrapper = lambda b: F.array_contains("slots", b["slot"]) & ~F.array_contains("template", b["h"]) & (F.col("passed") | ~named(b))
    by_name = lambda b: ~named(b) & (main(b) | ~F.col("named"))
    good = lambda b: F.when(F.col("slots").isNotNull(), by_wrapper(b)).otherwise(by_name(b))
    texts = F.transform(F.filter(F.arrays_zip("texts", "blocks"), lambda x: good(x["blocks"])), lambda x: x["texts"])
    out = rows.select("page_id", "url", F.array_join(texts, "\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
