"""Main text of pages by wrapper induction over the pages of a host.

Pages become trees of block elements; what is inline is part of its block's text. The structures of all
pages of a host that have blocks, each once, are merged into its frame, about ``FRAMES`` at a time and what that gives
again, the longest first: each is aligned with what came before by simple tree matching, and its nodes without
a partner are added where they stand.
Per node of a structure are summed, while pages are read for it, the pages, the words and whether the text was the same
throughout; every structure is then aligned with its host's frame, in any number of tasks, and its sums go to the frame's nodes. Nodes of one text are the
template, others slots; words of blocks without a partner count for the slot around them. The wrapper is
the smallest container that holds most words of slots, and a page's main text is its node there, without
elements that are never content. Constant blocks inside are left out if they are not paragraphs,
headings or list items: those may repeat because articles do. A page that does not fit its host's wrapper,
or whose host is unknown, gives its article or main element, else its body.
"""

from __future__ import annotations

import html
import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Cut, checked_broadcast, column, map_batches, scratch
from .url_filter import host_path

#: Name of a tag; the rest of a tag, in which a quoted value may hold anything; elements whose content is no markup.
TAG, REST = re.compile(r"[a-zA-Z][^\s/>]*+"), re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+""")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style noscript template textarea iframe svg title".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption caption summary address".split())
CONTAINERS = frozenset("html body div article main section ul ol dl table thead tbody tfoot tr figure details center form fieldset nav header footer aside menu dialog head hgroup search select button option".split())
BLOCKS = LEAVES | CONTAINERS
NEVER = frozenset("head nav header footer aside menu dialog form select button option search fieldset".split())
#: Elements with one of these as a whole class or id are no content; names that only contain one are.
NEVER_NAMED = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent cookie-notice cookie-banner notice notices newsletter subscribe comment comments comment-list reader-comments disqus respond sidebar breadcrumb breadcrumbs pagination share social menu nav navbar footer header popup modal widget".split())
NAME = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that a start tag closes if they are open, as the HTML standard has it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Structures that are merged at a time, about, into those of a host's frame; elements below this depth stand beside one another, as in browsers.
FRAMES, DEPTH = 8, 512
#: Cells of a table by which children are matched; larger ones are halved, with the same result.
CELLS = 4_000_000
#: Nodes of structures, with their sums, that a task holds before it passes them on.
HELD_NODES = 300_000
#: Share of the slots' words that a container must hold; pages that a constant must be on.
HELD, CONSTANT_PAGES = 0.8, 5


class Node:
    __slots__ = ("tag", "label", "never", "items", "kids", "index", "shape", "size")

    def __init__(self, tag: str, attributes: str = ""):
        names = " ".join(a or b or c for a, b, c in NAME.findall(attributes)).lower().split() if attributes else ()
        self.tag, self.label = tag, f"{tag}.{names[0]}" if names else tag
        self.never = tag in NEVER or any(n in NEVER_NAMED for n in names)
        self.items: list[str | Node] = []
        self.kids: list[Node] = []
        self.index, self.shape, self.size = -1, 0, 1

    def own(self) -> str:
        return " ".join("".join(x if isinstance(x, str) else " " for x in self.items).split())


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of what a page of any quality holds: text, start and end tags."""
    at = 0
    while at < len(page):
        i = page.find("<", at)
        if i < 0:
            i = len(page)
        if i > at:
            yield "text", page[at:i], ""
        if i == len(page):
            return
        if page.startswith("<!--", i):
            end = page.find("-->", i + 2)
            at = len(page) if end < 0 else end + 3
        elif m := TAG.match(page, i + 1 + page.startswith("/", i + 1)):
            rest = REST.match(page, m.end())
            at = rest.end() + 1
            if at > len(page):  # the page ends within the tag
                return
            tag = m[0].lower()
            if page[i + 1] == "/":
                yield "end", tag, ""
            elif tag in RAW:
                end = RAW[tag].search(page, at)
                at = len(page) if end is None else page.find(">", end.end()) + 1 or len(page)
            else:
                yield "start", tag, rest[0]
        elif page[i + 1 : i + 2] in ("!", "?", "/"):
            at = page.find(">", i) + 1 or len(page)
        else:  # no markup
            yield "text", "<", ""
            at = i + 1


def tree(page: str) -> Node:
    """The tree of block elements of a page of any quality."""
    root = Node("html")
    path, opened = [root], Counter()

    def close(n: int) -> None:
        for x in path[n:]:
            opened[x.tag] -= 1
        del path[n:]

    heading = lambda t: len(t) == 2 and t[0] == "h" and t[1].isdigit()
    for kind, tag, attributes in tokens(page):
        if kind == "text":
            path[-1].items.append(html.unescape(tag))
        elif tag in ("br", "hr"):
            path[-1].items.append(" ")
        elif tag not in BLOCKS:
            continue
        elif kind == "end":
            if opened[tag]:
                close(next(i for i in range(len(path) - 1, 0, -1) if path[i].tag == tag))
        elif tag not in ("html", "body") or len(path) == 1 and tag == "body":
            if path[-1].tag == "p" or heading(path[-1].tag) and heading(tag):
                close(len(path) - 1)
            if any(opened[t] for t in CLOSES.get(tag, ())):
                for i in range(len(path) - 1, 0, -1):
                    if path[i].tag in CLOSES[tag]:
                        close(i)
                        break
                    if path[i].tag in ("ul", "ol", "dl", "table"):
                        break
            if len(path) > DEPTH:
                close(DEPTH)
            node = Node(tag, attributes)
            path[-1].items.append(node)
            path[-1].kids.append(node)
            path.append(node)
            opened[tag] += 1
    return numbered(root)


def numbered(root: Node) -> Node:
    """The tree with numbers in order; equal shapes are subtrees of equal labels."""
    nodes = list(preorder(root))
    for i, n in enumerate(nodes):
        n.index = i
    for n in reversed(nodes):
        n.shape, n.size = hash((n.label, *(k.shape for k in n.kids))), 1 + sum(k.size for k in n.kids)
    return root


def preorder(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack += reversed(n.kids)


def skeleton(root: Node) -> str:
    """Labels, and the number of each node's parent, in order."""
    nodes = list(preorder(root))
    parent = {k.index: n.index for n in nodes for k in n.kids}
    return json.dumps([[n.tag, n.label, n.never, parent.get(n.index, -1)] for n in nodes])


def framed(text: str) -> Node:
    rows = json.loads(text)
    nodes = []
    for i, (tag, label, never, parent) in enumerate(rows):
        n = Node(tag)
        n.label, n.never, n.index = label, never, i
        nodes.append(n)
        if parent >= 0:
            nodes[parent].kids.append(n)
    return numbered(nodes[0])


def weights(x: list[Node], y: list[Node], known: dict) -> np.ndarray:
    """Most pairs under each pair of nodes, 0 for other labels."""
    kinds = [{n.shape: n for n in side} for side in (x, y)]
    table = np.array([[most(a, b, known) for b in kinds[1].values()] for a in kinds[0].values()], np.int32).reshape(len(kinds[0]), len(kinds[1]))
    at = [np.array([place[n.shape] for n in side], np.int64) for side, place in zip((x, y), ({s: i for i, s in enumerate(k)} for k in kinds), strict=True)]
    return table[at[0]][:, at[1]]


def rows(w: np.ndarray) -> Iterator[np.ndarray]:
    """Most that the first rows and columns of weights can give, in order, row after row."""
    best = np.zeros(w.shape[1] + 1, np.int32)
    yield best
    for line in w:
        new = best.copy()
        np.maximum(new[1:], best[:-1] + line, out=new[1:])
        best = np.maximum.accumulate(new)
        yield best


def aligned(w: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns in order of which the weights are most; large tables are halved by rows, so memory is bounded."""
    if not w.size or not w.any():
        return []
    if len(w) > w.shape[1]:  # a step for each of the shorter side: frames are much longer than most pages
        return [(a, b) for b, a in aligned(w.T)]
    if w.size > CELLS and len(w) > 1:
        half = len(w) // 2
        for first in rows(w[:half]):
            pass
        for last in rows(w[half:][::-1, ::-1]):
            pass
        j = int((first + last[::-1]).argmax())
        return aligned(w[:half, :j]) + [(half + a, j + b) for a, b in aligned(w[half:, j:])]
    best, out = np.stack(list(rows(w))), []
    i, j = len(w), w.shape[1]
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def ends(x: list[Node], y: list[Node]) -> tuple[int, int]:
    """How many children match in front, and at the back, in some best matching: those of equal shape."""
    n = min(len(x), len(y))
    i = next((k for k in range(n) if x[k].shape != y[k].shape), n)
    return i, next((k for k in range(n - i) if x[-1 - k].shape != y[-1 - k].shape), n - i)


def most(a: Node, b: Node, known: dict) -> int:
    """Number of pairs that ``match`` finds; ``known`` has it for shapes met before."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return a.size
    if (a.shape, b.shape) not in known:
        i, j = ends(a.kids, b.kids)
        same = sum(n.size for n in a.kids[:i]) + sum(n.size for n in a.kids[len(a.kids) - j :])
        w = weights(a.kids[i : len(a.kids) - j], b.kids[i : len(b.kids) - j], known)
        for last in rows(w if len(w) <= w.shape[1] else w.T):
            pass
        known[a.shape, b.shape] = 1 + same + int(last[-1])
    return known[a.shape, b.shape]


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most pairs of nodes in order, under pairs of one label, and these pairs."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * DEPTH))
    known: dict = {}
    if a.label != b.label:
        return 0, []
    pairs, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        if x.shape == y.shape:
            stack += zip(x.kids, y.kids, strict=True)
            continue
        i, j = ends(x.kids, y.kids)
        inner = x.kids[i : len(x.kids) - j], y.kids[i : len(y.kids) - j]
        stack += zip(x.kids[:i], y.kids[:i], strict=True)
        stack += zip(x.kids[len(x.kids) - j :], y.kids[len(y.kids) - j :], strict=True)
        stack += [(inner[0][k], inner[1][m]) for k, m in aligned(weights(*inner, known))]
    return len(pairs), pairs


def merged(frame: Node, page: Node) -> Node:
    """The frame with the page's nodes that have no partner in it, each after its nearest elder with one."""
    of = {id(y): x for x, y in match(frame, page)[1]}
    for y in preorder(page):
        if (x := of.get(id(y))) is None:
            continue
        at = 0
        for k in y.kids:
            if (own := of.get(id(k))) is not None:
                at = next(i for i in range(at, len(x.kids)) if x.kids[i] is own) + 1
            else:
                x.kids.insert(at, k)
                at += 1
    return numbered(frame)


def counted(page: Node, sums: list[list[int]]) -> None:
    """Adds the words and the checksum of each block's own text to a structure's sums; what is in elements that are never content isn't read."""
    stack = [page]
    while stack:
        n = stack.pop()
        words = "".join(x if isinstance(x, str) else " " for x in n.items).split()
        check = zlib.crc32(" ".join(words).encode(errors="replace"))
        of = sums[n.index]
        of[0] += len(words)
        of[1], of[2] = min(of[1], check), max(of[2], check)
        if not n.never:
            stack += n.kids


def placed(frame: Node, page: Node) -> list[tuple[int, int, bool]]:
    """(node of the frame, node of the page, partners or not) of a page's blocks; those without a partner count for the one around them."""
    of = {p.index: f.index for f, p in match(frame, page)[1]}
    stack, out = [(page, of.get(page.index, 0))], []
    while stack:
        n, around = stack.pop()
        at = of.get(n.index)
        if at is not None:
            out.append((at, n.index, True))
        elif not n.never:
            out.append((around, n.index, False))
        if not n.never:
            stack += [(k, around if at is None else at) for k in n.kids]
    return out


def induced(frame: Node, stats: dict[int, tuple[int, int, bool]]) -> tuple[int, set[int]]:
    """The wrapper: number of the container, and the constant blocks, from pages, words and sameness by node."""
    nodes = list(preorder(frame))
    constant = {i for i, (pages, _, same) in stats.items() if same and pages >= CONSTANT_PAGES}
    words = [0] * len(nodes)
    dropped = [False] * len(nodes)
    for n in nodes:
        for k in n.kids:
            dropped[k.index] = dropped[n.index] or k.never
    for n in reversed(nodes):
        own = stats.get(n.index, (0, 0, False))[1]
        words[n.index] += 0 if dropped[n.index] or n.index in constant else own
        for k in n.kids:
            words[n.index] += words[k.index]
    at = frame
    while True:
        inside = [k for k in at.kids if k.tag in CONTAINERS and not k.never and words[k.index] >= HELD * max(1, words[frame.index])]
        if not inside:
            return at.index, constant
        at = inside[0]


def text_of(node: Node, left_out: set[int]) -> str:
    """Text of a node's blocks in order, without what is never content."""
    out: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(piece).split()):
            out.append(text)
        piece.clear()

    stack = [(node, 0)]
    while stack:
        n, i = stack.pop()
        while i < len(n.items):
            x = n.items[i]
            i += 1
            if not isinstance(x, str):
                flush()
                if not x.never:
                    stack.append((n, i))
                    n, i = x, 0
            elif n.index not in left_out:
                piece.append(x)
        flush()
    return " ".join(out)


def extracted(page: Node, frame: Node | None, wrapper: tuple[int, set[int]] | None, known: dict[int, tuple[int, set[int]]] | None = None) -> str:
    """A page's main text; ``known`` has the region and what is left out for shapes that met this frame and wrapper before."""
    if frame is not None and wrapper is not None and wrapper[0] > 0:
        known = {} if known is None else known
        if page.shape not in known:
            of = {f.index: p for f, p in match(frame, page)[1]}
            region = of.get(wrapper[0])
            fits = region is not None and region.tag not in ("html", "body")
            known[page.shape] = (region.index, {of[i].index for i in wrapper[1] if i in of and of[i].tag not in LEAVES}) if fits else (-1, set())
        at, left_out = known[page.shape]
        if at >= 0:
            return text_of(next(n for n in preorder(page) if n.index == at), left_out)
    mains = [n for n in preorder(page) if n.tag in ("article", "main")]
    if mains:
        outer: list[Node] = []
        inside: set[int] = set()
        for n in mains:
            if n.index not in inside:
                outer.append(n)
                inside |= {x.index for x in preorder(n)}
        return " ".join(t for n in outer if (t := text_of(n, set())))
    return text_of(page, set())


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each page (page_id, url, html).

    Texts have character references decoded, one space for white space within a block and between
    blocks. A null or empty html, or one without content, gives an empty text. A null url, or one
    without host, has no host's wrapper. Repeated rows give equal results; a page without
    content is in no frame. An empty table gives an empty
    result; other columns are ignored. Very long pages are read whole, in time in proportion but for the matching of
    what differs from the frame.
    """
    with scratch():
        return Cut(_extract(pages), "texts", keep=True).df


def _extract(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "url", "html", host_path(F.col("url"))[0].alias("host"))
    usable = rows.where("host <> '' and html is not null").withColumn("marked", F.col("html").rlike("<[A-Za-z]"))

    def structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By host and structure: whether a page of it has content, its pages, and the sums of its nodes.
        met: dict[tuple[str, str], list] = {}
        nodes = 0

        def out() -> pa.RecordBatch:
            values = list(met.values())
            sums = [pa.array([[x[k] for x in v[2]] for v in values], pa.list_(pa.int64())) for k in range(3)]
            columns = [pa.array([k[i] for k in met], pa.string()) for i in range(2)] + [pa.array([v[0] for v in values], pa.bool_()), pa.array([v[1] for v in values], pa.int64()), *sums]
            return pa.RecordBatch.from_arrays(columns, names=["host", "frame", "content", "pages", "words", "least", "most"])

        for batch in batches:
            for host, page, marked in zip(column(batch, "host"), column(batch, "html"), column(batch, "marked"), strict=True):
                t = tree(page)
                if (key := (host, skeleton(t))) not in met:
                    met[key] = [False, 0, [[0, 1 << 40, -1] for _ in range(t.size)]]
                    nodes += t.size
                of = met[key]
                of[0] = of[0] or marked and any(n.own() and not n.never for n in preorder(t))
                of[1] += 1
                counted(t, of[2])
                if nodes > HELD_NODES:
                    yield out()
                    met.clear()
                    nodes = 0
        yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for frames in column(batch, "frames"):
                frame = framed(frames[0]["frame"])
                for f in frames[1:]:
                    frame = merged(frame, framed(f["frame"]))
                out.append(skeleton(frame))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "frame"])

    # Every structure of a host's pages once, in one order for all; then FRAMES or so are merged, and again, until a host has one.
    found = Cut(map_batches(usable.select("host", "html", "marked"), structures, "host string, frame string, content boolean, pages long, words array<long>, least array<long>, most array<long>"), "structures").df
    now = Cut(found.where("content").select("host", "frame").distinct(), "frames").df
    while True:
        counts = now.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
        counts = Cut(counts.where("_n > 1").withColumnRenamed("host", "_of"), "frame-counts").df
        if counts.isEmpty():
            framed_hosts = now
            break
        parts = F.ceil(F.coalesce("_n", F.lit(1)) / FRAMES)
        order = F.xxhash64("frame")
        dealt = now.join(checked_broadcast(counts), F.col("host") == F.col("_of"), "left")
        dealt = dealt.groupBy("host", F.pmod(order, parts).alias("k")).agg(F.sort_array(F.collect_list(F.struct((-F.length("frame")).alias("size"), order.alias("order"), "frame"))).alias("frames"))
        now = Cut(map_batches(dealt.select("host", "frames"), merge, "host string, frame string"), "frames").df

    def with_hosts(rows: DataFrame, hosts: DataFrame, columns: list[str], how: str) -> DataFrame:
        """Rows with their host's columns: broadcast if all hosts' are small, by their measured size."""
        size = hosts.agg(F.sum(F.length(F.to_json(F.struct(*columns))))).first()[0] or 0
        side = hosts.withColumnRenamed("host", "_of")
        return rows.join(F.broadcast(side) if size <= 32 << 20 else side, F.col("host") == F.col("_of"), how).drop("_of")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        sums: dict[tuple[str, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            keys, values = list(sums), list(sums.values())
            arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32())]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array([v[i] for v in values], pa.int64()) for i in range(4))], names=["host", "node", "pages", "words", "least", "most"])

        for batch in batches:
            hosts, frames, whole = (column(batch, x) for x in ("host", "frame", "whole"))
            figures = zip(*(column(batch, x) for x in ("pages", "words", "least", "most")), strict=True)
            for host, structure, frame, (pages, words, least, most) in zip(hosts, frames, whole, figures, strict=True):
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[host] = framed(frame)
                for node, own, partners in placed(known[host], framed(structure)):
                    s = sums.setdefault((host, node), [0, 0, 1 << 40, -1])
                    s[1] += words[own]
                    if partners:
                        s[0], s[2], s[3] = s[0] + pages, min(s[2], least[own]), max(s[3], most[own])
            if len(sums) > 100_000:
                yield out()
                sums.clear()
        yield out()

    structured = with_hosts(found, framed_hosts.withColumnRenamed("frame", "whole"), ["whole"], "inner").select("host", "frame", "whole", "pages", "words", "least", "most")
    sums = map_batches(structured, measure, "host string, node int, pages long, words long, least long, most long")
    sums = sums.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("words").alias("words"), (F.min("least") == F.max("most")).alias("same"))
    stats = sums.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "pages", "words", "same"))).alias("stats"))
    wrappers = Cut(framed_hosts.join(stats, "host"), "wrappers").df

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Node, tuple[int, set[int]], dict]] = {}
        for batch in batches:
            texts = []
            frames, figures = (batch.column(batch.schema.get_field_index(x)) for x in ("frame", "stats"))
            for i, (host, page) in enumerate(zip(column(batch, "host"), column(batch, "html"), strict=True)):
                of: tuple = (None, None)
                if frames[i].is_valid and page:
                    if host not in known:
                        if len(known) > 2000:
                            known.clear()
                        root = framed(frames[i].as_py())
                        known[host] = root, induced(root, {s["node"]: (s["pages"], s["words"], s["same"]) for s in figures[i].as_py()}), {}
                    of = known[host]
                    if len(of[2]) > 10_000:
                        of[2].clear()
                texts.append(extracted(tree(page), *of) if page else "")
            ids = batch.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = with_hosts(rows, wrappers, ["frame", "stats"], "left").select("page_id", "url", "host", "frame", "stats", "html")
    return map_batches(joined, cut_out, "page_id long, url string, text string, n_chars long")
