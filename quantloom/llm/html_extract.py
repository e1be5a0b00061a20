"""Main text of web pages by minimum-cut labelling of text blocks.

A page becomes blocks of text. A linear classifier over tags, names, links and length gives each block a cost of being content and
a cost of being boilerplate, the capacities of its terminal edges. Edges between neighbours and
between blocks with one parent make unequal labels costly; the minimum cut (Dinic) splits the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMENT, OTHER = r"<!--(?:>|->|.*?(?:--!?>|\Z))", r"<[!?/][^>]*+(?:>|\Z)"
TAG = r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>%s)>"
TOKEN = re.compile("|".join((COMMENT, TAG % r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+", OTHER, r"(?P<open><[a-zA-Z])")), re.S)
# For the rest of a page after a tag whose quotes never close: tags end at the first >.
PLAIN = re.compile("|".join((COMMENT, TAG % "[^>]*+", OTHER)), re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")

# Fixed sets of HTML: elements without text of their own, without end tags, inside a line, and not shown as prose.
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "textarea", "title", "svg", "math", "object", "audio", "video", "canvas", "xmp"}
TO_THE_END = {"script", "style", "iframe", "noembed", "noframes", "textarea", "title", "xmp"}  # of these, what is not closed hides the rest of a page
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "link", "meta", "base", "embed", "area", "param", "source", "track",
}
FORM = {"form", "button", "select", "option", "optgroup", "datalist", "fieldset", "legend", "input", "label", "output", "progress", "meter", "dialog"}
FRAME = {"nav", "aside", "menu", "footer", "header"}
MAIN = {"article", "main"}
# Words in class, id and role that mark a part as boilerplate or as content.
BOILER = set(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert disclaimer sidebar sidebars side aside "
    "rail menu menus nav navbar navigation breadcrumb breadcrumbs toolbar masthead header foot footer foote copyright legal comment comments commentlist disqus reply replies respond discussion share sharing shares "
    "social follow related recommended recommendations widget widgets newsletter subscribe subscription signup login signin search searchbox form popup modal overlay pagination pager paging tags tagcloud skip hidden "
    "complementary contentinfo".split()
)
CONTENT = set("article articlebody content post entry story main maincontent body text prose".split())
# Linear classifier: bias; boilerplate element or name, main element, content name; link share; log words; stops; heading. Markup that
# names a part decides by itself; where it says nothing, costs are small and the neighbours of a block count as much as the block.
WEIGHTS = {"bias": -1.6, "frame": -7.0, "form": -7.0, "boiler": -7.0, "main": 2.5, "content": 1.0, "links": -3.0, "words": 0.9, "stop": 0.8, "heading": 0.6}
SCALE, NEXT, PARENT = 1000, 1.0, 0.8  # capacities are whole thousandths; smoothness of neighbours and of one parent


class _Open:
    __slots__ = ("name", "frame", "form", "boiler", "main", "content", "key", "parent")

    def __init__(self, name: str, attrs: str, parent: "_Open | None", key: int):
        words: set[str] = set()
        hidden = False
        for m in NAMES.finditer(attrs) if attrs else ():
            what, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if what in ("class", "id", "role"):
                words.update(WORD.findall(value.replace("-", " ").replace("_", " ")))
            elif what == "style":
                hidden |= "display:none" in value.replace(" ", "")
            else:
                hidden |= what == "hidden" or value == "true"
        inside = bool(parent and parent.main)
        # The head of an article is its title; a foot in it is not its text.
        self.frame = bool(parent and parent.frame) or name in FRAME and not (name == "header" and inside)
        self.form = bool(parent and parent.form) or name in FORM
        whole = name in ("html", "body", "main", "article")
        self.boiler = bool(parent and parent.boiler) or hidden or bool(words & BOILER) and not whole and not (words & CONTENT and not inside)
        self.main = inside or name in MAIN
        self.content = bool(parent and parent.content) or bool(words & CONTENT)
        self.name, self.parent, self.key = name, parent, key


class Block:
    __slots__ = ("text", "linked", "at", "heading")

    def __init__(self, text: str, linked: int, at: _Open, heading: bool):
        self.text, self.linked, self.at, self.heading = text, linked, at, heading


def blocks(page: str) -> list[Block]:
    """Text blocks of a whole page in order. Unclosed and stray tags are taken as browsers take them, roughly."""
    out: list[Block] = []
    top = _Open("", "", None, 0)
    n_open, link, pieces, linked = 1, False, [], 0
    low = None

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            if "&" in raw:
                raw = html.unescape(raw)
            pieces.append(raw)
            if link:
                linked += len(raw)

    def close() -> None:
        nonlocal pieces, linked
        if pieces:
            joined = " ".join("".join(pieces).split())
            if joined:
                at = top
                out.append(Block(joined, min(linked, len(joined)), at, at.name in ("h1", "h2", "h3", "h4", "h5", "h6")))
            pieces, linked = [], 0

    at, size, token = 0, len(page), TOKEN
    while at < size:
        m = token.search(page, at)
        if m and token is TOKEN and m["open"]:
            token = PLAIN
            continue
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                link = False
            elif name not in INLINE or name == "label":
                node = top
                while node is not None and node.name != name:
                    node = node.parent
                if node is not None:
                    close()
                    top = node.parent
                elif name == "p":
                    close()
            continue
        if name in RAW:
            if not m["attrs"].endswith("/") or name not in ("svg", "math"):
                low = low if low is not None else page.lower()
                end = low.find(f"</{name}", at) if len(low) == size else page.find(f"</{name}", at)
                if end < 0 and name in TO_THE_END:
                    break
                if end < 0:
                    continue
                end = page.find(">", end)
                at = size if end < 0 else end + 1
            continue
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            link = True
        elif name in VOID:
            if name == "hr":
                close()
        elif name not in INLINE or name == "label":
            close()
            while top.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and name != "label":
                top = top.parent
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                node = top
                while node is not None and node.name not in ("ul", "ol", "dl", "table", "menu", "select", name, "tr" if name in ("td", "th") else name):
                    node = node.parent
                if node is not None and node.name == name:
                    top = node.parent
            n_open += 1
            top = _Open(name, m["attrs"], top, n_open)
    close()
    return out


def score(b: Block) -> float:
    """Log-odds of content."""
    w, at, words = WEIGHTS, b.at, b.text.count(" ") + 1
    s = w["bias"] + w["words"] * math.log1p(min(words, 200)) + w["links"] * b.linked / len(b.text)
    s += w["stop"] * (b.text[-1] in ".!?…。") + w["heading"] * b.heading
    s += w["main"] * at.main + w["content"] * at.content
    return s + w["frame"] * at.frame + w["form"] * at.form + w["boiler"] * at.boiler


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes on the source side of a minimum cut. ``source`` and ``sink`` are terminal capacities; edges go both ways."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(source[i], sink[i])  # what flows straight through
        if source[i] > both:
            edge(s, i, source[i] - both, 0)
        elif sink[i] > both:
            edge(i, t, sink[i] - both, 0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nth = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if not cap[e])
                a = to[path[k] ^ 1]
                del path[k:]
            while nth[a] < len(out[a]):
                e = out[a][nth[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    break
                nth[a] += 1
            if nth[a] < len(out[a]):
                path.append(out[a][nth[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                nth[a] += 1
            else:
                break


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    source, sink, edges = [], [], []
    parents: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        z = score(b)
        source.append(round(SCALE * max(0.0, z)))
        sink.append(round(SCALE * max(0.0, -z)))
        up = b.at.parent or b.at
        if i:
            near = found[i - 1].at.parent or found[i - 1].at
            edges.append((i - 1, i, round(SCALE * (NEXT if near.key == up.key else NEXT / 3))))
        parents.setdefault(up.key, []).append(i)
    for members in parents.values():
        if len(members) > 1:  # a node for the parent ties its blocks without an edge for each two
            source.append(0)
            sink.append(0)
            edges += [(i, len(source) - 1, round(SCALE * PARENT)) for i in members]
    return min_cut(source, sink, edges)[: len(found)]


def extract(page: str | None) -> str:
    """Content blocks of a page, one on a line; empty for a null or empty page or one without content."""
    found = blocks(page or "")
    return "\n".join(b.text for b, c in zip(found, labels(found), strict=True) if c)


def extract_pages(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the HTML; every row comes out once, whatever the other columns hold.

    A null or empty page, and one without content, has an empty text; whole pages are read, however long. Repeated rows and null
    ids come out like others, a column named ``out_col`` is replaced, and an empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    src = pages.select(*kept, F.col(html_col))
    schema = StructType([pages.schema[c] for c in kept]).add(out_col, "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(x) for x in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*kept, out_col])

    return src.mapInArrow(run, schema)
