"""Main text of web pages by a minimum cut over their blocks and containers.

A page becomes a row of text blocks in a tree of containers. A logistic classifier, trained in numpy on generated pages, judges
each block by how it behaves: its length, links, element and sentence ends; containers that name their purpose, by element,
role or class, have costs of their own. These costs are the capacities of the edges to the two terminals. Smoothness edges tie
each block to its container, a container to the nearest one around it that names a purpose, if any, and neighbours to each
other, weaker the farther apart they are in the tree. The maximum flow separates content from boilerplate: a short line or a list of
links in an article stays with it, prose in a sidebar goes with the sidebar.

Scale: one pass without a shuffle. Reading a page takes time in proportion to its length, whatever its quotes or depth; the
graph has a node for each block and container and three edges a block at most.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
#: Elements whose inside is text up to their end tag.
_RAW = frozenset(["script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"])
#: Elements whose inside is not shown as text.
_HIDDEN = frozenset(["noscript", "template", "svg", "object", "select", "datalist", "canvas", "audio", "video", "map"])
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
_BLOCK = frozenset(
    [
        *("address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt"),
        *("fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html"),
        *("legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "tfoot"),
        *("thead", "tr", "ul"),
    ]
)
_CLOSED_BY = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody"]), "option": frozenset(["option"])}
_HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_BOILER_TAG = frozenset(["nav", "footer", "aside", "form", "menu", "button", "fieldset", "legend", "dialog", "head", "label"])
_CONTENT_TAG = frozenset(["article", "main"])
_BOILER_ROLE = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist"])
#: Words of classes and ids. A name's last word says what an element is; its first does so before a word for a mere part.
_BOILER_WORD = re.compile(
    r"(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|footer|foot|header|masthead|topbar|toolbar|side|sidebar|aside|rail|widgets?|"
    r"cookies?|consent|gdpr|notices?|notifications?|popup|modal|overlay|newsletter|subscri\w*|signup|login|search|comments?|commentlist|replies|reply|respond|"
    r"disqus|discussion|share|sharing|social|related|recommended|links|pagination|pager|copyright|legal|skip|form)"
)
_PART_WORD = frozenset(
    [
        *("area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "column", "container", "content", "group", "inner", "item"),
        *("items", "left", "link", "list", "message", "module", "outer", "panel", "posts", "right", "row", "section", "slot", "text", "thread"),
        *("title", "top", "unit", "wrap", "wrapper"),
    ]
)
_CONTENT_WORD = frozenset(["article", "content", "main", "post", "entry", "story", "body", "text", "prose"])
_NEGATION = frozenset(["no", "has", "with", "without", "is", "not", "hide", "show"])
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Costs of a container that names boilerplate or content for each block in it, and the most that a block's own look says.
BOILER, CONTENT, OWN = 6.0, 4.0, 2.0
#: Strength of the edges between a block and its container, a container and the one around it, the same where the two name
#: different purposes, and neighbouring blocks (less by FADE for each step between them in the tree).
INSIDE, AROUND, ACROSS, NEIGHBOUR, FADE = 3.0, 5.0, 1.0, 0.6, 0.6
#: Steps in the tree beyond which neighbours have no edge.
FAR = 12


def _purpose(names: str) -> int:
    """-1 if a class or id names boilerplate, 1 if one names content, else 0."""
    found = 0
    for name in _CAMEL.sub("-", names).lower().replace("_", "-").split():
        words = [w for w in name.split("-") if w]
        if not words or words[0] in _NEGATION:
            continue
        last = words[-1]
        content_first = words[0] in _CONTENT_WORD and len(words) > 1
        if _BOILER_WORD.fullmatch(last) and not (content_first and last in ("header", "links", "notice", "legal")):
            return -1
        if last in _PART_WORD and any(_BOILER_WORD.fullmatch(w) for w in words[:-1]):
            return -1
        if last in _CONTENT_WORD or content_first and last in _PART_WORD:
            found = 1
    return found


def _attributes(raw: str) -> tuple[int, str, bool]:
    """What class and id name, the role, and whether the element is hidden."""
    if not raw or raw.isspace():
        return 0, "", False
    found = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(raw)}
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    return _purpose(f"{found.get('class', '')} {found.get('id', '')}"), found.get("role", "").lower(), hidden


class Block:
    __slots__ = ("text", "words", "links", "tag", "node")

    def __init__(self, text: str, links: int, tag: str, node: int):
        self.text, self.words, self.links, self.tag, self.node = text, text.count(" ") + 1, links / max(1, len(text)), tag, node


class Page:
    """Blocks in page order, and the tree of block elements: parent, depth, tag and purpose of each; node 0 is the page."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parent, self.depth, self.tag, self.purpose, self.role = [0], [0], [""], [0], [""]

    def add(self, parent: int, tag: str, purpose: int, role: str) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.purpose.append(purpose)
        self.role.append(role)
        return len(self.parent) - 1


def _tag_end(page: str, at: int, last: dict[str, int]) -> tuple[int, int]:
    """(end of the attributes, start of what follows) of a tag whose name ends at `at`.

    A quote after = holds its value up to the next one, > and all. If there is none, or the next one opens another value,
    the quote is stray and the tag ends at its first >.
    """
    stop = page.find(">", at)
    if stop < 0:
        return len(page), len(page)
    while True:
        raw, quote, k = page[at:stop], "", 0
        while True:
            found = [q for q in (raw.find("='", k), raw.find('="', k)) if q >= 0]
            if not found:
                return stop, stop + 1
            start = min(found) + 2
            quote = raw[start - 1]
            k = raw.find(quote, start) + 1
            if not k:
                break
        if last[quote] <= stop:
            return stop, stop + 1
        close = page.find(quote, stop)
        if page[close - 1] == "=" or "<" in page[stop:close] and page[close + 1 : close + 2] not in (">", " ", "/", "\n", "\t", "\r"):
            return stop, stop + 1
        more = page.find(">", close)
        if more < 0:
            return stop, stop + 1
        at, stop = close + 1, more


def read(page: str) -> Page:
    """White space in a block is one space; character references are decoded. Text that is not shown is left out."""
    out = Page()
    #: (tag, node, whether it is hidden) of the open elements, and how many of each tag are open.
    open_: list[tuple[str, int, bool]] = []
    count: dict[str, int] = {}
    last = {q: page.rfind(q) for q in "\"'"}
    text: list[str] = []
    links = at = in_link = hidden = 0

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                node = open_[-1][1] if open_ else 0
                out.blocks.append(Block(joined, links, out.tag[node], node))
            text.clear()
            links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not hidden:
            decoded = html.unescape(raw) if "&" in raw else raw
            text.append(decoded)
            if in_link:
                links += len(decoded)

    def close(k: int) -> None:
        nonlocal in_link, hidden
        for tag, _, unseen in open_[k:]:
            count[tag] -= 1
            in_link -= tag == "a"
            hidden -= unseen
        del open_[k:]

    while (m := _OPEN.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        if m[1]:
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if m[3] is None:
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        tag = m[3].lower()
        end, after = _tag_end(page, at, last)
        raw, at = page[at:end], after
        if m[2]:
            if tag in _BLOCK:
                flush()
            elif tag in ("td", "th"):
                text.append(" ")
            if count.get(tag):
                k = len(open_) - 1
                while open_[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag in _RAW:
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at) if not raw.endswith("/") or tag in ("script", "style", "title", "textarea") else None
            if found:
                at = found.end()
            elif not raw.endswith("/"):
                at = len(page)
            if tag != "title":
                text.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            for k in range(len(open_) - 1, -1, -1):
                if tag in _CLOSED_BY.get(open_[k][0], ()):
                    close(k)
                    break
                if open_[k][0] in _BLOCK and open_[k][0] not in _CLOSED_BY:
                    break
        elif tag in ("br", "td", "th"):
            text.append(" ")
        if tag in _VOID or raw.endswith("/") and tag not in _BLOCK:
            continue
        purpose, role, unseen = _attributes(raw)
        unseen = unseen and tag not in ("html", "body") or tag in _HIDDEN
        node = open_[-1][1] if open_ else 0
        if tag in _BLOCK or purpose or role:
            node = out.add(node, tag, purpose if tag not in ("html", "body") else 0, role)
        open_.append((tag, node, unseen))
        count[tag] = count.get(tag, 0) + 1
        in_link += tag == "a"
        hidden += unseen
    add(page[at:])
    flush()
    return out


def _marks(page: Page) -> list[int]:
    """-1 for the outermost containers of boilerplate, 1 for containers of content outside these, else 0.

    A form or a container whose class sounds like boilerplate, but that holds all of the page's articles and top headings,
    wraps the page and names nothing.
    """
    n = len(page.parent)
    held, all_held = [0] * n, 0
    for k in range(n - 1, 0, -1):
        if page.tag[k] in _CONTENT_TAG or page.tag[k] == "h1":
            held[k] += 1
            all_held += 1
        held[page.parent[k]] += held[k]
    out, inside = [0] * n, [0] * n
    for k in range(1, n):
        tag, role, above = page.tag[k], page.role[k], inside[page.parent[k]]
        inside[k] = above
        if above < 0 or tag in ("html", "body"):
            continue
        named = tag in _BOILER_TAG or role in _BOILER_ROLE or tag == "header" and not above
        boiler = named or page.purpose[k] < 0 and tag not in _CONTENT_TAG and tag not in _HEADING
        wraps = all_held and held[k] == all_held and tag not in ("nav", "footer", "aside", "header")
        if boiler and not wraps:
            out[k] = inside[k] = -1
        elif not above and (tag in _CONTENT_TAG or role in ("main", "article") or page.purpose[k] > 0):
            out[k] = inside[k] = 1
    return out


_COPYRIGHT = re.compile(r"©|\(c\)|copyright\b")


def _features(block: Block) -> list[float]:
    size = min(np.log1p(block.words) / 5, 1.5)
    return [1.0, block.links, size, block.tag in _HEADING, block.tag == "li", block.tag == "p", size * block.links, bool(_COPYRIGHT.match(block.text[:12].lower())), block.text[-1:] in ".!?…:\"”»"]


def _generated(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page of made-up words, and the texts of its content blocks."""

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(["ka", "to", "ri", "mu", "ne", "sol", "ba"], rng.integers(1, 4))) for _ in range(rng.integers(low, high)))

    good = [words(3, 9), *(words(1, 90) for _ in range(rng.integers(1, 9)))]
    inner = f"<h1>{good[0]}</h1>" + "".join(f"<p>{g}</p>" for g in good[1:])
    if rng.random() < 0.3:
        good.append(words(2, 20))
        inner += f"<ul><li>{good[-1]}</li></ul>"
    if rng.random() < 0.3:
        inner += f"<div class='{rng.choice(['share', 'related', 'ad'])}'><a href='#'>{words(1, 6)}</a></div>"
    wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div id='content'>{}</div>", "<div>{}</div>", "<main><article>{}</article></main>", "<section class='post'>{}</section>"])
    links = "".join(f"<li><a href='#'>{words(1, 3)}</a></li>" for _ in range(rng.integers(2, 9)))
    before = [f"<nav><ul>{links}</ul></nav>", f"<header><a href='#'>{words(1, 4)}</a></header>", f"<div class='menu'><ul>{links}</ul></div>", f"<div class='cookie-notice'>{words(3, 30)}</div>", f"<div class='ad'>{words(2, 30)}</div>", f"<ul>{links}</ul>"]
    after = [f"<footer>&copy; {words(2, 20)}</footer>", f"<aside>{words(3, 40)}</aside>", f"<section class='comments'><p>{words(3, 40)}</p></section>", f"<form><p>{words(2, 9)}</p><button>{words(1, 2)}</button></form>", f"<div id='footer'><p>{words(2, 12)}</p></div>", f"<div class='sidebar'><p>{words(3, 40)}</p></div>"]
    pick = lambda parts: "".join(p for p in parts if rng.random() < 0.5)
    return f"<html><body>{pick(before)}{wrap.format(inner)}{pick(after)}</body></html>", good


@cache
def classifier(pages: int = 250, seed: int = 11) -> np.ndarray:
    """Weights of a logistic regression over _features, by Newton steps on generated pages."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(pages):
        page, good = _generated(rng)
        left = list(good)
        for block in read(page).blocks:
            y.append(block.text in left)
            if y[-1]:
                left.remove(block.text)
            x.append(_features(block))
    a, b = np.array(x, float), np.array(y, float)
    w = np.zeros(a.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - b) + 0.5 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def minimum_cut(excess: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of the smallest minimum cut. excess > 0: capacity from the source, < 0: to the sink."""
    n = len(excess)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]

    def link(u: int, v: int, forth: float, back: float) -> None:
        near[u].append(len(to))
        to.append(v)
        cap.append(forth)
        near[v].append(len(to))
        to.append(u)
        cap.append(back)

    for k, e in enumerate(excess):
        if e > 0:
            link(source, k, e, 0)
        elif e < 0:
            link(k, sink, -e, 0)
    for u, v, c in edges:
        link(u, v, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in near[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        seen = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while seen[u] < len(near[u]):
                e = near[u][seen[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                seen[u] += 1
            else:
                if u == source:
                    break
                e = path.pop()
                u = to[e ^ 1]
                seen[u] += 1
                continue
            path.append(e)
            u = to[e]


def own_costs(blocks: list[Block]) -> list[float]:
    """What each block's own look says: above zero for content."""
    return np.clip(np.array([_features(b) for b in blocks]) @ classifier(), -OWN, OWN).tolist()


def _steps(page: Page, a: int, b: int) -> int:
    """Steps between two nodes of the tree, FAR + 1 if there are more than FAR."""
    n = 0
    while a != b and n <= FAR:
        if page.depth[a] >= page.depth[b]:
            a = page.parent[a]
        else:
            b = page.parent[b]
        n += 1
    return n


def content_blocks(text: str) -> list[Block]:
    page = read(text)
    blocks = page.blocks
    if not blocks:
        return []
    marks = _marks(page)
    #: The nearest container, itself included, that names a purpose; the page if there is none.
    anchor = [0] * len(marks)
    for k in range(1, len(marks)):
        anchor[k] = k if marks[k] else anchor[page.parent[k]]
    held = [0] * len(marks)
    for block in blocks:
        held[anchor[block.node]] += 1
    cost, edges = own_costs(blocks), []
    nodes: dict[int, int] = {}

    def node(k: int) -> int:
        """The graph's node of a container; made with its cost and its edge to the one around it."""
        if k not in nodes:
            nodes[k] = len(cost)
            cost.append(max(1, held[k]) * (-BOILER if marks[k] < 0 else CONTENT if marks[k] > 0 else 0.0))
            around = anchor[page.parent[k]] if marks[k] else anchor[k]
            if around:
                edges.append((nodes[k], node(around), ACROSS if marks[k] else AROUND))
        return nodes[k]

    for k, block in enumerate(blocks):
        inside = block.node if marks[block.node] or not page.parent[block.node] else page.parent[block.node]
        if page.tag[inside] not in ("", "html", "body"):
            edges.append((k, node(inside), INSIDE))
        if k and (far := _steps(page, blocks[k - 1].node, block.node)) <= FAR:
            edges.append((k - 1, k, NEIGHBOUR * FADE**far))
    side = minimum_cut(cost, edges)
    return [b for k, b in enumerate(blocks) if side[k]]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in content_blocks(page)) if page else ""


def extracted(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row for each row of df: id_col, the kept columns, text (blocks joined by a line feed; empty if none), n_chars.

    Null and empty pages have the empty text. Null ids and repeated rows pass through. Columns of df that are not named,
    whatever they are called, are not looked at. An empty df gives no rows.
    """
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate((id_col, *keep))]
    pages = df.select(*kept, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page) for page in batch["html"]]
            yield batch.drop(columns="html").assign(text=texts, n_chars=[len(t) for t in texts])

    kinds = T.StructType([*pages.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.mapInPandas(run, kinds).toDF(id_col, *keep, "text", "n_chars")
