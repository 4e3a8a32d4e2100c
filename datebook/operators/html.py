"""Pages as trees: markdown of the content and tables as bounded CSV.

A page is parsed once, in one Arrow UDF that returns both.  The tree follows the HTML standard where
pages need it: void and raw-text elements, implied end tags, and formatting elements that are closed
by their paragraph and opened again in the next.  Not followed are foster parenting and the full
adoption agency; a stray end tag is ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from datebook.functions import patterns as P
from datebook.functions.arrow_signals import strip as _strip

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre section summary table ul".split())
#: What a start tag closes, up to the elements that bound the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
SCOPE = frozenset("table td th caption button html".split())

#: White space that isn't a single blank; a single blank is what it becomes.
_SPACE = re.compile(f"[{P.SPACES.replace(' ', '')}]{P.S}*| {P.S}+")
_NOISY = re.compile("|".join(map(re.escape, P.NOISY_ATTRIBUTES)))
#: Pages that are parsed before their results go from Python's memory to Arrow's.
PAGES = 100


class Node:
    """An element; its children are nodes and texts."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        if parent is not None:
            parent.children.append(self)

    def descendants(self):
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.descendants() if n.tag in tags]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack += reversed(x.children)
            else:
                out.append(x)
        return "".join(out)


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.body = Node("body", {}, self.root)
        self.open = [self.root, self.body]
        self.formats: list[tuple[str, dict]] = []  # formatting that is in force, as opened
        self.feed(html)
        self.close()

    def updatepos(self, i: int, j: int) -> int:
        """Lines aren't counted."""
        return j

    def _index(self, tags, bounds=SCOPE) -> int:
        for k in range(len(self.open) - 1, 1, -1):
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in bounds:
                return 0
        return 0

    def _resume(self) -> None:
        """Open formatting again that an enclosing block has closed."""
        now = [n.tag for n in self.open]
        for tag, attrs in self.formats:
            if tag in now:
                now.remove(tag)
            else:
                self.open.append(Node(tag, attrs, self.open[-1]))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            target = self.root if tag == "html" else self.body
            if tag != "head":
                target.attrs = {**given, **target.attrs}
            return
        if tag in CLOSES_P and (k := self._index({"p"})):
            del self.open[k:]
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in IMPLIED:
            closes, bounds = IMPLIED[tag]
            while (k := self._index(closes, bounds)) > 0:
                del self.open[k:]
        if tag == "a" and any(t == "a" for t, _ in self.formats):
            self.handle_endtag("a")
        if tag not in CLOSES_P and tag not in IMPLIED:
            self._resume()
        node = Node(tag, given, self.open[-1])
        if tag not in VOID:
            self.open.append(node)
            if tag in FORMATTING:
                # At most three of the same kind are in force.
                same = [f for f in self.formats if f == (tag, given)]
                if len(same) >= 3:
                    self.formats.remove(same[0])
                self.formats.append((tag, given))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and not self._index({"p"}):
            Node("p", {}, self.open[-1])
        elif tag in FORMATTING:
            for k in range(len(self.formats) - 1, -1, -1):
                if self.formats[k][0] == tag:
                    del self.formats[k]
                    break
            if k := self._index({tag}):
                del self.open[k:]
        elif k := self._index(HEADINGS if tag in HEADINGS else {tag}, frozenset() if tag in SCOPE else SCOPE):
            del self.open[k:]

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._resume()
        self.open[-1].children.append(data)


@lru_cache(maxsize=4096)
def _noisy(value: str) -> bool:
    return _NOISY.search(value) is not None


def drop_noise(root: Node) -> None:
    """Remove elements that never carry an event, and those that look like chrome unless they hold a table or heading."""
    nodes, holders, dropped = list(root.descendants()), set(), set()
    # From the last to the first: what an element holds is known before the element.
    for node in reversed(nodes):
        if node.tag in P.DROPPED_TAGS or id(node) not in holders and any(v and _noisy(v) for v in map(node.attrs.get, ("class", "id", "aria-label"))):
            dropped.add(id(node))
        if node.tag == "table" or node.tag in HEADINGS or id(node) in holders:
            holders.add(id(node.parent))
    for parent in {id(n.parent): n.parent for n in nodes if id(n) in dropped}.values():
        parent.children = [c for c in parent.children if id(c) not in dropped]


def content_root(tree: Tree) -> Node:
    classes = {"main-content", "page-content", "entry-content"}
    for node in tree.root.descendants():
        if node.tag in ("main", "article") or node.attrs.get("role") == "main" or node.attrs.get("id") == "content" or classes & set(node.attrs.get("class", "").split()):
            return node
    return tree.body


def _wrapped(node: Node, inner: str) -> str:
    """An element's markdown around what its children gave."""
    tag, x = node.tag, _strip(inner)
    if tag in ("strong", "b"):
        return f" **{x}** "
    if tag in ("em", "i"):
        return f" *{x}* "
    if tag == "code":
        return f" `{x}` "
    if tag == "a":
        href = node.attrs.get("href")
        return f" [{x}]({href}) " if href and x else x
    if tag == "br":
        return "\n"
    if tag == "img" or not x and tag not in ("hr", "td", "th"):
        return ""
    if tag in HEADINGS:
        return f"\n\n{'#' * int(tag[1])} {x}\n\n"
    block = {"p": "{}", "ul": "{}", "ol": "{}", "table": "{}", "blockquote": "> {}", "pre": "```\n{}\n```", "hr": "---"}.get(tag)
    if block:
        return "\n\n" + block.replace("{}", x) + "\n\n"
    return {"li": f"\n- {x}", "tr": f"| {x} |\n", "th": f" {x} |", "td": f" {x} |"}.get(tag, f" {x} ")


def markdown(root: Node) -> str:
    """Markdown of an element, without recursion: pages can be nested deeper than Python's stack."""
    stack: list[tuple[Node, int, list[str]]] = [(root, 0, [])]
    while True:
        node, at, parts = stack.pop()
        if at < len(node.children):
            child = node.children[at]
            stack.append((node, at + 1, parts))
            if isinstance(child, Node):
                stack.append((child, 0, []))
            else:
                parts.append(_SPACE.sub(" ", child))
        else:
            done = _wrapped(node, "".join(parts))
            if not stack:
                return _strip(re.sub(r"\n{3,}", "\n\n", done))
            stack[-1][2].append(done)


def cell(value: str, most: int = P.CELL_CHARS) -> str:
    x = _strip(re.sub(r"[\n\r]+", " ", value))
    return x if len(x) <= most else "." * max(0, most) if most <= 3 else _strip(x[: most - 3]) + "..."


def csv_line(values: list[str], most: int | None = None) -> str | None:
    """Quoted cells, cut alike to the widest limit at which the line fits; null where none does."""
    line = lambda limit: ",".join('"' + cell(v, limit).replace('"', '""') + '"' for v in values)
    if most is None or len(line(P.CELL_CHARS)) <= most:
        return line(P.CELL_CHARS)
    low, high, best = 0, P.CELL_CHARS, None
    while low <= high:
        middle = (low + high) // 2
        x = line(middle)
        if len(x) <= most:
            low, best = middle + 1, x
        else:
            high = middle - 1
    return best


def table_snippets(root: Node, tables: int = 3, rows: int = 30, most: int = 6000) -> list[str]:
    """The first tables that have a header and a body row, as CSV within ``most`` characters each."""
    out = []
    for t in root.all("table")[:tables]:
        trs = t.all("tr")
        if not trs:
            continue
        head = [th for thead in t.all("thead") for tr in thead.all("tr") for th in tr.all("th")]
        head = list(dict.fromkeys(head)) or trs[0].all("th", "td")
        names = [_strip(c.text() or f"col{k + 1}") for k, c in enumerate(head)]
        first = 1 if head and head[0] in trs[0].all("th", "td") else 0
        line = csv_line(names, most)
        if not line:
            continue
        lines, used = [line], len(line)
        for tr in trs[first : first + rows]:
            cells = tr.all("td", "th")
            if not cells:
                continue
            values = [cells[k].text() if k < len(cells) else "" for k in range(len(names))]
            line = csv_line(values)
            if used + 1 + len(line) > most:
                if len(lines) > 1:
                    break
                line = csv_line(values, max(0, most - used - 1))
                if not line:
                    break
            lines.append(line)
            used += 1 + len(line)
        if len(lines) > 1:
            out.append("\n".join(lines))
    return out


PAGE = StructType([StructField("markdown", StringType()), StructField("tables", ArrayType(StringType())), StructField("title", StringType()), StructField("text", StringType()), StructField("lang", StringType())])


def read_page(html: str) -> tuple:
    """Markdown, table snippets, title, visible text and language.  Tables are read before noise is dropped."""
    tree = Tree(html)
    nodes = list(tree.root.descendants())
    tables = table_snippets(tree.root)
    titles = [n for n in nodes if n.tag == "title"]
    title = _strip(titles[0].text()) if titles else ""
    drop_noise(tree.root)
    for t in titles:
        t.parent.children = [c for c in t.parent.children if c is not t]
    lines = [_strip(_SPACE.sub(" ", x)) for x in markdown_text(tree.body).split("\n")]
    out = markdown(content_root(tree)), tables, title, "\n".join(x for x in lines if x), tree.root.attrs.get("lang")
    # Without the way back to its parents a tree is freed at once, and not when the collector next looks for cycles.
    for n in nodes:
        n.parent = None
    return out


def markdown_text(body: Node) -> str:
    """Text as a browser would render it, roughly: a line for each block."""
    out: list[str] = []
    stack: list = [body]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(_SPACE.sub(" ", x) if not x == "\n" else x)
        else:
            edge = "\n" if x.tag in CLOSES_P or x.tag in ("li", "tr", "br", "dt", "dd") else ""
            stack += [edge] + list(reversed(x.children)) + [edge] if edge else list(reversed(x.children))
    return "".join(out)


def page_structs(html: pa.Array) -> pa.StructArray:
    """The parse of each page; a null or blank page has empty ones."""
    kind = to_arrow_type(PAGE)
    rows = [read_page(x) if x and _strip(x) else ("", [], "", "", None) for x in html.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), kind)], fields=list(kind)) if rows else pa.array([], kind)


@F.arrow_udf(PAGE)
def _pages(html: pa.Array) -> pa.Array:
    return pa.concat_arrays([page_structs(html.slice(at, PAGES)) for at in range(0, max(1, len(html)), PAGES)])


def parsed_page(html: Column) -> Column:
    """Struct of markdown, tables, title, text and lang; a null or blank page has empty ones."""
    return _pages(html)
