"""HTML to text and to Markdown over the standard library's parser, an Arrow batch at a time.

Block text (`blocks`) takes tags as they are written, as the first kind of page build does. Markdown (`faithful`)
stands on a tree with implied ends: a start tag ends what can't go on beside it (a paragraph before any
block, a list item before the next one, cells and rows within their table), and whatever is open inside goes with
it, inline tags too, so no mark runs over two blocks. An end tag closes up to its element unless a stronger one lies
between; else it is void. Formatting that a block's end has closed isn't opened again."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from verbaloom.functions.pieces import portions

#: Bytes of pages whose rows a worker holds at once.
PAGE_BYTES = 1 << 21

#: What isn't article text, and the blocks that are.
DROP_TAGS = {"table", "figure", "style", "script"}
DROP_CLASSES = set(
    "infobox navbox vertical-navbox reflist reference mw-editsection thumb hatnote metadata mw-empty-elt noprint toc gallery "
    "sistersitebox side-box ambox portal mw-references-wrap".split()
)
BLOCKS = {"p", "h2", "h3", "li"}
ROOT_CLASS, CATEGORY_REL = "mw-parser-output", "mw:PageProp/Category"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that only mark text: what looks for an open block looks through them.
INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ROWS = {"tbody", "thead", "tfoot"}
_BLOCK_STARTS = HEADINGS | set("address blockquote body caption center col colgroup dd dir div dl dt fieldset form hr li listing menu ol p pre table td th title tr ul xmp".split()) | _ROWS
#: Start tags that end an open element.
ENDED_BY = (
    {"p": _BLOCK_STARTS, "a": {"a"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"}, "head": {"body"} | _BLOCK_STARTS}
    | {"td": {"td", "th", "tr"} | _ROWS, "th": {"td", "th", "tr"} | _ROWS, "tr": {"tr"} | _ROWS, "caption": {"col", "colgroup", "tr"} | _ROWS, "colgroup": {"colgroup", "tr"} | _ROWS}
    | dict.fromkeys(_ROWS, _ROWS) | dict.fromkeys(HEADINGS, HEADINGS | {"p", "li", "table", "form", "fieldset"})
)
#: A start tag that has a fence looks for what it ends up to there, through anything; others through inline tags.
FENCE = {"li": {"ul", "ol", "menu", "dir", "table", "td", "th"}, "dt": {"dl", "table", "td", "th"}, "dd": {"dl", "table", "td", "th"}} | dict.fromkeys(_ROWS | {"td", "th", "tr", "caption", "col", "colgroup"}, {"table"})
#: How strong an element is: an end tag doesn't reach beyond a stronger one than its own.
STRENGTH = {"div": 1, "td": 2, "th": 2, "tr": 3, "tbody": 4, "thead": 4, "tfoot": 4, "table": 5, "head": 6, "body": 6, "html": 7}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self) -> Iterator[Node]:
        """Elements in document order, this one first, without recursion."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo.extend(reversed(x.children))

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def prune(self, drop) -> None:
        for node in list(self.walk()):
            node.children = [c for c in node.children if isinstance(c, str) or not drop(c)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


class _TreeBuilder(_Builder):
    """A tree with implied ends."""

    def handle_starttag(self, tag, attrs):
        self.end_before(tag)
        super().handle_starttag(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        """A slash ends void tags only; in others it is noise."""
        self.handle_starttag(tag, attrs)

    def end_before(self, tag: str) -> None:
        fence, last = FENCE.get(tag), 0
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i].tag
            if tag in ENDED_BY.get(name, ()):
                last = i
            elif name in fence if fence else name not in INLINE:
                break
        if last:
            del self.open[last:]

    def handle_endtag(self, tag):
        own = STRENGTH.get(tag, 0)
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if STRENGTH.get(self.open[i].tag, 0) > own:
                return


def parse(html: str | None, builder: type[_Builder] = _Builder) -> Node:
    builder = builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def main_node(root: Node, is_root=lambda n: n.tag == "div" and ROOT_CLASS in n.classes()) -> Node:
    """The content root with most paragraphs (the first of equals), else body, else all."""
    roots = [n for n in root.walk() if is_root(n)]
    if roots:
        return max(roots, key=lambda n: sum(x.tag == "p" for x in n.walk()))
    return next((n for n in root.walk() if n.tag == "body"), root)


def furniture(n: Node) -> bool:
    return n.tag in DROP_TAGS or bool(n.classes() & DROP_CLASSES) or n.attrs.get("id") == "toc"


def blocks(html: str | None) -> list[tuple[str, str]]:
    """(tag, text) of block elements; nested ones come again within their parents' text."""
    node = main_node(parse(html))
    node.prune(furniture)
    found = [(n.tag, " ".join(s for s in (x.strip() for x in n.strings()) if s)) for n in node.walk() if n is not node and n.tag in BLOCKS]
    return [(tag, text) for tag, text in found if text]


def faithful(html: str | None, host: str, base: str) -> Node:
    """Body without scripts, styles and metas; category links become lines, links absolute."""
    root = parse(html, _TreeBuilder)
    body = next((n for n in root.walk() if n.tag == "body"), root)
    for n in body.walk():
        n.children = [_category(c) if isinstance(c, Node) and c.tag == "link" else c for c in n.children]
    body.prune(lambda n: n.tag in {"script", "style", "meta", "link"})
    for n in body.walk():
        name = {"a": "href", "img": "src", "source": "src"}.get(n.tag)
        if name and (value := n.attrs.get(name)):
            n.attrs[name] = "https:" + value if value.startswith("//") else urljoin(base, value[2:]) if value.startswith("./") else urljoin(host, value) if value.startswith("/") else value
    return body


def _category(link: Node) -> Node | str:
    return f"\nCategory: {link.attrs['href']}\n" if CATEGORY_REL in link.attrs.get("rel", "") and link.attrs.get("href") else link


def markdown(node: Node) -> str:
    """ATX headings, '-' bullets, links, images, emphasis, tables, code, quotes; span unwraps. Children come before
    their parent, on a stack of (node, children to do, text so far)."""
    stack: list[tuple[Node, Iterator[Node | str], list[str]]] = [(node, iter(node.children), [])]
    while True:
        node, rest, parts = stack[-1]
        child = next(rest, None)
        if isinstance(child, Node):
            stack.append((child, iter(child.children), []))
        elif child is not None:
            parts.append(child if child.startswith("\nCategory: ") else re.sub(r"[ \t\r\n]+", " ", child))
        else:
            stack.pop()
            text = _marked(node, "".join(parts))
            if not stack:
                return text
            stack[-1][2].append(text)


def _marked(node: Node, inner: str) -> str:
    """An element's Markdown around that of its content."""
    t = node.tag
    if t in HEADINGS:
        return f"\n\n{'#' * int(t[1])} {inner.strip()}\n\n"
    if t in {"p", "div", "article", "section", "header", "footer", "nav", "main", "ul", "ol", "dl"}:
        return f"\n\n{inner.strip()}\n\n" if inner.strip() else ""
    if t == "li":
        return "\n- " + inner.strip().replace("\n", "\n  ")
    if t in {"b", "strong", "i", "em"} and inner.strip():
        mark = "**" if t in {"b", "strong"} else "*"
        return f"{mark}{inner.strip()}{mark}" + " " * inner.endswith(" ")
    if t == "a" and inner.strip():
        return f"[{inner.strip()}]({node.attrs['href']})" if node.attrs.get("href") else inner
    if t == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    if t == "br":
        return "  \n"
    if t == "hr":
        return "\n\n---\n\n"
    if t in {"td", "th"}:
        return f" {inner.strip()} |"
    if t == "tr":
        rule = "\n|" + " --- |" * sum(isinstance(c, Node) for c in node.children) if any(isinstance(c, Node) and c.tag == "th" for c in node.children) else ""
        return "\n|" + inner + rule
    if t == "table":
        return f"\n\n{inner.strip()}\n\n"
    if t in {"code", "pre"}:
        return f"`{inner.strip()}`" if t == "code" else f"\n\n```\n{''.join(node.strings())}\n```\n\n"
    if t == "blockquote":
        return "\n\n> " + inner.strip().replace("\n", "\n> ") + "\n\n"
    return inner


_ARROW = {"int": pa.int32(), "string": pa.string()}


def page_rows(batches: Iterator[pa.RecordBatch], schema: str, rows) -> Iterator[pa.RecordBatch]:
    """page_id and schema's columns, some PAGE_BYTES of pages at a time, which bounds what is held of them."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    for batch in (part for whole in batches for part in portions(whole, PAGE_BYTES)):
        made = [rows(h) for h in batch.column(1).to_pylist()]
        # ids ride along in Arrow: a null among them leaves the others as they are
        ids = batch.column(0).take(pa.array([i for i, own in enumerate(made) for _ in own], pa.int64()))
        columns = zip(*[r for own in made for r in own], strict=True) if len(ids) else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, _ARROW[kind]) for c, kind in zip(columns, kinds, strict=True))], ["page_id", *names])


def per_page(pages: DataFrame, schema: str, rows) -> DataFrame:
    """rows(html) gives tuples of schema's columns; page_id is put before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from page_rows(batches, schema, rows)

    return pages.select("page_id", "html").mapInArrow(run, f"page_id long, {schema}")


def html_blocks(pages: DataFrame) -> DataFrame:
    return per_page(pages, "ord int, tag string, block string", lambda h: [(i, *b) for i, b in enumerate(blocks(h))])


def block_text(pages: DataFrame) -> DataFrame:
    """page_id, text: the blocks of a page joined with newlines."""
    return per_page(pages, "text string", lambda h: [("\n".join(b for _, b in blocks(h)),)])


def category_lines(pages: DataFrame) -> DataFrame:
    return per_page(pages, "ord int, line string", lambda h: list(enumerate(x for x in (s.strip() for s in faithful(h, "", "").strings()) if x.startswith("Category: "))))


def to_markdown(pages: DataFrame, host: str, base: str) -> DataFrame:
    """page_id, text: Markdown before normalization."""
    return per_page(pages, "text string", lambda h: [(markdown(faithful(h, host, base)),)])
