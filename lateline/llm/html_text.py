"""Visible text of web pages by layout-aware rendering.

A tree builder reads tags, closes what a new tag implies closed (paragraphs, list items, cells,
options), drops stray end tags and closes what is left open at the end. The renderer walks the tree without
recursion, skips what is not shown (scripts, styles, the head, hidden elements), joins inline text
by single blanks, separates blocks by line breaks and paragraphs by an empty line, marks list
items, and pads table cells to columns. Everything visible is kept, navigation included.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style title template noscript iframe object noembed noframes datalist "
             "audio video canvas svg math select".split())
BLOCK = set("html body address article aside blockquote center dd details dialog dir div dl dt fieldset "
            "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu "
            "nav ol p pre search section summary table caption ul".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"},
                                                {"table"})),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}

NAME = re.compile(r"/?([A-Za-z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)"
                       r"(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.items = tag, attrs, []


def tokens(page: str) -> Iterator[tuple]:
    """(kind, name or text, attributes) in order; an unfinished tag at the end is dropped."""
    at, n, lower = 0, len(page), None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", html.unescape(page[at:lt]), None
        if lt >= n:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        found = NAME.match(page, lt + 1)
        if not found:
            if page[lt + 1:lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", None
                at = lt + 1
            continue
        name, at, attrs = found[1].lower(), found.end(), {}
        while part := ATTRIBUTE.match(page, at):
            value = next((v for v in part.groups()[1:] if v is not None), "")
            attrs.setdefault(part[1].lower(), value)
            at = part.end()
        end = page.find(">", at)
        if end < 0:
            return
        at = end + 1
        if page[lt + 1] == "/":
            yield "end", name, None
            continue
        yield "start", name, attrs
        if name in RAW:
            lower = lower if lower is not None else ascii_lower(page)
            end = lower.find(f"</{name}", at)
            end = n if end < 0 else end
            if name in ("textarea", "title"):
                yield "text", html.unescape(page[at:end]), None
            at = end


def ascii_lower(text: str) -> str:
    """``text`` with A-Z in lower case and all positions kept."""
    return text.translate({k: k + 32 for k in range(65, 91)})


def build(page: str) -> Node:
    """The element tree of a page."""
    root = Node("html", {})
    stack, open_tags = [root], {"html": 1}

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    def pop_to(names: set, scope: set) -> None:
        """Close up to the nearest of ``names``, not beyond an element of ``scope``."""
        if not any(open_tags.get(x) for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                outer = k
                while stack[outer - 1].tag in names and outer > 1:
                    outer -= 1
                while len(stack) > outer:
                    pop()
                return
            if stack[k].tag in scope:
                return

    for kind, name, attrs in tokens(page):
        if kind == "text":
            stack[-1].items.append(name)
        elif kind == "start":
            if name == "html":
                root.attrs = {**attrs, **root.attrs}
                continue
            if name in CLOSES:
                pop_to(*CLOSES[name])
            if name in BLOCK and stack[-1].tag != "button":
                pop_to({"p"}, {"td", "th", "button", "table", "caption"})
            if name in BLOCK and open_tags.get("head"):
                pop_to({"head"}, set())
            node = Node(name, attrs)
            stack[-1].items.append(node)
            if name not in VOID:
                stack.append(node)
                open_tags[name] = open_tags.get(name, 0) + 1
        elif name not in ("html", "body") and open_tags.get(name):
            outside = {"table"} if name not in ("table", "div", "body") else set()
            pop_to({name}, outside - {name}) if stack[-1].tag != name else pop()
        elif name == "br":
            stack[-1].items.append(Node("br", {}))
    return root


def hidden(node: Node) -> bool:
    a = node.attrs
    return (node.tag in UNSEEN or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
            or (node.tag == "input")
            or (node.tag == "dialog" and "open" not in a)
            or ("style" in a and HIDING.search(a["style"]) is not None))


class Page:
    """Lines under construction; ``gap`` is the number of line breaks due before more text."""

    def __init__(self):
        self.out: list[str] = []
        self.gap, self.blank, self.indent, self.mark = 0, False, 0, ""

    def block(self, breaks: int) -> None:
        self.gap, self.blank = max(self.gap, breaks), False

    def write(self, text: str) -> None:
        if self.gap or not self.out:
            if self.out:
                self.out.append("\n" * self.gap)
            lead = "  " * self.indent
            self.out.append(lead + self.mark)
            self.mark, self.gap, self.blank = "", 0, False
        elif self.blank:
            self.out.append(" ")
            self.blank = False
        self.out.append(text)

    def inline(self, text: str) -> None:
        plain = SPACE.sub(" ", text)
        core = plain.strip(" ")
        if not core:
            self.blank = self.blank or bool(plain and self.out and not self.gap)
            return
        if plain[0] == " " and self.out and not self.gap:
            self.blank = True
        self.write(core)
        self.blank = plain[-1] == " "

    def exact(self, text: str) -> None:
        for k, line in enumerate(text.split("\n")):
            if k:
                self.gap = min(self.gap + 1, 2) if self.out else 0
            if line.strip():
                self.write(line.rstrip())


def _table(page: Page, rows: list[list[str]]) -> None:
    """Rows of cells, padded to the width of their column (cells of one line only)."""
    widths: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            if k == len(widths):
                widths.append(0)
            widths[k] = max(widths[k], min(len(cell), 40))
    for row in rows:
        if any(row):
            page.block(1)
            page.write("  ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip())


def render(root: Node) -> str:
    """The visible text of a tree."""
    page = Page()
    pages: list[Page] = []
    tables: list[list[list[str]]] = []
    lists: list[list] = []
    pre = 0
    todo: list[tuple] = [("in", root)]
    while todo:
        step, node = todo.pop()
        if step == "in":
            if isinstance(node, str):
                page.exact(node) if pre else page.inline(node)
                continue
            if hidden(node):
                continue
            tag = node.tag
            if tag == "br":
                page.gap = min(page.gap + 1, 2)
                page.blank = False
                continue
            if tag in ("img", "area"):
                if node.attrs.get("alt", "").strip():
                    page.inline(html.unescape(node.attrs["alt"]))
                continue
            if tag in BLOCK:
                page.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                page.indent += bool(lists)
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                page.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                pages.append(page)
                page = Page()
            todo.append(("out", node))
            todo.extend(("in", item) for item in reversed(node.items))
        else:
            tag = node.tag
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                page.indent -= bool(lists)
            elif tag == "li":
                page.mark = ""
            elif tag == "pre":
                pre -= 1
            elif tag in ("td", "th") and tables:
                text = SPACE.sub(" ", "".join(page.out)).strip()
                page = pages.pop()
                tables[-1][-1].append(text)
            elif tag == "table":
                _table(page, tables.pop())
            if tag in BLOCK:
                page.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
    return "".join(page.out)


def extract(page: str | None) -> str:
    return render(build(page)) if page else ""


def visible_text(pages: DataFrame) -> DataFrame:
    """page_id and the visible text of every whole page.

    A null or empty page, and one without visible text, gives an empty text; pages have no length
    limit and may nest to any depth; repeated rows and null ids give a row each; an empty table
    gives an empty result; columns besides page_id and html are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", pages["html"].cast("string").alias("html")).mapInArrow(
        run, f"page_id {id_type}, text string")
