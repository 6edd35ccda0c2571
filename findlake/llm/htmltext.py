"""Visible text of HTML pages, laid out.

The standard library's tokenizer feeds a tree builder that supplies implied end and start tags. The page's style sheets and
style attributes are resolved for the three properties that say what text can be seen and how its spaces count. Rendering walks
the tree: elements that are not displayed are left out, as is text that style makes invisible; blocks stand on lines of their own
with a blank line around paragraphs, list items are marked and indented, and table cells are padded to common columns.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from unicodedata import east_asian_width

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.arrow import append_columns

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head title style script template datalist iframe audio video canvas desc metadata defs annotation annotation-xml rp param".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
BLOCKS = SPACED | set("html body div section article aside header footer nav main address center details dialog dd dt li fieldset figcaption form hgroup hr legend optgroup option summary tr td th thead tbody tfoot caption search menu".split())
#: A start tag of the key ends an open element of the value.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th", "tbody", "tfoot", "caption", "colgroup"}, "tbody": {"tr", "td", "th", "thead", "tfoot", "tbody", "caption", "colgroup"},
    "tfoot": {"tr", "td", "th", "thead", "tbody", "caption", "colgroup"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "rp": {"rt", "rp"}, "rt": {"rt", "rp"},
    "body": {"head"},
}
#: Open elements are searched up to one of these.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "legend"}
HEAD_ONLY = set("base link meta title style script template noscript head".split())
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility|white-space)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
#: Values that say nothing for the property, or that stand for the parent's.
NOT_VALUES = set("inherit unset revert revert-layer".split())
VISIBILITIES = set("visible hidden collapse initial".split())
#: How the spaces of a text count: collapsed (the default), kept, or kept at line ends only.
COLLAPSED, KEPT, LINES = 0, 1, 2
WHITE_SPACE = {"pre": KEPT, "pre-wrap": KEPT, "break-spaces": KEPT, "pre-line": LINES, "normal": COLLAPSED, "nowrap": COLLAPSED, "initial": COLLAPSED}
#: A selector's part: a name, classes and an id; other selectors (attributes, states, siblings) match nothing.
COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
#: Conditions of a style sheet's blocks under which a page on a screen is seen.
SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:all|screen)\s*$|@layer\b", re.I)
#: Kinds of input whose value is read as text.
SHOWN_INPUTS = set("button submit reset text search url tel email number".split())
LARGEST_COLSPAN, LARGEST_ROWSPAN = 1000, 65534
SPACES = re.compile(r"[ \t\n\r\f]+")
#: An element deeper than this joins its parent; text is never lost.
DEEPEST = 400


class Node:
    __slots__ = ("tag", "attrs", "children", "style")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []
        #: declared values by property
        self.style: dict[str, str] = {}


class TreeBuilder(HTMLParser):
    """Tokens to a tree with implied tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def _close(self, tags: set[str], scope: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                del self.open[i:]
                # more than one may be open, as a cell in a row
                self._close(tags, scope)
                return
            if tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        if self.open[-1].tag == "head" and tag not in HEAD_ONLY:
            self.open.pop()
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"table", "td", "th", "button", "caption", "object"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES.get(tag, set()))
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", {})
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def _push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self.open.append(node)

    def _foreign(self) -> bool:
        """Whether the newest element stands in a drawing or a formula, and not in a page inside it."""
        for node in reversed(self.open[:-1]):
            if node.tag in ("svg", "math"):
                return True
            if node.tag in ("foreignobject", "annotation-xml"):
                return False
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        # a slash ends elements of drawings and formulas only
        if len(self.open) > depth and self.open[-1].tag == tag and (tag in ("svg", "math") or self._foreign()):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        scope = SCOPES.get(tag, {"table"} if tag not in ("table",) else set())
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in scope and self.open[i].tag != tag:
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.open.pop()
        self.open[-1].children.append(data)


def _declared(text: str) -> list[tuple[str, str, bool]]:
    """The (property, value, important) of declarations that matter here and hold a value that is known."""
    out = []
    for name, value, important in DECLARATION.findall(text):
        name, value = name.lower(), value.lower()
        known = VISIBILITIES if name == "visibility" else WHITE_SPACE if name == "white-space" else None
        if value in NOT_VALUES or known is None or value in known:
            out.append((name, value, bool(important)))
    return out


def _blocks(sheet: str) -> list[tuple[str, str]]:
    """The (head, body) of the outermost blocks of a style sheet; statements without a block are left out."""
    out, at, depth, head, start = [], 0, 0, "", 0
    for m in re.finditer(r"[{};]", sheet):
        c = m.group()
        if c == "{":
            if depth == 0:
                head, start = sheet[at : m.start()].strip(), m.end()
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append((head, sheet[start : m.start()]))
                at = m.end()
        elif depth == 0:
            at = m.end()
    if depth:  # a sheet that breaks off ends its blocks
        out.append((head, sheet[start:] + "}" * (depth - 1)))
    return out


class Rules:
    """Rules of a page's style sheets, found by the last part of their selectors.

    Names, classes and ids, and their nesting by blanks or ``>``, are taken; by weight, then order, the last rule counts.
    """

    def __init__(self, sheets: list[str]) -> None:
        self.by_end: dict[str, list] = {}
        self.count = 0
        for sheet in sheets:
            self._add(re.sub(r"(?s)/\*.*?(?:\*/|\Z)|<!--|-->", " ", sheet))

    def _add(self, sheet: str) -> None:
        todo = list(reversed(_blocks(sheet)))
        while todo:
            head, body = todo.pop()
            if head.startswith("@"):
                todo += reversed(_blocks(body)) if SCREEN.match(head) else []
                continue
            if said := _declared(body):
                for selector in head.split(","):
                    self._selector(selector, said)

    def _selector(self, selector: str, said: list) -> None:
        parts, weight, joint = [], [0, 0, 0], " "
        for word in re.sub(r"\s*>\s*", " > ", selector).split():
            if word == ">":
                joint = ">"
                continue
            m = COMPOUND.fullmatch(word)
            if not m:
                return
            name = (m[1] or "*").lower()
            marks = re.findall(r"[.#][\w-]+", m[2])
            weight[0] += sum(x[0] == "#" for x in marks)
            weight[1] += sum(x[0] == "." for x in marks)
            weight[2] += name != "*"
            parts.append((joint, name, frozenset(marks)))
            joint = " "
        if parts:
            self.count += 1
            _, name, marks = parts[-1]
            self.by_end.setdefault(min(marks) if marks else name, []).append((tuple(weight), self.count, parts, said))

    def style(self, path: list[tuple[str, frozenset]], own: str | None) -> dict[str, str]:
        """Declared values of the last of ``path``, each a name with its classes and id; ``own`` is its style attribute."""
        name, marks = path[-1]
        ranked: dict[str, tuple] = {}

        def offer(said: list, rank: tuple) -> None:
            for prop, value, important in said:
                if prop not in ranked or ranked[prop][0] <= (important, rank):
                    ranked[prop] = ((important, rank), value)

        for key in ("*", name, *marks) if self.by_end else ():
            for weight, order, parts, said in self.by_end.get(key, ()):
                if _matches(parts, path):
                    offer(said, (0, weight, order))
        if own:
            offer(_declared(own), (1, (0, 0, 0), 0))
        return {prop: value for prop, (_, value) in ranked.items()}


def _matches(parts: list, path: list) -> bool:
    """Whether a selector's parts match the last element of a path."""
    # (parts left, elements left): every split of the path between parts is tried once
    last, todo, seen = len(parts) - 1, [(len(parts) - 1, len(path) - 1)], set()
    while todo:
        i, at = todo.pop()
        if at < 0 or (i, at) in seen:
            continue
        seen.add((i, at))
        joint, name, marks = parts[i]
        if name in ("*", path[at][0]) and marks <= path[at][1]:
            if i == 0:
                return True
            todo.append((i - 1, at - 1))
        # only the child joint of the part behind ties a part to one place
        if i < last and parts[i + 1][0] == " ":
            todo.append((i, at - 1))
    return False


def _resolve(root: Node) -> None:
    """Set the declared style of every element, from the sheets of the page and its own attribute."""
    sheets, todo, nodes = [], [root], False
    while todo:
        node = todo.pop()
        nodes |= "style" in node.attrs
        if node.tag == "style" and (node.attrs.get("media") or "all").strip().lower() in ("all", "screen"):
            sheets.append("".join(c for c in node.children if isinstance(c, str)))
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    rules = Rules(sheets)
    if not rules.by_end and not nodes:
        return
    stack: list = [(root, 0)]
    path: list[tuple[str, frozenset]] = []
    while stack:
        node, depth = stack.pop()
        del path[depth:]
        marks = {f".{c}" for c in (node.attrs.get("class") or "").split()}
        if node.attrs.get("id"):
            marks.add(f"#{node.attrs['id']}")
        path.append((node.tag, frozenset(marks)))
        node.style = rules.style(path, node.attrs.get("style"))
        stack += [(c, depth + 1) for c in reversed(node.children) if isinstance(c, Node)]


def _hidden(node: Node) -> bool:
    """Whether an element and all in it is not displayed; a declared display shows what only the ``hidden`` attribute hides."""
    if node.tag in HIDDEN:
        return True
    display = node.style.get("display")
    if display and display not in NOT_VALUES:
        return display == "none"
    return "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs


def _visible(node: Node, inherited: bool) -> bool:
    """Whether an element's own text can be seen; elements inside may say otherwise for theirs."""
    said = node.style.get("visibility")
    return inherited if not said or said in NOT_VALUES else said in ("visible", "initial")


def _spaces(node: Node, inherited: int) -> int:
    """How spaces count in an element's own text."""
    said = node.style.get("white-space")
    if said and said not in NOT_VALUES:
        return WHITE_SPACE[said]
    return KEPT if node.tag in ("pre", "textarea") and said is None else inherited


def _number(text: str | None, most: int) -> int | None:
    if not text or not re.fullmatch(r"\s*[0-9]+\s*", text):
        return None
    digits = text.strip().lstrip("0") or "0"
    return most if len(digits) > len(str(most)) else min(most, int(digits))


class Layout:
    """Lines of text with pending spaces and breaks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank, self.space, self.fresh = False, False, True
        self.prefix: list[str] = []
        self.marker = ""

    def text(self, data: str, keep: int) -> None:
        if keep == LINES:
            for i, part in enumerate(re.split(r"\r\n|\r|\n", data)):
                if i:
                    self._end(True)
                self.text(part, COLLAPSED)
            return
        if keep == KEPT:
            first = True
            for part in data.replace("\r\n", "\n").split("\n"):
                if not first:
                    self._end(True)
                first = False
                if part:
                    self._add(part)
            return
        parts = SPACES.split(data)
        for i, part in enumerate(parts):
            if i and self.line:
                self.space = True
            if part:
                if self.space and self.line:
                    self.line.append(" ")
                self.space = False
                self._add(part)

    def _add(self, part: str) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.line.append("".join(self.prefix[:-1]) + self.marker if self.marker else "".join(self.prefix))
            self.marker = ""
        self.line.append(part)

    def _end(self, force: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
        elif force and self.lines:
            self.blank = True
        self.line, self.space = [], False

    def block(self, spaced: bool) -> None:
        self._end()
        self.blank |= spaced and bool(self.lines)

    def rows(self, rows: list[str]) -> None:
        self.block(True)
        for row in rows:
            self._add(row)
            self._end()
        self.block(True)

    def result(self) -> str:
        self._end()
        return "\n".join(self.lines)


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in text)


def _cells(table: Node, visible: bool) -> tuple[list[tuple[list[Node], bool]], list[Node]]:
    """The rows of cells of a table that aren't in an inner table, each with whether its text can be seen, and the captions."""
    rows, captions, todo = [], [], [(c, visible) for c in reversed(table.children) if isinstance(c, Node)]
    while todo:
        node, seen = todo.pop()
        if _hidden(node):
            continue
        if node.tag == "caption":
            captions.append(node)
        seen = _visible(node, seen)
        if node.tag == "tr":
            rows.append(([c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and not _hidden(c)], seen))
        elif node.tag in ("thead", "tbody", "tfoot"):
            todo += [(c, seen) for c in reversed(node.children) if isinstance(c, Node)]
    return rows, captions


def _loose(table: Node, visible: bool) -> list[tuple]:
    """What stands in a table outside its cells, with whether it can be seen: rendered before it, as browsers move it there."""
    out, todo = [], [(c, visible) for c in reversed(table.children)]
    while todo:
        child, seen = todo.pop()
        if isinstance(child, str):
            if child.strip():
                out.append((child, seen))
        elif child.tag in ("thead", "tbody", "tfoot", "tr"):
            if not _hidden(child):
                todo += [(c, _visible(child, seen)) for c in reversed(child.children)]
        elif child.tag not in ("td", "th", "caption", "colgroup", "col"):
            out.append((child, seen))
    return out


def _table(node: Node, out: Layout, visible: bool, spaces: int) -> None:
    for child, seen in _loose(node, visible):
        _walk([child], out, seen, spaces)
    rows, captions = _cells(node, visible)
    for caption in captions:
        out.block(True)
        _walk(caption.children, out, _visible(caption, visible), _spaces(caption, spaces))
        out.block(False)
    # each row's cells as (column, columns, text); a cell that goes on below keeps its columns there
    drawn: list[list[tuple[int, int, str]]] = []
    held: dict[int, int] = {}
    for i, (row, seen) in enumerate(rows):
        cells, at = [], 0
        for cell in row:
            while held.get(at, 0) > i:
                at += 1
            inner = Layout()
            _walk(cell.children, inner, _visible(cell, seen), _spaces(cell, spaces))
            span = _number(cell.attrs.get("colspan"), LARGEST_COLSPAN) or 1
            down = _number(cell.attrs.get("rowspan"), LARGEST_ROWSPAN)
            cells.append((at, span, inner.result()))
            for c in range(at, at + span):
                held[c] = len(rows) if down == 0 else i + (down or 1)
            at += span
        if cells:
            drawn.append(cells)
    if not drawn:
        return
    if max(c + s for row in drawn for c, s, _ in row) == 1:  # one column: a plain sequence of blocks
        for row in drawn:
            for _, _, text in row:
                out.block(False)
                for line in text.split("\n"):
                    out._add(line) if line else out.block(True)
                    out._end()
        out.block(True)
        return
    # a column in which no cell begins takes no room
    widths = {at: 0 for row in drawn for at, _, _ in row}
    columns = sorted(widths)
    for row in drawn:
        for at, span, text in row:
            if span == 1:
                widths[at] = max(widths[at], *[_width(x) for x in text.split("\n")])
    lines = []
    for row in drawn:
        split = [text.split("\n") for _, _, text in row]
        for i in range(max(map(len, split))):
            line, at = "", 0
            for k, (start, span, _) in enumerate(row):
                # columns that a cell of an earlier row holds
                line += "".join(" " * widths[c] + " | " for c in columns if at <= c < start)
                own = split[k][i] if i < len(split[k]) else ""
                taken = [widths[c] for c in columns if start <= c < start + span]
                room = sum(taken) + 3 * (len(taken) - 1)
                line += own + (" " * max(0, room - _width(own)) + " | " if k < len(row) - 1 else "")
                at = start + span
            lines.append(line.rstrip())
    out.rows(lines)


def _walk(children: list, out: Layout, visible: bool = True, spaces: int = COLLAPSED) -> None:
    """Emit children; tables recurse (elements nest DEEPEST deep at most), everything else is on a stack of its own."""
    todo: list = [("see", c, spaces, visible) for c in reversed(children)]
    counters: list[int | None] = []
    while todo:
        what, node, keep, seen = todo.pop()
        if what == "done":
            if node.tag in ("ul", "ol", "menu") and counters:
                counters.pop()
            if node.tag in ("li", "blockquote", "dd"):
                out.marker = ""
                out.prefix.pop()
            out.block(node.tag in SPACED and not (node.tag in ("ul", "ol") and counters))
            continue
        if isinstance(node, str):
            if seen:
                out.text(node, keep)
            continue
        if _hidden(node):
            continue
        tag, seen, keep = node.tag, _visible(node, seen), _spaces(node, keep)
        if tag == "br":
            out._end(True)
        elif tag == "hr":
            out.block(True)
        elif tag in ("img", "input"):
            kind = (node.attrs.get("type") or "text").strip().lower()
            shown = node.attrs.get("alt") if tag == "img" or kind == "image" else node.attrs.get("value") if kind in SHOWN_INPUTS else None
            if shown and seen:
                out.text(shown, COLLAPSED)
        elif tag == "table":
            out.block(True)
            _table(node, out, seen, keep)
            out.block(True)
        else:
            if tag in BLOCKS:
                out.block(tag in SPACED and not (tag in ("ul", "ol") and counters))
                if tag in ("ul", "ol", "menu"):
                    start = node.attrs.get("start") or "1"
                    counters.append(int(start) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else 1 if tag == "ol" else None)
                elif tag == "li":
                    number = counters[-1] if counters else None
                    if number is not None:
                        counters[-1] = number + 1
                    out.marker = "- " if number is None else f"{number}. "
                    # lines after the first, and lists inside, are indented below the text
                    out.prefix.append(" " * len(out.marker))
                elif tag in ("blockquote", "dd"):
                    out.prefix.append("  ")
                todo.append(("done", node, keep, seen))
            label = node.attrs.get("label") if tag in ("optgroup", "option") else None
            if label and tag == "option":  # stands in for the text
                todo.append(("see", label, keep, seen))
                continue
            todo += [("see", c, keep, seen) for c in reversed(node.children)]
            if label and seen:
                out.text(label, COLLAPSED)
                out.block(False)


def extract(html: str | None) -> str:
    """The visible text of a page; empty for a null or empty one. A tag in which the page breaks off counts as text.

    The page is shown as without scripts and plug-ins, with details and lists of options open; input fields show their values.
    Of style sheets, the page's own rules on names, classes and ids count, whatever they are nested in; rules on attributes, states
    and siblings, those for other media or window sizes, and sheets in files of their own don't.
    """
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    _resolve(builder.root)
    out = Layout()
    _walk(builder.root.children, out)
    return out.result().strip("\n")


def extract_text(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``df`` with ``out_col``, the visible text of each whole page (a column of that name is replaced)."""
    return append_columns(df.withColumn(html_col, F.col(html_col).cast("string")), [html_col], [T.StructField(out_col, T.StringType())], lambda: lambda pages: ([extract(p) for p in pages],))
