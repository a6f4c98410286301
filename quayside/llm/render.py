"""HTML to text the way a page shows it: tree, visibility, blocks, lists and aligned tables."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quayside.llm.common import rows_of

# Fixed values of the HTML standard: elements without content, of raw content, never shown, and of blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style template noscript iframe object embed audio video canvas datalist noembed noframes title".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp table figure fieldset hr".split())
BLOCKS = SPACED | frozenset("html body address article aside center details dd dialog dir div dt figcaption footer form header hgroup legend li "
                            "main menu nav section summary caption option optgroup thead tbody tfoot tr td th".split())
# An opening tag ends open elements of the second set, looking no further up than one of the third.
ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot tr td th caption colgroup", "table"), "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tfoot": ("thead tbody tfoot tr td th caption colgroup", "table"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
ENDS_P = BLOCKS - frozenset("html body option optgroup thead tbody tfoot tr td th caption legend summary figcaption".split())
# SVG and MathML: what never shows where it stands, elements that hold HTML again, HTML that ends an SVG or MathML left open, and
# elements whose parts stand apart.
FOREIGN_UNSEEN = {
    "svg": frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter style script".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
HOLDS_HTML = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext annotation-xml".split())}
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
                       "ruby s small span strong strike sub sup table tt u ul var".split())
APART = frozenset("mfrac mroot msub msup msubsup munder mover munderover mmultiscripts mtr mlabeledtr".split())
# Types of input that show no value as text.
WORDLESS = frozenset("hidden password checkbox radio range color file image".split())
P_SCOPE = frozenset("td th caption button object li dd dt body html table blockquote div article section".split())

# A quote opens a value only after the equals sign of an attribute; one that is not closed, or stands elsewhere, is a character like others.
_PAIR = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"
# Attributes run on to the first > outside a closed quote, so a tag that ends nowhere is one whose run reaches the end of the page.
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_PAIR})*+)>", re.S)
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_SHEET_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_SHEET_MARK = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|url\([^)]*\)|[{};]", re.I | re.S)
_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_SELECTOR_END = re.compile(r",(?![^(\[]*[)\]])")
_IMPORTANT = re.compile(r"\s*!\s*important\Z")
_NOT_SHOWN = {"display": ("none",), "visibility": ("hidden", "collapse")}
_BLANKS = re.compile(r"[ \t\n\r\f]+")

# Deeper elements are placed at this depth; table columns are padded to this width at most. No text is lost by either.
DEEPEST, WIDEST = 100, 80


@dataclass
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    space: str = ""  # svg or math, or HTML
    inside: str = ""  # the same for its children


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


class _Builder:
    """A tree from tags: missing end tags are put where the next tag implies them, and so are ``body`` and ``tbody``."""

    def __init__(self):
        self.root = Element("html")
        self.open = [self.root]
        self.styles: list[str] = []

    def _end(self, tags: frozenset[str], scope: frozenset[str]):
        """Ends the outermost open element of ``tags`` above the nearest element of ``scope``."""
        lowest = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                lowest = i
            elif self.open[i].tag in scope:
                break
        if lowest is not None:
            del self.open[lowest:]

    def _leave_head(self, tag: str):
        if len(self.open) > 1 and self.open[1].tag == "head" and tag not in HEAD_ONLY:
            del self.open[1:]

    def start(self, tag: str, source: str) -> bool:
        """Opens an element; tells whether it takes content."""
        if tag in ("html", "body"):
            self._leave_head(tag)
            (self.root if tag == "html" else self.open[-1]).attributes.update(_attributes(source) if tag == "html" else {})
            if tag == "body" and len(self.open) == 1:
                self._push(Element("body", _attributes(source)))
            return False
        self._leave_head(tag)
        if self.open[-1].inside and tag in BREAKS_OUT:
            while self.open[-1].inside:
                self.open.pop()
        space = tag if tag in FOREIGN_UNSEEN else self.open[-1].inside
        if space:
            element = Element(tag, _attributes(source), [], space, "" if tag in HOLDS_HTML[space] else space)
            if source.endswith("/"):
                self.open[-1].children.append(element)
                return False
            self._push(element)
            return True
        if tag in ENDS_P:
            self._end(frozenset(["p"]), P_SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "tr" and self.open[-1].tag == "table":
            self._push(Element("tbody"))
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Element("tr"))
        element = Element(tag, _attributes(source))
        if tag in VOID:
            self.open[-1].children.append(element)
            return False
        self._push(element)
        return True

    def _push(self, element: Element):
        if len(self.open) == DEEPEST:
            self.open.pop()
        self.open[-1].children.append(element)
        self.open.append(element)

    def end(self, tag: str):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if tag not in BLOCKS and self.open[i].tag in ("td", "th", "table"):  # a stray inline end tag ends no cell
                return

    def text(self, text: str):
        if text:
            if text.strip():
                self._leave_head("")
            self.open[-1].children.append(html.unescape(text))


def build(source: str) -> tuple[Element, list[str]]:
    """The tree of a page and its style sheets. What is no tag is text; nothing makes it fail."""
    tree, at, start = _Builder(), 0, source.find("<")
    while start >= 0:
        after = source[start + 1:start + 3]
        m = None
        if after[:1].isascii() and after[:1].isalpha() or after[:1] == "/" and after[1:].isascii() and after[1:].isalpha():
            m = _TAG.match(source, start)
            if m is None:  # it ends nowhere, nor does any tag after it: read once, the rest is text
                break
        elif after[:1] not in ("!", "?", "/") or not after:
            start = source.find("<", start + 1)
            continue
        tree.text(source[at:start])
        if m is None:  # a comment, or what is read as one
            at = _comment_end(source, start, tree)
            start = source.find("<", at)
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            tree.end(tag)
        elif tree.start(tag, m[3]) and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            raw, at = source[at:close.start() if close else len(source)], close.end() if close else len(source)
            if tag == "style":
                if _on_screen(tree.open[-1].attributes.get("media", "")):
                    tree.styles.append(raw)
            elif tag == "textarea":
                tree.open[-1].children.append(html.unescape(raw))
            elif tag == "xmp":
                tree.open[-1].children.append(raw)
            tree.end(tag)
        start = source.find("<", at)
    tree.text(source[at:])
    return tree.root, tree.styles


def _comment_end(source: str, start: int, tree: _Builder) -> int:
    """Where a comment ends that begins at ``start``; the text of a CDATA section inside SVG or MathML goes to the tree."""
    if source.startswith("<!--", start):
        if source.startswith((">", "->"), start + 4):  # <!--> and <!---> are whole comments
            return source.index(">", start) + 1
        end = _COMMENT_END.search(source, start + 4)
        return end.end() if end else len(source)
    if tree.open[-1].space and source.startswith("<![CDATA[", start):
        close = source.find("]]>", start)
        tree.open[-1].children.append(source[start + 9:close if close >= 0 else len(source)])
        return close + 3 if close >= 0 else len(source)
    end = source.find(">", start)
    return end + 1 if end >= 0 else len(source)


def _blocks(sheet: str) -> Iterator[tuple[str, str]]:
    """What stands before each outermost pair of braces, and what stands within it."""
    depth = start = 0
    before = ""
    for m in _SHEET_MARK.finditer(sheet):
        if m[0] == "{":
            if not depth:
                before, start = sheet[start:m.start()].strip(), m.end()
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                yield before, sheet[start:m.start()]
                start = m.end()
        elif m[0] == ";" and not depth and sheet[start:m.start()].lstrip().startswith("@"):
            start = m.end()
    if depth:
        yield before, sheet[start:]


def _declared(body: str) -> dict[str, tuple[bool, str]]:
    """The values of ``display`` and ``visibility`` that a rule's body gives, and whether they are important; nested rules do not count."""
    depth, start, parts = 0, 0, []
    for m in _SHEET_MARK.finditer(body):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            start = m.end()
        elif m[0] == ";" and not depth:
            parts.append(body[start:m.start()])
            start = m.end()
    if not depth:
        parts.append(body[start:])
    found: dict[str, tuple[bool, str]] = {}
    for part in parts:
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in _NOT_SHOWN:
            important = _IMPORTANT.search(value) is not None
            value = _IMPORTANT.sub("", value)
            if re.fullmatch(r"[a-z-]+(?: [a-z-]+)*", value) and (important or not found.get(name, (False,))[0]):
                found[name] = (important, value)
    return found


def _on_screen(media: str) -> bool:
    """Whether a media list holds for every screen."""
    return not media.strip() or any(m.lower().split() in (["all"], ["screen"], ["only", "screen"]) for m in media.split(","))


# Rules by what the element must have: tag, classes and id, weight of the selector, declarations.
Rules = dict[str, list[tuple[str, frozenset[str], tuple, dict[str, tuple[bool, str]]]]]


def sheet_rules(styles: list[str]) -> Rules:
    """Rules on ``display`` and ``visibility`` whose selector is a tag, classes and an id, by the last of these.

    Only what holds on every screen counts: the bodies of ``@media`` are read for ``all``
    and ``screen``, not for print or for screens of some width.
    """
    rules: Rules = {}
    order = 0

    def read(sheet: str, depth: int):
        nonlocal order
        for before, body in _blocks(sheet):
            if before.startswith("@"):
                kind, condition = re.match(r"@([\w-]*)(.*)", before.lower(), re.S).groups()
                if depth < DEEPEST and (kind == "layer" or (kind == "media" and _on_screen(condition))
                                        or (kind == "supports" and "not" not in condition.split())):
                    read(body, depth + 1)
                continue
            declared = _declared(body)
            for selector in _SELECTOR_END.split(before) if declared else ():
                m = _SELECTOR.fullmatch(selector.strip())
                if m and m[0]:
                    order += 1
                    tag, names = (m[1] or "*").lower(), re.findall(r"[.#][\w-]+", m[2])
                    ids = sum(n[0] == "#" for n in names)
                    weight = (ids, len(names) - ids, int(tag != "*"), order)
                    rules.setdefault(names[-1] if names else tag, []).append((tag, frozenset(names), weight, declared))
    for sheet in styles:
        read(_SHEET_COMMENT.sub("", sheet), 0)
    return rules


def shown(element: Element, rules: Rules) -> bool:
    """Whether an element shows, where all around it does: of the declarations that meet it the strongest decides."""
    a = element.attributes
    if element.tag in FOREIGN_UNSEEN.get(element.space, UNSEEN) or (element.tag == "dialog" and "open" not in a):
        return False
    if not rules and "style" not in a and "hidden" not in a and element.space != "svg":
        return True
    # Values by strength: important, in the style attribute, weight of the selector. The hidden attribute is the weakest, with those of SVG.
    given: dict[str, list] = {"display": [((False, False, ()), "none")] if "hidden" in a and element.space != "svg" else [], "visibility": []}
    if element.space == "svg":
        for name, values in given.items():
            if name in a:
                values.append(((False, False, ()), a[name].strip().lower()))
    if rules:
        names = {f".{c}" for c in a.get("class", "").split()}
        if "id" in a:
            names.add(f"#{a['id']}")
        for key in (*names, element.tag, "*"):
            for tag, needed, weight, declared in rules.get(key, ()):
                if tag in ("*", element.tag) and needed <= names:
                    for name, (important, value) in declared.items():
                        given[name].append(((important, False, weight), value))
    if "style" in a:
        for name, (important, value) in _declared(a["style"]).items():
            given[name].append(((important, True, ()), value))
    return all(not values or max(values)[1] not in _NOT_SHOWN[name] for name, values in given.items())


def _width(text: str) -> int:
    """Columns on a screen: wide East Asian characters take two, combining marks none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Flow:
    """Lines of a block, with the blank lines that blocks keep from each other."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.space = 0, False

    def inline(self, text: str, keep_blanks: bool):
        if keep_blanks:
            for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
                if i:
                    self.line_break()
                if line:
                    self.parts.append(line)
            return
        words = _BLANKS.sub(" ", text)
        lead, words = words[:1] == " ", words.strip(" ")
        self.space = self.space or lead
        if words:
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(words)
            self.space = text[-1] in " \t\n\r\f"

    def flush(self):
        if self.parts:
            self.put(["".join(self.parts)])
        self.parts, self.space = [], False

    def put(self, lines: list[str]):
        if not lines:
            return
        if self.lines:
            self.lines += [""] * self.gap
        self.lines += lines
        self.gap = 0

    def line_break(self):
        if self.parts:
            self.flush()
        elif self.lines:
            self.gap += 1

    def margin(self, blank: int):
        self.flush()
        self.gap = max(self.gap, blank)


class _Painter:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.labels = False  # within a text of SVG
        self.items = 0  # open list items: a list within one keeps no blank lines around it

    def block(self, element: Element, keep_blanks: bool = False) -> list[str]:
        flow = _Flow()
        self.children(element, flow, keep_blanks)
        flow.flush()
        return flow.lines

    def children(self, element: Element, flow: _Flow, keep_blanks: bool):
        number = int(element.attributes.get("start", "1")) if re.fullmatch(r"-?\d{1,9}", element.attributes.get("start", "1")) else 1
        for child in element.children:
            if isinstance(child, str):
                flow.inline(child, keep_blanks)
            elif shown(child, self.rules):
                if child.tag == "li":
                    self.item(child, flow, f"{number}. " if element.tag == "ol" else "- ", keep_blanks)
                    number += 1
                else:
                    self.element(child, flow, keep_blanks)

    def item(self, element: Element, flow: _Flow, mark: str, keep_blanks: bool):
        flow.flush()
        self.items += 1
        lines = self.block(element, keep_blanks)
        self.items -= 1
        flow.put([(mark if i == 0 else " " * len(mark) if line else "") + line for i, line in enumerate(lines)])

    def element(self, element: Element, flow: _Flow, keep_blanks: bool):
        tag = element.tag
        if element.space:
            self.foreign(element, flow, keep_blanks)
        elif tag == "br":
            flow.line_break()
        elif tag == "table":
            flow.margin(1)
            flow.put(self.table(element))
            flow.margin(1)
        elif tag in ("ul", "ol", "menu", "dir", "blockquote", "dd"):
            is_list = tag not in ("blockquote", "dd")
            blank = 1 if tag in SPACED and not (is_list and self.items) else 0
            flow.margin(blank)
            lines = self.block(element, keep_blanks)
            flow.put([("" if is_list else "  ") + line if line else "" for line in lines])
            flow.margin(blank)
        elif tag in BLOCKS:
            flow.margin(1 if tag in SPACED else 0)
            self.children(element, flow, keep_blanks or tag in ("pre", "xmp"))
            flow.margin(1 if tag in SPACED else 0)
        elif tag == "input":
            if element.attributes.get("type", "").strip().lower() not in WORDLESS:
                flow.inline(element.attributes.get("value", ""), False)
        else:
            self.children(element, flow, keep_blanks or tag == "textarea")

    def foreign(self, element: Element, flow: _Flow, keep_blanks: bool):
        """SVG shows its ``text`` and embedded HTML, each on lines of its own; MathML shows its text, the parts of a fraction, script or row apart."""
        tag = element.tag
        if element.space == "svg":
            if tag in ("text", "foreignobject"):
                flow.margin(0)
                outer, self.labels = self.labels, tag == "text"
                self.children(element, flow, keep_blanks)
                self.labels = outer
                flow.margin(0)
            elif self.labels:
                if "x" in element.attributes:  # placed anew
                    if {"y", "dy"} & element.attributes.keys():
                        flow.margin(0)
                    flow.space = True
                self.children(element, flow, keep_blanks)
            else:
                for child in element.children:
                    if not isinstance(child, str) and shown(child, self.rules):
                        self.element(child, flow, keep_blanks)
        elif tag in APART:
            if tag in ("mtr", "mlabeledtr"):
                flow.margin(0)
            for child in element.children:
                flow.space = True
                if isinstance(child, str):
                    flow.inline(child, keep_blanks)
                elif shown(child, self.rules):
                    self.element(child, flow, keep_blanks)
            flow.space = True
            if tag in ("mtr", "mlabeledtr"):
                flow.margin(0)
        else:
            apart = tag == "math" and element.attributes.get("display", "").strip().lower() == "block"
            if apart:
                flow.margin(0)
            self.children(element, flow, keep_blanks)
            if apart:
                flow.margin(0)

    def table(self, table: Element) -> list[str]:
        """Rows of cells, padded so that the cells of a column start at the same place; a caption first."""
        captions, rows, around = [], [], []

        def gather(element: Element):
            for child in element.children:
                if isinstance(child, str):
                    if child.strip():
                        around.append(_BLANKS.sub(" ", child).strip())
                elif shown(child, self.rules):
                    if child.tag == "tr":
                        cells = [c for c in child.children if isinstance(c, Element) and c.tag in ("td", "th") and shown(c, self.rules)]
                        rows.append((element, [(self.block(c), self.span(c), self.span(c, "rowspan", 65534)) for c in cells]))
                        loose = Element("div", {}, [c for c in child.children if isinstance(c, str) or c.tag not in ("td", "th")])
                        around.extend(self.block(loose))
                    elif child.tag in ("thead", "tbody", "tfoot"):
                        gather(child)
                    elif child.tag == "caption":
                        captions.extend(self.block(child))
                    elif child.tag not in ("col", "colgroup"):
                        around.extend(self.block(child))
        gather(table)
        widths: list[int] = []
        placed: list[list[tuple[int, list[str], int]]] = []  # column, lines and columns of each cell
        spread: list[tuple[int, int, int]] = []
        group, hanging = None, []  # columns that cells of rows above hold, from, to and for how many rows more: within a row group
        for section, row in rows:
            if section is not group:
                group, hanging = section, []
            at, k, cells, held = 0, 0, [], []
            for lines, span, down in row:
                while k < len(hanging) and hanging[k][0] <= at:
                    at = max(at, hanging[k][1])
                    k += 1
                widths += [0] * (at + 1 - len(widths))
                if span == 1:
                    widths[at] = max([widths[at], *map(_width, lines)])
                cells.append((at, lines, span))
                if down != 1:
                    held.append((at, at + span, down - 1 if down else len(rows)))
                    if span > 1:
                        spread.append((at, at + span, max(map(_width, lines), default=0)))
                at += span
            placed.append(cells)
            if hanging or held:
                hanging = sorted([(a, b, left - 1) for a, b, left in hanging if left > 1] + held)
        widths = [min(w, WIDEST) for w in widths]
        out = around + captions
        room = lambda start, stop: sum(widths[start:stop]) + 2 * max(0, min(stop, len(widths)) - start)
        for start, stop, width in spread:  # what stands after such a cell does so in all its rows
            widths[min(stop, len(widths)) - 1] += max(0, min(width, WIDEST) + 2 - room(start, stop))
        for cells in placed:
            for i in range(max((len(lines) for _, lines, _ in cells), default=0)):
                line, done = "", 0
                for at, lines, span in cells:
                    cell = lines[i] if i < len(lines) else ""
                    line += " " * room(done, at) + cell + " " * max(0, max(0, room(at, at + span) - 2) - _width(cell)) + "  "
                    done = at + span
                out.append(line.rstrip())
        return out

    @staticmethod
    def span(cell: Element, name: str = "colspan", most: int = 1000) -> int:
        """Columns or rows of a cell; no rows stand for all that follow in the row group."""
        value = cell.attributes.get(name, "1").strip()
        return min(most, max(int(name == "colspan"), int(value))) if re.fullmatch(r"[0-9]{1,9}", value) else 1


def render(source: str) -> str:
    """The visible text of a page."""
    root, styles = build(source)
    painter = _Painter(sheet_rules(styles))
    lines = painter.block(root) if shown(root, painter.rules) else []
    return "\n".join(line.rstrip() for line in lines).strip("\n")


def _render_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches, 128):
        texts = [render(h) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                                         ["page_id", "text", "n_lines"])


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, text, n_lines)`` for every row: all text that the page shows, line by line.

    A tree is built with the end tags and elements that HTML implies. Elements that never
    show, the ``hidden`` attribute, inline styles and style sheet rules that hide take
    their content out; all other text stays, also the labels of SVG, MathML and the values
    of inputs. SVG that shows only through ``use`` is not repeated where it is used. Rules count whose selector is a tag, classes
    and an id and which hold on every screen; the strongest and then the last decides. Paragraphs, headings, lists, quotes and
    tables keep a blank line around them, other blocks start a line, list items get a
    bullet or number and are indented, preformatted text keeps its blanks, and table cells
    are padded to columns, below cells of several rows too. Pages are rendered row by row without a shuffle. Null and empty
    pages, and markup without text, give an empty text; text without tags stays as it is
    but for blanks; null ids and repeated rows keep their rows; an empty table gives an
    empty result; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(_render_rows, "page_id long, text string, n_lines long")
