"""Operator 4: layout-aware text of HTML pages.

A tokenizer that follows HTML's rules for tags, attributes and comments feeds a tree
builder that opens and closes the tags which HTML implies (paragraphs before blocks,
list items, definition terms, options, table sections, rows and cells). Visibility
comes from tags, attributes, inline styles and the page's style sheets, whose matching
rules apply by weight and order. A renderer walks the tree: what isn't displayed is left
out, inline text collapses its white space, blocks start new lines and paragraphs leave
an empty line, list items get their marks and indents, preformatted text stays, and the
cells of a table line up in columns.

Scale: one map over the pages, no shuffle. Time and text are in proportion to the page: rules wait by
key under the elements that begin them, so no element climbs to its ancestors or tries rules whose
beginning isn't above it; columns of a table line up as far as padding stays below PADDING times the table's
text (beyond, wide columns stop lining up, at last all do, and two blanks part the cells); lists
indent up to MAX_INDENT. Tree and walk use stacks of their own, so markup may be nested to any depth.

Defined results: null and empty html give an empty text; broken markup never fails
(unknown ends are ignored, open elements end with the page, a tag that the page breaks
off is dropped); selectors other than tags, classes, ids and attributes, alone, compound,
below or directly below each other, are ignored, and so are rules for other media than
all and screen, or under conditions; strings, comments and addresses in styles are read over; of
closed details the first summary is shown, and a closed dialog isn't; the first line break of pre and
textarea is dropped; other columns are ignored; repeated rows are rendered
one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Elements by their part in HTML, and its limits of spans.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
NEVER = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist area base link meta param source track col colgroup".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table ul xmp plaintext caption tr td th thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu dir".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("thead tbody tfoot".split())
VERBATIM = frozenset("pre xmp textarea plaintext".split())
LISTS = frozenset("ul ol menu dir".split())
FOREIGN = frozenset(["svg", "math"])
FOREIGN_HIDDEN = frozenset("title desc defs metadata style script symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

#: tag -> (open tags that it ends, tags that such a search doesn't cross)
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["tr", "td", "th", "caption", "colgroup", *SECTIONS]), frozenset(["table"])),
    "caption": (frozenset(["caption"]), frozenset(["table"])),
}
_ENDS["tbody"] = _ENDS["tfoot"] = _ENDS["thead"]
#: Blanks that lining up may cost, as a multiple of a table's text, and columns that lists indent at most.
PADDING, MAX_INDENT = 4, 64
_P_SCOPE = frozenset("table td th caption button li dd".split())
_TABLE = frozenset(["table"])

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_CDATA = re.compile(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)", re.S)
_BOGUS = re.compile(r"<[^>]*(?:>|\Z)")
#: What comes before an attribute, the tag's end, or a name with its value: quoted, left open to the page's end, or bare.
_ATTR = re.compile(r"[\s/]*(?:(>)|(\Z)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([\"'])|([^\s>]*)))?)")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_FIRST_BREAK = re.compile(r"(?:\r\n?|\n)?")


_NO_ATTRIBUTES: dict[str, str] = {}  # of many nodes, never changed


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "shown", "visible", "pre", "lines")

    def __init__(self, tag: str, parent: Node | None, attrs: dict | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or _NO_ATTRIBUTES, [], parent
        self.shown = self.visible = True
        self.pre = tag in VERBATIM
        if parent is not None:
            parent.children.append(self)


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I)


def _read_attributes(html: str, at: int) -> tuple[dict[str, str] | None, int, bool]:
    """Attributes (the first of a name counts), the place behind the tag, and whether it closes itself; None if the page ends first."""
    out: dict[str, str] = {}
    while True:
        found = _ATTR.match(html, at)
        at = found.end()
        if found[1]:
            return out, at, html[at - 2] == "/" and not found[3]
        if found[2] is not None or found[6]:
            return None, len(html), False
        value = found[4] or found[5] or found[7] or ""
        out.setdefault(found[3].lower(), unescape(value) if "&" in value else value)


class _Builder:
    def __init__(self):
        self.root = Node("html", None)
        self.body = Node("body", self.root)
        self.stack = [self.root, self.body]
        self.places: dict[str, list[int]] = {}  # tag -> where it is open
        self.sheets: list[tuple[str, str]] = []  # (media, text) of style sheets
        self.foreign = 0

    def push(self, tag: str, attrs: dict | None = None) -> Node:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Node(tag, self.stack[-1], attrs))
        self.foreign += tag in FOREIGN
        return self.stack[-1]

    def cut(self, at: int) -> None:
        """Close what is open from place ``at`` on."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            self.foreign -= tag in FOREIGN

    def _top(self, tags: frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, ends: frozenset[str], scope: frozenset[str] = frozenset()) -> None:
        """End the innermost open element of ``ends`` that no element of ``scope`` encloses from inside, with those of ``ends`` right around it."""
        at = self._top(ends)
        if at and at > self._top(scope):
            while at > 2 and self.stack[at - 1].tag in ends and self.stack[at - 1].tag not in scope:
                at -= 1
            self.cut(at)

    def text(self, data: str) -> None:
        top = self.stack[-1]
        if data and top.tag in ("table", "tr", *SECTIONS):
            if data.isspace():
                return
            top = Node("caption", top)  # text astray in a table is kept before its rows
        if data:
            top.children.append(unescape(data) if "&" in data else data)

    def end(self, tag: str) -> None:
        if tag == "br":
            Node("br", self.stack[-1])
        elif tag in HEADINGS:
            self.close(HEADINGS)
        elif tag not in ("html", "body"):
            self.close_one(tag)

    def close_one(self, tag: str) -> None:
        at = self._top(frozenset([tag]))
        if at and (tag == "table" or at > self._top(_TABLE)):
            self.cut(at)

    def start(self, tag: str, attrs: dict, closes_itself: bool) -> Node:
        if tag in ("html", "body"):
            node = self.root if tag == "html" else self.body
            node.attrs = attrs | node.attrs
            if tag == "body":
                self.close(frozenset(["head"]))
            return node
        if tag in CLOSES_P:
            if self.stack[-1].tag == "head":
                self.cut(len(self.stack) - 1)
            self.close(frozenset(["p"]), _P_SCOPE)
        if tag in _ENDS:
            self.close(*_ENDS[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", *SECTIONS):  # an implied row
            self.push("tr")
        if tag in VOID or tag in RAW or closes_itself and (self.foreign or tag in FOREIGN):
            return Node(tag, self.stack[-1], attrs)
        return self.push(tag, attrs)


def parse(html: str) -> tuple[Node, list[tuple[str, str]]]:
    """The tree of a page (html, with a body below it), and its style sheets as (media, text)."""
    b = _Builder()
    at, size = 0, len(html)
    while at < size:
        opened = _OPEN.search(html, at)
        if not opened:
            b.text(html[at:])
            break
        found = opened.start()
        b.text(html[at:found])
        name = _NAME.match(html, found)
        if not name:
            at = _markup(b, html, found)
            continue
        tag, ends = name[1].lower(), html[found + 1] == "/"
        attrs, at, closes_itself = _read_attributes(html, name.end())
        if attrs is None:
            break
        if ends:
            b.end(tag)
            continue
        node = b.start(tag, attrs, closes_itself)
        if tag in RAW and not (closes_itself and b.foreign):
            end = _raw_end(tag).search(html, at)
            data = html[at : end.start() if end else size]
            at = end.end() if end else size
            if tag == "style":
                b.sheets.append((attrs.get("media", ""), data))
            elif data:
                data = data[_FIRST_BREAK.match(data).end() :] if tag == "textarea" else data
                node.children.append(data if tag in ("xmp", "plaintext") else unescape(data))
        elif tag in ("pre", "listing"):
            at = _FIRST_BREAK.match(html, at).end()
    return b.root, b.sheets


def _markup(b: _Builder, html: str, at: int) -> int:
    """What a < begins that no tag name follows: comments, declarations, or text. The place behind it."""
    second = html[at + 1 : at + 2]
    if second == "!" and html.startswith("<!--", at):
        return _COMMENT.match(html, at).end()
    if b.foreign and html.startswith("<![CDATA[", at):
        found = _CDATA.match(html, at)
        b.stack[-1].children.append(found[1])
        return found.end()
    if second in ("!", "?") or second == "/" and at + 2 < len(html):
        return _BOGUS.match(html, at).end()
    b.text("<")
    return at + 1


# --- visibility -----------------------------------------------------------------

_SIMPLE = re.compile(r"([a-z][a-z0-9-]*|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]", re.I)
_AT_MEDIA = re.compile(r"@media\b(.*)", re.I | re.S)
_DECLARATION = re.compile(r"\s*(display|visibility)\s*:\s*([\w-]+(?:\s+[\w-]+)*)\s*(!\s*important)?\s*", re.I)
#: What structure doesn't look into: comments, strings, bare addresses; then the marks that make up structure.
_CSS = re.compile(r"(/\*.*?(?:\*/|\Z))|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|\burl\(\s*(?![\"'\s])(?:\\.|[^)\\])*(?:\)|\Z)|\\.|([{};(),\[\]])", re.S | re.I)


def _without_comments(css: str) -> str:
    return _CSS.sub(lambda m: " " if m[1] else m[0], css) if "/*" in css else css


def _split(css: str, mark: str) -> list[str]:
    """Parts between marks that stand outside strings, addresses and brackets."""
    parts, at, depth = [], 0, 0
    for found in _CSS.finditer(css):
        if found[2] == mark and not depth:
            parts.append(css[at : found.start()])
            at = found.end()
        elif found[2] and found[2] in "([":
            depth += 1
        elif found[2] and found[2] in ")]":
            depth = max(0, depth - 1)
    return [*parts, css[at:]]


def _declared(text: str) -> dict[str, tuple[str, bool]]:
    """property -> (value, important) of display and visibility; the last counts, but for important ones."""
    out: dict[str, tuple[str, bool]] = {}
    low = text.lower()
    if "display" not in low and "visibility" not in low:
        return out
    for part in _split(_without_comments(text), ";"):
        m = _DECLARATION.fullmatch(part)
        if m and not (" " in m[2].strip() and "none" in m[2].lower().split()):
            name, value, important = m[1].lower(), m[2].lower(), bool(m[3])
            if important or not out.get(name, ("", False))[1]:
                out[name] = (value, important)
    return out


def _applies(media: str) -> bool:
    """Whether a list of media asks for nothing but all or screen, in one of its parts."""
    return any(re.fullmatch(r"\s*(?:only\s+)?(?:all|screen)?\s*", part, re.I) for part in media.split(","))


def _rules(css: str):
    """(selectors, body) of the rules that apply; blocks under other conditions are skipped whole."""
    css = _without_comments(css).replace("<!--", " ").replace("-->", " ")
    at, open_ = 0, []  # open_: whether the rules of each block that is entered apply
    off = 0  # open blocks whose rules don't
    for found in _CSS.finditer(css):
        if not found[2] or found[2] not in "{};":
            continue
        if found[2] == "{":
            head = css[at : found.start()].strip()
            media = _AT_MEDIA.match(head)
            nests = bool(media) or re.match(r"@(?:layer|supports|container|scope|starting-style)\b", head, re.I)
            applies = nests and (_applies(media[1]) if media else bool(re.match(r"@layer\b", head, re.I)))
            open_.append((head, bool(applies), bool(nests), found.end()))
            off += not applies
        elif found[2] == "}" and open_:
            head, applies, nests, start = open_.pop()
            off -= not applies
            if not nests and not head.startswith("@") and not off:
                yield head, css[start : found.start()]
        at = found.end()


class _Selector:
    """Compound selectors from the outermost element inward, each with whether it stands directly below the one before."""

    __slots__ = ("parts", "weight", "declared", "order")

    def __init__(self, parts: list, weight: tuple[int, int, int]):
        self.parts, self.weight = parts, weight
        self.declared, self.order = {}, 0

    @classmethod
    def of(cls, text: str) -> _Selector | None:
        parts, weight, directly = [], [0, 0, 0], False
        for piece in re.findall(r"\s*>\s*|\s+|(?:\[(?:\"[^\"]*\"|'[^']*'|[^\]])*\]|[^\s>\[])+", text.strip()):
            if not piece.strip() or piece.strip() == ">":
                directly = bool(piece.strip())
                continue
            test, at = [], 0
            while at < len(piece):
                m = _SIMPLE.match(piece, at)
                if not m:
                    return None
                at = m.end()
                if m[1] and m[1] != "*":
                    test.append(("tag", m[1].lower(), None))
                    weight[2] += 1
                elif m[2]:
                    test.append(("class", m[2], None))
                    weight[1] += 1
                elif m[3]:
                    test.append(("id", m[3], None))
                    weight[0] += 1
                elif m[4]:
                    test.append((m[5] or "has", m[4].lower(), m[6] or m[7] or m[8] or ""))
                    weight[1] += 1
            parts.append((test, directly))
            directly = False
        return cls(parts, tuple(weight)) if parts else None

    def key(self, i: int) -> tuple[str, str]:
        """What an element must have for part i to be tried."""
        by = {kind: value for kind, value, _ in self.parts[i][0] if kind in ("tag", "class", "id")}
        return next(((k, by[k]) for k in ("id", "class", "tag") if k in by), ("any", ""))


def _passes(node: Node, test: list) -> bool:
    for kind, name, value in test:
        if kind == "tag":
            ok = node.tag == name
        elif kind == "class":
            ok = name in node.attrs.get("class", "").split()
        elif kind == "id":
            ok = node.attrs.get("id") == name
        else:
            have = node.attrs.get(name)
            ok = have is not None and {"has": lambda: True, "=": lambda h=have: h == value, "~=": lambda h=have: value in h.split(), "^=": lambda h=have: value != "" and h.startswith(value), "$=": lambda h=have: value != "" and h.endswith(value), "*=": lambda h=have: value != "" and value in h, "|=": lambda h=have: h == value or h.startswith(f"{value}-")}[kind]()
        if not ok:
            return False
    return True


def _style_rules(sheets: list[tuple[str, str]]) -> dict[tuple[str, str], list]:
    """key -> [(selector, 0)]: the rules on display and visibility, by what their outermost part asks for."""
    found: dict[tuple, tuple] = {}  # the last rule of a selector with these declarations counts
    order = 0
    for media, css in sheets:
        for selectors, body in _rules(css) if _applies(media) else ():
            declared = _declared(body)
            for text in _split(selectors, ",") if declared else ():
                order += 1
                found[text.strip(), tuple(declared.items())] = (text, declared, order)
    out: dict[tuple[str, str], list] = {}
    for text, declared, order in found.values():
        selector = _Selector.of(text)
        if selector:
            selector.declared, selector.order = declared, order
            out.setdefault(selector.key(0), []).append((selector, 0))
    return out


class _Waiting:
    """Parts of selectors whose beginning stands above the present element, by what they ask for."""

    def __init__(self, rules: dict[tuple[str, str], list]):
        self.rules = rules
        self.below: dict[tuple[str, str], dict[tuple[int, int], tuple[_Selector, int]]] = {}

    def matched(self, node: Node, direct: dict) -> tuple[list[_Selector], list, dict]:
        """Selectors that end in the node, what waits below it from now on (to be taken back by ``leave``), and what waits for its children alone."""
        ends, entered, children = [], [], {}
        attrs = node.attrs
        keys = [("any", ""), ("tag", node.tag)]
        if "id" in attrs:
            keys.append(("id", attrs["id"]))
        if "class" in attrs:
            keys += [("class", c) for c in dict.fromkeys(attrs["class"].split())]
        done = set()
        for key in keys:
            for selector, i in (*self.rules.get(key, ()), *self.below.get(key, {}).values(), *direct.get(key, ())):
                if (id(selector), i) in done or not _passes(node, selector.parts[i][0]):
                    continue
                done.add((id(selector), i))
                if i + 1 == len(selector.parts):
                    ends.append(selector)
                    continue
                following = selector.key(i + 1)
                if selector.parts[i + 1][1]:
                    children.setdefault(following, []).append((selector, i + 1))
                else:
                    entered.append((following, (id(selector), i + 1), (selector, i + 1)))
        fresh = []
        for key, name, part in entered:
            waiting = self.below.setdefault(key, {})
            if name not in waiting:
                waiting[name] = part
                fresh.append((key, name))
        return ends, fresh, children

    def leave(self, entered: list) -> None:
        for key, name in entered:
            del self.below[key][name]


_NOWHERE: dict = {}


def _set_visibility(root: Node, sheets: list[tuple[str, str]]) -> list[Node]:
    """Decide ``shown`` (display) and ``visible`` (visibility, inherited) of each node; the tables that are shown, outer ones first."""
    rules = _style_rules(sheets)
    waiting = _Waiting(rules)
    tables: list[Node] = []
    stack: list = [(root, True, "", _NOWHERE)]
    while stack:
        node, visible, drawing, direct = stack.pop()  # drawing: svg or math around it, where bare text of svg isn't shown
        if drawing is None:  # the element's end
            waiting.leave(node)
            continue
        attrs, tag = node.attrs, node.tag
        node.shown = not (tag in NEVER or drawing and tag in FOREIGN_HIDDEN)
        if not node.shown:
            continue
        hidden = "hidden" in attrs or tag == "input" and attrs.get("type", "").lower() == "hidden" or tag == "dialog" and "open" not in attrs
        best = {"display": ((False, (-1, 0, 0), 0), "none" if hidden else ""), "visibility": ((False, (-1, 0, 0), 0), "")}
        entered, children = [], _NOWHERE
        if rules:
            ends, entered, children = waiting.matched(node, direct)
            for selector in ends:
                for name, (value, important) in selector.declared.items():
                    best[name] = max(best[name], ((important, selector.weight, selector.order), value))
        for name, (value, important) in _declared(attrs["style"]).items() if "style" in attrs else ():
            best[name] = max(best[name], ((important, (1 << 30, 0, 0), 0), value))
        node.shown = best["display"][1] != "none"
        if best["visibility"][1] in ("visible", "hidden", "collapse"):
            visible = best["visibility"][1] == "visible"
        text_of_svg = tag in ("text", "foreignobject")
        within = tag if tag in FOREIGN else "" if text_of_svg else drawing
        node.visible = visible and within != "svg"
        if not node.shown:
            waiting.leave(entered)
            continue
        if tag == "table":
            tables.append(node)
        if entered:
            stack.append((entered, True, None, _NOWHERE))
        below = [c for c in node.children if not isinstance(c, str)]
        if tag == "details" and "open" not in attrs:
            first = next((c for c in below if c.tag == "summary"), None)
            node.children = [first] if first is not None else []
            below = node.children
        stack += [(c, visible, within, children) for c in reversed(below)]
    return tables


# --- layout ---------------------------------------------------------------------


class _Lines:
    """Lines in the making: collapsed inline text, or verbatim in preformatted text."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = False  # an empty line is due before the next text
        self.breaks = 0  # empty lines that breaks ask for
        self.widths = [0]  # blanks that each level indents, with those around it
        self.marks: list[str | None] = []  # of each level, of list items
        self.settled = 0  # levels that text has followed already

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self._put(first)
            for part in rest:
                self.br()
                self._put(part)
            return
        for i, part in enumerate(_SPACE.split(data)):
            if i and self.line:
                self.space = True
            if part:
                self._put(part)

    def _put(self, part: str) -> None:
        if not part:
            return
        if not self.line:
            if self.gap and self.done:
                self.done.append("")
            self.done += [""] * self.breaks
            self.gap, self.breaks = False, 0
            self.line.append(" " * self.widths[self.settled] + "".join(m if m is not None else " " * (self.widths[i + 1] - self.widths[i]) for i, m in enumerate(self.marks[self.settled :], self.settled)))
            self.settled = len(self.marks)
        elif self.space:
            self.line.append(" ")
        self.line.append(part)
        self.space = False

    def end_line(self) -> None:
        if self.line:
            self.done.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def br(self) -> None:
        if self.line:
            self.end_line()
        else:
            self.breaks += 1

    def edge(self, spaced: bool, closing: bool) -> None:
        """The edge of a block."""
        self.end_line()
        if closing:
            self.breaks = 0
        self.gap = self.gap or spaced

    def enter(self, indent: str, mark: str | None = None) -> None:
        self.widths.append(min(self.widths[-1] + len(indent), MAX_INDENT))
        self.marks.append(mark)

    def leave(self) -> None:
        self.widths.pop()
        self.marks.pop()
        self.settled = min(self.settled, len(self.marks))

    def block(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        for line in lines:
            if line:
                self._put(line)
                self.end_line()
            else:
                self.breaks += 1


def _lay_out(node: Node) -> list[str]:
    """The lines of what a node holds. Tables below it must have theirs."""
    out = _Lines()
    numbers: dict[int, int] = {}  # open ordered list -> the next number
    begun: set[int] = set()  # open lists that have an item
    walk: list = [(c, node, False) for c in reversed(node.children)]
    while walk:
        child, parent, leaving = walk.pop()
        if isinstance(child, str):
            if parent.visible:
                out.text(child, parent.pre)
            continue
        tag = child.tag
        if leaving:
            if tag == "li" and parent.tag in LISTS:
                out.edge(False, True)
                out.gap = False
                out.leave()
            else:
                if tag in ("blockquote", "dd") or parent.tag in LISTS:
                    out.end_line()
                    out.leave()
                out.edge(tag in SPACED and not (tag in LISTS and parent.tag == "li"), True) if tag in BLOCK else None
                begun.discard(id(child))
            continue
        if not child.shown:
            continue
        if tag == "br":
            out.br()
        elif tag == "img":
            if child.attrs.get("alt") and child.visible:
                out.text(child.attrs["alt"], False)
        elif tag == "input":
            if child.attrs.get("value") and child.visible and child.attrs.get("type", "text").lower() not in ("checkbox", "radio", "password", "file", "image"):
                out.text(child.attrs["value"], False)
        elif tag == "table":
            out.edge(True, False)
            if parent.tag in LISTS:
                out.enter("  ")
            out.block(child.lines)
            if parent.tag in LISTS:
                out.end_line()
                out.leave()
            out.edge(True, True)
        else:
            child.pre = child.pre or parent.pre
            if tag == "li" and parent.tag in LISTS:
                number = _number(child.attrs.get("value"), numbers.get(id(parent), 1))
                numbers[id(parent)] = number + 1
                out.edge(False, False)
                if id(parent) in begun:
                    out.gap = False
                begun.add(id(parent))
                mark = f"{number}. " if parent.tag == "ol" else "- "
                out.enter(" " * len(mark), mark)
            else:
                if tag in BLOCK:
                    out.edge(tag in SPACED and not (tag in LISTS and parent.tag == "li"), False)
                if tag == "ol":
                    numbers[id(child)] = _number(child.attrs.get("start"), 1)
                if tag in ("blockquote", "dd") or parent.tag in LISTS:
                    out.enter("  ")
            walk.append((child, parent, True))
            walk += [(c, child, False) for c in reversed(child.children)]
    out.end_line()
    return out.done


def _number(text: str | None, default: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,18})", text or "")
    return int(found[1]) if found else default


def _span(text: str | None, most: int) -> int:
    """A span as HTML reads it: at least 1, at most HTML's limit."""
    found = re.match(r"\s*\+?(\d+)", text or "")
    return min(int(found[1][:9]), most) or 1 if found else 1


def _rows(table: Node):
    """Rows as lists of cells, and other children as nodes."""
    for child in table.children:
        if not isinstance(child, str) and child.shown:
            for row in child.children if child.tag in SECTIONS else [child]:
                if not isinstance(row, str) and row.shown:
                    yield [c for c in row.children if not isinstance(c, str) and c.shown] if row.tag == "tr" else row


def _grid(rows: list[list[Node]]) -> list[list[tuple[int, int, list[str]]]]:
    """(column, span, lines) of the cells of each row."""
    grid = []
    taken: list[tuple[int, int, int]] = []  # columns [from, to) that spans keep, and the row where that ends; in order
    for y, row in enumerate(rows):
        cells, at, k, kept = [], 0, 0, []
        for cell in row:
            while k < len(taken) and taken[k][0] <= at:
                at = max(at, taken[k][1])
                kept.append(taken[k])
                k += 1
            span = _span(cell.attrs.get("colspan"), MAX_COLSPAN)
            cells.append((at, span, _lay_out(cell)))
            kept.append((at, at + span, min(y + _span(cell.attrs.get("rowspan"), MAX_ROWSPAN), len(rows))))
            at += span
        kept += taken[k:]
        taken = []
        for a, b, end in kept:
            if end > y + 1:
                if taken and taken[-1][1:] == (a, end):
                    a = taken.pop()[0]
                taken.append((a, b, end))
        grid.append(cells)
    return grid


def _table(table: Node) -> list[str]:
    out, rows = [], []
    for row in _rows(table):
        if isinstance(row, Node):  # a caption, or what is astray
            out += _lay_out(row)
        else:
            rows.append(row)
    grid = _grid(rows)
    width: dict[int, int] = {}  # of the columns where cells begin
    text = 0
    for cells in grid:
        for at, span, lines in cells:
            width[at] = max(width.get(at, 0), max(map(len, lines), default=0) if span == 1 else 0)
            text += sum(len(line) - line.count(" ") for line in lines) + 2
    most, widest = PADDING * text, max(width.values(), default=0)
    while True:  # widths are capped lower and lower until padding stays in proportion
        left, place = {}, 0
        for at in sorted(width):
            left[at] = place
            place += min(width[at], widest) + 2
        if sum(_padding(cells, left) for cells in grid) <= most:
            break
        if not widest:
            left = dict.fromkeys(width, 0)
            break
        widest //= 2
    for cells in grid:
        tallest = max((len(lines) for _, _, lines in cells), default=0)
        placed: list[list[tuple[int, str]]] = [[] for _ in range(tallest)]
        for at, _, lines in cells:
            for i, line in enumerate(lines):
                if line:
                    placed[i].append((left[at], line))
        for line in placed:
            parts, place = [], 0
            for start, part in line:
                if start > place:
                    parts.append(" " * (start - place))
                    place = start
                elif parts:  # a wide cell reached into this column
                    parts.append("  ")
                    place += 2
                parts.append(part)
                place += len(part)
            out.append("".join(parts).rstrip())
    return out


def _padding(cells: list[tuple[int, int, list[str]]], left: dict[int, int]) -> int:
    """Blanks that a row's lines need at most if cells begin where ``left`` says."""
    ends: dict[int, int] = {}  # line -> where its last cell begins
    for at, _, lines in cells:
        for i, line in enumerate(lines):
            if line:
                ends[i] = left[at]
    return sum(ends.values())


def render(html: str | None) -> str:
    if not html:
        return ""
    root, sheets = parse(html)
    for table in reversed(_set_visibility(root, sheets)):  # inner ones first
        table.lines = _table(table)
    return "\n".join(_lay_out(root) if root.shown else []).replace("\xa0", " ")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text and n_chars of each page (page_id, html)."""
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in common.sliced(batches, 1):
            texts = [render(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, text string, n_chars long")
