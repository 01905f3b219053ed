"""Visible text of web pages, laid out: block spacing, lists, aligned table cells.

A builder turns the tags of a page into a well-formed tree in document order: end tags that HTML
implies are added (a `p` ends before a block, `li`, `dt`, `option`, rows and cells before the next),
missing rows are opened, end tags without a start are ignored, and nothing closes across a cell.
The tree is visited while it is built, with a stack of open elements and the places of each tag on
it, so that deep nesting needs no recursion and no search: the time is linear in the page. A page
with a style sheet after its first text is read a second time with all its rules.

Each element carries what shows. Elements without a box (`script`, `head`, ...) never do, nor does
what is in closed `details`. For the others `display` and `visibility` are those of the winning
declaration: important ones first, then the style attribute, then rules by specificity and order;
without one, `hidden` and a closed `dialog` are not shown. `visibility` is inherited and can be
turned on again. Rules select by tag, id, classes, plain attributes and `:not()` of these. What
can't be told leaves text in: a rule with a combinator or another pseudo-class hides nothing, but
one with a combinator may show its last element.

Layout: white space collapses outside `pre`; `br` breaks a line; paragraphs, headings, lists, quotes
and tables stand apart by an empty line, other blocks begin a line; list items have a mark or number
and are indented by their level (the first `MOST_LEVELS` levels of lists and quotes), quotes have
`> `; the cells of a table stand in columns, padded to the widest cell up to `WIDEST`; spans of
columns and rows are kept. Tables more than `MOST_TABLES` deep are lines of cells.

Defined cases: a null page has a null text, an empty one an empty text. Broken markup never fails: an
unfinished comment or tag runs to the end of the page. Rows are independent of each other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.llm.common import slices, table

WIDEST = 120
MOST_LEVELS = 64
MOST_TABLES = 16
MOST_SPAN = 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
NO_BOX = frozenset("head script style template title iframe noembed noframes datalist object audio video canvas annotation annotation-xml".split())
# in a drawing only `text` and foreign objects show text, and these none at all
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp plaintext table figure hr fieldset menu dir".split())
LINE = frozenset(
    "html body div section article aside nav header footer main address form li dt dd figcaption "
    "details summary dialog legend center caption hgroup search option optgroup".split()
)
BLOCK = APART | LINE
# an open element on the left ends where one on the right begins
ENDED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "optgroup": frozenset(["optgroup"]),
    "tr": frozenset("tr tbody thead tfoot".split()),
    "td": frozenset("td th tr tbody thead tfoot".split()),
    "th": frozenset("td th tr tbody thead tfoot".split()),
    "thead": frozenset("tbody thead tfoot".split()),
    "tbody": frozenset("tbody thead tfoot".split()),
    "tfoot": frozenset("tbody thead tfoot".split()),
    "caption": frozenset("caption tr td th tbody thead tfoot colgroup".split()),
    "p": BLOCK - frozenset(["html", "body", "option", "optgroup", "legend", "summary", "caption"]),
    "head": frozenset(["body"]) | BLOCK,
    "rt": frozenset(["rt", "rp"]),
    "rp": frozenset(["rt", "rp"]),
}
ENDS: dict[str, list[str]] = {}
for _tag, _enders in ENDED_BY.items():
    for _name in sorted(_enders):
        ENDS.setdefault(_name, []).append(_tag)
# what an implied end doesn't reach across
FENCE = {
    "li": frozenset("ul ol menu dir table td th".split()),
    "dt": frozenset("dl table td th".split()),
    "dd": frozenset("dl table td th".split()),
    "p": frozenset("table td th caption button object".split()),
}
DEFAULT_FENCE = frozenset(["table"])
LISTS = frozenset("ul ol menu dir".split())
CELLS = frozenset(["td", "th", "table"])
# end tags that reach out of a cell
FAR_ENDS = frozenset("table tr tbody thead tfoot body html".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
DISPLAY = re.compile(
    r"(?:none|contents|block|inline|inline-block|flow-root|list-item|run-in|(?:inline-)?(?:flex|grid|table)|table-[a-z-]+|ruby[a-z-]*|math"
    r"|-webkit-(?:inline-)?(?:box|flex)|-ms-(?:inline-)?(?:flexbox|grid)|inherit|initial|unset|revert|revert-layer)(?:\s|\Z)"
)
VISIBILITY = re.compile(r"(?:visible|hidden|collapse|inherit|initial|unset|revert|revert-layer)\Z")
IMPORTANT = re.compile(r"\s*!\s*important\Z")
DECLARATION = re.compile(r"([\w-]+)\s*:\s*(.*)", re.S)
STYLE_PART = re.compile(r"((?:[^{};\"']++|\"[^\"\n]*+\"?|'[^'\n]*+'?)*+)([{};]|\Z)")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
MEDIA = re.compile(r"(?:(not|only)\s+)?([\w-]*)(?:(?:^|\s+and\s+|\s*)(\(.*\)))?", re.S)
WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([0-9.]+)(px|em|rem)?\s*\)")
SCREEN_WIDTH = 1280
COMPOUND_PART = re.compile(
    r"(?P<tag>\A(?:[a-zA-Z][\w-]*|\*))|#(?P<id>[\w-]+)|\.(?P<name>[\w-]+)"
    r"|\[\s*(?P<key>[\w-]+)\s*(?:=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[\w-]+))\s*)?\]"
    r"|:not\(\s*(?P<but>[^():]+?)\s*\)"
)
COMBINED = re.compile(r"\s*[>+~]\s*|\s+")


@dataclass(frozen=True)
class Compound:
    """What an element must have: names (`a`, `#id`, `.class`), attributes (with a value or any), and
    what it must not have."""

    names: frozenset[str]
    attributes: frozenset[tuple[str, str | None]] = frozenset()
    but: tuple["Compound", ...] = ()
    weight: tuple[int, int, int] = (0, 0, 0)

    def holds(self, names: set[str], attributes: dict[str, str]) -> bool:
        return (
            self.names <= names
            and all(k in attributes and v in (None, attributes[k]) for k, v in self.attributes)
            and not any(b.holds(names, attributes) for b in self.but)
        )


def compound(text: str) -> Compound | None:
    """A selector without combinators; None if it asks for what can't be told."""
    names, attributes, but, weight, at = set(), set(), [], [0, 0, 0], 0
    while at < len(text):
        m = COMPOUND_PART.match(text, at)
        if not m:
            return None
        at = m.end()
        if m["tag"]:
            if m["tag"] != "*":
                names.add(m["tag"].lower())
                weight[2] += 1
        elif m["id"]:
            names.add("#" + m["id"])
            weight[0] += 1
        elif m["name"]:
            names.add("." + m["name"])
            weight[1] += 1
        elif m["key"]:
            attributes.add((m["key"].lower(), next((v for v in m.group("a", "b", "c") if v is not None), None)))
            weight[1] += 1
        else:
            inner = [compound(x.strip()) for x in m["but"].split(",")]
            if not all(inner):
                return None
            but += inner
            weight = [x + y for x, y in zip(weight, max(x.weight for x in inner), strict=True)]
    return Compound(frozenset(names), frozenset(attributes), tuple(but), tuple(weight)) if text else None


Declared = dict[str, tuple[str, bool]]  # of `display` and `visibility`: value, whether important


def declared(text: str) -> Declared:
    """The last valid value of each of the two properties; an important one before others."""
    found: Declared = {}
    for part in STYLE_PART.finditer(COMMENT.sub(" ", text)):
        m = DECLARATION.fullmatch(part[1].strip())
        if not m or (name := m[1].lower()) not in ("display", "visibility"):
            continue
        value = m[2].strip().lower()
        plain = IMPORTANT.sub("", value)
        if (DISPLAY if name == "display" else VISIBILITY).match(plain) and (plain != value or not found.get(name, ("", False))[1]):
            found[name] = plain.split()[0], plain != value
    return found


class Rules:
    """Rules of style sheets in order, found by the rarest kind of name that they ask for."""

    def __init__(self):
        self.by_name: dict[str, dict[tuple[Compound, bool], dict[str, tuple]]] = {}
        self.count = 0
        self.plain = True  # no rule asks for attributes
        self.known: dict[tuple, dict[str, str]] = {}

    def add(self, selectors: list[tuple[Compound, bool]], found: Declared) -> None:
        self.count += 1
        self.known.clear()
        for selector, only_shows in selectors:
            self.plain &= not selector.attributes and not any(b.attributes for b in selector.but)
            key = min(selector.names, key=lambda n: ("#.".find(n[0]) % 3, n), default="")
            kept = self.by_name.setdefault(key, {}).setdefault((selector, only_shows), {})
            for name, (value, important) in found.items():
                if only_shows and value in ("none", "hidden", "collapse"):
                    continue
                rank = important, selector.weight, self.count
                if name not in kept or kept[name][0] < rank:
                    kept[name] = rank, value

    def style(self, names: set[str], attributes: dict[str, str], inline: str) -> dict[str, str]:
        """Winning values of an element."""
        if not inline and not self.by_name:
            return {}
        key = None
        if self.plain and not inline:
            key = tuple(sorted(names))
            if key in self.known:
                return self.known[key]
        best: dict[str, tuple] = {}
        for name in (*names, ""):
            for (selector, _), kept in self.by_name.get(name, {}).items():
                if kept and selector.holds(names, attributes):
                    for of, (rank, value) in kept.items():
                        if of not in best or best[of][0] < (rank[0], False, *rank[1:]):
                            best[of] = (rank[0], False, *rank[1:]), value
        for of, (value, important) in declared(inline).items() if inline else ():
            if of not in best or best[of][0] < (important, True):
                best[of] = (important, True), value
        found = {of: value for of, (_, value) in best.items()}
        if key is not None:
            self.known[key] = found
        return found


def on_screen(query: str) -> bool:
    """Whether a media query holds for a screen `SCREEN_WIDTH` wide; not, if that can't be told."""

    def holds(one: str) -> bool:
        m = MEDIA.fullmatch(one.strip().lower())
        if not m:
            return False
        kind = m[2] in ("", "all", "screen")
        features = [f for f in re.split(r"\s+and\s+", m[3] or "") if f]
        known = [WIDTH.fullmatch(f) for f in features]
        if not all(known):
            return m[1] == "not" and not kind
        wide = all(
            (SCREEN_WIDTH >= size) if f[1] == "min" else (SCREEN_WIDTH <= size)
            for f in known
            for size in [float("0" + f[2].rstrip(".")) * (16 if f[3] in ("em", "rem") else 1) if f[2].count(".") < 2 else 0.0]
        )
        return (kind and wide) != (m[1] == "not")

    return not query.strip() or any(map(holds, query.split(",")))


def selectors_of(text: str, nested: bool) -> list[tuple[Compound, bool]]:
    """Selectors of a rule that can be told, and whether they are of use for showing only."""
    found = []
    for one in text.split(","):
        *outer, last = COMBINED.split(one.strip().replace("&", ""))
        if selector := compound(last):
            found.append((selector, nested or bool(outer)))
    return found


def add_rules(rules: Rules, sheet: str) -> None:
    """Add the rules of a style sheet on a screen. Those in a condition that does not hold, or can't
    be told, are left out."""
    open_: list[tuple[bool, list[tuple[Compound, bool]]]] = [(True, [])]  # holds, selectors
    for m in STYLE_PART.finditer(COMMENT.sub(" ", sheet)):
        text, mark = m[1].strip(), m[2]
        holds, selectors = open_[-1]
        if mark == "{":
            if text.startswith("@"):
                rule = re.match(r"@([\w-]*)", text)[1].lower()
                if rule == "media":
                    holds = holds and on_screen(text[6:])
                elif rule not in ("supports", "layer"):
                    holds = False
                open_.append((holds, selectors))
            else:
                # a rule inside another one speaks of its descendants
                open_.append((holds, selectors_of(text, len(open_) > 1 and bool(selectors))))
            continue
        if holds and selectors and text and (found := declared(text)):
            rules.add(selectors, found)
        if mark == "}" and len(open_) > 1:
            open_.pop()


class Paper:
    """Lines of text; asks for line ends and empty lines are met before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # 1: a new line, 2: an empty line before it
        self.space = False
        self.blank = True
        self.prefix: list[list[str]] = []  # of lists and quotes: first and further lines
        self.deep: list[str] = []  # beyond `MOST_LEVELS`: marks only
        self.used = 0  # of these, how many are written

    def text(self, text: str, kept: bool) -> None:
        if kept:
            first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.add(first)
            for line in rest:
                self.end_line()
                self.add(line)
            return
        body = SPACES.sub(" ", text)
        if body.startswith(" "):
            self.space = True
            body = body[1:]
        after = body.endswith(" ")
        if body := body.rstrip(" "):
            self.add(body)
            self.space = after

    def add(self, text: str) -> None:
        if not text:
            return
        self.start()
        if self.space and not self.blank:
            self.now.append(" ")
        self.space = False
        self.now.append(text)
        self.blank = False

    def push(self, first: str, further: str) -> None:
        if len(self.prefix) < MOST_LEVELS:
            self.prefix.append([first, further])
        else:
            self.deep.append(first)

    def pop(self) -> None:
        self.flush()
        if self.deep:
            self.deep.pop()
            self.used = min(self.used, len(self.deep))
        else:
            self.prefix.pop()

    def start(self) -> None:
        if self.gap:
            self.flush()
            if self.gap == 2 and self.lines and self.lines[-1].strip(" >"):
                self.lines.append("".join(p[1] for p in self.prefix if p[1].startswith(">")).rstrip())
            self.gap = 0
        if not self.now:
            for p in self.prefix:
                self.now.append(p[0])
                p[0] = p[1]
            self.now += self.deep[self.used :]
            self.used = len(self.deep)
            self.blank = True

    def flush(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.blank, self.space = True, False

    def end_line(self) -> None:
        """A break: an empty line counts."""
        self.start()
        if not self.now:
            self.lines.append("")
        self.flush()

    def ask(self, gap: int) -> None:
        self.gap = max(self.gap, gap)
        self.space = False

    def block(self, lines: list[str]) -> None:
        for line in lines:
            self.ask(1)
            self.start()
            self.now.append(line)
            self.blank = False
        self.ask(1)

    def done(self) -> list[str]:
        self.flush()
        lines = self.lines
        while lines and not lines[-1].strip():
            lines.pop()
        while lines and not lines[0].strip():
            lines.pop(0)
        return lines


@dataclass
class Grid:
    """Cells of a table: place, span and lines."""

    rows: list[dict[int, tuple[int, list[str]]]] = field(default_factory=list)
    taken: dict[int, int] = field(default_factory=dict)  # column: rows still covered from above
    column: int = 0

    def row(self) -> None:
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1} if self.rows else {}
        self.rows.append({})
        self.column = 0

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        while self.taken.get(self.column, 0) > 0 and self.column not in self.rows[-1]:
            self.column += 1
        self.rows[-1][self.column] = columns, lines
        if rows > 1:
            for c in range(self.column, self.column + columns):
                self.taken[c] = rows
        self.column += columns

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for c, (span, lines) in row.items():
                width.setdefault(c, 0)
                if span == 1:
                    width[c] = max([width[c], *(len(x) for x in lines if len(x) <= WIDEST)])
        order = sorted(width)
        offset, at = {}, 0
        for c in order:
            offset[c] = at
            at += width[c] + 2
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, lines in row.values()), default=0)):
                text = ""
                for c in sorted(row):
                    lines = row[c][1]
                    if k < len(lines) and lines[k]:
                        text += " " * max(offset[c] - len(text), 2 if text else 0) + lines[k]
                out.append(text.rstrip())
        return [x for x in out if x]


@dataclass
class Element:
    tag: str
    shown: bool
    visible: bool
    kept: bool
    marks: int = 0  # prefixes on the paper
    counter: int | None = None
    paper: Paper | None = None  # of a cell
    grid: Grid | None = None
    spans: tuple[int, int] = (1, 1)
    closed: bool = False  # details of which only the summary shows
    gap: int = 0
    drawn: bool = False  # in a drawing, outside its texts


class Page:
    def __init__(self, rules: Rules | None = None):
        self.papers = [Paper()]
        self.title: list[str] = []
        self.given = rules is not None
        self.rules = rules or Rules()
        self.begun = False  # text has been met
        self.late = False  # and then a style sheet
        self.open = [Element("", True, True, False)]
        self.at: dict[str, list[int]] = {}  # places of each tag among the open elements

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element with one of the tags, or 0."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def read(self, source: str) -> str:
        at, size = 0, len(source)
        while at < size:
            tag = source.find("<", at)
            if tag < 0:
                self.text(source[at:])
                break
            if tag > at:
                self.text(source[at:tag])
            after = source[tag + 1 : tag + 2]
            if after == "!" or after == "?":
                comment = source.startswith("<!--", tag)
                end = source.find("-->" if comment else ">", tag + (4 if comment else 1))
                at = size if end < 0 else end + (3 if comment else 1)
                continue
            if not (after.isascii() and after.isalpha()) and not (after == "/" and source[tag + 2 : tag + 3].isalpha()):
                self.text("<")
                at = tag + 1
                continue
            m = TAG.match(source, tag)
            if not m:
                end = source.find(">", tag)
                if end < 0:
                    break
                name = re.match(r"</?([a-zA-Z][^\s/>]*)", source[tag:end + 1])
                closing, name, attributes, at = after == "/", name[1].lower(), "", end + 1
            else:
                closing, name, attributes, at = bool(m[1]), m[2].lower(), m[3], m.end()
            if closing:
                self.end(name)
                continue
            self.begin(name, attributes)
            if name == "plaintext":
                self.text(source[at:], literal=True)
                break
            if name in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                stop = end.start() if end else size
                self.raw(name, source[at:stop], attributes)
                at = stop
        while len(self.open) > 1:
            self.close()
        return "\n".join(self.papers[0].done())

    def raw(self, name: str, text: str, source: str) -> None:
        if name == "style":
            media = next((m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(source) if m[0].lower() == "media"), "")
            if not self.given and not self.at.get("template") and on_screen(html.unescape(media)):
                before = self.rules.count
                add_rules(self.rules, text)
                self.late |= self.begun and self.rules.count > before
        elif name == "title" and not self.at.get("svg"):
            self.title.append(text)
        elif name == "textarea":
            self.text(text)
        elif name == "xmp":
            self.text(text, literal=True)

    def text(self, source: str, literal: bool = False) -> None:
        top = self.open[-1]
        self.begun = self.begun or bool(source.strip())
        if top.drawn:
            return
        if top.shown and top.visible and not top.closed and top.tag not in ("table", "tr", "tbody", "thead", "tfoot"):
            self.papers[-1].text(html.unescape(source) if "&" in source and not literal else source, top.kept)
        elif top.shown and top.visible and not top.closed and source.strip():
            # text that is misplaced between cells stands before the table
            outer = self.papers[-1]
            outer.text(html.unescape(source), False)

    def imply(self, name: str) -> None:
        """Close what `name` ends."""
        for tag in ENDS.get(name, ()):
            k = self.last((tag,))
            if k > self.last(FENCE.get(tag, DEFAULT_FENCE)):
                self.close_to(k)

    def within(self, name: str) -> bool:
        return self.last((name,)) > self.last(("table",))

    def begin(self, name: str, source: str) -> None:
        self.imply(name)
        if name in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.begin("tr", "")
        attributes = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in reversed(ATTRIBUTE.findall(source))} if source.strip(" /") else {}
        top = self.open[-1]
        names = {name, *(f".{c}" for c in attributes.get("class", "").split())}
        if "id" in attributes:
            names.add(f"#{attributes['id']}")
        style = self.rules.style(names, attributes, attributes.get("style", ""))
        display = style.get("display", "revert")
        if display.startswith("revert"):
            display = "none" if "hidden" in attributes or name == "dialog" and "open" not in attributes else ""
        shown = top.shown and not (
            name in NO_BOX
            or top.drawn and name in UNDRAWN
            or display == "none"
            or name == "input" and attributes.get("type", "").lower() == "hidden"
            or top.closed and name != "summary"
        )
        visible = {"visible": True, "initial": True, "hidden": False, "collapse": False}.get(style.get("visibility"), top.visible)
        paper = self.papers[-1]
        if name in VOID:
            if shown and visible:
                if name == "br":
                    paper.end_line()
                elif name == "hr":
                    paper.ask(2)
                elif name == "input" and attributes.get("type", "text").lower() in ("submit", "button", "reset", "text"):
                    paper.text(attributes.get("value", ""), False)
            return
        e = Element(name, bool(shown), visible, top.kept or name in ("pre", "xmp", "textarea", "plaintext"))
        e.closed = name == "details" and "open" not in attributes
        e.drawn = name == "svg" or top.drawn and name not in ("text", "foreignobject")
        outer = self.last(LISTS)
        inner = bool(self.at.get("li") or self.at.get("dd"))
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append(e)
        if not shown:
            return
        if name in BLOCK or name == "text" and top.drawn:
            e.gap = 2 if name in APART else 1
            if inner and (name in LISTS or name == "dl"):
                e.gap = 1
            paper.ask(e.gap)
        if name == "table":
            e.grid = Grid() if len(self.papers) <= MOST_TABLES else None
        elif name == "tr":
            if grid := self.grid():
                grid.row()
            else:
                paper.ask(1)
        elif name in ("td", "th") and not self.grid():
            paper.text(" ", False)
        elif name in ("td", "th"):
            e.paper = Paper()
            e.spans = tuple(max(1, min(MOST_SPAN, number(attributes.get(n), 1))) for n in ("colspan", "rowspan"))
            self.papers.append(e.paper)
        elif name == "ol":
            e.counter = number(attributes.get("start"), 1)
        elif name == "li":
            mark = "- "
            if outer and (x := self.open[outer]).counter is not None:
                x.counter = number(attributes.get("value"), x.counter)
                mark = f"{x.counter}. "
                x.counter += 1
            paper.push(mark, " " * len(mark))
            e.marks = 1
        elif name == "dd":
            paper.push("  ", "  ")
            e.marks = 1
        elif name == "blockquote":
            paper.start() if paper.gap and paper.now else None
            paper.push("> ", "> ")
            e.marks = 1

    def grid(self) -> Grid | None:
        return self.open[k].grid if (k := self.last(("table",))) else None

    def end(self, name: str) -> None:
        if name in ("br", "p") and not self.within(name):
            self.begin(name, "")
            if name == "br":
                return
        k = self.last((name,))
        # an end tag doesn't reach out of its cell
        if k and (name in FAR_ENDS or k >= self.last(CELLS)):
            self.close_to(k)

    def close_to(self, place: int) -> None:
        while len(self.open) > place:
            self.close()

    def close(self) -> None:
        e = self.open.pop()
        self.at[e.tag].pop()
        if not e.shown:
            return
        paper = self.papers[-1]
        if e.paper is not None:
            self.papers.pop()
            if grid := self.grid():
                grid.cell(e.paper.done(), *e.spans)
            return
        if e.grid is not None:
            paper.block(e.grid.lines())
        if e.gap:
            paper.ask(e.gap)
        for _ in range(e.marks):
            paper.pop()


def number(text: str | None, otherwise: int) -> int:
    m = re.match(r"\s*([+-]?[0-9]{1,6})", text or "")
    return int(m[1]) if m else otherwise


def rendered(source: str) -> tuple[str, str]:
    """Title and visible text of a page."""
    page = Page()
    text = page.read(source)
    if page.late:
        page = Page(page.rules)
        text = page.read(source)
    return SPACES.sub(" ", html.unescape("".join(page.title[:1]))).strip(), text


def with_layout(pages: DataFrame, column: str = "html") -> DataFrame:
    """`pages` without the column of markup, with `page_title` and `page_text`."""
    rest = [c for c in pages.columns if c not in (column, "page_title", "page_text")]
    out = pages.limit(0).select(*rest).withColumns({c: F.lit(None).cast("string") for c in ("page_title", "page_text")}).schema

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                found = [(None, None) if x is None else rendered(x) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in rest),
                        pa.array([t for t, _ in found], pa.string()),
                        pa.array([t for _, t in found], pa.string()),
                    ],
                    [*rest, "page_title", "page_text"],
                )

    return pages.mapInArrow(render, out)


def op4_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_layout(pages).select(
        "page_id", "url", F.col("page_title").alias("title"), F.col("page_text").alias("text")
    )
