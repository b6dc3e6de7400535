"""HTML to text the way a page is laid out.

A tree builder puts in what the markup leaves out (closed paragraphs, list
items, rows, cells, table bodies).  Visibility rules take away what a browser
does not show: the head, scripts, templates, hidden elements, closed details,
and what inline or page styles set to ``display:none`` or
``visibility:hidden``.  All other text is emitted: blocks on lines of their
own, paragraphs with a blank line between, list items with bullets or numbers
under their indentation, preformatted text as it stands, and tables with their
columns aligned.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements nested deeper stay in the tree at this depth, as in browsers.
DEEPEST = 512
#: Indentation stops growing here, and columns are aligned within so many characters of a line; text beyond is kept.
MOST_INDENT, MOST_PADDED = 120, 1000

# No pattern can go back over what it has matched, so a page is read in linear time.
_SIMPLE_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>\s++[a-zA-Z_:][\w:.-]*+(?>="[^"<>]*+"|='[^'<>]*+'|=[^\s"'<>=`/]++)?)*+)\s*+(/?)>""")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_PAIR = re.compile(r"""([a-zA-Z_:][\w:.-]*+)(?>="([^"]*+)"|='([^']*+)'|=([^\s"'<>=`/]++))?""")
_GAP, _NAME, _EQUALS, _BARE = re.compile(r"[\s/]*+"), re.compile(r"=?+[^\s/>=]*+"), re.compile(r"\s*+=\s*+"), re.compile(r"[^\s>]*+")
_SPACE = re.compile("[ \t\n\r\f]+")
_NUMBER = re.compile(r"-?[0-9]{1,9}")


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


# Element names by their role in HTML.
_VOID = _set("area base br col embed hr img input link meta param source track wbr")
_RAW = _set("script style xmp iframe noembed noframes noscript textarea title")
_HIDDEN = _set("head script style template noscript iframe noembed noframes title meta link base datalist object audio video canvas param source track rp")
_SPACED = _set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table hr figure fieldset details menu dir form")
_LINE = _set("html body div section article aside header footer nav main address li dt dd tr caption legend figcaption summary center optgroup option thead tbody tfoot td th hgroup search dialog")
_ENDS_P = _SPACED | _set("address article aside center div footer header hgroup main nav section summary li dt dd search dialog")
_IN_HEAD = _set("base link meta title style script template noscript")

#: What an opening tag closes, as far as the nearest of the second names.
_CLOSES = {
    "li": (_set("li"), _set("ul ol menu dir table td th")),
    "dt": (_set("dt dd"), _set("dl table td th")),
    "dd": (_set("dt dd"), _set("dl table td th")),
    "option": (_set("option"), _set("select datalist")),
    "optgroup": (_set("option optgroup"), _set("select datalist")),
    "td": (_set("td th"), _set("tr table")),
    "th": (_set("td th"), _set("tr table")),
    "tr": (_set("tr td th caption colgroup"), _set("table")),
    "thead": (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")),
    "tbody": (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")),
    "tfoot": (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")),
    "rt": (_set("rt rp"), _set("ruby")),
    "rp": (_set("rt rp"), _set("ruby")),
}
_WALLS = _set("table td th caption template")
_P = _set("p")


class Element:
    """A node of the tree: its name, its attributes (raw until asked for), its parent and its children (elements and strings)."""

    __slots__ = ("name", "raw", "known", "parent", "children")

    def __init__(self, name: str, raw: str = "", known: dict[str, str] | None = None):
        self.name, self.raw, self.known, self.parent, self.children = name, raw, known, None, []

    def attribute(self, name: str) -> str | None:
        if self.known is None:
            if not self.raw:
                return None
            self.known = {}
            for key, *values in _PAIR.findall(self.raw):
                self.known.setdefault(key.lower(), "".join(values))
        value = self.known.get(name)
        return unescape(value) if value and "&" in value else value

    def adopt(self, other: Element) -> None:
        """Takes on attributes that it does not have yet."""
        self.attribute("")
        other.attribute("")
        self.known = {**(other.known or {}), **(self.known or {})}


def _odd_tag(html: str, at: int) -> tuple[dict[str, str], int] | None:
    """Attributes from ``at`` on as a browser reads them, and the place behind the tag; None if it never ends."""
    known: dict[str, str] = {}
    n = len(html)
    while True:
        at = _GAP.match(html, at).end()
        if at >= n:
            return None
        if html[at] == ">":
            return known, at + 1
        name = _NAME.match(html, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(html, at):
            at = equals.end()
            if at < n and html[at] in "\"'":
                end = html.find(html[at], at + 1)
                if end < 0:
                    return None
                value, at = html[at + 1 : end], end + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
        known.setdefault(name[0].lower(), value)


def build(html: str) -> tuple[Element, list[str], set[str]]:
    """The tree of a page, the texts of its style elements, and the classes and ids that stand in it."""
    root = Element("html")
    head = Element("head")
    body = Element("body")
    root.children = [head, body]
    head.parent = body.parent = root
    stack: list[Element] = [root, body]
    styles: list[str] = []
    words: set[str] = set()
    at, n = 0, len(html)

    def close(names: frozenset[str], walls: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].name in names:
                del stack[i:]
                continue
            if stack[i].name in walls:
                return None
        return None

    def add(element: Element, stays_open: bool = True) -> None:
        element.parent = stack[-1]
        stack[-1].children.append(element)
        if stays_open and len(stack) < DEEPEST:
            stack.append(element)

    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            stack[-1].children.append(html[at:])
            break
        if begin > at:
            stack[-1].children.append(html[at:begin])
        after = html[begin + 1 : begin + 2]
        if html.startswith("<!--", begin):
            short = next((x for x in ("<!-->", "<!--->") if html.startswith(x, begin)), None)
            end = html.find("-->", begin + 4)
            at = begin + len(short) if short else n if end < 0 else end + 3
            continue
        if after in ("!", "?") or (after == "/" and not _TAG_NAME.match(html, begin + 2)):
            end = html.find(">", begin)
            at = n if end < 0 else end + 1
            continue
        named = _TAG_NAME.match(html, begin + (2 if after == "/" else 1))
        if named is None:
            stack[-1].children.append("<")
            at = begin + 1
            continue
        if tag := _SIMPLE_TAG.match(html, begin):
            raw, known, at = tag[3], None, tag.end()
        else:
            read = _odd_tag(html, named.end())
            if read is None:
                break
            raw, (known, at) = "", read
        closed = html[at - 2] == "/"
        name = named[0].lower()
        if after == "/":
            if name == "p" and not any(e.name == "p" for e in stack):
                add(Element("p"), False)
            elif name == "br":
                add(Element("br"), False)
            for i in range(len(stack) - 1, 1, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in _WALLS and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                    break
            continue
        if known is not None or "class" in raw or "id" in raw or raw != raw.lower():
            own = Element(name, raw, known)
            words.update((own.attribute("class") or "").split(), (own.attribute("id") or "",))
        if name in ("html", "body"):
            (root if name == "html" else body).adopt(Element(name, raw, known))
            continue
        if name == "head":
            continue
        if name in _CLOSES:
            close(*_CLOSES[name])
        if name in _ENDS_P:
            close(_P, _WALLS)
        top = stack[-1].name
        if name in ("td", "th") and top in ("table", "thead", "tbody", "tfoot"):
            if top == "table":
                add(Element("tbody"))
            add(Element("tr"))
        elif name == "tr" and top == "table":
            add(Element("tbody"))
        element = Element(name, raw, known)
        if name in _RAW:
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*+>", re.I).search(html, at)
            text = html[at : end.start() if end else n]
            at = end.end() if end else n
            element.children.append(text)
            if name == "style" and (element.attribute("media") or "all").strip().lower() in ("all", "screen"):
                styles.append(text)
            add(element, False)
        else:
            add(element, name not in _VOID and not (closed and name in ("svg", "path", "use", "circle", "rect")))
    return root, styles, words


_COMMENT, _MARK = re.compile(r"/\*.*?(?:\*/|\Z)", re.S), re.compile("[{};]")
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*+)?+((?:[.#][\w-]++)*+)")
_PART = re.compile(r"([.#])([\w-]++)")
_APPLIES = re.compile(r"^@(?:media(?![\w-])(?!.*\b(?:print|speech)\b)|supports|layer|container|scope)", re.S)
# What the two properties may be set to here.
_SHOWS, _HIDES = _set("visible initial"), _set("hidden collapse")


def _rules_of(text: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of a style sheet in order, without comments and without what is for paper or speech."""
    text = _COMMENT.sub(" ", text)
    at, skipping, depth, selector = 0, 0, 0, ""
    for mark in _MARK.finditer(text):
        before, at = text[at : mark.start()], mark.end()
        if mark[0] == "{":
            depth += 1
            selector = before.strip()
            if not skipping and selector.startswith("@") and not _APPLIES.match(selector):
                skipping = depth
        elif mark[0] == "}":
            if not skipping and selector and not selector.startswith("@"):
                yield selector, declared + before
            if skipping == depth:
                skipping = 0
            depth, selector = max(0, depth - 1), ""
        elif selector:
            declared += before + ";"
        if mark[0] != ";" or not selector:
            declared = ""


def _declared(block: str) -> dict[str, tuple[bool, str]]:
    """The last ``display`` and ``visibility`` of a block, each with whether it is important."""
    out: dict[str, tuple[bool, str]] = {}
    for one in block.split(";"):
        name, _, value = one.partition(":")
        name = name.strip().lower()
        if name in ("display", "visibility"):
            value, bang, _ = value.partition("!")
            if bang or not out.get(name, (False, ""))[0]:
                out[name] = (bool(bang), value.strip().lower())
    return out


class Styles:
    """Rules of a page that set ``display`` or ``visibility``, by what their last compound names.

    Selectors of names, classes and ids, joined by blanks or ``>``; rules with
    any other selector are left out.
    """

    def __init__(self, styles: list[str], words: set[str]):
        self.rules: dict[str, dict[tuple, tuple]] = {}
        self.seen: dict[tuple, dict[str, str]] = {}
        order = 0
        for text in styles:
            for selectors, block in _rules_of(text):
                if not (said := _declared(block)):
                    continue
                for one in selectors.split(","):
                    order += 1
                    # a class or id that stands nowhere in the page matches nothing
                    if (chain := self._chain(one)) is not None and all(c[1] <= words and (not c[2] or c[2] in words) for c in chain):
                        name, classes, ident = chain[-1][:3]
                        key = f"#{ident}" if ident else f".{min(classes)}" if classes else name or "*"
                        weight = (sum(1 for c in chain if c[2]), sum(len(c[1]) for c in chain), sum(1 for c in chain if c[0]))
                        mine = self.rules.setdefault(key, {}).setdefault(chain, {})
                        for prop, (bang, value) in said.items():
                            mine[prop] = max(mine.get(prop, ((False,), "")), ((bang, False, weight, order), value))

    @staticmethod
    def _chain(selector: str) -> tuple | None:
        out, child = [], False
        for part in selector.replace(">", " > ").split():
            if part == ">":
                child = True
                continue
            m = _COMPOUND.fullmatch(part)
            if not m:
                return None
            kinds = _PART.findall(m[2])
            ids = [v for k, v in kinds if k == "#"]
            if len(set(ids)) > 1:
                return None
            out.append(("" if m[1] in (None, "*") else m[1].lower(), frozenset(v for k, v in kinds if k == "."), ids[0] if ids else "", child))
            child = False
        return tuple(out) or None

    def of(self, e: Element) -> dict[str, str]:
        """What applies to an element: the rules' and its own style's last word on each property."""
        best: dict[str, tuple] = {}
        if not self.rules and not e.raw and not e.known:
            return best
        key = (id(e.parent), e.name, e.raw)  # twins among siblings are told apart by nothing that a rule may name
        if e.raw or not e.known:
            if key in self.seen:
                return self.seen[key]
        if self.rules:
            ident, classes = e.attribute("id"), (e.attribute("class") or "").split()
            for name in {e.name, "*", *(f".{c}" for c in classes), *([f"#{ident}"] if ident else [])}:
                for chain, mine in self.rules.get(name, {}).items():
                    if _matches(e, chain, len(chain) - 1):
                        for prop, said in mine.items():
                            best[prop] = max(best.get(prop, said), said)
        if (own := e.attribute("style")) and ("display" in own.lower() or "visibility" in own.lower()):
            for prop, (bang, value) in _declared(_COMMENT.sub(" ", own)).items():
                best[prop] = max(best.get(prop, ((False,), "")), ((bang, True), value))
        out = {prop: value for prop, (_, value) in best.items()}
        if e.raw or not e.known:
            self.seen[key] = out
        return out


def _fits(e: Element, compound: tuple) -> bool:
    name, classes, ident, _ = compound
    return (not name or name == e.name) and (not ident or ident == e.attribute("id")) and (not classes or classes <= set((e.attribute("class") or "").split()))


def _matches(e: Element, chain: tuple, k: int) -> bool:
    """Whether an element fits the chain's compound ``k`` and its ancestors the ones before.

    Ancestors are taken as near as possible; only a child combinator may send
    the search further up, by starting again from the compound before it.
    """
    if not _fits(e, chain[k]):
        return False
    at, retry = e.parent, []
    while k > 0:
        if chain[k][3]:
            if at is not None and _fits(at, chain[k - 1]):
                k, at = k - 1, at.parent
                continue
        else:
            while at is not None and not _fits(at, chain[k - 1]):
                at = at.parent
            if at is not None:
                retry.append((k, at.parent))
                k, at = k - 1, at.parent
                continue
        if not retry:
            return False
        k, at = retry.pop()
    return True


class _Page:
    """Lines of text as they come, indented, with blank lines between spaced blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False
        self.indent = ""
        self.mark: tuple[str, bool] | None = None  # what the next line begins with, and whether a blank one goes before

    def flush(self) -> None:
        if self.inline:
            text = _SPACE.sub(" ", "".join(self.inline)).strip(" ")
            self.inline = []
            if text:
                self.line(text)

    def line(self, text: str) -> None:
        begin = self.indent
        if self.mark is not None:
            begin, self.gap = self.mark
            self.mark = None
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(begin + text if text else begin.rstrip())

    def block(self, lines: list[str], spaced: bool) -> None:
        self.flush()
        self.gap |= spaced
        for text in lines:
            if text or (self.lines and not self.gap):
                self.line(text)
        self.gap |= spaced

    def enter(self, mark: str) -> tuple:
        """Begins a part whose first line starts with ``mark`` and whose others stand under its text."""
        self.flush()
        before = (self.indent, self.mark)
        begin, gap = self.mark if self.mark is not None else (self.indent, self.gap)
        self.mark, self.gap = (begin + mark, gap), False
        if len(self.indent) < MOST_INDENT:
            self.indent += " " * len(mark)
        return before

    def leave(self, before: tuple, shown: bool) -> None:
        """Ends it; an empty one leaves its mark alone on a line if ``shown``."""
        self.flush()
        if self.mark is not None:
            if shown:
                self.line("")
            else:
                self.gap, self.mark = self.mark[1] if before[1] is None else self.gap, before[1]
                self.indent = before[0]
                return
        self.indent, self.gap = before[0], False


def _run(step: Generator) -> object:
    """Runs a generator that yields generators for what lies deeper, on a stack of its own, so depth takes no frames of Python."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


class Renderer:
    """Renders one page; counts its tables.  The methods that return generators are for :func:`_run`."""

    def __init__(self, styles: Styles):
        self.styles, self.tables = styles, 0

    def seen(self, e: Element, shown: bool) -> tuple[bool, bool]:
        """Whether an element is laid out at all, and whether its own text shows."""
        if e.name in _HIDDEN:
            return False, False
        said = self.styles.of(e)
        display, visibility = said.get("display"), said.get("visibility")
        if display is None:
            out = e.attribute("hidden") is not None or (e.name == "dialog" and e.attribute("open") is None)
        else:
            out = display == "none"
        if e.name == "input" and (e.attribute("type") or "").lower() == "hidden":
            out = True
        return not out, True if visibility in _SHOWS else False if visibility in _HIDES else shown

    def lines(self, e: Element, shown: bool) -> Generator:
        page = _Page()
        yield self.into(page, e, shown)
        page.flush()
        return page.lines

    def into(self, page: _Page, e: Element, shown: bool) -> Generator:
        number = None
        if e.name == "ol":
            start = e.attribute("start") or ""
            number = int(start) if _NUMBER.fullmatch(start) else 1
        shut = e.name == "details" and e.attribute("open") is None
        for child in e.children:
            if isinstance(child, str):
                if shown and not shut:
                    page.inline.append(unescape(child) if "&" in child else child)
                continue
            name = child.name
            if shut and name != "summary":
                continue
            laid, own = self.seen(child, shown)
            if not laid:
                continue
            if name == "br":
                empty = not page.inline
                page.flush()
                if empty and page.lines and page.lines[-1] and page.mark is None:
                    page.lines.append("")
            elif name == "hr":
                page.block([], True)
            elif name == "li":
                mark = "- "
                if number is not None:
                    value = child.attribute("value") or ""
                    number = int(value) if _NUMBER.fullmatch(value) else number
                    mark, number = f"{number}. ", number + 1
                before = page.enter(mark if own else " " * len(mark))
                yield self.into(page, child, own)
                page.leave(before, own)
            elif name in ("ul", "ol", "menu", "dir"):
                page.flush()
                spaced = e.name not in ("li", "ul", "ol")
                page.gap |= spaced
                yield self.into(page, child, own)
                page.flush()
                page.gap |= spaced
            elif name == "pre":
                text = unescape("".join(self.strings(child, own)))
                page.block([t.rstrip("\r") for t in text.removeprefix("\n").rstrip("\n").split("\n")], True)
            elif name == "blockquote":
                page.flush()
                page.gap = True
                indent, page.indent = page.indent, page.indent + ("    " if len(page.indent) < MOST_INDENT else "")
                if page.mark is not None:
                    page.mark = (page.mark[0] + "    ", page.mark[1])
                yield self.into(page, child, own)
                page.flush()
                page.indent, page.gap = indent, True
            elif name == "dd":
                before = page.enter("    ")
                yield self.into(page, child, own)
                page.leave(before, False)
            elif name == "table":
                self.tables += 1
                page.block((yield self.table(child, own)), True)
            elif name in ("textarea", "xmp"):
                page.block([t for x in child.children if own for t in (unescape(x) if name == "textarea" else x).split("\n")], False)
            elif name == "input":
                if own and (child.attribute("type") or "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                    page.inline.append(" " + (child.attribute("value") or "") + " ")
            elif name in _SPACED or name in _LINE:
                page.flush()
                page.gap |= name in _SPACED
                yield self.into(page, child, own)
                page.flush()
                page.gap |= name in _SPACED
            else:
                yield self.into(page, child, own)

    def table(self, e: Element, shown: bool) -> Generator:
        rows: list[list[tuple[list[str], int]]] = []
        before: list[str] = []
        held: dict[int, int] = {}  # columns that a cell above still spans

        def loose(text: str, show: bool) -> None:
            if show and text.strip():
                before.append(_SPACE.sub(" ", unescape(text)).strip(" "))

        def span_of(cell: Element, name: str, most: int) -> int:
            value = cell.attribute(name) or ""
            return min(max(1, int(value)), most) if _NUMBER.fullmatch(value) else 1

        def walk(node: Element, show: bool) -> Generator:
            for child in node.children:
                if isinstance(child, str):
                    loose(child, show)
                    continue
                laid, own = self.seen(child, show)
                if not laid:
                    continue
                if child.name in ("thead", "tbody", "tfoot"):
                    held.clear()  # a cell spans rows of its own group only
                    yield walk(child, own)
                    held.clear()
                elif child.name == "tr":
                    row: list[tuple[list[str], int]] = []
                    column = 0
                    above = dict(held)
                    # each column counts down once a row, whether or not a cell of this row comes to it
                    held.clear()
                    held.update({c: n - 1 for c, n in above.items() if n > 1})
                    for cell in child.children:
                        if isinstance(cell, str):
                            loose(cell, own)
                            continue
                        there, mine = self.seen(cell, own)
                        if not there:
                            continue
                        while above.get(column, 0) > 0:
                            row.append(([], 1))
                            column += 1
                        span, down = span_of(cell, "colspan", 1000), span_of(cell, "rowspan", 65534)
                        row.append(((yield self.lines(cell, mine)), span))
                        if down > 1:
                            for c in range(column, column + span):
                                held[c] = down - 1
                        column += span
                    rows.append(row)
                elif child.name not in ("colgroup", "col"):
                    before.extend((yield self.lines(child, own)))

        yield walk(e, shown)
        width: dict[int, int] = {}
        for row in rows:
            column = 0
            for lines, span in row:
                if span == 1:
                    width[column] = max(width.get(column, 0), max((len(t) for t in lines), default=0))
                column += span
        # where each column would begin, were every row padded
        place, known = [0], sorted(width)
        for c in range(known[-1] + 1 if known else 0):
            place.append(place[-1] + width.get(c, 0) + 2)
        starts = lambda c: place[c] if c < len(place) else place[-1] + 2 * (c - len(place) + 1)
        out = before
        for row in rows:
            for k in range(max((len(lines) for lines, _ in row), default=0)):
                column, parts, length = 0, [], 0
                for lines, span in row:
                    text = lines[k] if k < len(lines) else ""
                    if text or length < MOST_PADDED:
                        part = text.ljust(max(0, min(starts(column + span) - starts(column) - 2, MOST_PADDED - length)))
                        length += len(part) + 2
                        parts.append(part)
                    column += span
                out.append("  ".join(parts).rstrip())
        return out

    def strings(self, e: Element, shown: bool) -> Iterator[str]:
        """The text under an element in order, line breaks for ``br``."""
        stack = [(iter(e.children), shown)]
        while stack:
            child = next(stack[-1][0], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                if stack[-1][1]:
                    yield child
            elif child.name == "br":
                yield "\n"
            else:
                laid, own = self.seen(child, stack[-1][1])
                if laid:
                    stack.append((iter(child.children), own))


def render(html: str) -> tuple[str, int]:
    """The visible text of a page and its number of tables."""
    root, styles, words = build(html)
    renderer = Renderer(Styles(styles, words))
    page = _Page()
    laid, shown = renderer.seen(root, True)
    if laid:
        for part in root.children[1:]:
            there, own = renderer.seen(part, shown)
            if there:
                _run(renderer.into(page, part, own))
                page.flush()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return "\n".join(page.lines), renderer.tables


_RESULT = "page_id long, url string, text string, n_chars long, n_lines long, n_tables long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            done = [render(h or "") for h in part.column("html").to_pylist()]
            texts = [t for t, _ in done]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"),
                    part.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([sum(1 for x in t.split("\n") if x) for t in texts], pa.int64()),
                    pa.array([k for _, k in done], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars", "n_lines", "n_tables"],
            )


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars, n_lines, n_tables``.

    Whole pages are read.  A null or empty page gives an empty text; broken
    markup is built into a tree like any other, and depth, odd numbers or tags
    that never end fail nothing.  Elements nested more than 512 deep are
    attached at that depth, so their text is kept.  Repeated rows give
    a row each, null ids and urls stay null, other columns are ignored, and an
    empty table gives an empty result.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, _RESULT)
