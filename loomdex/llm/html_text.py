"""HTML extraction by layout: a tree with implied tags, visibility rules, and a renderer that emits all visible text.

The tree builder reads tags with one pattern and supplies what HTML leaves out: end tags of p, li, dt, dd, option, rows and cells where another
begins, tables' rows, the body's begin, and elements still open at the end. The renderer skips what is not shown (head matter, script, style, template, ``hidden``,
``display:none`` and ``visibility:hidden`` in attributes or in simple rules of style sheets, where the last declaration of the highest rank wins and
rules for print or under conditions hide nothing, closed ``details`` but for their summary, closed
dialogs, hidden inputs) and keeps everything else: navigation, footers and
boxes too. Inline white space collapses; blocks are set apart by line breaks and the larger ones by an empty line; list items carry bullets or
numbers and are indented by depth; ``pre`` keeps its spacing; the cells of a table's rows are padded to columns of equal width.

Walks are loops with a stack of their own, so nesting may have any depth.

Defined cases: null or empty html gives an empty text; text outside any tag is text; malformed tags are text; repeated rows each get a row; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from loomdex.llm.common import blobs, map_batches, slices

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^<>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDING = re.compile(r"none|hidden|collapse", re.I)
_NOTE, _SIMPLE = re.compile(r"/\*.*?(?:\*/|\Z)", re.S), re.compile(r"[a-z][a-z0-9-]*(?:\.[\w-]+)?|[.#][\w-]+|\*")
_MARK = re.compile(r"[{};]|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'", re.S)
_SAID = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([^;!]*)(!\s*important)?", re.I)
_SEEN_MEDIA, _OTHER_MEDIA = re.compile(r"(?:(?:only\s+)?(?:screen|all))?|not\s+(?:print|speech)", re.I), re.compile(r"(?:only\s+)?(?!not\b|only\b|screen\b|all\b)[a-z]+(?:\s+and\b.*)?|not\s+(?:screen|all)", re.I | re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title xmp iframe noembed noframes")
UNSEEN = _words("head script style template title meta link base noembed noframes iframe object audio video canvas datalist desc defs metadata symbol rp")
IN_HEAD = _words("title meta link base style script noscript template head")
WIDE = _words("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset")
BLOCK = WIDE | _words("html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li main menu nav search section summary tr caption option optgroup")
#: What a start tag closes, and the elements above which it does not look.
_CLOSES = {
    "li": (_words("li"), _words("ul ol menu dir")), "dt": (_words("dt dd"), _words("dl")), "dd": (_words("dt dd"), _words("dl")),
    "option": (_words("option"), _words("select datalist optgroup")), "optgroup": (_words("option optgroup"), _words("select")),
    "tr": (_words("tr td th caption colgroup"), _words("table tbody thead tfoot")), "td": (_words("td th"), _words("tr table")), "th": (_words("td th"), _words("tr table")),
    "thead": (_words("thead tbody tfoot tr td th caption colgroup"), _words("table")),
}
_CLOSES |= dict.fromkeys(("tbody", "tfoot"), _CLOSES["thead"])
_BOUND = _words("table td th caption button object template html body")
#: Tables in tables beyond this depth are not aligned (each level takes some frames of the stack). Columns are padded to their widest cell; only in a table
#: whose padding would take more than so many characters, to ``WIDEST`` at most. Both keep all text.
DEEPEST, MOST_PADDING, WIDEST = 200, 1 << 23, 80
_STRUCTURE = _BOUND | _words("tr tbody thead tfoot")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def parse(source: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root = Node("#root")
    stack = [root]
    where: dict[str, list[int]] = {}  # places of the open elements of each tag

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            where[stack.pop().tag].pop()

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        where.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def highest(tags: frozenset) -> int:
        return max((p[-1] for t in tags if (p := where.get(t))), default=0)

    def close(tags: frozenset, bound: frozenset) -> None:
        """End the outermost open element of ``tags`` above the nearest of ``bound``."""
        above = highest(bound)
        found = [p[k] for t in tags if (p := where.get(t)) and (k := bisect_right(p, above)) < len(p)]
        if found:
            pop_to(min(found))

    sheets: list[tuple[str, int]] = []

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and not s.isspace():
                pop_to(len(stack) - 1)  # the body begins
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            places = where.get(tag)
            if places:
                if places[-1] > highest(_BOUND) or tag in _STRUCTURE:
                    pop_to(places[-1])
            elif tag in ("p", "br"):
                stack[-1].children.append(Node(tag))
            continue
        attributes = {a.lower(): html.unescape(x or y or z) for a, x, y, z in _ATTRIBUTE.findall(m[3])} if m[3].strip(" /\n\t") else {}
        if tag not in IN_HEAD and where.get("head") and not where.get("template"):
            pop_to(where["head"][-1])
        if tag in WIDE or tag in BLOCK and tag not in ("option", "optgroup", "tr", "caption"):
            if where.get("p") and tag not in ("html", "body"):
                close(frozenset("p"), _BOUND)
        if (ends := _CLOSES.get(tag)) is not None:
            close(*ends)
        if tag in ("td", "th") and where.get("table") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr"))
        node = Node(tag, attributes)
        if tag in VOID:
            stack[-1].children.append(node)
        elif tag in RAW:
            stack[-1].children.append(node)
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(source, at)
            inside = source[at : end.start()] if end else source[at:]
            node.children.append(html.unescape(inside) if tag in ("textarea", "title") else inside)
            if tag == "style":
                sheets.append((inside, media(attributes.get("media", ""))))
            at = end.end() if end else size
        else:
            push(node)
    if rules := visibility_rules(sheets):
        todo = [(root, None)]
        while todo:
            node, above = todo.pop()
            for c in node.children:
                if isinstance(c, Node):
                    names = {c.tag, "*", "#" + c.attributes.get("id", "")} if c.attributes else {c.tag, "*"}
                    for k in c.attributes.get("class", "").split():
                        names |= {"." + k, f"{c.tag}.{k}"}
                    if met := [said for n in names if n in rules for chain, said in rules[n] if not chain or within(chain, above)]:
                        won = {p: max(r[p] for r in met if p in r) for p in ("display", "visibility") if any(p in r for r in met)}
                        own = declared(c.attributes.get("style", ""))
                        ends = {p: own[p][1] if p in own and own[p][0] >= (p in won and won[p][0][0]) else won[p][1] for p in {*own, *won}}
                        said_so = {"display": ("none", "revert"), "visibility": ("hidden", "visible")}
                        c.attributes["style"] = ";".join(f"{p}:{said_so[p][not hides]}" for p, hides in ends.items())
                    todo.append((c, (names, above)))
    if "visibility" in source.lower():
        settle_visibility(root)
    return root


def within(chain: tuple, above: tuple | None) -> bool:
    """Whether ancestors (names of the nearest, and those above it) meet the parts of a selector, its last but one first."""
    if not chain:
        return True
    (child, part), rest = chain[0], chain[1:]
    while above:
        names, above = above
        if part in names and within(rest, above):
            return True
        if child:
            return False
    return False


def settle_visibility(root: Node) -> None:
    """Elements that inherit or declare ``visibility:hidden`` lose their own text, and go where nothing in them is visible again."""
    order, todo = [], [(root, False)]
    while todo:
        node, off = todo.pop()
        said = declared(node.attributes["style"]).get("visibility") if "style" in node.attributes else None
        if said and not re.search(r"visibility\s*:\s*(?:inherit|unset|revert)", node.attributes["style"], re.I):
            off = said[1]
        order.append((node, off))
        todo += [(c, off) for c in node.children if isinstance(c, Node)]
    seen = set()
    for node, off in reversed(order):  # what is in an element comes before it
        if not off:
            seen.add(id(node))
            continue
        node.children = [c for c in node.children if isinstance(c, Node) and id(c) in seen]
        if node.children:
            seen.add(id(node))
        else:
            node.attributes = {**node.attributes, "style": "display:none"}


def media(queries: str) -> int:
    """Whether a screen meets a list of media queries: 2 always, 1 perhaps, 0 never."""
    each = [q.strip() for q in queries.split(",")]
    return max(2 if _SEEN_MEDIA.fullmatch(q) else 0 if _OTHER_MEDIA.fullmatch(q) else 1 for q in each)


def declared(said: str) -> dict[str, tuple[bool, bool]]:
    """Of display and visibility, as far as declared: whether important, and whether it hides; the last declaration wins, important ones first."""
    out: dict[str, tuple[bool, bool]] = {}
    for name, value, important in _SAID.findall(said):
        name, now = name.lower(), (bool(important), bool(_HIDING.fullmatch(value.strip())))
        if now[0] >= out.get(name, now)[0]:
            out[name] = now
    return out


def visibility_rules(sheets: list[tuple[str, int]]) -> dict[str, list[tuple[tuple, dict[str, tuple]]]]:
    """What style sheets (with what ``media`` says of each) declare, by the last part of a selector: the parts before it (whether the parent is meant,
    and the part), and for each of display and visibility its rank (important, specificity, place) and whether it hides. Parts are a tag, a class, an id or a
    tag with a class, one in another or in its parent (``>``); other selectors are not read.

    Rules in at-rules that a screen only perhaps meets (media with conditions, ``@supports``, layers) can show but not hide, and of those that it
    never meets, as for print, nothing counts: in doubt the text is kept.
    """
    out: dict[str, list[tuple[tuple, dict[str, tuple]]]] = {}
    place = 0
    for sheet, outer in sheets:
        sheet = _NOTE.sub("", sheet)
        open_, at = [(outer, "")], 0  # of each open block, whether it counts, and the selectors if it is a rule
        for m in _MARK.finditer(sheet):
            mark = m[0]
            if mark == "{":
                head, counts = sheet[at : m.start()].strip(), open_[-1][0]
                if open_[-1][1]:
                    open_.append((0, "nested"))
                elif head.startswith("@"):
                    kind, rest = re.match(r"@([\w-]*)(.*)", head, re.S).groups()
                    kind = kind.lower()
                    open_.append((min(counts, media(rest) if kind == "media" else 1 if kind in ("supports", "layer", "container", "scope", "document", "-moz-document", "starting-style") else 0), ""))
                else:
                    open_.append((counts, head or "?"))
                at = m.end()
            elif mark == "}":
                if len(open_) > 1:
                    counts, selectors = open_.pop()
                    if selectors and counts and selectors != "nested":
                        said = declared(sheet[at : m.start()])
                        for x in map(str.strip, selectors.split(",")) if said else ():
                            parts = x.replace(">", " > ").split()
                            names = [q for q in parts if q != ">"]
                            if names and ">" not in (parts[0], parts[-1]) and "> >" not in " ".join(parts) and all(map(_SIMPLE.fullmatch, names)):
                                place += 1
                                chain, child = [], False
                                for q in parts[-2::-1] if len(parts) > 1 else ():
                                    if q == ">":
                                        child = True
                                    else:
                                        chain.append((child, q))
                                        child = False
                                weight = (sum(q[0] == "#" for q in names), sum("." in q for q in names), sum(q[0] not in ".#*" for q in names))
                                rule = {name: ((important, *weight, place), hides) for name, (important, hides) in said.items() if counts == 2 or not hides}
                                if rule:
                                    out.setdefault(names[-1], []).append((tuple(chain), rule))
                at = m.end()
            elif mark == ";" and not open_[-1][1]:
                at = m.end()
    return out


def hidden(node: Node) -> bool:
    a = node.attributes
    if node.tag in UNSEEN or node.tag == "dialog" and "open" not in a:
        return True
    if not a:
        return False
    said = declared(a["style"]) if "style" in a else {}
    return said.get("display", (False, False))[1] or "hidden" in a and "display" not in said or node.tag == "input" and a.get("type", "").lower() == "hidden"


def columns_of(text: str) -> int:
    """Columns that a line takes: wide East Asian characters take two, combining marks none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines in the making."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.space, self.indent, self.mark = False, False, 0, ""

    def add(self, text: str) -> None:
        """Inline text, white space collapsed across elements."""
        flat = _SPACE.sub(" ", text)
        if flat == " ":
            self.space = True
            return
        if not flat:
            return
        if (self.space or flat[0] == " ") and self.now:
            self.now.append(" ")
        self.now.append(flat.strip(" "))
        self.space = flat[-1] == " "

    def end_line(self, always: bool = False) -> None:
        text = "".join(self.now)
        self.now, self.space = [], False
        if text or always or self.mark and text:
            self.put(text)

    def put(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = "  " * self.indent
        if self.mark and text:
            lead, self.mark = "  " * (self.indent - 1) + self.mark, ""
        self.lines.append((lead + text).rstrip(" ") if text else "")

    def block(self, wide: bool = False) -> None:
        self.end_line()
        self.gap = self.gap or wide and bool(self.lines)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def render(root: Node, depth: int = 0) -> str:
    """All visible text of a tree; ``depth`` counts the tables around it."""
    page = Page()
    #: What is left to do: nodes and strings to render, or functions to call.
    todo: list = [root]
    lists: list[list] = []  # open lists: tag and next number
    while todo:
        node = todo.pop()
        if callable(node):
            node()
            continue
        if isinstance(node, str):
            page.add(node)
            continue
        if hidden(node):
            continue
        tag = node.tag
        if tag == "br":
            page.end_line(always=True)
        elif tag == "hr":
            page.block(True)
            page.put("-" * 20)
            page.gap = True
        elif tag == "input":
            if node.attributes.get("type", "").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number", ""):
                page.add(node.attributes.get("value", ""))
        elif tag == "pre" or tag == "textarea" or tag == "xmp":
            page.block(True)
            for line in "".join(_texts(node)).replace("\r\n", "\n").removeprefix("\n").rstrip("\n").split("\n"):
                page.put(line)
            page.block(True)
        elif tag == "table" and depth < DEEPEST:
            page.block(True)
            for line in _table(node, depth + 1):
                page.put(line)
            page.block(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            start = node.attributes.get("start", "1")
            page.block(not lists)
            lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            page.indent += 1

            def leave() -> None:
                page.block(len(lists) == 1)
                page.indent -= 1
                lists.pop()

            todo.append(leave)
            todo += reversed(node.children)
        elif tag == "li":
            page.block()
            if lists and lists[-1][0] == "ol":
                page.mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                page.mark = "- "
            if not lists:
                page.indent += 1

            def done(alone: bool = not lists) -> None:
                page.block()
                page.mark = ""
                page.indent -= alone

            todo.append(done)
            todo += reversed(node.children)
        elif tag == "dd" or tag == "blockquote":
            page.block(tag == "blockquote")
            page.indent += 1

            def back(wide: bool = tag == "blockquote") -> None:
                page.block(wide)
                page.indent -= 1

            todo.append(back)
            todo += reversed(node.children)
        elif tag == "details" and "open" not in node.attributes:
            page.block()
            todo.append(page.block)
            todo += [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        elif tag in BLOCK:
            wide = tag in WIDE
            page.block(wide)
            todo.append(lambda wide=wide: page.block(wide))
            todo += reversed(node.children)
        elif tag in ("td", "th"):
            page.space = True
            todo.append(lambda: setattr(page, "space", True))
            todo += reversed(node.children)
        else:
            todo += reversed(node.children)
    return page.text()


def _texts(node: Node):
    """Visible strings below a node, white space as it is."""
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif x.tag == "br":
            yield "\n"
        elif not hidden(x):
            todo += reversed(x.children)


def _table(table: Node, depth: int) -> list[str]:
    """A table's lines: its captions, then rows whose cells are padded to their column's width; what stands between cells comes first."""
    before, rows, seen = [], [], []
    todo = list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                before.append(_SPACE.sub(" ", x).strip())
        elif hidden(x):
            continue
        elif x.tag == "tr":
            cells, stray = [], []
            for c in x.children:
                if isinstance(c, Node) and c.tag in ("td", "th"):
                    if not hidden(c):
                        span = c.attributes.get("colspan", "1")
                        cells.append((render(_inside(c), depth).split("\n"), int(span) if re.fullmatch(r"[1-9]\d?", span) else 1))
                else:
                    stray.append(c)
            if other := render(_inside(x, stray), depth):
                before += other.split("\n")
            if cells:
                rows.append(cells)
        elif x.tag in ("tbody", "thead", "tfoot"):
            todo += reversed(x.children)
        elif shown := render(_inside(x), depth):
            before += shown.split("\n")
    widths: dict[int, int] = {}
    for cells in rows:
        at = 0
        for lines, span in cells:
            if span == 1:
                widths[at] = max(widths.get(at, 0), *map(columns_of, lines))
            at += span
    if sum(widths.values()) * len(rows) > MOST_PADDING:
        widths = {at: min(WIDEST, n) for at, n in widths.items()}
    for cells in rows:
        for k in range(max(len(lines) for lines, _ in cells)):
            out, at = [], 0
            for lines, span in cells:
                line = lines[k] if k < len(lines) else ""
                wide = sum(widths.get(at + j, 0) for j in range(span)) + 3 * (span - 1)
                out.append(line + " " * max(0, wide - columns_of(line)))
                at += span
            seen.append(" | ".join(out).rstrip())
    return before + seen


def _inside(node: Node, children: list | None = None) -> Node:
    root = Node("#root")
    root.children = node.children if children is None else children
    return root


def visible_text(source: str) -> str:
    return render(parse(source)) if source else ""


def extract(pages: DataFrame, id_column: str = "page_id", column: str = "html") -> DataFrame:
    """page_id, text: every page's visible text; no shuffle."""

    def run(batches):
        for b in slices(batches, column):
            texts = [visible_text(t.decode("utf-8", "replace")) for t in blobs(b.column(column))]
            yield pa.RecordBatch.from_arrays([b.column(id_column).cast(pa.int64()), pa.array(texts, pa.string())], [id_column, "text"])

    return map_batches(pages.select(id_column, column), run, f"{id_column} long, text string")
