"""All visible text of an HTML page, laid out: tree builder with implied tags, visibility rules, text renderer.

The parser builds a tree the way browsers repair markup: void elements, implied
end tags (p, li, dt/dd, options, table parts), end tags that close what they
left open, raw text in script, style and textarea, character references.  An
element is invisible by its kind (head, script, template, ...), by ``hidden``,
by an inline style or by a simple rule (tag, .class, #id or tag.class) of the
page's own style sheets with display:none or visibility:hidden.

Rendering collapses white space outside ``pre``, starts block elements on a new
line, sets paragraphs, headings, lists and tables apart by a blank line, marks
list items (numbers in ordered lists), indents nested lists and quotes, and
pads table cells to the width of their columns, with column spans (at most
1000, as the HTML standard has it) and row spans.  Empty and null pages have an
empty text; time and memory grow with the length of a page.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas datalist param source track area map desc metadata defs symbol clippath mask annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu fieldset".split())
BLOCK = SPACED | frozenset("html body div article section header footer main nav aside address li dt dd tr form details summary figcaption caption center legend dialog hgroup search option optgroup thead tbody tfoot td th".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
INDENTS = 40  # levels of lists and quotes that indent; deeper ones stay at that margin
DEEPEST = 150  # tables inside tables; further ones keep their text, as plain blocks
BARRIER = frozenset("table td th caption html template button".split())
_TAG = re.compile(r"<(?:!--(?P<comment>)|(?P<name>/?[a-zA-Z][^\s/>]*)|(?P<other>[!?/]))")
_ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_MEDIA, _BRACE = re.compile(r"@media\b([^{};]*)\{", re.I), re.compile(r"[{}]")
_NONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_WS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag, attrs=None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def _attributes(html, i):
    """(attributes, position after the tag's '>')."""
    attrs, n = {}, len(html)
    while i < n:
        if html[i] == ">":
            return attrs, i + 1
        m = _ATTR.match(html, i)
        if m is None or m.end() == i:
            i += 1
            continue
        name = m[1].lower()
        if name not in attrs:
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            attrs[name] = unescape(value) if "&" in value else value
        i = m.end()
    return attrs, n


def parse(html: str) -> Node:
    root = Node("html")
    stack = [root]
    at = {}  # places in the stack of the open elements of each tag, so that no end tag searches a deep stack
    i, n = 0, len(html)

    def push(node):
        at.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(k):
        for node in stack[k:]:
            at[node.tag].pop()
        del stack[k:]

    def text(s):
        if s:
            stack[-1].kids.append(unescape(s) if "&" in s else s)

    def close(tags, stop):
        k = max((at[t][-1] for t in tags if at.get(t)), default=0)
        if k and k >= max((at[t][-1] for t in stop if at.get(t)), default=0):
            cut(k)
            return True
        return False

    while i < n:
        m = _TAG.search(html, i)
        if m is None:
            text(html[i:])
            break
        text(html[i : m.start()])
        if m["comment"] is not None:
            end = html.find("-->", m.end() - 2 if html.startswith("<!-->", m.start()) else m.end())
            i = n if end < 0 else end + 3
            continue
        if m["other"] is not None:
            end = html.find(">", m.end())
            i = n if end < 0 else end + 1
            continue
        name = m["name"].lower()
        attrs, i = _attributes(html, m.end())
        if name[0] == "/":
            name = name[1:]
            if name in ("body", "html"):
                continue
            if name == "br":
                stack[-1].kids.append(Node("br"))
            elif name in VOID:
                pass
            elif name in ("table", "td", "th", "caption", "tr", "thead", "tbody", "tfoot"):
                close({name}, {"html"} if name == "table" else {"table"})
            elif name in ("li", "dt", "dd"):
                close({name}, BARRIER | {"ul", "ol", "dl", "menu"})
            elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, BARRIER)
            else:
                close({name}, BARRIER)
            continue
        if name in ("html", "body"):
            if name == "body":
                close({"head"}, ())
                root.kids.append(body := Node("body", attrs))
                if len(stack) == 1:
                    push(body)
            continue
        if name == "head" and len(stack) > 1:
            continue
        if name in IMPLIED:
            tags, stop = IMPLIED[name]
            while close(tags, stop):
                pass
            if name in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr")
                stack[-1].kids.append(row)
                push(row)
        if name in CLOSES_P:
            close({"p"}, BARRIER)
        if stack[-1].tag == "head" and name not in HIDDEN:
            cut(len(stack) - 1)  # content ends an open head
        if name in ("h1", "h2", "h3", "h4", "h5", "h6") and re.fullmatch("h[1-6]", stack[-1].tag):
            cut(len(stack) - 1)
        node = Node(name, attrs)
        stack[-1].kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, i)
            raw = html[i : end.start()] if end else html[i:]
            if raw:
                node.kids.append(unescape(raw) if name in ("textarea", "title") else raw)
            i = html.find(">", end.end()) + 1 or n if end else n
        elif name not in VOID:
            push(node)
    return root


def _screen_rules(css: str) -> str:
    """A style sheet without its comments and the blocks of @media rules that don't apply to a screen."""
    css, out, i = re.sub(r"/\*.*?\*/", "", css, flags=re.S), [], 0
    for m in _MEDIA.finditer(css):
        if m.start() < i:
            continue
        out.append(css[i : m.start()])
        depth, k = 1, m.end()
        while k < len(css) and depth:
            brace = _BRACE.search(css, k)
            if brace is None:
                k = len(css)
                break
            depth += 1 if brace[0] == "{" else -1
            k = brace.end()
        kinds = [q.split() for q in m[1].lower().split(",")]
        if any(not q or q[0] in ("screen", "all", "only") and "print" not in q or q[0][0] == "(" or q[:2] == ["not", "print"] for q in kinds):
            out.append(css[m.end() : k - 1])
        i = k
    out.append(css[i:])
    return "".join(out)


def _hidden_rules(root: Node):
    tags, classes, ids, pairs = set(), set(), set(), set()
    todo = [root]
    while todo:
        node = todo.pop()
        for kid in node.kids:
            if isinstance(kid, Node):
                if kid.tag == "style":
                    for selectors, body in _RULE.findall(_screen_rules("".join(k for k in kid.kids if isinstance(k, str)))):
                        if _NONE.search(body):
                            for s in selectors.split(","):
                                m = re.fullmatch(r"\s*([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?\s*", s)
                                if m and (m[1] or m[2]):
                                    tag = m[1] and m[1].lower()
                                    if not m[2]:
                                        tags.add(tag)
                                    elif tag:
                                        pairs.add((tag, m[2], m[3]))
                                    else:
                                        (classes if m[2] == "." else ids).add(m[3])
                else:
                    todo.append(kid)

    def hidden(node):
        a = node.attrs
        if node.tag in HIDDEN or node.tag in tags:
            return True
        if not a:
            return node.tag == "dialog"
        if "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in a:
            return True
        if "style" in a and _NONE.search(a["style"]):
            return True
        if classes or pairs or ids:
            own = a.get("class", "").split()
            if classes.intersection(own) or a.get("id") in ids:
                return True
            return any((node.tag, ".", c) in pairs for c in own) or (node.tag, "#", a.get("id")) in pairs
        return False

    return hidden


class _Lines:
    """Collects laid-out lines; ``gap`` is the number of line breaks that wait for the next text."""

    def __init__(self):
        self.lines, self.now, self.gap, self.space, self.indent, self.mark = [], None, 0, False, [], None

    def want(self, breaks):
        self.space = False
        self.gap = max(self.gap, breaks)

    def _open(self):
        if self.gap or self.now is None:
            if self.now is not None:
                self.lines.append(self.now)
                self.lines.extend([""] * (self.gap - 1))
            self.now, self.gap = "", 0
            pad = "".join(self.indent[:INDENTS])
            if self.mark is not None:
                depth, mark = self.mark
                self.mark = None
                pad = "".join(self.indent[: min(depth, INDENTS)]) + mark
            self.now = pad
            return True
        return False

    def words(self, s):
        s = _WS.sub(" ", s)
        if s == " " or not s:
            self.space = self.space or bool(s)
            return
        fresh = self._open()
        if (self.space or s[0] == " ") and not fresh and not self.now.endswith(" "):
            self.now += " "
        self.now += s.strip(" ")
        self.space = s[-1] == " "

    def exact(self, s):
        for k, line in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.gap += 1
                if self.now is None:
                    self.gap = 0
            if line:
                self._open()
                self.now += line
        self.space = False

    def text(self):
        out = [*self.lines, *([self.now] if self.now is not None else [])]
        return "\n".join(line.rstrip() for line in out)


def _number(value, default):
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(m[1]) if m else default


def _table(node, hidden, depth):
    """Lines of a table with its columns padded."""
    rows, caption = [], []
    todo = list(reversed(node.kids))
    loose = Node("td")
    while todo:
        kid = todo.pop()
        if isinstance(kid, str):
            if kid.strip():
                loose.kids.append(kid)
        elif hidden(kid):
            continue
        elif kid.tag in ("thead", "tbody", "tfoot"):
            todo.extend(reversed(kid.kids))
        elif kid.tag == "caption":
            caption.append(_render(kid.kids, hidden, depth + 1))
        elif kid.tag == "tr":
            rows.append([c for c in kid.kids if isinstance(c, Node) and c.tag in ("td", "th") and not hidden(c)])
            loose.kids.extend(c for c in kid.kids if not (isinstance(c, Node) and c.tag in ("td", "th")) and not (isinstance(c, str) and not c.strip()))
        else:
            loose.kids.append(kid)
    taken, grid = {}, []
    for r, row in enumerate(rows):
        line, col = [], 0
        for cell in row:
            while taken.get(col, 0) > r:
                col += 1
            across = min(max(1, _number(cell.attrs.get("colspan"), 1)), 1000)
            down = min(max(1, _number(cell.attrs.get("rowspan"), 1)), len(rows) - r)
            line.append((col, across, _render(cell.kids, hidden, depth + 1).split("\n")))
            for c in range(col, col + across):
                taken[c] = r + down
            col += across
        grid.append(line)
    width = {}
    for line in grid:
        for col, across, texts in line:
            if across == 1:
                width[col] = max(width.get(col, 0), *map(len, texts))
    for line in grid:
        for col, across, texts in line:
            if across > 1:
                lack = max(map(len, texts)) - sum(width.get(c, 0) + 2 for c in range(col, col + across)) + 2
                if lack > 0:
                    width[col + across - 1] = width.get(col + across - 1, 0) + lack
    starts, x = {}, 0
    for c in range(max(width, default=-1) + 1):
        starts[c] = x
        x += width.get(c, 0) + 2 * (c in width)
    out = [*caption]
    before = _render(loose.kids, hidden, depth + 1) if loose.kids else ""
    if before:
        out.append(before)
    for line in grid:
        for k in range(max((len(t) for _, _, t in line), default=0)):
            s = ""
            for col, _, texts in line:
                if k < len(texts) and texts[k]:
                    s = s.ljust(starts.get(col, 0)) + texts[k]
            out.append(s)
    return out


def _render(kids, hidden, depth=0) -> str:
    out = _Lines()
    # work list: nodes and texts still to lay out, and callables that end an element
    todo = list(reversed(kids))
    pre = [0]
    lists = []
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.exact(item) if pre[0] else out.words(item)
            continue
        if callable(item):
            item()
            continue
        tag = item.tag
        if hidden(item):
            continue
        if tag == "br":
            out.space = False
            if out.now is not None:
                out.gap += 1
            continue
        if tag == "wbr":
            continue
        if tag == "input":
            if item.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
                out.words(item.attrs.get("value", ""))
            continue
        breaks = 2 if tag in SPACED else 1 if tag in BLOCK else 0
        if tag in ("ul", "ol", "menu") and lists:
            breaks = 1
        if breaks:
            out.want(breaks)
        if tag == "hr":
            continue
        if tag == "table" and depth < DEEPEST:
            for line in _table(item, hidden, depth):
                for part in line.split("\n"):
                    out.want(1)
                    if part:
                        out._open()
                        out.now += part
            out.want(2)
            continue
        ends = []
        if tag in ("ul", "ol", "menu"):
            lists.append([tag, _number(item.attrs.get("start"), 1)])
            ends.append(lists.pop)
        elif tag == "li":
            if lists and lists[-1][0] == "ol":
                number = _number(item.attrs.get("value"), lists[-1][1])
                lists[-1][1] = number + 1
                mark = f"{number}. "
            else:
                mark = "- "
            out.mark = (len(out.indent), mark)
            out.indent.append(" " * len(mark))
            ends.append(out.indent.pop)
        elif tag in ("blockquote", "dd"):
            out.indent.append("  ")
            ends.append(out.indent.pop)
        elif tag in ("pre", "textarea", "xmp"):
            pre[0] += 1

            def leave():
                pre[0] -= 1

            ends.append(leave)
            if item.kids and isinstance(item.kids[0], str) and item.kids[0].startswith("\n"):
                item.kids[0] = item.kids[0][1:]
        elif tag in ("td", "th"):
            ends.append(lambda: out.words(" "))
        if breaks:
            ends.append(lambda b=breaks: out.want(b))
        todo.extend(reversed(ends))
        todo.extend(reversed(item.kids))
    return out.text()


def page_text(html: str | None) -> str:
    """The laid-out visible text; empty for null or empty pages."""
    if not html:
        return ""
    root = parse(html.replace("\x00", ""))
    return _render(root.kids, _hidden_rules(root))


def _extract():
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [page_text(h.as_py()) for h in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names=["page_id", "text", "n_lines"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_lines) of every page; other columns are not read."""
    small_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(_extract(), "page_id long, text string, n_lines long").withColumnRenamed("page_id", id_col)
