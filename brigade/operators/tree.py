"""A page's tree of elements, built as the HTML standard says: implied ends and table parts, content
moved out of tables, and formatting that crosses blocks."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

MAX_DEPTH = 2000
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {f"h{i}" for i in range(1, 7)}
#: A paragraph ends where one of these begins.
BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr listing main menu nav ol p pre search section summary table ul".split()) | HEADINGS
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
#: Elements that end tags don't look beyond, and those that end the search for an open list item.
SCOPE = set("applet caption html table td th marquee object template".split()) | {""}
SPECIAL = BLOCKS | VOID | SCOPE | set("body button colgroup dd dt frame frameset head iframe li noembed noframes noscript plaintext script select style tbody textarea tfoot thead title tr xmp".split())
IMPLIED = set("dd dt li optgroup option p rb rp rt rtc".split())
SECTIONS = {"tbody", "thead", "tfoot"}
IN_TABLE = SECTIONS | {"table", "tr"}
#: Elements whose content isn't markup.
RAW = set("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
#: Tags as most are written: names, values in double quotes and without entities.
_START = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9-]*(?:="[^"&]*")?)*)[ \t\n\r\f]*>')
_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
_ATTR = re.compile(r'([a-zA-Z][a-zA-Z0-9-]*)(?:="([^"]*)")?')
#: Plain tags met lately, read: their attributes are never changed.
_known: dict[str, tuple[str, dict[str, str]]] = {}
_known_ends: dict[str, str] = {}
#: Elements that are left to the parser; it reads titles as others where it has no content of their kind.
_UNREAD = RAW if hasattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS") else RAW - {"title"}
MARKERS = set("applet caption marquee object td th".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], None

    def below(self):
        todo = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while todo:
            n = todo.pop()
            yield n
            if n.kids:
                todo += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def text(self) -> str:
        if len(self.kids) == 1 and isinstance(self.kids[0], str):
            return self.kids[0]
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo += reversed(n.kids)
        return "".join(out)


class Tree(HTMLParser):
    """``Tree(page).root`` is the parent of all; what the page leaves open ends with it."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.stack = [self.root]
        self.active: list[Node | None] = []  # open formatting; None marks a cell's or an object's begin
        self.once: set[str] = set()
        self.rawdata = page
        self.rawdata = page[self._plainly(page) :]
        self.goahead(0)
        self.close()

    # where things go

    def _put(self, kid, outside: bool | None = None) -> None:
        """Append to the current element, or before the table that can't hold it."""
        at = self.stack[-1]
        if (at.tag in IN_TABLE) if outside is None else outside:
            table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                at = table.parent
                i = next(i for i, k in enumerate(at.kids) if k is table)
                at.kids.insert(i, kid)
                if isinstance(kid, Node):
                    kid.parent = at
                return
        at.kids.append(kid)
        if isinstance(kid, Node):
            kid.parent = at

    def _open(self, tag: str, attrs: dict, outside: bool | None = None) -> Node:
        node = Node(tag, attrs)
        self._put(node, outside)
        if tag not in VOID and len(self.stack) < MAX_DEPTH:
            self.stack.append(node)
            if tag in MARKERS:
                self.active.append(None)
        return node

    def _find(self, tags, extra=(), scope=SCOPE) -> int:
        """Place in the stack of the nearest open element of ``tags`` in scope; 0 if there's none."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                return i
            if tag in scope or tag in extra:
                return 0
        return 0

    def _pop(self, to: int) -> None:
        for n in self.stack[to:]:
            if n.tag in MARKERS:
                while self.active and self.active.pop() is not None:
                    pass
        del self.stack[to:]

    def _end_paragraph(self) -> None:
        if i := self._find({"p"}, {"button"}):
            self._pop(i)

    def _clear(self, tags) -> None:
        """Back to the nearest of ``tags``."""
        while len(self.stack) > 1 and self.stack[-1].tag not in tags:
            self._pop(len(self.stack) - 1)

    def _rebuild(self) -> None:
        """Open formatting again that a block's end has closed."""
        i = len(self.active)
        while i and self.active[i - 1] is not None and not any(n is self.active[i - 1] for n in self.stack):
            i -= 1
        for j in range(i, len(self.active)):
            self.active[j] = self._open(self.active[j].tag, dict(self.active[j].attrs))

    # plain tags are read by one pattern, all others by the parser

    def _plainly(self, page: str) -> int:
        """Read tags and texts as far as the parser's loop isn't needed; returns where it is."""
        i = 0
        while True:
            if self.cdata_elem is not None:
                m = self.interesting.search(page, i) if self.cdata_elem in ("script", "style") else None
                if m is None:
                    return i
                if m.start() > i:
                    self.handle_data(page[i : m.start()])
                i = m.start()
                k = self.parse_endtag(i)
            else:
                j = page.find("<", i)
                if j < 0:
                    return i
                if j > i:
                    text = page[i:j]
                    self.handle_data(unescape(text) if "&" in text else text)
                    i = j
                # a tag met before, as a whole: no other reading of it goes beyond its first >
                k = page.find(">", i) + 1
                if k:
                    tag = page[i:k]
                    if known := _known.get(tag):
                        self.lasttag = known[0]
                        self._start(*known)
                        i = k
                        continue
                    if known := _known_ends.get(tag):
                        self.handle_endtag(known)
                        i = k
                        continue
                after = page[i + 1 : i + 2]
                if after == "/":
                    k = self.parse_endtag(i)
                elif after.isascii() and after.isalpha():
                    k = self.parse_starttag(i)
                else:
                    return i
            if k < 0:
                return i
            i = k

    def parse_starttag(self, i):
        m = _START.match(self.rawdata, i)
        known = m and _known.get(m[0])
        if not known:
            if not m or (tag := m[1].lower()) in _UNREAD:
                return super().parse_starttag(i)
            known = tag, self._first((a[1].lower(), a[2]) for a in _ATTR.finditer(m[2]))
            if len(m[0]) <= 100:
                if len(_known) >= 10_000:
                    _known.clear()
                _known[m[0]] = known
        self.lasttag = known[0]
        self._start(*known)
        return m.end()

    def parse_endtag(self, i):
        m = _END.match(self.rawdata, i)
        if not m or self.cdata_elem is not None or (tag := m[1].lower()) in _UNREAD:
            return super().parse_endtag(i)
        if len(tag) <= 20 and len(_known_ends) < 1000:
            _known_ends[m[0]] = tag
        self.handle_endtag(tag)
        return m.end()

    # what a page says

    def handle_data(self, data):
        at = self.stack[-1]
        if (self.active or at.tag in IN_TABLE) and data.strip("\t\n\f\r "):
            if self.active:
                self._rebuild()
            self._put(data)
        else:
            at.kids.append(data)

    @staticmethod
    def _first(attrs) -> dict[str, str]:
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        return first

    def handle_starttag(self, tag, attrs):
        self._start(tag, self._first(attrs))

    def _start(self, tag, first):
        if tag in ("html", "head", "body"):
            if tag not in self.once:
                self.once.add(tag)
                if tag == "body" and (i := self._find({"head"})):
                    self._pop(i)
                self._open(tag, first)
        elif tag in IN_TABLE or tag in ("td", "th", "caption", "colgroup", "col"):
            self._table_part(tag, first)
        elif tag in FORMATTING:
            if tag == "a" and any(n is not None and n.tag == "a" for n in self._since_marker()):
                self._end_formatting("a")
            self._rebuild()
            self.active.append(self._open(tag, first))
        else:
            self._element(tag, first)

    def _element(self, tag, attrs):
        if tag in ("li", "dd", "dt"):
            same = {"li"} if tag == "li" else {"dd", "dt"}
            for i in range(len(self.stack) - 1, 0, -1):
                open_ = self.stack[i].tag
                if open_ in same:
                    self._pop(i)
                    break
                if open_ in SPECIAL and open_ not in ("address", "div", "p"):
                    break
            self._end_paragraph()
        elif tag in BLOCKS:
            if tag == "form" and self._find({"form"}, scope={"template"}):
                return
            self._end_paragraph()
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self._pop(len(self.stack) - 1)
        elif tag == "button" and (i := self._find({"button"})):
            self._pop(i)
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self._pop(len(self.stack) - 1)
            if tag == "optgroup" and self.stack[-1].tag == "optgroup":
                self._pop(len(self.stack) - 1)
        hidden = tag in ("script", "style", "template") or tag == "input" and attrs.get("type", "").lower() == "hidden"
        if self.active and tag not in BLOCKS and tag not in ("li", "dd", "dt") and not hidden:
            self._rebuild()
        self._open(tag, attrs, False if hidden else None)

    def _table_part(self, tag, attrs):
        if tag == "table":
            if self.stack[-1].tag in IN_TABLE:
                self._clear({"table"})
                self._pop(len(self.stack) - 1)
            self._end_paragraph()
            self._open(tag, attrs)
            return
        if not self._find({"table"}, scope={"html", "template"}):
            return  # parts of a table count within one only
        if tag in ("td", "th"):
            if i := self._find({"td", "th"}, scope={"html", "table", "template"}):
                self._pop(i)
            self._clear(IN_TABLE)
            if self.stack[-1].tag == "table":
                self._open("tbody", {}, False)
            if self.stack[-1].tag in SECTIONS:
                self._open("tr", {}, False)
        elif tag == "tr":
            self._clear(SECTIONS | {"table"})
            if self.stack[-1].tag == "table":
                self._open("tbody", {}, False)
        elif tag == "col":
            self._clear({"table", "colgroup"})
            if self.stack[-1].tag == "table":
                self._open("colgroup", {}, False)
        else:
            self._clear({"table"})
        self._open(tag, attrs, False)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "p":
            if i := self._find({"p"}, {"button"}):
                self._pop(i)
            else:
                self._put(Node("p", {}))
        elif tag in FORMATTING:
            self._end_formatting(tag)
        elif tag in HEADINGS:
            if i := self._find(HEADINGS):
                self._pop(i)
        elif tag in IN_TABLE or tag in ("td", "th", "caption"):
            if i := self._find({tag}, scope={"html", "template"} if tag == "table" else {"html", "table", "template"}):
                self._pop(i)
        elif tag == "li":
            if i := self._find({"li"}, {"ol", "ul"}):
                self._pop(i)
        elif tag in BLOCKS or tag in ("button", "dd", "dt"):
            if i := self._find({tag}):
                self._pop(i)
        else:
            self._end_other(tag)

    def _end_other(self, tag) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._pop(i)
                return
            if self.stack[i].tag in SPECIAL:
                return

    # formatting that ends while blocks within it are open

    def _since_marker(self) -> list[Node]:
        out: list[Node] = []
        for n in reversed(self.active):
            if n is None:
                break
            out.append(n)
        return out

    def _end_formatting(self, tag) -> None:
        for _ in range(8):
            node = next((n for n in self._since_marker() if n.tag == tag), None)
            if node is None:
                self._end_other(tag)
                return
            at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i] is node), 0)
            if not at:
                self._forget(node)
                return
            if self._find({tag}) < at:
                return  # a cell or an object stands between
            block = next((i for i in range(at + 1, len(self.stack)) if self.stack[i].tag in SPECIAL), 0)
            if not block:
                self._pop(at)
                self._forget(node)
                return
            self._move_out(node, at, block)

    def _forget(self, node) -> None:
        self.active = [n for n in self.active if n is not node]

    def _move_out(self, node: Node, at: int, block: int) -> None:
        """The first block within ``node`` leaves it; what the block holds gets a copy of the formatting."""
        above, inner = self.stack[at - 1], self.stack[block]
        last, mark = inner, next(i for i, n in enumerate(self.active) if n is node)
        for i in range(block - 1, at, -1):  # formatting between the two is copied as well, the rest stays behind
            n = self.stack[i]
            j = next((j for j, x in enumerate(self.active) if x is n), None)
            if j is None:
                del self.stack[i]
                block -= 1
                continue
            copy = Node(n.tag, dict(n.attrs))
            self.active[j] = self.stack[i] = copy
            if last is inner:
                mark = j + 1
            self._take(last)
            copy.kids.append(last)
            last.parent = copy
            last = copy
        self._take(last)
        if above.tag in IN_TABLE:
            self.stack.append(above)
            self._put(last)
            self.stack.pop()
        else:
            above.kids.append(last)
            last.parent = above
        copy = Node(node.tag, dict(node.attrs))
        copy.kids, inner.kids = inner.kids, [copy]
        for k in copy.kids:
            if isinstance(k, Node):
                k.parent = copy
        copy.parent = inner
        old = next(i for i, n in enumerate(self.active) if n is node)
        self.active.insert(mark, copy)
        del self.active[old if old < mark else old + 1]
        self.stack = [n for n in self.stack if n is not node]
        self.stack.insert(next(i for i, n in enumerate(self.stack) if n is inner) + 1, copy)

    def _take(self, node: Node) -> None:
        if node.parent is not None:
            node.parent.kids = [k for k in node.parent.kids if k is not node]
