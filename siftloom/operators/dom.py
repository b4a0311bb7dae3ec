"""A small document tree on the standard library's HTML tokenizer.

Void elements, raw text and the end tags that HTML implies are handled; that is
what text, links and headings of real pages need.  It isn't a full HTML5 tree
builder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: An opening tag closes these open elements, up to the nearest of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}
_HEAD = {"title", "meta", "link", "base", "style", "script"}


class Node:
    """An element (``tag``) or a text (``tag`` None)."""

    __slots__ = ("attrs", "children", "data", "parent", "tag")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, data: str = ""):
        self.tag, self.attrs, self.data = tag, attrs or {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if n.tag is not None:
                yield n
                stack.extend(reversed(n.children))

    def find(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.tag is None:
                out.append(n.data)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def copy(self) -> Node:
        top = Node(self.tag, dict(self.attrs), self.data)
        stack = [(self, top)]
        while stack:
            old, new = stack.pop()
            for c in old.children:
                stack.append((c, new.add(Node(c.tag, dict(c.attrs), c.data))))
        return top


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.html = self.root.add(Node("html"))
        self.head, self.body = self.html.add(Node("head")), self.html.add(Node("body"))
        self.open = [self.body]
        self.in_body = False

    def _close(self, tags: set[str], until: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in until:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in a.items():
                node.attrs.setdefault(k, v)
            self.in_body = self.in_body or tag == "body"
            return
        if not self.in_body and tag not in _HEAD and tag not in ("noscript", "template"):
            self.in_body = True
        if tag in _BLOCKS:
            self._close({"p"}, {"button", "td", "th", "table"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if not self.in_body and len(self.open) == 1:
            parent = self.head
        else:
            parent = self.open[-1]
        node = parent.add(Node(tag, a))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            pass  # a slash closes void elements only

    def handle_endtag(self, tag):
        if tag == "head":
            self.in_body = True
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if len(self.open) == 1 and not self.in_body:
            if not data.strip():
                return
            self.in_body = True
        parent = self.open[-1]
        if parent.children and parent.children[-1].tag is None:
            parent.children[-1].data += data
        else:
            parent.add(Node(None, data=data))


class Document:
    """A parsed page with its ``html``, ``head`` and ``body``."""

    def __init__(self, html: str):
        b = _Builder()
        b.feed(html)
        b.close()
        self.root, self.html, self.head, self.body = b.root, b.html, b.head, b.body


def parse(html: str) -> Document:
    return Document(html)
