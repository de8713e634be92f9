"""A small document tree over the standard library's HTML tokenizer.

The tree keeps the author's nesting: a new ``<p>`` does not close an open one, end tags
without an open element are dropped, elements left open close with their parent, void
elements hold nothing, and scripts and styles stay raw text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())


class Node:
    """An element; ``children`` holds nodes and strings."""

    __slots__ = ("name", "attrs", "children", "parent", "order", "_found")

    def __init__(self, name: str, attrs: dict[str, str], parent: "Node | None") -> None:
        self.name, self.attrs, self.children, self.parent = name, attrs, [], parent
        #: All elements of the page in document order, at its root alone.
        self.order: list[Node] | None = None
        self._found: dict[tuple[int, str], list[Node]] | None = None

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def found(self) -> dict[tuple[int, str], list["Node"]]:
        """At a page's root: its elements by id (0), class (1) and name (2), in document order."""
        if self._found is None:
            self._found = {}
            for n in self.order or ():
                self._found.setdefault((2, n.name), []).append(n)
                if own := n.attrs.get("id"):
                    self._found.setdefault((0, own), []).append(n)
                for c in dict.fromkeys(n.classes):
                    self._found.setdefault((1, c), []).append(n)
        return self._found

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator["Node"]:
        """Elements below this one in document order, without recursion: pages may nest deeply."""
        if self.order is not None:
            yield from self.order
            return
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def strings(self) -> Iterator[str]:
        stack: list = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    stack.append(iter(child.children))
                    break
                yield child
            else:
                stack.pop()

    def text(self, joiner: str = "") -> str:
        """The text pieces, each stripped, joined with nothing between them."""
        return joiner.join(s for piece in self.strings() if (s := piece.strip()))

    def up(self) -> Iterator["Node"]:
        """This element and those around it."""
        node: Node | None = self
        while node is not None and node.name:
            yield node
            node = node.parent

    def elements(self) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node)]


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.root.order = []
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1])
        self.open[-1].children.append(node)
        self.root.order.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; an empty tree for nothing."""
    builder = _Builder()
    if html:
        builder.feed(html)
        builder.close()
    return builder.root
