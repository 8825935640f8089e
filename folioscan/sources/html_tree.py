"""A page as a tree of elements: end tags that may be left out are implied, void elements have none, stray ones are ignored."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements that end when one of these begins, and the elements beyond which that does not reach.
IMPLIED = {"p": (_BLOCKS, set()), "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "tbody", "tfoot"}, {"table"}), "td": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}), "th": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}), "option": ({"option", "optgroup"}, {"select"})}
#: Open elements beyond which no start tag ends anything, but the ones that it ends themselves.
_FENCES = (_BLOCKS - {"p"}) | {"li", "td", "th", "tr", "select", "table"}
_NONE = (frozenset(), frozenset())
#: Elements around which text breaks into lines.
LINES = {"p", "div", "br", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main"}
MOST_DEPTH = 512


class Node:
    """An element: tag, attributes, classes, and in order its texts and elements; closed tells whether its own end tag was there."""

    __slots__ = ("tag", "attrs", "classes", "children", "closed")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children, self.closed = tag, attrs, [], False
        self.classes = set((attrs.get("class") or "").split())

    def walk(self):
        """The element and all elements in it, in page order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, tag: str | None = None, cls: str | None = None) -> list[Node]:
        return [n for n in self.walk() if n is not self and (tag is None or n.tag == tag) and (cls is None or cls in n.classes)]

    def first(self, tag: str | None = None, cls: str | None = None) -> Node | None:
        return next((n for n in self.walk() if n is not self and (tag is None or n.tag == tag) and (cls is None or cls in n.classes)), None)

    def text(self) -> str:
        """All text in it, each piece without white space around it, joined by spaces."""
        out, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(" ".join(c.split()))
            else:
                todo += reversed(c.children)
        return " ".join(x for x in out if x)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        top = len(self.stack) - 1
        while top:  # the innermost element that this tag ends, and what is open in it
            at = self.stack[top].tag
            enders, fence = IMPLIED.get(at, _NONE)
            if tag in enders:
                del self.stack[top:]
                top -= 1
                continue
            if at in _FENCES or tag in fence:
                break
            top -= 1
        node = Node(tag, {k: v for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID and len(self.stack) < MOST_DEPTH:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "use") and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.stack[k].closed = True
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def main_text(html: str | None, skipped: set[str]) -> str:
    """Text in lines, without skipped elements; cells of a row are joined by " | ". A skipped element that is never closed counts as any other."""
    out, todo = [], [tree(html)]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag in skipped and c.closed:
            continue
        elif c.tag not in ("script", "style"):
            edge = "\n" if c.tag in LINES else ""
            out.append(" | " if c.tag in ("td", "th") else edge)
            todo += [edge, *reversed(c.children)]
    lines = (" ".join(x.split()).strip("| ").strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)
