"""Blocks of a page by a tree of nodes: the plain form that the engine's native splitter is held against."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from vellumine.sources.html import ABSTRACT, BLOCK, CITES, CITES_LOOSE, HIDDEN, INFO, PDF, TITLE, VOID


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str | None], up: _Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.classes = set((attrs.get("class") or "").split())
        self.children: list[_Node | str] = []

    def walk(self) -> Iterator[_Node]:
        """Elements below, in document order. A stack: pages nest as deep as they like."""
        stack = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, _Node)]

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(" ".join(("|" + x + "|").split())[1:-1])
            elif x.tag == "br":
                parts.append("\n")
            elif x.tag not in HIDDEN:
                stack += reversed(x.children)
        lines = [" ".join(line.split()) for line in "".join(parts).split("\n")]
        return "\n".join(line for line in lines if line)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(_Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _first(node: _Node, classes: str | None = None, link_in: bool = False, href: str | None = None) -> _Node | None:
    for x in node.walk():
        if classes is not None and classes in x.classes:
            if not link_in:
                return x
            if (found := next((y for y in x.walk() if y.tag == "a"), None)) is not None:
                return found
        if href is not None and x.tag == "a" and href in (x.attrs.get("href") or ""):
            return x
    return None


def parse_blocks(html: str | None) -> list[dict]:
    """Blocks of a page in document order; fields that a block lacks are null."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    out = []
    for block in (x for x in tree.root.walk() if set(BLOCK) <= x.classes):
        title, info, abstract = _first(block, TITLE, link_in=True), _first(block, INFO), _first(block, ABSTRACT)
        cite, loose, pdf = _first(block, href=CITES), _first(block, href=CITES_LOOSE), _first(block, PDF, link_in=True)
        out.append(
            {
                "pos": len(out) + 1,
                "title": title.text() if title else None,
                "url": title.attrs.get("href") if title else None,
                "info": info.text() if info else None,
                "abstract": abstract.text() if abstract else None,
                "cite_text": cite.text() if cite else None,
                "cite_text_loose": loose.text() if loose else None,
                "has_pdf_link": pdf is not None,
                "pdf_url": pdf.attrs.get("href") if pdf else None,
            }
        )
    return out
