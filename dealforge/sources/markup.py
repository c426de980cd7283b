"""HTML read as elements, not as text: nesting, attribute order and unclosed tags do not matter.

The parser is the standard library's. It runs on Arrow batches, a page at a time, since Spark has no reader of HTML; all that
follows is in columns. Selectors are those that shops' pages need: tag, .class, [name], [name="v"], [name*="v"], one
after another for "inside", a comma for "or".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_STEP = re.compile(r'([a-zA-Z][\w-]*|\*)?((?:\.[\w-]+|\[[\w-]+(?:\*?="[^"]*")?\])*)')
_PART = re.compile(r'\.([\w-]+)|\[([\w-]+)(?:(\*?=)"([^"]*)")?\]')


class Element:
    """A tag with its attributes, the one that holds it, and what it holds: elements and texts, in order."""

    __slots__ = ("tag", "attrs", "parent", "held")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent, self.held = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        """All elements inside, in the page's order; without recursion, as pages may nest deeply."""
        waiting = [x for x in reversed(self.held) if isinstance(x, Element)]
        while waiting:
            one = waiting.pop()
            yield one
            waiting += [x for x in reversed(one.held) if isinstance(x, Element)]

    def text(self) -> str:
        """All text inside, with one space for white space."""
        out, waiting = [], list(reversed(self.held))
        while waiting:
            one = waiting.pop()
            if isinstance(one, str):
                out.append(one)
            elif one.tag not in ("script", "style"):
                waiting += reversed(one.held)
        return " ".join("".join(out).split())

    def find(self, selector: str) -> list[Element]:
        ways = _selector(selector)
        return [e for e in self.walk() if any(_fits(e, way, self) for way in ways)]

    def first(self, selector: str) -> Element | None:
        ways = _selector(selector)
        return next((e for e in self.walk() if any(_fits(e, way, self) for way in ways)), None)


@lru_cache(512)
def _selector(selector: str) -> tuple:
    ways = []
    for way in re.split(r",(?![^\[]*\])", selector):
        steps = []
        for step in re.split(r"\s+(?![^\[]*\])", way.strip()):
            found = _STEP.fullmatch(step)
            if not found:
                raise ValueError(f"a selector that is not understood: {step}")
            steps.append((found[1] if found[1] != "*" else None, tuple(_PART.findall(found[2]))))
        ways.append(tuple(steps))
    return tuple(ways)


def _is(e: Element, step: tuple) -> bool:
    tag, parts = step
    if tag and e.tag != tag.lower():
        return False
    for name, attr, how, value in parts:
        if name:
            if name not in e.attrs.get("class", "").split():
                return False
        elif attr not in e.attrs or how == "=" and e.attrs[attr] != value or how == "*=" and value not in e.attrs[attr]:
            return False
    return True


def _fits(e: Element, way: tuple, top: Element) -> bool:
    if not _is(e, way[-1]):
        return False
    above = e.parent
    for step in reversed(way[:-1]):
        while above is not None and above is not top and not _is(above, step):
            above = above.parent
        if above is None or above is top:
            return False
        above = above.parent
    return True


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)  # of an attribute given twice the first counts
        self.at.held.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.held.append(Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at))

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:  # an end without a start is left out
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.held.append(data)


def parse(html: str | None) -> Element:
    """The page's top, which has no tag. Any text is some page; a null one is empty."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.top
