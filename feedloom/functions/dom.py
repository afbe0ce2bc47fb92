"""A small document tree over the standard HTML parser, with selectors and serialisation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
_P_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def add(self, child) -> None:
        if isinstance(child, Element):
            child.parent = self
        self.children.append(child)

    def elements(self) -> Iterator[Element]:
        """All elements below, in document order. Like all walks here it keeps its own stack, as markup nests to any depth."""
        open_ = [iter(list(self.children))]
        while open_:
            for c in open_[-1]:
                if isinstance(c, Element):
                    yield c
                    open_.append(iter(list(c.children)))
                    break
            else:
                open_.pop()

    def text(self) -> str:
        parts, open_ = [], [iter(self.children)]
        while open_:
            for c in open_[-1]:
                if isinstance(c, Element):
                    open_.append(iter(c.children))
                    break
                parts.append(c)
            else:
                open_.pop()
        return "".join(parts)

    def remove(self) -> None:
        if self.parent is not None and self in self.parent.children:
            self.parent.children.remove(self)

    def replace(self, *new) -> None:
        at = self.parent.children.index(self)
        for n in new:
            if isinstance(n, Element):
                n.parent = self.parent
        self.parent.children[at : at + 1] = new

    def up(self) -> Iterator[Element]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def siblings(self) -> list[Element]:
        return [c for c in self.parent.children if isinstance(c, Element)] if self.parent is not None else [self]

    def matches(self, selector: str) -> bool:
        return any(_matches(self, parts) for parts in selectors(selector))

    def find(self, selector: str) -> list[Element]:
        chosen = selectors(selector)
        return [e for e in self.elements() if any(_matches(e, parts) for parts in chosen)]

    def inner(self) -> str:
        parts, open_ = [], [(self, iter(self.children))]
        while open_:
            node, rest = open_[-1]
            for c in rest:
                if not isinstance(c, Element):
                    parts.append(c if node.tag in RAW else escape(c, quote=False))
                elif c.tag in VOID:
                    parts.append(c.start()[:-1] + "/>")
                else:
                    parts.append(c.start())
                    open_.append((c, iter(c.children)))
                    break
            else:
                open_.pop()
                if open_:
                    parts.append(f"</{node.tag}>")
        return "".join(parts)

    def start(self) -> str:
        return f"<{self.tag}{''.join(f' {k}="{escape(v or "")}"' for k, v in self.attrs.items())}>"

    def outer(self) -> str:
        return self.start()[:-1] + "/>" if self.tag in VOID else f"{self.start()}{self.inner()}</{self.tag}>"


_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]]*?))\s*)?\]|:([\w-]+)(?:\(((?:[^()]|\([^()]*\))*)\))?""")
_ONE = r"""(?:\[(?:"[^"]*"|'[^']*'|[^\]"'])*\]|\((?:[^()]|\([^()]*\))*\)|[^\s,>+~\[\]()])+"""
_TOKEN = re.compile(rf"({_ONE})|(\s*[>+~,]\s*|\s+)")


@lru_cache(maxsize=512)
def selectors(text: str) -> tuple[tuple[str, ...], ...]:
    """The alternatives of a selector, each as compounds with the combinators between them."""
    out: list[list[str]] = [[]]
    for one, between in _TOKEN.findall(text.strip()):
        if one:
            out[-1].append(one)
        elif between.strip() == ",":
            out.append([])
        else:
            out[-1].append(between.strip() or " ")
    return tuple(tuple(x) for x in out if x and x[-1] not in " >+~")


def _pseudo(e: Element, name: str, argument: str) -> bool:
    """The pseudo-classes that rules use; any other never holds."""
    if name == "not":
        return not e.matches(argument)
    if name == "has":
        return bool(e.find(argument))
    around = e.siblings()
    if name in ("first-child", "last-child", "only-child"):
        return (name == "last-child" or around[0] is e) and (name == "first-child" or around[-1] is e)
    return name == "nth-child" and argument.isdigit() and 0 < int(argument) <= len(around) and around[int(argument) - 1] is e


def _one(e: Element, simple: str) -> bool:
    for tag, cls, ident, attr, op, *values, pseudo, argument in _SIMPLE.findall(simple):
        have, value = e.attrs.get(attr), "".join(values)
        if tag and tag != "*" and e.tag != tag.lower() or cls and cls not in (e.attrs.get("class") or "").split() or ident and e.attrs.get("id") != ident:
            return False
        if attr and (have is None or op == "=" and have != value or op == "*=" and value not in have or op == "^=" and not have.startswith(value) or op == "$=" and not have.endswith(value) or op == "~=" and value not in have.split()):
            return False
        if pseudo and not _pseudo(e, pseudo, argument):
            return False
    return True


def _matches(e: Element, parts: tuple[str, ...]) -> bool:
    if not e.tag or not _one(e, parts[-1]):
        return False
    if len(parts) < 3:
        return True
    how, rest = parts[-2], parts[:-2]
    if how in "+~":
        before = []
        for x in e.siblings():
            if x is e:
                break
            before.append(x)
        return any(_matches(x, rest) for x in (before[-1:] if how == "+" else before))
    return any(_matches(a, rest) for a in (list(e.up())[:1] if how == ">" else e.up()))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Element("")
        self.open: Counter = Counter()

    def handle_starttag(self, tag, attrs):
        if tag in _P_ENDS and self.top.tag == "p" or tag == "li" and self.top.tag == "li":
            self._close()
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.top.add(e)
        if tag not in VOID:
            self.top = e
            self.open[tag] += 1

    def _close(self):
        self.open[self.top.tag] -= 1
        self.top = self.top.parent

    def handle_startendtag(self, tag, attrs):
        self.top.add(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        while self.top.tag != tag:
            self._close()
        self._close()

    def handle_data(self, data):
        self.top.add(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
