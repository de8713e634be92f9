"""CSS selectors over the tree: types, classes, ids, attributes, combinators, lists and
``:first-child``, ``:last-child``, ``:nth-child()``, ``:not()``."""

from __future__ import annotations

import re
from functools import lru_cache

from mossgrid.html.dom import Node

_IDENT = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_PART = re.compile(
    rf"""\s*(?P<comb>[>+~,])\s*|(?P<space>\s+)|(?P<any>\*)|\#(?P<id>{_IDENT})|\.(?P<cls>{_IDENT})
    |\[\s*(?P<attr>{_IDENT})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]]+))\s*(?P<flag>[iI])?\s*)?\]
    |:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?|(?P<type>{_IDENT})""",
    re.VERBOSE,
)


class SelectorError(ValueError):
    """A selector outside the supported set."""


def _nth(arg: str):
    arg = arg.replace(" ", "").lower()
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not m or not arg:
        raise SelectorError(f":nth-child({arg})")
    a = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    return lambda i: i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0


def _attr_test(name: str, op: str | None, value: str, fold: bool):
    def test(node: Node) -> bool:
        own = node.attrs.get(name)
        if own is None:
            return False
        want = value
        if fold:
            own, want = own.lower(), want.lower()
        match op:
            case None:
                return True
            case "=":
                return own == want
            case "~=":
                return want in own.split()
            case "^=":
                return bool(want) and own.startswith(want)
            case "$=":
                return bool(want) and own.endswith(want)
            case "*=":
                return bool(want) and want in own
            case _:
                return own == want or own.startswith(want + "-")

    return test


def _pseudo(name: str, arg: str | None):
    place = lambda n: [c for c in n.parent.elements()].index(n) + 1
    if name == "first-child":
        return lambda n: place(n) == 1
    if name == "last-child":
        return lambda n: n.parent.elements()[-1] is n
    if name == "nth-child" and arg:
        hit = _nth(arg)
        return lambda n: hit(place(n))
    if name == "not" and arg:
        inner = compiled(arg)
        return lambda n: not any(_matches(n, chain) for chain in inner)
    raise SelectorError(f":{name}")


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple:
    """Chains of ``(combinator, tests, hint)``, the last compound first; the hint, a kind and a value, is
    what an element must have to match the compound."""
    chains, chain, tests, hints, comb, at = [], [], [], [], None, 0
    text = selector.strip()
    if not text:
        raise SelectorError("empty selector")

    def close() -> None:
        nonlocal tests, hints
        if not tests:
            raise SelectorError(selector)
        chain.append((comb, tuple(tests), min(hints) if hints else None))
        tests, hints = [], []

    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise SelectorError(selector)
        at = m.end()
        if m["comb"] == ",":
            close()
            chains.append(tuple(reversed(chain)))
            chain, comb = [], None
        elif m["comb"] or m["space"]:
            close()
            comb = m["comb"] or " "
        elif m["any"]:
            tests.append(lambda n: True)
        elif m["id"]:
            hints.append((0, m["id"].replace("\\", "")))
            tests.append(lambda n, v=m["id"].replace("\\", ""): n.attrs.get("id") == v)
        elif m["cls"]:
            hints.append((1, m["cls"].replace("\\", "")))
            tests.append(lambda n, v=m["cls"].replace("\\", ""): v in n.classes)
        elif m["attr"]:
            value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")
            tests.append(_attr_test(m["attr"].lower(), m["op"], value, bool(m["flag"])))
        elif m["pseudo"]:
            tests.append(_pseudo(m["pseudo"].lower(), m["arg"]))
        else:
            hints.append((2, m["type"].lower()))
            tests.append(lambda n, v=m["type"].lower(): n.name == v)
    close()
    chains.append(tuple(reversed(chain)))
    return tuple(chains)


def _matches(node: Node, chain: tuple, step: int = 0) -> bool:
    comb, tests, _ = chain[step]
    if not all(t(node) for t in tests):
        return False
    if step + 1 == len(chain):
        return True
    if comb == " ":
        up = node.parent
        while up is not None and up.name:
            if _matches(up, chain, step + 1):
                return True
            up = up.parent
        return False
    if comb == ">":
        return node.parent is not None and bool(node.parent.name) and _matches(node.parent, chain, step + 1)
    before = node.parent.elements() if node.parent is not None else []
    before = before[: before.index(node)]
    if comb == "+":
        return bool(before) and _matches(before[-1], chain, step + 1)
    return any(_matches(b, chain, step + 1) for b in before)


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` that match, in document order."""
    chains = compiled(selector)
    if len(chains) == 1 and chains[0][0][2] is not None and root.order is not None:
        chain = chains[0]
        return [n for n in root.found().get(chain[0][2], ()) if _matches(n, chain)]
    return [n for n in root.walk() if any(_matches(n, c) for c in chains)]
