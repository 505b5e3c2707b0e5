"""Rewrites that Catalyst does not do: flattening for explain, and merging ranges on one value."""

from __future__ import annotations

from papyra.plans.ast import All, And, Any, Eq, Node, Not, Nothing, Or, Range


def _kind(v) -> str:
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, int | float) else type(v).__name__


def merge(a: Range, b: Range) -> Node | None:
    """The values in both ranges; ``None`` if they cannot be told apart from here."""
    ends = [v for r in (a, b) for v in (r.low, r.high) if v is not None]
    if len({_kind(v) for v in ends}) != 1:
        return Nothing()  # ranges hold values of one kind only
    low, low_in, high, high_in = a.low, a.low_in, a.high, a.high_in
    if b.low is not None and (low is None or b.low > low or b.low == low and not b.low_in):
        low, low_in = b.low, b.low_in
    if b.high is not None and (high is None or b.high < high or b.high == high and not b.high_in):
        high, high_in = b.high, b.high_in
    if low is not None and high is not None:
        if low > high or low == high and not (low_in and high_in):
            return Nothing()
        if low == high:
            return Eq(low)
    return Range(low, high, low_in, high_in)


def simplify(node: Node) -> Node:
    if isinstance(node, Not):
        term = simplify(node.term)
        if isinstance(term, Not):
            return term.term
        return Nothing() if isinstance(term, All) else All() if isinstance(term, Nothing) else Not(term)
    if isinstance(node, Any):
        term = simplify(node.term)
        return Nothing() if isinstance(term, Nothing) else Any(node.path, term, node.expand, node.nulls)
    if isinstance(node, Or):
        terms: list[Node] = []
        for t in map(simplify, node.terms):
            terms += t.terms if isinstance(t, Or) else [t]
        if any(isinstance(t, All) for t in terms):
            return All()
        terms = [t for t in terms if not isinstance(t, Nothing)]
        return Nothing() if not terms else terms[0] if len(terms) == 1 else Or(tuple(dict.fromkeys(terms)))
    if isinstance(node, And):
        terms = []
        for t in map(simplify, node.terms):
            terms += t.terms if isinstance(t, And) else [t]
        if any(isinstance(t, Nothing) for t in terms):
            return Nothing()
        terms = [t for t in terms if not isinstance(t, All)]
        rest, held = [], None
        for t in terms:  # bare ranges are on one and the same value
            if isinstance(t, Range):
                held = t if held is None else merge(held, t) if isinstance(held, Range) else Nothing()
            else:
                rest.append(t)
        if isinstance(held, Nothing):
            return Nothing()
        terms = rest + ([held] if held is not None else [])
        return All() if not terms else terms[0] if len(terms) == 1 else And(tuple(terms))
    return node
