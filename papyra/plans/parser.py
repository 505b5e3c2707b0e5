"""Filter documents to predicates.

A filter is an AND of entries: a logical operator with a list of filters, a path with a literal or a
regular expression (``re.Pattern``), or a path with a document of operators.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from papyra.errors import DocumentError
from papyra.plans.ast import (
    All, And, Any, Eq, In, IsObject, Node, Not, Nothing, Or, Range, Regex, Size, TypeIs, wants_nulls,
)

ID = "_id"


def is_literal(value) -> bool:
    """Whether a document is a value to compare with, not a document of operators."""
    return not any(k.startswith("$") for k in value)


def at(path: str, term: Node, in_element: bool = False, expand: bool = True) -> Node:
    return term if not path else Any(path, term, expand, not in_element and wants_nulls(term))


def _flags(pattern: re.Pattern) -> str:
    return "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & f)


def _regex(value, options: str = "") -> Regex:
    if isinstance(value, re.Pattern):
        found = Regex(value.pattern, "".join(sorted({*_flags(value), *options})))
    elif isinstance(value, str):
        found = Regex(value, "".join(sorted(set(options))))
    else:
        raise DocumentError(20000, "a regular expression is a string or a pattern")
    if set(found.flags) - set("imsx"):
        raise DocumentError(20000, f"regular expression options {options!r}")
    return found


def _range(op: str, value) -> Node:
    if isinstance(value, Mapping | list | tuple):
        return Nothing()
    if value is None:
        return Eq(None) if op in ("$gte", "$lte") else Nothing()
    if op in ("$gt", "$gte"):
        return Range(low=value, low_in=op == "$gte")
    return Range(high=value, high_in=op == "$lte")


def _value_operator(op: str, value, path: str, options: str) -> Node:
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return at(path, _range(op, value))
    if op == "$eq":
        return at(path, Eq(value))
    if op == "$ne":
        return Not(at(path, Eq(value)))
    if op in ("$in", "$nin"):
        if not isinstance(value, list | tuple):
            raise DocumentError(20000, f"{op} takes a list")
        found = at(path, In(tuple(value)))
        return found if op == "$in" else Not(found)
    if op == "$exists":
        return at(path, All()) if value else Not(at(path, All()))
    if op == "$type":
        return at(path, TypeIs(int(value)))
    if op == "$not":
        return Not(parse({path: value}) if path else _element({"": value}))
    if op == "$size":
        return Any(path, Size(int(value)), False, False) if path else Size(int(value))
    if op == "$regex":
        return at(path, _regex(value, options))
    if op == "$all":
        if not value:
            return Nothing()
        terms = []
        for v in value:
            if isinstance(v, Mapping) and "$elemMatch" in v:
                terms.append(_values(v, path))
            else:
                terms.append(at(path, Eq(v)))
        return And(tuple(terms))
    if op == "$elemMatch":
        return at(path, _element(value), in_element=True)
    if op == "$DEBUG_none":
        return Nothing()
    raise DocumentError(29997, op)


def _element(value: Mapping) -> Node:
    """What one element has to satisfy: a filter on an object, or operators on the element itself."""
    if "" in value:
        v = value[""]
        if isinstance(v, re.Pattern):
            return _regex(v)
        return _values(v, "") if isinstance(v, Mapping) and not is_literal(v) else Eq(v)
    if all(not k.startswith("$") or k in ("$and", "$or", "$nor") for k in value):
        return And((IsObject(), parse(value)))
    return _values(value, "")


def _values(value: Mapping, path: str) -> Node:
    options = value.get("$options", "")
    terms = [_value_operator(op, v, path, options) for op, v in value.items() if op != "$options"]
    return terms[0] if len(terms) == 1 else And(tuple(terms))


def parse(query: Mapping | None, top: bool = False) -> Node:
    """The predicate of a filter document."""
    terms: list[Node] = []
    for key, value in (query or {}).items():
        if isinstance(value, re.Pattern):
            terms.append(at(key, _regex(value)))
        elif key.startswith("$"):
            if key not in ("$and", "$or", "$nor"):
                raise DocumentError(15896, key)
            if not isinstance(value, list | tuple) or not all(isinstance(v, Mapping) for v in value):
                raise DocumentError(20000, f"{key} takes a list of filters")
            parts = tuple(parse(v) for v in value)
            terms.append(And(parts) if key == "$and" else Or(parts) if key == "$or" else Not(Or(parts)))
        elif isinstance(value, Mapping) and not is_literal(value):
            if top and key == ID:  # an _id is never an array
                terms.append(at(key, _element(value), in_element=True))
            else:
                terms.append(_values(value, key))
        else:
            terms.append(at(key, Eq(value)))
    return terms[0] if len(terms) == 1 else And(tuple(terms))
