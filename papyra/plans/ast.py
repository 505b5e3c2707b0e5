"""Predicates of the filter language, independent of any schema."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any as Value


class Node:
    """A predicate on a document (``Any``, logic) or on one value (the others)."""


@dataclass(frozen=True)
class All(Node):
    """Always true; below a path: something is there."""


@dataclass(frozen=True)
class Nothing(Node):
    """Never true."""


@dataclass(frozen=True)
class And(Node):
    terms: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    terms: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    term: Node


@dataclass(frozen=True)
class Any(Node):
    """Some value that the path expands to satisfies ``term``."""

    path: str
    term: Node
    expand: bool = True
    nulls: bool = True


@dataclass(frozen=True)
class Eq(Node):
    value: Value


@dataclass(frozen=True)
class In(Node):
    values: tuple[Value, ...]


@dataclass(frozen=True)
class Range(Node):
    """Values of one kind between two ends; ``None`` as an end: open within the kind."""

    low: Value = None
    high: Value = None
    low_in: bool = False
    high_in: bool = False


@dataclass(frozen=True)
class TypeIs(Node):
    code: int


@dataclass(frozen=True)
class IsObject(Node):
    """An object or an array."""


@dataclass(frozen=True)
class Size(Node):
    n: int


@dataclass(frozen=True)
class Regex(Node):
    pattern: str
    flags: str = ""

    @property
    def java(self) -> str:
        return f"(?{''.join(sorted(set(self.flags)))}){self.pattern}" if self.flags else self.pattern


def wants_nulls(node: Node) -> bool:
    """Whether a missing value counts as null for the predicate."""
    if isinstance(node, All | TypeIs | Any):
        return False
    if isinstance(node, And | Or):
        return all(wants_nulls(t) for t in node.terms)
    return wants_nulls(node.term) if isinstance(node, Not) else True


def describe(node: Node) -> dict:
    """A nested description, as explain shows it."""
    if isinstance(node, And | Or):
        return {type(node).__name__.upper(): [describe(t) for t in node.terms]}
    if isinstance(node, Not):
        return {"NOT": describe(node.term)}
    if isinstance(node, Any):
        return {"ANY": {"path": node.path, "predicate": describe(node.term)}}
    return {type(node).__name__.upper(): {k: repr(v) for k, v in vars(node).items()}}
