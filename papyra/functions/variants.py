"""VARIANT documents taken apart, and documents made of parts. Every function is one column expression.

A missing value is SQL NULL; an explicit null is a VARIANT value. Arrays directly within arrays are gone
through ``NESTED`` times; what is deeper counts as a scalar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NESTED = 2


def bound(value: Column, make) -> Column:
    """``make(value)`` with the value worked out once, however often ``make`` names it: expressions made of such steps grow by
    addition, where naming a column many times in each step multiplies them."""
    return F.element_at(F.transform(F.array(value), lambda x: make(x)), 1)


def fields(v: Column) -> Column:
    """The fields of an object by name, NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def elements(v: Column) -> Column:
    """The elements of an array, NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def field(v: Column, name: str) -> Column:
    return F.try_element_at(fields(v), F.lit(name))


def part(v: Column, name: str) -> Column:
    """A field of an object, or by a number an element of an array."""
    if not name.isdigit():
        return field(v, name)
    return bound(v, lambda v: F.coalesce(field(v, name), F.get(elements(v), F.lit(int(name)))))


def _none() -> Column:
    return F.expr("cast(array() as array<variant>)")


def values_at(v: Column, parts: list[str]) -> Column:
    """All values at a path as an array: arrays on the way are gone through, one at its end is taken apart; NULL for none."""
    if not parts:
        return F.when(v.isNotNull(), F.coalesce(elements(v), F.array(v)))
    head, rest = parts[0], parts[1:]
    ways = [values_at(field(v, head), rest)]
    if head.isdigit():
        ways.append(values_at(F.get(elements(v), F.lit(int(head))), rest))
    inner = F.transform(elements(v), lambda x: F.coalesce(values_at(field(x, head), rest), _none()))
    ways.append(F.flatten(inner))
    return F.concat(*[F.coalesce(w, _none()) for w in ways])


def equal_key(v: Column) -> Column:
    """A text that is the same for equal values: whole numbers are equal in whatever kind they are held."""
    kind, double = F.schema_of_variant(v), F.try_variant_get(v, "$", "double")
    number = kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    whole = (double == F.floor(double)) & (F.abs(double) < 2.0**53)
    as_long = double.try_cast("bigint").cast("string")
    text = (
        F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint").cast("string"))
        .when(number, F.when(whole, as_long).otherwise(double.cast("string")))
        .otherwise(F.to_json(v))
    )
    name = F.when(number | (kind == "BIGINT"), "number").when(kind.startswith("OBJECT"), "object")
    return F.concat_ws(" ", name.when(kind.startswith("ARRAY"), "array").otherwise(kind), text)


def include(v: Column, tree: dict) -> Column:
    """The object with the paths of ``tree`` only (``None``: the whole value); NULL for anything but an object."""
    kept = [x for n, t in tree.items() for x in (F.lit(n), field(v, n) if t is None else _include_below(field(v, n), t, NESTED))]
    there = F.map_filter(F.create_map(*kept), lambda _, x: x.isNotNull())
    return F.when(fields(v).isNotNull(), F.to_variant_object(there))


def _include_below(v: Column, tree: dict, depth: int) -> Column:
    if not depth:
        return include(v, tree)
    items = F.transform(elements(v), lambda x: _include_below(x, tree, depth - 1))
    return F.coalesce(include(v, tree), F.to_variant_object(F.filter(items, lambda x: x.isNotNull())))


def exclude(v: Column, tree: dict) -> Column:
    """The object without the paths of ``tree``; NULL for anything but an object."""
    gone = [n for n, t in tree.items() if t is None]
    left = F.map_filter(fields(v), lambda n, _: ~n.isin(gone)) if gone else fields(v)

    def change(name: Column, x: Column) -> Column:
        out = x
        for n, t in tree.items():
            if t is not None:
                out = F.when(name == n, _exclude_below(x, t, NESTED)).otherwise(out)
        return out

    return F.to_variant_object(F.transform_values(left, change) if len(gone) < len(tree) else left)


def _exclude_below(v: Column, tree: dict, depth: int) -> Column:
    if not depth:
        return F.coalesce(exclude(v, tree), v)
    items = F.transform(elements(v), lambda x: _exclude_below(x, tree, depth - 1))
    return F.coalesce(exclude(v, tree), F.to_variant_object(items), v)


def put(v: Column, parts: list[str], make) -> Column:
    """The object with ``make(old value)`` at a path, objects made on the way; a NULL takes the field away.

    A number leads to a place of an array, which grows with nulls up to it; there a NULL becomes a null. Another value
    on the way stays as it is.
    """
    head, rest = parts[0], parts[1:]
    changed = lambda old: put(old, rest, make) if rest else bound(old, make)
    null = F.parse_json(F.lit("null"))

    def in_object(own: Column, new: Column) -> Column:
        others = F.map_filter(own, lambda n, _: n != head)
        return F.to_variant_object(F.map_concat(others, F.map_filter(F.create_map(F.lit(head), new), lambda _, x: x.isNotNull())))

    def in_array(held: Column, new: Column, k: int) -> Column:
        grown = F.concat(held, F.array_repeat(null, F.greatest(F.lit(k + 1) - F.size(held), F.lit(0))))
        return F.to_variant_object(F.transform(grown, lambda x, i: F.when(i == k, F.coalesce(new, null)).otherwise(x)))

    def in_either(own: Column, held: Column, k: int, v: Column) -> Column:
        old = F.coalesce(F.try_element_at(own, F.lit(head)), F.get(held, F.lit(k)))
        new = F.when(own.isNotNull() | held.isNotNull(), changed(old))
        return bound(new, lambda new: F.when(own.isNotNull(), in_object(own, new)).when(held.isNotNull(), in_array(held, new, k)).otherwise(v))

    def done(v: Column) -> Column:
        own = F.when(v.isNull(), F.expr("cast(map() as map<string,variant>)")).otherwise(fields(v))
        if head.isdigit():
            return bound(own, lambda own: bound(elements(v), lambda held: in_either(own, held, int(head), v)))
        return bound(own, lambda own: F.when(own.isNotNull(), in_object(own, changed(F.try_element_at(own, F.lit(head))))).otherwise(v))

    return bound(v, done)
