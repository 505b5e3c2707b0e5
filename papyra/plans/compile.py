"""Predicates to columns, for typed documents and for VARIANT documents.

A condition is a pair: ``pos`` may be NULL where it is false (as a filter wants it, so that bare
comparisons reach the Parquet scan), ``neg`` is its negation and never NULL. SQL NULL and a missing
field are the same in typed documents. Paths are resolved against the schema, so a path that
cannot exist becomes a constant, which Catalyst folds.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.plans.ast import (
    All, And, Any, Eq, In, IsObject, Node, Not, Nothing, Or, Range, Regex, Size, TypeIs,
)

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass(frozen=True)
class Cond:
    pos: Column
    neg: Column

    @staticmethod
    def of(pos: Column) -> Cond:
        return Cond(pos, ~F.coalesce(pos, F.lit(False)))


TRUE, FALSE = True, False


def _cond(value: bool | Cond) -> Cond:
    return value if isinstance(value, Cond) else Cond(F.lit(value), F.lit(not value))


def both(parts: list) -> bool | Cond:
    if any(p is False for p in parts):
        return FALSE
    rest = [p for p in parts if p is not True]
    if len(rest) < 2:
        return rest[0] if rest else TRUE
    return Cond(reduce(Column.__and__, [p.pos for p in rest]), reduce(Column.__or__, [p.neg for p in rest]))


def either(parts: list) -> bool | Cond:
    if any(p is True for p in parts):
        return TRUE
    rest = [p for p in parts if p is not False]
    if len(rest) < 2:
        return rest[0] if rest else FALSE
    return Cond(reduce(Column.__or__, [p.pos for p in rest]), reduce(Column.__and__, [p.neg for p in rest]))


def negate(part: bool | Cond) -> bool | Cond:
    return not part if isinstance(part, bool) else Cond(part.neg, F.coalesce(part.pos, F.lit(False)))


# --- literals ---------------------------------------------------------------------------------


def literal(value, dtype: T.DataType) -> Column | None:
    """A value of exactly this type as a column; ``None`` if the type cannot hold an equal value."""
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return F.lit(value) if isinstance(value, bool) else None
    if isinstance(dtype, NUMBERS):
        if isinstance(value, bool) or not isinstance(value, int | float):
            return None
        if isinstance(dtype, INTEGERS):
            if isinstance(value, float) and not (math.isfinite(value) and value.is_integer()):
                return None
            return F.lit(int(value)) if abs(int(value)) < 2**63 else None
        if isinstance(value, int):
            return F.lit(float(value)) if abs(value) < 2**1023 and int(float(value)) == value else None
        return F.lit(value)
    if isinstance(dtype, T.StringType):
        return F.lit(value) if isinstance(value, str) else None
    if isinstance(dtype, T.BinaryType):
        return F.lit(bytes(value)) if isinstance(value, bytes | bytearray) else None
    if isinstance(dtype, TIMES):
        if isinstance(value, datetime.datetime):
            kind = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp"
            return F.lit(value.isoformat(" ")).cast(kind)
        return F.lit(value).cast(dtype) if isinstance(value, datetime.date) else None
    if isinstance(dtype, T.ArrayType):
        if not isinstance(value, list | tuple):
            return None
        items = [literal(v, dtype.elementType) for v in value]
        return None if any(i is None for i in items) else F.array(*items).cast(dtype)
    if isinstance(dtype, T.StructType):
        if not isinstance(value, Mapping) or set(value) - set(dtype.names):
            return None
        fields = [(f.name, literal(value.get(f.name), f.dataType)) for f in dtype]
        if any(c is None for _, c in fields):
            return None
        return F.struct(*[c.cast(dtype[n].dataType).alias(n) for n, c in fields])
    return None


# --- leaves on typed values -------------------------------------------------------------------


def _equal(col: Column, dtype: T.DataType, value) -> bool | Cond:
    if value is None:
        return Cond(col.isNull(), col.isNotNull())
    lit = literal(value, dtype)
    if lit is None:
        return FALSE
    return Cond(col == lit, ~col.eqNullSafe(lit))


def _within(col: Column, dtype: T.DataType, r: Range) -> bool | Cond:
    parts = []
    for end, inside, op in ((r.low, r.low_in, ">"), (r.high, r.high_in, "<")):
        if end is None:
            continue
        if isinstance(dtype, INTEGERS) and isinstance(end, float) and not isinstance(end, bool):
            if math.isinf(end):  # beyond every integer
                parts.append(Cond.of(col.isNotNull()) if (end < 0) == (op == ">") else FALSE)
                continue
            if not end.is_integer():  # the next integer on the inner side
                end, inside = (math.ceil(end) if op == ">" else math.floor(end)), True
        lit = literal(end, dtype)
        if lit is None and isinstance(dtype, T.DoubleType | T.FloatType) and isinstance(end, int) and not isinstance(end, bool):
            near = float(end)  # an integer that no double equals
            inside, lit = (near > end) == (op == ">"), F.lit(near)
        if lit is None and isinstance(dtype, INTEGERS) and isinstance(end, int | float) and not isinstance(end, bool):
            parts.append(Cond.of(col.isNotNull()) if (end < 0) == (op == ">") else FALSE)
            continue
        if lit is None:
            return FALSE
        ok = (col >= lit if inside else col > lit) if op == ">" else (col <= lit if inside else col < lit)
        parts.append(Cond.of(ok))
    return both(parts) if parts else FALSE


_CODES = {
    1: (T.DoubleType, T.FloatType, T.DecimalType), 2: T.StringType, 3: (T.StructType, T.MapType), 4: T.ArrayType,
    5: T.BinaryType, 8: T.BooleanType, 9: TIMES, 16: (T.ByteType, T.ShortType, T.IntegerType), 18: T.LongType,
}


def test(node: Node, col: Column, dtype: T.DataType) -> bool | Cond:
    """A predicate on one typed value."""
    if isinstance(node, All):
        return Cond(col.isNotNull(), col.isNull())
    if isinstance(node, Nothing):
        return FALSE
    if isinstance(node, Eq):
        return _equal(col, dtype, node.value)
    if isinstance(node, In):
        lits = [literal(v, dtype) for v in node.values if v is not None]
        lits = [x for x in lits if x is not None]
        parts: list = [Cond.of(col.isin(*lits))] if lits else []
        return either(parts + [_equal(col, dtype, None)] * any(v is None for v in node.values))
    if isinstance(node, Range):
        return _within(col, dtype, node)
    if isinstance(node, TypeIs):
        kinds = _CODES.get(node.code)
        return Cond(col.isNotNull(), col.isNull()) if kinds and isinstance(dtype, kinds) else FALSE
    if isinstance(node, IsObject):
        return Cond(col.isNotNull(), col.isNull()) if isinstance(dtype, T.StructType | T.MapType | T.ArrayType) else FALSE
    if isinstance(node, Size):
        return Cond.of(F.size(col) == node.n) if isinstance(dtype, T.ArrayType) else FALSE
    if isinstance(node, Regex):
        return Cond.of(col.rlike(node.java)) if isinstance(dtype, T.StringType) else FALSE
    if isinstance(node, And):
        return both([test(t, col, dtype) for t in node.terms])
    if isinstance(node, Or):
        return either([test(t, col, dtype) for t in node.terms])
    if isinstance(node, Not):
        return negate(test(node.term, col, dtype))
    if isinstance(node, Any):
        parts = node.path.split(".")
        if isinstance(dtype, T.ArrayType):  # an array that is the value itself is not gone through: only an index leads on
            if not parts[0].isdigit():
                return FALSE
            at = F.get(col, F.lit(int(parts[0])))
            return both([Cond.of(F.size(col) > int(parts[0])), _walk(at, dtype.elementType, parts[1:], node, True, len(parts) == 1)])
        return _walk(col, dtype, parts, node, False, False)
    raise TypeError(node)


def _null(node: Any) -> bool | Cond:
    """What the predicate says of a value that is not there."""
    return test(node.term, F.lit(None), T.NullType()) if node.nulls else FALSE


def _some(array: Column, make: Callable[[Column], bool | Cond]) -> bool | Cond:
    made: list[bool | Cond] = []

    def element(x: Column) -> Column:  # built once: nested arrays would double the work at every level
        made.append(make(x))
        return F.coalesce(_cond(made[0]).pos, F.lit(False))

    found = F.exists(array, element)
    if isinstance(made[0], bool):
        return Cond.of(F.size(array) > 0) if made[0] else FALSE
    return Cond.of(found)


def _walk(col: Column, dtype: T.DataType, parts: list[str], node: Any, in_array: bool, leaf_index: bool) -> bool | Cond:
    """Some expansion of the path below ``col`` satisfies the predicate."""
    if not parts:
        found = test(node.term, col, dtype)
        if isinstance(dtype, T.ArrayType) and node.expand and not leaf_index:
            found = either([found, _some(col, lambda x: test(node.term, x, dtype.elementType))])
        return found
    head, rest = parts[0], parts[1:]
    if isinstance(dtype, T.StructType):
        if head not in dtype.names:
            return both([Cond(col.isNotNull(), col.isNull()) if in_array else TRUE, _null(node)])
        found = _walk(col.getField(head), dtype[head].dataType, rest, node, False, False)
        return both([Cond(col.isNotNull(), col.isNull()), found]) if in_array else found
    if isinstance(dtype, T.MapType):
        return _walk(F.try_element_at(col, F.lit(head)), dtype.valueType, rest, node, False, False)
    if isinstance(dtype, T.ArrayType):
        kind = dtype.elementType
        ways = []
        if head.isdigit() or head == "":
            k = int(head or 0)
            inner = _walk(F.get(col, F.lit(k)), kind, rest, node, True, not rest)
            ways.append(both([Cond.of(F.size(col) > k), inner]))
            if isinstance(kind, T.StructType) and head in kind.names:
                ways.append(_some(col, lambda x: _walk(x, kind, parts, node, True, False)))
        elif isinstance(kind, T.StructType | T.MapType):
            ways.append(_some(col, lambda x: _walk(x, kind, parts, node, True, False)))
        if not in_array:  # an array that is missing is no array: the value is missing
            ways.append(both([Cond(col.isNull(), col.isNotNull()), _null(node)]))
        return either(ways)
    return FALSE if in_array else _null(node)


# --- VARIANT documents ------------------------------------------------------------------------


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _array(v: Column) -> Column:
    """The elements, or NULL where the value is no array."""
    return F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _whole(v: Column) -> Column:
    return F.when(_kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def _fraction(v: Column) -> Column:
    kind = _kind(v)
    return F.when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))


def _time(v: Column) -> Column:
    return F.when(_kind(v).startswith("TIMESTAMP") | (_kind(v) == "DATE"), F.try_variant_get(v, "$", "timestamp"))


def _binary(v: Column) -> Column:
    return F.when(_kind(v) == "BINARY", F.try_variant_get(v, "$", "binary"))


def _variant_equal(v: Column, value) -> bool | Cond:
    if value is None:
        return Cond.of(F.coalesce(_kind(v) == "VOID", F.lit(True)))
    if isinstance(value, bool):
        return Cond.of((_kind(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value)))
    if isinstance(value, int | float):  # integers are compared exactly, also beyond what a double tells apart
        return either([_equal(_whole(v), T.LongType(), value), _equal(_fraction(v), T.DoubleType(), value)])
    if isinstance(value, datetime.date):
        return _equal(_time(v), T.TimestampType(), value)
    if isinstance(value, bytes | bytearray):
        return _equal(_binary(v), T.BinaryType(), value)
    if isinstance(value, str):
        return Cond.of((_kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(value)))
    if isinstance(value, Mapping | list | tuple):
        import json

        # JSON of a variant has sorted keys, so objects are equal in whatever order their fields are.
        want = F.to_json(F.parse_json(F.lit(json.dumps(value, ensure_ascii=False))))
        start = "ARRAY" if not isinstance(value, Mapping) else "OBJECT"
        return Cond.of(_kind(v).startswith(start) & (F.to_json(v) == want))
    return FALSE


_VARIANT_CODES = {1: ("DOUBLE", "FLOAT", "DECIMAL"), 2: ("STRING",), 3: ("OBJECT",), 4: ("ARRAY",), 8: ("BOOLEAN",), 9: ("TIMESTAMP", "DATE"), 5: ("BINARY",), 10: ("VOID",)}


def test_variant(node: Node, v: Column) -> bool | Cond:
    """A predicate on one VARIANT value; a missing value is SQL NULL, an explicit null is not."""
    if isinstance(node, All):
        return Cond(v.isNotNull(), v.isNull())
    if isinstance(node, Nothing):
        return FALSE
    if isinstance(node, Eq):
        return _variant_equal(v, node.value)
    if isinstance(node, In):
        return either([_variant_equal(v, x) for x in node.values])
    if isinstance(node, Range):
        ends = [e for e in (node.low, node.high) if e is not None]
        if all(isinstance(e, str) for e in ends):
            col, kind = F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")), T.StringType()
        elif all(isinstance(e, bool) for e in ends):
            col, kind = F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")), T.BooleanType()
        elif all(isinstance(e, datetime.date) for e in ends):
            col, kind = _time(v), T.TimestampType()
        elif all(isinstance(e, bytes | bytearray) for e in ends):
            col, kind = _binary(v), T.BinaryType()
        elif all(isinstance(e, int | float) and not isinstance(e, bool) for e in ends):
            return either([_within(_whole(v), T.LongType(), node), _within(_fraction(v), T.DoubleType(), node)])
        else:
            return FALSE
        return _within(col, kind, node)
    if isinstance(node, TypeIs) and node.code in (16, 18):  # whole numbers have no width here: 16 if 32 bits hold them
        narrow = _whole(v).between(F.lit(-(2**31)), F.lit(2**31 - 1))
        return Cond.of(narrow if node.code == 16 else ~narrow)
    if isinstance(node, TypeIs):
        starts = [Cond.of(_kind(v).startswith(s)) for s in _VARIANT_CODES.get(node.code, ())]
        return either(starts)
    if isinstance(node, IsObject):
        return Cond.of(_kind(v).startswith("OBJECT") | _kind(v).startswith("ARRAY"))
    if isinstance(node, Size):
        return Cond.of(F.size(_array(v)) == node.n)
    if isinstance(node, Regex):
        return Cond.of(F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string").rlike(node.java)))
    if isinstance(node, And):
        return both([test_variant(t, v) for t in node.terms])
    if isinstance(node, Or):
        return either([test_variant(t, v) for t in node.terms])
    if isinstance(node, Not):
        return negate(test_variant(node.term, v))
    if isinstance(node, Any):
        return _walk_variant(v, node.path.split("."), node, False, False, True)
    raise TypeError(node)


def _walk_variant(
    v: Column, parts: list[str], node: Any, in_array: bool, leaf_index: bool, closed: bool = False
) -> bool | Cond:
    """The same below a VARIANT value; ``closed``: if it is an array, it is not gone through, only an index leads on."""
    there = Cond(v.isNotNull(), v.isNull())
    if not parts:
        own = both([there, test_variant(node.term, v)])
        if node.expand and not leaf_index:
            own = either([own, _some(_array(v), lambda x: test_variant(node.term, x))])
        return own
    head, rest = parts[0], parts[1:]
    null = test_variant(node.term, F.lit(None).cast("variant")) if node.nulls else FALSE
    field = F.try_variant_get(v, "$['" + head.replace("'", "\\'") + "']", "variant")
    is_object = _kind(v).startswith("OBJECT")
    ways = [both([Cond.of(is_object), _walk_variant(field, rest, node, False, False)])]
    missing = is_object & field.isNull()
    if not in_array:  # below a scalar that is in no array, or below nothing, a value is missing too
        missing = missing | F.coalesce(~is_object & ~_kind(v).startswith("ARRAY"), F.lit(True))
    ways.append(both([Cond.of(missing), null]))
    elements = _array(v)
    inner = lambda x: both([Cond.of(_kind(x).startswith("OBJECT")), _walk_variant(x, parts, node, True, False, True)])
    if head.isdigit():
        at = F.get(elements, F.lit(int(head)))
        ways.append(both([Cond.of(F.size(elements) > int(head)), _walk_variant(at, rest, node, True, not rest)]))
    if not closed:
        ways.append(_some(elements, inner))
    return either(ways)


# --- whole documents --------------------------------------------------------------------------


def condition(node: Node, df: DataFrame, variant: str | None = None) -> Cond:
    """The condition of a predicate on the rows of ``df``; ``variant``: the column that holds the documents."""

    def go(n: Node) -> bool | Cond:
        if isinstance(n, And):
            return both([go(t) for t in n.terms])
        if isinstance(n, Or):
            return either([go(t) for t in n.terms])
        if isinstance(n, Not):
            return negate(go(n.term))
        if isinstance(n, All):
            return TRUE
        if isinstance(n, Nothing):
            return FALSE
        assert isinstance(n, Any), n
        if variant is not None and n.path.split(".")[0] not in df.columns:
            return _walk_variant(F.col(f"`{variant}`"), n.path.split("."), n, False, False)
        head, *rest = n.path.split(".")
        if head not in df.columns:
            return _null(n)
        return _walk(F.col(f"`{head}`"), df.schema[head].dataType, rest, n, False, False)

    return _cond(go(node))
