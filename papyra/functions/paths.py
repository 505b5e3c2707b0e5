"""Values at a dotted path of typed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def value_at(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """The value at a path; below arrays of objects, the array of the elements' values."""
    head, *rest = path.split(".")
    if head not in df.columns:
        return F.lit(None), T.NullType()
    return _value(F.col(f"`{head}`"), df.schema[head].dataType, rest)


def _value(col: Column, dtype: T.DataType, parts: list[str]) -> tuple[Column, T.DataType]:
    if not parts:
        return col, dtype
    head, rest = parts[0], parts[1:]
    if isinstance(dtype, T.StructType) and head in dtype.names:
        return _value(col.getField(head), dtype[head].dataType, rest)
    if isinstance(dtype, T.MapType):
        return _value(F.try_element_at(col, F.lit(head)), dtype.valueType, rest)
    if isinstance(dtype, T.ArrayType):
        if head.isdigit():
            return _value(F.get(col, F.lit(int(head))), dtype.elementType, rest)
        if isinstance(dtype.elementType, T.StructType) and head in dtype.elementType.names:
            kind = _value(F.lit(None), dtype.elementType, parts)[1]
            return F.transform(col, lambda x: _value(x, dtype.elementType, parts)[0]), T.ArrayType(kind)
    return F.lit(None), T.NullType()


def values_of(col: Column, dtype: T.DataType, parts: list[str], keep_arrays: bool) -> tuple[Column, T.DataType] | None:
    """All values that the path expands to, as one array, a final array taken apart one level.

    ``keep_arrays``: a final array counts as a value itself besides its elements.
    """
    if not parts:
        if isinstance(dtype, T.ArrayType):
            return col, dtype.elementType
        return F.when(col.isNotNull(), F.array(col)), dtype
    head, rest = parts[0], parts[1:]
    if isinstance(dtype, T.StructType) and head in dtype.names:
        return values_of(col.getField(head), dtype[head].dataType, rest, keep_arrays)
    if isinstance(dtype, T.ArrayType):
        kind = dtype.elementType
        if head.isdigit():
            at = F.get(col, F.lit(int(head)))
            if not rest:  # a leaf index does not take its own array apart
                return F.when(at.isNotNull(), F.array(at)), kind
            return values_of(at, kind, rest, keep_arrays)
        if isinstance(kind, T.StructType):
            inner = values_of(F.lit(None).cast(kind), kind, parts, keep_arrays)
            if inner is None:
                return None
            empty = F.array().cast(T.ArrayType(inner[1]))
            return F.flatten(F.transform(col, lambda x: F.coalesce(values_of(x, kind, parts, keep_arrays)[0], empty))), inner[1]
    return None
