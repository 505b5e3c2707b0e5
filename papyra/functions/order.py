"""Sort keys of the cross-type order of document values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.plans.compile import NUMBERS, TIMES

#: Order of the kinds of values: null, numbers, strings, objects, arrays, bytes, booleans, dates.
CODES = ((NUMBERS, 30), (T.StringType, 40), (T.StructType, 51), (T.MapType, 51), (T.ArrayType, 61), (T.BinaryType, 70), (T.BooleanType, 90), (TIMES, 100))


def type_code(dtype: T.DataType) -> int:
    return next((code for kinds, code in CODES if isinstance(dtype, kinds)), 20)


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    return isinstance(dtype, T.MapType) or isinstance(dtype, T.StructType) and any(_holds_map(f.dataType) for f in dtype)


def sort_keys(col: Column, dtype: T.DataType, direction: int) -> list[Column]:
    """Order-by expressions of one field; nulls and missing values are the smallest.

    An array is sorted by its smallest element (ascending) or its largest (descending); objects are
    compared field by field.
    """
    if isinstance(dtype, T.ArrayType):
        element = dtype.elementType
        if _holds_map(element):  # maps have no order of their own
            return sort_keys(F.to_json(col), T.StringType(), direction)
        return sort_keys(F.array_min(col) if direction > 0 else F.array_max(col), element, direction)
    if _holds_map(dtype):
        return sort_keys(F.to_json(col), T.StringType(), direction)
    return [col.asc_nulls_first() if direction > 0 else col.desc_nulls_last()]


def _variant_keys(v: Column) -> tuple[Column, Column, Column]:
    kind = F.schema_of_variant(v)
    code = (
        F.when(kind.isNull() | (kind == "VOID"), 20)
        .when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), 30)
        .when(kind == "STRING", 40).when(kind.startswith("OBJECT"), 51).when(kind.startswith("ARRAY"), 61)
        .when(kind == "BINARY", 70).when(kind == "BOOLEAN", 90).otherwise(100)
    )
    number = F.when(code == 30, F.try_variant_get(v, "$", "double"))
    text = F.when(code == 40, F.try_variant_get(v, "$", "string")).when(code > 40, F.to_json(v))
    return code, number, text


def variant_sort_keys(v: Column, direction: int) -> list[Column]:
    """The same for a VARIANT value: the kind first, then the value within its kind."""
    return [k.asc_nulls_first() if direction > 0 else k.desc_nulls_last() for k in _variant_keys(v)]


def variant_rank(v: Column) -> Column:
    """A struct by which two VARIANT values are compared; whole numbers exactly, also beyond what a double tells apart."""
    code, number, text = _variant_keys(v)
    whole = F.when(code == 30, F.coalesce(F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")), number.try_cast("bigint")))
    return F.struct(code.alias("kind"), number.alias("number"), whole.alias("whole"), text.alias("text"))
