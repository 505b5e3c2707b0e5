"""Update documents as column expressions: every operator is a function of the old document.

``apply_update`` gives the new documents; rows that the condition does not hold for stay. All
operators of one update read the old values. Types widen where an operand needs it. In typed documents
a field that is unset or moved away stays in the schema and is NULL, which is the same as missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.errors import DocumentError
from papyra.functions import variants
from papyra.operators import variant_leaves
from papyra.plans.compile import INTEGERS, NUMBERS, Cond, literal, test
from papyra.plans.ast import Eq, In

Typed = tuple[Column, T.DataType]
OPERATORS = (
    "$set", "$unset", "$rename", "$inc", "$mul", "$bit", "$setOnInsert", "$pop", "$pull", "$pullAll", "$push",
    "$addToSet", "$currentDate", "$max", "$min",
)
#: Operators that create the parents of their path.
CREATING = ("$set", "$inc", "$mul", "$currentDate", "$max", "$min", "$push", "$addToSet")


def infer(value) -> T.DataType:
    """The type that a literal has by itself."""
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.IntegerType() if -(2**31) <= value < 2**31 else T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, bytes | bytearray):
        return T.BinaryType()
    if isinstance(value, Mapping):
        return T.StructType([T.StructField(k, infer(v)) for k, v in value.items()])
    if isinstance(value, list | tuple):
        kind: T.DataType = T.NullType()
        for v in value:
            kind = wider(kind, infer(v))
        return T.ArrayType(kind)
    return T.TimestampType()


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The smallest type that holds both, if there is one."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, NUMBERS) and isinstance(b, NUMBERS):
        order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
        ranks = [order.index(type(x)) if type(x) in order else 5 for x in (a, b)]
        return order[5 if 4 in ranks and ranks[0] != ranks[1] else max(ranks)]()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*a.names, *(n for n in b.names if n not in a.names)]
        pick = lambda n: wider(a[n].dataType, b[n].dataType) if n in a.names and n in b.names else (a if n in a.names else b)[n].dataType
        return T.StructType([T.StructField(n, pick(n)) for n in names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    if isinstance(a, times) and isinstance(b, times):
        return a
    raise DocumentError(20000, f"a field cannot hold both {a.simpleString()} and {b.simpleString()}")


def cast(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value of one type as one of a wider type; fields are matched by name."""
    if have == want:
        return col
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        fields = [
            (cast(col.getField(f.name), have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want
        ]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType) and isinstance(have.elementType, T.StructType):
        return F.transform(col, lambda x: cast(x, have.elementType, want.elementType))
    return col.cast(want)


def constant(value) -> Typed:
    dtype = infer(value)
    return literal(value, dtype) if not isinstance(dtype, T.TimestampType) else F.lit(value), dtype


# --- one value --------------------------------------------------------------------------------

Leaf = Callable[[Column | None, T.DataType], Typed]


def modify(col: Column | None, dtype: T.DataType, parts: list[str], leaf: Leaf, create: bool) -> Typed:
    """The value with ``leaf`` applied at a path below it."""
    if not parts:
        return leaf(col, dtype)
    head, rest = parts[0], parts[1:]
    if col is None or isinstance(dtype, T.NullType):
        if not create:
            return F.lit(None) if col is None else col, dtype
        inner, kind = modify(None, T.NullType(), rest, leaf, create)
        return F.struct(inner.alias(head)), T.StructType([T.StructField(head, kind)])
    if isinstance(dtype, T.StructType):
        if head in dtype.names:
            inner, kind = modify(col.getField(head), dtype[head].dataType, rest, leaf, create)
        elif create:
            inner, kind = modify(None, T.NullType(), rest, leaf, create)
        else:
            return col, dtype
        fields = [(n, col.getField(n), dtype[n].dataType) for n in dtype.names if n != head]
        order = dtype.names if head in dtype.names else [*dtype.names, head]
        by_name = {n: (c, d) for n, c, d in [*fields, (head, inner, kind)]}
        made = F.struct(*[by_name[n][0].alias(n) for n in order])
        return (made if create else F.when(col.isNotNull(), made)), T.StructType([T.StructField(n, by_name[n][1]) for n in order])
    if isinstance(dtype, T.ArrayType):
        if not head.isdigit():
            raise DocumentError(10348, head)
        k = int(head)
        inner, kind = modify(F.get(col, F.lit(k)), dtype.elementType, rest, leaf, create)
        whole = wider(dtype.elementType, kind)
        old = cast(col, dtype, T.ArrayType(whole))
        if create:  # grow with nulls up to the place
            old = F.coalesce(old, F.array().cast(T.ArrayType(whole)))
            old = F.concat(old, F.array_repeat(F.lit(None).cast(whole), F.greatest(F.lit(k + 1) - F.size(old), F.lit(0))))
        new = F.transform(old, lambda x, i: F.when(i == k, cast(inner, kind, whole)).otherwise(x))
        return new, T.ArrayType(whole)
    if create:
        raise DocumentError(10145, head)
    return col, dtype


def _number_result(col: Column | None, dtype: T.DataType, operand, code: int) -> tuple[T.DataType, Column]:
    if isinstance(operand, bool) or not isinstance(operand, int | float):
        raise DocumentError(16840)
    if col is not None and not isinstance(dtype, (*NUMBERS, T.NullType)):
        raise DocumentError(code)
    kind = wider(dtype if col is not None else T.NullType(), infer(operand))
    return kind, F.lit(operand).cast(kind)


def _int32(x: Column) -> Column:
    """The low 32 bits of a long, with their sign."""
    return F.shiftright(F.shiftleft(x, 32), 32).cast("int")


def _int64(x: Column) -> Column:
    """A whole decimal number modulo 2^64, with its sign."""
    half, whole = F.lit(str(2**63)).cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(20,0)")
    return (F.pmod(x + half, whole) - half).cast("long")


def _wrapped(a: Column, b: Column, kind: T.DataType, op: str) -> Column:
    """``a + b`` or ``a * b``; integers beyond the ends of their type start again at the other end, as in two's complement."""
    apply = (lambda x, y: x + y) if op == "+" else (lambda x, y: x * y)
    if isinstance(kind, T.LongType):
        exact = F.try_add(a, b) if op == "+" else F.try_multiply(a, b)
        wide = [x.cast("decimal(19,0)") for x in (a, b)]
        return F.when(a.isNotNull(), F.coalesce(exact, _int64(apply(*wide))))
    if isinstance(kind, INTEGERS):
        return _int32(apply(a.cast("long"), b.cast("long"))).cast(kind)
    return apply(a, b)


def _inc(operand) -> Leaf:
    def leaf(col, dtype):
        kind, by = _number_result(col, dtype, operand, 10140)
        return (by if col is None else _wrapped(F.coalesce(col.cast(kind), F.lit(0).cast(kind)), by, kind, "+")), kind

    return leaf


def _mul(operand) -> Leaf:
    def leaf(col, dtype):
        kind, by = _number_result(col, dtype, operand, 16837)
        return (F.lit(0).cast(kind) if col is None else F.coalesce(_wrapped(col.cast(kind), by, kind, "*"), F.lit(0).cast(kind))), kind

    return leaf


def _bit(operand) -> Leaf:
    if not isinstance(operand, Mapping) or len(operand) != 1:
        raise DocumentError(9016)
    op, value = next(iter(operand.items()))
    if op not in ("and", "or", "xor"):
        raise DocumentError(9016)
    if isinstance(value, bool) or not isinstance(value, int):
        raise DocumentError(10139)

    def leaf(col, dtype):
        if col is not None and not isinstance(dtype, (*INTEGERS, T.NullType)):
            raise DocumentError(10138)
        old = F.lit(0) if col is None else F.coalesce(_int32(col.cast("long")), F.lit(0))  # the low 32 bits of a long
        apply = {"and": Column.bitwiseAND, "or": Column.bitwiseOR, "xor": Column.bitwiseXOR}[op]
        kind = dtype if col is not None and isinstance(dtype, INTEGERS) else T.IntegerType()
        return apply(old, F.lit((value + 2**31) % 2**32 - 2**31)).cast(kind), kind

    return leaf


def _extreme(operand, largest: bool) -> Leaf:
    def leaf(col, dtype):
        new, kind = constant(operand)
        if col is None or isinstance(dtype, T.NullType):
            return new, kind
        from papyra.functions.order import type_code

        if type_code(dtype) != type_code(kind):  # kinds are ordered among each other
            wins = (type_code(kind) > type_code(dtype)) == largest
            if wins:
                raise DocumentError(20000, "a typed field cannot change its kind")
            # A missing field takes the operand, which this field's type cannot hold.
            return col, dtype
        whole = wider(dtype, kind)
        pick = F.greatest if largest else F.least  # both pass over nulls: a missing field takes the operand
        return pick(cast(col, dtype, whole), cast(new, kind, whole)), whole

    return leaf


def _array_leaf(code: int, make: Callable[[Column | None, T.DataType], Typed]) -> Leaf:
    def leaf(col, dtype):
        if col is not None and not isinstance(dtype, T.ArrayType | T.NullType):
            raise DocumentError(code)
        if col is not None and isinstance(dtype, T.NullType):
            col = None
        return make(col, dtype)

    return leaf


def _pop(operand) -> Leaf:
    if operand not in (1, -1):
        raise DocumentError(20000, "$pop takes 1 or -1")

    def make(col, dtype):
        if col is None:
            return F.lit(None), T.NullType()
        keep = F.greatest(F.size(col) - 1, F.lit(0))
        return F.slice(col, F.lit(1 if operand == 1 else 2), keep), dtype

    return _array_leaf(10143, make)


def _pull(values: list) -> Leaf:
    def make(col, dtype):
        if col is None:
            return F.lit(None), T.NullType()

        def keep(x):
            gone = test(In(tuple(values)), x, dtype.elementType) if len(values) != 1 else test(Eq(values[0]), x, dtype.elementType)
            return gone.neg if isinstance(gone, Cond) else F.lit(not gone)

        return F.filter(col, keep), dtype

    return _array_leaf(10142, make)


def _joined(col: Column | None, dtype: T.DataType, items: list) -> tuple[Column, Column, T.ArrayType]:
    """The old and the new elements in one type."""
    kind = infer(items)
    whole = T.ArrayType(wider(dtype.elementType, kind.elementType) if col is not None else kind.elementType)
    new = literal(items, whole)
    if new is None:
        raise DocumentError(20000, "the elements do not fit the array")
    old = F.array().cast(whole) if col is None else F.coalesce(cast(col, dtype, whole), F.array().cast(whole))
    return old, new, whole


def _push(operand) -> Leaf:
    each = isinstance(operand, Mapping) and "$each" in operand
    items = list(operand["$each"]) if each else [operand]
    size = operand.get("$slice") if each else None
    order = operand.get("$sort") if each else None
    if each and set(operand) - {"$each", "$slice", "$sort"}:
        raise DocumentError(20000, "$push takes $each, $slice and $sort")
    if order is not None and size is None:
        raise DocumentError(20000, "$sort needs $slice")

    def make(col, dtype):
        old, new, whole = _joined(col, dtype, items)
        if order is not None:
            if not isinstance(whole.elementType, T.StructType):
                raise DocumentError(20000, "$sort applies to arrays of objects")
            done = F.concat(new, old)
            fields = [(f, d) for f, d in dict(order).items() if f in whole.elementType.names]

            def compare(a, b):
                out = F.lit(0)
                for f, d in reversed(fields):
                    x, y = a.getField(f), b.getField(f)
                    less = F.coalesce(x < y, x.isNull() & y.isNotNull())
                    more = F.coalesce(x > y, x.isNotNull() & y.isNull())
                    out = F.when(less, -d).when(more, d).otherwise(out)
                return out

            done = F.array_sort(done, compare)
        else:
            done = F.concat(old, new)
        if size is not None:
            n = abs(int(size))
            if n == 0:
                done = F.slice(done, 1, 0)
            elif size > 0:
                done = F.slice(done, 1, n)
            else:
                done = F.slice(done, F.greatest(F.size(done) - n + 1, F.lit(1)), F.lit(n))
        return done, whole

    return _array_leaf(10141, make)


def _add_to_set(operand) -> Leaf:
    items = list(operand["$each"]) if isinstance(operand, Mapping) and "$each" in operand else [operand]

    def make(col, dtype):
        old, new, whole = _joined(col, dtype, items)
        fresh = F.filter(F.array_distinct(new), lambda x: ~F.exists(old, lambda y: y.eqNullSafe(x)))
        return F.concat(old, fresh), whole

    return _array_leaf(12591, make)


def _current_date(operand) -> Leaf:
    kind = operand.get("$type") if isinstance(operand, Mapping) else None
    if kind == "timestamp":
        raise DocumentError(29985)

    def leaf(col, dtype):
        if operand is not True and kind != "date":
            return (F.lit(None), T.NullType()) if col is None else (col, dtype)
        now = F.current_timestamp()
        return (now.cast(dtype), dtype) if col is not None and isinstance(dtype, T.TimestampNTZType) else (now, T.TimestampType())

    return leaf


LEAVES: dict[str, Callable] = {
    "$inc": _inc, "$mul": _mul, "$bit": _bit, "$max": lambda v: _extreme(v, True), "$min": lambda v: _extreme(v, False),
    "$pop": _pop, "$pull": lambda v: _pull([v]), "$pullAll": lambda v: _pull(list(v)), "$push": _push,
    "$addToSet": _add_to_set, "$currentDate": _current_date, "$set": lambda v: lambda col, dtype: constant(v),
    "$setOnInsert": lambda v: lambda col, dtype: constant(v),
    "$unset": lambda v: lambda col, dtype: (F.lit(None).cast(dtype), dtype),
}


# --- whole documents --------------------------------------------------------------------------


def is_operator_update(update: Mapping) -> bool:
    marked = [k.startswith("$") for k in update]
    if any(marked) and not all(marked):
        raise DocumentError(10147)
    return any(marked)


def validate(update: Mapping, id_field: str = "_id", on_insert: bool = False) -> None:
    """Static checks of an operator update."""
    paths: list[str] = []
    for op, fields in update.items():
        if op not in OPERATORS:
            raise DocumentError(10148, op)
        if not isinstance(fields, Mapping) or not fields:
            raise DocumentError(26840, op)
        for path, value in fields.items():
            if op == "$rename":
                if not isinstance(value, str):
                    raise DocumentError(13494, path)
                paths.append(value)
            if path.split(".")[0] == id_field and not (op in ("$set", "$setOnInsert") and path == id_field):
                raise DocumentError(20010, path)
            paths.append(path)
    for i, a in enumerate(sorted(paths)):
        for b in sorted(paths)[i + 1 :]:
            if a == b:
                raise DocumentError(10150, a)
            if b.startswith(f"{a}."):
                raise DocumentError(10151, b)


def new_fields(df: DataFrame, update: Mapping, on_insert: bool = False, id_field: str = "_id") -> dict[str, Typed]:
    """The changed top-level fields of the documents of ``df``, as if each of them matched."""
    validate(update, id_field)
    made: dict[str, Typed] = {n: (F.col(f"`{n}`"), df.schema[n].dataType) for n in df.columns}
    old = dict(made)

    def put(path: str, leaf: Leaf, create: bool) -> None:
        head, *rest = path.split(".")
        col, dtype = made.get(head, (None, T.NullType()))
        if col is None and not create:
            return
        made[head] = modify(col, dtype, rest, leaf, create)

    for op, fields in update.items():
        for path, value in fields.items():
            if op == "$setOnInsert" and not on_insert:
                continue
            if op == "$rename":
                head, *rest = path.split(".")
                if head not in old:
                    continue
                moved: list[Typed] = []
                modify(*old[head], rest, lambda c, d: moved.append((c, d)) or (c, d), False)  # noqa: B023
                if not moved:
                    continue
                source, kind = moved[0]

                def target(col, dtype, source=source, kind=kind):
                    if col is None:
                        return source, kind
                    whole = wider(dtype, kind)  # a document without the field keeps its target
                    return F.when(source.isNotNull(), cast(source, kind, whole)).otherwise(cast(col, dtype, whole)), whole

                put(value, target, True)
                put(path, LEAVES["$unset"](None), False)
                continue
            put(path, LEAVES[op](value), op in CREATING or op == "$setOnInsert")
    return {n: t for n, t in made.items() if n not in old or t is not old[n]}


def apply_update(df: DataFrame, hit: Column, update: Mapping, id_field: str = "_id") -> DataFrame:
    """The documents after an update of the rows for which ``hit`` (never NULL) holds."""
    if not is_operator_update(update):
        return replace(df, hit, update, id_field)
    changed = new_fields(df, update, id_field=id_field)
    columns = []
    for name in [*df.columns, *(n for n in changed if n not in df.columns)]:
        if name not in changed:
            columns.append(F.col(f"`{name}`"))
            continue
        new, kind = changed[name]
        if name not in df.columns:
            columns.append(F.when(hit, new).alias(name))
            continue
        if name == id_field:
            columns.append(F.when(hit & ~new.eqNullSafe(F.col(name)), F.raise_error(F.lit("20010: the _id of a document cannot change")).cast(kind)).otherwise(F.col(name)).alias(name))
            continue
        have = df.schema[name].dataType
        whole = wider(have, kind) if not isinstance(kind, T.NullType) else have
        columns.append(F.when(hit, cast(new, kind, whole)).otherwise(cast(F.col(f"`{name}`"), have, whole)).alias(name))
    return df.select(*columns)


def replace(df: DataFrame, hit: Column, document: Mapping, id_field: str = "_id") -> DataFrame:
    """Full replacement: the id stays, every other field is the document's or gone."""
    columns = []
    for name in [*df.columns, *(n for n in document if n not in df.columns)]:
        if name == id_field:
            same = F.lit(True)
            if id_field in document:
                lit = literal(document[id_field], df.schema[name].dataType)
                same = F.lit(False) if lit is None else F.col(name).eqNullSafe(lit)
            columns.append(F.when(hit & ~same, F.raise_error(F.lit("16836: the _id of a document cannot change")).cast(df.schema[name].dataType)).otherwise(F.col(name)).alias(name))
            continue
        new, kind = constant(document.get(name))
        if name not in df.columns:
            columns.append(F.when(hit, new).alias(name))
            continue
        have = df.schema[name].dataType
        whole = wider(have, kind)
        fits = literal(document.get(name), whole)
        columns.append(F.when(hit, fits if fits is not None else cast(new, kind, whole)).otherwise(cast(F.col(f"`{name}`"), have, whole)).alias(name))
    return df.select(*columns)


def seed(selector: Mapping) -> dict:
    """The document that an upsert starts from: the equality parts of its selector."""
    comparison = ("$eq", "$gt", "$gte", "$lt", "$lte", "$ne", "$in", "$nin")
    logical, other = ("$and", "$or", "$nor"), ("$not", "$exists", "$type", "$mod", "$regex", "$options", "$where", "$text", "$elemMatch", "$size")
    out: dict = {}

    def put(path: str, value) -> None:
        at = out
        *parents, leaf = path.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[leaf] = value

    def logic(op: str, parts) -> None:
        if not isinstance(parts, list | tuple):
            raise DocumentError(10149, op)
        if op == "$nor" or op == "$or" and len(parts) > 1:
            return
        for part in parts:
            if isinstance(part, Mapping):
                top(part)

    def top(query: Mapping) -> None:
        for key, value in query.items():
            if key in logical:
                logic(key, value)
            elif key.startswith("$"):
                raise DocumentError(10149, key)
            elif isinstance(value, re.Pattern):
                continue
            elif isinstance(value, Mapping) and any(k.startswith("$") for k in value):
                for op, v in value.items():
                    if op in logical:
                        raise DocumentError(10159, op)
                    if op == "$eq":
                        put(key, v)
                    elif op == "$all":
                        if not isinstance(v, list | tuple) or len(v) > 1:
                            raise DocumentError(10149, op)
                        if v:
                            put(key, v[0])
                    elif op == "$in" and not isinstance(v, list | tuple):
                        raise DocumentError(10149, op)
                    elif op not in comparison + other:
                        raise DocumentError(10149, op)
            else:
                put(key, value)

    top(selector)
    return out


# --- VARIANT documents ------------------------------------------------------------------------


def apply_variant_update(df: DataFrame, hit: Column, update: Mapping, variant: str, id_field: str = "_id") -> DataFrame:
    """The VARIANT documents of a column after an update of the rows for which ``hit`` (never NULL) holds.

    All operators and replacement; a field may change its kind. Paths lead through objects and, by numbers, to places of
    arrays, which grow with nulls up to the place; another value on the way stays as it is.
    """
    held = F.col(f"`{variant}`")
    if not is_operator_update(update):
        new = variant_leaves.literal({k: v for k, v in update.items() if k != id_field})
        keep = variants.field(held, id_field)
        return df.withColumn(variant, F.when(hit, variants.put(new, [id_field], lambda _: keep)).otherwise(held))
    validate(update, id_field)
    matched = "__hit"
    while matched in df.columns:
        matched += "_"
    out = df.withColumn(matched, hit)  # of the old documents
    for op, fields in update.items():
        for path, value in fields.items():
            if op != "$setOnInsert":  # which leaves documents that are there as they are
                # A projection each: Spark resolves functions of functions by one level a pass, in a bounded number of passes.
                out = out.withColumn(variant, F.when(F.col(matched), _variant_changed(held, op, path.split("."), value)).otherwise(held))
    return out.drop(matched)


def _variant_changed(v: Column, op: str, parts: list[str], value) -> Column:
    if op == "$unset":
        return _variant_unset(v, parts)
    if op == "$rename":
        return _variant_rename(v, parts, value.split("."))
    leaf, creates = variant_leaves.LEAVES[op]
    return variants.put(v, parts, leaf(value)) if creates else _variant_where_there(v, parts, leaf(value))


def _variant_there(v: Column, parts: list[str]) -> Column:
    for p in parts:
        v = variants.part(v, p)
    return v


def _variant_where_there(v: Column, parts: list[str], make: variant_leaves.Make) -> Column:
    """``make`` of the value at a path; nothing is made on the way to one that is missing."""
    return variants.bound(v, lambda v: F.when(_variant_there(v, parts).isNull(), v).otherwise(variants.put(v, parts, make)))


def _variant_unset(v: Column, parts: list[str]) -> Column:
    """Without the field."""
    return _variant_where_there(v, parts, lambda _: F.lit(None).cast("variant"))


def _variant_rename(v: Column, old: list[str], new: list[str]) -> Column:
    def moved(v: Column) -> Column:
        to = lambda source: variants.put(_variant_unset(v, old), new, lambda _: source)
        return variants.bound(_variant_there(v, old), lambda source: F.when(source.isNull(), v).otherwise(to(source)))

    return variants.bound(v, moved)
