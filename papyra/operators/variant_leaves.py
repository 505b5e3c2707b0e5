"""What an update operator makes of one VARIANT value: functions of the old value, NULL for none, to the new one.

They follow the typed operators of the same names, but a field may take any kind; a value that an operator does
not apply to is an error of the statement.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.errors import DocumentError
from papyra.functions.order import variant_rank
from papyra.functions.variants import bound, elements, equal_key

Make = Callable[[Column], Column]


def literal(value) -> Column:
    if isinstance(value, datetime.date | bytes | bytearray):
        return F.lit(bytes(value) if isinstance(value, bytearray) else value).cast("variant")
    return F.parse_json(F.lit(json.dumps(value, ensure_ascii=False)))


def _wrong(code: int, text: str) -> Column:
    return F.raise_error(F.lit(f"{code}: {text}")).cast("variant")


def _arithmetic(value, missing, code: int, name: str, apply, exact) -> Make:
    """``apply`` on doubles; on whole numbers ``exact``, and beyond the ends of 64 bits they start again at the other end."""
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise DocumentError(16840)
    half, turn = (F.lit(str(2**k)).cast("decimal(21,0)") for k in (63, 64))
    number = lambda k: k.isin("DOUBLE", "FLOAT") | k.startswith("DECIMAL")

    def of_kind(old: Column, kind: Column) -> Column:
        double = apply(F.try_variant_get(old, "$", "double"), F.lit(float(value))).cast("variant")
        whole = double
        if isinstance(value, int):
            by = (value + 2**63) % 2**64 - 2**63
            big = F.try_variant_get(old, "$", "bigint")
            wide = apply(big.cast("decimal(19,0)"), F.lit(str(by)).cast("decimal(19,0)"))
            around = F.pmod(wide + half, turn) - half
            whole = F.coalesce(exact(big, F.lit(by).cast("bigint")), around.try_cast("bigint")).cast("variant")
        return F.when(old.isNull(), literal(missing)).when(kind == "BIGINT", whole).when(number(kind), double).otherwise(_wrong(code, f"{name} needs a number"))

    return lambda old: bound(F.schema_of_variant(old), lambda kind: of_kind(old, kind))


def inc(value) -> Make:
    return _arithmetic(value, value, 10140, "$inc", lambda a, b: a + b, F.try_add)


def mul(value) -> Make:
    return _arithmetic(value, 0, 16837, "$mul", lambda a, b: a * b, F.try_multiply)


def bit(value) -> Make:
    if not isinstance(value, Mapping) or len(value) != 1 or next(iter(value)) not in ("and", "or", "xor"):
        raise DocumentError(9016)
    op, by = next(iter(value.items()))
    if isinstance(by, bool) or not isinstance(by, int):
        raise DocumentError(10139)
    apply = {"and": Column.bitwiseAND, "or": Column.bitwiseOR, "xor": Column.bitwiseXOR}[op]

    def make(old: Column) -> Column:
        low = F.shiftright(F.shiftleft(F.try_variant_get(old, "$", "bigint"), 32), 32).cast("int")  # the low 32 bits, as for typed longs
        new = apply(F.coalesce(low, F.lit(0)), F.lit((by + 2**31) % 2**32 - 2**31)).cast("variant")
        return F.when(old.isNull() | (F.schema_of_variant(old) == "BIGINT"), new).otherwise(_wrong(10138, "$bit needs a whole number"))

    return make


def extreme(value, largest: bool) -> Make:
    def make(old: Column) -> Column:
        new = literal(value)
        have, want = variant_rank(old), variant_rank(new)
        return F.when(old.isNull() | (want > have if largest else want < have), new).otherwise(old)

    return make


def current_date(_) -> Make:
    return lambda old: F.current_timestamp().cast("variant")


def _on_array(code: int, name: str, change: Callable[[Column], Column], missing: Column | None) -> Make:
    """A missing array is ``missing``; an explicit null is no array."""

    def make(old: Column) -> Column:
        held = elements(old) if missing is None else F.when(old.isNull(), missing).otherwise(elements(old))
        wrong = F.when(old.isNotNull(), _wrong(code, f"{name} applies to arrays only"))
        return bound(held, lambda held: F.when(held.isNotNull(), F.to_variant_object(change(held))).otherwise(wrong))

    return make


def _items(values: list) -> Column:
    return F.array(*map(literal, values)) if values else F.expr("cast(array() as array<variant>)")


def pop(value) -> Make:
    if value not in (1, -1):
        raise DocumentError(20000, "$pop takes 1 or -1")
    keep = lambda held: F.slice(held, F.lit(1 if value == 1 else 2), F.greatest(F.size(held) - 1, F.lit(0)))
    return _on_array(10143, "$pop", keep, None)


def pull(values: list) -> Make:
    gone = [equal_key(literal(v)) for v in values]
    keep = lambda held: F.filter(held, lambda x: ~equal_key(x).isin(*gone)) if gone else held
    return _on_array(10142, "$pull", keep, None)


def push(value) -> Make:
    each = isinstance(value, Mapping) and "$each" in value
    items = list(value["$each"]) if each else [value]
    size, order = (value.get("$slice"), value.get("$sort")) if each else (None, None)
    if each and set(value) - {"$each", "$slice", "$sort"}:
        raise DocumentError(20000, "$push takes $each, $slice and $sort")
    if order is not None and size is None:
        raise DocumentError(20000, "$sort needs $slice")

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, direction in reversed(dict(order).items()):
            place = "$['" + name.replace("'", "\\'") + "']"
            x, y = (variant_rank(F.try_variant_get(v, place, "variant")) for v in (a, b))
            out = F.when(x < y, -direction).when(x > y, direction).otherwise(out)
        return out

    def change(held: Column) -> Column:
        if order is not None:
            done = F.array_sort(F.concat(_items(items), held), compare)
        else:
            done = F.concat(held, _items(items))
        if size is None:
            return done
        n = abs(int(size))
        if n == 0 or size > 0:
            return F.slice(done, 1, n)
        return F.slice(done, F.greatest(F.size(done) - n + 1, F.lit(1)), F.lit(n))

    return _on_array(10141, "$push", change, _items([]))


def add_to_set(value) -> Make:
    items = list(value["$each"]) if isinstance(value, Mapping) and "$each" in value else [value]

    def change(held: Column) -> Column:
        def added(out: Column, item: Column) -> Column:
            equal = lambda key: F.exists(out, lambda x: equal_key(x) == key)
            return F.when(bound(equal_key(item), equal), out).otherwise(F.concat(out, F.array(item)))

        return F.aggregate(_items(items), held, added)  # one after the other, so that equal new ones are added once

    return _on_array(12591, "$addToSet", change, _items([]))


#: By operator: the function of its operand, and whether a missing field is made.
LEAVES: dict[str, tuple[Callable[..., Make], bool]] = {
    "$set": (lambda value: lambda _: literal(value), True),
    "$inc": (inc, True),
    "$mul": (mul, True),
    "$bit": (bit, True),
    "$min": (lambda value: extreme(value, False), True),
    "$max": (lambda value: extreme(value, True), True),
    "$currentDate": (current_date, True),
    "$push": (push, True),
    "$addToSet": (add_to_set, True),
    "$pop": (pop, False),
    "$pull": (lambda value: pull([value]), False),
    "$pullAll": (lambda value: pull(list(value)), False),
}
