"""Secondary indexes: definitions, entries, the check of unique ones, and which conditions an index can answer."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.errors import DocumentError
from papyra.functions.paths import value_at, values_of
from papyra.plans.ast import And, Any, Eq, In, Node, Or, Range


#: Most entries of one document in an index of several fields.
MAX_ENTRIES = 1000


@dataclass(frozen=True)
class Index:
    name: str
    fields: tuple[tuple[str, int], ...]
    unique: bool = False
    status: str = "ready"

    @staticmethod
    def of(spec: Mapping, id_field: str = "_id") -> Index | None:
        """The definition in a spec document; ``None`` for the index that every collection has."""
        key = spec["key"]
        key = {key: 1} if isinstance(key, str) else dict(key)
        if any(v == "text" for v in key.values()):
            raise DocumentError(29969)
        if any(v not in (1, -1) for v in key.values()):
            raise DocumentError(29991)
        if len(set(key.values())) > 1:
            raise DocumentError(29990)
        if id_field in key:
            if len(key) > 1:
                raise DocumentError(29982)
            return None
        if not spec.get("name"):
            raise DocumentError(29967)
        if spec.get("unique") and spec.get("background"):
            raise DocumentError(20005)
        return Index(spec["name"], tuple(key.items()), bool(spec.get("unique")))

    @property
    def keys(self) -> list[str]:
        """The key columns of the entries."""
        return [f"k{n}" for n in range(len(self.fields))]

    def document(self) -> dict:
        return {"name": self.name, "key": dict(self.fields), "unique": self.unique, "status": self.status}


def entries(df: DataFrame, index: Index, id_field: str = "_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row ``k0, k1, ..., id`` for each distinct combination of the values of a document; the columns ``keep`` come along.

    A document without a value at a path has a null entry there. More than ``MAX_ENTRIES`` of one document
    in an index of several fields are an error (29992).
    """
    out = df
    for n, (path, _) in enumerate(index.fields):
        head, *rest = path.split(".")
        found = None
        if head in df.columns:
            found = values_of(F.col(f"`{head}`"), df.schema[head].dataType, rest, True)
        values, kind = found or (F.array().cast("array<string>"), T.StringType())
        nothing = F.array(F.lit(None).cast(kind))
        out = out.withColumn(f"__k{n}", F.when(F.size(values) > 0, F.array_distinct(values)).otherwise(nothing))
    if len(index.fields) > 1:
        product = reduce(Column.__mul__, [F.size(f"__k{n}").cast("double") for n in range(len(index.fields))])
        first = F.when(product > MAX_ENTRIES, F.raise_error(F.lit("29992"))).otherwise(F.col("__k0"))
        out = out.withColumn("__k0", first)
    for n in range(len(index.fields)):
        out = out.withColumn(f"__k{n}", F.explode(f"__k{n}"))
    return out.select(*[F.col(f"__k{n}").alias(k) for n, k in enumerate(index.keys)], F.col(id_field).alias("id"), *keep)


def violations(df: DataFrame, index: Index, id_field: str = "_id") -> DataFrame:
    """Keys of a unique index that more than one document has; null counts as a value."""
    return repeated(entries(df, index, id_field), index)


def repeated(found: DataFrame, index: Index) -> DataFrame:
    """Keys of entries with more than one id."""
    # The smallest and the largest id are aggregated before the shuffle, whatever one key's share is.
    grouped = found.groupBy(*index.keys).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    return grouped.filter("a <> b").drop("a", "b")


def _bounds(term: Node) -> bool:
    """Whether a predicate on one value holds for scalars alone that are not null, so that an entry tells it."""
    scalar = lambda v: v is not None and not isinstance(v, list | tuple | Mapping)
    if isinstance(term, Eq):
        return scalar(term.value)
    if isinstance(term, In):
        return all(map(scalar, term.values))
    if isinstance(term, Range):
        return all(scalar(v) for v in (term.low, term.high) if v is not None)
    return isinstance(term, And) and all(map(_bounds, term.terms))


def _typed(df: DataFrame, path: str) -> bool:
    """Whether entries hold all that a filter finds at the path: no place in an array, no map, no VARIANT."""
    head, *rest = path.split(".")
    if head not in df.columns or any(p.isdigit() for p in rest):
        return False
    found = values_of(F.col(f"`{head}`"), df.schema[head].dataType, rest, True)
    return found is not None and not isinstance(found[1], T.VariantType | T.MapType)


def usable(node: Node, indexes: list[Index], id_field: str = "_id", df: DataFrame | None = None) -> dict:
    """The access that a plan takes: the id, an index, several of them, or the whole collection.

    A condition on the id wins; then the index with the fewest fields, then by name. With ``df``, the
    documents, paths whose entries would not tell all matches are left to the whole collection.
    """
    terms = node.terms if isinstance(node, And) else (node,)
    bounded = {t.path for t in terms if isinstance(t, Any) and _bounds(t.term)}
    if id_field in bounded:
        return {"type": "primary key lookup"}
    for index in sorted((i for i in indexes if i.status == "ready"), key=lambda i: (len(i.fields), i.name)):
        prefix = []
        for path, _ in index.fields:
            if path not in bounded or df is not None and not _typed(df, path):
                break
            prefix.append(path)
        if prefix:
            return {"type": "index scan", "index": index.name, "fields": prefix}
    if isinstance(node, Or):
        parts = [usable(t, indexes, id_field, df) for t in node.terms]
        if all(p["type"] != "table scan" for p in parts):
            return {"type": "union", "plans": parts}
    return {"type": "table scan"}


def lookups(node: Node, indexes: list[Index], df: DataFrame, id_field: str = "_id") -> list[tuple[Index, Node]] | None:
    """Indexes with a predicate on their entries; every matching document has an entry that satisfies one of them.

    ``None`` where the access is another one.
    """
    access = usable(node, indexes, id_field, df)
    if access["type"] == "union":
        parts = [lookups(t, indexes, df, id_field) for t in node.terms]
        return None if any(p is None for p in parts) else [x for p in parts for x in p]
    if access["type"] != "index scan":
        return None
    index = next(i for i in indexes if i.name == access["index"])
    terms = node.terms if isinstance(node, And) else (node,)
    wanted = []
    for key, path in zip(index.keys, access["fields"], strict=False):
        on = [t.term for t in terms if isinstance(t, Any) and t.path == path and _bounds(t.term)]
        if isinstance(value_at(df, path)[1], T.ArrayType):  # two conditions may hold for two elements, so for two entries
            on = sorted(on, key=lambda t: not isinstance(t, Eq))[:1]
        wanted += [Any(key, t) for t in on]
    return [(index, And(tuple(wanted)))]
