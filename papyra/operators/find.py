"""Find, count and distinct over any DataFrame of documents."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.order import sort_keys, variant_sort_keys
from papyra.functions.paths import value_at, values_of
from papyra.functions.variants import equal_key, values_at
from papyra.operators.project import project
from papyra.plans.compile import Cond, condition
from papyra.plans.parser import parse
from papyra.plans.simplify import simplify


def matching(df: DataFrame, query: Mapping | None, variant: str | None = None) -> Cond:
    return condition(simplify(parse(query, top=True)), df, variant)


def match(df: DataFrame, query: Mapping | None, variant: str | None = None) -> DataFrame:
    """The documents that satisfy a filter; it works on streams as well."""
    return df.filter(matching(df, query, variant).pos) if query else df


def sort_by(df: DataFrame, sort: Mapping[str, int] | Sequence[tuple[str, int]], variant: str | None = None) -> DataFrame:
    keys: list[Column] = []
    for path, direction in dict(sort).items():
        if variant is not None and path.split(".")[0] not in df.columns:
            place = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
            keys += variant_sort_keys(F.try_variant_get(F.col(f"`{variant}`"), place, "variant"), direction)
            continue
        col, dtype = value_at(df, path)
        keys += sort_keys(col, dtype, direction) if not isinstance(dtype, T.NullType) else []
    return df.orderBy(*keys) if keys else df


def unwrap(query: Mapping | None) -> tuple[Mapping | None, Mapping | None]:
    """Filter and sort of a wrapped query (``$query``/``query`` with ``$orderby``/``orderby``); hints and ``$explain`` are left out."""
    marks = ("$query", "$orderby", "$explain", "$hint")
    if not query or not (any(m in query for m in marks) or "query" in query and "orderby" in query):
        return query, None
    inner = query.get("$query", query.get("query"))
    if inner is None:
        inner = {k: v for k, v in query.items() if k not in (*marks, "orderby")}
    return inner, query.get("$orderby", query.get("orderby"))


def find(
    df: DataFrame, query: Mapping | None = None, projection: Mapping | None = None, sort=None, skip: int = 0,
    limit: int = 0, id_field: str = "_id", variant: str | None = None,
) -> DataFrame:
    """Filter, sort, skip, limit (0: none; a negative limit counts as its absolute value), project."""
    query, order = unwrap(query)
    sort = sort or order
    found = match(df, query, variant)
    if sort:
        found = sort_by(found, sort, variant)
    if skip:
        found = found.offset(skip)
    if limit:
        found = found.limit(abs(limit))
    return project(found, projection, id_field, variant)


def count(df: DataFrame, query: Mapping | None = None, skip: int = 0, limit: int = 0, variant: str | None = None) -> DataFrame:
    """One row ``n``: the matches minus ``skip`` (never below 0), at most ``limit`` if there is one."""
    n = F.greatest(F.count("*") - F.lit(skip), F.lit(0))
    n = F.least(n, F.lit(abs(limit))) if limit else n
    return match(df, query, variant).agg(n.cast("long").alias("n"))


def distinct(df: DataFrame, path: str, query: Mapping | None = None, variant: str | None = None) -> DataFrame:
    """One column ``value``: the distinct values at a path, arrays taken apart one level, in their order.

    Missing values are no values. All values of a document count. In VARIANT documents the values are VARIANT, and
    numbers that are equal are one value; of these the one with the smallest text stays.
    """
    found = match(df, query, variant)
    head, *rest = path.split(".")
    if variant is not None and head not in df.columns:
        every = found.select(F.explode(values_at(F.col(f"`{variant}`"), [head, *rest])).alias("value"))
        one = every.groupBy(equal_key(F.col("value")).alias("key")).agg(F.min_by("value", F.to_json("value")).alias("value"))
        return one.select("value").orderBy(*variant_sort_keys(F.col("value"), 1))
    values = None
    if head in df.columns:
        values = values_of(F.col(f"`{head}`"), df.schema[head].dataType, rest, False)
    if values is None:
        return found.select(F.lit(None).cast("string").alias("value")).limit(0)
    return found.select(F.explode(values[0]).alias("value")).distinct().orderBy(F.col("value").asc_nulls_first())


class Cursor:
    """Results in batches, as a client asks for them; only one partition at a time is on the driver."""

    FIRST, LATER = 101, 1000

    def __init__(self, df: DataFrame, batch_size: int = 0):
        self._rows: Iterator | None = df.toLocalIterator(prefetchPartitions=True)
        self._size, self._first = batch_size, True

    def next_batch(self) -> list:
        if self._rows is None:
            return []
        size = self._size or (self.FIRST if self._first else self.LATER)
        self._first = False
        out = [r for _, r in zip(range(size), self._rows, strict=False)]
        if len(out) < size:
            self.close()
        return out

    @property
    def alive(self) -> bool:
        return self._rows is not None

    def close(self) -> None:
        self._rows = None

    def __iter__(self):
        while self.alive:
            yield from self.next_batch()
