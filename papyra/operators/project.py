"""Projection documents: which fields of a document are returned."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.errors import DocumentError
from papyra.functions.variants import exclude, include


def _tree(spec: Mapping, id_field: str) -> tuple[bool | None, dict, bool | None]:
    """``(inclusive, tree of the paths, whether the id is asked for)``."""
    inclusive: bool | None = None
    tree: dict = {}
    id_wanted: bool | None = None
    for path, value in spec.items():
        if isinstance(value, Mapping) or path.endswith(".$"):
            raise DocumentError(17288, path)
        wanted = bool(value)
        if path == id_field:
            id_wanted = wanted
            continue
        if path.split(".")[0] == id_field:
            continue  # an id is given as a whole or not at all
        if inclusive is None:
            inclusive = wanted
        elif inclusive != wanted:
            raise DocumentError(17288, "inclusions and exclusions are mixed")
        at = tree
        *parents, leaf = path.split(".")
        for p in parents:
            at = at.setdefault(p, {})
            if at is None:
                break
        if at is not None:
            at[leaf] = None
    if inclusive is None and id_wanted:
        inclusive = True
    return inclusive, tree, id_wanted


def _include(col: Column, dtype: T.DataType, tree: dict | None) -> Column | None:
    """The part of a value that the tree keeps; ``None``: nothing can be kept of a scalar."""
    if tree is None:
        return col
    if isinstance(dtype, T.StructType):
        kept = [(n, _include(col.getField(n), dtype[n].dataType, tree[n])) for n in dtype.names if n in tree]
        kept = [c.alias(n) for n, c in kept if c is not None]
        return F.when(col.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(dtype, T.ArrayType):
        kind = dtype.elementType
        if not isinstance(kind, T.StructType | T.ArrayType) or _include(col, kind, tree) is None:
            return F.slice(col, 1, 0)  # scalars vanish under a partial inclusion
        return F.transform(F.filter(col, lambda x: x.isNotNull()), lambda x: _include(x, kind, tree))
    return None


def _exclude(col: Column, dtype: T.DataType, tree: dict) -> Column | None:
    if isinstance(dtype, T.StructType):
        kept = []
        for n in dtype.names:
            if n not in tree:
                kept.append(col.getField(n).alias(n))
            elif tree[n] is not None:
                inner = _exclude(col.getField(n), dtype[n].dataType, tree[n])
                if inner is not None:
                    kept.append(inner.alias(n))
        return F.when(col.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, T.StructType | T.ArrayType):
            if _exclude(col, dtype.elementType, tree) is None:
                return F.slice(col, 1, 0)
            return F.transform(col, lambda x: _exclude(x, dtype.elementType, tree))
    return col


def _within(col: Column, tree: dict, inclusive: bool | None, id_wanted: bool | None, id_field: str) -> Column | None:
    """A VARIANT document with the projected paths; ``None``: no path asks for any of it."""
    if inclusive:
        own = {id_field: None} if id_wanted is not False else {}
        return include(col, {**own, **tree}) if tree else None
    own = {id_field: None} if id_wanted is False else {}
    return exclude(col, {**own, **tree}) if own or tree else col


def project(df: DataFrame, spec: Mapping | None, id_field: str = "_id", variant: str | None = None) -> DataFrame:
    """Apply a projection document; whole columns that are not kept are never read.

    Paths that start with no column are those of the documents in the column ``variant``.
    """
    if not spec:
        return df
    inclusive, tree, id_wanted = _tree(spec, id_field)
    inner = {n: t for n, t in tree.items() if n not in df.columns}
    columns = []
    for name in df.columns:
        col, dtype = F.col(f"`{name}`"), df.schema[name].dataType
        if name == variant and name not in tree:
            kept = _within(col, inner, inclusive, None if id_field in df.columns else id_wanted, id_field)
            if kept is not None:
                columns.append(kept.alias(name))
        elif name == id_field:
            if id_wanted is not False:
                columns.append(col)
        elif inclusive:
            if name in tree:
                kept = _include(col, dtype, tree[name])
                if kept is not None:
                    columns.append(kept.alias(name))
        elif name not in tree:
            columns.append(col)
        elif tree[name] is not None:
            kept = _exclude(col, dtype, tree[name])
            if kept is not None:
                columns.append(kept.alias(name))
    return df.select(*columns)
