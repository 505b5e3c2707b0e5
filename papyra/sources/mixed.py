"""Collections whose fields may hold any kind: one VARIANT column holds the whole document."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.errors import DocumentError
from papyra.functions import variants
from papyra.operators import find as finding
from papyra.operators import update as updating
from papyra.operators.variant_leaves import literal
from papyra.sources.store import ID, Collection, Version, new_id

DOC, KEY = "doc", "__key"


class MixedCollection(Collection):
    """The statements of a collection on documents of any shape.

    Documents come as dictionaries or as a DataFrame with a VARIANT column ``doc``; results are VARIANT documents in
    ``doc``. Ids of any kind but arrays tell documents apart, numbers by value; a text of the id is stored beside the
    document, so that a lookup by a plain id and the check of ids read that column. Explicit nulls and missing fields
    differ. Indexes need typed collections (error 11002).
    """

    key, variant = KEY, DOC
    empty = T.StructType([T.StructField(KEY, T.StringType()), T.StructField(DOC, T.VariantType())])

    def _matches(self, version: Version, query) -> DataFrame:
        df = self._frame(version)
        wanted = (finding.unwrap(query)[0] or {}).get(ID)
        if isinstance(wanted, str | int | float):  # reaches the Parquet scan
            df = df.filter(F.col(KEY) == variants.equal_key(literal(wanted)))
        return df

    def _find(self, df: DataFrame, query=None, projection=None, sort=None, skip: int = 0, limit: int = 0) -> DataFrame:
        return super()._find(df, query, projection, sort, skip, limit).select(DOC)

    def _frame_of(self, documents: DataFrame | list[dict]) -> DataFrame:
        if not isinstance(documents, DataFrame):
            for d in documents:
                if any(k.startswith("$") for k in d):
                    raise DocumentError(15896)
                if isinstance(d.get(ID), list | tuple):
                    raise DocumentError(29999)
            rows = [(json.dumps(d, ensure_ascii=False),) for d in documents]
            documents = self.spark.createDataFrame(rows, "json string").select(F.parse_json("json").alias(DOC))
        own = variants.field(F.col(DOC), ID)
        made = F.when(own.isNull(), variants.put(F.col(DOC), [ID], lambda _: new_id().cast("variant"))).otherwise(F.col(DOC))
        return _keyed(documents.select(made.alias(DOC)))

    def _changed(self, df: DataFrame, hit: Column, update: Mapping) -> DataFrame:
        return updating.apply_variant_update(df, hit, update, DOC, ID)

    def _upsert(self, query: Mapping, update: Mapping, operators: bool) -> tuple[DataFrame, object]:
        document = updating.seed(query) if operators else dict(update)
        wanted = query.get(ID)
        if not operators and ID in query and not isinstance(wanted, Mapping):
            if ID in document and document[ID] != wanted:
                raise DocumentError(20010)
            document[ID] = wanted
        for op in ("$set", "$setOnInsert") if operators else ():
            if ID in update.get(op, {}):
                document.setdefault(ID, update[op][ID])
                break
        row = self._frame_of([document])
        if operators:
            own = {("$set" if op == "$setOnInsert" else op, k): v for op, f in update.items() for k, v in f.items() if k != ID}
            for (op, k), v in own.items():
                row = self._changed(row, F.lit(True), {op: {k: v}})
        row = self.spark.createDataFrame(row.select(KEY, F.to_json(DOC).alias("json")).collect(), "key string, json string")  # one row; its new id is fixed here
        row = row.select(F.col("key").alias(KEY), F.parse_json("json").alias(DOC))
        return row, json.loads(row.select(F.to_json(variants.field(F.col(DOC), ID))).first()[0])

    def create_index(self, spec: Mapping) -> bool:
        raise DocumentError(11002, "an index of VARIANT documents")


def _keyed(df: DataFrame) -> DataFrame:
    own = variants.field(F.col(DOC), ID)
    wrong = F.raise_error(F.lit("29999: an _id is not an array")).cast("string")
    key = F.when(F.schema_of_variant(own).startswith("ARRAY"), wrong).otherwise(variants.equal_key(own))
    return df.select(key.alias(KEY), DOC)
