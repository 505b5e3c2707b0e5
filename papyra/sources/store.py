"""Databases of mutable collections over Parquet files.

A collection is a folder of data files and of numbered version files. A version names the data files
that belong to it, its schema and its indexes. Reading takes the files of the newest version, so a
query sees one unchanging snapshot. Writing adds data files and then one version file, which fails
if another writer has taken the number; the statement then runs again on the newer version.

An update or a delete rewrites only the data files that hold a matching document; the others stay in the
next version as they are. Old files stay readable for running queries until ``vacuum``.

Inserted documents are clustered by id. The entries of an index are files sorted by key, written for the new data
files of a version only; each entry names its data file. A find, an update or a delete with a condition on indexed
paths reads the data files that the entries name, and new keys of a unique index are compared with the entries.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.errors import DocumentError
from papyra.operators import find as finding
from papyra.operators import update as updating
from papyra.operators.index import Index, entries, lookups, repeated, usable
from papyra.plans.ast import describe
from papyra.plans.compile import condition
from papyra.plans.parser import parse
from papyra.plans.simplify import simplify
from papyra.sources.files import Files

ID = "_id"
RETRIES = 20
_FILE = "__papyra_file"
_ID_SCHEMA = T.StructType([T.StructField(ID, T.StringType())])


class Conflict(Exception):
    """Another writer has published the version first."""


@dataclass
class Version:
    number: int = 0
    files: list[str] = field(default_factory=list)
    schema: T.StructType = field(default_factory=lambda: _ID_SCHEMA)
    indexes: list[Index] = field(default_factory=list)
    #: The newest batch of every stream that was inserted.
    batches: dict[str, int] = field(default_factory=dict)
    #: By index the folders of its entries, each with the data files that it covers.
    entries: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    #: By data folder the schema, as JSON, to read it with, where a field has taken another type since it was written.
    schemas: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        indexes = [[i.name, list(map(list, i.fields)), i.unique, i.status] for i in self.indexes]
        rest = {"indexes": indexes, "batches": self.batches, "entries": self.entries, "schemas": self.schemas}
        return json.dumps({"files": self.files, "schema": self.schema.jsonValue(), **rest})

    @staticmethod
    def read(number: int, text: str) -> Version:
        x = json.loads(text)
        indexes = [Index(n, tuple((p, d) for p, d in f), *more) for n, f, *more in x["indexes"]]
        return Version(number, x["files"], T.StructType.fromJson(x["schema"]), indexes, x["batches"], x["entries"], x["schemas"])

    def then(self, files: list[str], schema: T.StructType) -> Version:
        """The next version, without entries; folders that a reader cannot read by the new schema keep theirs."""
        new = Version(self.number + 1, files, schema, self.indexes, self.batches)
        before, fits = {f.split("/")[0] for f in self.files}, _fits(self.schema, schema)
        for folder in before.intersection(f.split("/")[0] for f in files):
            if folder in self.schemas or not fits:
                new.schemas[folder] = self.schemas.get(folder, self.schema.json())
        return new


def _fits(have: T.DataType, want: T.DataType) -> bool:
    """Whether data of one type are read by another as they are: fields may come and go, none takes another type."""
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        return all(_fits(f.dataType, want[f.name].dataType) for f in have if f.name in want.names)
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return _fits(have.elementType, want.elementType)
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        return _fits(have.keyType, want.keyType) and _fits(have.valueType, want.valueType)
    return have == want


def new_id() -> Column:
    """An id of 24 hexadecimal digits for a document that has none."""
    return F.substring(F.md5(F.uuid()), 1, 24)


class Collection:
    #: The column that tells documents apart, the one that holds whole documents if there is one, and the schema of no documents.
    key, variant, empty = ID, None, _ID_SCHEMA

    def __init__(self, spark: SparkSession, root: str, database: str, name: str):
        self.spark, self.database, self.name = spark, database, name
        self.path = f"{root}/{database}/{name}"
        self.files = Files(spark, root)

    # --- versions -----------------------------------------------------------------------------

    def exists(self) -> bool:
        return self.files.exists(f"{self.path}/versions")

    def version(self) -> Version:
        names = [n for n in self.files.names(f"{self.path}/versions") if n.endswith(".json")]
        if not names:
            return Version(schema=self.empty)
        return Version.read(int(names[-1][:-5]), self.files.read(f"{self.path}/versions/{names[-1]}"))

    def _publish(
        self, old: Version, files: list[str], schema: T.StructType, indexes: list[Index] | None = None, batch: dict | None = None
    ) -> Version:
        """The next version; indexes that are ready get the entries of data files that have none."""
        new = old.then(files, schema)
        new.indexes, new.batches = old.indexes if indexes is None else indexes, old.batches | (batch or {})
        for index in new.indexes:
            if index.status == "ready":
                new.entries[index.name] = self._index(new, index, self._live(old, index, new))
        self.files.make(f"{self.path}/versions")
        if not self.files.create(f"{self.path}/versions/{new.number:012d}.json", new.text()):
            raise Conflict
        return new

    def _retry(self, statement):
        for _ in range(RETRIES):
            try:
                return statement(self.version())
            except Conflict:
                continue
        raise Conflict(f"{self.database}.{self.name} changed {RETRIES} times meanwhile")

    def create(self) -> None:
        if not self.exists():
            self._publish(Version(schema=self.empty), [], self.empty)

    def vacuum(self) -> int:
        """Remove data and entries that the newest version does not name; the number of folders removed."""
        version, gone = self.version(), 0
        held = {"data": {f.split("/")[0] for f in version.files}, "entries": {f for sets in version.entries.values() for f in sets}}
        for kind, kept in held.items():
            for folder in self.files.names(f"{self.path}/{kind}"):
                if folder not in kept:
                    gone += self.files.delete(f"{self.path}/{kind}/{folder}")
        return gone

    # --- reading ------------------------------------------------------------------------------

    def _frame(self, version: Version, files: Iterable[str] | None = None) -> DataFrame:
        files = version.files if files is None else list(files)
        if not files:
            return self.spark.createDataFrame([], version.schema)
        parts: dict[str | None, list[str]] = {}
        for f in files:
            parts.setdefault(version.schemas.get(f.split("/")[0]), []).append(f"{self.path}/data/{f}")
        frames = []
        for own, paths in parts.items():
            df = self.spark.read.schema(T.StructType.fromJson(json.loads(own)) if own else version.schema).parquet(*paths)
            frames.append(df.select(*[_field(df, f) for f in version.schema]) if own else df)
        return reduce(DataFrame.unionByName, frames)

    def frame(self) -> DataFrame:
        return self._frame(self.version())

    def _candidates(self, version: Version, query) -> list[str]:
        """The data files that can hold a match: those that entries name, or all of them."""
        query, _ = finding.unwrap(query)
        if len(version.files) < 2 or not version.indexes or not query:
            return version.files
        found = lookups(simplify(parse(query, top=True)), version.indexes, self._frame(version, []), ID)
        if found is None:
            return version.files
        named: set[str] = set()
        for index, wanted in found:
            held = self._entries(version, index, version.entries[index.name])
            # At most one row for each data file of the version and of those that it has replaced.
            named |= {r["file"] for r in held.filter(condition(simplify(wanted), held).pos).select("file").distinct().collect()}
        return [f for f in version.files if f in named]

    def _matches(self, version: Version, query) -> DataFrame:
        return self._frame(version, self._candidates(version, query))

    def find(self, query=None, projection=None, sort=None, skip: int = 0, limit: int = 0) -> DataFrame:
        return self._find(self._matches(self.version(), query), query, projection, sort, skip, limit)

    def _find(self, df: DataFrame, query=None, projection=None, sort=None, skip: int = 0, limit: int = 0) -> DataFrame:
        return finding.find(df, query, projection, sort, skip, limit, ID, self.variant)

    def count(self, query=None, skip: int = 0, limit: int = 0) -> int:
        return finding.count(self._matches(self.version(), query), query, skip, limit, self.variant).first()["n"]

    def distinct(self, path: str, query=None) -> DataFrame:
        return finding.distinct(self._matches(self.version(), query), path, query, self.variant)

    def explain(self, query=None) -> dict:
        """What a find does: the predicate, the access, the data files read of all, and Spark's physical plan."""
        version = self.version()
        node = simplify(parse(query, top=True))
        files = self._candidates(version, query)
        plan = self._find(self._frame(version, files), query)._jdf.queryExecution().executedPlan().toString()
        access = usable(node, version.indexes, ID, self._frame(version, []))
        return {"predicate": describe(node), "access": access, "files": [len(files), len(version.files)], "plan": plan}

    # --- writing ------------------------------------------------------------------------------

    def _write(self, df: DataFrame) -> list[str]:
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{folder}")
        return [f"{folder}/{n}" for n in self.files.names(f"{self.path}/data/{folder}") if n.endswith(".parquet")]

    def _check_ids(self, df: DataFrame) -> None:
        if df.groupBy(self.key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
            raise DocumentError(11000, ID)

    def insert(self, documents: DataFrame | list[dict], batch: tuple[str, int] | None = None) -> int:
        """Add documents, all or none; a document without an id gets one.

        ``batch``: a stream and the number of its batch, which is inserted once only; its number is kept in the version.
        """
        documents = self._frame_of(documents)

        def statement(old: Version):
            if batch and old.batches.get(batch[0], -1) >= batch[1]:
                return 0
            return self._add(old, documents, dict([batch]) if batch else None)[1]

        return self._retry(statement)

    def _frame_of(self, documents: DataFrame | list[dict]) -> DataFrame:
        if not isinstance(documents, DataFrame):
            documents = [dict(d) for d in documents]
            for d in documents:
                if any(k.startswith("$") for k in d):
                    raise DocumentError(15896)
                if isinstance(d.get(ID), list | tuple):
                    raise DocumentError(29999)
            kind: T.DataType = T.StructType([])
            for d in documents:
                kind = updating.wider(kind, updating.infer(d))
            kind = _filled(kind)
            documents = self.spark.createDataFrame([_row(d, kind) for d in documents], kind)
        if ID not in documents.columns:
            documents = documents.withColumn(ID, new_id())
        elif isinstance(documents.schema[ID].dataType, T.ArrayType):
            raise DocumentError(29999)
        elif isinstance(documents.schema[ID].dataType, T.StringType):
            documents = documents.withColumn(ID, F.coalesce(ID, new_id()))

        return documents

    def _add(self, old: Version, documents: DataFrame, batch: dict | None = None) -> tuple[Version, int]:
        """The version with the documents added, and how many there are."""
        schema = documents.schema if not old.files else updating.wider(old.schema, documents.schema)
        # Ids that were made here have to be the ones that are checked, so the rows are written first.
        fresh = documents.select(*[_field(documents, f) for f in schema])
        # Clustered by id, so that a lookup by id is told most row groups by their statistics.
        added = self._write(fresh.repartitionByRange(self.key).sortWithinPartitions(self.key))
        now = old.then(old.files + added, schema)
        new_rows = self._frame(now, added)
        self._check_ids(new_rows)
        if old.files:
            held = self._frame(now, old.files).select(self.key)
            if held.join(new_rows.select(self.key), self.key, "left_semi").limit(1).count():
                raise DocumentError(11000, ID)
        return self._publish(old, old.files + added, schema, batch=batch), new_rows.count()

    def _first(self, df: DataFrame, hit: Column, limit: int) -> Column:
        """The condition for the ``limit`` matching documents with the smallest ids."""
        if not limit:
            return hit
        first = finding.sort_by(df.filter(hit), {ID: 1}, self.variant).limit(limit)
        ids = [r[self.key] for r in first.select(self.key).collect()]
        return F.col(self.key).isin(ids) if ids else F.lit(False)

    def _changed(self, df: DataFrame, hit: Column, update: Mapping) -> DataFrame:
        return updating.apply_update(df, hit, update, ID)

    def _rewrite(self, old: Version, query, limit: int, change) -> tuple[Version, int]:
        """The version with ``change(rows, hit)`` in the place of the files that hold a matching document, and the matches."""
        df = self._matches(old, query)
        hit = F.coalesce(finding.matching(df, query, self.variant).pos, F.lit(False))
        hit = self._first(df, hit, limit)
        # As many rows as there are data files at most.
        touched = df.filter(hit).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()
        n = sum(r["n"] for r in touched)
        if not n:
            return old, 0
        named = {"/".join(r["f"].rsplit("/", 2)[-2:]) for r in touched}
        rows = self._frame(old, [f for f in old.files if f in named])
        new = change(rows, hit)
        kept = [f for f in old.files if f not in named]
        return self._publish(old, kept + self._write(new.sortWithinPartitions(self.key)), new.schema), n

    def update(self, query: Mapping, update: Mapping, upsert: bool = False, multi: bool = False) -> dict:
        """Update the matching documents, or the one with the smallest id; insert if none and ``upsert``."""
        operators = updating.is_operator_update(update)
        if multi and not operators:
            raise DocumentError(10158)
        if operators:
            updating.validate(update, ID)

        def statement(old: Version):
            _, n = self._rewrite(old, query, 0 if multi else 1, lambda df, hit: self._changed(df, hit, update))
            if n or not upsert:
                return {"n": n, "nModified": n, "upserted": None}
            row, made = self._upsert(query, update, operators)
            self._add(old, row)  # on the version that has no match, so nobody else has added it meanwhile
            return {"n": 1, "nModified": 0, "upserted": made}

        return self._retry(statement)

    def _upsert(self, query: Mapping, update: Mapping, operators: bool) -> tuple[DataFrame, object]:
        """The document that an upsert adds, and its id."""
        if not operators:
            document = dict(update)
            wanted = query.get(ID)
            if ID in query and not isinstance(wanted, Mapping):
                if ID in document and document[ID] != wanted:
                    raise DocumentError(20010)
                document[ID] = wanted
        else:
            document = updating.seed(query)
            for op in ("$set", "$setOnInsert"):
                if ID in update.get(op, {}):
                    document.setdefault(ID, update[op][ID])
                    break
        kind = _filled(updating.infer(document))
        if not kind.fields:
            kind = T.StructType([T.StructField("__none", T.StringType())])
        row = self.spark.createDataFrame([_row(document, kind)], kind).drop("__none")
        if operators:
            own = {op: {k: v for k, v in f.items() if k != ID} for op, f in update.items()}
            own = {op: f for op, f in own.items() if f}
            changed = updating.new_fields(row, own, True, ID) if own else {}
            columns = [F.col(f"`{c}`") for c in row.columns if c not in changed]
            row = row.select(*columns, *[c.cast(_filled(d)).alias(n) for n, (c, d) in changed.items()])
        if ID not in row.columns:
            row = row.withColumn(ID, F.lit(uuid.uuid4().hex[:24]))
        return row, row.select(ID).first()[ID]

    def delete(self, query: Mapping, limit: int = 0) -> int:
        """Remove the matching documents, or the ``limit`` ones with the smallest ids."""
        return self._retry(lambda old: self._rewrite(old, query, limit, lambda df, hit: df.filter(~hit))[1])

    def find_and_modify(self, query=None, update=None, remove: bool = False, new: bool = False, upsert: bool = False, fields=None, sort=None):
        """Change or remove the first match, in one version; the document before (or after), or ``None``."""
        if sort:
            raise DocumentError(20002)
        if bool(update) == bool(remove):
            raise DocumentError(15899)
        operators = bool(update) and updating.is_operator_update(update)
        if operators:
            updating.validate(update, ID)

        def statement(old: Version):
            rows = self._matches(old, query)
            read = lambda version, key: self._find(self._frame(version).filter(F.col(self.key) == F.lit(key)), {}, fields).first()
            found = finding.sort_by(finding.match(rows, finding.unwrap(query)[0], self.variant), {ID: 1}, self.variant)
            first = found.select(self.key).first()
            if first is None:
                if not (update and upsert):
                    return None
                row, _ = self._upsert(query or {}, update, operators)
                now, _ = self._add(old, row)
                return read(now, row.select(self.key).first()[0]) if new else None
            before = read(old, first[0])
            change = (lambda df, hit: df.filter(~hit)) if remove else (lambda df, hit: self._changed(df, hit, update))
            now, _ = self._rewrite(old, {self.key: first[0]}, 1, change)
            return read(now, first[0]) if new and not remove else before

        return self._retry(statement)

    # --- indexes ------------------------------------------------------------------------------

    def create_index(self, spec: Mapping) -> bool:
        """Add an index and write its entries; ``False`` if there is one with the same key.

        Its status is ``building`` meanwhile; writers go on, and what they add is indexed before it is ``ready``.
        """
        index = Index.of(spec, ID)

        def statement(old: Version):
            if index is None or any(i.fields == index.fields for i in old.indexes):
                return False
            if any(i.name == index.name for i in old.indexes):
                raise DocumentError(29993, index.name)
            self._publish(old, old.files, old.schema, [*old.indexes, replace(index, status="building")])
            return True

        def give_up(old: Version):
            self._publish(old, old.files, old.schema, [i for i in old.indexes if i.name != index.name])

        built = Version()  # what is written so far; a try after another writer's version adds the rest

        def settle(old: Version):
            built.entries[index.name] = self._index(old, index, self._live(built, index, old))
            built.schema = old.schema
            ready = [index if i.name == index.name else i for i in old.indexes]
            self._publish(replace(old, entries=old.entries | built.entries), old.files, old.schema, ready)

        if not self._retry(statement):
            return False
        try:
            self._retry(settle)
        except Exception:
            self._retry(give_up)
            raise
        return True

    def _kind(self, version: Version, index: Index) -> str:
        return entries(self._frame(version, []), index, ID).schema.simpleString()

    def _live(self, old: Version, index: Index, new: Version) -> dict[str, list[str]]:
        """The folders of entries that are still good in a new version.

        All go if the type of a key has changed, and those of which most data files are gone.
        """
        if old.schema != new.schema and self._kind(old, index) != self._kind(new, index):
            return {}
        files = set(new.files)
        return {folder: covered for folder, covered in old.entries.get(index.name, {}).items() if 2 * len(files.intersection(covered)) > len(covered)}

    def _index(self, version: Version, index: Index, sets: dict[str, list[str]]) -> dict[str, list[str]]:
        """``sets`` and a folder with the entries of all other data files; the keys of a unique index are checked."""
        covered = {f for files in sets.values() for f in files}
        rest = [f for f in version.files if f not in covered]
        if not rest:
            return sets
        rows = self._frame(version, rest).withColumn(_FILE, F.substring_index(F.input_file_name(), "/", -2))
        made = entries(rows, index, ID, (_FILE,)).withColumnRenamed(_FILE, "file")
        folder = uuid.uuid4().hex
        order = [*index.keys, "id"]  # with the id, so that a key of many documents is spread over tasks
        try:
            made.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{self.path}/entries/{folder}")
        except Exception as e:
            if "29992" in str(e):
                raise DocumentError(29992, index.name) from None
            raise
        more = {**sets, folder: rest}
        if index.unique:
            fresh = self._entries(version, index, {folder: rest})
            clash = repeated(fresh, index).limit(1).count()
            if not clash and sets:
                held, keys = self._entries(version, index, sets), fresh.select(*[F.col(k).alias(f"new_{k}") for k in index.keys]).distinct()
                same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in index.keys])
                clash = held.join(keys, same, "left_semi").limit(1).count()
            if clash:
                raise DocumentError(11000, index.name)
        return more

    def _entries(self, version: Version, index: Index, sets: dict[str, list[str]]) -> DataFrame:
        """The entries of a version in these folders: keys, ``id`` and ``file``."""
        kind = entries(self._frame(version, []), index, ID).schema.add("file", "string")
        if not sets:
            return self.spark.createDataFrame([], kind)
        held = self.spark.read.schema(kind).parquet(*[f"{self.path}/entries/{f}" for f in sets])
        files = set(version.files)
        if all(files.issuperset(covered) for covered in sets.values()):
            return held
        live = self.spark.createDataFrame([(f,) for f in version.files], "file string")
        return held.join(live, "file", "left_semi").select(*kind.names)

    def drop_index(self, which: str | Mapping) -> int:
        """Drop by name, by key, or all (``*``); the number dropped."""

        def statement(old: Version):
            if which == "*":
                kept = []
            elif isinstance(which, str):
                kept = [i for i in old.indexes if i.name != which]
            else:
                kept = [i for i in old.indexes if dict(i.fields) != dict(which)]
            if len(kept) < len(old.indexes):
                self._publish(old, old.files, old.schema, kept)
            return len(old.indexes) - len(kept)

        return self._retry(statement)

    def indexes(self) -> list[dict]:
        return [{"name": "_id_", "key": {ID: 1}, "unique": True, "status": "ready"}, *(i.document() for i in self.version().indexes)]

    def index_entries(self, name: str) -> DataFrame:
        version = self.version()
        index = next(i for i in version.indexes if i.name == name)
        return self._entries(version, index, version.entries.get(name, {})).drop("file")


def _filled(kind: T.DataType) -> T.DataType:
    """The same type with text where a literal tells none (null, an empty list)."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_filled(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _filled(f.dataType)) for f in kind])
    return kind


def _row(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_row(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [_row(v, kind.elementType) for v in value]
    return float(value) if isinstance(kind, T.DoubleType) else value


def _field(df: DataFrame, f: T.StructField) -> Column:
    if f.name not in df.columns:
        return F.lit(None).cast(f.dataType).alias(f.name)
    return updating.cast(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType).alias(f.name)


class Database:
    """The collections below ``root/name``, and the command documents that clients send."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.files = Files(spark, root)
        self.last: dict = {"ok": 1, "n": 0, "err": None}

    def __getitem__(self, collection: str) -> Collection:
        return Collection(self.spark, self.root, self.name, collection)

    def collections(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/{self.name}") if self[n].exists()]

    def namespaces(self) -> DataFrame:
        rows = [(f"{self.name}.{n}",) for n in self.collections()]
        return self.spark.createDataFrame(rows, "name string")

    def index_catalog(self) -> DataFrame:
        rows = [(f"{self.name}.{n}", i["name"], json.dumps(i["key"]), i["unique"]) for n in self.collections() for i in self[n].indexes()]
        return self.spark.createDataFrame(rows, "ns string, name string, key string, unique boolean")

    def rename(self, old: str, new: str, drop_target: bool = False) -> None:
        if old == new:
            raise DocumentError(29978)
        if not self[old].exists():
            raise DocumentError(29976)
        if self[new].exists():
            if not drop_target:
                raise DocumentError(29977)
            self.files.delete(self[new].path)
        self.files.rename(self[old].path, self[new].path)

    def drop(self, collection: str) -> bool:
        return self.files.delete(self[collection].path) if self[collection].exists() else False

    def drop_all(self) -> None:
        self.files.delete(f"{self.root}/{self.name}")

    def command(self, document: Mapping) -> dict:
        """Run a command document; its first key, in lower case, names the command."""
        name, target = next(iter(document.items()))
        run = getattr(self, f"_do_{name.lower()}", None)
        if run is None:
            return {"ok": 0, "errmsg": f"no such command: {name}"}
        try:
            return {"ok": 1, **(run(target, document) or {})}
        except DocumentError as e:
            self.last = {"ok": 1, "n": 0, "err": str(e), "code": e.code}
            return {"ok": 0, "errmsg": str(e), "code": e.code}

    def _wrote(self, n: int, **more) -> dict:
        self.last = {"ok": 1, "n": n, "err": None}
        return {"n": n, **more}

    def _do_insert(self, c, d):
        return self._wrote(self[c].insert(d["documents"]))

    def _do_update(self, c, d):
        n = modified = 0
        upserted, errors = [], []
        for i, u in enumerate(d["updates"]):
            try:
                done = self[c].update(u["q"], u["u"], u.get("upsert", False), u.get("multi", False))
            except DocumentError as e:
                errors.append({"index": i, "code": e.code, "errmsg": str(e)})
                if d.get("ordered", True):
                    break
                continue
            n, modified = n + done["n"], modified + done["nModified"]
            if done["upserted"] is not None:
                upserted.append({"index": i, ID: done["upserted"]})
        return self._wrote(n, nModified=modified, **({"upserted": upserted} if upserted else {}), **({"writeErrors": errors} if errors else {}))

    def _do_delete(self, c, d):
        return self._wrote(sum(self[c].delete(x["q"], x.get("limit", 0)) for x in d["deletes"] if self[c].exists()))

    def _do_findandmodify(self, c, d):
        got = self[c].find_and_modify(d.get("query"), d.get("update"), d.get("remove", False), d.get("new", False), d.get("upsert", False), d.get("fields"), d.get("sort"))
        return {"value": got.asDict(True) if got is not None else None}

    def _do_count(self, c, d):
        return {"n": self[c].count(d.get("query"), d.get("skip", 0), d.get("limit", 0))}

    def _do_distinct(self, c, d):
        values = [r["value"] for r in self[c].distinct(d["key"], d.get("query")).collect()]
        n = self[c].count(d.get("query"))
        every = self[c].count() if d.get("query") else n
        return {"values": values, "stats": {"n": n, "nscanned": every, "nscannedObjects": every}}

    def _do_create(self, c, d):
        if d.get("capped") or d.get("storageEngine"):
            raise DocumentError(11002)
        self[c].create()

    def _do_drop(self, c, d):
        if not self.drop(c):
            return {"ok": 0, "errmsg": "ns not found"}

    def _do_dropdatabase(self, c, d):
        self.drop_all()
        return {"dropped": self.name}

    def _do_renamecollection(self, c, d):
        self.rename(c.partition(".")[2], d["to"].partition(".")[2], d.get("dropTarget", False))

    def _do_listcollections(self, c, d):
        if (d.get("cursor") or {}).get("batchSize"):
            raise DocumentError(11002)
        return {"collections": self.collections()}

    def _do_listdatabases(self, c, d):
        return {"databases": self.files.names(self.root)}

    def _do_createindexes(self, c, d):
        before = len(self[c].indexes())
        made = [self[c].create_index(s) for s in d["indexes"]]
        return {"numIndexesBefore": before, "numIndexesAfter": before + sum(made)}

    def _do_dropindexes(self, c, d):
        return {"nIndexesWas": len(self[c].indexes()), "dropped": self[c].drop_index(d["index"])}

    _do_deleteindexes = _do_dropindexes

    def _do_listindexes(self, c, d):
        return {"indexes": self[c].indexes()}

    def _do_dbstats(self, c, d):
        names = self.collections()
        return {"db": self.name, "collections": len(names), "indexes": sum(len(self[n].indexes()) for n in names)}

    def _do_collstats(self, c, d):
        return {"ns": f"{self.name}.{c}", "nindexes": len(self[c].indexes()), "count": self[c].count()}

    def _do_buildinfo(self, c, d):
        from papyra import __version__

        return {"version": "3.0.0", "engine": __version__, "spark": self.spark.version, "maxBsonObjectSize": 16777216}

    def _do_getdoclayerversion(self, c, d):
        from papyra import __version__

        return {"packageVersion": __version__}

    def _do_getmemoryusage(self, c, d):
        runtime = self.spark._jvm.java.lang.Runtime.getRuntime()
        return {"process memory usage": runtime.totalMemory() - runtime.freeMemory()}

    def _do_getkvstatus(self, c, d):
        return {"root": self.root, "databases": self.files.names(self.root)}

    def _do_whatsmyuri(self, c, d):
        return {"you": "127.0.0.1:0"}

    def _do_getnonce(self, c, d):
        return {"nonce": "0000000000000000"}

    def _do_fakeerror(self, c, d):
        raise DocumentError(29966)

    def _do_ismaster(self, c, d):
        return {"ismaster": True, "maxBsonObjectSize": 16777216, "maxMessageSizeBytes": 48000000, "maxWriteBatchSize": 1000}

    def _do_getlasterror(self, c, d):
        return dict(self.last)

    def _do_ping(self, c, d):
        return {}

    _do_serverstatus = _do_ping

    def _do_connectionstatus(self, c, d):
        return {"authInfo": {"authenticatedUsers": [], "authenticatedUserRoles": []}}

    def _do_replsetgetstatus(self, c, d):
        return {"ok": 0, "errmsg": "not running with --replSet"}

    def _do_availablequeryoptions(self, c, d):
        return {"options": 0}

    def _do_getcmdlineopts(self, c, d):
        return {"argv": ["papyra"], "parsed": {}}

    def _do_getlog(self, c, d):
        return {"totalLinesWritten": 0, "log": []}
