"""Stored entries of indexes: which data files a statement reads, and that results stay the same."""

import random

import pytest
from papyra.errors import DocumentError
from papyra.operators.find import find
from papyra.operators.index import entries, lookups
from papyra.plans.parser import parse
from papyra.plans.simplify import simplify
from papyra.sources.store import Database
from pyspark.sql import functions as F


@pytest.fixture()
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}", "shop")


@pytest.fixture()
def filled(db):
    """Four inserts, so four data files at least, each with values of its own."""
    c = db["things"]
    for part in range(4):
        c.insert([{"_id": 10 * part + i, "n": part, "tags": [f"t{part}", f"u{i}"], "o": {"x": 10 * part + i}} for i in range(10)])
    return c


def test_a_find_reads_the_files_that_entries_name(filled):
    c = filled
    c.create_index({"key": {"n": 1}, "name": "n"})
    c.create_index({"key": {"tags": 1}, "name": "tags"})
    c.create_index({"key": {"o.x": 1, "n": 1}, "name": "xn"})
    for query, most in (
        ({"n": 2}, 1), ({"n": {"$gte": 1, "$lt": 3}}, 2), ({"tags": "t3"}, 1), ({"tags": {"$gt": "t0", "$lt": "t2"}}, 4), ({"o.x": 13}, 1),
        ({"o.x": {"$in": [1, 39]}}, 2), ({"$or": [{"n": 0}, {"tags": "t1"}]}, 2), ({"n": 2, "o.x": {"$exists": True}}, 1), ({"n": "2"}, 0), ({"n": 2.0}, 1),
    ):
        seen = c.explain(query)
        per = seen["files"][1] // 4
        assert seen["access"]["type"] in ("index scan", "union") and seen["files"][0] <= most * per, query
        assert sorted(c.find(query).collect()) == sorted(find(c.frame(), query).collect()), query
    for query in ({"n": None}, {"n": {"$ne": 1}}, {"tags.0": "t1"}, {"tags": ["t1", "u1"]}, {"$or": [{"n": 0}, {"o.x": {"$exists": True}}]}, {}):
        seen = c.explain(query)
        assert seen["access"]["type"] == "table scan" and seen["files"][0] == seen["files"][1], query
        assert sorted(c.find(query).collect()) == sorted(find(c.frame(), query).collect()), query


def test_entries_follow_every_write(filled):
    c = filled
    c.create_index({"key": {"n": 1}, "name": "n"})

    def same():
        version = c.version()
        index = version.indexes[0]
        got = sorted(map(str, c.index_entries("n").collect()))
        assert got == sorted(map(str, entries(c.frame(), index, "_id").collect()))
        return version.entries["n"]

    same()
    assert c.update({"n": 1}, {"$set": {"n": 9}}, multi=True)["n"] == 10
    assert c.count({"n": 1}) == 0 and c.count({"n": 9}) == 10
    same()
    assert c.delete({"n": 9}) == 10 and c.count({"n": {"$gt": 0}}) == 20
    same()
    before = same()
    c.insert([{"_id": 900, "n": 5}])
    assert set(before) < set(same())  # only the new document was indexed
    c.insert([{"_id": 901, "n": 5.5}])  # the key has another type now: all entries are made anew
    assert not set(before) & set(same()) and c.count({"n": {"$gt": 5}}) == 1 and c.count({"n": 5}) == 1
    held = same()
    c.vacuum()
    assert set(c.files.names(f"{c.path}/entries")) == set(held) and c.count({"n": 2}) == 10
    c.drop_index("n")
    c.vacuum()
    assert c.files.names(f"{c.path}/entries") == [] and c.count({"n": 2}) == 10


def test_unique_keys_are_compared_with_entries(db):
    c = db["u"]
    c.insert([{"_id": 1, "a": [1, 2], "b": "x"}, {"_id": 2, "a": [3], "b": None}])
    assert c.create_index({"key": {"a": 1, "b": 1}, "name": "ab", "unique": True})
    for bad in ({"_id": 3, "a": [9, 2], "b": "x"}, {"_id": 3, "a": [3]}):
        with pytest.raises(DocumentError) as e:
            c.insert([bad])
        assert e.value.code == 11000 and c.count() == 2
    c.insert([{"_id": 3, "a": [1], "b": "y"}])
    with pytest.raises(DocumentError):
        c.update({"_id": 3}, {"$set": {"b": "x"}})
    assert c.update({"_id": 1}, {"$set": {"b": "z"}})["n"] == 1
    assert c.update({"_id": 3}, {"$set": {"b": "x"}})["n"] == 1  # the key that stood in the way is gone
    with pytest.raises(DocumentError):
        c.insert([{"_id": 8, "a": [5], "b": "q"}, {"_id": 9, "a": [5], "b": "q"}])


def test_what_is_inserted_while_an_index_is_built_is_indexed(db, monkeypatch):
    c = db["busy"]
    c.insert([{"_id": i, "n": i} for i in range(5)])
    real, calls = type(c)._index, []

    def slow(self, version, index, sets):
        made = real(self, version, index, sets)
        if not calls:
            calls.append(1)
            assert self.indexes()[1]["status"] == "building"
            db["busy"].insert([{"_id": 100, "n": 100}])
        return made

    monkeypatch.setattr(type(c), "_index", slow)
    assert c.create_index({"key": {"n": 1}, "name": "n"}) and c.indexes()[1]["status"] == "ready"
    assert c.index_entries("n").count() == 6 and len(c.version().entries["n"]) == 2 and c.count({"n": 100}) == 1


def test_random_conditions_find_the_same_with_an_index(spark, db):
    rng = random.Random(5)
    value = lambda: rng.choice([rng.randint(-3, 3), None])
    c = db["random"]
    for part in range(5):
        c.insert([{"_id": 8 * part + i, "a": value(), "b": [v for _ in range(rng.randint(0, 3)) if (v := value()) is not None] + [part], "c": [{"d": value()}, {"d": part}]} for i in range(8)])
    for n, key in enumerate(({"a": 1}, {"b": 1}, {"c.d": 1}, {"a": 1, "b": 1})):
        c.create_index({"key": key, "name": f"i{n}"})
    every = c.frame().cache()

    def term():
        v = lambda: rng.choice([rng.randint(-4, 5), rng.randint(-4, 4) + 0.5, None, "x"])
        return rng.choice([v(), {rng.choice(["$gt", "$gte", "$lt", "$lte"]): rng.randint(-4, 5)}, {"$in": [v(), v()]}, {"$ne": v()},
                           {"$gt": rng.randint(-4, 2), "$lt": rng.randint(-2, 5)}, {"$exists": rng.random() < 0.5}])

    for _ in range(60):
        query = {p: term() for p in rng.sample(["a", "b", "c.d"], rng.randint(1, 2))}
        if rng.random() < 0.3:
            query = {"$or": [query, {rng.choice(["a", "b", "c.d"]): term()}]}
        got = sorted(r["_id"] for r in c.find(query).collect())
        assert got == sorted(r["_id"] for r in find(every, query).collect()), query


def test_paths_that_entries_do_not_tell(spark):
    from papyra.operators.index import Index

    df = spark.range(1).select(F.create_map(F.lit("k"), F.lit(1)).alias("m"), F.array(F.array(F.lit(1))).alias("a"), F.parse_json(F.lit("1")).alias("v"))
    indexes = [Index(p, ((p, 1),)) for p in ("m.k", "a.0", "v", "none")]
    for path in ("m.k", "a.0", "v", "none"):
        assert lookups(simplify(parse({path: 1})), indexes, df) is None
