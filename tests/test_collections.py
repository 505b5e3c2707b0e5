"""Statements that are one version each: two writers, streams, indexes, wrapped queries."""

import threading

import pytest
from papyra.errors import DocumentError
from papyra.operators.find import find, unwrap
from papyra.operators.index import Index, entries
from papyra.sources.store import Conflict, Database
from papyra.streaming.live import append_to, live_find
from pyspark.sql import functions as F


@pytest.fixture()
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}", "shop")


def both(one, other):
    """Run two functions at the same time; their results or errors."""
    out = [None, None]

    def go(n, fn):
        try:
            out[n] = fn()
        except Exception as e:  # noqa: BLE001
            out[n] = e

    threads = [threading.Thread(target=go, args=x) for x in ((0, one), (1, other))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_two_writers_never_get_the_same_document(db):
    c = db["counter"]
    c.insert([{"_id": 1, "n": 0}])
    bump = lambda: [c.find_and_modify({"_id": 1}, {"$inc": {"n": 1}})["n"] for _ in range(3)]
    got = both(bump, bump)
    assert sorted(got[0] + got[1]) == list(range(6)) and c.find().first()["n"] == 6


def test_two_writers_insert_one_document_by_upsert(db):
    c = db["once"]
    c.create()
    add = lambda who: lambda: c.update({"_id": 7}, {"$set": {"who": who}}, upsert=True)
    got = both(add(1), add(2))
    assert c.count() == 1 and sorted(x["upserted"] is None for x in got) == [False, True]


def test_a_statement_runs_again_on_the_newer_version(db):
    c = db["again"]
    c.insert([{"_id": 1}])
    stale = c.version()
    c.insert([{"_id": 2}])
    with pytest.raises(Conflict):
        c._add(stale, c._frame_of([{"_id": 3}]))
    seen = c.frame()  # a reader keeps the version that it began with
    c.delete({})
    assert seen.count() == 2 and c.count() == 0


def test_a_batch_is_inserted_once(spark, db, tmp_path):
    c = db["stream"]
    c.insert([{"_id": 1}], ("s", 0))
    assert c.insert([{"_id": 1}], ("s", 0)) == 0 and c.count() == 1
    c.insert([{"_id": 2}], ("s", 1))
    assert c.insert([{"_id": 3}], ("other", 0)) == 1 and c.count() == 3
    source = f"{tmp_path}/in"
    spark.createDataFrame([(10, "a"), (11, "b")], "_id int, x string").write.parquet(source)
    stream = spark.readStream.schema("_id int, x string").parquet(source)
    for _ in range(2):
        append_to(live_find(stream, {"x": {"$ne": "b"}}), c, f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["_id"] for r in c.find().collect()) == [1, 2, 3, 10]


def test_index_status_and_failed_builds(db):
    c = db["people"]
    c.insert([{"_id": 1, "n": 5}, {"_id": 2, "n": 5}])
    with pytest.raises(DocumentError) as e:
        c.create_index({"key": {"n": 1}, "name": "n", "unique": True})
    assert e.value.code == 11000 and len(c.indexes()) == 1
    assert c.create_index({"key": {"n": 1}, "name": "n"}) and c.indexes()[1]["status"] == "ready"
    building = Index("n", (("n", 1),), False, "building")
    from papyra.operators.index import usable
    from papyra.plans.parser import parse

    assert usable(parse({"n": 1}), [building])["type"] == "table scan"


def test_too_many_entries_of_a_document(spark, db):
    c = db["wide"]
    c.insert([{"_id": 1, "a": list(range(40)), "b": list(range(30))}])
    with pytest.raises(DocumentError) as e:
        c.create_index({"key": {"a": 1, "b": 1}, "name": "ab"})
    assert e.value.code == 29992 and len(c.indexes()) == 1
    small = spark.createDataFrame([(1, [1, 2, 2], [3, 4])], "_id int, a array<int>, b array<int>")
    assert entries(small, Index("ab", (("a", 1), ("b", 1)))).count() == 4


def test_wrapped_queries(spark):
    assert unwrap({"query": 5}) == ({"query": 5}, None) and unwrap(None) == (None, None)
    assert unwrap({"$query": {"a": 1}, "$orderby": {"b": -1}, "$hint": "x"}) == ({"a": 1}, {"b": -1})
    assert unwrap({"query": {"a": 1}, "orderby": {"b": 1}}) == ({"a": 1}, {"b": 1})
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id int, x int")
    assert [r["id"] for r in find(df, {"$query": {"x": {"$gt": 1}}, "$orderby": {"x": -1}}).collect()] == [2, 1]
    assert find(df, {"x": 1, "$hint": {"x": 1}}).count() == 1


def test_objects_sort_field_by_field(spark):
    df = spark.createDataFrame([(1, (9,), [(10,)]), (2, (10,), [(9,), (100,)]), (3, None, None)], "id int, o struct<k:int>, a array<struct<k:int>>")
    assert [r["id"] for r in find(df, sort={"o": 1}).collect()] == [3, 1, 2]
    assert [r["id"] for r in find(df, sort={"a": -1}).collect()] == [2, 1, 3]
    maps = df.withColumn("m", F.create_map(F.lit("x"), "id"))
    assert [r["id"] for r in find(maps, sort={"m": -1}).collect()] == [3, 2, 1]


def test_a_field_takes_a_wider_type_than_older_files_have(spark, db):
    c = db["wide_types"]
    c.insert([{"_id": 1, "n": 2**40, "a": [{"x": 2**40}]}, {"_id": 5, "n": 4, "a": []}])
    c.create_index({"key": {"n": 1}, "name": "n", "unique": True})
    c.insert([{"_id": 2, "n": 1.5, "a": [{"x": 0.5, "y": "q"}]}])
    c.insert([{"_id": 2.5, "m": 1}])
    assert [(r["_id"], r["n"]) for r in c.find(sort={"_id": 1}).collect()] == [(1.0, 2.0**40), (2.0, 1.5), (2.5, None), (5.0, 4.0)]
    assert c.find({"_id": 1}).first()["a"][0]["x"] == 2.0**40 and c.count({"n": {"$gt": 1}}) == 3
    with pytest.raises(DocumentError):
        c.insert([{"_id": 7, "n": 4}])
    assert len(c.version().schemas) == 2  # the folders of the first two statements
    assert c.update({"n": {"$gte": 4}}, {"$set": {"n": 0.25}})["n"] == 1 and c.delete({"n": 1.5}) == 1
    assert not c.version().schemas and sorted(r["n"] or 0 for r in c.find().collect()) == [0, 0.25, 4]
    c.update({}, {"$inc": {"k": 1}}, multi=True)
    assert c.count({"k": 1}) == 3
