"""Path semantics, update errors and mutable collections."""

import pytest
from papyra.errors import DocumentError
from papyra.operators.find import find
from papyra.operators.project import project
from papyra.operators.update import seed, validate
from papyra.plans.parser import parse
from papyra.plans.simplify import simplify
from papyra.sources.store import Database
from pyspark.sql import functions as F

#: document, filter, whether it matches
TRUTH = (
    ('{"a":[{"b":1}]}', {"a.b": 1}, True), ('{"a":[[{"b":1}]]}', {"a.b": 1}, False), ('{"a":[[{"b":1}]]}', {"a.0.b": 1}, True),
    ('{"a":[{"0":1}]}', {"a.0": 1}, True), ('{"a":[[1]]}', {"a.0": 1}, False), ('{"a":[1,2]}', {"a": 1}, True),
    ('{"a":[1,2]}', {"a": [1, 2]}, True), ("{}", {"a": None}, True), ("{}", {"a.b": None}, True), ('{"a":[]}', {"a.b": None}, False),
    ('{"a":[{},{"b":5}]}', {"a.b": None}, True), ('{"a":[5]}', {"a.b": None}, False), ('{"a":5}', {"a": {"$gt": 4.5}}, True),
    ('{"a":"x"}', {"a": {"$gt": 4}}, False), ('{"a":null}', {"a": {"$exists": True}}, True), ("{}", {"a": {"$ne": 1}}, True),
    ('{"a":{"c":1,"b":2}}', {"a": {"b": 2, "c": 1}}, True),
    ('{"a":[{"b":1,"c":2},{"b":3,"c":4}]}', {"a": {"$elemMatch": {"b": 1, "c": 4}}}, False),
    ('{"a":[{"b":1,"c":2},{"b":3,"c":4}]}', {"a": {"$elemMatch": {"b": 3, "c": 4}}}, True),
)


def test_path_semantics(spark):
    rows = [(i, d) for i, (d, _, _) in enumerate(TRUTH)]
    docs = spark.createDataFrame(rows, "id int, json string").select("id", F.parse_json("json").alias("doc"))
    for i, (doc, query, want) in enumerate(TRUTH):
        got = find(docs.filter(F.col("id") == i), query, variant="doc").count()
        assert got == int(want), (doc, query)


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    found = find(df, {"o_orderstatus": "F", "o_totalprice": {"$gte": 1000}}, {"o_orderkey": 1, "_id": 0})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThanOrEqual(o_totalprice,1000.0)" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1]


def test_ranges_on_one_value_merge():
    node = simplify(parse({"a": {"$elemMatch": {"$gt": 5, "$lt": 3}}}))
    assert type(node).__name__ == "Nothing"


@pytest.mark.parametrize(
    ("update", "code"),
    [
        ({"$set": {}}, 26840), ({"$set": {"a": 1}, "$inc": {"a": 1}}, 10150), ({"$set": {"a": 1, "a.b": 1}}, 10151),
        ({"$rename": {"a": 1}}, 13494), ({"$inc": {"_id": 1}}, 20010), ({"$nope": {"a": 1}}, 10148),
    ],
)
def test_invalid_updates(update, code):
    with pytest.raises(DocumentError) as e:
        validate(update)
    assert e.value.code == code


def test_invalid_filters_and_projections(spark):
    for query, code in (({"a": {"$mod": [2, 1]}}, 29997), ({"$where": "x"}, 15896)):
        with pytest.raises(DocumentError) as e:
            parse(query)
        assert e.value.code == code
    with pytest.raises(DocumentError):
        project(spark.range(1), {"id": 1, "x": 0, "y": 1})


def test_upsert_seed():
    assert seed({"a.b": 1, "c": {"$gt": 2}, "$and": [{"d": {"$eq": 3}}], "$or": [{"e": 4}], "f": {"$all": [5]}}) == {
        "a": {"b": 1}, "d": 3, "e": 4, "f": 5,
    }


def test_collection_life(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}", "shop")
    people = db["people"]
    assert people.insert([{"_id": "1", "n": 1, "tags": ["a"]}, {"_id": "2", "n": 2, "tags": ["b", "c"]}, {"_id": "3", "n": 3, "tags": []}]) == 3
    with pytest.raises(DocumentError) as e:
        people.insert([{"_id": "9"}, {"_id": "2"}])
    assert e.value.code == 11000 and people.count() == 3
    assert people.update({"n": {"$gte": 2}}, {"$inc": {"n": 10}}, multi=True)["n"] == 2
    assert people.update({"n": {"$gte": 2}}, {"$push": {"tags": "z"}})["n"] == 1  # the smallest id
    assert {r["_id"]: (r["n"], r["tags"]) for r in people.find().collect()} == {
        "1": (1, ["a"]), "2": (12, ["b", "c", "z"]), "3": (13, []),
    }
    done = people.update({"_id": "4", "n": 7}, {"$set": {"note": "new"}}, upsert=True)
    assert done["upserted"] == "4" and people.find({"_id": "4"}).first()["note"] == "new"
    assert sorted(r["value"] for r in people.distinct("tags").collect()) == ["a", "b", "c", "z"]
    assert people.create_index({"key": {"n": 1}, "name": "n_1", "unique": True})
    with pytest.raises(DocumentError) as e:
        people.insert([{"_id": "5", "n": 7}])
    assert e.value.code == 11000
    assert people.explain({"n": 7})["access"]["type"] == "index scan"
    before = people.find_and_modify({"n": 7}, {"$set": {"n": 8}})
    assert before["n"] == 7 and people.find({"_id": "4"}).first()["n"] == 8
    assert people.delete({"n": {"$gt": 10}}, 1) == 1 and people.count() == 3
    assert people.find_and_modify({"_id": "1"}, remove=True)["_id"] == "1"
    assert db.command({"count": "people"}) == {"ok": 1, "n": 2}
    assert db.command({"insert": "people", "documents": [{"_id": "4"}]})["code"] == 11000
    db.rename("people", "folk")
    assert db.collections() == ["folk"] and db["folk"].count() == 2
    assert db.command({"listIndexes": "folk"})["indexes"][1]["name"] == "n_1"
    assert db["folk"].vacuum() >= 1 and db["folk"].count() == 2
    assert db.drop("folk") and db.collections() == []
