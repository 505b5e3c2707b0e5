"""Collections of documents whose fields hold any kind."""

import json

import pytest
from papyra.errors import DocumentError
from papyra.sources.mixed import MixedCollection
from pyspark.sql import functions as F


@pytest.fixture()
def c(spark, tmp_path):
    return MixedCollection(spark, f"file://{tmp_path}", "shop", "mixed")


def shown(df):
    return [json.loads(r[0]) for r in df.select(F.to_json("doc")).collect()]


def test_life_of_documents_of_any_shape(c):
    c.create()
    assert c.count() == 0 and c.find({"a": 1}).collect() == []
    assert c.insert([{"_id": 1, "a": 1}, {"_id": "1", "a": "x"}, {"_id": {"k": 1}, "a": None}, {"_id": 10, "a": [1, {"b": "q"}]}, {"_id": 9}]) == 5
    for bad in ([{"_id": 1.0}], [{"_id": 70}, {"_id": 70}], [{"_id": {"k": 1}}]):
        with pytest.raises(DocumentError) as e:
            c.insert(bad)
        assert e.value.code == 11000 and c.count() == 5
    assert shown(c.find({"a": 1}, sort={"_id": 1})) == [{"_id": 1, "a": 1}, {"_id": 10, "a": [1, {"b": "q"}]}]
    assert shown(c.find({"_id": 1.0})) == [{"_id": 1, "a": 1}] and shown(c.find({"_id": "1"}, {"a": 1, "_id": 0})) == [{"a": "x"}]
    assert c.count({"a": None}) == 2 and c.count({"a": {"$exists": True}}) == 4
    assert c.update({"a": {"$exists": True}}, {"$set": {"a": {"n": 1}}})["n"] == 1  # the smallest id, by number
    assert shown(c.find({"_id": 1})) == [{"_id": 1, "a": {"n": 1}}]
    assert c.update({"_id": {"$gt": 1}}, {"$push": {"t": "z"}}, multi=True)["n"] == 2
    assert shown(c.find({"t": "z"}, sort={"_id": -1})) == [{"_id": 10, "a": [1, {"b": "q"}], "t": ["z"]}, {"_id": 9, "t": ["z"]}]
    assert [json.loads(r[0]) for r in c.distinct("a").select(F.to_json("value")).collect()] == [None, 1, "x", {"b": "q"}, {"n": 1}]
    assert c.delete({"_id": {"$gt": 0}}, 1) == 1 and c.count({"_id": 1}) == 0
    assert c.update({"_id": 9}, {"b": 2})["n"] == 1 and shown(c.find({"_id": 9})) == [{"_id": 9, "b": 2}]


def test_upsert_and_find_and_modify(c):
    assert c.update({"_id": 4, "x": "a"}, {"$inc": {"n": 2}, "$setOnInsert": {"m": [1]}}, upsert=True) == {"n": 1, "nModified": 0, "upserted": 4}
    assert c.update({"_id": 4}, {"$inc": {"n": 2}, "$setOnInsert": {"m": 7}}, upsert=True)["upserted"] is None
    assert shown(c.find()) == [{"_id": 4, "m": [1], "n": 4, "x": "a"}]
    made = c.update({"y": 1}, {"z": 2}, upsert=True)["upserted"]
    assert len(made) == 24 and shown(c.find({"_id": made})) == [{"_id": made, "z": 2}]
    before = c.find_and_modify({"n": 4}, {"$set": {"n": "four"}})
    after = c.find_and_modify({"n": "four"}, {"$mul": {"q": 2}}, new=True)
    assert json.loads(before["doc"].toJson())["n"] == 4 and json.loads(after["doc"].toJson()) == {"_id": 4, "m": [1], "n": "four", "q": 0, "x": "a"}
    assert json.loads(c.find_and_modify({"_id": 8}, {"$set": {"k": 1}}, upsert=True, new=True)["doc"].toJson()) == {"_id": 8, "k": 1}
    assert c.find_and_modify({"_id": 4}, remove=True) is not None and c.count() == 2
    assert c.find_and_modify({"_id": 400}, remove=True) is None


def test_ids_are_made_and_checked(spark, c):
    docs = spark.createDataFrame([('{"a":1}',), ('{"a":2}',)], "j string").select(F.parse_json("j").alias("doc"))
    assert c.insert(docs) == 2 and sorted(d["a"] for d in shown(c.find())) == [1, 2] and len({d["_id"] for d in shown(c.find())}) == 2
    assert all(shown(c.find({"_id": d["_id"]})) == [d] for d in shown(c.find()))  # the key is that of the id in the document
    for bad in ([{"_id": [1]}], [{"$a": 1}]):
        with pytest.raises(DocumentError):
            c.insert(bad)
    with pytest.raises(DocumentError) as e:
        c.create_index({"key": {"a": 1}, "name": "a"})
    assert e.value.code == 11002


def test_a_lookup_by_id_reaches_the_scan(spark, c):
    c.insert([{"_id": i} for i in range(5)])
    plan = c._matches(c.version(), {"_id": 3})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(__key,number 3)" in plan
