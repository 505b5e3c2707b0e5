"""Projection, distinct values and updates of VARIANT documents, whose fields hold any kind."""

import json

import pytest
from papyra.errors import DocumentError
from papyra.operators.find import distinct, find
from papyra.operators.update import apply_variant_update
from pyspark.sql import functions as F

DOC = '{"_id":1,"a":{"b":1,"c":[{"x":1,"y":2},5,[{"x":3}]]},"n":null}'


def frame(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "json string").select(F.parse_json("json").alias("doc"))


def shown(df):
    return [json.loads(r[0]) if r[0] is not None else None for r in df.select(F.to_json("doc")).collect()]


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({"a.b": 1}, {"_id": 1, "a": {"b": 1}}),
        ({"a.c.x": 1, "_id": 0}, {"a": {"c": [{"x": 1}, [{"x": 3}]]}}),
        ({"n": 1, "missing": 1}, {"_id": 1, "n": None}),
        ({"n.x": 1, "_id": 0}, {}),
        ({"a": 0}, {"_id": 1, "n": None}),
        ({"a.c.x": 0, "_id": 0}, {"a": {"b": 1, "c": [{"y": 2}, 5, [{}]]}, "n": None}),
        ({"n.x": 0, "a.b.z": 0}, json.loads(DOC)),
        ({"_id": 0}, {k: v for k, v in json.loads(DOC).items() if k != "_id"}),
    ],
)
def test_projection(spark, spec, want):
    assert shown(find(frame(spark, DOC), {}, spec, variant="doc")) == [want]


def test_distinct_values_of_every_kind(spark):
    docs = frame(spark, '{"v":1}', '{"v":1.0}', '{"v":[1,"1",null]}', '{"v":{"b":1,"a":2}}', '{"v":{"a":2,"b":1}}', "{}", '{"v":2.5}', '{"v":[]}', "7")
    got = [json.loads(r[0]) for r in distinct(docs, "v", variant="doc").select(F.to_json("value")).collect()]
    assert got == [None, 1, 2.5, "1", {"a": 2, "b": 1}]
    deep = frame(spark, '{"a":[{"b":[1,2]},{"b":3},4]}')
    assert [r[0] for r in distinct(deep, "a.b", variant="doc").select(F.to_json("value")).collect()] == ["1", "2", "3"]
    assert [r[0] for r in distinct(deep, "a.0.b", variant="doc").select(F.to_json("value")).collect()] == ["1", "2"]


@pytest.mark.parametrize(
    ("update", "want"),
    [
        ({"$set": {"a.b": "x", "k.l": [1]}}, '{"_id":1,"a":{"b":"x","c":[{"x":1,"y":2},5,[{"x":3}]]},"n":null,"k":{"l":[1]}}'),
        ({"$unset": {"a.c": "", "q.r": ""}}, '{"_id":1,"a":{"b":1},"n":null}'),
        ({"$inc": {"a.b": 2, "m": 1}}, '{"_id":1,"a":{"b":3,"c":[{"x":1,"y":2},5,[{"x":3}]]},"n":null,"m":1}'),
        ({"$rename": {"a.b": "z", "q": "w"}}, '{"_id":1,"a":{"c":[{"x":1,"y":2},5,[{"x":3}]]},"n":null,"z":1}'),
        ({"f": {"g": None}}, '{"_id":1,"f":{"g":null}}'),
    ],
)
def test_updates(spark, update, want):
    df = apply_variant_update(frame(spark, DOC), F.lit(True), update, "doc")
    assert shown(df) == [json.loads(want)]
    assert shown(apply_variant_update(frame(spark, DOC), F.lit(False), update, "doc")) == [json.loads(DOC)]


def test_increments_at_the_ends_and_of_other_kinds(spark):
    docs = frame(spark, '{"v":9223372036854775807}', '{"v":1.5}')
    assert [d["v"] for d in shown(apply_variant_update(docs, F.lit(True), {"$inc": {"v": 1}}, "doc"))] == [-(2**63), 2.5]
    with pytest.raises(Exception, match="10140"):
        shown(apply_variant_update(frame(spark, '{"v":"x"}'), F.lit(True), {"$inc": {"v": 1}}, "doc"))
    with pytest.raises(Exception, match="10141"):
        shown(apply_variant_update(docs, F.lit(True), {"$push": {"v": 1}}, "doc"))
    with pytest.raises(DocumentError):
        apply_variant_update(docs, F.lit(True), {"$push": {"v": {"$each": [1], "$sort": {"a": 1}}}}, "doc")


@pytest.mark.parametrize(
    ("doc", "update", "want"),
    [
        ({"v": 6}, {"$mul": {"v": 7}}, {"v": 42}),
        ({"v": 2**62 + 1}, {"$mul": {"v": 4}}, {"v": 4}),
        ({"v": -(2**63)}, {"$inc": {"v": -1}}, {"v": 2**63 - 1}),
        ({"v": 1.5}, {"$mul": {"v": 2}}, {"v": 3.0}),
        ({}, {"$mul": {"v": 2}, "$inc": {"w": 3}}, {"v": 0, "w": 3}),
        ({"v": 2**40 + 6}, {"$bit": {"v": {"or": 1}}}, {"v": 7}),
        ({}, {"$bit": {"v": {"xor": 5}}}, {"v": 5}),
        ({"v": 5}, {"$min": {"v": "x"}, "$max": {"w": 1}}, {"v": 5, "w": 1}),
        ({"v": 5}, {"$max": {"v": "x"}}, {"v": "x"}),
        ({"v": 9007199254740992}, {"$max": {"v": 9007199254740993}}, {"v": 9007199254740993}),
        ({"v": None}, {"$max": {"v": 1}}, {"v": 1}),
        ({"v": [1]}, {"$push": {"v": {"a": 1}}}, {"v": [1, {"a": 1}]}),
        ({}, {"$push": {"a.b": {"$each": [1, "x", None]}}}, {"a": {"b": [1, "x", None]}}),
        ({"v": [1, 2, 3]}, {"$push": {"v": {"$each": [4], "$slice": -2}}}, {"v": [3, 4]}),
        ({"v": [1, 2, 3]}, {"$push": {"v": {"$each": [4], "$slice": 0}}}, {"v": []}),
        ({"v": [{"a": 2}, {"a": "s"}, 7]}, {"$push": {"v": {"$each": [{"a": 1}], "$slice": 3, "$sort": {"a": -1}}}}, {"v": [{"a": "s"}, {"a": 2}, {"a": 1}]}),
        ({"v": [1, "a"]}, {"$addToSet": {"v": {"$each": [1.0, "b", "b", {"x": 1, "y": 2}]}}}, {"v": [1, "a", "b", {"x": 1, "y": 2}]}),
        ({"v": [{"y": 2, "x": 1}]}, {"$addToSet": {"v": {"x": 1, "y": 2}}}, {"v": [{"x": 1, "y": 2}]}),
        ({}, {"$addToSet": {"v": 1}}, {"v": [1]}),
        ({"v": [1, "1", 1.0, [1]]}, {"$pull": {"v": 1}}, {"v": ["1", [1]]}),
        ({"v": [1, None, 2]}, {"$pullAll": {"v": [None, 2]}}, {"v": [1]}),
        ({"v": [1, 2]}, {"$pop": {"v": 1}}, {"v": [1]}),
        ({"v": [1, 2]}, {"$pop": {"v": -1}}, {"v": [2]}),
        ({"v": []}, {"$pop": {"v": 1}, "$pull": {"a.b": 1}}, {"v": []}),
        ({"v": [1, {"x": 1}]}, {"$set": {"v.3": "d", "v.1.x": 2}}, {"v": [1, {"x": 2}, None, "d"]}),
        ({"v": [1, 2]}, {"$unset": {"v.0": "", "v.7": ""}}, {"v": [None, 2]}),
        ({"v": [5]}, {"$inc": {"v.0": 1}, "$setOnInsert": {"z": 1}}, {"v": [6]}),
    ],
)
def test_more_updates(spark, doc, update, want):
    assert shown(apply_variant_update(frame(spark, json.dumps(doc)), F.lit(True), update, "doc")) == [want]


@pytest.mark.parametrize(
    ("doc", "update", "code"),
    [({"v": "x"}, {"$mul": {"v": 1}}, "16837"), ({"v": 1.5}, {"$bit": {"v": {"or": 1}}}, "10138"), ({"v": None}, {"$push": {"v": 1}}, "10141"),
     ({"v": 1}, {"$pop": {"v": 1}}, "10143"), ({"v": {}}, {"$pull": {"v": 1}}, "10142"), ({"v": 1}, {"$addToSet": {"v": 1}}, "12591")],
)
def test_updates_of_values_of_other_kinds(spark, doc, update, code):
    with pytest.raises(Exception, match=code):
        shown(apply_variant_update(frame(spark, json.dumps(doc)), F.lit(True), update, "doc"))


def test_the_current_date(spark):
    new = apply_variant_update(frame(spark, "{}"), F.lit(True), {"$currentDate": {"t": True}}, "doc")
    assert new.select(F.schema_of_variant(F.try_variant_get("doc", "$.t", "variant"))).first()[0].startswith("TIMESTAMP")


@pytest.mark.parametrize(
    "update",
    [
        lambda n: {"$inc": {f"f{i}": 1 for i in range(n)}}, lambda n: {"$max": {f"f{i}": 1 for i in range(n)}},
        lambda n: {"$set": {f"f{i}": 1 for i in range(n)}}, lambda n: {"$unset": {f"f{i}": "" for i in range(n)}},
        lambda n: {"$rename": {f"f{i}": f"g{i}" for i in range(n)}}, lambda n: {"$pop": {f"f{i}": 1 for i in range(n)}},
        lambda n: {"$addToSet": {"f": {"$each": list(range(n))}}}, lambda n: {"$set": {"f" + n * ".0": 1}},
    ],
)
def test_expressions_grow_by_addition(spark, update):
    """Every further operator, value or step of a path adds as much as the one before."""
    docs = frame(spark, DOC)
    one, two, three = (len(apply_variant_update(docs, F.lit(True), update(n), "doc")._jdf.queryExecution().analyzed().toString()) for n in (1, 2, 3))
    assert three - two < 1.5 * (two - one)


def test_many_operators_of_one_statement(spark):
    n = 12
    doc = {"a": {f"k{i}": i for i in range(n)}, "l": [[1], 2], "m": {f"x{i}": i for i in range(n)}, "s": [1]}
    update = {
        "$inc": {f"a.k{i}": 1 for i in range(n)} | {"l.0.0": 5}, "$set": {f"b.c.d{i}": i for i in range(n)}, "$max": {f"n{i}": i for i in range(n)},
        "$rename": {f"m.x{i}": f"y{i}" for i in range(n)}, "$unset": {f"q.r{i}": "" for i in range(n)}, "$addToSet": {"s": {"$each": list(range(n))}},
    }
    want = {
        "a": {f"k{i}": i + 1 for i in range(n)}, "l": [[6], 2], "m": {}, "s": [1, 0, *range(2, n)], "b": {"c": {f"d{i}": i for i in range(n)}},
        **{f"n{i}": i for i in range(n)}, **{f"y{i}": i for i in range(n)},
    }
    assert shown(apply_variant_update(frame(spark, json.dumps(doc)), F.lit(True), update, "doc")) == [want]
