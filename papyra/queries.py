"""Registered queries of the document language, each with its SQL counterpart."""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import collections as C
from papyra.functions import variants
from papyra.operators.find import Cursor, count, distinct, find, match, matching
from papyra.operators.index import Index, entries, violations
from papyra.operators.update import apply_update, apply_variant_update
from papyra.session import checkpoint_dir, remove_at_exit
from papyra.sources.mixed import MixedCollection
from papyra.sources.store import Collection, Database

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Query, sql: str | None = None) -> None:
    assert name not in QUERIES, name
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _find(table: str, *args, id_field: str = "_id", **more) -> Query:
    return lambda s, d: find(C.load(s, d, table), *args, id_field=id_field, **more)


def _on(make: Callable[[SparkSession, str], DataFrame], query, fields: dict, **more) -> Query:
    return lambda s, d: find(make(s, d), query, {**fields, "_id": 0}, **more)


# --- scans, comparisons, logic ----------------------------------------------------------------

add("find_all", _find("nation"), "SELECT * FROM nation")
add(
    "find_eq", _find("events", {"event_type": "purchase"}, {"event_id": 1, "user_id": 1, "value": 1, "_id": 0}),
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
)
add(
    "find_implicit_and",
    _find("events", {"event_type": "purchase", "value": {"$gte": 50}}, {"event_id": 1, "user_id": 1, "value": 1, "_id": 0}),
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value >= 50",
)
_ORDER = {"o_orderkey": 1, "o_custkey": 1, "o_totalprice": 1}
_KEYS = "o_orderkey, o_custkey, o_totalprice"
add("pk_lookup", _find("orders", {"o_orderkey": 77}, _ORDER, id_field="o_orderkey"), f"SELECT {_KEYS} FROM orders WHERE o_orderkey = 77")
add(
    "pk_range", _find("orders", {"o_orderkey": {"$gte": 100, "$lt": 200}}, _ORDER, id_field="o_orderkey"),
    f"SELECT {_KEYS} FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200",
)
for _op, _sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    add(
        _op, _find("lineitem", {"l_quantity": {f"${_op}": 25}}, {"l_orderkey": 1, "l_linenumber": 1, "l_quantity": 1, "_id": 0}),
        f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sign} 25",
    )
add(
    "range_other_kind", _find("nation", {"n_name": {"$gt": 5}}, {"n_name": 1, "_id": 0}),
    "SELECT n_name FROM nation WHERE false",
)
_D1 = {"doc_id": 1, "quality": 1}


def _d1(name: str, query: dict, where: str) -> None:
    add(name, _on(C.docs, query, _D1), f"WITH {C.D1} SELECT doc_id, quality FROM docs WHERE {where}")


_d1("in", {"quality": {"$in": [0, 1, "x"]}}, "quality IN (0, 1)")
_d1("nin", {"quality": {"$nin": [1, 5]}}, "coalesce(quality NOT IN (1, 5), true)")
_d1("ne", {"quality": {"$ne": 1}}, "quality IS DISTINCT FROM 1")
_d1("eq_operator", {"quality": {"$eq": 1.0}}, "quality = 1")
_d1("eq_null", {"quality": None}, "quality IS NULL")
_d1("in_null", {"quality": {"$in": [None, 0]}}, "quality IS NULL OR quality = 0")
_d1("nin_null", {"quality": {"$nin": [None, 0]}}, "quality IS NOT NULL AND quality <> 0")
_d1("gte_null", {"quality": {"$gte": None}}, "quality IS NULL")
_d1("gt_null", {"quality": {"$gt": None}}, "false")
_d1("ne_null", {"quality": {"$ne": None}}, "quality IS NOT NULL")
_d1("exists_true", {"quality": {"$exists": True}}, "quality IS NOT NULL")
_d1("exists_false", {"quality": {"$exists": False}}, "quality IS NULL")
_d1("missing_field_null", {"no.such.field": None, "toxic": 1}, "toxic = 1")
_d1("and", {"$and": [{"quality": 1}, {"toxic": 0}]}, "quality = 1 AND toxic = 0")
_d1("or", {"$or": [{"quality": 0}, {"toxic": 1}]}, "quality = 0 OR toxic = 1")
_d1("nor", {"$nor": [{"quality": 1}, {"toxic": 1}]}, "NOT coalesce(quality = 1 OR toxic = 1, false)")
_d1("not", {"quality": {"$not": {"$gte": 1}}}, "NOT coalesce(quality >= 1, false)")
_d1("double_not", {"$nor": [{"quality": {"$not": {"$gte": 1}}}]}, "coalesce(quality >= 1, false)")
_d1("empty_or", {"$or": [{"quality": {"$DEBUG_none": 1}}, {"toxic": 1}]}, "toxic = 1")
_d1("debug_none", {"quality": {"$DEBUG_none": 1}}, "false")
_d1("type_int", {"quality": {"$type": 16}}, "quality IS NOT NULL")
_d1("type_long", {"doc_id": {"$type": 18}}, "true")
_d1("type_string", {"lang": {"$type": 2}}, "true")
_d1("type_double", {"quality": {"$type": 1}}, "false")
_d1("type_date", {"doc_id": {"$type": 9}}, "false")
_d1("regex", {"text": {"$regex": "^The"}}, "regexp_matches(text, '^The')")
_d1("regex_i", {"text": {"$regex": "licensed under", "$options": "i"}}, "regexp_matches(text, 'licensed under', 'i')")
_d1("regex_m", {"text": {"$regex": "^Licensed", "$options": "m"}}, "regexp_matches(text, '(?m)^Licensed')")
_d1("regex_s", {"text": {"$regex": "^The.{40,}Licensed", "$options": "s"}}, "regexp_matches(text, '(?s)^The.{40,}Licensed')")
_d1("regex_literal", {"source": re.compile("^SRC1[0-3]$", re.I)}, "regexp_matches(source, '^src1[0-3]$')")
_d1("regex_x", {"source": re.compile("^src 1 $  # one", re.X)}, "source = 'src1'")
_d1("not_regex", {"source": {"$not": re.compile("^src[0-9]$")}}, "NOT regexp_matches(source, '^src[0-9]$')")
add(
    "or_union_disjoint",
    _find("orders", {"$or": [{"o_orderkey": {"$lt": 50}}, {"o_custkey": 7}, {"o_orderkey": {"$gt": 14900}}]}, _ORDER, id_field="o_orderkey"),
    f"SELECT {_KEYS} FROM orders WHERE o_orderkey < 50 OR o_custkey = 7 OR o_orderkey > 14900",
)

# --- paths ------------------------------------------------------------------------------------

add(
    "dotted_struct", _on(C.events, {"props.k": {"$gte": 50}}, {"event_id": 1, "event_type": 1}),
    f"WITH {C.D4} SELECT event_id, event_type FROM ev WHERE props >= 50",
)
_ROLES = "list_transform(turns, lambda x: x.role)"


def _d2(name: str, query: dict, where: str) -> None:
    add(name, _on(C.conversations, query, {"conv_id": 1}), f"WITH {C.D2} SELECT conv_id FROM conv WHERE {where}")


_d2("dotted_array", {"turns.role": "system"}, f"list_contains({_ROLES}, 'system')")
_d2("dotted_index", {"turns.0.role": "user"}, "turns[1].role = 'user'")
_d2("dotted_index_beyond", {"turns.6.role": {"$exists": True}}, "len(turns) > 6")
_d2("size", {"turns": {"$size": 6}}, "len(turns) = 6")
_d2("all", {"turns.role": {"$all": ["user", "system"]}}, f"list_contains({_ROLES}, 'user') AND list_contains({_ROLES}, 'system')")
_d2("all_empty", {"turns.role": {"$all": []}}, "false")
_d2("type_array", {"turns": {"$type": 4}}, "true")
_d2("type_object", {"turns": {"$type": 3}}, "true")
_d2("not_size", {"turns": {"$not": {"$size": 6}}}, "len(turns) <> 6")
_d2(
    "all_elem_match", {"turns": {"$all": [{"$elemMatch": {"role": "user", "turn": 0}}, {"$elemMatch": {"turn": 5}}]}},
    "len(list_filter(turns, lambda x: x.role = 'user' AND x.turn = 0)) > 0 AND len(list_filter(turns, lambda x: x.turn = 5)) > 0",
)


def _d3(name: str, query: dict, where: str, urgent: bool = False) -> None:
    cust = C.D3_URGENT if urgent else C.D3_ALL
    add(name, _on(lambda s, d: C.customers(s, d, urgent), query, {"c_custkey": 1}), f"WITH {cust} SELECT c_custkey FROM cust WHERE {where}")


def _some(test: str) -> str:
    return f"coalesce(len(list_filter(orders, lambda x: {test})) > 0, false)"


_d3("array_elem_eq", {"orders.o_orderstatus": "F"}, _some("x.o_orderstatus = 'F'"))
_d3("array_ne", {"orders.o_orderstatus": {"$ne": "F"}}, f"NOT {_some("x.o_orderstatus = 'F'")}")
_d3("array_nin", {"orders.o_orderstatus": {"$nin": ["F", "P"]}}, f"NOT {_some("x.o_orderstatus IN ('F', 'P')")}")
_d3("array_missing", {"orders": None}, "orders IS NULL", urgent=True)
_d3("array_exists", {"orders.o_orderkey": {"$exists": True}}, "orders IS NOT NULL")
_d3("array_null_below", {"orders.o_totalprice": None}, "orders IS NULL", urgent=True)
_d3(
    "elem_match", {"orders": {"$elemMatch": {"o_totalprice": {"$gt": 100000, "$lt": 150000}, "o_orderstatus": "F"}}},
    _some("x.o_totalprice > 100000 AND x.o_totalprice < 150000 AND x.o_orderstatus = 'F'"),
)
_d3(
    "two_ranges", {"orders.o_totalprice": {"$gt": 250000, "$lt": 50000}},
    f"{_some('x.o_totalprice > 250000')} AND {_some('x.o_totalprice < 50000')}",
)
_d3(
    "elem_match_or", {"orders": {"$elemMatch": {"$or": [{"o_totalprice": {"$gt": 400000}}, {"o_orderkey": {"$lt": 20}}]}}},
    _some("x.o_totalprice > 400000 OR x.o_orderkey < 20"),
)
_d3("not_elem_match", {"orders": {"$not": {"$elemMatch": {"o_orderstatus": "O"}}}}, f"NOT {_some("x.o_orderstatus = 'O'")}")
add(
    "elem_match_values",
    lambda s, d: match(
        C.load(s, d, "embeddings"), {"embedding": {"$elemMatch": {"$gt": 0.3, "$lt": 0.32}}}
    ).select("vec_id"),
    "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3 AND x < 0.32)) > 0",
)

# --- projection, sort, skip, limit ------------------------------------------------------------

add("proj_incl", _find("customer", {}, {"c_name": 1, "c_mktsegment": 1}, id_field="c_custkey"), "SELECT c_custkey, c_name, c_mktsegment FROM customer")
add("proj_excl", _find("customer", {}, {"c_acctbal": 0, "c_name": 0}, id_field="c_custkey"), "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
add("proj_id_only", _find("customer", {}, {"c_custkey": 1}, id_field="c_custkey"), "SELECT c_custkey FROM customer")
add("proj_no_id", _find("region", {}, {"r_regionkey": 0}, id_field="r_regionkey"), "SELECT r_name FROM region")
add(
    "proj_dotted",
    lambda s, d: find(C.events(s, d), {}, {"props.k": 1}, id_field="event_id").select("event_id", F.col("props.k").alias("k")),
    f"WITH {C.D4} SELECT event_id, props AS k FROM ev",
)
add(
    "proj_array",
    lambda s, d: find(C.conversations(s, d), {}, {"turns.role": 1}, id_field="conv_id").select(
        "conv_id", F.concat_ws(",", F.transform("turns", lambda x: x["role"])).alias("roles")
    ),
    f"WITH {C.D2} SELECT conv_id, array_to_string({_ROLES}, ',') AS roles FROM conv",
)
add(
    "proj_array_excl",
    lambda s, d: find(C.conversations(s, d), {}, {"turns.text": 0}, id_field="conv_id").select(
        "conv_id", F.concat_ws(",", F.transform("turns", lambda x: F.concat(x["turn"], F.lit(":"), x["role"]))).alias("turns")
    ),
    f"WITH {C.D2} SELECT conv_id, array_to_string(list_transform(turns, lambda x: x.turn || ':' || x.role), ',') AS turns FROM conv",
)
add(
    "sort_multi", _find("orders", {"o_orderstatus": "P"}, _ORDER, sort={"o_custkey": 1, "o_orderkey": -1}, limit=50, id_field="o_orderkey"),
    f"SELECT {_KEYS} FROM orders WHERE o_orderstatus = 'P' ORDER BY o_custkey, o_orderkey DESC LIMIT 50",
)
add(
    "sort_missing_first", _on(C.docs, {}, _D1, sort={"quality": 1, "doc_id": 1}, limit=40),
    f"WITH {C.D1} SELECT doc_id, quality FROM docs ORDER BY quality NULLS FIRST, doc_id LIMIT 40",
)
add(
    "sort_missing_last", _on(C.docs, {}, _D1, sort={"quality": -1, "doc_id": 1}, limit=40),
    f"WITH {C.D1} SELECT doc_id, quality FROM docs ORDER BY quality DESC NULLS LAST, doc_id LIMIT 40",
)
add(
    "sort_array", _on(C.customers, {"orders": {"$exists": True}}, {"c_custkey": 1}, sort={"orders.o_totalprice": -1, "c_custkey": 1}, limit=20),
    f"WITH {C.D3_ALL} SELECT c_custkey FROM cust WHERE orders IS NOT NULL"
    " ORDER BY list_max(list_transform(orders, lambda x: x.o_totalprice)) DESC, c_custkey LIMIT 20",
)
add(
    "skip_limit", _find("orders", {}, _ORDER, sort={"o_totalprice": -1, "o_orderkey": 1}, skip=30, limit=20, id_field="o_orderkey"),
    f"SELECT {_KEYS} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30",
)
add(
    "negative_limit", _find("orders", {}, _ORDER, sort={"o_orderkey": 1}, limit=-5, id_field="o_orderkey"),
    f"SELECT {_KEYS} FROM orders ORDER BY o_orderkey LIMIT 5",
)

# --- count, distinct --------------------------------------------------------------------------

add("count", lambda s, d: count(C.load(s, d, "events"), {"event_type": "click"}), "SELECT count(*) AS n FROM events WHERE event_type = 'click'")
add("count_all", lambda s, d: count(C.load(s, d, "lineitem")), "SELECT count(*) AS n FROM lineitem")
add("count_skip", lambda s, d: count(C.load(s, d, "events"), {"event_type": "click"}, skip=100), "SELECT greatest(count(*) - 100, 0) AS n FROM events WHERE event_type = 'click'")
add("count_skip_all", lambda s, d: count(C.load(s, d, "nation"), {}, skip=100), "SELECT CAST(0 AS BIGINT) AS n")
add("count_limit", lambda s, d: count(C.load(s, d, "nation"), {}, skip=3, limit=10), "SELECT CAST(10 AS BIGINT) AS n")
add("distinct", lambda s, d: distinct(C.load(s, d, "events"), "event_type"), "SELECT DISTINCT event_type AS value FROM events")
add(
    "distinct_query", lambda s, d: distinct(C.load(s, d, "orders"), "o_orderpriority", {"o_totalprice": {"$gt": 300000}}),
    "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_totalprice > 300000",
)
add(
    "distinct_array", lambda s, d: distinct(C.customers(s, d), "orders.o_orderstatus"),
    f"WITH {C.D3_ALL} SELECT DISTINCT unnest(list_transform(orders, lambda x: x.o_orderstatus)) AS value FROM cust",
)
add("distinct_missing", lambda s, d: distinct(C.docs(s, d), "quality"), f"WITH {C.D1} SELECT DISTINCT quality AS value FROM docs WHERE quality IS NOT NULL")

# --- updates ----------------------------------------------------------------------------------


def _updated(make, query: dict, update: dict, *columns: str, id_field: str = "_id") -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = make(s, d)
        hit = F.coalesce(matching(df, query).pos, F.lit(False))
        return apply_update(df, hit, update, id_field).selectExpr(*columns)

    return run


def _part(s: SparkSession, d: str) -> DataFrame:
    return C.load(s, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


def _upd(name: str, update: dict, expression: str, column: str = "p_size") -> None:
    add(
        f"upd_{name}", _updated(_part, {"p_size": {"$gt": 25}}, update, "p_partkey", column),
        f"SELECT p_partkey, CASE WHEN p_size > 25 THEN {expression} ELSE {column} END AS {column} FROM part",
    )


_upd("set", {"$set": {"p_name": "new"}}, "'new'", "p_name")
_upd("unset", {"$unset": {"p_name": ""}}, "NULL", "p_name")
_upd("inc", {"$inc": {"p_size": 5}}, "p_size + 5")
_upd("mul", {"$mul": {"p_size": 3}}, "p_size * 3")
_upd("inc_double", {"$inc": {"p_retailprice": 0.5}}, "p_retailprice + 0.5", "p_retailprice")
_upd("min", {"$min": {"p_size": 30}}, "least(p_size, 30)")
_upd("max", {"$max": {"p_size": 40}}, "greatest(p_size, 40)")
_upd("bit_and", {"$bit": {"p_size": {"and": 12}}}, "p_size & 12")
_upd("bit_or", {"$bit": {"p_size": {"or": 64}}}, "p_size | 64")
_upd("bit_xor", {"$bit": {"p_size": {"xor": 21}}}, "xor(p_size, 21)")
_upd("set_on_insert", {"$setOnInsert": {"p_name": "x"}, "$inc": {"p_size": 1}}, "p_size + 1")
add(
    "upd_set_new_field", _updated(_part, {"p_size": 1}, {"$set": {"extra.note": "small"}}, "p_partkey", "extra.note AS note"),
    "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'small' END AS note FROM part",
)
add(
    "upd_rename", _updated(_part, {"p_size": {"$lte": 10}}, {"$rename": {"p_name": "title"}}, "p_partkey", "p_name", "title"),
    "SELECT p_partkey, CASE WHEN p_size <= 10 THEN NULL ELSE p_name END AS p_name,"
    " CASE WHEN p_size <= 10 THEN p_name END AS title FROM part",
)
add("upd_inc_missing", _updated(C.docs, {}, {"$inc": {"quality": 3}}, "doc_id", "quality"), f"WITH {C.D1} SELECT doc_id, coalesce(quality, 0) + 3 AS quality FROM docs")
add("upd_mul_missing", _updated(C.docs, {}, {"$mul": {"quality": 3}}, "doc_id", "quality"), f"WITH {C.D1} SELECT doc_id, coalesce(quality * 3, 0) AS quality FROM docs")
add("upd_max_missing", _updated(C.docs, {}, {"$max": {"quality": 0}}, "doc_id", "quality"), f"WITH {C.D1} SELECT doc_id, greatest(coalesce(quality, 0), 0) AS quality FROM docs")
add(
    "upd_current_date", _updated(_part, {"p_size": 1}, {"$currentDate": {"at": True}}, "p_partkey", "at IS NOT NULL AS dated"),
    "SELECT p_partkey, p_size = 1 AS dated FROM part",
)
add(
    "upd_dotted", _updated(C.events, {"event_type": "click"}, {"$inc": {"props.k": 100}}, "event_id", "props.k AS k"),
    f"WITH {C.D4} SELECT event_id, CASE WHEN event_type = 'click' THEN props + 100 ELSE props END AS k FROM ev",
)
_JOINED = "concat_ws(',', roles) AS roles"


def _roles(s: SparkSession, d: str) -> DataFrame:
    return C.conversations(s, d).select("conv_id", F.transform("turns", lambda x: x["role"]).alias("roles"))


def _arr(name: str, update: dict, expression: str) -> None:
    add(
        f"upd_{name}", _updated(_roles, {}, update, "conv_id", _JOINED),
        f"WITH {C.D2}, r AS (SELECT conv_id, {_ROLES} AS roles FROM conv)"
        f" SELECT conv_id, array_to_string({expression}, ',') AS roles FROM r",
    )


_arr("push", {"$push": {"roles": "end"}}, "list_append(roles, 'end')")
_arr("push_each", {"$push": {"roles": {"$each": ["a", "b"]}}}, "list_concat(roles, ['a', 'b'])")
_arr("push_slice", {"$push": {"roles": {"$each": ["a"], "$slice": 2}}}, "list_append(roles, 'a')[1:2]")
_arr("push_slice_last", {"$push": {"roles": {"$each": ["a"], "$slice": -2}}}, "list_append(roles, 'a')[-2:]")
_arr("push_slice_none", {"$push": {"roles": {"$each": ["a"], "$slice": 0}}}, "CAST([] AS VARCHAR[])")
_arr("pop_last", {"$pop": {"roles": 1}}, "roles[1:len(roles) - 1]")
_arr("pop_first", {"$pop": {"roles": -1}}, "roles[2:]")
_arr("pull", {"$pull": {"roles": "user"}}, "list_filter(roles, lambda x: x <> 'user')")
_arr("pullall", {"$pullAll": {"roles": ["user", "system"]}}, "list_filter(roles, lambda x: x NOT IN ('user', 'system'))")
_arr("addtoset", {"$addToSet": {"roles": "system"}}, "CASE WHEN list_contains(roles, 'system') THEN roles ELSE list_append(roles, 'system') END")
_arr(
    "addtoset_each", {"$addToSet": {"roles": {"$each": ["tool", "user", "tool"]}}},
    "list_concat(list_append(roles, 'tool'), CASE WHEN list_contains(roles, 'user') THEN CAST([] AS VARCHAR[]) ELSE ['user'] END)",
)
_arr("set_index", {"$set": {"roles.1": "second"}}, "list_transform(roles, lambda x, i: CASE WHEN i = 2 THEN 'second' ELSE x END)")
add(
    "upd_push_sort_slice",
    _updated(
        C.customers, {}, {"$push": {"orders": {"$each": [{"o_orderkey": 0, "o_totalprice": 123456.5}], "$sort": {"o_totalprice": -1, "o_orderkey": 1}, "$slice": 3}}},
        "c_custkey", "concat_ws(',', transform(orders, x -> CAST(x.o_orderkey AS STRING))) AS keys",
    ),
    f"WITH {C.D3_ALL}, u AS (SELECT c_custkey, unnest(list_append(list_transform(coalesce(orders, []), lambda x: "
    "{'k': x.o_orderkey, 'p': x.o_totalprice}), {'k': 0, 'p': 123456.5})) AS o FROM cust),"
    " r AS (SELECT c_custkey, o.k AS k, row_number() OVER (PARTITION BY c_custkey ORDER BY o.p DESC, o.k) AS n FROM u)"
    " SELECT c_custkey, string_agg(CAST(k AS VARCHAR), ',' ORDER BY n) AS keys FROM r WHERE n <= 3 GROUP BY c_custkey",
)

# --- replace, upsert, delete, insert, find and modify -----------------------------------------


def scratch(s: SparkSession) -> Database:
    """A database of its own below the checkpoint folder, removed when the session ends."""
    root = f"{checkpoint_dir(s)}/scratch-{uuid.uuid4().hex}"
    remove_at_exit(s, root)
    return Database(s, root, "db")


def stored(s: SparkSession, d: str, table: str, id_field: str) -> tuple[Database, Collection]:
    """A table as a collection of that name, its id field as ``_id``."""
    db = scratch(s)
    db[table].insert(C.load(s, d, table).withColumnRenamed(id_field, "_id"))
    return db, db[table]


def _write(name: str, table: str, id_field: str, statement: Callable[[Collection], object], sql: str, *columns: str) -> None:
    """A statement on a stored table; the query gives the collection as it is afterwards."""

    def run(s: SparkSession, d: str) -> DataFrame:
        _, held = stored(s, d, table, id_field)
        statement(held)
        found = held.find()
        return found.selectExpr(*(columns or [c for c in found.columns])).withColumnRenamed("_id", id_field)

    add(name, run, sql)


_NATION = "n_nationkey, n_name, n_regionkey"
_IN_NATION = ("_id", "n_name", "n_regionkey")
_IN_REGION = ("_id", "r_name")
_write(
    "upd_replace", "region", "r_regionkey", lambda c: c.update({"_id": {"$gte": 2}}, {"note": "new"}),
    "SELECT r_regionkey, CASE WHEN r_regionkey <> 2 THEN r_name END AS r_name, CASE WHEN r_regionkey = 2 THEN 'new' END AS note FROM region",
)
_write(
    "update_one", "nation", "n_nationkey", lambda c: c.update({"n_regionkey": 2}, {"$set": {"n_name": "X"}}),
    "SELECT n_nationkey, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2) THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation",
    *_IN_NATION,
)
_write(
    "update_many", "nation", "n_nationkey", lambda c: c.update({"n_regionkey": {"$gte": 2}}, {"$inc": {"n_regionkey": 7}}, multi=True),
    "SELECT n_nationkey, n_name, CASE WHEN n_regionkey >= 2 THEN n_regionkey + 7 ELSE n_regionkey END AS n_regionkey FROM nation", *_IN_NATION,
)
_write(
    "delete_many", "nation", "n_nationkey", lambda c: c.delete({"n_regionkey": {"$in": [1, 2]}}),
    f"SELECT {_NATION} FROM nation WHERE n_regionkey NOT IN (1, 2)", *_IN_NATION,
)
_write(
    "delete_one", "nation", "n_nationkey", lambda c: c.delete({"n_regionkey": 3}, 1),
    f"SELECT {_NATION} FROM nation WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 3)", *_IN_NATION,
)


def _modify(name: str, sql: str, **arguments) -> None:
    """Find-and-modify on nations: the document that it gives, and the same one as it is stored afterwards."""

    def run(s: SparkSession, d: str) -> DataFrame:
        _, held = stored(s, d, "nation", "n_nationkey")
        got = held.find_and_modify(**arguments)
        given = s.createDataFrame([(got["_id"], got["n_regionkey"])], "n_nationkey int, given int")
        after = held.find().select(F.col("_id").alias("n_nationkey"), F.col("n_regionkey").alias("stored"))
        return given.join(after, "n_nationkey", "left").crossJoin(after.agg(F.count("*").alias("n")))

    add(name, run, f"WITH x AS (SELECT n_nationkey, n_regionkey AS r FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 1) {sql}")


_INC = {"$inc": {"n_regionkey": 10}}
_modify("find_and_modify_old", "SELECT n_nationkey, r AS given, r + 10 AS stored, (SELECT count(*) FROM nation) AS n FROM x", query={"n_regionkey": 1}, update=_INC)
_modify("find_and_modify_new", "SELECT n_nationkey, r + 10 AS given, r + 10 AS stored, (SELECT count(*) FROM nation) AS n FROM x", query={"n_regionkey": 1}, update=_INC, new=True)
_modify("find_and_modify_remove", "SELECT n_nationkey, r AS given, CAST(NULL AS INT) AS stored, (SELECT count(*) - 1 FROM nation) AS n FROM x", query={"n_regionkey": 1}, remove=True)
_write(
    "find_and_modify_upsert", "region", "r_regionkey",
    lambda c: c.find_and_modify({"_id": 50}, {"$set": {"r_name": "FIFTY"}}, upsert=True, new=True),
    "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'FIFTY'", *_IN_REGION,
)


def _upsert(name: str, query: dict, update: dict, sql: str, *columns: str) -> None:
    _write(name, "region", "r_regionkey", lambda c: c.update(query, update, upsert=True), sql, *(columns or _IN_REGION))


_upsert("upsert_match", {"_id": 3}, {"$set": {"r_name": "Z"}}, "SELECT r_regionkey, CASE WHEN r_regionkey = 3 THEN 'Z' ELSE r_name END AS r_name FROM region")
_upsert("upsert_insert", {"_id": 99}, {"$set": {"r_name": "NEW"}}, "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEW'")
_upsert(
    "upsert_seed_from_query", {"$and": [{"_id": {"$eq": 77}}, {"r_name": "FROM QUERY"}]}, {"$setOnInsert": {"note": "x"}},
    "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note FROM region UNION ALL SELECT 77, 'FROM QUERY', 'x'", *_IN_REGION, "note",
)
_upsert("upsert_id_from_set", {"r_name": "NOBODY"}, {"$set": {"_id": 41}}, "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 41, 'NOBODY'")
_upsert("upsert_replacement", {"_id": 42}, {"r_name": "WHOLE"}, "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 42, 'WHOLE'")
_write(
    "insert_many", "region", "r_regionkey", lambda c: c.insert([{"_id": 100, "r_name": "A"}, {"_id": 101, "r_name": "B"}]),
    "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (100, 'A'), (101, 'B')", *_IN_REGION,
)


def _commands(name: str, table: str, id_field: str, steps: list[dict], sql: str, schema: str, rows: Callable[[Database, list[dict]], list]) -> None:
    """Command documents on a stored table; ``rows`` makes the result of the database and the answers."""

    def run(s: SparkSession, d: str) -> DataFrame:
        db, _ = stored(s, d, table, id_field)
        return s.createDataFrame(rows(db, [db.command(c) for c in steps]), schema)

    add(name, run, sql)


def _region_command(name: str, steps: list[dict], sql: str, schema: str, rows) -> None:
    _commands(name, "region", "r_regionkey", steps, sql, schema, rows)


_REGIONS = "(SELECT count(*) FROM region)"
_region_command(
    "insert_duplicate_check",
    [{"insert": "region", "documents": [{"_id": 200}, {"_id": 1}]}, {"insert": "region", "documents": [{"_id": 201}, {"_id": 201}]}],
    f"SELECT 11000 AS stored, 11000 AS within, {_REGIONS} AS n", "stored int, within int, n long",
    lambda db, a: [(a[0]["code"], a[1]["code"], db["region"].count())],
)
_region_command(
    "cmd_insert", [{"insert": "region", "documents": [{"_id": 200, "r_name": "A"}, {"_id": 201}]}],
    f"SELECT CAST(2 AS BIGINT) AS n, {_REGIONS} + 2 AS held", "n long, held long", lambda db, a: [(a[0]["n"], db["region"].count())],
)
_region_command(
    "cmd_update",
    [{"update": "region", "updates": [
        {"q": {"_id": {"$lt": 3}}, "u": {"$set": {"r_name": "Q"}}, "multi": True}, {"q": {"_id": 70}, "u": {"$set": {"r_name": "U"}}, "upsert": True},
        {"q": {}, "u": {"r_name": "no"}, "multi": True}, {"q": {"_id": 4}, "u": {"$set": {"r_name": "never"}}},
    ]}],
    "SELECT count(*) + 1 AS n, count(*) AS modified, 70 AS upserted, 2 AS failed, 10158 AS code, count(*) + 1 AS changed FROM region WHERE r_regionkey < 3",
    "n long, modified long, upserted int, failed int, code int, changed long",
    lambda db, a: [(
        a[0]["n"], a[0]["nModified"], a[0]["upserted"][0]["_id"], a[0]["writeErrors"][0]["index"], a[0]["writeErrors"][0]["code"],
        db["region"].count({"r_name": {"$in": ["Q", "U", "never"]}}),
    )],
)
_region_command(
    "cmd_delete", [{"delete": "region", "deletes": [{"q": {"_id": {"$gte": 3}}, "limit": 0}, {"q": {}, "limit": 1}]}, {"delete": "none", "deletes": [{"q": {}}]}],
    "SELECT count(*) FILTER (r_regionkey >= 3) + 1 AS n, CAST(0 AS BIGINT) AS none, count(*) FILTER (r_regionkey < 3) - 1 AS held FROM region",
    "n long, none long, held long", lambda db, a: [(a[0]["n"], a[1]["n"], db["region"].count())],
)
_region_command(
    "cmd_findandmodify",
    [{"findAndModify": "region", "query": {"_id": 2}, "update": {"$set": {"r_name": "M"}}, "new": True}, {"findAndModify": "region", "query": {}, "sort": {"_id": 1}, "remove": True},
     {"findAndModify": "region", "query": {}}],
    "SELECT 'M' AS r_name, 20002 AS sorted, 15899 AS neither", "r_name string, sorted int, neither int",
    lambda db, a: [(a[0]["value"]["r_name"], a[1]["code"], a[2]["code"])],
)
_region_command(
    "cmd_getlasterror", [{"insert": "region", "documents": [{"_id": 300}]}, {"getLastError": 1}, {"insert": "region", "documents": [{"_id": 300}]}, {"getLastError": 1}],
    "SELECT CAST(1 AS BIGINT) AS n, true AS fine, 11000 AS code", "n long, fine boolean, code int",
    lambda db, a: [(a[1]["n"], a[1]["err"] is None, a[3]["code"])],
)
_region_command(
    "cmd_count", [{"count": "region", "query": {"_id": {"$gte": 1}}}, {"count": "region", "skip": 2}, {"count": "region", "limit": 3}, {"count": "none"}],
    "SELECT count(*) FILTER (r_regionkey >= 1) AS found, count(*) - 2 AS skipped, CAST(3 AS BIGINT) AS limited, CAST(0 AS BIGINT) AS none FROM region",
    "found long, skipped long, limited long, none long", lambda db, a: [tuple(x["n"] for x in a)],
)
_commands(
    "cmd_distinct", "nation", "n_nationkey", [{"distinct": "nation", "key": "n_regionkey", "query": {"n_regionkey": {"$lt": 3}}}],
    "SELECT n_regionkey AS value, (SELECT count(*) FROM nation WHERE n_regionkey < 3) AS n, (SELECT count(*) FROM nation) AS nscanned"
    " FROM nation WHERE n_regionkey < 3 GROUP BY n_regionkey",
    "value int, n long, nscanned long", lambda db, a: [(v, a[0]["stats"]["n"], a[0]["stats"]["nscanned"]) for v in a[0]["values"]],
)
_region_command(
    "cmd_create_drop",
    [{"create": "fresh"}, {"create": "capped", "capped": True}, {"listCollections": 1}, {"listCollections": 1, "cursor": {"batchSize": 5}}, {"drop": "fresh"}, {"drop": "fresh"},
     {"listDatabases": 1}, {"dropDatabase": 1}, {"listCollections": 1}],
    "SELECT 11002 AS capped, 'fresh,region' AS names, 11002 AS batched, 1 AS dropped, 0 AS again, 'db' AS databases, 0 AS rest",
    "capped int, names string, batched int, dropped int, again int, databases string, rest int",
    lambda db, a: [(a[1]["code"], ",".join(a[2]["collections"]), a[3]["code"], a[4]["ok"], a[5]["ok"], ",".join(a[6]["databases"]), len(a[8]["collections"]))],
)
_region_command(
    "cmd_rename",
    [{"create": "other"}, {"renameCollection": "db.none", "to": "db.x"}, {"renameCollection": "db.region", "to": "db.other"}, {"renameCollection": "db.region", "to": "db.region"},
     {"renameCollection": "db.region", "to": "db.other", "dropTarget": True}],
    f"SELECT 29976 AS missing, 29977 AS taken, 29978 AS same, 1 AS done, 'other' AS names, {_REGIONS} AS n",
    "missing int, taken int, same int, done int, names string, n long",
    lambda db, a: [(a[1]["code"], a[2]["code"], a[3]["code"], a[4]["ok"], ",".join(db.collections()), db["other"].count())],
)
_NAME = {"key": {"n_name": 1}, "name": "by_name", "unique": True}
_commands(
    "cmd_indexes", "nation", "n_nationkey",
    [{"createIndexes": "nation", "indexes": [_NAME]}, {"createIndexes": "nation", "indexes": [_NAME]}, {"createIndexes": "nation", "indexes": [{"key": {"n_regionkey": 1}, "name": "by_name"}]},
     {"createIndexes": "nation", "indexes": [{"key": {"n_regionkey": 1}, "name": "by_region", "unique": True}]},
     {"createIndexes": "nation", "indexes": [{"key": {"a": 1, "b": -1}, "name": "x"}]}, {"createIndexes": "nation", "indexes": [{"key": {"a": "text"}, "name": "x"}]},
     {"createIndexes": "nation", "indexes": [{"key": {"_id": 1, "b": 1}, "name": "x"}]}, {"createIndexes": "nation", "indexes": [{"key": {"a": 1}}]},
     {"listIndexes": "nation"}, {"collStats": "nation"}, {"dbStats": 1}],
    "SELECT 2 AS made, 2 AS again, 29993 AS same_name, 11000 AS violated, 29990 AS mixed, 29969 AS text, 29982 AS with_id, 29967 AS no_name,"
    " '_id_:ready,by_name:ready' AS names, 2 AS nindexes, (SELECT count(*) FROM nation) AS n, 1 AS collections",
    "made int, again int, same_name int, violated int, mixed int, text int, with_id int, no_name int, names string, nindexes int, n long, collections int",
    lambda db, a: [(
        a[0]["numIndexesAfter"], a[1]["numIndexesAfter"], *(x["code"] for x in a[2:8]), ",".join(f"{i['name']}:{i['status']}" for i in a[8]["indexes"]),
        a[9]["nindexes"], a[9]["count"], a[10]["collections"],
    )],
)
_commands(
    "cmd_drop_indexes", "nation", "n_nationkey",
    [{"createIndexes": "nation", "indexes": [_NAME, {"key": "n_regionkey", "name": "r"}, {"key": {"n_regionkey": 1, "n_name": 1}, "name": "rn"}]},
     {"insert": "nation", "documents": [{"_id": 900, "n_name": "NATION_3"}]}, {"dropIndexes": "nation", "index": "by_name"}, {"dropIndexes": "nation", "index": {"n_regionkey": 1}},
     {"insert": "nation", "documents": [{"_id": 900, "n_name": "NATION_3"}]}, {"deleteIndexes": "nation", "index": "*"}, {"dropIndexes": "nation", "index": "none"}],
    "SELECT 4 AS held, 11000 AS refused, 1 AS by_name, 1 AS by_key, CAST(1 AS BIGINT) AS accepted, 1 AS rest, 0 AS nothing",
    "held int, refused int, by_name int, by_key int, accepted long, rest int, nothing int",
    lambda db, a: [(a[0]["numIndexesAfter"], a[1]["code"], a[2]["dropped"], a[3]["dropped"], a[4]["n"], a[5]["dropped"], a[6]["dropped"])],
)
_region_command(
    "cmd_info",
    [{"buildInfo": 1}, {"isMaster": 1}, {"ping": 1}, {"serverStatus": 1}, {"connectionStatus": 1}, {"availableQueryOptions": 1}, {"getCmdLineOpts": 1}, {"getLog": "global"},
     {"getDocLayerVersion": 1}, {"whatsMyUri": 1}, {"getNonce": 1}, {"getKVStatus": 1}, {"getMemoryUsage": 1}, {"replSetGetStatus": 1}, {"fakeError": 1}, {"noSuch": 1}],
    "SELECT '3.0.0' AS version, 16777216 AS most, 13 AS ok, 0 AS repl, 29966 AS fake, 0 AS unknown", "version string, most int, ok int, repl int, fake int, unknown int",
    lambda db, a: [(a[0]["version"], a[1]["maxBsonObjectSize"], sum(x["ok"] for x in a), a[13]["ok"], a[14]["code"], a[15]["ok"])],
)
add(
    "find_wrapped",
    lambda s, d: stored(s, d, "nation", "n_nationkey")[1].find({"$query": {"n_regionkey": {"$gte": 2}}, "$orderby": {"n_name": -1}, "$hint": "by_name"}, {"n_name": 1}, limit=5).withColumnRenamed("_id", "n_nationkey"),
    "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= 2 ORDER BY n_name DESC LIMIT 5",
)
add(
    "find_by_id",
    lambda s, d: stored(s, d, "nation", "n_nationkey")[1].find({"_id": {"$gt": 3, "$lte": 9}}, {"_id.x": 1, "n_name": 1}).withColumnRenamed("_id", "n_nationkey"),
    "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 3 AND n_nationkey <= 9",
)
add(
    "cursor_batches",
    lambda s, d: s.createDataFrame(
        [(n, len(b)) for n, b in enumerate(_batches(find(C.load(s, d, "events"), {"event_type": "click"}, {"event_id": 1, "_id": 0})))], "batch int, n int"
    ),
    "WITH c AS (SELECT count(*) AS n FROM events WHERE event_type = 'click'), b AS (SELECT unnest(range(0, (SELECT 1 + CAST(ceil(greatest(n - 101, 0) / 1000) AS BIGINT) FROM c))) AS batch)"
    " SELECT CAST(batch AS INT) AS batch, CAST(CASE WHEN batch = 0 THEN least(n, 101) ELSE least(1000, n - 101 - (batch - 1) * 1000) END AS INT) AS n FROM b, c",
)


def _batches(df: DataFrame):
    cursor = Cursor(df)
    while cursor.alive and (batch := cursor.next_batch()):
        yield batch


_ENDS = "SELECT * FROM (VALUES (1, {a}), (2, {b}), (3, {c})) t(id, x)"


def _at_ends(name: str, update: dict, kind: str, before: tuple, after: tuple) -> None:
    """An update of integers next to the ends of their type."""

    def run(s: SparkSession, d: str) -> DataFrame:
        df = s.createDataFrame(list(enumerate(before, 1)), f"id int, x {kind}")
        return apply_update(df, F.lit(True), update, "id")

    cast = "INT" if kind == "int" else "BIGINT"
    a, b, c = (f"CAST({v} AS {cast})" for v in after)
    add(name, run, _ENDS.format(a=a, b=b, c=c))


_at_ends("upd_inc_overflow", {"$inc": {"x": 2}}, "int", (2**31 - 1, -5, 2**31 - 3), (-(2**31) + 1, -3, 2**31 - 1))
_at_ends("upd_inc_overflow_long", {"$inc": {"x": 2}}, "long", (2**63 - 1, -(2**63), 7), (-(2**63) + 1, -(2**63) + 2, 9))
_at_ends("upd_mul_overflow", {"$mul": {"x": 3}}, "int", (2**30, -(2**31), 5), (3 * 2**30 - 2**32, -(2**31), 15))
_at_ends("upd_mul_overflow_long", {"$mul": {"x": 4}}, "long", (2**62 + 1, -(2**63) + 3, 5), (4, 12, 20))
_at_ends("upd_bit_long", {"$bit": {"x": {"or": 1}}}, "long", (2**40 + 6, 2**31, -2), (7, -(2**31) + 1, -1))

# --- indexes ----------------------------------------------------------------------------------

_STATUS = Index("status", (("orders.o_orderstatus", 1),), True)
add(
    "index_entries_simple", lambda s, d: entries(C.customers(s, d), _STATUS, "c_custkey"),
    f"WITH {C.D3_ALL} SELECT DISTINCT unnest(CASE WHEN orders IS NULL THEN [NULL] ELSE list_transform(orders, lambda x: x.o_orderstatus) END) AS k0, c_custkey AS id FROM cust",
)
add(
    "index_entries_compound",
    lambda s, d: entries(C.customers(s, d), Index("c", (("c_mktsegment", 1), ("orders.o_orderstatus", 1))), "c_custkey"),
    f"WITH {C.D3_ALL} SELECT DISTINCT c_mktsegment AS k0, unnest(CASE WHEN orders IS NULL THEN [NULL] ELSE list_transform(orders, lambda x: x.o_orderstatus) END) AS k1, c_custkey AS id FROM cust",
)
add(
    "unique_violations", lambda s, d: violations(C.customers(s, d), _STATUS, "c_custkey"),
    f"WITH {C.D3_ALL}, e AS (SELECT DISTINCT unnest(CASE WHEN orders IS NULL THEN [NULL] ELSE list_transform(orders, lambda x: x.o_orderstatus) END) AS k0, c_custkey AS id FROM cust)"
    " SELECT k0, count(*) AS n FROM e GROUP BY k0 HAVING count(DISTINCT id) > 1",
)


def _indexed(s: SparkSession, d: str, *keys: dict) -> Collection:
    """All orders as a collection of one statement a status, so of several data files, with indexes."""
    orders = C.load(s, d, "orders").withColumnRenamed("o_orderkey", "_id")
    held = scratch(s)["orders"]
    for status in ("F", "O", "P"):
        held.insert(orders.filter(F.col("o_orderstatus") == status))
    for n, key in enumerate(keys):
        held.create_index({"key": key, "name": f"i{n}"})
    return held


def _index_scan(name: str, keys: list[dict], query: dict, where: str, access: str) -> None:
    """A find through stored entries, and the access that explain names."""

    def run(s: SparkSession, d: str) -> DataFrame:
        held = _indexed(s, d, *keys)
        return held.find(query).select(F.col("_id").alias("o_orderkey"), "o_totalprice", F.lit(held.explain(query)["access"]["type"]).alias("access"))

    add(f"index_scan_{name}", run, f"SELECT o_orderkey, o_totalprice, '{access}' AS access FROM orders WHERE {where}")


_index_scan("eq", [{"o_orderstatus": 1}], {"o_orderstatus": "P"}, "o_orderstatus = 'P'", "index scan")
_index_scan("range", [{"o_totalprice": 1}], {"o_totalprice": {"$gte": 1000, "$lt": 50000}}, "o_totalprice >= 1000 AND o_totalprice < 50000", "index scan")
_index_scan(
    "compound", [{"o_orderstatus": 1, "o_totalprice": 1}], {"o_orderstatus": "F", "o_totalprice": {"$gt": 300000}}, "o_orderstatus = 'F' AND o_totalprice > 300000", "index scan",
)
_index_scan(
    "union", [{"o_orderstatus": 1}, {"o_custkey": 1}], {"$or": [{"o_orderstatus": "P"}, {"o_custkey": {"$lt": 50}}]}, "o_orderstatus = 'P' OR o_custkey < 50", "union",
)
_index_scan("none", [{"o_orderstatus": 1}], {"o_orderstatus": {"$ne": "P"}}, "o_orderstatus <> 'P'", "table scan")


def _indexed_writes(s: SparkSession, d: str) -> DataFrame:
    held = _indexed(s, d, {"o_orderstatus": 1})
    held.update({"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "Q"}}, multi=True)
    held.delete({"o_orderstatus": "F"})
    return held.index_entries("i0")


add(
    "index_entries_after_writes", _indexed_writes,
    "SELECT CASE WHEN o_orderstatus = 'P' THEN 'Q' ELSE o_orderstatus END AS k0, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'",
)

# --- variant documents ------------------------------------------------------------------------


def _variant(name: str, query: dict, where: str) -> None:
    add(
        f"variant_{name}", lambda s, d: find(C.variant_events(s, d), query, {"event_id": 1, "_id": 0}, variant="doc"),
        f"WITH {C.D4} SELECT event_id FROM ev WHERE {where}",
    )


_variant("eq", {"event_type": "purchase", "props.k": {"$gte": 50}}, "event_type = 'purchase' AND props >= 50")
_variant("array", {"ids": {"$gt": 9000}}, "event_id % 3 = 0 AND (user_id > 9000 OR event_id > 9000)")
_variant("array_null", {"ids": None}, "event_id % 3 <> 0")
_variant("index", {"ids.1": {"$lt": 100}}, "event_id % 3 = 0 AND event_id < 100")
_variant("size", {"ids": {"$size": 2}}, "event_id % 3 = 0")
_variant("type", {"ids": {"$type": 4}}, "event_id % 3 = 0")
_variant("ne", {"props": {"$ne": {"k": 1}}}, "props IS DISTINCT FROM 1")
_variant("not_exists", {"ids": {"$exists": False}, "event_type": {"$regex": "^c", "$options": "i"}}, "event_id % 3 <> 0 AND event_type LIKE 'c%'")
add(
    "variant_sort", lambda s, d: find(C.variant_events(s, d), {}, {"event_id": 1, "_id": 0}, sort={"props.k": -1, "n": 1}, limit=25, variant="doc"),
    f"WITH {C.D4} SELECT event_id FROM ev ORDER BY props DESC NULLS LAST, event_id LIMIT 25",
)



def _variant_value(name: str, query: dict, where: str) -> None:
    """Values that JSON has no literals for, or that doubles do not tell apart."""

    def run(s: SparkSession, d: str) -> DataFrame:
        big = (F.lit(2**53).cast("long") + F.col("event_id") % 3).alias("big")
        e = C.load(s, d, "events").select("event_id", F.to_variant_object(F.struct(F.col("ts").alias("at"), big, F.col("event_type").cast("binary").alias("raw"))).alias("doc"))
        return find(e, query, {"event_id": 1, "_id": 0}, variant="doc")

    add(f"variant_{name}", run, f"SELECT event_id FROM events WHERE {where}")


_BIG = "9007199254740992 + event_id % 3"
_variant_value("date", {"at": {"$lt": datetime.datetime(2024, 1, 10)}}, "ts < TIMESTAMP '2024-01-10'")
_variant_value("bytes", {"raw": b"click"}, "event_type = 'click'")
_variant_value("big_gt", {"big": {"$gt": 2**53}}, f"{_BIG} > 9007199254740992")
_variant_value("big_eq", {"big": 2**53 + 1}, f"{_BIG} = 9007199254740993")
_variant("type_int", {"n": {"$type": 16}}, "true")
_variant("type_long", {"n": {"$type": 18}}, "false")
add(
    "sort_objects",
    lambda s, d: find(
        C.events(s, d).withColumn("all", F.array("props")), {}, {"event_id": 1, "_id": 0}, sort={"all": -1, "props": 1, "event_id": 1}, limit=30
    ),
    f"WITH {C.D4} SELECT event_id FROM ev ORDER BY props DESC NULLS LAST, event_id LIMIT 30",
)

# --- flagship ---------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two segments with a large finished order, projected and sorted."""
    return find(
        C.customers(spark, sf_dir),
        {"c_mktsegment": {"$in": ["BUILDING", "HOUSEHOLD"]}, "orders": {"$elemMatch": {"o_orderstatus": "F", "o_totalprice": {"$gt": 100000}}}},
        {"c_name": 1, "c_mktsegment": 1, "c_acctbal": 1}, sort={"c_acctbal": -1, "c_custkey": 1}, id_field="c_custkey",
    )


add(
    "flagship", flagship,
    f"WITH {C.D3_ALL} SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM cust WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')"
    " AND coalesce(len(list_filter(orders, lambda x: x.o_orderstatus = 'F' AND x.o_totalprice > 100000)) > 0, false)",
)


def _shown(docs: DataFrame) -> DataFrame:
    """What is in the documents: their fields by name, and the values of some."""
    v = F.col("doc")
    get = lambda place, kind: F.try_variant_get(v, place, kind)
    return docs.select(
        "event_id", F.array_join(F.array_sort(F.map_keys(variants.fields(v))), ",").alias("fields"), get("$.props.k", "bigint").alias("k"),
        get("$.n", "bigint").alias("n"), F.to_json(get("$.ids", "variant")).alias("ids"), get("$.extra.flag", "boolean").alias("flag"),
    )


def _variant_shown(name: str, make, fields: str, k: str, n: str, ids: str, flag: str) -> None:
    add(
        f"variant_{name}", lambda s, d: _shown(make(C.variant_events(s, d))),
        f"WITH {C.D4} SELECT event_id, {fields} AS fields, CAST({k} AS BIGINT) AS k, CAST({n} AS BIGINT) AS n, {ids} AS ids, CAST({flag} AS BOOLEAN) AS flag FROM ev",
    )


_IDS = "CASE WHEN event_id % 3 = 0 THEN '[' || user_id || ',' || event_id || ']' END"
_HAS = "CASE WHEN event_id % 3 = 0 THEN 'ids,' ELSE '' END"
_variant_shown(
    "proj_in", lambda e: find(e, {}, {"event_id": 1, "props.k": 1, "ids": 1, "_id": 0}, variant="doc"),
    f"{_HAS} || 'props'", "props", "NULL", _IDS, "NULL",
)
_variant_shown(
    "proj_ex", lambda e: find(e, {}, {"ids": 0, "user_id": 0, "props.k": 0}, variant="doc"),
    "'event_type,n,props'", "NULL", "event_id", "NULL::VARCHAR", "NULL",
)
_BOUGHT = "event_type = 'purchase'"


def _bought(update: dict):
    return lambda e: apply_variant_update(e, F.coalesce(matching(e, {"event_type": "purchase"}, "doc").pos, F.lit(False)), update, "doc")


_variant_shown(
    "update_set", _bought({"$set": {"props.k": 7, "extra.flag": True}, "$unset": {"ids": ""}, "$inc": {"n": 5}}),
    f"CASE WHEN {_BOUGHT} THEN 'event_type,extra,n,props,user_id' ELSE 'event_type,' || {_HAS} || 'n,props,user_id' END",
    f"CASE WHEN {_BOUGHT} THEN 7 ELSE props END", f"CASE WHEN {_BOUGHT} THEN event_id + 5 ELSE event_id END",
    f"CASE WHEN {_BOUGHT} THEN NULL ELSE {_IDS} END", f"CASE WHEN {_BOUGHT} THEN true END",
)
_variant_shown(
    "update_rename", _bought({"$rename": {"user_id": "props.k"}, "$set": {"n": "text now"}}),
    f"'event_type,' || {_HAS} || CASE WHEN {_BOUGHT} THEN 'n,props' ELSE 'n,props,user_id' END",
    f"CASE WHEN {_BOUGHT} THEN user_id ELSE props END", f"CASE WHEN {_BOUGHT} THEN NULL ELSE event_id END", _IDS, "NULL",
)
_variant_shown(
    "replace", _bought({"n": 1, "props": {"k": [2]}}),
    f"CASE WHEN {_BOUGHT} THEN 'n,props' ELSE 'event_type,' || {_HAS} || 'n,props,user_id' END",
    f"CASE WHEN {_BOUGHT} THEN NULL ELSE props END", f"CASE WHEN {_BOUGHT} THEN 1 ELSE event_id END",
    f"CASE WHEN {_BOUGHT} THEN NULL ELSE {_IDS} END", "NULL",
)
_variant_shown(
    "update_numbers", _bought({"$mul": {"props.k": 3}, "$max": {"n": 500}, "$bit": {"user_id": {"and": 0}}}),
    f"'event_type,' || {_HAS} || 'n,props,user_id'", f"CASE WHEN {_BOUGHT} THEN coalesce(props, 0) * 3 ELSE props END",
    f"CASE WHEN {_BOUGHT} THEN greatest(event_id, 500) ELSE event_id END", _IDS, "NULL",
)
_variant_shown(
    "update_push", _bought({"$push": {"ids": {"$each": ["x", 7], "$slice": -3}}}),
    f"'event_type,' || CASE WHEN {_BOUGHT} THEN 'ids,' ELSE {_HAS} END || 'n,props,user_id'", "props", "event_id",
    f"""CASE WHEN NOT {_BOUGHT} THEN {_IDS} WHEN event_id % 3 = 0 THEN '[' || event_id || ',"x",7]' ELSE '["x",7]' END""", "NULL",
)
_variant_shown(
    "update_pop", _bought({"$pop": {"ids": -1}, "$setOnInsert": {"never": 1}}), f"'event_type,' || {_HAS} || 'n,props,user_id'", "props", "event_id",
    f"CASE WHEN {_BOUGHT} AND event_id % 3 = 0 THEN '[' || event_id || ']' ELSE {_IDS} END", "NULL",
)
add(
    "variant_distinct", lambda s, d: distinct(C.variant_events(s, d), "ids", variant="doc").select(F.try_variant_get("value", "$", "bigint").alias("value")),
    "SELECT DISTINCT unnest([user_id, event_id]) AS value FROM events WHERE event_id % 3 = 0",
)

# --- collections of documents of any shape ----------------------------------------------------


def _mixed(name: str, statement: Callable[[MixedCollection], DataFrame | None], sql: str) -> None:
    """Nations whose ``v`` is a number in regions of even keys and a text in the others, after a statement, or what it finds."""

    def run(s: SparkSession, d: str) -> DataFrame:
        db = scratch(s)
        held = MixedCollection(s, db.root, db.name, "nation")
        v = F.when(F.col("n_regionkey") % 2 == 0, F.col("n_regionkey").cast("variant")).otherwise(F.col("n_name").cast("variant"))
        held.insert(C.load(s, d, "nation").select(F.to_variant_object(F.struct(F.col("n_nationkey").alias("_id"), v.alias("v"))).alias("doc")))
        found = statement(held)
        found = found if isinstance(found, DataFrame) else held.find()
        get = lambda place, kind: F.try_variant_get("doc", place, kind)
        return found.select(get("$._id", "int").alias("n_nationkey"), F.to_json(get("$.v", "variant")).alias("v"), F.to_json(get("$.t", "variant")).alias("t"))

    whole = "nat AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) ELSE '\"' || n_name || '\"' END AS v FROM nation)"
    add(f"mixed_{name}", run, f"WITH {whole} {sql}")


_mixed("find", lambda c: c.find({"v": {"$gte": 2}}), "SELECT n_nationkey, v, NULL::VARCHAR AS t FROM nat WHERE n_regionkey IN (2, 4)")
_mixed("lookup", lambda c: c.find({"_id": 7.0}), "SELECT n_nationkey, v, NULL::VARCHAR AS t FROM nat WHERE n_nationkey = 7")
_mixed(
    "update", lambda c: c.update({"v": {"$type": 2}}, {"$set": {"v": {"k": [1]}}, "$push": {"t": "was text"}}, multi=True),
    """SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN v ELSE '{"k":[1]}' END AS v, CASE WHEN n_regionkey % 2 <> 0 THEN '["was text"]' END AS t FROM nat""",
)
_mixed(
    "delete_one", lambda c: c.delete({"v": {"$type": 2}}, 1),
    "SELECT n_nationkey, v, NULL::VARCHAR AS t FROM nat WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nat WHERE n_regionkey % 2 <> 0)",
)
_mixed(
    "upsert", lambda c: c.update({"_id": 500, "v": None}, {"$setOnInsert": {"t": [1, "x"]}}, upsert=True),
    """SELECT n_nationkey, v, NULL::VARCHAR AS t FROM nat UNION ALL SELECT 500, 'null', '[1,"x"]'""",
)
_mixed(
    "find_and_modify", lambda c: c.find_and_modify({"v": 2}, {"$max": {"v": "text is larger"}}) and None,
    """SELECT n_nationkey, CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nat WHERE n_regionkey = 2) THEN '"text is larger"' ELSE v END AS v, NULL::VARCHAR AS t FROM nat""",
)
