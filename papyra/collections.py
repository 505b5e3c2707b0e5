"""Document collections derived from the flat tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; most have none, so ``quality`` and ``toxic`` are often missing."""
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a conversation: ``conv_id, turns: [{turn, role, text}]`` in order of the turns."""
    turns = load(spark, sf_dir, "conversations")
    grouped = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    return grouped.withColumn("turns", F.array_sort("turns"))


def customers(spark: SparkSession, sf_dir: str, urgent: bool = False) -> DataFrame:
    """One document a customer with its orders in order of their keys; without any, ``orders`` is missing.

    ``urgent``: only orders of the highest priority, for queries on missing arrays: of all orders hardly a customer has none.
    """
    orders = load(spark, sf_dir, "orders")
    if urgent:
        orders = orders.filter(F.col("o_orderpriority").startswith("1-"))
    order = F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    grouped = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(order)).alias("orders"))
    customer = load(spark, sf_dir, "customer")
    return customer.join(grouped, customer["c_custkey"] == grouped["o_custkey"], "left").drop("o_custkey")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``props`` as an object."""
    return load(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k bigint"))


def variant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id`` and the whole event as one VARIANT document with a nested list."""
    e = load(spark, sf_dir, "events")
    nested = F.struct(
        "event_type", "user_id", F.col("event_id").alias("n"),
        F.when(F.col("event_id") % 3 == 0, F.array(F.col("user_id"), F.col("event_id"))).alias("ids"),
        F.from_json("props", "k bigint").alias("props"),
    )
    return e.select("event_id", F.parse_json(F.to_json(nested)).alias("doc"))


D1 = "docs AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"
D2 = (
    "conv AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS turns"
    " FROM conversations GROUP BY conv_id)"
)
D3 = (
    "cust AS (SELECT c.*, o.orders FROM customer c LEFT JOIN (SELECT o_custkey, list({'o_orderkey': o_orderkey,"
    " 'o_orderstatus': o_orderstatus, 'o_totalprice': o_totalprice, 'o_orderpriority': o_orderpriority}"
    " ORDER BY o_orderkey) AS orders FROM orders %s GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey)"
)
D3_URGENT, D3_ALL = D3 % "WHERE o_orderpriority LIKE '1-%'", D3 % ""
D4 = "ev AS (SELECT * REPLACE (CAST(json_extract(props, '$.k') AS BIGINT) AS props) FROM events)"
