"""The driver's tables as sources and typed trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.documents import from_table
from .sources.shred import typed_nodes
from .staging import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".json"))
    return from_table(table(spark, sf_dir, "events"), "props", path, "json", "event_id")


def pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "pages"), "html", F.col("url"), "html", "page_id")


def documents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return from_table(table(spark, sf_dir, "documents"), "text", path, "text", "doc_id")


def customer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, name, segment, order (key, status, total, priority): orders by key."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority")))).alias("order")
    )
    c = table(spark, sf_dir, "customer")
    return c.join(orders, c["c_custkey"] == orders["o_custkey"], "left").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "order")


def order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, line (n, quantity, flag): an order's lines in order."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_returnflag").alias("flag")))).alias("line")
    )


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of order_tree, a document for each order, without a parser; written once."""
    return settle(typed_nodes(order_tree(spark, sf_dir).withColumn("doc_id", F.col("key")), "doc_id", F.lit("orders.json")), "nodes")


def conversation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn (n, role, text): turns in order."""
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("n"), "role", "text"))).alias("turn"))
