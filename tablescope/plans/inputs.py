"""Input frames for the registered queries: the given parquet tables and frames Spark
derives from them (projections, left joins, casts), mirrored by SQL views in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_DUP_KEY = ["l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]


def docs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels: the missing-value test frame (unlabelled docs are NULL)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


DOCS_LABELS_SQL = ("(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                   "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")


def lineitem_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINEITEM_NUMERIC)


def lineitem_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem numerics with zero discounts turned into NULL (a second null pattern)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_quantity", "l_extendedprice",
                     F.expr("nullif(l_discount, 0)").alias("l_discount"), "l_tax")


LINEITEM_NULLABLE_SQL = ("(SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, l_tax "
                         "FROM lineitem)")


def orders_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with some columns rendered as text, for type-detection queries."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.col("o_orderdate").cast("string").alias("date_text"),
        "o_orderstatus",
        F.when(F.col("o_totalprice") > 200000, "Yes").otherwise("No").alias("big_order"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string"))
        .otherwise(F.col("o_orderpriority")).alias("mixed_text"),
        "o_totalprice", "o_orderdate")


ORDERS_AS_TEXT_SQL = (
    "(SELECT CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_orderdate AS VARCHAR) AS date_text, "
    "o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'Yes' ELSE 'No' END AS big_order, "
    "CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS VARCHAR) ELSE o_orderpriority END AS mixed_text, "
    "o_totalprice, o_orderdate FROM orders)")


CUSTOMER_ORDERS_SQL = (
    "(SELECT c.c_custkey, c.c_acctbal, c.c_mktsegment, c.c_nationkey, "
    "CAST(coalesce(a.n_orders, 0) AS DOUBLE) AS n_orders, a.total_spent, a.avg_order FROM customer c LEFT JOIN "
    "(SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total_spent, avg(o_totalprice) AS avg_order "
    "FROM orders GROUP BY o_custkey) a ON c.c_custkey = a.o_custkey)")
CUSTOMER_ORDERS_NUMERIC = ["c_acctbal", "n_orders", "total_spent", "avg_order"]


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer features with order aggregates (segmentation input)."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    agg = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"),
                                     F.sum("o_totalprice").alias("total_spent"),
                                     F.avg("o_totalprice").alias("avg_order"))
    return (c.join(agg, c.c_custkey == agg.o_custkey, "left")
            .select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey",
                    F.coalesce("n_orders", F.lit(0)).cast("double").alias("n_orders"),
                    "total_spent", "avg_order"))


def banded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a band of their length, its root, and their labels as text (NULL where unlabelled)."""
    n = F.col("n_chars")
    return docs_labels(spark, sf_dir).select(
        F.when(n <= 1000, "short").when(n <= 2500, "middle").otherwise("long").alias("length_band"),
        F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"),
        "n_chars", F.sqrt(n.cast("double")).alias("root_chars"))


BANDED_DOCUMENTS_SQL = (
    "(SELECT CASE WHEN n_chars <= 1000 THEN 'short' WHEN n_chars <= 2500 THEN 'middle' ELSE 'long' END AS length_band, "
    "CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, n_chars, sqrt(n_chars) AS root_chars "
    f"FROM {DOCS_LABELS_SQL} x)")
