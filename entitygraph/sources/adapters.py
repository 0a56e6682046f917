"""The star schema and other tables as points: (id, cell, feature, x, y, z, nuclear, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entitygraph.functions.storage import read_table

#: Ids number the lines of an order, at most so many.
LINES_PER_ORDER = 1000


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points: the customer is the prior cell and the brand the feature.

    The id is the order and the line's rank within it; lines that tie in every column
    are alike, so ids do not depend on the order of rows.  The rank needs one shuffle by
    order, no global sort.
    """
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus", "l_returnflag")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus", "l_returnflag"))
    return (
        lines.withColumn("rank", rank)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            (F.col("l_orderkey") * LINES_PER_ORDER + F.col("rank")).alias("id"),
            F.col("o_custkey").cast("string").alias("cell"),
            F.col("p_brand").alias("feature"),
            F.col("l_quantity").alias("x"),
            (F.col("l_extendedprice") / 2000).alias("y"),
            (F.col("l_discount") * 100 + 0.0).alias("z"),
            (F.col("l_linestatus") == "F").alias("nuclear"),
            F.when(F.col("l_returnflag") == "N", "-1").otherwise(F.col("o_custkey").cast("string")).alias("label"),
        )
    )


def order_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(context, feature) of the larger vocabulary: orders and part names, with both signs of association."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("cell"), F.col("p_name").alias("feature"))


def embedding_points(spark: SparkSession, sf_dir: str, scale: float = 20.0) -> DataFrame:
    """Embeddings by their first three dimensions."""
    e = read_table(spark, sf_dir, "embeddings")
    at = lambda k: F.round(F.col("embedding")[k].cast("double") * scale, 6)
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
