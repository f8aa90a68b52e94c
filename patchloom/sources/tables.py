"""Scans of the star-schema tables and the survey-like view built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with customer, region and line totals: predictors, targets of every type, a weight and the id `rid`."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"),
        F.sum("l_quantity").alias("qty"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0)).alias("returned_value"),
        (F.sum(F.expr("l_extendedprice * l_discount")) / F.sum("l_extendedprice")).alias("disc_share"),
        (F.sum(F.expr("l_extendedprice * l_tax")) / F.sum("l_extendedprice")).alias("tax_share"),
    )
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    joined = joined.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(
        F.col("o_orderkey").alias("rid"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("acctbal"), "n_lines", F.month("o_orderdate").alias("mon"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("totalprice"), "qty", "returned_value", (F.col("o_totalprice") > 250000).alias("is_large"), "disc_share", "tax_share", (1 + F.col("o_custkey") % 7).alias("weight"),
    )
