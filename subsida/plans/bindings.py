"""Deterministic points, epochs and series from the driver's tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsida.functions import time as tm


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def key_lat(key: Column) -> Column:
    return F.lit(53) + ((key * 37) % 1000) / F.lit(1000.0) * F.lit(0.6)


def key_lon(key: Column) -> Column:
    return F.lit(5.5) + ((key * 91) % 1000) / F.lit(1000.0) * F.lit(0.8)


def points(df: DataFrame, key: str) -> DataFrame:
    """(k, lat, lon) of every key."""
    return df.select(F.col(key).cast("long").alias("k")).select("k", key_lat(F.col("k")).alias("lat"), key_lon(F.col("k")).alias("lon"))


def suppliers(spark, d):
    return points(read(spark, d, "supplier"), "s_suppkey")


def customers(spark, d):
    return points(read(spark, d, "customer"), "c_custkey")


def sql_points(table: str, key: str) -> str:
    return f"SELECT {key}::BIGINT AS k, 53 + (({key} * 37) % 1000) / 1000.0::DOUBLE * 0.6::DOUBLE AS lat, 5.5::DOUBLE + (({key} * 91) % 1000) / 1000.0::DOUBLE * 0.8::DOUBLE AS lon FROM {table}"


SQL_SUPPLIERS = sql_points("supplier", "s_suppkey")
SQL_CUSTOMERS = sql_points("customer", "c_custkey")


def event_series(spark, d) -> DataFrame:
    """(pnt, event_id, ts, dyear, value) of the events."""
    return read(spark, d, "events").select(F.col("user_id").alias("pnt"), "event_id", "ts", tm.dyear(F.col("ts")).alias("dyear"), "value")


SQL_DYEAR = "(2000 + (epoch_us({0}) / 86400000000.0::DOUBLE + 40587 - 51544.5::DOUBLE) / 365.25::DOUBLE)"
SQL_EVENTS = f"SELECT user_id AS pnt, event_id, ts, {SQL_DYEAR.format('ts')} AS dyear, value FROM events"


def campaign(spark, d) -> DataFrame:
    """(pnt, epoch, v): supplier by ship month, logarithm of the mean price: a campaign-like matrix."""
    li = read(spark, d, "lineitem")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    return li.select(F.col("l_suppkey").alias("pnt"), month.cast("long").alias("epoch"), "l_extendedprice").groupBy("pnt", "epoch").agg(F.ln(F.avg("l_extendedprice")).alias("v"))


SQL_CAMPAIGN = "SELECT l_suppkey AS pnt, (year(l_shipdate) * 12 + month(l_shipdate) - 1)::BIGINT AS epoch, ln(avg(l_extendedprice)) AS v FROM lineitem GROUP BY 1, 2"


def regions(spark, d) -> DataFrame:
    """(pnt, epoch, v): region of the supplier by ship quarter, logarithm of the mean price: a matrix without gaps."""
    li = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    quarter = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("long")
    return li.groupBy(F.col("n_regionkey").cast("long").alias("pnt"), quarter.alias("epoch")).agg(F.ln(F.avg("l_extendedprice")).alias("v"))


SQL_REGIONS = """c AS (SELECT n_regionkey::BIGINT AS pnt, (year(l_shipdate) * 4 + quarter(l_shipdate) - 1)::BIGINT AS epoch, ln(avg(l_extendedprice)) AS v
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_long(c: Column, digits: int) -> Column:
    """A column without negative values, rounded as DuckDB does: for results of so many rows that Spark's decimals take most of the time."""
    return F.floor(c * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)
