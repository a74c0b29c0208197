"""A flight-shaped view over the driver's tables, in integer arithmetic that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
HISTORICAL_UNTIL = 2000
EVALUATION = 2001


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: a marketing row of a flight, planned and observed."""
    lines = load(spark, sf_dir, "lineitem")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # line items are dealt once: orders get their customers' nations first, and suppliers (one for hundreds of line items) are broadcast
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = lines.join(F.broadcast(suppliers), F.col("l_suppkey") == F.col("s_suppkey")).join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    number = F.lpad((F.col("l_partkey") % 4).cast("string"), 4, "0")
    day = F.to_date("l_shipdate")
    minute = (300 + 185 * (F.col("l_suppkey") % 5) + 60 * (F.col("l_partkey") % 4) + 15 * (F.col("s_nationkey") % 5)) % 1440
    elapsed = 60 + 30 * (F.col("c_nationkey") % 6) + F.when(F.col("l_quantity") == 50, 10).otherwise(0)
    return joined.select(
        F.concat_ws("-", *[F.col(c).cast("long").cast("string") for c in ORDER[:4]], F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("record_id"),
        *ORDER,
        day.alias("flight_date"), F.year(day).alias("year"), F.month(day).alias("month"),
        (10000 + F.col("s_nationkey") % 5).cast("long").alias("origin"), (10000 + F.col("c_nationkey") % 6).cast("long").alias("destination"),
        F.concat(F.lit("C"), (F.col("l_suppkey") % 5).cast("string")).alias("operating_carrier"), number.alias("operating_number"),
        F.concat(F.lit("C"), (F.col("l_linenumber") % 3).cast("string")).alias("marketing_carrier"), number.alias("marketing_number"),
        minute.cast("long").alias("departure_minute"), elapsed.cast("long").alias("elapsed"),
        F.when(F.col("l_quantity") <= 48, F.col("l_quantity").cast("long") - 15).alias("departure_delay"),
        (F.col("l_tax") >= 0.08).alias("cancelled"), (F.col("l_tax") < 0.01).alias("diverted"),
    )


#: The same view as a common table expression.
FLIGHTS_SQL = """flights AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS record_id,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        CAST(l_shipdate AS DATE) AS flight_date, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
        CAST(10000 + s_nationkey % 5 AS BIGINT) AS origin, CAST(10000 + c_nationkey % 6 AS BIGINT) AS destination,
        'C' || (l_suppkey % 5) AS operating_carrier, lpad(CAST(l_partkey % 4 AS VARCHAR), 4, '0') AS operating_number,
        'C' || (l_linenumber % 3) AS marketing_carrier, lpad(CAST(l_partkey % 4 AS VARCHAR), 4, '0') AS marketing_number,
        CAST((300 + 185 * (l_suppkey % 5) + 60 * (l_partkey % 4) + 15 * (s_nationkey % 5)) % 1440 AS BIGINT) AS departure_minute,
        CAST(60 + 30 * (c_nationkey % 6) + CASE WHEN l_quantity = 50 THEN 10 ELSE 0 END AS BIGINT) AS elapsed,
        CASE WHEN l_quantity <= 48 THEN CAST(l_quantity AS BIGINT) - 15 END AS departure_delay,
        l_tax >= 0.08 AS cancelled, l_tax < 0.01 AS diverted
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
