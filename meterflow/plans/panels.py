"""Stand-in panels over the star-schema tables, as plans and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

TYPES = ("view", "signup", "click", "error", "purchase")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, ts, v, total, n): events by type and hour."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("region"), S.hour_bucket("ts").alias("ts")).agg(
        F.avg("value").alias("v"), F.sum("value").alias("total"), F.count("*").alias("n")
    )


HOURLY = "hourly AS (SELECT event_type AS region, date_trunc('hour', ts) AS ts, avg(value) AS v, sum(value) AS total, count(*) AS n FROM events GROUP BY 1, 2)"


def regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, timestamp, value): orders with the region of their customer, by day of order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nations.join(regions, nations.n_regionkey == regions.r_regionkey).select("n_nationkey", "r_name")
    at = orders.join(customers, orders.o_custkey == customers.c_custkey).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return at.select(F.col("r_name").alias("region"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("value"))


REGIONAL = (
    "regional AS (SELECT r_name AS region, o_orderdate AS timestamp, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)
DAILY = (
    REGIONAL + ", daily AS (SELECT region, date_trunc('day', timestamp) AS timestamp, avg(value) AS daily_avg, max(value) AS daily_max, "
    "min(value) AS daily_min, stddev_samp(value) AS daily_std FROM regional GROUP BY 1, 2)"
)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, datetime, demand_mwh, solar_mwh, wind_mwh, hydro_mwh, natural_gas_mwh): hours of events.

    Regions are ``even`` and ``odd`` users; fuels stand for event types.
    """
    part = lambda t: F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("value"))), F.lit(0.0))
    side = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    return table(spark, sf_dir, "events").groupBy(side.alias("region"), S.hour_bucket("ts").alias("datetime")).agg(
        F.sum("value").alias("demand_mwh"), part("view").alias("solar_mwh"), part("signup").alias("wind_mwh"), part("click").alias("hydro_mwh"), part("error").alias("natural_gas_mwh")
    )


WIDE = (
    "wide AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS region, date_trunc('hour', ts) AS datetime, sum(value) AS demand_mwh, "
    + ", ".join(f"coalesce(sum(CASE WHEN event_type = '{t}' THEN value END), 0) AS {f}_mwh" for t, f in (("view", "solar"), ("signup", "wind"), ("click", "hydro"), ("error", "natural_gas")))
    + " FROM events GROUP BY 1, 2)"
)
