"""Synthetic hourly series from formulas; noise is seeded and can be left out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..operators.quality import medians

YEAR = 8766


def _wave(cycle: float, shift: float = 0.0, fn=F.sin) -> Column:
    return fn(F.col("t") * (2 * math.pi / cycle) + shift)


def series(spark: SparkSession, hours: int, start: str = "2024-01-01", base_mw: float = 1000.0, solar_cf: float = 0.25, wind_cf: float = 0.35, seed: int | None = 42, region: str | None = None) -> DataFrame:
    """Demand, solar, wind, temperature, price and stability per hour. ``seed=None`` leaves the noise out."""
    normal = (lambda k: F.randn(seed + k)) if seed is not None else (lambda k: F.lit(0.0))
    uniform = (lambda k: F.rand(seed + k)) if seed is not None else (lambda k: F.lit(0.5))
    t = spark.range(hours).withColumnRenamed("id", "t")
    demand = base_mw * (1 + 0.05 * normal(1)) * (1 + 0.2 * _wave(24, -math.pi / 3) + 0.1 * _wave(168) + 0.3 * _wave(YEAR, fn=F.cos))
    median = F.greatest(F.least(uniform(2), uniform(3)), F.least(F.greatest(uniform(2), uniform(3)), uniform(4)))  # of three: Beta(2, 2)
    solar = solar_cf * F.greatest(F.lit(0.0), _wave(24, -math.pi / 2)) * (0.5 + 0.5 * _wave(YEAR, -math.pi / 2)) * (0.7 + 0.3 * median) * base_mw
    wind = clip(wind_cf * (0.3 + 0.2 * _wave(168) + 0.3 * 0.5 * F.sqrt(-2 * F.log(1 - uniform(5)))), 0, 2 * wind_cf) * base_mw
    warm = 15 + 10 * _wave(YEAR, -math.pi / 2) + 5 * _wave(24, -math.pi / 2) + 2 * normal(6)
    rows = t.select("t", clip(demand, low=0.1 * base_mw).alias("demand_mw"), solar.alias("solar_generation_mw"), wind.alias("wind_generation_mw"), warm.alias("temperature_c"))
    rows = rows.withColumn("_ren", F.col("solar_generation_mw") + F.col("wind_generation_mw"))
    # four constants of the whole series, read by subqueries of the same query
    values = rows.select(F.lit(0).alias("all"), F.col("demand_mw").alias("value"))
    med = medians(values.groupBy("all", "value").agg(F.count("*").alias("n")), values, ["all"], "value").select("median").scalar()
    fit = rows.agg(F.struct(F.avg("demand_mw").alias("m"), F.stddev_pop("demand_mw").alias("s"), F.avg("_ren").alias("r")).alias("fit")).scalar()
    spread, mean_ren = F.when(fit["s"] > 0, fit["s"]).otherwise(1.0), F.when(fit["r"] > 0, fit["r"]).otherwise(1.0)
    price = 50 + 30 * (F.col("demand_mw") - fit["m"]) / spread - 20 * F.col("_ren") / mean_ren + 10 * normal(7)
    stable = 0.8 - 0.1 * F.least(F.abs(F.col("demand_mw") - med) / spread, F.lit(3.0)) / 3
    if seed is not None:
        stable = stable + 0.01 * F.log(1 - uniform(8))
    at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("t").cast("int"))
    out = rows.select(
        at.cast("timestamp_ntz").alias("datetime"), "demand_mw", "solar_generation_mw", "wind_generation_mw", "temperature_c",
        clip(price, low=5.0).alias("price_usd_per_mwh"), clip(stable, 0, 1).alias("grid_stability"),
    )
    return out if region is None else out.withColumn("region", F.lit(region))


def week(spark: SparkSession, region: str = "CAISO") -> DataFrame:
    return series(spark, 168, region=region)


def month(spark: SparkSession, region: str = "CAISO") -> DataFrame:
    return series(spark, 744, region=region)


def year(spark: SparkSession, region: str = "CAISO") -> DataFrame:
    return series(spark, 8760, region=region)
