"""Moments and co-moments kept for each arrival and merged, so that a new fit reads new data only.

An arrival's state is a row for each key and pair of columns (a column with itself included): how many rows have both
values, both means, both sums of squares about the mean, the sum of products about the means, and the least and
largest value of the first column. States merge by adding counts, weighing means, and shifting squares and products to the common means, so
means, deviations, extremes and correlations over all arrivals come from a few rows each. NULL and NaN are missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

STATE = ["n", "mean_x", "mean_y", "square_x", "square_y", "product", "low", "high"]


def state(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, x, y, STATE): one pass over ``df``."""
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    pairs = []
    for a, b in combinations_with_replacement(columns, 2):
        x = F.when(clean[b].isNotNull(), clean[a])
        y = F.when(clean[a].isNotNull(), clean[b])
        n = F.count(x)
        pairs.append(
            F.struct(
                F.lit(a).alias("x"), F.lit(b).alias("y"), n.alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), (F.var_pop(x) * n).alias("square_x"),
                (F.var_pop(y) * n).alias("square_y"), (F.covar_pop(x, y) * n).alias("product"), F.min(x).alias("low"), F.max(x).alias("high"),
            )
        )
    return df.groupBy(*keys).agg(F.array(*pairs).alias("_s")).select(*keys, F.inline("_s")).where("n > 0")


def merge(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """States of one key and pair put together; in any order and any number of steps."""
    total = states.groupBy(*keys, "x", "y")
    n, w = F.sum("n"), lambda c: F.sum(F.col("n") * F.col(c))
    means = total.agg(n.alias("_n"), (w("mean_x") / n).alias("_x"), (w("mean_y") / n).alias("_y")).withColumnsRenamed({k: f"_k_{k}" for k in (*keys, "x", "y")})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "x", "y")]
    dx, dy = F.col("mean_x") - F.col("_x"), F.col("mean_y") - F.col("_y")
    shifted = states.join(means, on)
    return shifted.groupBy(*keys, "x", "y").agg(
        F.sum("n").alias("n"), F.first("_x").alias("mean_x"), F.first("_y").alias("mean_y"), F.sum(F.col("square_x") + F.col("n") * dx * dx).alias("square_x"),
        F.sum(F.col("square_y") + F.col("n") * dy * dy).alias("square_y"), F.sum(F.col("product") + F.col("n") * dx * dy).alias("product"), F.min("low").alias("low"), F.max("high").alias("high"),
    )


def fitted(merged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, mean, std, min, max) as ``sequences.fit_normalizer`` gives them over all rows."""
    own = merged.where(F.col("x") == F.col("y"))
    return own.select(*keys, F.col("x").alias("feature"), F.col("mean_x").alias("mean"), F.sqrt(F.col("square_x") / F.col("n")).alias("std"), F.col("low").alias("min"), F.col("high").alias("max"))


def correlations(merged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, x, y, n, correlation) of every pair of different columns; NULL where one is constant."""
    pairs = merged.where(F.col("x") != F.col("y"))
    return pairs.select(*keys, "x", "y", "n", S.ratio("product", F.sqrt(F.col("square_x") * F.col("square_y"))).alias("correlation"))


class MomentStore:
    """States of arrivals below one folder; an arrival that is fitted again replaces its own state."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], keys: Sequence[str] = ()):
        self.spark, self.path, self.columns, self.keys = spark, path.rstrip("/"), list(columns), list(keys)

    def add(self, df: DataFrame, arrival: str) -> None:
        """Fit one arrival; only ``df`` is read."""
        if not arrival or not arrival.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a name of an arrival: {arrival!r}")
        state(df, self.columns, self.keys).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/arrival={arrival}")

    def states(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path).drop("arrival")

    def merged(self) -> DataFrame:
        return merge(self.states(), self.keys)
