"""Profiles, thresholds, coverage and scores, from partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import windows as W


#: Error of the sketch that brackets a median: so small a share of the values lies between its bounds.
BRACKET = 100_000


def medians(counts: DataFrame, values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median): exact, without gathering a group's values in one buffer.

    ``counts`` holds (keys, value, n), ``values`` the rows behind it. A sketch of ``values`` brackets the
    middle; only the few distinct values between its bounds are ordered, with how many lie below them.
    """
    share = 2.0 / BRACKET
    ends = values.groupBy(*keys).agg(F.percentile_approx(value, [max(0.0, 0.5 - share), min(1.0, 0.5 + share)], BRACKET).alias("_ends"))
    near = W.join_small(counts, ends, keys).where(F.col(value).isNotNull())
    low, high, v = F.col("_ends")[0], F.col("_ends")[1], F.col(value)
    below = F.coalesce(F.sum(F.when(v < low, F.col("n"))), F.lit(0))
    sizes = near.groupBy(*keys).agg(F.sum("n").alias("_all"), below.alias("_below"))
    middle = W.join_small(near.where((v >= low) & (v <= high)), sizes, keys)
    upto = F.col("_below") + F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    one, two = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    ranked = middle.withColumn("_upto", upto)
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col(value)))
    return ranked.groupBy(*keys).agg(((at(one) + at(two)) / 2).alias("median"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, min, max, mean, median, distinct), exact: values are counted before they are shuffled."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(F.inline(pairs))
    counts = rows.groupBy("column", "value").agg(F.count("*").alias("n"))
    v, n = F.col("value"), F.when(F.col("value").isNotNull(), F.col("n"))
    out = counts.groupBy("column").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), S.ratio(F.sum(v * n), F.sum(n)).alias("mean"), F.count(v).alias("distinct")
    )
    out = W.join_small(out, medians(counts, rows, ["column"], "value"), ["column"])
    return out.select("column", "count", "min", "max", "mean", "median", "distinct")


def latency(df: DataFrame, keys: Sequence[str], value: str, ts: str, ok: Column) -> DataFrame:
    """(keys, operations, average_latency, median_latency, success_rate, per_second) of timed operations."""
    span = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("operations"), F.avg(value).alias("average_latency"), (F.count_if(ok) * F.lit(100.0) / F.count("*")).alias("success_rate"),
        S.ratio(F.count("*"), span / 1e6).alias("per_second"),
    )
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    found = medians(counts, df.select(*keys, value), keys, value).withColumnRenamed("median", "median_latency")
    return W.join_small(out, found, keys).select(*keys, "operations", "average_latency", "median_latency", "success_rate", "per_second")


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    """The combinations of values that occur."""
    return df.select(*columns).distinct()


def buckets(df: DataFrame, keys: Sequence[str], value: str, edges: dict[str, float], rest: str, **aggregates: Column) -> DataFrame:
    """Aggregates by key and size: ``edges`` names each bucket with the bound its values stay below."""
    name = F.lit(rest)
    for label, bound in sorted(edges.items(), key=lambda e: -e[1]):
        name = F.when(F.col(value) < bound, label).otherwise(name)
    return df.groupBy(*keys, name.alias("bucket")).agg(*[v.alias(k) for k, v in aggregates.items()])


def relation(df: DataFrame, a: str, b: str, region: str = "region", ts: str = "timestamp", **blocks) -> DataFrame:
    """(region, mean_abs_diff, correlation): how much ``a`` changes from row to row, and how it goes with ``b``."""
    d = W.over_rows(df.select(region, ts, a, b), lambda w: {"_w_diff": F.abs(W.ramp(a, w))}, 1, region=region, ts=ts, **blocks)
    return d.groupBy(region).agg(F.avg("_w_diff").alias("mean_abs_diff"), F.corr(a, b).alias("correlation"))


def series_info(df: DataFrame, observed: DataFrame, region: str, ts: str, value: str) -> DataFrame:
    """(region, n_hours, n_values, low, high, n_gaps) of a series on its spine and of what was observed."""
    rows = df.groupBy(region).agg(F.count("*").alias("n_hours"), F.count(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high"))
    return W.join_small(rows, W.gap_report(observed, region, ts).select(region, "n_gaps"), [region])


def missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, pct_null) for every column."""
    columns = list(columns or df.columns)
    rows = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), F.coalesce(S.ratio(F.count_if(F.col(c).isNull()) * 100.0, F.count("*")), F.lit(0.0)).alias("pct_null")) for c in columns]
    return df.agg(F.array(*rows).alias("s")).select(F.inline("s"))


def thresholds(df: DataFrame, max_missing_pct: float = 5.0, low: float = 0, high: float = 100_000, word: str = "demand", columns: Sequence[str] | None = None) -> DataFrame:
    """(issue, detail): columns with too many NULLs, and values out of range in columns named after ``word``."""
    columns = list(columns or df.columns)
    found = []
    for c in columns:
        pct = F.count_if(F.col(c).isNull()) * 100.0 / F.greatest(F.count("*"), F.lit(1))
        found.append(F.when(pct > max_missing_pct, F.struct(F.lit(f"missing_{c}").alias("issue"), F.concat(F.format_number(pct, 1), F.lit("%")).alias("detail"))))
        if word in c.lower():
            out = F.count_if((F.col(c) < low) | (F.col(c) > high))
            found.append(F.when(out > 0, F.struct(F.lit(f"range_{c}").alias("issue"), F.concat(out.cast("string"), F.lit(" values out of range")).alias("detail"))))
    return df.agg(F.array_compact(F.array(*found)).alias("s")).select(F.inline("s"))


def duplicate_times(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Keys and times that occur more than once, with how often."""
    return df.groupBy(*keys, ts).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """``df`` if every time is unique, else the job fails: a batch is taken whole or not at all."""
    if duplicate_times(df, keys, ts).limit(1).count():
        raise ValueError(f"duplicate {ts} within {list(keys)}")
    return df


def reject_batch(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """The rows of ``df``; the job fails on the first bad one."""
    return df.where(F.assert_true(~F.coalesce(bad, F.lit(False)), F.lit(message)).isNull())


def availability(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """(non-NULL share + in-range share) / 2, three places."""
    share = F.avg(F.col(value).isNotNull().cast("int"))
    inside = F.avg(F.coalesce(F.col(value).between(low, high), F.lit(False)).cast("int"))
    return df.groupBy(*keys).agg(F.round((share + inside) / 2, 3).alias("availability"))


def coverage(df: DataFrame, region: str, ts: str, expected_years: Sequence[int]) -> DataFrame:
    """Per region: years with rows, the earliest, the share of the expected years, rows per covered day."""
    years = df.groupBy(region, F.year(ts).alias("_y")).agg(F.count("*").alias("_n"), F.countDistinct(F.to_date(ts)).alias("_days"))
    wanted = years.where(F.col("_y").isin(*expected_years))
    return wanted.groupBy(region).agg(
        F.count("*").alias("years"), F.min("_y").cast("long").alias("earliest_year"),
        (F.count("*") * 100.0 / len(expected_years)).alias("coverage_pct"), S.ratio(F.sum("_n"), F.sum("_days")).alias("rows_per_day"),
    )


def counts_by(df: DataFrame, sets: Sequence[str], **aggregates: Column) -> DataFrame:
    """Grouping sets of single keys and the total, in one pass."""
    keys = [F.col(c) for c in sets]
    out = df.groupingSets([[k] for k in keys] + [[]], *keys)
    return out.agg(F.grouping_id().alias("grouping_id"), *[v.alias(k) for k, v in aggregates.items()])
