"""Pivots, buckets, spines and joins between series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .windows import numbered


def pivot(
    df: DataFrame, keys: Sequence[str], names: str, value: str, values: Sequence[str], how: str = "sum", suffix: str = "", fill: float | None = 0.0, order: str | None = None
) -> DataFrame:
    """Long to wide with given column values, so that no extra job looks them up.

    ``how="first"`` takes the value of the first row by the column ``order``; NULL values count as rows.
    """
    if how == "first" and order is None:
        raise ValueError("first needs an order column")
    agg = {"sum": F.sum, "mean": F.avg, "first": None}[how]
    cells = []
    for v in values:
        mine = F.col(names) == v
        cell = agg(F.when(mine, F.col(value))) if agg else F.min(F.when(mine, F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))["v"]
        cells.append(cell.alias(f"{v}{suffix}"))
    out = df.groupBy(*keys).agg(*cells)
    return out if fill is None else out.fillna(fill, subset=[f"{v}{suffix}" for v in values])


def places(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds ``place``, from 0, within the rows of each key; only chunks of ``order`` are sorted in one task."""
    return numbered(df, keys, order, chunk_hours=10_000).withColumnRenamed("_w_row", "place").drop("_w_rows")


def resample(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], unit: str = "hour") -> DataFrame:
    """Mean per bucket; empty buckets are added by ``on_spine``."""
    return df.groupBy(*keys, F.date_trunc(unit, ts).cast("timestamp_ntz").alias(ts)).agg(*[F.avg(v).alias(v) for v in values])


def spine(df: DataFrame, keys: Sequence[str], ts: str, unit: str = "HOUR") -> DataFrame:
    """Every bucket between each key's first and last."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    return ends.select(*keys, F.explode(F.expr(f"sequence(_lo, _hi, interval 1 {unit})")).alias(ts))


def on_spine(df: DataFrame, keys: Sequence[str], ts: str, unit: str = "HOUR") -> DataFrame:
    return spine(df, keys, ts, unit).join(df, [*keys, ts], "left")


def align(frames: Sequence[DataFrame], ts: str = "timestamp") -> DataFrame:
    """Hourly mean of each frame on the range they share; value columns get ``_source_i`` when there are several."""
    hourly = []
    for i, df in enumerate(frames):
        values = [c for c in df.columns if c != ts]
        h = resample(df, [], ts, values)
        hourly.append(h.withColumnsRenamed({v: f"{v}_source_{i}" for v in values}) if len(frames) > 1 else h)
    ends = reduce(lambda a, b: a.union(b), [h.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")) for h in hourly])
    hours = ends.agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")).where("lo <= hi")
    hours = hours.select(F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias(ts))
    return reduce(lambda a, b: a.join(b, ts, "left"), hourly, hours)


def prefixed(df: DataFrame, prefix: str, on: Sequence[str], keep: bool = False) -> DataFrame:
    """``{prefix}_{column}`` for every column beside ``on``; with ``keep`` in addition to the originals."""
    rest = [c for c in df.columns if c not in on]
    return df.select(*on, *(rest if keep else []), *[F.col(c).alias(f"{prefix}_{c}") for c in rest])


def join_demand_generation(demand: DataFrame, generation: DataFrame, on: Sequence[str] = ("region", "datetime"), keep: bool = False) -> DataFrame:
    """Full outer join on region and time; the other columns get the prefix of their side.

    ``keep`` leaves the originals beside them (their names must then differ between the sides).
    """
    return prefixed(demand, "demand", on, keep).join(prefixed(generation, "generation", on, keep), list(on), "full")


def to_map(df: DataFrame, keys: Sequence[str], name: str, value: str, last_by: str | None = None) -> DataFrame:
    """One map per key, summing values of equal names first, or taking the last by the column ``last_by``."""
    one = F.sum(value) if last_by is None else F.max(F.struct(F.col(last_by).alias("o"), F.col(value).alias("v")))["v"]
    single = df.groupBy(*keys, name).agg(one.alias("_v"))
    return single.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "_v")))).alias("by_name"))


def join_maps(demand: DataFrame, generation: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, demand, generation): the maps of keys that both sides hold."""
    return demand.withColumnRenamed("by_name", "demand").join(generation.withColumnRenamed("by_name", "generation"), list(keys))


def bucket_metrics(demand: DataFrame, generation: DataFrame, key: str, value: str, fuel: str, good: Sequence[str], last_by: str | None = None) -> DataFrame:
    """Per bucket with both sides: mean and peak demand, generation, its renewable part, and with ``last_by`` the last value per fuel."""
    load = demand.groupBy(key).agg(F.avg(value).alias("avg_demand"), F.max(value).alias("peak_demand"))
    green = F.sum(F.when(F.col(fuel).isin(*good), F.col(value)))
    supply = generation.groupBy(key).agg(F.sum(value).alias("generation"), F.coalesce(green, F.lit(0.0)).alias("renewable"))
    out = load.join(supply, key)
    return out if last_by is None else out.join(to_map(generation, [key], fuel, value, last_by).withColumnRenamed("by_name", "last_by_fuel"), key)


def grid_metrics(buckets: DataFrame) -> DataFrame:
    """Adds load factor, renewable share, stress and activity to the rows of ``bucket_metrics``."""
    return buckets.withColumns(
        {
            "load_factor": S.load_factor("avg_demand", "peak_demand"), "renewable_pct": F.coalesce(S.ratio("renewable", "generation") * 100, F.lit(0.0)),
            "stress": S.stress("avg_demand", "peak_demand"), "activity": F.col("avg_demand") / 1000,
        }
    )


def renewable_shares(wide: DataFrame, good: Sequence[str], all_: Sequence[str], places: int = 2) -> DataFrame:
    """Adds ``total_renewable_mwh`` and ``renewable_percentage``, both rounded."""
    return wide.withColumns({"total_renewable_mwh": F.round(S.row_sum(*good), places), "renewable_percentage": S.percent(S.row_sum(*good), S.row_sum(*all_), places)})


def without(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """The rows whose ``left`` is not among ``right``; NULL is never among them."""
    return df.join(other.select(F.col(right).alias("_right")).distinct(), F.col(left) == F.col("_right"), "left_anti")


def harmonize(df: DataFrame, source: str, data_type: str, time: str, value: str, unit: str, region: str | None = None) -> DataFrame:
    """The six harmonized columns of one source; region and unit are carried, not invented."""
    place = F.col("region") if region is None else F.lit(region)
    return df.select(
        S.col(time).cast("timestamp_ntz").alias("timestamp"),
        place.cast("string").alias("region"),
        F.lit(source).alias("data_source"),
        F.col(value).cast("double").alias("value"),
        (F.col(unit) if unit in df.columns else F.lit(unit)).cast("string").alias("unit"),
        F.lit(data_type).alias("data_type"),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def daily_features(df: DataFrame, region: str = "region", ts: str = "timestamp", value: str = "value") -> DataFrame:
    return df.groupBy(region, S.day_bucket(ts).alias(ts)).agg(
        F.avg(value).alias("daily_avg"), F.max(value).alias("daily_max"), F.min(value).alias("daily_min"), F.stddev_samp(value).alias("daily_std")
    )


def cross_region(daily: DataFrame) -> DataFrame:
    """Every ordered pair of regions on the same day, in one equi-join on time."""
    a = daily.select("timestamp", F.col("region").alias("from_region"), F.col("daily_avg").alias("a_avg"), F.col("daily_max").alias("a_max"))
    b = daily.select(F.col("timestamp").alias("_t"), F.col("region").alias("to_region"), F.col("daily_avg").alias("b_avg"), F.col("daily_max").alias("b_max"))
    pairs = a.join(b, (F.col("timestamp") == F.col("_t")) & (F.col("from_region") != F.col("to_region")))
    return pairs.select(
        "timestamp", "from_region", "to_region",
        (F.col("b_avg") - F.col("a_avg")).alias("avg_differential"),
        (F.col("b_max") - F.col("a_max")).alias("max_differential"),
        S.ratio("b_avg", "a_avg").alias("avg_ratio"),
    )


def migration_features(store, df: DataFrame, name: str, overwrite: bool = False) -> DataFrame:
    """The chain of regional daily features, their differences between regions and the save, read back from the store."""
    store.save(cross_region(daily_features(df)), "features", name, overwrite=overwrite, ts="timestamp")
    return store.load("features", name)


def collect_sources(builders: dict, wanted: Sequence[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(frames, errors) of the named builders: a source that cannot be planned is left out and named."""
    frames, errors = {}, {}
    for name in wanted or builders:
        try:
            frames[name] = builders[name]()
        except Exception as e:  # noqa: BLE001  any source may be missing
            errors[name] = f"{type(e).__name__}: {e}"
    return frames, errors
