"""Calendar, renewable, demand and balance features, and all of them together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from . import windows as W

BASE_FUELS = ("solar", "wind", "hydro", "natural_gas", "coal", "nuclear", "oil", "other")


def temporal(df: DataFrame, ts: str = "datetime", weekend: str = "sat_sun") -> DataFrame:
    """18 calendar columns. ``weekend="iso_reference"`` also counts Friday."""
    t = F.col(ts)
    weekday = S.iso_weekday(t)
    parts = {
        "year": F.year(t), "month": F.month(t).cast("tinyint"), "day": F.day(t).cast("tinyint"), "hour": F.hour(t).cast("tinyint"),
        "weekday": weekday.cast("tinyint"), "day_of_year": F.dayofyear(t).cast("smallint"),
    }
    for name, x, cycle in (("hour", F.hour(t), 24), ("weekday", weekday, 7), ("month", F.month(t), 12), ("day_of_year", F.dayofyear(t), 365)):
        parts[f"{name}_sin"], parts[f"{name}_cos"] = S.cyclic(x, cycle)
    parts |= {
        "is_weekend": weekday >= (5 if weekend == "iso_reference" else 6),
        "is_business_hour": F.hour(t).between(9, 17),
        "is_peak_hour": F.hour(t).between(6, 9) | F.hour(t).between(17, 20),
        "is_summer": F.month(t).between(6, 8),
    }
    return df.withColumns(parts)


def first_with(columns: Sequence[str], *words: str) -> str | None:
    """The first column whose name holds one of the words; column order decides."""
    return next((c for c in columns if any(w in c.lower() for w in words)), None)


def renewable(df: DataFrame, region: str = "region", ts: str = "datetime", **blocks) -> DataFrame:
    """Total, penetration, and for solar and wind the share of the region's maximum and the ramp."""
    return with_features(df, region, ts, renewable_=True, **blocks)


def demand(df: DataFrame, region: str = "region", ts: str = "datetime", **blocks) -> DataFrame:
    """Growth, z-score and peak flags of the first demand column; ``df`` as it is where there is none."""
    return with_features(df, region, ts, demand_=True, **blocks) if first_with(df.columns, "demand") else df


def with_features(
    df: DataFrame, region: str, ts: str, renewable_: bool = False, demand_: bool = False, lags: Sequence[str] = (), rolling: Sequence[str] = (), **blocks
) -> DataFrame:
    """The asked families in one pass over the blocks of each series, so that all of them share two shuffles."""
    columns, kept = df.columns, df.columns
    fuels = {fuel: c for fuel in ("solar", "wind") if renewable_ and (c := first_with(columns, fuel))}
    plain, names = {}, []
    if renewable_:
        found = [c for c in columns if any(x in c.lower() for x in ("solar", "wind", "hydro"))]
        if found:
            plain["total_renewable_mwh"] = S.row_sum(*found)
            if load := first_with(columns, "demand"):
                plain["renewable_penetration"] = S.ratio(S.row_sum(*found), load) * 100
        names += list(plain)
        for fuel in fuels:
            names += [f"{fuel}_capacity_factor", f"{fuel}_ramp_rate"]
    c = first_with(columns, "demand") if demand_ else None
    if c:
        names += ["demand_growth_1h", "demand_growth_24h", "demand_zscore_168h", "is_daily_peak", "is_weekly_peak"]

    def new(w) -> dict:
        out = {f"{fuel}_ramp_rate": W.ramp(x, w) for fuel, x in fuels.items()}
        if c:
            out |= {
                "demand_growth_1h": W.growth(c, 1, w), "demand_growth_24h": W.growth(c, 24, w),
                "demand_zscore_168h": S.ratio(F.col(c) - W.laddered(c, "mean", 168), W.laddered(c, "std", 168)),
                "is_daily_peak": F.col(c) == W.laddered(c, "max", 24), "is_weekly_peak": F.col(c) == W.laddered(c, "max", 168),
            }
        return out | W.lag_columns(lags, W.LAGS, w) | W.rolling_columns(rolling, W.ROLLS)

    back = max(1, 167 if c or rolling else 0, max(W.LAGS) if lags else 0)
    long = list(dict.fromkeys([*([c] if c else []), *rolling]))
    steps = W.ladder_steps(long, W.ROLLS) if long else ()
    out = df.select("*", *[v.alias(k) for k, v in plain.items()])
    if fuels:
        out = W.shares_of_max(out, {f"{fuel}_capacity_factor": x for fuel, x in fuels.items()}, region)
    if fuels or c or lags or rolling:
        out = W.over_rows(out, new, back, region=region, ts=ts, steps=steps, **blocks)
    names += [*W.lag_columns(lags, W.LAGS, W.series(region, ts)), *W.rolling_columns(rolling, W.ROLLS)]
    return out.select(*kept, *names)


def supply_demand(df: DataFrame, demand_column: str | None = None, supplies: Sequence[str] | None = None, strict_reference: bool = False) -> DataFrame:
    """Balance of supply and demand. ``strict_reference`` also sums derived columns named after a fuel."""
    d = demand_column or first_with(df.columns, "demand")
    if supplies is None:
        fuel = [c for c in df.columns if any(f in c.lower() for f in BASE_FUELS)]
        supplies = fuel if strict_reference else [c for c in fuel if c.lower() in {f"{f}_mwh" for f in BASE_FUELS}]
    if d is None or not supplies:
        return df
    total = S.row_sum(*supplies)
    net = total - F.col(d)
    margin = S.ratio(net, d) * 100
    return df.withColumns(
        {
            "total_generation_mwh": total, "net_supply_mwh": net, "supply_adequacy_ratio": S.ratio(total, d), "supply_shortage": net < 0,
            "reserve_margin_pct": margin, "grid_stress": margin < 5,
        }
    )


def all_features(df: DataFrame, region: str = "region", ts: str = "datetime", lags: bool = True, rolling: bool = True, **blocks) -> DataFrame:
    """The whole chain: calendar, renewable, demand, balance, then lags of 5 and rolling statistics of 3 core columns."""
    core = [c for c in df.columns if c not in (region, ts) and any(x in c.lower() for x in ("demand", *BASE_FUELS))]
    calendar = temporal(df, ts)
    out = with_features(calendar, region, ts, True, True, core[:5] if lags else (), core[:3] if rolling else (), **blocks)
    late = [c for c in out.columns if "_lag_" in c or "_rolling_" in c]
    balanced = supply_demand(out.drop(*late) if late else out).columns
    return supply_demand(out, first_with(df.columns, "demand"), [c for c in df.columns if c.lower() in {f"{f}_mwh" for f in BASE_FUELS}]).select(*balanced, *late)


def feature_columns(df: DataFrame) -> list[str]:
    """The numeric columns that enter a matrix: float, double, int, long and boolean."""
    kinds = (T.FloatType, T.DoubleType, T.IntegerType, T.LongType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def matrix(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, normalize: bool = True, epsilon: float = 1e-8) -> DataFrame:
    """keys and ``features array<float>``: NULL as 0, then (x - mean) / (population std + epsilon)."""
    columns = list(columns or feature_columns(df.drop(*keys)))
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    if not normalize:
        return df.select(*keys, F.array(*x.values()).cast("array<float>").alias("features"))
    moments = F.array(*[F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")) for v in x.values()])
    fitted = df.agg(moments.alias("fitted")).scalar()  # a subquery of the same query: no job while the plan is built
    scaled = [(v - fitted[i]["mean"]) / (fitted[i]["std"] + epsilon) for i, v in enumerate(x.values())]
    return df.select(*keys, F.array(*scaled).cast("array<float>").alias("features"))
