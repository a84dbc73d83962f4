"""Queries over ordered series: lags, rolling statistics, fills, flags, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..operators import attention, features, moments, quality, reshape, sequences
from ..operators import windows as W
from ..sources import synthetic
from .panels import HOURLY, REGIONAL, WIDE, hourly, regional, wide
from .registry import query

r6 = lambda c: F.round(c, 6)
WIN = "(PARTITION BY region ORDER BY ts)"


def panel_with(spark, sf_dir, new, back: int) -> DataFrame:
    """The hourly panel with row-frame columns, in blocks: round(…, 6) unless the column rounds itself."""
    return W.over_rows(hourly(spark, sf_dir), new, back, ts="ts", chunk_hours=CHUNK, block_rows=BLOCK)


#: Small enough that the test tables fill several chunks and blocks of each series.
CHUNK, BLOCK = 24 * 7, 256

FILLED = HOURLY + """, ends AS (SELECT region, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY 1),
spine AS (SELECT region, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM ends),
filled AS (SELECT spine.region, spine.ts, hourly.v FROM spine LEFT JOIN hourly ON spine.region = hourly.region AND spine.ts = hourly.ts)"""


def rolled(fn: str, n: int, c: str = "v", order: str = "ts") -> str:
    frame = f"(PARTITION BY region ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {frame} = {n} THEN {fn}({c}) OVER {frame} END"


def filled(spark, sf_dir) -> DataFrame:
    return reshape.on_spine(hourly(spark, sf_dir).select("region", "ts", "v"), ["region"], "ts")


@query(f"WITH {HOURLY} SELECT region, ts, round(v, 6) AS v, round(lag(v) OVER {WIN}, 6) AS lag_1, round(lag(v, 24) OVER {WIN}, 6) AS lag_24, round({rolled('avg', 24)}, 9) AS mean_24, round({rolled('stddev_samp', 24)}, 6) AS std_24 FROM hourly")
def hourly_feature_panel(spark, sf_dir):
    v = F.col("v")
    new = lambda w: {"lag_1": F.lag("v").over(w), "lag_24": F.lag("v", 24).over(w), "mean_24": W.full(v, F.avg, w, 24), "std_24": W.full(v, F.stddev_samp, w, 24)}
    out = panel_with(spark, sf_dir, new, 24)
    return out.select("region", "ts", *[F.round(c, 9 if c == "mean_24" else 6).alias(c) for c in ("v", "lag_1", "lag_24", "mean_24", "std_24")])


@query(f"WITH {HOURLY} SELECT region, ts, " + ", ".join(f"round(lag(v, {k}) OVER {WIN}, 6) AS v_lag_{k}h" for k in W.LAGS) + " FROM hourly")
def lag_features(spark, sf_dir):
    out = W.add_lags(hourly(spark, sf_dir).select("region", "ts", "v"), ["v", "absent"], ts="ts", chunk_hours=CHUNK, block_rows=BLOCK)
    return out.select("region", "ts", *[r6(f"v_lag_{k}h").alias(f"v_lag_{k}h") for k in W.LAGS])


@query(
    f"WITH {HOURLY} SELECT region, ts, "
    + ", ".join(f"round({rolled(f, n)}, {9 if name == 'mean' else 6}) AS v_rolling_{name}_{n}h" for n in W.ROLLS for name, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    + " FROM hourly"
)
def rolling_features(spark, sf_dir):
    out = W.add_rolling(hourly(spark, sf_dir).select("region", "ts", "v"), ["v"], ts="ts", chunk_hours=CHUNK, block_rows=BLOCK)
    return out.select("region", "ts", *[F.round(c, 9 if "_mean_" in c else 6).alias(c) for c in out.columns if "_rolling_" in c])


@query(f"WITH {FILLED} SELECT region, ts, round({rolled('avg', 168, 'x')}, 6) AS v_rolling_mean_168h, round({rolled('stddev_samp', 168, 'x')}, 6) AS v_rolling_std_168h FROM (SELECT region, ts, coalesce(v, 0) AS x FROM filled)")
def rolling_features_chunked(spark, sf_dir):
    out = W.rolling_in_chunks(filled(spark, sf_dir).fillna(0.0, ["v"]), "v", 168, chunk_hours=240, ts="ts")
    return out.select("region", "ts", r6("v_rolling_mean_168h").alias("v_rolling_mean_168h"), r6("v_rolling_std_168h").alias("v_rolling_std_168h"))


@query(f"WITH {HOURLY} SELECT region, ts, round(avg(v) OVER (PARTITION BY region ORDER BY ts RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW), 9) AS mean_24h FROM hourly")
def rolling_by_time(spark, sf_dir):
    out = W.timed(hourly(spark, sf_dir), {"mean_24h": ("v", F.avg)}, 24, ts="ts", chunk_hours=CHUNK)
    return out.select("region", "ts", F.round("mean_24h", 9).alias("mean_24h"))


@query(f"WITH {HOURLY} SELECT region, ts, round(v - lag(v) OVER {WIN}, 6) AS ramp FROM hourly")
def ramp_rate(spark, sf_dir):
    return panel_with(spark, sf_dir, lambda w: {"ramp": r6(W.ramp("v", w))}, 1).select("region", "ts", "ramp")


@query(f"WITH {HOURLY} SELECT region, ts, round((v - lag(v) OVER {WIN}) / nullif(lag(v) OVER {WIN}, 0) * 100, 6) AS growth_1h, round((v - lag(v, 24) OVER {WIN}) / nullif(lag(v, 24) OVER {WIN}, 0) * 100, 6) AS growth_24h FROM hourly")
def growth_rate(spark, sf_dir):
    new = lambda w: {f"growth_{k}h": r6(W.growth("v", k, w)) for k in (1, 24)}
    return panel_with(spark, sf_dir, new, 24).select("region", "ts", "growth_1h", "growth_24h")


@query(f"WITH {HOURLY} SELECT region, ts, round((v - {rolled('avg', 168)}) / nullif({rolled('stddev_samp', 168)}, 0), 6) AS zscore FROM hourly")
def rolling_zscore(spark, sf_dir):
    return panel_with(spark, sf_dir, lambda w: {"zscore": r6(W.rolling_zscore("v", 168, w))}, 167).select("region", "ts", "zscore")


@query(f"WITH {HOURLY} SELECT region, ts, v = {rolled('max', 24)} AS daily_peak, v = {rolled('max', 168)} AS weekly_peak FROM hourly")
def peak_flags(spark, sf_dir):
    new = lambda w: {"daily_peak": W.is_peak("v", 24, w), "weekly_peak": W.is_peak("v", 168, w)}
    return panel_with(spark, sf_dir, new, 167).select("region", "ts", "daily_peak", "weekly_peak")


@query(f"WITH {HOURLY} SELECT region, ts, round({rolled('stddev_samp', 24)} / nullif({rolled('avg', 24)}, 0), 6) AS cv FROM hourly")
def rolling_cv(spark, sf_dir):
    return panel_with(spark, sf_dir, lambda w: {"cv": r6(W.rolling_cv("v", 24, w))}, 23).select("region", "ts", "cv")


@query(f"WITH {HOURLY} SELECT region, ts, round(v / nullif(max(v) OVER (PARTITION BY region), 0), 6) AS factor FROM hourly")
def capacity_factor(spark, sf_dir):
    return W.shares_of_max(hourly(spark, sf_dir), {"factor": "v"}).select("region", "ts", r6("factor").alias("factor"))


@query(f"WITH {HOURLY}, g AS (SELECT region, date_diff('hour', lag(ts) OVER {WIN}, ts) AS gap FROM hourly) SELECT region, count(*) FILTER (WHERE gap > 1.5) AS n_gaps, coalesce(max(gap), 0) AS max_gap_hours FROM g GROUP BY region")
def gap_report(spark, sf_dir):
    return W.gap_report(hourly(spark, sf_dir), ts="ts", chunk_hours=CHUNK)


FFILL = f"last_value(v IGNORE NULLS) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"  # noqa: F541


@query(f"WITH {FILLED} SELECT region, ts, round({FFILL}, 6) AS v FROM filled")
def forward_fill(spark, sf_dir):
    return W.fill_forward(filled(spark, sf_dir), ["v"], ts="ts", chunk_hours=CHUNK).select("region", "ts", r6("v").alias("v"))


@query(f"""WITH {FILLED}, k AS (SELECT region, ts, v, {FFILL} AS v0,
 last_value(CASE WHEN v IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
 first_value(v IGNORE NULLS) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
 first_value(CASE WHEN v IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM filled)
SELECT region, ts, round(coalesce(v, v0 + (v1 - v0) * (epoch(ts) - t0) / nullif(t1 - t0, 0)), 6) AS v FROM k""")
def linear_interpolation(spark, sf_dir):
    return W.fill_linear(filled(spark, sf_dir), ["v"], ts="ts", chunk_hours=CHUNK).select("region", "ts", r6("v").alias("v"))


@query(f"WITH {FILLED} SELECT region, ts, round(coalesce({FFILL}, avg(v) OVER (PARTITION BY region)), 6) AS v FROM filled")
def mean_impute(spark, sf_dir):
    return W.impute(filled(spark, sf_dir), ["v"], ts="ts", chunk_hours=CHUNK).select("region", "ts", r6("v").alias("v"))


@query(f"WITH {HOURLY} SELECT region, ts, coalesce(abs((v - avg(v) OVER (PARTITION BY region)) / nullif(stddev_samp(v) OVER (PARTITION BY region), 0)) > 3, false) AS v_anomaly, coalesce(abs((total - avg(total) OVER (PARTITION BY region)) / nullif(stddev_samp(total) OVER (PARTITION BY region), 0)) > 3, false) AS total_anomaly FROM hourly")
def global_zscore_flags(spark, sf_dir):
    return W.zscore_flags(hourly(spark, sf_dir), ["v", "total"]).select("region", "ts", "v_anomaly", "total_anomaly")


@query("""SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, isodow(ts)::INT AS weekday, dayofyear(ts)::INT AS day_of_year,
round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, round(sin(2 * pi() * isodow(ts) / 7), 6) AS weekday_sin, round(cos(2 * pi() * isodow(ts) / 7), 6) AS weekday_cos, round(sin(2 * pi() * month(ts) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS month_cos, round(sin(2 * pi() * dayofyear(ts) / 365), 6) AS day_of_year_sin, round(cos(2 * pi() * dayofyear(ts) / 365), 6) AS day_of_year_cos,
isodow(ts) >= 6 AS is_weekend, hour(ts) BETWEEN 9 AND 17 AS is_business_hour, (hour(ts) BETWEEN 6 AND 9 OR hour(ts) BETWEEN 17 AND 20) AS is_peak_hour, month(ts) BETWEEN 6 AND 8 AS is_summer FROM events""")
def temporal_features(spark, sf_dir):
    out = features.temporal(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"), "ts")
    ints = [F.col(c).cast("int").alias(c) for c in ("year", "month", "day", "hour", "weekday", "day_of_year")]
    waves = [F.round(c, 6).alias(c) for x in ("hour", "weekday", "month", "day_of_year") for c in (f"{x}_sin", f"{x}_cos")]
    return out.select("event_id", *ints, *waves, "is_weekend", "is_business_hour", "is_peak_hour", "is_summer")


@query("SELECT event_id, isodow(ts) >= 5 AS is_weekend FROM events")
def weekend_iso_reference(spark, sf_dir):
    return features.temporal(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", weekend="iso_reference").select("event_id", "is_weekend")


DT = "(PARTITION BY region ORDER BY datetime)"


@query(f"""WITH {WIDE} SELECT region, datetime, round(solar_mwh + wind_mwh + hydro_mwh, 6) AS total_renewable_mwh, round((solar_mwh + wind_mwh + hydro_mwh) / nullif(demand_mwh, 0) * 100, 6) AS renewable_penetration,
round(solar_mwh / nullif(max(solar_mwh) OVER (PARTITION BY region), 0), 6) AS solar_capacity_factor, round(solar_mwh - lag(solar_mwh) OVER {DT}, 6) AS solar_ramp_rate,
round(wind_mwh / nullif(max(wind_mwh) OVER (PARTITION BY region), 0), 6) AS wind_capacity_factor, round(wind_mwh - lag(wind_mwh) OVER {DT}, 6) AS wind_ramp_rate FROM wide""")
def renewable_features(spark, sf_dir):
    out = features.renewable(wide(spark, sf_dir), chunk_hours=CHUNK, block_rows=BLOCK)
    new = ["total_renewable_mwh", "renewable_penetration", "solar_capacity_factor", "solar_ramp_rate", "wind_capacity_factor", "wind_ramp_rate"]
    return out.select("region", "datetime", *[r6(c).alias(c) for c in new])


@query(f"""WITH {WIDE}, d AS (SELECT region, datetime, demand_mwh AS v FROM wide) SELECT region, datetime, round((v - lag(v) OVER {DT}) / nullif(lag(v) OVER {DT}, 0) * 100, 6) AS demand_growth_1h, round((v - lag(v, 24) OVER {DT}) / nullif(lag(v, 24) OVER {DT}, 0) * 100, 6) AS demand_growth_24h,
round((v - {rolled('avg', 168, 'v', 'datetime')}) / nullif({rolled('stddev_samp', 168, 'v', 'datetime')}, 0), 6) AS demand_zscore_168h, v = {rolled('max', 24, 'v', 'datetime')} AS is_daily_peak, v = {rolled('max', 168, 'v', 'datetime')} AS is_weekly_peak FROM d""")
def demand_features(spark, sf_dir):
    out = features.demand(wide(spark, sf_dir), chunk_hours=CHUNK, block_rows=BLOCK)
    rounded = [r6(c).alias(c) for c in ("demand_growth_1h", "demand_growth_24h", "demand_zscore_168h")]
    return out.select("region", "datetime", *rounded, "is_daily_peak", "is_weekly_peak")


TOTAL = "(solar_mwh + wind_mwh + hydro_mwh + natural_gas_mwh)"


@query(f"""WITH {WIDE} SELECT region, datetime, round({TOTAL}, 6) AS total_generation_mwh, round({TOTAL} - demand_mwh, 6) AS net_supply_mwh, round({TOTAL} / nullif(demand_mwh, 0), 6) AS supply_adequacy_ratio,
{TOTAL} - demand_mwh < -0.00001 AS supply_shortage, round(({TOTAL} - demand_mwh) / nullif(demand_mwh, 0) * 100, 6) AS reserve_margin_pct,
round(({TOTAL} - demand_mwh) / nullif(demand_mwh, 0) * 100, 6) < 5 AS grid_stress FROM wide""")
def supply_demand(spark, sf_dir):
    out = features.supply_demand(features.renewable(wide(spark, sf_dir)))
    rounded = [r6(c).alias(c) for c in ("total_generation_mwh", "net_supply_mwh", "supply_adequacy_ratio", "reserve_margin_pct")]
    return out.select("region", "datetime", *rounded, (F.col("net_supply_mwh") < -0.00001).alias("supply_shortage"), (r6("reserve_margin_pct") < 5).alias("grid_stress"))


@query(f"""WITH {WIDE}, r AS (SELECT *, solar_mwh + wind_mwh + hydro_mwh AS t FROM wide) SELECT region, datetime, round({TOTAL} + coalesce(solar_mwh / nullif(max(solar_mwh) OVER (PARTITION BY region), 0), 0)
 + coalesce(solar_mwh - lag(solar_mwh) OVER {DT}, 0) + coalesce(wind_mwh / nullif(max(wind_mwh) OVER (PARTITION BY region), 0), 0) + coalesce(wind_mwh - lag(wind_mwh) OVER {DT}, 0), 6) AS total_generation_mwh FROM r""")
def supply_demand_strict(spark, sf_dir):
    """Every column named after a fuel is a supply, derived ones too."""
    out = features.supply_demand(features.renewable(wide(spark, sf_dir)), strict_reference=True)
    return out.select("region", "datetime", r6("total_generation_mwh").alias("total_generation_mwh"))


CORE = ("demand_mwh", "solar_mwh", "wind_mwh", "hydro_mwh", "natural_gas_mwh")


def all_features_sql() -> str:
    """The 153 columns in SQL; the calendar, renewable and demand parts are those of the queries above."""
    part = ["year(t)::INT AS year", "month(t)::INT AS month", "day(t)::INT AS day", "hour(t)::INT AS hour", "isodow(t)::INT AS weekday", "dayofyear(t)::INT AS day_of_year"]
    part += [f"round({f}(2 * pi() * {e} / {n}), 6) AS {k}_{f}" for k, e, n in (("hour", "hour(t)", 24), ("weekday", "isodow(t)", 7), ("month", "month(t)", 12), ("day_of_year", "dayofyear(t)", 365)) for f in ("sin", "cos")]
    part += ["isodow(t) >= 6 AS is_weekend", "hour(t) BETWEEN 9 AND 17 AS is_business_hour", "(hour(t) BETWEEN 6 AND 9 OR hour(t) BETWEEN 17 AND 20) AS is_peak_hour", "month(t) BETWEEN 6 AND 8 AS is_summer"]
    part += ["round(solar_mwh + wind_mwh + hydro_mwh, 6) AS total_renewable_mwh", "round((solar_mwh + wind_mwh + hydro_mwh) / nullif(demand_mwh, 0) * 100, 6) AS renewable_penetration"]
    for x in ("solar", "wind"):
        part += [f"round({x}_mwh / nullif(max({x}_mwh) OVER (PARTITION BY region), 0), 6) AS {x}_capacity_factor", f"round({x}_mwh - lag({x}_mwh) OVER {DT}, 6) AS {x}_ramp_rate"]
    part += [f"round((v - lag(v, {k}) OVER {DT}) / nullif(lag(v, {k}) OVER {DT}, 0) * 100, 6) AS demand_growth_{k}h" for k in (1, 24)]
    part += [f"round((v - {rolled('avg', 168, 'v', 'datetime')}) / nullif({rolled('stddev_samp', 168, 'v', 'datetime')}, 0), 6) AS demand_zscore_168h"]
    part += [f"v = {rolled('max', n, 'v', 'datetime')} AS is_{name}_peak" for name, n in (("daily", 24), ("weekly", 168))]
    part += [f"round({TOTAL}, 6) AS total_generation_mwh", f"round({TOTAL} - v, 6) AS net_supply_mwh", f"round({TOTAL} / nullif(v, 0), 6) AS supply_adequacy_ratio", f"round({TOTAL} - v, 6) < 0 AS supply_shortage"]
    part += [f"round(({TOTAL} - v) / nullif(v, 0) * 100, 6) AS reserve_margin_pct", f"round(({TOTAL} - v) / nullif(v, 0) * 100, 6) < 5 AS grid_stress"]
    part += [f"round(lag({c}, {k}) OVER {DT}, 6) AS {c}_lag_{k}h" for c in CORE for k in W.LAGS]
    part += [f"round({rolled(fn, n, c, 'datetime')}, 6) AS {c}_rolling_{name}_{n}h" for c in CORE[:3] for n in W.ROLLS for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
    core = [f"round({c}, 6) AS {c}" for c in CORE]
    return f"WITH {WIDE}, d AS (SELECT *, datetime AS t, demand_mwh AS v FROM wide) SELECT region, datetime, {', '.join(core + part)} FROM d"


@query(all_features_sql())
def all_features(spark, sf_dir):
    """153 columns beside the region, each rounded to 6 places."""
    out = features.all_features(wide(spark, sf_dir), chunk_hours=CHUNK, block_rows=BLOCK)
    ints = ("year", "month", "day", "hour", "weekday", "day_of_year")
    margin = {"supply_shortage": r6("net_supply_mwh") < 0, "grid_stress": r6("reserve_margin_pct") < 5}
    kinds = dict(out.dtypes)
    return out.select(*[F.col(c).cast("int").alias(c) if c in ints else margin[c].alias(c) if c in margin else r6(c).alias(c) if kinds[c] == "double" else F.col(c) for c in out.columns])


@query(f"""WITH {WIDE}, d AS (SELECT *, abs(demand_mwh - lag(demand_mwh) OVER {DT}) AS diff FROM wide) SELECT region, round(avg(diff), 6) AS mean_abs_diff, round(corr(demand_mwh, solar_mwh), 6) AS correlation FROM d GROUP BY region""")
def feature_correlation(spark, sf_dir):
    out = quality.relation(wide(spark, sf_dir), "demand_mwh", "solar_mwh", ts="datetime", chunk_hours=CHUNK, block_rows=BLOCK)
    return out.select("region", r6("mean_abs_diff").alias("mean_abs_diff"), r6("correlation").alias("correlation"))


FEATURES = ["demand_mwh", "solar_mwh", "wind_mwh"]


@query(f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM wide" for c in FEATURES))
def normalizer_fit(spark, sf_dir):
    return sequences.fit_normalizer(wide(spark, sf_dir), FEATURES).select("feature", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


def refitted(spark, sf_dir) -> moments.MomentStore:
    """The panel in three arrivals by month, day and hour, the second fitted twice."""
    df, held = wide(spark, sf_dir), moments.MomentStore(spark, shared.fresh_path(spark, "moments"), FEATURES, ["region"])
    part = F.dayofyear("datetime") % 3
    for k in (0, 1, 1, 2):
        held.add(df.where(part == k), f"part-{k}")
    return held


@query(f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT region, '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM wide GROUP BY region" for c in FEATURES))
def merged_fit(spark, sf_dir):
    """Means, deviations and extremes of each region from the merged states of three arrivals."""
    out = moments.fitted(refitted(spark, sf_dir).merged(), ["region"])
    return out.select("region", "feature", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@query(f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT region, '{a}' AS x, '{b}' AS y, count(*) AS n, round(corr({a}, {b}), 6) AS correlation FROM wide GROUP BY region" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]))
def merged_correlations(spark, sf_dir):
    """Correlations of every pair of columns from the same states."""
    return moments.correlations(refitted(spark, sf_dir).merged(), ["region"]).withColumn("correlation", r6("correlation"))


@query(f"WITH {WIDE} SELECT region, datetime, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 6) AS {c}_norm" for c in FEATURES) + " FROM wide")
def zscore_normalize(spark, sf_dir):
    df = wide(spark, sf_dir)
    out = sequences.normalize(df, sequences.fit_normalizer(df, FEATURES), FEATURES)
    return out.select("region", "datetime", *[r6(f"{c}_norm").alias(f"{c}_norm") for c in FEATURES])


@query(f"WITH {WIDE} SELECT region, datetime, " + ", ".join(f"round(((({c}) - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-8))::FLOAT::DOUBLE, 3) AS f{i}" for i, c in enumerate(FEATURES)) + " FROM wide")
def feature_matrix(spark, sf_dir):
    out = features.matrix(wide(spark, sf_dir), ["region", "datetime"], FEATURES)
    return out.select("region", "datetime", *[F.round(F.col("features")[i].cast("double"), 3).alias(f"f{i}") for i in range(3)])


NUM = f"{WIDE}, num AS (SELECT *, row_number() OVER {DT} - 1 AS r, count(*) OVER (PARTITION BY region) AS n FROM wide)"


def sequence_sql(length: int, stride: int, room: int, extra: str = "") -> str:
    return f"""WITH {NUM}, s AS (SELECT DISTINCT region, n, unnest(generate_series(0, n - {length} - {room}, {stride})) AS start FROM num WHERE n >= {length + room})
SELECT num.region, s.start // {stride} AS seq_id, (num.r - s.start)::INT AS pos, round(num.demand_mwh, 6) AS demand_mwh{extra} FROM s JOIN num ON num.region = s.region AND num.r BETWEEN s.start AND s.start + {length - 1}"""


def rows_of(df: DataFrame, *more) -> DataFrame:
    return df.select("region", "seq_id", "pos", r6("demand_mwh").alias("demand_mwh"), *more)


@query(sequence_sql(168, 24, 1))
def sequence_windows(spark, sf_dir):
    return rows_of(sequences.windows(wide(spark, sf_dir), ["region"], "datetime", 168, 24))


@query(f"WITH {NUM} SELECT region, (r - 168) // 24 AS seq_id, round(demand_mwh, 6) AS target FROM num WHERE r >= 168 AND (r - 168) % 24 = 0")
def next_row_targets(spark, sf_dir):
    out = sequences.next_row_targets(wide(spark, sf_dir), ["region"], "datetime", "demand_mwh", 168, 24)
    return out.select("region", "seq_id", r6("target").alias("target"))


@query(sequence_sql(168, 24, 1, ", round((SELECT m.demand_mwh FROM num m WHERE m.region = num.region AND m.r = num.r + 1), 6) AS target"))
def target_shift(spark, sf_dir):
    out = sequences.shifted_targets(wide(spark, sf_dir), ["region"], "datetime", "demand_mwh", 168, 24)
    return rows_of(out, r6("target").alias("target"))


@query(sequence_sql(100, 100, 0))
def prediction_windows(spark, sf_dir):
    return rows_of(sequences.prediction_windows(wide(spark, sf_dir), ["region"], "datetime", 100))


@query(sequence_sql(168, 144, 0))
def overlap_windows(spark, sf_dir):
    return rows_of(sequences.overlapping(wide(spark, sf_dir), ["region"], "datetime", 168, 24))


SEG = sequences.segment_length(168, 4, 8)


@query(f"""WITH q AS ({sequence_sql(168, 168, 0)}), g AS (SELECT unnest(range(4)) AS segment), b AS (SELECT segment, least(segment * {SEG - 8}, {168 - SEG}) AS start FROM g)
SELECT region, seq_id, segment::INT AS segment, (pos - start)::INT AS seg_pos, demand_mwh FROM q JOIN b ON pos >= start AND pos < start + {SEG}""")
def ring_segments(spark, sf_dir):
    seq = sequences.prediction_windows(wide(spark, sf_dir), ["region"], "datetime", 168)
    out = sequences.ring_segments(seq, 168, 4, 8)
    return out.select("region", "seq_id", "segment", F.col("seg_pos").cast("int").alias("seg_pos"), r6("demand_mwh").alias("demand_mwh"))


@query(f"WITH {NUM}, s AS (SELECT DISTINCT region, unnest(generate_series(0, n - 168 - 1, 24)) AS start FROM num WHERE n >= 169) SELECT region, start // 24 AS seq_id, start, start + 168 AS stop, (start // 24) // 8 AS batch_id FROM s")
def batching(spark, sf_dir):
    return sequences.batches(sequences.starts(wide(spark, sf_dir), ["region"], 168, 24), 8)


@query(f"WITH {NUM} SELECT region, count(*) AS n_rows, greatest(0, (count(*) - 168 - 1) // 24 + 1) AS n_sequences, 'demand_mwh,solar_mwh' AS available, 'coal_mwh' AS missing FROM num GROUP BY region")
def sequence_info(spark, sf_dir):
    out = sequences.info(wide(spark, sf_dir), ["region"], 168, 24, ["demand_mwh", "coal_mwh", "solar_mwh"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("available", "missing")})


@query(f"""WITH {WIDE} SELECT CASE WHEN datetime BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-20 23:00:00' THEN 'train' WHEN datetime BETWEEN TIMESTAMP '2024-01-21 00:00:00' AND TIMESTAMP '2024-01-25 23:00:00' THEN 'validation' ELSE 'test' END AS split,
count(*) AS n, min(datetime) AS first, max(datetime) AS last FROM wide WHERE datetime <= TIMESTAMP '2024-01-30 23:00:00' GROUP BY 1""")
def temporal_split(spark, sf_dir):
    bounds = {"train": ("2024-01-01 00:00:00", "2024-01-20 23:00:00"), "validation": ("2024-01-21 00:00:00", "2024-01-25 23:00:00"), "test": ("2024-01-26 00:00:00", "2024-01-30 23:00:00")}
    return sequences.split(wide(spark, sf_dir), "datetime", bounds).groupBy("split").agg(F.count("*").alias("n"), F.min("datetime").alias("first"), F.max("datetime").alias("last"))


@query("SELECT q // 6 AS segment, sum(q + 1)::BIGINT AS visible, count(*) * 24 AS total FROM range(24) t(q) GROUP BY 1")
def causal_mask_counts(spark, sf_dir):
    return attention.mask_counts(spark, 24, 4)


@query(None)
def ring_attention_block(spark, sf_dir):
    seq = sequences.prediction_windows(wide(spark, sf_dir), ["region"], "datetime", 24)
    arrays = sequences.as_arrays(seq, ["region"], FEATURES)
    return attention.attend(arrays.select(F.xxhash64("region", "seq_id").alias("seq_id"), "features"), 4)


TWO_PI = 6.283185307179586


@query(f"""WITH w AS (SELECT t, greatest(100.0, 1000.0 * (1 + 0.2 * sin({TWO_PI} * t / 24 - pi() / 3) + 0.1 * sin({TWO_PI} * t / 168) + 0.3 * cos({TWO_PI} * t / 8766))) AS d,
0.25 * greatest(0.0, sin({TWO_PI} * t / 24 - pi() / 2)) * (0.5 + 0.5 * sin({TWO_PI} * t / 8766 - pi() / 2)) * 0.85 * 1000.0 AS s,
least(greatest(0.35 * (0.3 + 0.2 * sin({TWO_PI} * t / 168) + 0.3 * 0.5 * sqrt(-2 * ln(0.5))), 0), 0.7) * 1000.0 AS w,
15 + 10 * sin({TWO_PI} * t / 8766 - pi() / 2) + 5 * sin({TWO_PI} * t / 24 - pi() / 2) AS c FROM range(744) r(t)),
f AS (SELECT avg(d) AS m, stddev_pop(d) AS sd, avg(s + w) AS r, median(d) AS med FROM w)
SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(t::BIGINT) AS datetime, round(d, 6) AS demand_mw, round(s, 6) AS solar_generation_mw, round(w, 6) AS wind_generation_mw, round(c, 6) AS temperature_c,
round(greatest(5.0, 50 + 30 * (d - m) / sd - 20 * (s + w) / r), 6) AS price_usd_per_mwh, round(least(1.0, greatest(0.0, 0.8 - 0.1 * least(abs(d - med) / sd, 3.0) / 3)), 6) AS grid_stability FROM w, f""")
def synthetic_series(spark, sf_dir):
    out = synthetic.series(spark, 744, seed=None)
    return out.select("datetime", *[r6(c).alias(c) for c in out.columns if c != "datetime"])


@query(f"""WITH {HOURLY}, ends AS (SELECT greatest(min(ts) FILTER (WHERE region = 'view'), min(ts) FILTER (WHERE region = 'click')) AS lo, least(max(ts) FILTER (WHERE region = 'view'), max(ts) FILTER (WHERE region = 'click')) AS hi FROM hourly),
spine AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM ends)
SELECT spine.ts, round(a.v, 6) AS v_source_0, round(b.v, 6) AS v_source_1 FROM spine LEFT JOIN hourly a ON a.region = 'view' AND a.ts = spine.ts LEFT JOIN hourly b ON b.region = 'click' AND b.ts = spine.ts""")
def spine_left_join(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    side = lambda t: events.where(F.col("event_type") == t).select("ts", F.col("value").alias("v"))
    out = reshape.align([side("view"), side("click")], "ts")
    return out.select("ts", r6("v_source_0").alias("v_source_0"), r6("v_source_1").alias("v_source_1"))


@query(f"WITH {FILLED} SELECT region, ts, round(v, 6) AS v FROM filled")
def hourly_resample(spark, sf_dir):
    return filled(spark, sf_dir).select("region", "ts", r6("v").alias("v"))


@query(f"WITH {FILLED}, g AS (SELECT region, date_diff('hour', lag(ts) OVER {WIN}, ts) AS gap FROM hourly), m AS (SELECT region, count(*) FILTER (WHERE gap > 1.5) AS n_gaps FROM g GROUP BY region) SELECT f.region, count(*) AS n_hours, count(v) AS n_values, round(min(v), 6) AS low, round(max(v), 6) AS high, any_value(m.n_gaps) AS n_gaps FROM filled f JOIN m ON m.region = f.region GROUP BY f.region")
def data_info(spark, sf_dir):
    # panel and spine are read three times: written once, they are computed once
    panel = shared.save(hourly(spark, sf_dir).select("region", "ts", "v"), "panel")
    out = quality.series_info(reshape.on_spine(panel, ["region"], "ts"), panel, "region", "ts", "v")
    return out.select("region", "n_hours", "n_values", r6("low").alias("low"), r6("high").alias("high"), "n_gaps")


@query(f"WITH {NUM}, s AS (SELECT DISTINCT region, unnest(generate_series(0, n - 168 - 1, 24)) AS start FROM num WHERE n >= 169) SELECT region, start // 24 AS seq_id, row_number() OVER (ORDER BY md5('42:' || region || ':' || (start // 24)))::BIGINT AS place FROM s")
def shuffled_sequences(spark, sf_dir):
    """Whole sequences in a repeatable random order."""
    out = sequences.shuffled(sequences.starts(wide(spark, sf_dir), ["region"], 168, 24), 42, ["region"])
    # the place is for the comparison only: a global order is one sort, as ``orderBy("shuffle_key")`` would be
    return out.select("region", "seq_id", F.row_number().over(Window.orderBy("shuffle_key")).cast("long").alias("place"))


@query(f"WITH {REGIONAL}, y AS (SELECT region, year(timestamp) AS y, count(*) AS n, count(DISTINCT timestamp::DATE) AS d FROM regional WHERE year(timestamp) BETWEEN 1995 AND 1999 GROUP BY 1, 2) SELECT region, count(*) AS years, min(y)::BIGINT AS earliest_year, count(*) * 100.0::DOUBLE / 5 AS coverage_pct, round(sum(n)::DOUBLE / sum(d), 6) AS rows_per_day FROM y GROUP BY region")
def coverage_map(spark, sf_dir):
    return quality.coverage(regional(spark, sf_dir), "region", "timestamp", range(1995, 2000)).withColumn("rows_per_day", r6("rows_per_day"))
