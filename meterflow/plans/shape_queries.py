"""Queries that reshape, join, aggregate, check and parse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clean, quality, reshape
from ..sources import raw_json
from .panels import DAILY, HOURLY, REGIONAL, TYPES, hourly, regional, table
from .registry import query

r6 = lambda c: F.round(c, 6)
r2 = lambda c: F.round(c, 2)


@query(f"WITH {DAILY} SELECT region, timestamp, round(daily_avg, 6) AS daily_avg, round(daily_max, 6) AS daily_max, round(daily_min, 6) AS daily_min, round(daily_std, 6) AS daily_std FROM daily")
def daily_regional_features(spark, sf_dir):
    return reshape.daily_features(regional(spark, sf_dir)).select("region", "timestamp", *[r6(c).alias(c) for c in ("daily_avg", "daily_max", "daily_min", "daily_std")])


@query(f"""WITH {DAILY} SELECT a.timestamp, a.region AS from_region, b.region AS to_region, round(b.daily_avg - a.daily_avg, 6) AS avg_differential, round(b.daily_max - a.daily_max, 6) AS max_differential,
round(b.daily_avg / nullif(a.daily_avg, 0), 6) AS avg_ratio FROM daily a JOIN daily b ON a.timestamp = b.timestamp AND a.region <> b.region""")
def cross_region_pairs(spark, sf_dir):
    out = reshape.cross_region(reshape.daily_features(regional(spark, sf_dir)))
    return out.select("timestamp", "from_region", "to_region", r6("avg_differential").alias("avg_differential"), r6("max_differential").alias("max_differential"), r6("avg_ratio").alias("avg_ratio"))


def pivot_sql(fn: str) -> str:
    cells = ", ".join(f"round(coalesce({fn}(CASE WHEN event_type = '{t}' THEN value END), 0), 6) AS {t}_mwh" for t in TYPES)
    return f"SELECT date_trunc('hour', ts) AS ts, {cells} FROM events GROUP BY 1"


def pivoted(spark, sf_dir, how: str):
    rows = table(spark, sf_dir, "events").select("event_id", S.hour_bucket("ts").alias("ts"), "event_type", "value")
    out = reshape.pivot(rows, ["ts"], "event_type", "value", TYPES, how, "_mwh", order="event_id")
    return out.select("ts", *[r6(f"{t}_mwh").alias(f"{t}_mwh") for t in TYPES])


@query(pivot_sql("sum"))
def pivot_sum(spark, sf_dir):
    return pivoted(spark, sf_dir, "sum")


@query(pivot_sql("avg"))
def pivot_mean(spark, sf_dir):
    return pivoted(spark, sf_dir, "mean")


@query("SELECT date_trunc('hour', ts) AS ts, " + ", ".join(f"round(coalesce(first(value ORDER BY event_id) FILTER (WHERE event_type = '{t}'), 0), 6) AS {t}_mwh" for t in TYPES) + " FROM events GROUP BY 1")
def pivot_first(spark, sf_dir):
    return pivoted(spark, sf_dir, "first")


FULL = """WITH d AS (SELECT r_name AS region, l_shipdate AS datetime, sum(l_quantity) AS solar_mwh FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
o AS (SELECT r_name AS region, o_orderdate AS datetime, sum(o_totalprice) AS demand_mwh FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT coalesce(o.region, d.region) AS region, coalesce(o.datetime, d.datetime) AS datetime, round(o.demand_mwh, 2) AS demand_demand_mwh, round(d.solar_mwh, 2) AS generation_solar_mwh FROM o FULL JOIN d ON o.region = d.region AND o.datetime = d.datetime"""


@query(FULL)
def full_outer_join(spark, sf_dir):
    out = reshape.join_demand_generation(*both_sides(spark, sf_dir))
    return out.select("region", "datetime", r2("demand_demand_mwh").alias("demand_demand_mwh"), r2("generation_solar_mwh").alias("generation_solar_mwh"))


@query(FULL.replace("SELECT coalesce(o.region", "SELECT round(o.demand_mwh, 2) AS demand_mwh, round(d.solar_mwh, 2) AS solar_mwh, coalesce(o.region"))
def full_outer_join_originals(spark, sf_dir):
    """As above, with the columns under their own names as well."""
    out = reshape.join_demand_generation(*both_sides(spark, sf_dir), keep=True)
    return out.select("region", "datetime", *[r2(c).alias(c) for c in out.columns if c not in ("region", "datetime")])


def both_sides(spark, sf_dir):
    """Daily demand by customers' regions, and shipped quantities by suppliers'."""
    demand = regional(spark, sf_dir).groupBy("region", F.col("timestamp").alias("datetime")).agg(F.sum("value").alias("demand_mwh"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    suppliers = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "region")
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    generation = items.groupBy("region", F.col("l_shipdate").alias("datetime")).agg(F.sum("l_quantity").alias("solar_mwh"))
    return demand, generation


@query(f"""WITH {HOURLY} SELECT a.ts, round(a.total, 6) AS demand, round(coalesce(b.total, 0), 6) AS renewables, round(coalesce(c.v, 0), 6) AS price FROM (SELECT * FROM hourly WHERE region = 'view') a
LEFT JOIN (SELECT * FROM hourly WHERE region = 'click') b ON a.ts = b.ts LEFT JOIN (SELECT * FROM hourly WHERE region = 'purchase') c ON a.ts = c.ts""")
def three_way_left_join(spark, sf_dir):
    panel = hourly(spark, sf_dir)
    side = lambda t, v, name: panel.where(F.col("region") == t).select("ts", F.col(v).alias(name))
    out = side("view", "total", "demand").join(side("click", "total", "renewables"), "ts", "left").join(side("purchase", "v", "price"), "ts", "left").fillna(0.0)
    return out.select("ts", *[r6(c).alias(c) for c in ("demand", "renewables", "price")])


@query("""WITH d AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS avg_demand, max(value) AS peak_demand FROM events WHERE event_type IN ('view', 'signup') GROUP BY 1),
g AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS generation, coalesce(sum(value) FILTER (WHERE event_type IN ('click', 'error')), 0) AS renewable FROM events WHERE event_type NOT IN ('view', 'signup') GROUP BY 1),
l AS (SELECT ts, string_agg(event_type || '=' || printf('%.2f', v), ',' ORDER BY event_type) AS last_by_fuel FROM (SELECT date_trunc('hour', ts) AS ts, event_type, last(value ORDER BY event_id) AS v FROM events WHERE event_type NOT IN ('view', 'signup') GROUP BY 1, 2) GROUP BY 1)
SELECT d.ts, round(coalesce(avg_demand / nullif(peak_demand, 0), 0), 6) AS load_factor, round(coalesce(renewable / nullif(generation, 0) * 100, 0), 6) AS renewable_pct, round(greatest(0, coalesce((peak_demand - avg_demand) / nullif(avg_demand, 0), 0)), 6) AS stress, round(avg_demand / 1000, 9) AS activity, last_by_fuel
FROM d JOIN g ON d.ts = g.ts JOIN l ON l.ts = d.ts""")
def regional_metrics(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", S.hour_bucket("ts").alias("ts"))
    load = F.col("event_type").isin("view", "signup")
    out = reshape.grid_metrics(reshape.bucket_metrics(events.where(load), events.where(~load), "ts", "value", "event_type", ("click", "error"), "event_id"))
    return out.select("ts", *[r6(c).alias(c) for c in ("load_factor", "renewable_pct", "stress")], F.round("activity", 9).alias("activity"), map_text("last_by_fuel").alias("last_by_fuel"))


def map_text(c: str):
    """A map as ``name=value`` pairs in order of the names."""
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"]))), ",")


@query(f"WITH p AS ({pivot_sql('sum')}) SELECT ts, round(view_mwh + click_mwh, 2) AS total_renewable_mwh, coalesce(round_even((view_mwh + click_mwh) / nullif(view_mwh + signup_mwh + click_mwh + error_mwh + purchase_mwh, 0) * 100, 2), 0) AS renewable_percentage FROM p")
def renewable_summary(spark, sf_dir):
    out = reshape.renewable_shares(pivoted(spark, sf_dir, "sum"), ["view_mwh", "click_mwh"], [f"{t}_mwh" for t in TYPES])
    return out.select("ts", "total_renewable_mwh", "renewable_percentage")


@query("""SELECT ts AS timestamp, event_type AS region, 'events' AS data_source, value, 'MWh' AS unit, 'demand' AS data_type FROM events UNION ALL SELECT o_orderdate, 'US', 'orders', o_totalprice, 'MW', 'demand' FROM orders""")
def harmonize_union(spark, sf_dir):
    a = reshape.harmonize(table(spark, sf_dir, "events").withColumnRenamed("event_type", "region"), "events", "demand", "ts", "value", "MWh")
    b = reshape.harmonize(table(spark, sf_dir, "orders"), "orders", "demand", "o_orderdate", "o_totalprice", "MW", region="US")
    return reshape.union_sources(a, b)


@query("SELECT event_id, hour, event_type, value FROM (SELECT event_id, date_trunc('hour', ts) AS hour, event_type, value, row_number() OVER (PARTITION BY date_trunc('hour', ts), event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", S.hour_bucket("ts").alias("hour"), "event_type", "value")
    return clean.keep_first(rows, ["hour", "event_type"], ["event_id"])


DIRTY = """dirty AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS timestamp, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS region,
CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 2 = 0 THEN 'SUN' END AS fuel_type, CASE WHEN event_id % 3 = 0 THEN 'demand' ELSE 'generation' END AS data_type FROM events)"""


def dirty(spark, sf_dir):
    """Events with NULLs at known places, in the unified columns."""
    gone = lambda n, c: F.when(F.col("event_id") % n != 0, c)
    return table(spark, sf_dir, "events").select(
        "event_id", gone(11, S.hour_bucket("ts")).alias("timestamp"), gone(13, F.col("event_type")).alias("region"), gone(17, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 2 == 0, "SUN").alias("fuel_type"), F.when(F.col("event_id") % 3 == 0, "demand").otherwise("generation").alias("data_type"),
    )


@query(f"""WITH {DIRTY}, k AS (SELECT count(DISTINCT struct_pack(a := timestamp, b := region, c := fuel_type)) AS final_records FROM dirty WHERE timestamp IS NOT NULL AND region IS NOT NULL AND value IS NOT NULL)
SELECT count(*) AS initial_records, any_value(k.final_records) AS final_records, count(*) FILTER (WHERE timestamp IS NULL) AS null_timestamp, count(*) FILTER (WHERE value IS NULL) AS null_value, count(*) FILTER (WHERE region IS NULL) AS null_region,
count(*) FILTER (WHERE data_type = 'demand' AND fuel_type IS NOT NULL) AS mislabelled, count(*) - any_value(k.final_records) AS dropped_records, round(any_value(k.final_records)::DOUBLE / count(*), 6) AS quality_score, round(count(*)::DOUBLE / any_value(k.final_records), 6) AS compression_ratio FROM dirty, k""")
def quality_report(spark, sf_dir):
    out = clean.report(dirty(spark, sf_dir)).drop("drop_pct").withColumn("compression_ratio", r6(S.ratio("initial_records", "final_records")))
    return out.withColumn("quality_score", r6("quality_score"))


@query(f"WITH {DIRTY} SELECT 'missing_demand_mw' AS issue, printf('%.1f', 100.0 * count(*) FILTER (WHERE value IS NULL) / count(*)) || '%' AS detail FROM dirty HAVING count(*) FILTER (WHERE value IS NULL) * 100.0 / count(*) > 5 UNION ALL SELECT 'range_demand_mw', count(*) || ' values out of range' FROM dirty WHERE value > 100 HAVING count(*) > 0")
def threshold_report(spark, sf_dir):
    return quality.thresholds(dirty(spark, sf_dir).select(F.col("value").alias("demand_mw")), 5.0, 0, 100)


@query(f"WITH {DIRTY} SELECT region, round((avg((value IS NOT NULL)::INT) + avg(coalesce(value BETWEEN 1 AND 50, false)::INT)) / 2, 3) AS availability FROM dirty GROUP BY region")
def availability_score(spark, sf_dir):
    return quality.availability(dirty(spark, sf_dir), ["region"], "value", 1, 50)


@query(f"WITH {DIRTY} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null, round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS pct_null FROM dirty" for c in ("timestamp", "region", "value", "fuel_type")))
def missing_counts(spark, sf_dir):
    return quality.missing(dirty(spark, sf_dir), ["timestamp", "region", "value", "fuel_type"]).withColumn("pct_null", r6("pct_null"))


@query("SELECT event_type AS region, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_timestamps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("region"), S.hour_bucket("ts").alias("ts"))
    return quality.duplicate_times(rows, ["region"], "ts")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max, round(avg({c}), 6) AS mean, round(median({c})::DOUBLE, 6) AS median, count(DISTINCT {c}) AS \"distinct\" FROM events" for c in ("value", "user_id")))
def profile_stats(spark, sf_dir):
    out = quality.profile(table(spark, sf_dir, "events"), ["value", "user_id"])
    return out.select("column", "count", *[r6(c).alias(c) for c in ("min", "max", "mean", "median")], "distinct")


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_values(spark, sf_dir):
    return quality.distinct(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("SELECT o_orderpriority, o_orderstatus, grouping(o_orderpriority, o_orderstatus)::BIGINT AS grouping_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def grouping_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return quality.counts_by(orders, ["o_orderpriority", "o_orderstatus"], n=F.count("*"), total=r2(F.sum("o_totalprice")))


@query("SELECT o_orderpriority, CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1, 2")
def size_buckets(spark, sf_dir):
    edges = {"small": 100_000, "medium": 300_000}
    return quality.buckets(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", edges, "large", n=F.count("*"), mean=r2(F.avg("o_totalprice")))


@query("(SELECT 'top' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL (SELECT 'bottom', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)")
def topk_size(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    top = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select(F.lit("top").alias("side"), "*")
    return top.union(orders.orderBy("o_totalprice", "o_orderkey").limit(5).select(F.lit("bottom").alias("side"), "*"))


@query("SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 10")
def head_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(10).select("event_id", "value")


@query("SELECT event_type, count(*) AS operations, round(avg(value), 6) AS average_latency, round(median(value), 6) AS median_latency, round(100.0::DOUBLE * count(*) FILTER (WHERE value < 50) / count(*), 6) AS success_rate, round(count(*) / nullif(epoch(max(ts)) - epoch(min(ts)), 0)::DOUBLE, 8) AS per_second FROM events GROUP BY 1")
def latency_metrics(spark, sf_dir):
    out = quality.latency(table(spark, sf_dir, "events"), ["event_type"], "value", "ts", F.col("value") < 50)
    rounded = [r6(c).alias(c) for c in ("average_latency", "median_latency", "success_rate")]
    return out.select("event_type", "operations", *rounded, F.round("per_second", 8).alias("per_second"))


@query("SELECT DISTINCT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL AND s_acctbal > 9000)")
def region_set_difference(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select("s_nationkey")
    return reshape.without(table(spark, sf_dir, "nation"), rich, "n_nationkey", "s_nationkey").select("n_name").distinct()


@query("SELECT f::DATE AS from_date, least(f + INTERVAL 7 DAY, DATE '2024-03-01')::DATE AS to_date FROM generate_series(DATE '2024-01-01', DATE '2024-02-29', INTERVAL 7 DAY) t(f)")
def date_batches(spark, sf_dir):
    return raw_json.date_batches(spark, "2024-01-01", "2024-02-29", 7)


@query("""WITH b AS (SELECT f::DATE AS from_date, least(f + INTERVAL 30 DAY, DATE '2024-03-01')::DATE AS to_date FROM generate_series(DATE '2024-01-01', DATE '2024-02-29', INTERVAL 30 DAY) t(f))
SELECT data_type, from_date, to_date, regions FROM (VALUES ('demand'), ('generation')) k(data_type), b, (VALUES ('PACW,ERCO'), ('CAL')) r(regions)""")
def request_plan(spark, sf_dir):
    out = raw_json.request_plan(spark, ["demand", "generation"], ["PACW", "ERCO", "CAL"], "2024-01-01", "2024-02-29", 30, 2)
    return out.withColumn("regions", F.array_join("regions", ","))


@query("SELECT ts, string_agg(event_type || '=' || printf('%.2f', s), ',' ORDER BY event_type) AS fuels FROM (SELECT date_trunc('hour', ts) AS ts, event_type, sum(value) AS s FROM events GROUP BY 1, 2) GROUP BY 1")
def fuel_map(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(S.hour_bucket("ts").alias("ts"), "event_type", "value")
    out = reshape.to_map(rows, ["ts"], "event_type", "value")
    return out.select("ts", map_text("by_name").alias("fuels"))


@query("""WITH m AS (SELECT date_trunc('hour', ts) AS ts, event_type IN ('view', 'signup') AS load, event_type, sum(value) AS s FROM events GROUP BY 1, 2, 3),
t AS (SELECT ts, load, string_agg(event_type || '=' || printf('%.2f', s), ',' ORDER BY event_type) AS names FROM m GROUP BY 1, 2) SELECT a.ts, a.names AS demand, b.names AS generation FROM t a JOIN t b ON a.ts = b.ts AND a.load AND NOT b.load""")
def map_join(spark, sf_dir):
    """Demand and generation maps of the hours that hold both."""
    rows, load = table(spark, sf_dir, "events").select(S.hour_bucket("ts").alias("ts"), "event_type", "value"), F.col("event_type").isin("view", "signup")
    out = reshape.join_maps(reshape.to_map(rows.where(load), ["ts"], "event_type", "value"), reshape.to_map(rows.where(~load), ["ts"], "event_type", "value"), ["ts"])
    return out.select("ts", map_text("demand").alias("demand"), map_text("generation").alias("generation"))


@query("SELECT CASE WHEN event_type = 'view' THEN 'demand' WHEN event_type IN ('click', 'error') THEN 'generation' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1")
def type_routing(spark, sf_dir):
    records = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "D").alias("type"), F.when(F.col("event_type").isin("click", "error"), F.col("event_type")).alias("fueltype"))
    return reshape.union_sources(*[df.select(F.lit(kind).alias("kind")) for kind, df in clean.route(records).items()]).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' AND event_type = 'view' AND value IS NOT NULL")
def range_and_region_filter(spark, sf_dir):
    at = F.col("ts").between(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-12 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").where(at & (F.col("event_type") == "view")).dropna(subset=["value"]).select("event_id", "event_type", "value")


@query("SELECT event_id, (props->>'k')::BIGINT AS k, md5(event_type || ':' || event_id || ':' || user_id) AS signature, split_part(event_type, 'i', 1) AS head, upper(event_type) AS code FROM events")
def json_and_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), S.file_signature("event_type", "event_id", "user_id").alias("signature"),
        F.split_part("event_type", F.lit("i"), F.lit(1)).alias("head"), F.upper("event_type").alias("code"),
    )


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS number, strptime(strftime(ts, '%Y-%m-%dT%H'), '%Y-%m-%dT%H') AS period, date_trunc('day', ts) + to_hours((event_id % 24)::BIGINT) AS hour_start FROM events")
def parse_fields(spark, sf_dir):
    bad = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("value").cast("string"), F.lit("d"))).otherwise(F.col("value").cast("string"))
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH")
    return table(spark, sf_dir, "events").select(
        "event_id", S.number(bad).alias("number"), S.strict_period(at).alias("period"), S.hour_of_day(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"), F.col("event_id") % 24 + 1).alias("hour_start")
    )


@query("SELECT event_id, least(greatest(value, 5), 50) AS clipped, CASE event_type WHEN 'view' THEN 'solar' WHEN 'click' THEN 'wind' ELSE event_type END AS fuel, event_type IN ('view', 'click') AS renewable FROM events")
def clip_and_names(spark, sf_dir):
    code = F.when(F.col("event_type") == "view", "SUN").when(F.col("event_type") == "click", "WND").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", S.clip("value", 5, 50).alias("clipped"), S.fuel_name(code).alias("fuel"), S.is_renewable(S.fuel_name(code)).alias("renewable"))
