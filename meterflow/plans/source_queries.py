"""Queries that write what a source or a store holds, from the whole ``events`` table, and read it back.

Every one writes below the shared folder, as tasks, so that its SQL twin speaks about ``events`` alone.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import scalar as S
from ..operators import clean, quality, reshape, sequences
from ..sources import csv_zip, files, footers, keyed, layout, raw_json, rest, store
from ..operators import windows as W
from ..streaming import cleaner
from ..streaming import features as stream
from . import config
from .panels import DAILY, HOURLY, hourly, regional, table
from .registry import query
from .series_queries import rolled

r6 = lambda c: F.round(c, 6)


def load():
    return F.col("event_type").isin("view", "signup")



# raw envelopes -------------------------------------------------------------------------------------
def envelopes(spark, sf_dir) -> DataFrame:
    """Events as answers of at most 500 records: loads as demand, the rest as generation by fuel; some values and times are spoilt."""
    period = F.when(F.col("event_id") % 19 == 0, "no time").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH"))
    value = F.when(F.col("event_id") % 17 == 0, F.concat(F.col("value").cast("string"), F.lit("d"))).otherwise(F.col("value").cast("string"))
    record = F.struct(
        period.alias("period"), F.concat(F.lit("U"), F.col("user_id") % 7).alias("respondent"), F.lit(None).cast("string").alias("respondent-name"), F.when(load(), "D").alias("type"),
        F.col("event_type").alias("type-name"), F.when(~load(), F.col("event_type")).alias("fueltype"), value.alias("value"), F.lit("MWh").alias("value-units"),
    )
    page = F.floor(F.col("event_id") / 500)
    rows = table(spark, sf_dir, "events").groupBy(F.when(load(), "demand").otherwise("generation").alias("kind"), page.alias("page"))
    held = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", record.alias("r")))), lambda x: x["r"]).alias("data"))
    about = F.struct(
        F.lpad(F.col("page").cast("string"), 9, "0").alias("timestamp"), F.lit("events").alias("source"), F.lit("ALL").alias("region"), F.col("kind").alias("data_type"),
        F.lit("2024-01-01").alias("start_date"), F.lit("2024-01-31").alias("end_date"), F.lit(0).cast("long").alias("response_size_bytes"), F.lit(0).cast("long").alias("record_count"), F.lit(True).alias("success"),
    )
    return held.select("kind", "page", about.alias("metadata"), F.struct(F.struct(F.size("data").cast("string").alias("total"), F.col("data")).alias("response")).alias("api_response"))


RAW = """raw AS (SELECT event_id, event_id // 500 AS page, CASE WHEN event_type IN ('view', 'signup') THEN 'demand' ELSE 'generation' END AS kind,
CASE WHEN event_id % 19 <> 0 THEN date_trunc('hour', ts) END AS timestamp, 'U' || (user_id % 7) AS region, CASE WHEN event_type NOT IN ('view', 'signup') THEN event_type END AS fuel_type, event_type AS type_name,
CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events)"""


KEPT = f"""WITH {RAW}, k AS (SELECT *, row_number() OVER (PARTITION BY timestamp, region, fuel_type ORDER BY event_id) AS rn FROM raw WHERE timestamp IS NOT NULL AND value IS NOT NULL AND region IS NOT NULL)
SELECT timestamp, region, kind AS data_type, fuel_type, type_name, round(value, 6) AS value, 'MWh' AS value_units, 'raw_' || kind || '_ALL_2024-01-01_to_2024-01-31_' || lpad(page::VARCHAR, 9, '0') || '.json' AS source_file FROM k WHERE rn = 1"""


@query(KEPT)
def raw_transform(spark, sf_dir):
    """The main path: named envelope files, scanned, flattened, typed, rejected, deduplicated over all files."""
    path = shared.fresh_path(spark, "raw")
    raw_json.write_envelopes(envelopes(spark, sf_dir), path)
    out = clean.clean(raw_json.read_envelopes(spark, path))
    return out.withColumn("value", r6("value"))


@query(KEPT)
def keyed_transform(spark, sf_dir):
    """The transform over three arrivals of files, out of order: each meets only what the store may hold of its keys."""
    path = shared.fresh_path(spark, "raw")
    raw_json.write_envelopes(envelopes(spark, sf_dir), f"{path}/files")
    rows = clean.reject_incomplete(clean.flatten(raw_json.read_envelopes(spark, f"{path}/files")))
    unique = keyed.KeyedStore(spark, f"{path}/store", rows.schema, ["timestamp", "region", "fuel_type"], ["source_file", "_pos"], parts=4, chunk_hours=24 * 7)
    page = F.regexp_extract("source_file", r"_(\d+)\.json$", 1).cast("int")
    for k in (1, 2, 0):
        unique.append(rows.where(page % 3 == k))
    return unique.read().drop("_pos").withColumn("value", r6("value"))


@query(f"""WITH {RAW}, u AS (SELECT count(DISTINCT (timestamp, region, fuel_type)) AS n FROM raw WHERE timestamp IS NOT NULL AND value IS NOT NULL) SELECT count(*) AS initial_records, any_value(u.n) AS final_records,
count(*) FILTER (WHERE timestamp IS NULL) AS null_timestamp, count(*) FILTER (WHERE value IS NULL) AS null_value, 0::BIGINT AS null_region, 0::BIGINT AS mislabelled, count(*) - any_value(u.n) AS dropped_records,
round((count(*) - any_value(u.n)) * 100.0::DOUBLE / count(*), 6) AS drop_pct, round(any_value(u.n)::DOUBLE / count(*), 6) AS quality_score FROM raw, u""")
def raw_report(spark, sf_dir):
    """Counts of the transform, before and after."""
    path = shared.fresh_path(spark, "raw")
    raw_json.write_envelopes(envelopes(spark, sf_dir), path)
    out = clean.report(clean.flatten(raw_json.read_envelopes(spark, path)))
    return out.withColumns({c: r6(c) for c in ("drop_pct", "quality_score")})


@query(f"WITH {RAW}, f AS (SELECT kind, page, count(*) AS n FROM raw GROUP BY 1, 2) SELECT kind AS data_type, count(*) AS files, sum(n)::BIGINT AS records, true AS sized FROM f GROUP BY 1")
def raw_listing(spark, sf_dir):
    """Files of each data type by name, with the record counts and sizes that writing filled in."""
    path = shared.fresh_path(spark, "raw")
    raw_json.write_envelopes(envelopes(spark, sf_dir), path)
    parts = []
    for kind in ("demand", "generation"):
        df = raw_json.read_envelopes(spark, path, f"raw_{kind}_*.json", kind)
        sized = F.min(F.col("metadata.response_size_bytes")) > 0
        parts.append(df.agg(F.lit(kind).alias("data_type"), F.countDistinct("source_file").alias("files"), F.sum("metadata.record_count").alias("records"), sized.alias("sized")))
    return reshape.union_sources(*parts)


@query(f"""WITH {RAW}, f AS (SELECT DISTINCT kind, page FROM raw) SELECT CASE page % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'empty' WHEN 3 THEN 'invalid' ELSE 'data' END AS answer, count(*) AS files FROM f GROUP BY 1""")
def raw_answers(spark, sf_dir):
    """Error answers, broken files, answers without records or without a response, and good ones."""
    path = shared.fresh_path(spark, "raw")
    rows, p = envelopes(spark, sf_dir), F.col("page") % 5
    whole = F.to_json(F.struct("metadata", "api_response"))
    none = lambda text: F.to_json(F.struct("metadata", F.from_json(F.lit(text), "response struct<data: array<string>>, error string").alias("api_response")))
    body = F.when(p == 0, none('{"error": "no"}')).when(p == 1, F.substring(whole, 1, 40)).when(p == 2, none('{"response": {"data": []}}')).when(p == 3, none("{}")).otherwise(whole)
    files.write_named(rows.select(F.concat_ws("/", "kind", F.concat(F.col("page").cast("string"), F.lit(".json"))).alias("name"), body.alias("body")), path)
    return clean.response_kind(raw_json.read_envelopes(spark, path)).groupBy(F.col("kind").alias("answer")).agg(F.count("*").alias("files"))


@query("""WITH l AS (SELECT event_type || '/' || (event_id // 500) || '.txt' AS name, event_id, event_id || ';' || user_id AS line FROM events)
SELECT name, (sum(length(line) + 1) - 1)::BIGINT AS bytes, count(*) AS lines, min(event_id) AS first, max(event_id) AS last, md5(string_agg(line, chr(10) ORDER BY event_id)) AS body_md5 FROM l GROUP BY 1""")
def named_files(spark, sf_dir):
    """Named files by a committed job, after one that fails half-way and must leave nothing: names, sizes and bodies as a reader finds them."""
    path, page = shared.fresh_path(spark, "named"), F.floor(F.col("event_id") / 500)
    line = F.concat_ws(";", F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").groupBy(F.concat(F.col("event_type"), F.lit("/"), page.cast("string"), F.lit(".txt")).alias("name"))
    bodies = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    spoilt = bodies.withColumn("body", F.when(F.col("name").startswith("view/"), F.raise_error(F.lit("spoilt"))).otherwise(F.col("body")))
    try:
        files.write_named(spoilt, path)
    except Exception as e:  # noqa: BLE001  Spark's own kind of error
        if "spoilt" not in str(e):
            raise
    else:
        raise AssertionError("the spoilt job has ended well")
    files.write_named(bodies, path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.col("content").cast("string")
    ids = F.transform(F.split(text, "\n"), lambda x: F.split_part(x, F.lit(";"), F.lit(1)).cast("long"))
    return found.select(
        F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.size(ids).cast("long").alias("lines"),
        F.array_min(ids).alias("first"), F.array_max(ids).alias("last"), F.md5("content").alias("body_md5"),
    )


# paged source --------------------------------------------------------------------------------------
PAGED = ("view", "signup", "click", "error", "purchase")
PAGE = 200
RECORDS = "SELECT CASE WHEN event_type IN ('view', 'signup') THEN 'demand' ELSE 'generation' END AS data_type, event_type AS respondent, strftime(ts, '%Y-%m-%dT%H') AS period, round(value, 6) AS value FROM events"


def placed(spark, sf_dir) -> DataFrame:
    """Events with the request they answer to (a region and part of the ids) and their place in it."""
    events = table(spark, sf_dir, "events")
    ends = [-1.0] + [float(x) for x in events.agg(F.percentile_approx("event_id", [0.25, 0.5, 0.75]).alias("q")).first()["q"]] + [float("inf")]
    part = F.lit(3)
    for i in (2, 1, 0):
        part = F.when(F.col("event_id") <= ends[i + 1], i).otherwise(part)
    return reshape.places(events.withColumn("part", part), ["event_type", "part"], "event_id")


def record_pages(rows: DataFrame, path: str, *refused: tuple[int, int]) -> None:
    """Write the pages of placed records; ``refused`` (n, status): every n-th page has that status at the first try."""
    record = F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH").alias("period"), F.col("event_type").alias("respondent"), F.col("value").alias("value"))
    numbered = rows.withColumn("page", F.floor(F.col("place") / PAGE))
    pages = numbered.groupBy("event_type", "part", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", record.alias("r")))), lambda x: x["r"]).alias("data"))
    answer = F.to_json(F.struct(F.struct("data").alias("response")))
    before = F.lit("")
    for n, status in reversed(refused):
        before = F.when(F.col("page") % n == 0, F.lit(f'{{"status": {status}}}\n')).otherwise(before)
    endpoint = F.when(load(), rest.ENDPOINTS["demand"].split("/")[-2]).otherwise(rest.ENDPOINTS["generation"].split("/")[-2])
    name = F.concat(F.concat_ws("_", endpoint, "event_type", F.col("part").cast("string"), (F.col("page") * PAGE).cast("string")), F.lit(".json"))
    files.write_named(pages.select(name.alias("name"), F.concat(before, answer).alias("body")), path)


def paged_options(path: str, **more: str) -> dict[str, str]:
    requests = [{"data_type": "demand" if t in ("view", "signup") else "generation", "regions": [t], "start": str(i), "end": "x"} for t in PAGED for i in range(4)]
    return {"requests": json.dumps(requests), "transport": f"replay:{path}", "page": str(PAGE)} | more


def records(got: DataFrame) -> DataFrame:
    return got.select("data_type", "respondent", "period", r6(S.number("value")).alias("value"))


@query(RECORDS)
def paged_source(spark, sf_dir):
    """Recorded pages of both data types; every third page is refused at the first try and every fifth limited."""
    path = shared.fresh_path(spark, "pages")
    record_pages(placed(spark, sf_dir), path, (3, 503), (5, 429))
    spark.dataSource.register(rest.PagedSource)
    return records(spark.read.format("paged").options(**paged_options(path)).load())


@query(RECORDS)
def spaced_source(spark, sf_dir):
    """The same by the second source's rhythm: calls are spaced, every second page is limited at first; the waiting is left out."""
    path = shared.fresh_path(spark, "pages")
    record_pages(placed(spark, sf_dir), path, (2, 429))
    spark.dataSource.register(rest.PagedSource)
    return records(spark.read.format("paged").options(**paged_options(path, policy="spaced", wait="none")).load())


@query(RECORDS)
def paged_stream(spark, sf_dir):
    """Pages that grow between two runs of a stream: the second run reads on, every record comes once."""
    path = shared.fresh_path(spark, "pages")
    rows = shared.save(placed(spark, sf_dir), "placed")
    half = (rows.agg(F.max("place")).first()[0] or 0) // 2
    spark.dataSource.register(rest.PagedSource)
    for now in (rows.where(F.col("place") <= half), rows):
        record_pages(now, f"{path}/pages", (3, 503))
        read = spark.readStream.format("paged").options(**paged_options(f"{path}/pages", pages_per_task="2")).load()
        cleaner.write(read, f"{path}/out", f"{path}/state").awaitTermination()
    return records(spark.read.parquet(f"{path}/out"))


# zipped CSV ----------------------------------------------------------------------------------------
def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for member, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(member, text)
            out.append(held.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["name", "body"])


def reports(spark, sf_dir, header: str, line, where=None) -> str:
    """One zipped CSV per 500 events; in every second file the columns stand in reverse order. Returns the folder."""
    path, page = shared.fresh_path(spark, "reports"), F.floor(F.col("event_id") / 500)
    rows = table(spark, sf_dir, "events") if where is None else table(spark, sf_dir, "events").where(where)
    columns = header.split(",")
    forward, back = F.concat_ws(",", *line), F.concat_ws(",", *line[::-1])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.when(page % 2 == 0, forward).otherwise(back).alias("t")))), lambda x: x["t"]), "\n")
    bodies = rows.groupBy(page.alias("page")).agg(text.alias("text"))
    head = F.when(F.col("page") % 2 == 0, header).otherwise(",".join(reversed(columns)))
    named = bodies.select(F.concat(F.col("page").cast("string"), F.lit(".zip")).alias("name"), F.lit("report.csv").alias("member"), F.concat(head, F.lit("\n"), "text").alias("text"))
    files.write_named(named.mapInArrow(_zipped, "name string, body binary"), path)
    return path


def cells(*more) -> list:
    """Day, hour ending 1 to 24, what the report names beside them, and the value."""
    return [F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"), (F.hour("ts") + 1).cast("string"), *more, (F.col("value") - 5).cast("string")]


LINES = "OPR_DT string, OPR_HR string, {}MW string"


@query("SELECT date_trunc('hour', ts) AS datetime, 'CAISO' AS region, round(value - 5, 6) AS demand_mwh FROM events WHERE value - 5 >= 0")
def zipped_demand(spark, sf_dir):
    """The load report; negative values are left out."""
    path = reports(spark, sf_dir, "OPR_DT,OPR_HR,MW", cells())
    return csv_zip.demand(csv_zip.parse(csv_zip.read_zipped_csv(spark, path), LINES.format(""))).withColumn("demand_mwh", r6("demand_mwh"))


@query("SELECT date_trunc('day', ts) + to_hours(((hour(ts) + 1) % 24)::BIGINT) AS datetime, 'CAISO' AS region, round(value - 5, 6) AS demand_mwh FROM events WHERE value - 5 >= 0")
def zipped_demand_same_day(spark, sf_dir):
    """The other reading of hours: h is h o'clock, 24 is 0 o'clock of the same day."""
    path = reports(spark, sf_dir, "OPR_DT,OPR_HR,MW", cells())
    return csv_zip.demand(csv_zip.parse(csv_zip.read_zipped_csv(spark, path), LINES.format("")), same_day_24=True).withColumn("demand_mwh", r6("demand_mwh"))


@query("SELECT date_trunc('hour', ts) AS timestamp, event_type AS fuel_type, round(value - 5, 6) AS generation_mw, 'CAISO' AS region FROM events WHERE value - 5 >= 0")
def zipped_generation(spark, sf_dir):
    path = reports(spark, sf_dir, "OPR_DT,OPR_HR,FUEL_TYPE,MW", cells(F.upper("event_type")))
    out = csv_zip.generation(csv_zip.parse(csv_zip.read_zipped_csv(spark, path), LINES.format("FUEL_TYPE string, ")))
    return out.withColumn("generation_mw", r6("generation_mw"))


def named(names: dict[str, str], rest: str):
    """The event types under other names."""
    out = F.lit(rest)
    for event, name in names.items():
        out = F.when(F.col("event_type") == event, name).otherwise(out)
    return out


GREEN = {"wind": "click", "solar": "view", "geothermal": None, "biomass": None, "biogas": None, "small_hydro": "error"}


@query("SELECT date_trunc('hour', ts) AS timestamp, " + ", ".join(f"round(coalesce(min(value - 5) FILTER (WHERE event_type = '{t}'), 0), 6) AS {k}_mw" if t else f"0::DOUBLE AS {k}_mw" for k, t in GREEN.items()) + ", 'CAISO' AS region FROM events GROUP BY 1")
def zipped_renewables(spark, sf_dir):
    path = reports(spark, sf_dir, "OPR_DT,OPR_HR,RENEWABLE_TYPE,MW", cells(named({"view": "Solar", "click": "Wind", "error": "Small Hydro"}, "Tidal")))
    out = csv_zip.renewables(csv_zip.parse(csv_zip.read_zipped_csv(spark, path), LINES.format("RENEWABLE_TYPE string, ")))
    return out.select("timestamp", *[r6(f"{k}_mw").alias(f"{k}_mw") for k in GREEN], "region")


PRICES = """p AS (SELECT date_trunc('hour', ts) AS timestamp, 'N' || (user_id % 3) AS location, min(value - 5) FILTER (WHERE event_type = 'view') AS lmp_price, min(value - 5) FILTER (WHERE event_type = 'click') AS energy_price,
min(value - 5) FILTER (WHERE event_type = 'error') AS congestion_price, min(value - 5) FILTER (WHERE event_type NOT IN ('view', 'click', 'error')) AS loss_price FROM events GROUP BY 1, 2)"""


@query(f"WITH {PRICES} SELECT timestamp, location, round(lmp_price, 6) AS lmp_price, round(energy_price, 6) AS energy_price, round(congestion_price, 6) AS congestion_price, round(loss_price, 6) AS loss_price FROM p WHERE lmp_price IS NOT NULL")
def zipped_prices(spark, sf_dir):
    path = reports(spark, sf_dir, "OPR_DT,OPR_HR,NODE,LMP_TYPE,MW", cells(F.concat(F.lit("N"), F.col("user_id") % 3), named({"view": "LMP", "click": "MCE", "error": "MCC"}, "MCL")))
    out = csv_zip.prices(csv_zip.parse(csv_zip.read_zipped_csv(spark, path), LINES.format("NODE string, LMP_TYPE string, ")))
    return out.select("timestamp", "location", *[r6(c).alias(c) for c in out.columns if c.endswith("_price")])


@query("SELECT CASE WHEN event_id // 500 % 2 = 0 THEN '1000' ELSE '' END AS code, count(DISTINCT event_id // 500) AS files, count(*) FILTER (WHERE event_id // 500 % 2 = 1) AS n_lines, count(*) FILTER (WHERE event_id // 500 % 2 = 1 AND event_id % 10 = 0) AS n_bad FROM events GROUP BY 1")
def zipped_errors(spark, sf_dir):
    """Every second answer is an XML error; of the others every tenth line has a field too many."""
    path, page = shared.fresh_path(spark, "reports"), F.floor(F.col("event_id") / 500)
    line = F.concat_ws(",", *cells(), F.when(F.col("event_id") % 10 == 0, "more"))
    bodies = table(spark, sf_dir, "events").groupBy(page.alias("page")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    xml, broken = "<m:E><m:ERR_CODE>1000</m:ERR_CODE><m:ERR_DESC>No data</m:ERR_DESC></m:E>", F.col("page") % 2 == 0
    named = bodies.select(
        F.concat(F.col("page").cast("string"), F.lit(".zip")).alias("name"), F.when(broken, "x.xml").otherwise("x.csv").alias("member"),
        F.when(broken, xml).otherwise(F.concat(F.lit("OPR_DT,OPR_HR,MW\n"), "text")).alias("text"),
    )
    files.write_named(named.mapInArrow(_zipped, "name string, body binary"), path)
    lines = csv_zip.read_zipped_csv(spark, path)
    bad = lines.where("error is not null").select(csv_zip.error_message()["code"].alias("code")).groupBy("code").agg(F.count("*").alias("files"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_bad"))
    good = csv_zip.bad_lines(lines).agg(F.lit("").alias("code"), F.count("*").alias("files"), F.sum("n_lines").alias("n_lines"), F.sum("n_bad").alias("n_bad"))
    return bad.union(good)


@query("""WITH d AS (SELECT date_trunc('hour', ts) AS timestamp, sum(value) AS demand_mwh FROM events GROUP BY 1), r AS (SELECT date_trunc('hour', ts) AS timestamp, min(value) AS wind_mw FROM events WHERE event_type = 'click' GROUP BY 1),
p AS (SELECT date_trunc('hour', ts) AS timestamp, min(value) AS lmp_price FROM events WHERE event_type = 'view' AND user_id % 2 = 0 GROUP BY 1),
j AS (SELECT d.timestamp, demand_mwh, wind_mw, lmp_price FROM d LEFT JOIN r ON r.timestamp = d.timestamp LEFT JOIN p ON p.timestamp = d.timestamp)
SELECT timestamp, 'CAISO' AS region, """ + ", ".join(f"round(coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS {c}" for c in ("demand_mwh", "wind_mw", "lmp_price")) + " FROM j")
def comprehensive(spark, sf_dir):
    """Demand with renewables and prices of the hour, forward filled."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", "value", S.hour_bucket("ts").alias("timestamp"))
    load = rows.groupBy(F.col("timestamp").alias("datetime")).agg(F.sum("value").alias("demand_mwh")).withColumn("region", F.lit("CAISO"))
    wind = rows.where("event_type = 'click'").groupBy("timestamp").agg(F.min("value").alias("wind_mw")).withColumn("region", F.lit("CAISO"))
    price = rows.where("event_type = 'view' and user_id % 2 = 0").groupBy("timestamp").agg(F.min("value").alias("lmp_price")).withColumn("location", F.lit("N"))
    out = csv_zip.together(load, wind, price)
    return out.select("timestamp", "region", *[r6(c).alias(c) for c in ("demand_mwh", "wind_mw", "lmp_price")])


# store ---------------------------------------------------------------------------------------------
def saved(spark, sf_dir) -> store.Store:
    """A store with the events of each region in its raw layer, one harmonized dataset, all partitioned."""
    s = store.Store(spark, shared.fresh_path(spark, "store"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("region"), F.col("ts").alias("timestamp"), F.col("value"), F.when(load(), "demand").otherwise("generation").alias("data_type"))
    s.save(rows, "raw", "events", partition_by=["region"], ts="timestamp", source="events", data_type="all")
    s.save(reshape.harmonize(rows, "events", "demand", "timestamp", "value", "MWh"), "harmonized", "events", compression="zstd", ts="timestamp", source="events")
    return s


@query("SELECT event_id, event_type AS region, round(value, 6) AS value FROM events")
def store_columns(spark, sf_dir):
    """Saved once (a second save is refused), three columns read back."""
    s = saved(spark, sf_dir)
    try:
        s.save(spark.range(1), "raw", "events")
    except Exception as e:  # noqa: BLE001  Spark's own kind of error
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    else:
        raise AssertionError("an existing dataset was overwritten")
    return s.load("raw", "events", ["event_id", "region", "value"]).withColumn("value", r6("value"))


@query("SELECT event_id, round(value, 6) AS value FROM events WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'")
def store_range(spark, sf_dir):
    """One region and range, as partition and row-group filters."""
    out = saved(spark, sf_dir).load_range("raw", "events", "view", "timestamp", "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    return out.select("event_id", r6("value").alias("value"))


@query("SELECT layer, 'events' AS name, count(*) AS row_count, min(ts) AS start_date, max(ts) AS end_date FROM events, (VALUES ('raw'), ('harmonized')) l(layer) GROUP BY 1")
def store_catalog(spark, sf_dir):
    return saved(spark, sf_dir).datasets().select("layer", "name", "row_count", "start_date", "end_date")


@query("SELECT true AS there, count(DISTINCT event_type) AS folders, true AS sized, false AS after_delete FROM events")
def store_files(spark, sf_dir):
    """Listing, existence and deletion."""
    s = saved(spark, sf_dir)
    there, found = s.exists(s.path("raw", "events")), s.files("raw", "events")
    folders = spark.read.parquet(s.path("raw", "events")).select("region").distinct().count()
    s.delete("raw", "events")
    return spark.createDataFrame([(there, folders, bool(found) and all(f["bytes"] > 0 for f in found), s.exists(s.path("raw", "events")))], "there boolean, folders long, sized boolean, after_delete boolean")


@query("SELECT count(*) AS rows, min(ts) AS first, max(ts) AS last, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS regions, string_agg(DISTINCT CASE WHEN event_type IN ('view', 'signup') THEN 'demand' ELSE 'generation' END, ',' ORDER BY CASE WHEN event_type IN ('view', 'signup') THEN 'demand' ELSE 'generation' END) AS data_types, 5::BIGINT AS columns FROM events")
def store_profile(spark, sf_dir):
    """Rows, range, regions and data types from footers and folder names."""
    got = saved(spark, sf_dir).info("raw", "events")
    row = (got["rows"], got["first"], got["last"], ",".join(sorted(got["region"])), ",".join(sorted(got["data_type"])), len(got["columns"]))
    return spark.createDataFrame([row], "rows long, first timestamp_ntz, last timestamp_ntz, regions string, data_types string, columns long")


@query("SELECT count(*) AS rows, min(ts) AS first, max(ts) AS last, true AS in_order, 0::BIGINT AS rows_of_nothing FROM events")
def store_consolidated(spark, sf_dir):
    """One dataset in order of region and time with its statistics; nothing leaves a schema."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("region"), F.col("ts").alias("timestamp"), "value")
    path = shared.fresh_path(spark, "consolidated")
    told, none = store.consolidate(rows, path, 4), store.consolidate(rows.limit(0), f"{path}-none")
    # every file is in order if no row lies before the one above it
    placed = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    lower = placed.groupBy("f", F.floor(F.col("i") / 1000).alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "region", "timestamp"))).alias("x"))
    keys = F.transform("x", lambda r: F.struct(r["region"], r["timestamp"]))
    ordered = lower.select((keys == F.array_sort(keys)).alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok")).first()["ok"]
    row = (told["rows"], told["first"], told["last"], ordered and spark.read.parquet(f"{path}-none").columns == rows.columns, none["rows"])
    return spark.createDataFrame([row], "rows long, first timestamp_ntz, last timestamp_ntz, in_order boolean, rows_of_nothing long")


@query("""SELECT 'region' AS probe, count(*) AS n, round(sum(value), 4) AS total, true AS skips FROM events WHERE user_id % 50 = 7
UNION ALL SELECT 'day', count(*), round(sum(value), 4), true FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 23:59:59'
UNION ALL SELECT 'both', count(*), round(sum(value), 4), true FROM events WHERE user_id % 50 = 7 AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 23:59:59'""")
def store_interleaved(spark, sf_dir):
    """Consolidated by region and time at once: a filter on either one skips more than half of the row groups by their footers."""
    rows = table(spark, sf_dir, "events").select(F.format_string("R%02d", F.col("user_id") % 50).alias("region"), F.col("ts").alias("timestamp"), "value")
    path, day = shared.fresh_path(spark, "interleaved"), ("2024-01-10 00:00:00", "2024-01-10 23:59:59")
    told = store.consolidate(rows, path, 4, interleave=True, group_rows=max(1, rows.count() // 64), bits=6)
    asks = {"region": [("region", "string", "R07", "R07")], "day": [("timestamp", "timestamp_ntz", *day)]}
    asks["both"], found, saved_rows, out = asks["region"] + asks["day"], footers.footers(spark, path), spark.read.parquet(path), None
    for probe, bounds in asks.items():
        met, skips = saved_rows, F.lit(told["rows"] > 0)
        for column, kind, lo, hi in bounds:
            met = met.where(F.col(column).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)))
            skips = skips & layout.groups_read(found, column, kind, lo, hi).select(F.col("read") * 2 < F.col("groups")).scalar()
        one = met.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.lit(probe).alias("probe"), "n", "total", skips.alias("skips"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT date_trunc('hour', ts) AS ts, round(sum(value), 6) AS total FROM events GROUP BY 1")
def store_cached(spark, sf_dir):
    """Built and saved at the first call, loaded at the second, whose builder is never run."""
    s = store.Store(spark, shared.fresh_path(spark, "store"))
    build = lambda: table(spark, sf_dir, "events").groupBy(S.hour_bucket("ts").alias("ts")).agg(F.sum("value").alias("total"))
    store.load_or_build(s, "features", "hours", build)

    def never():
        raise AssertionError("the saved dataset was not used")

    return store.load_or_build(s, "features", "hours", never).withColumn("total", r6("total"))


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def store_configured(spark, sf_dir):
    """Codec and partitioning from the settings of a pipeline."""
    settings = config.PipelineConfig.from_dict({"storage": {"compression": "zstd", "partition_by": ["year"]}}).storage
    s = store.Store(spark, shared.fresh_path(spark, "store"))
    rows = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice", F.year("o_orderdate").alias("year"))
    s.save(rows, "raw", "orders", partition_by=settings.partition_by, compression=settings.compression)
    if not all(".zstd." in f["name"] for f in s.files("raw", "orders")):
        raise AssertionError("another codec was used")
    return s.load("raw", "orders").groupBy(F.col("year").cast("int").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH {DAILY} SELECT a.timestamp, a.region AS from_region, b.region AS to_region, round(b.daily_avg - a.daily_avg, 6) AS avg_differential, round(b.daily_max - a.daily_max, 6) AS max_differential,
round(b.daily_avg / nullif(a.daily_avg, 0), 6) AS avg_ratio FROM daily a JOIN daily b ON a.timestamp = b.timestamp AND a.region <> b.region""")
def migration_features(spark, sf_dir):
    """Daily features, differences between regions, saved and read back, in one chain."""
    out = reshape.migration_features(store.Store(spark, shared.fresh_path(spark, "store")), regional(spark, sf_dir), "migration")
    return out.select("timestamp", "from_region", "to_region", *[r6(c).alias(c) for c in ("avg_differential", "max_differential", "avg_ratio")])


@query("SELECT 'missing' AS source, 0::BIGINT AS n UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders")
def collected_sources(spark, sf_dir):
    """Every source that can be read; the others are named."""
    builders = {"events": lambda: table(spark, sf_dir, "events"), "orders": lambda: table(spark, sf_dir, "orders"), "missing": lambda: table(spark, sf_dir, "no_such_table")}
    frames, errors = reshape.collect_sources(builders)
    failed = spark.createDataFrame([(name, 0) for name in errors], "source string, n long")
    return reshape.union_sources(failed, *[df.agg(F.lit(name).alias("source"), F.count("*").alias("n")) for name, df in frames.items()])


@query("""SELECT event_type AS region, count(*) AS rows, min(ts) AS first, max(ts) AS last, min(event_id) AS low, max(event_id) AS high, true AS broken_named FROM events GROUP BY 1""")
def store_footers(spark, sf_dir):
    """Rows and ranges by folder, from footers alone; files whose footers are torn are named and stand beside."""
    s = saved(spark, sf_dir)
    torn = table(spark, sf_dir, "events").select(F.concat(F.lit("region=torn/part-"), F.floor(F.col("event_id") / 500).cast("string"), F.lit(".parquet")).alias("name")).distinct()
    n, _ = files.write_named(torn.select("name", F.unhex(F.lit("5041523100000000000000000400000050415231")).alias("body")), s.path("raw", "events"))
    found = s.footers("raw", "events")
    at, ids = (footers.bounds(c, kind) for c, kind in (("timestamp", "timestamp_ntz"), ("event_id", "bigint")))
    region = F.regexp_extract("path", "/region=([^/]+)/", 1)
    named = s.unreadable("raw", "events").where(region == "torn").count() == n
    ranges = found.where("error is null").groupBy(region.alias("region"))
    return ranges.agg(F.sum("rows").alias("rows"), at[0].alias("first"), at[1].alias("last"), ids[0].alias("low"), ids[1].alias("high"), F.lit(named).alias("broken_named"))


# parsing, validity, settings, streams --------------------------------------------------------------
FORMS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "MM/dd/yyyy HH:mm")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('minute', ts) END AS any_form,
CASE WHEN event_id % 6 = 1 THEN date_trunc('second', ts) END AS one_form FROM events""")
def any_timestamps(spark, sf_dir):
    """Five written forms of a time and one that is none."""
    text, at = F.lit("soon"), F.col("ts").cast("timestamp")
    for i, form in enumerate(FORMS):
        text = F.when(F.col("event_id") % 6 == i, F.date_format(at, form)).otherwise(text)
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    return rows.select("event_id", S.any_timestamp("t").alias("any_form"), S.any_timestamp("t", FORMS[1:2]).alias("one_form"))


@query("SELECT event_id, value FROM events WHERE value BETWEEN 1 AND 50 AND value IS NOT NULL")
def range_validity(spark, sf_dir):
    """Rows out of range go; the batch of what is left passes the check that would fail the job."""
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    inside = rows.where(F.col("value").between(1, 50))
    return quality.reject_batch(inside, ~F.col("value").between(1, 50), "out of range")


@query("SELECT d::DATE AS from_date, least(d + INTERVAL 45 DAY, DATE '2025-01-01')::DATE AS to_date, data_type, regions, split FROM generate_series(DATE '2019-01-01', DATE '2024-12-31', INTERVAL 45 DAY) t(d), (VALUES ('demand'), ('generation')) k(data_type), (VALUES ('PACW'), ('ERCO'), ('NE'), ('CAL')) r(regions), LATERAL (SELECT CASE WHEN d <= DATE '2022-12-31' THEN 'train' WHEN d <= DATE '2023-12-31' THEN 'validation' ELSE 'test' END AS split)")
def configured_plan(spark, sf_dir):
    """The requests of a valid configuration, each with the split that its first day lies in."""
    c = config.PipelineConfig.from_dict(config.PipelineConfig().to_dict())
    if problems := c.validate() + config.production().validate() + config.development().validate() + config.research().validate():
        raise AssertionError(problems)
    plan = raw_json.request_plan(spark, c.data_types, c.regions, c.split.train[0], c.split.test[1], c.batch_days)
    bounds = {"train": c.split.train, "validation": c.split.validation, "test": c.split.test}
    out = sequences.split(plan.withColumn("at", F.col("from_date").cast("timestamp_ntz")), "at", bounds, c.split.min_days, c.split.max_overlap_days)
    return out.select("from_date", "to_date", "data_type", F.array_join("regions", ",").alias("regions"), "split")


@query("""WITH r AS (SELECT date_trunc('hour', ts) AS h, event_type AS region, value FROM events WHERE event_id % 17 <> 0), d AS (SELECT h, region, min(value) AS value FROM r GROUP BY 1, 2), m AS (SELECT max(h) AS top FROM r)
SELECT h AS timestamp, region, 1::BIGINT AS n FROM d, m WHERE h + INTERVAL 1 HOUR <= top - INTERVAL 1 DAY""")
def stream_hours(spark, sf_dir):
    """The cleaner as a stream over what is there now: one row per region and hour once the watermark has passed it."""
    path = shared.fresh_path(spark, "stream")
    spoilt = F.when(F.col("event_id") % 17 == 0, "x").otherwise(F.col("value").cast("string"))
    rows = table(spark, sf_dir, "events").select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH").alias("period"), F.col("event_type").alias("region"), F.lit(None).cast("string").alias("fuel_type"), spoilt.alias("value"))
    rows.write.parquet(f"{path}/in")
    stream = cleaner.hourly(cleaner.clean(cleaner.read_files(spark, f"{path}/in", rows.schema, files_per_trigger=1_000_000)))
    cleaner.write(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("timestamp", "region", "n")


ROLLED = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@query(f"WITH {HOURLY}, x AS (SELECT region, ts, CASE WHEN epoch(ts)::BIGINT // 3600 % 400 >= 3 THEN v END AS v FROM hourly), f AS (SELECT region, ts, round(v, 6) AS v, "
    "round(last_value(v IGNORE NULLS) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS v_filled, "
    + ", ".join(f"round(lag(v, {k}) OVER (PARTITION BY region ORDER BY ts), 6) AS v_lag_{k}h" for k in W.LAGS) + ", "
    + ", ".join(f"round({rolled(fn, n)}, {9 if name == 'mean' else 6}) AS v_rolling_{name}_{n}h" for n in W.ROLLS for name, fn in ROLLED.items())
    + " FROM x) SELECT f.* FROM f, (SELECT max(ts) AS top FROM x) WHERE ts <= top - INTERVAL 1 DAY")
def stream_features(spark, sf_dir):
    """Lags, rolling statistics and fills of hours that arrive in two parts, some up to 16 hours late; the second run carries on from the first one's state."""
    path, hour = shared.fresh_path(spark, "stream"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    rows = shared.save(hourly(spark, sf_dir).select("region", "ts", F.when(hour % 400 >= 3, F.col("v")).alias("v"), (hour + hour % 3 * 8).alias("arrives")), "hours")
    half = rows.agg(F.avg("arrives")).first()[0] or 0.0
    for part in (rows.where(F.col("arrives") <= half), rows.where(F.col("arrives") > half)):
        part.drop("arrives").write.mode("append").parquet(f"{path}/in")
        hours = cleaner.read_files(spark, f"{path}/in", rows.drop("arrives").schema, files_per_trigger=1_000_000)
        cleaner.write(stream.add_features(hours, ["v"], ts="ts"), f"{path}/out", f"{path}/state").awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.select("region", "ts", *[F.round(c, 9 if "_mean_" in c else 6).alias(c) for c in out.columns if c not in ("region", "ts")])
