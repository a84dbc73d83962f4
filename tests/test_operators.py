import datetime as dt
import io
import json
import math
import threading
import tracemalloc
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.functions import scalar as S
from meterflow.operators import attention, clean, features, moments, quality, reshape, sequences
from meterflow.operators import windows as W
from meterflow.plans import config
from meterflow.plans.pipeline import Pipeline, summary, timed, to_json
from meterflow.schemas import UNIFIED
from meterflow.sources import csv_zip, raw_json, rest, store, synthetic
from meterflow.streaming import cleaner


def envelope(data_type, records, region="PACW", success=True):
    return {
        "metadata": {"data_type": data_type, "region": region, "start_date": "2024-01-20", "record_count": len(records), "response_size_bytes": 10, "success": success},
        "api_response": {"response": {"data": records}} if success else {},
    }


def record(period="2024-01-20T00", value="1", fuel=None, respondent="PACW"):
    out = {"period": period, "respondent": respondent, "type-name": "x", "value": value, "value-units": "MWh"}
    return out | ({"fueltype": fuel} if fuel else {"type": "D"})


@pytest.fixture()
def raw(tmp_path):
    def write(**files):
        for name, body in files.items():
            (tmp_path / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))
        return str(tmp_path)

    return write


def test_generation_and_demand_share_a_schema(spark, raw):
    path = raw(g=envelope("generation", [record(f"2024-01-20T0{i}", "5", f) for i, f in enumerate(("BAT", "COL", "NG"))]), d=envelope("demand", [record("2024-01-20T00"), record("2024-01-20T01")]))
    out = clean.clean(raw_json.read_envelopes(spark, path))
    assert out.schema.names == UNIFIED.names and out.count() == 5
    assert out.where("data_type = 'demand' and fuel_type is not null").count() == 0


def test_dirty_rows_are_dropped_and_counted(spark, raw):
    path = raw(x=envelope("demand", [record(), record(period=None), record(value=None)]))
    rows = clean.flatten(raw_json.read_envelopes(spark, path))
    r = clean.report(rows).first()
    assert (r["initial_records"], r["final_records"], r["dropped_records"], r["null_timestamp"], r["null_value"]) == (3, 1, 2, 1, 1)
    assert clean.clean(raw_json.read_envelopes(spark, path)).count() == 1


def test_failed_empty_corrupt_and_mislabelled_files(spark, raw):
    path = raw(f=envelope("demand", [], success=False), c="not json", e=envelope("demand", []), m=envelope("demand", [record(fuel="SUN")]))
    env = raw_json.read_envelopes(spark, path)
    kinds = {r["source_file"]: r["kind"] for r in clean.response_kind(env).collect()}
    assert kinds == {"f.json": "invalid", "c.json": "corrupt", "e.json": "empty", "m.json": "data"}
    assert clean.clean(env).count() == 1
    assert clean.report(clean.flatten(env)).first()["mislabelled"] == 1
    total = raw_json.extraction_summary(env).where("grouping_id = 7").first()
    assert (total["files"], total["failed"]) == (4, 2)


def test_report_of_nothing_scores_one(spark, raw):
    rows = clean.flatten(raw_json.read_envelopes(spark, raw(e=envelope("demand", []))))
    assert clean.report(rows).first()["quality_score"] == 1.0


def test_duplicates_across_files(spark, raw):
    path = raw(a=envelope("demand", [record(value="1")]), b=envelope("demand", [record(value="2")]))
    env = raw_json.read_envelopes(spark, path)
    assert [r["value"] for r in clean.clean(env).collect()] == [1.0]
    assert clean.clean(env, across_files=False).count() == 2


def test_cleaning_is_idempotent(spark, raw):
    once = clean.clean(raw_json.read_envelopes(spark, raw(a=envelope("demand", [record(), record()]))))
    again = clean.keep_first(once, ["timestamp", "region", "fuel_type"], ["source_file"])
    assert once.collect() == again.collect()


def test_pivot_values_and_total(spark):
    rows = spark.createDataFrame([("00", "SUN", 44.0), ("00", "WND", 282.0), ("01", "SUN", 8.0), ("01", "WND", 289.0), ("01", "WND", 1.0)], "t string, fuel string, v double")
    named = rows.withColumn("fuel", S.fuel_name("fuel"))
    total = {r["t"]: r for r in reshape.pivot(named, ["t"], "fuel", "v", ["solar", "wind"], "sum", "_mwh").collect()}
    mean = {r["t"]: r for r in reshape.pivot(named, ["t"], "fuel", "v", ["solar", "wind"], "mean", "_mwh").collect()}
    assert (total["00"]["solar_mwh"], total["01"]["wind_mwh"], mean["01"]["wind_mwh"]) == (44, 290, 145)
    assert sum(r["solar_mwh"] + r["wind_mwh"] for r in total.values()) == 624


def test_second_source_hours(spark):
    rows = spark.createDataFrame([("2024-01-01", "1", "25000"), ("2024-01-01", "24", "26000"), ("2024-01-01", "2", "-5")], "OPR_DT string, OPR_HR string, MW string")
    out = {r["datetime"]: r["demand_mwh"] for r in csv_zip.demand(rows).collect()}
    assert out == {dt.datetime(2024, 1, 1, 0): 25000.0, dt.datetime(2024, 1, 1, 23): 26000.0}
    same = [r["datetime"].hour for r in csv_zip.demand(rows.where("OPR_HR = '24'"), same_day_24=True).collect()]
    assert same == [0]


def test_zipped_csv_and_xml_errors(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("a.csv", "OPR_DT,OPR_HR,MW\n2024-01-01,1,5\n2024-01-01,bad,row,too,long\n")
    with zipfile.ZipFile(tmp_path / "other.zip", "w") as z:  # columns in another order, one quoted, one more
        z.writestr("b.csv", 'MW, OPR_HR ,NOTE,OPR_DT\n7,2,"a, b",2024-01-01\n8,3\n')
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("a.xml", "<m:x><m:ERR_CODE>1000</m:ERR_CODE><m:ERR_DESC>No data</m:ERR_DESC></m:x>")
    lines = csv_zip.read_zipped_csv(spark, str(tmp_path)).cache()
    assert [r["MW"] for r in csv_zip.parse(lines, "OPR_DT string, OPR_HR string, MW string").where("OPR_HR = '1'").collect()] == ["5"]
    named = csv_zip.parse(lines, "OPR_DT string, MW double, NONE string").where("MW > 6").orderBy("MW").collect()
    assert [tuple(r) for r in named] == [("2024-01-01", 7.0, None), (None, 8.0, None)]
    assert sorted((r["n_lines"], r["n_bad"]) for r in csv_zip.bad_lines(lines).collect()) == [(2, 0), (2, 1)]
    error = lines.where("error is not null").select(csv_zip.error_message().alias("e")).first()["e"]
    assert (error["code"], error["description"]) == ("1000", "No data")


def test_records_are_cut_outside_quotes_only(monkeypatch):
    body = 'a,b\r\n1,"x\ny ""z"", \u2028"\n\n2,\x0bq\n"3\r\n",é'.encode()
    want = ["a,b", '1,"x\ny ""z"", \u2028"', "", "2,\x0bq", '"3\r\n",é']
    for size in (1, 2, 3, 7, 1000):  # blocks that end anywhere, inside characters and quotes, too
        monkeypatch.setattr(csv_zip, "BLOCK", size)
        for tail in (b"", b"\n", b"\r\n"):
            assert [t for part in csv_zip.cut(io.BytesIO(body + tail)) for t in part.to_pylist()] == want
    assert [t for part in csv_zip.cut(io.BytesIO(b"ok\n\xff\n")) for t in part.to_pylist()] == ["ok", "\ufffd"]
    assert list(csv_zip.cut(io.BytesIO(b""))) == []
    monkeypatch.setattr(csv_zip, "LONGEST", 20)
    with pytest.raises(csv_zip.BadCsv):
        list(csv_zip.cut(io.BytesIO(b'"' + b"x\n" * 2000)))


def test_quoted_line_ends_and_blank_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("a.csv", '\ufeff\n\nNAME,"MW"\r\n"two\nlines, ""quoted""",1\r\n\r\n  plain ,2\r\n"",3\r\n,4,\r\nlong,5,6\r\n')
    lines = csv_zip.read_zipped_csv(spark, str(tmp_path))
    got = sorted((r["MW"], r["NAME"]) for r in csv_zip.parse(lines, "NAME string, MW int").collect())
    assert got == [(1, 'two\nlines, "quoted"'), (2, "plain"), (3, None)]
    assert [(r["n_lines"], r["n_bad"]) for r in csv_zip.bad_lines(lines).collect()] == [(5, 2)]


def test_a_member_of_100_mb_is_never_held_as_a_whole(spark, tmp_path):
    line = "2024-01-01,{},1.5," + "x" * 70 + "\n"
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("a.csv", "w") as out:
        out.write(b"OPR_DT,OPR_HR,MW,NOTE\n")
        for h in range(1, 25):
            out.write(line.format(h).encode() * 46_000)
    content = (tmp_path / "big.zip").read_bytes()
    tracemalloc.start()
    stream, _ = csv_zip._opened(content)
    n = size = 0
    for part in csv_zip.cut(stream):
        n, size = n + len(part), size + part.nbytes
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 24 * 46_000 + 1 and size > 100e6 and most < 40e6
    lines = csv_zip.read_zipped_csv(spark, str(tmp_path))
    out = csv_zip.parse(lines, "OPR_HR int, MW double").groupBy("OPR_HR").agg(F.sum("MW").alias("mw")).collect()
    assert len(out) == 24 and {r["mw"] for r in out} == {69_000.0}


def test_second_source_reports(spark):
    schema = "OPR_DT string, OPR_HR string, {} string, MW string"
    green = spark.createDataFrame([("2024-01-01", "1", "Solar", "5"), ("2024-01-01", "1", "Wind", "x"), ("2024-01-01", "2", "Wind", "7")], schema.format("RENEWABLE_TYPE"))
    out = {r["timestamp"].hour: (r["solar_mw"], r["wind_mw"], r["geothermal_mw"]) for r in csv_zip.renewables(green).collect()}
    assert out == {0: (5.0, 0.0, 0.0), 1: (0.0, 7.0, 0.0)}
    lmp = [("2024-01-01", "1", "N", "LMP", "30"), ("2024-01-01", "1", "N", "MCC", "1"), ("2024-01-01", "2", "N", "MCC", "1")]
    price = csv_zip.prices(spark.createDataFrame(lmp, "OPR_DT string, OPR_HR string, NODE string, LMP_TYPE string, MW string"))
    assert [(r["lmp_price"], r["congestion_price"]) for r in price.collect()] == [(30.0, 1.0)]
    load = csv_zip.demand(spark.createDataFrame([("2024-01-01", str(h), "100") for h in (1, 2, 3)], "OPR_DT string, OPR_HR string, MW string"))
    rows = csv_zip.together(load, csv_zip.renewables(green), price).orderBy("timestamp").collect()
    assert [r["lmp_price"] for r in rows] == [30.0] * 3 and [r["wind_mw"] for r in rows] == [0.0, 7.0, 7.0]


def test_missing_sources_are_named(spark):
    frames, errors = reshape.collect_sources({"a": lambda: spark.range(1), "b": lambda: spark.read.parquet("/nowhere")})
    assert [*frames] == ["a"] and "PATH_NOT_FOUND" in errors["b"]


def test_full_outer_join_keeps_both_sides(spark):
    d = spark.createDataFrame([("A", 1, 10.0), ("A", 2, 20.0)], "region string, datetime int, demand_mwh double")
    g = spark.createDataFrame([("A", 1, 1.0), ("A", 3, 3.0)], "region string, datetime int, solar_mwh double")
    out = reshape.join_demand_generation(d, g)
    assert out.columns == ["region", "datetime", "demand_demand_mwh", "generation_solar_mwh"] and out.count() == 3


def test_cross_region_by_hand(spark):
    rows = [("California", 25000.0), ("California", 26000.0), ("Oregon", 15000.0), ("Oregon", 16000.0)]
    df = spark.createDataFrame(rows, "region string, value double").withColumn("timestamp", F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"))
    out = {(r["from_region"], r["to_region"]): r["avg_differential"] for r in reshape.cross_region(reshape.daily_features(df)).collect()}
    assert out == {("California", "Oregon"): -10000.0, ("Oregon", "California"): 10000.0}


def test_parsing(spark):
    df = spark.createDataFrame([("2024-01-20T01", "12", "2024-01-01 00:00:00"), ("invalid-date", "12d", "x"), (None, None, None)], "p string, v string, t string")
    out = df.select(S.period("p").alias("p"), S.strict_period("p").alias("s"), S.number("v").alias("v"), S.any_timestamp("t").alias("t")).collect()
    assert out[0] == (dt.datetime(2024, 1, 20, 1), dt.datetime(2024, 1, 20, 1), 12.0, dt.datetime(2024, 1, 1))
    assert out[1] == (None, None, None, None) and out[2] == (None, None, None, None)


def test_percent_rounds_half_even_and_guards_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(S.percent("a", "b")).collect()] == [0.0, 33.33]


@pytest.fixture(scope="module")
def hours(spark):
    out = spark.range(168).select(
        F.lit("A").alias("region"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).cast("timestamp_ntz").alias("datetime"),
        (1000 + F.col("id")).cast("double").alias("demand_mwh"), (F.col("id") % 24).cast("double").alias("solar_mwh"), F.lit(5.0).alias("wind_mwh"), F.lit(1.0).alias("hydro_mwh"), F.lit(2.0).alias("natural_gas_mwh"),
    )
    return out.cache()


def test_feature_chain(hours):
    out = features.all_features(hours)
    assert len(out.columns) - 1 == 153
    r = out.orderBy("datetime").limit(2).collect()
    assert r[0]["demand_mwh_lag_1h"] is None and r[1]["demand_mwh_lag_1h"] == 1000.0
    assert r[1]["total_renewable_mwh"] == 1.0 + 5 + 1 and -1 <= r[1]["hour_sin"] <= 1
    assert r[1]["total_generation_mwh"] == 1.0 + 5 + 1 + 2  # base fuels only
    strict = features.supply_demand(features.renewable(hours), strict_reference=True).orderBy("datetime").limit(2).collect()
    assert strict[1]["total_generation_mwh"] > r[1]["total_generation_mwh"]


def test_chunks_equal_one_window(hours):
    w = W.series("region", "datetime")
    whole = hours.select("datetime", W.full(F.col("demand_mwh"), F.avg, w, 24).alias("m")).orderBy("datetime").collect()
    parts = W.rolling_in_chunks(hours, "demand_mwh", 24, chunk_hours=10, ts="datetime").orderBy("datetime").collect()
    assert [r["m"] for r in whole] == [r["demand_mwh_rolling_mean_24h"] for r in parts]


@pytest.fixture(scope="module")
def long_series(spark):
    """One region with gaps in time and in values, over several chunks and blocks, and a short second one."""
    at = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).cast("timestamp_ntz")
    rows = spark.range(1500).where("id % 13 <> 0 and id not between 400 and 700").select(F.lit("A").alias("region"), at.alias("ts"), F.when(F.col("id") % 7 != 0, F.sin(F.col("id") / 9.0) * 50 + F.col("id") % 31).alias("v"))
    leading = rows.withColumn("v", F.when(F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz"), F.col("v")))
    return rows.union(leading.select(F.lit("B"), "ts", "v").limit(300)).union(rows.limit(9).select(F.lit(None), "ts", "v")).cache()


def test_blocks_equal_one_window(long_series):
    w = W.series("region", "ts")
    new = lambda w: {"lag": F.lag("v", 5).over(w), "lead": F.lead("v", 3).over(w), "mean": W.full(F.col("v"), F.avg, w, 4), "std": W.full(F.col("v"), F.stddev_samp, w, 24), "z": W.rolling_zscore("v", 6, w)}
    whole = long_series.select("*", *[c.alias(k) for k, c in new(w).items()])
    parts = W.over_rows(long_series, new, 23, 3, ts="ts", block_rows=64, chunk_hours=50)
    key = lambda r: (r["region"] or "", r["ts"])
    assert sorted(parts.collect(), key=key) == sorted(whole.collect(), key=key)
    assert parts.columns == whole.columns


def test_fills_and_gaps_over_chunks_equal_one_window(long_series):
    w, key = W.series("region", "ts"), lambda r: (r["region"] or "", r["ts"])
    whole = {key(r): r["x"] for r in long_series.select("region", "ts", W.forward_fill("v", w).alias("x")).collect()}
    assert {key(r): r["v"] for r in W.fill_forward(long_series, ["v"], ts="ts", chunk_hours=20).collect()} == whole
    linear = {key(r): r["v"] for r in W.fill_linear(long_series, ["v"], ts="ts", chunk_hours=20).collect()}
    known = {key(r): r["v"] for r in long_series.collect()}
    for region in ("A", "B", ""):
        mine = sorted((t for r, t in known if r == region))
        hours = np.array([(t - mine[0]).total_seconds() for t in mine])
        there = np.array([known[region, t] is not None for t in mine])
        if not there.any():
            assert all(linear[region, t] is None for t in mine)
            continue
        want = np.interp(hours, hours[there], [known[region, t] for t, y in zip(mine, there) if y], left=np.nan, right=np.nan)
        got = np.array([np.nan if linear[region, t] is None else linear[region, t] for t in mine])
        assert np.allclose(got, want, equal_nan=True)
    gaps = {r["region"]: (r["n_gaps"], r["max_gap_hours"]) for r in W.gap_report(long_series, ts="ts", chunk_hours=20).collect()}
    mine = sorted(t for r, t in known if r == "A")
    apart = [(b - a).total_seconds() / 3600 for a, b in zip(mine, mine[1:])]
    assert gaps["A"] == (sum(h > 1.5 for h in apart), max(apart))


def test_one_series_fills_many_tasks(spark, long_series):
    """More tasks than regions: windows are partitioned by block or chunk, too."""
    one = long_series.where("region = 'A'")
    frames = {
        "rows": W.add_lags(one, ["v"], (1,), ts="ts", block_rows=64, chunk_hours=50), "fill": W.fill_forward(one, ["v"], ts="ts", chunk_hours=50),
        "linear": W.fill_linear(one, ["v"], ts="ts", chunk_hours=50), "gaps": W.numbered(one, "region", "ts", 50),
    }
    for name, df in frames.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        over = [x for x in plan.splitlines() if x.strip(" :+-").startswith("Window ")]
        data = [x for x in over if "_w_size" not in x and "_w_before" not in x and "_w_in_" not in x and "_w_out_" not in x]
        assert data and all("_w_block" in x.split("], [")[1] + x or "_w_chunk" in x for x in data), name
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert frames["rows"].select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert frames["fill"].select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_medians_are_exact(spark):
    r = np.random.default_rng(3)
    values = {"a": r.integers(0, 50, 999), "b": r.normal(size=400).round(3), "c": [7.0], "d": [1.0] * 30 + [2.0] * 30}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)], "k string, x double")
    got = {x["k"]: x["median"] for x in quality.medians(rows.groupBy("k", "x").agg(F.count("*").alias("n")), rows, ["k"], "x").collect()}
    assert got == {k: float(np.median(v)) for k, v in values.items()}
    p = quality.profile(rows, ["x"]).first()
    every = np.concatenate([np.array(v, float) for v in values.values()])
    assert (p["count"], p["distinct"], p["median"]) == (len(every), len(set(every)), np.median(every)) and abs(p["mean"] - every.mean()) < 1e-9


def test_first_by_order_and_map_of_last_values(spark):
    rows = spark.createDataFrame([("k", 2, "a", 1.0), ("k", 1, "a", 5.0), ("k", 3, "a", 3.0), ("k", 9, "b", 2.0)], "k string, i int, n string, v double")
    r = reshape.pivot(rows, ["k"], "n", "v", ["a", "b", "c"], "first", order="i").first()
    assert (r["a"], r["b"], r["c"]) == (5.0, 2.0, 0.0)
    assert reshape.to_map(rows, ["k"], "n", "v", last_by="i").first()["by_name"] == {"a": 3.0, "b": 2.0}
    with pytest.raises(ValueError):
        reshape.pivot(rows, ["k"], "n", "v", ["a"], "first")
    assert reshape.prefixed(rows, "x", ["k"], keep=True).columns == ["k", "i", "n", "v", "x_i", "x_n", "x_v"]


def test_split_checks_its_ranges(spark):
    df = spark.range(3).select(F.lit("2024-01-02").cast("timestamp_ntz").alias("ts"))
    with pytest.raises(ValueError, match="shorter"):
        sequences.split(df, "ts", {"train": ("2024-01-01", "2024-01-05")}, min_days=30)
    with pytest.raises(ValueError, match="share"):
        sequences.split(df, "ts", {"train": ("2024-01-01", "2024-03-05"), "test": ("2024-01-01", "2024-03-05")}, max_overlap_days=30)
    assert sequences.split(df, "ts", {"train": ("2024-01-01", "2024-03-05"), "test": ("2024-03-01", "2024-04-05")}, 30, 30).count() == 3


@pytest.mark.parametrize("n,length,stride,room,expected", [(500, 168, 24, 1, 14), (1008, 168, 24, 1, 35), (400, 168, 144, 0, 2), (500, 100, 100, 0, 5), (167, 168, 24, 1, 0)])
def test_sequence_counts(spark, n, length, stride, room, expected):
    df = spark.range(n).select(F.lit("A").alias("region"), F.col("id").alias("ts"), F.col("id").cast("double").alias("v"))
    out = sequences.windows(df, ["region"], "ts", length, stride, room)
    assert out.select("seq_id").distinct().count() == expected == sequences.starts(df, ["region"], length, stride, room).count()
    assert out.count() == expected * length


def test_targets_follow_their_rows(spark):
    df = spark.range(60).select(F.lit("A").alias("region"), F.col("id").alias("ts"), F.col("id").cast("double").alias("v"))
    out = sequences.shifted_targets(df, ["region"], "ts", "v", 10, 5)
    assert out.where("target <> v + 1 or target is null").count() == 0
    nxt = {r["seq_id"]: r["target"] for r in sequences.next_row_targets(df, ["region"], "ts", "v", 10, 5).collect()}
    assert nxt[0] == 10.0 and nxt[1] == 15.0


def test_ring_segments(spark):
    assert sequences.segment_length(8760, 8, 168) == 1242 and sequences.segment_length(8760, 4, 0) == 2190
    df = spark.range(20).select(F.lit("A").alias("region"), F.col("id").alias("ts"))
    seq = sequences.prediction_windows(df, ["region"], "ts", 20)
    out = sequences.ring_segments(seq, 20, 4, 4).groupBy("segment").agg(F.count("*").alias("n"), F.min("pos").alias("a")).orderBy("segment").collect()
    assert [r["n"] for r in out] == [8] * 4 and [r["a"] for r in out] == [0, 4, 8, 12]


def test_impute_align_and_flags(spark):
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    df = spark.createDataFrame([("A", at(i), None if i in (0, 5) else 10.0 + (i == 50) * 90 - (i == 75) * 60 + i % 3 * 0.1) for i in range(100)], "region string, timestamp timestamp_ntz, v double")
    out = W.impute(df, ["v"])
    assert out.where("v is null").count() == 0
    assert {r["timestamp"] for r in W.zscore_flags(df, ["v"]).where("v_anomaly").collect()} == {at(50), at(75)}
    flat = df.withColumn("v", F.lit(1.0))
    assert W.zscore_flags(flat, ["v"]).where("v_anomaly").count() == 0
    late = spark.createDataFrame([(at(i + 10), 1.0) for i in range(80)], "timestamp timestamp_ntz, w double")
    both = reshape.align([df.select("timestamp", "v"), late])
    assert both.count() == 80 and both.columns == ["timestamp", "v_source_0", "w_source_1"]


def test_thresholds(spark):
    rows = [1000.0, 2000.0, None, 3000.0, None] * 20
    df = spark.createDataFrame([(x,) for x in rows], "demand_mw double")
    assert [tuple(r) for r in quality.thresholds(df).collect()] == [("missing_demand_mw", "40.0%")]
    df = spark.createDataFrame([(x,) for x in (1000.0, 2000.0, 200000.0, 3000.0, -1000.0)], "demand_mw double")
    assert [tuple(r) for r in quality.thresholds(df).collect()] == [("range_demand_mw", "2 values out of range")]


def test_unique_times_or_nothing(spark):
    df = spark.createDataFrame([("A", 1), ("A", 1)], "region string, t int")
    with pytest.raises(ValueError):
        quality.require_unique(df, ["region"], "t")
    with pytest.raises(Exception, match="too high"):
        quality.reject_batch(df, F.col("t") > 0, "too high").collect()


def test_normalizer_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    out = sequences.normalize(df, sequences.fit_normalizer(df, ["a", "b"])).collect()
    assert [r["a_norm"] for r in out] == [0, 0] and sorted(r["b_norm"] for r in out) == [-1, 1]


def test_ring_attention_equals_full_attention():
    x = np.random.default_rng(0).normal(size=(26, 6))
    s = x @ x.T / math.sqrt(6)
    s[np.triu_indices(26, 1)] = -np.inf
    p = np.exp(s - s.max(axis=1, keepdims=True))
    full = p / p.sum(axis=1, keepdims=True) @ x
    for ring in (1, 4, 5):
        assert np.allclose(attention.ring_attention(x, ring), full)
    assert not np.allclose(attention.ring_attention(x, 4, merge="sum"), full)
    changed = x.copy()
    changed[20:] += 1
    assert np.allclose(attention.ring_attention(changed, 4)[:20], full[:20])  # the future is not seen


def test_synthetic_bounds(spark):
    out = synthetic.week(spark, "X")
    r = out.agg(F.count("*").alias("n"), F.min("demand_mw").alias("d"), F.min("grid_stability").alias("a"), F.max("grid_stability").alias("b"), F.min("price_usd_per_mwh").alias("p"), F.min("solar_generation_mw").alias("s")).first()
    assert r["n"] == 168 and r["d"] >= 100 and 0 <= r["a"] <= r["b"] <= 1 and r["p"] >= 5 and r["s"] >= 0
    assert synthetic.series(spark, 24).collect() == synthetic.series(spark, 24).collect()


def test_store(spark, tmp_path, hours):
    s = store.Store(spark, str(tmp_path))
    s.save(hours.withColumn("year", F.year("datetime")), "raw", "x", partition_by=["year"], ts="datetime", source="test")
    with pytest.raises(Exception):
        s.save(hours, "raw", "x")
    entry = s.datasets().first()
    assert entry["row_count"] == 168 and entry["start_date"] == dt.datetime(2024, 1, 1)
    got = s.load_range("raw", "x", "A", "datetime", "2024-01-02 00:00:00", "2024-01-02 23:00:00")
    assert got.count() == 24 and "PushedFilters" in got._jdf.queryExecution().toString()
    assert s.info("raw", "x", "datetime")["rows"] == 168 and s.files("raw", "x")
    assert store.load_or_build(s, "features", "y", lambda: hours).count() == 168
    assert s.delete("raw", "x") and not s.exists(s.path("raw", "x"))
    told = store.consolidate(hours.withColumnRenamed("datetime", "timestamp"), str(tmp_path / "one"), 3)
    assert spark.read.parquet(str(tmp_path / "one")).count() == 168 == told["rows"] and told["files"] > 1 and told["first"] == dt.datetime(2024, 1, 1)
    assert store.consolidate(hours.withColumnRenamed("datetime", "timestamp").limit(0), str(tmp_path / "none"))["rows"] == 0
    assert spark.read.parquet(str(tmp_path / "none")).columns[:2] == ["region", "timestamp"]
    s.save(hours, "raw", "broken")
    (tmp_path / "raw/broken/part-bad.parquet").write_bytes(b"no parquet at all")
    assert s.load("raw", "broken", skip_unreadable=True).count() == 168
    assert [r["path"].rsplit("/", 1)[1] for r in s.unreadable("raw", "broken").collect()] == ["part-bad.parquet"]
    with pytest.raises(Exception):
        s.load("raw", "broken").count()
    files = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "source_file string, file_size long, modified long")
    assert store.signed_name("x", files, "t") == store.signed_name("x", files.orderBy(F.desc("file_size")), "t") != store.signed_name("x", files.limit(1), "t")


def test_paged_source_replays_recordings(spark, tmp_path):
    name = "region-data_PACW_2024-01-01_{}.json"
    for offset, n in ((0, 3), (3, 2)):
        body = {"response": {"data": [record(f"2024-01-01T{offset + i:02d}") for i in range(n)]}}
        (tmp_path / name.format(offset)).write_text(json.dumps(body))
    spark.dataSource.register(rest.PagedSource)
    requests = [{"data_type": "demand", "regions": ["PACW"], "start": "2024-01-01", "end": "2024-01-02"}]
    df = spark.read.format("paged").option("requests", json.dumps(requests)).option("transport", f"replay:{tmp_path}").option("page", "3").load()
    assert df.count() == 5
    assert rest.parameters("demand", ["A", "B"], "x", "y")["facets[respondent][1]"] == "B"


class Meeting:
    """A transport of one request of ``n`` records whose calls wait until ``k`` of them are under way."""

    def __init__(self, n, k=1, told=None):
        self.n, self.told, self.door, self.asked = n, told, threading.Barrier(k, timeout=20), []

    def __call__(self, params):
        at, length = int(params["offset"]), int(params["length"])
        self.asked.append(at)
        if at < 80:
            self.door.wait()
        return {"response": {"data": [{"value": i} for i in range(at, min(self.n, at + length))]}}

    def total(self, params):
        return self.told


def read_by_tasks(monkeypatch, fetch, **more):
    """What each task of a read of one request by pages of 10 finds."""
    monkeypatch.setattr(rest, "transport", lambda *_: fetch)
    asked = json.dumps([{"data_type": "demand", "regions": ["A"], "start": "s", "end": "e"}])
    reader = rest.PagedReader({"requests": asked, "transport": "replay:x", "page": "10", "wait": "none"} | more)
    return [[int(x) for b in reader.read(p) for x in b["value"].to_pylist()] for p in reader.partitions()]


def test_a_long_request_is_read_by_several_tasks_with_calls_under_way(monkeypatch):
    got = read_by_tasks(monkeypatch, Meeting(85, 4, 85), pages_per_task="4", pool="4")
    assert got == [list(range(40)), list(range(40, 85))]
    assert read_by_tasks(monkeypatch, Meeting(85, 8, 85), pages_per_task="2", pool="8", tasks="1") == [list(range(85))]


@pytest.mark.parametrize("told", [None, 0, 7, 60, 80, 85])
def test_records_beyond_the_total_are_read(monkeypatch, told):
    got = read_by_tasks(monkeypatch, Meeting(85, 1, told), pages_per_task="3")
    assert sum(got, []) == list(range(85)) and len(got) == max(1, -(-(told or 0) // 10 * 10 // 30))
    assert sum(read_by_tasks(monkeypatch, Meeting(85, 1, told), pages_per_task="3", most="25", on_most="stop"), []) == list(range(30))
    with pytest.raises(rest.TooManyRecords):
        read_by_tasks(monkeypatch, Meeting(85, 1, told), pages_per_task="3", most="25")


def test_records_that_are_gone_fail_and_spaced_calls_stay_single(monkeypatch):
    with pytest.raises(rest.Shrunk):
        read_by_tasks(monkeypatch, Meeting(33, 1, 85), pages_per_task="3")
    spaced = Meeting(85, 1, 85)
    assert read_by_tasks(monkeypatch, spaced, pages_per_task="3", policy="spaced") == [list(range(85))] and spaced.asked == list(range(0, 90, 10))


def test_a_folder_of_recordings_is_listed_once(tmp_path, monkeypatch):
    for region, offset, n in (("A", 0, 3), ("A", 3, 2), ("A", 12, 1), ("B_C", 0, 1)):
        (tmp_path / f"region-data_{region}_s_{offset}.json").write_text('{"status": 429}\n' + json.dumps({"response": {"data": [{}] * n}}))
    (tmp_path / "region-data_A_s_99.txt").write_text("")
    asked = json.dumps([{"data_type": "demand", "regions": [r], "start": "s", "end": "e"} for r in ("A", "B_C", "none")])
    listed, selector = [], rest.pyarrow.fs.FileSelector
    monkeypatch.setattr(rest.pyarrow.fs, "FileSelector", lambda *a, **k: listed.append(a) or selector(*a, **k))
    assert rest.Calls({"requests": asked, "transport": f"replay:{tmp_path}", "page": "3"}).totals() == [13, 1, 0] and len(listed) == 1


def test_retries_then_gives_up():
    calls, pauses = [], []

    def call():
        calls.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        rest.retried(call, rest.POLICIES["pooled"], pauses.append)
    assert len(calls) == 3 and pauses == [0.3, 0.6]

    def limited():
        raise rest.Refused(429)

    pauses.clear()
    with pytest.raises(OSError):
        rest.retried(limited, rest.POLICIES["spaced"], pauses.append)
    assert pauses == [3.0, 10.0, 3.0, 20.0, 3.0]
    pauses.clear()
    with pytest.raises(OSError):
        rest.retried(call, rest.POLICIES["spaced"], pauses.append)
    assert pauses == [3.0, 5.0, 3.0, 7.5, 3.0]


def test_a_long_request_fails_or_ends_as_asked():
    fetch = lambda p: {"response": {"data": [{}] * 10}}
    with pytest.raises(rest.TooManyRecords):
        list(rest.pages(fetch, {}, most=25, page=10))
    assert len(list(rest.pages(fetch, {}, most=25, page=10, on_most="stop"))) == 3
    endless = rest.pages(fetch, {}, page=10)
    assert sum(len(next(endless)) for _ in range(20_000)) == 200_000  # no silent end


def test_request_of_a_report():
    assert csv_zip.report_request("demand", "2024-01-01", "2024-01-02") == {"queryname": "SLD_FCST", "startdatetime": "20240101T08:00-0000", "enddatetime": "20240102T08:00-0000", "version": "1", "resultformat": "6"}
    assert csv_zip.report_request("prices", "20240101", "20240101", "N")["node"] == "N"
    with pytest.raises(ValueError):
        csv_zip.report_request("prices", "20240101", "20240101")


def test_pipeline_statuses(spark):
    def broken(df):
        raise ValueError("no")

    p = Pipeline(spark).add("a", lambda: spark.range(5)).add("b", broken, ["a"]).add("c", lambda df: df, ["b"]).add("d", lambda df: df.where("id > 1"), ["a"])
    out = p.run()
    assert {k: v.status for k, v in out.items()} == {"a": "done", "b": "failed", "c": "skipped", "d": "done"}
    assert out["d"].output.count() == 3 and not summary(out)["success"] and "failed" in to_json(out)
    assert {r.status for r in p.run(dry=True).values()} == {"dry"}
    with pytest.raises(ValueError):
        p.add("a", lambda: None)
    with pytest.raises(ValueError):
        p.add("z", lambda: None, ["nothing"])
    assert timed(lambda: spark.range(7))().rows == 7


def test_config_round_trip():
    c = config.PipelineConfig.from_dict({"regions": ["X"], "quality": {"max_missing_pct": 1.0}})
    assert c.regions == ["X"] and c.quality.max_missing_pct == 1.0 and not c.validate()
    assert config.PipelineConfig.from_dict(c.to_dict()) == c
    assert config.SplitConfig(train=("2024-01-01", "2023-01-01")).validate()
    assert not config.production().validate()


def test_stream_equals_batch(spark, tmp_path):
    rows = [("2024-01-01T00", "A", None, "1"), ("2024-01-01T00", "A", None, "9"), ("2024-01-01T01", "A", None, "x"), ("2024-01-05T00", "A", None, "3")]
    schema = "period string, region string, fuel_type string, value string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = cleaner.hourly(cleaner.clean(cleaner.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)))
    cleaner.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["timestamp"], r["n"]) for r in got] == [(dt.datetime(2024, 1, 1), 1)]  # the last hour is still open


def test_date_batches_lose_no_hour(spark):
    out = raw_json.date_batches(spark, "2024-01-01", "2024-01-10", 4).orderBy("from_date").collect()
    assert [(r["from_date"].day, r["to_date"].day) for r in out] == [(1, 5), (5, 9), (9, 11)]


def test_rungs_of_a_ladder_add_up():
    for windows in (W.ROLLS, (1,), (2,), (7, 5), (168,), (24, 1000)):
        have = {1}
        for n, a, b in W.ladder(windows):
            assert n == a + b and {a, b} <= have
            have.add(n)
        assert set(windows) <= have
    assert len(W.ladder((168,))) <= 10 and len(W.ladder(W.ROLLS)) <= 10


def test_ladder_equals_plain_frames(spark):
    i = F.col("id")
    v = F.when(i % 61 == 17, None).otherwise(F.sin(i * 7.3) * 1000 + 1e6)
    df = spark.range(3000).select((i % 3).cast("string").alias("region"), (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(hours=i)).cast("timestamp_ntz").alias("timestamp"), v.alias("v"), (i * 37 % 101).cast("int").alias("k"))
    windows = (1, 2, 5, 24, 50)
    got = W.add_rolling(df, ["v", "k"], windows, block_rows=70, chunk_hours=100)
    w = W.series()
    names = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    want = df.select("*", *[W.full(F.col(c), fn, w, n).alias(f"{c}_rolling_{s}_{n}h") for c in ("v", "k") for n in windows for s, fn in names.items()])
    assert got.columns == want.columns and got.schema["k_rolling_min_5h"].dataType == want.schema["k_rolling_min_5h"].dataType
    for a, b in zip(got.orderBy("timestamp").collect(), want.orderBy("timestamp").collect(), strict=True):
        for c in got.columns:
            x, y = a[c], b[c]
            assert (x is None) == (y is None) and (x == y or abs(x - y) <= 1e-7 * max(1.0, abs(y))), (c, x, y)


def test_merged_moments_equal_the_full_fit(spark, tmp_path):
    i = F.col("id")
    a = F.when(i % 13 == 3, None).when(i % 17 == 1, float("nan")).otherwise(1e6 + F.sin(i) * 3)
    b = F.when(i % 7 == 0, None).otherwise(F.cos(i * 1.1) + i * 1e-4)
    df = spark.range(4000).select(F.when(i % 5 == 0, None).otherwise("r").alias("g"), a.alias("a"), b.alias("b"), F.lit(2.0).alias("c"), (i * i % 9).alias("k"))
    held = moments.MomentStore(spark, str(tmp_path / "m"), ["a", "b", "c"], ["g"])
    for k in (0, 1, 1, 2):
        held.add(df.where((F.col("k") % 3) == k).drop("k"), f"p{k}")
    held.add(df.where("k > 100"), "none")
    merged = held.merged().cache()
    again = moments.merge(moments.merge(held.states().where("n < 700"), ["g"]).unionByName(held.states().where("n >= 700")), ["g"])  # in steps
    for state in (merged, again):
        for g in (None, "r"):
            mine = df.where(F.col("g").eqNullSafe(F.lit(g)))
            want = {r["feature"]: r for r in sequences.fit_normalizer(mine, ["a", "b", "c"]).collect()}
            got = {r["feature"]: r for r in moments.fitted(state, ["g"]).where(F.col("g").eqNullSafe(F.lit(g))).collect()}
            assert got.keys() == want.keys()
            for f, r in want.items():
                for c in ("mean", "std", "min", "max"):
                    assert math.isclose(got[f][c], r[c], rel_tol=1e-9, abs_tol=1e-12), (f, c)
            both = mine.where("a is not null and not isnan(a) and b is not null")
            pairs = {(r["x"], r["y"]): r for r in moments.correlations(state, ["g"]).where(F.col("g").eqNullSafe(F.lit(g))).collect()}
            n, corr = both.agg(F.count("*"), F.corr("a", "b")).first()
            assert pairs["a", "b"]["n"] == n and math.isclose(pairs["a", "b"]["correlation"], corr, abs_tol=1e-9)
            assert pairs["a", "c"]["correlation"] is None
    with pytest.raises(ValueError):
        held.add(df, "../x")
