"""The keyed store against one clean over all arrivals."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterflow import shared
from meterflow.operators import clean
from meterflow.sources import keyed

SCHEMA = "timestamp timestamp_ntz, region string, fuel_type string, value double, source_file string, _pos int"
KEYS, ORDER = ["timestamp", "region", "fuel_type"], ["source_file", "_pos"]
T0 = dt.datetime(2024, 1, 1)


def arrival(seed, file, hours, n=300):
    r = random.Random(seed)
    rows = [(T0 + dt.timedelta(hours=r.choice(hours)), r.choice("ABC"), r.choice(["SUN", "WND", None]), r.random(), f"f{file:03d}", i) for i in range(n)]
    return rows + [(None, "A", None, 1.0, f"f{file:03d}", n), (T0, None, None, 2.0, f"f{file:03d}", n + 1)]


def full(spark, rows):
    return Counter(tuple(r) for r in clean.keep_first(spark.createDataFrame(rows, SCHEMA), KEYS, ORDER).collect())


def opened(spark, path, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    return keyed.KeyedStore(spark, path, schema, KEYS, ORDER, **({"parts": 3, "chunk_hours": 48} | more))


def files(spark, path):
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/data").count()


def test_arrivals_equal_the_full_clean_and_read_little(spark, tmp_path):
    path, seen = str(tmp_path / "s"), []
    store = opened(spark, path)
    assert store.read().count() == 0 and store.version() == 0
    # new hours, then hours that overlap the newest ones only
    for k in range(3):
        part = arrival(k, 10 + k, range(k * 200, k * 200 + 210))
        part += part[:5]  # the same rows twice
        seen += part
        assert store.append(spark.createDataFrame(part, SCHEMA)) == k + 1
        assert Counter(tuple(r) for r in store.read().collect()) == full(spark, seen)
        if k:
            read = spark.read.parquet(*store.read_buckets).inputFiles()
            assert 0 < len(read) < files(spark, path) / 3
    # hours of their own: only the rows without a time or region, which every arrival brings, have to be looked up
    part = arrival(7, 30, range(5000, 5100))
    seen += part
    store.append(spark.createDataFrame(part, SCHEMA))
    assert all(f"/chunk={keyed.NO_TIME}" in p or "/chunk=0" in p or len(store.read_buckets) < 8 for p in store.read_buckets) and len(store.read_buckets) < 8
    # a file whose name comes first arrives last and takes its keys over
    part = arrival(8, 1, range(0, 600), 400)
    seen += part
    store.append(spark.createDataFrame(part, SCHEMA))
    want = full(spark, seen)
    assert Counter(tuple(r) for r in store.read().collect()) == want
    assert any(r[4] == "f001" for r in want)
    # the same files again change nothing
    before = store.read().count()
    store.append(spark.createDataFrame(seen, SCHEMA))
    assert store.read().count() == before and Counter(tuple(r) for r in store.read().collect()) == want
    store.append(spark.createDataFrame([], SCHEMA))
    live = store.manifest(store.version()).count()
    store.compact(1)
    assert store.manifest(store.version()).count() < live and Counter(tuple(r) for r in store.read().collect()) == want
    version = store.version()
    assert store.compact(1) == version


def test_a_range_and_a_region_choose_buckets(spark, tmp_path):
    store, rows = opened(spark, str(tmp_path / "s")), arrival(1, 1, range(500), 800)
    store.append(spark.createDataFrame(rows, SCHEMA))
    got = store.read("2024-01-05 06:00:00", "2024-01-07 00:00:00", "B")
    want = [r for r in full(spark, rows) if r[1] == "B" and r[0] and dt.datetime(2024, 1, 5, 6) <= r[0] <= dt.datetime(2024, 1, 7)]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want) and want
    assert len(got.inputFiles()) < len(store.read().inputFiles()) / 3


def test_of_two_writers_none_is_lost(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    a, b = opened(spark, path), opened(spark, path)
    rows = [arrival(k, k, range(100)) for k in range(3)]
    a.append(spark.createDataFrame(rows[0], SCHEMA))
    meets, once = a._publish, []

    def late(*args):  # the other writer commits while this one writes
        if not once:
            once.append(b.append(spark.createDataFrame(rows[1], SCHEMA)))
        return meets(*args)

    monkeypatch.setattr(a, "_publish", late)
    assert a.append(spark.createDataFrame(rows[2], SCHEMA)) == 3 and once == [2]
    assert Counter(tuple(r) for r in a.read().collect()) == full(spark, sum(rows, []))
    with pytest.raises(keyed.Conflict):
        a.append(spark.createDataFrame(rows[2], SCHEMA), tries=0)


def test_filters_hold_every_key_and_few_others(spark, tmp_path):
    schema = "timestamp timestamp_ntz, region string, fuel_type string, value double, source_file string, _pos int"
    rows = lambda a, b: spark.range(a, b).select(
        F.lit(T0).cast("timestamp_ntz").alias("timestamp"), F.lit("A").alias("region"), F.concat(F.lit("k"), "id").alias("fuel_type"), F.lit(1.0).alias("value"), F.lit("f").alias("source_file"), F.lit(0).alias("_pos")
    )
    store = keyed.KeyedStore(spark, str(tmp_path / "s"), spark.createDataFrame([], schema).schema, KEYS, ORDER)
    store.append(rows(0, 20_000))
    live = store.manifest(1)
    assert live.first()["blocks"] == 8  # one hot bucket, split over blocks
    assert store._maybe(store._hashed(rows(0, 20_000)), live).count() == 20_000
    assert store._maybe(store._hashed(rows(20_000, 60_000)), live).count() < 0.01 * 40_000


def test_create_once(spark, tmp_path):
    path = f"{tmp_path}/a"
    assert shared.create_once(spark, path, "one") and not shared.create_once(spark, path, "two")
    assert (tmp_path / "a").read_text() == "one" and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["a"]
