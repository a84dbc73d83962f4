"""Profiles from footers, and files that cannot be read."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meterflow.sources import footers, store

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def held(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    at = (F.lit(T0) + F.make_dt_interval(hours="id")).cast("timestamp_ntz").alias("timestamp")
    rows = spark.range(0, 400, 1, 4).select(at, F.when(F.col("id") % 2 == 0, "A b").otherwise("B").alias("region"), F.when(F.col("id") != 7, F.col("id") * 0.5).alias("v"), F.lit("demand").alias("data_type"))
    s.save(rows, "raw", "x", partition_by=["region"])
    return s


def parts(s):
    return sorted(Path(s.path("raw", "x")).rglob("*.parquet"))


def test_a_profile_reads_no_data_page(spark, held):
    want = {"rows": 400, "first": T0, "last": T0 + dt.timedelta(hours=399), "region": ["A b", "B"], "broken": 0}
    for spoil in (False, True):
        if spoil:  # every byte before the footer is gone: only footers can still be read
            for p in parts(held):
                body = p.read_bytes()
                size = int.from_bytes(body[-8:-4], "little") + 8
                p.write_bytes(b"PAR1" + b"\0" * (len(body) - 4 - size) + body[-size:])
                Path(f"{p.parent}/.{p.name}.crc").unlink(missing_ok=True)
        got = footers.profile(held.footers("raw", "x"), timestamp="timestamp_ntz", v="double").first()
        assert (got["rows"], got["files"], got["broken"]) == (400, len(parts(held)), 0)
        assert (got["timestamp_min"], got["timestamp_max"], got["v_min"], got["v_max"]) == (want["first"], want["last"], 0.0, 199.5)
        assert got["bytes"] == sum(p.stat().st_size for p in parts(held))
    assert held.unreadable("raw", "x").count() == 0
    assert held.unreadable("raw", "x", pages=True).count() == len(parts(held))


def test_info_takes_folders_and_footers(held):
    got = held.info("raw", "x")
    assert (got["rows"], got["first"], got["last"]) == (400, T0, T0 + dt.timedelta(hours=399))
    assert sorted(got["region"]) == ["A b", "B"] and got["data_type"] == ["demand"] and len(got["columns"]) == 4


def test_torn_footers_and_pages_are_named(spark, held):
    torn, cut, paged, empty = parts(held)[:4]
    body = torn.read_bytes()
    size = int.from_bytes(body[-8:-4], "little")
    torn.write_bytes(body[: -8 - size] + b"\x99" * size + body[-8:])  # sound magic and length, a footer of rubbish
    cut.write_bytes(cut.read_bytes()[:-20])
    body = bytearray(paged.read_bytes())
    body[4:60] = b"\xff" * 56
    paged.write_bytes(bytes(body))
    empty.write_bytes(b"")
    for p in (torn, cut, paged, empty):
        Path(f"{p.parent}/.{p.name}.crc").unlink(missing_ok=True)
    names = lambda df: {Path(r["path"]).name for r in df.collect() if r["error"]}
    # two of the four have one name in different folders, so paths are compared as sets of names per call
    assert names(held.unreadable("raw", "x")) == {torn.name, cut.name}  # Spark passes over files without a byte
    assert names(held.unreadable("raw", "x", pages=True)) == {torn.name, cut.name, paged.name}
    told = footers.profile(held.footers("raw", "x")).first()
    assert told["broken"] == 2 and told["rows"] < 400 and told["files"] == len(parts(held)) - 3
    assert held.load("raw", "x", skip_unreadable=True).where("region is not null").select("timestamp").count() < 400


def test_schemas_of_files_are_merged(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, s string").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(1, 2.0)], "k int, x double").write.parquet(f"{tmp_path}/b")
    spark.createDataFrame([], "k int, x double").write.parquet(f"{tmp_path}/c")
    found = footers.footers(spark, str(tmp_path))
    assert {f.name: f.dataType.simpleString() for f in footers.merged_schema(found).fields} == {"k": "int", "s": "string", "x": "double"}
    assert footers.schemas(found).count() == 2 and footers.profile(found, k="int").first()["k_max"] == 1
    spark.createDataFrame([("z",)], "k string").write.parquet(f"{tmp_path}/d")
    with pytest.raises(ValueError, match="column k"):
        footers.merged_schema(footers.footers(spark, str(tmp_path)))
