"""The interleaved layout: rows kept whole, row groups skipped by either column, odd input."""

import datetime as dt

from pyspark.sql import functions as F

from meterflow.sources import footers, layout, store

T0 = dt.datetime(2024, 1, 1)


def series(spark, rows=8000):
    """A third of the rows is one region; 40 others and 500 hours share the rest."""
    at = (F.lit(T0) + F.make_dt_interval(hours=F.pmod(F.xxhash64("id", F.lit("t")), F.lit(500)))).cast("timestamp_ntz")
    region = F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.format_string("R%02d", F.pmod(F.xxhash64("id"), F.lit(40))))
    return spark.range(rows).select(region.alias("region"), at.alias("timestamp"), (F.col("id") * 0.5).alias("value"), F.lit(1).alias("rank"))


def read_share(found, *ask):
    r = layout.groups_read(found, *ask).first()
    return r["read"] / r["groups"]


def test_either_filter_skips_row_groups(spark, tmp_path):
    rows, day = series(spark), ("timestamp", "timestamp_ntz", "2024-01-05 00:00:00", "2024-01-05 23:59:59")
    told = store.consolidate(rows, str(tmp_path / "z"), 4, interleave=True, group_rows=125, bits=6)
    store.consolidate(rows.withColumn("value", F.col("value")), str(tmp_path / "s"), 4)
    got = spark.read.parquet(str(tmp_path / "z"))
    assert told["rows"] == 8000 and told["files"] == 4 and got.columns == rows.columns
    assert got.exceptAll(rows).isEmpty() and rows.exceptAll(got).isEmpty()
    found = footers.footers(spark, str(tmp_path / "z"))
    assert layout.groups_read(found, *day).first()["groups"] >= 64
    assert read_share(found, "region", "string", "R07", "R07") < 0.3 and read_share(found, *day) < 0.35
    # the sorted layout meets every file for a day, the hot region lies in several files here
    assert read_share(footers.footers(spark, str(tmp_path / "s")), *day) == 1.0
    hot = got.where("region = 'HOT'").select(F.col("_metadata.file_path").alias("f")).distinct().count()
    assert hot > 1
    plan = got.where("region = 'R07'")._jdf.queryExecution().toString()
    assert "EqualTo(region,R07)" in plan


def test_ranks_grow_with_values_and_take_nulls(spark):
    rows = series(spark, 900).union(spark.createDataFrame([(None, None, None, 1)] * 3, "region string, timestamp timestamp_ntz, value double, rank int"))
    for column in ("region", "timestamp"):
        got = sorted(((r["value"] is not None, str(r["value"])), r["rank"]) for r in layout.ranks(rows, column, 4).collect())
        assert len(got) == len({v for v, _ in got}) and got[0][0] == (False, "None")
        assert [r for _, r in got] == sorted(r for _, r in got) and got[0][1] == 0 and 8 <= got[-1][1] < 16


def test_interleaving(spark):
    pairs = spark.range(16).select((F.col("id") / 4).cast("int").alias("a"), (F.col("id") % 4).cast("int").alias("b"))
    z = {(r["a"], r["b"]): r["z"] for r in pairs.withColumn("z", layout.interleaved([F.col("a"), F.col("b")], 2)).collect()}
    assert z == {(a, b): (a >> 1 << 3) | (b >> 1 << 2) | ((a & 1) << 1) | (b & 1) for a in range(4) for b in range(4)}


def test_nulls_repeats_and_nothing(spark, tmp_path):
    odd = spark.createDataFrame([(None, None, 1.0), ("A", None, 2.0), (None, T0, None), ("A", T0, 3.0), ("A", T0, 3.0)], "region string, timestamp timestamp_ntz, value double")
    for name, rows in (("odd", odd), ("none", odd.limit(0))):
        layout.write(rows, str(tmp_path / name), ["region", "timestamp"], 2, bits=3)
        got = spark.read.parquet(str(tmp_path / name))
        assert got.schema == rows.schema and got.exceptAll(rows).isEmpty() and rows.exceptAll(got).isEmpty()
    layout.write(odd, str(tmp_path / "three"), ["value", "region", "timestamp"], bits=3)
    assert spark.read.parquet(str(tmp_path / "three")).count() == 5
