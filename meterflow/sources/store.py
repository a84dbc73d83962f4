"""Layered Parquet storage with a catalog of what was saved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schemas import DATASET
from . import footers, layout

LAYERS = ("raw", "harmonized", "features")


class Store:
    """``base/<layer>/<name>`` folders, partitioned where asked, and ``base/_datasets`` describing them."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, layer: str, name: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"layer must be one of {LAYERS}")
        return f"{self.base}/{layer}/{name}"

    def save(self, df: DataFrame, layer: str, name: str, overwrite: bool = False, partition_by: Sequence[str] = (), compression: str = "snappy", ts: str | None = None, **about: str) -> str:
        """Write once; an existing dataset is only replaced with ``overwrite``."""
        if not df.columns:
            raise ValueError("the frame has no columns")
        where = self.path(layer, name)
        df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).partitionBy(*partition_by).parquet(where)
        saved = self.spark.read.parquet(where)
        stats = saved.agg(F.count("*").alias("n"), *([F.min(ts).alias("a"), F.max(ts).alias("b")] if ts else [])).first()
        row = (name, about.get("source"), about.get("region"), about.get("data_type"), layer, where, stats["n"], stats["a"] if ts else None, stats["b"] if ts else None, None)
        entry = self.spark.createDataFrame([row], DATASET).withColumn("saved_at", F.current_timestamp().cast("timestamp_ntz"))
        entry.write.mode("append").parquet(f"{self.base}/_datasets")
        return where

    def load(self, layer: str, name: str, columns: Sequence[str] | None = None, skip_unreadable: bool = False) -> DataFrame:
        """The dataset; a damaged file fails the job unless it may be skipped (``unreadable`` names such files).

        Then the schema comes from the footers of all sound files, so that no damaged one is asked for it.
        """
        reader = self.spark.read
        if skip_unreadable:
            reader = reader.option("ignoreCorruptFiles", True).schema(footers.merged_schema(self.footers(layer, name)))
        df = reader.parquet(self.path(layer, name))
        return df.select(*columns) if columns else df

    def footers(self, layer: str, name: str, pages: bool = False) -> DataFrame:
        """What the dataset's files say about themselves (``footers``); ``pages`` also reads and checks every page."""
        return footers.footers(self.spark, self.path(layer, name), pages)

    def unreadable(self, layer: str, name: str, pages: bool = False) -> DataFrame:
        """(path, bytes, error): data files whose footer, or with ``pages`` any page, cannot be read."""
        return footers.broken(self.footers(layer, name, pages))

    def load_range(self, layer: str, name: str, region: str | None = None, ts: str = "timestamp", start: str | None = None, end: str | None = None) -> DataFrame:
        """Region and inclusive range; both reach the scan as partition and row-group filters."""
        df = self.load(layer, name)
        if region is not None:
            df = df.where(F.col("region") == region)
        if start is not None:
            df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
        return df if end is None else df.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))

    def datasets(self) -> DataFrame:
        """The newest entry of each dataset."""
        if not self.exists(f"{self.base}/_datasets"):
            return self.spark.createDataFrame([], DATASET)
        all_ = self.spark.read.schema(DATASET).parquet(f"{self.base}/_datasets")
        return all_.groupBy("path").agg(F.max_by(F.struct(*DATASET.fieldNames()), "saved_at").alias("d")).select("d.*")

    # files -------------------------------------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def delete(self, layer: str, name: str) -> bool:
        fs, p = self._fs(self.path(layer, name))
        return fs.delete(p, True)

    def files(self, layer: str, name: str) -> list[dict]:
        """(name, bytes, modified) of the data files of a dataset."""
        fs, p = self._fs(self.path(layer, name))
        found, out = fs.listFiles(p, True), []
        while found.hasNext():
            s = found.next()
            if not s.getPath().getName().startswith(("_", ".")):
                out.append({"name": s.getPath().getName(), "bytes": s.getLen(), "modified": s.getModificationTime()})
        return sorted(out, key=lambda x: x["name"])

    def info(self, layer: str, name: str, ts: str = "timestamp") -> dict:
        """Rows, columns, range, regions and data types: from footers and folder names; a column that is neither is read alone."""
        df, found = self.load(layer, name), self.footers(layer, name)
        told = footers.profile(found, **({ts: "timestamp_ntz"} if ts in df.columns else {})).first()
        out = {k: told[k] for k in ("rows", "files", "bytes", "broken")} | {"columns": df.columns}
        if ts in df.columns:
            out |= {"first": told[f"{ts}_min"], "last": told[f"{ts}_max"]}
            if out["first"] is None and told["rows"]:  # written without statistics
                out["first"], out["last"] = df.agg(F.min(ts), F.max(ts)).first()
        folders = found.where("error is null and rows > 0").select("path").distinct()
        for c in ("region", "data_type"):
            if c in df.columns:
                value = F.regexp_extract("path", f"/{c}=([^/]+)/", 1)
                named = [r[0] for r in folders.select(F.url_decode(value)).distinct().collect()]
                out[c] = named if all(named) and named else [r[0] for r in df.select(c).distinct().collect()]
        return out


def consolidate(df: DataFrame, path: str, files: int | None = None, ts: str = "timestamp", interleave: bool = False, **how: int) -> dict:
    """One dataset sorted by region and time: ranges over files, order within them; an empty frame leaves its schema.

    ``interleave`` orders by both columns at once instead (``layout``, which takes ``how``), so that a filter on times alone skips row
    groups, too. Returns rows, files, bytes, first and last time of what was written.
    """
    if interleave:
        layout.write(df, path, ["region", ts], files, **how)
    else:
        ranged = df.repartitionByRange(files, "region", ts) if files else df.repartitionByRange("region", ts)
        ranged.sortWithinPartitions("region", ts).write.mode("overwrite").parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    size = saved.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
    each = size.groupBy("_file").agg(F.max("_size").alias("b"), F.count("*").alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.min("lo").alias("first"), F.max("hi").alias("last")
    ).first().asDict()


def signed_name(source: str, files: DataFrame, stamp: str) -> str:
    """``{source}_{stamp}_{8 hex digits}``: the digits change when a source file's name, size or time does."""
    each = files.select(S.file_signature("source_file", "file_size", "modified").alias("s")).distinct()
    whole = each.agg(F.sum(F.conv(F.substring("s", 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("t"))  # the order of files does not matter
    return f"{source}_{stamp}_{whole.select(F.substring(F.md5(F.coalesce('t', F.lit(''))), 1, 8)).first()[0]}"


def load_or_build(store: Store, layer: str, name: str, build) -> DataFrame:
    """The saved dataset, built and saved first where it is missing."""
    if not store.exists(store.path(layer, name)):
        store.save(build(), layer, name)
    return store.load(layer, name)
