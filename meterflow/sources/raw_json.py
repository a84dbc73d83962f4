"""Raw envelopes as JSON files: scan, write, and the plan of requests that fetch them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ENVELOPE
from .files import write_named


def read_envelopes(spark: SparkSession, path: str, glob: str = "*.json", data_type: str | None = None) -> DataFrame:
    """All envelopes below ``path`` with ``source_file``; files that are not JSON have ``_corrupt_record`` set."""
    df = (
        spark.read.schema(ENVELOPE)
        .option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .json(path)
        .select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified"))
    )
    return df if data_type is None else df.where(F.col("metadata.data_type") == data_type)


def filled_in(envelopes: DataFrame) -> DataFrame:
    """``metadata`` with the size of the answer and its number of records, where they are missing or 0."""
    response = F.to_json("api_response")
    size = F.when(F.coalesce("metadata.response_size_bytes", F.lit(0)) == 0, F.octet_length(response).cast("long")).otherwise(F.col("metadata.response_size_bytes"))
    n = F.when(F.coalesce("metadata.record_count", F.lit(0)) == 0, F.coalesce(F.size("api_response.response.data"), F.lit(0)).cast("long")).otherwise(F.col("metadata.record_count"))
    return envelopes.withColumn("metadata", F.col("metadata").withField("response_size_bytes", size).withField("record_count", n))


def file_name(source: str = "raw") -> Column:
    """``{year}/{source}_{type}_{region}_{start}_to_{end}_{timestamp}.json`` of an envelope."""
    m = lambda name, other: F.coalesce(F.col(f"metadata.{name}"), F.lit(other))
    stamp = F.regexp_replace(m("timestamp", ""), "[^0-9A-Za-z]", "")
    parts = [F.lit(source), m("data_type", "unknown"), m("region", "all"), m("start_date", ""), F.lit("to"), m("end_date", ""), stamp]
    return F.concat(F.substring(m("start_date", "0000"), 1, 4), F.lit("/"), F.concat_ws("_", *parts), F.lit(".json"))


def write_envelopes(df: DataFrame, path: str, source: str = "raw") -> tuple[int, int]:
    """One named file per envelope below the year of its range, size and record count filled in; returns files and bytes."""
    full = filled_in(df)
    body = F.to_json(F.struct("metadata", "api_response"))
    return write_named(full.select(file_name(source).alias("name"), body.cast("binary").alias("body")), path)


def file_info(path_df: DataFrame) -> DataFrame:
    """(source_file, file_size, modified), one row per file of ``read_envelopes``."""
    return path_df.select("source_file", "file_size", "modified").distinct()


def extraction_summary(envelopes: DataFrame) -> DataFrame:
    """Files, records, bytes and failures by data type, by region, by year and in all."""
    rows = envelopes.select(
        F.col("metadata.data_type").alias("data_type"), F.col("metadata.region").alias("region"), F.substring("metadata.start_date", 1, 4).alias("year"),
        F.coalesce("metadata.record_count", F.lit(0)).alias("records"), F.coalesce("metadata.response_size_bytes", F.lit(0)).alias("bytes"),
        (~F.coalesce("metadata.success", F.lit(False))).cast("int").alias("failed"),
    )
    keys = [F.col(c) for c in ("data_type", "region", "year")]
    return rows.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.grouping_id().alias("grouping_id"), F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.sum("failed").alias("failed")
    )


def date_batches(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """Half-open ranges [from, to) of ``days`` days that tile [start, end]; no hour is lost between them."""
    if days < 1:
        raise ValueError("days must be at least 1")
    one = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.date_add(F.lit(end).cast("date"), 1).alias("b"))
    cut = one.select("b", F.explode(F.expr(f"sequence(a, date_sub(b, 1), interval {days} day)")).alias("from_date"))
    return cut.select("from_date", F.least(F.date_add("from_date", days), F.col("b")).alias("to_date"))


def request_plan(spark: SparkSession, data_types: Sequence[str], regions: Sequence[str], start: str, end: str, days: int, regions_per_request: int = 1) -> DataFrame:
    """One row per request: data type x range x chunk of regions (three small lists)."""
    chunks = [list(regions[i : i + regions_per_request]) for i in range(0, len(regions), regions_per_request)]
    kinds = spark.createDataFrame([(t,) for t in data_types], "data_type string")
    groups = spark.createDataFrame([(c,) for c in chunks], "regions array<string>")
    return kinds.crossJoin(date_batches(spark, start, end, days)).crossJoin(groups)
