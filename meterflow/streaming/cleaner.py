"""The batch cleaner's semantics as a stream: parse, reject, deduplicate, hourly means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import scalar as S


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def clean(records: DataFrame, keys: tuple[str, ...] = ("timestamp", "region", "fuel_type"), late: str = "1 day") -> DataFrame:
    """Records with text ``period`` and ``value`` to unique typed rows; state is bounded by the watermark."""
    typed = records.withColumns({"timestamp": S.period("period").cast("timestamp"), "value": S.number("value")})
    kept = typed.where("timestamp is not null and value is not null and region is not null")
    return kept.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(list(keys))


def hourly(cleaned: DataFrame, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """Mean per key and hour, emitted once the watermark has passed the hour."""
    out = cleaned.groupBy(F.window("timestamp", "1 hour"), *keys).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("timestamp"), *keys, "value", "n")


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, exactly once, as Parquet."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
