"""Raw envelopes to the unified table: flatten, type, reject, deduplicate, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schemas import UNIFIED

NEEDED = ("timestamp", "value", "region")


def flatten(envelopes: DataFrame) -> DataFrame:
    """One row per record with all eight unified columns, malformed values as NULL; ``_pos`` keeps the order."""
    rows = envelopes.select(
        F.coalesce("metadata.data_type", F.lit("unknown")).alias("data_type"),
        F.col("source_file"),
        F.posexplode("api_response.response.data").alias("_pos", "r"),
    )
    return rows.select(
        S.period("r.period").alias("timestamp"),
        F.col("r.respondent").alias("region"),
        "data_type",
        F.col("r.fueltype").alias("fuel_type"),
        F.col("r.`type-name`").alias("type_name"),
        S.number("r.value").alias("value"),
        F.col("r.`value-units`").alias("value_units"),
        "source_file",
        "_pos",
    )


def complete(needed=NEEDED) -> Column:
    out = F.lit(True)
    for name in needed:
        out = out & F.col(name).isNotNull()
    return out


def reject_incomplete(df: DataFrame, needed=NEEDED) -> DataFrame:
    return df.dropna(subset=list(needed))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by a total order; NULL keys are equal. Hot keys only sort, never join."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def clean(envelopes: DataFrame, across_files: bool = True) -> DataFrame:
    """The unified table. Without ``across_files`` duplicates are removed within each file only."""
    keys = ["timestamp", "region", "fuel_type"] + ([] if across_files else ["source_file"])
    rows = keep_first(reject_incomplete(flatten(envelopes)), keys, ["source_file", "_pos"])
    return rows.select(*UNIFIED.fieldNames())


def route(records: DataFrame) -> dict[str, DataFrame]:
    """Demand rows carry type D, generation rows a fuel; the rest is neither."""
    demand, generation = F.col("type") == "D", F.col("fueltype").isNotNull()
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return {
        "demand": records.where(demand),
        "generation": records.where(generation & no(demand)),
        "other": records.where(no(demand) & no(generation)),
    }


def response_kind(envelopes: DataFrame) -> DataFrame:
    """Adds ``kind``: corrupt, error, data, empty or invalid."""
    response = F.col("api_response.response")
    kind = (
        F.when(F.col("_corrupt_record").isNotNull(), "corrupt")
        .when(F.col("api_response.error").isNotNull(), "error")
        .when(F.size(response["data"]) > 0, "data")
        .when(response.isNotNull(), "empty")
        .otherwise("invalid")
    )
    return envelopes.withColumn("kind", kind)


def report(rows: DataFrame, keys=("timestamp", "region", "fuel_type"), needed=NEEDED) -> DataFrame:
    """One row: initial, final, dropped, NULL counts, mislabelled rows and score = final / initial (1 if empty)."""
    seen = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max(complete(needed).cast("int")).alias("ok"),
        F.sum((~complete(needed)).cast("int")).alias("bad"),
        *[F.sum(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in needed],
        F.sum((F.col("data_type").eqNullSafe("demand") & F.col("fuel_type").isNotNull()).cast("int")).alias("mislabelled"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    out = seen.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("initial_records"),
        F.coalesce(F.sum("ok"), F.lit(0)).cast("long").alias("final_records"),
        *[total(f"null_{c}") for c in needed],
        total("mislabelled"),
    )
    dropped = F.col("initial_records") - F.col("final_records")
    return out.withColumns(
        {
            "dropped_records": dropped,
            "drop_pct": F.coalesce(S.ratio(dropped * 100.0, "initial_records"), F.lit(0.0)),
            "quality_score": F.coalesce(S.ratio("final_records", "initial_records"), F.lit(1.0)),
        }
    )
