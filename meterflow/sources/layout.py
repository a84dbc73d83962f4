"""A file layout on several columns at once, so that a filter on any one of them prunes row groups.

Sorting by region and time serves a filter on regions; one on a day then meets every file. Here each column
gets a rank of a few bits, the ranks' bits are interleaved to one number, and rows are ranged over files and
ordered within them by it: a row group holds a box that is narrow in every column.

Ranks come from the distinct values of a column (hours, for times): Spark ranges them over ``1 << bits``
partitions, and a value's rank is its partition. No value passes through the driver, and a value that a third
of all rows share has one rank like any other; its rows are then split over files by the other columns.

Defined results: NULL ranks first, as it sorts; a column of fewer values than ranks spreads them over all ranks;
an empty frame leaves its schema; rows are neither dropped nor changed, columns keep their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared
from ..functions import scalar as S
from .footers import bounds

BITS = 8
#: Distinct values up to which their ranks are broadcast (about 100 bytes a value); beyond it the same join shuffles.
BROADCAST_VALUES = 300_000


def ranked_value(df: DataFrame, column: str) -> Column:
    """What is ranked of a column: the hour of a time, any other value itself."""
    kind = df.schema[column].dataType
    return S.hour_bucket(column) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(f"`{column}`")


def ranks(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(value, rank): each distinct value with its rank, 0 to ``2 ** bits - 1``; ranks grow with values."""
    parts = df.select(ranked_value(df, column).alias("value")).distinct().repartitionByRange(1 << bits, "value")
    held = shared.save(parts.select("value", F.spark_partition_id().alias("part")), "ranks")
    kinds = held.agg((F.coalesce(F.max("part"), F.lit(0)) + 1).alias("n")).first()["n"]
    return held.select("value", F.floor(F.col("part") * F.lit(1 << bits) / F.lit(kinds)).cast("int").alias("rank"))


def interleaved(columns: Sequence[Column], bits: int = BITS) -> Column:
    """One number from several ranks, the first column's bit before the second's, high bits first."""
    n, z = len(columns), F.lit(0).cast("long")
    for b in range(bits):
        for i, c in enumerate(columns):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1)), b * n + n - 1 - i))
    return z


def write(df: DataFrame, path: str, columns: Sequence[str], files: int | None = None, group_rows: int | None = None, bits: int = BITS) -> None:
    """Write ``df`` in the order of the interleaved ranks of ``columns``; ``group_rows`` bounds the rows of a row group."""
    if not 0 < len(columns) * bits < 63:
        raise ValueError("the ranks of all columns must fit into 62 bits")
    names, out = df.columns, df
    for i, c in enumerate(columns):
        table = ranks(df, c, bits)
        small = table.count() <= BROADCAST_VALUES
        table = table.select(F.col("value").alias(f"_value{i}"), F.col("rank").alias(f"_rank{i}"))
        out = out.withColumn(f"_own{i}", ranked_value(df, c))
        out = out.join(F.broadcast(table) if small else table, F.col(f"_own{i}").eqNullSafe(F.col(f"_value{i}")), "left")
    order = [interleaved([F.col(f"_rank{i}") for i in range(len(columns))], bits), *[F.col(f"`{c}`") for c in columns]]
    ranged = out.repartitionByRange(files, *order) if files else out.repartitionByRange(*order)
    writer = ranged.sortWithinPartitions(*order).select(*[f"`{n}`" for n in names]).write.mode("overwrite")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)


def groups_read(found: DataFrame, column: str, kind: str, lo, hi) -> DataFrame:
    """(groups, read): row groups with rows by their footers, and how many a filter ``lo <= column <= hi`` cannot skip."""
    each = found.where("error is null and rows > 0").groupBy("path", "row_group").agg(*[b.alias(n) for b, n in zip(bounds(column, kind), ("lo", "hi"))])
    meets = F.coalesce((F.col("lo") <= F.lit(hi).cast(kind)) & (F.col("hi") >= F.lit(lo).cast(kind)), F.lit(True))
    return each.agg(F.count("*").alias("groups"), F.count_if(meets).alias("read"))
