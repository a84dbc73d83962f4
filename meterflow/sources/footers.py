"""What Parquet files say about themselves: rows, ranges and schemas from footers, and files that cannot be read.

Spark lists the files, and tasks read the last bytes of each: no data page is touched, so the profile of a store
costs as much as its number of files. ``pages`` asks for more: every page of every column is then read and
checked, row group by row group, and what fails is named with its error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import open_path, resolved

#: The key under which Spark leaves its schema in a footer.
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"
STATS = "map<string, struct<lo: string, hi: string, nulls: bigint>>"
OUT = f"path string, bytes bigint, row_group int, rows bigint, stats {STATS}, schema string, error string"


def _text(value) -> str | None:
    if value is None or isinstance(value, bytes):
        return None
    return value.isoformat(sep=" ") if hasattr(value, "isoformat") and hasattr(value, "hour") else str(value)


def _group(group) -> dict:
    """Statistics of a row group by column; columns without them are left out."""
    out = {}
    for i in range(group.num_columns):
        column = group.column(i)
        s = column.statistics
        if s is not None and (s.has_min_max or s.num_values == 0):
            lo, hi = (_text(s.min), _text(s.max)) if s.has_min_max else (None, None)
            out[column.path_in_schema] = {"lo": lo, "hi": hi, "nulls": s.null_count if s.has_null_count else None}
    return out


def _read(fs, path: str, pages: bool) -> list[tuple]:
    """(row_group, rows, stats, schema) of a file; one row with group -1 where it has no row group."""
    with fs.open_input_file(path) as file:
        whole = pq.ParquetFile(file)
        meta = whole.metadata
        held = (meta.metadata or {}).get(SPARK_SCHEMA)
        schema = held.decode() if held else str(whole.schema_arrow.remove_metadata())
        if pages:
            for k in range(meta.num_row_groups):
                for batch in whole.iter_batches(row_groups=[k], batch_size=10_000):
                    batch.validate()
        groups = [(k, meta.row_group(k).num_rows, _group(meta.row_group(k)), schema) for k in range(meta.num_row_groups)]
        return groups or [(-1, 0, {}, schema)]


def _footers(seen: str, real: str, pages: bool):
    kinds = T._parse_datatype_string(OUT)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_path(real)
        for batch in batches:
            rows = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = [(*g, None) for g in _read(fs, top.rstrip("/") + path.removeprefix(seen), pages)]
                except (OSError, ValueError, pa.ArrowException) as e:
                    found = [(-1, 0, {}, None, f"{type(e).__name__}: {e}"[:500])]
                rows += [(path, size, *g) for g in found]
            columns = [pa.array([list(r[i].items()) if i == 4 else r[i] for r in rows], field.type) for i, field in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return run


def footers(spark: SparkSession, address: str, pages: bool = False, glob: str = "*.parquet") -> DataFrame:
    """(path, bytes, row_group, rows, stats, schema, error): a row for each row group, and one for each file without or with an error."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(address).select("path", "length")
    # what Spark calls the folder in the paths that it lists, and what lies behind it
    p = spark._jvm.org.apache.hadoop.fs.Path(address)
    seen = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    return listed.mapInArrow(_footers(seen, resolved(spark, address), pages), OUT)


def broken(found: DataFrame) -> DataFrame:
    """(path, bytes, error) of the files that cannot be read."""
    return found.where("error is not null").select("path", "bytes", "error")


def bounds(column: str, kind: str) -> tuple[Column, Column]:
    """Least and largest value of a column by the row groups' statistics; NULL where a row group with rows has none."""
    s, rows = F.col("stats")[column], F.col("rows") > 0
    known = F.bool_and(F.when(rows, s["lo"].isNotNull() | (s["nulls"] == F.col("rows"))))
    return F.when(known, F.min(s["lo"].cast(kind))), F.when(known, F.max(s["hi"].cast(kind)))


def profile(found: DataFrame, **columns: str) -> DataFrame:
    """One row: files, bytes, rows, broken files, and ``{c}_min`` and ``{c}_max`` of the named columns, cast to their kinds."""
    first = F.col("row_group") <= 0
    ranges = [x.alias(f"{c}_{side}") for c, kind in columns.items() for x, side in zip(bounds(c, kind), ("min", "max"))]
    return found.agg(
        F.count_if(first & F.col("error").isNull()).alias("files"), F.coalesce(F.sum(F.when(first & F.col("error").isNull(), F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("broken"), *ranges,
    )


def schemas(found: DataFrame) -> DataFrame:
    """(schema, files): the different schemas of the sound files."""
    return found.where("error is null and row_group <= 0").groupBy("schema").agg(F.count("*").alias("files"))


def merged_schema(found: DataFrame) -> T.StructType:
    """All columns of all files that Spark has written, in the order they are met; a column of two types fails."""
    out: dict[str, T.StructField] = {}
    for r in schemas(found).orderBy(F.desc("files"), "schema").collect():  # a row for each different schema
        for f in T.StructType.fromJson(json.loads(r["schema"])).fields:
            held = out.setdefault(f.name, f)
            if held.dataType != f.dataType:
                raise ValueError(f"column {f.name} is {held.dataType.simpleString()} in some files and {f.dataType.simpleString()} in others")
    return T.StructType(list(out.values()))
