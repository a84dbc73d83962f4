"""Helpers shared by the operators: the shared folder, saved tables, text columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import fresh_path, shared_dir  # noqa: F401  operators take them from here

#: ASCII white space between words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows in an Arrow batch: texts are long, and a worker holds a batch or two.
BATCH_ROWS = "1000"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, **measures: Column) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    ``rows`` of the result counts what was written, ``measured`` holds the aggregates asked for; both come
    from the write itself.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    seen = Observation()
    # the shuffle files behind a saved table are of no more use
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[c.alias(k) for k, c in measures.items()]).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    found = seen.get
    out.saved_path, out.rows, out.measured = path, found.get("_rows", 0), found
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by ``save`` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes up to which a saved table is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row in a broadcast relation: numbers of 8 bytes, short strings and digests of 40, the map's own 64."""
    kinds = [f.dataType for f in df.schema.fields]
    if any(isinstance(k, (T.ArrayType, T.MapType, T.StructType)) for k in kinds):
        raise ValueError("the size of nested columns does not follow from the row count")
    return 64 + sum(40 if isinstance(k, (T.StringType, T.BinaryType)) else 8 for k in kinds)


def if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a saved table of numbers and digests, with a broadcast hint if all its rows fit into ``limit`` bytes."""
    return F.broadcast(df) if df.rows * row_bytes(df) <= limit else df


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= int(BATCH_ROWS):
        spark.conf.set(key, BATCH_ROWS)


def released(batches: Iterator) -> Iterator:
    """The batches, with the memory that Arrow has freed meanwhile handed back before each."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        yield batch


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Select and cast the named columns, so that extra columns with clashing names do no harm."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; NULL for a NULL id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in the whole table: one aggregated row."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"]


#: Equal rows of one id part by their place from so many rows on, or from this share of a block's bytes.
HOT_ROWS, HOT_SHARE = 1000, 16


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, a hash of where each lies: of its file and its number there, so that it is the same whenever it is read.

    What does not come straight from files is saved first.
    """
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place")
    try:
        return rows.select("*", place)
    except AnalysisException:
        return save(rows, "placed").select("*", place)


def spread(rows: DataFrame, block_bytes: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` (doc_id, text and others) with ``spread``, a hash to deal them by to blocks of about ``block_bytes``.

    It is the hash of id and text, so rows that share an id, or have none, part by their texts. Equal rows of one
    id that are many are counted beforehand and part by their place in the input; there are at most
    rows / ``hot_rows`` kinds of them and ``HOT_SHARE`` for each block.
    """
    key = F.xxhash64("doc_id", "text")
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))
    many = rows.groupBy(key.alias("hot")).agg(F.count("*").alias("n"), size.alias("b"))
    hot = save(many.where((F.col("n") > 1) & ((F.col("n") > hot_rows) | (F.col("b") > block_bytes // HOT_SHARE))).select("hot"), "hot-rows")
    if not hot.rows:
        return rows.withColumn("spread", key)
    keyed = placed(rows).withColumn("spread", key)
    joined = keyed.join(if_small(hot), keyed["spread"] == hot["hot"], "left")
    return joined.withColumn("spread", F.when(F.col("hot").isNotNull(), F.xxhash64("spread", "place")).otherwise(F.col("spread"))).drop("hot", "place")
