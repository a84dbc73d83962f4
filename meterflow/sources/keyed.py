"""A store of unique rows that takes arrivals one after the other without reading itself anew.

Rows lie in buckets of a hash of their region and a span of time, as ``data/batch=B/part=P/chunk=C``; a batch is what
one append has written. For each bucket of a batch the store keeps a Bloom filter of its keys: blocks of 32,768 bits,
a key's hash choosing the block and six bits in it. Arrivals are first made unique among themselves; a key that no
filter of its bucket can hold is new, and of the store only those buckets are read that may hold one of the others; filters are read for the
buckets that arrivals fall into.
Where a stored row comes first by the order it stays; where the arriving one does, the stored row's bucket is written
again without it. So after any arrivals the store holds what ``clean.keep_first`` gives over all of them.

A batch is written before its manifest, the list of all live buckets, and the manifest before the file ``versions/N``
that makes both visible and cannot replace another: of two writers one goes again on the other's version. A killed
writer leaves files that nothing names. The driver handles bucket names only, never keys.

NULL keys are equal; rows without a time share a chunk. Names that begin with ``_k_`` belong to this module.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import keep_first
from ..shared import create_once, save

#: Bits of a block, bits a key sets, and bits of filter for each key.
BLOCK_BITS, HASHES, BITS_A_KEY = 32_768, 6, 12
MANIFEST = "batch string, part int, chunk long, rows long, blocks int"
BUCKET = ["batch", "part", "chunk"]
#: The chunk of rows without a time.
NO_TIME = -(1 << 40)


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def same(keys: Sequence[str], a: str, b: str) -> Column:
    """Equal keys of two aliased frames, NULL being equal to NULL."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def bit_places() -> Column:
    """The bits in its block that a key sets, by two hashes."""
    step = F.pmod(F.shiftright("_k_two", 17), F.lit(BLOCK_BITS // 2)) * 2 + 1
    return F.array(*[F.pmod(F.col("_k_two") + step * i, F.lit(BLOCK_BITS)) for i in range(HASHES)])


def has_bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


class KeyedStore:
    """``keys`` identify a row, ``order`` says which of two comes first; ``region`` and ``ts`` choose the bucket."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], region: str = "region", ts: str = "timestamp",
        parts: int = 16, chunk_hours: int = 24 * 28,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order, self.region, self.ts = list(keys), list(order), region, ts
        self.parts, self.chunk_hours = parts, chunk_hours
        self.read_buckets: list[str] = []  # what the last append has read of the store

    # versions --------------------------------------------------------------------------------------
    def version(self) -> int:
        """The newest version; 0 before the first."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return max([int(n) for s in (fs.listStatus(p) if fs.exists(p) else []) if (n := s.getPath().getName()).isdigit()], default=0)

    def manifest(self, version: int) -> DataFrame:
        """Live buckets with their rows and filter blocks."""
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        told = json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/versions/{version}").collect()))
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{told['manifest']}")

    def paths(self, buckets: DataFrame, kind: str = "data") -> list[str]:
        """Folders of buckets, a name each."""
        named = F.format_string("%s/%s/batch=%s/part=%d/chunk=%d", F.lit(self.path), F.lit(kind), *BUCKET)
        return sorted(r["p"] for r in buckets.select(named.alias("p")).distinct().collect())

    def _rows(self, paths: list[str]) -> DataFrame:
        """Stored rows with their bucket."""
        if not paths:
            return self.spark.createDataFrame([], self._stored())
        return self.spark.read.schema(self._stored()).option("basePath", f"{self.path}/data").parquet(*paths)

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("batch", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("chunk", T.LongType())])

    def read(self, start: str | None = None, end: str | None = None, region: str | None = None) -> DataFrame:
        """The unique rows; a range of time and a region choose buckets before any file is listed."""
        live = self.manifest(self.version())
        hours = lambda t: F.floor(F.unix_seconds(F.lit(t).cast("timestamp_ntz").cast("timestamp")) / 3600 / self.chunk_hours)
        where = [live["chunk"] >= hours(start)] * (start is not None) + [live["chunk"] <= hours(end)] * (end is not None)
        where += [live["part"] == self._part(F.lit(region))] * (region is not None)
        for w in where:
            live = live.where(w)
        rows = self._rows(self.paths(live)).select(*self.schema.fieldNames())
        at = F.col(self.ts)
        rows = rows if start is None else rows.where(at >= F.lit(start).cast("timestamp_ntz"))
        rows = rows if end is None else rows.where(at <= F.lit(end).cast("timestamp_ntz"))
        return rows if region is None else rows.where(F.col(self.region) == region)

    # appending -------------------------------------------------------------------------------------
    def _part(self, region: Column) -> Column:
        return F.pmod(F.xxhash64(region), F.lit(self.parts)).cast("int")

    def _hashed(self, rows: DataFrame) -> DataFrame:
        hour = F.unix_seconds(F.col(self.ts).cast("timestamp")) / 3600
        key = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.keys]
        return rows.select(
            *self.schema.fieldNames(), self._part(F.col(self.region)).alias("part"), F.coalesce(F.floor(hour / self.chunk_hours), F.lit(NO_TIME)).cast("long").alias("chunk"),
            F.xxhash64(*key).alias("_k_one"), F.xxhash64(F.lit(1), *key).alias("_k_two"),
        )

    def append(self, rows: DataFrame, tries: int = 5) -> int:
        """Add arrivals; returns the version that holds them."""
        unique = keep_first(rows.select(*self.schema.fieldNames()), self.keys, self.order)
        arrived = save(self._hashed(unique), "arrivals")
        for _ in range(tries):
            try:
                return self._append(arrived)
            except Conflict:
                continue
        raise Conflict(f"{tries} other writers came first")

    def _append(self, arrived: DataFrame) -> int:
        base = self.version()
        live = self.manifest(base)
        maybe = save(self._maybe(arrived, live), "maybe")
        self.read_buckets = self.paths(maybe.select(*BUCKET))
        held = self._rows(self.read_buckets).select(*self.keys, F.struct(*self.order).alias("_k_held"), *BUCKET)
        asked = maybe.select(*self.keys, F.struct(*self.order).alias("_k_new"), F.col("batch").alias("_k_batch"))
        # one row for each key and bucket that met; a key may be asked in several batches of its bucket
        met = held.alias("h").join(asked.alias("a"), same(self.keys, "h", "a") & (F.col("h.batch") == F.col("a._k_batch")))
        met = save(met.select(*[F.col(f"h.{k}").alias(k) for k in self.keys], *[F.col(f"h.{c}").alias(c) for c in BUCKET], (F.col("_k_new") < F.col("_k_held")).alias("wins")), "met")
        known = met.where("not wins").select(*self.keys).distinct()
        new = arrived.alias("n").join(known.alias("k"), same(self.keys, "n", "k"), "left_anti")
        return self._publish(base, live, new, met.where("wins"), met.where("wins"))

    def _maybe(self, arrived: DataFrame, live: DataFrame) -> DataFrame:
        """Arrivals that a bucket's filter may hold, with the batches that they are asked of."""
        touched = save(live.join(arrived.select("part", "chunk").distinct(), ["part", "chunk"], "left_semi"), "touched")
        near = arrived.join(touched.select(*BUCKET, "blocks"), ["part", "chunk"]).withColumn("block", F.pmod("_k_one", "blocks").cast("int"))
        filters = self._filters(touched)
        return near.join(filters, [*BUCKET, "block"]).where(F.forall(bit_places(), lambda p: has_bit(F.col("bits"), p))).select(*self.keys, *self.order, *BUCKET)

    def _filters(self, buckets: DataFrame) -> DataFrame:
        """The filter blocks of some buckets; no others are listed."""
        schema, paths = "block int, bits binary, batch string, part int, chunk long", self.paths(buckets, "filters")
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/filters").parquet(*paths)

    def _publish(self, base: int, live: DataFrame, new: DataFrame, beaten: DataFrame, again: DataFrame) -> int:
        """Commit ``new`` rows and the rows of the buckets ``again`` without the ``beaten`` keys as one batch, in place of those buckets."""
        batch = uuid.uuid4().hex
        again = save(again.select(*BUCKET).distinct(), "again")
        kept = self._hashed(self._rows(self.paths(again)))
        kept = kept.alias("s").join(beaten.select(*self.keys).distinct().alias("b"), same(self.keys, "s", "b"), "left_anti")
        rows = save(new.select(*kept.columns).unionByName(kept), "batch")
        rows.select(*self.schema.fieldNames(), "part", "chunk").hint("rebalance", "part", "chunk").write.partitionBy("part", "chunk").parquet(f"{self.path}/data/batch={batch}")
        blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") * BITS_A_KEY / BLOCK_BITS)).cast("int")
        sized = save(rows.groupBy("part", "chunk").agg(F.count("*").alias("rows")).withColumn("blocks", blocks), "sized")
        hashes = rows.select("part", "chunk", "_k_one", "_k_two").join(sized, ["part", "chunk"])
        bits = hashes.select("part", "chunk", F.pmod("_k_one", "blocks").cast("int").alias("block"), F.explode(bit_places()).alias("p"))
        bits.groupBy("part", "chunk", "block").agg(F.bitmap_construct_agg("p").alias("bits")).write.partitionBy("part", "chunk").parquet(f"{self.path}/filters/batch={batch}")
        stays = live.join(again, BUCKET, "left_anti")
        stays.unionByName(sized.withColumn("batch", F.lit(batch))).write.parquet(f"{self.path}/manifests/{batch}")
        if not create_once(self.spark, f"{self.path}/versions/{base + 1}", json.dumps({"manifest": batch})):
            raise Conflict(f"version {base + 1} was committed meanwhile")
        return base + 1

    def compact(self, most: int = 4) -> int:
        """Write buckets with more than ``most`` batches again as one; returns the version."""
        base = self.version()
        live = self.manifest(base)
        many = live.groupBy("part", "chunk").agg(F.count("*").alias("n")).where(F.col("n") > most)
        again = live.join(many, ["part", "chunk"], "left_semi")
        if again.isEmpty():
            return base
        none = self._hashed(self._rows([]))
        return self._publish(base, live, none, none, again)
