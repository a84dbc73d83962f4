"""Size-tiered compaction of a growing dataset, committed through versioned manifests.

A dataset is a folder with ``shards/`` (immutable Parquet folders), ``manifests/`` (one JSON file per
version) and ``leases/``. Readers see exactly the shards that a manifest names. A commit publishes the
file of the next version by a primitive that refuses an existing target: a hard link on a local disk, a
rename without overwriting elsewhere (atomic on HDFS; an object store must offer such a rename). Only one
writer gets a version; the loser re-reads the manifest and tries again. Nothing that a manifest names is
ever changed.

Arrivals are appended as small shards. Compaction sorts shards into tiers by the power of ``ratio``
of their bytes and merges a tier once it holds ``min_merge`` shards, each time into files of about
``target_bytes``; a shard that has reached the target is left alone. The bookkeeping is one short
row per shard on the driver; the rows themselves are read, dealt out and written by Spark.

A writer leaves a lease before it writes a shard and takes it away after the commit, so ``vacuum`` never
deletes what is about to be committed; a lease of a writer that died ends after ``lease_seconds``.

Every shard's schema stands in the manifest. Arrivals may differ in their columns: a column that a shard
lacks is NULL there, numbers widen, and compaction keeps all columns. An arrival whose column has a type
that cannot be merged is refused: before anything is written where the dataset has that column already, and
in the commit itself where another writer has brought it meanwhile (what was written is deleted again). Names
are compared by the session's rule for their case.

Defined results: rows are kept as they are (NULLs, empty or very long texts, repeated rows, extra
columns, whatever their names); an empty arrival commits no shard; reading a dataset without shards needs
a schema; a version that was vacuumed is an error. ``read`` adds the shard of each row as ``_shard``, or
under a longer name where a column is called so. Rows of a merged shard are dealt round robin, so no key
or source can fill one task.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import unused


@dataclass(frozen=True)
class Shard:
    name: str
    rows: int
    bytes: int
    files: int
    born: int  # the version that added it
    schema: str = ""  # as JSON


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class VersionGone(LookupError):
    """The version was vacuumed, or never was."""


class SchemaConflict(ValueError):
    """A column of an arrival cannot be merged with the dataset's."""


class TieredDataset:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, ratio: float = 4.0, min_merge: int = 4, lease_seconds: float = 24 * 3600):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.ratio, self.min_merge = target_bytes, ratio, min_merge
        self._jvm = spark._jvm
        root = self._path("")
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.lease_seconds = lease_seconds
        for folder in ("manifests", "shards", "leases"):
            self._fs.mkdirs(self._path(folder))

    def _path(self, tail: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tail}" if tail else self.path)

    # manifests -----------------------------------------------------------------------------------
    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """(version, shards); version 0 is the empty dataset."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, []
        try:
            stream = self._fs.open(self._path(f"manifests/v{version:08d}.json"))
        except Py4JJavaError as e:
            raise VersionGone(f"version {version} is not there") from e
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Shard(**s) for s in json.loads(text)["shards"]]

    def _commit(self, version: int, shards: list[Shard]) -> None:
        """Publish one version: written beside, then given a name that must not exist yet."""
        body = json.dumps({"version": version, "shards": [asdict(s) for s in shards]}, indent=1)
        draft = self._path(f"manifests/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        final = self._path(f"manifests/v{version:08d}.json")
        try:
            self._name(draft, final)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            raise CommitConflict(f"version {version} exists") from e
        finally:
            self._fs.delete(draft, False)

    def _name(self, draft, final) -> None:
        """Give a written file its name; fails if a file has it."""
        if self._fs.getScheme() == "file":
            at = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(at(self._fs.makeQualified(final)), at(self._fs.makeQualified(draft)))
            return
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        uri = self._fs.makeQualified(final).toUri()
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), none)

    def _publish(self, change) -> int:
        """Apply ``change(version, shards) -> shards`` to the newest manifest, again after a lost race."""
        while True:
            version, shards = self.manifest()
            try:
                self._commit(version + 1, change(version + 1, shards))
                return version + 1
            except CommitConflict:
                continue

    # writing -------------------------------------------------------------------------------------
    def _write(self, df: DataFrame) -> Shard:
        """Write one shard under a lease, which ``_release`` ends."""
        name = uuid.uuid4().hex
        self._fs.create(self._path(f"leases/{name}"), True).close()
        where = f"{self.path}/shards/{name}"
        df.write.parquet(where)
        files = [s for s in self._fs.listStatus(self._path(f"shards/{name}")) if s.getPath().getName().startswith("part-")]
        rows = self.spark.read.schema(df.schema).parquet(where).count() if files else 0
        return Shard(name, rows, sum(s.getLen() for s in files), len(files), 0, df.schema.json())

    def _release(self, shard: Shard) -> None:
        self._fs.delete(self._path(f"leases/{shard.name}"), False)

    def _born(self, shard: Shard, version: int) -> Shard:
        return Shard(**asdict(shard) | {"born": version})

    def append(self, df: DataFrame) -> int:
        """Write one arrival as an immutable shard and commit it; returns the version."""
        self._check(self.manifest()[1], df.schema)
        shard = self._write(df)

        def add(v: int, shards: list[Shard]) -> list[Shard]:
            self._check(shards, df.schema)  # another writer may have brought a column meanwhile
            return [*shards, self._born(shard, v)]

        try:
            if not shard.rows:
                self._fs.delete(self._path(f"shards/{shard.name}"), True)
                return self.manifest()[0]
            return self._publish(add)
        except SchemaConflict:
            self._fs.delete(self._path(f"shards/{shard.name}"), True)
            raise
        finally:
            self._release(shard)

    def _check(self, shards: list[Shard], schema: StructType) -> None:
        """SchemaConflict where ``schema`` cannot be read together with the shards'."""
        try:
            self._together([*self._schemas(shards), schema])
        except AnalysisException as e:
            raise SchemaConflict(str(e)) from e

    def tier(self, shard: Shard) -> int:
        return int(math.log(max(shard.bytes, 1), self.ratio))

    def candidates(self, shards: list[Shard]) -> list[Shard]:
        """The smallest tier that is due: at least ``min_merge`` shards below the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes:
                tiers.setdefault(self.tier(s), []).append(s)
        due = [t for t, members in tiers.items() if len(members) >= self.min_merge]
        return tiers[min(due)] if due else []

    def compact(self) -> int:
        """Merge due tiers until none is left; returns the newest version."""
        while runs := self.candidates(self.manifest()[1]):
            gone = {s.name for s in runs}
            merged = self.read_shards(runs)
            files = max(1, round(sum(s.bytes for s in runs) / self.target_bytes))
            new = self._write(merged.repartition(files) if files > 1 else merged.coalesce(1))
            if new.rows != sum(s.rows for s in runs):
                raise RuntimeError(f"compaction read {new.rows} of {sum(s.rows for s in runs)} rows")

            def swap(v: int, shards: list[Shard]) -> list[Shard]:
                if not gone <= {s.name for s in shards}:  # another compaction took some of them
                    return shards
                return [*(s for s in shards if s.name not in gone), self._born(new, v)]

            try:
                self._publish(swap)
            finally:
                self._release(new)
        return self.manifest()[0]

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete older manifests than the newest ``keep_versions`` and the shards that none of these names; returns how many.

        Shards are listed first, then leases, then manifests: a shard without a lease was committed before
        the manifests are read, or never will be.
        """
        found = [s.getPath() for s in self._fs.listStatus(self._path("shards"))]
        now, leased = time.time(), set()
        for s in self._fs.listStatus(self._path("leases")):
            if now - s.getModificationTime() / 1000 < self.lease_seconds:
                leased.add(s.getPath().getName())
            else:
                self._fs.delete(s.getPath(), False)
        versions = self.versions()
        live = {s.name for v in versions[-keep_versions:] for s in self.manifest(v)[1]}
        for v in versions[:-keep_versions]:
            self._fs.delete(self._path(f"manifests/v{v:08d}.json"), False)
        gone = [p for p in found if p.getName() not in live | leased]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    # reading -------------------------------------------------------------------------------------
    def _schemas(self, shards: list[Shard]) -> list[StructType]:
        return [StructType.fromJson(json.loads(text)) for text in dict.fromkeys(s.schema for s in shards)]

    def _together(self, schemas: list[StructType]) -> StructType:
        """All columns of some schemas, each wide enough; AnalysisException where there is no such type."""
        out = self.spark.createDataFrame([], schemas[0])
        fold = str if self.spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower  # as a union matches names
        for schema in schemas[1:]:
            mine = {fold(f.name): f.dataType for f in out.schema.fields}
            for f in schema.fields:
                held = mine.get(fold(f.name))
                if held is not None and held != f.dataType and "string" in (held.simpleString(), f.dataType.simpleString()):
                    raise AnalysisException(f"column {f.name} is {held.simpleString()} here and {f.dataType.simpleString()} there")
            out = out.unionByName(self.spark.createDataFrame([], schema), allowMissingColumns=True)
        return out.schema

    def read_shards(self, shards: list[Shard], shard_column: str | None = None) -> DataFrame:
        """The rows of some shards with all their columns; shards of one schema are one scan."""
        parts: dict[str, list[str]] = {}
        for s in shards:
            parts.setdefault(s.schema, []).append(f"{self.path}/shards/{s.name}")
        out = None
        for schema, paths in parts.items():
            df = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths)
            if shard_column:
                file = df.metadataColumn("_metadata")["file_path"]  # the file's, whatever the columns are called
                df = df.withColumn(shard_column, F.element_at(F.split(file, "/"), -2))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """The rows of one version, with ``_shard``: the shard each row lies in."""
        _, shards = self.manifest(version)
        if not shards:
            if schema is None:
                raise ValueError("the dataset has no shard; give a schema")
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn(unused(empty, "_shard"), F.lit(None).cast("string"))
        whole = self.spark.createDataFrame([], self._together(self._schemas(shards)))
        return self.read_shards(shards, unused(whole, "_shard"))


def arrivals(docs: DataFrame, n: int, key: str = "doc_id") -> list[DataFrame]:
    """``docs`` as ``n`` arrivals by ranges of ``key``, which Parquet statistics prune on reading."""
    lo, hi = docs.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return [docs]
    step = max(1, -(-(hi - lo + 1) // n))
    cuts = [lo + i * step for i in range(n + 1)]
    c = F.col(key)
    parts = [docs.where((c >= a) & (c < b)) for a, b in zip(cuts, cuts[1:])]
    return [*parts, docs.where(c.isNull())]
