"""Files with given names as a committing sink: tasks write drafts, one commit makes them visible.

``bodies.write.format("named_files").option("path", folder)`` writes each ``(name, body)`` row as a file below
``folder``. A job's tasks write into a folder of drafts beside it, whose name begins with ``_`` so that no
reader lists it, each attempt apart. The commit gathers the files of the attempts that Spark has accepted and
renames them into place: as one folder where ``folder`` is new or is overwritten, so that a reader sees all of
a job or nothing; file by file under a journal where ``folder`` is kept, which ``roll_forward`` carries on
after a driver has died there. A failed job leaves no draft, a killed one only hidden ones, and a repeated or
speculative task changes nothing (what a task writes after its job was aborted stays hidden, too). ``_SUCCESS`` tells the files and bytes of the last job.

A name is relative, stays below the folder and has no hidden part; two rows with one name fail the job. The
drafts lie on the file system of ``folder``, which must be able to rename (HDFS, local and shared disks, stores with real
folders). Addresses that only Spark knows are taken to what lies behind them by ``resolved``.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Threads that rename; each has the names of its own hash, so that a name is met by one thread only.
MOVERS = 16
#: Rows that a task holds at a time while it writes.
BATCH_ROWS = 200


def open_path(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of an address such as ``file:/x``, ``hdfs://host/x``, ``s3a://bucket/x`` or ``/x``."""
    if address.startswith("file:") and not address.startswith("file://"):
        address = address.removeprefix("file:")
    for spark_name in ("s3a://", "s3n://"):
        if address.startswith(spark_name):
            address = "s3://" + address.removeprefix(spark_name)
    return pyarrow.fs.FileSystem.from_uri(address)


def resolved(spark: SparkSession, address: str) -> str:
    """What lies behind an address that only Spark's file systems know (a mount, say), also for a folder that is yet to be made."""
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    fs, rest = path.getFileSystem(spark._jsc.hadoopConfiguration()), []
    while not fs.exists(path) and path.getParent() is not None:
        rest.append(path.getName())
        path = path.getParent()
    return posixpath.join(fs.resolvePath(path).toString(), *reversed(rest))


class BadName(ValueError):
    """A name that leaves the folder, is hidden, or stands for two rows."""


def checked(name: str | None) -> str:
    parts = (name or "").split("/")
    if not all(parts) or any(p[0] in "._" for p in parts):
        raise BadName(f"not a name below the folder: {name!r}")
    return name


def _exists(fs: pyarrow.fs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound


def _write(fs: pyarrow.fs.FileSystem, path: str, body: bytes) -> None:
    with fs.open_output_stream(path) as out:
        out.write(body)


@dataclass
class Drafts(WriterCommitMessage):
    """What one accepted attempt has written; its names stand in a file beside them."""

    attempt: str
    files: int
    bytes: int


class _Job:
    """The folders of one job: drafts of attempts, and the assembled result."""

    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def open(self) -> None:
        self.fs, self.target = open_path(self.path.rstrip("/"))
        above, name = posixpath.split(self.target)
        self.drafts = f"{above}/_temporary-{name}-{self.job}"
        self.whole, self.journal = f"{self.drafts}/whole", f"{self.drafts}/journal"

    def names(self, attempt: str, mover: int) -> Iterator[str]:
        """The names of an attempt that belong to one of the movers."""
        with self.fs.open_input_stream(f"{self.drafts}/{attempt}.names") as held:
            for batch in pa.ipc.open_stream(held):
                yield from (n for n in batch.column(0).to_pylist() if zlib.crc32(n.encode()) % MOVERS == mover)

    def move(self, source: str, goal: str) -> None:
        self.fs.create_dir(posixpath.dirname(goal), recursive=True)
        self.fs.move(source, goal)

    def each(self, attempts: list[str], what) -> None:
        """``what(attempt, name)`` for all names, by threads."""

        def run(mover: int) -> None:
            for attempt in attempts:
                for name in self.names(attempt, mover):
                    what(attempt, name)

        with ThreadPoolExecutor(MOVERS) as pool:
            for done in [pool.submit(run, k) for k in range(MOVERS)]:
                done.result()

    def gather(self, attempt: str, name: str) -> None:
        goal = f"{self.whole}/{name}"
        if _exists(self.fs, goal):
            raise BadName(f"two rows are named {name}")
        self.move(f"{self.drafts}/{attempt}/{name}", goal)

    def publish(self, attempt: str, name: str) -> None:
        source = f"{self.whole}/{name}"
        if _exists(self.fs, source):  # else it was moved before the driver died
            self.move(source, f"{self.target}/{name}")

    def finish(self, attempts: list[str]) -> None:
        """Move the gathered files into a folder that is kept; can be done again from the journal."""
        self.each(attempts, self.publish)
        if _exists(self.fs, f"{self.whole}/_SUCCESS"):
            self.move(f"{self.whole}/_SUCCESS", f"{self.target}/_SUCCESS")
        self.fs.delete_dir(self.drafts)


class NamedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.keep_old = options.get("onExisting", "replace") == "fail"
        self.job = uuid.uuid4().hex

    def _open(self) -> _Job:
        job = _Job(self.path, self.job)
        job.open()
        return job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drafts:
        job, task = self._open(), TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}"
        top, seen, size, made = f"{job.drafts}/{attempt}", set(), 0, set()
        job.fs.create_dir(top, recursive=True)
        for batch in iterator:
            for k in range(batch.num_rows):
                name, body = checked(batch.column(0)[k].as_py()), batch.column(1)[k].as_py() or b""
                if name in seen:
                    raise BadName(f"two rows are named {name}")
                seen.add(name)
                folder = posixpath.dirname(f"{top}/{name}")
                if folder not in made:
                    job.fs.create_dir(folder, recursive=True)
                    made.add(folder)
                _write(job.fs, f"{top}/{name}", body)
                size += len(body)
        table = pa.table({"name": pa.array(sorted(seen), pa.string())})
        with job.fs.open_output_stream(f"{top}.names") as out, pa.ipc.new_stream(out, table.schema) as names:
            names.write_table(table, max_chunksize=10_000)
        return Drafts(attempt, len(seen), size)

    def commit(self, messages: list[Drafts | None]) -> None:
        job, done = self._open(), [m for m in messages if m is not None]
        attempts = [m.attempt for m in done]
        job.fs.create_dir(job.whole, recursive=True)
        job.each(attempts, job.gather)
        told = {"job": self.job, "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}
        _write(job.fs, f"{job.whole}/_SUCCESS", json.dumps(told).encode())
        there = _exists(job.fs, job.target)
        if there and not self.overwrite:
            if self.keep_old:
                job.each(attempts, lambda attempt, name: self._refuse(job, name))
            _write(job.fs, f"{job.journal}.draft", json.dumps({"path": self.path, "attempts": attempts}).encode())
            job.fs.move(f"{job.journal}.draft", job.journal)
            job.finish(attempts)
            return
        if there:
            job.fs.move(job.target, f"{job.drafts}/old")
        try:
            job.fs.move(job.whole, job.target)
        except OSError:
            if there:
                job.fs.move(f"{job.drafts}/old", job.target)
            raise
        job.fs.delete_dir(job.drafts)

    @staticmethod
    def _refuse(job: _Job, name: str) -> None:
        if _exists(job.fs, f"{job.target}/{name}"):
            raise FileExistsError(f"{name} is there already")

    def abort(self, messages: list[Drafts | None]) -> None:
        job, calm = self._open(), 0
        # tasks that are being ended meanwhile can still write: delete until nothing comes back
        for _ in range(40):
            if _exists(job.fs, job.journal):
                return
            if _exists(job.fs, job.drafts):
                with suppress(OSError):
                    job.fs.delete_dir(job.drafts)
                calm = 0
            elif (calm := calm + 1) > 3:
                return
            time.sleep(0.25)


class NamedFiles(DataSource):
    """The sink ``named_files``: options ``path`` and ``onExisting`` (``replace`` or ``fail``, file by file, where the folder is kept)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, body binary"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options, overwrite)


def roll_forward(spark: SparkSession, address: str) -> int:
    """Finish commits into ``address`` whose driver died while it renamed; returns their number. Drafts without a journal stay hidden."""
    path = resolved(spark, address.rstrip("/"))
    fs, target = open_path(path)
    above, name = posixpath.split(target)
    n = 0
    for found in fs.get_file_info(pyarrow.fs.FileSelector(above, allow_not_found=True)):
        begin = f"_temporary-{name}-"
        if found.base_name.startswith(begin) and _exists(fs, f"{found.path}/journal"):
            with fs.open_input_stream(f"{found.path}/journal") as held:
                journal = json.loads(held.read())
            job = _Job(path, found.base_name.removeprefix(begin))
            job.open()
            job.finish(journal["attempts"])
            n += 1
    return n


def write_named(bodies: DataFrame, address: str, overwrite: bool = False, on_existing: str = "replace") -> tuple[int, int]:
    """Write ``(name, body)`` rows as files below ``address`` in one committed job; returns files and bytes."""
    spark = bodies.sparkSession
    spark.dataSource.register(NamedFiles)
    rows = bodies.select(F.col("name").cast("string").alias("name"), F.col("body").cast("binary").alias("body"))
    path, key = resolved(spark, address), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))  # bodies are whole files
    try:
        rows.write.format("named_files").mode("overwrite" if overwrite else "append").option("path", path).option("onExisting", on_existing).save()
    finally:
        spark.conf.set(key, before)
    fs, top = open_path(path)
    with fs.open_input_stream(f"{top}/_SUCCESS") as told:
        done = json.loads(told.read())
    return done["files"], done["bytes"]
