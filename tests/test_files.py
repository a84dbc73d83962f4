"""The committing sink of named files: what is visible after good, failed, killed and half-committed jobs."""

import json
import os
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meterflow.sources import files

ROOT = Path(__file__).resolve().parent.parent


def rows(spark, n, parts=4, body="x"):
    return spark.range(0, n, 1, parts).select(F.format_string("d%d/f%d.txt", F.col("id") % 3, "id").alias("name"), F.concat(F.lit(body), F.col("id").cast("string")).alias("body"))


def visible(path):
    """Names and bodies that a reader meets: nothing hidden."""
    top = Path(path)
    return {str(p.relative_to(top)): p.read_text() for p in sorted(top.rglob("*")) if p.is_file() and not any(x[0] in "._" for x in p.relative_to(top).parts)}


def test_a_job_makes_all_its_files_visible_at_once(spark, tmp_path):
    path = f"{tmp_path}/out"
    assert files.write_named(rows(spark, 30), path) == (30, sum(1 + len(str(i)) for i in range(30)))
    want = {f"d{i % 3}/f{i}.txt": f"x{i}" for i in range(30)}
    assert visible(path) == want and os.listdir(tmp_path) == ["out"]
    read = spark.read.option("recursiveFileLookup", True).text(path)
    assert sorted(r["value"] for r in read.collect()) == sorted(want.values())
    # kept: same names are replaced, others stay; overwritten: only the new ones are left
    assert files.write_named(rows(spark, 10, body="y"), path)[0] == 10
    assert visible(path) == want | {f"d{i % 3}/f{i}.txt": f"y{i}" for i in range(10)}
    with pytest.raises(Exception, match="is there already"):
        files.write_named(rows(spark, 40, body="z"), path, on_existing="fail")
    assert len(visible(path)) == 30 and "z0" not in visible(path).values()
    files.write_named(rows(spark, 2, body="z"), path, overwrite=True)
    assert visible(path) == {"d0/f0.txt": "z0", "d1/f1.txt": "z1"} and os.listdir(tmp_path) == ["out"]


def test_no_rows_and_odd_bodies(spark, tmp_path):
    assert files.write_named(rows(spark, 5).limit(0), f"{tmp_path}/none") == (0, 0) and visible(f"{tmp_path}/none") == {}
    odd = spark.createDataFrame([("a/é b.txt", None), ("c", bytearray(b"\x00\xff"))], "name string, body binary")
    files.write_named(odd, f"{tmp_path}/odd")
    assert (tmp_path / "odd/a/é b.txt").read_bytes() == b"" and (tmp_path / "odd/c").read_bytes() == b"\x00\xff"


@pytest.mark.parametrize("name", [None, "", "../out", "/abs", "a//b", "_hidden", "a/.b"])
def test_names_that_leave_the_folder_fail_the_job(spark, tmp_path, name):
    more = spark.createDataFrame([(name, "x")], "name string, body string")
    with pytest.raises(Exception, match="not a name below the folder"):
        files.write_named(rows(spark, 10).union(more), f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def test_one_name_for_two_rows_fails_the_job(spark, tmp_path):
    for parts in (1, 8):  # in one task, and in two
        twice = rows(spark, 20, 4).union(rows(spark, 1, 1)).repartition(parts)
        with pytest.raises(Exception, match="two rows are named"):
            files.write_named(twice, f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    files.write_named(rows(spark, 3, body="old"), f"{tmp_path}/out")
    bad = F.when(F.col("id") == 77, F.raise_error(F.lit("spoilt row"))).otherwise(F.col("id").cast("string"))
    late = spark.range(0, 100, 1, 10).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), bad.alias("body"))
    for overwrite in (False, True):
        with pytest.raises(Exception, match="spoilt row"):
            files.write_named(late, f"{tmp_path}/out", overwrite=overwrite)
    assert len(visible(f"{tmp_path}/out")) == 3 and os.listdir(tmp_path) == ["out"]


KILLED = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__
from meterflow.session import build_session
from meterflow.sources import files
spark = build_session("killed", "local[2]")
__spark_entry__._importable(spark)
def slow(batches):
    import time
    for b in batches:
        if b.column(0)[0].as_py().endswith("f15.txt"):
            time.sleep(300)
        yield b
from pyspark.sql import functions as F
df = spark.range(0, 30, 1, 2).select(F.format_string("d/f%d.txt", "id").alias("name"), F.lit("x").alias("body"))
files.write_named(df.mapInArrow(slow, "name string, body string"), {path!r})
"""


def test_a_killed_job_shows_nothing(spark, tmp_path):
    path = tmp_path / "out"
    run = subprocess.Popen([sys.executable, "-c", KILLED.format(root=str(ROOT), path=str(path))], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        ends = time.time() + 120
        while not list(tmp_path.glob("_temporary-out-*/*.names")) and run.poll() is None and time.time() < ends:
            time.sleep(0.2)
        assert run.poll() is None, "the job ended before it could be killed"
    finally:
        os.killpg(run.pid, signal.SIGKILL)
        run.wait()
    assert list(tmp_path.glob("_temporary-out-*/*/d/f0.txt"))  # one task had written its files
    assert not path.exists() and visible(tmp_path) == {}
    assert spark.read.option("recursiveFileLookup", True).format("binaryFile").load(str(tmp_path)).count() == 0
    assert files.roll_forward(spark, str(path)) == 0
    files.write_named(rows(spark, 4), str(path))  # the next job does not mind what is left
    assert len(visible(path)) == 4


def test_a_driver_that_dies_in_the_commit_is_rolled_forward(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/out"
    files.write_named(rows(spark, 3, body="old"), path)
    # the state after the journal and some renames
    job = files._Job(path, "dead")
    job.open()
    names = [f"d{i % 3}/f{i}.txt" for i in range(12)]
    for n in names:
        (tmp_path / f"_temporary-out-dead/0-0/{n}").parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"_temporary-out-dead/0-0/{n}").write_text("new")
    import pyarrow as pa

    table = pa.table({"name": names})
    with job.fs.open_output_stream(f"{job.drafts}/0-0.names") as out, pa.ipc.new_stream(out, table.schema) as held:
        held.write_table(table)
    job.each(["0-0"], job.gather)
    Path(job.whole, "_SUCCESS").write_text("{}")
    Path(job.journal).write_text(json.dumps({"path": path, "attempts": ["0-0"]}))
    for n in names[:5]:
        job.publish("0-0", n)
    assert len(visible(path)) == 5
    assert files.roll_forward(spark, path) == 1
    assert visible(path) == dict.fromkeys(names, "new") and os.listdir(tmp_path) == ["out"]
    assert files.roll_forward(spark, path) == 0


def test_a_scheme_that_only_spark_knows(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.cold.impl", "org.apache.hadoop.fs.viewfs.ViewFileSystemOverloadScheme")
    conf.set("fs.viewfs.overload.scheme.target.file.impl", "org.apache.hadoop.fs.LocalFileSystem")
    conf.set("fs.viewfs.mounttable.files.link./top", f"file://{tmp_path}")
    with pytest.raises(Exception, match="[Uu]nrecognized|scheme"):
        files.open_path("cold://files/top/a")
    assert files.resolved(spark, "cold://files/top/a/b") == f"file:{tmp_path}/a/b"
    assert files.write_named(rows(spark, 6), "cold://files/top/a")[0] == 6
    assert len(visible(tmp_path / "a")) == 6
    read = spark.read.option("recursiveFileLookup", True).text("cold://files/top/a")
    assert read.count() == 6
