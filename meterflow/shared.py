"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a single-JVM ``local`` session without it gets a temporary folder (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="meterflow-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/meterflow/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file with ``text``, all at once; False if ``path`` is there already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    goal, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = goal.getFileSystem(conf)
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":  # renaming on a local disk overwrites; a hard link does not
            os.link(fs.makeQualified(draft).toUri().getPath(), fs.makeQualified(goal).toUri().getPath())
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = spark.sparkContext._gateway.new_array(kind, 1)
            options[0] = kind.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, goal, options)
    except FileExistsError:
        return False
    except Exception as e:  # noqa: BLE001  py4j's own kind of error
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(draft, False)
    return True
