"""Zipped CSV answers of the second source: unzipped and cut into records in tasks, split and typed by Spark.

A task reads a member in blocks of ``BLOCK`` bytes and cuts it where a line ends outside quotes, on whole arrays; no
member is held as a whole and no line is a Python object. The records go to Spark as they stand, where expressions
split them and take the fields by the place that the file's own header gives each column. Quotes come in pairs, doubled inside a quoted
field (RFC 4180); lines end with LF or CR LF; blank lines are no records; bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.windows import fill_forward
from ..schemas import GOOD_SHARES

#: Bytes of a member that a task takes at a time, and the longest record.
BLOCK, LONGEST = 1 << 20, 64 << 20
#: A field behind its comma: quoted, with doubled quotes inside, or up to the next comma.
FIELD = r',\s*("[^"]*+(?:""[^"]*+)*+"|[^,]*)'
OUT = "path string, header array<string>, record string, error string"


class BadCsv(ValueError):
    """A quoted field without an end."""


def cut(stream) -> Iterator[pa.Array]:
    """The records of a CSV stream, a string array a block; a line end inside quotes ends no record."""
    held = b""
    while True:
        block = stream.read(BLOCK)
        data = held + block
        if not data:
            return
        b = np.frombuffer(data, np.uint8)
        line = b == 10
        ends = np.flatnonzero(line & (np.cumsum(b == 34) % 2 == 0))
        if not block and (not len(ends) or ends[-1] != len(b) - 1):
            ends = np.r_[ends, len(b)]  # the last line has no end
        if not len(ends):
            if len(data) > LONGEST:
                raise BadCsv(f"a record of more than {LONGEST} bytes")
            held = data
            continue
        inside = np.ones(ends[-1], bool)  # without the ends of records, and what stands before them as CR
        inside[ends[:-1]] = False
        before = ends[ends > 0] - 1
        inside[before[b[before] == 13]] = False
        starts = np.r_[0, ends[:-1] + 1]
        kept = np.r_[0, np.cumsum(inside)]
        yield _strings(b[: ends[-1]][inside], np.r_[kept[starts], kept[-1]])
        held = data[ends[-1] + 1 :]


def _strings(body: np.ndarray, offsets: np.ndarray) -> pa.Array:
    out = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        out = pa.array([x.decode("utf-8", "replace") for x in out.cast(pa.binary()).to_pylist()], pa.string())
    return out


def _opened(content: bytes) -> tuple[io.BufferedIOBase | None, str | None]:
    """The first CSV member as a stream, or what an answer without one says."""
    if content[:2] != b"PK":
        stream = io.BytesIO(content)
    else:
        try:
            z = zipfile.ZipFile(io.BytesIO(content))
            names = z.namelist()
            csvs = [n for n in names if n.lower().endswith(".csv")]
            if not csvs:
                return None, z.read(names[0]).decode("utf-8", "replace") if names else "empty archive"
            stream = io.BufferedReader(z.open(csvs[0]), BLOCK)
        except zipfile.BadZipFile as e:
            return None, str(e)
    if (stream.getvalue()[:100] if isinstance(stream, io.BytesIO) else stream.peek(100)[:100]).lstrip()[:1] == b"<":
        return None, stream.read().decode("utf-8", "replace")
    return stream, None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ["path", "header", "record", "error"]
    for batch in batches:
        for k in range(batch.num_rows):
            path = batch.column(0)[k].as_py()
            stream, error = _opened(batch.column(1)[k].as_py())
            header = None
            for records in cut(stream) if stream else ():
                if header is None:
                    texts = records.to_pylist()
                    first = next((i for i, t in enumerate(texts) if t.strip(" \t\ufeff")), None)
                    if first is None:
                        continue
                    header = [c.strip() for c in next(csv.reader([texts[first].lstrip("\ufeff")], skipinitialspace=True))]
                    records = records.slice(first + 1)
                n = len(records)
                names = pa.array([header], pa.list_(pa.string())).take(pa.array(np.zeros(n, np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(n, np.int32))), names, records, pa.nulls(n, pa.string())], columns)
            if error is not None:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, pa.string()), pa.array([error])], columns)


def read_zipped_csv(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """(path, header, record, error): the records of each file's first CSV member below its header; XML answers are errors, with their text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
    # compressed files come to a task in batches that Spark bounds by their bytes (spark.sql.execution.arrow.maxBytesPerBatch)
    return files.mapInArrow(_records, OUT)


def error_message(xml: str = "error"):
    """Code and description of an XML error answer."""
    tag = lambda name: F.regexp_extract(F.col(xml), f"<(?:\\w+:)?{name}>([^<]*)<", 1)
    return F.struct(tag("ERR_CODE").alias("code"), tag("ERR_DESC").alias("description"))


def _cells(lines: DataFrame) -> DataFrame:
    """(path, header, cells, bad): ``bad`` where a record has more fields than the header."""
    rows = lines.where("error is null and trim(record) <> ''")
    fields = F.regexp_extract_all(F.concat(F.lit(","), "record"), F.lit(FIELD), 1)
    whole = lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    cells = F.when(F.contains("record", F.lit('"')), F.transform(fields, whole)).otherwise(F.split("record", ","))
    return rows.select("path", "header", cells.alias("cells")).withColumn("bad", F.size("cells") > F.size("header"))


def parse(lines: DataFrame, schema: str) -> DataFrame:
    """Records by the names of a DDL schema, wherever the file's own header puts them; absent columns and empty fields are NULL.

    Records with more fields than their header are left out, as ``bad_lines`` counts.
    """
    wanted = lines.sparkSession.createDataFrame([], schema).schema
    place = lambda name: F.array_position("header", F.lit(name)).cast("int")
    cell = lambda name: F.nullif(F.trim(F.when(place(name) > 0, F.get("cells", place(name) - 1))), F.lit(""))
    return _cells(lines).where(~F.col("bad")).select(*[cell(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])


def bad_lines(lines: DataFrame) -> DataFrame:
    """(path, n_lines, n_bad) of every file that is no error."""
    return _cells(lines).groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if("bad").alias("n_bad"))


def demand(rows: DataFrame, region: str = "CAISO", same_day_24: bool = False) -> DataFrame:
    """OPR_DT, OPR_HR, MW to (datetime, region, demand_mwh); negative values are left out."""
    out = rows.select(S.hour_of_day("OPR_DT", "OPR_HR", same_day_24).alias("datetime"), F.lit(region).alias("region"), S.number("MW").alias("demand_mwh"))
    return out.where(F.col("demand_mwh") >= 0)


def generation(rows: DataFrame, region: str = "CAISO", same_day_24: bool = False) -> DataFrame:
    """OPR_DT, OPR_HR, FUEL_TYPE, MW to (timestamp, fuel_type, generation_mw, region)."""
    out = rows.select(
        S.hour_of_day("OPR_DT", "OPR_HR", same_day_24).alias("timestamp"), F.lower("FUEL_TYPE").alias("fuel_type"), S.number("MW").alias("generation_mw"), F.lit(region).alias("region")
    )
    return out.where(F.col("generation_mw") >= 0)


# Report names of the second source by what they hold.
REPORTS = {"demand": "SLD_FCST", "renewables": "SLD_REN_FCST", "prices": "PRC_LMP", "generation": "ENE_SLRS"}


def report_request(kind: str, start: str, end: str, location: str | None = None) -> dict[str, str]:
    """Query parameters of one of the four reports; dates are ``yyyyMMdd`` or ISO."""
    a, b = start.replace("-", ""), end.replace("-", "")
    # the load report counts its days from 8 o'clock and knows no market run
    times = (f"{a}T08:00-0000", f"{b}T08:00-0000") if kind == "demand" else (f"{a}T00:00-0000", f"{b}T23:59-0000")
    out = {"queryname": REPORTS[kind], "startdatetime": times[0], "enddatetime": times[1], "version": "1", "resultformat": "6"}
    if kind != "demand":
        out["market_run_id"] = "RTM"
    if kind == "prices":
        if location is None:
            raise ValueError("prices need a location")
        out["node"] = location
    return out


def renewables(rows: DataFrame, region: str = "CAISO", same_day_24: bool = False) -> DataFrame:
    """OPR_DT, OPR_HR, RENEWABLE_TYPE, MW to one column per kind; solar and wind are always there, gaps are 0."""
    at = S.hour_of_day("OPR_DT", "OPR_HR", same_day_24).alias("timestamp")
    typed = rows.select(at, F.upper("RENEWABLE_TYPE").alias("kind"), S.number("MW").alias("mw"))
    cells = [F.coalesce(F.min(F.when(F.col("kind") == code, F.col("mw"))), F.lit(0.0)).alias(f"{name}_mw") for name, code in GOOD_SHARES.items()]
    return typed.groupBy("timestamp").agg(*cells).withColumn("region", F.lit(region))


def prices(rows: DataFrame, location: str | None = None, same_day_24: bool = False) -> DataFrame:
    """OPR_DT, OPR_HR, NODE, LMP_TYPE, MW to one row per node and hour; hours without a price go."""
    at = S.hour_of_day("OPR_DT", "OPR_HR", same_day_24).alias("timestamp")
    typed = rows.select(at, F.col("NODE").alias("location"), F.upper("LMP_TYPE").alias("kind"), S.number("MW").alias("price"))
    if location is not None:
        typed = typed.where(F.col("location") == location)
    kinds = {"LMP": "lmp", "MCE": "energy", "MCC": "congestion", "MCL": "loss"}
    cells = [F.min(F.when(F.col("kind") == code, F.col("price"))).alias(f"{name}_price") for code, name in kinds.items()]
    return typed.groupBy("timestamp", "location").agg(*cells).dropna(subset=["lmp_price"])


def together(demand_: DataFrame, renewables_: DataFrame, prices_: DataFrame) -> DataFrame:
    """Demand with renewables and prices of the same hour, forward filled, then 0."""
    d = demand_.withColumnRenamed("datetime", "timestamp")
    out = d.join(renewables_.drop("region"), "timestamp", "left").join(prices_.drop("location"), "timestamp", "left")
    values = [c for c in out.columns if c not in ("timestamp", "region")]
    return fill_forward(out, values, "region", "timestamp").fillna(0.0, subset=values)
