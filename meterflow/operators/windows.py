"""Lags, rolling statistics, gaps, fills and flags over ordered series of any length.

No operator gathers a whole series in one task. Row frames run in blocks of ``BLOCK_ROWS`` rows, each
read with a halo of the rows its frames look at (``over_rows``); blocks are cut by a row's place in its
series, so gaps in time change nothing. Places come from time chunks: rows are counted within a chunk,
and a prefix sum over the short table of chunks gives what lies before it (``numbered``). Fills carry
one boundary value per chunk in the same way. Statistics of a whole series are aggregates joined back.

Functions that take ``w`` give column expressions over any window; functions that take ``df`` bring
their own bounded windows. Names that begin with ``_w_`` belong to this module.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S

LAGS = (1, 2, 3, 6, 12, 24, 48, 168)
ROLLS = (3, 6, 12, 24, 48, 168)
#: Hours (or units of a numeric order column) in a chunk, and rows in a block.
CHUNK_HOURS, BLOCK_ROWS = 24 * 28, 4096


def series(region: str | Sequence[str] = "region", ts: str = "timestamp") -> WindowSpec:
    """One window per series, for series that are known to be short."""
    return Window.partitionBy(*_keys(region)).orderBy(ts)


def _keys(region: str | Sequence[str]) -> list[str]:
    return [region] if isinstance(region, str) else list(region)


# places --------------------------------------------------------------------------------------------
def in_chunks(df: DataFrame, ts: str, chunk_hours: float = CHUNK_HOURS) -> DataFrame:
    """Adds ``_w_chunk``, which grows with ``ts``; NULL times are the first chunk."""
    number = isinstance(df.schema[ts].dataType, T.NumericType)
    at = F.col(ts) if number else F.unix_seconds(F.col(ts).cast("timestamp")) / 3600
    return df.withColumn("_w_chunk", F.floor(at / chunk_hours))


def join_small(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys``, NULL keys being equal; adaptive execution broadcasts ``table`` while it is small."""
    renamed = table.withColumnsRenamed({k: f"_w_key_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_w_key_{k}")) for k in keys]
    joined = rows.join(renamed, reduce(lambda a, b: a & b, on), "left") if on else rows.join(renamed, how="left")
    return joined.drop(*[f"_w_key_{k}" for k in keys])


def numbered(df: DataFrame, region: str | Sequence[str] = "region", ts: str = "timestamp", chunk_hours: float = CHUNK_HOURS) -> DataFrame:
    """Adds ``_w_row``, the place in the series from 0, and ``_w_rows``, the length of the series."""
    keys = _keys(region)
    rows = in_chunks(df, ts, chunk_hours)
    local = Window.partitionBy(*keys, "_w_chunk").orderBy(ts)
    sizes = rows.groupBy(*keys, "_w_chunk").agg(F.count("*").alias("_w_size"))
    before = Window.partitionBy(*keys).orderBy("_w_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys, "_w_chunk", F.coalesce(F.sum("_w_size").over(before), F.lit(0)).alias("_w_before"), F.sum("_w_size").over(Window.partitionBy(*keys)).alias("_w_rows")
    )
    placed = join_small(rows.withColumn("_w_local", F.row_number().over(local) - 1), sizes, [*keys, "_w_chunk"])
    return placed.withColumn("_w_row", F.col("_w_before") + F.col("_w_local")).drop("_w_chunk", "_w_local", "_w_before")


def over_places(
    placed: DataFrame, new: Callable[[WindowSpec], dict[str, Column]], back: int, ahead: int = 0, region: str | Sequence[str] = "region", block_rows: int = BLOCK_ROWS,
    steps: Sequence[Callable[[WindowSpec], dict[str, Column]]] = (),
) -> DataFrame:
    """``over_rows`` for rows that ``numbered`` has placed; the place stays."""
    r = F.col("_w_row")
    blocks = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((r - ahead) / block_rows)), F.floor((r + back) / block_rows))
    spread = placed.withColumn("_w_own", F.floor(r / block_rows)).withColumn("_w_block", F.explode(blocks))
    w = Window.partitionBy(*_keys(region), "_w_block").orderBy("_w_row")
    out = spread
    for step in steps:
        out = out.select("*", *[c.alias(name) for name, c in step(w).items()])
    out = out.select("*", *[c.alias(name) for name, c in new(w).items()]).where("_w_own = _w_block")
    return out.drop("_w_own", "_w_block", *[c for c in out.columns if c.startswith("_w_of_")])


def over_rows(
    df: DataFrame, new: Callable[[WindowSpec], dict[str, Column]], back: int, ahead: int = 0, region: str | Sequence[str] = "region", ts: str = "timestamp",
    block_rows: int = BLOCK_ROWS, chunk_hours: float = CHUNK_HOURS, steps: Sequence[Callable[[WindowSpec], dict[str, Column]]] = (),
) -> DataFrame:
    """``df`` with the columns that ``new(w)`` names, for frames of up to ``back`` rows before and ``ahead`` after a row.

    The result is that of one window per series: every block holds the halo that its frames look at. ``steps``
    come first, each on the columns of those before it; what they name with ``_w_of_`` is dropped at the end.
    """
    placed = numbered(df, region, ts, chunk_hours)
    return over_places(placed, new, back, ahead, region, block_rows, steps).drop("_w_row", "_w_rows")


# row frames ----------------------------------------------------------------------------------------
def full(value: Column, fn, w, n: int) -> Column:
    """fn over the last n rows; NULL until n non-NULL values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, fn(value).over(frame))


STATISTICS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def ladder(windows: Sequence[int]) -> list[tuple[int, int, int]]:
    """(size, a, b) with size = a + b: how windows are put together from shorter ones, beginning with single rows."""
    have, out = [1], []
    for n in sorted({*windows} - {1}):
        now = have[-1]
        while now < n:
            more = max(h for h in have if h <= n - now)
            out.append((now + more, now, more))
            now += more
            have.append(now)
    return out


def _of(c: str, n: int) -> str:
    return f"_w_of_{n}_{c}"


def ladder_steps(columns: Sequence[str], windows: Sequence[int]) -> list[Callable[[WindowSpec], dict[str, Column]]]:
    """Steps for ``over_rows`` that give every window's statistics by a lag a rung, so that time grows with the number of rungs.

    A frame of n rows costs Spark n updates for each row and aggregate, min and max most of all. Here the last ``a + b`` rows
    of a row are its last ``a`` and the ``b`` before them, which the row ``a`` places earlier has: sums are added, squares
    merged about both means, extremes compared. NULL where a value is missing, as ``full``.
    """

    def single(w: WindowSpec) -> dict[str, Column]:
        one = lambda v: F.struct(v.cast("double").alias("s"), F.lit(0.0).alias("q"), v.alias("lo"), v.alias("hi"))
        return {_of(c, 1): F.when(F.col(c).isNotNull(), one(F.col(c))) for c in columns}

    def rung(a: int, b: int) -> tuple[Callable, Callable]:
        def earlier(w: WindowSpec) -> dict[str, Column]:
            return {f"_w_of_back_{c}_{a}_{b}": F.lag(_of(c, b), a).over(w) for c in columns}

        def together(w: WindowSpec) -> dict[str, Column]:
            out = {}
            for c in columns:
                x, y = F.col(_of(c, a)), F.col(f"_w_of_back_{c}_{a}_{b}")
                apart = y["s"] / b - x["s"] / a
                both = F.struct(
                    (x["s"] + y["s"]).alias("s"), (x["q"] + y["q"] + apart * apart * (a * b / (a + b))).alias("q"),
                    F.least(x["lo"], y["lo"]).alias("lo"), F.greatest(x["hi"], y["hi"]).alias("hi"),
                )
                out[_of(c, a + b)] = F.when(x.isNotNull() & y.isNotNull(), both)
            return out

        return earlier, together

    return [single, *[step for _, a, b in ladder(windows) for step in rung(a, b)]]


def laddered(c: str, statistic: str, n: int) -> Column:
    """A statistic of the last n rows, from the rungs of ``ladder_steps``."""
    x = F.col(_of(c, n))
    if statistic == "std":
        return F.sqrt(x["q"] / (n - 1)) if n > 1 else F.lit(None).cast("double")
    return {"mean": x["s"] / n, "min": x["lo"], "max": x["hi"]}[statistic]


def lag_columns(columns: Sequence[str], lags: Sequence[int], w) -> dict[str, Column]:
    return {f"{c}_lag_{k}h": F.lag(c, k).over(w) for c in columns for k in lags}


def rolling_columns(columns: Sequence[str], windows: Sequence[int]) -> dict[str, Column]:
    """From the rungs of ``ladder_steps``."""
    return {f"{c}_rolling_{name}_{n}h": laddered(c, name, n) for c in columns for n in windows for name in STATISTICS}


def add_lags(df: DataFrame, columns: Sequence[str], lags: Sequence[int] = LAGS, region: str = "region", ts: str = "timestamp", **blocks) -> DataFrame:
    """Absent columns are left out."""
    there = [c for c in columns if c in df.columns]
    return over_rows(df, lambda w: lag_columns(there, lags, w), max(lags), region=region, ts=ts, **blocks)


def add_rolling(df: DataFrame, columns: Sequence[str], windows: Sequence[int] = ROLLS, region: str = "region", ts: str = "timestamp", **blocks) -> DataFrame:
    there = [c for c in columns if c in df.columns]
    return over_rows(df, lambda w: rolling_columns(there, windows), max(windows) - 1, region=region, ts=ts, steps=ladder_steps(there, windows), **blocks)


def ramp(c: str, w) -> Column:
    return F.col(c) - F.lag(c).over(w)


def growth(c: str, k: int, w) -> Column:
    """Percent change over k rows."""
    return S.ratio(F.col(c) - F.lag(c, k).over(w), F.lag(c, k).over(w)) * 100


def rolling_zscore(c: str, n: int, w) -> Column:
    return S.ratio(F.col(c) - full(F.col(c), F.avg, w, n), full(F.col(c), F.stddev_samp, w, n))


def is_peak(c: str, n: int, w) -> Column:
    return F.col(c) == full(F.col(c), F.max, w, n)


def rolling_cv(c: str, n: int, w) -> Column:
    return S.ratio(full(F.col(c), F.stddev_samp, w, n), full(F.col(c), F.avg, w, n))


# frames in time ------------------------------------------------------------------------------------
def with_halo(df: DataFrame, ts: str, chunk_hours: int, halo_hours: int) -> DataFrame:
    """Each row in its time chunk, and again as ``_halo`` in the next chunks that look back on it."""
    hour = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 3600)
    chunk = F.floor(hour / chunk_hours)
    last = F.floor((hour + halo_hours) / chunk_hours)
    out = df.withColumn("_own", chunk).withColumn("_chunk", F.explode(F.sequence(chunk, last)))
    return out.withColumn("_halo", F.col("_own") != F.col("_chunk"))


def rolling_in_chunks(df: DataFrame, column: str, n: int, chunk_hours: int = CHUNK_HOURS, region: str = "region", ts: str = "timestamp") -> DataFrame:
    """Rolling mean and std of a gap-free hourly series, whose places follow from time alone: one shuffle."""
    w = series([region, "_chunk"], ts)
    v = F.col(column)
    rolled = with_halo(df, ts, chunk_hours, n - 1).select(
        "*", full(v, F.avg, w, n).alias(f"{column}_rolling_mean_{n}h"), full(v, F.stddev_samp, w, n).alias(f"{column}_rolling_std_{n}h")
    )
    return rolled.where(~F.col("_halo")).drop("_own", "_chunk", "_halo")


def timed(df: DataFrame, fns: dict[str, tuple[str, Callable]], hours: int, region: str = "region", ts: str = "timestamp", chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """``{name: (column, fn)}``: fn over the last ``hours`` hours of time instead of rows; NULL times are left out."""
    epoch = F.unix_seconds(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(region, "_chunk").orderBy(epoch).rangeBetween(-(hours - 1) * 3600, 0)
    out = with_halo(df, ts, chunk_hours, hours - 1).select("*", *[fn(c).over(w).alias(name) for name, (c, fn) in fns.items()])
    return out.where(~F.col("_halo")).drop("_own", "_chunk", "_halo")


# gaps and fills ------------------------------------------------------------------------------------
def gap_hours(ts: str, w) -> Column:
    return F.timestamp_diff("HOUR", F.lag(ts).over(w), F.col(ts))


def gap_report(df: DataFrame, region: str = "region", ts: str = "timestamp", limit: float = 1.5, chunk_hours: float = CHUNK_HOURS) -> DataFrame:
    """(region, n_gaps, max_gap_hours): gaps within chunks, and those between one chunk's end and the next one's start."""
    rows = in_chunks(df.select(region, ts), ts, chunk_hours)
    inner = rows.withColumn("_w_gap", gap_hours(ts, Window.partitionBy(region, "_w_chunk").orderBy(ts)))
    chunks = inner.groupBy(region, "_w_chunk").agg(
        F.count_if(F.col("_w_gap") > limit).alias("_w_n"), F.max("_w_gap").alias("_w_most"), F.min(ts).alias("_w_first"), F.max(ts).alias("_w_last")
    )
    between = F.timestamp_diff("HOUR", F.lag("_w_last").over(Window.partitionBy(region).orderBy("_w_chunk")), F.col("_w_first"))
    joints = chunks.withColumn("_w_gap", between)
    return joints.groupBy(region).agg(
        (F.sum("_w_n") + F.count_if(F.col("_w_gap") > limit)).alias("n_gaps"),
        F.coalesce(F.greatest(F.max("_w_most"), F.max("_w_gap")), F.lit(0)).cast("long").alias("max_gap_hours"),
    )


def forward_fill(c: str, w) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def _known(columns: Sequence[str], ts: str) -> dict[str, Column]:
    """Value and time of each column where it is known, under one name each."""
    return {c: F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v"))) for c in columns}


def _beside(df: DataFrame, columns: Sequence[str], region: str | Sequence[str], ts: str, chunk_hours: float, both: bool) -> DataFrame:
    """Adds ``_w_back_{c}`` and, with ``both``, ``_w_next_{c}``: time and value of the nearest known rows up to and from each row."""
    keys = _keys(region)
    rows, known = in_chunks(df, ts, chunk_hours), _known(columns, ts)
    ends = rows.groupBy(*keys, "_w_chunk").agg(
        *[F.max(k).alias(f"_w_last_{c}") for c, k in known.items()], *([F.min(k).alias(f"_w_first_{c}") for c, k in known.items()] if both else [])
    )
    order = Window.partitionBy(*keys).orderBy("_w_chunk")
    past, future = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    carried = [F.last(f"_w_last_{c}", ignorenulls=True).over(past).alias(f"_w_in_{c}") for c in columns]
    carried += [F.first(f"_w_first_{c}", ignorenulls=True).over(future).alias(f"_w_out_{c}") for c in columns] if both else []
    local = Window.partitionBy(*keys, "_w_chunk").orderBy(ts)
    up, on = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(0, Window.unboundedFollowing)
    near = {f"_w_here_{c}": F.last(k, ignorenulls=True).over(up) for c, k in known.items()}
    near |= {f"_w_ahead_{c}": F.first(k, ignorenulls=True).over(on) for c, k in known.items()} if both else {}
    joined = join_small(rows.select("*", *[v.alias(n) for n, v in near.items()]), ends.select(*keys, "_w_chunk", *carried), [*keys, "_w_chunk"])
    found = {f"_w_back_{c}": F.coalesce(f"_w_here_{c}", f"_w_in_{c}") for c in columns}
    found |= {f"_w_next_{c}": F.coalesce(f"_w_ahead_{c}", f"_w_out_{c}") for c in columns} if both else {}
    return joined.select(*df.columns, *[v.alias(n) for n, v in found.items()])


def fill_forward(df: DataFrame, columns: Sequence[str], region: str | Sequence[str] = "region", ts: str = "timestamp", chunk_hours: float = CHUNK_HOURS) -> DataFrame:
    """The last known value of each column; NULL before the first one."""
    out = _beside(df, columns, region, ts, chunk_hours, both=False)
    filled = {c: F.col(f"_w_back_{c}.v").alias(c) for c in columns}
    return out.select(*[filled.get(c, F.col(c)) for c in df.columns])


def fill_linear(df: DataFrame, columns: Sequence[str], region: str | Sequence[str] = "region", ts: str = "timestamp", chunk_hours: float = CHUNK_HOURS) -> DataFrame:
    """Linear in time between the nearest known values; NULL before the first and after the last."""
    out = _beside(df, columns, region, ts, chunk_hours, both=True)
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    between = {}
    for c in columns:
        a, b = F.col(f"_w_back_{c}"), F.col(f"_w_next_{c}")
        share = S.ratio((seconds(F.col(ts)) - seconds(a["t"])).cast("double"), seconds(b["t"]) - seconds(a["t"]))
        between[c] = F.coalesce(F.col(c), a["v"] + (b["v"] - a["v"]) * share).alias(c)
    return out.select(*[between.get(c, F.col(c)) for c in df.columns])


# statistics of whole series ------------------------------------------------------------------------
def with_statistics(df: DataFrame, region: str | Sequence[str] = "region", **statistics: Column) -> DataFrame:
    """Aggregates of each series joined to its rows: partial sums are shuffled, never the rows of a series."""
    keys = _keys(region)
    return join_small(df, df.groupBy(*keys).agg(*[c.alias(name) for name, c in statistics.items()]), keys)


def shares_of_max(df: DataFrame, columns: dict[str, str], region: str | Sequence[str] = "region") -> DataFrame:
    """``{name: column}``: the column over its largest value in the series."""
    out = with_statistics(df, region, **{f"_w_max_{c}": F.max(c) for c in set(columns.values())})
    return out.select(*df.columns, *[S.ratio(c, f"_w_max_{c}").alias(name) for name, c in columns.items()])


def impute(df: DataFrame, columns: Sequence[str], region: str = "region", ts: str = "timestamp", chunk_hours: float = CHUNK_HOURS) -> DataFrame:
    """Forward fill, then the region's mean for what leads the series."""
    means = df.groupBy(region).agg(*[F.avg(c).alias(f"_w_mean_{c}") for c in columns])
    out = join_small(fill_forward(df, columns, region, ts, chunk_hours), means, [region])
    return out.select(*[F.coalesce(c, f"_w_mean_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def zscore_flags(df: DataFrame, columns: Sequence[str], region: str = "region", limit: float = 3.0) -> DataFrame:
    """``{c}_anomaly``: further than ``limit`` sample deviations from the region's mean."""
    stats = {f"_w_mean_{c}": F.avg(c) for c in columns} | {f"_w_std_{c}": F.stddev_samp(c) for c in columns}
    z = lambda c: S.ratio(F.col(c) - F.col(f"_w_mean_{c}"), f"_w_std_{c}")
    return with_statistics(df, region, **stats).select(*df.columns, *[F.coalesce(F.abs(z(c)) > limit, F.lit(False)).alias(f"{c}_anomaly") for c in columns])
