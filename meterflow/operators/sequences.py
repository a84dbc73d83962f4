"""Fixed-length sequences from ordered series, as rows (seq_id, pos, ...).

Sequences multiply the data by length / stride, so ``starts`` (one row per sequence) is the lazy form
and ``windows`` expands it on demand. A row knows the sequences it belongs to from its place alone:
each row is exploded into them, which needs no join and no shuffle beyond the numbering.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import windows as W


def starts(df: DataFrame, keys: Sequence[str], length: int, stride: int, room: int = 1) -> DataFrame:
    """(keys, seq_id, start, stop) for starts 0, stride, ... with ``room`` rows after the window."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= length + room)
    last = (F.floor((F.col("_n") - length - room) / stride)).cast("long")
    out = sizes.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq_id"))
    return out.select(*keys, "seq_id", (F.col("seq_id") * stride).alias("start"), (F.col("seq_id") * stride + length).alias("stop"))


def windows(df: DataFrame, keys: Sequence[str], ts: str, length: int, stride: int, room: int = 1) -> DataFrame:
    """Rows of every strided window: seq_id and pos (0 .. length-1) beside the columns of ``df``.

    ``room`` rows must follow a window: 1 for a next-row target, 0 for none.
    """
    return _expanded(W.numbered(df, keys, ts), length, stride, room)


def _expanded(rows: DataFrame, length: int, stride: int, room: int) -> DataFrame:
    """Placed rows, once for each window that holds them."""
    r, n = F.col("_w_row"), F.col("_w_rows")
    first = F.greatest(F.lit(0), F.ceil((r - length + 1) / stride))
    last = F.least(F.floor(r / stride), F.floor((n - length - room) / stride))
    ids = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))
    out = rows.withColumn("seq_id", F.explode(ids))
    return out.withColumn("pos", (r - F.col("seq_id") * stride).cast("int")).drop("_w_row", "_w_rows")


def next_row_targets(df: DataFrame, keys: Sequence[str], ts: str, target: str, length: int, stride: int) -> DataFrame:
    """(keys, seq_id, target): the row right after each window."""
    r = F.col("_w_row")
    k = (r - length) / stride
    hit = (r >= length) & ((r - length) % stride == 0)
    return W.numbered(df, keys, ts).where(hit).select(*keys, k.cast("long").alias("seq_id"), F.col(target).alias("target"))


def shifted_targets(df: DataFrame, keys: Sequence[str], ts: str, target: str, length: int, stride: int) -> DataFrame:
    """Windows with the next row's target at each place; a window without a last target is left out."""
    ahead = W.over_places(W.numbered(df, keys, ts), lambda w: {"target": F.lead(target).over(w)}, 0, 1, keys)
    return _expanded(ahead, length, stride, room=1)


def prediction_windows(df: DataFrame, keys: Sequence[str], ts: str, context: int) -> DataFrame:
    """Full windows that do not overlap."""
    return windows(df, keys, ts, context, context, room=0)


def overlapping(df: DataFrame, keys: Sequence[str], ts: str, length: int, overlap: int) -> DataFrame:
    return windows(df, keys, ts, length, length - overlap, room=0)


def segment_length(length: int, ring: int, overlap: int) -> int:
    return (length + overlap * (ring - 1)) // ring


def ring_segments(sequences: DataFrame, length: int, ring: int, overlap: int = 0) -> DataFrame:
    """Rows of sequences, dealt to ``ring`` overlapping segments: segment and its own pos, ``seg_pos``."""
    size = segment_length(length, ring, overlap)
    step = size - overlap
    begin = [min(j * step, length - size) for j in range(ring)]
    table = F.array(*[F.struct(F.lit(j).alias("segment"), F.lit(b).alias("begin")) for j, b in enumerate(begin)])
    mine = F.filter(table, lambda s: (F.col("pos") >= s["begin"]) & (F.col("pos") < s["begin"] + size))
    out = sequences.withColumn("_s", F.explode(mine))
    return out.withColumns({"segment": F.col("_s.segment"), "seg_pos": F.col("pos") - F.col("_s.begin")}).drop("_s")


def batches(sequences: DataFrame, size: int) -> DataFrame:
    return sequences.withColumn("batch_id", F.floor(F.col("seq_id") / size).cast("long"))


def as_arrays(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per sequence: ``features array<array<float>>`` in order of pos."""
    step = F.struct("pos", F.array(*[F.col(c).cast("float") for c in columns]).alias("x"))
    return rows.groupBy(*keys, "seq_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["x"]).alias("features"))


def shuffled(sequences: DataFrame, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """A repeatable order of whole sequences, which their rows share: ``shuffle_key`` of md5 over seed, keys and seq_id."""
    parts = [F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("seq_id").cast("string")]
    return sequences.withColumn("shuffle_key", F.md5(F.concat_ws(":", *parts)))


def fit_normalizer(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std, min, max) with the population deviation, in one pass; NULL and NaN left out."""
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    stats = [F.struct(F.lit(c).alias("feature"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")) for c, v in clean.items()]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def normalize(df: DataFrame, fitted: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``{feature}_norm`` of the given (else all numeric) columns; a constant feature becomes 0, one that was not fitted NULL."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    # one map from feature to its two numbers, read by a subquery of the same query
    known = fitted.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("m")).scalar()
    scaled = {}
    for c in columns:
        r = F.try_element_at(known, F.lit(c))
        scaled[f"{c}_norm"] = F.when(r["std"] == 0, F.lit(0.0)).otherwise((F.col(c) - r["mean"]) / r["std"])
    return df.withColumns(scaled)


def split(df: DataFrame, ts: str, bounds: dict[str, tuple[str, str]], min_days: int = 0, max_overlap_days: int | None = None) -> DataFrame:
    """Adds ``split``: the name of the first range [from, to] that holds the row; other rows go.

    A range must last ``min_days``; successive ranges may share ``max_overlap_days`` (None: any number).
    """
    days = {name: [datetime.fromisoformat(x) for x in ends] for name, ends in bounds.items()}
    for name, (a, b) in days.items():
        if a > b or (b - a).days < min_days:
            raise ValueError(f"{name}: {a} to {b} is shorter than {min_days} days")
    for (one, (_, end)), (two, (begin, _)) in zip(list(days.items()), list(days.items())[1:]):
        if max_overlap_days is not None and (end - begin).days > max_overlap_days:
            raise ValueError(f"{one} and {two} share more than {max_overlap_days} days")
    out = F.lit(None).cast("string")
    for name, (a, b) in reversed(bounds.items()):
        out = F.when(F.col(ts).between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")), name).otherwise(out)
    return df.withColumn("split", out).where(F.col("split").isNotNull())


def info(df: DataFrame, keys: Sequence[str], length: int, stride: int, wanted: Sequence[str] = (), room: int = 1) -> DataFrame:
    """(keys, n_rows, n_sequences, available, missing): what the series give, and which wanted features are there."""
    n, there = F.count("*"), [c for c in wanted if c in df.columns]
    names = lambda cs: F.array(*map(F.lit, cs)) if cs else F.array().cast("array<string>")
    return df.groupBy(*keys).agg(
        n.alias("n_rows"), F.greatest(F.lit(0), F.floor((n - length - room) / stride) + 1).cast("long").alias("n_sequences"),
        names(there).alias("available"), names([c for c in wanted if c not in there]).alias("missing"),
    )
