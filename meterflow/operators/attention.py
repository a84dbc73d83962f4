"""Causal attention over ring segments, one sequence at a time.

``ring`` deals the positions to segments (the remainder goes to the first ones), computes the pairs
(query segment, key segment) and merges them by running maximum and sum, which equals softmax over
the whole context. ``merge="sum"`` adds the separately normalised parts instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mask_counts(spark: SparkSession, positions: int, ring: int) -> DataFrame:
    """(segment, visible, total): how many key positions the queries of each segment see."""
    size = -(-positions // ring)
    q = spark.range(positions).select(F.col("id").alias("q"))
    return q.groupBy(F.floor(F.col("q") / size).cast("long").alias("segment")).agg(
        F.sum(F.col("q") + 1).cast("long").alias("visible"), (F.count("*") * positions).cast("long").alias("total")
    )


def ring_attention(x: np.ndarray, ring: int, merge: str = "logsumexp") -> np.ndarray:
    """Self-attention of (n, d) rows with queries = keys = values."""
    parts = np.array_split(np.arange(len(x)), ring)
    out = np.zeros_like(x)
    for i, q in enumerate(parts):
        if not len(q):
            continue
        top = np.full(len(q), -np.inf)
        weight, value = np.zeros(len(q)), np.zeros((len(q), x.shape[1]))
        for k in parts[: i + 1]:
            if not len(k):
                continue
            s = x[q] @ x[k].T / np.sqrt(x.shape[1])
            s = np.where(k[None, :] <= q[:, None], s, -np.inf)
            high = s.max(axis=1)
            if merge == "sum":
                e = np.exp(s - high[:, None])
                value += e @ x[k] / e.sum(axis=1, keepdims=True)
                weight[:] = 1
                continue
            new = np.maximum(top, high)
            e, scale = np.exp(s - new[:, None]), np.exp(top - new)
            value = value * scale[:, None] + e @ x[k]
            weight = weight * scale + e.sum(axis=1)
            top = new
        out[q] = value / weight[:, None]
    return out


def attend(sequences: DataFrame, ring: int, merge: str = "logsumexp") -> DataFrame:
    """(seq_id, features array<array<float>>) -> (seq_id, pos, output): rows of attention outputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, features in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                y = ring_attention(np.array(features, dtype=np.float64), ring, merge)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seq] * len(y), pa.int64()), pa.array(np.arange(len(y), dtype=np.int32)), pa.array(y.tolist(), pa.list_(pa.float64()))], ["seq_id", "pos", "output"]
                )

    return sequences.select("seq_id", "features").mapInArrow(run, "seq_id long, pos int, output array<double>")
