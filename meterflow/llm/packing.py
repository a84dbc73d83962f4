"""Variable-capacity best-fit packing of documents into training sequences.

Documents are measured in words, or in the tokens of a byte-pair vocabulary (``pack_tokens``), cut into
pieces of at most the largest permitted length, and dealt to shards by hash, each small enough for one
task. Within a shard pieces go from long to short into the open bin with the least room that still fits
(best fit). When none fits, a bin of the permitted length with the least cost for each word it may still
take is opened, given what is left to place; at the end every bin shrinks to the cheapest permitted
length that holds its contents.

``pack_docs`` gives the places of the pieces, ``pack_sequences`` and ``pack_tokens`` the sequences
themselves, made in the task that packs them. A shard leaves at most a few bins part full, so more
shards cost next to nothing.

Defined results: NULL or wordless text gives one row with ``n_words`` 0 and no bin, and is in no
sequence; a NULL doc_id is carried; repeated rows are packed once each, and many equal ones are dealt by
their place in the input (which of them lies where may then differ between runs); long texts are cut, never shortened; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import SPACE, only, spread, text_bytes

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_ROWS = 20_000
SHARD_BYTES = 12 << 20
PLAN = "doc_id long, piece int, n_pieces int, first_word long, n_words int, bin_id long, capacity int, offset int, bin_used int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def default_cost(capacity: int, largest: int) -> float:
    """Cost of one sequence: a fixed overhead, its length, and attention's quadratic share."""
    return 32 + capacity + capacity * capacity / (16 * largest)


def pack(lengths: Sequence[int], capacities: Sequence[int], cost=default_cost) -> list[tuple[int, int, int, int]]:
    """(bin, offset, capacity, used) for each length, all between 1 and the largest capacity."""
    sizes = sorted(capacities)
    largest = sizes[-1]
    price = {c: cost(c, largest) for c in sizes}
    free: list[list[int]] = [[] for _ in range(largest + 1)]  # bins by room left
    some = 0  # bit r is set while a bin has r words of room
    size, used = [], []
    at: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    left = sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda j: (-lengths[j], j)):
        n = lengths[i]
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room = min((c for c in sizes if c >= n), key=lambda c: (price[c] / min(c, left), c))
            b = len(size)
            size.append(room)
            used.append(0)
        at[i] = (b, used[b])
        used[b] += n
        left -= n
        if room > n:
            free[room - n].append(b)
            some |= 1 << (room - n)
    final = [min((c for c in sizes if c >= u), key=lambda c: (price[c], c)) for u in used]
    return [(b, offset, final[b], used[b]) for b, offset in at]


def _cut(lengths: list[int], largest: int) -> list[tuple[int, int, int, int, int]]:
    """(row, piece, pieces, first word, words) of every piece; an empty row is one piece without words."""
    out = []
    for r, n in enumerate(lengths):
        pieces = max(1, -(-n // largest))
        out += [(r, p, pieces, p * largest, min(largest, n - p * largest)) for p in range(pieces)]
    return out


class _Texts:
    """The pieces of some texts by words; each word keeps the white space behind it."""

    def __init__(self, texts: list[str], largest: int):
        self.texts, self.largest, self.last, self.edges = texts, largest, None, []

    def part(self, cut: tuple[int, int, int, int, int]) -> str:
        r, p, pieces, _, _ = cut
        if pieces == 1:
            return self.texts[r]
        if self.last != r:
            starts = [m.start() for m in WORD.finditer(self.texts[r])]
            self.last, self.edges = r, [0, *starts[self.largest :: self.largest], len(self.texts[r])]
        return self.texts[r][self.edges[p] : self.edges[p + 1]]


def _planner(capacities: tuple[int, ...], cost, with_text: bool):
    largest = max(capacities)

    def plan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n", "tie"], kind="stable")
        cut = _cut(rows["n"].tolist(), largest)
        real = [i for i, c in enumerate(cut) if c[4] > 0]
        packed: list = [(None, None, None, None)] * len(cut)
        for i, found in zip(real, pack([cut[i][4] for i in real], capacities, cost)):
            packed[i] = ((int(key[0]) << 32) | found[0], *found[1:])
        ids = rows["doc_id"].tolist()
        out = pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(ids[c[0]]) else int(ids[c[0]]) for c in cut], "Int64"),
                "piece": [c[1] for c in cut],
                "n_pieces": [c[2] for c in cut],
                "first_word": [c[3] for c in cut],
                "n_words": [c[4] for c in cut],
                "bin_id": pd.array([p[0] for p in packed], "Int64"),
                "capacity": pd.array([p[2] for p in packed], "Int32"),
                "offset": pd.array([p[1] for p in packed], "Int32"),
                "bin_used": pd.array([p[3] for p in packed], "Int32"),
            }
        )
        if with_text:
            texts = _Texts(rows["text"].tolist(), largest)
            out["text"] = [texts.part(c) for c in cut]
        return out

    return plan


SEQUENCE = "bin_id long, capacity int, used int, doc_ids array<long>, pieces array<int>, offsets array<int>"


def _sequencer(capacities: tuple[int, ...], cost, encode=None):
    """Sequences of a shard, in Arrow: text with a line end between documents, or token ids."""
    largest = max(capacities)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("tie").to_numpy(), table.column("n").to_numpy(), table.column("doc_id").fill_null(-(1 << 62)).to_numpy()))
        table = table.take(pa.array(order))
        ids, texts = table.column("doc_id").to_pylist(), [t or "" for t in table.column("text").to_pylist()]
        held = [encode()(t) for t in texts] if encode else None
        cut = [c for c in _cut([len(h) for h in held] if encode else table.column("n").to_pylist(), largest) if c[4]]
        source, bins = _Texts(texts, largest), {}
        for c, (b, offset, capacity, used) in zip(cut, pack([c[4] for c in cut], capacities, cost)):
            part = held[c[0]][c[3] : c[3] + c[4]] if encode else source.part(c)
            bins.setdefault(b, (capacity, used, []))[2].append((offset, ids[c[0]], c[1], part))
        rows = [((key[0].as_py() << 32) | b, capacity, used, sorted(parts, key=lambda p: p[0])) for b, (capacity, used, parts) in bins.items()]
        out = {
            "bin_id": pa.array([r[0] for r in rows], pa.int64()), "capacity": pa.array([r[1] for r in rows], pa.int32()), "used": pa.array([r[2] for r in rows], pa.int32()),
            "doc_ids": pa.array([[p[1] for p in r[3]] for r in rows], pa.list_(pa.int64())), "pieces": pa.array([[p[2] for p in r[3]] for r in rows], pa.list_(pa.int32())),
            "offsets": pa.array([[p[0] for p in r[3]] for r in rows], pa.list_(pa.int32())),
        }
        if encode:
            out["ids"] = pa.array([[t for p in r[3] for t in p[3]] for r in rows], pa.list_(pa.int32()))
        else:
            out["text"] = pa.array(["\n".join(p[3] for p in r[3]) for r in rows], pa.string())
        return pa.table(out)

    return run


def _dealt(docs: DataFrame, with_text: bool) -> DataFrame:
    """(shard, doc_id, n, tie[, text]): rows dealt to shards by hash (``spread``)."""
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), SPACE), ""))
    base = only(docs, doc_id="long", text="string")
    if with_text:
        shards = max(1, -(-text_bytes(base) // SHARD_BYTES))
    else:
        shards = max(1, -(-base.count() // SHARD_ROWS))
    dealt = spread(base.select("doc_id", "text"), SHARD_BYTES).withColumn("n", words)
    return dealt.select(F.pmod("spread", F.lit(shards)).cast("int").alias("shard"), "doc_id", "n", F.col("spread").alias("tie"), *["text"] * with_text)


def pack_docs(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, cost=default_cost, with_text: bool = False) -> DataFrame:
    """One row per piece: which words of which document lie where in which bin."""
    schema = PLAN + ", text string" * with_text
    return _dealt(docs, with_text).groupBy("shard").applyInPandas(_planner(tuple(capacities), cost, with_text), schema)


def pack_sequences(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, cost=default_cost) -> DataFrame:
    """One row per sequence: its length, the words in it, its documents with their pieces and offsets, and its text."""
    return _dealt(docs, True).groupBy("shard").applyInArrow(_sequencer(tuple(capacities), cost), SEQUENCE + ", text string")


def pack_tokens(docs: DataFrame, path: str, capacities: Sequence[int] = CAPACITIES, cost=default_cost) -> DataFrame:
    """As ``pack_sequences``, measured in the tokens of the vocabulary at ``path``, with the token ids of each sequence."""

    def encode():
        encoder = bpe.load(path)
        return lambda text: bpe.encode_text(encoder, text)

    return _dealt(docs, True).groupBy("shard").applyInArrow(_sequencer(tuple(capacities), cost, encode), SEQUENCE + ", ids array<int>")


def bins(plan: DataFrame) -> DataFrame:
    """One row per bin: its length, what it holds, and the documents in order."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "n_words")))
    return (
        plan.where("bin_id is not null")
        .groupBy("bin_id")
        .agg(F.first("capacity").alias("capacity"), F.first("bin_used").alias("bin_used"), inside.alias("pieces"))
    )
