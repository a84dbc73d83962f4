"""Repeated passages across documents with a sparse suffix array over words.

Only suffixes that start at a minimiser are retained: in every ``WINDOW`` successive starts the one
with the least hash of its first ``SEED`` words. Two documents that share ``SEED + WINDOW - 1`` = 50
words share the minimiser of that passage, so its suffixes meet. Suffixes are ordered by doubling, as
suffix arrays are built: first by their ``SEED`` words, then by all words of the windows of 50 that hold
the seed, each word standing for its hash. Within the run of one seed equal orders are neighbours. Where
the whole run is of one order, every member agrees with the earliest (least doc_id, then place) as far as
any window reaches, and is compared with it alone: successive matches against the same place join to one
stretch (as SEED > WINDOW no word between them is left unchecked), which is extended to the left and right
word by word. Stretches of at least ``min_words`` words are repeats; the earliest document keeps the
passage. A run of any size is one head and its members: nothing is squared.

Where a run holds several orders, a member may share more with another one than with the earliest. The
members of these runs, the borders of passages, are ordered once more by each window of 50 words around
their seed: windows that are equal are repeats as they are. So what is found is exact: the words of all
windows of 50 that an earlier document holds, and no others.

Defined results: NULL text has no words; texts shorter than ``min_words`` have no repeats; passages
that recur only inside one document are left alone; rows with a NULL doc_id are left alone; rows that
share a doc_id count as one document; an empty table gives no matches; other columns are carried by
``remove_repeats`` and ignored by ``matches``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, forget, if_small, only, released, save, small_batches, unused
from .shingles import WordHashes, mix, word_hashes

SEED, WINDOW = 26, 25
MIN_WORDS = SEED + WINDOW - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    return mix(a[:n] * _A + b[:n] * _B)


def seed_hashes(h: np.ndarray) -> np.ndarray:
    """The hash of the SEED words from each place, by doubling: 26 = 16 + 8 + 2."""
    two = _pair(h, h[1:])
    four = _pair(two, two[2:])
    eight = _pair(four, four[4:])
    sixteen = _pair(eight, eight[8:])
    return _pair(_pair(sixteen, eight[16:]), two[24:])


def _slide(x: np.ndarray, best) -> np.ndarray:
    """min or max of each WINDOW successive values: 25 = two overlapping 16s."""
    for step in (1, 2, 4, 8):
        x = best(x[:-step], x[step:])
    return best(x[: len(x) - 9], x[9:])


def minimisers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, seed hashes) that are the least of some window; ties are all taken."""
    g = seed_hashes(h)
    low = _slide(g, np.minimum)
    pad = np.zeros(WINDOW - 1, dtype=np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), np.maximum) == g)
    return at, g[at]


_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def around(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of all words of the windows of MIN_WORDS words that hold the seed at each place, as far as the text goes."""
    powers = np.cumprod(np.full(len(h), _BASE))
    back = np.cumprod(np.full(len(h), _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * powers)])
    first, end = np.maximum(at - (MIN_WORDS - SEED), 0), np.minimum(at + MIN_WORDS, len(h))
    whole = (sums[end] - sums[first]) * back[first]
    return mix(whole + (at - first).astype(np.uint64) * _A + (end - at).astype(np.uint64) * _B)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in released(batches):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        held, count = [], 0
        for i, text in enumerate(batch.column(1)):
            words = (text.as_py() or "").encode().split()
            if len(words) >= MIN_WORDS:
                h = word_hashes(words, known)
                at, g = minimisers(h)
                held.append((np.full(len(at), ids[i]), at, g, around(h, at)))
                count += len(at)
            if held and (count > 50_000 or i == len(ids) - 1):
                doc, at, g, c = (np.concatenate(x) for x in zip(*held))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(c.view(np.int64))], ["seed", "doc_id", "pos", "near"]
                )
                held, count = [], 0


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes beside each asked stretch: up to WINDOW before it (nearest first) and after it."""
    known = WordHashes()
    for batch in released(batches):
        doc, lo, hi, before, after = [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            h = word_hashes((text.as_py() or "").encode().split(), known).view(np.int64)
            for ask in batch.column(2)[i].as_py():
                a, b = ask["lo"], ask["hi"] + SEED
                doc.append(batch.column(0)[i].as_py())
                lo.append(ask["lo"])
                hi.append(ask["hi"])
                before.append(h[max(0, a - WINDOW) : a][::-1])
                after.append(h[b : b + WINDOW])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(before, pa.list_(pa.int64())), pa.array(after, pa.list_(pa.int64()))],
            ["doc_id", "lo", "hi", "before", "after"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every window of MIN_WORDS words that holds the seed at an asked place."""
    known = WordHashes()
    for batch in released(batches):
        for i, text in enumerate(batch.column(1)):
            h = word_hashes((text.as_py() or "").encode().split(), known)
            if len(h) < MIN_WORDS:
                continue
            two = _pair(h, h[1:])
            four = _pair(two, two[2:])
            eight = _pair(four, four[4:])
            sixteen = _pair(eight, eight[8:])
            whole = _pair(_pair(_pair(sixteen, sixteen[16:]), sixteen[32:]), two[48:])  # 16 + 16 + 16 + 2
            at = np.array(batch.column(2)[i].as_py())
            at = np.unique((at[:, None] - np.arange(WINDOW)).ravel())
            at = at[(at >= 0) & (at < len(whole))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole[at].view(np.int64)), pa.array(np.full(len(at), batch.column(0)[i].as_py())), pa.array(at.astype(np.int32))], ["seed", "doc_id", "pos"]
            )


def _common(a: Column, b: Column) -> Column:
    """How many leading elements are equal."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def _met(suffixes: DataFrame, *more: str) -> DataFrame:
    """Each suffix beside the earliest of its run, where that lies in another document; ``mixed`` says that the run holds several orders."""
    near = [(F.min("near") < F.max("near")).alias("mixed")] if more else []
    heads = suffixes.groupBy("seed").agg(F.min(F.struct("doc_id", "pos")).alias("head"), F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), *near).where("_a < _b")
    # a table of its own, so that both sides of the join are plain shuffles and adaptive execution can split a hot seed
    heads = save(heads.select("seed", F.col("head.doc_id").alias("head_doc"), F.col("head.pos").alias("head_pos"), *more), "run-heads")
    matched = suffixes.join(if_small(heads), "seed").where("doc_id <> head_doc")
    return matched.select("doc_id", "pos", "head_doc", "head_pos", *(["seed", *more] if more else []))


def _stretches(matched: DataFrame, gap: int) -> DataFrame:
    """Join successive matches of one document with one place: (doc_id, lo, hi, head_doc, head_lo, head_hi)."""
    same = Window.partitionBy("doc_id", "head_doc", "shift").orderBy("pos")
    fresh = F.coalesce((F.col("pos") - F.lag("pos").over(same) > gap).cast("int"), F.lit(1))
    runs = matched.withColumn("shift", F.col("pos") - F.col("head_pos")).withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(same))
    return runs.groupBy("doc_id", "head_doc", "shift", "run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).select(
        "doc_id", "lo", "hi", "head_doc", (F.col("lo") - F.col("shift")).alias("head_lo"), (F.col("hi") - F.col("shift")).alias("head_hi")
    )


def _by_document(asked: DataFrame, item: Column, broadcast_bytes: int) -> DataFrame:
    """(doc_id, asked array): what is asked of each document, broadcast if it is little in all."""
    if not broadcast_bytes:
        return asked.groupBy("doc_id").agg(F.collect_list(item).alias("asked"))
    asked = save(asked, "asked")
    return if_small_by(asked.groupBy("doc_id").agg(F.collect_list(item).alias("asked")), asked, broadcast_bytes)


def if_small_by(df: DataFrame, measured: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, which gathers the rows of the saved table ``measured`` in lists, broadcast if those rows fit into ``limit`` bytes."""
    return F.broadcast(df) if measured.rows * 64 <= limit else df


def matches(docs: DataFrame, min_words: int = MIN_WORDS, broadcast_bytes: int = 0) -> DataFrame:
    """(doc_id, start_word, n_words, kept_doc_id, kept_start_word): passages that an earlier document holds.

    A corpus with its copies asks about nearly every document, so by default texts and questions meet
    by shuffle. Where copies are gone already, up to ``broadcast_bytes`` of questions may be broadcast.
    """
    if min_words < MIN_WORDS:
        raise ValueError(f"passages below {MIN_WORDS} words may hold no minimiser")
    base = only(docs, doc_id="long", text="string").where("doc_id is not null")
    suffixes = save(base.mapInArrow(_suffixes, "seed long, doc_id long, pos int, near long"), "suffixes")
    matched = save(_met(suffixes, "mixed"), "matched")
    runs = save(_stretches(matched, WINDOW), "stretches")
    asked = runs.select("doc_id", "lo", "hi").union(runs.select("head_doc", "head_lo", "head_hi")).distinct()
    sides = base.join(_by_document(asked, F.struct("lo", "hi"), broadcast_bytes), "doc_id").select("doc_id", "text", "asked")
    sides = save(sides.mapInArrow(_around, "doc_id long, lo int, hi int, before array<long>, after array<long>"), "sides")
    head_sides = sides.select(
        F.col("doc_id").alias("head_doc"), F.col("lo").alias("head_lo"), F.col("hi").alias("head_hi"), F.col("before").alias("head_before"), F.col("after").alias("head_after")
    )
    ends = runs.join(sides, ["doc_id", "lo", "hi"]).join(head_sides, ["head_doc", "head_lo", "head_hi"])
    left = _common(F.col("before"), F.col("head_before"))
    right = _common(F.col("after"), F.col("head_after"))
    grown = ends.select("doc_id", "lo", "hi", "head_doc", "head_lo", left.alias("left"), right.alias("right"))
    grown = save(grown.withColumn("n_words", F.col("hi") - F.col("lo") + SEED + F.col("left") + F.col("right")), "grown")
    found = grown.where(F.col("n_words") >= min_words).select(
        "doc_id",
        (F.col("lo") - F.col("left")).alias("start_word"),
        "n_words",
        F.col("head_doc").alias("kept_doc_id"),
        (F.col("head_lo") - F.col("left")).alias("kept_start_word"),
    )
    # runs with several orders: compare whole windows
    seeds = save(matched.where("mixed").select("seed").distinct(), "mixed-seeds")
    if seeds.rows:
        asked = suffixes.join(if_small(seeds), "seed", "left_semi").select("doc_id", "pos")
        whole = base.join(_by_document(asked, F.col("pos"), broadcast_bytes), "doc_id").select("doc_id", "text", "asked").mapInArrow(_windows, "seed long, doc_id long, pos int")
        equal = _stretches(_met(save(whole, "windows")), MIN_WORDS).withColumn("n_words", F.col("hi") - F.col("lo") + MIN_WORDS)
        equal = equal.where(F.col("n_words") >= min_words)
        found = found.union(equal.select("doc_id", F.col("lo"), "n_words", "head_doc", "head_lo"))
    found = save(found.distinct(), "repeats")
    for table in (suffixes, matched, runs, sides, grown, seeds):
        forget(table)
    return found


def _cut(schema_names: list[str], text_at: int, spans_at: int, chars_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = batch.column(text_at).to_pylist()
            left_none = np.zeros(len(texts), dtype=bool)
            for i, spans in enumerate(batch.column(spans_at)):
                if not spans.is_valid:
                    continue
                text = texts[i]
                starts = [m.start() for m in WORD.finditer(text)]
                edges = [*starts, len(text)]
                out, done = [], 0
                for s in sorted((x["s"], x["e"]) for x in spans.as_py()):
                    if s[0] > done:
                        out.append(text[edges[done] if done else 0 : edges[s[0]]])
                    done = max(done, s[1])
                out.append(text[edges[done] :] if done < len(starts) else "")
                texts[i] = "".join(out)
                left_none[i] = not WORD.search(texts[i])
            columns = [c for i, c in enumerate(batch.columns) if i != spans_at]
            names = [n for i, n in enumerate(schema_names) if i != spans_at]
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if chars_at is not None:
                old = batch.column(chars_at).to_pylist()
                touched = batch.column(spans_at).is_valid().to_pylist()
                columns[chars_at] = pa.array([len(t) if hit else n for t, n, hit in zip(texts, old, touched)], batch.schema.field(chars_at).type)
            keep = pa.array(~left_none)
            yield pa.RecordBatch.from_arrays(columns, names).filter(keep)

    return run


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the passages that an earlier document holds; documents left without words go."""
    found = matches(docs, min_words, BROADCAST_BYTES)
    small_batches(docs.sparkSession)
    id_, spans_ = unused(docs, "_id"), unused(docs, "_spans")
    spans = found.groupBy(F.col("doc_id").alias(id_)).agg(
        F.collect_list(F.struct(F.col("start_word").alias("s"), (F.col("start_word") + F.col("n_words")).alias("e"))).alias(spans_)
    )
    joined = docs.join(if_small_by(spans, found), docs["doc_id"] == F.col(id_), "left").drop(id_)
    names = joined.columns
    chars = names.index("n_chars") if "n_chars" in names else None
    return joined.mapInArrow(_cut(names, names.index("text"), names.index(spans_), chars), docs.schema)
