"""Interaction audit of filters by the multilinear extension.

Every document has a mask, one bit for each filter that it fails. For each part the documents are counted
by mask; these counts, 2^k of them for k filters, are all that the rest needs. They make the part's removal
polynomial

    R(x) = sum over masks m of c(m) * (1 - product over i in m of (1 - x_i)) = sum over sets S of a(S) * x^S,

the number of documents removed when filter i is applied with chance x_i. At a corner of the cube it is the
number removed by a set of filters, so survivors, removals and losses of every order and step are
differences of corners. The Shapley value of a filter is the integral of its partial derivative along the
diagonal, the sum over S with i of a(S) / |S|, kept as an exact fraction; times k! it is the whole number
that the filter removes, summed over all orders.

Masks and counts are Spark's work; a part's polynomial is a row of 2^k counts and is evaluated in a task.
Identical texts are found by digest: rows are counted by (doc_id, text) and then by (text, part, label)
before texts meet, so a text that a third of all rows repeat is a handful of rows.

Defined results: NULL text counts as the empty text, NULL source as ''; a NULL doc_id is neither smaller nor
larger than another, so such a row never fails E nor makes others fail it; rows that repeat a doc_id with
its text are equal in E and all counted; a document is good or toxic if any of its rows in ``labels`` says
1, and neither if there is none; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, only

LETTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
MEASURES = ("n", "good", "toxic")


def text_failures(rows: DataFrame) -> dict[str, Column]:
    """The conditions of filters A to D over columns ``words`` and ``text``; the filters that look at one text."""
    n = F.size("words")
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct("words")) < 65 * n,
        "C": 100 * capitals > 5 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail; bit i is the i-th letter."""
    rows = only(docs, doc_id="long", text="string", source="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    cut = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    bits = [F.when(failed, 1 << LETTERS.index(x)).otherwise(0) for x, failed in text_failures(cut).items()]
    masked = cut.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), reduce(lambda a, b: a + b, bits).alias("mask"))
    documents = masked.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = only(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = documents.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    # the documents of a text, part and label as one row: how many, and how many of them have its least id
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), least.alias("least")
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    unique = F.col("no_id") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = texts.withColumn("unique", unique)
    copy = 1 << LETTERS.index("E")
    kinds = F.array(F.struct(F.col("mask"), F.col("unique").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("unique")).alias("n")))
    masks = split.select("part", "good", "toxic", F.explode(kinds).alias("k")).select("part", "k.mask", "k.n", "good", "toxic").where("n > 0")
    return masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


class Removal:
    """A multilinear polynomial by its coefficients: ``coefficient[S]`` for the set S of variables as bits."""

    def __init__(self, counts: Sequence[int]):
        self.k = (len(counts) - 1).bit_length()
        self.total = sum(counts)
        held = [int(c) for c in counts]
        for i in range(self.k):  # sums over all supersets
            for s in range(len(held)):
                if not s >> i & 1:
                    held[s] += held[s | 1 << i]
        self.coefficient = [0] + [(-1) ** (s.bit_count() + 1) * held[s] for s in range(1, len(held))]

    def corner(self, chosen: int) -> int:
        """The polynomial where the chosen variables are 1 and the others 0."""
        return sum(a for s, a in enumerate(self.coefficient) if s & ~chosen == 0)

    def derivative_integral(self, i: int) -> Fraction:
        """The partial derivative by x_i, integrated over (t, ..., t) for t from 0 to 1."""
        return sum((Fraction(a, s.bit_count()) for s, a in enumerate(self.coefficient) if s >> i & 1), Fraction(0))


def audit_part(counts: dict[str, Sequence[int]], letters: str = LETTERS) -> Iterator[tuple]:
    """(order, step, *COUNTS) of a part for every order of the filters; ``counts`` by measure and mask."""
    k, every = len(letters), (1 << len(letters)) - 1
    removal = {name: Removal(c) for name, c in counts.items()}
    corner = {name: [r.corner(s) for s in range(every + 1)] for name, r in removal.items()}
    n = corner["n"]
    share = [removal["n"].derivative_integral(i) * factorial(k) for i in range(k)]
    if any(s.denominator != 1 for s in share):
        raise AssertionError("the removals of all orders add up to whole numbers")
    for order in permutations(range(k)):
        applied, name = 0, "".join(letters[i] for i in order)
        for step, i in enumerate(order, 1):
            then = applied | 1 << i
            removed = n[then] - n[applied]
            yield (
                name, step, removal["n"].total - n[then], removed, n[1 << i] - removed, n[every] - n[every & ~(1 << i)],
                corner["good"][then] - corner["good"][applied], corner["toxic"][then] - corner["toxic"][applied], int(share[i]),
            )
            applied = then


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.to_pylist():
            counts = {name: [0] * (1 << len(LETTERS)) for name in MEASURES}
            for m in part["masks"]:
                for name in MEASURES:
                    counts[name][m["mask"]] += m[name]
            orders, steps, *values = zip(*audit_part(counts))
            columns = [pa.array([part["part"]] * len(steps)), pa.array(orders), pa.array(steps, pa.int32()), *[pa.array(np.array(v), pa.int64()) for v in values]]
            yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, as the contract names them."""
    masks = mask_counts(docs, labels)
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("masks"))  # 32 entries at most
    return parts.mapInArrow(_audits, OUT)
