"""Nearest neighbours by additive quantisation, with exact reranking.

A unit vector is approximated by a sum of ``BOOKS`` full-dimensional codewords. Codebooks start as
k-means of successive residuals of a bounded sample (``SAMPLE`` rows of least hash, on the driver) and
are then refined together by least squares on the beam-search codes. Every row is encoded by beam
search where it lies; its code and the norm of its approximation are stored. A query block meets a
block of codes in one task: inner products with all codewords go to a lookup table, a candidate's
score is the sum of its entries over its stored norm, and the best ``RERANK`` of each query in each
block are kept. The best over all blocks are compared exactly on the original vectors.

That is a start and no cap: the k-th best of these exact scores is a proven lower bound of a query's
result. A row's code holds the angle between the vector and its approximation, too, so the angle between
query and vector is at least the difference of the two known ones; every row that could still reach the
lower bound by that is compared exactly as well. Such rows meet a query block once, however many of its
queries ask for them, and the k best of each block go on. So the result is that of a full comparison.

The query set is stated (vec_id divisible by ``EVERY``) and meets all rows, in blocks of bounded size.
Of equal vectors only the k + 1 least ids can be among the k nearest, so blocks are dealt by a hash of
the vector and equal ones beyond that are set aside, first where they are read and again in the block.

Defined results: vectors that are NULL, empty, zero, of another length than most, or hold NULL
or non-finite components take no part; NULL ids take no part; rows that repeat a vec_id count once in
a result and never match their own id; fewer candidates than k give fewer rows; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small_batches

BOOKS, WORDS, BEAM = 16, 256, 6
SAMPLE, RERANK, EVERY = 16_384, 64, 50
QUERY_BLOCK, CODE_BLOCK = 1024, 65_536


CODES = "vec_id long, same long, code binary, norm float, off float"


@dataclass
class Quantizer:
    books: np.ndarray  # (books, words, dim) float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes uint8 (n, books), norms of the approximations) by beam search."""
        codes, norms = [], []
        for i in range(0, len(x), 1024):
            c, n = self._encode(x[i : i + 1024], beam)
            codes.append(c)
            norms.append(n)
        return np.concatenate(codes), np.concatenate(norms)

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, dim = x.shape
        rest, taken = x[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8)
        for book in self.books:
            # the squared length of rest - codeword, less what all codewords of a beam share
            gain = (rest.reshape(-1, dim) @ book.T).reshape(n, -1, len(book)) * -2 + (book * book).sum(axis=1)
            gain += (rest * rest).sum(axis=2)[:, :, None]
            flat = gain.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.broadcast_to(np.arange(keep), (n, keep))
            origin, word = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            rest = rest[rows, origin] - book[word]
            taken = np.concatenate([taken[rows, origin], word[:, :, None].astype(np.uint8)], axis=2)
        best = (rest * rest).sum(axis=2).argmin(axis=1)
        rows = np.arange(n)
        return taken[rows, best], np.sqrt(((x - rest[rows, best]) ** 2).sum(axis=1))

    def refine(self, x: np.ndarray, codes: np.ndarray) -> None:
        """All codebooks together by ridge least squares for fixed codes."""
        m, k, dim = self.books.shape
        place = codes.astype(np.int64) + np.arange(m) * k
        gram, right = np.zeros((m * k, m * k), np.float32), np.zeros((m * k, dim), np.float32)
        for a in range(m):
            np.add.at(right, place[:, a], x)
            for b in range(m):
                gram[a * k : (a + 1) * k, b * k : (b + 1) * k] = np.bincount(codes[:, a].astype(np.int64) * k + codes[:, b], minlength=k * k).reshape(k, k)
        gram[np.arange(m * k), np.arange(m * k)] += 0.1
        right += 0.1 * self.books.reshape(m * k, dim)
        self.books = np.linalg.solve(gram, right).astype(np.float32).reshape(m, k, dim)


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 3) -> Quantizer:
    rng = np.random.default_rng(seed)
    k, rest, found = min(words, len(x)), x.copy(), []
    for _ in range(books):
        book = rest[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(rounds):
            near = (rest @ book.T * -2 + (book * book).sum(axis=1)).argmin(axis=1)
            total, n = np.zeros_like(book), np.bincount(near, minlength=k)
            np.add.at(total, near, rest)
            book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rest[rng.choice(len(x), k)])
        near = (rest @ book.T * -2 + (book * book).sum(axis=1)).argmin(axis=1)
        rest = rest - book[near]
        found.append(book.astype(np.float32))
    out = Quantizer(np.stack(found))
    if len(x) > k:
        out.refine(x, out.encode(x, 2)[0])
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return base.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that very large and very small components survive squaring."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Quantizer | None:
    good = usable(vectors)
    lengths = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return None
    # one odd row must not decide which rows take part
    good = good.where(F.size("v") == lengths[0]["dim"])
    n, scale = lengths[0]["count"], 1 << 40
    if n > 2 * sample:  # by a bound on the hash first, so that few more rows than the sample are sorted
        good = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(scale)) < int(scale * min(1.0, 1.5 * sample / n)))
    rows = good.orderBy(F.pmod(F.xxhash64("vec_id"), F.lit(scale)), F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    return train(unit(_matrix(rows)).astype(np.float32))


def _index(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantizer: Quantizer = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            same = np.array([xxhash.xxh3_64_intdigest(r) for r in np.ascontiguousarray(v)], dtype=np.uint64).view(np.int64)
            x = unit(v)
            codes, norms = quantizer.encode(x.astype(np.float32))
            back = quantizer.books[np.arange(len(quantizer.books)), codes].sum(axis=1).astype(np.float64)
            cosine = (x * back).sum(axis=1) / np.maximum(np.sqrt((back * back).sum(axis=1)), 1e-9)
            off = np.arccos(np.clip(cosine, -1, 1)) + 1e-6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(same), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32)), pa.array(off.astype(np.float32))],
                ["vec_id", "same", "code", "norm", "off"],
            )

    return run


def index(vectors: DataFrame, quantizer: Quantizer, k: int = 5) -> DataFrame:
    """(vec_id, same, code, norm, off) of every usable row; ``off`` is the angle to its approximation."""
    dim = quantizer.books.shape[2]
    shared = vectors.sparkSession.sparkContext.broadcast(quantizer)  # books * words * dim floats, whatever the input
    return usable(vectors).where(F.size("v") == dim).mapInArrow(_index(shared, k), CODES)


def _least(ids: np.ndarray, same: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` least distinct ids of each group of equal vectors."""
    order = np.lexsort((ids, same))
    s, d = same[order], ids[order]
    fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])  # repeated ids count once
    order, s = order[fresh], s[fresh]
    first = np.searchsorted(s, s)
    return order[np.arange(len(s)) - first < most]


def _thin(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _least(batch.column(0).to_numpy(), batch.column(1).to_numpy(), k + 1)
                yield batch.take(pa.array(np.sort(keep)))

    return run


def _search(shared, k: int, rerank: int):
    def run(queries: pa.Table, codes: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "near": pa.array([], pa.float32())})
        if not queries.num_rows or not codes.num_rows:
            return empty
        books = shared.value.books
        ids = codes.column("vec_id").to_numpy()
        keep = _least(ids, codes.column("same").to_numpy(), k + 1)
        keep = keep[np.argsort(ids[keep])]
        ids, norms = ids[keep], np.maximum(codes.column("norm").to_numpy()[keep], 1e-9)
        code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(-1, len(books))[keep]
        q = unit(_matrix(queries.column("v").combine_chunks())).astype(np.float32)
        own = queries.column("query_id").to_numpy()
        table = np.einsum("qd,mwd->mqw", q, books, optimize=True)
        best_s, best_i = np.full((len(q), 0), 0, np.float32), np.zeros((len(q), 0), np.int64)
        for i in range(0, len(ids), 8192):
            part = code[i : i + 8192]
            s = table[0][:, part[:, 0]]
            for m in range(1, len(books)):
                s += table[m][:, part[:, m]]
            s /= norms[i : i + 8192]
            s[own[:, None] == ids[i : i + 8192]] = -np.inf
            best_s = np.concatenate([best_s, s], axis=1)
            best_i = np.concatenate([best_i, np.broadcast_to(ids[i : i + 8192], s.shape)], axis=1)
            if best_s.shape[1] > rerank:
                top = np.argpartition(-best_s, rerank - 1, axis=1)[:, :rerank]
                best_s, best_i = np.take_along_axis(best_s, top, 1), np.take_along_axis(best_i, top, 1)
        there = np.isfinite(best_s)
        who = np.broadcast_to(own[:, None], best_s.shape)
        return pa.table({"query_id": who[there], "vec_id": best_i[there], "near": best_s[there]})

    return run


def _reach(shared, k: int):
    """(qb, cb, vec_id) of the rows of a code block that may reach the lower bound of some query of a block."""

    def run(queries: pa.Table, codes: pa.Table) -> pa.Table:
        if not queries.num_rows or not codes.num_rows:
            return pa.table({"qb": pa.array([], pa.int32()), "cb": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64())})
        books = shared.value.books
        keep = _least(codes.column("vec_id").to_numpy(), codes.column("same").to_numpy(), k + 1)
        ids, off = codes.column("vec_id").to_numpy()[keep], codes.column("off").to_numpy()[keep]
        norms = np.maximum(codes.column("norm").to_numpy()[keep], 1e-9)
        code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(-1, len(books))[keep]
        q = unit(_matrix(queries.column("v").combine_chunks())).astype(np.float32)
        own = queries.column("query_id").to_numpy()
        far = np.arccos(np.clip(queries.column("least").to_numpy() - 1e-9, -1, 1))[:, None]
        table = np.einsum("qd,mwd->mqw", q, books, optimize=True)
        # more than the rounding of single precision adds up to
        slack = 4e-6 * np.sqrt((books.astype(np.float64) ** 2).sum(axis=2)).max(axis=1).sum()
        asked = np.zeros(len(ids), bool)
        for i in range(0, len(ids), 8192):
            part = code[i : i + 8192]
            s = table[0][:, part[:, 0]]
            for m in range(1, len(books)):
                s += table[m][:, part[:, m]]
            angle = np.arccos(np.clip((s + slack) / norms[i : i + 8192], -1, 1))
            near = angle <= far + off[i : i + 8192] + 1e-5
            asked[i : i + 8192] = (near & (own[:, None] != ids[i : i + 8192])).any(axis=0)
        found = np.unique(ids[asked])
        blocks = [pa.array(np.full(len(found), queries.column(name)[0].as_py()), pa.int32()) for name in ("qb", "cb")]
        return pa.table({"qb": blocks[0], "cb": blocks[1], "vec_id": found})

    return run


def _compare(k: int):
    """The k nearest rows of a block for each query of a block, and all that equal the last of them."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        who, what, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if queries.num_rows and rows.num_rows:
            ids, own = rows.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
            x, q = unit(_matrix(rows.column("v").combine_chunks())), unit(_matrix(queries.column("v").combine_chunks()))
            least = queries.column("least").to_numpy()
            distinct = len(np.unique(ids)) == len(ids)
            for i in range(0, len(q), 64):
                s = q[i : i + 64] @ x.T
                s[own[i : i + 64, None] == ids] = -np.inf
                bound = least[i : i + 64]
                if distinct and len(ids) > k:
                    bound = np.maximum(bound, -np.partition(-s, k - 1, axis=1)[:, k - 1])
                a, b = np.nonzero((s >= bound[:, None] - 1e-9) & np.isfinite(s))
                who.append(own[i + a])
                what.append(ids[b])
                scores.append((q[i + a] * x[b]).sum(axis=1))  # as in _exact, so that equal vectors tie
        return pa.table({"query_id": np.concatenate(who), "vec_id": np.concatenate(what), "score": np.concatenate(scores)})

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            score = (unit(_matrix(batch.column(2))) * unit(_matrix(batch.column(3)))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "vec_id", "score"])


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, k: int = 5, every: int = EVERY, rerank: int = RERANK) -> DataFrame:
    """The k nearest rows of each query by exact cosine."""
    spark = vectors.sparkSession
    small_batches(spark)
    quantizer = fit(vectors)
    if quantizer is None:
        return spark.createDataFrame([], RESULT)
    dim = quantizer.books.shape[2]
    codes = save(index(vectors, quantizer, k), "codes")
    good = usable(vectors).where(F.size("v") == dim)
    queries = save(good.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "queries")
    n_q, n_c = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-codes.count() // CODE_BLOCK))
    # a grid of blocks: each query block goes to every code block and the other way round
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    thin = codes.mapInArrow(_thin(k), CODES)
    right = thin.withColumn("cb", F.pmod(F.col("same"), F.lit(n_c)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    shared = spark.sparkContext.broadcast(quantizer)
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_search(shared, k, rerank), "query_id long, vec_id long, near float")
    near = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    pairs = found.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= rerank).select("query_id", "vec_id")
    mine = queries.select("query_id", F.col("v").alias("q"))
    pairs = pairs.join(good, "vec_id").join(mine, "query_id").select("query_id", "vec_id", "q", "v")
    exact = save(pairs.mapInArrow(_exact, "query_id long, vec_id long, score double"), "exact")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(scores: DataFrame) -> DataFrame:
        once = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # a query with fewer than k results so far is compared with all rows
    least = best(exact).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    bounded = save(left.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))), "bounded")
    asked = bounded.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_reach(shared, k), "qb int, cb int, vec_id long")
    asked = asked.join(good, "vec_id").select("qb", "cb", "vec_id", "v")
    more = bounded.groupBy("qb", "cb").cogroup(asked.groupBy("qb", "cb")).applyInArrow(_compare(k), "query_id long, vec_id long, score double")
    return best(exact.union(more)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
