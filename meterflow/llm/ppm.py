"""Language-model scores by prediction by partial matching, with counts from the whole corpus.

The model is a trie of byte contexts up to ``ORDER`` bytes, held as tables with one row per node: an
n-gram of ORDER+1 symbols packed in a long, whose suffixes are the nodes of the lower orders. From the
training documents it keeps how often each symbol follows each context. A symbol unseen in a context
is reached by an escape to the next shorter one, with the escape estimate d / 2n for d distinct
symbols in n occurrences and (2c - 1) / 2n for a symbol seen c times (method D); symbols of the longer context are excluded from the shorter one.
As every successor of a context also follows its suffix, the exclusion needs two sums per context,
so the probability of each distinct n-gram is a few joins and windows of at most 258 rows per group.
Below order 0 the symbols not seen at all share the rest. ``score`` is the log10 probability of the
lower-cased bytes of the text and an end symbol.

Scale: documents are dealt to blocks of about BLOCK_BYTES of text; many equal rows part by their place in
the input, which is the same for both passes. A block is reduced to its distinct
n-grams and words before any shuffle of counts; counts are summed over blocks by key, turned to
probabilities once for each distinct key, and sent back to the blocks that hold the key, where the
documents are scored. No table of the corpus is broadcast or collected. Words are keyed by 63-bit
hashes.

Defined results: NULL text is the empty text (one end token); a NULL doc_id trains; repeated rows are
counted and scored once each; whole texts of any length are used; an empty table gives an empty
table; other columns are ignored (``lang``, where present, only groups like texts in a block).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder, save, spread
from .shingles import WordHashes, word_hashes

ORDER = 5
END, START, SYMBOLS, BITS = 256, 257, 257, 9
BLOCK_BYTES = 24 << 20
#: Symbols handled at once in a task, and documents (they share a sort key of 64 bits).
CHUNK, CHUNK_DOCS = 1_500_000, 1000
END_TOKEN = b"\n"  # no word holds it


def _chunks(texts: pa.ChunkedArray):
    """(first row, last row, lower-cased texts) of as many documents as are handled at once."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text.as_py() or "").encode().lower()
        if held and (size + len(raw) > CHUNK or len(held) == CHUNK_DOCS):
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + ORDER + 1
    if held:
        yield first, held


def _ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each symbol of each text, and the text's number."""
    sizes = np.array([len(t) + 1 for t in texts])
    symbols = np.full(sizes.sum() + ORDER * len(texts), START, dtype=np.uint64)
    at = 0
    for t in texts:
        at += ORDER
        symbols[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        symbols[at + len(t)] = END
        at += len(t) + 1
    packed = np.zeros(len(symbols) - ORDER, dtype=np.uint64)
    for i in range(ORDER + 1):
        packed <<= np.uint64(BITS)
        packed |= symbols[i : len(symbols) - ORDER + i]
    return packed[symbols[ORDER:] != START], np.repeat(np.arange(len(texts)), sizes)


def _word_keys(hashes: np.ndarray) -> np.ndarray:
    return (hashes | np.uint64(1 << 63)).view(np.int64)


def _totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _count(block: pa.Table) -> pa.Table:
    """The distinct n-grams and words of one block with their counts in its training documents."""
    train = block.column("train").to_numpy()
    known, seen, counts, parts, ends = WordHashes(), set(), {}, [], 0
    for first, texts in _chunks(block.column("text")):
        grams, doc = _ngrams(texts)
        keep = train[first : first + len(texts)]
        grams = (grams << np.uint64(1)) | keep[doc].astype(np.uint64)
        grams.sort()
        n, grams = (grams & np.uint64(1)).astype(np.int64), grams >> np.uint64(1)
        at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        parts.append((grams[at].view(np.int64), np.add.reduceat(n, at)))
        for text, yes in zip(texts, keep):
            words = text.split()
            if yes:
                ends += 1
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
            else:
                seen.update(words)
    keys, n = (np.concatenate(x) for x in zip(*parts))
    keys, n = _totals(keys, n)
    words = [*counts, *(w for w in seen if w not in counts), END_TOKEN]
    word_n = np.zeros(len(words), dtype=np.int64)
    word_n[: len(counts)] = np.fromiter(counts.values(), np.int64, len(counts))
    word_n[-1] = ends
    word_keys, word_n = _totals(_word_keys(word_hashes(words, known)), word_n)
    number = block.column("block")[0].as_py()
    keys, n = np.concatenate([word_keys, keys]), np.concatenate([word_n, n])
    return pa.table({"block": pa.array(np.full(len(keys), number, np.int32)), "key": keys, "n": n})


def _score(n_tokens: int, n_distinct: int):
    below = n_tokens + 0.5 * (n_distinct + 1)

    def run(block: pa.Table, values: pa.Table) -> pa.Table:
        keys, value = values.column("key").to_numpy(), values.column("value").to_numpy()
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        split = np.searchsorted(keys, 0)
        word_keys, word_n, grams_known, logs = keys[:split], value[:split], keys[split:], value[split:]
        known = WordHashes()
        rows: list[tuple] = []
        for _, texts in _chunks(block.column("text")):
            grams, doc = _ngrams(texts)
            packed = (grams << np.uint64(10)) | doc.astype(np.uint64)
            packed.sort()
            grams, doc = (packed >> np.uint64(10)).view(np.int64), (packed & np.uint64(1023)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            found = logs[np.searchsorted(grams_known, grams[at])]
            scores = np.bincount(doc, np.repeat(found, np.diff(np.append(at, len(grams)))), len(texts))
            for text, score in zip(texts, scores):
                hashes = _word_keys(word_hashes([*text.split(), END_TOKEN], known))
                c = word_n[np.searchsorted(word_keys, hashes)]
                rows.append((len(hashes), int((c > 0).sum()), float(np.log10((c + 0.5) / below).sum()), float(score), len(text)))
        n, n_known, base, scores, size = zip(*rows)
        return pa.table(
            {
                "doc_id": block.column("doc_id"),
                "held_out": pa.array(~block.column("train").to_numpy()),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([n_tokens] * len(n), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(scores, pa.float64()),
                "bits_per_byte": pa.array(-np.array(scores) * np.log2(10) / (np.array(size) + 1), pa.float64()),
            }
        )

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, doc_id, text, train): documents dealt to blocks by hash (``spread``), like languages together."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    volume = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    sizes = rows.groupBy("lang").agg(volume.alias("b")).orderBy(F.desc("b"), "lang").limit(64).collect()
    rows = spread(rows, block_bytes)
    own = F.col("spread")
    # the 63 largest languages get blocks of their own, all others share theirs
    first, deal = 0, F.lit(None)
    for name, size in [(r["lang"], r["b"]) for r in sizes[:63]]:
        n = max(1, round(size / block_bytes))
        here = F.pmod(own, F.lit(n)) + first
        deal = F.when(F.col("lang").eqNullSafe(F.lit(name)), here) if first == 0 else deal.when(F.col("lang").eqNullSafe(F.lit(name)), here)
        first += n
    if len(sizes) == 64:
        rest = rows.agg(volume.alias("b")).first()["b"] - sum(r["b"] for r in sizes[:63])
        deal = deal.otherwise(F.pmod(own, F.lit(max(1, round(rest / block_bytes)))) + first)
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    return rows.select(deal.cast("int").alias("block"), "doc_id", "text", (~held_out).alias("train"))


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): log10 probability of the last symbol of each packed n-gram, from training counts."""
    mask = lambda k: F.lit((1 << BITS * (k + 1)) - 1)
    nodes = {order: counts}
    for k in range(order - 1, -1, -1):
        nodes[k] = save(nodes[k + 1].groupBy(F.col("key").bitwiseAND(mask(k)).alias("key")).agg(F.sum("n").alias("n")), f"order{k}")
    lower = None
    for k in range(order + 1):
        here = nodes[k].withColumn("context", F.shiftright("key", BITS))
        if lower is not None:
            here = here.withColumn("suffix", F.col("key").bitwiseAND(mask(k - 1))).join(lower, "suffix")
        else:
            here = here.withColumn("low_n", F.lit(0))
        group = Window.partitionBy("context")
        seen = F.col("n") > 0
        here = here.withColumns(
            {
                "total": F.sum("n").over(group),
                "kinds": F.sum(seen.cast("long")).over(group),
                "covered": F.sum(F.when(seen, F.col("low_n")).otherwise(0)).over(group),
            }
        )
        if lower is None:
            escaped = -F.log10(SYMBOLS - F.col("kinds"))
        else:
            kinds = F.col("low_kinds") - F.col("kinds")
            room = 2 * (F.col("low_total") - F.col("covered"))
            escaped = (
                F.when(room <= 0, F.col("low_escaped"))
                .when(F.col("low_n") > 0, F.log10((2 * F.col("low_n") - 1) / room))
                .when(kinds <= 0, F.col("low_escaped"))
                .otherwise(F.log10(kinds / room) + F.col("low_escaped"))
            )
        rows = here.select("key", "n", "total", "kinds", escaped.alias("escaped"))
        if k == order:
            room = 2 * F.col("total")
            value = (
                F.when(F.col("total") == 0, F.col("escaped"))
                .when(F.col("n") > 0, F.log10((2 * F.col("n") - 1) / room))
                .otherwise(F.log10(F.col("kinds") / room) + F.col("escaped"))
            )
            return rows.select("key", value.alias("value"))
        rows = save(rows, f"trie{k}")
        lower = rows.select(
            F.col("key").alias("suffix"), F.col("n").alias("low_n"), F.col("total").alias("low_total"), F.col("kinds").alias("low_kinds"), F.col("escaped").alias("low_escaped")
        )


def score_docs(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Model and unigram log10 probabilities of every document."""
    dealt = blocks(docs, block_bytes)
    held = save(dealt.groupBy("block").applyInArrow(_count, "block int, key long, n long"), "block-counts")
    counts = save(held.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    words, grams = counts.where("key < 0"), counts.where("key >= 0")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    values = save(words.select("key", F.col("n").cast("double").alias("value")).union(log_probabilities(grams)), "values")
    wanted = held.select("block", "key").join(values, "key").select("block", "key", "value")
    return dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_score(total["n"], total["v"]), RESULT)
