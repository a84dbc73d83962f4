"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch of texts are laid end to end in one array of symbols, with the place
where each sequence begins. A round looks up the rank of every adjacent pair, takes the lowest of each
sequence by a segmented minimum, and merges all pairs of that rank in all sequences at once; where such
pairs overlap (``aaa``), every second one of a run counts, from the left. Sequences without a mergeable
pair leave with their number of symbols. After a round only the pairs beside merged symbols are looked up
again, so a round over a long sequence costs a pass of comparisons, not of look-ups.

A merge's parts rank before the merge itself (checked when the file is read), so nothing that a round
creates could have gone before that round: the counts are the library's.

Words between single spaces and line ends are split by themselves; texts with other white space are split
whole. Counts of words met before are remembered, up to ``CACHE_WORDS``; texts of a batch are taken in
blocks of ``BLOCK_CHARS``, so memory follows the block and the longest text.

Defined results: NULL text counts as the empty text (0 bytes, 0 tokens); an added token's string in a text
is one token, as in the library; repeated rows and NULL ids are counted row by row; an empty table gives an
empty table; other columns are ignored; texts are counted whole whatever their length.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PRE_SPLIT, byte_chars
from .common import only, small_batches

#: Words kept with their counts in one Python worker; beyond it the table starts anew.
CACHE_WORDS = 500_000
#: Characters of texts whose new words are merged together.
BLOCK_CHARS = 4 << 20
#: The rank of a pair that is no merge.
NONE = np.int32(2**31 - 1)


class Merges:
    """Pairs of symbols with their ranks and results, as sorted arrays."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        to_byte = byte_chars()
        self.size = max(vocab.values()) + 1
        self.of_byte = np.zeros(256, np.int32)
        for char, byte in to_byte.items():
            self.of_byte[byte] = vocab[char]
        left, right, made = (np.array(x, np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]))
        rank_of = np.full(self.size, -1, np.int64)
        rank_of[made] = np.arange(len(made))
        parts = np.maximum(rank_of[left], rank_of[right])
        if len(np.unique(made)) != len(made) or (parts >= np.arange(len(made))).any():
            raise ValueError("a merge ranks before its parts: pairs of one rank cannot be merged at once")
        key = left * self.size + right
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, lengths): the symbols left of all words, end to end, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = lengths.copy()
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        # the rank of each symbol with its right neighbour; NONE at the end of a sequence
        rank = np.full(len(symbol), NONE)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        while len(symbol):
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[begins, len(symbol)])
            lowest = np.minimum.reduceat(rank, begins)
            over = lowest == NONE
            if over.any():
                counts[owner[begins[over]]] = sizes[over]
                ended = np.repeat(over, sizes)
                done.append((owner[ended], symbol[ended]))
                symbol, owner, rank = symbol[~ended], owner[~ended], rank[~ended]
                lowest, sizes = lowest[~over], sizes[~over]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # in a run of overlapping pairs every second one is merged, from the left
            fresh = np.r_[True, (np.diff(hit) > 1)]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            stays = np.ones(len(symbol), bool)
            stays[hit + 1] = False
            rank[hit] = rank[hit + 1]  # NONE if the sequence ends there, else looked up below
            at = hit - np.arange(len(hit))  # where the merged symbols lie now
            symbol, owner, rank = symbol[stays], owner[stays], rank[stays]
            beside = np.r_[at - 1, at]
            beside = beside[(beside >= 0) & (beside < len(symbol) - 1)]
            beside = beside[owner[beside] == owner[beside + 1]]
            rank[beside] = self.ranks(symbol[beside], symbol[beside + 1])
        if not done:
            return symbol, counts
        owner, symbol = (np.concatenate(x) for x in zip(*done))
        return symbol[np.argsort(owner, kind="stable")], counts


def words_of(text: str) -> list[str] | None:
    """``text`` cut at each space and before each line end; None if it holds other white space than single ones of these between words.

    Every word but the first and those that begin with a line end has a space before it. No token reaches
    over such a cut, so the words can be encoded one by one.
    """
    if not text or " ".join(text.split()) != text.replace("\n", " "):
        return None
    return text.replace("\n", " \n").split(" ")


class Counter:
    """Counts tokens of whole texts, remembering the words it has met."""

    def __init__(self, merges: Merges, added: list[str] = ()):
        self.merges, self.known = merges, {}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def _each(self, spans: list[list[str]]) -> list[int]:
        """The number of symbols of each list of pre-tokens; all distinct ones are merged together."""
        place = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(spans)))}
        counts = self.merges.merge([p.encode() for p in place])[1].tolist()
        return [counts[place[found[0]]] if len(found) == 1 else sum([counts[place[p]] for p in found]) for found in spans]

    def count(self, texts: Iterable[str]) -> list[int]:
        """The number of tokens of each text."""
        out: list[int] = []
        cut: list[list[str]] = []
        whole: list[tuple[int, str]] = []
        for text in texts:
            pieces = [text] if self.split_added is None else self.split_added.split(text)
            mine: list[str] = []
            for piece in filter(None, pieces):
                found = words_of(piece)
                if found is None:
                    whole.append((len(out), piece))
                else:
                    found[0] = " " + found[0]  # stands for the word without a space before it
                    mine += found
            cut.append(mine)
            out.append(len(pieces) - 1)
        words = set().union(*cut)
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = words
        new = list(new)
        # words of ASCII letters are one pre-token
        spans = [[" " + w] if w.isascii() and w.isalpha() else PRE_SPLIT.findall(w[1:] if w[0] == " " else w if w[0] == "\n" else " " + w) for w in new]
        spans += [PRE_SPLIT.findall(piece) for _, piece in whole]
        if spans:
            counts = self._each(spans)
            self.known.update(zip(new, counts))
            for (at, _), n in zip(whole, counts[len(new) :]):
                out[at] += n
        get = self.known.__getitem__
        return [n + sum(map(get, mine)) for n, mine in zip(out, cut)]


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    """The counter of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Counter(Merges(model["vocab"], merges), [a["content"] for a in spec["added_tokens"]])


def blocks(texts: list, most: int | None = None) -> Iterator[list[str]]:
    """``texts`` (None: empty) in runs of about ``most`` characters, one text at least."""
    held, size, most = [], 0, most or BLOCK_CHARS
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(path: str, schema) -> Callable:
    """The last column, a text, becomes its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            counts = [n for block in blocks(batch.column(batch.num_columns - 1).to_pylist()) for n in counter.count(block)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], schema.names)

    return run


def add_counts(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``text`` in a new column ``name``; the other columns stay."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {name} already")
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.select("*", F.col(f"`{text}`").cast("string").alias(name)).mapInArrow(_counted(path, schema), schema)


def count_docs(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row."""
    rows = only(docs, doc_id="long", text="string").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").alias("n_tokens"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in rows.columns])
    counted = rows.mapInArrow(_counted(path, schema), schema)
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
