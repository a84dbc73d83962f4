"""Alignment of two tokenizers over the bytes of a text by elementary intervals.

The ends of all tokens of both sides cut a text into elementary intervals: the union of both end arrays.
Each interval lies in one token of either side, found by a binary search in that side's ends, and is the
overlap of these two tokens; every overlap of two tokens is one interval, as tokens are contiguous. Ends that
both sides share close a group. What a group holds, its ids on both sides, is written as ``a1,a2|b1``.

A text is cut into words at single spaces and before single line ends. Neither side has a token that
reaches over such a cut, so the words can be aligned one by one: the distinct new words of many texts are
encoded, laid end to end and aligned by one union and two searches, and a text is put together from its
words. Texts with other white space, and texts with a word whose bytes one side does not give back, are
aligned whole. Alignments of words are remembered, up to ``CACHE_WORDS``.

How often an id pair is linked in the whole corpus, and the most of each id of side B, comes from Spark:
every text carries its distinct pairs with their number, these are counted, and the counts are joined back
to the pairs of the texts. The pairs with the most links are broadcast as far as their counted rows fit
(``BROADCAST_BYTES``); the others are joined by shuffle.

Defined results: NULL and empty texts, and texts whose tokens give other bytes than a space and the text on
either side, have no tokens: zeros, and '' for the groups. Repeated rows and NULL ids are aligned row by
row and all count; an empty table gives an empty table; other columns are ignored; strings of special
tokens are plain text; texts are aligned whole whatever their length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PRE_SPLIT, byte_chars
from .common import BROADCAST_BYTES, only, row_bytes, save
from .token_counts import blocks, words_of

#: Words kept with their alignments in one Python worker; beyond it the table starts anew.
CACHE_WORDS = 400_000
#: Characters of texts that are aligned together.
BLOCK_CHARS = 1 << 20
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Side:
    """One tokenizer over spans that begin with the white space before them, and the bytes of each of its ids."""

    #: Whether the tokens of any text give its bytes back.
    lossless = False

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes = token_bytes
        self.sizes = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))

    def words(self, spans: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each span) of spans that no token reaches over; ``lengths`` are their bytes."""
        return self.texts(spans)

    def texts(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for spans that are whole texts with a space before them."""
        found = self.encode(spans)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts

    def encode(self, spans: list[str]) -> list[list[int]]:
        raise NotImplementedError


class ByteLevel(Side):
    """A byte-level BPE file of the tokenizers library; special strings are plain text.

    Its ids stand in the order of its merges, so they are ranks for tiktoken, which is several times faster.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, split = spec["model"]["vocab"], spec["pre_tokenizer"] or {}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made != sorted(made) or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("not a byte-level file with ids in the order of its merges")
        to_byte = byte_chars()
        added = {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
        entry = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if i not in added}
        self.coder = tiktoken.Encoding("file", pat_str=PRE_SPLIT.pattern, mergeable_ranks={b: i for i, b in entry.items()}, special_tokens={})
        self.lossless = set(map(int.to_bytes, range(256))) <= set(entry.values())
        entry |= added
        super().__init__([entry.get(i, b"") for i in range(max(entry) + 1)])

    def words(self, spans: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.coder.encode_ordinary("".join(spans)), np.int64)  # one call for all; it loses no byte
        return ids, np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(lengths), side="right"), prepend=0)

    def encode(self, spans: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(s) for s in spans]


class Pieces(Side):
    """A sentencepiece model with byte fallback that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in names):
            raise ValueError("a piece reaches over a space or holds a line end: words cannot be encoded one by one")
        self.space = self.model.piece_to_id("▁")
        super().__init__([bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in names])

    def encode(self, spans: list[str]) -> list[list[int]]:
        # the model adds the space that a span has before it; before a line end it stands alone and goes again
        found = self.model.encode([s.removeprefix(" ") for s in spans], num_threads=1)
        return [ids[1:] if s[0] == "\n" and ids[0] == self.space else ids for s, ids in zip(spans, found)]


@dataclass
class Table:
    """Aligned spans, as columns."""

    right: np.ndarray  # both sides give the span's bytes back
    counts: np.ndarray  # tokens of A, of B, groups and links
    groups: list[str]
    pairs: np.ndarray  # the id pairs of all links, as numbers, end to end
    begins: np.ndarray  # where each span's links begin

    def plus(self, more: Table) -> Table:
        columns = [np.concatenate(x) for x in ((self.right, more.right), (self.counts, more.counts), (self.pairs, more.pairs), (self.begins, more.begins + len(self.pairs)))]
        return Table(columns[0], columns[1], self.groups + more.groups, columns[2], columns[3])

    def links(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, how many) of the links of ``rows``, one row after the other."""
        n = self.counts[rows, 3].astype(np.int64)
        ends = np.cumsum(n)
        return self.pairs[np.repeat(self.begins[rows] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n


EMPTY = Table(np.zeros(0, bool), np.zeros((0, 4), np.int32), [], np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Texts:
    """Aligned texts of a block: counts, groups in writing, and distinct pairs with the links of each."""

    right: np.ndarray
    counts: np.ndarray
    groups: list[str]
    offsets: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


class Aligner:
    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.known: dict[str, int] = {}
        self.table = EMPTY
        numbers = [str(i) for i in range(max(len(a.token_bytes), len(b.token_bytes)))]
        # an id with what follows it: another of its side, side B, the next group
        self.written = [n + after for n in numbers for after in (",", "|", ";")]
        self.bits = (len(a.token_bytes) * len(b.token_bytes)).bit_length()

    def align(self, spans: list[str], words: bool) -> Table:
        """Align every span, all in one pass over their end arrays laid end to end; ``words``: no token reaches over a span's end."""
        if not spans:
            return EMPTY
        body = "".join(spans).encode()
        # the bytes of each span, from where its characters begin
        first = np.flatnonzero((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)
        lengths = np.diff(np.r_[first, len(body)][np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))], prepend=0)
        flat, counts = zip(*[side.words(spans, lengths) if words else side.texts(spans) for side in (self.a, self.b)])
        right = self._right(body, lengths, flat, counts)
        if not right.all():
            flat = [ids[np.repeat(right, n)] for ids, n in zip(flat, counts)]
            counts, lengths = [np.where(right, n, 0) for n in counts], np.where(right, lengths, 0)
        ends = [np.cumsum(side.sizes[ids]) for side, ids in zip((self.a, self.b), flat)]
        last = np.cumsum(lengths)  # where spans end
        # elementary intervals, and the token of either side that holds each
        cuts = np.union1d(*ends)
        owner = [np.searchsorted(e, cuts) for e in ends]
        pairs = flat[0][owner[0]] * len(self.b.token_bytes) + flat[1][owner[1]]
        # groups end where both sides do
        shared = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(shared, e) for e in ends]
        closes = [np.diff(g, append=-1) != 0 for g in group]
        # the groups in writing: a token's place is its own plus the other side's tokens before it
        place = [np.arange(len(g)) for g in group]
        said = np.empty(len(place[0]) + len(place[1]), np.int64)
        said[place[0] + np.searchsorted(group[1], group[0])] = flat[0] * 3 + closes[0]
        said[place[1] + np.searchsorted(group[0], group[1], side="right")] = flat[1] * 3 + closes[1] * 2
        tokens = list(map(self.written.__getitem__, said.tolist()))
        stops = np.cumsum(counts[0] + counts[1]).tolist()
        groups = ["".join(tokens[i:j])[:-1] for i, j in zip([0, *stops], stops)]
        till = [np.searchsorted(x, last, side="right") for x in (shared, cuts)]
        return Table(right, np.stack([*counts, *[np.diff(t, prepend=0) for t in till]], axis=1).astype(np.int32), groups, pairs, np.r_[0, till[1][:-1]])

    def _right(self, body: bytes, lengths: np.ndarray, flat, counts) -> np.ndarray:
        """Whether both sides give the bytes of each span back."""
        right, stops = np.ones(len(lengths), bool), np.cumsum(lengths)
        for side, ids, n in zip((self.a, self.b), flat, counts):
            if side.lossless:
                continue
            back = b"".join(map(side.token_bytes.__getitem__, ids.tolist()))
            at = np.r_[0, np.cumsum(side.sizes[ids])][np.cumsum(n)]  # where each span ends in ``back``
            if back == body and np.array_equal(at, stops):
                continue
            for k, (i, j, x, y) in enumerate(zip([0, *at.tolist()], at.tolist(), [0, *stops.tolist()], stops.tolist())):
                right[k] &= back[i:j] == body[x:y]
        return right

    def texts(self, texts: list[str]) -> Texts:
        """Align a space and each text, from its words where it can be cut into words, else whole."""
        cut = [words_of(t) for t in texts]
        words = set().union(*filter(None, cut))
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.table = {}, EMPTY
            new = words
        new = list(new)
        self.known |= zip(new, range(len(self.known), len(self.known) + len(new)))
        self.table = self.table.plus(self.align([w if w[0] == "\n" else " " + w for w in new], words=True))
        rows = [np.fromiter(map(self.known.__getitem__, mine or ()), np.int64, len(mine or ())) for mine in cut]
        whole = [k for k, t in enumerate(texts) if t and not (len(rows[k]) and self.table.right[rows[k]].all())]
        for k in whole:
            rows[k] = rows[k][:0]
        apart = self.align([" " + texts[k] for k in whole], words=False)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat, owner = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), sizes)
        counts = np.stack([np.bincount(owner, self.table.counts[flat, i], len(rows)) for i in range(4)], axis=1).astype(np.int64)
        counts[whole] = apart.counts
        right = sizes > 0
        right[whole] = apart.right
        strings = self.table.groups
        groups = [";".join(map(strings.__getitem__, mine.tolist())) for mine in rows]
        for k, text in zip(whole, apart.groups):
            groups[k] = text
        found = [self.table.links(flat), apart.links(np.arange(len(whole)))]
        keys = np.concatenate([np.repeat(of, n) << self.bits | pairs for of, (pairs, n) in zip((owner, np.array(whole, np.int64)), found)])
        distinct, times = _counted(keys)
        offsets = np.searchsorted(distinct, np.arange(len(texts) + 1) << self.bits)
        return Texts(right, counts, groups, offsets, distinct & ((1 << self.bits) - 1), times)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[begins], np.diff(begins, append=len(keys))


@lru_cache(maxsize=1)
def load(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(ByteLevel(byte_path), Pieces(piece_path))


COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align_texts(docs: DataFrame, byte_path: str, piece_path: str, written: bool = False) -> DataFrame:
    """A row per document: tokens, groups and links, the groups' hash, its distinct pairs and the links of each; ``written`` adds ``groups``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(byte_path, piece_path)
        for batch in batches:
            ids, at = batch.column(0), 0
            for block in blocks(batch.column(1).to_pylist(), BLOCK_CHARS):
                found = aligner.texts(block)
                hashes = [hashlib.sha256(g.encode()).hexdigest() if ok else "" for g, ok in zip(found.groups, found.right.tolist())]
                offsets = pa.array(found.offsets, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(found.pairs)), pa.ListArray.from_arrays(offsets, pa.array(found.times, pa.int32()))]
                columns = [ids.slice(at, len(block)), *[pa.array(c) for c in found.counts.T.copy()], pa.array(hashes, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(found.groups, pa.string())] if written else [])], names)
                at += len(block)

    schema = COLUMNS + (", groups string" if written else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return only(docs, doc_id="long", text="string").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, b_ids: int) -> DataFrame:
    """(pair, links, best): links of each pair in all documents; ``best`` where no pair of its B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("n"))
    counted = save(each.groupBy("pair").agg(F.sum("n").alias("links")), "pairs").withColumn("b", F.pmod("pair", F.lit(b_ids)))
    most = counted.groupBy("b").agg(F.max("links").alias("most"))
    return counted.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align_docs(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The contract's row per document: counts, links among the best of their B id, sum of the links' counts, hash of the groups."""
    import sentencepiece

    b_ids = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    aligned = save(align_texts(docs, byte_path, piece_path).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = save(pair_counts(aligned, b_ids), "pair-counts")
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("n"))
    fit = BROADCAST_BYTES // row_bytes(counts)
    if counts.rows <= fit:
        found = each.join(F.broadcast(counts), "pair")
    else:
        # pairs by the power of two of their links: the most frequent ones that fit are broadcast, the rest meets by shuffle
        counts = counts.withColumn("size", F.floor(F.log2("links")).cast("int"))
        classes = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.count("*").alias("n")).collect()}  # 63 rows at most
        held, least = 0, 64
        for size in sorted(classes, reverse=True):
            held += classes[size]
            if held > fit:
                break
            least = size
        many, few = counts.where(F.col("size") >= least).drop("size"), counts.where(F.col("size") < least).drop("size")
        met = each.join(F.broadcast(many), "pair", "left")
        rest = met.where("links is null").drop("links", "best")
        found = met.where("links is not null").unionByName(rest.join(few.hint("shuffle_merge"), "pair"))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    out = aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
