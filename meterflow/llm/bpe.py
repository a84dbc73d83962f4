"""Byte-pair encoding and decoding with an automaton over token labels.

Compilation starts from one state with an arc back to itself for each byte and applies one gadget for
each merge (u, v) -> w in rank order: wherever an arc u leads to a state with an arc v, that state is
replaced, for u only, by a copy without the arc v, and an arc w to the target of v is added. All arcs
with one label lead to one state, so a state is known by the label that leads to it, and its missing
arcs by the copies made so far. The automaton accepts exactly the sequences that merging in rank order
yields, one for every byte string.

A copy of a copy keeps what was removed before it was made, and an arc added before a removal stays.
So an arc w leaves the state after t unless some merge (a, b) blocks it, where a is t or lies on the
chain of right parts of t, b is w or lies on the chain of left parts of w, and the merge ranks before
the parts above a and above b were put together (for b also in the same merge, when a token merges
with itself: the cut comes before the new arc).

The finished automaton is compiled into a table. Labels are numbered in post-order of the tree of left
parts, younger subtrees first, so that what one merge (a, b) blocks is one interval of numbers: b itself
and the subtrees below it that were made later. A state's row is the sorted union of the intervals of its
chain of right parts; equal rows are kept once (states that no word tells apart), which gives the minimal
number of rows. For 50,000 labels that is about a million bounds in two flat arrays, fixed before the
first text, and a transition is one bisection.

Encoding walks a byte trie of the labels from each position of a word; the first arc that reaches a
position is the only one. Decoding emits the labels of the arcs.

Defined results: NULL text is encoded as the empty text (no tokens); the added token's string in a
text is that token, as in the tokenizers library; repeated rows and NULL ids are carried as they are;
whole texts of any length are encoded; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import only

#: Fixed value: the pattern that splits text before merging.
PRE_SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Words kept with their encodings in one Python worker; beyond it the table starts anew.
CACHE_WORDS = 500_000


def byte_chars() -> dict[str, int]:
    """The printable stand-in for each byte: itself if printable in Latin-1, else counted from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list, added: list[tuple[str, int]] = ()):
        to_byte = byte_chars()
        self.labels: dict[int, bytes] = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.added = {content: i for content, i in added}
        self.labels |= {i: content.encode() for content, i in added}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left part, right part, rank
        for rank, (left, right) in enumerate(merges):
            self._gadget(vocab[left], vocab[right], vocab[left + right], rank)
        self.trie: dict = {}
        live = {t for t in self.labels if len(self.labels[t]) == 1} | set(self.parts)
        self._compile(live - set(self.added.values()))
        for t in live - set(self.added.values()):
            node = self.trie
            for b in self.labels[t]:
                node = node.setdefault(b, {})
            node[-1] = t
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _gadget(self, u: int, v: int, w: int, rank: int) -> None:
        """Cut v behind u and add w, if the automaton so far has arcs u and v and lets v follow u."""
        there = all(t in self.parts or len(self.labels[t]) == 1 for t in (u, v))
        if there and w not in self.parts and self._open(u, v):
            self.rank[u, v] = rank
            self.parts[w] = (u, v, rank)

    def _open(self, t: int, w: int) -> bool:
        after, never = t, len(self.rank) + (1 << 40)
        made_after = never
        while True:
            ahead, made_ahead = w, never
            while True:
                r = self.rank.get((after, ahead))
                if r is not None and r < made_after and r <= made_ahead:
                    return False
                p = self.parts.get(ahead)
                if p is None:
                    break
                ahead, _, made_ahead = p
            p = self.parts.get(after)
            if p is None:
                return True
            _, after, made_after = p

    def _compile(self, live: set[int]) -> None:
        """Number the labels and tabulate, for each state, the intervals of labels whose arcs are missing."""
        above: dict[int, list[tuple[int, int]]] = {}
        for w, (left, _, rank) in self.parts.items():
            above.setdefault(left, []).append((rank, w))
        for made in above.values():
            made.sort()
        number, start = {}, {}
        todo = [(t, False) for t in sorted(live - set(self.parts), reverse=True)]
        while todo:
            t, left = todo.pop()
            if left:
                number[t] = len(number)
                continue
            start[t] = len(number)
            todo.append((t, True))
            todo += [(w, False) for _, w in reversed(above.get(t, ()))]
        cuts: dict[int, list[tuple[int, int, int]]] = {}  # left token: rank, first and last blocked number
        for (a, b), rank in self.rank.items():
            later = above.get(b, [])
            k = bisect_left(later, (rank, -1))
            cuts.setdefault(a, []).append((rank, start[later[k][1]] if k < len(later) else number[b], number[b]))
        self.number = [-1] * (max(self.labels, default=-1) + 1)
        for t, n in number.items():
            self.number[t] = n
        self.row = [0] * len(self.number)
        self.begin, self.low, self.high, known = [0], array("i"), array("i"), {}
        for t in sorted(live):
            found, after, made = [], t, None
            while True:
                found += [(lo, hi) for rank, lo, hi in cuts.get(after, ()) if made is None or rank < made]
                p = self.parts.get(after)
                if p is None:
                    break
                _, after, made = p
            merged: list[tuple[int, int]] = []
            for lo, hi in sorted(found):
                if merged and lo <= merged[-1][1] + 1:
                    merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
                else:
                    merged.append((lo, hi))
            key = tuple(merged)
            if key not in known:
                known[key] = len(self.begin) - 1
                self.low.extend(lo for lo, _ in merged)
                self.high.extend(hi for _, hi in merged)
                self.begin.append(len(self.low))
            self.row[t] = known[key]

    def arc(self, t: int, w: int) -> bool:
        """Whether an arc w leaves the state after t."""
        r, n = self.row[t], self.number[w]
        i = bisect_right(self.low, n, self.begin[r], self.begin[r + 1]) - 1
        return i < self.begin[r] or self.high[i] < n

    def encode_word(self, word: bytes) -> list[int]:
        n, arc = len(word), self.arc
        token: list[int] = [-1] * (n + 1)  # the label that reaches a position, and where its arc began
        began = [0] * (n + 1)
        for i in range(n):
            node, before = self.trie, token[i]
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                t = node.get(-1)
                if t is not None and token[j + 1] < 0 and (i == 0 or arc(before, t)):
                    token[j + 1], began[j + 1] = t, i
        out, i = [], n
        while i:
            out.append(token[i])
            i = began[i]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


class _Pieces(dict):
    """pre-split word -> (number of ids, decimal ids joined by commas, decoded bytes), filled on demand."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str):
        ids = self.automaton.encode_word(word.encode())
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = (len(ids), ",".join(map(str, ids)), b"".join(map(self.automaton.labels.__getitem__, ids)))
        return found


class _Words(dict):
    """The same for what stands between two single spaces, with the space before it."""

    def __init__(self, pieces: _Pieces, lead: str = ""):
        super().__init__()
        self.pieces, self.lead = pieces, lead

    def __missing__(self, word: str):
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Run  # a run of white space: its split depends on more than this word
        parts = [self.pieces[p] for p in PRE_SPLIT.findall(self.lead + word)]
        found = parts[0] if len(parts) == 1 else (sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), b"".join([p[2] for p in parts]))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


class _Run(Exception):
    pass


class Encoder:
    """Encodes whole texts, remembering the words it has met."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.pieces = _Pieces(automaton)
        self.bare, self.spaced = _Words(self.pieces), _Words(self.pieces, " ")
        self.newline = self.pieces["\n"]

    def parts(self, text: str) -> list[tuple[int, str, bytes]]:
        """The encodings of the parts of ``text``, in order."""
        if self.automaton.split_added is None:
            return self._plain(text)
        out: list = []
        for k, piece in enumerate(self.automaton.split_added.split(text)):
            if k % 2:
                t = self.automaton.added[piece]
                out.append((1, str(t), self.automaton.labels[t]))
            elif piece:
                out += self._plain(piece)
        return out

    def _plain(self, text: str) -> list:
        # one space or line end between words: each word splits and merges by itself
        try:
            out: list = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                out.append(self.bare[first])
                out += map(self.spaced.__getitem__, rest)
                out.append(self.newline)
            out.pop()
            return out
        except _Run:
            return [self.pieces[p] for p in PRE_SPLIT.findall(text)]


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    added = [(a["content"], a["id"]) for a in spec["added_tokens"]]
    return Encoder(Automaton(spec["model"]["vocab"], merges, added))


def encode_text(encoder: Encoder, text: str) -> list[int]:
    return [int(i) for _, ids, _ in encoder.parts(text) if ids for i in ids.split(",")]


def encode_docs(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the operator's own output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for batch in batches:
            rows = [encode_text(encoder, t or "") for t in batch.column(1).to_pylist()]
            decoded = [encoder.automaton.decode(ids) for ids in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_docs(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and hashes of ids and decoded text, without moving the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for value in batch.column(1):
                parts = encoder.parts(value.as_py() or "")
                n.append(sum([p[0] for p in parts]))
                ids_hash.append(hashlib.sha256(",".join([p[1] for p in parts if p[1]]).encode()).hexdigest())
                decoded = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return only(docs, doc_id="long", text="string").mapInArrow(run, schema)
