"""Toxicity of whole texts by a bidirectional gated recurrent network with attention pooling.

Each word enters with a word input and a character input, both learnt with the network: a hashed
embedding of the word and the mean of hashed embeddings of its byte n-grams of 3 to 6. Beside them stand
six numbers that say how strongly the word and its n-grams lean to either class in the training sample
(signed z-scores of document frequencies, kept in hashed tables) and how long it is; a share of the
embeddings is dropped in training, so that neither input does all the work. Two GRUs read a window of
64 words in both directions, attention weighs their states, and a logistic unit gives the window's
probability. A text is scored in all windows that overlap by half, and takes the largest.

The network is trained in numpy, in one task, on a bounded sample of labelled documents: ``SAMPLE`` toxic
ones and ``CLEAN`` times as many clean ones, least hashes of doc_id first, ``SAMPLE_BYTES`` of text of
each class at most (whole texts), one row per doc_id. Each training text is described without its own
counts, so that words seen once teach nothing; the windows it learns from are the highest-scoring ones of
each text, chosen again between rounds. At last the scores of the sample are calibrated by a logistic fit
in which the classes weigh as much as they do among all labelled documents that may be learnt from.

Scoring is one pass over the documents without a shuffle: projected inputs are computed once for each
distinct word of a task, then the recurrence runs over many windows at once.

Defined results: NULL or wordless texts are scored as one empty window; a NULL doc_id is scored and is
never held out or learnt from; repeated label rows count once (toxic if any says so); repeated rows are
scored alike, and of rows that share a doc_id the least text is learnt from; with labels of one class only, every score is that class's share; an empty table gives
an empty table; other columns are carried by ``reject_toxic`` and ignored by ``score_docs``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, remainder, save, small_batches, unused
from .shingles import mix

SAMPLE, CLEAN, SAMPLE_BYTES = 1500, 1, 24 << 20
WIDTH, STRIDE = 64, 32
#: Numbers, word and character inputs of a word.
STATS, WORD_DIM, CHAR_DIM = 6, 8, 8
HIDDEN, ATTEND, INPUTS = 8, 8, STATS + WORD_DIM + CHAR_DIM
#: Rows of the embedding tables, by the low bits of the buckets.
WORD_ROWS, CHAR_ROWS = 1 << 16, 1 << 17
THRESHOLD = 0.7
WORD_BITS, GRAM_BITS = 18, 20
GRAMS = (3, 4, 5, 6)
#: Windows of a text that training may choose from, by their counted numbers; scores and calibration use all.
CANDIDATES = 8
#: Windows of a training step, fewer where the sample is small.
BATCH = 256
_PUNCTUATION = b" \t.,;:!?\"'()[]{}<>*_-#%&$|/\\"


# inputs ------------------------------------------------------------------------------------------
def word_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, n-gram buckets padded with -1, lengths) of whole words of any length."""
    words = [b"^" + w.strip(_PUNCTUATION) + b"$" for w in words]
    sizes = np.array([len(w) for w in words])
    width = int(sizes.max())
    letters = np.zeros((len(words), width), dtype=np.uint8)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    letters[np.arange(width) < sizes[:, None]] = flat
    seed = letters.astype(np.uint64) + np.uint64(1)
    rolled, out, whole = np.zeros_like(seed), [], np.zeros(len(words), dtype=np.uint64)
    for i in range(width):  # letters beyond the end change nothing
        whole = np.where(i < sizes, mix(whole + seed[:, i] * np.uint64(0x9E3779B97F4A7C15)), whole)
    rolled = seed
    for n in range(2, max(GRAMS) + 1):
        if width < n:
            break
        rolled = mix(rolled[:, :-1] * np.uint64(0xC2B2AE3D27D4EB4F) + seed[:, n - 1 :])
        if n in GRAMS:
            bucket = (rolled >> np.uint64(64 - GRAM_BITS)).astype(np.int32)
            bucket[np.arange(bucket.shape[1]) + n > sizes[:, None]] = -1
            out.append(bucket)
    grams = np.concatenate(out, axis=1) if out else np.full((len(words), 1), -1, dtype=np.int32)
    return (whole >> np.uint64(64 - WORD_BITS)).astype(np.int32), grams, sizes - 2


def by_width(words: list[bytes]) -> Iterator[np.ndarray]:
    """Places of words of like length, so that one long word does not widen all."""
    sizes = np.array([len(w) for w in words])
    for low, high in [(0, 12), (12, 24), (24, 64), *((64 << i, 64 << i + 1) for i in range(25))]:
        at = np.flatnonzero((sizes >= low) & (sizes < high))
        for start in range(0, len(at), max(1, 1_000_000 // (high * 8))):
            yield at[start : start + max(1, 1_000_000 // (high * 8))]


def statistics(word_z: np.ndarray, gram_z: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(n, STATS) from the word's z, its n-grams' z (NaN where there is none) and its length."""
    some = ~np.isnan(gram_z)
    high = np.where(some, gram_z, -99)
    top = high.max(axis=1)
    top = np.where(some.any(axis=1), top, 0)
    kinds = np.maximum(some.sum(axis=1), 1)
    mean = np.where(some, gram_z, 0).sum(axis=1) / kinds
    strong = (high > 2).sum(axis=1) / kinds
    low = np.where(some.any(axis=1), np.where(some, gram_z, 99).min(axis=1), 0)
    x = np.stack([word_z / 3, top / 3, mean, low / 3, strong * 2, np.minimum(sizes, 20) / 10], axis=1)
    return np.clip(x, -4, 4).astype(np.float32)


def leaning(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float) -> np.ndarray:
    """Signed z-score of the log ratio of two document frequencies; 0 where nothing was seen."""
    pa_, pb = n_a / (n_a + n_b), n_b / (n_a + n_b)
    # places of padding may have fallen below zero by leaving a text out
    a, b = np.maximum(a, 0) + pa_, np.maximum(b, 0) + pb
    return (np.log(a / (n_a + 1)) - np.log(b / (n_b + 1)) - np.log(pa_ / (n_a + 1)) + np.log(pb / (n_b + 1))) / np.sqrt(1 / a + 1 / b)


def windows(n: int) -> np.ndarray:
    """Starts of all windows over n words, half overlapping, the last one ending with the text."""
    if n <= WIDTH:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n - WIDTH, STRIDE), n - WIDTH)


def by_owner(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` that each of n owners has; ``owner`` is sorted."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(owner):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def embedded(words: np.ndarray, chars: np.ndarray, bucket: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """(n, WORD_DIM + CHAR_DIM): the word's row, and the mean of its n-grams' rows (padding is -1)."""
    out = np.zeros((len(bucket), WORD_DIM + CHAR_DIM), np.float32)
    out[:, :WORD_DIM] = words[bucket % WORD_ROWS]
    there = grams >= 0
    at, k = np.nonzero(there)
    total = by_owner(chars[grams[at, k] % CHAR_ROWS].astype(np.float32), at, len(bucket))
    out[:, WORD_DIM:] = total / np.maximum(there.sum(axis=1), 1)[:, None]
    return out


# network -----------------------------------------------------------------------------------------
def fresh_network(seed: int = 7) -> dict[str, np.ndarray]:
    """Weights; the first axis of W, U and b is the direction."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else shape[0])).astype(np.float32)
    return {
        "W": draw(2, INPUTS, 3 * HIDDEN), "U": draw(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
        "A": draw(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": draw(ATTEND), "w": draw(2 * HIDDEN), "c": np.zeros(1, np.float32),
    }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _gru(projected: np.ndarray, U: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, 2, n, H) after each step; ``projected`` (T, 2, n, 3H) holds the inputs' share of the gates, each direction in its own order."""
    T, _, n, _ = projected.shape
    H = HIDDEN
    h, out = np.zeros((2, n, H), projected.dtype), np.empty((T, 2, n, H), projected.dtype)
    for t in range(T):
        g, hu = projected[t], h @ U
        zr = sigmoid(g[..., : 2 * H] + hu[..., : 2 * H])
        z, r = zr[..., :H], zr[..., H:]
        c = np.tanh(g[..., 2 * H :] + r * hu[..., 2 * H :])
        if keep is not None:
            keep.append((h, z, r, c, hu[..., 2 * H :]))
        h = c + z * (h - c)
        out[t] = h
    return out


def forward(net: dict, projected: np.ndarray, there: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of n windows. projected: (T, 2, n, 3H), backward direction last word first; there: (n, T) real words."""
    kept = [] if keep is not None else None
    both = _gru(projected, net["U"], kept)
    states = np.concatenate([both[:, 0], both[::-1, 1]], axis=2)  # (T, n, 2H) in order of the words
    tanhs = np.tanh(states @ net["A"] + net["a"])
    e = np.where(there.T, tanhs @ net["v"], -1e9)
    weight = np.exp(e - e.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    if keep is not None:
        keep |= {"kept": kept, "states": states, "tanhs": tanhs, "weight": weight, "pooled": pooled}
    return pooled @ net["w"] + net["c"][0]


def project(net: dict, x: np.ndarray) -> np.ndarray:
    """(T, 2, n, 3H) of inputs x (n, T, INPUTS)."""
    flat = x.transpose(1, 0, 2)
    return np.stack([flat @ net["W"][0] + net["b"][0], flat[::-1] @ net["W"][1] + net["b"][1]], axis=1)


def gradients(net: dict, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Mean logistic loss of windows x (n, T, INPUTS), its gradients, and that of the inputs."""
    n, T, _ = x.shape
    H, keep = HIDDEN, {}
    logit = forward(net, project(net, x), there, keep)
    p = sigmoid(logit)
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    d = ((p - y) / n).astype(x.dtype)
    weight, states, tanhs = keep["weight"], keep["states"], keep["tanhs"]
    out = {"w": keep["pooled"].T @ d, "c": np.array([d.sum()], x.dtype)}
    dpool = d[:, None] * net["w"]
    dweight = (dpool * states).sum(axis=2)
    de = weight * (dweight - (weight * dweight).sum(axis=0))
    out["v"] = np.einsum("tna,tn->a", tanhs, de)
    dh = de[:, :, None] * net["v"] * (1 - tanhs * tanhs)
    out["A"] = np.einsum("tns,tna->sa", states, dh, optimize=True)
    out["a"] = dh.sum(axis=(0, 1))
    dstates = weight[:, :, None] * dpool + dh @ net["A"].T
    each = np.stack([dstates[:, :, :H], dstates[::-1, :, H:]], axis=1)  # (T, 2, n, H), each direction in its own order
    U, back = net["U"].transpose(0, 2, 1), np.zeros((2, n, H), x.dtype)
    dU, gates = np.zeros_like(net["U"]), np.empty((T, 2, n, 3 * H), x.dtype)
    for t in range(T - 1, -1, -1):
        h, z, r, c, uc = keep["kept"][t]
        back = back + each[t]
        dz, dc = back * (h - c) * z * (1 - z), back * (1 - z) * (1 - c * c)
        dr = dc * uc * r * (1 - r)
        gates[t] = np.concatenate([dz, dr, dc], axis=2)
        through = np.concatenate([dz, dr, dc * r], axis=2)
        dU += h.transpose(0, 2, 1) @ through
        back = back * z + through @ U
    flat = x.transpose(1, 0, 2)
    out |= {"U": dU, "b": gates.sum(axis=(0, 2))[:, None]}
    out["W"] = np.stack([np.tensordot(flat, gates[:, 0], ([0, 1], [0, 1])), np.tensordot(flat[::-1], gates[:, 1], ([0, 1], [0, 1]))])
    dx = gates[:, 0] @ net["W"][0].T + gates[::-1, 1] @ net["W"][1].T
    return loss, out, dx.transpose(1, 0, 2)


@dataclass
class Model:
    net: dict
    word_z: np.ndarray  # int8, eighths
    gram_z: np.ndarray
    words: np.ndarray  # float16 embeddings
    chars: np.ndarray
    share: float | None = None  # of toxic rows, where only one class was there to learn from


class _Sample:
    """Training texts as places in tables: their words, and what the words look like without the text's own counts."""

    def __init__(self, texts: list[str], y: np.ndarray):
        self.y, n_a, n_b = y, float(y.sum()), float(len(y) - y.sum())
        vocabulary: dict[bytes, int] = {}
        ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.lower().encode().split()], dtype=np.int64) for t in texts]
        known = list(vocabulary) or [b""]
        self.bucket, size = np.zeros(len(known), np.int32), np.zeros(len(known), np.int32)
        grams: list = [None] * len(known)
        for at in by_width(known):
            self.bucket[at], g, size[at] = word_buckets([known[i] for i in at])
            for i, row in zip(at, g):
                grams[i] = row[row >= 0]
        self.edges = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
        self.grams = np.concatenate(grams)
        df = {k: np.zeros((2, 1 << bits), np.float32) for k, bits in (("word", WORD_BITS), ("gram", GRAM_BITS))}
        for row, label in zip(ids, y.astype(int)):
            mine = np.unique(row)
            df["word"][label, np.unique(self.bucket[mine])] += 1
            if len(mine):
                df["gram"][label, np.unique(np.concatenate([grams[i] for i in mine]))] += 1
        described, place, word, starts, lengths, owner, held = [np.zeros((1, STATS), np.float32)], [], [], [], [], [], 1
        begin = 0
        for d, (row, label) in enumerate(zip(ids, y)):
            mine, back = np.unique(row, return_inverse=True)
            a, b = n_a - label, n_b - (1 - label)
            stats = np.zeros((len(mine), STATS), np.float32)
            if len(mine) and a and b:
                g = np.full((len(mine), max(max(len(grams[i]) for i in mine), 1)), -1, np.int32)
                for k, i in enumerate(mine):
                    g[k, : len(grams[i])] = grams[i]
                zg = leaning(df["gram"][1][g] - label, df["gram"][0][g] - (1 - label), a, b)
                zw = leaning(df["word"][1][self.bucket[mine]] - label, df["word"][0][self.bucket[mine]] - (1 - label), a, b)
                stats = statistics(zw, np.where(g >= 0, zg, np.nan), size[mine])
            described.append(stats)
            place.append(back + held)
            word.append(row)
            s = windows(len(row))
            starts.append(s + begin)
            lengths.append(np.minimum(len(row) - s, WIDTH))
            owner.append(np.full(len(s), d))
            held, begin = held + len(mine), begin + len(row)
        self.described = np.concatenate(described)
        # one place more, for what lies beyond the end of a text
        self.place, self.word = np.append(np.concatenate(place), 0).astype(np.int64), np.append(np.concatenate(word), -1).astype(np.int64)
        self.starts, self.lengths, self.owner = np.concatenate(starts), np.concatenate(lengths), np.concatenate(owner)
        eighths = lambda t: np.clip(np.round(leaning(t[1], t[0], n_a, n_b) * 8), -127, 127).astype(np.int8)
        self.word_z, self.gram_z = eighths(df["word"]), eighths(df["gram"])

    def cut(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the statistics, words, real words) of windows, each (n, WIDTH)."""
        real = np.arange(WIDTH) < self.lengths[at, None]
        where = np.where(real, self.starts[at, None] + np.arange(WIDTH), len(self.place) - 1)
        return self.place[where], self.word[where], real | (np.arange(WIDTH) == 0)

    def rows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams of some words, and the word (its number among them) of each."""
        n = self.edges[words + 1] - self.edges[words]
        at = np.repeat(self.edges[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.grams[at] % CHAR_ROWS, np.repeat(np.arange(len(words)), n)


def scaled_step(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """Move rows of a table against their summed gradients, scaled by all the squared ones that they have met."""
    order = np.argsort(rows, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], rows[order][1:] != rows[order][:-1]]))
    total, which = np.add.reduceat(gradient[order], starts, axis=0), rows[order][starts]
    seen[which] += (total * total).mean(axis=1)
    table[which] -= rate * total / np.sqrt(seen[which])[:, None]


def train(texts: list[str], labels: list[int], counts: tuple[float, float] | None = None, rounds: int = 3, epochs: int = 2, rate: float = 0.02, seed: int = 7, embed: bool = True) -> Model:
    """Fit tables, embeddings and network to a bounded sample; ``counts`` are the toxic and clean documents behind it."""
    y = np.array(labels, dtype=np.float32)
    n_a, n_b = float(y.sum()), float(len(y) - y.sum())
    blank = np.zeros((1, 1), np.float16)
    if not n_a or not n_b:
        return Model({}, np.zeros(1, np.int8), np.zeros(1, np.int8), blank, blank, float(n_a / len(y)) if len(y) else 0.0)
    sample = _Sample(texts, y)
    net, rng = fresh_network(seed), np.random.default_rng(seed)
    words, chars = np.zeros((WORD_ROWS, WORD_DIM), np.float32), np.zeros((CHAR_ROWS, CHAR_DIM), np.float32)
    seen_w, seen_c = np.full(WORD_ROWS, 1e-6, np.float32), np.full(CHAR_ROWS, 1e-6, np.float32)
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.items()}

    def built(at: np.ndarray, drop: float = 0.0):
        place, word, real = sample.cut(at)
        distinct, back = np.unique(word, return_inverse=True)
        back = back.reshape(word.shape)
        some = distinct[distinct >= 0]
        first = len(distinct) - len(some)  # 1 where a window has places without a word
        table = np.zeros((len(distinct), WORD_DIM + CHAR_DIM), np.float32)
        rows, of = sample.rows(some)
        n = np.maximum(np.bincount(of, minlength=len(some)), 1).astype(np.float32)
        if embed:
            table[first:, :WORD_DIM] = words[sample.bucket[some] % WORD_ROWS]
            table[first:, WORD_DIM:] = by_owner(chars[rows], of, len(some)) / n[:, None]
        stay = (rng.random(len(distinct)) >= drop).astype(np.float32)[:, None] if drop else None
        if drop:
            table *= stay
        x = np.concatenate([sample.described[place], table[back]], axis=2)
        return x, real, (distinct, back, some, first, rows, of, n, stay)

    def scores(at: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for i in range(0, len(at), 1024):
            x, real, _ = built(at[i : i + 1024])
            out.append(forward(net, project(net, x), real))
        return np.concatenate(out)

    def ranked(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows text by text, the highest first, and their ranks."""
        order = np.lexsort((-score, owner))
        return order, np.arange(len(order)) - np.searchsorted(owner[order], owner[order])

    strong = sample.described[:, 1] + sample.described[:, 0]
    score = np.concatenate([strong[sample.cut(np.arange(i, min(i + 4096, len(sample.owner))))[0]].max(axis=1) for i in range(0, len(sample.owner), 4096)])
    step, owner, batch = 0, sample.owner, BATCH if len(y) > 1000 else BATCH // 4
    order, rank = ranked(score)
    able = order[rank < CANDIDATES]  # the windows that training may choose from
    score = np.where(np.isin(np.arange(len(owner)), able), score, -np.inf)
    for turn in range(rounds):
        # the highest windows of each text: one of a toxic text, three of a clean one
        order, rank = ranked(score)
        chosen = order[(rank < np.where(y[owner[order]] == 1, 1, 3)) & np.isfinite(score[order])]
        goal = y[owner[chosen]]
        weight = np.where(goal == 1, (goal == 0).sum() / max((goal == 1).sum(), 1), 1.0)
        pick = rng.choice(len(chosen), size=2 * len(chosen), p=weight / weight.sum())
        for _ in range(epochs):
            for i in range(0, len(pick), batch):
                at = chosen[pick[i : i + batch]]
                x, real, (distinct, back, some, first, rows, of, n, stay) = built(at, 0.3)
                _, grad, dx = gradients(net, x, real, y[owner[at]])
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m[k][0] = 0.9 * m[k][0] + 0.1 * g
                    m[k][1] = 0.999 * m[k][1] + 0.001 * g * g
                    net[k] = net[k] - rate * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-8)
                if not embed or not len(some):
                    continue
                # embeddings by scaled steps: a row's rate falls with the squared gradients it has met
                flat = dx[:, :, STATS:].reshape(-1, WORD_DIM + CHAR_DIM)
                each = np.stack([np.bincount(back.ravel(), flat[:, k], len(distinct)) for k in range(flat.shape[1])], axis=1).astype(np.float32)
                each = (each * stay)[first:]
                bucket = sample.bucket[some] % WORD_ROWS
                scaled_step(words, seen_w, bucket, each[:, :WORD_DIM], 2 * rate)
                scaled_step(chars, seen_c, rows, (each[:, WORD_DIM:] / n[:, None])[of], 2 * rate)
            rng.shuffle(pick)
        rate *= 0.6
        if turn < rounds - 1:
            score[able] = scores(able)
    score = scores(np.arange(len(owner)))
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, owner, score)
    slope, shift = calibrated(best, y, *(counts or (n_a, n_b)))
    net["w"], net["c"] = net["w"] * slope, net["c"] * slope + shift
    return Model({k: v.astype(np.float32) for k, v in net.items()}, sample.word_z, sample.gram_z, words.astype(np.float16), chars.astype(np.float16))


def calibrated(score: np.ndarray, y: np.ndarray, all_a: float, all_b: float, ridge: float = 0.05) -> tuple[float, float]:
    """(slope, shift) of a logistic fit of ``y`` to ``score`` by Newton steps; classes weigh as in the whole, the slope stays near 1."""
    weight = np.where(y == 1, all_a / max(y.sum(), 1), all_b / max((1 - y).sum(), 1))
    weight, f = weight / weight.mean(), np.array([1.0, 0.0])
    x = np.stack([score.astype(np.float64), np.ones(len(y))], axis=1)
    for _ in range(50):
        p = sigmoid(np.clip(x @ f, -30, 30))
        slope = x.T @ (weight * (p - y)) / len(y) + ridge * np.array([f[0] - 1, 0])
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / len(y) + np.diag([ridge, 1e-6])
        move = np.linalg.solve(curve, slope)
        f = f - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    return (float(np.clip(f[0], 0.1, 5)), float(f[1])) if np.isfinite(f).all() else (1.0, 0.0)


class Scorer:
    """Scores texts, remembering the projected inputs of the words it has met."""

    LIMIT = 100_000

    def __init__(self, model: Model):
        self.model = model
        if model.share is None:
            self.reset()

    def reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.sides = self._project(np.zeros((1, INPUTS), np.float32))  # of no word

    def _project(self, x: np.ndarray) -> np.ndarray:
        net = self.model.net
        return np.stack([x @ net["W"][0] + net["b"][0], x @ net["W"][1] + net["b"][1]])

    def _learn(self, words: list[bytes]) -> None:
        if not words:
            return
        x = np.zeros((len(words), INPUTS), np.float32)
        for at in by_width(words):
            b, g, s = word_buckets([words[i] for i in at])
            z = np.where(g >= 0, self.model.gram_z[g] / np.float32(8), np.float32(np.nan))
            x[at, :STATS] = statistics(self.model.word_z[b] / np.float32(8), z, s)
            x[at, STATS:] = embedded(self.model.words, self.model.chars, b, g)
        self.sides = np.concatenate([self.sides, self._project(x)], axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.model.share is not None:
            return np.full(len(texts), self.model.share)
        if len(self.ids) > self.LIMIT:
            self.reset()
        rows, new, ids = [], [], self.ids
        for t in texts:
            words = t.lower().encode().split()
            for w in set(words).difference(ids):
                ids[w] = len(ids) + 1  # 0 is no word
                new.append(w)
            rows.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        self._learn(new)
        sizes = np.array([len(r) for r in rows])
        starts = [windows(n) for n in sizes]
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in starts])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])[owner]
        start = np.concatenate(starts)
        flat = np.append(np.concatenate(rows), 0)
        best = np.full(len(rows), -np.inf)
        for i in range(0, len(owner), 1024):
            place = start[i : i + 1024, None] + np.arange(WIDTH)
            own = owner[i : i + 1024]
            real = place < sizes[own, None]
            word = flat[np.where(real, place + begin[i : i + 1024, None], len(flat) - 1)].T
            projected = np.stack([self.sides[0][word], self.sides[1][word[::-1]]], axis=1)
            np.maximum.at(best, own, forward(self.model.net, projected, real | (np.arange(WIDTH) == 0)))
        return sigmoid(np.clip(best.astype(np.float64), -500, 500))


def _fitted(counts: tuple[float, float]):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")  # the same model whatever order the rows come in
        model = train([t or "" for t in rows.column("text").to_pylist()], rows.column("toxic").to_pylist(), counts)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on the bounded sample of the documents whose remainder is not 1; only the model, of fixed size, reaches the driver."""
    rows = only(labels, doc_id="long", toxic="int").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder("doc_id", 3) != 1))
    rows = rows.groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    sizes = only(docs, doc_id="long", text="string").groupBy("doc_id").agg(F.min(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    known = save(rows.join(sizes, "doc_id"), "labelled", toxic=F.count_if(F.col("toxic") == 1))
    counts = (float(known.measured.get("toxic") or 0), float(known.rows - (known.measured.get("toxic") or 0)))
    if not known.rows:
        return train([], [])
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = lambda c, n: known.where(f"toxic = {c}").orderBy(*order).limit(n)  # noqa: E731  sorted within tasks, so many rows of each at most
    upto = F.sum("bytes").over(Window.partitionBy("toxic").orderBy(*order))
    named = first(1, sample).union(first(0, CLEAN * sample)).withColumn("upto", upto).where((F.col("upto") <= sample_bytes) | (F.col("upto") == F.col("bytes")))
    # at most (1 + CLEAN) * sample ids: a proven bound for the broadcast, and with the bytes for the one group
    found = only(docs, doc_id="long", text="string").join(F.broadcast(named.select("doc_id", "toxic")), "doc_id")
    once = found.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    model = once.groupBy().applyInArrow(_fitted(counts), "model binary")
    return pickle.loads(save(model, "model").first()["model"])


def _scores(shared, text_at: int, name: str):
    scorer: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not scorer:
            scorer.append(Scorer(shared.value))
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                # so many texts at once that their windows are a few thousand
                end, held, texts = start, 0, []
                while end < batch.num_rows and (held < 300_000 or end == start):
                    texts.append(batch.column(text_at)[end].as_py() or "")
                    held += len(texts[-1])
                    end += 1
                part = batch.slice(start, end - start)
                scores = pa.array(scorer[0].score(texts), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*batch.schema.names, name])
                start = end

    return run


def with_scores(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` and the score of each row's text as a new column."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, whatever the input
    schema = docs.limit(0).withColumn(name, F.lit(0.0)).schema
    return docs.mapInArrow(_scores(shared, docs.columns.index("text"), name), schema)


def score_docs(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    base = only(docs, doc_id="long", text="string")
    scored = with_scores(base, fit(docs, labels), "_score")
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    score = unused(docs, "_score")
    return with_scores(docs, fit(docs, labels), score).where(F.col(score) < threshold).select(*docs.columns)
