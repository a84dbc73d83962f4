"""Token counts and alignment against the libraries, the filter audit against plain passes over all orders."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from meterflow.llm import alignment, filter_audit, queries, token_counts

from .conftest import frame, words

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "\xa0", "é", "日本", "١٢", "345", "'s", "'ll", "!", "...", "<|endoftext|>", "<s>", "<0x41>", "　", "▁", "😀", "\r\n", "aaaa", " foo", " bar,", "\x1c"]


def odd_texts(n, seed=7):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randrange(25))) for _ in range(n)] + ["", "a" * 3000, " " * 777, "ab" * 4000, " x", "x ", "\n", "\nx", "a  b\tc", "日本" * 500, "<|endoftext|> x"]


@pytest.fixture(scope="module")
def library():
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    return Tokenizer.from_file(BYTES), plain, sentencepiece.SentencePieceProcessor(model_file=PIECES)


# token counts --------------------------------------------------------------------------------------
def test_counts_are_the_librarys(library, monkeypatch):
    texts, counter = odd_texts(3000), token_counts.load(BYTES)
    want = [len(e.ids) for e in library[0].encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == want
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 50)  # the table of words starts anew all the time
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 100)
    assert [n for block in token_counts.blocks(texts) for n in counter.count(block)] == want
    r = random.Random(1)
    word = "".join(r.choice("abcdefgh") for _ in range(20_000))  # one pre-token, all through the rounds
    assert counter.count([word]) == [len(library[0].encode(word).ids)]


def test_merging_leaves_the_librarys_symbols(library):
    merges = token_counts.load(BYTES).merges
    texts = ["aaaaaaa", "tokenization", "Straße", "x", "日本語", "abababab" * 30, ""]
    symbols, counts = merges.merge([t.encode() for t in texts])
    assert symbols.tolist() == [i for t in texts for i in library[0].encode(t).ids] and counts.tolist() == [len(library[0].encode(t).ids) for t in texts]
    assert merges.merge([])[1].tolist() == []


def test_merges_out_of_order_are_refused():
    vocab = {c: i for i, c in enumerate([*token_counts.byte_chars(), "ab", "abc"])}
    with pytest.raises(ValueError, match="ranks before its parts"):
        token_counts.Merges(vocab, [("ab", "c"), ("a", "b")])


def test_counts_of_documents(spark, sf_dir, library, odd_docs, no_docs):
    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = token_counts.count_docs(docs, BYTES).collect()
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        n = [len(library[0].encode(t, add_special_tokens=False).ids) for _, t in rows]
        want = Counter((d, len(t.encode()), k, k > 1024) for (d, t), k in zip(rows, n))
        assert Counter(tuple(r) for r in got) == want
    assert token_counts.count_docs(no_docs, BYTES).collect() == []
    out = token_counts.add_counts(odd_docs, BYTES, name="tokens")
    assert out.columns == [*odd_docs.columns, "tokens"] and out.count() == odd_docs.count()
    with pytest.raises(ValueError, match="has a column"):
        token_counts.add_counts(odd_docs, BYTES, name="KEY")


# alignment -----------------------------------------------------------------------------------------
def plain_alignment(text, library, table):
    """Tokens, groups and links of a space and the text by two nested walks."""
    _, byte, piece = library
    ids = [byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)] if text else [[], []]
    parts = [[table[s][i] for i in side] for s, side in enumerate(ids)]
    if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    spans = []
    for side in parts:
        at, mine = 0, []
        for p in side:
            mine.append((at, at + len(p)))
            at += len(p)
        spans.append(mine)
    links, j0 = [], 0
    for i, (p, q) in enumerate(spans[0]):
        while spans[1][j0][1] <= p:
            j0 += 1
        j = j0
        while j < len(spans[1]) and spans[1][j][0] < q:
            links.append((ids[0][i], ids[1][j]))
            j += 1
    groups, at = [], [0, 0]
    for end in sorted({q for _, q in spans[0]} & {q for _, q in spans[1]}):
        both = []
        for s in (0, 1):
            k = at[s]
            while k < len(spans[s]) and spans[s][k][1] <= end:
                k += 1
            both.append(",".join(map(str, ids[s][at[s] : k])))
            at[s] = k
        groups.append("|".join(both))
    return len(ids[0]), len(ids[1]), len(groups), len(links), ";".join(groups), links


def plain_rows(rows, library):
    aligner = alignment.load(BYTES, PIECES)
    table = [aligner.a.token_bytes, aligner.b.token_bytes]
    found = [(d, plain_alignment(t, library, table)) for d, t in rows]
    count = Counter(link for _, f in found if f for link in f[5])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(count[x] == most[x[1]] for x in f[5])
            out.append((d, *f[:4], best, sum(count[x] for x in f[5]), hashlib.sha256(f[4].encode()).hexdigest()))
    return Counter(out)


def test_alignment_of_odd_texts(library, monkeypatch):
    aligner = alignment.load(BYTES, PIECES)
    table = [aligner.a.token_bytes, aligner.b.token_bytes]
    texts = odd_texts(1500)
    want = [plain_alignment(t, library, table) for t in texts]
    assert sum(w is None for w in want) > 100 and sum(w is not None for w in want) > 500
    for limit in (alignment.CACHE_WORDS, 20):
        monkeypatch.setattr(alignment, "CACHE_WORDS", limit)
        for at in range(0, len(texts), 300):
            found = aligner.texts(texts[at : at + 300])
            for k, w in enumerate(want[at : at + 300]):
                lo, hi = found.offsets[k], found.offsets[k + 1]
                pairs = Counter({(int(p) // len(table[1]), int(p) % len(table[1])): int(n) for p, n in zip(found.pairs[lo:hi], found.times[lo:hi])})
                if w is None:
                    assert not found.right[k] and not found.counts[k].any() and not found.groups[k] and not pairs
                else:
                    assert (*found.counts[k].tolist(), found.groups[k]) == w[:5] and pairs == Counter(w[5])


@pytest.mark.parametrize("limit", [None, 4000, 0])
def test_alignment_of_documents(spark, sf_dir, library, odd_docs, no_docs, monkeypatch, limit):
    if limit is not None:  # some pairs, or all, meet their counts by shuffle
        monkeypatch.setattr(alignment, "BROADCAST_BYTES", limit * 100)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(None, None), (9001, ""), (9002, "same ▁ text"), (9003, "a  b "), (9004, "a  b "), (9004, "a  b ")], "doc_id long, text string")
    for df in (docs.unionByName(more), odd_docs):
        got = alignment.align_docs(df, BYTES, PIECES)
        assert Counter(tuple(r) for r in got.collect()) == plain_rows([(r["doc_id"], r["text"] or "") for r in df.collect()], library)
    assert alignment.align_docs(no_docs, BYTES, PIECES).collect() == []
    written = alignment.align_texts(more, BYTES, PIECES, written=True).where("doc_id = 9003").first()
    assert hashlib.sha256(written["groups"].encode()).hexdigest() == written["groups_sha256"]


# filter audit --------------------------------------------------------------------------------------
def plain_audit(rows, marks):
    """rows: (doc_id, text, source). Applies the filters one after the other in every order."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    good, toxic = ({d for d, *m in marks if d is not None and m[i] == 1} for i in (0, 1))
    failing = []
    for d, t, s in rows:
        t = t or ""
        parts = [w for w in t.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        fails = {
            "A": len(parts) < 50, "B": 100 * len(set(parts)) < 65 * len(parts), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t],
        }
        failing.append((s or "", d, {x for x, f in fails.items() if f}))
    out = []
    for part in {p for p, *_ in failing}:
        mine = [(d, f) for p, d, f in failing if p == part]
        each = []
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone, left = [m for m in left if x in m[1]], [m for m in left if x not in m[1]]
                each.append(
                    (
                        "".join(order), step, len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                        sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                    )
                )
        total = Counter()
        for row in each:
            total[row[0][row[1] - 1]] += row[3]
        out += [(part, *row, total[row[0][row[1] - 1]]) for row in each]
    return sorted(out)


def test_polynomial_of_two_filters():
    r = filter_audit.Removal([5, 1, 2, 4])  # none, first only, second only, both
    assert [r.corner(s) for s in range(4)] == [0, 5, 6, 7] and r.total == 12
    assert r.derivative_integral(0) == 3 and r.derivative_integral(1) == 4
    three = filter_audit.Removal([0, 0, 0, 0, 0, 0, 0, 1])
    assert [three.derivative_integral(i).as_integer_ratio() for i in range(3)] == [(1, 3)] * 3


def test_audit_of_odd_documents(spark, odd_docs, no_docs):
    shout = "HELLO " * 10 + " ".join(words(5, 70))
    more = [(10, shout, "en", "t"), (11, shout, "en", "s"), (11, shout, "en", "t"), (12, "a # b", "en", None), (13, "a\x0bb\x0cc\x1fd e", "en", "t"), (14, " ".join(words(6, 60, 20)), "en", "t"), (None, shout, "en", "t"), (15, "", "de", "s")]
    docs = frame(spark, more).unionByName(odd_docs.select(*frame(spark, more).columns))
    marks = [(0, 1, 0), (5, 1, 1), (5, 0, 0), (11, 0, 1), (12, None, 1), (13, 1, None), (999, 1, 1), (None, 1, 1)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, part string")
    got = sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect())
    want = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], marks)
    assert got == want and len(got) == 600 * 3
    assert filter_audit.audit(no_docs, labels).collect() == []
    assert {r["good_lost"] for r in filter_audit.audit(docs, labels.limit(0)).collect()} == {0}


def test_audit_against_sql_and_plain_passes(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.op12_filter_audit(spark, sf_dir)
    got = sorted(tuple(r) for r in df.collect())
    twin = c.sql(queries.ORACLES["op12_filter_audit"])
    assert twin.columns == df.columns and sorted(twin.fetchall()) == got
    rows = c.sql("SELECT doc_id, text, source FROM documents").fetchall()
    assert plain_audit(rows, c.sql("SELECT doc_id, quality, toxic FROM labels").fetchall()) == got


def test_a_text_that_many_rows_repeat_is_few_rows_before_texts_meet(spark):
    rows = [(i, "copy " * 60, "en", "s") for i in range(3000)] + [(3000 + i, " ".join(words(i, 60)), "en", "t") for i in range(50)]
    out = filter_audit.mask_counts(frame(spark, rows), spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int"))
    masks = {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in out.collect()}
    assert masks["s", 2] == (1, 1, 1) and masks["s", 18] == (2999, 0, 0)
    assert np.sum([n for n, *_ in masks.values()]) == 3050
