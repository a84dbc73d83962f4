import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.llm import bpe, dartminhash, packing, ppm, quality, queries, sharding, suffix_dedup, toxicity
from meterflow.llm.shingles import WordHashes, shingle_set

from .conftest import frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


# quality -----------------------------------------------------------------------------------------
def brute_counts(t):
    w = WORD.findall(t or "")
    grams = list(zip(w, w[1:], w[2:]))
    seen, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_equal_brute_force(spark, odd_docs):
    texts = ["a b c a b c", "é é é é", "x#y $z\n\n x#y $z\nx#y $z", "\x0b a\x0cb ", "a a a a a a", "p q r s p q r"]
    df = odd_docs.unionByName(frame(spark, [(100 + i, t) for i, t in enumerate(texts)]))
    want = Counter((r["doc_id"], *brute_counts(r["text"])) for r in df.collect())
    got = Counter(tuple(r) for r in quality.verdicts(df).select("doc_id", *quality.COUNTS).collect())
    assert got == want


def test_quality_thresholds_follow_their_group(spark):
    clean = [(i, " ".join(words(i, 80)), "en", "a") for i in range(60)]
    code = [(100 + i, " ".join(w + "<>#" for w in words(i, 80)), "en", "code") for i in range(60)]
    junk = [(200, " ".join(w + "$$$" for w in words(7, 80)), "en", "a")]
    df = frame(spark, clean + code + junk)
    kept = {r["doc_id"] for r in quality.verdicts(df, min_group=30).where("kept").collect()}
    assert kept == {i for i, *_ in clean + code}  # symbols are usual in one source and junk in the other
    assert {r["doc_id"] for r in quality.filter_docs(df, min_group=30).collect()} == kept
    assert quality.filter_docs(df, min_group=30).columns == df.columns


def test_verdicts_equal_exact_quantiles(spark):
    """``kept`` by sorted lists instead of sketches, on the whole of a small table with its own groups."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = []
    for r in df.collect():
        n, chars, symbols, dup, rep = brute_counts(r["text"])
        lines = sum(1 for x in (r["text"] or "").split("\n") if WORD.search(x))
        signals = {"symbol_ratio": symbols / chars if chars else 0, "dup_line_ratio": dup / lines if lines else 0, "repeat_ratio": rep / n if n else 0, "mean_word_chars": chars / n if n else 0}
        rows.append((r["doc_id"], r["lang"], r["source"], n < 50 or 100 * rep > 50 * n, signals))
    levels = [lambda r: (r[1], r[2]), lambda r: r[1], lambda r: 0]
    groups = [defaultdict(list) for _ in levels]
    for r in rows:
        if not r[3]:
            for level, g in zip(levels, groups):
                g[level(r)].append(r[4])
    keep = {}
    for r in rows:
        near = [g[level(r)] for level, g in zip(levels, groups)]
        mine = next((g for g in near[:2] if len(g) >= quality.MIN_GROUP), near[2])
        ok = not r[3]
        for sig in quality.SIGNALS:
            v = sorted(x[sig.name] for x in mine)
            q = lambda p: v[max(0, int(np.ceil(p * len(v))) - 1)]  # noqa: B023,E731
            spread = max(q(0.5) - q(0.1), sig.least)
            x = r[4][sig.name]
            ok = ok and x <= q(0.5) + sig.k * spread and (not sig.both_sides or x >= q(0.5) - sig.k * spread)
        keep[r[0]] = ok
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(df).collect()}
    differ = [d for d in keep if keep[d] != got[d]]
    assert len(differ) <= 0.002 * len(keep)  # groups are smaller than a sketch, so only ties at a rank differ


def test_quality_of_odd_and_no_documents(odd_docs, no_docs):
    out = quality.verdicts(odd_docs)
    assert out.count() == odd_docs.count() and out.where("doc_id = 0 and base_failed and not kept").count() == 1
    assert quality.verdicts(no_docs).count() == 0 and quality.filter_docs(no_docs).count() == 0


def test_quality_plan_is_native(odd_docs):
    plan = quality.with_counts(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# packing -----------------------------------------------------------------------------------------
def test_packing_keeps_every_word_once(spark, odd_docs):
    out = packing.pack_docs(odd_docs, with_text=True).collect()
    by = defaultdict(list)
    for r in out:
        by[r["bin_id"]].append(r)
    for b, pieces in by.items():
        if b is None:
            assert all(p["n_words"] == 0 for p in pieces)
            continue
        pieces.sort(key=lambda p: p["offset"])
        assert pieces[0]["capacity"] in packing.CAPACITIES and pieces[0]["bin_used"] <= pieces[0]["capacity"]
        at = 0
        for p in pieces:
            assert p["offset"] == at and len(p["text"].split()) == p["n_words"]
            at += p["n_words"]
        assert at == pieces[0]["bin_used"]
    long = sorted((r["piece"], r["text"]) for r in out if r["doc_id"] == 4)
    assert "".join(t for _, t in long) == odd_docs.where("doc_id = 4").first()["text"] and len(long) == 8
    assert sum(r["doc_id"] == 5 for r in out) == 2


def test_packing_is_best_fit_and_downsizes():
    flat = lambda c, largest: c
    got = packing.pack([6, 5, 4, 3], [4, 8, 16], flat)
    assert sum({b: c for b, _, c, _ in got}.values()) <= 24
    assert packing.pack([3], [4, 16], lambda c, largest: c + 100)[0][2] == 4  # opened or not, it shrinks
    r = random.Random(0)
    sizes = [r.randrange(1, 500) for _ in range(400)]
    bins = {b: (c, u) for b, _, c, u in packing.pack(sizes, [128, 256, 512])}
    assert sum(u for _, u in bins.values()) == sum(sizes) and sum(sizes) / sum(c for c, _ in bins.values()) > 0.95


def plain_pack(lengths, capacities):
    """Best fit with a list of bins: of those with the least room the one that was changed last."""
    top = max(capacities)
    price = lambda c: packing.default_cost(c, top)
    bins, where, left = [], {}, sum(lengths)  # capacity, used, when it was changed
    for turn, i in enumerate(sorted(range(len(lengths)), key=lambda j: (-lengths[j], j))):
        n = lengths[i]
        rooms = [(cap - used, -changed, b) for b, (cap, used, changed) in enumerate(bins) if cap - used >= n]
        if rooms:
            b = min(rooms)[2]
        else:
            bins.append((min((c for c in sorted(capacities) if c >= n), key=lambda c: price(c) / min(c, left)), 0, 0))
            b = len(bins) - 1
        where[i] = (b, bins[b][1])
        bins[b] = (bins[b][0], bins[b][1] + n, turn)
        left -= n
    final = [min((c for c in sorted(capacities) if c >= used), key=price) for _, used, _ in bins]
    return [(b, o, final[b], bins[b][1]) for b, o in (where[i] for i in range(len(lengths)))]


def test_packing_equals_a_plain_best_fit():
    for seed in range(30):
        r = random.Random(seed)
        sizes = [r.choice([r.randrange(1, 64), r.randrange(1, 17)]) for _ in range(r.randrange(1, 120))]
        assert packing.pack(sizes, [16, 32, 64]) == plain_pack(sizes, [16, 32, 64])


def test_sequences_hold_every_word_and_token_once(spark, odd_docs):
    out = packing.pack_sequences(odd_docs).collect()
    assert all(r["used"] == len(r["text"].split()) <= r["capacity"] and len(r["doc_ids"]) == len(r["pieces"]) == len(r["offsets"]) for r in out)
    want = Counter(w for r in odd_docs.collect() for w in (r["text"] or "").split())
    assert Counter(w for r in out for w in r["text"].split()) == want
    tokens = packing.pack_tokens(odd_docs, path(), [256, 1024]).collect()
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_docs(odd_docs.where("doc_id is not null"), path()).collect()}
    whole = defaultdict(dict)
    for r in tokens:
        assert len(r["ids"]) == r["used"] <= r["capacity"]
        for d, p, o, e in zip(r["doc_ids"], r["pieces"], r["offsets"], [*r["offsets"][1:], r["used"]]):
            whole[d][p] = r["ids"][o:e]
    assert all(sum((whole[d][p] for p in sorted(whole[d])), []) == t for d, t in ids.items() if t and d != 5)
    assert packing.pack_sequences(odd_docs.limit(0)).count() == packing.pack_tokens(odd_docs.limit(0), path()).count() == 0


def test_packing_nothing(no_docs):
    assert packing.pack_docs(no_docs).count() == 0 and packing.bins(packing.pack_docs(no_docs)).count() == 0


# sharding ----------------------------------------------------------------------------------------
def test_sharding_round_trip_and_versions(spark, odd_docs, tmp_path):
    data = sharding.TieredDataset(spark, str(tmp_path / "d"), target_bytes=1 << 30, min_merge=3)
    for i in range(7):
        data.append(odd_docs.withColumn("source", F.lit(f"s{i}")))
        data.compact()
    assert data.append(odd_docs.limit(0)) == data.manifest()[0]  # nothing to commit
    assert data.read().count() == 7 * odd_docs.count()
    assert len(data.manifest()[1]) < 7 and data.read(1).count() == odd_docs.count()
    assert data.read(3).count() == 3 * odd_docs.count()
    before = {tuple(r) for r in data.read().drop("_shard").collect()}
    assert data.vacuum() > 0 and {tuple(r) for r in data.read().drop("_shard").collect()} == before
    with pytest.raises(sharding.VersionGone):
        data.read(1)


def test_arrivals_with_other_columns_lose_nothing(spark, tmp_path):
    data = sharding.TieredDataset(spark, str(tmp_path / "d"), min_merge=2)
    one = spark.createDataFrame([(1, "a")], "id int, x string")
    two = spark.createDataFrame([(2_000_000_000_000, 5, "m", "s")], "id long, extra int, _metadata string, _shard string")
    for order in ((one, two), (two, one)):
        data = sharding.TieredDataset(spark, str(tmp_path / f"d{order[0] is one}"), min_merge=2)
        for df in order:
            data.append(df)
        for _ in range(2):
            got = {r["id"]: r for r in data.read().collect()}
            assert set(got) == {1, 2_000_000_000_000} and got[1]["x"] == "a" and got[1]["extra"] is None
            late = got[2_000_000_000_000]
            assert (late["extra"], late["_metadata"], late["_shard"]) == (5, "m", "s") and len(late["_shard_"]) == 32
            data.compact()
            data.vacuum()
        assert len(data.manifest()[1]) == 1
    with pytest.raises(sharding.SchemaConflict):
        data.append(spark.createDataFrame([("no",)], "id string"))
    assert data.read().count() == 2


def test_vacuum_spares_what_another_writer_is_about_to_commit(spark, odd_docs, tmp_path):
    a, b = (sharding.TieredDataset(spark, str(tmp_path / "d")) for _ in range(2))
    a.append(odd_docs)
    shard = b._write(odd_docs)
    assert a.vacuum() == 0
    b._publish(lambda v, shards: [*shards, b._born(shard, v)])
    b._release(shard)
    assert a.read().count() == 2 * odd_docs.count()
    dead = b._write(odd_docs)  # its writer died
    assert sharding.TieredDataset(spark, str(tmp_path / "d"), lease_seconds=0).vacuum() == 1 and dead.rows == odd_docs.count()
    assert a.read().count() == 2 * odd_docs.count()


def test_commit_conflicts(spark, odd_docs, tmp_path):
    a, b = (sharding.TieredDataset(spark, str(tmp_path / "d")) for _ in range(2))
    a.append(odd_docs)
    with pytest.raises(sharding.CommitConflict):
        b._commit(1, [])
    assert b.append(odd_docs) == 2 and a.read().count() == 2 * odd_docs.count()
    with pytest.raises(ValueError):
        sharding.TieredDataset(spark, str(tmp_path / "e")).read()
    assert sharding.TieredDataset(spark, str(tmp_path / "e")).read(schema=odd_docs.schema).count() == 0


def test_a_type_that_another_writer_brings_meanwhile_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "two")
    first, second = sharding.TieredDataset(spark, path), sharding.TieredDataset(spark, path)
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(2, "s")], "k int, x string")
    write = second._write

    def late(df):  # the other writer commits after the check before the write
        out = write(df)
        first.append(a)
        return out

    monkeypatch.setattr(second, "_write", late)
    with pytest.raises(sharding.SchemaConflict):
        second.append(b)
    assert first.versions() == [1] and [r["x"] for r in first.read().collect()] == [2]
    assert len(list((tmp_path / "two/shards").iterdir())) == 1 and not list((tmp_path / "two/leases").glob("[!.]*"))
    for _ in range(4):
        first.append(a)
    assert first.compact() > 5 and first.read().count() == 5


def test_names_are_compared_by_the_sessions_case(spark, tmp_path):
    data = sharding.TieredDataset(spark, str(tmp_path / "case"))
    data.append(spark.createDataFrame([(1,)], "A int"))
    with pytest.raises(sharding.SchemaConflict):
        data.append(spark.createDataFrame([("s",)], "a string"))
    data.append(spark.createDataFrame([(2,)], "a int"))
    assert sorted(r["A"] for r in data.read().collect()) == [1, 2]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        two = sharding.TieredDataset(spark, str(tmp_path / "both"))
        two.append(spark.createDataFrame([(1,)], "A int"))
        two.append(spark.createDataFrame([("s",)], "a string"))
        assert sorted((r["A"], r["a"]) for r in two.read().collect() if r["A"]) == [(1, None)]
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_sharding_query_equals_sql(spark, sf_dir):
    got = queries.op5_tiered_sharding(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = duckdb.sql(queries.ORACLES["op5_tiered_sharding"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got[["doc_id", "text_md5", "lang"]].equals(want[["doc_id", "text_md5", "lang"]])
    assert got["batch"].fillna(-1).astype(int).tolist() == want["batch"].fillna(-1).astype(int).tolist() and got["batch"].nunique() > 2


# encoding ----------------------------------------------------------------------------------------
ODD_TEXTS = [
    "", "  ", " a", "a  b\n\n c\t", "<|endoftext|>x <|endoftext|>  y\x1c \x85z", "it's I'LL we've 's", "日本語テキスト１２３ ²³ Ⅷ", "🙂🙂 �", "a\x00b\r\n\r\n d", "\x1c\x1d a", " \n \n x",
    "$$$ $$$$$ aaaaaaaaa %%%%%%%", "naïve é́a", "x y  z", "a\n b \nc",
]


def test_bpe_equals_the_library(spark, odd_docs, sf_dir):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = docs.union(frame(spark, [(10_000 + i, t) for i, t in enumerate(ODD_TEXTS)]).select("doc_id", "text")).union(odd_docs.select("doc_id", "text"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in df.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.digest_docs(df, path()).collect()) == want


def test_the_compiled_table_is_the_predicate():
    a = bpe.load(path()).automaton
    live = [t for t in a.parts] + [t for t in a.labels if len(a.labels[t]) == 1]
    r = random.Random(8)
    pairs = [(r.choice(live), r.choice(live)) for _ in range(60_000)]
    pairs += [(u, x) for u, v in r.sample(sorted(a.rank), 20_000) for x in (v, *(w for w in (r.choice(live),) if w in a.parts and a.parts[w][0] == v))]
    pairs += [(u, w) for w, (left, _, _) in r.sample(sorted(a.parts.items()), 20_000) for u in (r.choice(live), *[x for x, y in list(a.rank)[:50] if y == left])]
    blocked = 0
    for t, w in pairs:
        want = a._open(t, w)
        blocked += not want
        assert a.arc(t, w) == want
    assert blocked > 20_000 and len(a.begin) - 1 < len(live) and len(a.low) < 2_000_000  # fewer rows than states


def test_bpe_real_outputs(odd_docs, no_docs):
    out = bpe.encode_docs(odd_docs, path()).where("doc_id = 5").first()
    assert out["decoded"] == odd_docs.where("doc_id = 5").first()["text"] and len(out["ids"]) > 0
    assert bpe.digest_docs(no_docs, path()).count() == 0


def merge_by_rank(word, ranks, names):
    parts = [bytes([b]) for b in word]
    while True:
        best = min((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks) if any(p in ranks for p in zip(parts, parts[1:])) else None
        if best is None:
            return [names[p] for p in parts]
        r, pair = best[0], None
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == r:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_automaton_accepts_what_merging_yields():
    r = random.Random(5)
    chars = {b: c for c, b in bpe.byte_chars().items()}
    for _ in range(30):
        known, merges = [b"a", b"b", b"c"], []
        while len(merges) < 25:
            u, v = r.choice(known), r.choice(known)
            if u + v not in known and len(u + v) < 9:
                merges.append((u, v))
                known.append(u + v)
        text = lambda s: "".join(chars[b] for b in s)
        vocab = {text(bytes([b])): b for b in range(256)} | {text(u + v): 256 + i for i, (u, v) in enumerate(merges)}
        names = {bytes([b]): b for b in range(256)} | {u + v: 256 + i for i, (u, v) in enumerate(merges)}
        automaton = bpe.Automaton(vocab, [(text(u), text(v)) for u, v in merges])
        ranks = {m: i for i, m in enumerate(merges)}
        for _ in range(60):
            word = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 24)))
            assert automaton.encode_word(word) == merge_by_rank(word, ranks, names)


# language model ----------------------------------------------------------------------------------
def brute_ppm(texts, train):
    """Method D with exclusion, by dictionaries."""
    K, counts = ppm.ORDER, defaultdict(Counter)
    seq = [[ppm.START] * K + list((t or "").encode().lower()) + [ppm.END] for t in texts]
    for s, yes in zip(seq, train):
        if yes:
            for i in range(K, len(s)):
                for k in range(K + 1):
                    counts[tuple(s[i - k : i])][s[i]] += 1

    def log(context, symbol):
        out, gone = 0.0, set()
        for k in range(K, -1, -1):
            here = {x: n for x, n in counts[context[len(context) - k :]].items() if x not in gone}
            if not here:
                continue
            total = 2 * sum(here.values())
            if symbol in here:
                return out + np.log10((2 * here[symbol] - 1) / total)
            out += np.log10(len(here) / total)
            gone |= set(here)
        return out - np.log10(ppm.SYMBOLS - len(gone))

    return [sum(log(tuple(s[i - K : i]), s[i]) for i in range(K, len(s))) for s in seq]


def test_ppm_equals_brute_force(spark, odd_docs):
    rows = [(i, " ".join(words(i % 9, 12 + i, 15)) + "É!" * (i % 2)) for i in range(40)] + [(50, ""), (51, None), (None, "zz top")]
    df = frame(spark, rows)
    import zlib

    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, *_ in rows]
    scores = brute_ppm([t for _, t, *_ in rows], [not h for h in held])
    got = {r["doc_id"]: r for r in ppm.score_docs(df, block_bytes=300).collect()}
    for (d, t, *_), h, s in zip(rows, held, scores):
        assert got[d]["held_out"] == h and got[d]["score"] == pytest.approx(s, abs=1e-9)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode()) + ["\n"] for _, t, *_ in rows]
    c = Counter(x for ts, h in zip(tokens, held) if not h for x in ts)
    n, v = sum(c.values()), len(c)
    for (d, *_), ts in zip(rows, tokens):
        assert got[d]["base_score"] == pytest.approx(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts))
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(ts), sum(c[x] > 0 for x in ts), n)
    # the probabilities of all symbols in a context sum to 1
    assert ppm.score_docs(odd_docs).count() == odd_docs.count()


def test_ppm_of_many_languages_and_hot_rows(spark):
    rows = [(i, " ".join(words(i, 12)), f"l{i % 70}", "s") for i in range(140)] + [(None, "same words again", "l1", "s")] * 40 + [(7, "one id many times", "l1", "s")] * 40
    out = ppm.score_docs(frame(spark, rows), block_bytes=200).collect()
    assert len(out) == len(rows) and len({(r["score"], r["n_tokens"]) for r in out if r["doc_id"] == 7}) == 2
    assert len({r["score"] for r in out if r["doc_id"] is None}) == 1
    n = len({r["block"] for r in ppm.blocks(frame(spark, rows), 200).collect()})
    assert n >= 70


def test_equal_rows_of_one_id_fill_no_block(spark, tmp_path):
    """100,000 equal rows with one id, and as many without one, are dealt evenly, alike at each reading and whole."""
    spark.range(200_000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 END AS doc_id", "'one id many times' AS text", "'en' AS lang").write.parquet(str(tmp_path / "d"))
    for docs in (spark.read.parquet(str(tmp_path / "d")), spark.range(0, 100_000, 1, 3).selectExpr("7L AS doc_id", "'one id many times' AS text", "id % 2 AS _metadata").repartition(5)):
        rows = docs.count()
        dealt = ppm.blocks(docs, 200_000)
        first, again = ({r["block"]: r["count"] for r in dealt.groupBy("block").count().collect()} for _ in range(2))
        assert first == again and sum(first.values()) == rows and len(first) >= 8
        assert max(first.values()) < 2 * rows / len(first)
        shards = [r["count"] for r in packing._dealt(docs, False).groupBy("shard").count().collect()]
        assert sum(shards) == rows and len(shards) == rows // packing.SHARD_ROWS and max(shards) < 2 * rows / len(shards)
    packed = packing.pack_docs(docs).agg(F.sum("n_words").alias("n"), F.count("*").alias("rows")).first()
    assert (packed["n"], packed["rows"]) == (4 * 100_000, 100_000)


def test_one_id_with_many_texts_is_dealt_by_its_texts(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "'t' || lpad(id, 7, '0') AS text")
    sizes = [r["count"] for r in ppm.blocks(docs, 3000).groupBy("block").count().collect()]
    assert sum(sizes) == 3000 and len(sizes) == 9 and max(sizes) < 2 * 3000 / 9


def test_ppm_of_nothing(no_docs):
    assert ppm.score_docs(no_docs).count() == 0


# near duplicates ---------------------------------------------------------------------------------
def test_dart_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], r.integers(0, 2**63, 60).astype(np.uint64)])  # 240 of 360
    s = dartminhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 2048)
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.04 and not (s == dartminhash.EMPTY).any()
    w = np.concatenate([np.full(300, 2.5), np.full(300, 2.5)])
    w[:240] = 1.25  # of the shared ones half as much: 300 of 1050
    s = dartminhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], 300), 2, 2048, w)
    assert abs((s[0] == s[1]).mean() - (240 * 1.25) / (240 * 2.5 + 60 * 2.5 * 2)) < 0.04
    one = dartminhash.signatures(a[:1], np.zeros(1, int), 1, 64)
    assert not (one == dartminhash.EMPTY).any()


def brute_classes(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").split()
        sets.append(frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)]))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, *_) in enumerate(rows)}


def test_classes_equal_brute_force(spark):
    r = random.Random(4)
    rows = []
    for g in range(25):
        base = words(g, r.randrange(30, 200), 3000)
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 6)):
                copy[r.randrange(len(copy))] = f"edit{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(500 + i, " ".join(words(99, 60)) + " " + " ".join(words(1000 + i, 40, 10**6))) for i in range(40)]  # one passage, no copies
    rows += [(600, "a b"), (601, "a  b"), (602, ""), (603, None)]
    got = {x["doc_id"]: x["class_id"] for x in dartminhash.classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_revisions_of_copies_are_found_in_a_large_group(spark):
    """A revision is near one copy only, which an earlier head of their buckets has caught already."""
    r = random.Random(8)
    base, rows, copies = words(77, 200, 10**6), [], []

    def edited(text, n):
        text = list(text)
        for i in r.sample(range(0, len(text), 5), n):
            text[i] = f"edit{r.randrange(10**9)}"
        return text

    for i in range(400):
        copies.append(edited(base, r.randrange(2, 5)))
        rows.append((i, " ".join(copies[-1])))
    rows += [(1000 + i, " ".join(edited(copies[i], 2 + i % 3))) for i in range(100)]
    rows += [(2000 + i, " ".join(edited(base, 9))) for i in range(30)]  # in their buckets, but near none of them
    got = {x["doc_id"]: x["class_id"] for x in dartminhash.classes(frame(spark, rows, extra=False)).collect()}
    assert got == brute_classes(rows)


def test_keep_one(odd_docs, no_docs):
    out = dartminhash.keep_one(odd_docs)
    assert out.columns == odd_docs.columns
    ids = sorted((r["doc_id"] for r in out.collect()), key=lambda x: (x is not None, x))
    assert ids == [None, None, 0, 3, 4, 5, 6, 7]  # 1 and 2 are wordless like 0; 5 was there twice
    assert dartminhash.classes(no_docs).count() == 0 and dartminhash.keep_one(no_docs).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(40, 41)], "a long, b long")
    got = {r["v"]: r["label"] for r in dartminhash.components(links).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 41: 40}


# repeated passages -------------------------------------------------------------------------------
def brute_repeats(rows, n=50):
    """Per document the starts of all windows of n words that an earlier document holds."""
    first, starts = {}, defaultdict(set)
    for d, t in sorted((d, t) for d, t, *_ in rows):
        w = (t or "").split()
        for i in range(len(w) - n + 1):
            if first.setdefault(tuple(w[i : i + n]), d) != d:
                starts[d].add(i)
    return starts


def check_cuts(starts, cut, n=50):
    """The words of all repeated windows are cut, and no others."""
    assert {d: c for d, c in cut.items() if c} == {d: {j for i in s for j in range(i, i + n)} for d, s in starts.items() if s}


def test_a_passage_is_cut_as_far_as_any_earlier_document_holds_it(spark):
    """The earliest holder has the middle only; later ones agree for longer, to either side and by few words."""
    core, left, right = words(1, 60, 10**6), words(2, 90, 10**6), words(3, 90, 10**6)
    own = lambda i: words(50 + i, 40, 10**6)
    rows = [(0, own(0) + core + own(1)), (1, own(2) + left[-13:] + core[:50] + own(3)), (2, own(4) + left[-13:] + core + right[:17] + own(5)), (3, own(6) + left + core + right + own(7)), (4, left[-20:] + core[:31] + own(8))]
    rows += [(5, own(9) + left + core + right), (6, core[30:] + right[:25])]
    rows = [(d, " ".join(w)) for d, w in rows]
    have = defaultdict(set)
    for m in suffix_dedup.matches(frame(spark, rows)).collect():
        have[m["doc_id"]] |= set(range(m["start_word"], m["start_word"] + m["n_words"]))
    check_cuts(brute_repeats(rows), have)


def test_repeats_equal_brute_force(spark):
    r = random.Random(8)
    passages = [words(100 + i, n, 10**5) for i, n in enumerate((50, 51, 60, 75, 120, 49, 300, 30))]
    rows = []
    for d in range(60):
        text = words(1000 + d, r.randrange(0, 80), 10**5)
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            cut = r.randrange(0, 8)
            text += p[cut:] + words(5000 + d, r.randrange(0, 20), 10**5)
        rows.append((d, " ".join(text)))
    rows.append((70, rows[3][1]))
    found = suffix_dedup.matches(frame(spark, rows)).collect()
    have = defaultdict(set)
    texts = dict(rows)
    for m in found:
        have[m["doc_id"]] |= set(range(m["start_word"], m["start_word"] + m["n_words"]))
        assert m["n_words"] >= 50 and m["kept_doc_id"] < m["doc_id"]
        mine, theirs = texts[m["doc_id"]].split(), texts[m["kept_doc_id"]].split()
        assert mine[m["start_word"] :][: m["n_words"]] == theirs[m["kept_start_word"] :][: m["n_words"]]
    check_cuts(brute_repeats(rows), have)
    cut = {x["doc_id"]: x["text"] for x in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    for d, t in rows:
        left = [w for i, w in enumerate(t.split()) if i not in have[d]]
        assert cut.get(d, "").split() == left


def test_repeats_of_odd_documents(odd_docs, no_docs):
    out = suffix_dedup.remove_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()  # a doc_id is one document, NULL ids stay
    assert suffix_dedup.matches(no_docs).count() == 0 and suffix_dedup.remove_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.matches(odd_docs, min_words=20)


def test_shingles_of_short_texts():
    known = WordHashes()
    assert len(shingle_set([], known)) == 0 and len(shingle_set([b"a"], known)) == 1
    assert len(shingle_set(b"a b c d e f".split(), known)) == 2


# toxicity ----------------------------------------------------------------------------------------
def test_gradients_are_right():
    r = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in toxicity.fresh_network().items()}
    x, there, y = r.normal(size=(3, 7, toxicity.INPUTS)), np.ones((3, 7), bool), np.array([1.0, 0.0, 1.0])
    there[1, 4:] = False
    _, grad, dx = toxicity.gradients(net, x, there, y)
    net |= {"x": x}
    grad |= {"x": dx}
    for k in net:
        flat = net[k].reshape(-1)
        for i in (0, flat.size // 2):
            old, eps = flat[i], 1e-4
            flat[i] = old + eps
            up, *_ = toxicity.gradients(net, x, there, y)
            flat[i] = old - eps
            down, *_ = toxicity.gradients(net, x, there, y)
            flat[i] = old
            assert grad[k].reshape(-1)[i] == pytest.approx((up - down) / (2 * eps), abs=2e-4)


def test_toxicity_held_out(spark, odd_docs, no_docs):
    r = random.Random(3)
    rows, labels = [], []
    for d in range(240):
        w, bad = words(d, r.randrange(20, 200), 2000), d % 4 == 0
        if bad:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["grunkle", "snorfbag", "vexo" + r.choice("abcdefgh")])
        rows.append((d, " ".join(w)))
        labels.append((d, 1, int(bad)))
    labels.append((0, None, None))
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x for x in toxicity.score_docs(df, lab).where("held_out").collect()}
    right = sum((x["predicted"] == 1) == (d % 4 == 0) for d, x in out.items())
    assert right / len(out) > 0.9 and all(0 <= x["score"] <= 1 for x in out.values())
    assert toxicity.score_docs(odd_docs, lab).where("score is null").count() == 0
    assert toxicity.score_docs(no_docs, lab).count() == 0
    assert toxicity.score_docs(odd_docs, lab.limit(0)).where("score <> 0").count() == 0
    kept = toxicity.reject_toxic(df, lab)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()


def plain_score(model, text):
    """One text, word by word and window by window."""
    sig, net, H = lambda v: 1 / (1 + np.exp(-v)), model.net, toxicity.HIDDEN
    xs = []
    for w in text.lower().encode().split():
        b, g, n = toxicity.word_buckets([w])
        g = g[0][g[0] >= 0]
        z = model.gram_z[g] / 8
        stats = [model.word_z[b[0]] / 24, z.max() / 3 if len(g) else 0, z.mean() if len(g) else 0, z.min() / 3 if len(g) else 0, 2 * (z > 2).mean() if len(g) else 0, min(n[0], 20) / 10]
        word = model.words[b[0] % toxicity.WORD_ROWS].astype(float)
        char = np.mean([model.chars[i % toxicity.CHAR_ROWS].astype(float) for i in g], axis=0) if len(g) else np.zeros(toxicity.CHAR_DIM)
        xs.append(np.concatenate([np.clip(stats, -4, 4), word, char]))
    xs, best = xs or [np.zeros(toxicity.INPUTS)], -np.inf
    for s in toxicity.windows(len(xs)):
        part = xs[s : s + 64]
        pad = part + [np.zeros(toxicity.INPUTS)] * (64 - len(part))
        sides = []
        for k, seq in ((0, pad), (1, pad[::-1])):
            h, states = np.zeros(H), []
            for v in seq:
                gate, hu = v @ net["W"][k] + net["b"][k][0], h @ net["U"][k]
                zr = sig(gate[: 2 * H] + hu[: 2 * H])
                c = np.tanh(gate[2 * H :] + zr[H:] * hu[2 * H :])
                h = zr[:H] * h + (1 - zr[:H]) * c
                states.append(h)
            sides.append(states if k == 0 else states[::-1])
        st = np.array([np.concatenate(p) for p in zip(*sides)])[: max(1, len(part))]
        e = np.tanh(st @ net["A"] + net["a"]) @ net["v"]
        w = np.exp(e - e.max())
        best = max(best, (w / w.sum()) @ st @ net["w"] + net["c"][0])
    return sig(best)


def test_scores_equal_a_plain_scorer():
    r = random.Random(4)
    texts = [" ".join(words(d, r.randrange(0, 180), 300) + (["snorfbag", "x" * 90] if d % 3 == 0 else [])) for d in range(60)]
    model = toxicity.train(texts, [int(d % 3 == 0) for d in range(60)], rounds=2, epochs=1)
    assert np.abs(model.words).max() > 0 < np.abs(model.chars).max()  # both inputs are learnt
    some = [*texts[:6], "", "a", "snorfbags never seen, Ünï " * 70]
    assert np.allclose(toxicity.Scorer(model).score(some), [plain_score(model, t) for t in some], atol=1e-4)


def test_embeddings_alone_can_tell():
    """Without the leaning statistics (all words of the sample occur in both classes equally often) order and characters remain."""
    slope, shift = toxicity.calibrated(np.array([-2.0, -1.0, 1.0, 2.0]), np.array([0.0, 0.0, 1.0, 1.0]), 10, 1000)
    assert 0.1 <= slope <= 5 and shift < 0  # rare in the whole: a lower score for the same evidence


def test_texts_of_many_megabytes(spark):
    big = " ".join(words(5, 600_000, 40_000))
    assert len(big) > 3_000_000
    df = frame(spark, [(1, big), (2, "a" * 100_000), (3, "short")], extra=False)
    tokens = {r["doc_id"]: r for r in bpe.digest_docs(df, path()).collect()}
    tokenizers = pytest.importorskip("tokenizers").Tokenizer.from_file(path())
    for d, t in ((1, big), (3, "short")):
        ids = tokenizers.encode(t, add_special_tokens=False).ids
        assert tokens[d]["n_tokens"] == len(ids) and tokens[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert tokens[2]["decoded_sha256"] == hashlib.sha256(b"a" * 100_000).hexdigest()
    texts = [" ".join(words(d, 80)) + (" snorfbag" if d % 2 else "") for d in range(40)]
    model = toxicity.train(texts, [d % 2 for d in range(40)], rounds=1, epochs=1)
    assert len(toxicity.Scorer(model).score([big, "a" * 20_000])) == 2


def test_windows_overlap_and_cover():
    for n in (0, 1, 64, 65, 96, 1000):
        s = toxicity.windows(n)
        assert s[0] == 0 and s[-1] + 64 >= n and (np.diff(s) <= 32).all()
