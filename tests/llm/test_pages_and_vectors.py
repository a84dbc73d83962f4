import hashlib
import urllib.parse
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.llm import aqann, templates

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="<p>no</p>";</script><style>p{}</style></head><body class="x">
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="content sidebar-left"><article><header><h1>Head &amp; tail</h1></header><p>First  one.<br>still <b>bold<p>Second&nbsp;one &lt;x&gt;
<ul><li>a<li>b</ul><form><input value=1>go</form><section class="comments"><p>me too</p></section></article></div><aside>side</aside><footer>&copy;</footer>"""


def test_text_of_an_article():
    assert templates.text_of(templates._read(PAGE)) == "Head & tail\nFirst one. still bold\nSecond one <x>\na\nb"
    for broken in ("", "<", "<p", "</p></div>", "<!-- x", "<p a='", "a<b>c", "<script>x", "<td>1<tr>"):
        templates.text_of(templates._read(broken))
    assert templates.text_of(templates._read("a<b>c")) == "ac"
    assert templates.text_of(templates._read("<p>" + "<b>" * 5000 + "deep")) == "deep"


def test_a_page_of_many_megabytes(spark):
    body = "".join(f"<div class='x{i}'><p>word{i} <b>bold</b></p>" for i in range(20_000))
    rows = [(1, "http://a.example/1", f"<article>{body}</article>"), (2, "http://a.example/2", "<p>" + "x " * 1_500_000)]
    got = {r["page_id"]: r for r in templates.extract(pages(spark, rows)).collect()}
    assert got[1]["text"].count("\n") == 19_999 and got[2]["n_chars"] == 2_999_999


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, templates string")


def test_templates_are_found_per_host(spark):
    box = "<div><p>Join our club</p><p>Now</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{box}<div><p>text {i} {'x' * i}</p></div></body>") for i in range(12)]
    rows += [(100, "http://b.example/1", f"<body>{box}<p>other</p></body>")]
    copies = [(200 + i, f"http://c.example/{i}?p={i}", "<body><div><p>one article</p></div></body>") for i in range(12)]
    rows += copies + [(None, None, None), (300, "not a url", "<p>z</p>"), (0, rows[0][1], rows[0][2])]
    out = templates.extract(pages(spark, rows)).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and got[3] == "text 3 xxx" and got[100] == "Join our club\nNow\nother"
    assert got[205] == "one article" and got[None] == "" and got[300] == "z"
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert templates.extract(pages(spark, rows).limit(0)).count() == 0


def test_prose_inside_an_article_stays(spark):
    rows = [(i, f"http://a.example/{i}", f"<article><h1>{i}</h1><p>same line</p><div>share <p>this</p></div><p>end {i}</p></article>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in templates.extract(pages(spark, rows)).collect()}
    assert got[4] == "4\nsame line\nend 4"


def test_recurring_blocks_of_articles_and_menus_are_counted(spark):
    body = "<article><h1>Title {i}</h1><p>Read our terms before use</p><p>{t}</p></article>"
    rows = [(i, f"http://a.example/{i}", "<nav><a>Home</a></nav>" + body.format(i=i, t=f"word{i} " * 20)) for i in range(12)]
    near = "one long text of an article that stands under many addresses " * 3
    rows += [(100 + i, f"http://b.example/{i}", f"<article><p>{near}</p><p>seen {i}</p></article>") for i in range(12)]  # near copies
    many = [(1000 + i, f"http://c.example/{i}", f"<div>{'<div>Section box</div>' if i < 55 else ''}<p>text {i}</p></div>") for i in range(700)]
    df = pages(spark, rows + many)
    for found in (templates.extract(df), templates.extract(df, broadcast_rows=0)):
        got = {r["page_id"]: r["text"] for r in found.collect()}
        assert len(got) == 724 and got[3] == "Title 3\n" + "word3 " * 19 + "word3"
        assert got[103] == near.strip() + "\nseen 3" and got[1005] == "text 5"
    kinds = {r["host"] for r in templates.find_templates(templates.inventory(df)).where("subtree % 2 = 0").collect()}
    assert "a.example" in kinds  # the menu is counted, though its tag alone would do


def test_templates_equal_a_plain_counter(spark):
    """The same counts with dictionaries, page by page."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    seen, counts, sizes = set(), defaultdict(lambda: [0, 0, 0]), Counter()
    for r in sorted(df.collect(), key=lambda r: hashlib.md5(r["html"].encode()).hexdigest()):
        host = (urllib.parse.urlsplit(r["url"]).hostname or "").lower()
        nodes, exact, shapes = templates._hashed(r["html"])
        text = templates.text_of(nodes)
        if (host, text) in seen:
            continue
        seen.add((host, text))
        sizes[host] += 1
        for kind, words, links in [(k, None, None) for k in exact] + shapes:
            entry = counts[host, kind, words is None]
            entry[0] += 1
            entry[1] += words or 0
            entry[2] += links or 0
    want = set()
    for (host, kind, exact), (n, words, links) in counts.items():
        need = max(3, min(10, sizes[host] / 2), min(50, sizes[host] / 10), 10 if exact and kind & 1 else 0)
        if n >= need and (exact or words <= 15 * n or 2 * links >= words):
            want.add((host, kind))
    got = {(r["host"], r["subtree"]) for r in templates.find_templates(templates.inventory(df)).collect()}
    assert got == want and len(got) > 20


def test_templates_alone_find_menus_and_footers(spark):
    """Without any rule about names and roles: what recurs goes, the articles stay as they are."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    alone = {r["page_id"]: r["text"] for r in templates.extract(df, by_markup=False).collect()}
    both = {r["page_id"]: r["text"] for r in templates.extract(df).collect()}
    marked = {r["page_id"]: templates.text_of(templates._read(r["html"])) for r in df.collect()}
    assert sum(both[k] == marked[k] for k in both) == len(both)
    assert sum(alone[k] == both[k] for k in both) > 0.5 * len(both)
    assert all(both[k] in alone[k] for k in both)


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 24)) * r.uniform(0.1, 10, (3000, 1))
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(3000)]
    rows += [(5000 + i, rows[50][1], 0) for i in range(40)]  # equal vectors: ties go to the least ids
    rows += [(6000, None, 0), (6050, [], 0), (6100, [0.0] * 24, 0), (6150, [float("nan")] + [1.0] * 23, 0), (6200, [None] + [1.0] * 23, 0), (None, rows[0][1], 0), (6250, [1.0] * 5, 0), (100, rows[100][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("same", F.lit("x")).withColumn("code", F.lit(1))
    got = {}
    for q in aqann.search(df).collect():
        got.setdefault(q["query_id"], {})[q["rank"]] = (q["vec_id"], q["score"])
    ids = np.array([i for i in range(3000)] + [5000 + i for i in range(40)])
    v = np.concatenate([x, np.repeat(x[50:51], 40, axis=0)])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.round(v @ v[q], 12)
        s[q] = -2
        order = np.lexsort((ids, -s))[:5]
        mine = got[ids[q]]
        assert sorted(mine) == [1, 2, 3, 4, 5] and ids[q] not in {i for i, _ in mine.values()}
        hit += len({i for i, _ in mine.values()} & set(ids[order]))
        total += 5
        for i, score in mine.values():
            assert abs(score - v[np.flatnonzero(ids == i)[0]] @ v[q]) < 1e-12
    assert hit / total >= 0.9
    assert [got[50][k][0] for k in range(1, 6)] == [5000, 5001, 5002, 5003, 5004]
    assert set(got) == {int(i) for i in ids if i % 50 == 0}


def test_a_dense_group_is_met_as_a_whole(spark):
    """Within a group of near-equal vectors codes say little; ``rerank`` is where the search starts, not where it ends."""
    r = np.random.default_rng(6)
    x = r.normal(size=(6000, 24))
    x[::3] = x[0] + 0.02 * r.normal(size=(2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(6000)], "vec_id long, embedding array<double>")
    got = {}
    for q in aqann.search(df, rerank=16).collect():
        got.setdefault(q["query_id"], set()).add(q["vec_id"])
    for q in range(0, 6000, 50):
        s = x @ x[q]
        s[q] = -2
        assert got[q] == set(np.argsort(-s)[:5].tolist())


def test_differing_vectors_under_one_id(spark):
    """An id asks by its least vector and is found by its nearest, in whatever order the rows come."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [-1.0, -1.0]), (3, [0.2, 1.0])]
    want = [(1, 2, 1 / 1.01**0.5 * 1.0), (2, 3, 1 / 1.04**0.5), (3, 1, 0.1 / 1.01**0.5)]
    for order in (rows, rows[::-1]):
        got = aqann.search(spark.createDataFrame(order, "vec_id long, embedding array<double>")).orderBy("rank").collect()
        assert [(r["rank"], r["vec_id"]) for r in got] == [w[:2] for w in want]
        assert [r["score"] for r in got] == pytest.approx([w[2] for w in want])


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in aqann.search(df).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]
    assert aqann.search(df.limit(0)).count() == 0


def test_beam_search_beats_greedy():
    r = np.random.default_rng(4)
    x = r.normal(size=(2000, 16)).astype(np.float32)
    q = aqann.train(x, books=4, words=32)
    def error(beam):
        codes, norms = q.encode(x, beam)
        back = q.books[np.arange(4), codes].sum(axis=1)
        assert np.allclose(np.linalg.norm(back, axis=1), norms, atol=1e-3)
        return ((x - back) ** 2).sum()
    assert error(8) < error(1)


def test_one_odd_row_does_not_set_the_dimension(spark):
    r = np.random.default_rng(9)
    ids = spark.range(300).orderBy(F.xxhash64("id"), "id").limit(1).first()[0]  # the row that a sample takes first
    rows = [(i, [float(v) for v in r.normal(size=3 if i == ids else 8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = aqann.search(df).collect()
    assert {q["query_id"] for q in got} == {i for i in range(0, 300, 50) if i != ids} and ids not in {q["vec_id"] for q in got}
