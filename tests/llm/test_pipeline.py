import importlib
import os
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
from meterflow.llm import dartminhash, quality, suffix_dedup, toxicity

from .test_text_operators import brute_classes, brute_counts, brute_repeats, check_cuts

ROOT = Path(__file__).resolve().parent.parent.parent


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    steps = dict(corpus_pipeline.STAGES)
    assert [*steps] == ["quality_rules", "toxicity", "minhash_dedup", "suffix_dedup", "packing"]
    one = steps["quality_rules"](spark, docs, sf_dir).cache()
    want = {r["doc_id"] for r in quality.verdicts(docs).where("kept").collect()}
    failed = {r["doc_id"] for r in docs.collect() for n, _, _, _, rep in [brute_counts(r["text"])] if n < 50 or 100 * rep > 50 * n}
    assert {r["doc_id"] for r in one.collect()} == want and not want & failed and one.columns == docs.columns
    two = steps["toxicity"](spark, one, sf_dir).cache()
    assert two.columns == docs.columns and 0.8 * one.count() < two.count() <= one.count()
    three = steps["minhash_dedup"](spark, two, sf_dir).cache()
    rows = [(r["doc_id"], r["text"]) for r in two.collect()]
    assert {r["doc_id"] for r in three.collect()} == set(brute_classes(rows).values())
    four = steps["suffix_dedup"](spark, three, sf_dir).cache()
    rows = [(r["doc_id"], r["text"]) for r in three.collect()]
    got, have = {r["doc_id"]: r for r in four.collect()}, defaultdict(set)
    for m in suffix_dedup.matches(three).collect():
        have[m["doc_id"]] |= set(range(m["start_word"], m["start_word"] + m["n_words"]))
    check_cuts(brute_repeats(rows), have)
    for d, t in rows:
        left = [w for i, w in enumerate(t.split()) if i not in have[d]]
        assert (got[d]["text"].split() if d in got else []) == left
        if d in got:
            assert got[d]["n_chars"] == len(got[d]["text"])
    five = steps["packing"](spark, four, sf_dir).collect()
    assert sum(r["n_words"] for r in five) == sum(len(r["text"].split()) for r in got.values())


def test_stages_take_odd_and_no_documents(spark, sf_dir, odd_docs, no_docs):
    steps = dict(corpus_pipeline.STAGES)
    kinds = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    whole = kinds(odd_docs)
    kept = kinds(steps["quality_rules"](spark, odd_docs, sf_dir))
    assert kept and all(len(t.split()) >= 50 and (some, d, t) in whole for some, d, t in kept)
    assert set(kinds(steps["toxicity"](spark, odd_docs, sf_dir))) <= set(whole)
    near = kinds(steps["minhash_dedup"](spark, odd_docs, sf_dir))
    # wordless texts are one class (its least id stays), repeated rows stay once, rows without an id all stay
    assert [d for some, d, _ in near if some] == [0, 3, 4, 5, 6, 7] and sum(not some for some, *_ in near) == 2
    assert kinds(steps["suffix_dedup"](spark, odd_docs, sf_dir)) == whole
    packed = steps["packing"](spark, odd_docs, sf_dir).collect()
    assert sum(r["n_words"] for r in packed) == sum(len(t.split()) for *_, t in whole)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_docs, sf_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == no_docs.columns)


def _alone(tmp_path, *command):
    """Run a Python command in the copy, without this run's settings; its output is shown if it fails."""
    mine = ("PYTEST", "PYSPARK", "SPARK", "PYTHON", "COVERAGE")
    env = {k: v for k, v in os.environ.items() if not k.startswith(mine)} | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, *command], cwd=tmp_path, env=env, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, stdin=subprocess.DEVNULL, text=True)
    assert done.returncode == 0, f"{command} ended with {done.returncode}:\n{done.stdout[-6000:]}"


def test_the_rest_stands_without_this_folder(tmp_path):
    import shutil

    copy, own = tmp_path / "copy", shutil.ignore_patterns("__pycache__", ".pytest_cache", "llm")
    copy.mkdir()
    for name in ("meterflow", "tests"):
        shutil.copytree(ROOT / name, copy / name, ignore=own)
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    _alone(copy, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())")
    # some of the engine's own query tests run there, too
    options = ["-x", "-q", "-p", "no:cacheprovider", "--rootdir", str(copy), "--basetemp", str(tmp_path / "inner"), "-c", os.devnull]
    _alone(copy, "-m", "pytest", *options, "tests/test_queries.py", "-k", "pivot or raw_report or entry")
    assert importlib.import_module("__spark_entry__").queries().keys() >= {"pipeline", "op1_ppm_scores"}
    assert all(m.__name__.startswith("meterflow.llm") for m in (dartminhash, quality, suffix_dedup, toxicity))
