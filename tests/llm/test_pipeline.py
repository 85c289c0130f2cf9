"""The stages of the pipeline against plain versions, and the driver's contract with and without the subpackage."""

import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_near_copies import groups_of
from tokenizers import Tokenizer

import corpus_pipeline
from factorloom.llm import quality, toxicity
from factorloom.llm.common import held_out, stored

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_keep_columns_and_only_drop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == columns and out.schema["text"] == docs.schema["text"]
        assert out.join(docs, "doc_id", "left_anti").count() == 0 and 0 < out.count() <= docs.count()
        if name != "repeats":
            assert out.exceptAll(docs).count() == 0
        docs = out
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_at_the_edges(spark, odd_docs, no_docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        now = docs
        for _, stage in corpus_pipeline.STAGES:
            now = stored(stage(spark, now, str(tmp_path)), "edge")
        assert now.columns[0] == "doc_id"


def plain_repeats(rows, width=13):
    """doc_id -> words left, without the words of windows that start in a document with a smaller id."""
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    left = {}
    for i, own in words.items():
        gone = {k + o for k in range(len(own) - width + 1) if first[tuple(own[k : k + width])] < i for o in range(width)}
        left[i] = [w for k, w in enumerate(own) if k not in gone]
    return left


@pytest.fixture(scope="module")
def chain(spark):
    """(rows of run(), documents that both classifiers keep)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    mild = toxicity.classify(docs, labels, "toxic", ~held_out("doc_id", 4, 2), keep=docs.columns).where("score < 0.3").drop("score")
    good = quality.classify(mild, labels, "quality", ~held_out("doc_id", 3, 1), keep=docs.columns).where("score >= 0.5")
    return corpus_pipeline.run(spark, SF).collect(), [(r["doc_id"], r["text"]) for r in good.collect()]


def test_chain_equals_brute_force(chain):
    """The classifiers' scores come from the operators; all else from plain loops."""
    packed, good = chain
    kept = [min(good[i] for i in g) for g in groups_of(good)]
    assert 0 < len(kept) < len(good)
    left = plain_repeats(kept)
    assert any(len(left[i]) < len((t or "").split()) for i, t in kept)
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    totals = {}
    for r in packed:
        assert totals.setdefault(r["doc_id"], r["doc_tokens"]) == r["doc_tokens"]
    assert set(totals) == {i for i, _ in kept}
    pieces = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, t in kept:
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == totals[i]
        if left[i] == (t or "").encode().split():  # such texts stay as they are
            assert totals[i] == len(tool.encode(t or "", add_special_tokens=False).ids) + 1
        if not left[i]:
            assert totals[i] <= 1 + len(tool.encode(t, add_special_tokens=False).ids)


def test_repeats_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = STAGES["repeats"](spark, docs, SF).collect()
    assert {r["doc_id"]: (r["text"] or "").encode().split() for r in out} == plain_repeats(rows)


def test_run_leaves_only_its_result(spark, tmp_path):
    from factorloom.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    corpus_pipeline.run(spark, SF)
    assert [n.split("-")[0] for n in {p.name for p in folder.iterdir()} - before] == ["packing"]


def test_library_imports_nothing_of_it():
    code = "import sys, __spark_entry__ as e; sys.modules\nimport factorloom.catalog.queries"
    text = "".join(p.read_text() for p in (ROOT / "factorloom").rglob("*.py") if "llm" not in p.parts)
    assert "llm" not in text
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
