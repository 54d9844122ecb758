"""Each stage on its own input: clean rows stay as they are, decisions take effect."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest

import __spark_entry__
from tidegrid.llm import decontamination, near_duplicates, quality_rules, secret_scans, sentence_pieces
from tidegrid.sources import table

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).persist()
        out.append((name, docs))
    return out


def test_columns_are_those_of_documents(spark, stages):
    want = table(spark, DATA, "documents").columns
    assert [n for n, _ in stages] == ["quality_rules", "near_duplicates", "decontamination", "secret_scans", "sentence_pieces"]
    assert all(d.columns == want for _, d in stages[:-1])


def test_decisions_take_effect(spark, stages):
    docs = [table(spark, DATA, "documents"), *[d for _, d in stages]]
    rows = [{r[0]: r.asDict() for r in d.collect()} for d in docs]
    kept = {r.doc_id for r in quality_rules.op1_query(docs[0]).filter("kept").collect()}
    assert set(rows[1]) == kept and all(rows[1][i] == rows[0][i] for i in kept)
    first = {r.class_id for r in near_duplicates.op8_query(docs[1]).collect()}
    assert set(rows[2]) == first and all(rows[2][i] == rows[1][i] for i in first)
    leaks = {r.doc_id for r in decontamination.op9_query(docs[2], table(spark, DATA, "benchmark")).collect()}
    assert leaks and set(rows[3]) == set(rows[2]) - leaks
    spans = {r.doc_id: r.spans for r in secret_scans.op5_query(docs[3]).collect()}
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert (r["text"] == rows[3][i]["text"]) == (not spans[i]) and r["n_chars"] == len(r["text"])
    assert not secret_scans.op5_query(docs[4]).filter("spans <> ''").count()
    text = {r.doc_id: r.text for r in sentence_pieces.decode(docs[5]).collect()}
    assert text == {i: r["text"] for i, r in rows[4].items()}


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[-1][1].collect()))


def test_every_query_is_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_the_rest_works_without_this_subpackage(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    for p in ("tidegrid", "__spark_entry__.py"):
        (shutil.copytree if (root / p).is_dir() else shutil.copy)(root / p, tmp_path / p)
    shutil.rmtree(tmp_path / "tidegrid/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(q) == set(e.oracle_sql()); assert not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
