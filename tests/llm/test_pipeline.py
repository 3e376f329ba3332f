"""Every stage of the pipeline against a brute-force version on the smallest tables."""

from __future__ import annotations

import corpus_pipeline as pipeline
import pytest
from test_decontaminate import slow as slow_benchmark
from test_pii import slow, slow_secrets
from test_simhash import slow_components, slow_fingerprint

from renewlens.llm import pii
from renewlens.llm.common import stored

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        out.append(docs.collect())
    return out


def test_columns(stages):
    for rows in stages[1:-1]:
        assert tuple(rows[0].asDict()) == pipeline.COLUMNS
    assert tuple(stages[-1][0].asDict()) == (*pipeline.COLUMNS, "mix_rate", "mix_copies")


def test_language_keeps_what_has_letters(stages):
    assert {r["doc_id"] for r in stages[1]} == {r["doc_id"] for r in stages[0] if any(c.isalpha() for c in r["text"] or "")}


def test_one_of_each_group(stages):
    groups = slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in stages[1]])
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(set(groups.values()))


def test_benchmark_documents_go(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in stages[2] if not slow_benchmark(r["text"], items)[1]}
    assert {r["doc_id"] for r in stages[3]} == clean and len(clean) < len(stages[2])


def test_spans_are_replaced(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3]}
    names = [f"[{k.name.upper()}]" for k in pii.KINDS]
    changed = 0
    assert set(before) == {r["doc_id"] for r in stages[4]}
    for r in stages[4]:
        text, at, out = before[r["doc_id"]], 0, ""
        for start, rank, end in sorted(slow(text) + slow_secrets(text)):
            if start >= at:
                out, at = out + text[at:start] + names[rank], end
            else:
                at = max(at, end)
        out += text[at:]
        changed += out != text
        assert r["text"] == out and r["n_chars"] == len(out)
    assert changed


def test_mixture_draws_from_what_is_left(stages):
    left = {r["doc_id"]: r for r in stages[4]}
    assert 0 < len(stages[5]) < len(left)
    for r in stages[5]:
        assert r["text"] == left[r["doc_id"]]["text"] and r["mix_copies"] >= 1 and r["mix_rate"] > 0


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(str, pipeline.run(spark, SF_DIR).collect())) == sorted(map(str, stages[-1]))
