from __future__ import annotations

import public_tokenizers
import pytest

from renewlens.llm import tokens

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = (
    "", "a <|endoftext|> b<|endoftext|>", "<|endoftext|", "՘ \U0001f600 mixed with plain text", "  \n\n  x  ", "'s 're I'LL don't",
    "x" * 5000, "日本語 テスト 123", "\t  a", "näive café №5", "Ωmega жизнь", "​﻿ bom", "1234567 1,234.5", "a b",
)


def library(text):
    return len(tokens.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids)


def test_counts_are_the_library_s(spark, make, odd, none):
    for docs in (make(*TEXTS, None, *TEXTS[:3]), odd):
        source = sorted(docs.select("doc_id", "text").collect(), key=str)
        found = tokens.count_tokens(docs, PATH).collect()
        expected = sorted(((r[0], len((r[1] or "").encode()), library(r[1])) for r in source), key=str)
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found), key=str) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found)
    assert tokens.count_tokens(none, PATH).count() == 0


def test_tiers_do_not_change_counts():
    texts = [t.encode() for t in TEXTS]
    plain = [library(t) for t in TEXTS]
    counts = tokens.Counts(PATH, {})
    assert counts.of(texts) == plain and counts.of(texts) == plain  # filled cache
    assert tokens.Counts(PATH, {" a": 1, "x": 1}).of(texts) == plain


def test_pattern_agrees_with_the_library_wherever_it_is_used():
    cut = tokens.tokenizer(PATH).pre_tokenizer.pre_tokenize_str
    for c in range(0x110000):
        if 0xD800 <= c <= 0xDFFF or tokens.UNSURE.search(chr(c)):
            continue
        s = f"a{chr(c)}1 {chr(c)} !{chr(c)}"
        assert [x[1] for x in cut(s)] == [m.span() for m in tokens.PIECES.finditer(s)], hex(c)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = tokens.op2_tokens(spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {i: library(t) for i, t in texts.items()}
