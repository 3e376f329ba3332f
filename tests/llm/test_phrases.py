from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from renewlens.llm import phrases


def slow(docs, least, top=2000):
    """Collocations of (lang, text), counted phrase by phrase."""
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                covered[lang, p[i : i + k]] = max(covered[lang, p[i : i + k]], a)
    found = {}
    for (lang, p), a in candidates.items():
        if covered[lang, p] >= a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, rows in found.items() for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)
    }


def made_up(draw, n=60):
    words = ["a", "B", "cc", "é", "É", "d\x00", "the", "of"]
    lines = ["of the cc of the", "x y z x y z x y z", "a a a a a a a"]
    text = lambda: "".join(
        (draw.choice(lines) if draw.random() < 0.2 else draw.choice(words)) + draw.choice([" ", " ", " ", "\t ", ", ", ".\n"]) for _ in range(draw.randint(0, 60))
    )
    return [(draw.choice(["en", "en", "de", None, "und"]), draw.choice([text(), text(), None, ""])) for _ in range(n)]


@pytest.mark.parametrize("budget", [phrases.BUDGET, 30, 1])
def test_equals_brute_force(spark, budget):
    """Small budgets open prefixes of two, three and four words."""
    docs = made_up(random.Random(7))
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    found = {tuple(r) for r in phrases.collocations(frame, least=5, budget=budget).collect()}
    assert found == slow(docs, 5) and len(found) > 30


def test_top_with_ties(spark):
    docs = made_up(random.Random(8), 40)
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert {tuple(r) for r in phrases.collocations(frame, least=3, top=4).collect()} == slow(docs, 3, 4)


def test_odd_rows(odd, none):
    docs = [(r["lang"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in phrases.collocations(odd, least=2).collect()} == slow(docs, 2)
    assert phrases.collocations(odd, least=2).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(none).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    rows = [(10**17 - 1, 10**15 - 7, 10**17, 10**17 + 3), (100, 10**15, 100, 100), (3, 7, 11, 13)]
    found = spark.createDataFrame(rows, "a long, n long, l long, r long").select(phrases.score("a", "n", "l", "r")).collect()
    assert [r[0] for r in found] == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_hashes_of_tasks_are_those_of_spark(spark):
    words = spark.createDataFrame([("en", "the"), ("é", "ñ\x00")], "lang string, word string")
    rows = words.select("*", phrases.word_hash(3).alias("h1"), F.xxhash64("word").alias("h2"), F.lit(-5).cast("long").alias("h3")).withColumn("m", phrases.mixed_column(phrases.H[:3])).collect()
    for r in rows:
        assert r["h1"] == phrases._signed(phrases.xxhash.xxh64_intdigest(phrases.lang_prefix(r["lang"], 3) + r["word"].encode(), phrases.SEED))
        assert r["m"] == phrases.mixed([np.array([r[h]], dtype=np.int64).view(np.uint64) for h in phrases.H[:3]]).view(np.int64)[0]


def test_other_salt_if_hashes_meet(spark, monkeypatch):
    words = spark.createDataFrame([("en", "a", 90), ("en", "b", 10), ("en", "c", 5)], "lang string, word string, n long")
    apart = phrases.word_hash
    monkeypatch.setattr(phrases, "word_hash", lambda salt: F.lit(1).cast("long") if salt < 2 else apart(salt))
    assert phrases.with_hashes(words, 100)[1] == 2 and phrases.with_hashes(words, 200)[1] == 0


def test_long_texts_are_cut_at_breaks():
    text = b"one two. three,four\n" * 50
    parts = list(phrases.segments(text, 30))
    assert len(parts) > 10 and b"".join(parts) == text and all(p[-1:] in (b".", b",", b"\n") for p in parts[:-1])
    assert list(phrases.segments(b"x " * 100, 30)) == [b"x " * 100, b""]
