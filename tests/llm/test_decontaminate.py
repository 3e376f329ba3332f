from __future__ import annotations

import random
import re

import pytest

from renewlens.llm.decontaminate import find_benchmark, without_benchmark

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items):
    doc, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for s in range(len(doc) - k + 1):
                if doc[s : s + k] == w[i : i + k]:
                    hit.update(range(s, s + k))
                    found.add(str(item))
    return len(doc), hit, sorted(found)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice("ab cd ef gh the of ünder x1".split()) + rng.choice("0123456789") for _ in range(n))
    items = [(n, make(rng.randrange(4, 40))) for n in range(30)]
    items += [(90, "two words"), (91, "Solo"), (92, ""), (93, None), (None, "no id at all"), (94, items[0][1]), (3, "an other text of item three"), (95, "a a a a a a a a a a a a")]
    texts = [make(rng.randrange(0, 80)) for _ in range(40)]
    texts += [f"{make(5)}, {items[n][1].upper()}! {make(7)}" for n in range(10)]
    texts += [items[5][1][: len(items[5][1]) // 2], "TWO-words", "solo", None, "", "a " * 30, "an other text of item three", items[7][1] + " " + items[8][1]]
    docs = spark.createDataFrame([(n, t, "x", "y") for n, t in enumerate(texts)] + [(0, texts[0], "x", "y"), (None, "two words", "x", "y")], "doc_id long, text string, spans string, item_ids string")
    return docs, spark.createDataFrame(items, "item_id long, text string"), [x for x in items if x[0] is not None]


@pytest.mark.parametrize("block", [400_000, 40])
def test_against_brute_force(case, block):
    docs, benchmark, items = case
    expected = sorted(
        ((r["doc_id"] is None, r["doc_id"] or 0, *slow(r["text"], items)) for r in docs.collect()), key=str
    )
    found = sorted(
        (
            (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], {p for s in r["spans"] for p in range(s["start"], s["end"])}, r["item_ids"])
            for r in find_benchmark(docs, benchmark, block_words=block).collect()
        ),
        key=str,
    )
    assert found == expected
    assert any(x[4] for x in found) and not all(x[4] for x in found)


def test_clean_documents_stay(case):
    docs, benchmark, items = case
    kept = without_benchmark(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if not slow(r["text"], items)[1])


def test_odd_and_empty(spark, odd, none, case):
    _, benchmark, _ = case
    assert find_benchmark(odd, benchmark).count() == odd.count()
    assert find_benchmark(none, benchmark).count() == 0
    empty = benchmark.limit(0)
    assert find_benchmark(odd, empty).filter("size(spans) > 0 OR size(item_ids) > 0").count() == 0
    assert without_benchmark(odd, empty).count() == odd.count()
