from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from renewlens.llm import spelling

UPPER = re.compile("[A-Z]+")


def slow_counts(docs, damage, least=6):
    """Words of (id, text), one run after the other."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = UPPER.sub(lambda m: m[0].lower(), run)
            if damage:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % damage == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= 5}


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(counts, ratio=5):
    out, form = {}, {}
    for w, n in counts.items():
        near = sorted((-counts[o], o) for o in counts if abs(len(o) - len(w)) < 2 and one_edit(w, o))
        if near and -near[0][0] >= ratio * n:
            form[w] = near[0][1]
        out[w] = len(near)
    root = lambda w: root(form[w]) if w in form else w
    return {(w, form.get(w), root(w), counts[w], out[w], counts[form[w]] if w in form else None) for w in counts}


def vocabulary_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def made_up(draw, words=400, letters="abé", longest=9):
    return {"".join(draw.choice(letters) for _ in range(draw.randint(1, longest))): draw.choice([1, 5, 5, 25, 130, 700]) for _ in range(words)}


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_near_words_equal_all_pairs(spark, block):
    counts = made_up(random.Random(2))
    found = {tuple(r) for r in spelling.near_words(vocabulary_of(spark, counts), 1, block).collect()}
    expected = set()
    for w in counts:
        near = sorted((-counts[o], o) for o in counts if one_edit(w, o))
        if near:
            expected.add((w, len(near), near[0][1], -near[0][0]))
    assert found == expected


@pytest.mark.parametrize("damage", [None, 7])
def test_variants_equal_brute_force(spark, damage):
    draw = random.Random(4)
    counts = made_up(draw, 120, "abcdÀ", 8)
    bag = [w for w, n in counts.items() for _ in range(min(n, 60))]
    draw.shuffle(bag)
    docs = [(i % 50 if i % 9 else None, draw.choice([" ", ", ", "1", "×-"]).join(bag[i : i + 40]).replace("a", "A", 3)) for i in range(0, len(bag), 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = spelling.spelling_variants(frame, damage=damage, least_length=3)
    assert {tuple(r) for r in found.collect()} == slow(slow_counts(docs, damage, 3))


def test_forms_are_followed_to_the_last(spark):
    counts = {"abcdefg": 5, "abcdefh": 25, "abcdehh": 125, "abcdhhh": 625, "abchhhh": 3125, "zbchhhh": 15625, "zbchhhhh": 16000}
    texts = [((n, " ".join([w] * n))) for n, w in ((n, w) for w, n in counts.items())]
    found = spelling.spelling_variants(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == slow(counts)
    assert {r["root"] for r in found.collect() if r["word"] < "z"} == {"zbchhhh"}


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = spelling.spelling_variants(odd, damage=5, least_length=1, least_count=1)
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = UPPER.sub(lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 5 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts.pop("", None)
    assert {tuple(r) for r in found.collect()} == slow(counts)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_variants(none).count() == 0


def test_a_ratio_without_an_end_is_refused(none):
    with pytest.raises(ValueError):
        spelling.spelling_variants(none, ratio=1)
