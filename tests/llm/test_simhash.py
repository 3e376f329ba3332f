from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from renewlens.llm import simhash


def slow_fingerprint(text):
    words = [w for w in _split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(text):
    word = ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            if word:
                yield word
            word = ""
        else:
            word += c
    if word:
        yield word


def slow_components(marks):
    """id -> smallest reachable id, for (id, fingerprint) pairs."""
    left, out = set(range(len(marks))), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            n = todo.pop()
            group.append(n)
            near = {m for m in left if bin(marks[n][1] ^ marks[m][1]).count("1") <= 2}
            left -= near
            todo += near
        ids = [marks[n][0] for n in group if marks[n][0] is not None]
        out.update({n: min(ids) if ids else None for n in group})
    return out


def test_fingerprints():
    for text in ("", " \n", "A", "A b", "a B c", "a b c d", "Ä Ö ü x\x0by", "the same the same the same the same"):
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_masks_hold_every_link():
    rng = random.Random(1)
    assert len(simhash.MASKS) == 27 and min(m.bit_count() for m in simhash.MASKS) >= 43
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randrange(3)))
        assert any(flip & m == 0 for m in simhash.MASKS)


def test_node_links_equal_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30, 3), dtype=np.uint64)
    marks = np.unique((base[:, None] ^ flips[..., 0] ^ flips[..., 1] ^ (flips[..., 2] * np.uint64(0))).ravel())
    pairs = simhash.node_links(marks, 0)
    label = {n: n for n in range(len(marks))}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in pairs:
        assert bin(int(marks[i] ^ marks[j])).count("1") <= 2
        label[find(i)] = find(j)
    found = {frozenset(m for m in label if find(m) == r) for r in {find(n) for n in label}}
    slow = slow_components([(n, int(m)) for n, m in enumerate(marks)])
    assert found == {frozenset(m for m in slow if slow[m] == r) for r in set(slow.values())}


def test_near_copies_and_odd_rows(spark, odd, make):
    rng = random.Random(2)
    words = [f"w{n}" for n in range(400)]
    bases = [[rng.choice(words) for _ in range(300)] for _ in range(15)]
    texts = [" ".join(b) for b in bases]
    for b in bases:
        for _ in range(4):
            c = list(b)
            c[rng.randrange(len(c))] = "changed"
            texts.append(" ".join(c))
    texts += [texts[0]] * 5
    docs = make(*texts).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    found = simhash.near_duplicates(docs).collect()
    source = {}
    for r in docs.collect():
        source.setdefault(r["doc_id"], set()).add(slow_fingerprint(r["text"]))
    marks = [(r["doc_id"], r["fp"] % 2**64) for r in found]
    assert len(found) == docs.count()
    assert all(fp in source[i] for i, fp in marks)
    slow = slow_components(marks)
    assert [r["component_id"] for r in found] == [slow[n] for n in range(len(found))]


def test_one_per_group(spark, odd, none):
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    groups = slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in odd.collect()])
    assert ids == sorted(set(groups.values()))
    assert simhash.one_per_group(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_groups_without_ids_keep_one_row(spark):
    data = [(None, "a b c d e"), (None, "a b c d e"), (None, "quite another text here"), (3, "x y z"), (None, "x y z")]
    kept = simhash.one_per_group(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in kept) == ["a b c d e", "quite another text here", "x y z"]
    assert [r["doc_id"] for r in kept if r["text"] == "x y z"] == [3]


def test_an_id_of_several_groups_keeps_a_row_of_each(spark):
    one, two, three = "a b c d e", "quite another text here", "third words that are unlike the others"
    data = [(5, one), (5, two), (5, two), (8, two), (2, three), (5, three), (9, one), (7, "alone"), (None, one)]
    found = simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert found.select("root").distinct().count() == 4
    kept = simhash.one_per_group(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(5, one), (5, two), (2, three), (7, "alone")])


def test_near_copies_under_one_id_keep_one_row(spark):
    # other texts with the same fingerprint
    data = [(5, "a b c d e"), (5, "A B c d  e"), (5, "a b c d e"), (6, "a b c d e"), (5, "quite another text here")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    groups = simhash.near_duplicates(docs).select("root").distinct().count()
    kept = simhash.one_per_group(docs).collect()
    assert len(kept) == groups and {r["doc_id"] for r in kept} == {5}
