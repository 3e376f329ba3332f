from __future__ import annotations

import random

from renewlens.llm.components import components


def brute(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_against_union_find(spark):
    rng = random.Random(3)
    chain = [(n, n + 1) for n in range(60)]
    star = [(100, n) for n in range(101, 400)]
    loose = [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)]
    links = chain + star + loose + [(7, 7), (None, 3), (3, None), (-5, 60), (60, -5)]
    rng.shuffle(links)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["root"] for r in found} == brute(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
