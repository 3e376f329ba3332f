from __future__ import annotations

import numpy as np
import pytest

from renewlens.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, mark long, rep long, size int, n string"


def brute(rows):
    """vec_id, links, smallest reachable id per row, from all pairs."""
    usable = [n for n, r in enumerate(rows) if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    unit = {n: np.array(rows[n][1], dtype=np.float32).astype(float) for n in usable}
    unit = {n: v / np.linalg.norm(v) for n, v in unit.items()}
    near = {n: [m for m in usable if m != n and rows[m][2] == rows[n][2] and len(unit[m]) == len(unit[n]) and unit[m] @ unit[n] >= 0.98] for n in usable}
    root = [r[0] for r in rows]
    for n in usable:
        seen, todo = {n}, [n]
        while todo:
            new = {m for k in todo for m in near[k]} - seen
            seen |= new
            todo = list(new)
        root[n] = min(rows[m][0] for m in seen)
    return sorted(((r[0], len(near.get(n, ())), root[n], r[0] is not None and r[0] == root[n]) for n, r in enumerate(rows)), key=str)


def planted(dim, groups, rng, spread):
    rows = []
    for g in range(groups):
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        for _ in range(rng.integers(1, 7)):
            noise = rng.standard_normal(dim)
            rows.append((base + spread * rng.random() * noise / np.linalg.norm(noise)).tolist())
    return rows


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(7)
    vectors = planted(64, 60, rng, 0.25) + planted(24, 20, rng, 0.2)
    base = rng.standard_normal(64)
    vectors += [(base + 0.1 * rng.standard_normal(64) / 8).tolist() for _ in range(150)]  # one large group
    rows = [(n, np.float32(v).tolist(), n % 2) for n, v in enumerate(vectors)]
    rows += [(1000 + n, *rows[n][1:]) for n in (0, 0, 5, 200, 200)]
    odd = [None, [], [0.0] * 64, [None] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [1e30] * 64, [1e-30] * 64]
    rows += [(2000 + n, v, 0) for n, v in enumerate(odd)] + [(3000, rows[0][1], None), (None, rows[0][1], 0)]
    return rows


@pytest.mark.parametrize("split, kind", [(embeddings.SPLIT, "float"), (20, "double")])
def test_against_brute_force(spark, case, split, kind):
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in case], SCHEMA.replace("float", kind)).repartition(3)
    found = sorted((tuple(r) for r in embeddings.near_duplicates(df, split=split).collect()), key=str)
    expected = brute(case)
    links = sum(r[1] for r in expected)
    assert [r[0] for r in found] == [r[0] for r in expected]
    assert abs(sum(r[1] for r in found) - links) <= 0.001 * links
    assert sum(a != b for a, b in zip(found, expected)) <= 2


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in embeddings.op6_embeddings(spark, sf).collect()), key=str) == brute(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    vec = rng.standard_normal((300, 64))
    vec[1::2] = vec[::2] + 0.15 * rng.standard_normal((150, 64))
    unit = embeddings._unit(vec)
    rotated, signs, factors = embeddings.codes(unit)
    estimate = np.mean([(2.0 * s - 1) @ r.T / (8 * f[:, None]) for s, r, f in zip(signs, rotated, factors)], axis=0)
    error = estimate - unit @ unit.T
    np.fill_diagonal(error, 0)
    assert abs(error.mean()) < 0.003
    bound = embeddings.SURE * np.sqrt((1 - factors**2) / factors**2).mean(axis=0) / np.sqrt(63 * len(signs))
    assert (np.abs(error) <= bound[:, None]).mean() > 0.9999


def test_no_rows(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
