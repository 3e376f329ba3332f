"""Corpus queries against their SQL, and what is registered."""

from __future__ import annotations

import pytest
from compare import differences, duck, entry

from renewlens.llm.catalogue import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert differences(spark, duck(SF_DIR), name, SF_DIR) == []


def test_all_are_registered():
    names = set(entry.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
