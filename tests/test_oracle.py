"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import differences, duck, entry

from renewlens.plans.catalogue import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(spark, con, name, SF_DIR) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
