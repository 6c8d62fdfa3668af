"""Every query of the market library against its SQL. ORACLE_SF_DIR picks another scale."""

from __future__ import annotations

import os

import __spark_entry__ as entry
import oracle
import pytest

from barloom.plans.oracles import ORACLES
from barloom.plans.queries import spark_queries

# Windows of 180 bars and labels 30 ahead need longer series than the smallest tables hold.
LONG_SERIES = {"lag_ratio_features", "gbt_regression_errors"}
LONG_FOLDER = "/root/testdata/sf0.01"
FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connections():
    return {folder: oracle.connect(folder) for folder in (FOLDER, LONG_FOLDER)}


def test_every_query_has_sql():
    assert set(spark_queries()) == set(ORACLES)
    assert set(spark_queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connections, name):
    folder = LONG_FOLDER if name in LONG_SERIES else FOLDER
    rows, found = oracle.differences(spark_queries()[name](spark, folder), connections[folder], ORACLES[name])
    assert not found, "\n".join(found)
    assert rows


def test_flagship(spark):
    assert entry.entry(spark).count() == 10
