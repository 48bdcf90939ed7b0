"""Every named query beside its SQL oracle, on the smallest tables.

AIRTIDE_SF_DIR points the comparison at larger ones.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from airtide.operators import cleaning, lookup
from airtide.plans.catalog import MAINTAINED, RESULTS
from oracles import oracle_queries
from tests.oracle_check import compare, connect

NAMED = RESULTS | MAINTAINED
SF_DIR = os.environ.get("AIRTIDE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert NAMED.keys() == oracle_queries().keys()
    assert NAMED.keys() <= contract.queries().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.fixture(scope="module")
def queries():
    return contract.queries()


@pytest.mark.parametrize("name", list(NAMED))
def test_query_matches_oracle(spark, con, queries, name):
    assert compare(spark, con, queries, name, SF_DIR) is None


JOINED = ["slot_mean", "slot_dedup", "outlier_cut_2s", "outlier_audit_low3",
          "group_only_main", "concurrent_slots", "slot_pressure"]


@pytest.mark.parametrize("heavy_rows", [2, 20])
def test_rows_served_as_heavy_match_too(spark, con, monkeypatch, heavy_rows):
    monkeypatch.setattr(lookup, "HEAVY_ROWS", heavy_rows)
    monkeypatch.setattr(cleaning, "HEAVY_ROWS", heavy_rows)
    queries = contract.queries()
    for name in JOINED:
        assert compare(spark, con, queries, name, SF_DIR) is None, name
