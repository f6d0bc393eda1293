"""The registered queries: names, coverage and, at the smallest scale, their SQL oracle.

Set SIFTLINE_ALL_QUERIES=1 to compare every query; by default one per area is compared.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from catalog import registry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ("s1_read_log_lines", "p5_feature_row", "r11_route_cascade", "r12_check_policy", "a9_latency_percentiles", "t3_tfidf_fit",
          "d1_stratified_split", "r5_top_incidents", "c13_history_groups", "k8_selection_report", "l5_trace_hash_audit", "l7_resolve_patches")
NAMES = sorted(registry.ORACLE) if os.environ.get("SIFTLINE_ALL_QUERIES") == "1" else SAMPLE

# Ids of the survey's operator inventory.
INVENTORY = (
    [f"s{i}" for i in range(1, 6)] + [f"p{i}" for i in range(1, 11)] + [f"t{i}" for i in range(1, 7)] + ["d1", "d2"]
    + [f"m{i}" for i in range(1, 7)] + ["m6b"] + [f"r{i}" for i in range(1, 17)] + [f"a{i}" for i in range(1, 12)]
    + [f"c{i}" for i in range(1, 16)] + [f"k{i}" for i in range(1, 17)] + [f"l{i}" for i in range(1, 9)]
)


def test_every_operator_is_registered():
    heads = {name.split("_")[0] for name in contract.queries()}
    assert [i for i in INVENTORY if i not in heads] == []
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_only_fits_lack_sql():
    assert all(name[0] == "m" for name in set(registry.QUERIES) - set(registry.ORACLE))


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r.service for r in rows} == {"payments", "web", "api", "storage", "unreadable"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    count, problems = compare(contract.queries()[name](spark, SF), duck, contract.oracle_sql()[name])
    assert problems == [] and count > 0
