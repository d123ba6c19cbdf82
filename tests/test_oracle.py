"""Registered queries against their SQL twins at the smallest scale.

One query per family by default; ``PERINUC_ALL=1`` checks every one.
"""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.verify import TABLES, oracle_rows, spark_rows

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a7_ne_stability", "a10_compare_stability", "a1_summary_stats", "a18_distance_stats", "j6_iou_best_match",
    "j7_greedy_pair", "s9_unpack_reg_slice", "s1_catalog", "w4_cumulative_length", "w3_u_ranges", "w9_bridge_gaps",
    "j17_signed_distance", "a36_profile_edge", "j19_sample_along_normals", "a41_shift_by_correlation", "w11_fdr", "w13_ledger_state",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PERINUC_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    names, got = spark_rows(entry.queries()[name](spark, SF))
    want_names, want = oracle_rows(con, entry.oracle_sql()[name])
    assert names == want_names
    assert got == want and got


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns[:2] == ["fov_id", "ne_label"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
