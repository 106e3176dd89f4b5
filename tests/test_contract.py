"""The registry and a few queries against DuckDB on the smallest data."""

import re

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

from .conftest import FOLDER

SPOT = [
    "A1_outliers", "A3_sector_baselines", "A11_pit_losses", "A37_outcome_distribution", "E16_position_change", "J6_nearest_baseline",
    "J13_rewind_invalidation", "R9_braking", "R4_sector_snapshot_stream", "S2_lap_packets", "W2_effective_coefficients", "K2_upsert",
]


def test_registry_is_complete():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries)
    without = {n for n in set(queries) - set(sqls) if not re.match(r"op\d+_|pipeline$", n)}
    assert not without


@pytest.mark.parametrize("name", SPOT)
def test_matches_sql(spark, name):
    assert compare(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
