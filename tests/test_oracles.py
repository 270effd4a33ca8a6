"""Every registered query against its DuckDB oracle, over the whole small tables."""

import pytest

from compare import compare, connect
from feedledger.workload import ORACLES, QUERIES

# These run whole ingestion batches; test_ingest.py and tests/compare.py cover them.
LONG = ("h1_", "h2_", "h5_", "h6_", "h7_")


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(LONG)])
def test_query(spark, duck, sf_dir, name):
    ok, note = compare(spark, duck, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
