"""The registered queries of the corpus operators against their SQL."""

import pytest

from compare import compare, connect
from feedledger.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    ok, note = compare(spark, connect(sf_dir), sf_dir, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_names_and_contract_columns():
    assert sorted(QUERIES) == sorted([*(n for n in QUERIES if n.startswith("op")), "pipeline"])
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline"} == set(range(1, 14))
