"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

from compare import check, connect
from tidemark.plans import COVERS, ORACLE, QUERIES

#: Queries whose SQL has no rows on the smallest tables
EMPTY: set[str] = {"nested_fitted_thresholds"}  # five years of training days are more than there are


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, msg, _ = check(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
    assert ok or (name in EMPTY and msg == "both empty"), msg


def test_registry_is_complete():
    assert set(ORACLE) <= set(QUERIES) == set(COVERS)
    assert not [n for n in QUERIES if n.startswith("op") and n[2:3].isdigit()]
