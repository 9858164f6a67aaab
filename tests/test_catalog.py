"""Every registered query against its SQL counterpart on the smallest tables."""

import os
import sys

import pytest

from conftest import ROOT
from corpuseval import catalog

sys.path.insert(0, os.path.join(ROOT, "tools"))
from check_queries import compare  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    outcome, _ = compare(spark, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert outcome.startswith(("ok", "rows only")), outcome
