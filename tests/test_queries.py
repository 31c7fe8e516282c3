"""Every registered query against its SQL twin."""
import os
import re

import pytest

from privtrace.plans import load

from .compare import compare, connect

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", list(load()))
def test_query(spark, con, name):
    message, rows, _, _ = compare(spark, con, name, load()[name], D)
    assert not message, message
    assert rows >= 0


def test_names_are_plain():
    for name in load():
        assert "pipeline" not in name and not re.match(r"op\d", name)


def test_inventory_is_covered():
    want = {"S": 11, "P": 18, "D": 30, "N": 10, "R": 19, "M": 15, "A": 35, "W": 9, "U": 13, "G": 6, "T": 11}
    have = {i for q in load().values() for i in q.ids.split()}
    missing = [f"{k}{i}" for k, n in want.items() for i in range(1, n + 1) if f"{k}{i}" not in have]
    assert not missing
