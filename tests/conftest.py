import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
ORACLE_SF = os.environ.get("HITWEAVE_ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from hitweave.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app="hitweave-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as plain tuples, sorted."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=lambda t: tuple((x is not None, x) for x in t))
