import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loadlens.session import build_session

    s = build_session("tests", "local[*]", 8, {"spark.ui.enabled": "false",
                                               "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *order):
    """Collected rows as tuples, sorted."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r)) if not order else sorted(
        out, key=lambda r: tuple(str(r[df.columns.index(c)]) for c in order))
