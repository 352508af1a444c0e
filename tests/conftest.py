import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    s = build_session("tests", f"local[{os.environ.get('CPUS', '8')}]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """A table from columns of plain values."""

    def make(schema: str, *columns):
        return spark.createDataFrame(list(zip(*columns)), schema)

    return make
