import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loanmart import scratch  # noqa: E402
from loanmart.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    scratch.clear(session)
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def rows(df, *order):
    """Collected rows as sorted tuples."""
    names = order or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda t: [(v is not None, str(v)) for v in t])
