import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="gridscope-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def text_file(tmp_path):
    """Write lines to a file and return its path."""
    def write(name, lines):
        path = tmp_path / name
        path.write_text("\n".join(lines) + ("\n" if lines else ""), encoding="utf-8")
        return str(path)
    return write
