import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from chartloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(name="chartloom-tests", memory="8g")
    yield session
    session.stop()
