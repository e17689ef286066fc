import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from nightloom import session

    s = session.build("local[4]", 4, "4g")
    yield s
    s.stop()
