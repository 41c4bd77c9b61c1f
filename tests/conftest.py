import sys
from pathlib import Path

import pytest

for folder in (Path(__file__).resolve().parents[1], Path(__file__).resolve().parent):
    sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import session

    return session(cores=4, app="tests")
