import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tallyweave.session import local_session

    return local_session(4, "6g", 4)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
