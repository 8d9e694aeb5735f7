import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lodemark.session import local_session

    session = local_session(cores=min(8, os.cpu_count() or 4), memory="4g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF
