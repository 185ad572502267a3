import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import local_session

    os.chdir(tmp_path_factory.mktemp("work"))  # the warehouse goes there
    session = local_session(4, "4g", 4)
    yield session
    session.stop()
