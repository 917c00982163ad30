import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)  # for Python workers

from policylake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "policylake-tests")
