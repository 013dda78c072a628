import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("TALKENGINE_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from talkengine.plans import runtime

    s = runtime.session(4, 4)
    runtime.ship(s)
    yield s
    s.stop()
