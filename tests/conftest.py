import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import local_session

    session = local_session(4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}"})
    yield session
    session.stop()
