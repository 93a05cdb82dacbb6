import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ladle.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", spark__sql__shuffle__partitions="4")
    ensure_checkpoint_dir(s)
    return s
