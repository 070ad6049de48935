from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import session, ship

    s = session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__sql__execution__arrow__maxRecordsPerBatch="2000",
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
