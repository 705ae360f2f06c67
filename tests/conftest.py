"""One local session for all tests; Python workers get this repository's path."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
HERE = [ROOT, f"{ROOT}/tests", f"{ROOT}/tests/llm"]  # workers unpickle what tests define
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (*HERE, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quarrymill.session import session

    made = session(
        "tests", 4,
        **{"spark.driver.memory": "3g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))},
    )
    yield made
    made.stop()
