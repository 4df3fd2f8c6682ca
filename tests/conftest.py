import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("LAVRA_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from lavra import get_spark

    return get_spark("4", 4)
