import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
# Python workers import the package by this path, whatever folder pytest was started in.
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from longform.session import get_spark
    yield get_spark("local[4]", shuffle_partitions=4, extra={"spark.ui.showConsoleProgress": "false"})
