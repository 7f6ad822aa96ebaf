"""Parameters and the per-session fixture cache shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from longform.session import story_session
from longform.sources.fixtures import Fixtures

# Outline parameters of the registered queries: the defaults of a run. The gate queries use a small cap, since no story of
# the fixture has more than 25 events.
K_CANDIDATES = 3
MAX_VAL = 2
MAX_EVENTS = 30
GATE_EVENTS = 6
RUN_ID = "run-1"

_CACHE: dict[tuple[str, str], Fixtures] = {}


def fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    key = (spark.sparkContext.applicationId, sf_dir)
    story_session(spark)
    if key not in _CACHE:
        _CACHE[key] = Fixtures(spark, sf_dir)
    return _CACHE[key]
