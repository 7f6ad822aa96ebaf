"""Headline-query benchmark: runs a fixed set of registered queries on ``$BENCH_SF_DIR`` (default sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line. Each query is run once cold (fixture views persist on first
use), then timed warm; the reported value is the sum of warm times."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from longform.catalog import queries  # noqa: E402
from longform.session import get_spark  # noqa: E402

HEADLINE = ["outline_fold", "event_graph", "story_plan", "reading_order", "context_text", "writing_waves",
            "chapter_text", "parse_events", "req_validate", "chk_dead_then_alive", "chk_nonlinear_order",
            "chk_realization"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus),
                      extra={"spark.ui.showConsoleProgress": "false"})
    qs = queries()
    times, rows = {}, {}
    for name in HEADLINE:
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_warm_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
