"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line.

The nested records are stored once, as the engine stores its derived table; that
is timed as ``derive`` and counted.  The queries then read them.
"""

import json
import os
import tempfile
import time

from answerscope.session import session

HEADLINE = ["brand_metrics", "brand_metrics_daily", "overview", "prompt_performance_latest", "drill_domains", "source_leaderboard", "timeline_delta", "audit_log", "term_counts", "rolling_eta", "upsert_latest"]


def main() -> None:
    from answerscope.plans import tpch
    from answerscope.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda n: QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("drill_domains")  # starts the JVM's compilers; not counted
    took = {}
    with tempfile.TemporaryDirectory() as folder:
        began = time.perf_counter()
        tpch.store_responses(spark, sf_dir, f"{folder}/records")
        took["derive"] = round(time.perf_counter() - began, 3)
        for name in HEADLINE:
            began = time.perf_counter()
            run(name)
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
