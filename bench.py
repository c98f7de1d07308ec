"""Times the headline queries: one warm-up, then the median of three runs into the noop sink; prints one JSON line."""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "address_rollup address_stats entity_profile entity_edges tx_stats_or_join exposure_ratio top_transactions_page daily_volume trade_convergence cv_per_receiver "
    "coordinated_cashout repeated_flow temporal_coordination fan_pattern convergence terminal_node integration_alerts structuring behaviors_ranked risk_scores wallet_risk flagged_screening chain_of_custody components mixing peeling_chain cluster_list path_match"
).split()


def main() -> None:
    from tracewell.registry import queries

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, took = queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.time()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "seconds over all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
