"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

QUERIES = (
    "tumbling_agg", "sliding_agg", "session_agg", "agg_median", "agg_top_k", "count_sliding", "keyed_join_latest", "temporal_asof", "suppress_alerts", "dedup_cooldown",
    "silence_alerts", "trigger_debounce", "late_corrections", "median_rssi", "fleet_alerts", "nexmark_q3", "nexmark_q5", "nexmark_q7", "nexmark_q8",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from tidemark.plans import mine, registry
    from tidemark.streaming.runtime import session

    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds, rates = registry.queries(), {}, {}
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()

    def timed(name, make, n) -> None:
        make().write.format("noop").mode("overwrite").save()
        best = []
        for _ in range(2):
            at = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - at)
        seconds[name] = round(min(best), 3)
        rates[name] = round(n / min(best))

    for name in QUERIES:
        timed(name, lambda name=name: found[name](spark, sf_dir), n_events)
    if not os.environ.get("BENCH_NO_MINE"):  # the published workload: about 950,000 packets
        packets = mine.packets(spark).cache()
        n = packets.count()
        timed("mine_median_rssi", lambda: mine.median_rssi(spark, packets), n)
        from tidemark.plans.pipelines import connectivity_alerts
        from pyspark.sql import functions as F

        say = {"readings": F.size("readings") > 0, "moving": F.col("moving"), "voltage": F.col("voltage"), "sos": F.col("sos")}
        timed("mine_connectivity", lambda: connectivity_alerts(packets, ["lamp"], "ts", "seq", **say), n)
        packets.unpersist()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "events_per_sec": rates, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
