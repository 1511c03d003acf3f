"""Headline queries, one JSON line. Every query computes its intermediate tables itself."""
import json
import os
import sys
import time

from lectern.plans.catalog import QUERIES, forget_stages
from lectern.session import local_session

HEADLINE = ("normalise_text page_split section_split condensed request_rows parsed_answers findings_flat ground_exact "
            "near_passages page_resolve fuzzy_match seed_top5 page_char_text located_quotes markdown_report grounding_rate "
            "cache_upsert").split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["mixed_claims"](spark, "/root/testdata/sf0.001").count()  # start JVM code paths and Python workers
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", "").split() or HEADLINE:
        forget_stages()
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
