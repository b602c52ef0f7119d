"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores,
``BENCH_QUERIES`` may name some queries or ``all``. Every query runs twice and the
better time counts, so that the first query does not pay for the JVM's start.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import SparkSession  # noqa: E402

from listsieve.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "evaluate_ads", "funnel", "language_filter_de", "score_terms", "geography",
    "normalize_urls", "first_wins_ads", "domain_skip_table", "strip_html_pages",
    "attribution", "merged_state", "merged_fresh", "purged_state", "status_update",
    "listed", "state_facets", "new_match_digest", "budget_per_source", "verify_enrich",
    "enrich_hits", "json_feed", "rss_feed", "embedded_json", "full_cards",
    "markdown_listing", "stream_merge",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("listsieve-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.listsieve.spread", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="listsieve-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "listing triage, all headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(Path(sf_dir).name.removeprefix("sf") or 0),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
