"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the threads, ``BENCH_QUERIES`` (optional) a comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bindings.queries import QUERIES  # noqa: E402
from storyline.session import build_session  # noqa: E402

HEADLINE = [
    "daily_analysis",
    "daily_briefing",
    "hac_average",
    "hac_average_rounds",
    "hac_single",
    "hac_complete",
    "similarity_join",
    "threshold_sweep",
    "suggest_threshold",
    "silhouette",
    "intra_similarity",
    "distance_percentiles",
    "cluster_metrics",
    "cluster_medoid",
    "story_categories",
    "story_cards",
    "sources_view",
    "unclustered_by_source",
    "other_headlines",
    "briefing_context",
    "stories_digest",
    "headline_context",
    "clean_html",
    "clean_article",
    "parse_published",
    "validate_entries",
    "feed_stats",
    "topn_per_feed",
    "dedupe_articles",
    "ingest_articles",
    "group_by_source",
    "embed_articles",
    "embed_hashing",
    "embed_incremental",
    "articles_roundtrip",
    "incremental_issues",
    "rss_scan",
    "episode_feed_scan",
    "episode_catalog",
    "previous_episode",
    "contingency",
    "adjusted_rand",
    "nmi",
    "stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="storyline-"), "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in wanted:
        start = time.time()
        # Every column is computed; nothing is sent to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
