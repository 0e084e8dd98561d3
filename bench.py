"""Times the headline queries on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from regspark.plans import catalog
from regspark.plans.retrieval import flagship
from regspark.session import local_session

HEADLINE = [
    "t01_plain_articles", "t03_real_articles", "t05_markdown_articles", "t16_text_with_header", "t20_html_articles",
    "f04_keywords", "f10_query_expansion", "r01_cross_references", "r02_j07_wikilinks", "r03_graph_degrees",
    "v01_j13_three_view_search", "v10_zone_filter_with_fallback", "v13_keyword_search", "g04_j09_point_in_zone",
    "g06_nearby_parcel", "a11_consolidated_units", "a12_unit_table", "j15_cadastral_layers", "k04_upsert", "k10_cache_aside",
    "m05_latest_state", "w02_session_history",
]


def run(df) -> None:
    """Every column of every row is computed, nothing is collected."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "regspark-bench")
    catalog.load_all()
    run(catalog.QUERIES["s05_page_keys"](spark, sf))  # starts the executors, not timed
    times = {}
    for name, fn in {"flagship": flagship, **{n: catalog.QUERIES[n] for n in HEADLINE}}.items():
        start = time.perf_counter()
        run(fn(spark, sf))
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
