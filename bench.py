"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pagelattice.plans import catalog
from pagelattice.session import local_session

HEADLINE = ("page_text", "search_phrase", "search_by_page", "words_from_letters", "hit_boxes", "nearest_line_point", "selection_text", "peak_histogram_events", "url_extract", "outline_flatten", "annotations_kept", "priority_schedule", "notification_suppress", "token_spacing", "ordinals", "letter_places")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, "bench")
    catalog.QUERIES["url_extract"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
