"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from speechmill.plans import registry  # noqa: E402
from speechmill.session import build_session  # noqa: E402

HEADLINE = [
    "word_timings", "phrase_ranges", "phrase_occurrences", "many_phrases", "words_outside_slices", "negative_chunks", "slice_table",
    "provenance_counts", "project_summaries", "training_pool", "pool_counts", "recording_upsert", "run_ledger",
    "take_grades", "threshold_sweep", "fire_events", "tally", "model_comparison", "hysteresis_detector",
    "energy_bursts", "snr_mix", "window_scores", "lexicon", "near_miss_phrases", "run_progress",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus)
    queries = registry.all_queries()
    queries["recordings_per_project"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
