"""Times the headline queries once each, after a warm-up, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from rulewright.plans.registry import QUERIES
from rulewright.session import local_session

HEADLINE = [
    "q1_rule_mining", "q2_rule_pruning", "q4_match_any_cue", "q6_match_all_items", "q7_rule_dilution", "text_question_tokens", "text_question_types", "text_answer_checks",
    "w1_turn_pairs", "c1_first_by_key", "c4_offset_ids", "c9_majority", "c14_object_lists", "c15_phrase_mentions", "t1_split_9_1_1", "t2_split_8_1_1", "a1_confusion", "a2_edited_pairs",
    "a5_summary", "a8_average_precision", "g1_box_overlaps", "g6_grid_pooled", "k1_suppression", "k3_assignment", "k5_hota", "r2_running_peaks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "4g"))
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
