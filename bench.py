"""Time the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8), and
``BENCH_QUERIES``, a comma-separated list of query names or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINES = (
    "e1_detection_corpus",
    "e2_family_corpus",
    "e2_combined_labels",
    "flt3_frequent_labels",
    "flt4_cap_imbalance",
    "flt9_exclusion_reasons",
    "w2_dedup_across_sides",
    "w9_random_split",
    "w10_guaranteed_split",
    "w12_temporal_class_split",
    "w13_temporal_split",
    "w16_spatial_bias",
    "w20_packed_blocks",
    "w21_section_bounds",
    "ag4_redundancy",
    "ag7_packing_map",
    "ag9_size_summary",
    "ag12_unigram_probabilities",
    "tk1_choose_labels",
    "sc3_digests",
    "sc11_byte_ids",
    "tok1_byte_words",
    "tok4_word_vocabulary",
    "tok5_encode_words",
    "tok6_train_merges",
    "fe1_byte_histogram",
    "fe2_byte_entropy_histogram",
    "fe3_fe4_string_features",
    "fe5_hashed_strings",
    "ev3_to_ev8_multiclass",
    "ev9_one_vs_rest",
    "ev11_to_ev14_multi_label",
    "src1_archive_members",
    "sc19_decoded_payloads",
    "st3_running_counts",
)


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    from samplemill.plans.session import local_session
    from samplemill.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINES)
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), "16g")
    # Start the Python workers of all cores and the code generator before the clock runs.
    QUERIES["sc12_input_ids"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name:36}{seconds[name]:8.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
