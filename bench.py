"""Time the headline queries: ``BENCH_SF_DIR=... BENCH_CPUS=... python bench.py [names]`` prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "a22_class_counts",
    "a1_moments",
    "s4_matched_filter_all_bands",
    "q5_quality_audit",
    "a12_rank_auc",
    "a14_discrimination",
    "a19_spearman",
    "a28_semivariogram",
    "j4_bilinear_regrid",
    "j5_area_average",
    "j6_native_to_ortho",
    "j13_shift_join",
    "x2_cross_fit",
    "x4_pair_numerators",
    "x3_block_bootstrap",
    "j11_ambiguous_pairs",
    "g1_components",
    "a34_member_frequency",
]


def main() -> None:
    from prismgrid.plans import catalog
    from prismgrid.session import local_session

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    # untimed: starts the Python workers and warms the compiler, so the first query is not charged for it
    catalog.QUERIES["s3_sam_class"](spark, d).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
