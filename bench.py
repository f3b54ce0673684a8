"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   input folder            (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores             (default 8)
    BENCH_QUERIES  comma list, or `all`    (default: the headline queries)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "j01_keyed_diff", "a09_section_rollup", "a10_element_rollup", "j03_cell_diff", "a04_column_facts", "a12_collapse_table_notes",
    "j06_exact_text_match", "j08_requirement_diff", "w08_items_from_lines", "w09_requirement_stitching", "w01_word_lines", "w03_native_lines",
    "j11_near_duplicates", "j12_band_join", "j13_nearest_neighbour", "j19_upsert_blocks", "u02_action_text", "a18_notice_assembly",
)


def main() -> None:
    from revdiff.catalog import QUERIES
    from revdiff.session import local_session

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus)
    spark.read.parquet(f"{path}/region.parquet").count()  # JVM and reader warm-up, not timed
    spent = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(path.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
