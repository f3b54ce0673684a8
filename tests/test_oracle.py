"""Registered queries against their DuckDB oracles on the smallest given tables.

A sample of the registry by default; all of it with REVDIFF_ALL=1.
"""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path(os.environ.get("REVDIFF_SF", "/root/testdata/sf0.001"))
SAMPLE = ("s01_version_pairs", "p05_noise_tables", "p15_mask_secrets", "j01_keyed_diff", "j03_cell_diff", "j06_exact_text_match", "j07_fuzzy_pairs_tokens",
          "j11_near_duplicates", "j12_band_join", "j13_nearest_neighbour", "j15_two_sided_cancellation", "j19_upsert_blocks", "a01_merge_texts",
          "a03_merge_continued", "a04_column_facts", "a09_section_rollup", "a12_collapse_table_notes", "a18_notice_assembly", "w02_gap_segments",
          "w08_items_from_lines", "w09_requirement_stitching", "w12_range_compression", "o07_top_with_rest", "u02_action_text", "f04_compare_key", "j03_table_diff", "j04_schematic_diff", "j09_table_pairing_tokens", "j11_near_duplicates_exact",
          "j12_conductors", "j13_nearest_connector", "j13_code_letter", "j17_note_coverage", "w07_items_from_tables", "a04_fact_values", "a17_best_blocks", "f08_f09_document_fields",
          "o02_stamp_titles", "s03_full_diff_json", "change_notice")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("REVDIFF_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not SF.exists(), reason="given tables not there")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want and got


def test_registry_is_complete():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {"doc_id", "kind", "section", "line_no", "line"} == set(entry.entry(spark).columns)
