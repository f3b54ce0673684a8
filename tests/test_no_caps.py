"""Results don't change with the size of numbers, pages or lists."""

import json

from pyspark.sql import functions as F

from revdiff.operators import lists, notes, sheets, tables
from revdiff.operators.scan import by_position
from revdiff.sources import sinks


def test_pages_above_999(spark):
    pages = spark.createDataFrame([(1, p) for p in (998, 999, 1000, 1001, 1200)] + [(2, 70000), (2, 5)], "doc_id long, page_num int")
    assert {r.doc_id: r.ranges for r in sheets.page_ranges(pages).collect()} == {1: "998-1001, 1200", 2: "5, 70000"}
    limits = spark.createDataFrame([(1, 1500), (2, 10)], "doc_id long, max_page int")
    assert sorted((r.doc_id, r.page_num) for r in sheets.changed_pages([pages], limits).collect()) == [(1, p) for p in (998, 999, 1000, 1001, 1200)] + [(2, 5)]


def ranges(spark, subjects, min_len=3):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(subjects)], "k long, i long, subject string")
    out = lists.compress_ranges(df, ["k"], ["i"], by_position("i"), min_len=min_len)
    return [r.item for r in out.orderBy("place").collect()]


def test_runs_of_long_numbers_and_other_lengths(spark):
    long = [str(10**25 - 2 + i) for i in range(4)]
    assert ranges(spark, long) == [f"{long[0]}-{long[-1]}"]
    assert ranges(spark, ["007", "8", "9", "10", "x", "20", "21"]) == ["007-10", "x", "20", "21"]
    assert ranges(spark, ["1", "2", "3", "7", "8", "9", "10"], min_len=4) == ["1", "2", "3", "7-10"]
    assert ranges(spark, ["1", "2", "5"], min_len=2) == ["1-2", "5"]


def test_natural_order_of_long_digit_runs(spark):
    names = ["a" + "9" * 24, "a" + "1" + "0" * 24, "a2", "a10", "a002b", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(notes.natural_key(F.col("n")))
    assert [r.n for r in df.collect()] == ["", "a2", "a002b", "a10", "a" + "9" * 24, "a1" + "0" * 24]


def test_a_long_document_is_one_json_value(spark):
    rows = spark.range(25001).select(F.lit(1).alias("doc_id"), (25000 - F.col("id")).alias("ord"))
    made = sinks.document_json(rows).collect()
    assert len(made) == 1
    assert [e["ord"] for e in json.loads(made[0].json)["elements"]] == list(range(25001))


def test_cells_beyond_the_filled_columns_reach_the_diff(spark):
    names = ["Поз.", "Провод", "Код"]

    def filled(rows):
        df = spark.createDataFrame([(1, i + 2, c) for i, c in enumerate(rows)], "table_id long, row_index int, cells array<string>")
        return tables.fill_down(tables.data_rows(df, "table_id", names), "table_id", names, 3)

    old = filled([["1", "a", "x", "u", "same"], ["2", "b", "y"], ["3", "c", "z", "", "gone"]])
    new = filled([["1", "a", "x", "v", "same"], ["2", "b", "y", "", "more"], ["3", "c", "z"]])
    assert {tuple(r.cells) for r in old.collect()} == {("1", "a", "x", "u", "same"), ("2", "b", "y"), ("3", "c", "z", "", "gone")}
    diff = tables.cell_diff(old, new, "table_id", names).collect()
    assert sorted((r.row_key, r.col_index, r.status, r.v1_val or "", r.v2_val or "") for r in diff) == [
        ("a", 4, "modified", "u", "v"), ("b", 5, "added", "", "more"), ("c", 5, "removed", "gone", "")]
