"""Groups known to be small are scanned by plain windows; large ones still go by chunks, with the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from revdiff.operators import geometry, lines, pairing, scan, tables
from revdiff.operators.scan import by_position, chunk_if_large, number_rows, ordered_scan


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]


@pytest.mark.parametrize("limit", [5, 200, 65536])
def test_sizes_decide_between_chunks_and_whole_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(scan, "CHUNK_ROWS", limit)
    rng = random.Random(limit)
    rows = [(0 if rng.random() < 0.3 else rng.randrange(1, 30), i, rng.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, ord int, v int")
    chunk = chunk_if_large(df, ["g"], by_position("ord", 5))
    assert (chunk is None) == (limit >= 200)
    args = dict(running={"s": F.coalesce("v", F.lit(0))}, carry={"c": F.col("v")}, previous={"p": F.col("v")}, following={"f": F.col("v")})
    got, want = (ordered_scan(df, ["g"], ["ord"], c, **args) for c in (chunk, by_position("ord", 7)))
    assert got.schema == want.schema and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_full_buckets_of_small_groups_are_counted_by_group(spark, monkeypatch):
    monkeypatch.setattr(scan, "BUCKETS", 1)
    monkeypatch.setattr(scan, "CHUNK_ROWS", 10)
    df = spark.range(40).select((F.col("id") % 8).alias("g"), F.col("id").alias("ord"))
    assert chunk_if_large(df, ["g"], by_position("ord")) is None
    assert chunk_if_large(df.withColumn("g", F.lit(1)), ["g"], by_position("ord")) is not None
    assert chunk_if_large(df.limit(0), ["g"], by_position("ord")) is None


def test_whole_scans_along_one_key_shuffle_once(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("g"), F.col("id").alias("ord"))
    twice = number_rows(number_rows(df, ["g"], ["ord"], None, "a"), ["g"], ["ord"], None, "b")
    assert len(exchanges(twice)) == 1


def table_rows(spark):
    rows = [(t, r, ["Код", "Имя", "Кол."] if r == 1 else [f"k{r % 3}", "" if r % 2 else f"n{r}", str(r)]) for t in (1, 2, 3) for r in range(1, 9)]
    return spark.createDataFrame(rows, "table_id long, row_index int, cells array<string>")


def test_table_rows_are_the_same_by_chunks_and_shuffled_once_otherwise(spark, monkeypatch):
    names = ["Код", "Имя", "Кол."]

    def filled():
        return tables.neighbour_rows(tables.fill_down(tables.data_rows(table_rows(spark), "table_id", names), "table_id", names, 3, ("имя",)), "table_id")

    whole = filled()
    assert len(exchanges(whole)) == 1
    monkeypatch.setattr(scan, "CHUNK_ROWS", 3)
    assert sorted(map(str, whole.collect())) == sorted(map(str, filled().select(*whole.columns).collect()))


def test_heads_are_read_once_for_each_distinct_one(spark):
    rows = [(i, i // 4, i % 4, 1, f"Таблица {i % 2}", ["Код", "Имя"] if i % 3 else None) for i in range(24)]
    df = spark.createDataFrame(rows, "table_id long, doc_id long, ord long, page_num int, name string, names array<string>")
    got = tables.with_heads(df, {"marks": tables.fill_marks(F.col("names"), ("имя",))})
    assert {(r.table_id, tuple(r.marks or ())) for r in got.collect()} == {(r[0], (False, True) if r[5] else ()) for r in rows}
    new = df.filter("table_id % 5 > 0")
    paired = pairing.pair_tables(df, new, pairing.token_share).collect()
    assert sorted(r.old_id for r in paired if r.old_id is not None) == list(range(24))
    assert sorted(r.new_id for r in paired if r.new_id is not None) == [i for i in range(24) if i % 5]


def page_words(spark):
    rng = random.Random(4)
    rows = [(d, p, i, i // 6, rng.randrange(0, 600) * 1.0, (i // 6) * 14 + rng.randrange(0, 5) * 1.0, f"w{i}") for d in (1, 2) for p in (1, 2) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id int, page_num int, i int, line int, x0 double, y0 double, text string").withColumns(
        {"x1": F.col("x0") + 20, "y1": F.col("y0") + 10})


@pytest.mark.parametrize("what", ["segment", "lines", "exact"])
def test_words_of_small_pages_are_shuffled_once(spark, monkeypatch, what):
    def run():
        w = page_words(spark)
        if what == "segment":
            return geometry.segment(w, ["doc_id", "page_num", "line"], 45.0)
        return geometry.number_lines(w) if what == "lines" else geometry.number_lines_exact(w)

    whole = run()
    assert len(exchanges(whole)) == 1
    monkeypatch.setattr(scan, "CHUNK_ROWS", 3)
    chunked = run()
    assert len(exchanges(chunked)) > 1
    assert sorted(map(str, whole.collect())) == sorted(map(str, chunked.select(*whole.columns).collect()))


def test_items_are_the_same_by_chunks_and_read_once_for_each_merge(spark, monkeypatch):
    rows = [(d, o, 1, "Section" if o % 9 == 0 else None, o % 11 == 0, str(o) if o % 3 == 1 else None, f"d{o % 4}", f"name {o % 5}", "1", "n") for d in (1, 2) for o in range(1, 30)]
    df = spark.createDataFrame(rows, "doc_id int, ord int, page_num int, section_here string, is_service boolean, position string, designation string, name string, quantity string, note string")
    staged = []
    real = lines.stage
    monkeypatch.setattr(lines, "stage", lambda f: staged.append(1) or real(f))
    whole = lines.items_from_rows(df)
    assert len(staged) == 2
    monkeypatch.setattr(scan, "CHUNK_ROWS", 3)
    assert sorted(map(str, whole.collect())) == sorted(map(str, lines.items_from_rows(df).collect()))


def test_item_table_heads_are_mapped_once(spark, monkeypatch):
    head = ["Поз.", "Обозначение", "Наименование", "Кол."]
    rows = [(t, r, head if r == 2 else ["", "Материалы", "", ""] if r == 3 else [str(r), f"d{r}", f"n{r}", "1"]) for t in (1, 2) for r in range(2, 9)]
    df = spark.createDataFrame(rows, "table_id int, row_index int, cells array<string>")
    boxes = spark.createDataFrame([(7, t, 1, 0.0, 10.0 * t) for t in (1, 2)], "doc_id int, table_id int, page_num int, x0 double, y0 double")
    columns, real = [], lines.stage
    monkeypatch.setattr(lines, "stage", lambda f: columns.append(f.columns) or real(f))
    found = {(r.position, r.designation, r.name) for r in lines.items_from_tables(boxes, df).collect()}
    assert found == {(str(r), f"d{r}", f"n{r}") for r in range(4, 9)}
    assert ["table_id", "row_index", "map"] in columns
