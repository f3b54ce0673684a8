"""Costly steps are worked out once for a row or a group, with the same results."""

import re

from pyspark.sql import functions as F

from revdiff.functions import fields as X
from revdiff.functions import text as T


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_field_tails_are_cut_once_and_in_turn(spark):
    texts = ["Гайка М4", "Гайка  Лист 3 x", 'x АО "a 123.45.67.89.123 b" c', "a Кабель", "a кабелЬ КМ 5", "a Кабеля", "Лист 3", " .;-", "", None, "a\nформат  A4 b",
             "x .ЛБУД y", "Винт Жгут 123.45-6 z", "a 123.45.67.89.1234", "a Изм. Лист", "Кабель Кабель", "a,Формат A4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def plain(c):
        text = T.norm_cell(c)
        for tail in X.FIELD_TAILS:
            text = F.regexp_replace(text, "(?iu)" + tail, "")
        return F.nullif(T.strip(T.squeeze(text), " .;,:-/"), F.lit(""))

    rows = df.select(X.clean_field(F.col("t")).alias("a"), plain(F.col("t")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
    assert plan(df.select(X.clean_field(F.col("t")).alias("x"))).count(r"\s+\.мазв.*$") == 1


def test_code_of_an_added_name_is_read_once(spark):
    df = spark.createDataFrame([("Винт", "АБВ.1 ТУ x"), ("Винт АБВ.1 ТУ", "АБВ.1 ТУ"), ("Винт", "5 шт"), ("Винт", "нов. 5"), ("Винт", None), ("Винт", ""), ("Винт", "ТУ")], "c string, d string")
    name = X.added_display_name(F.col("c"), F.col("d"))
    assert [r[0] for r in df.select(name).collect()] == ["Винт АБВ.1 ТУ", "Винт АБВ.1 ТУ", "Винт", "Винт", "Винт", "Винт", "Винт ТУ"]
    assert len(re.findall(r"regexp_extract\(", plan(df.select(name.alias("x"))))) == 1


def test_item_names_are_tidied(spark):
    df = spark.createDataFrame([("Болт- М4 / 5",), (" (  a ) , b.",), ("Болт  М4",), (None,), ("a - b",)], "t string")
    assert [r[0] for r in df.select(X.clean_item_name(F.col("t"))).collect()] == ["Болт-М4/5", "(a), b", "Болт М4", "", "a - b"]


def test_words_of_a_block_are_shuffled_once(spark):
    from revdiff.catalog.pages import p05

    physical = p05(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", physical)) == 1


def test_heads_of_tables_are_read_once_per_distinct_head(spark, monkeypatch):
    from revdiff.operators import tables

    names = ["Код", "Имя"]
    t = spark.createDataFrame([(1, i, 1 + i, 0.0, 0.0, 9.0, 9.0, n, names, 1) for i, n in enumerate(["Таблица 1", "Продолжение таблицы 1", "Прочее", "Таблица 1"])],
                              "doc_id long, table_id long, page_num int, x0 double, y0 double, x1 double, y1 double, name string, names array<string>, header_rows int")
    r = spark.createDataFrame([(i, k, names if k == 1 else [f"a{i}", str(k)]) for i in range(4) for k in (1, 2, 3)] + [(1, 4, ["код", "ИМЯ"])],
                              "table_id long, row_index int, cells array<string>")
    staged = []
    monkeypatch.setattr(tables, "stage", lambda df: staged.append(df) or df)
    heads, rows = tables.merge_continued(t, r)
    assert sorted(map(tuple, heads.select("table_id", "name", "pieces").collect())) == [(0, "Таблица 1", 3), (2, "Прочее", 1)]
    want = [(0, n + 1, c) for n, c in enumerate([names, ["a0", "2"], ["a0", "3"], ["a1", "2"], ["a1", "3"], ["a3", "2"], ["a3", "3"]])]
    assert sorted(map(tuple, rows.collect())) == want + [(2, 1, names), (2, 2, ["a2", "2"]), (2, 3, ["a2", "3"])]
    assert staged[0].count() == 3


def test_small_blocks_are_scanned_whole_and_stitched_one_way(spark, monkeypatch):
    from revdiff.operators import requirements as R
    from revdiff.operators import scan

    rows = [(1, i, t) for i, t in enumerate(["первая строка", "1", "длинный текст", "2", "ещё один текст"])] + [(2, i, t) for i, t in enumerate(["1. первый пункт", "и дальше", "2. второй пункт"])]
    df = spark.createDataFrame(rows, "page int, ord int, line string")
    chunks = []
    monkeypatch.setattr(R, "ordered_scan", lambda d, k, o, chunk, **a: chunks.append(chunk) or scan.ordered_scan(d, k, o, chunk, **a))
    whole = sorted(map(tuple, R.parse_blocks(df, ["page"]).collect()))
    assert chunks == [None, None]
    monkeypatch.setattr(scan, "CHUNK_ROWS", 2)
    assert whole == sorted(map(tuple, R.parse_blocks(df, ["page"]).collect())) and {r[0] for r in whole} == {1, 2}
    assert all(c is not None for c in chunks[2:])
