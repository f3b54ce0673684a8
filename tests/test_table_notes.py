"""Table notes: every pattern is matched once, and groups scanned whole or by chunks give the same lines."""

from revdiff.operators import notes as N
from revdiff.operators import scan

ROWS = [(1, 0, 'В таблице 2 в графе "Код" изменилось значение для "a".'), (1, 1, 'В таблице 2 введены записи для "b"..'), (1, 2, 'В ТАБЛИЦЕ 2 введены записи для "B"'),
        (1, 3, "Изменена таблица 2"), (1, 4, "Изменена таблица 3"), (1, 5, "Изменена таблица"), (1, 6, " Изменена графика чертежа. "), (2, 0, "Изменена таблица"),
        (2, 1, None), (3, 0, 'Из таблицы аннулированы записи для "c".')]
LINES = [(1, 0, 0, "Изменена таблица 2:"), (1, 0, 1, '- в графе "Код" изменилось значение для "a";'), (1, 0, 2, '- введены записи для "b".'), (1, 4, 0, "Изменена таблица 3."),
         (1, 6, 0, "Изменена графика чертежа."), (2, 0, 0, "Изменена таблица."), (2, 1, 0, None), (3, 0, 0, 'Изменена таблица 1 - аннулированы записи для "c".')]


def test_lines_and_plan(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, ord int, note string")
    out = N.collapse_table_notes(df)
    assert sorted(map(tuple, out.collect())) == LINES
    # what the notes say is read before they are staged, not again in every branch
    assert "regexp_extract" not in out._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(scan, "CHUNK_ROWS", 1)
    assert sorted(map(tuple, N.collapse_table_notes(df).collect())) == LINES
