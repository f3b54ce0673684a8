"""Comparison, header facts, masking and wording on small hand-worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from revdiff.functions import boxes as B
from revdiff.functions import fields as X
from revdiff.functions import text as T
from revdiff.operators import dedupe, diff, notes, sheets, table_facts
from revdiff.operators.scan import by_position
from revdiff.sources import sinks, versions

ITEMS = "doc_id int, key string, name string, quantity string"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


OLD = [(1, "a", "Bolt", "2"), (1, "b", "Nut", "1"), (1, "c", "Вал – 1", None)]
NEW = [(1, "a", "Bolt", "3"), (1, "c", "Bал-1", ""), (1, "d", "Pin", "5")]


def test_keyed_diff_statuses(spark):
    d = diff.keyed_diff(items(spark, OLD), items(spark, NEW), ["doc_id", "key"], ["name", "quantity"], attrs=["name"])
    got = {r["key"]: (r["status"], r["t"]) for r in d.withColumn("t", diff.changes_text()).collect()}
    # null equals empty, look-alike letters and dashes do not count
    assert got == {"a": ("modified", "quantity:2>3"), "b": ("removed", ""), "d": ("added", "")}


def test_keyed_diff_invariants(spark):
    a, b = items(spark, OLD), items(spark, NEW)
    args = (["doc_id", "key"], ["name", "quantity"])
    assert diff.keyed_diff(a, a, *args).count() == 0
    there = {(r["key"], r["status"]) for r in diff.keyed_diff(a, b, *args).collect()}
    back = {(r["key"], r["status"]) for r in diff.keyed_diff(b, a, *args).collect()}
    swap = {"added": "removed", "removed": "added", "modified": "modified"}
    assert {(k, swap[s]) for k, s in there} == back


def test_drawing_notice_facts(spark):
    schema = "doc_id int, mass_kg double, scale string, title string"
    old = spark.createDataFrame([(1, 0.04, "1:2", "Кабель")], schema)
    new = spark.createDataFrame([(1, 0.05, "1:1", "Кабель модернизированный")], schema)
    facts = {r["fact_type"]: (r["old_value"], r["new_value"]) for r in diff.metadata_facts(old, new).collect()}
    assert facts["mass_changed"] == ("0,04", "0,05")
    assert facts["scale_changed"] == ("1:2", "1:1") and "title_changed" in facts


def test_table_cell_note(spark):
    row = [(1, "Таблица 1 - Таблица присоединений", ["Провод", "Длина, мм"], "Длина, мм", 2, "004", "004", "modified", "100", "120", 10, 1)]
    d = spark.createDataFrame(row, "doc_id int, table_name string, names array<string>, col_name string, col_index int, row_key string, key_cell string, "
                                   "status string, v1_val string, v2_val string, table_data_rows int, ord int")
    groups = table_facts.column_groups(table_facts.with_subjects(d), ["ord"], by_position("ord"))
    assert table_facts.column_facts(groups).first()["note"] == 'В таблице 1 в графе "Длина, мм" изменилась длина для "004".'


@pytest.mark.parametrize("counts, replaced, introduced, changed, want", [
    ((1, 1), [], [], [1], "Заменить"),
    ((3, 3), [1], [], [], "Лист 1 заменить"),
    ((3, 5), [1, 2], [], [], "Листы 1-2 заменить, листы 4-5 вводятся вновь"),
    ((4, 3), [], [], [], "лист 4 аннулировать"),
    ((3, 3), [], [], [1, 2, 3], "Заменить"),
    ((4, 4), [], [], [1, 2, 4], "Листы 1-2, 4 заменить"),
    ((None, None), [], [], [], "Заменить"),
])
def test_action_text(spark, counts, replaced, introduced, changed, want):
    docs = spark.createDataFrame([(1, *counts, replaced, introduced, changed)],
                                 "doc_id int, old_count int, new_count int, replaced array<int>, introduced array<int>, changed array<int>")
    assert sheets.action_text(docs).first()["action"] == want


def test_mask_keeps_only_the_tail(spark):
    assert one(spark, X.mask(F.lit("super-secret-value"), 5)) == "*" * 13 + "value"
    assert one(spark, X.mask(F.lit(None).cast("string"))) == "" and one(spark, X.mask(F.lit(""))) == ""
    assert one(spark, X.mask(F.lit("abc"))) == "***" and one(spark, X.mask(F.lit("abcde"))) == "****bcde"
    config = F.create_map(F.lit("CLIENT_SECRET"), F.lit("abcdef123456"), F.lit("MODEL"), F.lit("m-1"), F.lit("nested.token"), F.lit("token-value"))
    masked = one(spark, X.mask_map(config))
    assert masked["CLIENT_SECRET"].endswith("3456") and "abcdef" not in masked["CLIENT_SECRET"]
    assert masked["MODEL"] == "m-1" and masked["nested.token"].endswith("alue")
    assert one(spark, X.is_sensitive(F.lit("api-key"))) and not one(spark, X.is_sensitive(F.lit("MODEL")))


@pytest.mark.parametrize("value, want", [(0.05, "0,05"), (12.5, "12,5"), (100.0, "100"), (0.0, "0"), (1234567.0, "1,23457e+06"), (0.00001, "1e-05"), (-2.5, "-2,5")])
def test_number_text(spark, value, want):
    assert one(spark, T.number_text(F.lit(value))) == want


def test_text_rules(spark):
    assert one(spark, T.compare_key(F.lit(" Вал — 1 "))) == "baл-1"
    assert one(spark, T.sentence(F.lit(" a  b "))) == "a b." and one(spark, T.sentence(F.lit("a!"))) == "a!"
    assert one(spark, T.space_units(F.lit("2м3кг"))) == "2 м3 кг" and one(spark, T.space_last_unit(F.lit("2м3кг"))) == "2м3 кг"
    assert one(spark, T.split_positions(F.lit("R1 , R2,R1;"))) == ["R1", "R2"]
    assert one(spark, X.document_number(F.lit("Изм. АБВГ.122.21.92.05.000 Э4 x"))) == "АБВГ.122.21.92.05.000 Э4"
    assert one(spark, X.document_number(F.lit("лист 051.01.40.01.000 сб"))) == "051.01.40.01.000 СБ"
    assert one(spark, X.mass_of(F.lit("Масса 0,04 1:2"))) == 0.04 and one(spark, X.mass_of(F.lit("см. табл 0,04 1:2"))) is None
    assert one(spark, X.sheet_status(F.lit(" Зам. "))) == "replace" and one(spark, X.status_change_number(F.lit("3Нов."))) == "3"
    assert one(spark, X.connector_of(F.lit("Маркировка / ХР1"))) == "XP1"
    assert one(spark, sinks.notice_file_name(F.lit("ИИ/1"), F.lit("a:b  СБ"))) == "ИИ_ИИ_1_a_b СБ.pdf"


def test_repair_reads_wrong_encodings(spark):
    broken = "дата формат".encode("utf-8").decode("latin1")
    df = spark.createDataFrame([(broken,), ("Масса",), ("ассаМ"[::-1],)], "t string")
    assert [r[0] for r in df.select(T.repair_encoding("t")).collect()][:2] == ["дата формат", "Масса"]


def test_boxes(spark):
    a = B.Box(*(F.lit(float(v)) for v in (0, 0, 10, 10)))
    b = B.Box(*(F.lit(float(v)) for v in (5, 0, 15, 10)))
    none = B.Box(*(F.lit(0.0) for _ in range(4)))
    assert one(spark, B.iou(a, b)) == pytest.approx(1 / 3) and one(spark, B.overlap_share(a, b)) == 0.5 and one(spark, B.iou(none, none)) == 0.0


def test_dedupe_policies(spark):
    df = spark.createDataFrame([(1, 1, "x", "a"), (1, 2, "xyz", "b"), (1, 3, "x", "ab"), (1, 4, "abc", "b")], "k int, ord int, name string, note string")
    assert dedupe.keep_richest(df, ["k"], F.char_length("name")).first()["ord"] == 2
    merged = dedupe.merge_texts(df, ["k"], ["name", "note"]).first()
    assert (merged["name"], merged["note"]) == ("x xyz abc", "a b ab")


def test_version_pairs_take_the_last_two(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 3, 3)] + [(2, 7)], "doc_id int, version int")
    got = sorted((r["doc_id"], r["version"], r["side"]) for r in versions.version_pairs(df).collect())
    assert got == [(1, 2, "old"), (1, 3, "new"), (1, 3, "new"), (2, 7, "new")]


def test_natural_order(spark):
    df = spark.createDataFrame([("a10",), ("a9",), ("A2 б",), ("a2",)], "n string")
    assert [r["n"] for r in df.orderBy(notes.natural_key(F.col("n"))).collect()] == ["a2", "A2 б", "a9", "a10"]


def test_notice_lines(spark):
    blocks = spark.createDataFrame([("n", 1, "Сборочный чертеж", "5 СБ", "Заменить", None), ("n", 2, "Спецификация", "10", "Заменить", "J")],
                                   "notice_id string, block_id int, doc_type string, decimal_number string, action string, journal_entry string")
    told = spark.createDataFrame([("n", 1, 1, 0, "first"), ("n", 1, 1, 1, "- a;"), ("n", 1, 2, 0, "- loose"), ("n", 1, 3, 0, "second")],
                                 "notice_id string, block_id int, note_ord int, line_no int, line string")
    got = [r["line"] for r in notes.assemble(blocks, told).orderBy("line_no").collect()]
    assert got == ["10", "Заменить", "J", "5 СБ", "Заменить", "Примечания:", "1 first", "- a;", "- loose", "2 second", "Журнал № XX, запись № XX."]


def test_counted_cancellation(spark):
    rows = [(i, s, subject) for i, (s, subject) in enumerate([("row_added", "x"), ("row_added", "X"), ("row_removed", "x"), ("row_removed", "y"), ("modified", "x")])]
    d = spark.createDataFrame(rows, "ord int, status string, subject string").withColumns({"doc_id": F.lit(1), "table_key": F.lit("t")})
    left = table_facts.cancel_both_sides(d, ["ord"], by_position("ord", 2)).collect()
    assert sorted(r["ord"] for r in left) == [1, 3, 4]


def test_encoding_repair_takes_the_best_of_all_readings(spark):
    """Against every path through code pages and directions, written as a product."""
    import itertools
    import random
    import re

    from revdiff import rules

    def plain(text):
        base = text.translate(str.maketrans({"￳": "-", "–": "-", "—": "-", "«": '"', "»": '"', "\xa0": " ", "​": None}))
        best = (tuple([-1] * 3), base)
        for before, page, after, last in itertools.product((1, -1), (None, "latin1", "cp1252"), ("utf-8", "cp1251"), (1, -1)):
            reading = base[::before]
            if page:
                reading = reading.encode(page, "ignore").decode(after, "ignore")
            reading = reading[::last]
            points = (sum(h in reading.lower() for h in rules.ENCODING_HINTS), len(re.findall("[А-Яа-яЁё]", reading)), len(re.findall("[A-Za-zА-Яа-яЁё0-9]", reading)))
            best = max(best, (points, reading), key=lambda b: b[0])
        return best[0]

    rng = random.Random(4)
    good = ["Формат листа", "масса и дата", "лист 3", "Привет", "кабель\n жгут", "abc", "Größe", "1,5 кг"]
    texts = []
    for _ in range(150):
        t = rng.choice(good) + rng.choice(["", " – ", "«x»", "​", "\t\t"]) + rng.choice(good)
        wrong = rng.choice([None, ("utf-8", "latin1"), ("cp1251", "latin1"), ("utf-8", "cp1252"), ("cp1251", "cp1252")])
        t = t.encode(wrong[0], "ignore").decode(wrong[1], "ignore") if wrong else t
        texts.append(t[::rng.choice([1, 1, -1])])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None, "plain ascii  text \n x"])], "i int, t string").select("i", "t", T.repair_encoding("t").alias("r")).collect()

    def points(reading):
        return (sum(h in reading.lower() for h in rules.ENCODING_HINTS), len(re.findall("[А-Яа-яЁё]", reading)), len(re.findall("[A-Za-zА-Яа-яЁё0-9]", reading)))

    for r in rows:
        if r.t is None:
            assert r.r is None
        elif r.t.isascii():
            assert r.r == re.sub(" ?\n ?", "\n", re.sub("[ \t]+", " ", r.t)).strip()
        else:
            assert points(r.r) == plain(r.t), (r.t, r.r)
    assert [r.r for r in rows][-1] == "plain ascii text\nx"


def test_cancellation_by_documents_and_by_chunks_agree(spark):
    rng = random.Random(4)
    rows = [(d, i, f"table:{rng.randrange(2)}", rng.choice(["1", "12", "007", "A", "a", "", None]), rng.choice(["row_added", "row_removed", "modified"]), rng.random() < 0.2, rng.random() < 0.4)
            for d in range(3) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id int, ord int, table_key string, subject string, status string, a boolean, c boolean").localCheckpoint()
    for make in (lambda chunk: table_facts.cancel_both_sides(df, ["ord"], chunk),
                 lambda chunk: table_facts.drop_counted(df, ["doc_id", "table_key"], ["ord"], chunk, F.col("a"), F.col("c"))):
        whole, by_chunks = (sorted(map(repr, make(chunk).collect())) for chunk in (None, F.floor(F.col("ord") / 16)))
        assert whole == by_chunks and 0 < len(whole) < len(rows)
        assert "Join" not in make(None)._jdf.queryExecution().executedPlan().toString()
