"""Merged texts: rows of a key meet at once where no key is large, with the same texts as where equal ones are combined first."""

import random

from pyspark.sql import functions as F

from revdiff.functions import text as T
from revdiff.operators import dedupe, lines, scan


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]


def rows(spark):
    rng = random.Random(5)
    made = [(rng.choice([1, 1, 2, 3, None]), rng.choice([1, 2, 3, None]), i, rng.choice("pq"), rng.choice(["a", "ab", "b", "c d", "", None]),
             rng.choice(["x", "y z", None]), rng.choice([None, "f", "g"])) for i in range(300)]
    return spark.createDataFrame(made, "doc int, run int, ord int, page string, name string, note string, format string")


def test_both_ways_give_the_same_texts(spark, monkeypatch):
    df = rows(spark)
    got, want = (dedupe.merge_texts(df, ["doc", "run"], ["name", "note"], firsts=["format"], whole=w) for w in (True, False))
    assert got.schema == want.schema
    told = [sorted(map(tuple, x.collect()), key=repr) for x in (got, want)]
    assert told[0] == told[1] and len(told[0]) == 16
    assert all(r[-1] is None and r[-2] is None for r in told[0] if None in r[:2])
    monkeypatch.setattr(scan, "CHUNK_ROWS", 10)
    counted = dedupe.merge_texts(df, ["doc", "run"], ["name", "note"], firsts=["format"])
    assert sorted(map(tuple, counted.collect()), key=repr) == told[1]


def test_small_groups_are_shuffled_once(spark):
    df = rows(spark)
    assert len(exchanges(dedupe.merge_texts(df, ["doc", "run"], ["name", "note"]))) == 1
    lying = scan.number_rows(df, ["doc"], ["ord"], None, "n")
    assert len(exchanges(dedupe.merge_texts(lying, ["doc", "run"], ["name", "note"], whole=True))) == 1


def test_items_from_rows_are_shuffled_once(spark):
    df = spark.range(60).select((F.col("id") % 4).alias("doc_id"), F.col("id").cast("int").alias("ord"), F.lit(1).alias("page_num"), F.lit(None).cast("string").alias("section_here"),
                                F.lit(False).alias("is_service"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("position"),
                                *[F.concat(F.lit(c), F.col("id") % 5).alias(c) for c in lines.ITEM_TEXTS])
    items = lines.items_from_rows(df)
    assert len(exchanges(items)) == 1 and items.count() == 22


def test_keys_leave_out_items_without_working_texts_out_twice(spark):
    df = spark.createDataFrame([("s", "1", "d", "n"), (None, "", " ", None), ("", None, None, "Имя")], "section string, position string, designation string, raw string")
    keyed = lines.with_keys(df.withColumn("name", F.regexp_replace("raw", "seldom", "x")))
    assert [r["key"] for r in keyed.collect()] == ["s|1", "имя"]
    assert keyed._jdf.queryExecution().optimizedPlan().toString().count("seldom") == 1


def test_rows_of_tables_say_section_and_format_as_before(spark):
    from revdiff.functions import fields as X
    cells = [["ФОР-\nМАТ", "a"], ["Фор-мат", "b"], ["фор.м-ат x"], ["фор", "мат"], ["Прочие  изделия", ""], ["", "раздел: документация"], ["Детали", "1", "2"], ["", ""]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, cells array<string>").withColumn("cells", F.transform("cells", T.norm_cell))
    told = df.select("i", lines.section_row(F.col("cells")).alias("s"), F.exists("cells", lambda c: F.contains(X.canon_header(c), F.lit("формат"))).alias("a"),
                     F.contains(F.translate(F.lower(F.array_join("cells", "\n")), "-.", ""), F.lit("формат")).alias("b")).orderBy("i").collect()
    assert [r.s for r in told] == [None, None, None, None, "Прочие Изделия", "Документация", None, None]
    assert [r.a for r in told] == [r.b for r in told]
