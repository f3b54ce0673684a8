"""Both versions of a table are dealt by table once, with the same differences as joined frames; a rank travels once."""

import random

import pytest
from pyspark.sql import functions as F

from revdiff.operators import dedupe, tables

NAMES = ["Код", "Наименование", "Кол."]


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]


def version(spark, seed):
    rng = random.Random(seed)
    rows = [(t, i + 1, [rng.choice("ab"), rng.choice(["x", "y", ""]), rng.choice("12")], f"T{t}") for t in (1, 2, 3, 3 + seed, None) for i in range(rng.randrange(2, 9))]
    return spark.createDataFrame([r for i, r in enumerate(rows) if (r[0], r[1]) not in {(q[0], q[1]) for q in rows[:i]}], "t int, row_index int, cells array<string>, title string")


def test_versions_in_one_frame_differ_as_joined_ones(spark):
    frames = [version(spark, s) for s in (1, 2)]
    old, new = (tables.fill_down(tables.data_rows(f, "t", NAMES), "t", NAMES, 3) for f in frames)
    want = tables.with_table_sizes(tables.cell_diff(old, new, "t", NAMES, ["title"]), old, new, "t")
    rows = frames[0].withColumn("version", F.lit(1)).unionByName(frames[1].withColumn("version", F.lit(2)))
    both = tables.fill_down(tables.data_rows(rows, "t", NAMES, also=["version"]), "t", NAMES, 3, also=["version"])
    got = tables.cell_diff_by_table(both, "t", NAMES, ["title"])
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert len(exchanges(got)) == 1
    found = [sorted(map(tuple, d.collect()), key=repr) for d in (got, want)]
    assert found[0] == found[1] and {r[got.columns.index("status")] for r in found[0]} >= {"row_added", "row_removed", "modified"}


@pytest.mark.parametrize("read", [True, False])
def test_richest_rows_carry_their_order_once(spark, read):
    df = spark.createDataFrame([(1, "ab", 2), (1, "cd", 1), (1, "e", 0), (2, None, 5), (None, "x", 1), (None, "y", 1)], "k int, name string, ord int").withColumn("ord", F.struct("ord"))
    best = dedupe.keep_richest(df, ["k"], F.coalesce(F.char_length("name"), F.lit(0)))
    best = best if read else best.drop("ord")
    shuffled = exchanges(best)
    told = {r["k"]: (r["name"], r["ord"]["ord"]) if read else r["name"] for r in best.filter("k is not null").collect()}
    assert told == ({1: ("cd", 1), 2: (None, 5)} if read else {1: "cd", 2: None})
    assert len(shuffled) == 1
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert ("min(struct" in plan) == read and plan.count("ord, ord#") + plan.count("o, ord#") == (3 if read else 2)
