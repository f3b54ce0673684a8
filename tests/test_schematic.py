"""Connection diagrams against plain Python on small inputs."""

import random

from revdiff.operators import scan
from revdiff.operators import schematic as C

WORDS = "doc_id int, page_num int, i int, x0 double, y0 double, x1 double, y1 double, text string"


def test_nearest_by_x_is_unbounded_and_takes_the_first_of_equals(spark):
    rng = random.Random(2)
    schema = "doc_id int, page_num int, i int, cx double, name string"
    targets = [(1, p, i, float(rng.choice([-5000, -3, 0, 2, 2, 9, 700, 90000])), f"t{i}") for p in (1, 2) for i in range(6)]
    probes = [(1, p, 100 + i, float(rng.randrange(-6000, 95000)), None) for p in (1, 2, 3) for i in range(60)] + [(1, 1, 300, 1.0, None), (1, 2, 301, 2.0, None), (None, 1, 302, 2.0, None)]
    got = {r.i + 1000 * r.page_num: r.nearest.name if r.nearest else None for r in C.nearest_by_x(spark.createDataFrame(probes, schema), spark.createDataFrame(targets, schema)).collect() if r.doc_id}
    for d, p, i, x, _ in probes:
        near = min(((abs(t[3] - x), t[2], t[4]) for t in targets if (t[0], t[1]) == (d, p)), default=None)
        if d:
            assert got[i + 1000 * p] == (near[2] if near else None)


def test_conductors(spark):
    rows = [(1, 1, 0, 100.0, 70.0, 110.0, 80.0, "ХS1"), (1, 1, 1, 300.0, 70.0, 310.0, 80.0, "XP2"), (1, 1, 2, 200.0, 110.0, 220.0, 120.0, "007"), (1, 1, 3, 150.0, 112.0, 155.0, 122.0, "4"),
            (1, 1, 4, 260.0, 112.0, 265.0, 122.0, "Ж"), (1, 1, 5, 320.0, 108.0, 340.0, 118.0, "Корпус"), (1, 1, 6, 230.0, 110.0, 240.0, 120.0, "GND"), (1, 1, 7, 600.0, 110.0, 610.0, 120.0, "OUT"),
            (1, 1, 8, 210.0, 160.0, 215.0, 170.0, "-"), (1, 2, 9, 10.0, 10.0, 20.0, 20.0, "123"), (2, 1, 0, 1.0, 1.0, 2.0, 2.0, None)]
    got = {r.key: r for r in C.conductors(spark.createDataFrame(rows, WORDS), 700.0, 320.0).collect()}
    assert set(got) == {"007", "-"}
    r = got["007"]
    assert (r.signal, r.left_pins, r.right_pins, r.left_housing, r.right_housing, r.housing_connectors) == ("GND", ["4"], ["Ж"], False, True, ["XP2"])
    assert tuple(r.bbox) == (200, 108, 140, 12)
    assert (got["-"].signal, got["-"].left_housing) == (None, False)
    assert C.conductors(spark.createDataFrame([], WORDS), 700.0, 320.0).count() == 0


def test_code_letters(spark):
    schema = "doc_id int, page_num int, part int, ord int, x0 double, y0 double, x1 double, y1 double, text string"
    rows = [(1, 1, 0, 0, 0.0, 0.0, 9.0, 9.0, "Лит."), (1, 1, 0, 1, 5.0, 60.0, 9.0, 69.0, "А"), (1, 1, 0, 2, 5.0, 30.0, 9.0, 39.0, "ЗАМ"), (1, 1, 0, 3, 80.0, 20.0, 9.0, 29.0, "о.1"), (1, 1, 0, 4, 80.0, 40.0, 9.0, 29.0, "О"),
            (2, 1, 0, 0, 0.0, 0.0, 9.0, 9.0, "Лит."), (2, 1, 0, 1, 500.0, 0.0, 9.0, 9.0, "б"), (3, 1, 1, 0, 0.0, 0.0, 9.0, 9.0, "литера: В"), (4, 1, 0, 0, 0.0, 0.0, 9.0, 9.0, None)]
    assert {r.doc_id: (r.letter, r.tier) for r in C.code_letters(spark.createDataFrame(rows, schema)).collect()} == {1: ("О", 1), 2: ("Б", 2), 3: ("В", 3)}


def test_conductors_by_pages_and_by_zones_agree_without_shuffled_pairs(spark, monkeypatch):
    rng = random.Random(5)
    toks = ["ХS1", "XP2", "007", "12", "Ж", "Корпус", "GND", "б/н", "№", "-", "OUT", " ", None]
    rows = [(d, p, i, x, y, x + 20.0, y + 10.0, rng.choice(toks)) for d in (1, 2) for p in (1, 2) for i in range(150)
            for x, y in [(rng.choice([60.0, 60.0, 61.5, 200.0, 300.0, 340.0, 500.0]), float(rng.randrange(0, 320)))]]
    words = spark.createDataFrame(rows, WORDS)
    whole = C.conductors(words, 700.0, 320.0)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(scan, "CHUNK_ROWS", 40)
    monkeypatch.setattr(C, "ZONE", 2)
    by_zones = C.conductors(words, 700.0, 320.0)
    assert "zone" in by_zones._jdf.queryExecution().toString()
    got = [sorted(map(repr, df.collect())) for df in (whole, by_zones)]
    assert got[0] == got[1] and len(got[0]) > 20
