"""Boxes and JSON output against plain Python: strips of any height, long chains, whole documents."""

import json
import random

from revdiff.operators import geometry as G
from revdiff.sources import sinks

BOX = "doc_id int, page_num int, ord int, x0 double, y0 double, x1 double, y1 double"


def shares(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = [max(0.0, (x[2] - x[0]) * (x[3] - x[1])) for x in (a, b)]
    union = area[0] + area[1] - w * h
    return w * h / max(1.0, (a[2] - a[0]) * (a[3] - a[1])), w * h / union if union else 0.0


def test_overlap_by_strips(spark):
    rng = random.Random(9)

    def some(n, pages, tall):
        out = []
        for i in range(n):
            x, y, h = rng.uniform(-50, 900), rng.uniform(-500, 2000), rng.choice(tall)
            out.append((1, rng.choice(pages), i, x, y, x + rng.uniform(0, 400), y + h * rng.random()))
        return out

    boxes, excluded = some(400, [1, 2, 3], [0.5, 3, 40, 900]), some(60, [1, 2], [2, 60, 5000]) + [(1, 1, 0, 5.0, 5.0, 5.0, 5.0)]
    want = {b[1:3] for b in boxes if not any(b[1] == e[1] and (shares(b[3:], e[3:])[0] > 0.2 or shares(b[3:], e[3:])[1] > 0.2) for e in excluded)}
    a, e = spark.createDataFrame(boxes, BOX), spark.createDataFrame(excluded, BOX)
    # ord repeats over pages only
    assert {(r.page_num, r.ord) for r in G.drop_overlapping(a, e).collect()} == want and 50 < len(want) < 390
    assert G.drop_overlapping(a, e.limit(0)).count() == 400


def test_chain_of_near_duplicates_ends(spark):
    """5,000 boxes, each near the one before: every second one stays, in one pass."""
    step = 8.0  # boxes two steps apart are below the limit
    boxes = [(1, 1, i, i * step, 0.0, i * step + 100.0, 100.0) for i in range(5000)]
    got = G.keep_first_of_duplicates(spark.createDataFrame(boxes, BOX))
    assert sorted(r.ord for r in got.collect()) == list(range(0, 5000, 2))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3


def test_json_lines(spark, tmp_path):
    a = spark.createDataFrame([(1, 2, "b"), (1, 1, "a\"ж"), (2, 1, None), (None, 1, "x")], "doc_id long, ord int, text string")
    b = spark.createDataFrame([(3, 1, 1.5)], "doc_id long, ord int, score double")
    want = [{"doc_id": 1, "texts": [{"text": 'a"ж'}, {"text": "b"}], "scores": []}, {"doc_id": 2, "texts": [{}], "scores": []}, {"doc_id": 3, "texts": [], "scores": [{"score": 1.5}]}]
    lines: dict = {}
    for r in sinks.json_lines({"texts": a, "scores": b}).orderBy("n").collect():
        lines.setdefault(r.doc_id, []).append(r.line)
    assert [json.loads("".join(lines[d])) for d in sorted(lines)] == want
    sinks.write_full_json({"texts": a, "scores": b}, str(tmp_path / "out"))
    text = "\n".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    decoder, found, at = json.JSONDecoder(), [], 0
    while at < len(text.rstrip()):
        value, at = decoder.raw_decode(text, at)
        found.append(value)
        at += len(text[at:]) - len(text[at:].lstrip())
    assert sorted(found, key=lambda v: v["doc_id"]) == want
    assert sinks.json_lines({"texts": a.limit(0)}).count() == 0
