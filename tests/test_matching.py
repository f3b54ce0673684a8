"""Order-dependent matching and sequence reconstruction against plain Python on small inputs."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from revdiff.functions import text as T
from revdiff.operators import geometry as G
from revdiff.operators import requirements as R
from revdiff.operators import scan
from revdiff.staging import stage

REQ = "doc_id long, number int, text string"


def greedy(pairs):
    used_l, used_r, out = set(), set(), []
    for rank, left, right in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if left not in used_l and right not in used_r:
            used_l.add(left)
            used_r.add(right)
            out.append((left, right))
    return sorted(out)


def test_greedy_assignment(spark):
    rng = random.Random(1)
    pairs = [(d, rng.choice([0.5, 0.6, 0.7, 0.8]), lft, r) for d in range(5) for lft in range(9) for r in range(9) if rng.random() < 0.5]
    df = spark.createDataFrame(pairs, "doc_id int, rank double, l_ord int, r_ord int")
    want = sorted((d, *p) for d in range(5) for p in greedy([x[1:] for x in pairs if x[0] == d]))
    for rows in (10_000, 7):  # documents over several batches change nothing
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        got = sorted((r["doc_id"], r["l_ord"], r["r_ord"]) for r in R.assign_greedy(df).collect())
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


def test_numbers_above_99_and_repeated_numbers(spark):
    def diff(old, new):
        d = R.requirement_diff(spark.createDataFrame(old, REQ), spark.createDataFrame(new, REQ))
        return {(r["status"], r["v1_number"], r["v2_number"], r["v1_text"]) for r in d.collect()}

    text = "The wire is laid without twisting at all"
    assert diff([(1, 99, text)], [(1, 100, text)]) == set()
    assert diff([(1, 99, text)], [(1, 100, text + " times")]) == {("modified", 99, 100, text)}
    assert diff([(1, 5, text), (1, 5, "zzz qqq gone")], [(1, 5, text)]) == {("removed", 5, None, "zzz qqq gone")}


def test_pairs_and_choice_over_several_blocks(spark, monkeypatch):
    """Blocks of old items change nothing."""
    old = [(1, n, f"common wording of the line {n % 7} part {n}") for n in range(300)]
    new = [(1, n + 150, f"common wording of the line {n % 5} part {n} more") for n in range(40)]
    frames = [R.in_order(spark.createDataFrame(x, REQ)) for x in (old, new)]

    def chosen():
        return sorted((r.l_ord, r.r_ord) for r in R.assign_greedy(R.fuzzy_pairs(*frames, use_ratio=False)).collect())

    one = chosen()
    monkeypatch.setattr(R, "BLOCK", 16)
    assert len(one) == 40 and chosen() == one


def test_requirement_diff(spark):
    old = [(1, 1, "The wire is laid without twisting at all"), (1, 2, "Marking by table five"), (1, 3, "Gone entirely zzz"), (2, 1, "same text here")]
    new = [(1, 2, "The wire is laid without twisting at all times"), (1, 3, "Marking by table five"), (1, 9, "Brand new qqq www"), (2, 4, "same text here")]
    d = R.requirement_diff(spark.createDataFrame(old, REQ), spark.createDataFrame(new, REQ))
    got = {(r["doc_id"], r["status"], r["v1_number"], r["v2_number"]) for r in d.collect()}
    # renumbering alone is no change
    assert got == {(1, "modified", 1, 2), (1, "removed", 3, None), (1, "added", None, 9)}
    same = spark.createDataFrame(old, REQ)
    assert R.requirement_diff(same, same).count() == 0


def test_fuzzy_pairs_keep_every_plausible_pair(spark):
    """The bound before the ratio must lose no pair that plain scoring finds plausible."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "of", "to", "abcd", "epsilon"]

    def text():
        return " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))

    old = [(1, n, text()) for n in range(1, 16)]
    new = [(1, n, text()) for n in range(1, 16)]
    got = {(r["l_number"], r["r_number"]): round(r["score"], 9) for r in R.fuzzy_pairs(
        R.in_order(spark.createDataFrame(old, REQ)), R.in_order(spark.createDataFrame(new, REQ))).collect()}
    want = {}
    for _, a, x in old:
        for _, b, y in new:
            tx, ty = ({w for w in t.split() if len(w) >= 4} for t in (x, y))
            ratio, shared = SequenceMatcher(None, x, y).ratio(), len(tx & ty)
            score = max(ratio, shared / len(tx | ty), 0.85 * shared / min(len(tx), len(ty))) if tx and ty else ratio
            if score >= 0.62 or (abs(a - b) <= 1 and score >= 0.42 and shared >= 2) or (score >= 0.5 and shared >= 3):
                want[a, b] = score
    assert set(got) == set(want)
    assert all(got[k] >= 0.42 for k in got)


def test_sequence_ratio(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", ""), ("a" * 300, "a" * 299 + "b")], "a string, b string")
    got = [r[0] for r in df.select(T.sequence_ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, r["a"], r["b"]).ratio() for r in df.collect()]


def test_exact_leftovers_match_copies_one_to_one(spark):
    old = spark.createDataFrame([(1, n, "x") for n in range(5)] + [(1, 9, "y")], REQ)
    new = spark.createDataFrame([(1, n, " X ") for n in range(3)], REQ)
    a, b = R.exact_leftovers(old, new)
    assert (a.count(), b.count()) == (3, 0)


def test_word_lines_exact(spark):
    rng = random.Random(3)
    words = [(1, p, i, float(rng.randrange(0, 300)), round(rng.choice([0, 20, 40]) + rng.random() * 9, 3)) for p in (1, 2) for i in range(60)]
    df = spark.createDataFrame(words, "doc_id int, page_num int, i int, x0 double, y0 double")
    got = {}
    for r in G.number_lines_exact(df).collect():
        got.setdefault((r["page_num"], r["band"], r["sub_line"]), set()).add(r["i"])
    want = set()
    for page in (1, 2):
        line, mean = [], None
        for _, _, i, x, y in sorted((w for w in words if w[1] == page), key=lambda w: (w[4], w[3], w[2])):
            if mean is None or abs(y - mean) <= 3.0:
                line.append(i)
                mean = y if mean is None else (mean + y) / 2
            else:
                want.add((page, frozenset(line)))
                line, mean = [i], y
        want.add((page, frozenset(line)))
    assert {(k[0], frozenset(v)) for k, v in got.items()} == want


def iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h or 1)


def test_near_duplicate_boxes(spark):
    rng = random.Random(5)
    boxes = []
    for o in range(150):
        x, y, w, h = rng.choice([0, 3, 50, 51]) + rng.random() * 4, rng.choice([0, 1, 30]) + rng.random(), rng.choice([20, 21, 64, 63]), rng.choice([10, 10.5, 31.9, 32.1])
        boxes.append((1, rng.randrange(1, 3), o, float(x), float(y), float(x + w), float(y + h)))
    boxes += [(*b[:2], b[2] + 1000, *b[3:]) for b in boxes[:40]] + [(1, 1, 5000 + i, 7.0, 7.0, 7.0, 9.0) for i in range(2)]
    df = spark.createDataFrame(boxes, "doc_id int, page_num int, ord int, x0 double, y0 double, x1 double, y1 double")
    any_earlier, kept = set(), []
    for b in boxes:
        if any(e[1] == b[1] and e[2] < b[2] and iou(e[3:], b[3:]) > 0.85 for e in boxes):
            any_earlier.add(b[2])
        if not any(e[1] == b[1] and iou(e[3:], b[3:]) > 0.85 for e in kept):
            kept.append(b)
    assert {r["ord"] for r in G.drop_near_duplicates(df).collect()} == {b[2] for b in boxes} - any_earlier
    assert {r["ord"] for r in G.keep_first_of_duplicates(df).collect()} == {b[2] for b in kept}


def test_stitching(spark):
    lines = ["lead", "1 First item goes", "on here", "2) Second item text", "Дата", "3 tiny", "2 Second again wins"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, ord int, line string")
    assert {r["number"]: r["text"] for r in R.stitch(df).collect()} == {1: "First item goes on here", 2: "Second again wins"}
    split = ["Alpha text before", "1", "more of alpha", "Beta text before", "2", "tail of beta-", "gamma"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(split)], "doc_id int, ord int, line string")
    assert {r["number"]: r["text"] for r in R.stitch_split(df).collect()} == {
        1: "Alpha text before\nmore of alpha", 2: "Beta text before\ntail of betagamma"}


def test_table_pairing(spark):
    from revdiff.operators.pairing import pair_tables, table_signature

    rng = random.Random(11)
    heads = [["Код", "Длина, мм"], ["Код", "Дл"], ["Поз.", "Наименование", "Кол."], ["x"]]

    def tables(n, base):
        return [(d, base + d * 100 + i, rng.randrange(1, 4), rng.choice(["Таблица 1", "Таблица 2", "Прочее"]), rng.choice(heads), i) for d in range(4) for i in range(n)]

    schema = "doc_id int, table_id int, page_num int, name string, names array<string>, ord int"
    old, new = spark.createDataFrame(tables(9, 0), schema), spark.createDataFrame(tables(8, 1000), schema)
    got = {(r["doc_id"], r["old_id"], r["new_id"]) for r in pair_tables(old, new).collect()}
    sig = table_signature(F.col("page_num"), F.col("name"), F.col("names"))
    left, right = ([(r["doc_id"], r["table_id"], r["page_num"], r["s"]) for r in df.withColumn("s", sig).orderBy("doc_id", "ord").collect()] for df in (old, new))
    want, used = set(), set()
    for doc, lid, page, s in left:
        best, best_score = None, 0.0
        for d2, rid, p2, s2 in right:
            if d2 == doc and rid not in used:
                score = SequenceMatcher(None, s, s2).ratio() + (0.15 if page == p2 else 0.0)
                if score > best_score:
                    best, best_score = rid, score
        if best is not None and best_score >= 0.45:
            used.add(best)
            want.add((doc, lid, best))
        else:
            want.add((doc, lid, None))
    want |= {(d, None, rid) for d, rid, _, _ in right if rid not in used}
    assert got == want


def test_alike_tables_of_one_document_need_no_rounds(spark):
    """2,000 tables that all like each other, on shifted pages with ties between classes, take turns in one pass."""
    from revdiff.operators import pairing

    schema = "doc_id int, table_id int, page_num int, name string, names array<string>, ord int"
    old = [(1, i, 1 + i % 9, "Таблица 1", ["Код", "Кол."], i) for i in range(2000)]
    new = [(1, 5000 + i, 3 + i % 9, "Таблица 1", ["Код", "Кол."], (i * 7) % 2000) for i in range(1990)]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("pairing", "pairing")
    got = {(r.old_id, r.new_id) for r in pairing.pair_tables(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), pairing.token_share).collect()}
    count = len(jobs.getJobIdsForGroup("pairing"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def share(p, q):
        a, b = {f"p{p}", "t1", "hкод", "кол"}, {f"p{q}", "t1", "hкод", "кол"}
        return len(a & b) / len(a | b) + (0.15 if p == q else 0.0)

    want, free = set(), sorted((t[5], t[1], t[2]) for t in new)
    for _, table, page, *_ in old:
        best = max(free, key=lambda f: (share(page, f[2]), -f[0]), default=None)
        want.add((table, best[1] if best else None))
        if best:
            free.remove(best)
    assert got == want and count < 40


def test_table_pairing_with_nulls_and_nothing(spark):
    from revdiff.operators.pairing import pair_tables, token_share

    schema = "doc_id int, table_id int, page_num int, name string, names array<string>, ord int"
    rows = [(None, 1, 1, "Таблица 1", ["Код"], 0), (1, 2, 1, None, None, 0), (2, 3, None, "x", [], 1)]
    df, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    assert {(r.doc_id, r.old_id, r.new_id) for r in pair_tables(df, none, token_share).collect()} == {(d, t, None) for d, t, *_ in rows}
    assert {(r.doc_id, r.old_id, r.new_id) for r in pair_tables(none, df, token_share).collect()} == {(d, None, t) for d, t, *_ in rows}
    assert pair_tables(none, none).count() == 0


def test_expected_lines_stand_within_a_note(spark):
    import re

    def plain(t):
        return re.sub(r"[\s\xa0]+", " ", re.sub('[;."«»]', "", t.lower().replace("ё", "е"))).strip()

    rng = random.Random(8)
    words = ["пункт", "о", "Ёлке", "маркировке", "7", "x", "введен", "«жгута»", "конец;"]

    def text(k):
        return " ".join(rng.choices(words, k=k))

    notes = [(d, text(rng.randrange(0, 25))) for d in range(4) for _ in range(12)] + [(9, None)]
    lines = [(d, n, text(rng.randrange(0, 4))) for d in range(5) for n in range(40)]
    for d, t in notes[:30]:
        if t and len(t) > 12:  # pieces of notes, cut within words at both ends
            a = rng.randrange(len(t) - 10)
            lines.append((d, 100, t[a:a + rng.randrange(5, len(t))]))
    got = {(r.doc_id, r.n, r.line) for r in R.missing_lines(spark.createDataFrame(lines, "doc_id int, n int, line string"), spark.createDataFrame(notes, "doc_id int, note string")).collect()}
    want = {(d, n, t) for d, n, t in lines if plain(t) and not any(e == d and u and plain(t) in plain(u) for e, u in notes)}
    assert got == want and 0 < len(want) < len(lines)


def test_leftovers_by_documents_and_by_chunks_agree_with_one_shuffle(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["x", " X ", "y", "z - 1", "z-1", "", None]
    old, new = (spark.createDataFrame([(d, rng.randrange(40), rng.choice(texts)) for d in range(4) for _ in range(30)], REQ).distinct().localCheckpoint() for _ in range(2))
    plans = []
    monkeypatch.setattr(R, "stage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df))

    def left():
        return [sorted(map(repr, side.select("doc_id", "number", "text").collect())) for side in R.exact_leftovers(old, new)]

    whole = left()
    assert sum(p.count("Exchange hashpartitioning") for p in plans) == 1
    monkeypatch.setattr(scan, "CHUNK_ROWS", 8)
    assert left() == whole and all(whole)
    placed = [sorted(tuple(r) for r in side.select("doc_id", "ord", "number").collect()) for side in R.exact_leftovers(old, new, place=True)]
    monkeypatch.setattr(scan, "CHUNK_ROWS", 1000)
    assert [sorted(tuple(r) for r in side.select("doc_id", "ord", "number").collect()) for side in R.exact_leftovers(old, new, place=True)] == placed
