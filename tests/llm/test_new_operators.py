"""Whitening, collocations and personal data against plain versions, with nulls, empties, ties, repeated rows and clashing column names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from revdiff.llm import collocation, sanitise, whiten

# --- whitening


def test_scatter_is_exact():
    rng = np.random.default_rng(4)
    for rows in (1, 63, 64, 65, 300):
        x = rng.integers(-700, 900, (rows, 7))
        x[:, 3] = 12
        for scale in (1, 2**33):
            y = x * scale
            sums, cross = whiten.scatter(y)
            want = y.astype(object).T @ y.astype(object)
            assert sums == y.astype(object).sum(axis=0).tolist()
            assert all(cross[j] == list(want[j, j:]) for j in range(7))


def plain_white(vecs):
    x = np.floor(1024 * np.array(vecs, float)).astype(int) + 100000
    n = len(x)
    mean = x.mean(axis=0)
    v = (x - mean).T @ (x - mean) / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:8], axes[:, ::-1][:, :8]
    s = x.sum(axis=0)
    return (x - mean) @ axes / np.sqrt(e), [int(d) for d in ((n * x - s) ** 2).sum(axis=1)], e / np.trace(v)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening(spark, kind):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((200, 12)) @ rng.standard_normal((12, 12))
    if kind == "float":
        base = base.astype(np.float32)
    rows = [(i, [float(c) for c in v], 1.0) for i, v in enumerate(base)]
    bad = [(900, None, 1.0), (901, [None] * 12, 1.0), (902, [float("nan")] * 12, 1.0), (903, [float("inf")] + [0.0] * 11, 1.0), (904, [], 1.0)]
    df = spark.createDataFrame(rows + bad + [(0, rows[0][1], 1.0), (None, rows[1][1], 1.0)], f"vec_id long, embedding array<{kind}>, white double")
    got = whiten.components(df).collect()
    white, deviation, share = plain_white([r[1] for r in rows] + [rows[0][1], rows[1][1]])
    assert Counter(r.vec_id for r in got) == Counter({**{i: 8 for i in range(200)}, None: 8, 0: 16})
    sign = {}
    for r in got:
        if r.vec_id is None:
            continue
        w = white[r.vec_id][r.component - 1]
        sign.setdefault(r.component, 1 if r.whitened * w > 0 else -1)
        assert math.isclose(r.whitened, sign[r.component] * w, rel_tol=1e-7, abs_tol=1e-9)
        assert (r.n, r.deviation) == (202, deviation[r.vec_id])
        assert math.isclose(r.explained, share[r.component - 1], rel_tol=1e-9) and r.identity_error < 1e-9
    wide = whiten.whiten(df)
    assert set(wide.columns) == {"vec_id", "embedding", "white", "deviation", "fitted", "explained", "identity_error"} and wide.count() == 202


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.components(spark.createDataFrame([], schema)).count() == 0
    assert whiten.components(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    # two lengths are whitened apart; a length that varies in one direction has one component
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [5.0]), (4, [7.0]), (5, [3e38]), (6, [-3e38])], schema)
    got = {(r.vec_id, r.component): r for r in whiten.components(df).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)}
    assert abs(got[1, 1].whitened + got[2, 1].whitened) < 1e-12 and abs(got[1, 1].whitened) == pytest.approx(1)
    assert got[1, 1].n == 2 and got[3, 1].n == 4 and got[1, 1].deviation == 1024**2 and got[5, 1].deviation is None


# --- collocations


def plain_mine(rows, longest=3, least=10, share=50, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    cand = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    longer = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i:i + k]] = max(longer[lang, w[i:i + k]], a)
    by_lang = defaultdict(list)
    for (lang, w), a in cand.items():
        if 100 * longer[lang, w] >= share * a:
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        by_lang[lang].append((-score, -a, " ".join(w).encode(), left, right))
    out = set()
    for lang, found in by_lang.items():
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, i, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def corpus(seed, docs):
    rng = random.Random(seed)
    words = ["a", "B", "b", "cc", "d\x01", "\x00", "ümlaut", "Ü", "x\xa0y", "'", "-", "e", "f", "g"]
    weights = [9, 5, 5, 4, 3, 2, 3, 1, 1, 1, 1, 2, 2, 2]
    rows = [(rng.choice(["en", "en", "en", "de", None, "", "und"]), "".join(rng.choices(words, weights)[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\x0b", "\n", "?!"]) for _ in range(rng.randrange(60))))
            for _ in range(docs)]
    return rows + [("en", None), ("en", ""), (None, " . "), ("en", "one two three four " * 3000), *[("de", "tie one. tie two. One tie")] * 12]


@pytest.mark.parametrize("longest, small", [(3, False), (3, True), (2, True), (5, False)])
def test_collocations(spark, monkeypatch, longest, small):
    rows = corpus(longest, 300)
    if small:  # crowded words and pairs, full dictionaries, several groups
        for name, value in {"CROWDED": 1 << 40, "ENTRIES": 100, "PIECE": 20, "WORDS": 5, "BLOCK": 300, "RANGE": 50}.items():
            monkeypatch.setattr(collocation, name, value)
    df = spark.createDataFrame([(t, lang, 0) for lang, t in rows], "text string, lang string, n int").repartition(5)
    got = collocation.mine(df, longest=longest, budget=40 if small else collocation.BUDGET).collect()
    have = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got]
    assert len(have) == len(set(have)) and set(have) == plain_mine(rows, longest)
    assert all(" ".join(r.words) == r.phrase for r in got)


def test_collocations_top_and_empty(spark):
    rows = corpus(9, 200)
    df = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    have = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocation.mine(df, top=5, least=4, share=90).collect()}
    assert have == plain_mine(rows, least=4, share=90, top=5)
    assert collocation.mine(df.limit(0)).count() == 0
    assert collocation.mine(spark.createDataFrame([(None, "en"), ("", None)], "text string, lang string")).count() == 0


def test_large_products_stay_exact(spark, monkeypatch):
    words = spark.createDataFrame([("en", "x", 10**12), ("en", "y", 10**12 + 7)], "lang string, word string, f long")
    found = spark.createDataFrame([("en", ["x", "y"], 10**12 - 3)], "lang string, words array<string>, f long")
    monkeypatch.setattr(collocation, "phrases", lambda *a, **k: (words, found))
    row = collocation.mine(words).first()
    assert row.score == 1000000 * (10**12 - 3) ** 2 // (10**12 * (10**12 + 7))


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile("[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    found = []
    for k, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in pattern.finditer(text or ""):
            digits = [c for c in m.group() if c in "0123456789"]
            if k == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if k == 2:
                twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(n // 10 + n % 10 for n in twice) % 10:
                    continue
            if k == 3 and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans():
    rng = random.Random(11)
    parts = ["a@b.c", "@", ".", "x", "1.2.3.4", "256", "+", "+49 (170) 1234567", "4041894974608795", "5500 0000-0000 0004", " ", "-", "0", "9", "é", "\n", "a_b%", "..", "00000000000000", "\U0001f600", "１"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert sanitise.base_spans(text) == plain_spans(text), text


def test_base_spans_of_long_texts():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "@" * 1_000_000, "a@" * 1_000_000, "+1" + " " * 2_000_000, "+1" * 1_000_000, "1 " * 1_000_000 + "a@b.c", "a.@b-" * 400_000):
        sanitise.base_spans(text)
    assert sanitise.base_spans("7" * 5000 + ".1.1.1 x@y.zz") == [(5007, 0, 5013)]


def plain_terms(texts, near=8, least=3, generalise=0.85, remove=0.95):
    """(row, start, end, action) by counting everything in plain Python."""
    term = re.compile(r"[^\W_]+")
    total, c_t, places, ways, mentions = 0, Counter(), defaultdict(set), defaultdict(set), defaultdict(set)
    where = defaultdict(set)
    for r, text in enumerate(texts):
        all_terms = [(m.group().lower(), m.start(), m.end()) for m in term.finditer(text or "")]
        total += len(all_terms)
        c_t.update(w for w, _, _ in all_terms)
        spans = plain_spans(text)
        free = [x for x in all_terms if all(x[2] <= s or x[1] >= e for s, _, e in spans)]
        for s, k, e in spans:
            name = (k, text[s:e].lower() if k < 2 else re.sub("[^0-9]", "", text[s:e]))
            left = [x for x in free if x[2] <= s][-near:]
            right = [x for x in free if x[1] >= e][:near]
            context = (len(left), tuple(w for w, _, _ in left + right))
            for w, a, b in left + right:
                mentions[name].add((r, context))
                places[name, w].add((r, a))
                where[name, w].add((r, a, b))
                ways[name, w].add(context)
    out = {}
    for (name, w), at in places.items():
        ic = math.log2(total / len(mentions[name]))
        # a place seen in two contexts counts once, in the lesser of them; texts of the test don't do that
        if len(ways[name, w]) < least or ic <= 0:
            continue
        d = 1 + math.log2(len(at) / c_t[w]) / ic
        if d > generalise:
            for x in where[name, w]:
                out[x] = max(out.get(x, "generalise"), "remove" if d > remove else "generalise")
    return {(*x, a) for x, a in out.items()}


def sanitise_texts():
    rng = random.Random(5)
    common = [f"w{i}" for i in range(60)]

    def some(k):
        return " ".join(rng.choices(common, k=k))

    texts = [f"{some(12)} Zebulon called bo.sb@mail.example.com about {some(12)}" for _ in range(6)]
    texts += [f"{some(10)} the Partly 10.20.30.40 host, {some(9)}" for _ in range(5)] + [f"partly {some(9)}" for _ in range(3)]
    texts += [f"{some(9)} uniqueword 4041894974608795 {some(9)}"] * 30  # copies: one surrounding
    return texts + [some(300) for _ in range(20)] + [None, "", "bo.sb@mail.example.com", "Zebulon alone", "İstanbul " + some(5), texts[0]]


def test_personal_data(spark):
    texts = sanitise_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[1], "x")], "doc_id long, text string, spans string").repartition(3)
    rows = {r.doc_id: r for r in sanitise.report(df).collect()}
    assert len(rows) == len(texts) + 1
    terms = plain_terms([*texts, texts[1]])
    assert {a for _, _, _, a in terms} == {"generalise", "remove"}
    for i, t in enumerate(texts):
        base = ",".join(f"{sanitise.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(t))
        added = [(s, 4, e) for r, s, e, _ in terms if r == i]
        every = ",".join(f"{sanitise.KINDS[k]}:{s}:{e}" for s, k, e in sorted(plain_spans(t) + added))
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert rows[i].spans == every, (i, t)
        assert [rows[i][f"n_{k}"] for k in sanitise.KINDS[:4]] == [sum(x[1] == k for x in plain_spans(t)) for k in range(4)]
    assert sanitise.report(df.limit(0)).count() == 0


def test_clean(spark):
    texts = sanitise_texts()
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, other int")
    found = sanitise.find(df)
    assert found.columns == ["doc_id", "other", "spans"]
    cleaned = {r.doc_id: r for r in sanitise.clean(df, found, key="doc_id").collect()}
    assert len(cleaned) == len(texts) and cleaned[0].other == 0
    assert "Zebulon" not in cleaned[0].text and "[EMAIL]" in cleaned[0].text
    assert any(f"[{k.upper()}]" in (r.text or "") for k in ("term",) for r in cleaned.values())
    for i, t in enumerate(texts):
        if not plain_spans(t):
            assert cleaned[i].text == t
