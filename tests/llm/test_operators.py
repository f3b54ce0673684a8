"""Operators of the corpus package against plain versions, with nulls, empties, ties, repeated rows and clashing column names."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from revdiff.llm import caps, decontaminate, langid, mixing, quality, simhash, tokens, urlfilter, warc
from revdiff.llm.components import components
from revdiff.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog and runs away from the old house near the river again"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft vom alten haus am fluss wieder weg"


def labels_of(n, edges):
    low = list(range(n))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    want = labels_of(260, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges + [(5, 5)], "u long, v long")).collect()}
    assert got == {v: want[v] for e in edges if e[0] != e[1] for v in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + texts[:5] + [None, "", " \n", "a", "A b", "\x1c", "x " * 5000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, "q r s t", 0), (0, texts[0], 0)], "doc_id long, text string, fp int")

    def print_of(t):
        w = (t or "").encode().lower().split()
        runs = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        bits = Counter(b for r in runs for b in range(64) if xxhash.xxh64_intdigest(r, 42) >> b & 1)
        return sum(1 << b for b in range(64) if 2 * bits[b] > len(runs))

    prints = [print_of(t) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = labels_of(len(texts), edges)
    rows = [r for r in simhash.dedupe(df).collect() if r.doc_id is not None]
    assert len(rows) == len(texts) + 1
    assert all((r.fingerprint, r.component_id) == ("%016x" % prints[r.doc_id], want[r.doc_id]) for r in rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want))
    assert simhash.dedupe(df.limit(0)).count() == 0


def test_index_search_loses_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    near = base[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    every = np.unique(np.concatenate([base, near]))
    rank = every.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    every = every[rank.argsort()]
    place = {int(v): i for i, v in enumerate(every)}
    edges = [(i, j) for i in range(len(every)) for j in (np.bitwise_count(every[:i] ^ every[i]) <= 3).nonzero()[0].tolist()]
    cut = 500
    found = [simhash.search(every[:cut], None), simhash.search(every[cut:], None), simhash.search(every[:cut], every[cut:])]
    links = [(place[int(a)], place[int(b)]) for u, v in found for a, b in zip(u, v, strict=True)]
    assert labels_of(len(every), links) == labels_of(len(every), edges)


def test_mixing(spark):
    sizes = {"a": 100, "b": 10, None: 50}
    goal = mixing.targets(sizes)
    assert sum(goal.values()) == pytest.approx(240) and goal["b"] == 20 and all(goal[s] <= 2 * z + 1e-9 for s, z in sizes.items())
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), "en", rng.choice(["s1", "s2", "s3", "", None]), 0) for i in range(600)] + [(None, None, None, "s1", 0), (3, "x", None, None, 1)] * 2
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.copies(df.withColumn("r", F.monotonically_increasing_id()), row="r").collect()
    assert len(got) == len(rows)
    again = mixing.copies(df.repartition(7).withColumn("r", F.monotonically_increasing_id()), row="r").collect()
    shape = lambda x: Counter((r.doc_id, r.size, r.target, r.copies) for r in x)
    assert shape(got) == shape(again)
    for t, z in {(r.target, r.source_size) for r in got}:
        part = [r for r in got if (r.target, r.source_size) == (t, z)]
        assert abs(sum(r.size * r.copies for r in part) - t) <= 0.05 * t + 120
    assert all(0 <= r.copies <= 2 for r in got)
    mixed = mixing.mix(df.withColumn("copies", F.lit(1)))
    assert mixed.columns == [*df.columns, "copies"] and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://a.example.org/en/7", "http://a.example.org/en/1x?q", "HTTP://EXAMPLE.org/es/", "https://x.com/fr/1", "https://x.com/de/1", "http://org", "http://fooorg/", None, "", "no scheme",
            "http://h.net/p?u=://z", "http://A.Org#f/x", "ftp://b.com/en/\n1"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://q.org/", "x"), (1, urls[1], "x")], "page_id long, url string, score string")
    rows = urlfilter.judge(df).collect()
    by = {r.page_id: (r.host, r.path, r.rule) for r in rows}
    assert len(rows) == len(urls) + 2 and {r.verdict for r in rows} <= {"allow", "block"}
    assert [by[i] for i in range(13)] == [
        ("a.example.org", "/en/7", "org/"), ("a.example.org", "/en/1x", "example.org/en/1"), ("example.org", "/es/", "example.org/es/"), ("x.com", "/fr/1", "com/fr/"), ("x.com", "/de/1", "com/de/"),
        ("org", "", None), ("fooorg", "/", None), ("", "", None), ("", "", None), ("", "", None), ("h.net", "/p", None), ("a.org", "", None), ("b.com", "/en/\n1", None)]
    many = [(i, f"http://s{i % 9}.org/good/{i}" if i % 2 else f"http://s{i % 9}.com/de/bad/{i}", "") for i in range(400)] + [(-1, "http://n.net/good/5", ""), (-2, "http://n.net/de/bad/5", "")]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(many, "page_id long, url string, html string")).collect()}
    assert got[-1] == "allow" and got[-2] == "block"
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "http://a/x y\r\nz", big), (2, None, big), (9, "http://b/", big), (3, "http://c", ""), (4, "http://d", None), (5, "http://e", "tiny"), (6, "http://f", "tiny"), (None, "http://g", "q" * 2000), (7, "http://h", "r" * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(1))
    warc.write(df, str(tmp_path / "w"))
    got = warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect()
    assert len(got) == len(rows) and all(r.request and r.metadata for r in got)
    by = {r.page: r for r in got}
    for k, _, html in rows:
        r, raw = by[None if k is None else str(k)], (html or "").encode()
        assert (r.response.payload_digest, r.metadata.payload_bytes) == (hashlib.sha1(raw).hexdigest(), len(raw))
        if k in (1, 2):
            assert (r.response.kind, r.refers_to) == ("revisit", 9)
        else:
            assert r.response.kind == "response" and bytes(r.response.payload) == raw
    warc.write(df.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choices(EN.split(), k=40)) + "."
    texts = [good() if i % 2 else " ".join(w + rng.choice(["!!", "$$$", "%%%"]) for w in good().upper().split()) for i in range(300)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts + [None, ""])] + [(None, "x", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (5, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, F.lit(True))
    rows = quality.score(df, model).collect()
    assert len(rows) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 300)
    assert quality.accepted(df, model).columns == df.columns
    empty = quality.fit(df, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(df, empty).collect()} == {0.5}
    assert quality.score(df.limit(0), model).count() == 0


def test_tokens(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = ["", None, " ", "\n", "  a  b", "a ", "▁a", "<s> </s>", "漢字\n é́", "\x00", "x" * 20000, "a b " * 5000] + ["".join(rng.choices(list(" \n\t\r▁aeth{}()0é漢;."), k=rng.randrange(1, 40))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 1)], "doc_id long, text string, n_tokens int")
    for r in tokens.count_tokens(df, path).collect():
        t = "a" if r.doc_id is None else texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)


def test_language(spark):
    rng = random.Random(7)
    some = lambda t, k: " ".join(rng.choices(t.split(), k=k))
    rows = [(i, some((EN, DE)[i % 2], 30), ("en", "de")[i % 2], "s", 0) for i in range(80)] + [(100, None, "en", "s", 0), (101, "12 %", "en", "s", 0), (102, "", None, "s", 0), (None, EN, "en", "s", 0), (103, some(DE, 4000), None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("margin", F.lit(1))
    model = langid.fit(df, F.col("doc_id") < 60)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == ("en", "de")[i % 2] and got[i].accepted for i in range(80))
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[103].lang_pred == "de" and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and kept.count() == 82
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}


def test_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 32))
    x[100:160] = x[:60] + 0.02 * rng.standard_normal((60, 32))
    x[160:220] = x[5] + 0.15 * rng.standard_normal((60, 32))
    x[220] = 3 * x[7]
    x[221:224] = x[8]
    rows = [(i, [float(np.float32(v)) for v in row], i % 2 if i < 100 else (i - 100) % 2 if i < 160 else (5 % 2 if i < 220 else i % 2)) for i, row in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None, 1.0], 1), (904, rows[0][1], None), (905, [], 0), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (908, [5.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("r", F.lit(1))
    vec = np.array([np.array(r[1], np.float32) for r in rows], np.float64)
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    hit = (vec @ vec.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(hit, False)
    want = labels_of(300, list(zip(*hit.nonzero(), strict=True)))
    got = {r.vec_id: r for r in caps.neighbours(df).collect()}
    assert len(got) == len(rows) + len(odd)
    right = [got[i].n_links == hit[i].sum() and got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in range(300)]
    assert np.mean(right) >= 0.98 and all(got[i].n_links <= hit[i].sum() for i in range(300))
    assert [(got[i].n_links, got[i].component_id) for i in range(900, 909)] == [(0, 900), (0, 901), (0, 902), (0, 903), (0, 904), (0, 905), (1, 906), (1, 906), (0, 908)]
    assert caps.neighbours(df.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    item = lambda k: " ".join(rng.choices(words, k=k // 2)) + ". " + " ".join(rng.choices(words, k=k - k // 2)) + "."
    items = [(i, item(rng.randrange(15, 60))) for i in range(60)] + [(60, item(150)), (61, None), (62, ""), (63, "zz yy xx")]
    docs, want = [], set()
    for d in range(120):
        body = rng.choices(words, k=rng.randrange(0, 700))
        if d % 3 == 0:
            i = rng.choice([*range(61), 63])
            at = rng.randrange(len(body) + 1)
            body[at:at] = items[i][1].upper().replace(" ", "  ").split() if d % 2 else items[i][1].split()
            want.add((d, i))
        docs.append((d, " ".join(body), "en", "s", 0))
    part = items[0][1].split()
    docs += [(200, None, None, None, 0), (201, "", None, None, 0), (202, " ".join(part[: len(part) // 2]), None, None, 0), (None, items[1][1], None, None, 0)]
    df = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit(0))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want | {(None, 1)}
    clean = decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d[0] for d in docs if d[0] is not None} - {d for d, _ in want}
    assert decontaminate.matches(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_wand_finds_what_full_scoring_finds():
    rng = random.Random(10)
    words = [f"w{i}" for i in range(60)]
    index = decontaminate.Index([(i, " ".join(rng.choices(words, k=rng.randrange(3, 20)))) for i in range(100)], 64)
    for _ in range(100):
        terms = sorted(rng.sample(range(1, len(index.at)), 25))
        score = Counter()
        for t in terms:
            for i, v in zip(index.at[t], index.impact[t], strict=True):
                score[i] += v
        want = {i for i, v in score.items() if v >= decontaminate.THRESHOLD - 1e-9}
        found = index.wand(terms)
        assert {i for i, _ in found} == want and all(math.isclose(v, score[i]) for i, v in found)
        assert bool(len(index.hopeful(np.zeros(len(terms), np.int64), np.array(terms), 1))) >= bool(want)


def test_all_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
