"""The suffix tree against a plain dictionary version of the same model."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from revdiff.llm import suffixtree as S


def plain(texts, learn):
    docs = [((t or "").encode().lower().split() + [b""]) for t in texts]
    c = Counter(w for d, l in zip(docs, learn) if l for w in d)
    n, v = sum(c.values()), len(c)
    root = lambda w: (c[w] + S.ADD) / (n + S.ADD * (v + 1))
    states = [{}, {}]
    # level 1
    for level in range(S.DEPTH):
        seen = defaultdict(Counter)
        for d, l in zip(docs, learn):
            for i in range(level + 1, len(d)):
                ctx = tuple(d[i - level - 1:i])
                if c[d[i]] >= S.LEAST and candidate(ctx, c, states) and l:
                    seen[ctx][d[i]] += 1
        for ctx, follow in seen.items():
            total = c[ctx[0]] if level == 0 else states[0][ctx[:1]][1][ctx[1]]
            kept = {w: k for w, k in follow.items() if k >= S.LEAST_FOLLOWER}
            p = {w: math.exp(-min(255, max(0, round(-8 * math.log(prob(ctx[1:], w, root, states))))) / 8) for w in kept}
            mass, share = sum(kept.values()), min(1 - 1e-9, sum(p.values()))
            rest = max(total - mass, 0)
            gain = sum(k * math.log(k / (total * p[w])) for w, k in kept.items()) + rest * math.log(max(rest, 1e-9) / total / (1 - share))
            if kept and gain > S.PENALTY * len(kept):
                states[level][ctx] = (total, kept)
    out = []
    for d in docs:
        out.append((sum(math.log10(root(w)) for w in d), sum(math.log10(prob(tuple(d[max(0, i - 2):i]), w, root, states)) for i, w in enumerate(d))))
    return out, n, c


def candidate(ctx, c, states):
    if len(ctx) == 1:
        return c[ctx[0]] >= S.LEAST
    one = states[0].get(ctx[:1])
    return one is not None and one[1].get(ctx[1], 0) >= S.LEAST


def prob(ctx, w, root, states):
    p = root(w)
    for k in range(1, len(ctx) + 1):
        state = states[k - 1].get(ctx[-k:])
        if state:
            total, kept = state
            back = (total - sum(kept.values()) + S.DISCOUNT * len(kept)) / total
            p = max(kept.get(w, 0) - S.DISCOUNT, 0) / total + back * p
    return p


@pytest.mark.parametrize("block", [40, 10**6])
def test_scores_match_plain_model(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_TOKENS", block)
    text = "the cat sat on the mat and the dog sat on the log"
    texts = [text] * 6 + ["the cat ran", "A b\tC  d\n", None, "", "the dog sat on the mat"] * 3 + ["zzz yyy the cat sat on"]
    learn = [i % 4 != 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(zip(texts, learn))], "doc_id long, text string, learn boolean").repartition(3)
    got = {r.doc_id: r for r in S.score(df, F.col("learn")).collect()}
    want, n, c = plain(texts, learn)
    assert len(got) == len(texts)
    for i, (base, score) in enumerate(want):
        words = (texts[i] or "").encode().lower().split() + [b""]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(c[w] > 0 for w in words), n)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score)
    assert any(got[i].score > got[i].base_score + 1 for i in got)


def test_states_are_distributions():
    """What a state gives to its followers and leaves to the shorter state adds up to one."""
    total, kept = 20, {"a": 9, "b": 4}
    back = (total - sum(kept.values()) + S.DISCOUNT * len(kept)) / total
    assert sum((k - S.DISCOUNT) / total for k in kept.values()) + back == pytest.approx(1)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    rows = S.score(df, F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert S.score(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("part", [3, 20])
def test_parts_of_a_context_are_tested_as_one(spark, monkeypatch, part):
    monkeypatch.setattr(S, "PART", part)
    monkeypatch.setattr(S, "BLOCK_TOKENS", 60)
    cloudpickle.register_pickle_by_value(S)  # else workers import the module with its own PART
    # after `the` comes `zap` far more often than chance, and every other word about as often
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        words = rng.choices("a b c d e f g h the".split(), k=25)
        texts.append(" ".join(w + " zap" if w == "the" and rng.random() < 0.4 else w for w in words))
    texts += [None, "the"]
    learn = [i % 5 != 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(zip(texts, learn))], "doc_id long, text string, learn boolean").repartition(3)
    try:
        got = {r.doc_id: r for r in S.score(df, F.col("learn")).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(S)
    want, _, c = plain(texts, learn)
    assert c[b"the"] > 2 * part
    assert [got[i].score for i in range(len(texts))] == pytest.approx([score for _, score in want])


def test_requests_of_a_block_are_made_in_pieces():
    """Beside a block's own arrays a task holds a small part of its requests; every distinct follower is asked about once."""
    rng = np.random.default_rng(1)
    size, words = 1_000_000, 50_000
    codes = np.minimum(rng.zipf(1.3, size), words).astype(np.int32) - 1
    c = np.bincount(codes, minlength=words).astype(np.int64)
    ids = np.where(c < S.LEAST, -1, np.arange(words))
    row = {"codes": S._pack(codes), "lens": S._pack(np.full(size // 500, 500)), "learn": S._pack(np.ones(size // 500, np.uint8)), "c": S._pack(c), "ids": S._pack(ids)}
    tracemalloc.start()
    block = S._Block(row, size, words)
    asked, times = [], 0
    try:
        for b in S._send(0, block, words // S.SLOT_CONTEXTS):
            for slot, packed in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if slot >= 0:
                    ctx, _, _, follower, n, _ = S._unpack(packed, np.int64).reshape(6, -1)
                    asked.append((ctx * words + follower).astype(np.int64))
                    times += int(n.sum())
        kept = sum(x.nbytes for x in asked)
        held = (tracemalloc.get_traced_memory()[1] - kept) / size
    finally:
        tracemalloc.stop()
    inner = np.arange(size) % 500 > 0
    a, b = ids[codes[np.arange(size) - 1]], ids[codes]
    ok = inner & (a >= 0) & (b >= 0)
    got = np.concatenate(asked)
    assert len(got) == len(np.unique(got)) and times == ok.sum()
    assert np.array_equal(np.sort(got), np.unique(a[ok] * words + b[ok]))
    assert held < 80  # bytes for each place
