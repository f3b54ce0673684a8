"""Phrase collocations from depth-truncated suffix subtrees, built group by group.

Every position of a text starts a suffix, cut off after the longest phrase asked for and at the end of its piece. Scans over the texts,
each with what the one before it found:

1. words are counted;
2. pairs of frequent words are counted by their hashes alone: a bound from above for every pair, as hashes only ever add up;
3. suffixes are cut where a pair, by that bound, is rare. They are dealt to groups by their first word, so many words to a group as fit
   the memory budget. A word over the budget is dealt by its first two words, a pair over the budget by all. A group's suffixes
   are sorted, which lays its subtree out in order; the count of a node is the total of the leaves below it.

A phrase is as rare as its rarest pair at least, so nothing that reaches the least count is cut. What scans send is counted
within the task first. Frequent words and pairs reach the tasks as bit fields of fixed size: where these fill up, less is cut and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revdiff.llm.common import groups
from revdiff.staging import stage

#: Bits of the fields of frequent words and pairs (8 MB each); slots that first words are dealt to groups by.
FIELD, SLOTS = 1 << 26, 1 << 14
#: Suffixes of a group aimed at; at most CROWDED words and pairs can be over the budget, so their lists stay small.
BUDGET, CROWDED = 1 << 20, 1 << 14
#: Words of a task's dictionary and entries of a task's counts before they are sent.
WORDS, ENTRIES = 1 << 19, 1 << 21
#: Bytes of text worked on at a time.
BLOCK = 1 << 22
#: Leaves that a subtree's task lays out at a time.
PIECE = 1 << 18
#: Pairs of one range of hashes that one task adds up.
RANGE = 1 << 21

_UPPER = bytes(range(65, 91))
_TABLE = bytes.maketrans(_UPPER + b",;:!?\n\x0b\x0c\r\t", _UPPER.lower() + b"." * 9 + b" ")
_U = np.uint64


def _hash(lang: str, word: bytes) -> int:
    """Equals Spark's xxhash64 of (lang, ' ', word) put together."""
    return xxhash.xxh64_intdigest(lang.encode() + b" " + word, 42)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a pair from the hashes of both parts, in order."""
    h = (left * _U(0x9E3779B97F4A7C15)) ^ (right + (left << _U(23)))
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


class Lexicon:
    """Numbers of the words of one language within a task; 0 ends a piece."""

    def __init__(self, lang: str):
        self.lang = lang
        self.clear()

    def clear(self) -> None:
        self.ids = {b".": 0}
        self.hashes = np.zeros(1024, np.uint64)
        self.known = 1

    def number(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        for w in set(words) - ids.keys():
            ids[w] = len(ids)
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def hash(self) -> np.ndarray:
        """Hashes of all words by number; worked out once a word."""
        n = len(self.ids)
        if n > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        if n > self.known:
            for w, i in list(self.ids.items())[self.known:]:
                self.hashes[i] = _hash(self.lang, w)
            self.known = n
        return self.hashes[:n]

    def words(self) -> list[bytes]:
        return list(self.ids)


def _blocks(batches: Iterator[pa.RecordBatch], lexica: dict[str, Lexicon]) -> Iterator[tuple[Lexicon, np.ndarray]]:
    """(lexicon, numbers) of the texts of a language, about BLOCK bytes at a time; batches hold (lang, text)."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> tuple[Lexicon, np.ndarray]:
        lex = lexica.setdefault(lang, Lexicon(lang))
        text = b".".join(held.pop(lang)) + b"."
        size.pop(lang)
        return lex, lex.number(text.replace(b".", b" . ").split())

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            lang = lang.as_py()
            data = text.as_buffer().to_pybytes().translate(_TABLE)
            held.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data)
            if size[lang] >= BLOCK:
                yield flush(lang)
        if sum(size.values()) >= 4 * BLOCK:
            for lang in list(held):
                yield flush(lang)
    for lang in list(held):
        yield flush(lang)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter("text <> ''")


def _bits(df: DataFrame, position: str) -> bytes:
    """Positions below FIELD as one field; Spark builds it in pieces of 4,096 bytes."""
    pieces = df.groupBy(F.bitmap_bucket_number(position).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("m"))
    field = np.zeros((FIELD // 32768, 4096), np.uint8)
    for r in pieces.toLocalIterator():
        field[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)
    return field.tobytes()


def _test(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    # Spark numbers positions from one
    at = (hashes % _U(FIELD)).astype(np.int64)
    return field[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def count_words(texts: DataFrame) -> DataFrame:
    """lang, word, f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexica: dict[str, Lexicon] = {}
        counts: dict[str, np.ndarray] = {}

        def send(lang: str) -> Iterator[pa.RecordBatch]:
            words, n = lexica[lang].words()[1:], counts.pop(lang)[1:]
            lexica[lang].clear()
            for i in range(0, len(words), 65536):
                part = pa.array(words[i:i + 65536], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(n[i:i + 65536])], ["lang", "word", "f"])

        for lex, ids in _blocks(batches, lexica):
            n = np.bincount(ids, minlength=len(lex.ids))
            if (old := counts.get(lex.lang)) is not None:
                n[:len(old)] += old
            counts[lex.lang] = n
            if len(n) > WORDS:
                yield from send(lex.lang)
        for lang in list(counts):
            yield from send(lang)

    return texts.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _pair_field(texts: DataFrame, frequent, least: int, budget: int, total: int) -> tuple[bytes, np.ndarray]:
    """The field of pairs that may occur `least` times, and the hashes of those that may occur more than `budget` times."""
    ranges = max(64, -(-total // RANGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.frombuffer(frequent.value, np.uint8)
        lexica: dict[str, Lexicon] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _add_up(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))

        def send() -> Iterator[pa.RecordBatch]:
            h, c = merged()
            part = (h // _U(-(-2**64 // ranges))).astype(np.int32)
            found, at = np.unique(part, return_index=True)
            cut = [*at.tolist(), len(h)]
            for i, r in enumerate(found):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([h[cut[i]:cut[i + 1]].tobytes()]), pa.array([c[cut[i]:cut[i + 1]].tobytes()])], ["part", "h", "c"])

        for lex, ids in _blocks(batches, lexica):
            hashes = lex.hash()
            good = _test(field, hashes)
            good[0] = False
            both = good[ids[:-1]] & good[ids[1:]]
            found = _join(hashes[ids[:-1][both]], hashes[ids[1:][both]])
            if len(lex.ids) > WORDS:
                lex.clear()
            h, c = np.unique(found, return_counts=True)
            held.append((h, c))
            n += len(h)
            if n > ENTRIES:
                h, c = merged()
                held, n = [(h, c)], len(h)
                if n > ENTRIES // 2:
                    yield from send()
                    held, n = [], 0
        if n:
            yield from send()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["part"]):
            h, c = (np.frombuffer(b"".join(t.column(k).to_pylist()), kind) for k, kind in (("h", np.uint64), ("c", np.int64)))
            h, c = _add_up(h, c)
            keep = c >= least
            h, c = h[keep], c[keep]
            yield pa.RecordBatch.from_arrays([pa.array((h % _U(FIELD)).astype(np.int64)), pa.array(h.view(np.int64)), pa.array(c)], ["at", "h", "c"])

    sent = texts.mapInArrow(run, "part int, h binary, c binary")
    found = stage(sent.repartition("part").sortWithinPartitions("part").mapInArrow(reduce, "at long, h long, c long"))
    crowded = np.array([r["h"] for r in found.filter(F.col("c") > budget).select("h").collect()], np.int64).view(np.uint64)
    return _bits(found.withColumn("at", F.col("at") + 1), "at"), np.sort(crowded)


def _add_up(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _codes(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words of each row as numbers (row, place; -1 beyond its end), the rows' sizes and starts, and all words in line."""
    flat = words.flatten()
    size = words.value_lengths().to_numpy().astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    codes = np.full((len(size), int(size.max(initial=0))), -1, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    codes[row, np.arange(len(row)) - start[row]] = flat.dictionary_encode().indices.to_numpy()
    return codes, size, start, flat


def _subtree(t: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    """Nodes of two and more words, and their totals, from sorted leaves (g, parted, lang, words, f), one batch for each depth.

    Nodes below `least` go, but for those of pairs dealt by all their words: other groups hold leaves of theirs.
    """
    codes, size, start, flat = _codes(t.column("words"))
    parted = t.column("parted").to_numpy(zero_copy_only=False)
    lang = t.column("lang").dictionary_encode().indices.to_numpy()
    sums = np.concatenate([[0], np.cumsum(t.column("f").to_numpy())])
    # words that a leaf shares with the one before it
    shared = np.zeros(len(size), np.int64)
    alike = (lang[1:] == lang[:-1]) & (parted[1:] == parted[:-1])
    for k in range(codes.shape[1]):
        alike &= (codes[1:, k] == codes[:-1, k]) & (codes[1:, k] >= 0)
        shared[1:] += alike
    for depth in range(2, codes.shape[1] + 1):
        # a node of this depth begins where a leaf that is long enough shares less with the one before; it ends at the next that does
        change = (shared < depth).nonzero()[0]
        at = change[size[change] >= depth]
        count = sums[np.concatenate([change, [len(size)]])[np.searchsorted(change, at, side="right")]] - sums[at]
        keep = (count >= least) | parted[at]
        at, count = at[keep], count[keep]
        if len(at):
            words = flat.take(pa.array((start[at][:, None] + np.arange(depth)).ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * depth), words)
            yield pa.RecordBatch.from_arrays([t.column("lang").take(pa.array(at)), lists, pa.array(count, pa.int64())], ["lang", "words", "f"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted leaves, about PIECE at a time; a cut falls between first pairs, or anywhere among the leaves of a pair dealt by all its words."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < PIECE:
            continue
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        codes = _codes(t.column("words"))[0]
        lang = t.column("lang").dictionary_encode().indices.to_numpy()
        free = (codes[1:, :2] != codes[:-1, :2]).any(axis=1) | (lang[1:] != lang[:-1]) | t.column("parted").to_numpy(zero_copy_only=False)[1:]
        cuts = free.nonzero()[0]
        if len(cuts):
            cut = int(cuts[-1]) + 1
            yield t.slice(0, cut)
            # a copy, so that the part that is done can be let go
            held, n = [t.slice(cut).take(pa.array(np.arange(t.num_rows - cut)))], t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): lang, word, f of all words; lang, words array<string>, f of all phrases of 2 to `longest` words that occur `least` times or more.

    Null texts are empty, a null language is `und`. Both frames are staged.
    """
    spark = docs.sparkSession
    texts = _texts(docs, text, lang)
    words = stage(count_words(texts))
    frequent = words.filter(F.col("f") >= least)
    key = F.xxhash64(F.concat(F.col("lang"), F.lit(" "), F.col("word")))
    # pmod of the signed hash by a power of two is the unsigned one's remainder
    field = spark.sparkContext.broadcast(_bits(frequent.select((F.pmod(key, F.lit(FIELD)) + 1).alias("at")), "at"))
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    budget = max(budget, -(-total // CROWDED))
    pair_bits, hot_pairs = _pair_field(texts, field, least, budget, total)
    pairs = spark.sparkContext.broadcast(pair_bits)
    hot_words = np.sort(np.array([r[0] for r in frequent.filter(F.col("f") > budget).select(key).collect()], np.int64).view(np.uint64))
    load = frequent.filter(F.col("f") <= budget).groupBy(F.pmod(key, F.lit(SLOTS)).cast("int").alias("s")).agg(F.sum("f").alias("n")).collect()
    slot_group = _group_slots({r["s"]: r["n"] for r in load}, budget)
    shares = max(1, -(-total // budget))
    first_share = int(slot_group.max(initial=0)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.frombuffer(field.value, np.uint8), np.frombuffer(pairs.value, np.uint8)
        lexica: dict[str, Lexicon] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[str, int] = {}

        def merge(lang: str) -> tuple[np.ndarray, np.ndarray]:
            rows = np.concatenate([r for r, _ in held[lang]])
            return _count_rows(rows, np.concatenate([c for _, c in held[lang]]), len(lexica[lang].ids))

        def send(lang: str) -> Iterator[pa.RecordBatch]:
            rows, c = merge(lang)
            held.pop(lang), size.pop(lang)
            hashes = lexica[lang].hash()
            vocabulary = pa.array(lexica[lang].words(), pa.binary()).cast(pa.string())
            head = hashes[rows[:, 0]]
            pair = _join(head, hashes[rows[:, 1]])
            every = pair
            for k in range(2, rows.shape[1]):
                every = _join(every, np.where(rows[:, k] > 0, hashes[rows[:, k]], _U(0)))
            group = slot_group[(head % _U(SLOTS)).astype(np.int64)]
            crowd = _member(hot_words, head)
            parted = crowd & _member(hot_pairs, pair)
            group = np.where(crowd, first_share + (pair % _U(shares)).astype(np.int64), group)
            group = np.where(parted, first_share + (every % _U(shares)).astype(np.int64), group)
            for i in range(0, len(rows), 65536):
                part = rows[i:i + 65536]
                used = part > 0
                ends = pa.array(np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(group[i:i + 65536], pa.int64()), pa.array(parted[i:i + 65536]), pa.array([lang] * len(part), pa.string()),
                    pa.ListArray.from_arrays(ends, vocabulary.take(pa.array(part[used]))), pa.array(c[i:i + 65536], pa.int64())], ["g", "parted", "lang", "words", "f"])
            if len(lexica[lang].ids) > WORDS:
                lexica[lang].clear()

        for lex, ids in _blocks(batches, lexica):
            hashes = lex.hash()
            good = _test(one, hashes)
            good[0] = False
            step = good[ids[:-1]] & good[ids[1:]]
            at = step.nonzero()[0]
            step[at[~_test(two, _join(hashes[ids[at]], hashes[ids[at + 1]]))]] = False
            at = step.nonzero()[0]
            rows = np.zeros((len(at), longest), np.int64)
            rows[:, 0] = ids[at]
            alive = np.ones(len(at), bool)
            for k in range(1, longest):
                alive &= np.concatenate([step, np.zeros(longest, bool)])[at + k - 1]
                rows[alive, k] = ids[at[alive] + k]
            rows, c = _count_rows(rows, np.ones(len(rows), np.int64), len(lex.ids))
            held.setdefault(lex.lang, []).append((rows, c))
            size[lex.lang] = size.get(lex.lang, 0) + len(rows)
            if size[lex.lang] > ENTRIES:
                rows, c = merge(lex.lang)
                held[lex.lang], size[lex.lang] = [(rows, c)], len(rows)
            if size[lex.lang] > ENTRIES // 2 or len(lex.ids) > WORDS:
                yield from send(lex.lang)
        for lang in list(held):
            yield from send(lang)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _pieces(batches):
            yield from _subtree(t, least)

    leaves = texts.mapInArrow(run, "g long, parted boolean, lang string, words array<string>, f long")
    order = ["g", "lang", "parted", "words"]
    nodes = leaves.repartition("g").sortWithinPartitions(*order).mapInArrow(build, "lang string, words array<string>, f long")
    # nodes of a pair dealt by all its words come from several groups
    found = nodes.groupBy("lang", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return words, stage(found)


def _count_rows(rows: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and the totals of n."""
    if not len(rows):
        return rows, n
    code = rows[:, 0]
    for k in range(1, rows.shape[1]):
        code = code * words + rows[:, k]
        if k + 1 < rows.shape[1] or k > 2:
            # short codes again before the next word is taken in
            code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return rows[order[first]], np.add.reduceat(n[order], first)


def _group_slots(load: dict[int, int], budget: int) -> np.ndarray:
    """Group of every slot: slots follow each other into a group until the budget is reached."""
    group = np.zeros(SLOTS, np.int64)
    now, used = 0, 0
    for s in range(SLOTS):
        n = load.get(s, 0)
        if used and used + n > budget:
            now, used = now + 1, 0
        group[s] = now
        used += n
    return group


def mine(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, words, a, l, r, n, score.

    A phrase of 2 to `longest` words that occurs a >= least times is cut into two parts that occur l and r times; its score is
    floor(1000000 * a * a / (l * r)) at the lowest-scoring cut, the earliest of equals. Phrases inside a longer one that occurs in `share` or more of
    a hundred of their places are dropped. Ties in score go to the more frequent phrase, then to the first in byte order.
    Null and empty texts have no words; a null language is `und`; repeated rows count as often as they occur; an empty table gives no rows.
    """
    words, found = phrases(docs, text=text, lang=lang, longest=longest, least=least, budget=budget)
    text_of = F.concat_ws(" ", "words")
    cand = found.select("lang", "words", text_of.alias("phrase"), F.col("f").alias("a"))
    counts = words.filter(F.col("f") >= least).select("lang", F.col("word").alias("part"), "f").unionByName(found.select("lang", text_of.alias("part"), "f"))
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("left"),
                       F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    score = F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide["a"] * wide["a"]), wide["l"] * wide["r"])
    scored = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("best"))
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.concat_ws(" ", F.slice("words", i, k)))))
    inside = cand.filter(size > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.split("phrase", " ").alias("words"), "a", F.col("best.l").alias("l"),
                                              F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
