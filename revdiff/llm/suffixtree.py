"""Language-model scores from a probabilistic suffix tree over words.

Contexts are the last words before a symbol. A context is retained if its next-symbol distribution diverges from that of the longest
retained suffix by more than chance gives; longer contexts grow from pairs that the shorter ones kept. A retained state mixes its
discounted counts with the distribution of the next shorter state, down to the smoothed word frequencies. A text is scored
with the longest retained suffix at every place.

Nothing global is held in one place. Documents are packed into blocks of a bounded number of tokens, each with a vocabulary of its own;
a block sends one row per distinct word, or per distinct context with its followers, and gets back what the whole corpus knows of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from revdiff.llm.common import as_bytes, drop_stage, release, stage_by, whole_groups
from revdiff.staging import stage

#: Tokens packed into one block; a longer text is a block of its own.
BLOCK_TOKENS = 1_000_000
#: Added to every word's count in the root distribution.
ADD = 0.1
#: Occurrences that a word or a context needs to be a symbol of a state, and that a follower needs to be kept.
LEAST, LEAST_FOLLOWER = 4, 2
#: Taken off every kept follower's count, for the shorter state.
DISCOUNT = 0.5
#: Divergence, in nats, asked for per kept follower.
PENALTY = 4.0
DEPTH = 2
#: Occurrences of a context to each part of its followers that is counted in one group; the test is over all parts.
PART = 2**20
#: Places of a block's texts that are looked up, or asked about, at a time: what a task holds besides the block itself.
PLACES = 2**17
#: Words, and rows of requests, merged at a time.
CHUNK, MERGE = 20_000, 400
#: States told to blocks that are packed at a time.
PACK_ROWS = 300_000
#: Contexts in one row of a list.
LISTED = 1024
END = xxhash.xxh64_intdigest(b"")


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    a = np.ascontiguousarray(a)
    return _codec()[0].compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


@lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _unpack(raw: bytes, kind) -> np.ndarray:
    data = np.frombuffer(_codec()[1].decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(data.reshape(width, -1).T).view(kind).ravel()


def blocks_of(docs: DataFrame, learn: Column, key: str, text: str) -> DataFrame:
    """Packed documents: block, keys, learn, lens, codes (places in the block's vocabulary, a text ends with the end symbol), vocab (word hashes)."""
    slim = docs.select(F.col(key).alias("k"), F.coalesce(learn, F.lit(False)).alias("learn"), as_bytes(F.col(text)).alias("b"))
    kind = slim.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 12
        keys: list[pa.Array] = []
        learns: list[bool] = []
        codes: list[np.ndarray] = []
        vocab: defaultdict[bytes, int] = defaultdict()
        vocab.default_factory = vocab.__len__
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            every = pa.concat_arrays(keys)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab), np.uint64, len(vocab))
            row = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every), pa.array([_pack(np.array(learns, np.uint8))]),
                 pa.array([_pack(np.array([len(c) for c in codes], np.int64))]), pa.array([_pack(np.concatenate(codes))]), pa.array([hashes.tobytes()])],
                ["block", "keys", "learn", "lens", "codes", "vocab"])
            keys.clear(), learns.clear(), codes.clear(), vocab.clear()
            number, size = number + 1, 0
            return row

        for b in batches:
            start = 0
            for i, (l, raw) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                words = raw.lower().split()
                words.append(b"")
                codes.append(np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)))
                learns.append(l)
                size += len(words)
                if size >= BLOCK_TOKENS:
                    keys.append(b.column(0).slice(start, i + 1 - start))
                    start = i + 1
                    yield flush()
            if start < b.num_rows:
                keys.append(b.column(0).slice(start))
        if keys:
            yield flush()

    return stage(slim.mapInArrow(run, f"block long, keys array<{kind}>, learn binary, lens binary, codes binary, vocab binary"))


def _counted_words(blocks: DataFrame) -> DataFrame:
    """block, i (place in its vocabulary), c (count in all texts learned from), id (one place of the word in the corpus)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, learn, lens, codes, vocab in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = np.frombuffer(vocab, np.uint64).view(np.int64)
                counts = np.bincount(_unpack(codes, np.int32)[np.repeat(_unpack(learn, np.uint8), _unpack(lens, np.int64)) > 0], minlength=len(h))
                for at in range(0, len(h), CHUNK):
                    o = np.arange(at, min(len(h), at + CHUNK))
                    yield pa.RecordBatch.from_arrays([pa.array(h[o]), pa.array((block << 31) + o), pa.array(counts[o])], ["h", "place", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["h"], CHUNK):
            h, place, n = (t.column(c).to_numpy() for c in ("h", "place", "n"))
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            start, word = new.nonzero()[0], new.cumsum() - 1
            columns = (place >> 31, (place & (2**31 - 1)).astype(np.int32), np.add.reduceat(n, start)[word], np.minimum.reduceat(place, start)[word])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["block", "i", "c", "id"])

    rows = blocks.select("block", "learn", "lens", "codes", "vocab").mapInArrow(ask, "h long, place long, n long")
    # a block sends one row per distinct word, so a word has at most as many rows as there are blocks, however often it occurs
    return rows.repartition(_slots(blocks), "h").sortWithinPartitions("h").mapInArrow(merge, "block long, i int, c long, id long")


def _slots(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _with_counts(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks with the count and the id of every word of their vocabulary instead of its hash; id -1: too rare to be a symbol of a state.

    Words counted at their own place add up, over all blocks, to tokens, distinct words and symbols of the corpus.
    """

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        i = right.column("i").to_numpy()
        c, ids = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        c[i], ids[i] = right.column("c").to_numpy(), right.column("id").to_numpy()
        own = (ids == (left.column("block")[0].as_py() << 31) + np.arange(len(ids))) & (c > 0)
        ids[c < LEAST] = -1
        about = {"c": pa.array([_pack(c)]), "ids": pa.array([_pack(ids)]), "tokens": pa.array([int(c[own].sum())], pa.int64()),
                 "distinct": pa.array([int(own.sum())], pa.int64()), "symbols": pa.array([int((own & (c >= LEAST)).sum())], pa.int64())}
        for name, column in about.items():
            left = left.append_column(name, column)
        return left

    slim = blocks.select("block", "keys", "learn", "lens", "codes")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields)
    out = f"{kinds}, c binary, ids binary, tokens long, distinct long, symbols long"
    empty = _nothing(out)
    return stage_by(slim.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(join, out), "block")


class _Block:
    """Places of a block's texts: symbols, root probabilities and, level by level, the state in force."""

    def __init__(self, row: dict, n: float, v: float):
        self.codes = _unpack(row["codes"], np.int32)
        self.lens = _unpack(row["lens"], np.int64)
        self.learn = _unpack(row["learn"], np.uint8)
        self.c, self.n, self.v = _unpack(row["c"], np.int64), n, v
        ids = _unpack(row["ids"], np.int64)
        self.symbols = np.unique(ids)  # -1, too rare, is one of them if any is
        self.symbol_at = np.searchsorted(self.symbols, ids).astype(np.int32)[self.codes]
        self.p = self.root()
        first = np.zeros(len(self.codes), bool)
        first[self.lens.cumsum() - self.lens] = True
        self.first = first
        self.context = np.full(len(self.codes), -1, np.int64)  # id of the candidate context, -1: none
        self.total = np.zeros(len(self.codes), np.int64)       # its occurrences
        for lo, hi in self._pieces(1):
            behind = ~first[lo:hi]
            self.context[lo:hi][behind] = ids[self.codes[lo - 1:hi - 1][behind]]
            self.total[lo:hi][behind] = self.c[self.codes[lo - 1:hi - 1][behind]]
        self.kept = None  # occurrences of every place's symbol behind its context, once states are applied

    def _pieces(self, start: int = 0) -> list[tuple[int, int]]:
        return [(lo, min(lo + PLACES, len(self.codes))) for lo in range(start, len(self.codes), PLACES)]

    def root(self) -> np.ndarray:
        return ((self.c + ADD) / (self.n + ADD * (self.v + 1)))[self.codes] if self.n or self.v else np.ones(len(self.codes))

    def known(self) -> np.ndarray:
        return (self.c > 0)[self.codes]

    def apply(self, states: dict[str, np.ndarray]) -> None:
        """Move to the retained states of this level; states: ctx, succ (-1 - kept followers for a state itself), n, all sorted by ctx, succ."""
        ctx, succ, n = states["ctx"], states["succ"], states["n"]
        own = succ < 0
        sc, st, sm = ctx[own], -1 - succ[own], n[own]
        self.kept = np.zeros(len(self.codes), np.int64)
        if not len(sc):
            return
        # a follower is looked up by the places of its context and of its symbol in the block
        have = np.searchsorted(sc, ctx[~own]) * len(self.symbols) + np.searchsorted(self.symbols, succ[~own])
        pn = n[~own]
        for lo, hi in self._pieces():
            context = self.context[lo:hi]
            at = np.minimum(np.searchsorted(sc, context), len(sc) - 1)
            where = ((sc[at] == context) & (context != -1)).nonzero()[0]
            at, where = at[where], where + lo
            if len(have):
                want = at * len(self.symbols) + self.symbol_at[where]
                hit = np.minimum(np.searchsorted(have, want), len(have) - 1)
                self.kept[where] = np.where(have[hit] == want, pn[hit], 0)
            total = self.total[where].astype(float)
            kinds, mass = st[at], sm[at]
            back = (total - mass + DISCOUNT * kinds) / total
            self.p[where] = np.maximum(self.kept[where] - DISCOUNT, 0) / total + back * self.p[where]

    def deepen(self) -> None:
        """Candidates of the next level: the symbol before, in front of a context that kept the context's last word often enough."""
        context = np.full(len(self.codes), -1, np.int64)
        total = np.zeros(len(self.codes), np.int64)
        for lo, hi in self._pieces(1):
            before, symbol = self.context[lo - 1:hi - 1], self.symbols[self.symbol_at[lo - 1:hi - 1]]
            ok = (before != -1) & (self.kept[lo - 1:hi - 1] >= LEAST) & (symbol != -1) & ~self.first[lo:hi]
            context[lo:hi][ok], total[lo:hi][ok] = _mix(before[ok], symbol[ok]), self.kept[lo - 1:hi - 1][ok]
        self.context, self.total = context, total

    def requests(self, slots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slots of the distinct (context, part, follower) of the block in order, and for each: context, part, the context's total, follower, its
        count in texts learned from, its quantised surprise. They come in ranges of slots, each about as many places as are read at a time."""
        slot = np.full(len(self.codes), -1, np.int64)
        asking = 0
        for lo, hi in self._pieces():
            symbol = self.symbols[self.symbol_at[lo:hi]]
            at = ((self.context[lo:hi] != -1) & (symbol != -1)).nonzero()[0]
            slot[lo:hi][at] = (_mix(self.context[lo:hi][at], self._part(symbol[at], self.total[lo:hi][at])) >> 1) % slots
            asking += len(at)
        turns = -(-asking // PLACES)
        learned = np.repeat(self.learn, self.lens)
        for turn in range(turns):
            at = ((slot >= slots * turn // turns) & (slot < slots * (turn + 1) // turns)).nonzero()[0]
            # followers of one context are told apart by their place among the symbols, which keeps their order
            if not len(at):
                continue
            ctx, place = np.unique(self.context[at], return_inverse=True)
            key = place * len(self.symbols) + self.symbol_at[at]
            order = key.argsort()
            at, key = at[order], key[order]
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            start = new.nonzero()[0]
            n = np.add.reduceat(learned[at].astype(np.int64), start)
            order = slot[at[start]].argsort(kind="stable")
            at, n = at[start][order], n[order]
            sym, total = self.symbols[self.symbol_at[at]], self.total[at]  # ids that all blocks share
            q = np.clip(np.rint(-8 * np.log(self.p[at])), 0, 255).astype(np.int64)
            yield slot[at], np.stack([self.context[at], self._part(sym, total), total, sym, n, q])

    def lists(self) -> np.ndarray:
        """The contexts whose state no single request brings back: all their followers are too rare to ask about, or they are counted in parts."""
        rare = len(self.symbols) > 0 and self.symbols[0] == -1
        few, asked, large = [], [], []
        for lo, hi in self._pieces():
            context, big = self.context[lo:hi], self.total[lo:hi] > PART
            seldom = (self.symbol_at[lo:hi] == 0) & rare
            few.append(np.unique(context[big | ((context != -1) & seldom)]))
            asked.append(np.unique(context[(context != -1) & ~seldom]))
            large.append(np.unique(context[big]))
        few, asked, large = (np.unique(np.concatenate([np.zeros(0, np.int64), *x])) for x in (few, asked, large))
        return few[~np.isin(few, asked) | np.isin(few, large)]

    @staticmethod
    def _part(symbol: np.ndarray, total: np.ndarray) -> np.ndarray:
        return symbol % -(-np.maximum(total, 1) // PART)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two longs that is at least 0."""
    with np.errstate(over="ignore"):
        x = (a * np.int64(-7046029254386353131) ^ b * np.int64(-4417276706812531889)) * np.int64(1609587929392839161)
        x ^= x >> 29
        return (x * np.int64(-4658895280553007687)) & np.int64(2**63 - 1)


def _states(right: pa.Table) -> list[dict[str, np.ndarray]]:
    """The answers to one block, one table per level, sorted by context and follower."""
    out = []
    levels, packs = right.column("level").to_pylist(), right.column("packed").to_pylist()
    for level in range(1, DEPTH + 1):
        parts = [_unpack(p, np.int64).reshape(3, -1) for p, k in zip(packs, levels, strict=True) if k == level]
        ctx, succ, n = np.concatenate([np.zeros((3, 0), np.int64), *parts], axis=1)
        order = np.lexsort((succ, ctx))
        out.append({"ctx": ctx[order], "succ": succ[order], "n": n[order]})
    return out


#: Requests travel by slots: contexts of like hash share a row, their numbers packed.
_REQUEST = "slot long, block long, packed binary"
SLOT_CONTEXTS = 256


def _send(block: int, b: _Block, slots: int) -> Iterator[pa.RecordBatch]:
    """Requests of a block, and rows with a slot below 0 that list contexts whose state it needs besides."""
    def rows(to: np.ndarray, packed: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(packed), block)), pa.array(packed, pa.binary())], ["slot", "block", "packed"])

    for slot, table in b.requests(slots):
        start = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        yield rows(slot[start], [_pack(table[:, lo:hi].ravel()) for lo, hi in zip(start, np.append(start[1:], len(slot)), strict=True)])
    lists = b.lists()
    packed = [_pack(lists[at:at + LISTED]) for at in range(0, len(lists), LISTED)]
    yield rows(np.full(len(packed), -1 - block), packed)


def _test(t: pa.Table) -> pa.RecordBatch | None:
    """Merge the requests of complete slots, test the divergence of every context counted in one part and answer.

    A row (block, packed) gives a block the kept followers that it asked for (context, follower, count) and the states of retained contexts
    that are counted in one part (context, -1 - kept followers, their mass); rows with block -1 give all these states. A context in
    several parts is tested later over all of them: rows with block -2 give its sums part by part, rows (block, ctx, packed) the kept
    followers that a block gets if it is retained.
    """
    tables = [_unpack(x, np.int64).reshape(6, -1) for x in t.column("packed").to_pylist()]
    block = np.repeat(t.column("block").to_numpy(), [x.shape[1] for x in tables])
    ctx, part, total, succ, n, q = np.concatenate(tables, axis=1)
    order = np.lexsort((succ, part, ctx))
    ctx, part, total, succ, n, q, block = (x[order] for x in (ctx, part, total, succ, n, q, block))
    change = np.ones(len(ctx), bool)
    change[1:] = (ctx[1:] != ctx[:-1]) | (part[1:] != part[:-1])
    g = change.cumsum() - 1
    heads = change.nonzero()[0]
    new = change.copy()
    new[1:] |= succ[1:] != succ[:-1]
    start = new.nonzero()[0]
    count = np.add.reduceat(n, start)
    kept = count >= LEAST_FOLLOWER
    own = g[start]
    size = len(heads)
    p = np.exp(-q[start] / 8.0)
    c = total[heads].astype(float)
    kinds = np.bincount(own[kept], minlength=size)
    mass = np.bincount(own[kept], count[kept], size)
    share = np.bincount(own[kept], p[kept], size)
    gain = np.bincount(own[kept], (count * np.log(np.maximum(count, 1) / (c[own] * p)))[kept], size)
    one = total[heads] <= PART
    good = one & (kinds > 0) & (gain + _rest(c, mass, share) > PENALTY * kinds)
    parts = ~one & (kinds > 0)
    if not (good | parts).any():
        return None
    follower = new.cumsum() - 1
    answer = ((good[own] & kept)[follower]).nonzero()[0]
    told = good[g].nonzero()[0]
    told = told[np.lexsort((block[told], g[told]))]
    first = np.ones(len(told), bool)
    first[1:] = (g[told][1:] != g[told][:-1]) | (block[told][1:] != block[told][:-1])
    told = told[first]
    own_state = np.stack([ctx[told], -1 - kinds[g[told]], mass[g[told]].astype(np.int64)])
    followers = np.stack([ctx[answer], succ[answer], count[follower][answer]])
    asks, packs = _by_block(np.append(block[answer], block[told]), np.concatenate([followers, own_state], axis=1))
    out = [_found(asks, packed=packs)]
    state = good.nonzero()[0]
    out.append(_found(np.full(len(state), -1), ctx[heads[state]], kinds[state], mass[state].astype(np.int64)))
    state = parts.nonzero()[0]
    out.append(_found(np.full(len(state), -2), ctx[heads[state]], kinds[state], mass[state].astype(np.int64), total[heads[state]], gain[state], share[state]))
    for k in state:
        later = ((own == k) & kept)[follower].nonzero()[0]
        asks, packs = _by_block(block[later], np.stack([ctx[later], succ[later], count[follower][later]]))
        out.append(_found(asks, np.full(len(asks), ctx[heads[k]]), packed=packs))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def _rest(c: np.ndarray, mass: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What the followers that are not kept add to the gain of a context with c occurrences."""
    rest = np.maximum(c - mass, 0)
    return rest * np.log(np.maximum(rest, 1e-9) / c / (1 - np.minimum(share, 1 - 1e-9)))


#: What a level finds, as _test says.
_FOUND = "block long, ctx long, succ long, n long, total long, gain double, share double, packed binary"


def _found(block: np.ndarray, *columns: np.ndarray, packed: list[bytes] | None = None) -> pa.RecordBatch:
    """Rows of what a level finds; columns not given are null."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _FOUND.split(", "))])
    given = [block, *columns]
    arrays = [pa.array(x, f.type) for x, f in zip(given, schema, strict=False)] + [pa.nulls(len(block), f.type) for f in list(schema)[len(given):]]
    if packed is not None:
        arrays[-1] = pa.array(packed, pa.binary())
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def _level(requests: DataFrame) -> DataFrame:
    """What a level finds for all blocks, as _test says; ctx is -1 in the lists of contexts that came along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["slot"], MERGE):
            lists = pc.less(t.column("slot"), 0)
            asked, t = t.filter(lists), t.filter(pc.invert(lists))
            if size := asked.num_rows:
                yield _found(asked.column("block").to_numpy(), np.full(size, -1), packed=asked.column("packed").to_pylist())
            if t.num_rows and (out := _test(t)) is not None:
                yield out

    return stage(requests.repartition(_slots(requests), "slot").sortWithinPartitions("slot").mapInArrow(run, _FOUND))


def _by_block(block: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Columns of a table packed per block, and the blocks."""
    order = block.argsort(kind="stable")
    block, table = block[order], table[:, order]
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    return block[first], [_pack(table[:, lo:hi].ravel()) for lo, hi in zip(first, np.append(first[1:], len(block)), strict=False)]


def _answers(found: DataFrame, level: int) -> DataFrame:
    """What a level says to every block (level, block, packed): kept followers and states, those of the listed contexts too."""
    sums = found.filter("block = -2").groupBy("ctx").agg(*[F.sum(c).alias(c) for c in ("succ", "n", "gain", "share")], F.max("total").alias("total"))
    rest = F.greatest(F.col("total") - F.col("n"), F.lit(0))
    rest_gain = rest * F.log(F.greatest(rest.cast("double"), F.lit(1e-9)) / F.col("total") / (1 - F.least("share", F.lit(1 - 1e-9))))
    # one test over all parts of a context: with many occurrences, so there are few
    whole = stage(sums.filter(F.col("gain") + rest_gain > PENALTY * F.col("succ")).select("ctx", "succ", "n"))
    states = found.filter("block = -1").select("ctx", "succ", "n").unionByName(whole).select("ctx", (-1 - F.col("succ")).alias("succ"), "n")
    later = found.filter("block >= 0 and ctx >= 0").join(whole.select("ctx"), "ctx", "left_semi").select("block", "packed")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            blocks, packs = _by_block(t.column("block").to_numpy(), np.stack([t.column(c).to_numpy() for c in ("ctx", "succ", "n")]))
            return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(packs, pa.binary())], ["block", "packed"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= PACK_ROWS:
                yield flush()
                held = []
        if held:
            yield flush()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = _unpack(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids)], ["block", "ctx"])

    asked = found.filter("ctx = -1").select("block", "packed").mapInArrow(listed, "block long, ctx long")
    about = stage(asked.join(states, "ctx").select("block", "ctx", "succ", "n").mapInArrow(pack, "block long, packed binary"))
    return found.filter("block >= 0 and ctx is null").select("block", "packed").unionByName(later).unionByName(about).withColumn("level", F.lit(level))


def score(docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where `learn` holds and scores all. Words are lower-cased in A-Z and split at ASCII blanks; every text ends with an end symbol. A null
    text is empty: one token. Without rows to learn from all scores are 0 (no model). base_score is the root state alone. Keys pass as they are.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    blocks = blocks_of(docs, learn, key, text)
    packed = _with_counts(blocks, _counted_words(blocks))
    drop_stage(blocks)
    known = packed.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v"), F.sum("symbols").alias("s")).first()
    n, v, slots = int(known["n"] or 0), int(known["v"] or 0), max(1, int(known["s"] or 0) // SLOT_CONTEXTS)
    columns = ["block", "learn", "lens", "codes", "c", "ids"]
    release(spark)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                yield from _send(r["block"], _Block(r, n, v), slots)

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def told(requests: DataFrame, level: int) -> DataFrame:
        """What a level says to every block; what it found goes. The first level's is read alone and kept by block, as the blocks are.

        Later ones are not: a union of tables in buckets has more partitions than the blocks that it is to meet.
        """
        found = _level(requests)
        release(spark)
        out = _answers(found, level)
        out = stage_by(out.repartition(buckets, "block"), "block") if level == 1 else stage(out)
        drop_stage(found)
        release(spark)
        return out

    answers = told(packed.select(*columns).mapInArrow(first, _REQUEST), 1)

    no_request = _nothing(_REQUEST)

    def deeper(left: pa.Table, right: pa.Table) -> pa.Table:
        """Requests of the next level, behind the last one answered."""
        out = []
        for r in left.to_pylist():
            b = _Block(r, n, v)
            for states in _states(right)[: int(r["level"]) - 1]:
                b.apply(states)
                b.deepen()
            out.extend(_send(r["block"], b, slots))
        return pa.Table.from_batches(out) if out else no_request

    for level in range(2, DEPTH + 1):
        ready = packed.select(*columns, F.lit(level).alias("level"))
        answers = answers.unionByName(told(ready.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(deeper, _REQUEST), level))

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.select(columns).to_pylist():
            b = _Block(r, n, v)
            for states in _states(right):
                b.apply(states)
                b.deepen()
            keys = left.column("keys").combine_chunks()
            keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
            start = b.lens.cumsum() - b.lens
            add = lambda x: np.add.reduceat(x, start)
            out.append(pa.Table.from_arrays(
                [keys.flatten(), pa.array(b.lens), pa.array(add(b.known().astype(np.int64))), pa.array(np.full(len(start), n, np.int64)),
                 pa.array(add(np.log10(b.root()))), pa.array(add(np.log10(b.p)))], ["k", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out) if out else no_result

    result = f"k {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    no_result = _nothing(result)
    scored = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(last, result)
    return scored.withColumnRenamed("k", key)


def _nothing(schema: str) -> pa.Table:
    """An empty table, made on the driver."""
    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()
