"""Personal data: patterns first, then terms that give a protected value away.

Values found by patterns (mail and network addresses, card and phone numbers) are the protected entities. A term that stands near an entity reveals it
as far as the corpus shows: with c(e, t) places of t near e out of c(t) places in all, seeing t leaves -log2(c(e, t) / c(t)) bits of the
IC(e) = log2(N / c(e)) bits that the entity holds among all N terms. The share of IC(e) that t discloses is pointwise mutual information over
information content, 1 + log2(c(e, t) / c(t)) / IC(e). Near their entity, terms that disclose more than GENERALISE are replaced by their kind, those that
disclose more than REMOVE are taken out.

Evidence is counted in different surroundings: copies of one passage are one surrounding, so a text that is repeated a thousand times does
not turn its rare words into identifiers.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.staging import stage

KINDS = ("email", "ip", "card", "phone", "term")
#: Terms on each side of an entity that count as near.
NEAR = 8
#: Different surroundings in which a term must stand near an entity.
LEAST = 3
GENERALISE, REMOVE = 0.85, 0.95
#: Bits of the field of terms worth counting (1 MB); terms of a task's dictionary before it is sent.
FIELD, WORDS = 1 << 23, 1 << 19
#: Characters read on each side of an entity for its surroundings, at least; more where terms are long.
REACH = 256

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, in time that grows with the text: each @ is looked at once, from its own end."""
    start = 0
    for m in _DOMAIN.finditer(text):
        # an @ without a domain lies between; local parts never reach over one
        start = max(start, text.rfind("@", start, m.start()) + 1)
        before = text[start:m.start()]
        n = len(before) - len(before.rstrip(_LOCAL))
        if n:
            yield m.start() - n, m.end()
            start = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, ordered; matches that fail their test are dropped."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(kind: int, value: str) -> str:
    """What makes two spans the same entity: letters in lower case, numbers without their punctuation."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else _NOT_DIGIT.sub('', value)}"


def surroundings(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Terms within NEAR terms of each span, outside all spans: e, t, start, end, win (a hash of the surroundings)."""
    covered = sorted((s, e) for s, _, e in spans)
    merged: list[list[int]] = []
    for s, e in covered:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts = np.array([s for s, _ in merged])
    ends = np.array([e for _, e in merged])
    out = []
    for s, kind, e in spans:
        left = _side(text, s, -1, starts, ends)
        right = _side(text, e, 1, starts, ends)
        near = left + right
        words = [text[a:b].lower() for a, b in near]
        win = xxhash.xxh64_intdigest(f"{len(left)} {' '.join(words)}".encode(), 13) - 2**63
        name = entity(kind, text[s:e])
        out += [{"e": name, "t": w, "start": a, "end": b, "win": win} for w, (a, b) in zip(words, near, strict=True)]
    return out


def _side(text: str, at: int, way: int, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The NEAR terms before (way -1) or after `at`; the stretch read doubles until it holds them."""
    reach = REACH
    while True:
        lo, hi = (max(0, at - reach), at) if way < 0 else (at, min(len(text), at + reach))
        whole = lo == 0 if way < 0 else hi == len(text)
        found = [(m.start(), m.end()) for m in _TERM.finditer(text, lo, hi)]
        if not whole and found:
            # a term at the far edge may be cut
            found = found[1:] if way < 0 else found[:-1]
        clear = []
        for a, b in found:
            i = int(np.searchsorted(ends, a, side="right"))
            if i == len(starts) or starts[i] >= b:
                clear.append((a, b))
        if whole or len(clear) >= NEAR:
            return clear[-NEAR:] if way < 0 else clear[:NEAR]
        reach *= 4


SPANS = "array<struct<start:int,end:int,kind:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_NEAR_TYPE = pa.list_(pa.struct([("e", pa.string()), ("t", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("win", pa.int64())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (r, text) to (r, base, near)."""
    for b in batches:
        base, near = [], []
        for text in b.column(1):
            value = text.as_py()
            spans = base_spans(value) if value else []
            base.append([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in spans])
            near.append(surroundings(value, spans) if spans else [])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, _SPAN_TYPE), pa.array(near, _NEAR_TYPE)], ["r", "base", "near"])


def _term_counts(texts: DataFrame, field) -> DataFrame:
    """t, n: places of the terms in the field (and of some others); t is null in rows that count all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = field.value
        counts: Counter[str] = Counter()
        total = 0

        def send() -> pa.RecordBatch:
            lower: Counter[str] = Counter()
            for w, n in counts.items():
                lower[w.lower()] += n
            kept = [(w, n) for w, n in lower.items() if bits[(at := xxhash.xxh64_intdigest(w.encode(), 42) % FIELD) >> 3] >> (at & 7) & 1]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["t", "n"])

        for b in batches:
            for text in b.column(0):
                words = _TERM.findall(text.as_py())
                total += len(words)
                counts.update(words)
                if len(counts) > WORDS:
                    yield send()
                    counts.clear()
        yield send()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([total], pa.int64())], ["t", "n"])

    return texts.mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))


def disclosing(found: DataFrame, texts: DataFrame, *, least: int = LEAST, threshold: float = GENERALISE) -> DataFrame:
    """e, t, disclosure of all terms that disclose more than `threshold` of an entity near which they stand in `least` different surroundings.

    found: a staged frame with r, base and near; texts: one column of all texts.
    """
    spark = texts.sparkSession
    near = found.select("r", F.explode("near").alias("x")).select("r", "x.*")
    # a place of t near two mentions of e is one place
    places = near.groupBy("e", "t", "r", "start").agg(F.min("win").alias("win"))
    pairs = places.groupBy("e", "t", "win").agg(F.count("*").alias("n")).groupBy("e", "t").agg(F.sum("n").alias("c_et"), F.count("*").alias("ways"))
    pairs = stage(pairs.filter(F.col("ways") >= least).select("e", "t", "c_et"))
    at = F.pmod(F.xxhash64("t"), F.lit(FIELD)) + 1
    pieces = pairs.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    field = np.zeros((FIELD // 32768, 4096), np.uint8)
    for row in pieces.collect():
        field[row["b"] - 1] = np.frombuffer(row["m"], np.uint8)
    counts = stage(_term_counts(texts, spark.sparkContext.broadcast(field.tobytes())))
    total = counts.filter("t is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mentions = near.select("e", "r", "win").distinct().groupBy("e").agg(F.count("*").alias("c_e"))
    ic = F.log2(F.lit(float(max(total, 1))) / F.col("c_e"))
    known = pairs.join(counts.withColumnRenamed("n", "c_t"), "t").join(mentions, "e").filter(ic > 0)
    return known.select("e", "t", (1 + F.log2(F.col("c_et") / F.col("c_t")) / ic).alias("disclosure")).filter(F.col("disclosure") > threshold)


def find(docs: DataFrame, *, text: str = "text", least: int = LEAST, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """All columns of docs but the text, and spans: array of (start, end, kind, action), by start, then kind as in KINDS.

    Positions are code points, ends exclusive. Base spans have action `mask`; terms have `generalise` or `remove`. Null and empty texts have no spans;
    repeated rows are rows of their own; an input column named `spans` is replaced.
    """
    keep = [c for c in docs.columns if c not in (text, "spans")]
    value = F.col(text).cast("string")
    # rows are numbered once, in the staged frame; texts are not written again
    at = [F.col(c).alias(f"__in_{i}") for i, c in enumerate(keep)]
    numbered = docs.select(F.struct(F.monotonically_increasing_id().alias("id"), *at).alias("r"), value.alias("text"))
    head = numbered.schema["r"].dataType.simpleString()
    found = stage(numbered.mapInArrow(_find, f"r {head}, base {SPANS}, near array<struct<e:string,t:string,start:int,end:int,win:bigint>>"))
    slim = found.select("r.id", "base", "near").withColumnRenamed("id", "r")
    terms = disclosing(slim, docs.select(F.coalesce(value, F.lit("")).alias("text")), least=least, threshold=generalise)
    near = slim.select("r", F.explode("near").alias("x")).select("r", "x.e", "x.t", "x.start", "x.end")
    action = F.when(F.max("disclosure") > remove, "remove").otherwise("generalise")
    added = near.join(terms, ["e", "t"]).groupBy("r", "start", "end").agg(action.alias("action"))
    added = added.groupBy("r").agg(F.collect_list(F.struct("start", "end", F.lit("term").alias("kind"), "action")).alias("added"))
    mask = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit("mask").alias("action")))
    joined = found.select(*[F.col(f"r.__in_{i}").alias(c) for i, c in enumerate(keep)], F.col("r.id").alias("__r"), mask.alias("__base"))
    joined = joined.join(added.withColumnRenamed("r", "__r"), "__r", "left")
    rank = F.array(*[F.lit(k) for k in KINDS])
    both = F.when(F.col("added").isNull(), F.col("__base")).otherwise(F.concat("__base", "added"))
    order = F.transform(both, lambda s: F.struct(s["start"].alias("a"), F.array_position(rank, s["kind"]).alias("b"), s.alias("s")))
    spans = F.transform(F.array_sort(order), lambda o: o["s"])
    return joined.select(*keep, spans.alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def clean(docs: DataFrame, spans: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """docs with their texts sanitised: base spans become [EMAIL] and so on, terms [TERM] or nothing. `key` tells rows apart and is not null.

    Where spans overlap, their union is replaced once, under the first one's name.
    """
    todo = spans.filter(F.size("spans") > 0).select(F.col(key), F.col("spans").alias("__spans"))
    joined = docs.join(todo, key, "left")
    at = joined.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_replace(t.as_py(), s.as_py()) for t, s in zip(b.column(at), b.column(b.num_columns - 1), strict=True)]
            cols = b.columns[:-1]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return joined.mapInArrow(run, joined.drop("__spans").schema).select(*docs.columns)


def _replace(text: str | None, spans: list[dict] | None) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out.append(text[at:s["start"]])
            out.append("" if s["action"] == "remove" else f"[{s['kind'].upper()}]")
        at = s["end"]
    return "".join([*out, text[at:]])


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans (text form)."""
    found = find(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), text="__text")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = digest(F.filter("spans", lambda s: s["kind"] != "term"))
    return found.select(F.col("__key").alias(key), *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
