"""Token counts: a proven whole-token table first, the merge procedure for the rest.

The tokenizer is a byte-pair model over text whose blanks become the mark U+2581, with one mark put
in front. No piece holds a mark behind another character, so no merge crosses the place before a mark
that follows a letter; and no piece holds a line feed, so each line feed is one byte token by itself.
Both are checked on the vocabulary when the table is built. A text is therefore a sequence of
pre-tokens counted one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff.llm.common import as_bytes

MARK = "▁"
#: Pre-tokens remembered in one task beyond the proven table.
MEMO = 400_000


@lru_cache(maxsize=2)
def whole_tokens(model: str) -> tuple[object, dict[str, int]]:
    """(processor, {pre-token: 1}) for the vocabulary strings that encode alone as exactly one token.

    Raises if the vocabulary would let a merge cross a pre-token boundary.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in plain):
        raise ValueError("a piece crosses a pre-token boundary; this vocabulary needs another split")
    if "".join(sp.encode(" a  b", out_type=str)) != MARK * 2 + "a" + MARK * 2 + "b":
        raise ValueError("this model drops blanks or adds no mark; pre-tokens would not add up")
    # only pieces that begin with the mark are pre-tokens at a word start; the model puts one mark in front itself
    words = [p[1:] for p in plain if p.startswith(MARK) and p.strip(MARK)]
    proven = {w: 1 for w, ids in zip(words, sp.encode(words), strict=True) if len(ids) == 1}
    return sp, proven


def counter(model: str):
    """A function from texts to their token counts, with a bounded memo of the counts of pre-tokens."""
    sp, proven = whole_tokens(model)
    known = dict(proven)
    runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def spans(text: str) -> int:
        """Texts with repeated blanks: pre-tokens are a run of marks and what follows it.

        Encoded alone, a pre-token gets the model's own mark in front, so one is taken off first; a mark alone is one token.
        """
        parts = [p[1:] for p in runs.findall(MARK + text.replace(" ", MARK))]
        return sum(len(x) or 1 for x in sp.encode(parts, num_threads=1))

    def count(texts: list[str]) -> list[int]:
        if len(known) > MEMO + len(proven):
            known.clear()
            known.update(proven)
        plans, wanted = [], set()
        for text in texts:
            total, words = 0, []
            if text:
                lines = text.replace(MARK, " ").split("\n")
                total = len(lines) - 1
                for i, line in enumerate(lines):
                    if i:
                        # what follows a line feed has no mark in front: it merges by itself up to the next blank
                        head, blank, line = line.partition(" ")
                        if head:
                            total += _bare(sp, head, bare)
                        if not blank:
                            continue
                    if "  " in line or line[:1] == " " or line[-1:] == " " or not line:
                        total += spans(line)
                    else:
                        words += line.split(" ")
                wanted.update(words)
            plans.append((total, words))
        fresh = list(wanted.difference(known))
        known.update(zip(fresh, map(len, sp.encode(fresh, num_threads=1)), strict=True))
        return [total + sum(map(known.__getitem__, words)) for total, words in plans]

    bare: dict[str, int] = {}
    return count


def _bare(sp, head: str, memo: dict[str, int]) -> int:
    """Tokens of a pre-token without a mark: put behind a line feed, which no merge crosses, so that the model adds its mark before that."""
    n = memo.get(head)
    if n is None:
        if len(memo) > MEMO:
            memo.clear()
        n = memo[head] = len(sp.encode("\n" + head)) - _lead(sp)
    return n


@lru_cache(maxsize=2)
def _lead(sp) -> int:
    return len(sp.encode("\n"))


def count_tokens(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts equal the model's own encoding of the whole text without begin and end tokens. A null text
    counts as empty: no bytes, no tokens. Any key, null or repeated, is carried through as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count(b.column(2).to_pylist()), pa.int64())], ["k", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    body: Column = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("k"), F.octet_length(as_bytes(F.col(text))).cast("long").alias("n_bytes"), body.alias("t"))
    out = slim.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
