"""Language by compression: the language whose raw-content dictionary compresses a text best.

A text is lower-cased, everything in it that is no letter becomes a blank, and it is compressed in
pieces of PIECE bytes with each language's dictionary. Small pieces keep the dictionary, not the
text's own past, in charge however long the text is. The smallest total wins; the margin to the
second decides whether the answer is accepted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revdiff.llm.common import keep_rows

#: Bounds of the fit: languages (the most frequent ones), documents a language and bytes a document in its dictionary.
LANGUAGES, SAMPLE_DOCS, SAMPLE_BYTES = 256, 192, 1024
PIECE = 4096
#: Compression levels: texts of at most one SHORT get the thorough search, which finds matches of three bytes.
LEVEL, SHORT_LEVEL, SHORT, TAIL = 3, 19, 1024, 512
#: Narrowest accepted margin, in bytes a piece.
MARGIN = 1.0

_BLANK = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split())


def fit(docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary bytes, most frequent language first, from a bounded sample of the rows where `learn` holds.

    The documents of a language with the smallest hashes are taken; each gives a slice of at most SAMPLE_BYTES.
    Rows with a null text, language or key are not learned from. No rows: an empty model.
    """
    usable = docs.filter(learn & F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.length(text) > 0))
    top = [r[0] for r in usable.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(LANGUAGES).collect()]
    first = Window.partitionBy("g").orderBy("h", "k")
    # ranked on hashes alone; a rank limit is applied in the map tasks, so a frequent language costs no more
    picked = (usable.filter(F.col(lang).isin(top)).select(F.col(lang).alias("g"), F.col(key).alias("k"), F.xxhash64(key).alias("h"))
              .withColumn("r", F.row_number().over(first)).filter(F.col("r") <= SAMPLE_DOCS).select("g", "k", "h"))
    rows = (usable.select(F.col(lang).alias("g"), F.col(key).alias("k"), F.substring(text, 1, SAMPLE_BYTES).alias("t"))
            .join(F.broadcast(picked), ["g", "k"]).groupBy("g", "k").agg(F.max("t").alias("t"), F.max("h").alias("h")).collect())
    model: dict[str, bytes] = {g: b"" for g in top}
    for r in sorted(rows, key=lambda r: (r["g"], r["h"], r["k"])):
        model[r["g"]] += plain(r["t"]) + b" "
    return model


def classifier(model: dict[str, bytes]):
    """A function from texts to (language or None, score, margin in bytes a piece)."""
    import zstandard as zs

    names = list(model)

    def pack(name: str, level: int):
        # a dictionary of fewer than 8 bytes is none
        d = zs.ZstdCompressionDict(model[name].rjust(8), dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zs.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    tails = [model[n].rjust(8)[-TAIL:] for n in names]
    quick, thorough = ([pack(n, level) for n in names] for level in (LEVEL, SHORT_LEVEL))

    def classify(texts: list[str | None]) -> list[tuple[str | None, float, float]]:
        out = []
        for text in texts:
            if not names or not text or not any(map(str.isalpha, text)):
                out.append((None, 0.0, 0.0))
                continue
            raw = plain(text)
            pieces = [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)] or [b""]
            if len(raw) <= SHORT:
                # behind the dictionary's own end every block is compressible: what the text saves shows to the byte
                sizes = [len(p.compress(t + raw)) for p, t in zip(thorough, tails, strict=True)]
            else:
                sizes = [sum(len(p.compress(x)) for x in pieces) for p in quick]
            best = sizes.index(min(sizes))
            rest = [s for i, s in enumerate(sizes) if i != best]
            margin = (min(rest) - sizes[best]) / len(pieces) if rest else float(PIECE)
            # each byte more is eight bits less likely; tempered to one bit, over the mean piece
            score = 1.0 / (1.0 + sum(2.0 ** -min(60.0, (s - sizes[best]) / len(pieces)) for s in rest))
            out.append((names[best], score if math.isfinite(score) else 1.0, margin))
        return out

    return classify


def identify(docs: DataFrame, model: dict[str, bytes], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, lang_pred, score (0 to 1), margin, accepted.

    `und` with score 0 where the text is null or has no letter, or the model is empty; never accepted.
    Equal sizes: the language learned from most documents, with margin 0, not accepted. Keys pass as they are.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(shared.value)
        for b in batches:
            got = classify(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] or "und" for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())],
                ["k", "lang_pred", "score", "margin"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double, margin double")
    return out.select(F.col("k").alias(key), "lang_pred", "score", "margin",
                      ((F.col("lang_pred") != "und") & (F.col("margin") >= MARGIN)).alias("accepted"))


def accepted(docs: DataFrame, model: dict[str, bytes], *, text: str = "text") -> DataFrame:
    """The rows with an accepted language, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def test():
        classify = classifier(shared.value)
        return lambda texts: [g[0] is not None and g[2] >= MARGIN for g in classify(texts)]

    return keep_rows(docs, text, None, lazy=test)
