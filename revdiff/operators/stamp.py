"""Fields of a document from the lines of its stamp, nearest surroundings first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff import rules
from revdiff.functions import fields as X
from revdiff.functions import text as T

#: Parts of a page that lines come from: the stamp, its wider surroundings, the lower right corner.
PARTS = (0, 1, 2)


def document_fields(lines: DataFrame, word_mass: DataFrame | None = None) -> DataFrame:
    """doc_id, number, number_part, number_tier, mass_kg, scale: one row per document that has lines.

    lines: doc_id, page_num, part, ord, line. Each field is the least candidate by (part, kind, page, line): the stamp before its surroundings, and
    within a part the number patterns in their order, a glued number last. The number's suffix may come from any line of its part. A line that sends the reader to a
    table gives no mass, and the corner gives none if any of its lines does. `word_mass` (doc_id, mass_kg) comes before the corner.
    A field is read within one line. One aggregate, combined before the shuffle; nothing of a document is gathered.
    """
    clean = T.strip_control(F.col("line"))
    patterns = [T.squeeze(X.first_pattern(clean, (p,))) for p in X.NUMBER_PATTERNS]
    glued = F.nullif(F.trim(F.concat_ws(" ", X.extract(clean, X.GLUED_NUMBER, 1), X.extract(clean, X.GLUED_NUMBER, 2))), F.lit(""))
    by_table = T.contains_any(F.replace(F.lower(T.squeeze(clean)), F.lit(" "), F.lit("")), rules.MASS_BY_TABLE_MARKERS)
    low = F.lower(clean)
    suffix = F.coalesce(*[F.when(low.rlike(f"{X.EDGE_L}{s.lower()}{X.EDGE_R}"), i) for i, s in enumerate(rules.SUFFIXES)])
    place = ["page_num", "ord"]
    found = lines.withColumns({"__n": F.array(*patterns, glued), "__s": suffix, "__t": by_table, "__m": X.mass_of(F.col("line")), "__c": X.scale_of(clean)})

    def number(tier: int) -> Column:
        value = F.col("__n")[tier]
        return F.when(value.isNotNull(), F.struct(F.col("part").alias("part"), F.lit(tier).alias("tier"), *place, value.alias("value")))

    def least(value: Column, where: Column | None = None) -> Column:
        given = value.isNotNull() if where is None else value.isNotNull() & where
        return F.min(F.when(given, F.struct("part", *place, value.alias("value"))))["value"]

    number_of = F.least(*[F.min(number(t)) for t in range(len(patterns) + 1)])
    out = found.groupBy("doc_id").agg(
        number_of.alias("n"), *[F.min(F.when(F.col("part") == p, F.col("__s"))).alias(f"s{p}") for p in PARTS],
        least(F.col("__m"), F.col("part") < 2).alias("near"), least(F.col("__m"), F.col("part") == 2).alias("corner"),
        F.coalesce(F.bool_or(F.when(F.col("part") == 2, F.col("__t"))), F.lit(False)).alias("to_table"), least(F.col("__c")).alias("scale"))
    names = F.array(*map(F.lit, rules.SUFFIXES))
    own = F.get(names, F.coalesce(*[F.when(F.col("n.part") == p, F.col(f"s{p}")) for p in PARTS]))
    out = out.withColumn("suffix", own).withColumn("words", F.lit(None).cast("double"))
    if word_mass is not None:
        out = out.drop("words").join(word_mass.select("doc_id", F.col("mass_kg").cast("double").alias("words")), "doc_id", "left")
    return out.select("doc_id", X.normalize_number(F.col("n.value"), F.lit(""), F.col("suffix")).alias("number"), F.col("n.part").alias("number_part"), F.col("n.tier").alias("number_tier"),
                      F.coalesce("near", "words", F.when(~F.col("to_table"), F.col("corner"))).alias("mass_kg"), "scale")


def titles(lines: DataFrame, docs: DataFrame, starts=rules.TITLE_STARTS) -> DataFrame:
    """O2: doc_id, title, part, tier: the likeliest title among a document's lines.

    lines: doc_id, part, ord, x0, line; docs: doc_id, number, doc_type, page_width. The stamp's lines come before its surroundings. Tier 3 is a short line with a known
    start, the longest in letters; tier 2 what follows the head's last word; tier 1 what is left of a line in the right of the page once scale, mass, letter and
    service text are taken off, by its Cyrillic letters and number of words. Lines with the document's own number, type or a service word are none; of equals the first stays.
    """
    text = T.norm_cell(F.col("line"))
    own = F.replace(F.coalesce("number", F.lit("")), F.lit(" "), F.lit(""))
    kind = F.lower(F.coalesce("doc_type", F.lit(rules.TYPE_UNKNOWN)))
    services = tuple(w.replace(" ", "") for w in rules.STAMP_SERVICE_WORDS)

    def letters(c: Column) -> Column:
        return F.regexp_count(c, F.lit("[А-Яа-яA-Za-z]"))

    def tight(c: Column) -> Column:
        return F.replace(c, F.lit(" "), F.lit(""))

    def names_itself(c: Column) -> Column:
        return (own != "") & F.contains(tight(c), own)

    def is_type(low: Column) -> Column:
        return (kind != F.lower(F.lit(rules.TYPE_UNKNOWN))) & F.contains(low, kind)

    tail = T.norm_cell(F.regexp_extract("line", f"(?iu){X.EDGE_L}Дата\\s+(.+)$", 1))
    rest = F.regexp_replace(F.col("line"), f"({X.EDGE_L}){X.SCALE}(?=$|[^{T.WORD}])", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, rules.STAMP_MASS, ""), rules.LETTER_LABEL, "")
    for pattern in rules.STAMP_TAILS:
        rest = F.regexp_replace(rest, pattern, "$1")
    staged = lines.join(docs.select("doc_id", "number", "doc_type", "page_width"), "doc_id").withColumns({"text": text, "tail": tail, "rest": T.norm_cell(rest)})
    low, low_tail, low_rest = (F.lower(F.col(c)) for c in ("text", "tail", "rest"))
    known = (low.rlike("^(?:" + "|".join(starts) + f")(?:$|[^{T.WORD}])") & (F.char_length("text") <= 40) & ~names_itself(F.col("text")) & ~T.contains_any(low, rules.TITLE_BANNED))
    follows = ((letters(F.col("tail")) >= 3) & ~F.col("tail").rlike(f"{X.EDGE_L}{X.SCALE}{X.EDGE_R}") & ~names_itself(F.col("tail")) & ~is_type(low_tail)
               & ~T.contains_any(tight(low_tail), services) & ~T.contains_any(low_tail, rules.TITLE_TAIL_BANNED))
    words = F.size(F.split("rest", " "))
    score = F.regexp_count("rest", F.lit("[А-Яа-я]")) * 3 + F.greatest(F.lit(0), 15 - F.abs(words - 2) * 4) + F.when(words <= 4, 10).otherwise(0)
    left_over = (F.char_length("rest").between(3, 50) & (F.col("x0") >= F.col("page_width") * 0.72) & ~T.contains_any(tight(low_rest), services) & ~names_itself(F.col("rest"))
                 & ~is_type(low_rest) & ~F.col("rest").rlike(r"^[A-ZА-Я0-9.\- ]+$") & ~F.contains("rest", F.lit(",")) & ~T.contains_any(low_rest, rules.TITLE_BANNED) & (letters(F.col("rest")) >= 3))

    def candidate(tier: int, points: Column, title: Column) -> Column:
        return F.struct((-F.col("part")).alias("part"), F.lit(tier).alias("tier"), points.cast("int").alias("score"), (-F.col("ord")).alias("ord"), title.alias("title"))

    best = F.when(known, candidate(3, 200 + letters(F.col("text")), F.col("text"))).when(follows, candidate(2, F.lit(100), F.col("tail"))).when(left_over, candidate(1, score, F.col("rest")))
    won = staged.groupBy("doc_id").agg(F.max(best).alias("b")).filter("b is not null")
    title = F.regexp_replace(F.regexp_replace("b.title", f"(?iu)({X.EDGE_L})См\\.?\\s*ТТ(?=$|[^{T.WORD}])", "$1"), r"\s+[ОO]$", "")
    return won.select("doc_id", T.strip(title, " ,;:-").alias("title"), (-F.col("b.part")).alias("part"), F.col("b.tier").alias("tier"))
