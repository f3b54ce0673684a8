"""Text normalisation, comparison keys and token sets."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from revdiff import rules

# Unicode white space, spelt out so that Java, RE2 and Python agree on it
WS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LETTER = "A-Za-zА-Яа-яЁё"
WORD = LETTER + "0-9_"


# ---- fixed values: typographic variants and what they are read as ---------------------------
TYPOGRAPHIC = ("\uFFF3\u2013\u2014\u00AB\u00BB\u200B", "---\"\"")


def let(value: Column, use) -> Column:
    """`use(value)` with the value worked out once, also inside lambdas, where Spark shares nothing."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column, chars: str = WS_CHARS) -> Column:
    return F.btrim(c, F.lit(chars))


def _one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "  +", " "))


def squeeze(c: Column) -> Column:
    """Every white-space run becomes one space; ends trimmed."""
    return _one_space(F.translate(c, WS_CHARS, " " * len(WS_CHARS)))


def typographic(c: Column) -> Column:
    """One dash, one quote; zero-width spaces dropped."""
    return F.translate(c, *TYPOGRAPHIC)


def norm_cell(c: Column) -> Column:
    wanted = TYPOGRAPHIC[1] + " " * len(WS_CHARS)
    return _one_space(F.translate(F.coalesce(c, F.lit("")), TYPOGRAPHIC[0][:5] + WS_CHARS + TYPOGRAPHIC[0][5], wanted))


def norm_or_null(c: Column) -> Column:
    return F.nullif(squeeze(c), F.lit(""))


def strip_control(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[\x00-\x1F\x7F]", ""))


def unify_line_ends(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\r\n|\r", "\n"))


def sentence(c: Column) -> Column:
    text = squeeze(F.coalesce(c, F.lit("")))
    return F.when((text == "") | text.rlike(r"[.;:!?]$"), text).otherwise(F.concat(text, F.lit(".")))


def strip_period(c: Column) -> Column:
    return strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\.+$", ""))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def shorten(c: Column, limit: int = 1200) -> Column:
    text = squeeze(c)
    cut = F.concat(F.regexp_replace(F.left(text, F.lit(limit - 3)), WS + "+$", ""), F.lit("..."))
    return F.when(F.char_length(text) <= limit, text).otherwise(cut)


def fold_lookalikes(c: Column, table: tuple[str, str] = rules.LOOKALIKE_COMPARE) -> Column:
    return F.translate(c, table[0], table[1])


def compare_key(c: Column) -> Column:
    """Null-safe key under which two texts count as equal."""
    found = TYPOGRAPHIC[0][:5] + "\u2212" + rules.LOOKALIKE_COMPARE[0] + WS_CHARS + TYPOGRAPHIC[0][5]
    wanted = TYPOGRAPHIC[1] + "-" + rules.LOOKALIKE_COMPARE[1] + " " * len(WS_CHARS)
    plain = F.translate(F.coalesce(c, F.lit("")), found, wanted)
    return F.lower(_one_space(F.regexp_replace(plain, " *- *", "-")))


def compact(c: Column) -> Column:
    """Lower case without any white space, ё read as е."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё" + WS_CHARS, "е")


def lower_plain(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")


def key_tokens(key: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Distinct words of four or more characters of a comparison key."""
    words = F.array_distinct(F.regexp_extract_all(key, F.lit("([а-яa-z0-9]{4,})"), F.lit(1)))
    return F.array_except(words, F.array(*map(F.lit, stop_words))) if stop_words else words


def contains_any(c: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in markers])


def count_hits(c: Column, markers) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(m)).cast("int") for m in markers])


def starts_with_any(c: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(c, F.lit(p)) for p in prefixes])


# ---- quantities and positions (F16) ---------------------------------------------------------

def space_units(c: Column) -> Column:
    """A space between a digit and the letter after it, everywhere."""
    return F.nullif(squeeze(F.regexp_replace(norm_cell(c), "([0-9])([A-Za-zА-Яа-я])", "$1 $2")), F.lit(""))


def space_last_unit(c: Column) -> Column:
    """A space before the unit that closes the text."""
    return F.regexp_replace(squeeze(c), "([0-9])([а-яА-Яa-zA-Z]+)$", "$1 $2")


def split_positions(c: Column) -> Column:
    """Comma list of position designations as an array, first spelling of each kept."""
    plain = F.translate(norm_or_null(c), "\u2013\u2014\u2212", "---")
    parts = F.transform(F.split(plain, f"{WS}*,{WS}*"), lambda p: strip(p, " ;"))
    return F.filter(F.array_distinct(parts), lambda p: p != "")


def number_text(c: Column) -> Column:
    """Six significant digits, no trailing zeros, decimal comma."""
    size = F.abs(c)
    value = F.bround(c, 9)
    for digits in range(8, -1, -1):
        value = F.when(size >= 10.0 ** (5 - digits), F.bround(c, digits)).otherwise(value)
    plain = F.regexp_replace(value.cast("decimal(28,10)").cast("string"), r"\.?0+$", "")
    exp = F.floor(F.log10(size))
    mantissa = F.regexp_replace(
        F.bround(c / F.pow(F.lit(10.0), exp), 5).cast("decimal(12,6)").cast("string"), r"\.?0+$", "")
    scientific = F.concat(mantissa, F.lit("e"), F.when(exp < 0, "-").otherwise("+"),
                          F.lpad(F.abs(exp).cast("string"), 2, "0"))
    text = F.when(c == 0, F.lit("0")).when((size >= 1e6) | (size < 1e-4), scientific).otherwise(plain)
    return F.replace(text, F.lit("."), F.lit(","))


# ---- requirement topics (F18) ---------------------------------------------------------------

def first_matching(c: Column, table) -> Column:
    """Value of the first rule whose marker occurs in the text, else null."""
    hit = F.lit(None).cast("string")
    for marker, value in reversed(table):
        hit = F.when(F.contains(c, F.lit(marker)), F.lit(value)).otherwise(hit)
    return hit


def summarize(c: Column, table=rules.REQUIREMENT_TOPICS) -> Column:
    def of(clean: Column) -> Column:
        def judge(low: Column) -> Column:
            short = (F.char_length(clean) <= 90) & ~contains_any(low, rules.TOPIC_TEXT_STOPS)
            return F.coalesce(first_matching(low, table), F.when(short, clean), F.lit(rules.TOPIC_DEFAULT))

        return let(F.lower(clean), judge)

    return (F.when(F.coalesce(c, F.lit("")) == "", F.lit(rules.TOPIC_EMPTY))
            .otherwise(let(F.regexp_replace(squeeze(c), r"\.+$", ""), of)))


def is_good_topic(c: Column) -> Column:
    def judge(low: Column) -> Column:
        return ((low != "") & ~contains_any(low, ("...", "…")) & (F.char_length(low) <= 90)
                & ~starts_with_any(low, rules.TOPIC_BAD_STARTS) & ~contains_any(low, rules.TOPIC_BAD_PARTS))

    return let(F.lower(squeeze(F.coalesce(c, F.lit("")))), judge)


def topic_of(*texts: Column, table=rules.REQUIREMENT_TOPICS) -> Column:
    """Topic of the first text that yields a usable one."""
    def pick(text: Column) -> Column:
        return let(summarize(text, table), lambda t: F.when(is_good_topic(t), lower_first(strip_period(t))))

    return F.coalesce(*map(pick, texts), F.lit(rules.TOPIC_DEFAULT))


def about(c: Column) -> Column:
    """Topic with its preposition."""
    first = F.lower(F.left(c, F.lit(1)))
    return F.when(c == "", "").otherwise(
        F.concat(F.when(first.isin(*rules.VOWELS), F.lit("об ")).otherwise(F.lit("о ")), c))


# ---- wrong encodings (F1) -------------------------------------------------------------------

def _page(name: str) -> dict[str, int]:
    """Characters of a one-byte code page and their bytes."""
    return {c: b for b in range(256) if (c := bytes([b]).decode(name, "ignore"))}


def _as_latin(c: Column, page: dict[str, int]) -> Column:
    """The bytes of a text in a code page, each as the character of that number; what the page lacks is left out."""
    moved = {ch: chr(b) for ch, b in page.items() if ord(ch) != b}
    known = F.regexp_replace(c, "[^" + "".join(f"\\x{{{ord(ch):X}}}" for ch in page) + "]", "")
    return F.translate(known, "".join(moved), "".join(moved.values())) if moved else known


def _cyrillic(latin: Column) -> Column:
    """Bytes, given as characters, in the Cyrillic one-byte page."""
    upper = {chr(b): bytes([b]).decode("cp1251", "ignore") for b in range(128, 256)}
    gone = "".join(k for k, v in upper.items() if not v)
    return F.translate(latin, "".join(k for k, v in upper.items() if v) + gone, "".join(upper.values()))


def _unicode(latin: Column) -> Column:
    """Bytes, given as characters, as UTF-8; bytes that are none are left out."""
    return F.translate(F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string")), "\uFFFD", "")


def repair_encoding(c: Column | str) -> Column:
    """The reading of a text that looks most Cyrillic: as it is, from a wrong code page, or backwards.

    A code page is a map of characters, so it does not matter whether a text is turned round before or after; UTF-8 takes several bytes for a character, and
    there both orders are tried. Readings are ranked by the hint words that they hold, then by Cyrillic characters, then by letters and digits; the
    first of equals is taken, which for a text of ASCII characters is the text itself.
    """
    text = F.translate(typographic(F.col(c) if isinstance(c, str) else c), "\u00A0", " ")

    def readings(t: Column) -> list[Column]:
        back = F.reverse(t)
        out = [t]
        mapped, decoded = [], []
        for name in ("latin1", "cp1252"):
            page = _page(name)
            out += [_unicode(_as_latin(t, page)), _cyrillic(_as_latin(t, page))]
            mapped.append(out[-1])
            decoded.append(_unicode(_as_latin(back, page)))
        return [*out, back, *decoded, *map(F.reverse, mapped), *[F.reverse(out[1]), F.reverse(out[3])], *map(F.reverse, decoded)]

    def ranked(t: Column) -> Column:
        def rank(reading: Column, place: Column) -> Column:
            low = F.lower(reading)
            hints = F.size(F.filter(F.array(*map(F.lit, rules.ENCODING_HINTS)), lambda h: F.contains(low, h)))
            return F.struct(hints.alias("hints"), F.regexp_count(reading, F.lit("[А-Яа-яЁё]")).alias("cyrillic"),
                            F.regexp_count(reading, F.lit("[A-Za-zА-Яа-яЁё0-9]")).alias("plain"), (-place).alias("place"), reading.alias("reading"))

        return F.array_max(F.transform(F.array(*readings(t)), rank))["reading"]

    best = F.when(text.rlike(r"[^\x00-\x7F]"), let(text, ranked)).otherwise(text)
    return strip(F.regexp_replace(F.regexp_replace(best, "[ \t]+", " "), " ?\n ?", "\n"))


# ---- Python-side helper (F17) ---------------------------------------------------------------

def _ratios(old: pd.Series, new: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity; order matters, so (old, new). Null where a side is null."""
    from difflib import SequenceMatcher

    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(old, new)], dtype="float64")


# marked non-deterministic so that a filter on the result is not pushed below it, which would
# compare every pair again
sequence_ratio = F.pandas_udf(_ratios, DoubleType()).asNondeterministic()
