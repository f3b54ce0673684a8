"""Field extraction and cleaning for document headers, items and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revdiff import rules
from revdiff.functions import text as T

# word edges spelt out: \b knows only ASCII letters
EDGE_L, EDGE_R = f"(?:^|[^{T.WORD}])", f"(?:$|[^{T.WORD}])"

# ---- fixed values: document-number patterns, tried in this order ----------------------------
_SUFFIX = r"(?:\s?(?:СБ|СП|Э4|ПЭ4|ТУ|ВО|МЧ))?"
NUMBER_PATTERNS = (
    r"[A-ZА-ЯЁ]{1,10}\.\d{3}\.\d{2}\.\d{2}\.\d{2}\.\d{3}" + _SUFFIX,
    r"\d{3}\.\d{2}\.\d{2}\.\d{2}\.\d{3}" + _SUFFIX,
    r"[A-ZА-ЯЁ]{1,10}(?:[.\-]\d{2,5}){3,8}" + _SUFFIX,
)
GLUED_NUMBER = r"(?iu)(?:^|[^0-9])\d?(\d{3}\.\d{2}\.\d{2}\.\d{2}\.\d{3})(?:\s*(СБ|СП|ПЭ4|Э4))?"
NUMBER_PARTS = r"(?iu)((?:[А-ЯA-ZЁ]{1,10}\.)?\d{3}(?:\.\d{2,5}){4,5})(?:\s*(СБ|СП|ПЭ4|Э4))?"
SCALE = r"(\d+\s*:\s*\d+)"
MASS_BEFORE_SCALE = r"(\d+[.,]\d+)\s+(1\s*:\s*\d+)"


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract with null for no match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_pattern(c: Column, patterns, flags: str = "(?iu)") -> Column:
    """First hit of the first pattern that occurs, as a whole word."""
    return F.coalesce(*[extract(c, f"{flags}{EDGE_L}({p}){EDGE_R}") for p in patterns])


def stamp_suffix(stamp: Column) -> Column:
    low = F.lower(stamp)
    out = F.lit(None).cast("string")
    for s in reversed(rules.SUFFIXES):
        out = F.when(low.rlike(f"{EDGE_L}{s.lower()}{EDGE_R}"), F.lit(s)).otherwise(out)
    return out


def normalize_number(value: Column, stamp: Column, suffix: Column | None = None) -> Column:
    """Base and suffix of a document number; the suffix may come from the stamp."""
    v = T.squeeze(T.strip_control(value)) if suffix is None else value
    base, own = extract(v, NUMBER_PARTS, 1), F.upper(extract(v, NUMBER_PARTS, 2))
    suffix = stamp_suffix(stamp) if suffix is None else suffix
    known = F.concat_ws(" ", base, F.coalesce(own, suffix))
    other = F.when(suffix.isNotNull() & ~F.endswith(v, F.concat(F.lit(" "), suffix)),
                   F.trim(F.concat_ws(" ", v, suffix))).otherwise(F.nullif(v, F.lit("")))
    return F.when(F.coalesce(value, F.lit("")) == "", None).when(base.isNotNull(), known).otherwise(other)


def document_number(c: Column) -> Column:
    """Normalised document number found in a text."""
    clean = T.strip_control(c)
    return normalize_number(raw_number(clean), clean)


def raw_number(clean: Column) -> Column:
    """First number pattern that occurs; failing all, a number glued to other characters."""
    glued = F.trim(F.concat_ws(" ", extract(clean, GLUED_NUMBER, 1), extract(clean, GLUED_NUMBER, 2)))
    return F.coalesce(T.squeeze(first_pattern(clean, NUMBER_PATTERNS)), F.nullif(glued, F.lit("")))


def with_document_number(df, text: str, out: str):
    """Add the document number found in a text column, each stage evaluated once."""
    return (df.withColumn("__clean", T.strip_control(F.col(text))).withColumn("__raw", raw_number(F.col("__clean")))
            .withColumn("__raw", T.squeeze(F.col("__raw"))).withColumn("__suffix", stamp_suffix(F.col("__clean")))
            .withColumn(out, normalize_number(F.col("__raw"), F.col("__clean"), F.col("__suffix")))
            .drop("__clean", "__raw", "__suffix"))


def suffix_of_type(doc_type: Column) -> Column:
    low = T.lower_plain(doc_type)
    return (F.when(F.contains(low, F.lit("сбороч")), "СБ")
            .when(F.contains(low, F.lit("схема электрическая соединений")), "Э4")
            .when(F.contains(low, F.lit("перечень элементов")), "ПЭ4"))


def ensure_suffix(number: Column, doc_type: Column) -> Column:
    v = T.norm_or_null(number)
    return (F.when(v.isNull() | v.rlike(r"(?iu)\s(?:СБ|Э4|ПЭ4|СП)$"), v)
            .otherwise(F.concat_ws(" ", v, suffix_of_type(doc_type))))


def base_number(number: Column) -> Column:
    """Upper-case number without its suffix."""
    return F.trim(F.regexp_replace(T.squeeze(F.upper(F.coalesce(number, F.lit("")))), r"(?u)\s+(СП|ПЭ4|СБ|Э4)$", ""))


def type_by_number(number: Column, fallback: Column) -> Column:
    up = F.upper(F.coalesce(number, F.lit("")))
    return (F.when(F.contains(up, F.lit("ПЭ4")), rules.TYPE_ELEMENTS)
            .when(F.contains(up, F.lit(" Э4")), rules.TYPE_WIRING)
            .when(F.contains(up, F.lit(" СБ")), rules.TYPE_ASSEMBLY)
            .when(F.contains(up, F.lit(" СП")), rules.TYPE_BOM)
            .otherwise(F.coalesce(F.nullif(fallback, F.lit("")), F.lit(rules.TYPE_BOM))))


def resolve_type(stamp: Column, number: Column, looks_like_bom: Column, looks_like_elements: Column,
                 looks_like_wiring: Column, known: Column) -> Column:
    """Stamp and number first, structure next, the type already known last."""
    low, num = F.lower(F.coalesce(stamp, F.lit(""))), F.coalesce(number, F.lit(""))

    def told(words, suffix):
        return F.contains(low, F.lit(words)) | F.endswith(num, F.lit(" " + suffix))

    return (F.when(told("сборочный чертеж", "СБ"), rules.TYPE_ASSEMBLY)
            .when(told("схема электрическая соединений", "Э4"), rules.TYPE_WIRING)
            .when(told("перечень элементов", "ПЭ4"), rules.TYPE_ELEMENTS)
            .when(told("спецификац", "СП"), rules.TYPE_BOM)
            .when(looks_like_bom, rules.TYPE_BOM)
            .when(looks_like_elements, rules.TYPE_ELEMENTS)
            .when(F.coalesce(F.nullif(known, F.lit("")), F.lit(rules.TYPE_UNKNOWN)) != rules.TYPE_UNKNOWN, known)
            .when(looks_like_wiring, rules.TYPE_WIRING)
            .otherwise(rules.TYPE_UNKNOWN))


# ---- scale, mass, sheets, change numbers (F9, F10) ------------------------------------------

def scale_of(c: Column) -> Column:
    return F.replace(extract(T.squeeze(c), f"{EDGE_L}{SCALE}{EDGE_R}"), F.lit(" "), F.lit(""))


def mass_of(c: Column) -> Column:
    """Decimal right before a 1:n scale, unless the text sends the reader to a table."""
    text = T.squeeze(T.strip_control(c))
    by_table = T.contains_any(F.replace(F.lower(text), F.lit(" "), F.lit("")), rules.MASS_BY_TABLE_MARKERS)
    number = F.replace(extract(text, MASS_BEFORE_SCALE), F.lit(","), F.lit("."))
    return F.when(~by_table, number.try_cast("double"))


def sheet_count(c: Column) -> Column:
    text = T.squeeze(c)
    return F.coalesce(
        extract(text, r"(?iu)Лист\s*Листов\s*(\d{1,3})\s+(\d{1,3})", 2),
        extract(text, r"(?iu)Лист\s*Листов\s*(\d{1,3})"),
        extract(text, r"(?iu)Листов\s*(\d{1,3})")).try_cast("int")


def sheet_status(c: Column) -> Column:
    token = T.strip(T.compact(c), ".:;,")
    return F.when(token.isin(*rules.STATUS_REPLACE), "replace").when(token.isin(*rules.STATUS_NEW), "new")


def change_number(c: Column) -> Column:
    text = T.strip(c)
    digits = extract(text, r"(\d{1,3})").try_cast("int").cast("string")
    return F.when(~text.rlike(r"^[-—–]+$"), digits)


def status_change_number(c: Column) -> Column:
    """Number glued to a status mark, as in `3Зам.`."""
    return extract(T.compact(c), r"^(\d{1,3})(зам|нов)\.?$").try_cast("int").cast("string")


# ---- paths into JSON, masking (P14, P15) -----------------------------------------------------

def first_path(c: Column, paths, clean=lambda v: v) -> Column:
    return F.coalesce(*[F.nullif(clean(F.get_json_object(c, p)), F.lit("")) for p in paths])


def resolve_change_number(c: Column, new_paths, old_paths) -> Column:
    """Number of the new version, else that of the old one plus one, else 1."""
    def digits(v):
        return F.when(~T.strip(v).rlike("^[-—]+$"), extract(v, r"(\d+)").try_cast("long").cast("string"))

    old = first_path(c, old_paths, digits).cast("long")
    return F.coalesce(first_path(c, new_paths, digits), (old + 1).cast("string"), F.lit("1"))


def is_sensitive(key: Column) -> Column:
    return T.contains_any(F.replace(F.lower(F.coalesce(key, F.lit(""))), F.lit("-"), F.lit("_")),
                          rules.SENSITIVE_KEY_PARTS)


def mask(value: Column, visible: int = 4) -> Column:
    """All but the last characters starred; short values whole."""
    n = F.char_length(value)
    tail = F.right(value, F.lit(visible)) if visible else F.lit("")
    return (F.when(value.isNull(), "")
            .when(n <= visible, F.repeat(F.lit("*"), n))
            .otherwise(F.concat(F.repeat(F.lit("*"), F.greatest(n - visible, F.lit(4))), tail)))


def mask_map(c: Column, visible: int = 4) -> Column:
    return F.transform_values(c, lambda k, v: F.when(is_sensitive(k), mask(v, visible)).otherwise(v))


def mask_assignments(c: Column, visible: int = 4) -> Column:
    """Mask quoted values assigned to a sensitive name inside running text."""
    parts = F.split(c, '"')
    name = "(?i)(?:" + "|".join(rules.SENSITIVE_KEY_PARTS) + r")[A-Za-z0-9_\-]* ?[:=] ?$"

    def one(part, i):
        told = F.when(i > 0, F.get(parts, i - 1).rlike(name)).otherwise(F.lit(False))
        return F.when(told, mask(part, visible)).otherwise(part)

    return F.array_join(F.transform(parts, one), '"')


# ---- items (F14, F15, P9) --------------------------------------------------------------------

def item_key(section: Column, position: Column, designation: Column, name: Column) -> Column:
    sec = F.lower(T.strip(F.coalesce(section, F.lit(""))))
    pos, des = (F.nullif(T.strip(c), F.lit("")) for c in (position, designation))
    nm = F.lower(T.strip(F.coalesce(name, F.lit(""))))
    anchor = F.when(sec == "документация", F.coalesce(des, nm)).otherwise(F.coalesce(pos, des, nm))
    return T.strip(F.concat_ws("|", sec, anchor), "|")


def element_key(positions: Column) -> Column:
    return F.regexp_replace(F.lower(T.norm_cell(positions)), T.WS + "+", "")


# ---- fixed values: tails of the title block that stick to the last row of a list -------------
FIELD_TAILS = (
    r"\s+\d{3}\.\d{2}\.\d{2}\.\d{2}\.\d{3}(?:$|[^A-Za-zА-Яа-яЁё0-9_]).*$",
    r"\s+(?:(?:АО|ООО|ПАО|ЗАО)\s*\"[^\"]*\"|Формат\s*A\d|Лист(?:ов)?(?:$|[^A-Za-zА-Яа-яЁё0-9_])|Лит\.|Изм\.|Зам\.|Нов\.).*$",
    r"\s+\.лбуд.*$", r"\s+\.мазв.*$", r"\s+\.лдоп.*$",
    r"\s+Жгут\s+\d{3}\.\d{2}-\d+.*$", r"\s+Кабель(?:$|[^A-Za-zА-Яа-яЁё0-9_]).*$",
)


#: What every tail begins with, in one pattern: a text without it has nothing to cut.
ANY_TAIL = "(?iu)" + r"\s(?:" + "|".join(t.removeprefix(r"\s+").removesuffix(".*$") for t in FIELD_TAILS) + ")"


def clean_field(c: Column) -> Column:
    def cut(text: Column) -> Column:
        short = text
        for tail in FIELD_TAILS:
            short = F.regexp_replace(short, "(?iu)" + tail, "")
        # a normalised cell is squeezed already
        return T.strip(F.when(text.rlike(ANY_TAIL), T.squeeze(short)).otherwise(text), " .;,:-/")

    return T.let(T.let(T.norm_cell(c), cut), lambda text: F.when(text != "", text))


# ---- fixed value: a designation broken off into the name -------------------------------------
SPLIT_DESIGNATION = r"(?iu)^(.+?ТМАРК-)\s*(\d{3}-\d{8}-\d{4})(?:\s+(.*))?$"


def rejoin_designation(designation: Column, name: Column) -> tuple[Column, Column]:
    """Designation and name after moving a broken-off number back."""
    broken = F.endswith(designation, F.lit("-")) & name.rlike(SPLIT_DESIGNATION)
    return (F.when(broken, F.concat(designation, F.regexp_extract(name, SPLIT_DESIGNATION, 2))).otherwise(designation),
            F.when(broken, clean_field(F.regexp_extract(name, SPLIT_DESIGNATION, 1))).otherwise(name))


def clean_item_name(c: Column) -> Column:
    def tidy(text: Column) -> Column:
        made = F.regexp_replace(text, "(?<=[A-Za-zА-Яа-я0-9])-\\s+(?=[A-Za-zА-Яа-я0-9])", "-")
        for pattern, value in ((r"\s*/\s*", "/"), (r"\s+\)", ")"), (r"\(\s+", "("), (r"\s+,", ",")):
            made = F.regexp_replace(made, pattern, value)
        # every pattern has one of these characters in it
        return F.when(text.rlike("[-/(),]"), made).otherwise(text)

    return T.let(T.strip(T.squeeze(F.coalesce(c, F.lit(""))), " .;:\"'«»"), tidy)


def has_garbage(c: Column) -> Column:
    def judge(low: Column) -> Column:
        new_row = F.contains(low, F.lit("нов.")) & low.rlike(EDGE_L + r"нов\.\s*\d") & ~T.contains_any(low, rules.GARBAGE_NEW_ROW_EXCEPTIONS)
        return (low != "") & (T.contains_any(low, rules.GARBAGE_MARKERS) | new_row)

    return T.let(F.lower(T.squeeze(F.coalesce(c, F.lit("")))), judge)


def is_bad_item_name(clean: Column) -> Column:
    """Of a cleaned name."""
    return has_garbage(clean) | (F.char_length(clean) < 2)


def is_plausible_quantity(c: Column) -> Column:
    def judge(qty: Column) -> Column:
        return (qty.rlike(r"^\d+(?:[,.]\d+)?\s*(?:м|мм|шт\.?|компл\.?|к-т)?$") & ~qty.rlike(r"^\d{2,}\.\d{2,}(?:\.\d+)?$")
                & ~has_garbage(qty))

    return T.let(F.lower(T.strip(T.space_last_unit(F.coalesce(c, F.lit(""))))), judge)


def item_drop_reason(section: Column, clean: Column, qty: Column) -> Column:
    """Why an added or removed item (name already clean) is not worth a note; null if it is."""
    def is_service(glued: Column) -> Column:
        tubing = F.contains(glued, F.lit("мцша")) & T.contains_any(glued, ("ттпок", "трубкатермоусаживаемая"))
        return F.startswith(glued, F.lit("нов.")) | T.contains_any(glued, ("зам.", "лбуд", "доп")) | tubing

    odd = ((F.coalesce(qty, F.lit("")) != "") & ~is_plausible_quantity(qty)
           & ~T.starts_with_any(F.lower(clean), rules.UNQUANTIFIED_NAMES))
    return (F.when(is_bad_item_name(clean), "name").when(has_garbage(section) | has_garbage(qty), "garbage")
            .when(T.let(F.replace(F.lower(clean), F.lit(" "), F.lit("")), is_service), "service row").when(odd, "quantity"))


def change_drop_reason(section: Column, clean: Column, field: Column, old: Column, new: Column) -> Column:
    """Why a changed field is not worth a note; only plausible quantities and document formats are."""
    is_format = (field == "format") & F.contains(F.lower(F.coalesce(section, F.lit(""))), F.lit("документац"))
    return (F.when(is_bad_item_name(clean), "name")
            .when(has_garbage(section) | has_garbage(old) | has_garbage(new), "garbage")
            .when(field == "quantity", F.when(~is_plausible_quantity(new), "quantity"))
            .when(is_format, F.when(F.coalesce(new, F.lit("")) == "", "format"))
            .otherwise("field"))


def added_display_name(clean: Column, des: Column) -> Column:
    """Item name with its code (both already clean), cut after the ТУ mark, unless the name has it already."""
    coded = F.when(F.contains(des, F.lit("ТУ")), F.regexp_extract(des, r"([A-Za-zА-Яа-яЁё0-9.\-/]+\s*ТУ)", 1)).otherwise("")
    tailed = F.lower(des).rlike(f"{EDGE_L}(?:(?:россыпью|количество|шт){EDGE_R}|шт\\.[{T.WORD}]|\\d+\\s+0?\\d{{2,}}[.-])")
    code = F.when(has_garbage(des), "").otherwise(T.let(coded, lambda k: F.when(k != "", k).when(~tailed, des).otherwise("")))
    return T.let(code, lambda k: F.when((k != "") & ~F.contains(F.lower(clean), F.lower(k)), F.concat_ws(" ", clean, k)).otherwise(clean))


def display_name(clean: Column, des: Column) -> Column:
    """Item name (clean) with the designation where the name alone is generic."""
    low = F.lower(clean)
    generic = low.isin("трубка термоусаживаемая ттпок-", "трубка термоусаживаемая") | F.endswith(low, F.lit("ттпок-"))
    glue = F.when(F.endswith(clean, F.lit("-")), "").otherwise(" ")
    return F.when((des != "") & ~has_garbage(des) & generic, F.concat(clean, glue, des)).otherwise(clean)


# ---- tables (F11, F13, F19, P7, P10) ---------------------------------------------------------

def canon_header(c: Column) -> Column:
    return T.squeeze(F.translate(F.lower(F.coalesce(c, F.lit(""))), "\n-.", " "))


def header_token(c: Column) -> Column:
    v = F.trim(F.regexp_replace(T.lower_plain(c), "[^а-яa-z0-9]+", " "))
    v = F.replace(v, F.lit("дл мм"), F.lit("длина мм"))
    return (F.when(v == "дл", "длина").when(v == "количество", "кол")
            .when(T.contains_any(v, rules.KEY_COLUMN_EXCLUDED), "обозначение провода кабеля").otherwise(v))


def header_key(names: Column) -> Column:
    return F.array_join(F.filter(F.transform(names, header_token), lambda x: x != ""), "|")


def named_table_number(name: Column) -> Column:
    return extract(T.lower_plain(name), f"{EDGE_L}(?:продолжение\\s+)?таблиц[аы]?\\s*(\\d{{1,3}}){EDGE_R}")


def table_number(name: Column, names: Column) -> Column:
    """Number in the name, else 1 for a wire table, else null."""
    blob = T.lower_plain(F.concat_ws(" ", name, header_key(names)))
    wires = F.contains(blob, F.lit("провод")) & T.contains_any(blob, ("соединител", "длина", "кол"))
    return F.coalesce(named_table_number(name), F.when(wires, "1"))


def note_table_number(name: Column) -> Column:
    text = T.squeeze(F.coalesce(name, F.lit("")))
    low = T.lower_plain(text)
    wires = F.contains(low, F.lit("провод")) & T.contains_any(low, ("соединител", "длина", "кол"))
    return F.coalesce(extract(text, r"(?iu)таблиц[аы]?\s*(\d+)"), F.when(wires, "1"))


def table_key(name: Column) -> Column:
    number = note_table_number(name)
    plain = F.nullif(T.lower_plain(T.squeeze(F.coalesce(name, F.lit("")))), F.lit(""))
    return F.coalesce(F.concat(F.lit("table:"), number), plain, F.lit("table:1"))


def clean_identity(c: Column) -> Column:
    return T.strip(T.norm_cell(c), " |/;:")


def clean_subject(c: Column) -> Column:
    return T.strip(T.squeeze(F.coalesce(c, F.lit(""))), " \"«»|/;:")


def header_words(names: Column) -> Column:
    """Compact column names, worked out once per row and not once per cell."""
    return F.transform(names, T.compact)


def _is_known(key: Column, exact, words: Column | None, share: bool) -> Column:
    def known(k: Column) -> Column:
        hit = (k == "") | k.isin(*exact)
        return hit if words is None else hit | F.array_contains(words, k)

    return T.let(key, known) if share else known(key)


def is_header_like(c: Column, words: Column | None = None, share: bool = True) -> Column:
    """Empty, a known header word, or one of the column names (given as header_words).

    `share` is for use inside lambdas; outside, generated code shares the key by itself.
    """
    return _is_known(T.strip(T.compact(T.typographic(c)), "|/;:"), rules.HEADER_WORDS_EXACT, words, share)


def table_head(spark, names) -> tuple[Column, Column, Column]:
    """Column names, their header words and the key column, from a column, a fixed list or these three as they are.

    A fixed list is worked out once, in a one-row frame, and enters the plan as literals.
    """
    if isinstance(names, tuple):
        return names
    if isinstance(names, Column):
        return names, header_words(names), key_column(names)
    listed = F.array(*map(F.lit, names))
    row = spark.range(1).select(header_words(listed).alias("w"), key_column(listed).alias("k")).first()
    return listed, F.array(*map(F.lit, row["w"])), F.lit(row["k"]).cast("int")


def is_bad_subject(c: Column, words: Column | None = None) -> Column:
    return _is_known(T.compact(clean_subject(c)), rules.BAD_SUBJECTS_EXACT, words, False)


def is_repeated_header(cells: Column, words: Column) -> Column:
    """Of normalised cells: a row that repeats the head, or is empty."""
    def wires(joined: Column) -> Column:
        return (F.contains(joined, F.lit("провод")) & F.contains(joined, F.lit("соединител"))
                & T.contains_any(joined, ("длина", "кол")))

    def judge(filled: Column) -> Column:
        hits = F.size(F.filter(filled, lambda c: is_header_like(c, words)))
        return ((F.size(filled) == 0) | (hits >= F.greatest(F.lit(2), F.floor(F.size(filled) / 2)))
                | T.let(T.lower_plain(F.array_join(filled, " ")), wires))

    return T.let(F.filter(cells, lambda c: c != ""), judge)


def key_column(names: Column) -> Column:
    """0-based index of the column that names a row: best marker group first, then leftmost; else null."""
    def usable(n: Column) -> Column:
        return F.when(T.contains_any(n, rules.KEY_COLUMN_EXCLUDED), "").otherwise(n)

    def place(canon: Column, markers) -> Column:
        hit = F.array_position(F.transform(canon, lambda n: T.contains_any(n, markers)), F.lit(True))
        return F.nullif(hit, F.lit(0).cast("long"))

    canon = F.transform(F.transform(names, canon_header), usable)
    return (T.let(canon, lambda c: F.coalesce(*[place(c, m) for m in rules.KEY_COLUMN_MARKERS])) - 1).cast("int")


def row_key(cells: Column, words: Column, key_col: Column) -> Column:
    """Of normalised cells: the key column's value, else the first two telling cells; '' if none."""
    own = F.get(cells, key_col)
    telling = F.array_join(F.slice(F.filter(cells, lambda c: ~is_header_like(c)), 1, 2), " | ")
    return T.strip(F.when(~is_header_like(own, words), own).otherwise(telling), " |/;:")


def connector_of(c: Column) -> Column:
    """Connector designation in a column name such as `Marking / XP1`; the last part counts first."""
    folded = T.fold_lookalikes(F.coalesce(c, F.lit("")), rules.LOOKALIKE_CONNECTOR)
    parts = F.reverse(F.filter(F.split(folded, "[/|]"), lambda p: F.trim(p) != ""))
    pattern = f"(?iu){EDGE_L}((?:X|XP|XS|XT|XR|XC|XW)\\d{{1,4}}){EDGE_R}"
    found = F.filter(F.transform(parts, lambda p: F.upper(F.regexp_extract(p, pattern, 1))), lambda p: p != "")
    return F.get(found, F.lit(0))


def is_wire_table_name(c: Column) -> Column:
    low = T.lower_plain(c)
    wires = F.contains(low, F.lit("провод"))
    return (F.contains(low, F.lit("таблица присоедин")) | (wires & F.contains(low, F.lit("соединител")))
            | (wires & F.contains(low, F.lit("длина")) & F.contains(low, F.lit("кол"))))


def is_wire_column(c: Column) -> Column:
    low = T.lower_plain(c)
    return F.contains(low, F.lit("провод")) & ~T.contains_any(low, rules.KEY_COLUMN_EXCLUDED)


def is_connection_column(c: Column) -> Column:
    return T.contains_any(T.lower_plain(c), ("от соедин", "к соедин"))


def is_wire_connection(name: Column, names: Column) -> Column:
    joined = T.lower_plain(F.array_join(names, " "))
    ends = T.contains_any(joined, ("от соедин", "к соедин", "гильз", "наконечник"))
    return is_wire_table_name(name) | (T.contains_any(joined, rules.KEY_COLUMN_EXCLUDED)
                                       & F.contains(joined, F.lit("длина")) & ends)


def has_wire_key(names: Column) -> Column:
    return F.exists(names, is_wire_column)


def is_unnumbered(c: Column) -> Column:
    return F.regexp_replace(T.lower_plain(clean_subject(c)), r"[\s./\-]+", "").isin(*rules.UNNUMBERED_SUBJECTS)


def is_marking_column(c: Column) -> Column:
    return F.contains(T.lower_plain(c), F.lit("маркиров"))


def table_subject(row_key_col: Column, words: Column, key_cell: Column) -> Column:
    """What a table change is about: the row key, else the key cell; '' if neither tells."""
    return (F.when(~is_bad_subject(row_key_col, words), T.strip(F.substring_index(clean_subject(row_key_col), "|", 1)))
            .when(~is_bad_subject(key_cell, words), clean_subject(key_cell)).otherwise(""))


def looks_like_header_row(values: Column) -> Column:
    """A 'row' of a marking table that is really part of its heading."""
    filled = F.filter(F.transform(values, lambda v: F.coalesce(T.squeeze(v), F.lit(""))), lambda v: v != "")
    joined = T.lower_plain(F.array_join(filled, " "))
    folded = F.transform(filled, lambda v: F.upper(T.fold_lookalikes(v, rules.LOOKALIKE_CONNECTOR)))
    connector = F.exists(folded, lambda v: v.rlike(r"^(?:X|XP|XS|XT|XR|XC|XW)\d{1,4}$"))
    small = F.exists(folded, lambda v: v.rlike(r"^\d{1,2}$"))
    code = F.exists(filled, lambda v: v.rlike(r"(?iu)^[A-ZА-ЯЁ]\d{3,5}$"))
    return ((F.size(filled) == 0) | T.contains_any(joined, ("обозначение", "маркировка", "код"))
            | (connector & small & ~code))


def marking_row_key(c: Column) -> Column:
    text = T.strip(T.squeeze(F.coalesce(c, F.lit(""))), " .;:-")
    return F.when(T.contains_any(T.lower_plain(text), ("маркировка", "обозначение", "код")), "").otherwise(text)
