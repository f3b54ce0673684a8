"""Lines of text and table rows: kinds, keyword classes, item assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff import rules
from revdiff.functions import fields as X
from revdiff.functions import text as T
from revdiff.operators.dedupe import keep_richest, merge_texts
from revdiff.operators.scan import CHUNK_ROWS, by_position, chunk_if_large, ordered_scan
from revdiff.staging import stage


# ---- line kinds (P6); all of normalised text, so that a line is normalised once --------------

def is_requirement_service(c: Column) -> Column:
    low = F.lower(c)
    return ((c == "") | low.isin(*rules.SERVICE_LINES_EXACT)
            | low.rlike(r"^(?:(?:обозначение|код|маркировка|xp\d|xs\d|хр\d|хs\d)$|таблица\s*\d+|продолжение таблицы)"))


def is_bom_header(c: Column) -> Column:
    return T.count_hits(F.lower(c), rules.BOM_HEADER_WORDS) >= 3


def is_bom_service(c: Column) -> Column:
    low = F.lower(c)
    return ((c == "") | is_bom_header(c) | low.isin(*rules.BOM_SERVICE_EXACT) | low.rlike(r"^\d+\s+зам\.") | F.startswith(low, F.lit("ао "))
            | (F.contains(low, F.lit("изм.")) & F.contains(low, F.lit("докум"))) | T.contains_any(low, rules.BOM_SERVICE_CONTAINS))


def bom_section(c: Column, names=rules.BOM_SECTIONS) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*names), F.initcap(low))


def is_item_start(c: Column) -> Column:
    return (c.rlike(r"^\d+\s+\S+") & ~c.rlike(r"(?iu)^\d+\s+зам\.")) | c.rlike(r"(?iu)^[AА]\d\s+\S+")


def is_element_service(values: Column) -> Column:
    low = F.lower(F.array_join(values, " "))
    marks = F.contains(low, F.lit("лит.")) & F.contains(low, F.lit("лист")) & F.contains(low, F.lit("листов"))
    return ((low == "") | (F.contains(low, F.lit("изм.")) & F.contains(low, F.lit("докум"))) | low.rlike(r"^\d+\s+зам\.") | marks
            | T.contains_any(low, rules.ELEMENT_SERVICE_CONTAINS))


def is_element_position(c: Column) -> Column:
    return (c.rlike(r"^[A-ZА-Я0-9][A-ZА-Я0-9.\-]*(?:, *)?$")
            & ~(F.contains(c, F.lit(" ")) & ~F.contains(c, F.lit(","))))


# ---- keyword classes (P4) --------------------------------------------------------------------

def keyword_hits(rows: DataFrame, keys: list[str], text: Column, markers) -> DataFrame:
    """How many distinct markers occur per group; a flag per marker is combined before the shuffle."""
    flags = rows.groupBy(*keys).agg(*[F.bool_or(F.contains(text, F.lit(m))).alias(f"__m{i}") for i, m in enumerate(markers)])
    total = sum((F.col(f"__m{i}").cast("int") for i in range(len(markers))), F.lit(0))
    return flags.select(*keys, total.alias("hits"))


def document_presets(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Which groups of lines read like an element list or a connection diagram, with what speaks against it.

    keys, header_hits, looks_like_elements, looks_like_wiring. An element list names itself and has four of its five head words, and is neither a drawing that only mentions
    one nor a bill of materials; a diagram names itself, or has its code with markings and designations. A phrase stands within one line.
    """
    low = F.lower(T.norm_cell(F.col(line)))

    def says(*markers: str) -> Column:
        return F.coalesce(F.bool_or(reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in markers])), F.lit(False))

    def code(c: str) -> Column:
        return F.coalesce(F.bool_or(low.rlike(f"(?:^|[^{T.WORD}]){c}(?:$|[^{T.WORD}])")), F.lit(False))

    flags = {"drawing": says("сборочный чертеж"), "listed": says("перечень элементов"), "papers": says("документация"), "others": says("прочие изделия"), "pe4": code("пэ4"),
             "named": says("схема электрическая соединений"), "e4": code("э4"), "marks": says("маркировк"), "des": says("обознач")}
    hits = reduce(lambda a, b: a + b, [says(m).cast("int") for m in rules.ELEMENT_HEADER_WORDS])
    told = rows.groupBy(*keys).agg(hits.alias("header_hits"), *[c.alias(f"__{n}") for n, c in flags.items()])
    f = {n: F.col(f"__{n}") for n in flags}
    elements = ~(f["drawing"] & ~f["listed"]) & ~(f["papers"] & f["others"]) & (f["listed"] | f["pe4"]) & (F.col("header_hits") >= 4)
    return told.select(*keys, "header_hits", elements.alias("looks_like_elements"), (f["named"] | (f["e4"] & f["marks"] & f["des"])).alias("looks_like_wiring"))


def document_class(rows: DataFrame, keys: list[str], line: str, head=rules.BOM_HEADER_WORDS, head_min: int = 5, sections=rules.BOM_SECTIONS,
                   section_min: int = 1) -> DataFrame:
    """Groups with enough head words and section names."""
    low = F.lower(T.norm_cell(F.col(line)))
    both = keyword_hits(rows, keys, low, head).withColumnRenamed("hits", "head_hits").join(
        keyword_hits(rows, keys, low, sections).withColumnRenamed("hits", "section_hits"), keys)
    return both.withColumn("matches", (F.col("head_hits") >= head_min) & (F.col("section_hits") >= section_min))


# ---- items from text lines (W8) --------------------------------------------------------------

# ---- fixed value: quantity and note at the end of an item's last line ------------------------
QUANTITY_TAIL = r"(\d+(?:[.,]\d+)?(?:\s*[мМ]|(?:\s*шт)?|(?:\s*кг)?))\s*([A-ZА-Я0-9,.\- ]+)?$"


def items_from_lines(lines: DataFrame, section: Column, is_service: Column | None = None) -> DataFrame:
    """Section lines set the section, numbered lines open items, others go on with them.

    Sections, starts and page ends close the open item; lines outside any item are dropped.
    """
    service = is_bom_service(F.col("piece")) if is_service is None else is_service
    clean = lines.withColumn("piece", T.norm_cell(F.col("line"))).filter(~service & (F.col("piece") != ""))
    marked = clean.withColumn("section_here", section).withColumn("start", is_item_start(F.col("piece")) & F.col("section_here").isNull())
    linked = stage(ordered_scan(marked, ["doc_id"], ["ord"], by_position("ord"), previous={"prev_page": F.col("page_num")}))
    breaks = F.col("start") | F.col("section_here").isNotNull() | (F.col("page_num") != F.coalesce("prev_page", "page_num"))
    runs = ordered_scan(linked, ["doc_id"], ["ord"], by_position("ord"), running={"run": breaks.cast("int")}, carry={"section": F.col("section_here")})
    block = F.array_sort(F.collect_list(F.struct("ord", "piece")))
    items = runs.filter("section_here is null").groupBy("doc_id", "run").agg(
        F.bool_or("start").alias("opened"), F.min_by("section", "ord").alias("section"), F.min("page_num").alias("page_num"),
        F.transform(block, lambda x: x["piece"]).alias("block")).filter("opened")
    head = r"^(\d+)\s+(.+)$"
    rest = F.concat(F.array(F.regexp_extract(F.col("block")[0], head, 2)), F.slice("block", 2, F.size("block")))
    parsed = items.filter(F.col("block")[0].rlike(head)).withColumns({"position": F.regexp_extract(F.col("block")[0], head, 1), "rest": rest})
    last = F.element_at("rest", -1)
    parsed = parsed.withColumns({
        "quantity": X.extract(last, QUANTITY_TAIL, 1), "note": F.nullif(F.trim(F.regexp_extract(last, QUANTITY_TAIL, 2)), F.lit("")),
        "rest": F.concat(F.slice("rest", 1, F.size("rest") - 1), F.array(F.trim(F.regexp_replace(last, QUANTITY_TAIL, ""))))})
    is_code = lambda x: F.lower(x).rlike(f"ту |(?:^|[^{T.WORD}])ту(?:$|[^{T.WORD}])")
    filled = F.filter("rest", lambda x: x != "")
    named = parsed.withColumns({"name": F.nullif(F.array_join(F.filter(filled, lambda x: ~is_code(x)), " "), F.lit("")),
                                "designation": F.nullif(F.array_join(F.filter(filled, is_code), " "), F.lit(""))})
    keyed = named.withColumn("key", X.item_key(F.col("section"), F.col("position"), F.col("designation"), F.col("name")))
    score = F.char_length(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("designation", F.lit(""))))
    return keep_richest(keyed.select("doc_id", "key", "section", "page_num", "position", "designation", "name", "quantity", "note", "run"), ["doc_id", "key"], score, "run")


# ---- items from table rows (W7) --------------------------------------------------------------

ITEM_TEXTS = ["designation", "name", "quantity", "note"]


def header_map(cells: Column) -> Column:
    """Field name -> column index of an item table's head; the last column of a field counts."""
    def field(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, marker in reversed(rules.ITEM_COLUMNS):
            hit = (c == "кол") | F.contains(c, F.lit("кол ")) | F.endswith(c, F.lit(" кол")) if name == "quantity" else F.contains(c, F.lit(marker))
            out = F.when(hit, F.lit(name)).otherwise(out)
        return out

    entries = F.transform(F.transform(cells, X.canon_header), lambda c, i: F.struct(field(c).alias("key"), i.alias("value")))
    return F.aggregate(F.filter(entries, lambda e: e["key"].isNotNull()), F.create_map().cast("map<string,int>"), lambda acc, e: F.map_concat(
        F.map_filter(acc, lambda k, v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def items_from_rows(rows: DataFrame) -> DataFrame:
    """Items from table rows with columns section_here, is_service, position, designation, ...

    A section or service row closes the item; a row with a position opens one (in the
    documentation section any row does), as does the first row after a close; others go on with it.
    """
    close = F.col("section_here").isNotNull() | F.col("is_service")
    chunk = chunk_if_large(rows, ["doc_id"], by_position("ord"))
    sectioned = ordered_scan(rows, ["doc_id"], ["ord"], chunk, carry={"section": F.col("section_here")}, previous={"after_close": close})
    sectioned = sectioned if chunk is None else stage(sectioned)
    opens = (F.coalesce("position", F.lit("")) != "") | (F.lower(F.coalesce("section", F.lit(""))) == "документация") | F.coalesce("after_close", F.lit(True))
    runs = ordered_scan(sectioned, ["doc_id"], ["ord"], chunk, running={"run": (close | opens).cast("int")}).filter(~close)
    cols = ["doc_id", "run", "ord", "page_num", "section", "position", *ITEM_TEXTS]
    # what the scans and the cleaning made is worked out once; no item has more rows than its document
    whole = True if chunk is None else None
    merged = merge_texts(stage(runs.select(*cols)), ["doc_id", "run"], ITEM_TEXTS, whole=whole)
    des, name = X.rejoin_designation(F.col("designation"), F.col("name"))
    fixed = merged.withColumns({"designation": des, "name": name}).withColumns({c: X.clean_field(F.col(c)) for c in ITEM_TEXTS})
    return merge_texts(stage(with_keys(fixed)), ["doc_id", "key"], ITEM_TEXTS, "run", whole=whole)


def with_keys(items: DataFrame) -> DataFrame:
    """Items with their key; those without one are left out, by a generator: a filter would be pushed below and have all texts worked out again."""
    key = X.item_key(F.col("section"), F.col("position"), F.col("designation"), F.col("name"))
    return items.withColumn("key", F.explode(F.filter(F.array(key), lambda k: k != "")))


def section_row(cells: Column, names=rules.BOM_SECTIONS) -> Column:
    """The section that a table row of normalised cells stands for: its whole text, or a section's name in a row of one or two cells."""
    def judge(filled: Column) -> Column:
        def named(joined: Column) -> Column:
            first = F.get(F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(joined, n)), F.lit(0))
            return F.when(joined.isin(*names), F.initcap(joined)).when(F.size(filled) <= 2, F.initcap(first))

        return T.let(F.lower(T.squeeze(F.array_join(filled, " "))), named)

    return T.let(F.filter(cells, lambda c: c != ""), judge)


def items_from_tables(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Items of a document's tables, from their raw rows.

    tables: doc_id, table_id, page_num, x0, y0; rows: table_id, row_index (from 1), cells. A table counts if its text names designation, name, quantity and a section,
    and one of its first six rows is a head with designation and name; that row says which column holds which field. Section rows, service rows and a
    table's start close the open item. A row with a position opens one, in the documentation section one with a format, designation or name; after a close
    any row does. Others add to it what it does not hold yet. Items of one key are one.
    """
    norm = stage(rows.select("table_id", "row_index", F.transform("cells", T.norm_cell).alias("cells")))
    low = F.lower(F.array_join(F.filter("cells", lambda c: c != ""), " "))

    def says(*markers: str) -> Column:
        return F.bool_or(T.contains_any(F.col("low"), markers))

    # staged: each field read from a map would otherwise work the whole map out again
    tops = stage(norm.filter("row_index <= 6").select("table_id", "row_index", header_map(F.col("cells")).alias("map")))
    is_head = F.map_contains_key("map", F.lit("designation")) & F.map_contains_key("map", F.lit("name"))
    told = norm.withColumn("low", low).groupBy("table_id").agg(
        says("обознач").alias("a"), says("наимен").alias("b"), says("кол").alias("c"), says("документац", "материал", "прочие изделия").alias("d"))
    head = tops.filter(is_head).groupBy("table_id").agg(
        F.min_by(F.struct("row_index", *[F.element_at("map", F.lit(f)).alias(f) for f, _ in rules.ITEM_COLUMNS]), "row_index").alias("head"))
    heads = stage(head.join(told.filter("a AND b AND c AND d").select("table_id"), "table_id"))
    place = ["page_num", "y0", "x0", "table_id"]
    body = norm.join(heads, "table_id").filter(F.col("row_index") > F.col("head.row_index")).join(tables.select("doc_id", *place), "table_id")
    fields = [f for f, _ in rules.ITEM_COLUMNS]
    read = body.withColumns({f: F.coalesce(F.get("cells", F.col(f"head.{f}")), F.lit("")) for f in fields})
    some = F.concat(*fields) != ""
    # a word of one cell, with hyphens and points left out as in a head; line ends keep the cells apart
    is_format = F.contains(F.translate(F.lower(F.array_join("cells", "\n")), "-.", ""), F.lit("формат"))
    is_service = T.let(F.lower(F.array_join("cells", " ")), lambda low: T.contains_any(low, rules.TABLE_ROW_SERVICE))
    # by a generator: a filter would be pushed below and have every row read twice
    told = T.let(section_row(F.col("cells")), lambda s: F.when(s.isNotNull() | (some & ~is_format), F.struct(s.alias("section_here"), (s.isNotNull() | is_service).alias("close"))))
    kept = read.withColumn("told", F.explode(F.filter(F.array(told), lambda t: t.isNotNull())))
    kept = stage(kept.select("doc_id", *place, "row_index", "told.section_here", "told.close", *fields))
    order = [*place, "row_index"]
    chunk = chunk_if_large(kept, ["doc_id"], F.struct(*place, F.floor(F.col("row_index") / CHUNK_ROWS)))
    sectioned = ordered_scan(kept, ["doc_id"], order, chunk, carry={"section": F.col("section_here")}, running={"ord": F.lit(1)},
                             previous={"before": F.struct("close", "table_id")})
    in_documents = F.lower(F.coalesce("section", F.lit(""))) == "документация"
    opens = F.when(in_documents, F.concat("format", "designation", "name") != "").otherwise(F.col("position") != "")
    fresh = F.coalesce(F.col("before.close") | (F.col("before.table_id") != F.col("table_id")), F.lit(True))
    sectioned = sectioned.withColumn("opens", F.col("close") | opens | fresh).drop("before")
    runs = ordered_scan(sectioned if chunk is None else stage(sectioned), ["doc_id"], ["ord"], None if chunk is None else by_position("ord"),
                        running={"run": F.col("opens").cast("int")}).filter(~F.col("close"))
    # what goes on with an item is cleaned before it is added
    pieces = runs.select("doc_id", "run", "ord", "page_num", "section", *[F.nullif(c, F.lit("")).alias(c) for c in ("format", "zone", "position")],
                         *[F.when(F.col("opens"), F.col(c)).otherwise(X.clean_field(F.col(c))).alias(c) for c in ITEM_TEXTS]).filter("doc_id IS NOT NULL")
    whole = chunk is None
    merged = merge_texts(pieces if whole else stage(pieces), ["doc_id", "run"], ITEM_TEXTS, firsts=["format", "zone"], whole=whole)
    cleaned = merged.withColumns({c: X.clean_field(F.col(c)) for c in ITEM_TEXTS})
    des, name = X.rejoin_designation(F.col("designation"), F.col("name"))
    keyed = with_keys(cleaned.withColumns({"designation": des, "name": name})).drop("ord")
    return merge_texts(keyed if whole else stage(keyed), ["doc_id", "key"], ITEM_TEXTS, "run", whole=whole).drop("run")


# ---- elements (W11) --------------------------------------------------------------------------

def accumulate_elements(rows: DataFrame) -> DataFrame:
    """Positions and names pile up until a quantity closes the element; the richest per key is kept."""
    runs = ordered_scan(rows, ["doc_id"], ["ord"], by_position("ord"), previous={"closed": F.col("quantity").isNotNull()})
    runs = ordered_scan(stage(runs), ["doc_id"], ["ord"], by_position("ord"), running={"run": F.coalesce(F.col("closed").cast("int"), F.lit(0))})

    def joined(c: str, glue: str) -> Column:
        kept = F.filter(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: F.coalesce(x[c], F.lit("")) != "")
        return F.array_join(F.transform(kept, lambda x: x[c]), glue)

    items = runs.groupBy("doc_id", "run").agg(joined("position", ", ").alias("positions"), joined("name", " ").alias("name"),
                                              F.max("quantity").alias("quantity"), F.min("page_num").alias("page_num"))
    kept = items.filter((F.col("positions") != "") & ~F.startswith(F.lower("positions"), F.lit("справ"))).withColumns(
        {"key": X.element_key(F.col("positions")), "quantity": T.space_units(F.col("quantity"))})
    return keep_richest(kept, ["doc_id", "key"], F.char_length("name") + F.coalesce(F.char_length("quantity"), F.lit(0)), "run")


# ---- edited notice text (W14) ----------------------------------------------------------------

def parse_notes(lines: DataFrame) -> DataFrame:
    """Notes from edited text: numbered or plain lines open a note, `-` lines stay with it.

    Note heads are skipped; everything from the first journal line on is left out.
    """
    text = F.col("line")
    journal = text.rlike(r"(?iu)^\s*Журнал\s*№")
    skipped = (F.trim(text) == "") | text.rlike(r"(?iu)^\s*Примечани[ея]\s*:?\s*$")
    numbered = text.rlike(r"^\s*\d+\s*[.)]?\s+\S")
    opens = numbered | ~F.startswith(F.ltrim(text), F.lit("-"))
    scanned = ordered_scan(lines.filter(~skipped), ["doc_id"], ["ord"], by_position("ord"),
                           running={"ended": journal.cast("int"), "note_no": opens.cast("int")}).filter("ended = 0")
    piece = F.when(numbered, F.rtrim(F.regexp_replace(text, r"^\s*\d+\s*[.)]?\s+", ""))).otherwise(F.trim(text))
    notes = scanned.groupBy("doc_id", "note_no").agg(F.array_sort(F.collect_list(F.struct("ord", piece.alias("p")))).alias("x"))
    return notes.select("doc_id", F.col("note_no").cast("int").alias("note_no"), F.array_join(F.transform("x", lambda r: r["p"]), "\n").alias("note"))


# ---- best title line (O2) --------------------------------------------------------------------

def best_title(lines: DataFrame, starts=rules.TITLE_STARTS, banned=rules.TITLE_BANNED, tail_word: str = "Дата") -> DataFrame:
    """Per document the likeliest title: a line with a known start, else the text after a head's last
    word, else the best-scored line; first on ties. A struct maximum, combined before the shuffle."""
    text = T.norm_cell(F.col("line"))
    low = F.lower(text)
    letters = F.char_length(F.regexp_replace(text, "[^А-Яа-яA-Za-z]", ""))
    known = low.rlike("^(?:" + "|".join(starts) + f")(?:$|[^{T.WORD}])") & (F.char_length(text) <= 40) & ~T.contains_any(low, banned)
    tail = T.norm_cell(F.regexp_extract("line", f"(?iu){X.EDGE_L}{tail_word}\\s+(.+)$", 1))
    tail_ok = (F.char_length(F.regexp_replace(tail, "[^А-Яа-яA-Za-z]", "")) >= 3) & ~T.contains_any(F.lower(tail), rules.TITLE_TAIL_BANNED)
    tokens = F.size(F.split(text, " "))
    fits = (F.char_length(text).between(3, 50) & ~F.contains(text, F.lit(",")) & (letters >= 3) & ~text.rlike(r"^[A-ZА-Я0-9.\- ]+$")
            & ~T.contains_any(low, banned))
    score = (F.char_length(F.regexp_replace(text, "[^А-Яа-я]", "")) * 3 + F.greatest(F.lit(0), 15 - F.abs(tokens - 2) * 4)
             + F.when(tokens <= 4, 10).otherwise(0))
    def candidate(tier: int, points: Column, title: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), points.cast("int").alias("score"), (-F.col("ord")).alias("o"), title.alias("title"))

    cand = (F.when(known, candidate(3, 200 + letters, text)).when(tail_ok, candidate(2, F.lit(100), tail))
            .when(fits, candidate(1, score, text)))
    return lines.groupBy("doc_id").agg(F.max(cand).alias("b")).select("doc_id", F.col("b.title").alias("title"), F.col("b.tier").alias("tier"))
