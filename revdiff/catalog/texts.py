"""Queries on raw lines, numbered requirements and text functions."""

from pyspark.sql import functions as F

from revdiff import rules
from revdiff import snapshots as S
from revdiff.catalog.base import query
from revdiff.functions import text as T
from revdiff.operators import dedupe, lines, requirements as R
from revdiff.staging import stage

# an English/French/German/Spanish rule table over the same operator
TOPICS = ((" the ", "the text"), (" les ", "les textes"), (" der ", "der Text"), (" los ", "los textos"))
MARKERS = (" the ", " of ", " les ", " des ", " der ", " und ", " los ", " el ")


@query("f01_encoding_repair")
def f01(spark, path):
    return S.document_lines(spark, path).select("doc_id", "number", T.repair_encoding("text").alias("text"))


@query("f02_text_normalisation")
def f02(spark, path):
    d = S.requirements(spark, path, 1)
    k = F.col("number") % 4
    dirty = F.concat(F.when(k == 0, "  «").when(k == 1, "\t\r\n").otherwise(""), F.col("text"), F.when(k == 2, " – x..").when(k == 3, " ;").otherwise("  "))
    d = d.withColumn("t", dirty)
    c = F.col("t")
    return d.select("doc_id", "number", T.norm_cell(c).alias("cell"), T.strip_control(c).alias("plain"), T.sentence(c).alias("sentence"),
                    T.strip_period(c).alias("bare"), T.lower_first(F.col("text")).alias("lower_first"), T.unify_line_ends(c).alias("lines"),
                    T.shorten(c, 60).alias("short"))


@query("f03_lookalike_folding")
def f03(spark, path):
    d = S.requirements(spark, path, 2)
    c = F.col("text")
    return d.select("doc_id", "number", T.fold_lookalikes(c).alias("compare"), T.fold_lookalikes(c, rules.LOOKALIKE_CONNECTOR).alias("connector"),
                    T.fold_lookalikes(c, rules.LOOKALIKE_DIAGRAM).alias("diagram"))


@query("f04_compare_key")
def f04(spark, path):
    return S.requirements(spark, path, 2).select("doc_id", "number", T.compare_key(F.concat(F.lit(" – "), "text", F.lit(" - x"))).alias("key"))


@query("f05_token_set")
def f05(spark, path):
    tokens = T.key_tokens(T.compare_key(F.col("text")), ("that", "this"))
    return S.requirements(spark, path, 1).select("doc_id", "number", F.array_join(F.array_sort(tokens), "|").alias("tokens"))


@query("f17_sequence_ratio")
def f17(spark, path):
    a = S.requirements(spark, path, 1)
    b = S.requirements(spark, path, 2).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("number") - 1).otherwise(F.col("number")).alias("number"), F.col("text").alias("new"))
    j = a.join(b, ["doc_id", "number"])
    return j.select("doc_id", "number", T.sequence_ratio(T.compare_key(F.col("text")), T.compare_key(F.col("new"))).alias("ratio"))


@query("f18_topics")
def f18(spark, path):
    d = S.requirements(spark, path, 1)
    return d.select("doc_id", "number", T.summarize(F.col("text"), TOPICS).alias("summary"), T.about(T.topic_of(F.col("text"), table=TOPICS)).alias("topic"),
                    T.is_good_topic(F.col("text")).alias("good"))


@query("p04_keyword_class")
def p04(spark, path):
    return lines.document_class(S.raw_lines(spark, path), ["doc_id"], "line", [m.strip() for m in MARKERS], 5, ("section 1", "section 9"), 1)


PRESET_LINES = ("Перечень элементов", "Поз. обозначение", "Наименование Кол.", "Примечание", "Сборочный  чертеж", "Документация", "Прочие изделия", "Схема электрическая соединений", "лист Э4 1",
                "Маркировка", "код ПЭ4", "пэ4x", "кол")


@query("p04_document_presets")
def p04_presets(spark, path):
    k = ((F.col("doc_id") * 5 + F.col("ord") * F.col("doc_id") % 7) % 29).cast("int")
    d = S.raw_lines(spark, path).withColumn("line", F.coalesce(F.get(F.array(*map(F.lit, PRESET_LINES)), k), F.col("line")))
    return lines.document_presets(d, ["doc_id"], "line")


VARIANTS = ("Дата", "Таблица 3 x", "Формат Зона Поз. обозн", "12 Зам. x", "А4 док", "Материалы", "XP1", "R1,", "ао x")


def varied_lines(spark, path):
    k = ((F.col("doc_id") + F.col("ord")) % 13).cast("int")
    return S.raw_lines(spark, path).withColumn("line", F.coalesce(F.get(F.array(*map(F.lit, VARIANTS)), k), F.col("line")))


@query("p06_line_kinds")
def p06(spark, path):
    c = F.col("text")
    return varied_lines(spark, path).withColumn("text", T.norm_cell(F.col("line"))).select(
        "doc_id", "ord", lines.is_requirement_service(c).alias("requirement_service"), lines.is_bom_header(c).alias("bom_header"),
        lines.is_bom_service(c).alias("bom_service"), lines.bom_section(c).alias("section"), lines.is_item_start(c).alias("item_start"),
        lines.is_element_service(F.array(c)).alias("element_service"), lines.is_element_position(c).alias("element_position"))


@query("w08_items_from_lines")
def w08(spark, path):
    section = F.when(F.col("line").rlike(r"^Section \d+$"), F.col("line"))
    return lines.items_from_lines(S.raw_lines(spark, path), section, F.lit(False)).select(
        "doc_id", "key", "section", "page_num", "position", "designation", "name", "quantity", "note")


@query("w07_items_from_rows")
def w07(spark, path):
    d = stage(S.items(spark, path, 1))
    rows = d.select("doc_id", "ord", "page_num", F.when(F.col("ord") % 7 == 0, F.initcap("section")).alias("section_here"), (F.col("ord") % 11 == 0).alias("is_service"),
                    F.when(F.col("ord") % 3 == 1, F.col("position").cast("string")).alias("position"), "designation", "name", "quantity", "note")
    return lines.items_from_rows(rows).select("doc_id", "key", "section", "position", "designation", "name", "quantity", "note", "page_num")


@query("w07_items_from_tables")
def w07_tables(spark, path):
    found = lines.items_from_tables(*S.item_tables(spark, path, stage(S.items(spark, path, 1))))
    return found.select("doc_id", "key", "section", "page_num", "format", "position", "designation", "name", "quantity", "note")


@query("w09_requirement_stitching")
def w09(spark, path):
    return R.stitch(S.raw_lines(spark, path))


@query("w10_split_requirement_stitching")
def w10(spark, path):
    return R.stitch_split(S.raw_lines_split(spark, path))


@query("w11_element_accumulation")
def w11(spark, path):
    d = S.elements(spark, path, 1)
    rows = d.select("doc_id", "ord", "page_num", F.when(F.col("ord") % 3 != 2, F.col("positions")).alias("position"), "name",
                    F.when(F.col("ord") % 3 == 0, F.col("quantity")).alias("quantity"))
    return lines.accumulate_elements(rows).select("doc_id", "key", "positions", "name", "quantity", "page_num")


@query("w14_parse_notes")
def w14(spark, path):
    d = S.raw_lines(spark, path)
    k = F.col("doc_id") + F.col("ord")
    text = (F.when(k % 25 == 24, F.lit("Журнал № 1, запись № 2.")).when(k % 9 == 0, F.lit(" Примечания: "))
            .when(k % 3 == 0, F.concat(F.lit(" - "), "line")).otherwise(F.col("line")))
    return lines.parse_notes(d.withColumn("line", text))


@query("a17_best_set")
def a17(spark, path):
    d = S.raw_lines(spark, path)
    starts = d.withColumn("number", F.regexp_extract("line", R.START, 1).try_cast("int")).filter("number is not null")
    return R.best_set(starts.select("doc_id", F.col("page_num").alias("candidate"), "number"), ["doc_id"])


@query("a17_best_blocks")
def a17_blocks(spark, path):
    block = F.floor(F.col("ord") / 4).cast("int")
    alone = F.regexp_extract("line", r"^(\d{1,2}) ", 1)
    d = S.raw_lines(spark, path).withColumns({"block_no": block, "x0": (block * 37 % 3) * 50.0})
    d = d.withColumn("line", F.when((block % 3 == 0) & (alone != ""), alone).when((F.col("doc_id") % 3 == 0) & (F.col("page_num") == 1) & (alone != ""), F.concat(alone, F.lit(" Экран"))).otherwise(F.col("line")))
    return R.best_blocks(d, d.select("doc_id", "page_num", "ord", "line"))


@query("o02_best_title")
def o02(spark, path):
    d = S.raw_lines(spark, path).withColumn("line", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Изм Дата "), "line")).otherwise(F.col("line")))
    return lines.best_title(d, ("the", "les", "section"), ("anin", "лист"))


@query("u04_merge_sets")
def u04(spark, path):
    both = S.requirements(spark, path, 1).withColumn("v", F.lit(1)).unionByName(S.requirements(spark, path, 2).withColumn("v", F.lit(2)))
    return dedupe.last_wins(both, ["doc_id", "number"], ["v", "text"])


@query("a14_ordered_distinct")
def a14(spark, path):
    d = S.requirements(spark, path, 2).withColumn("ord", F.col("number") * 2)
    return dedupe.ordered_distinct(d.select("doc_id", "ord", "text"), ["doc_id"], "text", "ord", F.lower(T.squeeze(F.col("text"))))


@query("j06_exact_text_match")
def j06(spark, path):
    a, b = R.exact_leftovers(S.requirements(spark, path, 1), S.requirements(spark, path, 2))
    return a.select("doc_id", F.lit("old").alias("side"), "number", "text").unionByName(b.select("doc_id", F.lit("new").alias("side"), "number", "text"))


def leftovers(spark, path):
    return R.exact_leftovers(S.requirements(spark, path, 1), S.requirements(spark, path, 2), place=True)


@query("j07_fuzzy_pairs_tokens")
def j07_tokens(spark, path):
    return R.fuzzy_pairs(*leftovers(spark, path), use_ratio=False).select("doc_id", "l_number", "r_number", "shared", "score", "rank")


@query("j07_fuzzy_pairs")
def j07(spark, path):
    return R.fuzzy_pairs(*leftovers(spark, path)).select("doc_id", "l_number", "r_number", "shared", "score", "rank")


def diff(spark, path, use_ratio=True):
    return R.requirement_diff(S.requirements(spark, path, 1), S.requirements(spark, path, 2), use_ratio)


@query("j08_requirement_diff")
def j08(spark, path):
    return diff(spark, path)


@query("j08_requirement_diff_tokens")
def j08_tokens(spark, path):
    return diff(spark, path, False)


@query("o03_diff_order")
def o03(spark, path):
    d = diff(spark, path, False).select("doc_id", "number", "status", "v1_number", "v2_number")
    return d.orderBy("doc_id", *R.diff_order())


@query("a08_requirement_facts")
def a08(spark, path):
    return R.requirement_facts(stage(diff(spark, path)), TOPICS)


def simple_facts(spark, path):
    """Facts that SQL can follow: each line is added, removed or modified by rule."""
    d = S.requirements(spark, path, 1)
    kind = F.when(F.col("number") % 3 == 0, "added").when(F.col("number") % 3 == 1, "removed").otherwise("modified")
    return d.select("doc_id", F.concat(F.lit("tech_requirement_"), kind).alias("fact_type"), T.summarize(F.col("text"), TOPICS).alias("description"),
                    F.when(kind != "added", F.col("number")).alias("number_old"), F.when(kind != "removed", F.col("number")).alias("number_new"),
                    F.when(kind != "added", F.col("text")).alias("old_value"), F.when(kind != "removed", F.col("text")).alias("new_value"))


@query("j16_supplied_topics")
def j16(spark, path):
    topics = S.requirements(spark, path, 1).filter("number % 2 = 0").select(
        "doc_id", "number", F.when(F.col("number") % 3 == 0, "added").when(F.col("number") % 3 == 1, "removed").otherwise("modified").alias("status"),
        F.when(F.col("number") % 4 == 0, F.lit(" О пробном textes; ")).otherwise(F.lit("скру...тке")).alias("topic"))
    t = R.with_topics(simple_facts(spark, path), topics, TOPICS)
    return t.select("doc_id", "number", "status", "topic", R.requirement_phrase(F.col("fact_type"), F.col("number"), F.col("topic")).alias("phrase"))


@query("j17_note_coverage")
def j17(spark, path):
    n, d = F.col("number"), F.col("doc_id")
    facts = simple_facts(spark, path).withColumn("number", F.coalesce("number_new", "number_old")).withColumns({
        "fact_type": F.when((d % 8 == 0) & (n == 3), "graphics_changed").otherwise(F.col("fact_type")),
        "topic": F.concat(F.lit("строке "), (n % 5).cast("string"))})
    phrase = R.requirement_phrase(F.col("fact_type"), n, F.col("topic"))
    note = (F.when((n == 1) & (d % 7 == 0), F.lit("Изменена графика")).when((n == 1) & (d % 9 == 0), "Масса 5").when((n == 2) & (d % 6 == 0), "аннулирован")
            .when((n == 3) & (d % 31 == 0), "Бирки термоусадить").when((n == 4) & (d % 13 == 0), "введено требование").when((n == 2) & (d % 17 == 0), "и так далее…")
            .when((d + n) % 23 == 0, F.concat(F.lit("п. "), n.cast("string"), F.lit(" стал другим"))).when((d * n) % 29 == 5, "изменен пункт о строке")
            .otherwise(F.concat(F.lit("- "), F.upper(F.substring(phrase, 1, 1)), F.substr(phrase, F.lit(2)), F.lit(" (п. "), n.cast("string"), F.lit(");"))))
    return R.coverage_reasons(facts, facts.withColumn("fact_type", F.concat(F.lit("tech_requirement_"), F.when(n % 3 == 0, "added").when(n % 3 == 1, "removed").otherwise("modified")))
                              .select("doc_id", note.alias("note")))
