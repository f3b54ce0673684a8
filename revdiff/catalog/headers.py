"""Queries on document headers, sheets, page scores and configuration maps."""

from pyspark.sql import functions as F

from revdiff import snapshots as S
from revdiff.catalog.base import query
from revdiff.functions import fields as X
from revdiff.functions import text as T
from revdiff.operators import diff, sheets, stamp
from revdiff.sources import sinks, versions


@query("s02_accept_files")
def s02(spark, path):
    ok, bad = versions.route_files(S.table(spark, path, "pages"), "url", "#TOP")
    return ok.select("page_id", "url", F.lit(True).alias("accepted")).unionByName(
        bad.select("page_id", "url", F.lit(False).alias("accepted")))


@query("s04_notice_file_name")
def s04(spark, path):
    d = S.headers(spark, path, 1)
    return d.select("doc_id", sinks.notice_file_name(F.concat(F.lit(" И/И:"), F.col("notice_id").cast("string"), F.lit("  x?")),
                                                     F.col("decimal_number")).alias("file_name"))


@query("p08_document_type")
def p08(spark, path):
    d = S.headers(spark, path, 1)
    bare = F.when(F.col("doc_id") % 3 == 0, F.regexp_extract("decimal_number", "^[0-9]+", 0)).otherwise(F.col("decimal_number"))
    stamp = F.when(F.col("doc_id") % 9 == 0, F.concat("stamp_text", F.lit(" Спецификация"))).otherwise(F.col("stamp_text"))
    return d.select("doc_id", X.resolve_type(stamp, bare, F.col("doc_id") % 7 == 0, F.col("doc_id") % 11 == 0,
                                             F.col("doc_id") % 12 == 0, F.when(F.col("doc_id") % 2 == 0, "Не определён")
                                             .otherwise("")).alias("doc_type"),
                    X.type_by_number(bare, F.lit("")).alias("by_number"))


@query("p11_effective_metadata")
def p11(spark, path):
    return diff.effective_metadata(S.headers(spark, path, 1), S.headers(spark, path, 2), "doc_id",
                                   ["decimal_number", "title", "scale"], ["mass_kg"])


@query("p12_clean_status_map")
def p12(spark, path):
    d = S.sheets(spark, path).groupBy("doc_id").agg(F.max("page_num").alias("p"), F.max("status").alias("s"), F.min("change_token").alias("c"))
    raw = F.create_map(F.col("p").cast("string"), F.when(F.col("s") == "Нов.", " NEW ").otherwise("old"),
                       F.concat("c", F.lit("x")), F.lit("new"), F.lit("900"), F.lit("replace"))
    m = diff.clean_status_map(raw)
    return d.select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws(
        "=", e["key"].cast("string"), e["value"]))), ",").alias("statuses"))


@query("p14_first_value")
def p14(spark, path):
    e = S.table(spark, path, "events")
    return e.select("event_id", X.first_path(F.col("props"), ["$.result.change_number", "$.k"]).alias("value"),
                    X.resolve_change_number(F.col("props"), ["$.change_number"], ["$.old", "$.k"]).alias("next_number"))


@query("p15_mask_secrets")
def p15(spark, path):
    m = S.secret_maps(spark, path)
    masked = X.mask_map(F.col("config"))
    return m.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.concat_ws(
        "|", masked["api_key"], masked["model"], masked["nested.token"]).alias("masked")).unionByName(
        S.table(spark, path, "documents").filter(F.lower("text").rlike("token|secret|password|api_key")).select(
            F.lit("document"), F.col("doc_id"), X.mask_assignments(F.col("text"))).toDF("kind", "id", "masked"))


@query("j05_metadata_facts")
def j05(spark, path):
    return diff.metadata_facts(S.headers(spark, path, 1), S.headers(spark, path, 2))


@query("f08_document_number")
def f08(spark, path):
    d = S.headers(spark, path, 1)
    k = F.col("doc_id")

    def two(m):
        return F.lpad((k % m).cast("string"), 2, "0")

    number = F.concat(F.when(k % 2 == 0, "АБВГ.").otherwise(""), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("."), two(100), F.lit("."),
                      two(97), F.lit("."), two(89), F.lit("."), F.lpad((k % 999).cast("string"), 3, "0"))
    text = F.concat(F.lit("Изм. Лист "), number, F.when(k % 5 < 3, F.regexp_extract("decimal_number", " .*$", 0)).otherwise(""),
                    F.when(k % 5 == 4, " см. сб").otherwise(""), F.when((k % 6 == 0) | (k % 7 == 1), "x").otherwise(" x"))
    d = X.with_document_number(d.withColumn("text", text), "text", "found")
    found = F.col("found")
    return d.select("doc_id", found.alias("number"), X.ensure_suffix(found, F.when(k % 4 == 0, F.lit("Сборочный чертёж"))).alias("full_number"),
                    X.base_number(F.col("decimal_number")).alias("base"))


@query("f09_scale_and_mass")
def f09(spark, path):
    d = S.headers(spark, path, 1)
    stamp = F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("См. табл "), F.col("stamp_text"))).otherwise(F.col("stamp_text"))
    return d.select("doc_id", X.scale_of(stamp).alias("scale"), X.mass_of(stamp).alias("mass_kg"))


def stamp_lines(spark, path):
    """Lines of three parts around a stamp; which of them say what depends on the document."""
    d = S.headers(spark, path, 1)
    k = F.col("doc_id")
    number = F.concat(F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad((k % 97).cast("string"), 2, "0"), F.lit(".01.02."), F.lpad((k % 999).cast("string"), 3, "0"))
    named, bare = F.concat(F.lit("АБВГ."), number), number

    def line(part, ord_, text):
        return F.struct(F.lit(part).alias("part"), F.lit(1).alias("page_num"), F.lit(ord_).alias("ord"), text.alias("line"))

    rows = [line(0, 1, F.when(k % 4 == 0, F.concat(F.lit("x "), bare)).otherwise("Лист Листов")), line(0, 2, F.when(k % 4 == 0, F.when(k % 3 == 0, named).otherwise("Подп."))),
            line(0, 3, F.when(k % 5 == 0, F.concat(F.lit("масса "), (k % 50).cast("string"), F.lit(",5 1:2")))), line(0, 4, F.when(k % 7 == 0, F.lit("чертеж СБ"))),
            line(1, 1, F.when(k % 4 == 1, F.concat(F.lit("инв"), bare, F.lit("x")))), line(1, 2, F.when(k % 3 == 1, F.lit("см. табл 7,5 1 : 4"))), line(1, 3, F.when(k % 7 == 1, F.lit("лист Э4"))),
            line(2, 1, F.when(k % 4 == 2, F.concat(bare, F.lit(" ПЭ4")))), line(2, 2, F.when(k % 6 == 0, F.lit("12.25 1:10"))), line(2, 3, F.when(k % 11 == 0, F.lit("См. ТТ")))]
    return d.select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*").withColumn("line", F.coalesce("line", F.lit("")))


@query("f08_f09_document_fields")
def f08_f09(spark, path):
    words = S.headers(spark, path, 1).select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.lit(3.5)).alias("mass_kg"))
    return stamp.document_fields(stamp_lines(spark, path), words)


@query("o02_stamp_titles")
def o02_titles(spark, path):
    d = S.headers(spark, path, 1)
    k = F.col("doc_id")
    a = F.when(k % 4 == 0, F.concat(F.lit("Жгут питания "), "decimal_number")).when(k % 4 == 1, "Кабель  связи").when(k % 4 == 2, "Блок формат А4").otherwise("")
    b = F.when(k % 3 == 0, "Изм. Лист № докум. Подп. Дата Корпус прибора").when(k % 3 == 1, "Дата 1:2 корпус").otherwise("Подп. Дата Сборочный чертеж прибора")
    c = F.when(k % 5 == 2, "АБВГ.123").when(k % 5 < 2, "Стойка левая 1:4")
    rows = [F.struct(F.lit(part).alias("part"), F.lit(i).alias("ord"), x0.alias("x0"), line.alias("line")) for part, i, x0, line in (
        (0, 1, F.lit(600.0), a), (0, 2, F.lit(600.0), b), (0, 3, F.when(k % 5 == 1, 10.0).otherwise(600.0), c), (1, 1, F.lit(10.0), F.lit("Переходник О")))]
    docs = d.select("doc_id", F.col("decimal_number").alias("number"), F.when(k % 2 == 0, "Сборочный чертеж").otherwise("Не определён").alias("doc_type"), F.lit(S.PAGE_W).alias("page_width"))
    return stamp.titles(d.select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*"), docs)


@query("f10_sheet_marks")
def f10(spark, path):
    s = S.sheets(spark, path).distinct()
    stamp = F.concat(F.lit("Лист Листов "), F.col("page_num").cast("string"), F.when(F.col("page_num") % 2 == 0, " 12").otherwise(" x"))
    return s.select("doc_id", "page_num", "change_token", "linestatus", X.sheet_status(F.col("status")).alias("sheet_status"),
                    X.status_change_number(F.col("change_token")).alias("glued_number"),
                    X.change_number(F.col("change_token")).alias("change_number"), X.sheet_count(stamp).alias("sheet_count"))


@query("a13_document_scores")
def a13(spark, path):
    return diff.document_scores(diff.align_pages(S.page_scores(spark, path, 1), S.page_scores(spark, path, 2)))


@query("j18_align_pages")
def j18(spark, path):
    return diff.align_pages(S.page_scores(spark, path, 1), S.page_scores(spark, path, 2))


def sheet_counts(spark, path):
    s = S.sheets(spark, path)
    return s.groupBy("doc_id").agg(F.max(F.when(F.col("linestatus") == "F", F.col("page_num"))).alias("old_count"),
                                   F.max("page_num").alias("new_count"))


def changed(spark, path):
    s = S.sheets(spark, path)
    limits = sheet_counts(spark, path).select("doc_id", F.coalesce("old_count", "new_count").alias("max_page"))
    return sheets.changed_pages([s.filter("status = 'Зам.'"), S.page_scores(spark, path, 2).filter("score > 0.35"),
                                 s.filter("linestatus = 'O'").select("doc_id", F.lit(1).alias("page_num"))], limits)


@query("a15_changed_pages")
def a15(spark, path):
    return changed(spark, path)


@query("w13_page_ranges")
def w13(spark, path):
    return sheets.page_ranges(S.sheets(spark, path).filter("status <> ''"))


@query("a16_sheet_facts")
def a16(spark, path):
    stamp = F.concat(F.lit("Лист Листов "), ((F.col("doc_id") + F.col("page_num")) % 12).cast("string"))
    return sheets.sheet_facts(S.sheets(spark, path).withColumn("stamp_text", stamp))


@query("u02_action_text")
def u02(spark, path):
    s = S.sheets(spark, path)
    mark = X.sheet_status(F.col("status"))
    marked = s.select("doc_id", "page_num", mark.alias("m")).distinct()
    per_doc = marked.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("m") == "replace", F.col("page_num"))).alias("replaced"),
        F.collect_set(F.when((F.col("m") == "new") & (F.col("page_num") > 5), F.col("page_num"))).alias("introduced"))
    pages = changed(spark, path).groupBy("doc_id").agg(F.collect_set("page_num").alias("changed"))
    docs = sheet_counts(spark, path).join(per_doc, "doc_id").join(pages, "doc_id", "left").withColumn(
        "replaced", F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.col("replaced")))
    return sheets.action_text(docs)
