"""Deterministic two-version snapshots derived from the given tables.

Each function reads parquet tables below `path` and yields element frames of version 1 or 2, so
that every operator can be run on whole tables. Nothing is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revdiff.functions import text as T
from revdiff.operators.scan import by_position, chunk_if_large, number_rows

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_shipdate"]
TABLE_COLUMNS = ["Код", "Наименование", "Длина, мм", "Кол.", "Маркировка / XP1"]
PAGE_W, PAGE_H = 700.0, 320.0


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


# ---- item lists ------------------------------------------------------------------------------

def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """lineitem with `ord`, the row's place within its order."""
    lines = table(spark, path, "lineitem").select("l_orderkey", "l_returnflag", *LINE_ORDER)
    chunk = F.struct("l_linenumber", F.floor(F.col("l_partkey") / 4096))
    return number_rows(lines, ["l_orderkey"], LINE_ORDER, chunk_if_large(lines, ["l_orderkey"], chunk), "ord")


def items(spark: SparkSession, path: str, version: int, with_ord: bool = True, base: DataFrame | None = None) -> DataFrame:
    """Item lists; `base`, if given, is version 1 as staged by the caller, so that it is worked out once for both versions."""
    base = _first_items(spark, path, with_ord) if base is None else base
    if version == 1:
        return base
    h = F.col("doc_id") * 7 + F.col("position")
    return base.filter(h % 29 != 0).withColumns({
        "quantity": F.when(h % 17 == 0, (F.col("quantity").cast("int") + 1).cast("string")).otherwise(F.col("quantity")),
        "note": F.when(h % 19 == 0, F.lit("X")).otherwise(F.col("note")),
        "position": F.when(h % 31 == 0, F.col("position") + 100).otherwise(F.col("position")),
    })


def _first_items(spark: SparkSession, path: str, with_ord: bool) -> DataFrame:
    if with_ord:
        lines = line_numbers(spark, path)
        rank = [F.col("ord").cast("int").alias("ord")]
    else:
        # the full row order is enough to break ties; no numbering needed
        lines = table(spark, path, "lineitem")
        rank = [F.struct(*LINE_ORDER).alias("ord")]
    parts = table(spark, path, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("p_type").alias("section"),
        F.col("l_linenumber").alias("position"),
        F.col("p_brand").alias("designation"),
        F.col("p_name").alias("name"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity"),
        F.col("l_returnflag").alias("note"),
        (1 + F.col("l_linenumber") % 3).cast("int").alias("page_num"),
        *rank,
    )


def elements(spark: SparkSession, path: str, version: int, with_ord: bool = True, base: DataFrame | None = None) -> DataFrame:
    return items(spark, path, version, with_ord, base).withColumn(
        "positions", F.concat(F.lit("E"), F.col("position").cast("string"))).drop("section")


def parts(spark: SparkSession, path: str, version: int) -> DataFrame:
    base = table(spark, path, "part").select(
        F.lit(1).cast("long").alias("doc_id"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"),
        F.col("p_size").alias("size"))
    if version == 1:
        return base
    return (base.filter("key % 97 <> 0")
            .withColumn("key", F.expr("if(key % 89 = 0, key + 1000000, key)"))
            .withColumn("size", F.expr("if(key % 13 = 0, size + 1, size)")))


# ---- tables of cells -------------------------------------------------------------------------

def column_names() -> Column:
    return F.array(*map(F.lit, TABLE_COLUMNS))


def table_rows(spark: SparkSession, path: str, version: int, base: DataFrame | None = None) -> DataFrame:
    """One row per table row: header first, data on odd indexes, a repeated header in every fifth table."""
    data = items(spark, path, version, base=base)
    head = dict(
        table_id=F.col("doc_id"),
        table_name=F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Таблица "), (1 + F.col("doc_id") % 4).cast("string")))
        .otherwise(F.lit("Table")),
    )
    body = data.withColumns(head).select(
        "doc_id", "table_id", "table_name", "page_num", (2 * F.col("ord") + 1).cast("int").alias("row_index"),
        F.array("designation", F.when(F.col("ord") % 3 == 2, "").otherwise(F.col("name")), "section",
                "quantity", "note").alias("cells"))
    docs = data.groupBy("doc_id").agg(F.min("page_num").alias("page_num")).withColumns(head)
    repeats = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(1), F.lit(4))).otherwise(F.array(F.lit(1)))
    headers = docs.select("doc_id", "table_id", "table_name", "page_num", F.explode(repeats).alias("row_index"),
                          column_names().alias("cells"))
    return body.unionByName(headers)


def item_tables(spark: SparkSession, path: str, base: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables of items as they are read: up to three to a document, two column orders, section, service and repeated head rows between the items."""
    d = items(spark, path, 1, base=base)
    o, k = F.col("ord"), F.col("doc_id") + F.col("ord")
    table_id = F.col("doc_id") * 8 + F.col("ord") % 3
    wide = table_id % 4 != 1
    head = {True: ["Формат", "Зона", "Поз.", "Обозначе-ние\nдок", "Наимено- вание", "Кол.", "Примечание"], False: ["Наименование", "Обозначение", "Кол", "Поз", "Примеч."]}

    def of(texts) -> Column:
        return F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])

    position = F.when(k % 3 != 1, F.col("position").cast("string")).otherwise("")
    item = F.when(wide, of([F.when(k % 4 == 0, "А4").otherwise(""), "", position, F.concat(F.lit(" "), "designation"), *map(F.col, ("name", "quantity", "note"))])).otherwise(
        of([*map(F.col, ("name", "designation", "quantity")), position, F.col("note")]))
    section = F.when(k % 2 == 0, of(["", "Прочие  изделия", "", "", ""])).otherwise(of(["", "раздел: документация", ""]))
    service = of(["Изм.", "Лист", "№ докум.", "Подп.", "Дата"])
    at = 10 + 4 * o
    made = [F.struct(at.alias("row_index"), item.alias("cells")), F.when(k % 5 == 0, F.struct((at - 1).alias("row_index"), section.alias("cells"))),
            F.when(k % 7 == 0, F.struct((at + 1).alias("row_index"), service.alias("cells"))),
            F.when(k % 6 == 0, F.struct((at + 2).alias("row_index"), of(["ФОР-МАТ", "x", "y", "z", "w"]).alias("cells")))]
    body = d.select("doc_id", table_id.alias("table_id"), F.explode(F.filter(F.array(*made), lambda r: r.isNotNull())).alias("r")).select("doc_id", "table_id", "r.row_index", "r.cells")
    t = d.select("doc_id", table_id.alias("table_id")).distinct()
    tid = F.col("table_id")
    top = [F.struct(F.lit(1).alias("row_index"), of(["Список", ""]).alias("cells")),
           F.struct(F.lit(3).alias("row_index"), F.when(tid % 4 != 1, of(head[True])).otherwise(of(head[False])).alias("cells")),
           F.struct(F.lit(4).alias("row_index"), F.when(tid % 11 == 0, of(["Материала", "нет", "x"])).when(tid % 13 == 0, of(["нет"])).otherwise(of(["", "Материалы"])).alias("cells"))]
    rows = body.unionByName(t.select("doc_id", "table_id", F.explode(F.array(*top)).alias("r")).select("doc_id", "table_id", F.col("r.row_index").alias("row_index"), F.col("r.cells").alias("cells")))
    boxes = t.select("doc_id", "table_id", (1 + tid % 2).cast("int").alias("page_num"), (tid % 3 * 10.0).alias("x0"), (tid % 5 * 20.0).alias("y0"))
    return boxes, rows.select("table_id", F.col("row_index").cast("int").alias("row_index"), "cells")


# ---- numbered texts and raw lines ------------------------------------------------------------

def document_lines(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return docs.filter(F.trim("line") != "").select(
        "doc_id", (F.col("pos") + 1).cast("int").alias("number"), F.trim("line").alias("text"))


def requirements(spark: SparkSession, path: str, version: int) -> DataFrame:
    base = document_lines(spark, path)
    if version == 1:
        return base
    d, n = F.col("doc_id"), F.col("number")
    text = F.when((d * 3 + n) % 11 == 0, F.concat("text", F.lit(" revised"))).otherwise(F.col("text"))
    edited = (base.filter((d + n) % 23 != 0)
              .select("doc_id", F.when(d % 2 == 0, n + 1).otherwise(n).alias("number"),
                      F.when(d % 7 == 0, F.translate(text, "AEKMHOPCTX", "АЕКМНОРСТХ")).otherwise(text).alias("text")))
    added = (table(spark, path, "documents").filter(d % 5 == 0)
             .select("doc_id", F.lit(99).alias("number"),
                     F.concat(F.lit("Added requirement "), d.cast("string")).alias("text")))
    return edited.unionByName(added)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Section lines, numbered starts and continuations, in document order."""
    d, n = F.col("doc_id"), F.col("number")
    return document_lines(spark, path).select(
        "doc_id", n.alias("ord"), (1 + F.floor(n / 20)).cast("int").alias("page_num"),
        F.when((d + n) % 10 == 0, F.concat(F.lit("Section "), n.cast("string")))
        .when((d + n) % 4 == 0, F.concat(n.cast("string"), F.lit(" "), F.col("text")))
        .otherwise(F.col("text")).alias("line"))


def raw_lines_split(spark: SparkSession, path: str) -> DataFrame:
    """As raw_lines, with every item number on a line of its own before its text's second half."""
    d, n = F.col("doc_id"), F.col("number")
    service = (d + n) % 10 == 0
    start = ((d + n) % 4 == 0) & ~service
    lines = document_lines(spark, path).withColumn("text", F.when(service, F.lit("Дата")).otherwise(F.col("text")))
    return lines.select(
        "doc_id", F.posexplode(F.when(start, F.array(F.col("text"), (n % 90).cast("string"))).otherwise(F.array("text")))
        .alias("part", "line"), "number").select(
        "doc_id", (2 * F.col("number") + F.col("part")).cast("int").alias("ord"), "line")


# ---- words and boxes -------------------------------------------------------------------------

def words(spark: SparkSession, path: str) -> DataFrame:
    split = table(spark, path, "documents").select(
        "doc_id", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("i", "text"))
    r = F.col("i") % 200
    line = F.floor(r / 10).cast("int")
    x0 = ((r % 10) * 60 + F.when(F.col("i") % 7 == 0, 45).otherwise(0)).cast("double")
    y0 = line * 14 + (F.col("i") % 3) * 0.5
    return split.select(
        "doc_id", F.col("i").cast("int").alias("i"), (1 + F.floor(F.col("i") / 200)).cast("int").alias("page_num"),
        line.alias("line"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 6 * F.least(F.char_length("text"), F.lit(9))).alias("x1"), (y0 + 10).alias("y1"), "text",
        F.floor(line / 5).cast("int").alias("block_no"), (line % 5).alias("line_no"))


def diagram_words(spark: SparkSession, path: str, version: int) -> DataFrame:
    """All words, some of them made into parts of a connection diagram or of a stamp; the second version changes some of those."""
    w = words(spark, path)
    k, n = (F.col("doc_id") * 7 + F.col("i") * 13) % 50, F.col("doc_id") + F.col("i")
    if version == 2:
        k = F.when(n % 97 == 0, (k + 1) % 50).otherwise(k)
    made = (F.when(k < 3, F.concat(F.lit("хр"), (F.col("i") % 9).cast("string"), F.lit("a")))
            .when(k < 8, F.lpad((F.col("i") % 40).cast("string"), 3, "0")).when(k == 8, F.lit("б/Н")).when(k < 11, F.lit(" Корпус"))
            .when(k < 20, (F.col("i") % 30).cast("string")).when(k < 22, F.lit("ж")).when(k == 22, F.lit("№"))
            .when((k == 23) & (n % 4 == 0), F.lit("Лит.")).when((k == 24) & (n % 3 == 0), F.lit("А1")).when((k == 25) & (n % 5 == 0), F.lit("о."))
            .when((k == 26) & (n % 5 == 0), F.lit("литера: Б")).when((k == 27) & (n % 3 == 0), F.lit("Изм")))
    return w.withColumn("text", F.coalesce(made, F.col("text")))


def line_boxes(spark: SparkSession, path: str) -> DataFrame:
    return words(spark, path).groupBy("doc_id", "page_num", F.col("line").alias("ord")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def near_duplicate_boxes(spark: SparkSession, path: str) -> DataFrame:
    boxes = line_boxes(spark, path)
    shift = (F.col("ord") % 4) * 2.0
    return boxes.unionByName(boxes.select(
        "doc_id", "page_num", (F.col("ord") + 100).alias("ord"), (F.col("x0") + shift).alias("x0"), "y0",
        (F.col("x1") + shift).alias("x1"), "y1"))


# ---- document headers ------------------------------------------------------------------------

def headers(spark: SparkSession, path: str, version: int) -> DataFrame:
    k = F.col("o_orderkey")
    suffix = F.when(F.col("o_orderstatus") == "F", " СБ").when(F.col("o_orderstatus") == "O", " Э4").otherwise(" ПЭ4")
    scale = F.concat(F.lit("1:"), (1 + k % 5).cast("string"))
    base = table(spark, path, "orders").select(
        k.alias("doc_id"), F.col("o_custkey").alias("notice_id"),
        F.concat(k.cast("string"), suffix).alias("decimal_number"),
        (F.floor(F.col("o_totalprice") / 100) / 10.0).alias("mass_kg"), scale.alias("scale"),
        F.col("o_orderpriority").alias("title"),
        F.when(k % 4 != 0, (k % 9).cast("string")).alias("change_number"),
        F.concat(F.lit("Масса Масштаб "), (k % 50).cast("string"), F.lit(",5 "), scale).alias("stamp_text"))
    if version == 1:
        return base
    d = F.col("doc_id")
    return base.withColumns({
        "mass_kg": F.when(d % 10 == 0, F.col("mass_kg") + 1).otherwise(F.col("mass_kg")),
        "scale": F.when(d % 11 == 0, F.lit("1:10")).otherwise(F.col("scale")),
        "title": F.when(d % 13 == 0, F.lit(None)).when(d % 7 == 0, F.concat("title", F.lit(" new")))
        .otherwise(F.col("title")),
    })


def incoming_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of an upsert: some known ones with new values, some unknown ones."""
    new = headers(spark, path, 2)
    return new.filter("doc_id % 3 = 0").unionByName(
        new.filter("doc_id % 50 = 0").withColumns({
            "doc_id": F.col("doc_id") + 1000000,
            "decimal_number": F.regexp_replace("decimal_number", "^[0-9]+", (F.col("doc_id") + 1000000).cast("string")),
        }))


# ---- sheets, page scores, secrets ------------------------------------------------------------

def sheets(spark: SparkSession, path: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "Зам.").when(F.col("l_returnflag") == "R", "Нов.").otherwise("")
    return table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_num"), status.alias("status"),
        F.concat((F.col("l_suppkey") % 12).cast("string"), status).alias("change_token"),
        F.col("l_linestatus").alias("linestatus"))


def page_scores(spark: SparkSession, path: str, version: int) -> DataFrame:
    pages = table(spark, path, "lineitem").groupBy(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_num")).agg(
        (F.max("l_discount") * 10).alias("score"))
    return pages if version == 1 else pages.filter((F.col("doc_id") + F.col("page_num")) % 6 != 0)


def secret_maps(spark: SparkSession, path: str) -> DataFrame:
    e = table(spark, path, "events")
    return e.select("event_id", F.create_map(
        F.lit("api_key"), F.concat("event_type", F.col("event_id").cast("string")),
        F.lit("model"), F.col("event_type"),
        F.lit("nested.token"), F.col("user_id").cast("string")).alias("config"))


# ---- table differences -----------------------------------------------------------------------

WIRE_NAMES = ["Провод", "Обозначение провода", "Длина, мм", "От соединителя", "Код"]
POSITION_NAMES = ["Поз.", "Обозначение провода", "Длина", "От соединителя"]


def table_differences(spark: SparkSession, path: str, base: DataFrame | None = None) -> DataFrame:
    """Differences of wire, marking and code tables, forty orders to a document."""
    d = items(spark, path, 1, base=base)
    sel = (F.col("doc_id") + F.col("ord")) % 8
    wire = F.lpad("quantity", 3, "0")
    doc = F.floor(F.col("doc_id") / 40).cast("long")

    def pick(*values):
        return F.element_at(F.array(*values), (sel + 1).cast("int"))

    return d.select(
        doc.alias("doc_id"), ((F.col("doc_id") % 40) * 1000 + F.col("ord")).cast("int").alias("ord"),
        F.when(doc % 3 == 0, F.lit("Таблица присоединений")).otherwise(
            F.concat(F.lit("Таблица "), (1 + F.col("position") % 2).cast("string"))).alias("table_name"),
        F.when(sel == 0, F.array(*map(F.lit, POSITION_NAMES))).otherwise(F.array(*map(F.lit, WIRE_NAMES))).alias("names"),
        pick(*map(F.lit, ["Поз.", "Провод", "Длина, мм", "Провод"]), F.concat(F.lit("Маркировка / ХР"), (1 + F.col("position") % 3).cast("string")),
             *map(F.lit, ["Код", "Код", "От соединителя"])).alias("col_name"),
        pick(*[F.lit(i) for i in (1, 1, 3, 1, 4, 5, 5, 4)]).alias("col_index"),
        pick(F.col("position").cast("string"), wire, wire, wire, F.col("designation"), F.col("designation"),
             F.concat("designation", F.lit(" | x")), F.lit("б/н")).alias("row_key"),
        F.col("designation").alias("key_cell"),
        pick(*map(F.lit, ["row_added", "row_removed", "modified", "row_added", "modified", "row_added", "row_removed", "added"])).alias("status"),
        F.col("quantity").alias("v1_val"), F.col("note").alias("v2_val"), F.lit(10).alias("table_data_rows"),
        F.array("designation", "name", "quantity").alias("values"))


def numeric_subjects(spark: SparkSession, path: str) -> DataFrame:
    """Distinct part numbers per forty orders, some with a letter."""
    lines = table(spark, path, "lineitem")
    n = F.col("l_partkey") % 300
    text = F.lpad(n.cast("string"), 3, "0")
    return lines.select(F.floor(F.col("l_orderkey") / 40).cast("long").alias("doc_id"),
                        F.when(n % 17 == 0, F.concat(text, F.lit("A"))).otherwise(text).alias("subject")).distinct()


def document_tables(spark: SparkSession, path: str, version: int = 1, base: DataFrame | None = None) -> DataFrame:
    """Eight tables to a document, some of them pieces of a numbered one."""
    t = items(spark, path, 1, with_ord=False, base=base).select(F.col("doc_id").alias("table_id")).distinct()
    k = F.col("table_id")
    doc = F.floor(k / 8).cast("long")
    number = (1 + doc % 3).cast("string")
    name = (F.when(k % 4 == 0, F.concat(F.lit("Таблица "), number)).when(k % 4 == 1, F.concat(F.lit("Продолжение таблицы "), number))
            .when(k % 4 == 2, F.concat(F.lit("Таблица "), (4 + doc % 3).cast("string"))).otherwise(F.lit("Прочее")))
    x0, y0 = (k % 3) * 10.0, (k % 5) * 20.0
    names = F.when(k % 5 == 1, F.concat(column_names(), F.array(F.lit("")))).otherwise(column_names())
    base = t.select(doc.alias("doc_id"), "table_id", (1 + k % 8).cast("int").alias("page_num"), x0.alias("x0"), y0.alias("y0"),
                    (x0 + 100 + k % 7).alias("x1"), (y0 + 30).alias("y1"), name.alias("name"), names.alias("names"), F.lit(1).alias("header_rows"))
    if version == 1:
        return base
    return base.filter("table_id % 11 <> 0").withColumns({
        "page_num": F.when(k % 7 == 0, F.col("page_num") + 1).otherwise(F.col("page_num")),
        "names": F.when(k % 6 == 0, F.slice("names", 1, 3)).otherwise(F.col("names")),
    })
