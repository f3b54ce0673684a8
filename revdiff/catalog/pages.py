"""Queries on positioned words and boxes."""

from pyspark.sql import functions as F

from revdiff import snapshots as S
from revdiff.catalog.base import query
from revdiff.functions import boxes as B
from revdiff.operators import diff
from revdiff.operators import geometry as G
from revdiff.operators import schematic as C
from revdiff.staging import stage

PAGE = ["doc_id", "page_num"]


def page():
    return F.lit(S.PAGE_W), F.lit(S.PAGE_H)


@query("f06_overlap_share")
def f06(spark, path):
    d = S.line_boxes(spark, path)
    return d.select(*PAGE, "ord", B.overlap_share(B.box(), B.title_block(*page())).alias("share"))


@query("f07_iou")
def f07(spark, path):
    d = S.line_boxes(spark, path)
    return d.select(*PAGE, "ord", B.iou(B.box(), B.title_block(*page(), expanded=True)).alias("iou"))


@query("p03_title_block_words")
def p03(spark, path):
    w = S.words(spark, path)
    width = F.when(F.col("doc_id") % 3 == 0, 3200.0).when(F.col("doc_id") % 3 == 1, 1600.0).otherwise(S.PAGE_W)
    scale = width / S.PAGE_W
    big = B.Box(F.col("x0") * scale, F.col("y0"), F.col("x1") * scale, F.col("y1"))
    inside = B.contains_centre(B.title_block(width, page()[1]), big)
    return w.select("doc_id", "i", inside.alias("inside"), B.contains_centre(B.title_block(width, page()[1], True), big).alias("inside_expanded")) \
        .filter("inside or inside_expanded")


@query("p05_noise_tables")
def p05(spark, path):
    w = S.words(spark, path)
    # a word carries its place as a prefix of one width, so a list of plain texts sorts like (i, text); no count of distinct values, which would shuffle the lists twice
    placed = F.concat(F.lpad(F.conv(F.col("i").cast("string"), 10, 36), 6, "0"), "text")
    joined = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(placed)), lambda x: F.substr(x, F.lit(7))), " "))
    t = w.groupBy(*PAGE, "block_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), joined.alias("flat"),
        F.size(F.collect_set("line")).alias("n_rows"), F.count("*").alias("n_cells"))
    name = F.when(F.col("doc_id") % 4 == 0, (F.col("page_num") % 30).cast("string")).otherwise("x")
    return t.select(*PAGE, "block_no", G.is_title_block(B.box(), *page(), F.col("flat"), F.col("n_rows"), F.col("n_cells")).alias("title_block"),
                    G.is_noise(B.box(), *page(), name, F.col("flat"), F.col("flat"), F.col("n_rows")).alias("noise"))


@query("w01_word_lines")
def w01(spark, path):
    return G.number_lines(S.words(spark, path)).select("doc_id", "i", "line_id")


@query("w01_word_lines_exact")
def w01_exact(spark, path):
    # rows pass through Python whole: only what orders them goes there
    w = S.words(spark, path).select("doc_id", "page_num", "i", "x0", "y0")
    return G.number_lines_exact(w).select("doc_id", "i", "band", "sub_line")


@query("w02_gap_segments")
def w02(spark, path):
    return G.segment(S.words(spark, path), [*PAGE, "line"], 45.0).select(*PAGE, "line", "segment", "text", "x0", "y0", "x1", "y1")


@query("w03_native_lines")
def w03(spark, path):
    return G.native_lines(S.words(spark, path), 80.0).select(*PAGE, "block_no", "line_no", "segment", "text", "x0", "y0", "x1", "y1")


@query("o01_reading_order")
def o01(spark, path):
    return S.near_duplicate_boxes(spark, path).orderBy("doc_id", "page_num", "y0", "x0", "ord")


@query("j10_excluded_boxes")
def j10(spark, path):
    d = S.line_boxes(spark, path)
    stamp = B.title_block(*page())
    excluded = d.select(*PAGE).distinct().select(*PAGE, stamp.x0.alias("x0"), stamp.y0.alias("y0"), stamp.x1.alias("x1"), stamp.y1.alias("y1"))
    return G.drop_overlapping(d, excluded).select(*PAGE, "ord")


@query("j11_near_duplicates")
def j11(spark, path):
    return G.drop_near_duplicates(S.near_duplicate_boxes(spark, path)).select(*PAGE, "ord")


@query("j11_near_duplicates_exact")
def j11_exact(spark, path):
    return G.keep_first_of_duplicates(S.near_duplicate_boxes(spark, path)).select(*PAGE, "ord")


def anchors(words):
    return words.filter(F.endswith("text", F.lit(".")))


@query("j12_band_join")
def j12(spark, path):
    w = stage(S.words(spark, path))
    return G.band_items(anchors(w), w, F.char_length("text") <= 2).select(*PAGE, "anchor", "left_pins", "right_pins", "signal")


@query("j13_nearest_neighbour")
def j13(spark, path):
    w = stage(S.words(spark, path))
    marks = anchors(w)
    below = G.nearest_below(marks, w.filter(F.char_length("text") <= 4)).select(
        *PAGE, F.lit("below").alias("kind"), F.col("header").alias("anchor"), "i", "text")
    left = G.nearest_left(marks, w.filter(F.char_length("text") <= 3)).select(
        *PAGE, F.concat(F.lit("left"), F.col("tier").cast("string")).alias("kind"), F.col("mark").alias("anchor"), "i", "text")
    return below.unionByName(left)


def conductor_rows(spark, path, version):
    return C.conductors(S.diagram_words(spark, path, version), S.PAGE_W, S.PAGE_H)


@query("j12_conductors")
def j12_conductors(spark, path):
    d = conductor_rows(spark, path, 1)
    return d.select(*PAGE, "i", "key", "signal", *[F.array_join(c, " ").alias(c) for c in ("left_pins", "right_pins", "housing_connectors")], "left_housing", "right_housing",
                    *[F.col(f"bbox.{c}").alias(c) for c in "xywh"])


@query("j04_schematic_diff")
def j04_schematic(spark, path):
    old, new = (C.last_of_key(conductor_rows(spark, path, v)) for v in (1, 2))
    return diff.connection_diff(old, new).select("doc_id", "has_changes", "change_percentage", *[F.col(f"bbox.{c}").alias(c) for c in "xywh"])


@query("j13_nearest_connector")
def j13_connector(spark, path):
    w = stage(S.diagram_words(spark, path, 1).withColumn("cx", (F.col("x0") + F.col("x1")) / 2.0).withColumn("name", C.connector_token(C.token(F.col("text")))))
    n = C.nearest_by_x(w.filter(F.lower(C.token(F.col("text"))) == "корпус"), w.filter(F.col("name").rlike("^XP[0-9]")))
    return n.select(*PAGE, "i", F.col("nearest.i").alias("connector_i"), F.col("nearest.name").alias("connector"))


@query("j13_code_letter")
def j13_letter(spark, path):
    w = S.diagram_words(spark, path, 1)
    return C.code_letters(w.withColumns({"part": (F.col("y0") < 200).cast("int"), "ord": F.col("i")}))
