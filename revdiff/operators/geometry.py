"""Words and boxes on pages.

Words carry doc_id, page_num, x0, y0, x1, y1, text and an order column without ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdiff import rules
from revdiff.functions import text as T
from revdiff.functions.boxes import Box, box, iou, overlap_share
from revdiff.operators.scan import chunk_if_large, ordered_scan
from revdiff.staging import stage

BAND = 64.0


def by_band(y: str = "y0", height: float = BAND) -> Column:
    """Chunk of rows ordered by y."""
    return F.floor(F.col(y) / height)


# ---- words to lines (W1, W2, W3) -------------------------------------------------------------

def number_lines(words: DataFrame, tol: float = 3.0, order: tuple = ("y0", "x0", "i"), out: str = "line_id") -> DataFrame:
    """Native variant of W1: a new line where y is more than `tol` below the word before."""
    return _number_lines(words, tol, order, out, chunk_if_large(words, ["doc_id", "page_num"], by_band()))


def _number_lines(words: DataFrame, tol: float, order: tuple, out: str, chunk: Column | None) -> DataFrame:
    page = ["doc_id", "page_num"]
    linked = ordered_scan(words, page, list(order), chunk, previous={"__y": F.col("y0")})
    starts = F.when(F.col("y0") - F.col("__y") <= tol, 0).otherwise(1)
    return ordered_scan(linked if chunk is None else stage(linked), page, list(order), chunk, running={out: starts}).drop("__y")


def number_lines_exact(words: DataFrame, tol: float = 3.0, order: tuple = ("y0", "x0", "i")) -> DataFrame:
    """W1 as defined: y is compared with a running mean of the line's last mean and y.

    A gap above `tol` always starts a line, whatever the mean, so gaps cut pages into bands first.
    Bands are spread over tasks and read in order with one number of state; no band is ever held. Pages that one window
    numbers lie together already and are read where they are.
    """
    chunk = chunk_if_large(words, ["doc_id", "page_num"], by_band())
    banded = _number_lines(words, tol, order, "band", chunk)
    cols = [c for c in banded.columns]

    def follow(batches):
        key, mean, line = None, 0.0, 0
        for pdf in batches:
            lines = []
            for k, y in zip(zip(pdf["doc_id"], pdf["page_num"], pdf["band"]), pdf["y0"]):
                if k != key:
                    key, mean, line = k, y, 1
                elif abs(y - mean) <= tol:
                    mean = (mean + y) / 2.0
                else:
                    mean, line = y, line + 1
                lines.append(line)
            yield pdf.assign(sub_line=lines)

    spread = banded if chunk is None else banded.repartition("doc_id", "page_num", "band")
    spread = spread.sortWithinPartitions("doc_id", "page_num", "band", *order)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in banded.schema) + ", sub_line long"
    return spread.mapInPandas(follow, ddl).select(*cols, "sub_line")


def segment(words: DataFrame, line_keys: list[str], gap: float = 80.0, order: tuple = ("x0", "i")) -> DataFrame:
    """Cut lines where the gap to the word before exceeds `gap`; one row per segment."""
    chunk = chunk_if_large(words, line_keys, F.floor(F.col(order[0]) / 4096))
    linked = ordered_scan(words, line_keys, list(order), chunk, previous={"__x": F.col("x1")})
    starts = F.when(F.col("x0") - F.col("__x") > gap, 1).otherwise(0)
    cut = ordered_scan(linked if chunk is None else stage(linked), line_keys, list(order), chunk, running={"segment": starts})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda w: w["text"]), " ")
    return (cut.groupBy(*line_keys, "segment")
            .agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
            .withColumn("text", T.norm_cell(F.col("text"))).filter("text <> ''"))


def native_lines(words: DataFrame, gap: float = 80.0) -> DataFrame:
    """Lines by the block and line ids the words come with, then segments."""
    return segment(words, ["doc_id", "page_num", "block_no", "line_no"], gap)


# ---- table boxes (P5) ------------------------------------------------------------------------

def is_title_block(b: Box, w: Column, h: Column, flat: Column, n_rows: Column, n_cells: Column) -> Column:
    stamp = Box(w * 0.60, h * 0.85, w, h)
    width, height = b.x1 - b.x0, b.y1 - b.y0
    return ((overlap_share(b, stamp) > 0.30) | ((b.x0 < w * 0.10) & (width < w * 0.12))
            | ((b.y0 < h * 0.10) & (height < h * 0.08) & (width < w * 0.35)) | ((n_rows < 2) & (width < w * 0.40))
            | (T.count_hits(flat, rules.TITLE_BLOCK_WORDS) >= 3) | ((n_cells <= 3) & (width < w * 0.45)))


def is_noise(b: Box, w: Column, h: Column, name: Column, top: Column, whole: Column, n_rows: Column) -> Column:
    """Mini tables read out of drawings. `top` is the lower-case text of the first three rows."""
    low_name = F.lower(T.norm_cell(name))
    known = T.contains_any(top, rules.DATA_TABLE_HEADERS) | T.contains_any(low_name, rules.DATA_TABLE_NAMES)
    bom = looks_like_bom_table(whole)
    bare_number = T.norm_cell(name).rlike(r"^\d+(?:[,.]\d+)?$") & ~T.contains_any(top, rules.NUMERIC_NAME_HEADERS)
    hits = T.count_hits(top, rules.NOISE_MARKERS)
    few_words = F.size(F.regexp_extract_all(top, F.lit("([а-яa-z]+)"), F.lit(1))) < 25
    width, height = b.x1 - b.x0, b.y1 - b.y0
    noisy = (((b.y1 < h * 0.35) & (hits >= 3)) | ((n_rows <= 4) & (hits >= 4) & few_words)
             | ((width > w * 0.20) & (height < h * 0.25) & (hits >= 4)))
    return (n_rows == 0) | (~known & ~bom & (bare_number | noisy))


def looks_like_bom_table(whole: Column) -> Column:
    return (T.count_hits(whole, rules.BOM_TABLE_ALL) == len(rules.BOM_TABLE_ALL)) & T.contains_any(whole, rules.BOM_TABLE_ANY)


# ---- overlap joins (J10, J11) ----------------------------------------------------------------

def drop_overlapping(boxes: DataFrame, excluded: DataFrame, iou_limit: float | None = 0.2, share_limit: float = 0.2, key: str = "ord") -> DataFrame:
    """Boxes of a page that overlap no excluded rectangle too much; `key` tells a page's boxes apart.

    Both sides go into strips of y as high as the higher of the two, one or two for each height that the other side has, so a page with many boxes and many
    rectangles compares those that may meet. Heights fall into classes by powers of two.
    """
    page = ["doc_id", "page_num"]

    def height_class(prefix: str = "") -> Column:
        return F.ceil(F.log2(F.greatest(F.col(f"{prefix}y1") - F.col(f"{prefix}y0"), F.lit(1.0)))).cast("int")

    def classes(df: DataFrame) -> Column:
        # a few tens at most: doubles have no more powers of two
        found = sorted(r[0] for r in df.select(height_class().alias("c")).distinct().collect() if r[0] is not None)
        return F.array(*map(F.lit, found)) if found else F.array().cast("array<int>")

    def strips(own: Column, others: Column, with_equal: bool) -> Column:
        levels = F.array_union(F.array(own), F.filter(others, lambda c: (c >= own) if with_equal else (c > own)))
        return F.explode(F.flatten(F.transform(levels, lambda c: F.transform(
            F.sequence(F.floor(F.col("y0") / F.pow(F.lit(2.0), c)), F.floor(F.col("y1") / F.pow(F.lit(2.0), c))), lambda k: F.struct(c.alias("c"), k.alias("k"))))))

    own_classes, other_classes = classes(boxes), classes(excluded)
    edges = ["x0", "y0", "x1", "y1"]
    a = boxes.select(*page, key, F.struct(*edges).alias("a"), strips(height_class(), other_classes, True).alias("s"))
    e = excluded.select(*page, F.struct(*edges).alias("e"), strips(height_class(), own_classes, False).alias("s"))
    pa_, pe = box("a."), box("e.")
    hit = overlap_share(pa_, pe) > share_limit
    if iou_limit is not None:
        hit = hit | (iou(pa_, pe) > iou_limit)
    gone = a.join(e, [*page, "s"]).filter(hit).select(*page, key).distinct()
    return boxes.join(gone, [*page, key], "left_anti")


def first_copies(boxes: DataFrame) -> DataFrame:
    """Earliest of equal boxes. Later copies go whatever happens to the first: what covers one
    covers all. So copies never meet in the pair join. Boxes without an area cover nothing and stay."""
    flat = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    solid = boxes.filter(~flat).groupBy("doc_id", "page_num", "x0", "y0", "x1", "y1").agg(F.min("ord").alias("ord"))
    cols = ["doc_id", "page_num", "ord", "x0", "y0", "x1", "y1"]
    return solid.select(*cols).unionByName(boxes.filter(flat).select(*cols))


def near_pairs(boxes: DataFrame, limit: float = 0.85) -> DataFrame:
    """(later, earlier) pairs of one page with IoU above `limit`.

    Two boxes can only overlap that much if their sides differ by less than the limit and their
    corners lie within (1 - limit) / limit of a side. Corners go into cells as large as the side,
    so a box meets only boxes of its size and place; the join is exact.
    """
    slack = (1 - limit) / limit

    def size_class(side: Column) -> Column:
        return F.floor(F.log2(F.greatest(side, F.lit(1e-6)))).cast("int")

    def cell(corner: Column, cls: Column) -> Column:
        return F.floor(corner / F.pow(F.lit(2.0), cls)).cast("long")

    def axes(prefix: str) -> tuple:
        b = box(prefix)
        return (b.x0, b.x1 - b.x0), (b.y0, b.y1 - b.y0)

    def places(corner: Column, side: Column) -> Column:
        """All (class, cell) a partner's corner may be in: one or two each."""
        classes = F.array_distinct(F.array(size_class(side * limit), size_class(side / limit)))
        return F.flatten(F.transform(classes, lambda c: F.transform(
            F.array_distinct(F.array(cell(corner - side * slack, c), cell(corner + side * slack, c))), lambda k: F.struct(c.alias("c"), k.alias("k")))))

    (x, w), (y, h) = axes("")
    home = boxes.select("doc_id", "page_num", F.col("ord").alias("e_ord"), F.struct("x0", "y0", "x1", "y1").alias("e"),
                        F.struct(size_class(w).alias("c"), cell(x, size_class(w)).alias("k")).alias("px"),
                        F.struct(size_class(h).alias("c"), cell(y, size_class(h)).alias("k")).alias("py"))
    probe = (boxes.withColumn("px", F.explode(places(x, w))).withColumn("py", F.explode(places(y, h)))
             .select("doc_id", "page_num", "ord", F.struct("x0", "y0", "x1", "y1").alias("a"), "px", "py"))
    # px and py are each box's only home, so a pair meets once
    return (probe.join(home, ["doc_id", "page_num", "px", "py"])
            .filter((F.col("e_ord") < F.col("ord")) & (iou(box("a."), box("e.")) > limit))
            .select("doc_id", "page_num", "ord", "e_ord"))


def drop_near_duplicates(boxes: DataFrame, limit: float = 0.85) -> DataFrame:
    """Native variant of J11: a box goes if any earlier box of its page covers it."""
    # read three times below
    firsts = stage(first_copies(boxes))
    gone = near_pairs(firsts, limit).select("doc_id", "page_num", "ord").distinct()
    return firsts.join(gone, ["doc_id", "page_num", "ord"], "left_anti")


def keep_first_of_duplicates(boxes: DataFrame, limit: float = 0.85) -> DataFrame:
    """J11 as defined: a box goes if an earlier *kept* box of its page covers it.

    What is kept depends on what was kept before, so near pairs are read once in the order of a page's boxes. One pass, however long the chains;
    it holds the numbers of the boxes that a page has lost so far.
    """
    keys = ["doc_id", "page_num", "ord"]
    boxes = stage(first_copies(boxes))
    pairs = near_pairs(boxes, limit).repartition("doc_id", "page_num").sortWithinPartitions(*keys, "e_ord")
    schema = ", ".join(f"{c} {boxes.schema[c].dataType.simpleString()}" for c in keys)

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, lost = None, set()
        for b in batches:
            gone = []
            for i, (doc, number, later, earlier) in enumerate(zip(*(b.column(c).to_pylist() for c in (*keys, "e_ord")), strict=True)):
                if (doc, number) != page:
                    page, lost = (doc, number), set()
                if earlier not in lost and later not in lost:
                    lost.add(later)
                    gone.append(i)
            yield b.select(keys).take(pa.array(gone, pa.int64()))

    return boxes.join(pairs.mapInArrow(lose, schema), keys, "left_anti")


# ---- band and nearest-neighbour joins (J12, J13) ---------------------------------------------

def band_join(anchors: DataFrame, words: DataFrame, reach: float = 18.0) -> DataFrame:
    """Words whose centre is within `reach` of an anchor's centre in y, on the same page.

    Anchors are put into the bands next to their own too, so the join is on (page, band).
    """
    a = anchors.withColumn("cy", (F.col("y0") + F.col("y1")) / 2.0).select(
        "doc_id", "page_num", F.col("i").alias("anchor"), F.col("cy").alias("a_cy"), ((F.col("x0") + F.col("x1")) / 2.0).alias("a_cx"),
        F.col("text").alias("a_text"), F.explode(F.array(*[(F.floor(F.col("cy") / reach) + k) for k in (-1, 0, 1)])).alias("band"))
    w = words.withColumns({"cy": (F.col("y0") + F.col("y1")) / 2.0, "cx": (F.col("x0") + F.col("x1")) / 2.0})
    return (a.join(w.withColumn("band", F.floor(F.col("cy") / reach)), ["doc_id", "page_num", "band"])
            .filter(F.abs(F.col("cy") - F.col("a_cy")) <= reach).drop("band"))


def band_items(anchors: DataFrame, words: DataFrame, is_pin: Column, reach: float = 18.0) -> DataFrame:
    """Per anchor: pins to its left and right, and the other words from left to right as its signal."""
    near = band_join(anchors, words, reach).filter(F.col("text") != F.col("a_text"))
    left = F.col("cx") < F.col("a_cx")
    others = F.collect_list(F.when(~is_pin, F.struct("x0", "i", "text")))
    return near.groupBy("doc_id", "page_num", "anchor").agg(
        F.count_if(is_pin & left).alias("left_pins"), F.count_if(is_pin & ~left).alias("right_pins"),
        F.array_join(F.transform(F.array_sort(others), lambda x: x["text"]), " ").alias("signal"))


def nearest_below(headers: DataFrame, words: DataFrame, lo: float = 8.0, hi: float = 45.0, dx: float = 100.0) -> DataFrame:
    """Best word below each header: lowest 3 * dy + dx within the window, earliest on ties."""
    cell = math.ceil(hi)
    h = headers.select("doc_id", "page_num", F.col("i").alias("header"), ((F.col("x0") + F.col("x1")) / 2.0).alias("hx"),
                       ((F.col("y0") + F.col("y1")) / 2.0).alias("hy"))
    h = h.withColumn("band", F.explode(F.array(F.floor(F.col("hy") / cell), F.floor(F.col("hy") / cell) + 1)))
    w = words.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2.0, "cy": (F.col("y0") + F.col("y1")) / 2.0})
    w = w.withColumn("band", F.floor(F.col("cy") / cell)).select("doc_id", "page_num", "band", "i", "text", "cx", "cy")
    dy, off = F.col("cy") - F.col("hy"), F.abs(F.col("cx") - F.col("hx"))
    near = h.join(w, ["doc_id", "page_num", "band"]).filter(dy.between(lo, hi) & (off <= dx))
    return near.groupBy("doc_id", "page_num", "header").agg(F.min(F.struct((dy * 3 + off).alias("score"), "i", "text")).alias("b")).select(
        "doc_id", "page_num", "header", F.col("b.i").alias("i"), F.col("b.text").alias("text"), F.col("b.score").alias("score"))


def nearest_left(marks: DataFrame, numbers: DataFrame, same_row: float = 8.0, reach: float = 90.0, fallback: float = 130.0) -> DataFrame:
    """Nearest number left of each mark in its row; failing that, the nearest on either side."""
    m = marks.select("doc_id", "page_num", F.col("i").alias("mark"), F.col("x0").alias("mx0"), F.col("x1").alias("mx1"),
                     ((F.col("y0") + F.col("y1")) / 2.0).alias("my"))
    m = m.withColumn("band", F.explode(F.array(*[F.floor(F.col("my") / same_row) + k for k in (-1, 0, 1)])))
    n = numbers.withColumn("cy", (F.col("y0") + F.col("y1")) / 2.0).withColumn("band", F.floor(F.col("cy") / same_row))
    gap, far = F.col("mx0") - F.col("x1"), F.abs(F.col("x0") - F.col("mx0"))
    tier = F.when((gap >= -4.0) & (gap <= reach), 1).when((F.col("x0") <= F.col("mx1") + 10.0) & (far <= fallback), 2)
    near = m.join(n.select("doc_id", "page_num", "band", "i", "text", "x0", "x1", "cy"), ["doc_id", "page_num", "band"]).filter(
        (F.abs(F.col("cy") - F.col("my")) <= same_row) & tier.isNotNull())
    return near.groupBy("doc_id", "page_num", "mark").agg(
        F.min(F.struct(tier.alias("tier"), F.when(tier == 1, gap).otherwise(far).alias("d"), "x0", "i", "text")).alias("b")).select(
        "doc_id", "page_num", "mark", F.col("b.tier").alias("tier"), F.col("b.i").alias("i"), F.col("b.text").alias("text"))
