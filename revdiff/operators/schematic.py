"""Connection diagrams on pages: the diagram's box, conductors with pins and housings, and nearest neighbours without a window.

Words carry doc_id, page_num, i, x0, y0, x1, y1 and text; i orders the words of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revdiff import rules
from revdiff.functions import text as T
from revdiff.operators.scan import chunk_if_large, ordered_scan
from revdiff.staging import stage

PAGE = ["doc_id", "page_num"]
#: Words within this many units of a conductor in y belong to it.
REACH = 18.0
STRIP = 512.0
#: Bands of a large page that are read in one place.
ZONE = 64


def token(c: Column) -> Column:
    return T.squeeze(T.strip_control(F.coalesce(c, F.lit(""))))


def connector_token(t: Column) -> Column:
    """Cyrillic letters that look like those of connector names become Latin; upper case."""
    return F.upper(F.translate(t, *rules.CONNECTOR_LETTERS))


# ---- nearest neighbour on a line (J13) -------------------------------------------------------

def nearest_by_x(probes: DataFrame, targets: DataFrame, x: str = "cx") -> DataFrame:
    """For each probe the target of its page with the least distance in x, however far; of equals, the first by i.

    Both carry doc_id, page_num, i and x; targets a name. Result: doc_id, page_num, i, nearest (x, i, name), null on pages without targets.
    Both sides are merged in x order and the last and the next target are carried along, so a page costs its words and not their product.
    """
    place = F.struct(F.col(x).alias("x"), "i", "name")
    # of targets at one place only the first can be the nearest
    firsts = targets.groupBy(*PAGE, x).agg(F.min_by("name", "i").alias("name"), F.min("i").alias("i"))
    both = stage(firsts.select(*PAGE, "i", F.col(x).alias("__x"), F.lit(0).alias("__probe"), place.alias("__t")).unionByName(
        probes.select(*PAGE, "i", F.col(x).alias("__x"), F.lit(1).alias("__probe")), allowMissingColumns=True).withColumn("__back", -F.col("__x")))
    # a target at the probe's own place comes before it both ways
    upto = ordered_scan(both, PAGE, ["__x", "__probe", "i"], F.floor(F.col("__x") / STRIP), carry={"__left": F.col("__t")})
    beside = ordered_scan(stage(upto), PAGE, ["__back", "__probe", "i"], F.floor(F.col("__back") / STRIP), carry={"__right": F.col("__t")})

    def measured(side: str) -> Column:
        t = F.col(side)
        return F.when(t.isNotNull(), F.struct(F.abs(t["x"] - F.col("__x")).alias("d"), t["i"].alias("i"), t.alias("t")))

    return beside.filter("__probe = 1").select(*PAGE, "i", F.least(measured("__left"), measured("__right"))["t"].alias("nearest"))


# ---- conductors of a diagram (J12) -----------------------------------------------------------

def _may_connect(w: Column, h: Column) -> Column:
    return (F.col("x0") < w * 0.55) & (F.col("y0") > h * 0.20) & (F.col("y0") < h * 0.50)


def _is_connector(name: Column, w: Column, h: Column) -> Column:
    return _may_connect(w, h) & name.rlike(rules.CONNECTOR_NAME)


def _extent(connects: Column, w: Column, h: Column) -> dict[str, Column]:
    """Aggregates over a page's words from which in_box tells the box around its connectors."""
    return {k: of(F.when(connects, c)) for k, of, c in (
        ("__x0", F.min, F.col("cx")), ("__x1", F.max, F.col("cx")), ("__y0", F.min, F.col("cy")), ("__y1", F.max, F.col("cy")), ("__w", F.max, w), ("__h", F.max, h))}


def _in_box() -> Column:
    bx = F.greatest(F.lit(0.0), F.col("__x0") - 120), F.least(F.col("__w") * 0.55, F.col("__x1") + 120)
    by = F.greatest(F.lit(0.0), F.col("__y0") - 30), F.least(F.col("__h") * 0.56, F.col("__y1") + 120)
    return F.col("__x0").isNotNull() & F.col("cx").between(*bx) & F.col("cy").between(*by)


def _is_housing() -> Column:
    return F.lower("tok") == "корпус"


def _is_told(tok: Column) -> Column:
    return (tok != "") & ~F.lower(tok).isin("справ.", "№")


def diagram_words(words: DataFrame, w: float | Column, h: float | Column) -> tuple[DataFrame, DataFrame]:
    """(connectors, words inside the diagram) of pages of size w x h; both staged.

    Connectors are named like X and one of S, P, T, K with a number, in the upper left part of a page. The diagram is the box around
    them, with a margin; pages without connectors have none.
    """
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (w, h))
    t = words.withColumns({"w": w, "h": h, "tok": token(F.col("text"))}).withColumns({
        "name": connector_token(F.col("tok")), "cx": (F.col("x0") + F.col("x1")) / 2.0, "cy": (F.col("y0") + F.col("y1")) / 2.0})
    t = stage(t.select(*PAGE, "i", "x0", "y0", "x1", "y1", "cx", "cy", "w", "h", "tok", "name"))
    is_connector = _is_connector(F.col("name"), F.col("w"), F.col("h"))
    connectors = stage(t.filter(is_connector).select(*PAGE, "i", "cx", "cy", "name", "w", "h"))
    boxes = connectors.groupBy(*PAGE).agg(*[c.alias(k) for k, c in _extent(F.lit(True), F.col("w"), F.col("h")).items()])
    inside = t.join(boxes, PAGE).filter(_in_box() & _is_told(F.col("tok")))
    return connectors, stage(inside.select(*PAGE, "i", "x0", "y0", "x1", "y1", "cx", "cy", "tok", "name"))


def conductors(words: DataFrame, w: float | Column, h: float | Column, reach: float = REACH) -> DataFrame:
    """One row per conductor word of a diagram: doc_id, page_num, i, key, signal, left_pins, right_pins, left_housing, right_housing, housing_connectors, bbox.

    Pins (one or two digits, or a letter) and the other words near it in y are listed from left to right; a housing mark stands on the side
    where its centre is and names the connector nearest to it in x. Words are gathered once per band of a page and conductors take the three bands
    around them as they are, so a word is shuffled once and not once for each conductor near it.
    """
    if chunk_if_large(words, PAGE, F.lit(0)) is None:
        marked, zone = _page_marks(words, w, h), []
        banded = marked.withColumn("band", F.floor(F.col("cy") / reach))
    else:
        connectors, inside = diagram_words(words, w, h)
        housing = inside.filter(_is_housing())
        near_connector = nearest_by_x(housing, connectors).select(*PAGE, "i", F.col("nearest.name").alias("connector"))
        marked = inside.filter(~_is_housing()).withColumn("connector", F.lit(None).cast("string")).unionByName(housing.join(near_connector, [*PAGE, "i"], "left"))
        # a large page is dealt by zones of bands; the bands at an edge lie in both zones
        band, zone = F.floor(F.col("cy") / reach), ["zone"]
        zones = F.array_distinct(F.array(F.floor((band - 1) / ZONE), F.floor((band + 1) / ZONE)))
        banded = marked.withColumn("band", band).withColumn("zone", F.explode(zones)).repartition(*PAGE, "zone")
    return _band_conductors(banded, [*PAGE, *zone], reach)


def _page_marks(words: DataFrame, w: float | Column, h: float | Column) -> DataFrame:
    """Words inside the diagrams, housing marks with their connector, by windows over whole pages: one shuffle, of what can lie in a diagram."""
    size = {"w": w, "h": h}
    own = {k: v for k, v in size.items() if isinstance(v, Column)}
    w, h = (F.col(k) if k in own else F.lit(v) for k, v in size.items())
    cx, cy = (F.col("x0") + F.col("x1")) / 2.0, (F.col("y0") + F.col("y1")) / 2.0
    # no connector and no diagram lies beyond these limits; words are read only behind the shuffle, once
    t = words.withColumns(own).dropna(subset=PAGE).filter(_may_connect(w, h) | ((cx <= w * 0.55) & (cy <= h * 0.56)))
    t = t.select(*PAGE, "i", "x0", "y0", "x1", "y1", "text", *own).repartition(*PAGE).withColumn("tok", token(F.col("text"))).drop("text")
    t = t.withColumns({"cx": cx, "cy": cy, "name": connector_token(F.col("tok"))}).withColumn("connects", _is_connector(F.col("name"), w, h))
    page = Window.partitionBy(*PAGE)
    t = t.withColumns({k: c.over(page) for k, c in _extent(F.col("connects"), w, h).items()}).filter("__x0 IS NOT NULL")
    t = t.withColumn("in", _in_box() & _is_told(F.col("tok")))
    place = F.when(F.col("connects"), F.struct(F.col("cx").alias("x"), "i", "name"))
    # at one x connectors come before the others, the first by i last
    last = F.when(F.col("connects"), -F.col("i"))
    sides = {f"__{side}": F.last(place, ignorenulls=True).over(page.orderBy(along, F.col("connects").desc(), last).rowsBetween(Window.unboundedPreceding, 0))
             for side, along in (("left", F.col("cx")), ("right", F.col("cx").desc()))}

    def measured(side: str) -> Column:
        t = F.col(side)
        return F.when(t.isNotNull(), F.struct(F.abs(t["x"] - F.col("cx")).alias("d"), t["i"].alias("i"), t.alias("t")))

    nearest = F.least(measured("__left"), measured("__right"))["t"]["name"]
    return t.withColumns(sides).filter("in").select(*PAGE, "i", "x0", "y0", "x1", "y1", "cx", "cy", "tok", "name", F.when(_is_housing(), nearest).alias("connector"))


def _band_conductors(banded: DataFrame, zone: list[str], reach: float) -> DataFrame:
    """Conductors of words that carry their band and lie by `zone` already: neither the bands nor the conductors are shuffled."""
    key = F.when(F.col("tok").rlike(rules.CONDUCTOR), F.col("tok"))
    plain = ~_is_housing() & ~F.col("name").rlike(rules.CONNECTOR_NAME)
    kind = F.when(_is_housing(), 2).when(plain, F.when(F.col("tok").rlike(rules.PIN), 1).otherwise(0))
    box = ["x0", "y0", "x1", "y1"]
    each = F.struct(F.col("x0").alias("at"), "i", "tok", key.alias("key"), kind.alias("kind"), "cx", "cy", *box, "connector")
    bands = banded.groupBy(*zone, "band").agg(F.collect_list(each).alias("here"))
    along = Window.partitionBy(*zone).orderBy("band")
    beside = {}
    for name, of, step in (("above", F.lag, -1), ("below", F.lead, 1)):
        band, here = (of(c).over(along) for c in ("band", "here"))
        beside[name] = F.when(band == F.col("band") + step, here)
    bands = bands.withColumns(beside)
    if "zone" in zone:
        bands = bands.filter(F.floor(F.col("band") / ZONE) == F.col("zone"))
    bands = bands.withColumn("c", F.filter("here", lambda x: x["key"].isNotNull())).filter(F.size("c") > 0)
    around = F.sort_array(F.flatten(F.filter(F.array("above", "here", "below"), lambda a: a.isNotNull())))
    # sorted and told apart once per band: a filtered list keeps the order
    kinds = {"plain": 0, "pins": 1, "housing": 2}

    def of_kind(n: int) -> Column:
        return F.filter("around", lambda x: x["kind"] == n)

    bands = bands.select(*PAGE, "c", around.alias("around")).select(
        *PAGE, F.explode("c").alias("c"), *[of_kind(n).alias(k) for k, n in kinds.items()])

    def near(x: Column) -> Column:
        return (F.abs(x["cy"] - F.col("c.cy")) <= reach) & (x["tok"] != F.col("c.key"))

    own = bands.select(*PAGE, "c", *[F.filter(k, near).alias(k) for k in kinds])

    def listed(of: Column | str, value: str = "tok") -> Column:
        return F.transform(of, lambda x: x[value])

    def edge(c: str) -> Column:
        values = listed("housing", c)
        return (F.least if c[1] == "0" else F.greatest)(F.col(f"c.{c}"), (F.array_min if c[1] == "0" else F.array_max)(values))

    def left(x: Column) -> Column:
        return x["cx"] < F.col("c.cx")

    size = [F.greatest(F.lit(1.0), edge(f"{a}1") - edge(f"{a}0")) for a in "xy"]
    bbox = F.struct(edge("x0").cast("int").alias("x"), edge("y0").cast("int").alias("y"), size[0].cast("int").alias("w"), size[1].cast("int").alias("h"))
    return own.select(
        *PAGE, F.col("c.i").alias("i"), F.col("c.key").alias("key"), F.nullif(F.array_join(listed("plain"), " "), F.lit("")).alias("signal"),
        listed(F.filter("pins", left)).alias("left_pins"), listed(F.filter("pins", lambda x: ~left(x))).alias("right_pins"),
        F.exists("housing", left).alias("left_housing"), F.exists("housing", lambda x: x["cx"] > F.col("c.cx")).alias("right_housing"),
        listed("housing", "connector").alias("housing_connectors"), bbox.alias("bbox"))


def last_of_key(items: DataFrame) -> DataFrame:
    """One row per conductor of a page, the last one, keyed by (page, conductor) as connection_diff takes it."""
    rest = ["signal", "left_pins", "right_pins", "left_housing", "right_housing", "bbox"]
    return items.groupBy(*PAGE, "key").agg(F.max_by(F.struct(*rest), "i").alias("s")).select(
        "doc_id", F.struct("page_num", "key").alias("key"), *[F.col(f"s.{c}").alias(c) for c in rest])


# ---- the letter of a document (J13) ----------------------------------------------------------

def code_letters(lines: DataFrame, band: float = 128.0) -> DataFrame:
    """doc_id, letter, tier: the letter that a document's stamp gives.

    Lines carry doc_id, page_num, part (0 the stamp, 1 its wider surroundings), ord, x0, y0, x1, y1 and text. Tier 1 is a letter below or beside
    the first header that has one, nearest in y, then in x; tier 2 a line that is a letter; tier 3 a letter behind its label within a line.
    """
    clean = T.squeeze(T.strip_control(F.coalesce(F.col("text"), F.lit(""))))
    up = F.replace(F.upper(clean), F.lit("."), F.lit(""))
    t = stage(lines.select("doc_id", "page_num", "part", "ord", "x0", "y0", "y1", clean.alias("line"), up.alias("up")))
    letters = t.filter(_is_letter(F.col("up")))
    is_header = F.col("line").rlike(rules.LETTER_HEADER)
    lo, hi = F.least(F.col("y0") - 20.0, F.col("y1") - 2.0), F.greatest(F.col("y1") + 90.0, F.col("y0") + 20.0)
    headers = t.filter(is_header).select("doc_id", "page_num", "part", F.col("ord").alias("h_ord"), F.col("x0").alias("hx0"), F.col("y0").alias("hy0"), F.col("y1").alias("hy1"),
                                         F.explode(F.sequence(F.floor(lo / band), F.floor(hi / band))).alias("band"))
    met = headers.join(letters.withColumn("band", F.floor(F.col("y0") / band)), ["doc_id", "page_num", "part", "band"])
    dy, dx = F.col("y0") - F.col("hy1"), F.abs(F.col("x0") - F.col("hx0"))
    beside = (F.abs(F.col("y0") - F.col("hy0")) <= 20.0) & (F.col("x0") >= F.col("hx0"))
    zero = F.lit(0.0)

    def rank(tier: int, *order: Column) -> Column:
        names = ("part", "page", "head", "d", "e", "line")
        return F.struct(F.lit(tier).alias("tier"), *[o.alias(n) for n, o in zip(names, order, strict=True)])

    near = met.filter((dx <= 90.0) & (dy.between(-2.0, 90.0) | beside)).select(
        "doc_id", rank(1, F.col("part"), F.col("page_num"), F.col("h_ord"), F.abs(dy), dx, F.col("ord")).alias("r"), F.col("up").alias("letter"))
    alone = letters.select("doc_id", rank(2, F.col("part"), F.col("page_num"), F.col("ord"), zero, zero, F.col("ord")).alias("r"), F.col("up").alias("letter"))
    labelled = F.replace(F.upper(F.regexp_extract("line", rules.LETTER_LABEL, 1)), F.lit("."), F.lit(""))
    told = t.withColumn("letter", labelled).filter(_is_letter(F.col("letter"))).select(
        "doc_id", rank(3, F.col("part"), F.col("page_num"), F.col("ord"), zero, zero, F.col("ord")).alias("r"), "letter")
    best = near.unionByName(alone).unionByName(told).groupBy("doc_id").agg(F.min_by(F.struct("letter", "r.tier"), "r").alias("b"))
    return best.select("doc_id", "b.letter", "b.tier")


def _is_letter(up: Column) -> Column:
    plain = F.translate(up, "Ё", "Е")
    return up.rlike("^[A-ZА-ЯЁ]{1,3}$") & ~plain.isin(*rules.BAD_CODE_LETTERS) & ~T.contains_any(plain, ("ТАБЛ", "СМТТ"))
