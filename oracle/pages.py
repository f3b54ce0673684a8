"""DuckDB SQL for the queries on positioned words and boxes."""

from oracle.base import CTES, any_of, cell, hits, in_, squeeze, with_
from revdiff import rules

SQL = {}
CELL = cell("text")


def inter(a, b):
    return (f"(greatest(0.0::DOUBLE, least({a[2]}, {b[2]}) - greatest({a[0]}, {b[0]})) * "
            f"greatest(0.0::DOUBLE, least({a[3]}, {b[3]}) - greatest({a[1]}, {b[1]})))")


def share(a, b):
    return f"({inter(a, b)} / greatest(1.0::DOUBLE, ({a[2]} - {a[0]}) * ({a[3]} - {a[1]})))"


def iou(a, b):
    areas = [f"greatest(0.0::DOUBLE, ({x[2]} - {x[0]}) * ({x[3]} - {x[1]}))" for x in (a, b)]
    union = f"({areas[0]} + {areas[1]} - {inter(a, b)})"
    return f"CASE WHEN {union} = 0 THEN 0.0::DOUBLE ELSE {inter(a, b)} / {union} END"


def d(x):
    return f"CAST('{x}' AS DOUBLE)"


ME = ("x0", "y0", "x1", "y1")
STAMP = (f"({d(700)} * {d(0.62)})", f"({d(320)} * {d(0.78)})", d(700), d(320))
WIDE = (f"({d(700)} * {d(0.52)})", f"({d(320)} * {d(0.72)})", d(700), d(320))
SQL["f06_overlap_share"] = with_(["lboxes"], f"SELECT doc_id, page_num, ord, {share(ME, STAMP)} AS share FROM lboxes")
SQL["f07_iou"] = with_(["lboxes"], f"SELECT doc_id, page_num, ord, {iou(ME, WIDE)} AS iou FROM lboxes")
SQL["p03_title_block_words"] = with_(["words"], f""", s AS (SELECT doc_id, i, CASE doc_id % 3 WHEN 0 THEN {d(3200)} WHEN 1 THEN {d(1600)} ELSE {d(700)} END AS w,
    x0, x1, (y0 + y1) / 2.0 AS cy FROM words), c AS (SELECT *, (x0 * (w / {d(700)}) + x1 * (w / {d(700)})) / 2.0 AS cx FROM s)
  SELECT * FROM (SELECT doc_id, i, cx >= w * CASE WHEN w > 1500 THEN {d(0.86)} ELSE {d(0.62)} END AND cx <= w AND cy <= 320
      AND cy >= {d(320)} * CASE WHEN w >= 3000 THEN {d(0.92)} WHEN w > 1500 THEN {d(0.9)} ELSE {d(0.78)} END AS inside,
    cx >= w * CASE WHEN w > 1500 THEN {d(0.78)} ELSE {d(0.52)} END AND cx <= w AND cy <= 320
      AND cy >= {d(320)} * CASE WHEN w > 1500 THEN {d(0.86)} ELSE {d(0.72)} END AS inside_expanded FROM c) WHERE inside OR inside_expanded""")

T5 = """, t AS (SELECT doc_id, page_num, block_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
    lower(string_agg(text, ' ' ORDER BY i)) AS flat, count(DISTINCT line) AS n_rows, count(*) AS n_cells FROM words GROUP BY ALL)"""
B5 = (f"({d(700)} * {d(0.60)})", f"({d(320)} * {d(0.85)})", d(700), d(320))
SQL["p05_noise_tables"] = with_(["words"], T5 + f"""
  SELECT doc_id, page_num, block_no, {share(ME, B5)} > {d(0.3)} OR (x0 < 700 * {d(0.1)} AND x1 - x0 < 700 * {d(0.12)})
    OR (y0 < 320 * {d(0.1)} AND y1 - y0 < 320 * {d(0.08)} AND x1 - x0 < 700 * {d(0.35)}) OR (n_rows < 2 AND x1 - x0 < 700 * {d(0.4)})
    OR {hits('flat', rules.TITLE_BLOCK_WORDS)} >= 3 OR (n_cells <= 3 AND x1 - x0 < 700 * {d(0.45)}) AS title_block,
    NOT {any_of('flat', rules.DATA_TABLE_HEADERS)} AND NOT ({hits('flat', rules.BOM_TABLE_ALL)} = 3 AND {any_of('flat', rules.BOM_TABLE_ANY)}) AND (
      (doc_id % 4 = 0 AND NOT {any_of('flat', rules.NUMERIC_NAME_HEADERS)}) OR (y1 < 320 * {d(0.35)} AND {hits('flat', rules.NOISE_MARKERS)} >= 3)
      OR (n_rows <= 4 AND {hits('flat', rules.NOISE_MARKERS)} >= 4 AND len(regexp_extract_all(flat, '[а-яa-z]+')) < 25)
      OR (x1 - x0 > 700 * {d(0.2)} AND y1 - y0 < 320 * {d(0.25)} AND {hits('flat', rules.NOISE_MARKERS)} >= 4)) AS noise FROM t""")

SQL["w01_word_lines"] = with_(["words"], """, g AS (SELECT *, lag(y0) OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, i) AS py FROM words)
  SELECT doc_id, i, CAST(sum(CASE WHEN y0 - py <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_id FROM g""")


def segments(keys, gap):
    return with_(["words"], f""", g AS (SELECT *, lag(x1) OVER (PARTITION BY {keys} ORDER BY x0, i) AS px FROM words),
    s AS (SELECT *, CAST(sum(CASE WHEN x0 - px > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY x0, i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g),
    a AS (SELECT {keys}, segment, string_agg(text, ' ' ORDER BY x0, i) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM s GROUP BY {keys}, segment)
  SELECT * REPLACE (CELL AS text) FROM a WHERE CELL <> ''""").replace("CELL", CELL)


SQL["w02_gap_segments"] = segments("doc_id, page_num, line", 45)
SQL["w03_native_lines"] = segments("doc_id, page_num, block_no, line_no", 80)
SQL["o01_reading_order"] = with_(["boxes"], "SELECT * FROM boxes ORDER BY doc_id, page_num, y0, x0, ord")
SQL["j10_excluded_boxes"] = with_(["lboxes"], f"SELECT doc_id, page_num, ord FROM lboxes WHERE NOT ({share(ME, STAMP)} > {d(0.2)} OR {iou(ME, STAMP)} > {d(0.2)})")
A, E = [tuple(f"{p}.{c}" for c in ME) for p in "ae"]
SQL["j11_near_duplicates"] = with_(["boxes"], f"""SELECT doc_id, page_num, ord FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes e
  WHERE e.doc_id = a.doc_id AND e.page_num = a.page_num AND e.ord < a.ord AND {iou(A, E)} > {d(0.85)})""")
SQL["j12_band_join"] = with_(["words"], """, a AS (SELECT *, (y0 + y1) / 2.0 AS cy, (x0 + x1) / 2.0 AS cx FROM words)
  SELECT m.doc_id, m.page_num, m.i AS anchor, count(*) FILTER (WHERE length(w.text) <= 2 AND w.cx < m.cx) AS left_pins,
    count(*) FILTER (WHERE length(w.text) <= 2 AND NOT w.cx < m.cx) AS right_pins,
    coalesce(string_agg(w.text, ' ' ORDER BY w.x0, w.i) FILTER (WHERE length(w.text) > 2), '') AS signal
  FROM a m JOIN a w ON m.doc_id = w.doc_id AND m.page_num = w.page_num AND abs(w.cy - m.cy) <= 18 AND w.text <> m.text
  WHERE ends_with(m.text, '.') GROUP BY ALL""")
SQL["j13_nearest_neighbour"] = with_(["words"], """, a AS (SELECT *, (y0 + y1) / 2.0 AS cy, (x0 + x1) / 2.0 AS cx FROM words),
  b AS (SELECT m.doc_id, m.page_num, m.i AS anchor, w.i, w.text, row_number() OVER (PARTITION BY m.doc_id, m.page_num, m.i
      ORDER BY (w.cy - m.cy) * 3 + abs(w.cx - m.cx), w.i) AS rn
    FROM a m JOIN a w ON m.doc_id = w.doc_id AND m.page_num = w.page_num AND w.cy - m.cy BETWEEN 8 AND 45 AND abs(w.cx - m.cx) <= 100
    WHERE ends_with(m.text, '.') AND length(w.text) <= 4),
  l AS (SELECT m.doc_id, m.page_num, m.i AS anchor, w.i, w.text, w.x0, m.x0 - w.x1 AS gap, abs(w.x0 - m.x0) AS far,
      CASE WHEN m.x0 - w.x1 >= -4 AND m.x0 - w.x1 <= 90 THEN 1 WHEN w.x0 <= m.x1 + 10 AND abs(w.x0 - m.x0) <= 130 THEN 2 END AS tier
    FROM a m JOIN a w ON m.doc_id = w.doc_id AND m.page_num = w.page_num AND abs(w.cy - m.cy) <= 8 WHERE ends_with(m.text, '.') AND length(w.text) <= 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, anchor ORDER BY tier, CASE tier WHEN 1 THEN gap ELSE far END, x0, i) AS rn FROM l WHERE tier IS NOT NULL)
  SELECT doc_id, page_num, 'below' AS kind, anchor, i, text FROM b WHERE rn = 1
  UNION ALL SELECT doc_id, page_num, 'left' || tier, anchor, i, text FROM r WHERE rn = 1""")


def diagram(v):
    k = "(doc_id * 7 + i * 13) % 50"
    if v == 2:
        k = f"CASE WHEN (doc_id + i) % 97 = 0 THEN ({k} + 1) % 50 ELSE {k} END"
    return f"""SELECT * REPLACE (CASE WHEN k < 3 THEN 'хр' || (i % 9) || 'a' WHEN k < 8 THEN lpad(CAST(i % 40 AS VARCHAR), 3, '0') WHEN k = 8 THEN 'б/Н' WHEN k < 11 THEN ' Корпус'
    WHEN k < 20 THEN CAST(i % 30 AS VARCHAR) WHEN k < 22 THEN 'ж' WHEN k = 22 THEN '№' WHEN k = 23 AND n % 4 = 0 THEN 'Лит.' WHEN k = 24 AND n % 3 = 0 THEN 'А1'
    WHEN k = 25 AND n % 5 = 0 THEN 'о.' WHEN k = 26 AND n % 5 = 0 THEN 'литера: Б' WHEN k = 27 AND n % 3 = 0 THEN 'Изм' ELSE text END AS text)
    FROM (SELECT *, {k} AS k, doc_id + i AS n FROM words)"""


TOKEN = squeeze("regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g')")
for v in (1, 2):
    CTES[f"dia{v}"] = (("words",), diagram(v))
    CTES[f"tok{v}"] = ((f"dia{v}",), f"""SELECT *, upper(translate(tok, 'ХхРрТтСс', 'XxPpTtSs')) AS name, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy FROM (SELECT *, {TOKEN} AS tok FROM dia{v})""")
    CTES[f"con{v}"] = ((f"tok{v}",), f"""SELECT * FROM tok{v} WHERE regexp_matches(name, '^X[SPTK][0-9]+[A-Z0-9-]*$') AND x0 < {d(700)} * {d(0.55)} AND y0 > {d(320)} * {d(0.2)} AND y0 < {d(320)} * {d(0.5)}""")
    CTES[f"ins{v}"] = ((f"con{v}",), f"""SELECT t.* FROM tok{v} t JOIN (SELECT doc_id, page_num, greatest(0, min(cx) - 120) AS a0, least({d(700)} * {d(0.55)}, max(cx) + 120) AS a1,
        greatest(0, min(cy) - 30) AS b0, least({d(320)} * {d(0.56)}, max(cy) + 120) AS b1 FROM con{v} GROUP BY ALL) b USING (doc_id, page_num)
      WHERE cx BETWEEN a0 AND a1 AND cy BETWEEN b0 AND b1 AND tok <> '' AND lower(tok) NOT IN ('справ.', '№')""")
    CTES[f"hou{v}"] = ((f"ins{v}",), f"""SELECT h.doc_id, h.page_num, h.i, min_by(c.name, (abs(c.cx - h.cx), c.i)) AS connector FROM ins{v} h JOIN con{v} c USING (doc_id, page_num)
      WHERE lower(h.tok) = 'корпус' GROUP BY ALL""")
    CTES[f"cnd{v}"] = ((f"hou{v}",), f"""SELECT doc_id, page_num, i, key, nullif(coalesce(string_agg(tok, ' ' ORDER BY x0, wi) FILTER (WHERE plain AND NOT pin), ''), '') AS signal,
        coalesce(string_agg(tok, ' ' ORDER BY x0, wi) FILTER (WHERE pin AND cx < kx), '') AS left_pins, coalesce(string_agg(tok, ' ' ORDER BY x0, wi) FILTER (WHERE pin AND NOT cx < kx), '') AS right_pins,
        coalesce(string_agg(connector, ' ' ORDER BY x0, wi) FILTER (WHERE hou), '') AS housing_connectors,
        count(*) FILTER (WHERE pin AND cx < kx) AS nl, count(*) FILTER (WHERE pin AND NOT cx < kx) AS nr,
        coalesce(bool_or(cx < kx) FILTER (WHERE hou), false) AS left_housing, coalesce(bool_or(cx > kx) FILTER (WHERE hou), false) AS right_housing,
        least(k0, min(x0) FILTER (WHERE hou)) AS a0, greatest(k1, max(x1) FILTER (WHERE hou)) AS a1, least(l0, min(y0) FILTER (WHERE hou)) AS b0, greatest(l1, max(y1) FILTER (WHERE hou)) AS b1
      FROM (SELECT *, plain AND regexp_matches(tok, '^([0-9]{{1,2}}|[A-ZА-ЯЁ])$', 'i') AS pin FROM (
        SELECT c.doc_id, c.page_num, c.i, c.tok AS key, c.cx AS kx, c.x0 AS k0, c.x1 AS k1, c.y0 AS l0, c.y1 AS l1, w.tok, w.x0, w.x1, w.y0, w.y1, w.cx, w.i AS wi, h.connector,
          lower(w.tok) = 'корпус' AS hou, w.tok <> c.tok AND lower(w.tok) <> 'корпус' AND NOT regexp_matches(w.name, '^X[SPTK][0-9]+[A-Z0-9-]*$') AS plain
        FROM ins{v} c JOIN ins{v} w ON w.doc_id = c.doc_id AND w.page_num = c.page_num AND abs(w.cy - c.cy) <= 18 LEFT JOIN hou{v} h ON h.doc_id = w.doc_id AND h.page_num = w.page_num AND h.i = w.i
        WHERE regexp_matches(c.tok, '^([0-9]{{3}}|б/н|-)$', 'i')))
      GROUP BY doc_id, page_num, i, key, k0, k1, l0, l1""")
    CTES[f"lst{v}"] = ((f"cnd{v}",), f"SELECT * FROM cnd{v} QUALIFY row_number() OVER (PARTITION BY doc_id, page_num, key ORDER BY i DESC) = 1")

BOX = "CAST(trunc(a0) AS INT) AS x, CAST(trunc(b0) AS INT) AS y, CAST(trunc(greatest(1, a1 - a0)) AS INT) AS w, CAST(trunc(greatest(1, b1 - b0)) AS INT) AS h"
SQL["j12_conductors"] = with_(["cnd1"], f"SELECT doc_id, page_num, i, key, signal, left_pins, right_pins, housing_connectors, left_housing, right_housing, {BOX} FROM cnd1")
SQL["j04_schematic_diff"] = with_(["lst1", "lst2"], f""", j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page_num, b.page_num) AS page_num, coalesce(a.key, b.key) AS key,
    a.doc_id IS NULL OR b.doc_id IS NULL OR coalesce(a.signal, '') <> coalesce(b.signal, '') OR a.nl <> b.nl OR a.nr <> b.nr OR a.left_housing <> b.left_housing OR a.right_housing <> b.right_housing AS changed,
    CASE WHEN b.doc_id IS NULL THEN a.a0 ELSE b.a0 END AS a0, CASE WHEN b.doc_id IS NULL THEN a.a1 ELSE b.a1 END AS a1,
    CASE WHEN b.doc_id IS NULL THEN a.b0 ELSE b.b0 END AS b0, CASE WHEN b.doc_id IS NULL THEN a.b1 ELSE b.b1 END AS b1
    FROM lst1 a FULL JOIN lst2 b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.key = b.key),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY changed DESC, page_num, key) AS r, bool_or(changed) OVER (PARTITION BY doc_id) AS has_changes FROM j)
  SELECT doc_id, has_changes, CASE WHEN has_changes THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS change_percentage,
    {', '.join(f'CASE WHEN has_changes THEN {c} END AS {c}' for c in 'xywh')} FROM (SELECT *, {BOX} FROM f WHERE r = 1)""")
SQL["j13_nearest_connector"] = with_(["tok1"], """, c AS (SELECT * FROM tok1 WHERE regexp_matches(name, '^XP[0-9]'))
  SELECT h.doc_id, h.page_num, h.i, min_by(c.i, (abs(c.cx - h.cx), c.i)) AS connector_i, min_by(c.name, (abs(c.cx - h.cx), c.i)) AS connector
  FROM tok1 h LEFT JOIN c USING (doc_id, page_num) WHERE lower(h.tok) = 'корпус' GROUP BY ALL""")
LETTER = f"regexp_matches(X, '^[A-ZА-ЯЁ]{{1,3}}$') AND NOT {in_('YY', rules.BAD_CODE_LETTERS)} AND NOT contains(YY, 'ТАБЛ') AND NOT contains(YY, 'СМТТ')".replace("YY", "translate(X, 'Ё', 'Е')")
SQL["j13_code_letter"] = with_(["tok1"], f""", t AS (SELECT *, CAST(y0 < 200 AS INT) AS part, replace(replace(replace(upper(tok), 'ß', 'SS'), 'ẞ', 'SS'), '.', '') AS up FROM tok1),
  l AS (SELECT * FROM t WHERE {LETTER.replace('X', 'up')}),
  r AS (SELECT h.doc_id, 1 AS tier, [h.part, h.page_num, h.i, abs(l.y0 - h.y1), abs(l.x0 - h.x0), l.i] AS o, l.up AS letter FROM t h JOIN l USING (doc_id, page_num, part)
      WHERE regexp_matches(h.tok, '(^|[^A-Za-zА-Яа-яЁё0-9_])лит($|[^A-Za-zА-Яа-яЁё0-9_])', 'i') AND abs(l.x0 - h.x0) <= 90
      AND (l.y0 - h.y1 BETWEEN -2 AND 90 OR (abs(l.y0 - h.y0) <= 20 AND l.x0 >= h.x0))
    UNION ALL SELECT doc_id, 2, [part, page_num, i, 0, 0, i], up FROM l
    UNION ALL SELECT doc_id, 3, [part, page_num, i, 0, 0, i], m FROM (SELECT *, replace(upper(regexp_extract(tok,
      '(лит(ера)?|лит\\.)\\s*[:.]?\\s*([A-ZА-Я]{{1,3}})($|[^A-Za-zА-Яа-яЁё0-9_])', 3, 'i')), '.', '') AS m FROM t) WHERE {LETTER.replace('X', 'm')})
  SELECT doc_id, letter, tier FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier, o) = 1""")


SQL["j11_near_duplicates_exact"] = with_(["boxes"], f""", o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY ord) AS k FROM boxes),
  p AS (SELECT a.doc_id, a.page_num, a.ord, list(e.ord) AS earlier FROM boxes a JOIN boxes e ON e.doc_id = a.doc_id AND e.page_num = a.page_num AND e.ord < a.ord AND {iou(A, E)} > {d(0.85)} GROUP BY ALL),
  q AS (SELECT o.*, coalesce(earlier, []::INT[]) AS earlier FROM o LEFT JOIN p USING (doc_id, page_num, ord)),
  w AS (SELECT DISTINCT doc_id, page_num, 0::BIGINT AS k, []::INT[] AS kept FROM boxes UNION ALL
    SELECT w.doc_id, w.page_num, q.k, CASE WHEN list_has_any(q.earlier, w.kept) THEN w.kept ELSE list_append(w.kept, q.ord::INT) END FROM w JOIN q ON q.doc_id = w.doc_id AND q.page_num = w.page_num AND q.k = w.k + 1)
  SELECT doc_id, page_num, unnest(kept) AS ord FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY k DESC) = 1)""").replace("WITH", "WITH RECURSIVE", 1)
