"""DuckDB SQL for the queries on tables of cells and on table differences."""

from oracle.base import COLS, CTES, ck, with_

SQL = {}

CTES["tdiff"] = (("bom1",), """SELECT doc AS doc_id, CAST((doc_id % 40) * 1000 + ord AS INT) AS ord,
  CASE WHEN doc % 3 = 0 THEN 'Таблица присоединений' ELSE 'Таблица ' || (1 + position % 2) END AS table_name, sel,
  CASE sel WHEN 0 THEN 'Поз.' WHEN 1 THEN 'Провод' WHEN 2 THEN 'Длина, мм' WHEN 3 THEN 'Провод'
    WHEN 4 THEN 'Маркировка / ХР' || (1 + position % 3) WHEN 5 THEN 'Код' WHEN 6 THEN 'Код' ELSE 'От соединителя' END AS col_name,
  CASE sel WHEN 0 THEN CAST(position AS VARCHAR) WHEN 1 THEN w WHEN 2 THEN w WHEN 3 THEN w WHEN 4 THEN designation
    WHEN 5 THEN designation WHEN 6 THEN designation || ' | x' ELSE 'б/н' END AS row_key,
  CASE sel WHEN 6 THEN designation WHEN 0 THEN CAST(position AS VARCHAR) WHEN 4 THEN designation WHEN 5 THEN designation
    WHEN 7 THEN 'б/н' ELSE w END AS subject,
  ['row_added','row_removed','modified','row_added','modified','row_added','row_removed','added'][sel + 1] AS status,
  CASE WHEN doc % 3 = 0 THEN 'таблица присоединений' ELSE 'table:' || (1 + position % 2) END AS table_key,
  position, quantity AS v1_val, note AS v2_val, designation
  FROM (SELECT *, doc_id // 40 AS doc, (doc_id + ord) % 8 AS sel, lpad(quantity, 3, '0') AS w FROM bom1)""")
CTES["nsub"] = ((), """SELECT DISTINCT l_orderkey // 40 AS doc_id, lpad(CAST(l_partkey % 300 AS VARCHAR), 3, '0') ||
  CASE WHEN (l_partkey % 300) % 17 = 0 THEN 'A' ELSE '' END AS subject FROM lineitem""")
CTES["dtab"] = (("bom1",), f"""SELECT k // 8 AS doc_id, k AS table_id, CAST(1 + k % 8 AS INT) AS page_num,
  (k % 3) * 10.0::DOUBLE AS x0, (k % 5) * 20.0::DOUBLE AS y0, (k % 3) * 10.0::DOUBLE + 100 + k % 7 AS x1, (k % 5) * 20.0::DOUBLE + 30 AS y1,
  CASE k % 4 WHEN 0 THEN 'Таблица ' || (1 + (k // 8) % 3) WHEN 1 THEN 'Продолжение таблицы ' || (1 + (k // 8) % 3)
    WHEN 2 THEN 'Таблица ' || (4 + (k // 8) % 3) ELSE 'Прочее' END AS name, CASE WHEN k % 5 = 1 THEN list_append({COLS}, '') ELSE {COLS} END AS names
  FROM (SELECT DISTINCT doc_id AS k FROM bom1)""")

SQL["p02_clean_rows"] = with_(["tbl1"], "SELECT table_id, row_index, array_to_string(cells, '|') AS cells FROM tbl1 WHERE row_index % 9 <> 0")
SQL["p07_repeated_header"] = with_(["tbl1"], f"SELECT table_id, row_index, row_index % 7 = 0 OR (cells = {COLS} AND row_index % 11 <> 0) AS is_header FROM tbl1")
SQL["p10_table_family"] = with_(["tdiff"], """SELECT doc_id, ord, contains(table_name, 'присоед') AS wire_table, true AS wire_connection,
  sel IN (1, 3) AS wire_column, sel <> 0 AS wire_key, sel = 7 AS unnumbered, sel = 7 AS connection, sel = 4 AS marking,
  sel IN (4, 5, 6) AS header_row, row_key AS marking_key FROM tdiff""")
SQL["f11_table_headers"] = with_(["dtab"], """SELECT table_id, 'код|наименование|длина мм|кол|маркировка xp1' AS header_key,
  nullif(regexp_extract(name, '\\d+'), '') AS own_number,
  CASE WHEN table_id % 3 = 0 THEN '1' ELSE nullif(regexp_extract(name, '\\d+'), '') END AS number,
  CASE WHEN table_id % 3 = 0 THEN 'table:1' WHEN regexp_extract(name, '\\d+') <> '' THEN 'table:' || regexp_extract(name, '\\d+') ELSE lower(name) END AS table_key,
  'код|наименование|длина, мм|кол|маркировка / xp1' || CASE WHEN table_id % 5 = 1 THEN '|' ELSE '' END AS canon FROM dtab""")
SQL["f12_table_heads"] = with_(["tbl1"], f""", t AS (SELECT table_id, list(cells ORDER BY row_index) AS r FROM tbl1 WHERE row_index <= 5 GROUP BY table_id),
  d AS (SELECT table_id, table_id % 3 AS k, CASE WHEN table_id % 3 = 0 THEN CASE WHEN len(r) > 1 AND r[2] = {COLS} THEN 3 ELSE 2 END
      WHEN table_id % 3 = 1 THEN 1 ELSE CASE WHEN len(r) > 1 AND r[2] = {COLS} THEN 2
        WHEN len(r) > 2 AND r[3] = {COLS} THEN 1 ELSE 1 END END AS depth FROM t)
  SELECT table_id, CAST(depth AS INT) AS depth, CASE WHEN k = 0 THEN 'Код|Наименование|Длина, мм / L, мм|Кол.|Маркировка / XP1 / XS1|Маркировка / XP1'
      ELSE 'Код|Наименование|Длина, мм|Кол.|Маркировка / XP1|Маркировка / XP1' END AS names,
    CASE WHEN table_id % 4 = 0 THEN 'продолжение таблицы 9' WHEN table_id % 5 > 0 THEN 'Код | Наименование | Длина, мм | Кол. | Маркировка / XP1'
      ELSE 'Таблица_стр_' || (table_id % 9) END AS name FROM d""")
SQL["f13_row_keys"] = with_(["tbl1"], f"""SELECT table_id, row_index, CAST(CASE table_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 0 END AS INT) AS key_col,
  CASE WHEN cells = {COLS} THEN 'Маркировка / XP1'
    ELSE CASE table_id % 4 WHEN 0 THEN CASE WHEN cells[2] = '' THEN cells[1] || ' | ' || cells[3] ELSE cells[2] END WHEN 1 THEN cells[3]
      WHEN 2 THEN cells[1] || ' | ' || CASE WHEN cells[2] = '' THEN cells[3] ELSE cells[2] END ELSE cells[1] END END AS row_key
  FROM tbl1 WHERE row_index > 1""")
SQL["f19_connector"] = with_(["tdiff"], """SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN 'XS' || v1_val
  WHEN sel = 4 THEN 'XP' || (1 + position % 3) END AS connector FROM tdiff""")


def data(v):
    return (f"SELECT *, cells[1] AS row_key, {ck('cells[1]')} AS base_key, CAST(row_number() OVER (PARTITION BY table_id, {ck('cells[1]')} "
            f"ORDER BY row_index) AS BIGINT) AS occ FROM tbl{v} WHERE row_index > 1 AND cells <> {COLS}")


def filled(v):
    return (f"SELECT * REPLACE ([cells[1], coalesce(last_value(nullif(cells[2], '') IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row_index "
            f"ROWS UNBOUNDED PRECEDING), ''), cells[3], cells[4], cells[5]] AS cells) FROM d{v}")


SQL["w05_data_rows"] = with_(["tbl1"], "SELECT table_id, row_index, row_key, base_key, occ FROM d1", [("d1", data(1))])
SQL["w06_fill_down"] = with_(["tbl1"], "SELECT table_id, row_index, array_to_string(cells, '|') AS cells FROM f1", [("d1", data(1)), ("f1", filled(1))])
SQL["w04_neighbour_rows"] = with_(["tbl1"], """SELECT table_id, row_index, array_to_string(lag(cells) OVER w, '|') AS prev_cells,
  array_to_string(lead(cells) OVER w, '|') AS next_cells FROM tbl1 WINDOW w AS (PARTITION BY table_id ORDER BY row_index)""")
SQL["j03_cell_diff"] = with_(["tbl1", "tbl2"], f""", n AS (SELECT table_id, greatest(sum(v1), sum(v2)) AS table_data_rows FROM (
    SELECT table_id, 1 AS v1, 0 AS v2 FROM f1 UNION ALL SELECT table_id, 0, 1 FROM f2) GROUP BY table_id),
  j AS (SELECT coalesce(a.table_id, b.table_id) AS table_id, coalesce(a.occ, b.occ) AS occ, coalesce(b.row_key, a.row_key) AS row_key,
    coalesce(b.row_index, a.row_index) AS row_index, coalesce(b.table_name, a.table_name) AS table_name, coalesce(b.page_num, a.page_num) AS page_num,
    a.cells AS c1, b.cells AS c2 FROM f1 a FULL JOIN f2 b ON a.table_id = b.table_id AND a.base_key = b.base_key AND a.occ = b.occ),
  w AS (SELECT *, 1 AS i FROM j WHERE c1 IS NULL OR c2 IS NULL UNION ALL
    SELECT *, unnest([2, 3, 4, 5]) AS i FROM j WHERE c1 IS NOT NULL AND c2 IS NOT NULL),
  x AS (SELECT *, c1[i] AS v1_val, c2[i] AS v2_val, {COLS}[i] AS col_name FROM w)
  SELECT table_id, occ, row_key, row_index, table_name, page_num, i AS col_index, col_name, CASE WHEN c1 IS NULL THEN 'row_added'
    WHEN c2 IS NULL THEN 'row_removed' WHEN v1_val <> '' AND v2_val <> '' THEN 'modified' WHEN v1_val <> '' THEN 'removed' ELSE 'added' END AS status,
    v1_val, v2_val, CAST(table_data_rows AS BIGINT) AS table_data_rows FROM x JOIN n USING (table_id)
  WHERE i = 1 OR {ck('v1_val')} <> {ck('v2_val')}""".replace("WITH", "WITH"), [("d1", data(1)), ("f1", filled(1)), ("d2", data(2)), ("f2", filled(2))])

J14 = """, art AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_key ORDER BY ord) AS k FROM tdiff WHERE sel = 1),
  cnt AS (SELECT doc_id, table_key, count(*) AS n FROM tdiff WHERE sel = 0 GROUP BY ALL),
  keep AS (SELECT art.* EXCLUDE (k) FROM art LEFT JOIN cnt USING (doc_id, table_key) WHERE k > coalesce(n, 0)
    UNION ALL SELECT * FROM tdiff WHERE sel NOT IN (0, 1))"""


def j15(src):
    return f""", mv AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_key, lower(subject), status ORDER BY ord) AS k,
    count(*) FILTER (WHERE status = 'row_added') OVER (PARTITION BY doc_id, table_key, lower(subject)) AS na,
    count(*) FILTER (WHERE status = 'row_removed') OVER (PARTITION BY doc_id, table_key, lower(subject)) AS nr
    FROM {src} WHERE status IN ('row_added', 'row_removed')),
  clean AS (SELECT * EXCLUDE (k, na, nr) FROM mv WHERE k > least(na, nr) UNION ALL
    SELECT * FROM {src} WHERE status NOT IN ('row_added', 'row_removed'))"""


SQL["j14_counted_cancellation"] = with_(["tdiff"], J14 + " SELECT doc_id, ord, table_key, subject, status FROM keep")
SQL["j15_two_sided_cancellation"] = with_(["tdiff"], j15("tdiff") + " SELECT doc_id, ord, table_key, subject, status FROM clean")


def islands(src, keys, order, name):
    """Displayed items: runs of three or more numbers as first-last, other rows single."""
    return f""", {name}1 AS (SELECT *, try_cast(subject AS BIGINT) AS num, lag(try_cast(subject AS BIGINT)) OVER (PARTITION BY {keys} ORDER BY {order}) AS pnum FROM {src}),
  {name}2 AS (SELECT *, sum(CASE WHEN num = pnum + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM {name}1),
  {name}3 AS (SELECT *, count(*) OVER (PARTITION BY {keys}, run) AS n, row_number() OVER (PARTITION BY {keys}, run ORDER BY {order}) AS r,
    last_value(subject) OVER (PARTITION BY {keys}, run ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM {name}2),
  {name} AS (SELECT *, CASE WHEN n >= 3 THEN subject || '-' || z ELSE subject END AS item, CASE WHEN n >= 3 THEN n ELSE 1 END AS records,
    row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS q FROM {name}3 WHERE n < 3 OR r = 1)"""


def quoted(keys, name, out):
    return f""", {out} AS (SELECT {keys}, count(*) AS n_items, sum(records) AS n_records,
    string_agg('"' || item || '"', ', ' ORDER BY q) FILTER (WHERE q <= 12) || CASE WHEN count(*) > 12 THEN ' и еще ' ||
      CAST(sum(records) FILTER (WHERE q > 12) AS BIGINT) || ' записей' ELSE '' END AS listed,
    CASE WHEN count(*) > 12 THEN string_agg(item, ', ' ORDER BY q) FILTER (WHERE q <= 12) || ' и еще ' || (count(*) - 12) || ' проводов'
      WHEN count(*) = 1 THEN min(item) ELSE string_agg(item, ', ' ORDER BY q) FILTER (WHERE q < m) || ' и ' || max(item) FILTER (WHERE q = m) END AS wires
    FROM (SELECT *, max(q) OVER (PARTITION BY {keys}) AS m FROM {name}) GROUP BY {keys})"""


def distinct_subjects(src, keys, order, name):
    return f", {name} AS (SELECT {keys}, min_by(subject, ({order})) AS subject, min(({order})) AS o FROM {src} GROUP BY {keys}, lower(subject))"


SQL["w12_range_compression"] = with_(["nsub"], islands("nsub", "doc_id", "subject", "isl")
                                     + " SELECT doc_id, subject AS first, item, CAST(records AS BIGINT) AS records FROM isl")
SQL["o07_top_with_rest"] = with_(["nsub"], islands("nsub", "doc_id", "subject", "isl") + quoted("doc_id", "isl", "lst")
                                 + " SELECT doc_id, n_items, CAST(n_records AS BIGINT) AS n_records, listed, wires FROM lst")


def rollup(src):
    return (f""", wr AS (SELECT doc_id, table_key, subject, CASE WHEN sel = 3 THEN 0 ELSE 1 END AS c, ord FROM {src}
    WHERE contains(table_name, 'присоед') AND (sel = 3 OR sel = 7))"""
            + distinct_subjects("wr", "doc_id, table_key", "c, ord", "wd")
            + ", we AS (SELECT doc_id, table_key FROM wd GROUP BY ALL HAVING count(*) FILTER (WHERE o[1] = 0) >= 3), wf AS (SELECT * FROM wd SEMI JOIN we USING (doc_id, table_key))"
            + islands("wf", "doc_id, table_key", "o", "wi") + quoted("doc_id, table_key", "wi", "wl"))


SQL["a05_wire_rollup"] = with_(["tdiff"], rollup("tdiff") + """ SELECT doc_id, table_key, 'table_column_changed' AS fact_type,
  CAST(n_records AS BIGINT) AS subjects, 'В таблице 1 введены провода ' || wires || '.' AS note FROM wl""")

GKEYS = "doc_id, table_key, col, gs"


def groups(src):
    return (f", g AS (SELECT *, col_name AS col, CASE WHEN status LIKE 'row%' THEN status ELSE 'changed' END AS gs FROM {src})"
            + distinct_subjects("g", GKEYS, "ord", "gd")
            + f", gc AS (SELECT {GKEYS}, count(*) AS changes FROM g GROUP BY ALL), gn AS (SELECT {GKEYS}, count(*) AS subjects FROM gd GROUP BY ALL)")


SQL["a06_whole_column"] = with_(["tdiff"], groups("tdiff") + """ SELECT doc_id, table_key, col AS column, gs AS group_status, changes, subjects,
  10 AS table_rows, subjects >= 8 AS whole_column FROM gc JOIN gn USING (doc_id, table_key, col, gs)""")

PHRASE = ("CASE col WHEN 'Поз.' THEN 'изменилась позиция' WHEN 'Длина, мм' THEN 'изменилась длина' "
          "WHEN 'Код' THEN 'изменилось значение' ELSE CASE WHEN starts_with(col, 'Маркировка') THEN 'изменилась маркировка' ELSE 'изменилось значение' END END")
SQL["a04_column_facts"] = with_(["tdiff"], J14 + j15("keep") + rollup("clean") + groups("clean") + islands("gd", GKEYS, "o", "gi") + quoted(GKEYS, "gi", "gl")
                                + f""" SELECT doc_id, table_key, col AS column, gs AS group_status, changes, subjects, subjects >= 8 AS whole_column,
    'table_column_changed' AS fact_type, CASE gs WHEN 'row_added' THEN 'В таблице ' || num || ' введены записи для ' || listed
      WHEN 'row_removed' THEN 'Из таблицы ' || num || ' аннулированы записи для ' || listed
      ELSE 'В таблице ' || num || ' в графе "' || col || '" ' || CASE WHEN col = 'От соединителя' THEN 'изменилось место присоединения' ELSE {PHRASE} END
        || CASE WHEN subjects >= 8 THEN CASE WHEN {PHRASE} = 'изменилось значение' AND col <> 'От соединителя' THEN ' код' ELSE '' END ELSE ' для ' || listed END END || '.' AS note
  FROM (SELECT *, CASE WHEN table_key LIKE 'table:%' THEN substr(table_key, 7) ELSE '1' END AS num FROM gc) JOIN gn USING (doc_id, table_key, col, gs)
  JOIN gl USING (doc_id, table_key, col, gs) ANTI JOIN we USING (doc_id, table_key)""")

SQL["a07_marking_tables"] = with_(["tdiff"], """, it AS (
    SELECT doc_id, table_name, 1 AS kind, 'изменена маркировка "XP' || (1 + position % 3) || '"' AS item, min(ord) AS p FROM tdiff WHERE sel = 4 GROUP BY ALL
    UNION ALL SELECT doc_id, table_name, kind, CASE kind WHEN 2 THEN 'аннулированы записи для ' ELSE 'введены записи для ' END ||
      string_agg('"' || k || '"', ', ' ORDER BY p), min(p) FROM (SELECT doc_id, table_name, CASE status WHEN 'row_removed' THEN 2 ELSE 3 END AS kind,
        lower(row_key) AS n, min_by(row_key, ord) AS k, min(ord) AS p FROM tdiff WHERE status LIKE 'row%' GROUP BY ALL) GROUP BY doc_id, table_name, kind),
  ln AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY doc_id, table_name) AS m FROM it WINDOW w AS (PARTITION BY doc_id, table_name ORDER BY kind, p)),
  lab AS (SELECT DISTINCT doc_id, table_name FROM tdiff)
  SELECT doc_id, table_name, CAST(n AS INT) AS line_no, '- ' || item || CASE WHEN n = m THEN '.' ELSE ';' END AS line FROM ln
  UNION ALL SELECT doc_id, table_name, 0, 'Изменена таблица' || CASE WHEN regexp_extract(table_name, '\\d+') <> '' THEN ' ' || regexp_extract(table_name, '\\d+') ELSE '' END
    || CASE WHEN EXISTS (SELECT 1 FROM it WHERE it.doc_id = lab.doc_id AND it.table_name = lab.table_name) THEN ':' ELSE '.' END FROM lab""")

SQL["a03_merge_continued"] = with_(["dtab", "tbl1"], f""", m AS (SELECT *, nullif(regexp_extract(name, '\\d+'), '') AS num,
    row_number() OVER (PARTITION BY doc_id, nullif(regexp_extract(name, '\\d+'), '') ORDER BY page_num, y0, x0, table_id) AS rk FROM dtab),
  h AS (SELECT doc_id, num, min_by(table_id, rk) AS table_id, min(page_num) AS page_num, min(x0) AS x0, min_by(y0, page_num) AS y0, max(x1) AS x1,
    min_by(y1, page_num) AS y1, coalesce(min_by(name, rk) FILTER (WHERE NOT starts_with(name, 'Прод')), 'Таблица ' || num) AS name,
    max(len(names)) AS width, count(*) AS pieces FROM m WHERE num IS NOT NULL GROUP BY doc_id, num
    UNION ALL SELECT doc_id, num, table_id, page_num, x0, y0, x1, y1, name, len(names), 1 FROM m WHERE num IS NULL),
  r AS (SELECT coalesce(b.table_id, m.table_id) AS tid, t.row_index, m.num, m.rk FROM tbl1 t JOIN m ON t.table_id = m.table_id
    LEFT JOIN (SELECT doc_id, num, table_id FROM m WHERE rk = 1 AND num IS NOT NULL) b ON b.doc_id = m.doc_id AND b.num = m.num
    WHERE m.num IS NULL OR m.rk = 1 OR (t.row_index > 1 AND t.cells <> {COLS})),
  c AS (SELECT tid, count(*) AS n_rows, max(row_index) AS mx, max(num) AS num FROM r GROUP BY tid)
  SELECT doc_id, table_id, page_num, x0, y0, x1, y1, name, CAST(width AS INT) AS width, pieces, n_rows,
    CAST(CASE WHEN c.num IS NULL THEN mx ELSE n_rows END AS INT) AS last_row FROM h LEFT JOIN c ON c.tid = h.table_id""")


def signed(v):
    """Tables of a version with the parts of their signature, in the order of their document."""
    head = "['hкод', 'наименование', 'длина, мм', 'кол', 'маркировка xp1']"
    page, keep, size = ("page_num", "true", "5") if v == 1 else (
        "CAST(CASE WHEN table_id % 7 = 0 THEN page_num + 1 ELSE page_num END AS INT)", "table_id % 11 <> 0", "CASE WHEN table_id % 6 = 0 THEN 3 ELSE 5 END")
    return (f"SELECT doc_id, table_id, table_id % 8 AS ord, name, page, ['p' || page, 't' || coalesce(regexp_extract(name, '\\d+'), '')] || {head}[1:w] AS parts, w "
            f"FROM (SELECT *, {page} AS page, {size} AS w FROM dtab) WHERE {keep}")


PAIRED = [("s1", signed(1)), ("s2", signed(2)),
          ("likes", """SELECT doc_id, a.table_id AS old_id, a.ord, b.table_id AS new_id, b.ord AS new_ord,
             len(list_intersect(a.parts, b.parts)) / len(list_distinct(a.parts || b.parts)) AS share, CASE WHEN a.page = b.page THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS bonus
             FROM s1 a JOIN s2 b USING (doc_id)"""),
          ("asks", """SELECT doc_id, table_id AS old_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS turn, prefs FROM s1 LEFT JOIN (
             SELECT doc_id, old_id, list(new_id ORDER BY share + bonus DESC, new_ord) AS prefs FROM likes WHERE share + bonus >= 0.45 GROUP BY ALL) p
             ON p.doc_id = s1.doc_id AND p.old_id = s1.table_id""".replace("SELECT doc_id, table_id", "SELECT s1.doc_id, table_id").replace("PARTITION BY doc_id", "PARTITION BY s1.doc_id")),
          ("turns", """SELECT DISTINCT doc_id, 0::BIGINT AS turn, []::BIGINT[] AS used, NULL::BIGINT AS old_id, NULL::BIGINT AS new_id FROM s1
             UNION ALL SELECT doc_id, turn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, old_id, pick FROM (
               SELECT t.doc_id, a.turn, t.used, a.old_id, list_filter(a.prefs, lambda x: NOT list_contains(t.used, x))[1] AS pick
               FROM turns t JOIN asks a ON a.doc_id = t.doc_id AND a.turn = t.turn + 1)"""),
          ("pairs", """SELECT doc_id, old_id, new_id FROM turns WHERE turn > 0 UNION ALL SELECT doc_id, NULL, table_id FROM s2
             WHERE table_id NOT IN (SELECT new_id FROM turns WHERE new_id IS NOT NULL)""")]
SQL["j09_table_pairing_tokens"] = with_(["dtab"], "SELECT doc_id, old_id, new_id FROM pairs", PAIRED).replace("WITH", "WITH RECURSIVE", 1)


def beside(v):
    return (f"SELECT *, coalesce(lag(c) OVER w, '') AS prv, coalesce(lead(c) OVER w, '') AS nxt FROM (SELECT *, array_to_string(cells, '|') || CASE WHEN w = 6 THEN '|' ELSE '' END AS c "
            f"FROM f{v} JOIN h{v} USING (table_id)) WINDOW w AS (PARTITION BY table_id ORDER BY row_index)")


def heads(v):
    return f"SELECT table_id, name, page, CASE WHEN w = 5 AND table_id % 5 = 1 THEN 6 ELSE w END AS w FROM s{v}"


SQL["j03_table_diff"] = with_(["tbl1", "tbl2", "dtab"], f""", v1 AS (SELECT p.*, b.* FROM pairs p JOIN n1 b ON b.table_id = p.old_id),
  v2 AS (SELECT p.*, b.* FROM pairs p JOIN n2 b ON b.table_id = p.new_id),
  n AS (SELECT old_id, new_id, max(k) AS table_data_rows FROM (SELECT old_id, new_id, table_id, 1 AS v, count(*) AS k FROM v1 GROUP BY ALL
    UNION ALL SELECT old_id, new_id, table_id, 2, count(*) FROM v2 GROUP BY ALL) GROUP BY ALL),
  j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.old_id, b.old_id) AS old_id, coalesce(a.new_id, b.new_id) AS new_id, coalesce(a.occ, b.occ) AS occ,
    coalesce(b.row_key, a.row_key) AS row_key, coalesce(b.row_index, a.row_index) AS row_index, a.cells AS c1, b.cells AS c2, a.c AS x1, b.c AS x2,
    a.prv AS p1, b.prv AS p2, a.nxt AS q1, b.nxt AS q2 FROM v1 a FULL JOIN v2 b ON a.old_id = b.old_id AND a.new_id = b.new_id AND a.base_key = b.base_key AND a.occ = b.occ),
  w AS (SELECT *, 1 AS i FROM j WHERE c1 IS NULL OR c2 IS NULL UNION ALL SELECT *, unnest([2, 3, 4, 5]) AS i FROM j WHERE c1 IS NOT NULL AND c2 IS NOT NULL),
  x AS (SELECT w.*, c1[i] AS v1_val, c2[i] AS v2_val, CASE WHEN c1 IS NULL THEN true WHEN c2 IS NULL THEN false ELSE i <= h2.w END AS of_new, h1.w AS w1, h2.w AS w2,
    h1.name AS n1, h2.name AS n2, h1.page AS g1, h2.page AS g2 FROM w LEFT JOIN h1 ON h1.table_id = w.old_id LEFT JOIN h2 ON h2.table_id = w.new_id)
  SELECT doc_id, x.old_id, CASE WHEN of_new THEN n2 ELSE n1 END AS table_name, CAST(CASE WHEN of_new THEN g2 ELSE g1 END AS INT) AS page_num,
    array_to_string({COLS}[1:CASE WHEN of_new THEN w2 ELSE w1 END], '|') || CASE WHEN (CASE WHEN of_new THEN w2 ELSE w1 END) = 6 THEN '|' ELSE '' END AS column_names, occ, row_key, row_index,
    i AS col_index, {COLS}[i] AS col_name, 'Код' AS key_column, CASE WHEN c1 IS NULL THEN 'row_added' WHEN c2 IS NULL THEN 'row_removed'
    WHEN v1_val <> '' AND v2_val <> '' THEN 'modified' WHEN v1_val <> '' THEN 'removed' ELSE 'added' END AS status, v1_val, v2_val, table_data_rows,
    coalesce(x1, '') AS row_values_v1, coalesce(x2, '') AS row_values_v2, coalesce(p1, '') AS prev_row_values_v1, coalesce(p2, '') AS prev_row_values_v2,
    coalesce(q1, '') AS next_row_values_v1, coalesce(q2, '') AS next_row_values_v2
  FROM x JOIN n ON n.old_id IS NOT DISTINCT FROM x.old_id AND n.new_id IS NOT DISTINCT FROM x.new_id
  WHERE c1 IS NULL OR c2 IS NULL OR {ck('v1_val')} <> {ck('v2_val')}""",
                               [*PAIRED, ("d1", data(1)), ("f1", filled(1)), ("d2", data(2)), ("f2", filled(2)), ("h1", heads(1)), ("h2", heads(2)), ("n1", beside(1)), ("n2", beside(2))]
                               ).replace("WITH", "WITH RECURSIVE", 1)


SQL["a03_merged_rows"] = with_(["dtab", "tbl1"], f""", m AS (SELECT *, nullif(regexp_extract(name, '\\d+'), '') AS num,
    row_number() OVER (PARTITION BY doc_id, nullif(regexp_extract(name, '\\d+'), '') ORDER BY page_num, y0, x0, table_id) AS rk FROM dtab),
  h AS (SELECT doc_id, num, min_by(table_id, rk) AS table_id, min(page_num) AS page_num, min(x0) AS x0, min_by(y0, page_num) AS y0, max(x1) AS x1,
    min_by(y1, page_num) AS y1, coalesce(min_by(name, rk) FILTER (WHERE NOT starts_with(name, 'Прод')), 'Таблица ' || num) AS name,
    max(len(names)) AS width, count(*) AS pieces FROM m WHERE num IS NOT NULL GROUP BY doc_id, num
    UNION ALL SELECT doc_id, num, table_id, page_num, x0, y0, x1, y1, name, len(names), 1 FROM m WHERE num IS NULL),
  r AS (SELECT coalesce(b.table_id, m.table_id) AS tid, t.row_index, t.cells, m.num, m.rk FROM tbl1 t JOIN m ON t.table_id = m.table_id
    LEFT JOIN (SELECT doc_id, num, table_id FROM m WHERE rk = 1 AND num IS NOT NULL) b ON b.doc_id = m.doc_id AND b.num = m.num
    WHERE m.num IS NULL OR m.rk = 1 OR (t.row_index > 1 AND t.cells <> {COLS}))
  SELECT tid AS table_id, CAST(CASE WHEN num IS NULL THEN row_index ELSE row_number() OVER (PARTITION BY tid ORDER BY rk, row_index) END AS INT) AS row_index, array_to_string(cells, '|') AS cells FROM r""")


SQL["a04_fact_values"] = with_(["tdiff"], J14 + j15("keep") + rollup("clean") + """,
  v AS (SELECT doc_id, table_key, col_name AS "column", CASE WHEN status LIKE 'row%' THEN status ELSE 'changed' END AS group_status, ord,
      unnest([{'l': 'row_keys', 'v': nullif(subject, '')}, {'l': 'old_values', 'v': v1_val}, {'l': 'new_values', 'v': v2_val}]) AS e FROM clean ANTI JOIN we USING (doc_id, table_key))
  SELECT doc_id, table_key, "column", group_status, e.l AS list, row_number() OVER (PARTITION BY doc_id, table_key, "column", group_status, e.l ORDER BY ord) AS n, e.v AS value FROM v WHERE e.v IS NOT NULL
  UNION ALL SELECT doc_id, table_key, 'Провод', 'row_added', unnest(['row_keys', 'new_values']), row_number() OVER (PARTITION BY doc_id, table_key ORDER BY o), subject FROM wf""")
