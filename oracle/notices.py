"""DuckDB SQL for the queries on facts, notes, blocks and notices."""

import oracle.tables  # noqa: F401  (registers the table difference snapshot)
from oracle.base import any_of, ck, q, squeeze, with_
from oracle.items import FIELDS
from oracle.texts import SF, TOPICS, about, good, lower_first, strip_period, summary
from revdiff import rules

SQL = {}


def facts(prefix):
    ch = ", ".join(f"CASE WHEN {ck('a.' + f)} <> {ck('b.' + f)} THEN {{'f': {q(f)}, 'o': a.{f}, 'n': b.{f}}} END" for f in FIELDS)
    return f""", d AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.position, b.position) AS position, coalesce(b.section, a.section) AS section,
      coalesce(b.name, a.name) AS description, CASE WHEN b.doc_id IS NULL THEN 'removed' WHEN a.doc_id IS NULL THEN 'added' ELSE 'modified' END AS st,
      unnest(CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN [{{'f': '', 'o': a.quantity, 'n': b.quantity}}] ELSE list_filter([{ch}], lambda x: x IS NOT NULL) END) AS c
      FROM u1 a FULL JOIN u2 b ON a.doc_id = b.doc_id AND a.position = b.position),
    fx AS (SELECT doc_id, position, section, description, CASE WHEN st <> 'modified' THEN '{prefix}_' || st WHEN c.f IN ('quantity', 'note') THEN '{prefix}_' || c.f || '_changed'
      ELSE '{prefix}_modified' END AS fact_type, c.f AS field, c.o AS old_value, c.n AS new_value FROM d)"""


TIDY = "(field IN ('', 'quantity'))"
SQL["a08_item_facts"] = with_(["u1", "u2"], facts("spec_item") + f" SELECT * FROM fx WHERE {TIDY}")
SQL["a08_element_facts"] = with_(["u1", "u2"], facts("element_item") + " SELECT doc_id, position, description, fact_type, field, old_value, new_value FROM fx")
SQL["a09_section_rollup"] = with_(["u1", "u2"], facts("spec_item").replace("FROM u1 a", "FROM u1 a").replace("coalesce(b.name, a.name) AS description",
    "coalesce(b.name, a.name) AS description, coalesce(b.designation, a.designation) AS des").replace("section, description, CASE", "section, description, des, CASE") + f""",
  it AS (SELECT doc_id, position, section, CASE fact_type WHEN 'spec_item_quantity_changed' THEN 1 WHEN 'spec_item_added' THEN 2 ELSE 3 END AS kind,
    CASE fact_type WHEN 'spec_item_quantity_changed' THEN description || ' на ' || new_value ELSE description || ' ' || des || ', количество ' || coalesce(new_value, old_value) END AS item FROM fx WHERE {TIDY}),
  ds AS (SELECT doc_id, kind, section, min_by(item, position) AS item, min(position) AS p FROM it GROUP BY doc_id, kind, section, lower(item)),
  nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, section ORDER BY p) AS n, count(*) OVER (PARTITION BY doc_id, kind, section) AS m FROM ds)
  SELECT doc_id, kind, section, CAST(n AS INT) AS line_no, '- ' || item || CASE WHEN n = m THEN '.' ELSE ';' END AS line FROM nb
  UNION ALL SELECT DISTINCT doc_id, kind, section, 0, 'В разделе "' || section || '" ' || ['изменено количество:', 'введена применяемость:', 'аннулирована применяемость:'][kind] FROM nb""")

SQL["a10_element_rollup"] = with_(["u1", "u2"], facts("element_item") + """,
  fy AS (SELECT *, CASE fact_type WHEN 'element_item_removed' THEN 2 WHEN 'element_item_added' THEN 3 WHEN 'element_item_quantity_changed' THEN 4 WHEN 'element_item_note_changed' THEN 5 END AS family FROM fx),
  sg AS (SELECT doc_id, family, position, CASE family WHEN 2 THEN 'Аннулирована применяемость элемента "' || description || '" для ' || CASE WHEN position % 4 = 0 THEN
      'позиционных обозначений "E' || position || '", "X1"' ELSE 'позиционного обозначения "E' || position || '"' END ELSE 'Введена применяемость ' || description END || '.' AS line FROM fy WHERE family IN (2, 3)),
  qd AS (SELECT doc_id, min_by(description || ' на ' || new_value, position) AS item, min(position) AS p FROM fy WHERE family = 4 GROUP BY doc_id, lower(description || ' на ' || new_value)),
  qn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n, count(*) OVER (PARTITION BY doc_id) AS m FROM qd)
  SELECT doc_id, family, min(position) AS place, 0 AS line_no, min_by(line, position) AS line FROM sg GROUP BY doc_id, family, lower(line)
  UNION ALL SELECT doc_id, 4, 0, CAST(n AS INT), '- ' || item || CASE WHEN n = m THEN '.' ELSE ';' END FROM qn
  UNION ALL SELECT DISTINCT doc_id, 4, 0, 0, 'Изменено количество элементов:' FROM qn
  UNION ALL SELECT DISTINCT doc_id, 5, 0, 0, 'В графе "Примечание" изменены данные элементов.' FROM fy WHERE family = 5""")

from oracle.headers import PAGES, SQL as HEADERS  # noqa: E402

J5_BODY = HEADERS["j05_metadata_facts"].split(", j AS (", 1)[1]
J5 = ", j AS (" + J5_BODY.split(")\n  SELECT", 1)[0] + "), mf AS (SELECT" + J5_BODY.split(")\n  SELECT", 1)[1] + ")"
SC = HEADERS["a13_document_scores"].split(", s AS (", 1)[1]
GF = PAGES + ", s AS (" + SC.split(")\n  SELECT", 1)[0] + "), gfx AS (SELECT" + SC.split(")\n  SELECT", 1)[1] + ")"
DERIVED = f"CASE WHEN {good('s2')} THEN {lower_first(strip_period('s2'))} ELSE NULL END"
SQL["a11_family_notes"] = with_(["meta1", "meta2", "gfx1", "gfx2", "req1"], J5 + GF + SF + f""",
  s2 AS (SELECT doc_id, number, status, {summary('s')} AS s2, {summary("CASE WHEN status <> 'removed' THEN text END")} AS s3, status <> 'removed' AS has FROM sf),
  s4 AS (SELECT *, coalesce(CASE WHEN {good('s2')} THEN {lower_first(strip_period('s2'))} END, CASE WHEN {good('s3')} THEN {lower_first(strip_period('s3'))} END, {q(rules.TOPIC_DEFAULT)}) AS topic FROM s2),
  nt AS (SELECT doc_id, 1 AS family, 0 AS step, CASE fact_type WHEN 'mass_changed' THEN 1 WHEN 'scale_changed' THEN 2 ELSE 3 END AS ord,
      CASE fact_type WHEN 'mass_changed' THEN 'В основной надписи в графе "Масса" изменено значение на ' || new_value || ' кг.' WHEN 'scale_changed' THEN
        'В основной надписи в графе "Масштаб" изменено значение на ' || new_value || '.' ELSE 'В основной надписи изменено наименование на "' || new_value || '".' END AS note FROM mf
    UNION ALL SELECT doc_id, 2, 0, 4, 'Изменена графика чертежа.' FROM gfx WHERE has_changes
    UNION ALL SELECT doc_id, 4, 3, 9, 'изменена нумерация пунктов' FROM meta1 WHERE doc_id NOT IN (SELECT doc_id FROM req1)
    UNION ALL SELECT doc_id, 4, CASE status WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END, 10 + number,
      CASE status WHEN 'added' THEN 'введен пункт ' WHEN 'removed' THEN 'аннулирован пункт ' ELSE 'изменен пункт ' || number || ' ' END || {about('topic')} FROM s4)
  SELECT doc_id, family, CAST(min((step, ord))[1] AS INT) AS step, CAST(min((step, ord))[2] AS INT) AS ord, min_by(note, (step, ord)) AS note
  FROM nt GROUP BY doc_id, family, lower({squeeze('note')})""")

NOTES = ('В таблице {n} в графе "Код" изменилось значение для "{k}"', 'Из таблицы {n} аннулированы записи для "{k}".', "Изменена таблица {n}",
         "Изменена таблица", "Изменена графика чертежа.", 'В таблице введены записи для "{k}"', "В таблице {m} изменились строки", "введен пункт о {k}")
TN = f""", t0 AS (SELECT doc_id, ord, (ord + doc_id) % 8 AS w0, 1 + doc_id % 3 AS n, 5 + ord % 2 AS m, v1_val AS k,
  replace(replace(replace([{", ".join(map(q, NOTES))}][(ord + doc_id) % 8 + 1], '{{n}}', CAST(1 + doc_id % 3 AS VARCHAR)), '{{m}}', CAST(5 + ord % 2 AS VARCHAR)), '{{k}}', v1_val) AS note0 FROM tdiff),
  t1 AS (SELECT *, CASE WHEN doc_id % 7 <= 1 AND contains(note0, '"') THEN CASE WHEN doc_id % 7 = 0 THEN 'Изменена таблица' ELSE 'Изменена таблица 4' END ELSE note0 END AS note1 FROM t0),
  t2 AS (SELECT *, CASE WHEN doc_id % 7 = 0 AND regexp_matches(note1, '[0-9]') THEN 'Изменились строки таблицы' ELSE note1 END AS note FROM t1),
  tn AS (SELECT doc_id, ord, note, n, k, CASE WHEN note = note0 THEN w0 ELSE 8 END AS w, nullif(regexp_extract(note, 'таблиц[аые] (\\d+)', 1), '') AS num FROM t2)"""
SQL["u03_union_families"] = with_(["tdiff"], TN + """ SELECT doc_id, ord, note, CASE w WHEN 4 THEN 1 WHEN 7 THEN 2 ELSE 3 END AS family FROM tn""")
SQL["o04_note_order"] = with_(["tdiff"], TN + """, p AS (SELECT doc_id, ord, note, CASE w WHEN 4 THEN 10 WHEN 7 THEN 30 ELSE 20 END AS priority FROM tn)
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, ord) AS place FROM p""")
SQL["a12_collapse_table_notes"] = with_(["tdiff"], TN + """,
  dt AS (SELECT doc_id, ord, CASE WHEN w = 5 THEN '1' ELSE CAST(n AS VARCHAR) END AS num, CASE w WHEN 0 THEN 'в графе "Код" изменилось значение для "' || k || '"'
    WHEN 1 THEN 'аннулированы записи для "' || k || '"' ELSE 'введены записи для "' || k || '"' END AS item FROM tn WHERE w IN (0, 1, 5)),
  ds AS (SELECT doc_id, num, min_by(item, ord) AS item, min(ord) AS ord FROM dt GROUP BY doc_id, num, lower(item)),
  nb AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id, num) AS c, min(ord) OVER (PARTITION BY doc_id, num) AS place FROM ds WINDOW w AS (PARTITION BY doc_id, num ORDER BY ord)),
  ge AS (SELECT doc_id, ord, num FROM tn WHERE w IN (2, 3, 6, 8)),
  br AS (SELECT doc_id, num, min(ord) AS ord FROM ge WHERE num IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ds WHERE ds.doc_id = ge.doc_id AND ds.num = ge.num) GROUP BY doc_id, num)
  SELECT doc_id, place AS ord, 0 AS line_no, CASE WHEN c = 1 THEN 'Изменена таблица ' || num || ' - ' || item || '.' ELSE 'Изменена таблица ' || num || ':' END AS line FROM nb WHERE i = 1
  UNION ALL SELECT doc_id, place, CAST(i AS INT), '- ' || item || CASE WHEN i = c THEN '.' ELSE ';' END FROM nb WHERE c > 1
  UNION ALL SELECT doc_id, ord, 0, 'Изменена таблица ' || num || '.' FROM br
  UNION ALL SELECT doc_id, min(ord), 0, 'Изменена таблица.' FROM ge WHERE num IS NULL AND NOT EXISTS (SELECT 1 FROM ds WHERE ds.doc_id = ge.doc_id)
    AND NOT EXISTS (SELECT 1 FROM br WHERE br.doc_id = ge.doc_id) GROUP BY doc_id
  UNION ALL SELECT doc_id, ord, 0, note FROM tn WHERE w IN (4, 7)""")

TYPE = "CASE WHEN contains(decimal_number, 'ПЭ4') THEN 'Перечень элементов' WHEN contains(decimal_number, ' Э4') THEN 'Схема электрическая соединений' ELSE 'Сборочный чертеж' END"
RANK = "CASE WHEN contains(decimal_number, 'ПЭ4') THEN 2 WHEN contains(decimal_number, ' Э4') THEN 4 ELSE 3 END"
SQL["o05_block_order"] = with_(["meta1"], f"""SELECT notice_id, doc_id AS block_id, {RANK} AS rank,
  row_number() OVER (PARTITION BY notice_id ORDER BY {RANK}, doc_id) AS place FROM meta1""")
SQL["o06_block_order_by_number"] = with_(["meta1"], f"""SELECT notice_id, doc_id AS block_id, {RANK} AS rank,
  row_number() OVER (PARTITION BY notice_id ORDER BY doc_id) AS place FROM meta1""")
SQL["p13_filled_blocks"] = with_(["meta1"], "SELECT notice_id, doc_id AS block_id FROM meta1 WHERE doc_id % 6 NOT IN (0, 2)")
SQL["p16_search_notices"] = with_(["meta1"], f"""SELECT notice_id, doc_id AS block_id FROM meta1 WHERE notice_id IN (
  SELECT notice_id FROM meta1 WHERE contains(lower(decimal_number || ' ' || {TYPE}), '77 э4'))""")
SQL["j19_upsert_blocks"] = with_(["meta1", "incoming"], f""", a AS (SELECT *, {TYPE} AS t FROM meta1), b AS (SELECT *, {TYPE} AS t FROM incoming)
  SELECT coalesce(a.notice_id, b.notice_id) AS notice_id, coalesce(a.decimal_number, b.decimal_number) AS decimal_number, coalesce(a.t, b.t) AS doc_type,
    coalesce(a.doc_id, b.doc_id + 5000000) AS block_id, coalesce(b.title, a.title) AS title, coalesce(b.scale, a.scale) AS scale, coalesce(b.mass_kg, a.mass_kg) AS mass_kg
  FROM a FULL JOIN b ON a.notice_id = b.notice_id AND a.decimal_number = b.decimal_number AND a.t = b.t""")
SQL["a18_notice_assembly"] = with_(["meta1", "meta2"], J5 + f""", n0 AS (SELECT m.notice_id, mf.doc_id, CASE fact_type WHEN 'mass_changed' THEN 1 WHEN 'scale_changed' THEN 2 ELSE 3 END AS o, fact_type, new_value
    FROM mf JOIN meta1 m USING (doc_id)),
  n1 AS (SELECT *, doc_id % 5 = 0 AND o = 2 AS dash FROM n0),
  n2 AS (SELECT *, sum((NOT dash)::INT) OVER (PARTITION BY doc_id ORDER BY o) AS no FROM n1),
  ls AS (SELECT notice_id, doc_id, 0 AS part, 0 AS o, 0 AS sub, decimal_number AS line FROM meta1 UNION ALL SELECT notice_id, doc_id, 1, 0, 0, 'Заменить' FROM meta1
    UNION ALL SELECT DISTINCT notice_id, doc_id, 2, 0, 0, 'Примечания:' FROM n2
    UNION ALL SELECT notice_id, doc_id, 3, o, 0, CASE WHEN dash THEN '- ' || new_value ELSE no || ' ' || fact_type || ' ' || new_value END FROM n2
    UNION ALL SELECT notice_id, doc_id, 3, o, 1, '- деталь;' FROM n2 WHERE doc_id % 3 = 0
    UNION ALL SELECT notice_id, doc_id, 4, 0, 0, CASE WHEN doc_id % 2 = 0 THEN 'Журнал № 1, запись № 2.' ELSE 'Журнал № XX, запись № XX.' END FROM meta1),
  rk AS (SELECT doc_id, {RANK} AS rank FROM meta1)
  SELECT notice_id, CAST(row_number() OVER (PARTITION BY notice_id ORDER BY rank, doc_id, part, o, sub) AS INT) AS line_no, doc_id AS block_id, line FROM ls JOIN rk USING (doc_id)""")

from oracle.tables import SQL as TABLES  # noqa: E402

KIND = "CASE WHEN doc_id % 5 = 0 THEN 'Спецификация' ELSE " + TYPE + " END"
SQL["change_notice"] = f"""WITH head AS ({with_(["meta2"], "SELECT * FROM meta2")}), a11 AS ({SQL["a11_family_notes"]}), a04 AS ({TABLES["a04_column_facts"]}), a09 AS ({SQL["a09_section_rollup"]}),
  a10 AS ({SQL["a10_element_rollup"]}), act AS ({HEADERS["u02_action_text"]}),
  doc AS (SELECT h.doc_id, notice_id, CASE WHEN h.doc_id % 5 = 0 THEN regexp_extract(decimal_number, '^[0-9]+') || ' СП' ELSE decimal_number END AS number,
    CASE WHEN h.doc_id % 5 = 0 THEN 'bom' WHEN contains(decimal_number, 'ПЭ4') THEN 'elements' WHEN contains(decimal_number, ' Э4') THEN 'wiring' ELSE 'drawing' END AS route,
    CASE WHEN h.doc_id % 5 = 0 THEN 1 ELSE {RANK} END AS rank, coalesce(action, 'Заменить') AS action FROM head h LEFT JOIN act ON act.doc_id = h.doc_id),
  told AS (SELECT a11.*, route FROM a11 JOIN doc USING (doc_id)),
  tf AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY table_key, "column", group_status) AS n, note FROM a04 JOIN doc USING (doc_id) WHERE route IN ('drawing', 'wiring')),
  tb AS (SELECT doc_id, n, regexp_extract(note, '^(?:В таблице|Из таблицы) (\\d+) ', 1) AS num, rtrim(regexp_extract(note, '^(?:В таблице|Из таблицы) \\d+ (.+)$', 1), ' .;') AS body FROM tf),
  td AS (SELECT doc_id, num, min_by(body, n) AS body, min(n) AS n FROM tb GROUP BY doc_id, num, lower(body)),
  tg AS (SELECT *, row_number() OVER (PARTITION BY doc_id, num ORDER BY n) AS i, count(*) OVER (PARTITION BY doc_id, num) AS c, min(n) OVER (PARTITION BY doc_id, num) AS place FROM td),
  req AS (SELECT doc_id, note, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN route = 'wiring' THEN 0 ELSE step END, ord) AS i, count(*) OVER (PARTITION BY doc_id) AS c
    FROM told WHERE family = 4 AND route IN ('drawing', 'wiring')),
  l0 AS (SELECT doc_id, CASE route WHEN 'wiring' THEN 5 WHEN 'drawing' THEN 1 ELSE 9 END AS family, ord AS place, '' AS label, 0 AS line_no, note AS line FROM told WHERE family = 1
      AND CASE route WHEN 'drawing' THEN true WHEN 'wiring' THEN NOT contains(note, '"Масса"') ELSE contains(note, 'изменено наименование') END
    UNION ALL SELECT doc_id, 2, 0, '', 0, CASE WHEN route = 'wiring' THEN 'Изменена графика схемы.' ELSE note END FROM told WHERE family = 2 AND route IN ('drawing', 'wiring')
    UNION ALL SELECT doc_id, 3, place, '', 0, CASE WHEN c = 1 THEN 'Изменена таблица ' || num || ' - ' || body || '.' ELSE 'Изменена таблица ' || num || ':' END FROM tg WHERE i = 1
    UNION ALL SELECT doc_id, 3, place, '', i, '- ' || body || CASE WHEN i = c THEN '.' ELSE ';' END FROM tg WHERE c > 1
    UNION ALL SELECT DISTINCT doc_id, 4, 0, '', 0, 'Изменены ТТ:' FROM req UNION ALL SELECT doc_id, 4, 0, '', i, '- ' || note || CASE WHEN i = c THEN '.' ELSE ';' END FROM req
    UNION ALL SELECT doc_id, kind, 0, lower(section), line_no, line FROM a09 JOIN doc USING (doc_id) WHERE route = 'bom'
    UNION ALL SELECT doc_id, family, place, '', line_no, line FROM a10 JOIN doc USING (doc_id) WHERE route = 'elements'),
  l1 AS (SELECT * FROM l0 UNION ALL SELECT doc_id, 1, 0, '', 0, 'Изменения требуют уточнения.' FROM doc WHERE doc_id NOT IN (SELECT doc_id FROM l0)),
  pr AS (SELECT doc_id, family, place, label, min(CASE WHEN contains(lower(line), 'график') THEN 10 WHEN contains(lower(line), 'таблиц') THEN 20 WHEN contains(lower(line), 'пункт') OR starts_with(lower(line), 'изменены тт') THEN 30
    WHEN contains(lower(line), 'основной надписи') THEN 40 ELSE 90 END) AS p FROM l1 GROUP BY ALL),
  nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, family, place, label) AS o FROM pr),
  ls AS (SELECT doc_id, 0 AS part, 0 AS o, 0 AS sub, number AS line FROM doc UNION ALL SELECT doc_id, 1, 0, 0, action FROM doc UNION ALL SELECT doc_id, 2, 0, 0, 'Примечания:' FROM doc
    UNION ALL SELECT doc_id, 3, o, line_no, CASE WHEN line_no = 0 THEN o || ' ' || line ELSE line END FROM l1 JOIN nu USING (doc_id, family, place, label)
    UNION ALL SELECT doc_id, 4, 0, 0, 'Журнал № XX, запись № XX.' FROM doc)
  SELECT notice_id, CAST(row_number() OVER (PARTITION BY notice_id ORDER BY rank, doc_id, part, o, sub) AS INT) AS line_no, doc_id AS block_id, line FROM ls JOIN doc USING (doc_id)"""

NAMES = ["metadata", "tech_requirements", "specification_items", "tables", "graphics"]
OPEN = ", ".join("(" + str(i) + ", " + q(("],'" if i else ",'").replace("'", '"') + n + '":[') + ")" for i, n in enumerate(NAMES))
SQL["s03_full_diff_json"] = f"""WITH mf AS ({HEADERS["j05_metadata_facts"]}), rq AS ({with_(["req1"], "SELECT * FROM req1")}), it AS ({SQL["a08_item_facts"]}),
  td AS ({with_(["tdiff"], "SELECT * FROM tdiff")}), gx AS ({HEADERS["a13_document_scores"]}),
  e AS (SELECT doc_id, 0 AS no, CASE fact_type WHEN 'mass_changed' THEN 1 WHEN 'scale_changed' THEN 2 ELSE 3 END AS ord,
      to_json({{'kind': replace(fact_type, '_changed', ''), 'new_value': new_value}})::VARCHAR AS element FROM mf
    UNION ALL SELECT doc_id, 1, number, to_json({{'fact_type': 'tech_requirement_' || ['added', 'removed', 'modified'][number % 3 + 1], 'number': number}})::VARCHAR FROM rq
    UNION ALL SELECT doc_id, 2, position, to_json({{'fact_type': fact_type, 'position': position, 'section': section, 'description': description}})::VARCHAR FROM it WHERE field = ''
    UNION ALL SELECT doc_id, 3, ord, to_json({{'table_name': table_name, 'col_name': col_name, 'row_key': row_key, 'status': status}})::VARCHAR FROM td
    UNION ALL SELECT doc_id, 4, 1, to_json({{'has_changes': has_changes, 'change_percentage': change_percentage}})::VARCHAR FROM gx WHERE has_changes),
  x AS (SELECT doc_id, no, 1 AS k, ord, element || CASE WHEN lead(ord) OVER (PARTITION BY doc_id, no ORDER BY ord) IS NULL THEN '' ELSE ',' END AS line FROM e
    UNION ALL SELECT doc_id, no, 0, 0, CASE WHEN no = 0 THEN '{{"doc_id":' || doc_id ELSE '' END || part FROM (SELECT DISTINCT doc_id FROM e), (VALUES {OPEN}) AS o(no, part)
    UNION ALL SELECT DISTINCT doc_id, 5, 0, 0, ']}}' FROM e)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no, k, ord) AS n, line FROM x"""
SQL["s03_document_json"] = with_(["bom1"], """SELECT doc_id, 0 AS part, '{"doc_id":' || doc_id || ',"elements":[' || string_agg(
    to_json({'ord': ord, 'section': section, 'position': position, 'name': name, 'quantity': quantity})::VARCHAR, ',' ORDER BY ord) || ']}' AS json FROM bom1 GROUP BY doc_id""")
