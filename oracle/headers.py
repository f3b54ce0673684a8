"""DuckDB SQL for the queries on document headers, sheets, page scores and configuration maps."""

from oracle.base import any_of, compact, squeeze, strip, with_
from revdiff import rules

SQL = {}

SQL["s02_accept_files"] = "SELECT page_id, url, coalesce(ends_with(lower(url), '#top'), false) AS accepted FROM pages"
SQL["s04_notice_file_name"] = with_(["meta1"], """SELECT doc_id,
  'ИИ_И_И_' || notice_id || ' x__' || decimal_number || '.pdf' AS file_name FROM meta1""")

BARE = "CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE decimal_number END"
SQL["p08_document_type"] = with_(["meta1"], f""", d AS (SELECT doc_id, {BARE} AS n FROM meta1)
  SELECT doc_id, CASE WHEN ends_with(n, ' СБ') THEN 'Сборочный чертеж' WHEN ends_with(n, ' Э4') THEN 'Схема электрическая соединений'
    WHEN ends_with(n, ' ПЭ4') THEN 'Перечень элементов' WHEN doc_id % 9 = 0 THEN 'Спецификация'
    WHEN doc_id % 7 = 0 THEN 'Спецификация' WHEN doc_id % 11 = 0 THEN 'Перечень элементов'
    WHEN doc_id % 12 = 0 THEN 'Схема электрическая соединений' ELSE 'Не определён' END AS doc_type,
    CASE WHEN contains(n, 'ПЭ4') THEN 'Перечень элементов' WHEN contains(n, ' Э4') THEN 'Схема электрическая соединений'
    WHEN contains(n, ' СБ') THEN 'Сборочный чертеж' ELSE 'Спецификация' END AS by_number FROM d""")

SQL["p11_effective_metadata"] = with_(["meta1", "meta2"], """SELECT b.doc_id,
  coalesce(nullif(b.decimal_number, ''), a.decimal_number) AS decimal_number, coalesce(nullif(b.title, ''), a.title) AS title,
  coalesce(nullif(b.scale, ''), a.scale) AS scale, coalesce(b.mass_kg, a.mass_kg) AS mass_kg
  FROM meta2 b LEFT JOIN meta1 a ON a.doc_id = b.doc_id""")

SQL["p12_clean_status_map"] = with_(["sheets"], """SELECT doc_id, array_to_string(list_sort(
  CASE WHEN s = 'Нов.' THEN [p || '=new', '900=replace'] ELSE ['900=replace'] END), ',') AS statuses
  FROM (SELECT doc_id, max(page_num) AS p, max(status) AS s FROM sheets GROUP BY doc_id)""")

SQL["p14_first_value"] = """SELECT event_id, json_extract_string(props, '$.k') AS value,
  CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS VARCHAR) AS next_number FROM events"""


def mask(e):
    return (f"CASE WHEN {e} IS NULL THEN '' WHEN length({e}) <= 4 THEN repeat('*', length({e})) "
            f"ELSE repeat('*', greatest(length({e}) - 4, 4)) || right({e}, 4) END")


NAMES = "(?i)(?:" + "|".join(rules.SENSITIVE_KEY_PARTS) + ")[A-Za-z0-9_\\-]* ?[:=] ?$"
SQL["p15_mask_secrets"] = f"""SELECT 'event' AS kind, event_id AS id, {mask("(event_type || event_id)")} || '|' || event_type || '|' ||
    {mask("CAST(user_id AS VARCHAR)")} AS masked FROM events
  UNION ALL SELECT 'document', doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i > 1 AND
    regexp_matches(p[i - 1], '{NAMES}') THEN {mask("x")} ELSE x END), '"')
  FROM (SELECT doc_id, string_split(text, '"') AS p FROM documents WHERE regexp_matches(lower(text), 'token|secret|password|api_key'))"""

NUM = "replace(format('{:g}', CASE_), '.', ',')"
SQL["j05_metadata_facts"] = with_(["meta1", "meta2"], f""", j AS (SELECT b.doc_id, a.mass_kg m1, b.mass_kg m2, a.scale s1, b.scale s2,
    a.title t1, b.title t2 FROM meta2 b JOIN meta1 a ON a.doc_id = b.doc_id)
  SELECT doc_id, 'mass_changed' AS fact_type, {NUM.replace('CASE_', 'm1')} AS old_value, {NUM.replace('CASE_', 'm2')} AS new_value,
    'metadata' AS source FROM j WHERE m1 IS DISTINCT FROM m2 AND m2 IS NOT NULL
  UNION ALL SELECT doc_id, 'scale_changed', s1, s2, 'metadata' FROM j WHERE s1 IS DISTINCT FROM s2 AND coalesce(s2, '') <> ''
  UNION ALL SELECT doc_id, 'title_changed', t1, t2, 'metadata' FROM j WHERE t1 IS DISTINCT FROM t2 AND coalesce(t2, '') <> ''""")

SUF = "regexp_extract(decimal_number, ' .*$')"
W = "A-Za-zА-Яа-яЁё0-9_"
SFX = "(?:\\s?(?:СБ|СП|Э4|ПЭ4|ТУ|ВО|МЧ))?"


def number(body):
    return f"nullif(regexp_extract(text, '(?i)(?:^|[^{W}])({body}{SFX})(?:$|[^{W}])', 1), '')"


PATTERNS = ", ".join(map(number, (r"[A-ZА-ЯЁ]{1,10}\.\d{3}\.\d{2}\.\d{2}\.\d{2}\.\d{3}", r"\d{3}\.\d{2}\.\d{2}\.\d{2}\.\d{3}",
                                  r"[A-ZА-ЯЁ]{1,10}(?:[.\-]\d{2,5}){3,8}")))
GLUED = r"'(?i)(?:^|[^0-9])\d?(\d{3}\.\d{2}\.\d{2}\.\d{2}\.\d{3})(?:\s*(?:СБ|СП|ПЭ4|Э4))?'"
SQL["f08_document_number"] = with_(["meta1"], f""", d AS (SELECT doc_id, decimal_number,
    CASE WHEN doc_id % 2 = 0 THEN 'АБВГ.' ELSE '' END || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '.' ||
    lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(doc_id % 97 AS VARCHAR), 2, '0') || '.' ||
    lpad(CAST(doc_id % 89 AS VARCHAR), 2, '0') || '.' || lpad(CAST(doc_id % 999 AS VARCHAR), 3, '0') AS num,
    CASE WHEN doc_id % 5 < 3 THEN {SUF} ELSE '' END AS suf, doc_id % 5 = 4 AS told,
    CASE WHEN doc_id % 6 = 0 OR doc_id % 7 = 1 THEN 'x' ELSE ' x' END AS tail FROM meta1),
  e AS (SELECT *, 'Изм. Лист ' || num || suf || CASE WHEN told THEN ' см. сб' ELSE '' END || tail AS text FROM d),
  f AS (SELECT *, coalesce({PATTERNS}, nullif(regexp_extract(text, {GLUED}, 1) ||
      regexp_extract(substr(text, 11), '^[0-9.]+(\\s*(?:СБ|СП|ПЭ4|Э4))', 1), '')) AS hit,
    CASE WHEN regexp_matches(lower(text), '(^|[^a-zа-яё0-9_])сб($|[^a-zа-яё0-9_])') THEN 'СБ'
         WHEN regexp_matches(lower(text), '(^|[^a-zа-яё0-9_])пэ4($|[^a-zа-яё0-9_])') THEN 'ПЭ4'
         WHEN regexp_matches(lower(text), '(^|[^a-zа-яё0-9_])э4($|[^a-zа-яё0-9_])') THEN 'Э4' END AS stamp FROM e),
  g AS (SELECT *, concat_ws(' ', regexp_extract(hit, '^[^ ]+'), coalesce(nullif(trim(regexp_extract(hit, ' .*$')), ''), stamp)) AS n FROM f)
  SELECT doc_id, CASE WHEN hit IS NOT NULL THEN n END AS number, CASE WHEN hit IS NOT NULL THEN
    CASE WHEN contains(n, ' ') OR doc_id % 4 <> 0 THEN n ELSE n || ' СБ' END END AS full_number,
    CAST(doc_id AS VARCHAR) AS base FROM g""")

SQL["f09_scale_and_mass"] = with_(["meta1"], """SELECT doc_id, scale,
  CASE WHEN doc_id % 8 = 0 OR scale NOT LIKE '1:%' THEN NULL ELSE CAST(doc_id % 50 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS mass_kg FROM meta1""")

SQL["f10_sheet_marks"] = with_(["sheets"], """SELECT DISTINCT doc_id, page_num, change_token, linestatus,
  CASE status WHEN 'Зам.' THEN 'replace' WHEN 'Нов.' THEN 'new' END AS sheet_status,
  CASE WHEN status <> '' THEN CAST(CAST(regexp_extract(change_token, '\\d+') AS INT) AS VARCHAR) END AS glued_number,
  CAST(CAST(regexp_extract(change_token, '\\d+') AS INT) AS VARCHAR) AS change_number,
  CASE WHEN page_num % 2 = 0 THEN 12 ELSE page_num END AS sheet_count FROM sheets""")

PAGES = """, p AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page_num, b.page_num) AS page_num,
    CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN 'one side' ELSE 'common' END AS presence,
    CASE WHEN a.doc_id IS NOT NULL THEN b.score END AS score
    FROM gfx1 a FULL JOIN gfx2 b ON a.doc_id = b.doc_id AND a.page_num = b.page_num)"""
SQL["j18_align_pages"] = with_(["gfx1", "gfx2"], PAGES + " SELECT * FROM p")
SQL["a13_document_scores"] = with_(["gfx1", "gfx2"], PAGES + """, s AS (SELECT doc_id, sum(CAST(score AS DECIMAL(18, 6))) AS total,
    count(score) AS n, count(*) FILTER (WHERE presence = 'one side') AS extra,
    count(*) FILTER (WHERE presence = 'one side' OR score > CAST(0.35 AS DOUBLE)) AS regions FROM p GROUP BY doc_id)
  SELECT doc_id, regions > 0 AS has_changes, regions, round_even((CAST(coalesce(total, 0) AS DOUBLE)
    + CAST(least(extra, 1) * 100 AS DOUBLE)) / (n + least(extra, 1)), 2) AS change_percentage FROM s""")

COUNTS = """, c AS (SELECT doc_id, max(page_num) FILTER (WHERE linestatus = 'F') AS old_count, max(page_num) AS new_count
    FROM sheets GROUP BY doc_id)"""
CHANGED = COUNTS + """, ch AS (SELECT DISTINCT doc_id, page_num FROM (SELECT doc_id, page_num FROM sheets WHERE status = 'Зам.'
    UNION ALL SELECT doc_id, page_num FROM gfx2 WHERE score > CAST(0.35 AS DOUBLE)
    UNION ALL SELECT doc_id, 1 FROM sheets WHERE linestatus = 'O') JOIN c USING (doc_id)
    WHERE page_num BETWEEN 1 AND coalesce(old_count, new_count))"""
SQL["a15_changed_pages"] = with_(["sheets", "gfx2"], CHANGED + " SELECT * FROM ch")
SQL["w13_page_ranges"] = with_(["sheets"], """, d AS (SELECT DISTINCT doc_id, page_num FROM sheets WHERE status <> ''),
  r AS (SELECT doc_id, page_num, page_num - row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS run FROM d),
  i AS (SELECT doc_id, min(page_num) AS a, max(page_num) AS b FROM r GROUP BY doc_id, run)
  SELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges,
    CAST(sum(b - a + 1) AS INT) AS n_ranges FROM i GROUP BY doc_id""")
SQL["a16_sheet_facts"] = with_(["sheets"], """, p AS (SELECT doc_id, page_num, bool_or(status = 'Нов.') AS nw, bool_or(status = 'Зам.') AS rp,
    max(CASE WHEN status <> '' THEN CAST(regexp_extract(change_token, '\\d+') AS INT) END) AS cn, (doc_id + page_num) % 12 AS sc
    FROM sheets GROUP BY doc_id, page_num), q AS (SELECT *, max(page_num) OVER (PARTITION BY doc_id) AS pages FROM p)
  SELECT doc_id, CAST(min_by(sc, page_num) FILTER (WHERE sc BETWEEN 1 AND pages + 2) AS INT) AS sheet_count,
    CAST(count(*) FILTER (WHERE nw) AS INT) AS new_pages, CAST(count(*) FILTER (WHERE rp AND NOT nw) AS INT) AS replaced_pages,
    CAST(max(cn) AS VARCHAR) AS change_number FROM q GROUP BY doc_id""")


def ranges(e):
    inner = (f"list_zip(list_filter({e}, lambda p: NOT list_contains({e}, p - 1)), list_filter({e}, lambda p: NOT list_contains({e}, p + 1)))")
    return (f"array_to_string(list_transform({inner}, lambda z: CASE WHEN z[1] = z[2] THEN CAST(z[1] AS VARCHAR) "
            f"ELSE z[1] || '-' || z[2] END), ', ')")


def phrase(e, one, many, v1, v2):
    return f"CASE WHEN len({e}) = 1 THEN '{one} ' || {ranges(e)} || ' {v1}' WHEN len({e}) > 1 THEN '{many} ' || {ranges(e)} || ' {v2}' END"


SQL["u02_action_text"] = with_(["sheets", "gfx2"], CHANGED + f""",
  m AS (SELECT doc_id, list_sort(coalesce(list(DISTINCT page_num) FILTER (WHERE status = 'Зам.' AND doc_id % 3 <> 0), []::INT[])) AS rep,
    list_sort(coalesce(list(DISTINCT page_num) FILTER (WHERE status = 'Нов.' AND page_num > 5), []::INT[])) AS intro FROM sheets GROUP BY doc_id),
  k AS (SELECT doc_id, list_sort(list(page_num)) AS changed FROM ch GROUP BY doc_id),
  a AS (SELECT doc_id, c.old_count, c.new_count, coalesce(new_count, old_count, 1) AS total, coalesce(changed, []::INT[]) AS changed,
    list_sort(list_distinct(list_concat(intro, CASE WHEN new_count > old_count THEN range(old_count + 1, new_count + 1) ELSE [] END))) AS intro,
    CASE WHEN old_count > new_count THEN range(new_count + 1, old_count + 1) ELSE [] END AS ann, rep,
    range(1, least(coalesce(old_count, new_count), coalesce(new_count, old_count)) + 1) AS common
    FROM c JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)),
  b AS (SELECT *, list_filter(rep, lambda x: NOT list_contains(intro, x)) AS rep2 FROM a),
  f AS (SELECT *, CASE WHEN len(intro) = 0 AND len(ann) = 0 AND len(rep2) = 0 THEN changed ELSE rep2 END AS fin FROM b)
  SELECT doc_id, old_count, new_count, CASE WHEN total <= 1 AND len(intro) = 0 AND len(ann) = 0 THEN 'Заменить'
    WHEN len(intro) = 0 AND len(ann) = 0 AND len(list_filter(common, lambda x: NOT list_contains(fin, x))) = 0 THEN 'Заменить'
    ELSE coalesce(nullif(concat_ws(', ', {phrase('fin', 'Лист', 'Листы', 'заменить', 'заменить')},
      {phrase('intro', 'лист', 'листы', 'вводится вновь', 'вводятся вновь')},
      {phrase('ann', 'лист', 'листы', 'аннулировать', 'аннулировать')}), ''), 'Заменить') END AS action FROM f""")


SQL["f08_f09_document_fields"] = with_(["meta1"], """, k AS (SELECT doc_id AS k, lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(doc_id % 97 AS VARCHAR), 2, '0') || '.01.02.' ||
    lpad(CAST(doc_id % 999 AS VARCHAR), 3, '0') AS n FROM meta1)
  SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN CASE WHEN k % 3 = 0 THEN 'АБВГ.' ELSE '' END || n || CASE WHEN k % 7 = 0 THEN ' СБ' ELSE '' END
      WHEN 1 THEN n || CASE WHEN k % 7 = 1 THEN ' Э4' ELSE '' END WHEN 2 THEN n || ' ПЭ4' END AS number,
    CAST(CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS INT) AS number_part, CAST(CASE k % 4 WHEN 0 THEN CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END WHEN 1 THEN 3 WHEN 2 THEN 1 END AS INT) AS number_tier,
    CASE WHEN k % 5 = 0 THEN (k % 50) + 0.5::DOUBLE WHEN k % 13 = 0 THEN 3.5::DOUBLE WHEN k % 6 = 0 AND k % 11 <> 0 THEN 12.25::DOUBLE END AS mass_kg,
    CASE WHEN k % 5 = 0 THEN '1:2' WHEN k % 3 = 1 THEN '1:4' WHEN k % 6 = 0 THEN '1:10' END AS scale FROM k""")

SQL["o02_stamp_titles"] = with_(["meta1"], """, k AS (SELECT doc_id AS k, CASE WHEN doc_id % 4 = 1 THEN 1 WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 3 = 2 AND doc_id % 2 = 1 THEN 3
    WHEN doc_id % 5 = 0 THEN 4 WHEN doc_id % 4 = 2 THEN 5 ELSE 6 END AS w FROM meta1)
  SELECT k AS doc_id, ['Кабель связи', 'Корпус прибора', 'Сборочный чертеж прибора', 'Стойка левая', 'Блок', 'Переходник'][w] AS title,
    CAST(CASE w WHEN 6 THEN 1 ELSE 0 END AS INT) AS part, CAST(CASE WHEN w IN (1, 6) THEN 3 WHEN w IN (2, 3) THEN 2 ELSE 1 END AS INT) AS tier FROM k""")
