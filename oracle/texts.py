"""DuckDB SQL for the queries on raw lines, numbered requirements and text functions."""

from oracle.base import any_of, cell, ck, hits, in_, low, lower_first, q, squeeze, strip, strip_period, with_
from revdiff import rules

SQL = {}
TOPICS = ((" the ", "the text"), (" les ", "les textes"), (" der ", "der Text"), (" los ", "los textos"))
WORD = "A-Za-zА-Яа-яЁё0-9_"

DIRTY = """(CASE number % 4 WHEN 0 THEN '  «' WHEN 1 THEN chr(9) || chr(13) || chr(10) ELSE '' END || text ||
  CASE number % 4 WHEN 2 THEN ' – x..' WHEN 3 THEN ' ;' ELSE chr(160) || ' ' END)"""
SQL["f02_text_normalisation"] = with_(["req1"], f""", d AS (SELECT doc_id, number, text, {DIRTY} AS t FROM req1)
  SELECT doc_id, number, {cell('t')} AS cell, {strip("regexp_replace(t, '[\\x00-\\x1F\\x7F]', '', 'g')")} AS plain,
    CASE WHEN regexp_matches({squeeze('t')}, '[.;:!?]$') OR {squeeze('t')} = '' THEN {squeeze('t')} ELSE {squeeze('t')} || '.' END AS sentence,
    {strip_period('t')} AS bare, {lower_first('text')} AS lower_first,
    {strip("replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS lines,
    CASE WHEN length({squeeze('t')}) <= 60 THEN {squeeze('t')} ELSE rtrim(left({squeeze('t')}, 57)) || '...' END AS short FROM d""")
C = [f"translate(text, '{a}', '{b}')" for a, b in (rules.LOOKALIKE_COMPARE, rules.LOOKALIKE_CONNECTOR, rules.LOOKALIKE_DIAGRAM)]
SQL["f03_lookalike_folding"] = with_(["req2"], f"SELECT doc_id, number, {C[0]} AS compare, {C[1]} AS connector, {C[2]} AS diagram FROM req2")
SQL["f04_compare_key"] = with_(["req2"], f"""SELECT doc_id, number, {ck("' – ' || text || ' -' || chr(160) || 'x'")} AS key FROM req2""")


def tokens(key):
    return f"list_distinct(regexp_extract_all({key}, '[а-яa-z0-9]{{4,}}'))"


SQL["f05_token_set"] = with_(["req1"], f"""SELECT doc_id, number, array_to_string(list_sort(list_filter({tokens(ck('text'))},
  lambda x: x <> 'that' AND x <> 'this')), '|') AS tokens FROM req1""")


def summary(e):
    clean = f"regexp_replace({squeeze(e)}, '\\.+$', '')"
    rules_sql = " ".join(f"WHEN contains(lower({clean}), {q(m)}) THEN {q(t)}" for m, t in TOPICS)
    return (f"CASE WHEN coalesce({e}, '') = '' THEN {q(rules.TOPIC_EMPTY)} {rules_sql} WHEN length({clean}) <= 90 AND NOT "
            f"{any_of(f'lower({clean})', rules.TOPIC_TEXT_STOPS)} THEN {clean} ELSE {q(rules.TOPIC_DEFAULT)} END")


def good(e):
    x = f"lower({squeeze(e)})"
    return (f"({x} <> '' AND NOT {any_of(x, ('...', '…'))} AND length({x}) <= 90 AND NOT "
            f"({' OR '.join(f'starts_with({x}, {q(p)})' for p in rules.TOPIC_BAD_STARTS)}) AND NOT {any_of(x, rules.TOPIC_BAD_PARTS)})")


def about(e):
    return f"CASE WHEN {e} = '' THEN '' WHEN contains('{rules.VOWELS}', lower(left({e}, 1))) THEN 'об ' || {e} ELSE 'о ' || {e} END"


TOPIC = f"CASE WHEN {good('s')} THEN {lower_first(strip_period('s'))} ELSE {q(rules.TOPIC_DEFAULT)} END"
SQL["f18_topics"] = with_(["req1"], f""", s AS (SELECT doc_id, number, text, {summary('text')} AS s FROM req1), t AS (SELECT *, {TOPIC} AS t FROM s)
  SELECT doc_id, number, s AS summary, {about('t')} AS topic, {good('text')} AS good FROM t""")

L = f"lower({cell('line')})"


def bools(markers):
    return " + ".join(f"max(contains({L}, {q(m)})::INT)" for m in markers)


SQL["p04_keyword_class"] = with_(["raw"], f""", c AS (SELECT doc_id, CAST({bools(('the', 'of', 'les', 'des', 'der', 'und', 'los', 'el'))} AS INT) AS head_hits,
  CAST({bools(('section 1', 'section 9'))} AS INT) AS section_hits FROM raw GROUP BY doc_id)
  SELECT *, head_hits >= 5 AND section_hits >= 1 AS matches FROM c""")

VARIANTS = ("Дата", "Таблица 3 x", "Формат Зона Поз. обозн", "12 Зам. x", "А4 док", "Материалы", "XP1", "R1,", "ао x")
VLINE = "CASE (doc_id + ord) % 13 " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(VARIANTS)) + " ELSE line END"
HEAD = f"({hits('l', rules.BOM_HEADER_WORDS)} >= 3)"
SQL["p06_line_kinds"] = with_(["raw"], f""", v AS (SELECT doc_id, ord, {cell('line')} AS t, lower({cell('line')}) AS l FROM (SELECT doc_id, ord, {VLINE} AS line FROM raw))
  SELECT doc_id, ord, l = '' OR {in_('l', rules.SERVICE_LINES_EXACT)} OR regexp_full_match(l, 'обозначение|код|маркировка|xp\\d|xs\\d|хр\\d|хs\\d')
      OR regexp_matches(l, '^(таблица\\s*\\d+|продолжение таблицы)') AS requirement_service, {HEAD} AS bom_header,
    l = '' OR {HEAD} OR {in_('l', rules.BOM_SERVICE_EXACT)} OR regexp_matches(l, '^\\d+\\s+зам\\.') OR starts_with(l, 'ао ')
      OR (contains(l, 'изм.') AND contains(l, 'докум')) OR {any_of('l', rules.BOM_SERVICE_CONTAINS)} AS bom_service,
    CASE WHEN {in_('l', rules.BOM_SECTIONS)} THEN upper(left(l, 1)) || substr(l, 2) END AS section,
    (regexp_matches(t, '^\\d+\\s+\\S+') AND NOT regexp_matches(t, '(?i)^\\d+\\s+зам\\.')) OR regexp_matches(t, '(?i)^[AА]\\d\\s+\\S+') AS item_start,
    l = '' OR (contains(l, 'изм.') AND contains(l, 'докум')) OR regexp_matches(l, '^\\d+\\s+зам\\.') OR (contains(l, 'лит.') AND contains(l, 'лист'))
      OR {any_of('l', rules.ELEMENT_SERVICE_CONTAINS)} AS element_service,
    regexp_full_match(t, '[A-ZА-Я0-9][A-ZА-Я0-9.\\-]*(, *)?') AND NOT (contains(t, ' ') AND NOT contains(t, ',')) AS element_position FROM v""")

QT = "(\\d+(?:[.,]\\d+)?(?:\\s*[мМ]|(?:\\s*шт)?|(?:\\s*кг)?))\\s*([A-ZА-Я0-9,.\\- ]+)?$"
SQL["w08_items_from_lines"] = with_(["raw"], f""", a AS (SELECT doc_id, ord, page_num, {cell('line')} AS piece,
    CASE WHEN regexp_matches(line, '^Section \\d+$') THEN line END AS sec FROM raw),
  b AS (SELECT *, sec IS NULL AND ((regexp_matches(piece, '^\\d+\\s+\\S+') AND NOT regexp_matches(piece, '(?i)^\\d+\\s+зам\\.')) OR regexp_matches(piece, '(?i)^[AА]\\d\\s+\\S+')) AS start,
    lag(page_num) OVER w AS pp FROM a WHERE piece <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
  c AS (SELECT *, sum((start OR sec IS NOT NULL OR page_num <> coalesce(pp, page_num))::INT) OVER w AS run, last_value(sec IGNORE NULLS) OVER w AS section
    FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT doc_id, run, min_by(section, ord) AS section, min(page_num) AS page_num, list(piece ORDER BY ord) AS block FROM c WHERE sec IS NULL
    GROUP BY doc_id, run HAVING bool_or(start)),
  p AS (SELECT *, regexp_extract(block[1], '^(\\d+)\\s+(.+)$', 1) AS position, list_prepend(regexp_extract(block[1], '^(\\d+)\\s+(.+)$', 2), block[2:]) AS rest
    FROM g WHERE regexp_matches(block[1], '^(\\d+)\\s+(.+)$')),
  r AS (SELECT *, nullif(regexp_extract(rest[-1], '{QT}', 1), '') AS quantity, nullif(trim(regexp_extract(rest[-1], '{QT}', 2)), '') AS note,
    list_filter(list_append(rest[:-2], trim(regexp_replace(rest[-1], '{QT}', ''))), lambda x: x <> '') AS rr FROM p),
  n AS (SELECT *, nullif(array_to_string(list_filter(rr, lambda x: NOT regexp_matches(lower(x), 'ту |(^|[^{WORD}])ту($|[^{WORD}])')), ' '), '') AS name,
    nullif(array_to_string(list_filter(rr, lambda x: regexp_matches(lower(x), 'ту |(^|[^{WORD}])ту($|[^{WORD}])')), ' '), '') AS designation FROM r),
  k AS (SELECT *, trim(concat(lower(coalesce(section, '')), '|', position), '|') AS key FROM n),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY length(coalesce(name, '') || ' ' || coalesce(designation, '')) DESC, run) AS rn FROM k)
  SELECT doc_id, key, section, page_num, position, designation, name, quantity, note FROM o WHERE rn = 1""")

SERVICE = (f"(l = '' OR {in_('l', rules.SERVICE_LINES_EXACT)} OR regexp_full_match(l, 'обозначение|код|маркировка|xp\\d|xs\\d|хр\\d|хs\\d') "
           "OR regexp_matches(l, '^(таблица\\s*\\d+|продолжение таблицы)'))")
KEEP = "length(text) >= 6 AND NOT regexp_full_match(text, '[\\d\\x{00}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+')"
SQL["w09_requirement_stitching"] = with_(["raw"], f""", a AS (SELECT doc_id, ord, {cell('line')} AS t, lower({cell('line')}) AS l FROM raw),
  b AS (SELECT *, regexp_matches(t, '^\\d{{1,2}}[.)]?\\s+.') AS st FROM a WHERE NOT {SERVICE}),
  c AS (SELECT *, sum(st::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS item FROM b),
  d AS (SELECT doc_id, item, max(CASE WHEN st THEN CAST(regexp_extract(t, '^(\\d{{1,2}})', 1) AS INT) END) AS number,
    string_agg(CASE WHEN st THEN regexp_extract(t, '^\\d{{1,2}}[.)]?\\s+(.+)$', 1) ELSE t END, ' ' ORDER BY ord) AS text FROM c WHERE item > 0 GROUP BY doc_id, item)
  SELECT doc_id, number, max_by(text, item) AS text FROM d WHERE {KEEP} GROUP BY doc_id, number""")
SQL["w10_split_requirement_stitching"] = with_(["rawsplit"], f""", a AS (SELECT doc_id, ord, {cell('line')} AS t, lower({cell('line')}) AS l FROM rawsplit),
  b AS (SELECT *, regexp_full_match(t, '\\d{{1,2}}') AS nm FROM a WHERE NOT {SERVICE}),
  c AS (SELECT *, sum(nm::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)
    + CASE WHEN NOT nm AND lead(nm) OVER (PARTITION BY doc_id ORDER BY ord) THEN 1 ELSE 0 END AS item FROM b),
  d AS (SELECT doc_id, item, max(CASE WHEN nm THEN CAST(t AS INT) END) AS number,
    regexp_replace(coalesce(string_agg(CASE WHEN NOT nm THEN t END, chr(10) ORDER BY ord), ''), '([{WORD}])-\\n([{WORD}])', '\\1\\2', 'g') AS text FROM c WHERE item > 0 GROUP BY doc_id, item)
  SELECT doc_id, number, max_by(text, item) AS text FROM d WHERE number IS NOT NULL AND {KEEP} GROUP BY doc_id, number""")

SQL["w11_element_accumulation"] = with_(["bom1"], """, a AS (SELECT doc_id, ord, page_num, name, CASE WHEN ord % 3 <> 2 THEN 'E' || position END AS p,
    CASE WHEN ord % 3 = 0 THEN quantity END AS q FROM bom1),
  b AS (SELECT *, coalesce(sum((q IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM a),
  g AS (SELECT doc_id, run, coalesce(string_agg(p, ', ' ORDER BY ord), '') AS positions, string_agg(name, ' ' ORDER BY ord) AS name, max(q) AS quantity, min(page_num) AS page_num
    FROM b GROUP BY doc_id, run),
  k AS (SELECT *, replace(lower(positions), ' ', '') AS key, row_number() OVER (PARTITION BY doc_id, replace(lower(positions), ' ', '')
    ORDER BY length(name) + coalesce(length(quantity), 0) DESC, run) AS rn FROM g WHERE positions <> '')
  SELECT doc_id, key, positions, name, quantity, page_num FROM k WHERE rn = 1""")

SQL["w14_parse_notes"] = with_(["raw"], """, a AS (SELECT doc_id, ord, CASE WHEN (doc_id + ord) % 25 = 24 THEN 'Журнал № 1, запись № 2.' WHEN (doc_id + ord) % 9 = 0 THEN ' Примечания: '
    WHEN (doc_id + ord) % 3 = 0 THEN ' - ' || line ELSE line END AS t FROM raw),
  b AS (SELECT *, starts_with(t, 'Журнал №') AS j, regexp_matches(t, '^\\s*\\d+\\s*[.)]?\\s+\\S') AS nb FROM a WHERE t <> ' Примечания: '),
  c AS (SELECT *, sum(j::INT) OVER w AS ended, sum((nb OR NOT starts_with(ltrim(t), '-'))::INT) OVER w AS note_no FROM b
    WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING))
  SELECT doc_id, CAST(note_no AS INT) AS note_no, string_agg(CASE WHEN nb THEN rtrim(regexp_replace(t, '^\\s*\\d+\\s*[.)]?\\s+', '')) ELSE trim(t) END, chr(10) ORDER BY ord) AS note
  FROM c WHERE ended = 0 GROUP BY doc_id, note_no""")

SQL["a17_best_set"] = with_(["raw"], """, n AS (SELECT DISTINCT doc_id, page_num AS candidate, CAST(nullif(regexp_extract(line, '^\\s*(\\d{1,2})[.)]?\\s+(.+)$', 1), '') AS INT) AS number FROM raw),
  l AS (SELECT *, lag(number) OVER (PARTITION BY doc_id, candidate ORDER BY number) AS p FROM n WHERE number IS NOT NULL),
  s AS (SELECT doc_id, candidate, max(number) AS largest, count(*) AS size, count(*) FILTER (WHERE number = p + 1) AS steps FROM l GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY largest DESC, size DESC, steps DESC, candidate) AS rn FROM s)
  SELECT doc_id, candidate, largest, size, steps FROM r WHERE rn = 1""")

LET = "length(regexp_replace(t, '[^А-Яа-яA-Za-z]', '', 'g'))"
NO = "NOT (contains(lower(t), 'anin') OR contains(lower(t), 'лист'))"
SQL["o02_best_title"] = with_(["raw"], f""", a AS (SELECT doc_id, ord, CASE WHEN doc_id % 4 = 0 THEN 'Изм Дата ' || line ELSE line END AS line
    FROM raw),
  b AS (SELECT *, {cell('line')} AS t, {cell("regexp_extract(line, '(?i)(?:^|[^" + WORD + "])Дата\\s+(.+)$', 1)")} AS tail FROM a),
  c AS (SELECT *, CASE WHEN regexp_matches(lower(t), '^(the|les|section)($|[^{WORD}])') AND length(t) <= 40 AND {NO} THEN 3
      WHEN length(regexp_replace(tail, '[^А-Яа-яA-Za-z]', '', 'g')) >= 3 AND NOT {any_of('lower(tail)', rules.TITLE_TAIL_BANNED)} THEN 2
      WHEN length(t) BETWEEN 3 AND 50 AND NOT contains(t, ',') AND {LET} >= 3 AND NOT regexp_full_match(t, '[A-ZА-Я0-9.\\- ]+') AND {NO} THEN 1 END AS tier FROM b),
  d AS (SELECT *, CASE tier WHEN 3 THEN 200 + {LET} WHEN 2 THEN 100 ELSE length(regexp_replace(t, '[^А-Яа-я]', '', 'g')) * 3
      + greatest(0, 15 - abs(len(string_split(t, ' ')) - 2) * 4) + CASE WHEN len(string_split(t, ' ')) <= 4 THEN 10 ELSE 0 END END AS score FROM c),
  e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier DESC NULLS LAST, score DESC, ord) AS rn FROM d)
  SELECT doc_id, CASE tier WHEN 2 THEN tail WHEN 1 THEN t WHEN 3 THEN t END AS title, tier FROM e WHERE rn = 1""")

SQL["u04_merge_sets"] = with_(["req1", "req2"], """SELECT doc_id, number, max(v) AS v, arg_max(text, (v, text)) AS text FROM (
  SELECT *, 1 AS v FROM req1 UNION ALL SELECT *, 2 FROM req2) GROUP BY doc_id, number""")
SQL["a14_ordered_distinct"] = with_(["req2"], f"""SELECT doc_id, min_by(t, o) AS text, CAST(min(o) AS INT) AS ord FROM (SELECT doc_id, number * 2 AS o, text AS t FROM req2)
  WHERE {squeeze('t')} <> '' GROUP BY doc_id, lower({squeeze('t')})""")

LEFT = f""", c1 AS (SELECT *, {ck('text')} AS k, row_number() OVER (PARTITION BY KEYS, {ck('text')} ORDER BY number, text) AS n FROM SRC1),
  c2 AS (SELECT *, {ck('text')} AS k, row_number() OVER (PARTITION BY KEYS, {ck('text')} ORDER BY number, text) AS n FROM SRC2),
  n1 AS (SELECT KEYS, k, count(*) AS m FROM c1 GROUP BY ALL), n2 AS (SELECT KEYS, k, count(*) AS m FROM c2 GROUP BY ALL),
  l1 AS (SELECT c1.* FROM c1 LEFT JOIN n2 USING (KEYS, k) WHERE c1.n > coalesce(n2.m, 0)),
  l2 AS (SELECT c2.* FROM c2 LEFT JOIN n1 USING (KEYS, k) WHERE c2.n > coalesce(n1.m, 0))"""


def left(keys, a, b):
    return LEFT.replace("KEYS", keys).replace("SRC1", a).replace("SRC2", b)


ORDS = """, o1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number, text) AS ord FROM req1),
  o2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number, text) AS ord FROM req2)"""
SQL["j06_exact_text_match"] = with_(["req1", "req2"], left("doc_id", "req1", "req2") + """ SELECT doc_id, 'old' AS side, number, text FROM l1
  UNION ALL SELECT doc_id, 'new', number, text FROM l2""")
PAIRS = ORDS + left("doc_id", "o1", "o2") + f""",
  t1 AS (SELECT *, {tokens('k')} AS t FROM l1), t2 AS (SELECT *, {tokens('k')} AS t FROM l2),
  j AS (SELECT a.doc_id, a.ord AS l_ord, b.ord AS r_ord, a.number AS l, b.number AS r, len(list_intersect(a.t, b.t)) AS s, len(a.t) AS x, len(b.t) AS y, a.k = '' OR b.k = '' AS e
    FROM t1 a JOIN t2 b ON a.doc_id = b.doc_id),
  g AS (SELECT *, CASE WHEN e OR least(x, y) = 0 THEN 0.0::DOUBLE ELSE greatest(CAST(s AS DOUBLE) / greatest(x + y - s, 1),
    CAST(s AS DOUBLE) / greatest(least(x, y), 1) * CAST(0.85 AS DOUBLE)) END AS score, abs(l - r) <= 1 AS close FROM j),
  p AS (SELECT doc_id, l_ord, r_ord, l AS l_number, r AS r_number, CAST(s AS INT) AS shared, score,
    score + CASE WHEN l = r THEN CAST(0.03 AS DOUBLE) WHEN close THEN CAST(0.01 AS DOUBLE) ELSE 0 END AS rank
  FROM g WHERE score >= CAST(0.62 AS DOUBLE) OR (close AND score >= CAST(0.42 AS DOUBLE) AND s >= 2) OR (score >= 0.5 AND s >= 3))"""
SQL["j07_fuzzy_pairs_tokens"] = with_(["req1", "req2"], PAIRS + " SELECT doc_id, l_number, r_number, shared, score, rank FROM p")
# the greedy choice as a fold: a pair joins the chosen ones if neither of its ends is among them
DIFF = PAIRS + """,
  q AS (SELECT doc_id, list_reduce(list({'ls': [l_ord], 'rs': [r_ord]} ORDER BY rank DESC, l_ord, r_ord), lambda a, b: CASE WHEN list_contains(a.ls, b.ls[1]) OR list_contains(a.rs, b.rs[1])
      THEN a ELSE {'ls': list_concat(a.ls, b.ls), 'rs': list_concat(a.rs, b.rs)} END) AS c FROM p GROUP BY doc_id),
  m AS (SELECT doc_id, unnest(c.ls) AS l_ord, unnest(c.rs) AS r_ord FROM q),
  d AS (SELECT doc_id, l2.number, 'modified' AS status, l1.number AS v1_number, l2.number AS v2_number, l1.text AS v1_text, l2.text AS v2_text
      FROM m JOIN l1 USING (doc_id) JOIN l2 USING (doc_id) WHERE l1.ord = m.l_ord AND l2.ord = m.r_ord
    UNION ALL SELECT doc_id, number, 'removed', number, NULL, text, NULL FROM l1 WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = l1.doc_id AND m.l_ord = l1.ord)
    UNION ALL SELECT doc_id, number, 'added', NULL, number, NULL, text FROM l2 WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = l2.doc_id AND m.r_ord = l2.ord))"""
SQL["j08_requirement_diff_tokens"] = with_(["req1", "req2"], DIFF + " SELECT * FROM d")
SQL["o03_diff_order"] = with_(["req1", "req2"], DIFF + " SELECT doc_id, number, status, v1_number, v2_number FROM d")

SF = f""", sf AS (SELECT doc_id, number, text, CASE number % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS status, {summary('text')} AS s FROM req1)"""
PHR = f"""CASE status WHEN 'added' THEN 'введен пункт ' ELSE CASE status WHEN 'removed' THEN 'аннулирован пункт ' ELSE 'изменен пункт ' || number || ' ' END END || {about('topic')}"""
SQL["j16_supplied_topics"] = with_(["req1"], SF + f""", d AS (SELECT *, CASE WHEN {good('s')} THEN {lower_first(strip_period('s'))}
      ELSE CASE WHEN {good(summary('s'))} THEN {lower_first(strip_period(summary('s')))} ELSE {q(rules.TOPIC_DEFAULT)} END END AS derived FROM sf),
  w AS (SELECT *, list_filter(regexp_extract_all({low('derived')}, '[а-яa-z0-9]{{5,}}'), lambda x: NOT {in_('x', rules.TOPIC_TOKEN_STOPS)}) AS own FROM d),
  m AS (SELECT *, len(list_distinct(own)) AS n, len(list_filter(list_distinct(own), lambda a: a = 'textes' OR a = 'пробном' OR (length(a) >= 6 AND (left(a, 6) = 'textes' OR left(a, 6) = 'пробно')))) AS hit FROM w),
  t AS (SELECT *, CASE WHEN number % 4 = 0 AND (derived IN ('{rules.TOPIC_DEFAULT}', '{rules.TOPIC_EMPTY}') OR (NOT {any_of(low('derived'), rules.TOPIC_ANCHORS)}
      AND (n = 0 OR (n <= 2 AND hit >= 1) OR (n > 2 AND (hit >= 2 OR hit / n >= 0.5))))) THEN 'пробном textes' ELSE derived END AS topic FROM m)
  SELECT doc_id, number, status, topic, {PHR} AS phrase FROM t""")

PLAIN = "trim(regexp_replace(translate(replace(lower(X), 'ё', 'е'), ';.\"«»', ''), '\\s+', ' ', 'g'))"
SQL["j17_note_coverage"] = with_(["req1"], f""", p AS (SELECT doc_id, number, CASE number % 3 WHEN 0 THEN 'введен пункт о строке ' || (number % 5) WHEN 1 THEN 'аннулирован пункт о строке ' || (number % 5)
      ELSE 'изменен пункт ' || number || ' о строке ' || (number % 5) END AS phrase, CASE WHEN doc_id % 8 = 0 AND number = 3 THEN 'graphics' ELSE ['added','removed','modified'][number % 3 + 1] END AS k FROM req1),
  n AS (SELECT doc_id, CASE WHEN number = 1 AND doc_id % 7 = 0 THEN 'Изменена графика' WHEN number = 1 AND doc_id % 9 = 0 THEN 'Масса 5' WHEN number = 2 AND doc_id % 6 = 0 THEN 'аннулирован'
      WHEN number = 3 AND doc_id % 31 = 0 THEN 'Бирки термоусадить' WHEN number = 4 AND doc_id % 13 = 0 THEN 'введено требование' WHEN number = 2 AND doc_id % 17 = 0 THEN 'и так далее…'
      WHEN (doc_id + number) % 23 = 0 THEN 'п. ' || number || ' стал другим' WHEN (doc_id * number) % 29 = 5 THEN 'изменен пункт о строке'
      ELSE '- ' || upper(left(phrase, 1)) || substr(phrase, 2) || ' (п. ' || number || ');' END AS note FROM p),
  t AS (SELECT doc_id, lower(note) AS low, {PLAIN.replace('X', 'note')} AS plain FROM n),
  nn AS (SELECT doc_id, bool_or({any_of('low', rules.GRAPHICS_WORDS)}) AS g, bool_or(contains(low, 'масса')) AS m, bool_or({any_of('low', ('тт', 'тех', 'пункт', 'п.'))}) AS i,
      bool_or({any_of('low', rules.RAW_REQUIREMENT_MARKERS)} AND NOT ({' OR '.join(f'starts_with(trim(low), {q(x)})' for x in rules.REQUIREMENT_NOTE_STARTS)})) AS raw,
      bool_or({any_of('low', rules.BAD_REQUIREMENT_FRAGMENTS)}) AS cut, bool_or(contains(low, 'введено требование')) AS weak, bool_or(contains(low, 'аннулирован')) AS r, bool_or(contains(low, 'п')) AS p FROM t GROUP BY doc_id),
  ff AS (SELECT doc_id, bool_or(k = 'graphics') AS g, bool_or(k <> 'graphics') AS i, bool_or(k = 'removed') AS r, bool_or(k = 'added') AS a FROM p GROUP BY doc_id),
  mm AS (SELECT doc_id, string_agg(number, ', ' ORDER BY number) AS missing FROM p WHERE k <> 'graphics'
      AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = p.doc_id AND regexp_matches(t.low, '(пункт\\s+|п\\.\\s*)' || p.number || '([^0-9]|$)')) GROUP BY doc_id),
  ll AS (SELECT doc_id, string_agg(phrase, '; ' ORDER BY number, phrase) AS lines FROM (SELECT doc_id, phrase, min(number) AS number FROM p WHERE k <> 'graphics'
      AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = p.doc_id AND contains(t.plain, p.phrase)) GROUP BY ALL) GROUP BY doc_id)
  SELECT doc_id, CASE WHEN nn.g AND NOT ff.g THEN 'graphics without a fact' WHEN m THEN 'mass without a fact' WHEN ff.g AND NOT nn.g THEN 'graphics not mentioned'
    WHEN ff.i AND NOT nn.i THEN 'requirements not mentioned' WHEN ff.i AND raw THEN 'raw requirement text' WHEN ff.i AND cut THEN 'cut wording' WHEN missing IS NOT NULL THEN 'missing items: ' || missing
    WHEN lines IS NOT NULL THEN 'other wording: ' || lines WHEN weak AND ff.a THEN 'weak wording' WHEN weak THEN 'requirement without a fact'
    WHEN nn.r AND nn.p AND NOT ff.r THEN 'removal without a fact' END AS reason
  FROM nn JOIN ff USING (doc_id) LEFT JOIN mm USING (doc_id) LEFT JOIN ll USING (doc_id)""")
SQL["w07_items_from_rows"] = with_(["bom1"], """, a AS (SELECT *, CASE WHEN ord % 7 = 0 THEN upper(left(section, 1)) || lower(substr(section, 2)) END AS sec, ord % 11 = 0 AS svc,
    CASE WHEN ord % 3 = 1 THEN CAST(position AS VARCHAR) END AS pos FROM bom1),
  b AS (SELECT *, sec IS NOT NULL OR svc AS close, lag(sec IS NOT NULL OR svc) OVER w AS ac, last_value(sec IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS cs
    FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
  c AS (SELECT *, sum((close OR pos IS NOT NULL OR coalesce(ac, true))::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM b),
  g AS (SELECT doc_id, run, min_by(cs, ord) AS section, min_by(pos, ord) AS position, min_by(page_num, ord) AS page_num, """ + ", ".join(
    f"list_reduce(list_prepend('', list({f} ORDER BY ord)), lambda a, b: CASE WHEN a = '' THEN b WHEN b = '' OR contains(a, b) THEN a ELSE a || ' ' || b END) AS {f}"
    for f in ("designation", "name", "quantity", "note")) + """ FROM (SELECT * EXCLUDE (section, position) FROM c WHERE NOT close) GROUP BY doc_id, run),
  k AS (SELECT *, ltrim(coalesce(lower(section), '') || '|' || coalesce(position, designation), '|') AS key FROM g)
  SELECT doc_id, key, min_by(section, run) AS section, min_by(position, run) AS position, min_by(page_num, run) AS page_num, """ + ", ".join(
    f"list_reduce(list_prepend('', list({f} ORDER BY run)), lambda a, b: CASE WHEN a = '' THEN b WHEN b = '' OR contains(a, b) THEN a ELSE a || ' ' || b END) AS {f}"
    for f in ("designation", "name", "quantity", "note")) + " FROM k GROUP BY doc_id, key")


def folded(order, columns=("designation", "name", "quantity", "note")):
    return ", ".join(f"list_reduce(list_prepend('', list(coalesce({f}, '') ORDER BY {order})), lambda a, b: CASE WHEN a = '' THEN b WHEN b = '' OR contains(a, b) THEN a ELSE a || ' ' || b END) AS {f}"
                     for f in columns)


ITEMS = with_(["bom1"], """, b AS (SELECT *, doc_id + ord AS k, doc_id * 8 + ord % 3 AS table_id, 10 + 4 * ord AS place FROM bom1),
  t AS (SELECT DISTINCT doc_id, table_id, CAST(1 + table_id % 2 AS INT) AS page_num, (table_id % 3) * 10.0 AS x0, (table_id % 5) * 20.0 AS y0 FROM b),
  spec AS (SELECT t.* FROM t WHERE table_id % 13 <> 0 OR table_id % 11 = 0 OR EXISTS (SELECT 1 FROM b WHERE b.table_id = t.table_id AND k % 5 = 0)),
  e AS (SELECT doc_id, table_id, place AS row_index, 'item' AS kind, NULL AS sec, CASE WHEN table_id % 4 <> 1 AND k % 4 = 0 THEN 'А4' ELSE '' END AS format,
      CASE WHEN k % 3 <> 1 THEN CAST(position AS VARCHAR) ELSE '' END AS position, designation, name, quantity, note FROM b
    UNION ALL SELECT doc_id, table_id, place - 1, 'section', CASE WHEN k % 2 = 0 THEN 'Прочие Изделия' ELSE 'Документация' END, '', '', '', '', '', '' FROM b WHERE k % 5 = 0
    UNION ALL SELECT doc_id, table_id, place + 1, 'service', NULL, '', '', '', '', '', '' FROM b WHERE k % 7 = 0
    UNION ALL SELECT doc_id, table_id, 4, CASE WHEN table_id % 11 = 0 THEN 'plain' WHEN table_id % 13 = 0 THEN 'word' ELSE 'section' END, CASE WHEN table_id % 11 <> 0 AND table_id % 13 <> 0 THEN 'Материалы' END,
      CASE WHEN table_id % 4 <> 1 AND (table_id % 11 = 0 OR table_id % 13 = 0) THEN CASE WHEN table_id % 11 = 0 THEN 'Материала' ELSE 'нет' END ELSE '' END,
      CASE WHEN table_id % 4 <> 1 AND table_id % 11 = 0 THEN 'x' ELSE '' END,
      CASE WHEN table_id % 4 = 1 AND table_id % 11 = 0 THEN 'нет' ELSE '' END,
      CASE WHEN table_id % 4 = 1 AND table_id % 11 = 0 THEN 'Материала' WHEN table_id % 4 = 1 AND table_id % 13 = 0 THEN 'нет' ELSE '' END,
      CASE WHEN table_id % 4 = 1 AND table_id % 11 = 0 THEN 'x' ELSE '' END, '' FROM t),
  r AS (SELECT e.*, s.page_num, row_number() OVER (PARTITION BY e.doc_id ORDER BY s.page_num, y0, x0, e.table_id, row_index) AS n FROM e JOIN spec s USING (doc_id, table_id)),
  m AS (SELECT *, kind IN ('section', 'service') AS close, last_value(sec IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section,
    lag(kind IN ('section', 'service')) OVER w AS pc, lag(table_id) OVER w AS pt FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
  o AS (SELECT *, CASE WHEN lower(coalesce(section, '')) = 'документация' THEN format || designation || name <> '' ELSE position <> '' END OR close OR coalesce(pc OR pt <> table_id, true) AS opens FROM m),
  u AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM o),
  g AS (SELECT doc_id, run, min_by(page_num, n) AS page_num, arg_min_null(section, n) AS section, nullif(arg_min(position, n), '') AS position,
      min_by(format, n) FILTER (WHERE format <> '') AS format, """ + folded("n") + """ FROM u WHERE NOT close GROUP BY doc_id, run),
  k AS (SELECT *, trim(coalesce(lower(section), '') || '|' || coalesce(CASE WHEN lower(section) = 'документация' THEN NULL ELSE position END, nullif(designation, ''), lower(name), ''), '|') AS key FROM g)
  SELECT doc_id, key, arg_min_null(section, run) AS section, min_by(page_num, run) AS page_num, arg_min_null(format, run) AS format, arg_min_null(position, run) AS position, """
                                     + folded("run") + " FROM k WHERE key <> '' GROUP BY doc_id, key")
SQL["w07_items_from_tables"] = f"""SELECT doc_id, key, section, page_num, format, position, nullif(designation, '') AS designation, nullif(name, '') AS name,
  nullif(quantity, '') AS quantity, nullif(note, '') AS note FROM ({ITEMS})"""


def parsed_blocks(name, keys):
    """Items of the blocks of bl: by lone numbers, else by lines that begin with one."""
    over = f"OVER (PARTITION BY {keys} ORDER BY ord"
    return f""", {name}a AS (SELECT *, {cell('line')} AS t, lower({cell('line')}) AS l FROM bl),
  {name}b AS (SELECT *, regexp_full_match(t, '\\d{{1,2}}') AS nm, regexp_matches(t, '^\\d{{1,2}}[.)]?\\s+.') AS st FROM {name}a WHERE NOT {SERVICE}),
  {name}c AS (SELECT *, sum(nm::INT) {over} ROWS UNBOUNDED PRECEDING) + CASE WHEN NOT nm AND lead(nm) {over}) THEN 1 ELSE 0 END AS i1, sum(st::INT) {over} ROWS UNBOUNDED PRECEDING) AS i2 FROM {name}b),
  {name}d AS (SELECT {keys}, i1 AS item, max(CASE WHEN nm THEN CAST(t AS INT) END) AS number,
    regexp_replace(coalesce(string_agg(CASE WHEN NOT nm THEN t END, chr(10) ORDER BY ord), ''), '([{WORD}])-\\n([{WORD}])', '\\1\\2', 'g') AS text FROM {name}c WHERE i1 > 0 GROUP BY {keys}, i1),
  {name}e AS (SELECT {keys}, i2 AS item, max(CASE WHEN st THEN CAST(regexp_extract(t, '^(\\d{{1,2}})', 1) AS INT) END) AS number,
    string_agg(CASE WHEN st THEN regexp_extract(t, '^\\d{{1,2}}[.)]?\\s+(.+)$', 1) ELSE t END, ' ' ORDER BY ord) AS text FROM {name}c WHERE i2 > 0 GROUP BY {keys}, i2),
  {name}s AS (SELECT {keys}, number, max_by(text, item) AS text FROM {name}d WHERE number IS NOT NULL AND {KEEP} GROUP BY {keys}, number),
  {name}i AS (SELECT {keys}, number, max_by(text, item) AS text FROM {name}e WHERE {KEEP} GROUP BY {keys}, number),
  {name} AS (SELECT * FROM {name}s UNION ALL SELECT {name}i.* FROM {name}i ANTI JOIN {name}s USING ({keys}))"""


SQL["a17_best_blocks"] = with_(["raw"], """, bl AS (SELECT doc_id, page_num, ord, block_no, (block_no * 37 % 3) * 50.0 AS x0, CASE WHEN block_no % 3 = 0 AND al <> '' THEN al
    WHEN doc_id % 3 = 0 AND page_num = 1 AND al <> '' THEN al || ' Экран' ELSE line END AS line FROM (SELECT *, CAST(ord // 4 AS INT) AS block_no, regexp_extract(line, '^(\\d{1,2}) ', 1) AS al FROM raw))"""
                               + parsed_blocks("p", "doc_id, page_num, block_no") + parsed_blocks("w", "doc_id, page_num") + """,
  ab AS (SELECT doc_id, page_num, block_no, min(number) AS lowest FROM p GROUP BY ALL HAVING count(*) > 1 OR sum(length(regexp_replace(text, '[^A-Za-zА-Яа-яЁё]', '', 'g'))) >= 30),
  pg AS (SELECT p.doc_id, p.page_num, 'blocks' AS route, number, max_by(text, (lowest, (p.block_no * 37 % 3) * 50.0, p.block_no)) AS text FROM p JOIN ab USING (doc_id, page_num, block_no) GROUP BY ALL
    UNION ALL SELECT doc_id, page_num, 'lines', number, text FROM w),
  sz AS (SELECT doc_id, page_num, count(*) FILTER (WHERE route = 'blocks') AS b, count(*) FILTER (WHERE route = 'lines') AS l, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS turn FROM pg GROUP BY doc_id, page_num),
  fold AS (SELECT DISTINCT doc_id, 0::BIGINT AS turn, 0::BIGINT AS size, NULL::INT AS page_num, '' AS route FROM sz UNION ALL
    SELECT f.doc_id, s.turn, CASE WHEN s.b > f.size THEN s.b WHEN s.l > f.size THEN s.l ELSE f.size END, CASE WHEN s.b > f.size OR s.l > f.size THEN s.page_num ELSE f.page_num END,
      CASE WHEN s.b > f.size THEN 'blocks' WHEN s.l > f.size THEN 'lines' ELSE f.route END FROM fold f JOIN sz s ON s.doc_id = f.doc_id AND s.turn = f.turn + 1),
  fin AS (SELECT doc_id, max_by(page_num, turn) AS page_num, max_by(route, turn) AS route FROM fold GROUP BY doc_id)
  SELECT pg.* FROM pg JOIN fin USING (doc_id, page_num, route)""").replace("WITH", "WITH RECURSIVE", 1)

PRESET_LINES = ("Перечень элементов", "Поз. обозначение", "Наименование Кол.", "Примечание", "Сборочный  чертеж", "Документация", "Прочие изделия", "Схема электрическая соединений", "лист Э4 1",
                "Маркировка", "код ПЭ4", "пэ4x", "кол")


def _says(m):
    return f"bool_or(contains(l, {q(m)}))"


def _code(c):
    return f"bool_or(regexp_matches(l, '(^|[^{WORD}]){c}($|[^{WORD}])'))"


SQL["p04_document_presets"] = with_(["raw"], f""", v AS (SELECT doc_id, lower({cell('line')}) AS l FROM (SELECT doc_id, CASE (doc_id * 5 + ord * doc_id % 7) % 29
      {" ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(PRESET_LINES))} ELSE line END AS line FROM raw)),
  f AS (SELECT doc_id, {" + ".join(_says(m) + "::INT" for m in ("поз", "обознач", "наимен", "кол", "примеч"))} AS header_hits, {_says("сборочный чертеж")} AS drawing, {_says("перечень элементов")} AS listed,
    {_says("документация")} AND {_says("прочие изделия")} AS bom, {_code("пэ4")} AS pe4, {_says("схема электрическая соединений")} OR ({_code("э4")} AND {_says("маркировк")} AND {_says("обознач")}) AS wiring FROM v GROUP BY doc_id)
  SELECT doc_id, header_hits, NOT (drawing AND NOT listed) AND NOT bom AND (listed OR pe4) AND header_hits >= 4 AS looks_like_elements, wiring AS looks_like_wiring FROM f""")
