"""DuckDB SQL for the queries on item lists."""

from oracle.base import any_of, cell, ck, compact, q, squeeze, strip, with_
from revdiff import rules

SQL = {}


def change(f, a="a", b="b"):
    old, new = f"CAST({a}.{f} AS VARCHAR)", f"CAST({b}.{f} AS VARCHAR)"
    return (f"CASE WHEN {ck(old)} <> {ck(new)} THEN '{f}:' || coalesce({old}, '') || '>' || coalesce({new}, '') END")


def diff_sql(attrs, fields, keys="doc_id, position", a="u1", b="u2", where="status <> 'unchanged'", probe="name"):
    ch = "concat_ws(';', " + ", ".join(change(f) for f in fields) + ")"
    ks = keys.split(", ")
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    kcols = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in ks)
    acols = "".join(f", coalesce(nullif(b.{c}, ''), a.{c}) AS {c}" for c in attrs)
    both = f"a.{ks[0]} IS NOT NULL AND b.{ks[0]} IS NOT NULL"
    return f"""SELECT * FROM (SELECT {kcols}{acols}, CASE WHEN b.{ks[0]} IS NULL THEN 'removed' WHEN a.{ks[0]} IS NULL THEN 'added'
      WHEN {ch} <> '' THEN 'modified' ELSE 'unchanged' END AS status, CASE WHEN {both} THEN {ch} ELSE '' END AS changes
      FROM {a} a FULL JOIN {b} b ON {on}) WHERE {where}"""


FIELDS = ["designation", "name", "quantity", "note"]

SQL["s01_version_pairs"] = with_(["part1", "part2"], """
  , snaps AS (SELECT * FROM (SELECT key % 50 AS doc_id, 1 AS version, key, name, size FROM part1 UNION ALL SELECT key % 50, 2, key, name, size FROM part2
      UNION ALL SELECT key % 50, 3, key, name, size FROM part2 WHERE key % 7 = 0) WHERE version <= 1 + doc_id % 3),
  v AS (SELECT doc_id, version, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS rn
        FROM (SELECT DISTINCT doc_id, version FROM snaps))
  SELECT doc_id, version, CASE rn WHEN 1 THEN 'new' ELSE 'old' END AS side, key, name, size
  FROM snaps JOIN v USING (doc_id, version) WHERE rn <= 2""")

SQL["p01_drop_unchanged"] = with_(["part1", "part2"], "SELECT key, status, changes FROM ("
                                  + diff_sql([], ["name", "size"], "key", "part1", "part2") + ")")
SQL["j01_keyed_diff"] = with_(["u1", "u2"], diff_sql(["section", "designation", "name"], FIELDS))
SQL["j02_element_diff"] = with_(["u1", "u2"], diff_sql(["name"], FIELDS, where="true"))
SQL["u01_key_union"] = with_(["bom1", "bom2"], "SELECT doc_id, position FROM bom1 UNION SELECT doc_id, position FROM bom2")


def merged(f):
    return (f"nullif(list_reduce(list_prepend('', list({f} ORDER BY ord)), lambda a, b: CASE WHEN a = '' THEN b "
            f"WHEN b = '' OR contains(a, b) THEN a ELSE a || ' ' || b END), '') AS {f}")


SQL["a01_merge_texts"] = with_(["bom1"], "SELECT doc_id, position, min_by(section, ord) AS section, "
                               + ", ".join(map(merged, FIELDS)) + " FROM bom1 GROUP BY doc_id, position")
SQL["a02_keep_richest"] = with_(["u2"], "SELECT * EXCLUDE (ord) FROM u2")


def item_name(e):
    e = strip(squeeze(f"coalesce({e}, '')"), "[ .;:\"''«»]")
    for _ in range(2):
        e = f"regexp_replace({e}, '([A-Za-zА-Яа-я0-9])-\\s+([A-Za-zА-Яа-я0-9])', '\\1-\\2', 'g')"
    for pat, val in (("\\s*/\\s*", "/"), ("\\s+\\)", ")"), ("\\(\\s+", "("), ("\\s+,", ",")):
        e = f"regexp_replace({e}, '{pat}', '{val}', 'g')"
    return e


def garbage(e):
    e = f"lower({squeeze(f'coalesce({e}, {chr(39)*2})')})"
    return (f"({e} <> '' AND ({any_of(e, rules.GARBAGE_MARKERS)} OR (regexp_matches({e}, "
            f"'(?:^|[^A-Za-zА-Яа-яЁё0-9_])нов\\.\\s*\\d') AND NOT {any_of(e, rules.GARBAGE_NEW_ROW_EXCEPTIONS)})))")


def bad_name(e):
    return f"({garbage(item_name(e))} OR length({item_name(e)}) < 2)"


def plausible(e):
    e = f"lower(trim(regexp_replace({squeeze(f'coalesce({e}, {chr(39)*2})')}, '([0-9])([а-яА-Яa-zA-Z]+)$', '\\1 \\2')))"
    return (f"(NOT {garbage(e)} AND NOT regexp_full_match({e}, '\\d{{2,}}\\.\\d{{2,}}(\\.\\d+)?') AND "
            f"regexp_full_match({e}, '\\d+([,.]\\d+)?\\s*(м|мм|шт\\.?|компл\\.?|к-т)?'))")


ODD = "coalesce(q2, q1) || CASE WHEN position % 5 = 0 THEN '-шт' ELSE ' шт.' END"
GLUED = f"replace(lower({item_name('name')}), ' ', '')"
FULL = diff_sql([], FIELDS)
SQL["p09_item_quality"] = with_(["u1", "u2"], f"""
  , d AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.position, b.position) AS position,
      coalesce(b.section, a.section) AS section, coalesce(b.name, a.name) AS name, a.quantity AS q1, b.quantity AS q2,
      CASE WHEN b.doc_id IS NULL THEN 'removed' WHEN a.doc_id IS NULL THEN 'added' ELSE 'modified' END AS status,
      unnest(CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN [{{'f': '', 'o': '', 'n': ''}}] ELSE list_filter([
        {", ".join(f"CASE WHEN {ck('a.' + f)} <> {ck('b.' + f)} THEN {{'f': {q(f)}, 'o': a.{f}, 'n': b.{f}}} END" for f in FIELDS)}
      ], lambda x: x IS NOT NULL) END) AS c
      FROM u1 a FULL JOIN u2 b ON a.doc_id = b.doc_id AND a.position = b.position)
  SELECT doc_id, position, status, c.f AS field, CASE WHEN status = 'modified' THEN
      CASE WHEN {bad_name('name')} THEN 'name' WHEN {garbage('section')} OR {garbage('c.o')} OR {garbage('c.n')} THEN 'garbage'
           WHEN c.f = 'quantity' THEN CASE WHEN NOT {plausible('c.n')} THEN 'quantity' END ELSE 'field' END
    ELSE CASE WHEN {bad_name('name')} THEN 'name' WHEN {garbage('section')} OR {garbage(ODD)} THEN 'garbage'
           WHEN starts_with({GLUED}, 'нов.') OR {any_of(GLUED, ('зам.', 'лбуд', 'доп'))} THEN 'service row'
           WHEN {ODD} <> '' AND NOT {plausible(ODD)} THEN 'quantity' END END AS reason
  FROM d""")

SQL["f14_keys"] = with_(["bom1"], f"""SELECT doc_id, ord, lower(trim(section)) || '|' || coalesce(
    CASE WHEN ord % 3 > 0 THEN CAST(position AS VARCHAR) END, CASE WHEN ord % 2 > 0 THEN designation END, lower(trim(name))) AS item_key,
  {compact("'E ' || position || ' , X1'")} AS element_key FROM bom1""")

K = "ord % 6"
DIRTY = f"""name || CASE {K} WHEN 0 THEN ' Лист 3' WHEN 1 THEN ' / - ( x )' WHEN 2 THEN ' ;;  .' WHEN 3 THEN ' Формат A4 x'
  WHEN 4 THEN ' Кабель КМ 5' ELSE ' ,a- 1' END"""
DES = f"(designation || CASE {K} WHEN 0 THEN '-' WHEN 1 THEN '.434 ТУ 12' ELSE '' END)"
BROKEN = f"CASE WHEN {K} = 0 THEN name || ' ТМАРК- 123-12345678-1234 x' ELSE name END"


def field_clean(e):
    from revdiff.functions.fields import FIELD_TAILS
    e = cell(e)
    for tail in FIELD_TAILS:
        e = f"regexp_replace({e}, {q('(?i)' + tail)}, '', 'g')"
    return f"nullif({strip(squeeze(e), '[ .;,:/-]')}, '')"


CODE = f"nullif(regexp_extract({item_name(DES)}, '([A-Za-zА-Яа-яЁё0-9.\\-/]+\\s*ТУ)', 1), '')"
SQL["f15_field_cleaning"] = with_(["bom1"], f"""SELECT doc_id, ord, {field_clean(DIRTY)} AS field, {item_name(DIRTY)} AS item_name,
  CASE WHEN {K} = 0 THEN {DES} || '123-12345678-1234' ELSE {DES} END AS designation,
  CASE WHEN {K} = 0 THEN name || ' ТМАРК' ELSE name END AS name,
  {item_name('name')} || ' ' || coalesce({CODE}, {item_name(DES)}) AS added_name FROM bom1""")

QTY = "(quantity || CASE ord % 3 WHEN 0 THEN 'м' WHEN 1 THEN ' шт' ELSE 'кг2м' END)"
SQL["f16_quantities"] = with_(["bom1"], f"""SELECT doc_id, ord,
  regexp_replace({QTY}, '([0-9])([A-Za-zА-Яа-я])', '\\1 \\2', 'g') AS spaced,
  regexp_replace({QTY}, '([0-9])([а-яА-Яa-zA-Z]+)$', '\\1 \\2') AS last_spaced,
  note || '|' || designation || '|' || quantity AS positions,
  replace(format('{{:g}}', CAST(quantity AS DOUBLE) / 8), '.', ',') AS number, try_cast(note AS INT) AS as_int FROM bom1""")

SQL["j04_connection_diff"] = with_(["u1", "u2"], """
  , c1 AS (SELECT *, CAST(quantity AS INT) % 5 AS lp, CAST(quantity AS INT) % 3 AS rp FROM u1),
  c2 AS (SELECT *, CAST(quantity AS INT) % 5 AS lp, CAST(quantity AS INT) % 3 AS rp FROM u2),
  j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, lpad(CAST(coalesce(a.position, b.position) AS VARCHAR), 3, '0') AS key,
      coalesce(b.position, a.position) AS p, a.doc_id IS NULL OR b.doc_id IS NULL OR a.name <> b.name OR a.lp <> b.lp OR a.rp <> b.rp
      OR (a.note = 'A') <> (b.note = 'A') OR (a.note = 'X') <> (b.note = 'X') AS changed
    FROM c1 a FULL JOIN c2 b ON a.doc_id = b.doc_id AND a.position = b.position)
  SELECT doc_id, bool_or(changed) AS has_changes, CASE WHEN bool_or(changed) THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS change_percentage,
    CAST(min_by(p, key) FILTER (WHERE changed) * 10 AS INT) AS x, CAST(min_by(p, key) FILTER (WHERE changed) * 7 AS INT) AS y
  FROM j GROUP BY doc_id""")
