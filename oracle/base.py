"""DuckDB SQL building blocks: the snapshots as CTEs and the text rules as expressions.

Independent of the Spark code on purpose: only the fixed rule values are shared.
"""

from revdiff import rules

WS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def q(s):
    return "'" + s.replace("'", "''") + "'"


def strip(e, chars=WS):
    return f"regexp_replace({e}, '^{chars}+|{chars}+$', '', 'g')"


def squeeze(e):
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


def typo(e):
    return f"""translate({e}, '\uFFF3\u2013\u2014\u00AB\u00BB\u00A0\u200B', '---"" ')"""


def cell(e):
    return squeeze(typo(f"coalesce({e}, '')"))


def norm_null(e):
    return f"nullif({squeeze(e)}, '')"


def fold(e, table=rules.LOOKALIKE_COMPARE):
    return f"translate({e}, '{table[0]}', '{table[1]}')"


def ck(e):
    inner = fold(f"translate({typo(f'coalesce({e}, {chr(39)*2})')}, '\u2212', '-')")
    return f"lower({squeeze(f'regexp_replace({inner}, {chr(39)}{WS}*-{WS}*{chr(39)}, {chr(39)}-{chr(39)}, {chr(39)}g{chr(39)})')})"


def compact(e):
    return f"regexp_replace(translate(lower(coalesce({e}, '')), 'ё', 'е'), '{WS}+', '', 'g')"


def low(e):
    return f"translate(lower(coalesce({e}, '')), 'ё', 'е')"


def any_of(e, markers):
    return "(" + " OR ".join(f"contains({e}, {q(m)})" for m in markers) + ")"


def hits(e, markers):
    return "(" + " + ".join(f"contains({e}, {q(m)})::INT" for m in markers) + ")"


def in_(e, values):
    return f"{e} IN (" + ", ".join(map(q, values)) + ")"


def strip_period(e):
    return strip(f"regexp_replace({strip(f'coalesce({e}, {chr(39)*2})')}, '\\.+$', '')")


def lower_first(e):
    return f"(lower(left({e}, 1)) || substr({e}, 2))"


ITEM_EDITS = """SELECT doc_id, section,
  CASE WHEN h % 31 = 0 THEN position + 100 ELSE position END AS position, designation, name,
  CASE WHEN h % 17 = 0 THEN CAST(CAST(quantity AS INT) + 1 AS VARCHAR) ELSE quantity END AS quantity,
  CASE WHEN h % 19 = 0 THEN 'X' ELSE note END AS note, page_num, ord
  FROM (SELECT *, doc_id * 7 + position AS h FROM bom1) WHERE h % 29 <> 0"""


def richest(src, keys="doc_id, position"):
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
      ORDER BY length(name || ' ' || designation) DESC, ord) AS rn FROM {src}) WHERE rn = 1"""


COLS = "['Код','Наименование','Длина, мм','Кол.','Маркировка / XP1']"


def rows_of(v):
    return f"""SELECT doc_id, doc_id AS table_id, table_name, page_num, row_index, cells FROM (
      SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Таблица ' || (1 + doc_id % 4) ELSE 'Table' END AS table_name,
        page_num, CAST(2 * ord + 1 AS INT) AS row_index,
        [designation, CASE WHEN ord % 3 = 2 THEN '' ELSE name END, section, quantity, note] AS cells FROM bom{v}
      UNION ALL
      SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Таблица ' || (1 + doc_id % 4) ELSE 'Table' END, page_num,
        unnest(CASE WHEN doc_id % 5 = 0 THEN [1, 4] ELSE [1] END), {COLS}
      FROM (SELECT doc_id, min(page_num) AS page_num FROM bom{v} GROUP BY doc_id))"""


SUFFIX = "CASE o_orderstatus WHEN 'F' THEN ' СБ' WHEN 'O' THEN ' Э4' ELSE ' ПЭ4' END"

CTES = {
    "bom1": ((), """SELECT l_orderkey AS doc_id, p_type AS section, l_linenumber AS position, p_brand AS designation,
      p_name AS name, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS quantity, l_returnflag AS note,
      CAST(1 + l_linenumber % 3 AS INT) AS page_num, CAST(ord AS INT) AS ord FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
          l_extendedprice, l_discount, l_tax, l_shipdate) AS ord FROM lineitem) JOIN part ON l_partkey = p_partkey"""),
    "bom2": (("bom1",), ITEM_EDITS),
    "u1": (("bom1",), richest("bom1")),
    "u2": (("bom2",), richest("bom2")),
    "part1": ((), "SELECT 1 AS doc_id, p_partkey AS key, p_name AS name, p_size AS size FROM part"),
    "part2": (("part1",), """SELECT doc_id, key, name, CASE WHEN key % 13 = 0 THEN size + 1 ELSE size END AS size FROM (
      SELECT doc_id, CASE WHEN key % 89 = 0 THEN key + 1000000 ELSE key END AS key, name, size FROM part1
      WHERE key % 97 <> 0)"""),
    "tbl1": (("bom1",), rows_of(1)),
    "tbl2": (("bom2",), rows_of(2)),
    "dlines": ((), """SELECT doc_id, CAST(pos AS INT) AS number, trim(line) AS text FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(line) <> ''"""),
    "req1": (("dlines",), "SELECT * FROM dlines"),
    "req2": (("dlines",), """SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN number + 1 ELSE number END AS INT) AS number,
      CASE WHEN doc_id % 7 = 0 THEN translate(t, 'AEKMHOPCTX', 'АЕКМНОРСТХ') ELSE t END AS text FROM (
        SELECT doc_id, number, CASE WHEN (doc_id * 3 + number) % 11 = 0 THEN text || ' revised' ELSE text END AS t
        FROM dlines WHERE (doc_id + number) % 23 <> 0)
      UNION ALL SELECT doc_id, 99, 'Added requirement ' || doc_id FROM documents WHERE doc_id % 5 = 0"""),
    "raw": (("dlines",), """SELECT doc_id, number AS ord, CAST(1 + number // 20 AS INT) AS page_num,
      CASE WHEN (doc_id + number) % 10 = 0 THEN 'Section ' || number
           WHEN (doc_id + number) % 4 = 0 THEN number || ' ' || text ELSE text END AS line FROM dlines"""),
    "rawsplit": (("dlines",), """SELECT doc_id, CAST(2 * number AS INT) AS ord, CASE WHEN (doc_id + number) % 10 = 0 THEN 'Дата' ELSE text END AS line FROM dlines
      UNION ALL
      SELECT doc_id, CAST(2 * number + 1 AS INT), CAST(number % 90 AS VARCHAR) FROM dlines
      WHERE (doc_id + number) % 10 <> 0 AND (doc_id + number) % 4 = 0"""),
    "words": ((), """SELECT doc_id, CAST(i AS INT) AS i, CAST(1 + i // 200 AS INT) AS page_num, CAST(line AS INT) AS line,
      x0, y0, x0 + 6 * least(length(text), 9) AS x1, y0 + 10 AS y1, text,
      CAST(line // 5 AS INT) AS block_no, CAST(line % 5 AS INT) AS line_no FROM (
        SELECT doc_id, i, text, (i % 200) // 10 AS line,
          CAST(((i % 200) % 10) * 60 + CASE WHEN i % 7 = 0 THEN 45 ELSE 0 END AS DOUBLE) AS x0,
          CAST(((i % 200) // 10) * 14 AS DOUBLE) + CAST(i % 3 AS DOUBLE) * 0.5 AS y0 FROM (
            SELECT doc_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS i FROM (
              SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)))"""),
    "lboxes": (("words",), """SELECT doc_id, page_num, line AS ord, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1,
      max(y1) AS y1 FROM words GROUP BY ALL"""),
    "boxes": (("lboxes",), """SELECT * FROM lboxes UNION ALL SELECT doc_id, page_num, ord + 100,
      x0 + (ord % 4) * 2.0, y0, x1 + (ord % 4) * 2.0, y1 FROM lboxes"""),
    "meta1": ((), f"""SELECT o_orderkey AS doc_id, o_custkey AS notice_id, o_orderkey || {SUFFIX} AS decimal_number,
      CAST(floor(o_totalprice / 100) AS DOUBLE) / CAST(10 AS DOUBLE) AS mass_kg, '1:' || (1 + o_orderkey % 5) AS scale,
      o_orderpriority AS title,
      CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS VARCHAR) END AS change_number,
      'Масса Масштаб ' || (o_orderkey % 50) || ',5 1:' || (1 + o_orderkey % 5) AS stamp_text FROM orders"""),
    "meta2": (("meta1",), """SELECT doc_id, notice_id, decimal_number,
      CASE WHEN doc_id % 10 = 0 THEN mass_kg + 1 ELSE mass_kg END AS mass_kg,
      CASE WHEN doc_id % 11 = 0 THEN '1:10' ELSE scale END AS scale,
      CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN title || ' new' ELSE title END AS title,
      change_number, stamp_text FROM meta1"""),
    "incoming": (("meta2",), """SELECT * FROM meta2 WHERE doc_id % 3 = 0 UNION ALL
      SELECT * REPLACE (doc_id + 1000000 AS doc_id,
        (doc_id + 1000000) || substr(decimal_number, length(CAST(doc_id AS VARCHAR)) + 1) AS decimal_number)
      FROM meta2 WHERE doc_id % 50 = 0"""),
    "sheets": ((), """SELECT l_orderkey AS doc_id, l_linenumber AS page_num, status,
      (l_suppkey % 12) || status AS change_token, l_linestatus AS linestatus FROM (
      SELECT *, CASE l_returnflag WHEN 'A' THEN 'Зам.' WHEN 'R' THEN 'Нов.' ELSE '' END AS status FROM lineitem)"""),
    "gfx1": ((), """SELECT l_orderkey AS doc_id, l_linenumber AS page_num, max(l_discount) * CAST(10 AS DOUBLE) AS score
      FROM lineitem GROUP BY ALL"""),
    "gfx2": (("gfx1",), "SELECT * FROM gfx1 WHERE (doc_id + page_num) % 6 <> 0"),
}


def with_(names, body, extra=()):
    """`body` after the named snapshots, what they need, and extra (name, sql) CTEs."""
    order = []

    def visit(n):
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({s})" for n, s in extra]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
