"""Memo queries: documents with planted tables, sections, dates and images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import markdown as m
from tidemark.operators.filings import BLANK
from tidemark.plans.registry import out, query, table

SENTENCES = "string_split(replace(replace(text, chr(13), ''), '. ', '.' || chr(10)), chr(10))"
AS_OF = "2024-02-10"


def tabled(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): sentences as lines, of nine of which six become tables or what looks like one."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit(". "), F.lit(".\n")), "\n")).alias("line_no", "x"))
    nth, bare, wide = (F.col("line_no") + F.col("doc_id")) % 9, F.col("doc_id") % 4 == 1, F.col("doc_id") % 3 == 0
    line = (
        F.when(nth == 0, F.concat(F.lit("| "), F.substring("x", 1, 9), F.lit(" | **b** | c |"))).when(nth == 1, F.when(bare, "---").otherwise("|---|:-:|"))
        .when(nth == 2, F.concat(F.lit("| "), F.substring("x", 1, 12), F.lit(" |"))).when(nth == 3, "| 1 | 2 | 3 | 4 |").when(nth == 5, "a | `b`").when(wide & (nth == 6), "---:|---").when(wide & (nth == 7), F.concat(F.lit("c|"), F.col("x"))).otherwise(F.col("x"))
    )
    return rows.select("doc_id", "line_no", line.alias("line"))


_TRIM = lambda c: f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"
T_SQL = f"""x AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS no FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)),
l AS (SELECT doc_id, no, CASE (no + doc_id) % 9 WHEN 0 THEN '| ' || left(x, 9) || ' | **b** | c |' WHEN 1 THEN CASE WHEN doc_id % 4 = 1 THEN '---' ELSE '|---|:-:|' END WHEN 2 THEN '| ' || left(x, 12) || ' |' WHEN 3 THEN '| 1 | 2 | 3 | 4 |'
  WHEN 5 THEN 'a | `b`' WHEN 6 THEN CASE WHEN doc_id % 3 = 0 THEN '---:|---' ELSE x END WHEN 7 THEN CASE WHEN doc_id % 3 = 0 THEN 'c|' || x ELSE x END ELSE x END AS line FROM x),
w AS (SELECT doc_id, no, line, contains(line, '|') AS pipe, list_transform(string_split(regexp_replace({_TRIM('line')}, '^\\||\\|$', '', 'g'), '|'), lambda c: {_TRIM('c')}) AS cells FROM l),
r AS (SELECT *, len(list_filter(cells, lambda c: NOT regexp_matches(c, '{m.DIVIDER}'))) = 0 AS rule FROM w),
e AS (SELECT *, lead(rule) OVER o AS rule_next, min(CASE WHEN NOT pipe THEN no END) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop, max(no) OVER (PARTITION BY doc_id) + 1 AS ends, lead(cells) OVER o AS marks FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
h AS (SELECT doc_id, no AS start, coalesce(stop, ends) AS stop, len(cells) AS width, marks FROM e WHERE pipe AND rule_next),
t AS (SELECT doc_id, unnest(list_reduce(list_prepend([[-1, 0]], list(DISTINCT [[start, stop]] ORDER BY [[start, stop]])), lambda a, b: CASE WHEN b[1][1] >= a[-1][2] THEN list_append(a, b[1]) ELSE a END)) AS s FROM h GROUP BY 1),
k AS (SELECT h.*, row_number() OVER (PARTITION BY h.doc_id ORDER BY start) - 1 AS tab FROM h JOIN t ON t.doc_id = h.doc_id AND t.s[1] = h.start),
c0 AS (SELECT k.doc_id, k.tab, CASE WHEN r.no = start THEN 0 ELSE r.no - start - 1 END AS row, r.cells, width, marks, start FROM k JOIN r ON r.doc_id = k.doc_id AND r.no >= start AND r.no < stop AND r.no <> start + 1),
c1 AS (SELECT doc_id, tab, row, unnest(range(width)) AS col, cells, marks, start FROM c0),
c AS (SELECT doc_id, tab AS "table", row, col, coalesce(cells[col + 1], '') AS text, CASE WHEN marks[col + 1] SIMILAR TO ':-{{3,}}:' THEN 'center' WHEN marks[col + 1] SIMILAR TO '-{{3,}}:' THEN 'right' WHEN marks[col + 1] IS NOT NULL THEN 'left' END AS alignment, start AS start_line FROM c1)"""


@query("md_tables", f"""WITH {T_SQL} SELECT doc_id, "table", row, col, text, alignment, start_line FROM c""")
def md_tables(spark, sf_dir):
    return out(m.table_cells(tabled(table(spark, sf_dir, "documents"))), "doc_id", "table", "row", "col", "text", "alignment", "start_line")


_SHOWN = lambda c: f"{_TRIM(f'''regexp_replace(regexp_replace(regexp_replace({c}, '[*][*]([^*]+)[*][*]', '{chr(92)}1', 'g'), '`([^`]+)`', '{chr(92)}1', 'g'), '{BLANK}+', ' ', 'g')''')}"


@query("md_table_check", f"""WITH {T_SQL}, x1 AS (SELECT doc_id, "table" AS t, row, col, {_SHOWN('text')} AS e FROM c), k5 AS (SELECT *, (doc_id + t) % 5 AS k FROM x1),
a AS (SELECT doc_id, t, row, col, CASE WHEN k = 3 AND col = 0 THEN e || '!' ELSE e END AS a FROM k5 WHERE k <> 0 AND NOT (k = 1 AND row >= 2) AND NOT (k = 2 AND col >= 1)),
se AS (SELECT doc_id, t, max(row) + 1 AS r, max(col) + 1 AS c FROM x1 GROUP BY 1, 2), sa AS (SELECT doc_id, t, max(row) + 1 AS r, max(col) + 1 AS c FROM a GROUP BY 1, 2),
ne AS (SELECT doc_id, count(DISTINCT t) AS n FROM x1 GROUP BY 1), na AS (SELECT doc_id, count(DISTINCT t) AS n FROM a GROUP BY 1)
SELECT ne.doc_id, NULL::BIGINT AS "table", NULL::BIGINT AS row, NULL::BIGINT AS col, 'tables' AS kind, CAST(ne.n AS VARCHAR) AS expected, CAST(coalesce(na.n, 0) AS VARCHAR) AS actual FROM ne LEFT JOIN na ON na.doc_id = ne.doc_id WHERE ne.n <> coalesce(na.n, 0)
UNION ALL SELECT se.doc_id, se.t, NULL, NULL, 'rows', CAST(se.r AS VARCHAR), CAST(sa.r AS VARCHAR) FROM se JOIN sa ON sa.doc_id = se.doc_id AND sa.t = se.t WHERE se.r <> sa.r
UNION ALL SELECT se.doc_id, se.t, NULL, NULL, 'columns', CAST(se.c AS VARCHAR), CAST(sa.c AS VARCHAR) FROM se JOIN sa ON sa.doc_id = se.doc_id AND sa.t = se.t WHERE se.c <> sa.c
UNION ALL SELECT e.doc_id, e.t, e.row, e.col, 'cell', e.e, coalesce(a.a, '') FROM x1 e JOIN sa ON sa.doc_id = e.doc_id AND sa.t = e.t LEFT JOIN a ON a.doc_id = e.doc_id AND a.t = e.t AND a.row = e.row AND a.col = e.col WHERE e.e <> coalesce(a.a, '')""")
def md_table_check(spark, sf_dir):
    """Of five tables the first is lost, the second has two rows, the third one column and the fourth changed cells."""
    cells = m.table_cells(tabled(table(spark, sf_dir, "documents")))
    k = (F.col("doc_id") + F.col("table")) % 5
    changed = F.when((k == 3) & (F.col("col") == 0), F.concat(F.trim("text"), F.lit("!"))).otherwise(F.col("text"))
    other = cells.where((k != 0) & ~((k == 1) & (F.col("row") >= 2)) & ~((k == 2) & (F.col("col") >= 1))).withColumn("text", changed)
    return out(m.table_mismatches(cells, other), "doc_id", "table", "row", "col", "kind", "expected", "actual")


def memos(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a memo of each document, with dates, sections, tables and images that its id decides."""
    rows = docs.where("doc_id is not null").select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\. ").alias("s"))
    i = F.col("doc_id")
    words = lambda j: F.regexp_replace(F.get("s", F.lit(j) % F.size("s")), "[^A-Za-z ]", "")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    many = lambda line, n: F.array_repeat(F.lit(line), n.cast("int"))
    part = lambda cond, *lines: F.when(cond, F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))).otherwise(F.array().cast("array<string>"))
    day = F.concat(F.lit("2024-01-"), two(1 + i % 28))
    base = F.concat(F.lit("기준일: "), F.when(i % 2 == 0, F.concat(F.lit("`"), day, F.lit("`"))).otherwise(day))
    parts = [part(F.lit(True), "# Memo"), part(i % 10 != 3, base), part(i % 3 == 0, F.concat(F.lit("최근 업데이트일: 2024-02-"), two(1 + i % 20))), part(i % 6 == 0, F.concat(F.lit("![c](chart-"), (i % 4).cast("string"), F.lit(".png)")))]
    for j, name in enumerate(m.MEMO_SECTIONS):
        here, full = (i + j) % 23 != 0, (i + j) % 9 != 4
        parts += [part(here, f"## {name}", ""), part(here & full, F.concat(F.lit(f"x{j} "), words(j)))]
        if name == m.VALUATION:
            parts.append(part(here & full, F.concat(F.lit("Price 10, Market Cap 20"), F.when(i % 3 != 0, ", PER 5").otherwise(""), F.when(i % 2 == 0, ", EV/EBITDA 3, PBR 1").otherwise(""))))
            parts.append(F.when(here & full, many("| d | 2024-01-02 |", i % 5)).otherwise(F.array().cast("array<string>")))
    recheck = i % 4 != 1
    parts += [part(recheck, "## DART Recheck"), part(recheck & (i % 8 != 2), "| 주장 | 상태 |", "| --- | --- |"), F.when(recheck & (i % 8 != 2), many("| c | ok |", i % 6)).otherwise(F.array().cast("array<string>"))]
    parts += [part(i % 11 != 0, "## Sources"), part((i % 11 != 0) & (i % 7 != 0), "- [a](http://x/y)")]
    return rows.select("doc_id", F.array_join(F.concat(*parts), "\n").alias("text"))


def files(docs: DataFrame) -> DataFrame:
    """The images beside each memo: the first two of four."""
    return docs.where("doc_id is not null").select("doc_id", F.explode(F.array(F.lit("chart-0.png"), F.lit("chart-1.png"))).alias("target"))


#: What the checks must say, from what decides the memos and not from their text.
_N = ", ".join(f"({j}, '{n}')" for j, n in enumerate(m.MEMO_SECTIONS))
_V = m.MEMO_SECTIONS.index(m.VALUATION)
M_SQL = f"""n(j, name) AS (VALUES {_N}), d AS (SELECT doc_id AS i, string_split(coalesce(text, ''), '. ') AS s FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT i, j, name, (i + j) % 23 <> 0 AS here, (i + j) % 9 <> 4 AS filled FROM d, n),
lost AS (SELECT i, coalesce(string_agg(name, ', ' ORDER BY j) FILTER (WHERE NOT here), '') AS missing, coalesce(string_agg(name, ', ' ORDER BY j) FILTER (WHERE here AND NOT filled), '') AS bare FROM p GROUP BY 1),
v AS (SELECT i, (i + {_V}) % 23 <> 0 AND (i + {_V}) % 9 <> 4 AS valued, lower(regexp_replace(s[{_V} % len(s) + 1], '[^A-Za-z ]', '', 'g')) AS said FROM d),
o AS (SELECT d.i, CASE WHEN i % 10 <> 3 THEN DATE '2024-01-01' + CAST(i % 28 AS INTEGER) END AS base, CASE WHEN i % 3 = 0 THEN DATE '2024-02-01' + CAST(i % 20 AS INTEGER) END AS updated, i % 4 <> 1 AS recheck, i % 4 <> 1 AND i % 8 <> 2 AS tabled FROM d),
u AS (SELECT i, list_filter(['price', 'market cap', 'per', 'ev/ebitda', 'pbr'], lambda w: NOT (valued AND (contains(said, w) OR w IN ('price', 'market cap') OR (w = 'per' AND i % 3 <> 0) OR (w IN ('ev/ebitda', 'pbr') AND i % 2 = 0)))) AS unsaid, CASE WHEN valued THEN i % 5 ELSE 0 END AS dates FROM v),
g AS (
  SELECT i, 'required-sections' AS "check", 'error' AS severity, missing = '' AS passed, missing AS detail FROM lost
  UNION ALL SELECT i, 'base-date-present', 'error', base IS NOT NULL, coalesce(CAST(base AS VARCHAR), '') FROM o
  UNION ALL SELECT i, 'base-date-staleness', 'warn', coalesce(DATE '{AS_OF}' - coalesce(updated, base) <= 14, true) OR base IS NULL, CASE WHEN base IS NULL THEN '' ELSE CAST(DATE '{AS_OF}' - coalesce(updated, base) AS VARCHAR) END FROM o
  UNION ALL SELECT i, 'no-empty-sections', 'warn', e = '', e FROM (SELECT i, concat_ws(', ', nullif(bare, ''), CASE WHEN recheck AND NOT tabled AND i % 11 <> 0 THEN 'DART Recheck' END) AS e FROM (SELECT o.i, recheck, tabled,
    CASE WHEN i % 11 = 0 AND NOT recheck AND last_bare THEN regexp_replace(bare, '(^|, )[^,]+$', '') ELSE bare END AS bare FROM o JOIN lost USING (i) JOIN (SELECT i, arg_max(NOT filled, j) FILTER (WHERE here) AS last_bare FROM p GROUP BY 1) USING (i)))
  UNION ALL SELECT i, 'images-exist', 'error', NOT (i % 6 = 0 AND i % 4 >= 2), CASE WHEN i % 6 = 0 AND i % 4 >= 2 THEN 'chart-' || i % 4 || '.png' ELSE '' END FROM o
  UNION ALL SELECT i, 'recheck-table', 'warn', tabled, '' FROM o
  UNION ALL SELECT i, 'recheck-claims', 'warn', NOT recheck OR (tabled AND i % 6 >= 3), CASE WHEN NOT recheck THEN '' WHEN tabled THEN CAST(i % 6 AS VARCHAR) ELSE '0' END FROM o
  UNION ALL SELECT i, 'valuation-metrics', 'warn', len(unsaid) = 0, array_to_string(unsaid, ', ') FROM u
  UNION ALL SELECT i, 'source-dates', 'warn', dates >= 3, CAST(dates AS VARCHAR) FROM u)"""


def _gate(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return m.memo_gate(memos(docs), files(docs), AS_OF)


@query("memo_gate", f'WITH {M_SQL} SELECT i AS doc_id, "check", severity, passed, detail FROM g')
def memo_gate(spark, sf_dir):
    return _gate(spark, sf_dir)


@query("memo_result", f"WITH {M_SQL} SELECT i AS doc_id, count(*) FILTER (WHERE NOT passed AND severity = 'error') AS errors, count(*) FILTER (WHERE NOT passed AND severity = 'warn') AS warnings, count(*) FILTER (WHERE passed) AS n_passed, count(*) FILTER (WHERE NOT passed AND severity = 'error') = 0 AS passed FROM g GROUP BY 1")
def memo_result(spark, sf_dir):
    return m.gate_result(_gate(spark, sf_dir))


@query("memo_audit", f"""WITH {M_SQL}, a AS (
  SELECT i, 'date' AS problem, '기준일' AS detail FROM o WHERE base IS NULL OR i % 2 = 0
  UNION ALL SELECT i, 'heading', name FROM p WHERE NOT here
  UNION ALL SELECT i, 'heading', 'Update Log' FROM o WHERE updated IS NOT NULL
  UNION ALL SELECT i, 'heading', 'Sources' FROM o WHERE i % 11 = 0
  UNION ALL SELECT i, 'sources', CASE WHEN i % 11 = 0 OR i % 7 = 0 THEN 'malformed' ELSE 'no links' END FROM o WHERE i % 11 = 0 OR i % 7 = 0
  UNION ALL SELECT i, 'heading', 'DART Recheck' FROM o WHERE NOT recheck AND i % 5 <> 0
  UNION ALL SELECT i, 'image', 'chart-' || i % 4 || '.png' FROM o WHERE i % 6 = 0 AND i % 4 >= 2)
SELECT i AS doc_id, problem, detail FROM a""")
def memo_audit(spark, sf_dir):
    """Every fifth memo has the recheck section in its reference text. A heading of sources at the end of a text has no line after it."""
    docs = table(spark, sf_dir, "documents")
    return m.heading_audit(memos(docs), "memo", files(docs), docs.where("doc_id % 5 = 0"), need_recheck=True)


def logged(docs: DataFrame) -> DataFrame:
    """Memos with a title, an update log of up to three entries, two of which may share a day, and addresses of which one may name a ticker."""
    i = F.col("doc_id")
    name = F.when(i % 2 == 0, F.concat(F.lit("Corp "), i.cast("string"), F.lit(" Memo"))).otherwise(F.concat(F.lit("회사 "), i.cast("string"), F.lit(" 분석 예시")))
    text = F.replace("text", F.lit("# Memo"), F.concat(F.lit("# "), name))
    entries = F.transform(F.sequence(F.lit(0), (i % 4).cast("int")), lambda k: F.concat(F.lit("\n### 2024-03-0"), (F.floor(k / 2) + 1).cast("string"), F.lit(" Update\nsee http://u.example/"), k.cast("string"), F.lit(" and [x](http://v.example/"), k.cast("string"), F.lit(")")))
    log = F.when(i % 5 != 2, F.concat(F.lit("\n## Update Log"), F.array_join(entries, ""))).otherwise("")
    code = F.when(i % 6 == 1, F.concat(F.lit("\nhttps://q.example/item?code="), F.lpad(i.cast("string"), 6, "0"))).otherwise("")
    return memos(docs).select("doc_id", F.concat(text, log, code).alias("text"))


@query("memo_baseline", f"""WITH {M_SQL}, b AS (SELECT d.i, i % 5 <> 2 AS logged, i % 4 AS k, i % 6 = 1 AS coded FROM d),
us AS (SELECT i, list_concat(list_concat(CASE WHEN i % 11 <> 0 AND i % 7 <> 0 THEN ['http://x/y'] ELSE [] END, CASE WHEN logged THEN list_transform(range(0, k + 1), lambda x: 'http://v.example/' || x) ELSE [] END),
  list_concat(CASE WHEN logged THEN list_transform(range(0, k + 1), lambda x: 'http://u.example/' || x) ELSE [] END, CASE WHEN coded THEN ['https://q.example/item?code=' || lpad(CAST(i AS VARCHAR), 6, '0')] ELSE [] END)) AS urls FROM b)
SELECT b.i AS doc_id, CASE WHEN b.i % 2 = 0 THEN 'Corp ' || b.i || ' Memo' ELSE '회사 ' || b.i || ' 분석 예시' END AS title, CASE WHEN b.i % 2 = 0 THEN 'Corp ' || b.i ELSE '회사 ' || b.i END AS company, CAST(o.base AS VARCHAR) AS memo_date, CAST(o.updated AS VARCHAR) AS recent_update, logged AS has_update_log,
  CASE WHEN NOT logged THEN '' WHEN k < 2 THEN '2024-03-01' ELSE '2024-03-01,2024-03-02' END AS update_dates, array_to_string(urls, ' ') AS source_urls, CASE WHEN (b.i + 1) % 23 <> 0 AND (b.i + 1) % 9 <> 4 THEN trim('x1 ' || regexp_replace(s[1 % len(s) + 1], '[^A-Za-z ]', '', 'g'))[:600] END AS summary,
  CASE WHEN coded THEN lpad(CAST(b.i AS VARCHAR), 6, '0') END AS ticker FROM b JOIN d ON d.i = b.i JOIN o ON o.i = b.i JOIN us ON us.i = b.i""")
def memo_baseline(spark, sf_dir):
    found = m.memo_baseline(logged(table(spark, sf_dir, "documents")))
    return found.withColumns({"update_dates": F.array_join("update_dates", ","), "source_urls": F.array_join("source_urls", " ")})
