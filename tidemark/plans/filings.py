"""Filing queries: documents with planted contents, headings, tables and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import filings as f
from tidemark.plans.registry import out, query, table
from tidemark.sources.shared import written

MARKER = "전자공시시스템 dart.fss.or.kr Page 1"
#: What stands before and after the first 24 characters of a heading line, by (line div 6 + doc_id) mod 8: the sixth is indented, the seventh a row of figures.
HEADS = (("II. ", ""), ("3. ", ""), ("3-1. ", ""), ("2.1. ", ""), ("【", "】"), ("  4. ", ""), ("5. ", " 12 1,340 5.6%"), ("IV. 주석 ", ""))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): sentences as lines; of six lines the first a heading, the third a table row, the fifth with an amount; two documents of three
    have contents, where some entries lack and some have no section.
    """
    rows = docs.select("doc_id", F.split(F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit(". "), F.lit(".\n")), "\n").alias("s"))
    kind = lambda i: F.pmod(F.call_function("div", i, F.lit(6)) + F.col("doc_id"), F.lit(8))

    def head(x, i):
        forms = F.when(F.lit(False), "")
        for k, (before, after) in enumerate(HEADS):
            forms = forms.when(kind(i) == k, F.concat(F.lit(before), F.substring(x, 1, 24), F.lit(after)))
        return forms

    def line(x, j):
        i = j + 1
        return F.when(i % 6 == 1, head(x, i)).when(i % 6 == 3, F.concat(F.lit("| "), x, F.lit(" | 7 |"))).when((i % 6 == 4) & (kind(i) == 1), "......12").when(i % 6 == 5, F.concat(x, F.lit(" 1,200억원"))).otherwise(x)

    def entry(x, j):
        i, g = j + 1, F.call_function("div", j + 1, F.lit(6))
        own = F.when(g % 5 != 4, F.concat(head(x, i), F.when(i % 4 != 3, F.concat(F.lit(" ..... "), i.cast("string"))).otherwise("")))
        more = F.when(g % 7 == 3, F.concat(F.lit("VI. missing "), i.cast("string")))
        return F.when(i % 6 == 1, F.array_compact(F.array(own, more))).otherwise(F.array().cast("array<string>"))

    toc = F.flatten(F.transform("s", entry))
    body = F.transform("s", line)
    whole = F.when(F.col("doc_id") % 3 == 2, body).otherwise(F.concat(toc, F.array(F.lit(MARKER)), body))
    return rows.select("doc_id", F.array_join(whole, "\n").alias("text"))


_HEAD = "CASE (i // 6 + doc_id) % 8 " + " ".join(f"WHEN {k} THEN '{a}' || left(x, 24) || '{b}'" for k, (a, b) in enumerate(HEADS)) + " END"
_TRIM = lambda c: f"regexp_replace({c}, '^{f.BLANK}+|{f.BLANK}+$', '', 'g')"
_COUNT = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_KEY = lambda c: f"""regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\.{{2,}}{f.BLANK}*\\d+$', ''), '{f.BLANK}+\\d+$', ''), '{f.BLANK}|[【】()\\[\\],.:;`''"-]', '', 'g')"""
F_SQL = f"""l AS (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(replace(replace(text, chr(13), ''), '. ', '.' || chr(10)), chr(10)) AS s FROM documents)),
toc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, more) AS no, x FROM (
  SELECT doc_id, i, 0 AS more, {_HEAD} || CASE WHEN i % 4 <> 3 THEN ' ..... ' || i ELSE '' END AS x FROM l WHERE i % 6 = 1 AND (i // 6) % 5 <> 4
  UNION ALL SELECT doc_id, i, 1, 'VI. missing ' || i FROM l WHERE i % 6 = 1 AND (i // 6) % 7 = 3) WHERE doc_id % 3 <> 2),
above AS (SELECT doc_id, coalesce(max(no), 0) + 1 AS marker FROM (SELECT doc_id, no FROM toc UNION ALL SELECT DISTINCT doc_id, 0 FROM documents WHERE doc_id % 3 <> 2) GROUP BY 1),
n AS (SELECT doc_id, no, x AS line FROM toc UNION ALL SELECT doc_id, marker, '{MARKER}' FROM above
  UNION ALL SELECT l.doc_id, i + coalesce(marker, 0), CASE WHEN i % 6 = 1 THEN {_HEAD.replace("doc_id", "l.doc_id")} WHEN i % 6 = 3 THEN '| ' || x || ' | 7 |' WHEN i % 6 = 4 AND (i // 6 + l.doc_id) % 8 = 1 THEN '......12' WHEN i % 6 = 5 THEN x || ' 1,200억원' ELSE x END
  FROM l LEFT JOIN above a ON a.doc_id = l.doc_id),
k AS (SELECT *, CASE WHEN regexp_matches(t, '{f.BRACKET}') THEN 'bracket' WHEN regexp_matches(t, '{f.ROMAN}') THEN 'roman' WHEN regexp_matches(t, '{f.DECIMAL}') THEN CASE WHEN contains(regexp_extract(t, '{f.TOKEN}', 1), '-') THEN 'hyphen-decimal' ELSE 'decimal' END END AS kind
  FROM (SELECT *, {_TRIM('line')} AS t, coalesce(a.marker, 1) AS start FROM n LEFT JOIN above a USING (doc_id))),
h AS (SELECT doc_id, no, line, t, start, kind, CASE WHEN kind IN ('bracket', 'roman') THEN 1 ELSE 2 + {_COUNT(f"regexp_extract(t, '{f.TOKEN}', 1)", '[.-]')} END AS level,
  (kind <> 'bracket' AND regexp_matches(line, '^{f.BLANK}')) OR regexp_matches(regexp_replace(t, '{f.PREFIX}', ''), '{f.DASHES}') OR {_COUNT(f"regexp_replace(t, '{f.PREFIX}', '')", f.FIGURE)} >= 2 AS tabular FROM k),
c AS (SELECT doc_id, no AS line_no, t AS title, level, kind FROM h WHERE kind IS NOT NULL AND no < start),
r AS (SELECT *, kind IS NOT NULL AND no >= start AND NOT tabular AS is_head FROM h),
g AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY no) AS section FROM r),
s0 AS (SELECT doc_id, CAST(section AS BIGINT) AS section, max(t) FILTER (WHERE is_head) AS title, max(level) FILTER (WHERE is_head) AS level, max(kind) FILTER (WHERE is_head) AS kind, min(no) AS start_line, max(no) AS end_line,
  {_TRIM("regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT is_head AND t <> '' AND NOT regexp_matches(t, '" + f.LEADER + "')), ''), '[ \\t]+', ' ', 'g')")} AS content FROM g WHERE section > 0 GROUP BY 1, 2),
s1 AS (SELECT *, length(content) AS content_length, {_COUNT('content', '(?m)^\\|.*\\|$')} AS table_count, {_COUNT('content', f.NUMBER)} AS numeric_count FROM s0),
s AS (SELECT *, CASE WHEN content_length = 0 THEN 'missing' WHEN content_length < 140 THEN 'partial' WHEN regexp_matches(title, '{f.REVIEW_HEAVY}') AND numeric_count = 0 AND table_count = 0 THEN 'needs_review' WHEN content_length < 300 AND numeric_count <= 1 THEN 'partial' ELSE 'parsed' END AS status FROM s1),
best AS (SELECT *, {_KEY('title')} AS key FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, {_KEY('title')} ORDER BY content_length DESC, section) = 1),
m AS (SELECT c.doc_id, c.line_no, c.title, c.level, b.section, coalesce(b.content_length, 0) AS content_length, coalesce(b.table_count, 0) AS table_count, coalesce(b.numeric_count, 0) AS numeric_count, coalesce(b.status, 'missing') AS status FROM c LEFT JOIN best b ON b.doc_id = c.doc_id AND b.key = {_KEY('c.title')})"""
I_SQL = f"""{F_SQL},
under AS (SELECT a.doc_id, a.line_no AS par, b.line_no, b.level, b.status, min(b.level) OVER (PARTITION BY a.doc_id, a.line_no ORDER BY b.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closer
  FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.line_no > a.line_no AND b.level > a.level WHERE a.status = 'missing' AND a.level <= 2),
kids AS (SELECT doc_id, par AS line_no, count(*) AS k, count(*) FILTER (WHERE status = 'parsed') AS p, count(*) FILTER (WHERE status = 'partial') AS q FROM under WHERE closer IS NULL OR closer >= level GROUP BY 1, 2),
i AS (SELECT m.* REPLACE (CASE WHEN p > 0 AND p = k THEN 'parsed' WHEN p > 0 OR q > 0 THEN 'partial' ELSE m.status END AS status) FROM m LEFT JOIN kids ON kids.doc_id = m.doc_id AND kids.line_no = m.line_no)"""


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = planted(table(spark, sf_dir, "documents"))
    return f.contents(docs), f.sections(docs)


def _outline(spark, sf_dir, *more: str) -> tuple[DataFrame, DataFrame]:
    return f.outline(planted(table(spark, sf_dir, "documents")), ["content_length", "table_count", "numeric_count", *more])


def _items(spark, sf_dir) -> DataFrame:
    return f.coverage_items(*_outline(spark, sf_dir))


@query("doc_contents", f"WITH {F_SQL} SELECT doc_id, line_no, title, CAST(level AS BIGINT) AS level, kind FROM c")
def doc_contents(spark, sf_dir):
    return out(_parts(spark, sf_dir)[0], "doc_id", "line_no", "title", "level", "kind")


@query("doc_sections", f"WITH {F_SQL} SELECT doc_id, section, title, CAST(level AS BIGINT) AS level, kind, start_line, end_line, content_length, table_count, numeric_count, sha256(content) AS content_sha256, CASE WHEN content = '' THEN '{f.NO_PREVIEW}' ELSE content[:280] END AS preview FROM s")
def doc_sections(spark, sf_dir):
    found = _parts(spark, sf_dir)[1].withColumn("content_sha256", F.sha2("content", 256))
    return out(found, "doc_id", "section", "title", "level", "kind", "start_line", "end_line", "content_length", "table_count", "numeric_count", "content_sha256", "preview")


@query("section_status", f"WITH {F_SQL} SELECT doc_id, section, status FROM s")
def section_status(spark, sf_dir):
    return out(_parts(spark, sf_dir)[1].withColumn("status", f.section_status()), "doc_id", "section", "status")


@query("toc_sections", f"WITH {F_SQL} SELECT doc_id, line_no, section, content_length, status FROM m")
def toc_sections(spark, sf_dir):
    toc, found = _outline(spark, sf_dir)
    return out(f.toc_sections(toc, found.withColumn("status", f.section_status())), "doc_id", "line_no", "section", "content_length", "status")


@query("toc_children", f"WITH {I_SQL} SELECT doc_id, line_no, CAST(level AS BIGINT) AS level, status FROM i")
def toc_children(spark, sf_dir):
    return out(_items(spark, sf_dir), "doc_id", "line_no", "level", "status")


_TITLES = lambda s: f"coalesce(string_agg(title, chr(10) ORDER BY line_no) FILTER (WHERE status = '{s}'), '') AS {s}_titles"


@query("coverage_report", f"""WITH {I_SQL} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE status = 'parsed') AS n_parsed, count(*) FILTER (WHERE status = 'partial') AS n_partial, count(*) FILTER (WHERE status = 'missing') AS n_missing, count(*) FILTER (WHERE status = 'needs_review') AS n_needs_review,
round(count(*) FILTER (WHERE status = 'parsed') / count(*), 4) AS completion, {_TITLES('partial')}, {_TITLES('missing')}, {_TITLES('needs_review')} FROM i GROUP BY 1""")
def coverage_report(spark, sf_dir):
    found = f.coverage_report(_items(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, "\n") for c in found.columns if c.endswith("_titles")})


@query("section_evidence", f"""WITH {I_SQL}, key AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS rank FROM s WHERE level <= 2 QUALIFY rank <= 20),
hit AS (SELECT key.doc_id, key.rank, i.status FROM key JOIN i ON i.doc_id = key.doc_id AND (i.section = key.section OR i.title = key.title) QUALIFY row_number() OVER (PARTITION BY key.doc_id, key.rank ORDER BY i.line_no) = 1)
SELECT key.doc_id, key.rank, title, CASE WHEN content = '' THEN '{f.NO_PREVIEW}' WHEN length(content) <= 180 THEN content ELSE content[:177] || '...' END AS summary, coalesce(hit.status, 'unmatched') AS status FROM key LEFT JOIN hit ON hit.doc_id = key.doc_id AND hit.rank = key.rank""")
def section_evidence(spark, sf_dir):
    toc, found = _outline(spark, sf_dir, "preview")
    return out(f.section_evidence(found, written(f.coverage_items(toc, found), "items")))


@query("next_checks", f"WITH {I_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY status <> 'missing', line_no) AS rank, title, status FROM i WHERE status IN ('missing', 'needs_review') QUALIFY rank <= 12")
def next_checks(spark, sf_dir):
    return out(f.next_checks(_items(spark, sf_dir)))
