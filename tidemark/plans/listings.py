"""Report listing queries: documents whose lines are planted with report rows, addresses and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import listings as ls
from tidemark.operators.filings import BLANK
from tidemark.plans.registry import out, query, table

SENTENCES = "string_split(replace(replace(text, chr(13), ''), '. ', '.' || chr(10)), chr(10))"
REPORT = r"https?://site\.example/read\?[^\s]*nid=(\d+)"
ADDRESS = r"https?://site\.example/[A-Za-z0-9_?=&/.-]+"


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of thirteen lines eight are a report's row, in one round of four with a wrong price, in one with two rows that overlap."""
    rows = docs.select("doc_id", F.split(F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit(". "), F.lit(".\n")), "\n").alias("s"))
    i = F.col("doc_id")

    def line(x, j):
        k, r = (j + i) % 13, F.call_function("div", j + i, F.lit(13)) % 4
        day = F.when(i % 5 == 0, "2024-13-45").otherwise(F.concat(F.lit("2024-01-1"), (j % 10).cast("string")))
        named = F.concat(F.lit("Corp(123456) "), x)
        cells = [day, named, F.when(r == 3, "2024-02-02").otherwise(named), x, F.when(r == 1, "n/a").otherwise("12,000"), F.lit("Buy"), F.when(r == 3, "7").otherwise("Kim"), F.when(r == 3, "Hold").otherwise("Broker"), F.lit(" ")]
        cells += [F.concat(F.substring(x, 1, 30), F.lit(" → https://site.example/read?a=1&nid="), j.cast("string")), F.when(i % 3 == 0, x).otherwise(F.concat(F.lit("PDF → https://site.example/f"), j.cast("string"), F.lit(".pdf"))), F.lit(" > "), x]
        out_ = x
        for n, c in enumerate(cells[:-1]):
            out_ = F.when(k == n, c).otherwise(out_)
        return out_

    return rows.select("doc_id", F.array_join(F.transform("s", line), "\n").alias("text"))


_TRIM = lambda c: f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"
P_SQL = f"""x AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS j FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)),
p AS (SELECT doc_id, j, {_TRIM('''CASE (j + doc_id) % 13 WHEN 0 THEN CASE WHEN doc_id % 5 = 0 THEN '2024-13-45' ELSE '2024-01-1' || j % 10 END WHEN 1 THEN 'Corp(123456) ' || x WHEN 2 THEN CASE WHEN r = 3 THEN '2024-02-02' ELSE 'Corp(123456) ' || x END
  WHEN 4 THEN CASE WHEN r = 1 THEN 'n/a' ELSE '12,000' END WHEN 5 THEN 'Buy' WHEN 6 THEN CASE WHEN r = 3 THEN '7' ELSE 'Kim' END WHEN 7 THEN CASE WHEN r = 3 THEN 'Hold' ELSE 'Broker' END WHEN 8 THEN ' '
  WHEN 9 THEN left(x, 30) || ' → https://site.example/read?a=1&nid=' || j WHEN 10 THEN CASE WHEN doc_id % 3 = 0 THEN x ELSE 'PDF → https://site.example/f' || j || '.pdf' END WHEN 11 THEN ' > ' ELSE x END''')} AS line FROM (SELECT *, ((j + doc_id) // 13) % 4 AS r FROM x)),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS no, line FROM p WHERE line <> ''),
w AS (SELECT *, {', '.join(f'lead(line, {k}) OVER o AS c{k}' for k in range(1, 8))} FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
fit AS (SELECT * FROM w WHERE regexp_matches(line, '{ls.BLOCK_DATE}') AND c7 IS NOT NULL AND regexp_matches(c4, '{ls.TARGET}') AND regexp_matches(c5, '{ls.RATING}')),
apart AS (SELECT doc_id, unnest(list_reduce(list_prepend([-8::BIGINT], list([no] ORDER BY no)), lambda a, b: CASE WHEN b[1] >= a[-1] + 8 THEN list_concat(a, b) ELSE a END)) AS no FROM fit GROUP BY 1)"""


@query("parse_report_rows", f"""WITH {P_SQL} SELECT f.doc_id, f.no AS line, try_cast(f.line AS DATE) AS published, {_TRIM(f"regexp_replace(c1, '{ls.TICKER_PREFIX}', '')")} AS title, c3 AS short_title, CASE WHEN c4 = '0' THEN NULL ELSE CAST(replace(c4, ',', '') AS DOUBLE) END AS target_price, c5 AS rating, c6 AS analyst, c7 AS broker
FROM fit f JOIN apart a ON a.doc_id = f.doc_id AND a.no = f.no""")
def parse_report_rows(spark, sf_dir):
    return out(ls.report_facts(ls.report_rows(pages(table(spark, sf_dir, "documents")))), "doc_id", "line", "published", "title", "short_title", "target_price", "rating", "analyst", "broker")


@query("rows_above_dates", f"""WITH {P_SQL}, d AS (SELECT doc_id, j, line FROM p WHERE regexp_matches(line, '{ls.DATE}')),
n AS (SELECT d.doc_id, d.j, p.line, row_number() OVER (PARTITION BY d.doc_id, d.j ORDER BY p.j DESC) AS k FROM d JOIN p ON p.doc_id = d.doc_id AND p.j < d.j AND p.j >= d.j - 10 WHERE length(p.line) >= 2 AND NOT regexp_matches(p.line, '{ls.ICONS}')),
g AS (SELECT doc_id, j, max(line) FILTER (WHERE k = 1) AS broker, max(line) FILTER (WHERE k = 2) AS company, max(line) FILTER (WHERE k = 3) AS title FROM n GROUP BY 1, 2)
SELECT d.doc_id, d.j AS line, try_cast(d.line AS DATE) AS published, broker, company, title FROM d LEFT JOIN g ON g.doc_id = d.doc_id AND g.j = d.j""")
def rows_above_dates(spark, sf_dir):
    return out(ls.rows_above_dates(pages(table(spark, sf_dir, "documents"))), "doc_id", "line", "published", "broker", "company", "title")


@query("parse_link_lines", f"""WITH {P_SQL}, a AS (SELECT doc_id, no, {_TRIM("split_part(line, ' → ', 1)")} AS title, {_TRIM("line[instr(line, ' → ') + 3:]")} AS url FROM l WHERE contains(line, ' → ')),
k AS (SELECT *, regexp_matches(url, '{REPORT}') AS is_report FROM a WHERE regexp_matches(url, '{REPORT}') OR regexp_matches(url, '{ls.PDF}')),
g AS (SELECT *, sum(is_report::INT) OVER (PARTITION BY doc_id ORDER BY no) AS nth FROM k),
f AS (SELECT doc_id, nth, arg_min(url, no) AS pdf_url FROM g WHERE NOT is_report GROUP BY 1, 2)
SELECT g.doc_id, CAST(g.nth - 1 AS BIGINT) AS nth, regexp_extract(url, '{REPORT}', 1) AS report_id, title, url, pdf_url FROM g LEFT JOIN f ON f.doc_id = g.doc_id AND f.nth = g.nth WHERE is_report""")
def parse_link_lines(spark, sf_dir):
    return out(ls.report_links(pages(table(spark, sf_dir, "documents")), REPORT))


@query("search_hits", f"""WITH {P_SQL}, u AS (SELECT doc_id, no, unnest(regexp_extract_all(line, '{ADDRESS}')) AS url FROM l), h AS (SELECT doc_id, url, min(no) AS no FROM u GROUP BY 1, 2),
n AS (SELECT h.doc_id, h.url, h.no, l.no AS pos, l.line, regexp_matches(l.line, '{ADDRESS}') AS hit FROM h JOIN l ON l.doc_id = h.doc_id AND l.no BETWEEN h.no - 3 AND h.no + 3),
g AS (SELECT doc_id, url, no, arg_max(line, pos) FILTER (WHERE pos < no AND NOT hit AND length(line) >= 4) AS title, arg_min(line, pos) FILTER (WHERE pos > no AND NOT hit AND length(line) >= 10) AS snippet, string_agg(line, ' ' ORDER BY pos) AS around FROM n GROUP BY 1, 2, 3),
t AS (SELECT *, regexp_extract(around, '\\b20\\d{{2}}[./-]\\d{{1,2}}[./-]\\d{{1,2}}\\b') AS day FROM g)
SELECT doc_id, no AS line, url, coalesce(title, '') AS title, coalesce(snippet, '') AS snippet, try_cast(day AS DATE) AS published FROM t""")
def search_hits(spark, sf_dir):
    return out(ls.search_hits(pages(table(spark, sf_dir, "documents")), ADDRESS), "doc_id", "line", "url", "title", "snippet", "published")


HOSTS = ("https://press.example/", "https://search.naver.com/", "https://news.naver.com", "https://news.naver.com/a/", "ftp://press.example/", "http://m.blog.naver.com/")


@query("headline_extract", f"""WITH x AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS j FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)),
h AS (SELECT doc_id, j, {_TRIM("left(x, 40) || CASE WHEN j % 3 <> 1 THEN ' 기사' ELSE '' END")} AS t, (j + doc_id) % 6 IN (0, 3) AS outside, {_TRIM("CASE WHEN regexp_matches(y, '^(.{10,150}?)[.。][ ' || chr(10) || ']') THEN regexp_extract(y, '^(.{10,150}?)[.。][ ' || chr(10) || ']', 1) ELSE left(y, 100) END")} AS b, length(y) >= 20 AS long
  FROM (SELECT *, replace(x, chr(10), ' ') || CASE WHEN j % 3 <> 1 THEN ' 기사' ELSE '' END || CASE WHEN j % 2 = 0 THEN '. 더 있음' ELSE '' END AS y FROM x)),
f AS (SELECT 'link' AS kind, doc_id, t AS headline, min(j) AS j FROM h WHERE outside GROUP BY 2, 3 UNION ALL SELECT 'text', doc_id, b, min(j) FROM h WHERE long GROUP BY 2, 3)
SELECT kind, doc_id, row_number() OVER (PARTITION BY kind, doc_id ORDER BY j) - 1 AS nth, headline FROM f WHERE length(headline) >= 10 AND regexp_matches(headline, '{ls.KOREAN}')""")
def headline_extract(spark, sf_dir):
    """Sentences as links, a third of them inside the portal or by another protocol, and as articles of one text; two of three get a Korean word."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split(F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit(". "), F.lit(".\n")), "\n").alias("s"))
    word = lambda j: F.when(j % 3 != 1, " 기사").otherwise("")
    host = lambda j: F.element_at(F.array(*map(F.lit, HOSTS)), ((j + F.col("doc_id")) % 6 + 1).cast("int"))
    address = lambda j: F.concat(host(j), F.when((j + F.col("doc_id")) % 6 == 2, "").otherwise(j.cast("string")))
    links = F.array_join(F.transform("s", lambda x, j: F.concat(F.substring(x, 1, 40), word(j), F.lit(" → "), address(j))), "\n")
    blob = F.array_join(F.transform("s", lambda x, j: F.concat(x, word(j), F.when(j % 2 == 0, ". 더 있음").otherwise(""))), ls.ARTICLE_MARK)
    linked, split = (f(rows.select("doc_id", t.alias("text"))).withColumn("kind", F.lit(k)) for f, t, k in ((ls.linked_headlines, links, "link"), (ls.split_headlines, blob, "text")))
    return out(linked.unionByName(split), "kind", "doc_id", "nth", "headline")
