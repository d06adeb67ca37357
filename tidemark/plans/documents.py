"""Document queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import documents as d
from tidemark.plans.registry import out, query, table

ANCHOR = r"(?is)<a\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>".replace('\\"', '"')


@query("extract_anchors", f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS href, unnest(regexp_extract_all(html, '{ANCHOR}', 2)) AS t, unnest(range(len(regexp_extract_all(html, '{ANCHOR}', 1)))) AS nth FROM pages)
SELECT page_id, nth, href, trim(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM a""")
def extract_anchors(spark, sf_dir):
    return out(d.anchors(table(spark, sf_dir, "pages")))


_PLAIN = lambda c: f"trim(regexp_replace(regexp_replace({c}, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_NAMED = lambda tag: f"""regexp_extract_all(html, '(?is)<{tag}\\b[^>]*(?:id|class)="[^"]*(?:article|news|content|view|body)[^"]*"[^>]*>(.*?)</{tag}>', 1)"""


@query("article_text", f"""WITH b AS (SELECT page_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT page_id, list_concat(list_concat(regexp_extract_all(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1), {_NAMED('div')}), {_NAMED('section')}) AS l FROM pages)),
g AS (SELECT page_id, x FROM (SELECT page_id, {_PLAIN('x')} AS x, i FROM b) WHERE length(x) >= 120 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(x) DESC, i) = 1), w AS (SELECT page_id, {_PLAIN('html')} AS page FROM pages)
SELECT w.page_id, left(coalesce(g.x, CASE WHEN length(page) < 120 THEN '' ELSE page END), 2500) AS text FROM w LEFT JOIN g ON g.page_id = w.page_id""")
def article_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", d.article_text(F.col("html")).alias("text"))


@query("html_to_text")
def html_to_text(spark, sf_dir):
    return d.html_to_text(table(spark, sf_dir, "pages"))


L_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"

WORDS = ["license", "token", "worthless"]
LINE_SQL = "CASE WHEN contains(line, '→') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(line, '[0-9]') THEN 1 ELSE 0 END + " + " + ".join(f"CASE WHEN contains(line, '{w}') THEN 1 ELSE 0 END" for w in WORDS) + " - CASE WHEN len(regexp_extract_all(line, '[0-9\\s,.()/%-]')) / greatest(length(line), 1) > 0.6 THEN 3 ELSE 0 END"


@query("line_score", f"WITH {L_SQL} SELECT doc_id, line_no, CAST({LINE_SQL} AS BIGINT) AS score FROM l")
def line_score(spark, sf_dir):
    return out(d.lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", d.line_score(F.col("line"), WORDS).alias("score")))


@query("one_liner_score", f"WITH {L_SQL} SELECT doc_id, line_no, CAST({LINE_SQL} + CASE WHEN regexp_matches(line, '[.!?]$') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(line, '[,(]$|\\([^)]*$') THEN 1 ELSE 0 END AS BIGINT) AS score FROM l")
def one_liner_score(spark, sf_dir):
    return out(d.lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", d.one_liner_score(F.col("line"), WORDS).alias("score")))


@query("budgeted_bullets", f"""WITH {L_SQL}, x AS (SELECT DISTINCT doc_id, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM l), s AS (SELECT *, {LINE_SQL} AS score FROM x WHERE length(line) BETWEEN 8 AND 400),
t AS (SELECT *, CASE WHEN length(line) <= 220 THEN line ELSE rtrim(left(line, 219)) || '…' END AS cut FROM s),
r AS (SELECT *, row_number() OVER w AS rank, sum(length(cut)) OVER w AS used FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, line ROWS UNBOUNDED PRECEDING)) SELECT doc_id, rank, cut AS line, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 8 AND (rank <= 5 OR used <= 1200)""")
def budgeted_bullets(spark, sf_dir):
    return out(d.bullets(d.lines(table(spark, sf_dir, "documents")), WORDS), "doc_id", "rank", "line", "score")


@query("split_narrative", f"""WITH {L_SQL}, m AS (SELECT *, length(line) <= 80 AND regexp_matches(line, '^[EIL]') AS r, length(line) <= 80 AND regexp_matches(line, '^[A-D]') AS x FROM l), h AS (SELECT *, max(r::INT) OVER (PARTITION BY doc_id) = 1 AS has FROM m),
o AS (SELECT *, CASE WHEN has THEN r ELSE x END AS heading, has AND x AS inner_ FROM h) SELECT doc_id, line_no, heading, inner_ AS inner, CAST(sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section FROM o""")
def split_narrative(spark, sf_dir):
    return out(d.split_narrative(d.lines(table(spark, sf_dir, "documents")), "^[EIL]", "^[A-D]"), "doc_id", "line_no", "heading", "inner", "section")


@query("link_text_match")
def link_text_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    links = d.anchors(pages).select("page_id", "nth", F.col("text").alias("title"))
    texts = d.html_to_text(pages).select("page_id", F.posexplode(F.split("text", "\n")).alias("row", "text"))
    return d.link_text_match(links, texts.withColumn("row", F.col("row").cast("long")))


@query("post_view", """WITH l AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS no FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS s FROM documents)),
o AS (SELECT doc_id, line, row_number() OVER w AS k, lag(line, 2) OVER w AS above FROM (SELECT doc_id, no, CASE WHEN no IN (3, 9) AND doc_id % 3 <> 0 THEN '2024. ' || (no % 8 + 1) || '. ' || (doc_id % 28 + 1) || '.' ELSE line END AS line FROM l) WHERE trim(line) NOT IN ('', 'menu') WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
f AS (SELECT *, min(CASE WHEN regexp_matches(line, '^[0-9]{4}[.] ?[0-9]{1,2}[.] ?[0-9]{1,2}[.]') THEN k END) OVER (PARTITION BY doc_id) AS d FROM o)
SELECT doc_id, coalesce(max(above) FILTER (WHERE k = d), arg_max(line, length(line) * 10 - k) FILTER (WHERE k <= 8)) AS title, max(line) FILTER (WHERE k = d) AS date_line, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE k > coalesce(d, 0)), '') AS body FROM f GROUP BY 1""")
def post_view(spark, sf_dir):
    """Sentences as lines; in two documents of three the fourth and the tenth are dates."""
    rows = d.lines(table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n"))))
    no = F.col("line_no")
    date = F.concat(F.lit("2024. "), (no % 8 + 1).cast("string"), F.lit(". "), (F.col("doc_id") % 28 + 1).cast("string"), F.lit("."))
    return d.post_views(rows.withColumn("line", F.when(no.isin(3, 9) & (F.col("doc_id") % 3 != 0), date).otherwise(F.col("line"))), chrome=["menu"])
