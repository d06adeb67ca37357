"""Evidence queries over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import documents as d
from tidemark.operators import evidence as ev
from tidemark.operators import fundamentals, news, screen
from tidemark.plans.documents import ANCHOR
from tidemark.plans.fundamentals import R_SQL, reports
from tidemark.plans.market import LENS_SQL, U_SQL, scores
from tidemark.plans.news import I_SQL, items
from tidemark.plans.registry import out, query, table

A_SQL = f"""a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS href, unnest(regexp_extract_all(html, '{ANCHOR}', 2)) AS t, unnest(range(len(regexp_extract_all(html, '{ANCHOR}', 1)))) AS nth FROM pages),
b AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS source, href, nth, trim(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM a)"""


def links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return d.anchors(pages).join(pages.select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("source")), "page_id")


@query("roundup_refs", f"WITH {A_SQL}, p AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY page_id) AS k, lower(regexp_extract(href, '^(?:https?://[^/?#]+)?/([A-Za-z0-9_-]+)', 1)) AS target FROM b) SELECT DISTINCT source, target FROM p WHERE k <= 3 AND target NOT IN ('', 'the', 'and') AND target <> lower(source)")
def roundup_refs(spark, sf_dir):
    return ev.references(links(spark, sf_dir).withColumnRenamed("page_id", "page"), ["the", "and"])


@query("update_merge", """WITH o AS (SELECT o_custkey % 50 AS memo, CAST(o_orderdate AS DATE) AS day, o_orderpriority || (o_orderkey % 40) AS event, o_orderkey % 3 AS side FROM orders), k AS (SELECT memo, day, min(event) AS event FROM o WHERE side > 0 GROUP BY 1, 2), n AS (SELECT memo, day, min(event) AS event FROM o WHERE side = 0 GROUP BY 1, 2),
f AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.memo = n.memo AND k.event = n.event AND k.day <> n.day)) SELECT * FROM f UNION ALL SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.memo = k.memo AND f.day = k.day)""")
def update_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("memo"), F.to_date("o_orderdate").alias("day"), F.concat("o_orderpriority", F.col("o_orderkey") % 40).alias("event"), (F.col("o_orderkey") % 3).alias("side"))
    side = lambda rule: o.where(rule).groupBy("memo", "day").agg(F.min("event").alias("event"))
    return ev.merged_updates(side("side > 0"), side("side = 0"))


@query("external_views", f"WITH {I_SQL}, {R_SQL}, u AS (SELECT source AS name, 'blogger' AS role, 'unverified' AS verification FROM i UNION ALL SELECT broker, 'broker', 'titled' FROM r) SELECT name, role, verification, count(*) AS n FROM u GROUP BY ALL")
def external_views(spark, sf_dir):
    return ev.external_views(items(spark, sf_dir), reports(spark, sf_dir)).groupBy("name", "role", "verification").agg(F.count("*").alias("n"))


@query("post_selection", f"""WITH {I_SQL}, m AS (SELECT *, contains(lower(headline), 'thor') AS t, contains(lower(left(text, 500)), 'eaux') AS h FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t DESC, seq) AS rank FROM m) SELECT source, item_id, rank FROM r WHERE rank <= 5 AND (t OR h)""")
def post_selection(spark, sf_dir):
    got = ev.selected_posts(items(spark, sf_dir), news.matches(F.col("headline"), ["thor"]), news.matches(F.substring("text", 1, 500), ["eaux"]))
    return out(got, "source", "item_id", "rank")


NOTES = [("(?i)license", "license"), (r"\|", "table"), (r"[%&$#*]{3}", "junk"), (r"\d", "numbers"), ("(?i)sch", "german")]


@query("collection_notes", f"""WITH {I_SQL}, n AS (SELECT DISTINCT source AS run, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for p, n in NOTES)} END AS note FROM i) SELECT run, row_number() OVER (PARTITION BY run ORDER BY list_position({[n for _, n in NOTES]}, note)) AS rank, note FROM n WHERE note IS NOT NULL QUALIFY rank <= 4""")
def collection_notes(spark, sf_dir):
    return out(ev.notes(items(spark, sf_dir).select(F.col("source").alias("run"), F.col("text").alias("warning")), NOTES))


@query("leader_names", f"{U_SQL}, {LENS_SQL('u', 3)}, o AS (SELECT ticker, min((list_position(['short', 'intermediate', 'structural'], lens), rank)) AS k FROM lu WHERE lens <> 'composite' GROUP BY 1) SELECT row_number() OVER (ORDER BY k) AS nth, ticker FROM o QUALIFY nth <= 8")
def leader_names(spark, sf_dir):
    return out(ev.leader_names(screen.lens_rankings(scores(spark, sf_dir), 3)))


@query("ordinary_shares", "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(regexp_replace(p_name, '\\s+', '', 'g'), 'ring$') AND NOT regexp_matches(regexp_replace(p_name, '\\s+', '', 'g'), '^(hot|cold)')")
def ordinary_shares(spark, sf_dir):
    return ev.ordinary_shares(table(spark, sf_dir, "part"), ["ring$", "^(hot|cold)"], "p_name").select("p_partkey", "p_name")


@query("normalize_ticker", "WITH t AS (SELECT s_suppkey, s_name || ' ' || s_nationkey AS t FROM supplier UNION ALL SELECT -1 - s_suppkey, ' x' || s_nationkey || ' ' FROM supplier) SELECT s_suppkey, coalesce(nullif(regexp_extract(t, '([0-9]{6})', 1), ''), trim(t)) AS ticker FROM t")
def normalize_ticker(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    t = s.select("s_suppkey", F.concat("s_name", F.lit(" "), "s_nationkey").alias("t")).unionByName(s.select((-1 - F.col("s_suppkey")).alias("s_suppkey"), F.concat(F.lit(" x"), "s_nationkey", F.lit(" ")).alias("t")))
    return t.select("s_suppkey", ev.normal_ticker(F.col("t")).alias("ticker"))


@query("lookback", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR CAST(o_orderdate AS DATE) BETWEEN DATE '2000-06-30' - 365 AND DATE '2000-06-30'")
def lookback(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate")).alias("day"))
    return ev.within_lookback(o, "day", F.lit("2000-06-30").cast("date"), 365).select("o_orderkey")


@query("date_chunks", "WITH r AS (SELECT o_orderpriority AS corp, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders GROUP BY 1), c AS (SELECT corp, z, a + CAST(unnest(range(0, CAST(z - a AS BIGINT) + 1, 80)) AS INTEGER) AS chunk_start FROM r) SELECT corp, chunk_start, least(chunk_start + 79, z) AS chunk_end FROM c")
def date_chunks(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("corp")).agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return fundamentals.date_chunks(r, 80)


ALIASES = [("one", "that"), ("one", "that this"), ("two", "with"), ("three", "Orre"), ("three", "elle"), ("four", "제프리스")]
#: What an article says after the text of its document, by the remainder of its id by 8.
SAID = [
    "\n\n제프리스는 목표주가를 @원으로 상향, 투자의견 매수", "\n\nwith a target price of @, strong buy. 2024년 3월 5일", "\n\nthat said, TP @원 and 비중확대 2024-01-09\n\nelse", "\n\nOrre: 목표주가 8.5만원, Equal-weight",
    " with 목표가 99 원, target price: @ or hold",
]


def _broker_sql() -> str:
    said = " ".join(f"WHEN {i} THEN replace('{x}', '@', CAST(100000 + item_id AS VARCHAR))" for i, x in enumerate(SAID))
    believed = lambda v: f"CASE WHEN {v} >= 100 AND {v} < 100000000 THEN {v} END"
    def price(x: str) -> str:
        whole = [believed(f"try_cast(replace(regexp_extract({x}, '{p}', 1), ',', '') AS BIGINT)") for p in ev.PRICE_FORMS]
        return ", ".join([*whole, believed(f"CAST(round(try_cast(regexp_extract({x}, '{ev.TEN_THOUSANDS_FORM}', 1) AS DOUBLE) * 10000) AS BIGINT)")])
    case = lambda x, p, n: f"WHEN regexp_matches({x}, '{p}') THEN '{n}'"
    rating = lambda x: f"CASE {' '.join(case(x, p, n) for p, n in ev.RATING_FORMS)} END"
    def date(x: str) -> str:
        part = lambda p, i: f"regexp_extract({x}, '{p}', {i})"
        return "try_cast(coalesce(" + ", ".join(f"CASE WHEN {part(p, 1)} <> '' THEN {part(p, 1)} || '-' || lpad({part(p, 2)}, 2, '0') || '-' || lpad({part(p, 3)}, 2, '0') END" for p in ev.DATE_FORMS) + ") AS DATE)"
    blank = "chr(10) || chr(10)"
    return f"""WITH {I_SQL}, ar AS (SELECT item_id AS article_id, text || CASE item_id % 8 {said} ELSE '' END AS text, CASE WHEN item_id % 3 <> 0 THEN DATE '2024-01-01' + CAST(item_id % 30 AS INTEGER) END AS published FROM i),
al AS (SELECT unnest({[b for b, _ in ALIASES]}) AS broker, unnest({[a for _, a in ALIASES]}) AS alias),
m AS (SELECT *, CASE WHEN NOT regexp_matches(alias, '^[a-zA-Z ]+$') THEN instr(text, alias) WHEN regexp_matches(text, '(?:^|[^A-Za-z0-9])' || alias || '(?:[^A-Za-z0-9]|$)') THEN length(regexp_extract(text, '(?s)^(|.*?[^A-Za-z0-9])' || alias || '(?:[^A-Za-z0-9]|$)', 1)) + 1 ELSE 0 END AS pos FROM ar JOIN al ON contains(text, alias)),
h AS (SELECT *, left(text, pos - 1) AS before, substr(text, pos + length(alias)) AS after FROM m WHERE pos > 0 QUALIFY row_number() OVER (PARTITION BY article_id, broker ORDER BY pos, length(alias) DESC, alias) = 1),
n AS (SELECT *, CASE WHEN contains(before, {blank}) OR contains(after, {blank}) THEN string_split(before, {blank})[-1] || alias || string_split(after, {blank})[1] ELSE substr(text, greatest(1, pos - 200), pos + 200 - greatest(1, pos - 200)) END AS near FROM h), f AS (SELECT *, trim(regexp_replace(near, '\\s+', ' ', 'g')) AS flat FROM n)
SELECT article_id, broker, alias, coalesce({price('near')}, {price('text')}) AS target_price, coalesce({rating('near')}, {rating('text')}) AS rating, coalesce({date('near')}, published, {date('text')}) AS report_date, CASE WHEN length(flat) <= 240 THEN flat ELSE trim(left(flat, 239)) || '…' END AS thesis FROM f"""


@query("broker_views_extract", _broker_sql())
def broker_views_extract(spark, sf_dir):
    aliases = spark.createDataFrame(ALIASES, "broker string, alias string")
    rest, number = F.col("item_id") % 8, (100000 + F.col("item_id")).cast("string")
    said = F.coalesce(*(F.when(rest == i, F.replace(F.lit(x), F.lit("@"), number)) for i, x in enumerate(SAID)), F.lit(""))
    published = F.when(F.col("item_id") % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") % 30).cast("int")))
    return out(ev.broker_views_extract(items(spark, sf_dir).select(F.col("item_id").alias("article_id"), F.concat("text", said).alias("text"), published.alias("published")), aliases))


@query("memo_public_view", f"WITH {I_SQL} SELECT item_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)license|token')), chr(10)) AS text FROM i")
def memo_public_view(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", ev.public_view(F.col("text"), ["license", "token"]).alias("text"))


@query("nickname_filter", f"""WITH {I_SQL}, q AS (SELECT source AS company, source || ' ' || string_split(headline, ' ')[1] AS query FROM i), t AS (SELECT company, regexp_replace(trim(regexp_replace(query, '(?i)^' || company || '\\s+', '')), '(,|[.])$', '') AS tail FROM q)
SELECT DISTINCT company, tail FROM t WHERE length(tail) >= 2 AND lower(tail) NOT IN ('été') AND NOT regexp_matches(tail, '^[\\x00-\\x7F]+$')""")
def nickname_filter(spark, sf_dir):
    q = items(spark, sf_dir).select(F.col("source").alias("company"), F.concat("source", F.lit(" "), F.split("headline", " ")[0]).alias("query"))
    return ev.nicknames(q, ["été"], r",|\.")
