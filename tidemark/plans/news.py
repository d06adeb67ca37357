"""News and source queries over documents (an item's text) and pages (its address)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import news
from tidemark.plans.registry import out, query, table

THEMES = [("(?i)the", "definite"), ("(?i)sch", "german"), ("(?i)eau", "french"), (r"\d", "numbers"), (r"[%&$#*]{3}", "junk")]
POINTS = [("(?i)tion", 8), ("(?i)ment", 7), (r"\d", 9), ("(?i)idiot", -24), ("License", 5)]
SECTORS = [("alpha", "thorreor"), ("alpha", "license"), ("beta", "eauxen"), ("beta", "keitbe"), ("gamma", "ciónte"), ("gamma", "the and")]
STOP = ["the", "and", "of", "de", "la", "le", "der", "die", "und"]

I_SQL = "i AS (SELECT doc_id AS item_id, doc_id AS seq, text, source, string_split(text, chr(10))[1] AS headline FROM documents)"
SCORE_SQL = " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {n} ELSE 0 END" for p, n in POINTS) + " - CASE WHEN NOT regexp_matches(text, '(?i)er') THEN 8 ELSE 0 END"


def items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("seq"), "text", "source", F.split("text", "\n")[0].alias("headline")).withColumn("score", news.pattern_score(F.col("text"), POINTS, "(?i)er", 8))


@query("news_score", f"WITH {I_SQL} SELECT item_id, CAST({SCORE_SQL} AS BIGINT) AS score FROM i")
def news_score(spark, sf_dir):
    return out(items(spark, sf_dir), "item_id", "score")


@query("rank_news", f"WITH {I_SQL}, s AS (SELECT *, {SCORE_SQL} AS score FROM i) SELECT item_id, CAST(score AS BIGINT) AS score FROM s WHERE score >= 1 ORDER BY s.score DESC, seq LIMIT 12")
def rank_news(spark, sf_dir):
    return out(news.ranked(items(spark, sf_dir), 12, 1), "item_id", "score")


@query("summary_theme", f"WITH {I_SQL} SELECT item_id, CASE {' '.join(f'''WHEN regexp_matches(text, '{p}') THEN '{n}' ''' for p, n in THEMES)} ELSE 'other' END AS theme FROM i")
def summary_theme(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", news.first_label(F.col("text"), THEMES, "other").alias("theme"))


EACH_THEME = " UNION ALL ".join(f"SELECT '{n}' AS theme, seq, headline FROM i WHERE regexp_matches(text, '{p}')" for p, n in THEMES)


NAMES, UP, DOWN = {"first": "thor", "second": "eaux"}, "(?i)er", "(?i)on"


def segment_sql(name: str, other: str) -> str:
    found = f"regexp_extract(text, '(?i){name}[^\\n.。]{{0,70}}')"
    return f"CASE WHEN instr({found}, '{other}') > 1 THEN left({found}, instr({found}, '{other}') - 1) ELSE {found} END"


@query("event_tags", f"""WITH {I_SQL}, s AS (SELECT item_id, text, {segment_sql('thor', 'eaux')} AS a, {segment_sql('eaux', 'thor')} AS b FROM i)
SELECT item_id, {', '.join(f"CASE WHEN regexp_matches({c}, '{UP}') THEN 'up' WHEN regexp_matches({c}, '{DOWN}') THEN 'down' ELSE '' END AS {n}_direction, regexp_extract({c}, '[0-9]+(?:[.][0-9]+)?%') AS {n}_percent" for c, n in (('a', 'first'), ('b', 'second')))},
array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for p, n in THEMES)}], lambda x: x IS NOT NULL)[:2], ', ') AS tags FROM s""")
def event_tags(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", *(c.alias(n) for n, c in news.event_tags(F.col("text"), NAMES, UP, DOWN, THEMES).items()))


@query("news_themes", f"""WITH {I_SQL}, e AS ({EACH_THEME}), f AS (SELECT theme, headline, min(seq) AS seq FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY seq) AS k FROM f),
h AS (SELECT theme, string_agg(headline, '|' ORDER BY seq) AS headlines FROM r WHERE k <= 5 GROUP BY 1) SELECT e.theme, count(*) AS n, any_value(headlines) AS headlines FROM e JOIN h ON h.theme = e.theme GROUP BY e.theme""")
def news_themes(spark, sf_dir):
    return news.theme_rollup(items(spark, sf_dir), THEMES).withColumn("headlines", F.array_join("headlines", "|"))


@query("sector_match", f"""WITH {I_SQL}, t AS (SELECT unnest({[s for s, _ in SECTORS]}) AS sector, unnest({[t for _, t in SECTORS]}) AS term), s AS (SELECT item_id, text, {SCORE_SQL} AS score FROM i),
m AS (SELECT DISTINCT sector, item_id, score FROM s JOIN t ON contains(lower(text), term)) SELECT sector, row_number() OVER (PARTITION BY sector ORDER BY score DESC, item_id) AS rank, item_id, CAST(score AS BIGINT) AS score FROM m QUALIFY rank <= 5""")
def sector_match(spark, sf_dir):
    terms = spark.createDataFrame(SECTORS, "sector string, term string")
    return out(news.sector_match(items(spark, sf_dir), terms), "sector", "rank", "item_id", "score")


@query("mentions", f"WITH {I_SQL} SELECT item_id, contains(lower(headline), 'thor') OR contains(lower(headline), 'eaux') AS in_title, contains(lower(left(text, 500)), 'thor') OR contains(lower(left(text, 500)), 'eaux') AS in_head FROM i")
def mentions(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", news.matches(F.col("headline"), ["thor", "eaux"]).alias("in_title"), news.matches(F.substring("text", 1, 500), ["thor", "eaux"]).alias("in_head"))


CHROME = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."]


@query("post_chrome_filter", f"WITH {I_SQL} SELECT item_id, left(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains({CHROME}, trim(x)) AND NOT regexp_matches(x, '^\\s*https?://\\S+\\s*$') AND trim(x) <> ''), chr(10)), 3000) AS text FROM i")
def post_chrome_filter(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", news.without_chrome(F.col("text"), CHROME).alias("text"))


@query("low_quality_summary_filter", f"WITH {I_SQL}, b AS (SELECT *, length(text) < 400 AS bad FROM i), c AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY source) AS good FROM b) SELECT item_id FROM c WHERE NOT bad OR good = 0")
def low_quality_summary_filter(spark, sf_dir):
    return news.good_summaries(items(spark, sf_dir), ["source"], F.length("text") < 400).select("item_id")


P_SQL = f"""{I_SQL}, p AS (SELECT source, item_id AS post_id, item_id % 3 + 1 AS page, CASE WHEN item_id % 11 <> 0 THEN DATE '2024-01-01' - CAST(item_id % 900 AS INT) END AS published, contains(lower(text), 'tion') AS relevant,
  CASE WHEN contains(lower(headline), 'ou') THEN 'ou' WHEN contains(lower(headline), 'ei') THEN 'ei' END AS anchor, contains(lower(headline), 'idiot') AS is_trading, len(regexp_extract_all(headline, '[,·/|]')) >= 3 AS is_listicle,
  contains(lower(headline), 'that') AS is_formulaic, contains(lower(headline), 'th') AS is_deep_tech, contains(lower(headline), 'en') AS is_stock, regexp_matches(headline, '^\\s*[\\[【(]') AS is_bracketed FROM i),
pf AS (SELECT *, relevant AND page = 1 AS found, relevant AND NOT is_trading AND NOT is_listicle AS single, row_number() OVER (PARTITION BY source ORDER BY published DESC NULLS LAST, post_id) AS nth FROM p),
m AS (SELECT source, count(*) AS posts, CAST(max(page) AS BIGINT) AS pages, count(*) FILTER (WHERE page = 1) AS page1, count(*) FILTER (WHERE page = 1 AND is_trading) AS page1_trading, count(*) FILTER (WHERE found) AS relevant, count(*) FILTER (WHERE found AND is_listicle) AS listicles,
  count(*) FILTER (WHERE found AND is_trading) AS trading, count(*) FILTER (WHERE found AND single) AS dedicated, count(*) FILTER (WHERE found AND single AND is_formulaic) AS dedicated_formulaic, count(*) FILTER (WHERE single AND is_deep_tech) AS deep_tech,
  count(published) FILTER (WHERE found) AS dated, count(*) FILTER (WHERE found AND DATE '2024-01-01' - published > 365) AS stale, min(published) AS oldest, max(published) AS newest, max(published) FILTER (WHERE found) AS latest, coalesce(string_agg(DISTINCT anchor, ',' ORDER BY anchor), '') AS anchors,
  count(*) FILTER (WHERE nth <= 20) AS timeline, count(*) FILTER (WHERE nth <= 20 AND is_stock) AS stock, count(*) FILTER (WHERE nth <= 20 AND is_bracketed) AS bracketed, count(*) FILTER (WHERE nth <= 20 AND is_formulaic) AS formulaic FROM pf GROUP BY 1)"""


def metrics(spark, sf_dir):
    title, id_ = F.col("headline"), F.col("item_id")
    has = lambda *terms: news.matches(title, list(terms))
    p = items(spark, sf_dir).select(
        "source", id_.alias("post_id"), (id_ % 3 + 1).alias("page"), F.when(id_ % 11 != 0, F.date_sub(F.lit("2024-01-01").cast("date"), (id_ % 900).cast("int"))).alias("published"),
        news.matches(F.col("text"), ["tion"]).alias("relevant"), F.when(has("ou"), "ou").when(has("ei"), "ei").alias("anchor"), has("idiot").alias("is_trading"), (F.regexp_count(title, F.lit("[,·/|]")) >= 3).alias("is_listicle"),
        has("that").alias("is_formulaic"), has("th").alias("is_deep_tech"), has("en").alias("is_stock"), title.rlike(r"^\s*[\[【(]").alias("is_bracketed"),
    )
    return news.source_metrics(p, "source", F.lit("2024-01-01").cast("date"))


@query("blogger_metrics", f"WITH {P_SQL} SELECT * FROM m")
def blogger_metrics(spark, sf_dir):
    return metrics(spark, sf_dir).withColumn("anchors", F.array_join("anchors", ","))


_GATES = "WHEN page1_trading / nullif(page1, 0) >= 0.5 THEN 'trading-shop' WHEN dated >= 3 AND stale / dated >= 0.8 THEN 'stale' WHEN dedicated < 3 AND timeline >= 5 AND stock / timeline < 0.5 THEN 'off-topic' WHEN timeline >= 5 AND formulaic / timeline >= 0.7 THEN 'farm' WHEN dedicated >= 2 AND dedicated_formulaic / dedicated >= 0.7 THEN 'dedicated-farm'"


@query("blogger_gates", f"""WITH {P_SQL}, g AS (SELECT source, CASE {_GATES} WHEN dedicated < 2 AND NOT (anchors <> '' AND dedicated >= 1) THEN 'too-few' END AS reason, CASE {_GATES} WHEN deep_tech < 1 THEN 'no-deep-post' END AS deep_reason FROM m) SELECT source, reason, reason IS NULL AS accepted, deep_reason FROM g""")
def blogger_gates(spark, sf_dir):
    both = news.source_gates(metrics(spark, sf_dir))
    return news.source_gates(both.withColumnsRenamed({"reason": "r", "accepted": "a"}), deep=True).select("source", F.col("r").alias("reason"), F.col("a").alias("accepted"), F.col("reason").alias("deep_reason"))


@query("rank_bloggers", f"WITH {P_SQL} SELECT source, row_number() OVER (ORDER BY anchors <> '' DESC, dedicated DESC, relevant DESC, pages DESC, latest DESC NULLS LAST, source) AS rank, row_number() OVER (ORDER BY deep_tech DESC, dedicated DESC, relevant DESC, pages DESC, latest DESC NULLS LAST, source) AS deep_rank FROM m")
def rank_bloggers(spark, sf_dir):
    usual = news.ranked_sources(metrics(spark, sf_dir), "source")
    return out(news.ranked_sources(usual.withColumnRenamed("rank", "usual"), "source", deep=True).withColumnsRenamed({"rank": "deep_rank", "usual": "rank"}), "source", "rank", "deep_rank")


@query("candidate_pool", f"WITH {P_SQL}, s AS (SELECT source, relevant AS hits, trading > 3 AS anchored FROM m) SELECT * FROM (SELECT source FROM s WHERE NOT anchored ORDER BY hits DESC, source LIMIT 10) UNION SELECT source FROM s WHERE anchored")
def candidate_pool(spark, sf_dir):
    s = metrics(spark, sf_dir).select("source", F.col("relevant").alias("hits"), (F.col("trading") > 3).alias("anchored"))
    return news.candidate_pool(s).select("source")


@query("source_coverage", f"WITH {P_SQL} SELECT source, posts, oldest, newest AS latest FROM m")
def source_coverage(spark, sf_dir):
    return metrics(spark, sf_dir).select("source", "posts", "oldest", F.col("newest").alias("latest"))


@query("same_date_news", f"WITH {I_SQL}, d AS (SELECT item_id, CASE WHEN item_id % 10 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(item_id % 5 AS INT) END AS published FROM i) SELECT count(*) FILTER (WHERE published IS NULL) AS missing_date, count(*) FILTER (WHERE published <> DATE '2024-01-03') AS other_date, count(*) FILTER (WHERE published = DATE '2024-01-03') AS kept FROM d")
def same_date_news(spark, sf_dir):
    d = items(spark, sf_dir).withColumn("published", F.when(F.col("item_id") % 10 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") % 5).cast("int"))))
    return news.same_date(d, F.lit("2024-01-03").cast("date"))[1]


@query("coerce_numbers", "WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1,2' || (o_orderkey % 1000) WHEN 1 THEN '-' WHEN 2 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS t FROM orders) SELECT o_orderkey, try_cast(regexp_replace(t, '[,\\s]', '', 'g') AS DOUBLE) AS n FROM x")
def coerce_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    t = F.when(k % 4 == 0, F.concat(F.lit("1,2"), k % 1000)).when(k % 4 == 1, "-").when(k % 4 == 2, " ").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", news.number_of(t).alias("n"))


@query("url_keys", r"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[^=&]*|fbclid|gclid|ncid|sid|session|tracking)=[^&#]*', '\1', 'g'), '[?&]+$', '')) AS key FROM pages")
def url_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", news.url_key(F.concat("url", F.when(F.contains("url", F.lit("?")), "&utm_source=x#top").otherwise("?utm_source=x&fbclid=1#top"))).alias("key"))


@query("dedupe_urls", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY 1")
def dedupe_urls(spark, sf_dir):
    return news.first_wins(table(spark, sf_dir, "pages"), ["url"], [F.asc("page_id")]).select("url", "page_id")


_ADDRESS = "CASE WHEN item_id % 13 <> 5 THEN 'https://News.example/' || source || '/' || (length(text) % 211) END"


@query("dedupe_news", f"""WITH RECURSIVE {I_SQL}, a AS (SELECT seq, item_id, lower(trim(regexp_replace(headline, '\\s+', ' ', 'g'))) AS h, lower({_ADDRESS}) AS u FROM i),
k AS (SELECT seq, item_id, coalesce('url:' || u, 'headline:' || coalesce(h, '')) AS k1, CASE WHEN coalesce(h, '') <> '' THEN 'headline:' || h END AS k2, row_number() OVER (ORDER BY seq) AS n FROM a),
s AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS seen, NULL::BIGINT AS item_id, false AS kept
  UNION ALL SELECT k.n, CASE WHEN list_contains(seen, k1) OR coalesce(list_contains(seen, k2), false) THEN seen ELSE list_concat(seen, list_filter([k1, k2], lambda x: x IS NOT NULL)) END, k.item_id, NOT (list_contains(seen, k1) OR coalesce(list_contains(seen, k2), false))
  FROM s JOIN k ON k.n = s.n + 1)
SELECT item_id FROM s WHERE kept""")
def dedupe_news(spark, sf_dir):
    """Items' addresses are made of source and length, some with tracking parameters, some missing."""
    i, id_ = items(spark, sf_dir), F.col("item_id")
    address = F.concat(F.lit("https://News.example/"), "source", F.lit("/"), (F.length("text") % 211).cast("string"), F.when(id_ % 3 == 0, "?utm_source=a&fbclid=1#top").otherwise(""))
    url, headline = news.news_keys(F.when(id_ % 13 != 5, address), F.col("headline"))
    return news.deduped(i.select("seq", "item_id", url.alias("url_key"), headline.alias("headline_key")), ["url_key", "headline_key"]).select("item_id")


@query("news_report", f"""WITH {I_SQL}, e AS (SELECT *, {SCORE_SQL} AS score, CASE WHEN item_id % 10 <> 0 THEN DATE '2024-01-01' + CAST(item_id % 5 AS INT) END AS published, item_id % 4 = 1 AS discovery FROM i), y AS (SELECT * FROM e WHERE published = DATE '2024-01-03'), s AS (SELECT * FROM y WHERE NOT discovery),
t AS (SELECT unnest({[s for s, _ in SECTORS]} || ['empty']) AS sector, unnest({[t for _, t in SECTORS]} || ['no such word']) AS term),
m AS (SELECT sector, item_id, row_number() OVER (PARTITION BY sector ORDER BY score DESC, item_id) AS rank FROM (SELECT DISTINCT sector, item_id, score FROM s JOIN t ON contains(lower(text), term)) QUALIFY rank <= 5),
b AS (SELECT * FROM s WHERE score >= 60 ORDER BY score DESC, seq LIMIT 12)
SELECT 'market' AS part, 'all' AS name, row_number() OVER (ORDER BY score DESC, seq) AS rank, item_id, NULL::BIGINT AS n FROM b UNION ALL SELECT 'sector', d.sector, rank, item_id, NULL FROM (SELECT DISTINCT sector FROM t) d LEFT JOIN m ON m.sector = d.sector
UNION ALL SELECT 'discovery', 'all', row_number() OVER (ORDER BY seq), item_id, NULL FROM y WHERE discovery UNION ALL SELECT 'role', source, NULL, NULL, count(*) FROM y GROUP BY source
UNION ALL SELECT 'missing-date', source, NULL, NULL, count(*) FROM e WHERE published IS NULL GROUP BY source UNION ALL SELECT 'other-date', source, NULL, NULL, count(*) FROM e WHERE published <> DATE '2024-01-03' GROUP BY source
UNION ALL SELECT 'warning', 'few-market-items', NULL, NULL, n FROM (SELECT count(*) AS n FROM b) WHERE n < 5""")
def news_report(spark, sf_dir):
    terms = spark.createDataFrame([*SECTORS, ("empty", "no such word")], "sector string, term string")
    id_ = F.col("item_id")
    dated = items(spark, sf_dir).withColumns({"published": F.when(id_ % 10 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (id_ % 5).cast("int"))), "discovery": id_ % 4 == 1})
    return out(news.report(dated, terms, F.lit("2024-01-03").cast("date"), "source", least=60))
