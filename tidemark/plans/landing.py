"""Source and sink queries: test tables are landed in the shared folder in a source's format and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import documents as d
from tidemark.operators import fundamentals as f
from tidemark.operators import news
from tidemark.plans.fundamentals import V_SQL
from tidemark.plans.market import BARS_SQL, bars
from tidemark.plans.news import I_SQL, SCORE_SQL, items
from tidemark.plans.registry import out, query, table
from tidemark.plans.streams import drained
from tidemark.sources import landed
from tidemark.sources.shared import shared_dir
from tidemark.streaming import jobs


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("load_filings", "SELECT CAST(o_custkey AS VARCHAR) AS rcept_no, min(CAST(o_orderdate AS DATE)) AS filed, count(*) > 0 AS known FROM orders GROUP BY 1")
def load_filings(spark, sf_dir):
    """A page for each customer, its orders by date; the customer stands in for the receipt number."""
    o = table(spark, sf_dir, "orders")
    row = F.struct(F.col("o_custkey").cast("string").alias("rcept_no"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"), F.lit("c").alias("corp_code"), F.lit("c").alias("corp_name"), F.lit("s").alias("stock_code"), F.lit("r").alias("report_nm"), F.lit("f").alias("flr_nm"))
    pages = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", row.alias("r")))).alias("x")).select(F.lit("000").alias("status"), F.transform("x", lambda x: x["r"]).alias("list"))
    path = folder(spark, "filings")
    pages.write.json(path)
    return landed.load_filings(spark, path, page_per_file=False).select("rcept_no", "filed", F.col("rcept_no").isNotNull().alias("known"))


@query("load_listings", "SELECT p_name AS name, p_brand AS market, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS ticker, p_type AS industry, CAST(p_size AS VARCHAR) AS product FROM part")
def load_listings(spark, sf_dir):
    """Pages of at most 1,000 keys, so that their number grows with the table."""
    cell = lambda c: F.concat(F.lit("<td><b>"), c, F.lit("</b></td>"))
    p = table(spark, sf_dir, "part")
    row = F.concat(F.lit("<tr>"), *map(cell, (F.col("p_name"), F.col("p_brand"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.col("p_type"), F.col("p_size").cast("string"), F.lit("2020-01-02"), F.lit("12"))), F.lit("</tr>"))
    return landed.load_listings(p.groupBy(F.floor(F.col("p_partkey") / 1000).alias("page")).agg(F.array_join(F.collect_list(row), "\n").alias("html"))).select("name", "market", "ticker", "industry", "product")


@query("load_corp_codes", "SELECT CAST(s_nationkey AS VARCHAR) AS stock_code, max(lpad(CAST(s_suppkey AS VARCHAR), 8, '0')) AS corp_code FROM supplier GROUP BY 1")
def load_corp_codes(spark, sf_dir):
    code = F.lpad(F.col("s_suppkey").cast("string"), 8, "0")
    path = folder(spark, "codes")
    table(spark, sf_dir, "supplier").select(code.alias("corp_code"), F.col("s_name").alias("corp_name"), F.concat(F.lit(" "), "s_nationkey").alias("stock_code"), code.alias("modify_date")).write.format("xml").option("rowTag", "list").save(path)
    return landed.load_corp_codes(spark, path).select("stock_code", "corp_code")


@query("load_rss", "SELECT url, count(*) AS n FROM pages WHERE page_id % 3 > 0 GROUP BY 1")
def load_rss(spark, sf_dir):
    """Pages as feed items: a link, a guid in its place, or neither."""
    p, path = table(spark, sf_dir, "pages"), folder(spark, "feed")
    k = F.col("page_id") % 3
    feed = p.select(F.concat(F.lit("page "), "page_id").alias("title"), F.when(k == 1, F.col("url")).alias("link"), F.when(k == 2, F.col("url")).otherwise("none").alias("guid"))
    feed.write.format("xml").option("rowTag", "item").save(path)
    return landed.load_rss(spark, path).groupBy("url").agg(F.count("*").alias("n"))


@query("load_bars", f"WITH {BARS_SQL} SELECT ticker, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def load_bars(spark, sf_dir):
    """A chart for each ticker, as its source sends them."""
    prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    each = bars(spark, sf_dir).select("ticker", F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), *prices).alias("bar"))
    path = folder(spark, "charts")
    each.groupBy("ticker").agg(F.sort_array(F.collect_list("bar")).alias("bars")).write.json(path)
    return out(landed.load_bars(spark, path, chart_per_file=False), "ticker", "date", "open", "high", "low", "close", "volume")


@query("load_dimensions", "SELECT c_mktsegment AS segment, count(*) FILTER (WHERE c_custkey % 10 < 7) AS accepted, count(*) FILTER (WHERE c_custkey % 10 >= 7) AS rejected FROM customer GROUP BY 1")
def load_dimensions(spark, sf_dir):
    """Customers as a watchlist; some tickers lack a digit."""
    path, k = folder(spark, "watchlist"), F.col("c_custkey")
    ticker = F.lpad((k % 100000).cast("string"), F.when(k % 10 < 7, 6).otherwise(5), F.lit("0"))
    table(spark, sf_dir, "customer").select(ticker.alias("ticker"), F.col("c_mktsegment").alias("name")).write.json(path)
    sides = zip(landed.load_dimensions(spark, path, "ticker string, name string", {"ticker": "^[0-9]{6}$"}, one_per_file=False), (True, False), strict=True)
    rows = reduce(DataFrame.unionByName, (df.withColumn("ok", F.lit(ok)) for df, ok in sides))
    return rows.groupBy(F.col("name").alias("segment")).agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


@query("load_filing_endpoints", """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS corp_code, CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR) AS bsns_year, CASE WHEN o_orderkey % 3 = 0 THEN 'CFS' ELSE 'OFS' END AS fs_div FROM orders WHERE o_custkey % 10 > 0),
a AS (SELECT corp_code, bsns_year FROM r QUALIFY fs_div = min(fs_div) OVER (PARTITION BY corp_code, bsns_year)),
e AS (SELECT unnest(['shareholders', 'dividends', 'treasury', 'capital_changes', 'board']) AS endpoint) SELECT endpoint, bsns_year, count(*) AS n FROM e, r GROUP BY 1, 2 UNION ALL SELECT 'accounts', bsns_year, count(*) FROM a GROUP BY 2""")
def load_filing_endpoints(spark, sf_dir):
    """Orders as rows of six endpoints, a page for each customer; every tenth customer's page has no data."""
    o, path = table(spark, sf_dir, "orders"), folder(spark, "endpoints")
    status = F.when(F.col("o_custkey") % 10 == 0, "013").otherwise("000")
    keys = [F.col("o_custkey").cast("string").alias("corp_code"), F.year("o_orderdate").cast("string").alias("bsns_year"), F.lit("11011").alias("reprt_code")]
    for name, columns in landed.ENDPOINTS.items():
        values = {"fs_div": F.when(F.col("o_orderkey") % 3 == 0, "CFS").otherwise("OFS"), "thstrm_amount": F.col("o_totalprice").cast("string")}
        row = F.struct(*keys, *(values.get(c, F.lit("-")).alias(c) for c in columns))
        o.groupBy("o_custkey").agg(F.collect_list(row).alias("list")).select(status.alias("status"), "list").write.json(f"{path}/{name}")
    found = landed.load_filing_endpoints(spark, path, page_per_file=False)
    each = (df.groupBy("bsns_year").agg(F.count("*").alias("n")).withColumn("endpoint", F.lit(name)) for name, df in found.items())
    return reduce(DataFrame.unionByName, each).select("endpoint", "bsns_year", "n")


@query("load_memo_sections", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents), m AS (SELECT doc_id, line_no, CASE WHEN length(line) BETWEEN 1 AND 39 AND doc_id % 2 = 0 THEN '## ' || line ELSE line END AS line FROM l),
k AS (SELECT doc_id, line_no, regexp_replace(regexp_extract(line, '^(?:[-*]\s+)?([^#:：]+)[:：]\s*(.+?)\s*$', 1), '^\s+|\s+$', '', 'g') AS name, regexp_replace(regexp_extract(line, '^(?:[-*]\s+)?([^#:：]+)[:：]\s*(.+?)\s*$', 2), '^`|`$', '', 'g') AS value FROM m WHERE line_no < 40 AND regexp_matches(line, '^(?:[-*]\s+)?([^#:：]+)[:：]\s*(.+?)\s*$')),
s AS (SELECT *, regexp_matches(line, '^##\s+(.+?)\s*$') AS h, sum(regexp_matches(line, '^##\s+(.+?)\s*$')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS nth FROM m)
SELECT doc_id, 'metadata' AS kind, max(line_no) AS nth, name, arg_max(value, line_no) AS value FROM k GROUP BY doc_id, name
UNION ALL SELECT doc_id, 'section', CAST(nth AS BIGINT), max(CASE WHEN h THEN regexp_extract(line, '^##\s+(.+?)\s*$', 1) END), regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT h), ''), '^\s+|\s+$', '', 'g') FROM s WHERE nth > 0 GROUP BY doc_id, nth""")
def load_memo_sections(spark, sf_dir):
    """Short lines of every second document stand in for headings."""
    heading = F.length("line").between(1, 39) & (F.col("doc_id") % 2 == 0)
    memo = d.lines(table(spark, sf_dir, "documents")).withColumn("line", F.when(heading, F.concat(F.lit("## "), "line")).otherwise(F.col("line")))
    return out(d.memo_parts(memo), "doc_id", "kind", "nth", "name", "value")


@query("html_tables", """WITH p AS (SELECT p_partkey AS k, p_partkey // 1000 AS page_id, row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) AS row, p_name, p_brand, p_size FROM part),
c AS (SELECT page_id, row, unnest([0, 1, 2]) AS col, unnest([trim(p_name), CASE WHEN k % 7 = 0 THEN '' ELSE p_brand END, CASE WHEN k % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END]) AS text FROM p)
SELECT page_id, CAST(0 AS BIGINT) AS "table", row, CAST(col AS BIGINT) AS col, text FROM c UNION ALL SELECT DISTINCT page_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(unnest([0, 1, 2]) AS BIGINT), unnest(['name', 'brand', 'size']) FROM p""")
def html_tables(spark, sf_dir):
    """Parts as tables of at most 1,000 keys; some rows have one cell, some have four."""
    k, cell = F.col("p_partkey"), lambda c: F.concat(F.lit("<td><b>"), c, F.lit("</b></td>"))
    cells = F.concat(cell(F.col("p_name")), F.when(k % 7 == 0, "").otherwise(F.concat(cell(F.col("p_brand")), cell(F.col("p_size").cast("string")))), F.when(k % 7 == 1, cell(F.lit("more"))).otherwise(""))
    row = F.struct("p_partkey", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("html"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["html"]), "\n")
    page = F.concat(F.lit('<table class="x"><tr><th>name</th><th>brand</th><th>size</th></tr>'), body, F.lit("</table>"))
    pages = table(spark, sf_dir, "part").groupBy(F.floor(k / 1000).alias("page_id")).agg(page.alias("html"))
    return out(d.html_tables(pages))


@query("dedupe_listings", "SELECT CAST(p_size AS VARCHAR) AS ticker, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1")
def dedupe_listings(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("ticker"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    return news.first_wins(rows, ["ticker"], [F.asc("seq")]).select("ticker", "name")


@query("write_snapshot", "SELECT DATE '2024-01-01' + CAST(o_custkey % 3 AS INT) AS as_of, count(*) AS n FROM orders GROUP BY 1")
def write_snapshot(spark, sf_dir):
    """Each day's rows are written twice; the second write replaces the first."""
    path, o = folder(spark, "snapshots"), table(spark, sf_dir, "orders")
    for day in (0, 1, 2, 1):
        landed.write_snapshot(o.where(F.col("o_custkey") % 3 == day), path, f"2024-01-0{day + 1}")
    return spark.read.parquet(path).groupBy("as_of").agg(F.count("*").alias("n"))


@query("band_label", f"{V_SQL} SELECT ticker, metric, CASE WHEN percentile <= 33 THEN 'lower' WHEN percentile >= 67 THEN 'upper' ELSE 'middle' END AS label FROM b")
def band_label(spark, sf_dir):
    return f.valuation_bands(bars(spark, sf_dir), ["close", "volume"]).select("ticker", "metric", f.band_label(F.col("percentile")).alias("label"))


NEWS = ("코스피 마감", "SMR 원전 수주", "SMR 아파트 분양", "SMR 공급계약", "배터리 투자", "AI 부품", "제3자배정 유상증자 SMR")


@query("news_predicates", """WITH p AS (SELECT page_id, url, page_id % 7 AS k, page_id % 5 = 0 AS discovery FROM pages)
SELECT page_id, url <> '' AND NOT discovery AND NOT regexp_matches(url, '^[a-z]+://m\\.') AS direct, k = 0 AS market, k = 1 AS sector FROM p""")
def news_predicates(spark, sf_dir):
    """A planted headline of each page, of which the second alone is a sector's; mobile hosts stand in for the discovery host."""
    p = table(spark, sf_dir, "pages")
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://(m\\.[^/?#]*)", 1), F.lit(""))
    text = F.element_at(F.array(*map(F.lit, NEWS)), (F.col("page_id") % 7 + 1).cast("int"))
    terms = news.sector_terms("원전/AI 부품", ["가"], ["SMR", "AI"])
    return p.select("page_id", (news.is_direct(F.col("url"), F.col("page_id") % 5 == 0, "news.google.com") & (host == "")).alias("direct"), news.is_market(text).alias("market"), news.is_sector(text, terms).alias("sector"))


@query("dedupe_posts", f"WITH {I_SQL} SELECT source, headline, min(item_id) AS item_id FROM i GROUP BY 1, 2")
def dedupe_posts(spark, sf_dir):
    return news.first_wins(items(spark, sf_dir), ["source", "headline"], [F.asc("seq")]).select("source", "headline", "item_id")


@query("stream_news", f"WITH {I_SQL}, s AS (SELECT 'http://x/' || item_id AS url_key, CAST({SCORE_SQL.split(' - CASE')[0]} AS BIGINT) AS score FROM i WHERE item_id % 4 = 1) SELECT url_key, score FROM s")
def stream_news(spark, sf_dir):
    """Documents as items of four days, each sent twice with different tracking parameters."""
    from tidemark.plans.news import POINTS

    i, path = items(spark, sf_dir), folder(spark, "items")
    day = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("item_id") % 4) * 86_400)
    twice = F.explode(F.array(F.lit("utm_source=a"), F.lit("fbclid=b")))
    i.select("item_id", "text", day.alias("published_at"), twice.alias("p")).select("item_id", "text", "published_at", F.concat(F.lit("http://x/"), "item_id", F.lit("?"), "p").alias("url")).write.parquet(path)
    stream = spark.readStream.schema("item_id long, text string, published_at timestamp, url string").parquet(path)
    return out(drained(jobs.news(stream, F.lit("2024-01-02").cast("date"), POINTS)), "url_key", "score")
