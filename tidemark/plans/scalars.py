"""Queries of the column functions, over phrases, addresses and amounts made of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scalars as s
from tidemark.plans.registry import out, query, table

PHRASES = ("2024.3.5 기사", "방금", "3시간 전", "12 분 전", "어제", "하루 전", "4일 전", "12.31.x", "2024-02-30", "Tue, 05 Mar 2024 18:30:00 GMT", "5 Mar 2024 23:00:00 +0900", "<![CDATA[2023-11-01]]>", "12&#51;", "", "소식 없음", "1일 전")
LONG = ("2024년 3 월 5일 발간", "보고 2023/ 1/ 9 끝", "날짜 없음", "20240305")
AS_OF = "DATE '2024-01-10' + CAST(o_orderkey % 60 AS INTEGER)"


@query("news_dates", f"""WITH d AS (SELECT o_orderkey, {AS_OF} AS d, o_orderkey // 3 AS k FROM orders),
v AS (SELECT *, CASE k % 16 WHEN 0 THEN DATE '2024-03-05' WHEN 1 THEN d WHEN 2 THEN d WHEN 3 THEN d WHEN 4 THEN d - 1 WHEN 5 THEN d - 1 WHEN 6 THEN d - 4 WHEN 7 THEN DATE '2024-12-31' WHEN 9 THEN NULL WHEN 15 THEN d - 1 END AS named FROM d)
SELECT o_orderkey, named, CASE k % 16 WHEN 9 THEN DATE '2024-03-06' WHEN 10 THEN DATE '2024-03-05' WHEN 11 THEN DATE '2023-11-01' ELSE named END AS fed, CASE k % 4 WHEN 0 THEN DATE '2024-03-05' WHEN 1 THEN DATE '2023-01-09' ELSE d END AS reported, CASE k % 4 WHEN 3 THEN DATE '2024-03-05' END AS compact
FROM (SELECT * REPLACE (CASE WHEN k % 16 = 11 THEN DATE '2023-11-01' ELSE named END AS named) FROM v)""")
def news_dates(spark, sf_dir):
    k = F.call_function("div", F.col("o_orderkey"), F.lit(3))
    pick = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int"))
    day = F.date_add(F.lit("2024-01-10").cast("date"), (F.col("o_orderkey") % 60).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.news_date(pick(PHRASES), day).alias("named"), s.feed_date(pick(PHRASES), day).alias("fed"), s.report_date(pick(LONG), day).alias("reported"), s.compact_date(pick(LONG)).alias("compact"))


@query("address_parts", """WITH p AS (SELECT page_id, page_id % 4 AS k, 'b' || page_id % 7 AS b, 100000 + page_id AS n FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'https://m.blog.example.com/' || b || '/' || n WHEN 1 THEN 'https://m.blog.example.com/' || b || '/' || n ELSE 'http://blog.example.com/' || b END AS mobile, CASE k WHEN 0 THEN lpad(CAST(n AS VARCHAR), 6, '0') WHEN 1 THEN n || '.KS' END AS ticker,
  array_to_string(list_filter([b, 'other'], lambda x: x <> 'b3'), ',') AS named FROM p""")
def address_parts(spark, sf_dir):
    k, b, n = F.col("page_id") % 4, F.concat(F.lit("b"), (F.col("page_id") % 7).cast("string")), (F.col("page_id") + 100000).cast("string")
    base = "http://blog.example.com/"
    url = F.when(k == 0, F.concat(F.lit(base), b, F.lit("/"), n)).when(k == 1, F.concat(F.lit(f"{base}PostView.naver?x=1&blogId="), b, F.lit("&logNo="), n)).otherwise(F.concat(F.lit(f" {base}"), b))
    urls = F.array(F.lit("http://x/"), F.when(k == 0, F.concat(F.lit("http://f/item?code="), n)).when(k == 1, F.concat(F.lit("http://y/chart/"), n, F.lit(".ks"))).otherwise(F.lit("http://z/code=123456")))
    text = F.concat(F.lit(f"see {base}api, {base}"), b, F.lit(f" and {base}other {base}"), b)
    return table(spark, sf_dir, "pages").select("page_id", s.mobile_address(url, "blog.example.com").alias("mobile"), s.ticker_of(urls).alias("ticker"), F.array_join(s.named_paths(text, "blog.example.com", ["api", "PostList"], F.lit("b3")), ",").alias("named"))


@query("content_keys", """WITH x AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\t-\\r\\p{Z}\\x{FEFF}]+|[\\t-\\r\\p{Z}\\x{FEFF}]+$', '', 'g'), '', '') AS c, title FROM (SELECT doc_id, title, replace(text, chr(13) || chr(10), chr(10)) AS c FROM x))
SELECT doc_id, left(sha1(coalesce(title, '')), 12) AS short, sha256(c) AS settled_sha256 FROM n""")
def content_keys(spark, sf_dir):
    """Blanks are put before every line's end and empty lines at the text's, which the key must not see."""
    noisy = F.concat(F.replace("text", F.lit("\n"), F.lit("  \t\r\n")), F.lit("\n\n\n\n"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", s.short_key(F.coalesce(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("")), 12).alias("short"), F.sha2(s.settled(noisy), 256).alias("settled_sha256"))


@query("formats", """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS v, (o_orderkey % 401 - 200) / 8.0 AS r FROM orders)
SELECT o_orderkey, CASE WHEN v IS NULL THEN 'N/A' ELSE format('{:,}', CAST(floor(v + 0.5) AS BIGINT)) END AS whole, CASE WHEN v IS NULL THEN '—' WHEN o_orderkey % 2 = 0 THEN '$' || format('{:.2f}', v) ELSE '₩' || format('{:,}', CAST(floor(v + 0.5) AS BIGINT)) END AS price,
  CASE WHEN r >= 0 THEN '+' ELSE '−' END || format('{:.3f}', abs(r)) || '%' AS signed, format('{:.1f}', r * 100) || '%' AS share, format('{:.3f}', r) || 'x' AS times, CASE WHEN v IS NULL THEN 'N/A' ELSE CASE WHEN r >= 0 THEN '+' ELSE '−' END || format('{:,}', CAST(abs(floor(r * 1000 + 0.5)) AS BIGINT)) END AS amount FROM x""")
def formats(spark, sf_dir):
    k, r = F.col("o_orderkey"), (F.col("o_orderkey") % 401 - 200) / F.lit(8.0)
    v = F.when(k % 9 != 0, F.col("o_totalprice").cast("double"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", s.thousands(v).alias("whole"), s.price(v, F.when(k % 2 == 0, "USD")).alias("price"), s.signed_percent(r, 3).alias("signed"), s.percent(r, 1).alias("share"), s.ratio(r, 3).alias("times"), s.signed_amount(F.when(v.isNotNull(), r * 1000)).alias("amount")
    )
