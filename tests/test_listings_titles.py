import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import documents, listings, news, scalars, spread, titles


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


BLOCK = ["2024-03-05", "엘앤에프(066970) 회복", "엘앤에프(066970) 회복", "회복", "120,000", "Buy", "김", "증권"]


def test_report_blocks_do_not_overlap(spark):
    inner = ["2024-03-06", "a", "2024-03-07", "b", "1,000", "Buy", "7", "Hold", "c", "d", "e"]
    text = "\r\n".join(["menu", "", *BLOCK, " ", *inner, "2024-03-08", "x", "y", "z", "n/a", "Buy", "k", "b", "2024-99-99", "t", "t", "t", "0", "Strong Buy", "a", "b", "2024-03-09", "cut"])
    got = listings.report_facts(listings.report_rows(docs(spark, text))).orderBy("line").collect()
    assert [(r["line"], r["published"], r["title"], r["target_price"], r["rating"], r["broker"]) for r in got] == [
        (1, dt.date(2024, 3, 5), "회복", 120000.0, "Buy", "증권"), (9, dt.date(2024, 3, 6), "a", 1000.0, "Buy", "Hold"), (28, None, "t", None, "Strong Buy", "b"),
    ]


def test_rows_above_dates_pass_over_icons(spark):
    text = "제목\n종목\n>\n\n증권사\n-\n2024.3.5\nx\n2024/03/06\n" + "\n" * 11 + "2024-03-07"
    got = [(r["line"], r["broker"], r["company"], r["title"]) for r in listings.rows_above_dates(docs(spark, text)).orderBy("line").collect()]
    assert got == [(6, "증권사", "종목", "제목"), (8, "2024.3.5", "증권사", "종목"), (20, None, None, None)]


def test_files_belong_to_the_report_above(spark):
    text = "PDF → http://f/0.pdf\na → http://s/read?nid=1\nPDF → http://f/1.pdf\nPDF → http://f/2.pdf\nother → http://x\nb → http://s/read?nid=2\nc → http://s/read?nid=3&p=1\nPDF → http://f/3.PDF?x=1"
    got = [(r["nth"], r["report_id"], r["title"], r["pdf_url"]) for r in listings.report_links(docs(spark, text), r"http://s/read\?nid=(\d+)").orderBy("nth").collect()]
    assert got == [(0, "1", "a", "http://f/1.pdf"), (1, "2", "b", None), (2, "3", "c", "http://f/3.PDF?x=1")]


def test_search_hits_take_title_snippet_and_date_around(spark):
    text = "긴 제목입니다\n짧\nhttp://s/p1\n짧음\n이것은 충분히 긴 요약입니다\n2024.3.5.\nhttp://s/p1\nhttp://s/p2"
    got = {r["url"]: (r["line"], r["title"], r["snippet"], r["published"]) for r in listings.search_hits(docs(spark, text), "http://s/[a-z0-9]+").collect()}
    assert got == {"http://s/p1": (2, "긴 제목입니다", "이것은 충분히 긴 요약입니다", dt.date(2024, 3, 5)), "http://s/p2": (7, "2024.3.5.", "", dt.date(2024, 3, 5))}


def test_headlines_of_links_and_of_one_text(spark):
    links = "국내 증시 상승 마감했다 → https://press/1\n국내 증시 상승 마감했다 → https://press/2\n블로그 글의 제목입니다 → http://blog.naver.com/a\nonly english headline → https://press/3\n짧은 제목 → https://press/4\n네이버 뉴스 기사 제목입니다 → https://news.naver.com/x\n네이버 뉴스 첫 화면입니다 → https://news.naver.com"
    assert [(r["nth"], r["headline"]) for r in listings.linked_headlines(docs(spark, links, None)).collect()] == [(0, "국내 증시 상승 마감했다"), (1, "네이버 뉴스 기사 제목입니다")]
    text = listings.ARTICLE_MARK.join(["코스피가 오늘 크게 올랐다. 이어지는 문장이 있다", "짧다", "마침표가 없는 기사 " + "가" * 120, "코스피가 오늘 크게 올랐다. 다른 문장이 이어진다", "english only text. and more of it"])
    assert [r["headline"] for r in listings.split_headlines(docs(spark, text)).orderBy("nth").collect()] == ["코스피가 오늘 크게 올랐다", "마침표가 없는 기사 " + "가" * 89]


def test_report_keys(spark):
    df = spark.createDataFrame([("한국 증권!", "2024-03-05", " 제목: (상)", None), (None, None, None, ""), ("a", None, "b", "77")], "b string, d string, t string, i string")
    got = [r[0] for r in df.select(listings.report_key("site", F.col("b"), F.col("d").cast("date"), F.col("t"), F.col("i"))).collect()]
    assert got == ["site-한국-증권-2024-03-05-제목-상", "site-unknown-na-untitled", "site-77"]


@pytest.mark.parametrize(
    ("title", "company", "found"),
    [
        ("삼성전자 차트로 보는 매매", "삼성전자", {"is_trading", "is_stock"}), ("반도체 조선 방산 정리해 봄", "x", {"is_listicle"}), ("반도체 조선 방산", "방산", set()), ("a, b, c / d", "x", {"is_listicle"}), ("[특징주] 강세", "x", {"is_bracketed"}),
        ("지금 사도 될까", "x", {"is_formulaic"}), ("차세대 공정", "x", {"is_deep_tech"}), ("오늘 차세대 공정", "x", set()), ("3인 3색 활용법", "x", {"is_roundup"}), ("엘앤에프 블로거 이야기", "엘앤에프", {"is_roundup"}),
        ("엘앤에프 블로거 이야기", None, set()), ("가" * 30 + " 회사 " + "나" * 10, "회사", {"is_listicle"}), (None, "x", set()),
    ],
)
def test_title_classes(spark, title, company, found):
    df = spark.createDataFrame([(title, company)], "t string, c string")
    row = df.select(*(v.alias(k) for k, v in titles.title_classes(F.col("t"), F.col("c")).items())).first()
    assert {k for k, v in row.asDict().items() if v} == found


def test_tokens_without_particles(spark):
    text = "삼성전자는 반도체에서 HBM을 “양산”한다… 12,000원 30% 5일 상승한 수율(수율) 삼성 IR 기록했다."
    df = spark.createDataFrame([(text, "삼성전자", "005930"), (None, "a", "b")], "t string, c string, k string")
    got = [r[0] for r in df.select(titles.tokens(F.col("t"), ["IR", "기록했다"], F.col("c"), F.col("k"))).collect()]
    assert got == [["반도체", "HBM", "양산", "한다", "상승한", "수율", "수율"], None]


def test_words_and_pairs_are_ranked_together(spark):
    got = titles.ngrams(docs(spark, "red fox red fox", "red fox, blue", "blue fox"), [], least=2, most=4).orderBy("rank").collect()
    assert [(r["term"], r["count"]) for r in got] == [("fox", 4), ("red", 3), ("red fox", 3), ("blue", 2)]


def test_product_terms_count_table_cells_again(spark):
    df = spark.createDataFrame([("a", "양극재 양극재 HBM x\n| 양극재는 SMR | HBM |\n|긴이름의제품군들|")], "c string, text string")
    got = [(r["term"], r["count"]) for r in titles.product_terms(df, ["핵심"], ["c"]).orderBy("rank").collect()]
    assert got == [("양극재", 4), ("HBM", 3), ("SMR", 2)]


def test_query_sets(spark):
    texts = spark.createDataFrame([("가나", "양극재 양극재 HBM HBM"), ("가나", "수주 수주 수주")], "company string, text string")
    memos = spark.createDataFrame([("가나", "# 핵심\n## Key 변수\nSMR은 실적\n# 기타\n수율 수율"), ("다라", "## 리스크\n원가 " + "x" * 500 + " 원가")], "company string, text string")
    companies = spark.createDataFrame([("가나",), ("다라",), ("다라",)], "company string")
    contexts = titles.context_terms(memos, [], "company")
    assert sorted((r["company"], r["term"], r["count"]) for r in contexts.collect()) == [("가나", "SMR", 2), ("가나", "기타", 2), ("가나", "수율", 4), ("가나", "실적", 2)]
    got = titles.query_set(companies, titles.product_terms(texts, [], ["company"]), titles.headline_terms(texts, [], "company"), contexts)
    assert [(r["company"], r["query"], r["source"]) for r in got.orderBy("company", "rank").collect()] == [
        ("가나", "가나 투자 분석", "base"), ("가나", "가나 실적", "base"), ("가나", "가나 수주", "product"), ("가나", "가나 HBM", "product"), ("가나", "가나 양극재", "product"), ("가나", "가나 수율", "context"), ("가나", "가나 SMR", "context"), ("가나", "가나 기타", "context"),
        ("다라", "다라 투자 분석", "base"), ("다라", "다라 실적", "base"), ("다라", "다라 주요 제품", "fallback"),
    ]


def test_company_tokens(spark):
    df = spark.createDataFrame([("SK-하이닉스 반도체주 LG&H 주가 LG&H 가",)], "t string")
    assert df.select(titles.company_tokens(F.col("t"), ["반도체", "주가"])).first()[0] == ["SK-하이닉스", "LG&H"]


def test_sources_with_anchors_rank_first(spark):
    rows = [("a", [], 9, 9, 1, None, 0), ("b", ["x"], 1, 1, 1, None, 0), ("c", [], 9, 9, 3, None, 5), ("d", ["x"], 1, 1, 1, dt.date(2024, 1, 1), 5)]
    df = spark.createDataFrame(rows, "source string, anchors array<string>, dedicated int, relevant int, pages int, latest date, deep_tech int")
    assert [r["source"] for r in news.ranked_sources(df, "source").orderBy("rank").collect()] == ["d", "b", "c", "a"]
    assert [r["source"] for r in news.ranked_sources(df, "source", deep=True).orderBy("rank").collect()] == ["c", "d", "a", "b"]


def test_five_bullets_whatever_the_budget(spark):
    lines = [f"{'가' * 20} {i} →" for i in range(8)] + ["z" * 300]
    got = documents.bullets(documents.lines(docs(spark, "\n".join(lines))), [], budget=150).orderBy("rank").collect()
    assert [len(r["line"]) for r in got] == [24] * 6
    got = documents.bullets(documents.lines(docs(spark, "\n".join(lines))), [], budget=10).orderBy("rank").collect()
    assert len(got) == 5
    assert documents.bullets(documents.lines(docs(spark, "z" * 300)), []).first()["line"] == "z" * 219 + "…"


def test_total_rank_is_gapless(spark):
    df = spark.range(5000).select(F.expr("pmod(xxhash64(id), 700)").alias("v"), "id").repartition(7)
    got = spread.total_rank(df, [F.desc("v"), F.asc("id")], "rank").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r["v"], r["id"]) for r in got] == sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert spread.total_rank(df.where("false"), ["v"], "rank").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (7, 7), (900, 600), (900, 601), (602, 900)]
    got = {r["node"]: r["component"] for r in spread.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 900: 600, 600: 600, 601: 600, 602: 600}


@pytest.mark.parametrize(("length", "together"), [(400, 1_000_000), (14, 4)])
def test_a_long_chain_is_gone_through_in_a_few_jobs(spark, length, together):
    rows = [(i, f"u{(i + 1) // 2}", f"h{i // 2}") for i in range(length)] + [(1000, None, None), (1001, None, "h0"), (1002, "u9", None)]
    df = spark.createDataFrame(rows, "seq long, u string, h string")
    seen, want = set(), []
    for i, u, h in rows:
        keys = {("u", u), ("h", h)} - {("u", None), ("h", None)}
        if not keys & seen:
            seen |= keys
            want.append(i)
    assert sorted(r["seq"] for r in news.deduped(df, ["u", "h"], rounds=1, together=together).collect()) == want


def test_keys_of_items_without_an_address(spark):
    df = spark.createDataFrame([(1, "http://a/x?utm_source=q#f", " A  b "), (2, None, "a B"), (3, "", None), (4, None, None), (5, "HTTP://A/X", "c")], "seq long, url string, head string")
    url, head = news.news_keys(F.col("url"), F.col("head"))
    keyed = df.select("seq", url.alias("k1"), head.alias("k2"))
    assert [(r["k1"], r["k2"]) for r in keyed.orderBy("seq").collect()] == [("url:http://a/x", "headline:a b"), ("headline:a b", "headline:a b"), ("headline:", None), ("headline:", None), ("url:http://a/x", "headline:c")]
    assert sorted(r["seq"] for r in news.deduped(keyed, ["k1", "k2"]).collect()) == [1, 3]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024.3.5 기사", "2024-03-05"), ("12.31.x", "2024-12-31"), ("12.31.", None), ("방금", "2024-01-10"), ("3시간 전", "2024-01-10"), ("어제", "2024-01-09"), ("10일 전", "2023-12-31"), ("11일 전", "2024-01-09"), ("2024-13-01", None), ("", None), (None, None)],
)
def test_news_dates(spark, text, want):
    """Eleven days ago holds "1일 전", which counts as yesterday."""
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(scalars.news_date(F.col("t"), F.lit("2024-01-10").cast("date"))).first()[0]
    assert (got and str(got)) == want


def test_feed_dates_are_of_the_zone(spark):
    df = spark.createDataFrame([("Tue, 05 Mar 2024 18:30:00 GMT",), ("Tue, 05 Mar 2024 18:30:00 +0900",), ("<![CDATA[1시간 전]]>",), ("2024&#45;03-01",), ("x",)], "t string")
    assert [r[0] and str(r[0]) for r in df.select(scalars.feed_date(F.col("t"), F.lit("2024-01-10").cast("date"))).collect()] == ["2024-03-06", "2024-03-05", "2024-01-10", "2024-03-01", None]


def test_entities(spark):
    df = spark.createDataFrame([("a &amp;lt; &#9731;&#x2603; &#x1F600; &#0; &quot;x&apos; <![CDATA[<b>\n]]>",)], "t string")
    assert df.select(scalars.decoded(F.col("t"))).first()[0] == "a < ☃☃ 😀 &#0; \"x' <b>\n"


def test_formats(spark):
    df = spark.createDataFrame([(1234567.5,), (-0.126,), (None,), (float("nan"),)], "x double")
    x = F.col("x")
    got = df.select(scalars.thousands(x), scalars.percent(x), scalars.signed_percent(x, 2), scalars.signed_amount(x), scalars.ratio(x), scalars.price(x, F.lit("KRW")), scalars.price(x, F.lit("USD"))).collect()
    assert tuple(got[0]) == ("1,234,568", "123456750.0%", "+1234567.50%", "+1,234,568", "1234567.50x", "₩1,234,568", "$1234567.50")
    assert tuple(got[1])[1:5] == ("-12.6%", "−0.13%", "−0", "-0.13x")
    assert tuple(got[2]) == tuple(got[3]) == ("N/A", "-", "N/A", "N/A", "-", "—", "—")


def test_equal_posts_have_equal_keys(spark):
    df = spark.createDataFrame([("t", "a  \r\n\n\n\nb", 1), (" t", "a\n\nb\n", 1), ("t", "a\n\nb", 2)], "t string, b string, n int")
    a, b, c = (r[0] for r in df.select(scalars.content_key(F.col("t"), F.col("b"), F.col("n"))).collect())
    assert a == b != c and len(a) == 64


def test_sector_news(spark):
    terms = news.sector_terms("반도체/AI  부품", ["삼성전자", ""], ["HBM", "AI", "x"])
    assert terms == ["반도체", "삼성전자", "HBM"]
    df = spark.createDataFrame([("HBM 증설",), ("HBM 공급계약",), ("반도체 파업",), ("AI 열풍",), ("LH HBM",)], "t string")
    assert [r[0] for r in df.select(news.is_sector(F.col("t"), terms)).collect()] == [True, False, False, False, False]
    urls = spark.createDataFrame([("http://x/a", None), ("https://News.Google.com/a", False), ("http://x", True), (None, None)], "u string, d boolean")
    assert [r[0] for r in urls.select(news.is_direct(F.col("u"), F.col("d"), "news.google.com")).collect()] == [True, False, False, False]
