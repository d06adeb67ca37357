import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import documents, evidence, news, structure
from tidemark.plans import registry
from tidemark.sources import landed


def lines(spark, *texts):
    return documents.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))


def test_links_take_each_text_once(spark):
    links = spark.createDataFrame([(1, 0, "ab"), (1, 1, "ab"), (1, 2, "zz"), (2, 0, "x")], "page_id long, nth int, title string")
    texts = spark.createDataFrame([(1, 5, "abc"), (1, 7, "a"), (1, 9, "q")], "page_id long, row long, text string")
    got = sorted((r["page_id"], r["nth"], r["row"]) for r in documents.link_text_match(links, texts).collect())
    assert got == [(1, 0, 5), (1, 1, 7), (1, 2, None), (2, 0, None)]


def test_post_title_is_above_the_date(spark):
    got = documents.post_views(lines(spark, "menu\nmy title\nblog name\n2024. 1. 2.\nbody\nmore", "short\na longer line")).orderBy("doc_id").collect()
    assert (got[0]["title"], got[0]["date_line"], got[0]["body"]) == ("my title", "2024. 1. 2.", "body\nmore")
    assert (got[1]["title"], got[1]["date_line"]) == ("a longer line", None)


def test_link_lines(spark):
    got = documents.link_lines(lines(spark, "first title → http://x/?id=7\nsnippet\nsecond title → http://y/?id=7\nno → u")).collect()
    assert [(r["title"], r["link_id"], r["snippet"]) for r in got] == [("first title", "7", "snippet")]


def test_endpoints_prefer_the_consolidated_statement(spark, tmp_path):
    for name, columns in landed.ENDPOINTS.items():
        row = {"corp_code": "1", "bsns_year": "2024", "reprt_code": "11011", **dict.fromkeys(columns, "x")}
        rows = [row | {"fs_div": "OFS"}, row | {"fs_div": "CFS"}, row | {"corp_code": "2", "fs_div": "OFS"}] if name == "accounts" else [row]
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(json.dumps({"status": "000", "list": rows}))
        (tmp_path / name / "b.json").write_text(json.dumps({"status": "013"}))
    got = landed.load_filing_endpoints(spark, str(tmp_path))
    assert sorted((r["corp_code"], r["fs_div"]) for r in got["accounts"].collect()) == [("1", "CFS"), ("2", "OFS")]
    assert got["board"].count() == 1


@pytest.mark.parametrize(("text", "want"), [("005930.KS", "005930"), (" AAPL ", "AAPL"), (None, None)])
def test_tickers(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(evidence.normal_ticker(df["t"])).first()[0] == want


def test_ordinary_shares_in_korean(spark):
    names = ["삼성전자", "삼성전자우", "한화 리츠", "대신 스팩 3호", "KODEX 200 ETF"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r["name"] for r in evidence.ordinary_shares(df, ["우[A-Z]?$", "리츠", "스팩", "ET[FN]|ELW"]).collect()] == ["삼성전자"]


def test_nicknames_in_korean(spark):
    df = spark.createDataFrame([("삼성", "삼성 개미는"), ("삼성", "삼성 abc"), ("삼성", "삼성 주가")], "company string, query string")
    assert [(r["tail"]) for r in evidence.nicknames(df, ["주가"], "은|는").collect()] == ["개미"]


def test_article_text_of_pages_without_article(spark):
    body, menu = "word " * 40, "menu " * 60
    pages = [
        f'<body><div>{menu}</div><div id="x" class="news-body">{body}</div></body>',
        f'<nav>{menu}</nav><section id="CONTENT">{body}</section>',
        f'<article>{"teaser " * 20}</article><div class="view">{body}</div>',
        "<p>too short</p>",
        f"<p>{body}</p>",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = {r["page_id"]: r["text"] for r in df.select("page_id", documents.article_text(df["html"]).alias("text")).collect()}
    assert got == {0: body.strip(), 1: body.strip(), 2: body.strip(), 3: "", 4: body.strip(), 5: None}


def test_listing_pages_are_bounded(spark, tmp_path, monkeypatch):
    parts = spark.range(1, 21_000).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    seen, load = [], landed.load_listings
    monkeypatch.setattr(landed, "load_listings", lambda pages: seen.append(pages) or load(pages))
    assert registry.QUERIES["load_listings"](spark, str(tmp_path)).select("ticker").distinct().count() == 20_999
    assert max(r["html"].count("<tr>") for r in seen[0].collect()) <= 1000


def test_lines_are_scored_by_what_they_say(spark):
    cases = [("목표주가를 100원에서 → 120원으로 상향 조정", 4, 4), ("목표주가 100,000원 → 120,000원", 1, 1), ("1,200 (3.4) 5-6/7 8%", -2, -2), ("실적이 좋아졌다.", 0, 1), ("실적은 좋으나,", 0, -1), ("매출 (전년 대비", 0, -1), ("a | b -> c", 0, 0)]
    df = spark.createDataFrame([(c[0],) for c in cases], "line string")
    got = df.select(documents.line_score(F.col("line"), ["목표주가"]), documents.one_liner_score(F.col("line"), ["목표주가"])).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_memo_parts(spark):
    memo = "# 제목\n- 종목코드: `005930`\n작성일： 2026-05-11\n작성일: 2026-05-12\n\n##  요약 \n\n- 첫째\n본문\n\n## 근거\n### 작은 제목\n표"
    got = [(r["kind"], r["name"], r["value"]) for r in documents.memo_parts(lines(spark, memo)).orderBy("kind", "nth").collect()]
    assert got == [("metadata", "종목코드", "005930"), ("metadata", "작성일", "2026-05-12"), ("section", "요약", "- 첫째\n본문"), ("section", "근거", "### 작은 제목\n표")]


def test_html_tables_fit_their_header(spark):
    html = "<TABLE><tr><th>이름</th><th> 값 </th></tr><tr><td>가<br>나</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></TABLE><table><tr></tr></table><p>x</p>"
    got = documents.html_tables(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")).orderBy("table", "row", "col").collect()
    assert [(r["table"], r["row"], r["col"], r["text"]) for r in got] == [(0, 0, 0, "이름"), (0, 0, 1, "값"), (0, 1, 0, "가나"), (0, 1, 1, ""), (0, 2, 0, "1"), (0, 2, 1, "2")]


def test_event_tags(spark):
    texts = ["코스피 1% 하락, 코스닥은 3%대 급등 마감. 외국인 매도", "코스닥 약세 속 코스피 3% 랠리", "환율 상승"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tags = news.event_tags(F.col("t"), {"kospi": "코스피", "kosdaq": "코스닥"}, "급등|강세|상승|랠리", "하락|약세", [("외국인", "수급"), ("환율", "환율"), ("마감", "마감")])
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in tags.items())).collect()]
    assert got == [("down", "1%", "up", "3%", "수급, 마감"), ("up", "3%", "down", "", ""), ("", "", "", "", "환율")]


def turns_by_hand(rows, least):
    out = []
    for n, kind, price in rows:
        if out and kind == out[-1][1]:
            if price > out[-1][2] if kind == "high" else price < out[-1][2]:
                out[-1] = (n, kind, price)
        elif not out or not (least > 0 and abs(price - out[-1][2]) < least):
            out.append((n, kind, price))
    return out


def test_pivots_alternate(spark):
    rng = random.Random(4)
    cases = [([(1, "high", 10.0), (2, "high", 12.0), (3, "low", 11.9), (4, "low", 9.0), (5, "low", 9.5), (6, "high", 9.2), (7, "high", 13.0)], 0.5)]
    cases += [([(n, rng.choice(["high", "low"]), float(rng.randint(1, 30))) for n in range(rng.randint(0, 40))], rng.choice([0.0, 2.0, 5.0])) for _ in range(40)]
    df = spark.createDataFrame(cases, "points array<struct<n:int,kind:string,price:double>>, least double")
    got = [[tuple(x) for x in r[0]] for r in df.select(structure.alternating(F.col("points"), F.col("least"))).collect()]
    assert got == [turns_by_hand(*c) for c in cases] and got[0] == [(2, "high", 12.0), (4, "low", 9.0), (7, "high", 13.0)]


@pytest.mark.parametrize(
    ("text", "price", "rated"),
    [
        ("목표주가를 85,000원에서 목표주가 95,000원으로 상향했다. 비중확대", 95000, "Overweight"),
        ("목표주가 120,000원, 투자의견 매수", 120000, "Buy"),
        ("목표TP 7,700원에 시장수익률 상회", 7700, "Outperform"),
        ("목표주가 8.5만원 중립", 85000, "Neutral"),
        ("목표가 5,0원, target  price: 4,200 and Equal weight", 4200, "Equal-weight"),
        ("목표주가 99,999,999,999원, a strongbuy", None, "Strong Buy"),
        ("Buyer holds 2,000", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_prices_and_ratings_in_korean(spark, text, price, rated):
    got = spark.createDataFrame([(text,)], "t string").select(evidence.target_price(F.col("t")), evidence.rating(F.col("t"))).first()
    assert tuple(got) == (price, rated)


def test_views_of_brokers_by_paragraph(spark):
    text = "서두 매도 2023년 1월 2일\n\nUBS는 목표주가 50,000원, 매수.\n\n골드만삭스 의견은 없다. MUBS도 없다"
    docs = spark.createDataFrame([(1, text, None), (2, "x" * 300 + " UBS " + "y" * 300, None), (3, None, None)], "article_id long, text string, published date")
    aliases = spark.createDataFrame([("UBS", "UBS"), ("Goldman", "골드만삭스"), ("Goldman", "골드만"), ("Nobody", "Nomura")], "broker string, alias string")
    got = {(r["article_id"], r["broker"]): r for r in evidence.broker_views_extract(docs, aliases).collect()}
    assert set(got) == {(1, "UBS"), (1, "Goldman"), (2, "UBS")}
    ubs, goldman = got[1, "UBS"], got[1, "Goldman"]
    assert (ubs["target_price"], ubs["rating"], str(ubs["report_date"]), ubs["thesis"]) == (50000, "Buy", "2023-01-02", "UBS는 목표주가 50,000원, 매수.")
    assert (goldman["alias"], goldman["target_price"], goldman["rating"]) == ("골드만삭스", 50000, "Buy")
    assert got[2, "UBS"]["thesis"].endswith("…") and len(got[2, "UBS"]["thesis"]) == 240
    with pytest.raises(ValueError):
        evidence.broker_views_extract(docs, aliases, most_aliases=2)
    assert evidence.broker_views_extract(docs, aliases.limit(0)).count() == 0


def test_the_place_of_a_broker_counts_characters(spark):
    docs = spark.createDataFrame([(1, "😀😀😀 UBS 매수\n\n끝 2,000", None)], "article_id long, text string, published date")
    got = evidence.broker_views_extract(docs, spark.createDataFrame([("UBS", "UBS")], "broker string, alias string")).first()
    assert (got["thesis"], got["rating"], got["target_price"]) == ("😀😀😀 UBS 매수", "Buy", None)


def test_what_a_form_needs_is_part_of_it(spark):
    said = ["비중확대", "비중축소", "시장수익률 상회", "시장수익률하회", "시장수익률", "적극매수", "중립", "매수", "매도", "보유", "EQUAL-Weight", "Overweight", "UNDERweight", "outPerform", "underPERFORM", "STRONG BUY", "bUY", "Sell", "HOLD", "Neutral"]
    prices = ["목표주가를 2,000원으로 상향", "목표주가 2,000원", "목표가 2,000원", "목표 가격 2,000원", "TP 2,000", "TARGET Price: 2,000", "목표주가 0.2 만원"]
    df = spark.createDataFrame([(i, f"가 {x} 나") for i, x in enumerate([*said, *prices])], "i int, t string")
    got = df.select(evidence.rating(F.col("t")).alias("r"), evidence.target_price(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r["r"] for r in got] == [label for _, label in evidence.RATING_FORMS] + [None] * len(prices)
    assert [r["p"] for r in got] == [None] * len(said) + [2000] * len(prices)
