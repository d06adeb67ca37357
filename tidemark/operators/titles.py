"""Titles and headlines: classes, tokens without particles, and the terms that stand out.

Each title is read inside its row. Stop words are a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.filings import BLANK, trimmed
from tidemark.operators.news import matches

# Fixed word lists and patterns of the classes.
TRADING = "차트분석 차트 캔들 이평 볼린저 RSI MACD 매매 매수 매도 손절 익절 지지선 저항선 단타 스윙 급등주 급락주 관심주 주목주 추천주 시황 오늘의 내일의 금일 상한가 하한가".split()
SECTORS = "반도체 2차전지 이차전지 바이오 광통신 원전 SMR 조선 방산 AI 인공지능 HBM 전기차 수소 로봇 우주 엔터 미디어 게임 건설 은행 증권 보험 화장품 면세점 철강 해운 항공 제약 식품 리튬 니켈 양극재 음극재 태양광 풍력".split()
DEEP_TECH = "기술 공정 특허 개발 양산 수율 경쟁력 독점 점유율 시장점유율 기술력 진입장벽 해자 로드맵 차세대 원천기술 핵심기술 혁신 경쟁사 대비 우위 선도 독보적 아키텍처 플랫폼 파이프라인 포트폴리오 내재화 국산화 자체개발 원가 원가구조".split()
SHORT_TERM = "오늘 내일 금일 이번주 금주 실시간 속보 긴급 종가 시가 급등 급락 지금 현재가".split()
STOCK = (
    "주가 주식 증시 코스피 코스닥 상한가 하한가 매수 매도 손절 익절 단타 스윙 급등 급락 시황 차트 캔들 이평 볼린저 투자 종목 목표주가 추천주 관심주 급등주 주목주 밸류에이션 PER PBR ROE EPS EV/EBITDA "
    "실적 매출 영업이익 순이익 어닝 컨센서스 실적발표 분기실적 배당 배당금 배당락 공시 증자 유상증자 무상증자 감자 합병 인적분할 물적분할 자사주 소각 IPO 상장 상장폐지 인수 경쟁력 점유율 시장점유율 진입장벽 해자 독점"
).split()
SEPARATOR, BRACKET = r"[,/·|、]", r"^\s*[\[【（(]"
FORMULAS = (
    "총정리", "완벽정리", "완벽가이드", "핵심정리", "한눈에", r"모든\s*것", "알아보기|알아보자", "총망라", r"(?i)TOP\s*\d+", r"\d+\s*가지", r"정리\s*$", r"\?\s*$", "필독",
    r"지금\s*사(면|도)\s*(늦을까|될까|괜찮을까|할까)", r"지금\s*매수\s*(타이밍|해도)", r"매수\s*타이밍\s*일까", r"왜\s*(오를까|떨어질까|주목받나|주목\s*받을까|뜨는가|뜨나)", r"얼마나\s*(오를까|갈까|올라)", r"사면\s*안\s*되는",
    r"꼭\s*알아야\s*할", r"모르면\s*(안\s*되는|손해)", r"놓치면\s*(안\s*되는|후회)", r"반드시\s*알아야", r"미래를?\s*(보다|엿보다|바꿀)", r"상승세\s*탈까",
    r"체크\s*포인트", "체크포인트", r"핵심\s*(분석|체크|비교)", r"가능성\s*체크", r"투자\s*전\s*체크", r"투자\s*핵심", r"관찰\s*포인트", r"예상\s*지급일", r"!\s*$", r"상승\s*확률\s*(얼마|몇)", r"비교\s*시점",
)
ROUNDUP, BLOGS = r"\d+\s*인\s*\d+\s*색", "블로거|블로그 추천|블로그 모음|블로그 정리"
PARTICLES = "을|를|이|가|의|은|는|에|에서|와|과|도|로|으로|에게|한테|부터|까지|처럼|만큼|보다|라고|이라고|라는|이라는|라며|이라며"
NOUN, ACRONYM, MIXED = r"^[\x{AC00}-\x{D7AF}]{2,6}$", r"^[A-Z]{2,6}$", r"^[A-Za-z\x{AC00}-\x{D7AF}]{2,8}$"
#: A number with or without a unit, a verb's ending.
NO_TERM = r"^(?:\d+[%조억원만천일월년시분]?|.{0,2}[하된])$"


def title_classes(title: Column, company: Column, news: bool = False) -> dict[str, Column]:
    """Seven classes of a title, each false for a null one; the rules for lists are looser for news headlines than for posts."""
    separators = F.regexp_count(title, F.lit(SEPARATOR))
    tags = sum((F.when(F.contains(title, F.lit(t)) & ~company.eqNullSafe(F.lit(t)), 1).otherwise(0) for t in SECTORS), F.lit(0))
    deep = (F.length(title) > 40) & (F.coalesce(company, F.lit("")) != "") & (F.instr(title, company) > 26)
    listicle = separators >= 4 if news else (separators >= 3) | (tags >= 3) | F.coalesce(deep, F.lit(False))
    named = (F.coalesce(company, F.lit("")) != "") & F.contains(title, company)
    found = {
        "is_trading": matches(title, TRADING), "is_listicle": listicle, "is_bracketed": title.rlike(BRACKET), "is_formulaic": title.rlike("|".join(f"(?:{p})" for p in FORMULAS)),
        "is_stock": matches(title, STOCK), "is_deep_tech": matches(title, DEEP_TECH) & ~matches(title, SHORT_TERM), "is_roundup": title.rlike(ROUNDUP) | F.coalesce(named & title.rlike(BLOGS), F.lit(False)),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


def company_tokens(title: Column, stop: list[str]) -> Column:
    """The distinct tokens of a title that may be company names: of letters, 2 to 10 long, no stop word, nor one with a suffix of shares."""
    found = F.regexp_extract_all(title, F.lit(r"[A-Za-z가-힣][A-Za-z가-힣0-9&-]{1,9}"), F.lit(0))
    bare = lambda x: F.when((F.length(x) > 2) & x.endswith("주"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*stop) & ~bare(x).isin(*stop)))


def tokens(text: Column, stop: list[str], company: Column | None = None, ticker: Column | None = None) -> Column:
    """Words without punctuation and particles; no stop words, numbers, dates and verb endings, nor the company, a part of its name or its ticker."""
    bare = F.regexp_replace(text, "[\"“”'‘’…·,;:!?()\\[\\]{}<>]", " ")
    bare = F.regexp_replace(trimmed(F.regexp_replace(bare, f"{BLANK}+", " ")), "[.。]+(?= |$)", "")
    words, last = F.split(bare, " "), lambda x: F.substring(x, -1, 1)
    words = F.when(text.rlike("[가-힣]"), F.transform(words, lambda x: F.regexp_replace(x, f"(?:{PARTICLES})$", ""))).otherwise(words)
    name = F.lower(F.coalesce(company, F.lit(""))) if company is not None else None

    def fits(x: Column) -> Column:
        low = F.lower(x)
        doubtful = F.substring(x, 1, 1).between("0", "9") | last(x).isin("하", "된")
        ok = (F.length(x) >= 2) & ~(doubtful & x.rlike(NO_TERM)) & ~x.isin(*stop) & ~low.isin(*stop)
        if name is not None:
            ok = ok & (low != name) & ~((F.length(name) > 2) & F.contains(name, low))
        return ok if ticker is None else ok & ~low.eqNullSafe(F.lower(ticker))

    return F.filter(words, fits)


def frequent(docs: DataFrame, terms: Column, by: list[str], least: int, most: int) -> DataFrame:
    """(by, rank, term, count) of the most frequent of terms, ties by term."""
    counts = docs.select(*by, F.explode(terms).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("count")).where(F.col("count") >= least)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("count"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select(*by, "rank", "term", "count")


def with_pairs(words: str) -> Column:
    """The words of a column and each two that follow one another."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(F.col(words), F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def ngrams(docs: DataFrame, stop: list[str], by: list[str] | None = None, company: Column | None = None, ticker: Column | None = None, least: int = 3, most: int = 10) -> DataFrame:
    """(by, rank, term, count): the most frequent words and pairs, ranked together."""
    words = docs.select(*(by or []), tokens(F.col("text"), stop, company, ticker).alias("words"))
    return frequent(words, with_pairs("words"), by or [], least, most)


def headline_terms(headlines: DataFrame, stop: list[str], company: str, ticker: str | None = None, least: int = 3, most: int = 10) -> DataFrame:
    """ngrams of each company's headlines (company, text) that are no lists."""
    name = F.col(company)
    single = headlines.where(~title_classes(F.col("text"), name, news=True)["is_listicle"])
    return ngrams(single, stop, [company], name, None if ticker is None else F.col(ticker), least, most)


def product_terms(docs: DataFrame, stop: list[str], by: list[str], company: Column | None = None, least: int = 2, most: int = 5) -> DataFrame:
    """(by, rank, term, count) of what may be products: short nouns, acronyms and mixed words of the text, and once more those nouns and acronyms that stand in table cells."""
    text = F.col("text")
    words = F.filter(tokens(text, stop, company), lambda x: x.rlike(NOUN) | x.rlike(MIXED))
    rows = F.regexp_extract_all(text, F.lit(r"(?m)^\|(.+)\|$"), F.lit(1))
    cells = F.flatten(F.transform(rows, lambda r: F.split(r, rf"\||{BLANK}+")))
    cells = F.transform(cells, lambda x: F.regexp_replace(x, f"(?:{PARTICLES})$", ""))
    cells = F.filter(cells, lambda x: (x.rlike(NOUN) & ~x.isin(*stop)) | x.rlike(ACRONYM))
    return frequent(docs, F.concat(words, cells), by, least, most)


#: Fixed headings of sections that name what matters, as far as 500 characters below.
KEY_SECTION = r"(?im)^#{1,3}\s+(?:핵심|투자|Key|논점|포인트|리스크|카탈리스트|모멘텀|변수).*$(?=([\s\S]{0,500}))"


def context_terms(memos: DataFrame, stop: list[str], company: str, least: int = 2, most: int = 5) -> DataFrame:
    """(company, rank, term, count) of short nouns and acronyms in the 500 characters below each key heading of a company's memos (company, text)."""
    near = F.regexp_extract_all("text", F.lit(KEY_SECTION), F.lit(1))
    rows = memos.select(company, F.array_join(near, "\n").alias("text"))
    words = F.filter(tokens(F.col("text"), stop, F.col(company)), lambda x: x.rlike(NOUN) | x.rlike(ACRONYM))
    return frequent(rows, words, [company], least, most)


def query_set(companies: DataFrame, products: DataFrame, headlines: DataFrame, contexts: DataFrame, company: str = "company", most: int = 8) -> DataFrame:
    """(company, rank, query, source): two base queries of each company, then its first three product, five headline and three context terms.

    Of queries that differ in case and blanks only the first stays. A company without product and headline terms that has no more
    than its base queries gets one for its main products.
    """
    name = F.col(company)
    base = companies.select(company).distinct().select(company, F.inline(F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(0).alias("rank"), F.lit(t).alias("term"), F.lit("base").alias("source")) for i, t in enumerate(("투자 분석", "실적"))))))
    some = lambda df, kind, n, source: df.where(F.col("rank") <= n).select(company, F.lit(kind).alias("kind"), F.col("rank").cast("int").alias("rank"), "term", F.lit(source).alias("source"))
    every = base.unionByName(some(products, 2, 3, "product")).unionByName(some(headlines, 3, 5, "news")).unionByName(some(contexts, 4, 3, "context"))
    every = every.withColumn("query", F.concat_ws(" ", name, "term")).withColumn("key", F.lower(trimmed(F.regexp_replace("query", f"{BLANK}+", " "))))
    first = every.groupBy(company, "key").agg(F.min(F.struct("kind", "rank", "query", "source")).alias("q")).select(company, "q.*")
    nth = F.row_number().over(W.partitionBy(company).orderBy("kind", "rank", "query"))
    kept = first.withColumn("nth", nth).where(F.col("nth") <= most)
    bare = kept.groupBy(company).agg(F.max("nth").alias("n"), F.max(F.col("source").isin("product", "news")).alias("found")).where((F.col("n") <= 2) & ~F.col("found"))
    bare = bare.where(F.col("n") < most).select(company, (F.col("n") + 1).alias("rank"), F.concat_ws(" ", name, F.lit("주요 제품")).alias("query"), F.lit("fallback").alias("source"))
    return kept.select(company, F.col("nth").alias("rank"), "query", "source").unionByName(bare)
