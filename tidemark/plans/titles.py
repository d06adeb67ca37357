"""Title and keyword queries: headlines with planted titles, texts with planted table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import titles as t
from tidemark.operators.filings import BLANK
from tidemark.plans.news import I_SQL, STOP, items
from tidemark.plans.registry import out, query, table

TITLES = (
    "", "2차전지 반도체 바이오 함께", "3인 3색 이야기", "[특징주] 강세", "지금 사도 될까", "왜 주목 받을까 이유", "차세대 공정 양산", "차세대 공정 오늘 실적", "a, b / c · d", "a, b / c · d | e", "배터리 블로그 추천", "RSI 차트를 보는 법", "TOP 10 종목 정리", "EV/EBITDA 매력",
    "반도체는 수율이 핵심이라는 로드맵을 반도체가", "HBM으로 12,000원에서 30% 상승한",
)


def titled(spark, sf_dir) -> DataFrame:
    """(item_id, company, text): a title before the first words of every document, with the source as company; every fifth names it late."""
    i = items(spark, sf_dir)
    planted = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("item_id") % len(TITLES) + 1).cast("int"))
    late = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit(" "), "source")).otherwise("")
    return i.select("item_id", F.col("source").alias("company"), F.concat(planted, F.lit(" "), F.substring("headline", 1, 40), late).alias("text"))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_ANY = lambda c, words: f"len(list_filter({_LIST(words)}, lambda w: contains(lower({c}), lower(w)))) > 0"
_SEPS = f"len(regexp_extract_all(text, '{t.SEPARATOR}'))"
T_SQL = f"{I_SQL}, t AS (SELECT item_id, source AS company, ({_LIST(TITLES)})[item_id % {len(TITLES)} + 1] || ' ' || left(headline, 40) || CASE WHEN item_id % 5 = 0 THEN ' ' || source ELSE '' END AS text FROM i)"


@query("title_classes", f"""WITH {T_SQL} SELECT item_id, {_ANY('text', t.TRADING)} AS is_trading, {_SEPS} >= 3 OR len(list_filter({_LIST(t.SECTORS)}, lambda w: contains(text, w))) >= 3 OR (length(text) > 40 AND instr(text, company) > 26) AS is_listicle, {_SEPS} >= 4 AS is_news_listicle,
  regexp_matches(text, '{t.BRACKET}') AS is_bracketed, len(list_filter({_LIST(t.FORMULAS)}, lambda p: regexp_matches(text, p))) > 0 AS is_formulaic, {_ANY('text', t.STOCK)} AS is_stock, {_ANY('text', t.DEEP_TECH)} AND NOT {_ANY('text', t.SHORT_TERM)} AS is_deep_tech,
  regexp_matches(text, '{t.ROUNDUP}') OR (contains(text, company) AND regexp_matches(text, '{t.BLOGS}')) AS is_roundup FROM t""".replace("lambda p: regexp_matches(text, p)", "lambda p: regexp_extract(text, p) <> ''"))
def title_classes(spark, sf_dir):
    rows = titled(spark, sf_dir)
    found = t.title_classes(F.col("text"), F.col("company"))
    found["is_news_listicle"] = t.title_classes(F.col("text"), F.col("company"), news=True)["is_listicle"]
    return rows.select("item_id", *(v.alias(k) for k, v in found.items()))


STOP_WORDS = [*STOP, "핵심", "이야기"]


def tokens_sql(text: str, company: str | None = None) -> str:
    bare = f"""regexp_replace(regexp_replace(regexp_replace({text}, '["“”''‘’…·,;:!?()\\[\\]{{}}<>]', ' ', 'g'), '{BLANK}+', ' ', 'g'), '^ | $', '', 'g')"""
    words = f"list_transform(string_split({bare}, ' '), lambda x: regexp_replace(regexp_replace(x, '[.。]+$', ''), '({t.PARTICLES})$', ''))"
    own = f" AND lower(x) <> lower({company}) AND NOT (length({company}) > 2 AND contains(lower({company}), lower(x)))" if company else ""
    return f"list_filter({words}, lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+[%조억원만천일월년시분]?$') AND NOT (length(x) <= 3 AND regexp_matches(x, '[하된]$')) AND NOT list_contains({_LIST(STOP_WORDS)}, x) AND NOT list_contains({_LIST(STOP_WORDS)}, lower(x)){own})"


_PAIRS = "unnest(list_concat(t, [t[k] || ' ' || t[k + 1] FOR k IN range(1, len(t))]))"


@query("ngrams", f"WITH t AS (SELECT {tokens_sql('text')} AS t FROM documents), c AS (SELECT term, count(*) AS count FROM (SELECT {_PAIRS} AS term FROM t) GROUP BY 1 HAVING count(*) >= 3) SELECT row_number() OVER (ORDER BY count DESC, term) AS rank, term, count FROM c QUALIFY rank <= 10")
def ngrams(spark, sf_dir):
    return out(t.ngrams(table(spark, sf_dir, "documents"), STOP_WORDS))


@query("headline_terms", f"WITH {T_SQL}, k AS (SELECT company, {tokens_sql('text', 'company')} AS t FROM t WHERE {_SEPS} < 4), c AS (SELECT company, term, count(*) AS count FROM (SELECT company, {_PAIRS} AS term FROM k) GROUP BY 1, 2 HAVING count(*) >= 3) SELECT company, row_number() OVER (PARTITION BY company ORDER BY count DESC, term) AS rank, term, count FROM c QUALIFY rank <= 10")
def headline_terms(spark, sf_dir):
    return out(t.headline_terms(titled(spark, sf_dir), STOP_WORDS, "company"))


CELLS = "|로드맵은 HBM|양극재를 SMR수출|핵심|ab 긴이름의제품군들|"


@query("product_terms", f"""WITH {T_SQL}, p AS (SELECT company, text || chr(10) || CASE WHEN item_id % 4 = 1 THEN '{CELLS}' ELSE '| x' END AS text FROM t),
k AS (SELECT company, list_filter({tokens_sql('text', 'company')}, lambda x: regexp_matches(x, '{t.NOUN}') OR regexp_matches(x, '{t.MIXED}')) AS a, CASE WHEN contains(text, '{CELLS}') THEN ['로드맵', 'HBM', '양극재'] ELSE [] END AS b FROM p),
c AS (SELECT company, term, count(*) AS count FROM (SELECT company, unnest(list_concat(a, b)) AS term FROM k) GROUP BY 1, 2 HAVING count(*) >= 2) SELECT company, row_number() OVER (PARTITION BY company ORDER BY count DESC, term) AS rank, term, count FROM c QUALIFY rank <= 5""")
def product_terms(spark, sf_dir):
    """Of the planted table row three words count once more; one is a stop word, one mixed, one too short and one too long."""
    rows = titled(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n"), F.when(F.col("item_id") % 4 == 1, CELLS).otherwise("| x")))
    return out(t.product_terms(rows, STOP_WORDS, ["company"], F.col("company")))


NOTE = "수율은 리스크다 수율 HBM HBM 이야기"


def noted(spark, sf_dir) -> DataFrame:
    """Memos of some sources: one has a key heading twice, so that its words count double; the others' heading is no key."""
    i = items(spark, sf_dir).where("item_id % 6 = 2")
    head = F.when(F.col("item_id") % 4 == 0, "# 핵심 변수\n## 리스크\n").otherwise("# 기타\n")
    return i.select(F.col("source").alias("company"), F.concat(head, F.lit(NOTE)).alias("text"))


def _term_sql(rows: str, terms: str, least: int, most: int, name: str) -> str:
    return f"{name} AS (SELECT company, row_number() OVER (PARTITION BY company ORDER BY count(*) DESC, term) AS rank, term FROM (SELECT company, unnest({terms}) AS term FROM {rows}) GROUP BY company, term HAVING count(*) >= {least} QUALIFY rank <= {most})"


@query("query_set", f"""WITH {T_SQL}, few AS (SELECT * FROM t WHERE company NOT IN ('src3', 'src5')), h0 AS (SELECT company, {tokens_sql('text', 'company')} AS t FROM few WHERE {_SEPS} < 4), p0 AS (SELECT company, list_filter({tokens_sql('text', 'company')}, lambda x: regexp_matches(x, '{t.NOUN}') OR regexp_matches(x, '{t.MIXED}')) AS t FROM few),
x0 AS (SELECT source AS company, CASE WHEN item_id % 4 = 0 THEN ['리스크다', '수율', '수율', 'HBM', 'HBM', '수율', '리스크다', '수율', 'HBM', 'HBM'] ELSE [] END AS t FROM i WHERE item_id % 6 = 2 AND source <> 'src5'),
{_term_sql('p0', 't', 2, 5, 'p')}, {_term_sql('h0', _PAIRS.removeprefix('unnest(').removesuffix(')'), 3, 10, 'h')}, {_term_sql('x0', 't', 2, 5, 'x')},
a AS (SELECT company, 0 AS kind, 0 AS rank, '투자 분석' AS term, 'base' AS source FROM (SELECT DISTINCT company FROM t) UNION ALL SELECT company, 1, 0, '실적', 'base' FROM (SELECT DISTINCT company FROM t) UNION ALL SELECT company, 2, rank, term, 'product' FROM p WHERE rank <= 3 UNION ALL SELECT company, 3, rank, term, 'news' FROM h WHERE rank <= 5 UNION ALL SELECT company, 4, rank, term, 'context' FROM x WHERE rank <= 3),
f AS (SELECT company, kind, rank, company || ' ' || term AS query, source FROM a QUALIFY row_number() OVER (PARTITION BY company, lower(term) ORDER BY kind, rank) = 1),
k AS (SELECT company, nth AS rank, query, source FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY kind, rank, query) AS nth FROM f) WHERE nth <= 8)
SELECT * FROM k UNION ALL SELECT company, max(rank) + 1, company || ' 주요 제품', 'fallback' FROM k GROUP BY company HAVING max(rank) <= 2 AND NOT bool_or(source IN ('product', 'news'))""")
def query_set(spark, sf_dir):
    """Of two sources there are no titles, of one of them no memos either."""
    rows = titled(spark, sf_dir)
    few = rows.where("company not in ('src3', 'src5')")
    return out(t.query_set(rows, t.product_terms(few, STOP_WORDS, ["company"], F.col("company")), t.headline_terms(few, STOP_WORDS, "company"), t.context_terms(noted(spark, sf_dir).where("company <> 'src5'"), STOP_WORDS, "company")))
