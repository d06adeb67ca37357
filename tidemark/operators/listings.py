"""Report listings from page text: rows of cells, rows above a date, links with the file that belongs to them.

A page is read inside its row, line by line in order, so nothing is exchanged. Blanks around lines and empty lines don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filings import trimmed

# Fixed patterns: date lines of both layouts, the cells of target price and rating, lines of icons, the file's address.
BLOCK_DATE = r"^20\d{2}-\d{2}-\d{2}$"
TARGET = r"^\d{1,7}(?:,\d{3})*$"
RATING = r"^[A-Za-z가-힣/ ]+$"
DATE = r"^20\d{2}[./-]\d{1,2}[./-]\d{1,2}$"
ICONS = r"^[>*\-+]+$"
PDF = r"(?i)https?://[^\s]+\.pdf(?:\?[^\s]*)?$"
TICKER_PREFIX = r"^[^()]{1,40}\(\d{5,7}\)\s*"
CELLS = ("published", "title", "title_again", "short_title", "target", "rating", "analyst", "broker")


def page_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), trimmed), lambda x: x != "")


def _apart(places: Column, step: int) -> Column:
    """Of ascending places, each that is step or more after the last one taken."""
    none = F.struct(F.lit(-step).alias("last"), F.array().cast("array<int>").alias("taken"))
    take = lambda s, i: F.when(i >= s["last"] + step, F.struct(i.alias("last"), F.concat(s["taken"], F.array(i)).alias("taken"))).otherwise(s)
    return F.aggregate(places, none, take, lambda s: s["taken"])


def report_rows(pages: DataFrame, id_col: str = "doc_id", text_col: str = "text", date: str = BLOCK_DATE, target: str = TARGET, rating: str = RATING) -> DataFrame:
    """(id_col, line, published, title, ...) of blocks of eight lines: a date, two full titles, a title, a target price, a rating, analyst and broker.

    The fifth and sixth line must look like a price and a rating. A block's lines begin no other; where one begins inside
    another, the earlier counts. published is a date, null if there is no such day; target is text.
    """
    rows = pages.select(id_col, page_lines(F.col(text_col)).alias("lines"))
    at = lambda i, k: F.get("lines", i + k)
    fits = F.transform("lines", lambda x, i: F.when(x.rlike(date) & at(i, 7).isNotNull() & at(i, 4).rlike(target) & at(i, 5).rlike(rating), i))
    rows = rows.select(id_col, "lines", _apart(F.filter(fits, lambda x: x.isNotNull()), len(CELLS)).alias("starts"))
    found = rows.select(id_col, F.inline(F.transform("starts", lambda i: F.struct(i.alias("line"), *(at(i, k).alias(c) for k, c in enumerate(CELLS))))))
    return found.withColumn("published", F.col("published").try_cast("date"))


def report_facts(rows: DataFrame) -> DataFrame:
    """rows with the title without its ticker, and the target as a number, null for 0."""
    price = F.nullif(F.regexp_replace("target", ",", "").try_cast("double"), F.lit(0.0))
    return rows.withColumns({"title": trimmed(F.regexp_replace("title", TICKER_PREFIX, "")), "target_price": price})


def rows_above_dates(pages: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 10) -> DataFrame:
    """(id_col, line, published, broker, company, title): the three nearest lines above each date line, upwards, among ``reach`` lines.

    Lines of one character, of icons, and empty ones are passed over, though empty ones count for the reach; dates above are lines like any other.
    """
    rows = pages.select(id_col, F.transform(F.split(text_col, r"\r?\n"), trimmed).alias("lines"))
    dates = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(DATE), i)), lambda x: x.isNotNull())
    rows = rows.select(id_col, "lines", dates.alias("dates"))
    above = lambda i: F.reverse(F.slice("lines", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))))
    near = lambda i: F.filter(above(i), lambda x: (F.length(x) >= 2) & ~x.rlike(ICONS))
    each = rows.select(id_col, F.inline(F.transform("dates", lambda i: F.struct(i.alias("line"), F.get("lines", i).alias("raw"), near(i).alias("near")))))
    parts = F.split("raw", "[./-]")
    published = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")).try_cast("date")
    return each.select(id_col, "line", published.alias("published"), *(F.get("near", F.lit(k)).alias(c) for k, c in enumerate(("broker", "company", "title"))))


def report_links(pages: DataFrame, report: str, id_col: str = "doc_id", text_col: str = "text", arrow: str = " → ", pdf: str = PDF) -> DataFrame:
    """(id_col, nth, report_id, title, url, pdf_url) of "text → address" lines whose address has the pattern report (its first group is the
    id), in order; pdf_url is the first file linked before the next report.
    """
    cut = lambda x: F.split(x, arrow, 2)
    links = F.transform(F.filter(page_lines(F.col(text_col)), lambda x: F.contains(x, F.lit(arrow))), lambda x: F.struct(trimmed(cut(x)[0]).alias("text"), trimmed(cut(x)[1]).alias("url")))
    links = F.filter(links, lambda x: x["url"].rlike(report) | x["url"].rlike(pdf))
    rows = pages.select(id_col, links.alias("links"))
    heads = F.filter(F.transform("links", lambda x, i: F.when(x["url"].rlike(report), i)), lambda x: x.isNotNull())
    rows = rows.select(id_col, "links", heads.alias("heads"))
    files = lambda i, k: F.slice("links", i + 2, F.coalesce(F.get("heads", k + 1), F.size("links")) - i - 1)
    found = F.transform("heads", lambda i, k: F.struct(k.alias("nth"), F.get("links", i).alias("link"), F.get(files(i, k), F.lit(0))["url"].alias("pdf_url")))
    each = rows.select(id_col, F.inline(found))
    return each.select(id_col, "nth", F.regexp_extract("link.url", report, 1).alias("report_id"), F.col("link.text").alias("title"), F.col("link.url").alias("url"), "pdf_url")


def report_key(prefix: str, broker: Column, published: Column, title: Column, report_id: Column) -> Column:
    """The site's id of a report, else one of broker, day and title."""
    slug = lambda x, other: F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(trimmed(x), r"\s+", "-"), r"[^\p{L}\p{N}-]", ""), 1, 60), F.lit("")), F.lit(other))
    made = F.concat_ws("-", F.lit(prefix), slug(broker, "unknown"), F.coalesce(published.cast("string"), F.lit("na")), slug(title, "untitled"))
    return F.coalesce(F.concat(F.lit(f"{prefix}-"), F.nullif(report_id, F.lit(""))), made)


def search_hits(pages: DataFrame, address: str, id_col: str = "doc_id", text_col: str = "text", around: int = 3, shortest: int = 4, least_snippet: int = 10) -> DataFrame:
    """(id_col, line, url, title, snippet, published) of each address of the pattern in a page, the first time it occurs.

    Title is the nearest line above, among ``around``, that holds no such address and is long enough; snippet likewise below;
    published the first date in the line and those around it.
    """
    rows = pages.select(id_col, page_lines(F.col(text_col)).alias("lines"))
    seen = F.flatten(F.transform("lines", lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(address), F.lit(0)), lambda u: F.struct(u.alias("url"), i.alias("line")))))
    rows = rows.select(id_col, "lines", seen.alias("seen"))
    before = lambda i: F.slice("lines", F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)))
    after = lambda i: F.slice("lines", i + 2, F.lit(around))
    fit = lambda lines, n: F.get(F.filter(lines, lambda x: (F.length(x) >= n) & ~x.rlike(address)), F.lit(0))
    each = rows.select(id_col, F.inline(F.transform("seen", lambda s: F.struct(
        s["line"].alias("line"), s["url"].alias("url"), F.coalesce(fit(F.reverse(before(s["line"])), shortest), F.lit("")).alias("title"), F.coalesce(fit(after(s["line"]), least_snippet), F.lit("")).alias("snippet"),
        F.array_join(F.concat(before(s["line"]), F.slice("lines", s["line"] + 1, F.lit(1)), after(s["line"])), " ").alias("around"),
    ))))
    day = lambda g: F.regexp_extract("around", r"\b(20\d{2})[./-](\d{1,2})[./-](\d{1,2})\b", g)
    published = F.concat_ws("-", day(1), F.lpad(day(2), 2, "0"), F.lpad(day(3), 2, "0")).try_cast("date")
    first = each.groupBy(id_col, "url").agg(F.min_by(F.struct("line", "title", "snippet", published.alias("published")), "line").alias("x"))
    return first.select(id_col, "x.line", "url", "x.title", "x.snippet", "x.published")


# Fixed pattern of addresses inside the portal, and the mark between the articles of a page read as one text.
INTERNAL = (
    r"search\.naver\.com|help\.naver\.com|nid\.naver\.com|section\.(blog|cafe)\.naver\.com|pay\.naver\.com|mail\.naver\.com|comic\.naver\.com|book\.naver\.com|kin\.naver\.com|stock\.naver\.com|dict\.naver\.com|"
    r"calendar\.naver\.com|blog\.naver\.com|cafe\.naver\.com|news\.naver\.com$|chzzk\.naver\.com|point\.pay\.naver\.com|m\.notify\.naver\.com|talks\.naver\.com"
)
ARTICLE_MARK = "Keep에 저장Keep에 바로가기"
KOREAN = r"[\x{AC00}-\x{D7AF}]"


def _numbered(pages: DataFrame, id_col: str, texts: Column) -> DataFrame:
    fit = F.array_distinct(F.filter(texts, lambda x: (F.length(x) >= 10) & x.rlike(KOREAN)))
    return pages.select(id_col, F.posexplode(fit).alias("nth", "headline"))


def linked_headlines(pages: DataFrame, id_col: str = "doc_id", text_col: str = "text", internal: str = INTERNAL, arrow: str = " → ") -> DataFrame:
    """(id_col, nth, headline): the distinct Korean texts, of ten characters or more, of a page's "text → address" lines that lead out of the portal."""
    cut = lambda x: F.split(x, arrow, 2)
    outside = F.filter(page_lines(F.col(text_col)), lambda x: F.contains(x, F.lit(arrow)) & trimmed(cut(x)[1]).rlike("^https?:") & ~trimmed(cut(x)[1]).rlike(internal))
    return _numbered(pages, id_col, F.transform(outside, lambda x: trimmed(cut(x)[0])))


def split_headlines(pages: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = ARTICLE_MARK) -> DataFrame:
    """(id_col, nth, headline) of pages that are one text: of what stands between marks the first sentence of 10 to 150 characters, else the first 100."""
    first = r"^(.{10,150}?)[.。]\s"
    parts = F.filter(F.split(text_col, mark), lambda x: F.length(x) >= 20)
    return _numbered(pages, id_col, F.transform(parts, lambda x: trimmed(F.when(x.rlike(first), F.regexp_extract(x, first, 1)).otherwise(F.substring(x, 1, 100)))))
