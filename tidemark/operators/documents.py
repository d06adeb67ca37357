"""Documents: pages to links and text, lines, bullets, links, reports and posts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ANCHOR = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, nth, href, text) of the links of each page."""
    both = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(g)).alias(n) for g, n in ((1, "href"), (2, "text"))))
    each = pages.select("page_id", F.posexplode(both).alias("nth", "a"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("a.text"), "<[^>]*>", ""), r"\s+", " "))
    return each.select("page_id", "nth", F.col("a.href").alias("href"), text.alias("text"))


def article_text(html: Column, least: int = 120, most: int = 2500) -> Column:
    """The longest article block, or div or section named like one, as text; without one of the least length, the whole page if it has that."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", " "), r"\s+", " "))
    named = r'(?is)<{0}\b[^>]*(?:id|class)="[^"]*(?:article|news|content|view|body)[^"]*"[^>]*>(.*?)</{0}>'
    patterns = [r"(?is)<article\b[^>]*>(.*?)</article>", named.format("div"), named.format("section")]
    found = F.concat(*(F.regexp_extract_all(html, F.lit(x), F.lit(1)) for x in patterns))
    blocks = F.filter(F.transform(found, plain), lambda x: F.length(x) >= least)
    longest = F.array_max(F.transform(blocks, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    page = plain(html)
    return F.substring(F.coalesce(longest, F.when(F.length(page) < least, "").otherwise(page)), 1, most)


class _Text(HTMLParser):
    """Text with a line for each block and cells set apart by pipes."""

    BLOCKS = {"p", "div", "section", "article", "li", "ul", "ol", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "nav", "footer", "header", "main", "aside", "pre", "body"}
    HIDDEN = {"script", "style", "head"}

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_to_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): nesting needs a parser, so this runs in Arrow batches."""

    def one(html: str | None) -> str:
        parser = _Text()
        parser.feed(html or "")
        lines = (" ".join(x.split()).rstrip(" |") for x in "".join(parser.out).split("\n"))
        return "\n".join(x for x in lines if x)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "text": [one(h) for h in b["html"]]})

    return pages.select("page_id", "html").mapInPandas(rows, "page_id long, text string")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_score(line: Column, keywords: list[str]) -> Column:
    """Two for an arrow, one for a digit and for each keyword, three less where figures and what stands between them make up the line."""
    total = F.when(F.contains(line, F.lit("→")), 2).otherwise(0) + F.when(line.rlike(r"\d"), 1).otherwise(0)
    for k in keywords:
        total = total + F.when(F.contains(line, F.lit(k)), 1).otherwise(0)
    figures = F.regexp_count(line, F.lit(r"[\d\s,.()/%-]")) / F.greatest(F.length(line), F.lit(1))
    return total - F.when(figures > 0.6, 3).otherwise(0)


def one_liner_score(line: Column, keywords: list[str]) -> Column:
    """line_score, one more for a whole sentence, one less for a line that breaks off at a comma or inside a bracket."""
    whole, broken = line.rlike(r"[.!?]$"), line.rlike(r"[,(]$|\([^)]*$")
    return line_score(line, keywords) + F.when(whole, 1).otherwise(0) - F.when(broken, 1).otherwise(0)


def bullets(lines_: DataFrame, keywords: list[str], most: int = 8, budget: int = 1200, shortest: int = 8, longest: int = 400, shown: int = 220, least: int = 5) -> DataFrame:
    """The best distinct lines of each document: ``least`` of them whatever their length, then up to ``most`` while they fit a budget of characters.

    Lines are scored whole and shown up to a length. The first that does not fit ends the choice.
    """
    x = lines_.select("doc_id", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line")).where(F.length("line").between(shortest, longest)).distinct().withColumn("score", line_score(F.col("line"), keywords))
    cut = F.when(F.length("line") <= shown, F.col("line")).otherwise(F.concat(F.rtrim(F.substring("line", 1, shown - 1)), F.lit("…")))
    by = W.partitionBy("doc_id").orderBy(F.desc("score"), "line")
    ranked = x.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).withColumn("bullet", cut)
    used = F.sum(F.length("bullet")).over(by.rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("used", used).where((F.col("rank") <= least) | (F.col("used") <= budget)).select("doc_id", "rank", F.col("bullet").alias("line"), "score", "used")


def split_narrative(lines_: DataFrame, roman: str = r"^\s*[IVX]+\.\s", decimal: str = r"^\s*\d+\.\s", longest: int = 80) -> DataFrame:
    """Sections by roman headings, or by decimal ones in documents without any; the others are marked as inner."""
    short = F.length("line") <= longest
    is_roman, is_decimal = short & F.col("line").rlike(roman), short & F.col("line").rlike(decimal)
    has_roman = F.max(is_roman).over(W.partitionBy("doc_id"))
    marked = lines_.withColumns({"has_roman": has_roman, "is_roman": is_roman, "is_decimal": is_decimal})
    outer = F.when(F.col("has_roman"), F.col("is_roman")).otherwise(F.col("is_decimal"))
    return marked.withColumns({"heading": outer, "inner": F.col("has_roman") & F.col("is_decimal")}).drop("has_roman", "is_roman", "is_decimal").withColumn(
        "section", F.sum(F.col("heading").cast("int")).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    )


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table, row, col, text) of HTML tables; every row has as many cells as the first of its table, padded with empty ones or cut."""
    every = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    tables = pages.select("page_id", F.posexplode(every(F.col("html"), r"(?is)<table\b[^>]*>(.*?)</table>")).alias("table", "body"))
    rows = tables.select("page_id", "table", F.transform(every(F.col("body"), r"(?is)<tr\b[^>]*>(.*?)</tr>"), lambda r: every(r, r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>")).alias("rows"))
    width = F.size(F.get("rows", F.lit(0)))
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"\s+", " "))
    each = rows.withColumn("width", width).select("page_id", "table", "width", F.posexplode("rows").alias("row", "cells")).where("width > 0")
    filled = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: plain(F.coalesce(F.get("cells", i), F.lit(""))))
    return each.select("page_id", "table", "row", F.posexplode(filled).alias("col", "text"))


def memo_parts(lines_: DataFrame, head: int = 40) -> DataFrame:
    """(doc_id, kind, nth, name, value): the "key: value" lines among the first ones, of equal keys the last, and the "##" sections with their bodies."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pair = r"^(?:[-*]\s+)?([^#:：]+)[:：]\s*(.+?)\s*$"
    keyed = lines_.where((F.col("line_no") < head) & F.col("line").rlike(pair)).withColumn("name", trim(F.regexp_extract("line", pair, 1)))
    value = F.regexp_replace(F.regexp_extract("line", pair, 2), "^`|`$", "")
    metadata = keyed.groupBy("doc_id", "name").agg(F.max("line_no").alias("nth"), F.max_by(value, "line_no").alias("value")).select("doc_id", F.lit("metadata").alias("kind"), "nth", "name", "value")
    heading = r"^##\s+(.+?)\s*$"
    is_heading = F.col("line").rlike(heading)
    running = F.sum(is_heading.cast("int")).over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    rows = lines_.withColumns({"nth": running, "h": is_heading}).where("nth > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    sections_ = rows.groupBy("doc_id", "nth").agg(F.max(F.when(F.col("h"), F.regexp_extract("line", heading, 1))).alias("name"), trim(body).alias("value"))
    return metadata.unionByName(sections_.select("doc_id", F.lit("section").alias("kind"), "nth", "name", "value"))


def link_lines(lines_: DataFrame, arrow: str = " → ", key: str = r"[?&](?:id|no)=([^&#]+)", least: int = 4) -> DataFrame:
    """Links written as "text → url" lines, the first of each id and document, with the line after as snippet."""
    by = W.partitionBy("doc_id").orderBy("line_no")
    parts = F.split("line", arrow, 2)
    rows = lines_.withColumn("snippet", F.lead("line").over(by)).where(F.contains("line", F.lit(arrow)))
    rows = rows.select("doc_id", "line_no", F.trim(parts[0]).alias("title"), F.trim(parts[1]).alias("url"), "snippet")
    rows = rows.withColumn("link_id", F.coalesce(F.nullif(F.regexp_extract("url", key, 1), F.lit("")), F.col("url"))).where(F.length("title") >= least)
    return rows.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "link_id").orderBy("line_no"))).where("k = 1").drop("k")


def link_text_match(links: DataFrame, texts: DataFrame) -> DataFrame:
    """Each link (page_id, nth, title) with the first unused text row (page_id, row, text) where one begins with the other.

    The choice goes through a page's links in order, so it is a grouped map over pages.
    """

    def one(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, out = b.sort_values("row")[["row", "text"]].values.tolist(), []
        for nth, title in a.sort_values("nth")[["nth", "title"]].itertuples(index=False):
            at = next((i for i, (_, t) in enumerate(left) if title and t and (t.startswith(title) or title.startswith(t))), None)
            out.append((key[0], nth, None if at is None else left.pop(at)[0]))
        return pd.DataFrame(out, columns=["page_id", "nth", "row"]).astype({"row": "Int64"})

    return links.groupBy("page_id").cogroup(texts.groupBy("page_id")).applyInPandas(one, "page_id long, nth int, row long")


def post_views(lines_: DataFrame, date: str = r"^\d{4}\. ?\d{1,2}\. ?\d{1,2}\.", chrome: list[str] | None = None) -> DataFrame:
    """(doc_id, title, date_line, body): the second line above the first date line is the title, else the longest of the first eight."""
    own = lines_.where(~F.trim("line").isin(*(chrome or [""])) & (F.trim("line") != ""))
    by = W.partitionBy("doc_id").orderBy("line_no")
    rows = own.withColumns({"k": F.row_number().over(by), "above": F.lag("line", 2).over(by), "is_date": F.col("line").rlike(date)})
    rows = rows.withColumn("first_date", F.min(F.when(F.col("is_date"), F.col("k"))).over(W.partitionBy("doc_id")))
    at = F.col("k") == F.col("first_date")
    longest = F.max_by(F.when(F.col("k") <= 8, F.col("line")), F.when(F.col("k") <= 8, F.struct(F.length("line"), -F.col("k"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") > F.coalesce("first_date", F.lit(0)), F.struct("k", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id").agg(F.coalesce(F.max(F.when(at, F.col("above"))), longest).alias("title"), F.max(F.when(at, F.col("line"))).alias("date_line"), body.alias("body"))
