"""Filing texts: contents and sections by a heading grammar, and how well the sections cover the contents.

Lines are classified inside the row, so the text of a filing is never shuffled; what leaves a row are
its headings, or its sections one by one. Line numbers count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.sources.shared import written

#: What counts as blank: also the wide and the unbreakable blank.
BLANK = r"[\t-\r\p{Z}\x{FEFF}]"
# Fixed patterns: the line that parts contents and body, three heading forms, lines without meaning, numbers.
BODY_START = rf"(?i)전자공시시스템{BLANK}+dart\.fss\.or\.kr{BLANK}+Page{BLANK}+1"
BRACKET = r"^【[^】]+】$"
ROMAN = rf"^[IVX]+\.{BLANK}+.+$"
DECIMAL = rf"^\d+(?:-\d+)?(?:\.\d+)*\.{BLANK}+.+$"
TOKEN = r"^(\d+(?:-\d+)?(?:\.\d+)*)\."
PREFIX = rf"^(?:[IVX]+\.{BLANK}+|\d+(?:-\d+)?(?:\.\d+)*\.{BLANK}+|【[^】]+】{BLANK}*)"
FIGURE = rf"(?:^|{BLANK})[△-]?\d[\d,]*(?:\.\d+)?%?"
DASHES = rf"(?:{BLANK}+-){{2,}}"
LEADER = rf"^{BLANK}*\.{{4,}}\d+{BLANK}*$"
FULL = r"[^\t-\r\p{Z}\x{FEFF}]"
NUMBER = rf"\d[\d,]*(?:\.\d+)?(?:{BLANK}*(?:억원|백만원|천원|%|배|원))?"
REVIEW_HEAVY = "재무|주석|손익|현금흐름|자본변동|재무상태|특수관계자|부문별보고|매출및수주|영업부문|우발부채|보고기간후사건"
NO_PREVIEW = "본문 길이 부족"
#: What a heading line begins with, its first characters that are not blank, and what parts sections while they are one text: no character of any text.
MAYBE, HEADERS, PART = rf"^{BLANK}*(?:【|[IVX]+\.|\d)", "【IVX0123456789", "\uffff"
#: The characters of BLANK.
BLANKS = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def begins(x: Column, chars: str) -> Column:
    """Whether the first character of x is one of chars: a cheap look before a pattern, which would decode the whole line."""
    return F.substring(x, 1, 1).isin(*chars)


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def marked(lines: Column) -> Column:
    """For each line its heading (no, title, level, kind, tabular), or null: bracket and roman at level 1, numbers below by their depth.

    The line at which the body starts is of the kind ``start``. What several rules use is a field of its own, made by a pass of
    its own: Spark would otherwise compute it anew for each use.
    """
    start = lambda x: F.contains(x, F.lit("전자공시시스템")) & x.rlike(BODY_START)

    def titled(x: Column, i: Column) -> Column:
        return F.when(start(x) | (begins(x, BLANKS + HEADERS) & x.rlike(MAYBE)), F.struct((i + 1).alias("no"), trimmed(x).alias("title"), start(x).alias("start"), x.rlike(f"^{BLANK}").alias("indented")))

    def kinds(m: Column) -> Column:
        title = m["title"]
        token = F.regexp_extract(title, TOKEN, 1)
        kind = F.when(m["start"], "start").when(title.rlike(BRACKET), "bracket").when(title.rlike(ROMAN), "roman").when(title.rlike(DECIMAL), F.when(F.contains(token, F.lit("-")), "hyphen-decimal").otherwise("decimal"))
        return F.when(m.isNotNull(), F.struct(m["no"].alias("no"), title.alias("title"), m["indented"].alias("indented"), kind.alias("kind"), token.alias("token"), F.regexp_replace(title, PREFIX, "").alias("rest")))

    def heads(m: Column) -> Column:
        kind, rest = m["kind"], m["rest"]
        level = F.when(kind == "start", 0).when(kind.isin("bracket", "roman"), 1).otherwise(2 + F.regexp_count(m["token"], F.lit(r"[.-]")))
        tabular = (kind == "start") | (m["indented"] & (kind != "bracket")) | rest.rlike(DASHES) | (F.regexp_count(rest, F.lit(FIGURE)) >= 2)
        return F.when(kind.isNotNull(), F.struct(m["no"].alias("no"), m["title"].alias("title"), level.cast("int").alias("level"), kind.alias("kind"), tabular.alias("tabular")))

    return F.transform(F.transform(F.transform(lines, titled), kinds), heads)


def _parsed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, contents, headings, bodies, n_lines): headings up to the body's start, those of the body that are no rows of figures, and the text below each.

    What a lambda function uses of other columns would be computed anew for each element, unless it is a column of the frame before.
    """
    texts = docs.select(id_col, F.col(text_col).alias("text"))
    for c in ("\r", PART):  # a search for what is rare is cheaper than its replacement
        texts = texts.select(id_col, F.when(F.contains("text", F.lit(c)), F.replace("text", F.lit(c), F.lit(""))).otherwise(F.col("text")).alias("text"))
    rows = texts.select(id_col, F.split("text", "\n").alias("lines")).select(id_col, "lines", marked(F.col("lines")).alias("marks"))
    rows = rows.select(id_col, "lines", "marks", F.filter("marks", lambda h: h.isNotNull()).alias("heads"))
    rows = rows.select(id_col, "lines", "marks", "heads", F.array_position(F.transform("heads", lambda h: h["kind"]), F.lit("start")).cast("int").alias("start"))
    before, after = F.slice("heads", F.lit(1), F.greatest(F.col("start") - 1, F.lit(0))), F.slice("heads", F.col("start") + 1, F.size("heads"))
    rows = rows.select(id_col, "lines", "marks", before.alias("before"), after.alias("after"), F.coalesce(F.get("heads", F.col("start") - 1)["no"], F.lit(1)).alias("first"), F.size("lines").alias("n_lines"))
    meant = lambda x: (x != "") & (~begins(x, BLANKS + ".") | (x.rlike(FULL) & ~x.rlike(LEADER)))
    part = lambda x, i: F.when(i + 1 < F.col("first"), None).when(~F.get("marks", i)["tabular"], PART).when(meant(x), x)
    bodies = F.split(F.array_join(F.filter(F.transform("lines", part), lambda x: x.isNotNull()), "\n"), PART)  # the first part stands above all headings
    return rows.select(id_col, F.filter("before", lambda h: h["kind"] != "start").alias("contents"), F.filter("after", lambda h: ~h["tabular"]).alias("headings"), bodies.alias("bodies"), "n_lines")


def contents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line_no, title, level, kind) of the headings before the body's start."""
    each = _parsed(docs, id_col, text_col).select(id_col, F.inline("contents"))
    return each.select(id_col, F.col("no").alias("line_no"), "title", "level", "kind")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, section, title, level, kind, anchor, start_line, end_line, content, preview and sizes) of the body's sections, numbered from 1.

    A section runs to the line before the next heading, of whatever level.
    """
    rows = _parsed(docs, id_col, text_col).select(id_col, "headings", "bodies", "n_lines")
    return _described(rows.select(id_col, F.inline(_sections())))


def outline(docs: DataFrame, facts: list[str], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``contents``, and of ``sections`` the number, title, level and the named facts, of one reading of the texts.

    Both are rows of one table in the shared folder, which holds these facts but no texts.
    """
    entry = lambda h: F.struct(F.lit(None).cast("int").alias("section"), h["title"].alias("title"), h["level"].alias("level"), h["kind"].alias("kind"), h["no"].alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("raw"))
    each = _parsed(docs, id_col, text_col).select(id_col, F.inline(F.concat(F.transform("contents", entry), _sections())))
    found = written(_described(each).select(id_col, "section", "title", "level", "kind", F.col("start_line").alias("line_no"), *facts), "outline")
    toc = found.where("section is null").select(id_col, "line_no", "title", "level", "kind")
    return toc, found.where("section is not null").select(id_col, "section", "title", "level", *facts)


def _sections() -> Column:
    """Rows (section, title, level, kind, start_line, end_line, raw) of what ``_parsed`` gives."""
    end = lambda i: F.coalesce(F.get("headings", i + 1)["no"] - 1, F.col("n_lines"))
    return F.transform("headings", lambda h, i: F.struct((i + 1).alias("section"), h["title"].alias("title"), h["level"].alias("level"), h["kind"].alias("kind"), h["no"].alias("start_line"), end(i).alias("end_line"), F.get("bodies", i + 1).alias("raw")))


def _described(each: DataFrame) -> DataFrame:
    """Sections with their content, preview and sizes, from the raw text below each heading."""
    # Of a pattern that is rare, only texts that can have it are searched; single blanks are left as they are.
    blanks = F.when(F.contains("raw", F.lit("\t")) | F.contains("raw", F.lit("  ")), F.regexp_replace("raw", "\t[\t ]*| [\t ]+", " ")).otherwise(F.col("raw"))
    each = each.withColumn("raw", blanks)
    breaks = F.when(F.contains("raw", F.lit("\n\n\n")), F.regexp_replace("raw", "\n{3,}", "\n\n")).otherwise(F.col("raw"))
    each = each.withColumn("content", trimmed(breaks)).drop("raw")
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9가-힣]+", "-"), "^-+|-+$", ""), 1, 100)
    row = lambda x: F.startswith(x, F.lit("|")) & F.endswith(x, F.lit("|")) & (x != "|")
    return each.withColumns({
        "anchor": slug, "content_length": F.length("content"), "table_count": F.size(F.filter(F.split("content", "\n"), row)), "numeric_count": F.regexp_count("content", F.lit(NUMBER)),
        "paragraph_count": F.when(F.col("content") == "", 0).otherwise(F.size(F.split("content", "\n\n+"))), "preview": F.when(F.col("content") == "", NO_PREVIEW).otherwise(F.substring("content", 1, 280)),
    })


def section_status(title: str = "title", review_heavy: str = REVIEW_HEAVY) -> Column:
    """missing (empty), partial (under 140 characters, or under 300 with one number at most), needs_review (a title of figures without any), or parsed."""
    n, numbers, tables = (F.col(x) for x in ("content_length", "numeric_count", "table_count"))
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "missing").when(n < 140, "partial")
        .when(F.col(title).rlike(review_heavy) & (numbers == 0) & (tables == 0), "needs_review")
        .when((n < 300) & (numbers <= 1), "partial").otherwise("parsed")
    )


def normal_title(title: Column) -> Column:
    """Lower case, without a leader and page number at the end, blanks and punctuation."""
    x = F.lower(title)
    paged = F.substring(title, -1, 1).between("0", "9")
    x = F.when(paged, F.regexp_replace(F.regexp_replace(x, rf"\.{{2,}}{BLANK}*\d+$", ""), rf"{BLANK}+\d+$", "")).otherwise(x)
    return F.translate(x, BLANKS + "【】()[],.:;`'\"-", "")


def toc_sections(toc: DataFrame, sections_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Contents entries (id_col, line_no, title, level) with the section of the same title, of several the longest, of those the first."""
    facts = ["section", "content_length", "table_count", "numeric_count", "status"]
    one = F.struct(F.col("content_length").alias("longest"), (-F.col("section")).alias("earliest"), *facts)
    found = sections_.where(F.col(id_col).isNotNull() & F.col("title").isNotNull()).select(id_col, normal_title(F.col("title")).alias("key"), one.alias("own"))
    # Sections stand before the entries of their title, so one exchange and one sort of both give each entry the best.
    along = W.partitionBy(id_col, "key").orderBy(F.col("own").isNull()).rowsBetween(W.unboundedPreceding, 0)
    rows = toc.withColumn("key", normal_title(F.col("title"))).unionByName(found, allowMissingColumns=True)
    out = rows.withColumn("best", F.max("own").over(along)).where("own is null")
    zero = lambda c: F.coalesce(F.col(f"best.{c}"), F.lit(0)).alias(c)
    return out.select(*toc.columns, "best.section", *map(zero, facts[1:4]), F.coalesce("best.status", F.lit("missing")).alias("status"))


def container_status(items: DataFrame, deepest: int = 2, id_col: str = "doc_id") -> DataFrame:
    """items (id_col, line_no, level, status, ...), where a missing entry of level ``deepest`` or above takes its status from its direct children.

    A child is any later entry of a deeper level; it is direct unless an earlier child's level lies between the two.
    So an entry c is a direct child of those entries of level p that stand after the last entry before c with a level between p
    and c's, and before c. For each level p these stretches are summed as they begin and end, in one pass over a document.
    """
    own = items.select(id_col, "line_no", "level", "status")
    spread = own.withColumn("l", F.explode(F.sequence(F.lit(1), F.col("level"))))
    before = F.max(F.when(F.col("l") == F.col("level"), F.col("line_no"))).over(W.partitionBy(id_col, "l").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    barred = spread.withColumn("last", before).where("l < level").groupBy(id_col, "line_no", "level", "status")
    parents = range(1, deepest + 1)
    barred = barred.agg(*(F.max(F.when(F.col("l") > p, F.col("last"))).alias(f"b{p}") for p in parents))
    ends = F.explode(F.array(*(F.struct(F.lit(p).alias("parent"), at.alias("at"), F.lit(sign).alias("sign")) for p in parents for at, sign in ((F.coalesce(f"b{p}", F.lit(-1)), 1), (F.col("line_no"), -1)))))
    events = barred.select(id_col, "level", "status", ends.alias("e")).where("e.parent < level").select(id_col, "e.*", *((F.col("e.sign") * (F.col("status") == s).cast("int")).alias(s) for s in ("parsed", "partial")))
    asked = own.where((F.col("status") == "missing") & (F.col("level") <= deepest)).select(id_col, F.col("level").alias("parent"), F.col("line_no").alias("at"))
    along = W.partitionBy(id_col, "parent").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    sums = events.unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    sums = sums.select(id_col, "at", "asked", *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"n_{c}") for c in ("sign", "parsed", "partial"))).where("asked")
    status = F.when((F.col("n_parsed") > 0) & (F.col("n_parsed") == F.col("n_sign")), "parsed").when((F.col("n_parsed") > 0) | (F.col("n_partial") > 0), "partial")
    found = sums.select(id_col, F.col("at").alias("line_no"), status.alias("from_children"))
    return items.join(found, [id_col, "line_no"], "left").withColumn("status", F.coalesce("from_children", "status")).select(*items.columns)


def coverage_items(toc: DataFrame, sections_: DataFrame, id_col: str = "doc_id", review_heavy: str = REVIEW_HEAVY) -> DataFrame:
    """Contents entries with their section, its sizes and the status of entry or children."""
    items = toc_sections(toc, sections_.withColumn("status", section_status(review_heavy=review_heavy)), id_col)
    return container_status(written(items, "contents"), id_col=id_col)


def coverage_report(items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n, n_parsed, ..., completion, and the titles that are partial, missing or to be reviewed, in their order)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    titles = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("line_no", "title")))), lambda x: x["title"]).alias(f"{s}_titles")
    out = items.groupBy(id_col).agg(F.count("*").alias("n"), *map(count, ("parsed", "partial", "missing", "needs_review")), *map(titles, ("partial", "missing", "needs_review")))
    return out.withColumn("completion", F.round(F.col("n_parsed") / F.col("n"), 4))


def section_evidence(sections_: DataFrame, items: DataFrame, deepest: int = 2, most: int = 20, shown: int = 180, id_col: str = "doc_id") -> DataFrame:
    """(id_col, rank, title, summary, status) of the first sections down to a level; status is that of the first contents entry that is
    theirs or has their title, else ``unmatched``.
    """
    key = sections_.where(F.col("level") <= deepest).withColumn("rank", F.row_number().over(W.partitionBy(id_col).orderBy("section"))).where(F.col("rank") <= most)
    key = key.select(id_col, "rank", "section", "title", F.when(F.length("preview") <= shown, F.col("preview")).otherwise(F.concat(F.substring("preview", 1, shown - 3), F.lit("..."))).alias("summary"))
    entry = F.min_by("status", "line_no")
    by_section = items.where("section is not null").groupBy(id_col, "section").agg(F.struct(F.min("line_no").alias("at"), entry.alias("status")).alias("a"))
    by_title = items.groupBy(id_col, "title").agg(F.struct(F.min("line_no").alias("at"), entry.alias("status")).alias("b"))
    both = key.join(by_section, [id_col, "section"], "left").join(by_title, [id_col, "title"], "left")
    return both.select(id_col, "rank", "title", "summary", F.coalesce(F.least("a", "b")["status"], F.lit("unmatched")).alias("status"))


def next_checks(items: DataFrame, most: int = 12, id_col: str = "doc_id") -> DataFrame:
    """(id_col, rank, title, status) of what to look at next: missing entries, then those to be reviewed, in their order."""
    again = items.where(F.col("status").isin("missing", "needs_review"))
    rank = F.row_number().over(W.partitionBy(id_col).orderBy(F.col("status") != "missing", "line_no"))
    return again.withColumn("rank", rank).where(F.col("rank") <= most).select(id_col, "rank", "title", "status")
