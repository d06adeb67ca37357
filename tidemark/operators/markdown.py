"""Markdown memos: tables, a check of rendered tables, the quality gate and heading audits.

Tables: a table is a line with a pipe, a divider line below it, and the lines with pipes that follow
without a gap. Only lines with a pipe and dividers leave their document's row, so text without tables is
never shuffled. Checks and audits are column functions inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.filings import BLANK, trimmed
from tidemark.operators.scalars import ticker_of

# Fixed patterns: divider cells, date labels, rows, images, links.
DIVIDER = r"^:?-{3,}:?$"
DATE = r"\d{4}[-/]\d{2}[-/]\d{2}"
BASE_DATE, UPDATE_DATE = "기준일", "최근 업데이트일"
TABLE_ROW, TABLE_RULE = r"^\|.+\|", r"^\|[-:| ]+\|$"
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
SOURCE_LINK = r"(?m)^- \[.+\]\(.+\)"
# Fixed headings and words of the checks.
MEMO_SECTIONS = (
    "Decision Frame", "Summary", "Business and Thesis", "Revenue Mix", "What The Latest Results Say", "Street / Alternative Views", "Current Valuation Snapshot", "Historical Valuation Bands",
    "Chart and Positioning", "Governance and Structure", "Catalysts", "Risks", "Uncomfortable Questions", "Decision-Changing Issues", "Structured Stance", "Follow-up Research Prompts",
)
SECTOR_SECTIONS = ("소개 및 연구 가정", "연구 범위와 방법론", "행정/정책 개요", "시장 풍경", "성장 드라이버와 제약", "가치사슬", "규제 프레임워크", "기술 변화", "경쟁 구도", "대표 상장사/비상장 플레이어 맵", "시장 기회와 미래 전망", "Sources")
BRIEF_SECTIONS = ("Request Summary", "Working Title", "Deliverable Mode", "Scope Definition", "In Scope", "Out of Scope", "Key Research Questions", "Required Source Ladder", "Proposed Outline", "Handoff Notes")
RECHECK, VALUATION, UPDATE_LOG, SOURCES = "DART Recheck", "Current Valuation Snapshot", "Update Log", "Sources"
VALUATION_WORDS = ("price", "market cap", "per", "ev/ebitda", "pbr")


def cells_of(line: Column) -> Column:
    """The trimmed cells of a table line; one pipe at either end is no cell's edge."""
    return F.transform(F.split(F.regexp_replace(trimmed(line), r"^\||\|$", ""), r"\|"), trimmed)


def table_cells(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, table, row, col, text, alignment, start_line) of the tables in lines (id_col, line_no, line).

    Tables are numbered from 0; row 0 is the header, the divider is none. Every row has as many cells as the header, padded with
    empty ones or cut. Alignment is null where the divider is shorter than the header. Tables do not overlap: in lines with pipes
    one after another the first header takes the rest; a divider without a pipe joins the next such stretch to its header.
    """
    pipe = F.contains("line", F.lit("|"))
    rows = lines.select(id_col, "line_no", "line", pipe.alias("pipe"), cells_of(F.col("line")).alias("cells"))
    rows = rows.select("*", F.forall("cells", lambda c: c.rlike(DIVIDER)).alias("rule")).where("pipe or rule")
    own = W.partitionBy(id_col).orderBy("line_no")
    next_to = lambda c, step: F.coalesce((F.lag("line_no", step).over(own) == F.col("line_no") - step) & F.lag(c, step).over(own), F.lit(False))
    rows = rows.withColumns({"after_pipe": next_to("pipe", 1), "before_rule": next_to("rule", -1), "before_pipe": next_to("pipe", -1)})
    rows = rows.withColumn("stretch", F.sum((F.col("pipe") & ~F.col("after_pipe")).cast("int")).over(own.rowsBetween(W.unboundedPreceding, 0)))
    header = F.col("pipe") & F.col("before_rule")
    stretches = rows.where("pipe").groupBy(id_col, "stretch").agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.min(F.when(header & F.col("before_pipe"), F.col("line_no"))).alias("head"), F.max(F.when(header & ~F.col("before_pipe"), F.col("line_no"))).alias("tail")
    )
    by = W.partitionBy(id_col).orderBy("stretch")
    bare = F.col("head").isNull() & F.col("tail").isNotNull()  # only its last line can be a header, with a divider without a pipe
    joined = F.coalesce(F.lag(bare).over(by) & (F.lag("last").over(by) + 2 == F.col("first")), F.lit(False))
    stretches = stretches.withColumns({"joined": joined, "tail_before": F.lag("tail").over(by)})
    stretches = stretches.withColumn("chain", F.sum((~F.col("joined")).cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    nth = F.row_number().over(W.partitionBy(id_col, "chain").orderBy("stretch")) - 1
    taken = F.col("joined") & (nth % 2 == 1)  # in a chain of such stretches every other one belongs to the header before it
    stretches = stretches.select(id_col, "stretch", F.when(taken, F.col("tail_before")).otherwise(F.coalesce("head", "tail")).alias("start"))
    tables = rows.join(stretches, [id_col, "stretch"]).where("line_no >= start and (pipe or line_no = start + 1)")
    at = F.when(F.col("line_no") == F.col("start"), 0).otherwise(F.col("line_no") - F.col("start") - 1)
    of = W.partitionBy(id_col, "start")
    tables = tables.withColumns({
        "width": F.max(F.when(F.col("line_no") == F.col("start"), F.size("cells"))).over(of), "marks": F.max(F.when(F.col("line_no") == F.col("start") + 1, F.col("cells"))).over(of),
        "table": F.sum((F.col("line_no") == F.col("start")).cast("int")).over(W.partitionBy(id_col).orderBy("start", "line_no").rowsBetween(W.unboundedPreceding, 0)) - 1,
    }).where("line_no <> start + 1")
    filled = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.struct(F.coalesce(F.get("cells", i), F.lit("")).alias("text"), F.get("marks", i).alias("mark")))
    each = tables.select(id_col, "table", at.alias("row"), F.col("start").alias("start_line"), F.posexplode(filled).alias("col", "c"))
    mark = F.col("c.mark")
    alignment = F.when(mark.rlike("^:-{3,}:$"), "center").when(mark.rlike("^-{3,}:$"), "right").when(mark.isNotNull(), "left")
    return each.select(id_col, "table", "row", "col", F.col("c.text").alias("text"), alignment.alias("alignment"), "start_line")


def table_lines(cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, table, row, line): the cells of a row set apart by tabs, with marked breaks as line ends."""
    text = F.regexp_replace("text", r"(?i)<br\s*/?>", "\n")
    own = F.array_sort(F.collect_list(F.struct("col", text.alias("text"))))
    return cells.groupBy(id_col, "table", "row").agg(F.array_join(F.transform(own, lambda c: c["text"]), "\t").alias("line"))


def shown_text(cell: Column) -> Column:
    """What a reader sees of a cell: breaks as lines, colours, bold and code without their marks, links as text and address."""
    for pattern, to in ((r"(?i)<br\s*/?>", "\n"), (r"\[(?:red|blue|brown):\s*([^\]]+)\]", "$1"), (r"\*\*([^*]+)\*\*", "$1"), ("`([^`]+)`", "$1"), (r"\[([^\]]+)\]\((https?://[^)]+)\)", "$1 ($2)")):
        cell = F.regexp_replace(cell, pattern, to)
    return cell


def table_mismatches(expected: DataFrame, actual: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, table, row, col, kind, expected, actual): a row for each difference of shape or cell.

    ``tables`` (numbers of tables), ``rows`` and ``columns`` (of a table that both have), ``cell`` (text of a cell of the expected
    one, blanks collapsed; a cell that is not there has none). Cells of tables that only one side has are not listed.
    """
    plain = lambda c: trimmed(F.regexp_replace(shown_text(c), f"{BLANK}+", " "))
    e = expected.select(id_col, "table", "row", "col", plain(F.col("text")).alias("e"))
    a = actual.select(id_col, "table", "row", "col", plain(F.col("text")).alias("a"))
    shape = lambda df, x: df.groupBy(id_col, "table").agg((F.max("row") + 1).alias(f"rows_{x}"), (F.max("col") + 1).alias(f"columns_{x}"))
    count = lambda df, x: df.groupBy(id_col).agg(F.count_distinct("table").alias(x))
    numbers = count(e, "e").join(count(a, "a"), id_col, "full").na.fill(0, ["e", "a"]).where("e <> a")
    none = F.lit(None).cast("int")
    text = lambda c: F.col(c).cast("string")
    found = numbers.select(id_col, none.alias("table"), none.alias("row"), none.alias("col"), F.lit("tables").alias("kind"), text("e").alias("expected"), text("a").alias("actual"))
    both = shape(e, "e").join(shape(a, "a"), [id_col, "table"])
    for kind in ("rows", "columns"):
        found = found.unionByName(both.where(f"{kind}_e <> {kind}_a").select(id_col, "table", none.alias("row"), none.alias("col"), F.lit(kind).alias("kind"), text(f"{kind}_e").alias("expected"), text(f"{kind}_a").alias("actual")))
    cells = e.join(both.select(id_col, "table"), [id_col, "table"]).join(a, [id_col, "table", "row", "col"], "left").withColumn("a", F.coalesce("a", F.lit("")))
    return found.unionByName(cells.where("e <> a").select(id_col, "table", "row", "col", F.lit("cell").alias("kind"), F.col("e").alias("expected"), F.col("a").alias("actual")))


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def section_lines(lines: Column, name: str) -> Column:
    """The lines below the first "##" heading that begins with name, up to the next; null without one."""
    at = F.array_position(F.transform(lines, lambda x: x.startswith(f"## {name}")), F.lit(True))
    rest = F.slice(lines, at.cast("int") + 1, F.size(lines))
    end = F.array_position(F.transform(rest, lambda x: x.startswith("## ")), F.lit(True))
    return F.when(at > 0, F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end.cast("int") - 1, F.lit(0)))).otherwise(rest))


def images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, target) of the images a memo shows."""
    return docs.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(IMAGE), F.lit(2))).alias("target"))


def _dated(text: Column, label: str) -> Column:
    return F.regexp_replace(F.nullif(F.regexp_extract(text, rf"{label}[:：]\s*`?({DATE})`?", 1), F.lit("")), "/", "-")


def memo_gate(docs: DataFrame, files: DataFrame, as_of: str, sections: tuple[str, ...] = MEMO_SECTIONS, words: tuple[str, ...] = VALUATION_WORDS, freshest: int = 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, check, severity, passed, detail): nine checks of each memo of docs; files (id_col, target) are the images that exist beside it."""
    text = F.col(text_col)
    lost = images(docs, id_col, text_col).join(files.select(id_col, "target").distinct(), [id_col, "target"], "left_anti")
    lost = lost.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set("target")), ", ").alias("__lost"))
    rows = docs.select(id_col, text_col, _lines(text).alias("lines"))
    rows = rows.select(
        id_col, text_col, "lines", section_lines(F.col("lines"), RECHECK).alias("recheck"), section_lines(F.col("lines"), VALUATION).alias("valuation"), F.filter("lines", lambda x: ~x.rlike(rf"^{BLANK}*$")).alias("full"),
    ).join(lost, id_col, "left")
    headings = F.transform(F.filter("lines", lambda x: x.startswith("## ")), lambda x: trimmed(F.substring(x, 4, 1 << 30)))
    missing = F.array_except(F.array(*map(F.lit, sections)), headings)
    dated = text.rlike(rf"{BASE_DATE}[：:]\s*{DATE}") | text.rlike(rf"{BASE_DATE}[：:]\s*`{DATE}`")
    base, update = _dated(text, BASE_DATE), _dated(text, UPDATE_DATE)
    age = F.datediff(F.lit(as_of).cast("date"), F.when(base.isNotNull(), F.coalesce(update, base)).try_cast("date"))
    title = lambda x: x.startswith("## ")
    empty = F.filter(F.transform("full", lambda x, i: F.when(title(x) & F.coalesce(title(F.get("full", i + 1)), F.lit(False)), trimmed(F.substring(x, 4, 1 << 30)))), lambda x: x.isNotNull())
    near = F.slice("recheck", F.lit(1), F.lit(49))
    table = F.coalesce(F.exists(near, lambda x: x.rlike(TABLE_ROW)), F.lit(False))
    rule = F.array_position(F.transform("recheck", lambda x: trimmed(x).rlike(TABLE_RULE)), F.lit(True)).cast("int")
    claims = F.when(rule > 0, F.size(F.filter(F.slice("recheck", rule + 1, F.size("recheck")), lambda x: x.rlike(TABLE_ROW) & ~trimmed(x).rlike(TABLE_RULE)))).otherwise(0)
    said = F.lower(F.array_join(F.coalesce("valuation", F.array()), "\n"))
    unsaid = F.filter(F.array(*map(F.lit, words)), lambda w: ~F.contains(said, w))
    dates = F.coalesce(F.aggregate("valuation", F.lit(0), lambda n, x: n + F.when(x.rlike(TABLE_ROW), F.regexp_count(x, F.lit(r"\d{4}-\d{2}-\d{2}"))).otherwise(0)), F.lit(0))
    names = lambda x: F.array_join(x, ", ")
    checks = [
        ("required-sections", "error", F.size(missing) == 0, names(missing)),
        ("base-date-present", "error", dated, F.coalesce(base, F.lit(""))),
        ("base-date-staleness", "warn", F.coalesce(age <= freshest, F.lit(True)), F.coalesce(age.cast("string"), F.lit(""))),
        ("no-empty-sections", "warn", F.size(empty) == 0, names(empty)),
        ("images-exist", "error", F.col("__lost").isNull(), F.coalesce("__lost", F.lit(""))),
        ("recheck-table", "warn", F.col("recheck").isNotNull() & table, F.lit("")),
        ("recheck-claims", "warn", F.col("recheck").isNull() | (claims >= 3), F.when(F.col("recheck").isNotNull(), claims.cast("string")).otherwise("")),
        ("valuation-metrics", "warn", F.size(unsaid) == 0, names(unsaid)),
        ("source-dates", "warn", dates >= 3, dates.cast("string")),
    ]
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("check"), F.lit(s).alias("severity"), p.alias("passed"), d.alias("detail")) for k, s, p, d in checks)))
    return rows.select(id_col, each)


def gate_result(checks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, errors, warnings, n_passed, passed) of each memo."""
    failed = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    return checks.groupBy(id_col).agg(failed("error").alias("errors"), failed("warn").alias("warnings"), F.count_if("passed").alias("n_passed"), (failed("error") == 0).alias("passed"))


def heading_audit(docs: DataFrame, kind: str, files: DataFrame | None = None, recheck_elsewhere: DataFrame | None = None, need_log: bool = False, need_recheck: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, problem, detail): what a ``memo``, ``sector`` report or ``brief`` lacks; a document in order has no row.

    files (id_col, target) are the images beside a memo; recheck_elsewhere (id_col) the memos whose reference text has the
    recheck section. Addresses on the web are not looked for.
    """
    label, sections = {"memo": (BASE_DATE, MEMO_SECTIONS), "sector": (BASE_DATE, SECTOR_SECTIONS), "brief": ("작성일", BRIEF_SECTIONS)}[kind]
    text = F.regexp_replace(text_col, r"\r\n?", "\n")
    rows = docs.select(id_col, text.alias("text")).select(id_col, "text", F.split("text", "\n").alias("lines"))
    has = lambda name: F.array_contains("lines", F.lit(f"## {name}"))
    dated = lambda name: F.col("text").rlike(rf"(?m)^{name}:\s+\d{{4}}-\d{{2}}-\d{{2}}$")
    problems = [(~dated(label), "date", label)] + [(~has(s), "heading", s) for s in sections]
    if kind == "memo":
        log = F.col("text").rlike(rf"(?m)^{UPDATE_DATE}:") | F.lit(need_log)
        problems += [(log & ~dated(UPDATE_DATE), "date", UPDATE_DATE), (log & ~has(UPDATE_LOG), "heading", UPDATE_LOG)]
    if kind != "brief":
        after = F.col("text").substr(F.locate("\n## Sources\n", F.col("text")) + F.lit(len("\n## Sources\n")), F.length("text"))
        after = F.split_part(after, F.lit("\n## Sources\n"), F.lit(1))
        inside = F.contains("text", F.lit("\n## Sources\n"))
        problems += [(~has(SOURCES), "heading", SOURCES)] * (kind == "memo") + [(~inside, "sources", "malformed"), (inside & ~after.rlike(SOURCE_LINK), "sources", "no links")]
    if kind == "memo" and need_recheck:
        known = docs.select(id_col).limit(0) if recheck_elsewhere is None else recheck_elsewhere.select(id_col).distinct()
        rows = rows.join(known.withColumn("elsewhere", F.lit(True)), id_col, "left")
        problems.append((~has(RECHECK) & F.col("elsewhere").isNull(), "heading", RECHECK))
    each = F.filter(F.array(*(F.when(p, F.struct(F.lit(a).alias("problem"), F.lit(b).alias("detail"))) for p, a, b in problems)), lambda x: x.isNotNull())
    found = rows.select(id_col, F.inline(each))
    if kind == "memo" and files is not None:
        targets = images(docs, id_col, text_col).withColumn("target", F.regexp_replace(F.trim("target"), "^<|>$", "")).where("not target rlike '(?i)^(https?:|mailto:)'")
        targets = targets.withColumn("target", F.coalesce(F.try_url_decode(F.replace("target", F.lit("+"), F.lit("%2B"))), "target")).distinct()
        lost = targets.join(files.select(id_col, "target").distinct(), [id_col, "target"], "left_anti")
        found = found.unionByName(lost.select(id_col, F.lit("image").alias("problem"), F.col("target").alias("detail")))
    return found


def labelled(text: Column, label: str) -> Column:
    """The value of the first "label: value" line, which may be a list item, without code marks; null without one."""
    value = trimmed(F.regexp_extract(text, rf"(?m)^(?:[-*]\s*)?{label}:\s*(.+)$", 1))
    return F.nullif(F.regexp_replace(value, "^`|`$", ""), F.lit(""))


def section_text(text: Column, name: str) -> Column:
    """What stands below the first "##" heading of exactly that name, up to the next; null without one or if empty."""
    return F.nullif(trimmed(F.regexp_extract(text, rf"(?sm)^##\s+{name}[ \t]*$(.*?)(?:\n##\s+|\z)", 1)), F.lit(""))


def memo_baseline(docs: DataFrame, summary: int = 600, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, title, company, memo_date, recent_update, has_update_log, update_dates, source_urls, summary, ticker) of memos: what an update starts from.

    Addresses of links come before bare ones, each once; the summary is without images and link targets. Only line ends
    are settled before; texts are read inside their rows.
    """
    rows = docs.select(id_col, F.replace(text_col, F.lit("\r"), F.lit("")).alias("text"))
    text = F.col("text")
    title = F.nullif(trimmed(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    company = F.regexp_replace(F.regexp_replace(title, r"(?i)\s+(analysis|memo|report)$", ""), r"\s+(분석 예시|분석|메모|리포트)$", "")
    every = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    urls = F.array_distinct(F.concat(every(r"\[[^\]]+\]\((https?://[^)\s]+)\)", 1), every(r"\bhttps?://[^\s)>]+", 0)))
    excerpt = F.coalesce(section_text(text, "Summary"), section_text(text, "요약"))
    excerpt = F.regexp_replace(F.regexp_replace(F.regexp_replace(excerpt, "\n{2,}", "\n\n"), r"!\[[^\]]*\]\([^)]+\)", ""), r"\[([^\]]+)\]\([^)]+\)", "$1")
    found = rows.select(
        id_col, title.alias("title"), trimmed(company).alias("company"), labelled(text, BASE_DATE).alias("memo_date"), labelled(text, UPDATE_DATE).alias("recent_update"), text.rlike(rf"(?m)^##\s+{UPDATE_LOG}\s*$").alias("has_update_log"),
        F.array_distinct(every(r"(?m)^###\s+(\d{4}-\d{2}-\d{2})\s+Update\s*$", 1)).alias("update_dates"), urls.alias("source_urls"), F.nullif(F.substring(trimmed(excerpt), 1, summary), F.lit("")).alias("summary"),
    )
    return found.withColumn("ticker", ticker_of(F.col("source_urls")))


#: Fixed labels of a reference text's facts.
REFERENCE = {
    "reference_date": "reference 기준일", "last_checked": "최근 확인일", "last_filing": "마지막 반영 공시일", "n_contents": "TOC 기준 섹션 수", "n_parsed": "완전 파싱", "n_partial": "부분 파싱", "n_missing": "누락", "n_needs_review": "재검토 필요",
}


def reference_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, the labelled facts of a reference text, next_checks: the items of its list of what to look at next)."""
    text = F.replace(text_col, F.lit("\r"), F.lit(""))
    listed = F.split(F.coalesce(section_text(text, "다음 업데이트 우선 확인 항목"), F.lit("")), "\n")
    items = F.filter(F.transform(listed, lambda x: trimmed(F.regexp_replace(x, r"^[-*]\s*", ""))), lambda x: x != "")
    return docs.select(id_col, *(labelled(text, label).alias(name) for name, label in REFERENCE.items()), items.alias("next_checks"))
