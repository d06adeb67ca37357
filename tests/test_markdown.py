import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import documents, markdown


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def cells(spark, *texts):
    return markdown.table_cells(documents.lines(docs(spark, *texts)))


def tables_by_hand(text):
    """Scans from the top: a header with a pipe, a divider, lines with pipes; goes on behind each table."""
    lines, out, i = text.split("\n"), [], 0
    row = lambda x: [c.strip() for c in re.sub(r"^\||\|$", "", x.strip()).split("|")]
    while i < len(lines):
        if "|" not in lines[i] or i + 1 >= len(lines) or not all(re.fullmatch(":?-{3,}:?", c) for c in row(lines[i + 1])):
            i += 1
            continue
        end = i + 2
        while end < len(lines) and "|" in lines[end]:
            end += 1
        out.append((i, [row(lines[i]), *map(row, lines[i + 2 : end])], row(lines[i + 1])))
        i = end
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tables_equal_a_scan(spark, seed):
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice(["| a | b |", "|---|:-:|", "---", "--- | ---:", "x", "|1|2|3|", "c|", "", "|"]) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    got = {}
    for r in cells(spark, *texts).collect():
        got.setdefault((r["doc_id"], r["table"], r["start_line"]), {})[(r["row"], r["col"])] = (r["text"], r["alignment"])
    want = {}
    for d, text in enumerate(texts):
        for k, (start, rows, marks) in enumerate(tables_by_hand(text)):
            side = lambda j, m=marks: None if j >= len(m) else "center" if re.fullmatch(":-{3,}:", m[j]) else "right" if m[j].endswith(":") else "left"
            want[(d, k, start)] = {(i, j): (row[j] if j < len(row) else "", side(j)) for i, row in enumerate(rows) for j in range(len(rows[0]))}
    assert got == want


def test_ragged_rows_and_alignment(spark):
    got = [(r["row"], r["col"], r["text"], r["alignment"]) for r in cells(spark, "t\n| 구분 | 값 |\n|:---|---:|\n| a |\n| b | 2 | 3 |\n\n| no table |").orderBy("row", "col").collect()]
    assert got == [(0, 0, "구분", "left"), (0, 1, "값", "right"), (1, 0, "a", "left"), (1, 1, "", "right"), (2, 0, "b", "left"), (2, 1, "2", "right")]


def test_table_lines(spark):
    got = [r["line"] for r in markdown.table_lines(cells(spark, "| a | b |\n|---|---|\n| x<br/>y | |")).orderBy("row").collect()]
    assert got == ["a\tb", "x\ny\t"]


def test_mismatches_of_shape_and_cell(spark):
    memo = "| **a** | `b` |\n|---|---|\n| [x](http://y) | 1<br>2 |\n\nt\n\n| c |\n|---|\n| d |\n"
    other = "| a | b |\n|---|---|\n| x (http://y) | 1 2 |\n"
    expected, actual = cells(spark, memo, memo, memo), cells(spark, other + "\nt\n\n| c |\n|---|\n| e |", memo.replace("| d |", "| d |\n| f |").replace("| c |\n|---|", "| c | g |\n|---|---|"), other)
    got = sorted((r["doc_id"], r["kind"], r["table"], r["row"], r["col"], r["expected"], r["actual"]) for r in markdown.table_mismatches(expected, actual).collect())
    assert got == [(0, "cell", 1, 1, 0, "d", "e"), (1, "columns", 1, None, None, "1", "2"), (1, "rows", 1, None, None, "2", "3"), (2, "tables", None, None, None, "2", "1")]


def memo(**change):
    parts = {name: ["본문"] for name in markdown.MEMO_SECTIONS} | {"DART Recheck": ["| 주장 | 상태 |", "|---|---|", *["| a | b |"] * 3], "Sources": ["- [a](http://b)"]}
    parts["Current Valuation Snapshot"] = ["Price Market Cap PER EV/EBITDA PBR", *["| x | 2024-01-02 |"] * 3]
    parts |= change
    return "\n".join(["기준일: 2024-01-10", *(x for k, v in parts.items() if v is not None for x in (f"## {k}", *v))])


def checks(spark, text, as_of="2024-01-20", files=()):
    listed = spark.createDataFrame([(0, f) for f in files], "doc_id int, target string")
    return {r["check"]: (r["passed"], r["detail"]) for r in markdown.memo_gate(docs(spark, text), listed, as_of).collect()}


def test_a_memo_in_order_passes_all_nine_checks(spark):
    found = checks(spark, memo())
    assert len(found) == 9 and all(p for p, _ in found.values())
    assert found["recheck-claims"] == (True, "3") and found["source-dates"] == (True, "3") and found["base-date-staleness"] == (True, "10")


@pytest.mark.parametrize(
    ("text", "failed", "detail"),
    [
        (memo(Risks=None, Summary=None), "required-sections", "Summary, Risks"), (memo(Risks=["", "  "]), "no-empty-sections", "Risks"), (memo().replace("기준일: 2024-01-10", ""), "base-date-present", ""),
        (memo().replace("2024-01-10", "`2024-01-01`"), "base-date-staleness", "19"), (memo(Risks=["![a](x.png) ![b](y.png)"]), "images-exist", "y.png"), (memo(**{"DART Recheck": None}), "recheck-table", ""),
        (memo(**{"DART Recheck": ["| a | b |", "| --- | --- |", "| 1 | 2 |", "|---|", "| 3 | 4 |"]}), "recheck-claims", "2"), (memo(**{"Current Valuation Snapshot": ["| price 2024-01-02 | 2024-01-02 | 2024-01-03 |", "pbr"]}), "valuation-metrics", "market cap, per, ev/ebitda"),
        (memo(**{"Current Valuation Snapshot": ["price market cap per ev/ebitda pbr 2024-01-02", "| 2024-01-02 |"]}), "source-dates", "1"),
    ],
)
def test_each_check_fails_alone(spark, text, failed, detail):
    found = checks(spark, text, files=["x.png"])
    assert {k for k, (p, _) in found.items() if not p} == {failed} and found[failed][1] == detail


def test_an_update_date_renews_a_memo(spark):
    text = memo().replace("2024-01-10", "2023-01-10\n최근 업데이트일: `2024/01/15`")
    assert checks(spark, text)["base-date-staleness"] == (True, "5")
    assert checks(spark, text, as_of="2024-02-15")["base-date-staleness"] == (False, "31")
    assert checks(spark, memo().replace("2024-01-10", "2024-13-40"))["base-date-staleness"] == (True, "")


def test_result_counts_by_severity(spark):
    listed = spark.createDataFrame([], "doc_id int, target string")
    got = markdown.gate_result(markdown.memo_gate(docs(spark, memo(Risks=None), memo(**{"DART Recheck": None}), ""), listed, "2024-01-20")).orderBy("doc_id").collect()
    assert [(r["errors"], r["warnings"], r["n_passed"], r["passed"]) for r in got] == [(1, 0, 8, False), (0, 1, 8, True), (2, 3, 4, False)]


def test_heading_audits(spark):
    audit = lambda text, kind, **more: sorted((r["problem"], r["detail"]) for r in markdown.heading_audit(docs(spark, text), kind, **more).collect())
    assert audit(memo(), "memo", need_recheck=True) == []
    changed = memo(Sources=["no link"], Risks=None).replace("\n## Summary", "\n최근 업데이트일: 2024-1-1\n![a](<b%20c.png>) ![d](https://x/y.png)\n## Summary")
    assert audit(changed, "memo", files=spark.createDataFrame([], "doc_id int, target string")) == [("date", "최근 업데이트일"), ("heading", "Risks"), ("heading", "Update Log"), ("image", "b c.png"), ("sources", "no links")]
    assert audit(memo(**{"DART Recheck": None}), "memo", need_recheck=True) == [("heading", "DART Recheck")]
    elsewhere = spark.createDataFrame([(0,)], "doc_id int")
    assert audit(memo(**{"DART Recheck": None}), "memo", need_recheck=True, recheck_elsewhere=elsewhere) == []
    sector = "\r\n".join(["기준일: 2024-01-10", *(f"## {s}" for s in markdown.SECTOR_SECTIONS), "- [a](http://b)"])
    assert audit(sector, "sector") == [] and audit(sector.replace("## 가치사슬", "## 사슬"), "sector") == [("heading", "가치사슬")]
    brief = "\n".join(["작성일: 2024-01-10", *(f"## {s}" for s in markdown.BRIEF_SECTIONS)])
    assert audit(brief, "brief") == [] and audit(brief.replace("작성일", "일자"), "brief") == [("date", "작성일")]


def test_baseline_of_a_memo(spark):
    text = "# LG CNS 분석\r\n- 기준일: `2024-01-10`\n최근 업데이트일: 2024-02-01\n## Summary\n\n![c](a.png)요약 [링크](http://a/1)\n\n\n끝\n## Update Log\n### 2024-02-01 Update\n- x\n### 2024-02-01 Update\n### 2024-03-01  Update \n## Sources\n- [차트](https://f/chart/005930.ks?x) https://g/2\n"
    r = markdown.memo_baseline(docs(spark, text, None, "no title\n## 요약\n" + "가" * 700)).orderBy("doc_id").collect()
    assert (r[0]["title"], r[0]["company"], r[0]["memo_date"], r[0]["recent_update"], r[0]["has_update_log"]) == ("LG CNS 분석", "LG CNS", "2024-01-10", "2024-02-01", True)
    assert r[0]["update_dates"] == ["2024-02-01", "2024-03-01"] and r[0]["source_urls"] == ["http://a/1", "https://f/chart/005930.ks?x", "https://g/2"]
    assert r[0]["summary"] == "요약 링크\n\n끝" and r[0]["ticker"] == "005930.KS"
    assert r[1]["title"] is None and r[2]["title"] is None and r[2]["summary"] == "가" * 600 and r[2]["ticker"] is None


def test_facts_of_a_reference(spark):
    text = "- reference 기준일: 2024-01-10\n- 완전 파싱: 12\n* 누락: `3`\n## 다음 업데이트 우선 확인 항목\n\n- 주석\n* 매출\n## DART Recheck\n- 다른 것"
    r = markdown.reference_facts(docs(spark, text, "")).orderBy("doc_id").collect()
    assert (r[0]["reference_date"], r[0]["n_parsed"], r[0]["n_missing"], r[0]["n_partial"], r[0]["next_checks"]) == ("2024-01-10", "12", "3", None, ["주석", "매출"])
    assert r[1]["next_checks"] == [] and r[1]["n_parsed"] is None


def test_text_without_tables_is_not_exchanged(spark):
    plan = cells(spark, "a\nb")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter .*Contains\(line|Filter .*forall", plan) and F is not None
