import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import filings

MARK = "전자공시시스템  dart.fss.or.kr\tPage 1"
FILING = "\n".join([
    "【 대표이사 등의 확인 】", "I. 회사의 개요 ..... 1", "1. 회사의 개황 ..... 2", "1-1. 연결대상 ..... 3", "II. 사업의 내용", "2.1.1. 시장 여건", "VII. 없는 장 ..... 9", MARK,
    "【 대표이사 등의 확인 】", "확인함", "I. 회사의 개요", "......12", "", "1. 회사의 개황", "당사는 1990년에 설립되었습니다. " + "본문 " * 100, "1-1. 연결대상", "| 구분 | 금액 |", "|  a\t| 1,200억원 |", "   2. 들여쓴 줄", "3. 매출 1,000 2,000", "4. 표 - - 1",
    "  【 괄호 】", "II. 사업의 내용", "III. 재무에 관한 사항", "설명 " * 60, "2.1.1. 시장 여건", "　", "점유율 12.5% 1,300 백만원 3배 " * 12,
])


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_headings_by_kind_and_depth(spark):
    got = [(r["line_no"], r["title"], r["level"], r["kind"]) for r in filings.contents(docs(spark, FILING)).orderBy("line_no").collect()]
    assert got == [
        (1, "【 대표이사 등의 확인 】", 1, "bracket"), (2, "I. 회사의 개요 ..... 1", 1, "roman"), (3, "1. 회사의 개황 ..... 2", 2, "decimal"), (4, "1-1. 연결대상 ..... 3", 3, "hyphen-decimal"),
        (5, "II. 사업의 내용", 1, "roman"), (6, "2.1.1. 시장 여건", 4, "decimal"), (7, "VII. 없는 장 ..... 9", 1, "roman"),
    ]


def test_sections_leave_out_rows_of_figures(spark):
    got = {r["title"]: r for r in filings.sections(docs(spark, FILING.replace("\n", "\r\n"), None, "", "no heading")).collect()}
    assert list(got) == ["【 대표이사 등의 확인 】", "I. 회사의 개요", "1. 회사의 개황", "1-1. 연결대상", "【 괄호 】", "II. 사업의 내용", "III. 재무에 관한 사항", "2.1.1. 시장 여건"]
    tables = got["1-1. 연결대상"]
    assert (tables["start_line"], tables["end_line"], tables["table_count"], tables["paragraph_count"]) == (16, 21, 2, 1)
    assert tables["content"].split("\n") == ["| 구분 | 금액 |", "| a | 1,200억원 |", " 2. 들여쓴 줄", "3. 매출 1,000 2,000", "4. 표 - - 1"]
    empty = got["I. 회사의 개요"]
    assert (empty["content"], empty["preview"], empty["content_length"], empty["paragraph_count"]) == ("", filings.NO_PREVIEW, 0, 0)
    assert got["2.1.1. 시장 여건"]["numeric_count"] == 36 and got["2.1.1. 시장 여건"]["anchor"] == "2-1-1-시장-여건"
    assert len(got["1. 회사의 개황"]["preview"]) == 280


def test_without_a_mark_all_is_body(spark):
    d = docs(spark, "1. a\ntext\n2. b")
    assert filings.contents(d).count() == 0
    assert [(r["section"], r["start_line"], r["end_line"]) for r in filings.sections(d).orderBy("section").collect()] == [(1, 1, 2), (2, 3, 3)]


def test_coverage(spark):
    d = docs(spark, FILING)
    items = filings.coverage_items(filings.contents(d), filings.sections(d))
    got = {r["title"]: r["status"] for r in items.collect()}
    assert got == {
        "【 대표이사 등의 확인 】": "partial", "I. 회사의 개요 ..... 1": "parsed", "1. 회사의 개황 ..... 2": "parsed", "1-1. 연결대상 ..... 3": "partial",
        "II. 사업의 내용": "parsed", "2.1.1. 시장 여건": "parsed", "VII. 없는 장 ..... 9": "missing",
    }
    report = filings.coverage_report(items).first()
    assert (report["n"], report["n_parsed"], report["n_partial"], report["n_missing"], report["completion"]) == (7, 4, 2, 1, 0.5714)
    assert report["missing_titles"] == ["VII. 없는 장 ..... 9"] and len(report["partial_titles"]) == 2
    status = {r["title"]: r["status"] for r in filings.sections(d).withColumn("status", filings.section_status()).collect()}
    assert status["III. 재무에 관한 사항"] == "needs_review"
    assert [(r["rank"], r["title"]) for r in filings.next_checks(items).collect()] == [(1, "VII. 없는 장 ..... 9")]
    evidence = {r["title"]: r["status"] for r in filings.section_evidence(filings.sections(d), items).collect()}
    assert evidence["II. 사업의 내용"] == "parsed" and evidence["III. 재무에 관한 사항"] == "unmatched" and evidence["1. 회사의 개황"] == "parsed"


def children_by_hand(items, deepest=2):
    out = {}
    for d, no, level, status in items:
        kids = [x for x in items if x[0] == d and x[1] > no and x[2] > level]
        direct = [c for c in kids if not any(o[1] < c[1] and o[2] < c[2] for o in kids)]
        if status == "missing" and level <= deepest and direct:
            parsed, partial = (sum(c[3] == s for c in direct) for s in ("parsed", "partial"))
            status = ("parsed" if parsed == len(direct) else "partial") if parsed else "partial" if partial else status
        out[(d, no)] = status
    return out


@pytest.mark.parametrize("seed", range(4))
def test_children_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    items = [(d, no, rng.randint(1, 5), rng.choice(["missing", "missing", "parsed", "partial", "needs_review"])) for d in range(12) for no in range(1, rng.randint(2, 40))]
    df = spark.createDataFrame(items, "doc_id int, line_no int, level int, status string")
    assert {(r["doc_id"], r["line_no"]): r["status"] for r in filings.container_status(df).collect()} == children_by_hand(items)


def test_a_text_of_many_headings_is_not_exchanged(spark):
    text = "\n".join(f"{i}. heading\nbody {i}" for i in range(3000))
    found = filings.sections(docs(spark, text))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.agg(F.count("*"), F.max("end_line")).first()[:] == (3000, 6000)


def test_the_outline_is_one_reading_of_contents_and_sections(spark):
    d = docs(spark, FILING, "1. a\ntext\n2. b\n| 1 | 2 |\n|\n| x", None, "")
    toc, found = filings.outline(d, ["content_length", "table_count", "numeric_count", "preview"])
    assert sorted(map(tuple, toc.collect())) == sorted(map(tuple, filings.contents(d).select(*toc.columns).collect())) and toc.count() == 7
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, filings.sections(d).select(*found.columns).collect())) and found.count() == 10
    assert "raw" not in toc.columns + found.columns and "content" not in found.columns
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (toc, found)]
    assert all("Generate" not in p for p in plans)  # both read the written table, no text


def test_blanks_at_the_ends_are_those_of_the_grammar(spark):
    each = [c for c in map(chr, range(0xFFFF)) if not 0xD800 <= ord(c) < 0xE000]
    df = spark.createDataFrame([(c, f"{c} a {c}") for c in each if c not in ("\x00",)], "c string, t string")
    got = df.where(filings.trimmed(F.col("t")) == "a").select("c", F.col("c").rlike(filings.BLANK).alias("blank")).collect()
    assert {r["c"] for r in got} == set(filings.BLANKS) and all(r["blank"] for r in got)
    assert df.where(F.col("c").rlike(filings.BLANK)).count() == len(filings.BLANKS)
    assert df.limit(1).select(filings.trimmed(F.lit("a \x85"))).first()[0] == "a \x85"  # before, a blank before such a line end went too, against the SQL


def test_entries_find_their_section_without_a_join(spark):
    head = "section int, title string, content_length int, table_count int, numeric_count int, status string"
    toc = spark.createDataFrame([(1, 1, "1. A b ... 3", 2), (1, 2, "1. ab", 2), (1, 3, "2. c", 2), (2, 1, "1. Ab", 2), (None, 1, "1. ab", 2), (1, 2, "1. ab", 2)], "doc_id int, line_no int, title string, level int")
    found = spark.createDataFrame([(1, 1, "1. ab", 5, 0, 1, "x"), (1, 2, "1. A-B", 9, 2, 0, "y"), (1, 3, "1. [ab]", 9, 0, 0, "z"), (1, 4, None, 99, 0, 0, "n"), (None, 1, "1. ab", 7, 0, 0, "w"), (3, 1, "2. c", 7, 0, 0, "v")], "doc_id int, " + head)
    got = filings.toc_sections(toc, found)
    plan = got._jdf.queryExecution().executedPlan().toString()
    none = (None, 0, 0, 0, "missing")
    best = (2, 9, 2, 0, "y")
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == sorted([(1, 1, "1. A b ... 3", 2, *best), (1, 2, "1. ab", 2, *best), (1, 2, "1. ab", 2, *best), (1, 3, "2. c", 2, *none), (2, 1, "1. Ab", 2, *none), (None, 1, "1. ab", 2, *none)], key=str)
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_title_keys_drop_page_leader_and_marks(spark):
    titles = ["1. A b ..... 12", "1. Ab 12", "Ⅰ. x", "가 나　다 3", "(a)[b]【c】:;`'\"-.,", "12", "a12", "a..3", "x 1 2", "", None, "a 7\x85"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = [r[0] for r in df.select(filings.normal_title(F.col("t"))).collect()]
    assert got == ["1ab", "1ab", "ⅰx", "가나다", "abc", "12", "a12", "a", "x1", "", None, "a7\x85"]  # before, a page before such a line end went too, against the SQL


def test_a_first_character_rules_a_pattern_out_only_where_it_cannot_match(spark):
    each = [c for c in map(chr, range(1, 0xFFFF)) if not 0xD800 <= ord(c) < 0xE000]
    lines = [(c, c + rest) for c in each for rest in ("", "I. x", "1", "....12", "a")]
    df = spark.createDataFrame(lines, "c string, x string")
    x = F.col("x")
    assert df.where(x.rlike(filings.MAYBE) & ~filings.begins(x, filings.BLANKS + filings.HEADERS)).count() == 0
    assert df.where((~x.rlike(filings.FULL) | x.rlike(filings.LEADER)) & ~filings.begins(x, filings.BLANKS + ".")).count() == 0
    body = ["1. a", "", "　", " ....12", "....12", "....x", ". b", " c", "d"]
    got = filings.sections(docs(spark, "\n".join(body))).first()
    assert got["content"].split("\n") == ["....x", ". b", " c", "d"]


def test_rare_characters_are_searched_before_they_are_replaced(spark):
    d = docs(spark, "1. a\r\nb￿\r\n2. c￿", "1. a\nb\n2. c", None)
    got = sorted(tuple(r) for r in filings.sections(d).select("doc_id", "title", "content", "end_line").collect())
    assert got == [(0, "1. a", "b", 2), (0, "2. c", "", 3), (1, "1. a", "b", 2), (1, "2. c", "", 3)]
    assert filings.sections(d)._jdf.queryExecution().optimizedPlan().toString().count("Contains(text") == 2
