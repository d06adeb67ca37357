import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import documents, fundamentals, news, rules, screen, series, structure
from tidemark.sources import landed
from tidemark.streaming import jobs


def bars_frame(spark, series_by_ticker):
    rows = []
    for ticker, closes in series_by_ticker.items():
        for i, c in enumerate(closes):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=i)
            rows.append((ticker, day, *((None,) * 4 if c is None else (c * 0.995, c * 1.01, c * 0.99, float(c))), 1000.0 + i))
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def walk():
    rng = random.Random(3)
    out = [100.0]
    for _ in range(329):
        out.append(out[-1] * (1 + rng.uniform(-0.03, 0.032)))
    return out


def test_rolling_values_need_a_full_window(spark, walk):
    gap = [*walk[:40], None, *walk[41:80]]
    rows = series.panel(bars_frame(spark, {"A": walk, "G": gap})).orderBy("ticker", "date").collect()
    a, g = [r for r in rows if r["ticker"] == "A"], [r for r in rows if r["ticker"] == "G"]
    for i, r in enumerate(a):
        for n in series.MEANS:
            want = None if i + 1 < n else sum(walk[i + 1 - n : i + 1]) / n
            assert r[f"ma{n}"] == (None if want is None else pytest.approx(want))
        for n in (1, 7, 252):
            assert r[f"return{n}"] == (None if i < n else pytest.approx(walk[i] / walk[i - n] - 1))
        if i >= 251:
            window = walk[i - 251 : i + 1]
            assert r["high52"] == pytest.approx(max(window)) and r["since_high"] == 251 - max(k for k, x in enumerate(window) if x == max(window))
            assert r["new_highs60"] == sum(walk[j] > max(walk[j - 251 : j]) for j in range(max(251, i - 59), i + 1))
    assert all(g[i]["ma5"] is None for i in range(40, 45)) and g[45]["ma5"] is not None
    assert all(r["rsi14"] is None or 0 <= r["rsi14"] <= 100 for r in rows)


def test_swing_pivots_by_hand(spark, walk):
    rows = series.panel(bars_frame(spark, {"A": walk})).orderBy("date").collect()
    high = [c * 1.01 for c in walk]
    want = [i for i in range(5, len(high) - 5) if all(high[j] <= high[i] for j in range(i - 5, i)) and all(high[j] < high[i] for j in range(i + 1, i + 6))]
    assert [i for i, r in enumerate(rows) if r["pivot_high"]] == want


def test_folds_by_hand(spark, walk):
    rows = series.folds(bars_frame(spark, {"A": walk, "S": walk[:10]})).orderBy("ticker", "date").collect()
    a, short = rows[: len(walk)], rows[len(walk) :]
    state = sum(walk[:12]) / 12
    for i in range(12, len(walk)):
        state = walk[i] * 2 / 13 + state * 11 / 13
        assert a[i]["ema12"] == pytest.approx(state)
    assert a[10]["ema12"] is None and a[24]["macd"] is None and a[25]["macd"] is not None and a[32]["signal"] is None and a[33]["signal"] is not None
    assert a[26]["adx"] is None and a[27]["adx"] is not None and all(0 <= r["adx"] <= 100 for r in a[27:])
    assert all(r["ema12"] is None and r["adx"] is None and r["rsi_wilder"] is None for r in short)


def test_adx_after_a_gap():
    h, low, c = (np.array([x + k + (i % 3) for i, x in enumerate(range(60))], float) for k in (1, -1, 0))
    h[40] = np.nan
    plus, minus, adx = series.adx(h, low, c)
    assert np.isnan(plus[40]) and np.isnan(plus[41]) and not np.isnan(plus[42]) and np.isnan(adx[40:]).all() and not np.isnan(adx[39])


def test_percentile_is_positional(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0), ("e", None)], "ticker string, x double")
    got = {r["ticker"]: r["p"] for r in series.percentile(df, "x", "p").collect()}
    assert got == {"a": 100.0, "b": pytest.approx(200 / 3), "c": pytest.approx(100 / 3), "d": 0.0, "e": None}
    assert series.percentile(df.where("ticker = 'a'"), "x", "p").first()["p"] == 100.0


def scenario(kind):
    n = 280
    if kind == "leader":
        return [100 + 0.5 * i + (i % 5) * 0.1 for i in range(n)]
    return [300 - 0.5 * i + (i % 5) * 0.1 for i in range(n)]


@pytest.mark.parametrize(("kind", "rs", "template", "grade"), [("leader", 95.0, "pass", "A"), ("laggard", 28.0, "fail", "D"), ("leader", None, "incomplete", None)])
def test_template_and_grade(spark, kind, rs, template, grade):
    row = series.latest(series.panel(bars_frame(spark, {"A": scenario(kind)}))).withColumn("rs_percentile", F.lit(rs).cast("double"))
    got = row.withColumns(rules.trend_template()).withColumns(rules.leadership_score()).first()
    assert got["template"] == template and (got["grade"] == grade or kind == "leader" and grade == "A" and got["points"] >= 80)


def test_scores_stay_in_range_and_survive_nulls(spark, walk):
    u = series.latest(series.panel(bars_frame(spark, {"A": walk, "B": walk[::-1], "C": walk[:30], "D": [5.0] * 300})))
    u = series.percentile(u.withColumns({"market": F.lit("m"), "rs_raw": screen.rs_raw(), "data_quality": F.array().cast("array<string>")}), "rs_raw", "rs_percentile")
    back = u.groupBy("market").agg(*(F.avg(f"return{n}").alias(f"return{n}") for n in (7, 30, 60)))
    rows = {r["ticker"]: r for r in screen.scored(u, back).collect()}
    for r in rows.values():
        for c in ("short_score", "intermediate_score", "structural_score", "composite_score", "buyability"):
            assert r[c] is None or 0 <= r[c] <= 100
    assert rows["C"]["composite_score"] is not None and "short-history" in rows["C"]["caution_flags"] and rows["C"]["setup_label"] == "check-data"


def test_entrants_and_crossings(spark):
    ranks = "lens string, rank int, ticker string, score double"
    now, before = spark.createDataFrame([("short", 1, "a", 9.0), ("short", 2, "b", 8.0)], ranks), spark.createDataFrame([("short", 1, "b", 9.0)], ranks)
    assert [r["ticker"] for r in screen.new_entrants(now, before).collect()] == ["a"]
    cols = "ticker string, leadership_label string, rs_percentile double, high_proximity double, volume_ratio double, composite_score double"
    a = spark.createDataFrame([("a", "watch", 91.0, 96.0, None, 1.0), ("b", "structural-leader", 95.0, 90.0, 2.0, 2.0)], cols)
    b = spark.createDataFrame([("b", "watch", 92.0, 99.0, 1.0, 2.0)], cols)
    got = {r["ticker"]: (r["upgraded"], r["rs_cross"], r["proximity_cross"], r["volume_cross"]) for r in screen.prior_diff(a, b).collect()}
    assert got == {"a": (True, True, True, False), "b": (True, False, False, True)}


def test_zone_status_with_a_given_price(spark, walk):
    p = series.panel(bars_frame(spark, {"A": [100, 110, 100, 90] * 30 + [50.0] * 6}))
    z = spark.createDataFrame([("A", 0, 60.0, 61.0, 60.5, 2, 5, 100, dt.date(2024, 1, 1), 1.0)], "ticker string, zone int, low double, high double, center double, pivots int, touches int, last_n int, last_touch date, volume double")
    assert structure.zone_status(z, p).first()["status"] == "active"
    assert structure.zone_status(z, p, current_price=70.0).first()["status"] == "broken"


def greedy(rows):
    seen, out = set(), []
    for i, u, h in rows:
        keys = {("u", u), ("h", h)} - {("u", None), ("h", None)}
        if not keys & seen:
            seen |= keys
            out.append(i)
    return out


def test_dedupe_keeps_what_only_a_dropped_row_shares(spark):
    rng = random.Random(7)
    cases = [[(0, "u1", "h1"), (1, "u2", "h1"), (2, "u2", "h3")], [(i, rng.choice(["a", "b", "c", "d", None]), rng.choice(["x", "y", "z", "w", "v", None])) for i in range(60)]]
    for rows in cases:
        df = spark.createDataFrame(rows, "seq int, u string, h string")
        got = news.deduped(df, ["u", "h"])
        assert sorted(r["seq"] for r in got.collect()) == greedy(rows)
        assert sorted(r["seq"] for r in news.deduped(got, ["u", "h"]).collect()) == greedy(rows)


def test_numbers_and_addresses(spark):
    df = spark.createDataFrame([("1,234",), (" ",), ("-",), ("",), ("12 000.5",), (None,)], "t string")
    assert [r[0] for r in df.select(news.number_of(F.col("t"))).collect()] == [1234.0, None, None, None, 12000.5, None]
    urls = spark.createDataFrame([("http://X.com/a?utm_source=b&id=1#f",), ("http://x.com/a?id=1&fbclid=9",), ("http://x.com/a?sid=3",)], "u string")
    assert [r[0] for r in urls.select(news.url_key("u")).collect()] == ["http://x.com/a?id=1", "http://x.com/a?id=1", "http://x.com/a"]


def test_consensus_ties_and_missing_brokers(spark):
    df = spark.createDataFrame([("c", "a", "SELL", 10.0, dt.date(2024, 1, 1), 1), ("c", None, "BUY", None, dt.date(2024, 1, 2), 2), ("c", None, None, -1.0, dt.date(2024, 1, 3), 3)], "company string, broker string, rating string, target_price double, published date, report_id int")
    r = fundamentals.consensus(df).first()
    assert (r["n_tp"], r["tp_median"], r["modal_rating"], r["n_brokers"], r["n_unrated"]) == (1, 10.0, "BUY", 2, 1)


def test_quantity_and_issuance_add_up(spark):
    df = spark.createDataFrame([(1, 5.0, 7.0, 500.0, 900.0)], "rcept_no int, prev_pct double, pct double, prev_shares double, shares double")
    r = fundamentals.quantity_vs_issuance(df).first()
    assert r["quantity_effect"] == pytest.approx(4.0) and r["quantity_effect"] + r["issuance_effect"] == pytest.approx(2.0)


def test_date_chunks_cover_the_range(spark):
    rows = fundamentals.date_chunks(spark.sql("SELECT DATE '2024-01-01' AS start, DATE '2024-08-15' AS end UNION ALL SELECT DATE '2024-02-01', DATE '2024-01-01'"), 80).orderBy("chunk_start").collect()
    assert rows[0][0] == dt.date(2024, 1, 1) and rows[-1][1] == dt.date(2024, 8, 15)
    assert all((b[0] - a[1]).days == 1 for a, b in zip(rows, rows[1:], strict=False)) and all((r[1] - r[0]).days < 80 for r in rows)


def test_html_and_listings(spark):
    html = "<html><head><title>x</title></head><body><p>a  b</p><table><tr><td>1</td><td>2</td></tr></table><script>no</script></body></html>"
    assert documents.html_to_text(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()[0]["text"] == "a b\n1 | 2"
    row = "<tr><td>삼성<b>전자</b></td><td>유가</td><td>005930</td><td>전자</td><td>반도체</td><td>1975-06-11</td><td>12월</td></tr><tr><td>가</td><td>나</td></tr>"
    r = landed.load_listings(spark.createDataFrame([(1, row)], "page int, html string")).collect()
    assert len(r) == 1 and (r[0]["name"], r[0]["market"], r[0]["ticker"], r[0]["closing_month"]) == ("삼성전자", "유가", "005930", "12월")


def test_load_bars_and_snapshots(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"ticker": "A", "bars": [{"date": "2024-01-02", "close": 2.0}, {"date": "2024-01-01", "close": null}]}')
    rows = landed.load_bars(spark, str(tmp_path / "c.json")).collect()
    assert [(r["ticker"], r["date"], r["close"]) for r in rows] == [("A", dt.date(2024, 1, 2), 2.0)]
    df, path = spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "snap")
    for day, times in (("2024-01-01", 2), ("2024-01-02", 1)):
        for _ in range(times):
            landed.write_snapshot(df, path, day)
    assert spark.read.parquet(path).groupBy("as_of").count().count() == 2 and spark.read.parquet(path).count() == 2


def test_xml_sources(spark, tmp_path):
    (tmp_path / "corp.xml").write_text("<result><list><corp_code>1</corp_code><corp_name>a</corp_name><stock_code> </stock_code><modify_date>1</modify_date></list><list><corp_code>2</corp_code><corp_name>b</corp_name><stock_code>000660</stock_code><modify_date>1</modify_date></list><list><corp_code>3</corp_code><corp_name>c</corp_name><stock_code>000660</stock_code><modify_date>2</modify_date></list></result>")
    assert [(r["stock_code"], r["corp_code"]) for r in landed.load_corp_codes(spark, str(tmp_path / "corp.xml")).collect()] == [("000660", "3")]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>t</title><link>http://x</link><pubDate>Tue, 02 Jan 2024 09:00:00 GMT</pubDate></item><item><title></title><link>http://y</link></item><item><title>u</title><guid>http://z</guid></item></channel></rss>")
    got = sorted((r["headline"], r["url"], r["published"]) for r in landed.load_rss(spark, str(tmp_path / "feed.xml")).collect())
    assert got == [("t", "http://x", dt.date(2024, 1, 2)), ("u", "http://z", None)]


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), t0 + dt.timedelta(minutes=7 * i), i, rng.uniform(0, 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq int, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(s, name):
        q = s.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(s.schema).parquet(str(tmp_path / name))

    key = lambda d: sorted(map(tuple, d.collect()), key=repr)
    ticks = lambda d: d.select("key", "ts", "seq", F.col("value").alias("price"), F.col("value").alias("quantity"))
    closed = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    batch = [b for b in key(jobs.bars(ticks(df))) if b[1] + dt.timedelta(hours=1) <= closed]
    streamed = key(run(jobs.bars(ticks(stream)), "bars"))
    assert [b[:6] for b in streamed] == [b[:6] for b in batch] and all(math.isclose(a[6], b[6]) for a, b in zip(streamed, batch, strict=True))


def test_crossings_of_shuffled_arrivals_equal_the_batch(spark, tmp_path):
    rng = random.Random(6)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), t0 + dt.timedelta(minutes=i), float(rng.randint(0, 100))) for i in range(300)] + [("d", t0, 60.0), ("a", t0, 60.0), ("a", t0, 10.0), ("b", t0, None)]
    arrivals = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, 40)))
    df = spark.createDataFrame(rows, "key string, ts timestamp, value double")
    for k in range(4):
        spark.createDataFrame(arrivals[k * 76 : (k + 1) * 76], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    s = jobs.crossings(stream, 50.0, late="45 minutes")
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(q.recentProgress) >= 4
    passed = max(r[1] for r in rows) - dt.timedelta(minutes=45)
    got = sorted(tuple(r) for r in spark.read.schema(s.schema).parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in jobs.crossings_batch(df, 50.0).where(F.col("ts") <= F.lit(passed)).collect())
    assert got == want and len(got) > 30


def test_registry_names(spark):
    import __spark_entry__ as e

    names = Counter(e.queries())
    assert set(e.oracle_sql()) <= set(names) and len(names) > 100


def test_rows_of_several_days_equal_a_panel_cut_at_each(spark, walk):
    bars = bars_frame(spark, {"A": walk, "B": walk[:40], "C": walk[:270]})
    dates = sorted(r["date"] for r in bars.select("date").distinct().collect())
    days = [str(dates[i]) for i in (35, 265, len(dates) - 1)]
    cols = ["ticker", "date", "bars", "ma20", "return30", "high_ratio", "volume_ratio"]
    got = series.latest_of_days(series.panel(bars), days)
    for d in days:
        want = series.latest(series.panel(series.as_of(bars, d))).select(*cols).orderBy("ticker").collect()
        assert got.where(F.col("as_of") == d).select(*cols).orderBy("ticker").collect() == want and len(want) == 3


@pytest.mark.parametrize("size", [0, 5, 14, 15, 30, 41, 42, 43, 120])
def test_wilder_rsi_of_each_bar(size):
    rng = np.random.default_rng(size)
    values = rng.normal(100, 5, size)
    if size == 120:
        values[30], values[90:] = np.nan, 50.0
    got = series.wilder_rsi(values)
    for i in range(size):
        d = np.diff(values[max(0, i - 41) : i + 1])
        want = np.nan
        if len(d) >= 14 and not np.isnan(d).any():
            g, s = np.maximum(d[:14], 0).mean(), np.maximum(-d[:14], 0).mean()
            for x in d[14:]:
                g, s = (g * 13 + max(x, 0)) / 14, (s * 13 + max(-x, 0)) / 14
            want = 100.0 if s == 0 else 100 - 100 / (1 + g / s)
        assert got[i] == pytest.approx(want, nan_ok=True)


GATES = {"posts": 30, "page1": 10, "page1_trading": 0, "relevant": 5, "listicles": 0, "trading": 0, "dedicated": 4, "dedicated_formulaic": 0, "deep_tech": 0, "dated": 4, "stale": 0, "timeline": 20, "stock": 15, "bracketed": 0, "formulaic": 0}


@pytest.mark.parametrize(
    ("changed", "anchors", "reason", "deep"),
    [
        ({}, [], None, "no-deep-post"),
        ({"page1_trading": 5}, [], "trading-shop", "trading-shop"),
        ({"page1": 0, "deep_tech": 1}, [], None, None),
        ({"dated": 5, "stale": 4}, [], "stale", "stale"),
        ({"dated": 2, "stale": 2}, [], None, "no-deep-post"),
        ({"stock": 0}, [], None, "no-deep-post"),
        ({"stock": 9, "dedicated": 2}, [], "off-topic", "off-topic"),
        ({"timeline": 4, "stock": 0, "formulaic": 4, "dedicated": 2}, [], None, "no-deep-post"),
        ({"formulaic": 14}, [], "farm", "farm"),
        ({"dedicated_formulaic": 3}, [], "dedicated-farm", "dedicated-farm"),
        ({"dedicated": 1}, [], "too-few", "no-deep-post"),
        ({"dedicated": 1, "deep_tech": 1}, ["name"], None, None),
        ({"dedicated": 0}, ["name"], "too-few", "no-deep-post"),
    ],
)
def test_source_gates(spark, changed, anchors, reason, deep):
    row = spark.createDataFrame([({**GATES, **changed, "anchors": anchors})], ", ".join(f"{c} long" for c in GATES) + ", anchors array<string>")
    assert [news.source_gates(row, deep=x).first()["reason"] for x in (False, True)] == [reason, deep]
