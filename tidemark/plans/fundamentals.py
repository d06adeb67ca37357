"""Fundamental queries over orders and customers.

An order is an analyst report (broker: priority, company: nation of the customer), an
ownership filing (company: customer) or a contract disclosure (status: state).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import fundamentals as f
from tidemark.plans.market import BARS_SQL, bars
from tidemark.plans.registry import out, query, table

R_SQL = """r AS (SELECT o_orderkey AS report_id, 'company' || c_nationkey AS company, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS broker, CAST(o_orderdate AS DATE) AS published,
  CASE o_orderstatus WHEN 'F' THEN 'BUY' WHEN 'O' THEN 'HOLD' WHEN 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'SELL' END END AS rating, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS target_price,
  'Report ' || (o_custkey % 50) AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS site FROM orders JOIN customer ON o_custkey = c_custkey)"""


def reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return o.select(
        k.alias("report_id"), F.concat(F.lit("company"), "c_nationkey").alias("company"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("broker"), F.to_date("o_orderdate").alias("published"),
        F.when(s == "F", "BUY").when(s == "O", "HOLD").when((s == "P") & (k % 3 != 0), "SELL").alias("rating"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("target_price"),
        F.concat(F.lit("Report "), F.col("o_custkey") % 50).alias("title"), F.when(k % 2 == 0, "alpha").otherwise("beta").alias("site"),
    )


C_SQL = f"""{R_SQL}, c0 AS (SELECT company, count(*) AS n_reports, count(target_price) FILTER (WHERE target_price > 0) AS n_tp, median(target_price) AS tp_median, avg(target_price) AS tp_mean, min(target_price) AS tp_min, max(target_price) AS tp_max, count(*) FILTER (WHERE rating = 'BUY') AS n_buy,
  count(*) FILTER (WHERE rating = 'HOLD') AS n_hold, count(*) FILTER (WHERE rating = 'SELL') AS n_sell, count(*) FILTER (WHERE rating IS NULL) AS n_unrated, count(DISTINCT coalesce(broker, '')) AS n_brokers, max(published) AS latest FROM r GROUP BY 1),
c AS (SELECT *, CASE WHEN n_buy >= n_hold AND n_buy >= n_sell AND n_buy > 0 THEN 'BUY' WHEN n_hold >= n_sell AND n_hold > 0 THEN 'HOLD' WHEN n_sell > 0 THEN 'SELL' END AS modal_rating FROM c0)"""


@query("consensus", f"WITH {C_SQL} SELECT company, n_reports, n_tp, round(tp_median, 6) AS tp_median, round(tp_mean, 6) AS tp_mean, round(tp_min, 6) AS tp_min, round(tp_max, 6) AS tp_max, n_buy, n_hold, n_sell, n_unrated, n_brokers, latest, modal_rating FROM c")
def consensus(spark, sf_dir):
    return out(f.consensus(reports(spark, sf_dir)))


@query("tp_trajectory", f"""WITH {R_SQL}, m AS (SELECT company, CAST(date_trunc('month', published) AS DATE) AS month, median(target_price) AS tp FROM r WHERE target_price > 0 AND company IN (SELECT company FROM r WHERE target_price > 0 GROUP BY 1 HAVING count(*) >= 6) GROUP BY 1, 2),
w AS (SELECT *, min(tp) OVER (PARTITION BY company) AS lo, max(tp) OVER (PARTITION BY company) AS hi FROM m) SELECT company, month, round(tp, 6) AS tp, CAST(CASE WHEN hi = lo THEN 3 ELSE floor(7 * (tp - lo) / (hi - lo) + 0.5) END AS BIGINT) AS level FROM w""")
def tp_trajectory(spark, sf_dir):
    return out(f.tp_trajectory(reports(spark, sf_dir)))


@query("tp_delta", f"WITH {R_SQL}, d AS (SELECT *, lag(target_price) OVER (PARTITION BY company, broker ORDER BY published, report_id) AS b FROM r WHERE target_price > 0), e AS (SELECT report_id, (target_price - b) / b AS tp_delta FROM d) SELECT report_id, round(tp_delta, 6) AS tp_delta FROM e")
def tp_delta(spark, sf_dir):
    return out(f.tp_delta(reports(spark, sf_dir)), "report_id", "tp_delta")


LATEST_SQL = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, broker ORDER BY published DESC, report_id DESC) AS k FROM r) WHERE k = 1)"


@query("latest_per_key", f"WITH {R_SQL}, {LATEST_SQL} SELECT company, broker, report_id FROM l")
def latest_per_key(spark, sf_dir):
    return f.first_per(reports(spark, sf_dir), ["company", "broker"], [F.desc("published"), F.desc("report_id")]).select("company", "broker", "report_id")


@query("divergences", f"""WITH {C_SQL}, {LATEST_SQL}, j AS (SELECT l.*, tp_median, modal_rating, (target_price - tp_median) / tp_median AS gap FROM l JOIN c USING (company))
SELECT company, broker, report_id, 'target-price' AS kind, round(gap, 6) AS gap FROM j WHERE target_price > 0 AND abs(gap) > 0.15 UNION ALL SELECT company, broker, report_id, 'rating', NULL FROM j WHERE rating <> modal_rating""")
def divergences(spark, sf_dir):
    return out(f.divergences(reports(spark, sf_dir)))


@query("report_dedupe_pref", f"WITH {R_SQL} SELECT report_id, broker, published, title, site FROM (SELECT *, row_number() OVER (PARTITION BY broker, published, title ORDER BY site DESC, report_id) AS k FROM r) WHERE k = 1")
def report_dedupe_pref(spark, sf_dir):
    return f.preferred_reports(reports(spark, sf_dir), ["beta", "alpha"]).select("report_id", "broker", "published", "title", "site")


@query("report_order", f"WITH {R_SQL} SELECT report_id, broker, published FROM r ORDER BY published DESC, coalesce(broker, '') , report_id LIMIT 100")
def report_order(spark, sf_dir):
    return reports(spark, sf_dir).orderBy(F.desc("published"), F.coalesce("broker", F.lit("")), "report_id").limit(100).select("report_id", "broker", "published")


@query("dedupe_views", f"""WITH {R_SQL}, v AS (SELECT broker, published, CAST(floor(target_price / 100000) AS BIGINT) AS tp, report_id AS article, title FROM r)
SELECT broker, published, tp AS target_price, min(article) AS article, first(title ORDER BY length(title) DESC, article DESC) AS snippet, string_agg(DISTINCT title, ',' ORDER BY title) AS queries FROM v GROUP BY 1, 2, 3""")
def dedupe_views(spark, sf_dir):
    v = reports(spark, sf_dir).select("broker", "published", F.floor(F.col("target_price") / 100000).cast("long").alias("target_price"), F.col("report_id").alias("article"), F.lit("2020-01-01").cast("date").alias("article_date"), F.col("title").alias("snippet"), F.array("title").alias("queries"))
    return f.merged_views(v).withColumn("queries", F.array_join("queries", ",")).drop("article_date")


_BROKERS = ", ".join(f"coalesce(string_agg(broker, ', ' ORDER BY nth) FILTER (WHERE rating = '{r}'), '') AS {r.lower()}_brokers" for r in f.RATINGS)


@query("broker_views", f"""WITH {R_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY published DESC NULLS LAST, broker NULLS FIRST, report_id) AS nth FROM r WHERE published >= DATE '1994-01-01'),
v AS (SELECT company, count(*) AS n_views, CASE WHEN count(target_price) % 2 = 0 THEN floor(median(target_price) + 0.5) ELSE median(target_price) END AS tp_median, {_BROKERS}, count(DISTINCT rating) AS n_ratings FROM n WHERE nth <= 8 GROUP BY 1)
SELECT company, n_views, round(tp_median, 6) AS tp_median, buy_brokers, hold_brokers, sell_brokers, n_ratings, CASE WHEN n_ratings = 0 THEN 'none' WHEN n_ratings = 1 THEN 'agree' ELSE 'split' END AS verdict FROM v""")
def broker_views(spark, sf_dir):
    return out(f.broker_views(reports(spark, sf_dir).where("published >= '1994-01-01'")))


@query("source_quality", f"""WITH {R_SQL}, q AS (SELECT *, report_id % 3 = 0 AS ok, report_id % 5 = 0 AS auth, report_id % 7 = 0 AS nopdf, report_id % 20 AS pages, report_id * 10 AS bytes FROM r)
SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS extracted, count(*) FILTER (WHERE NOT ok AND auth) AS gated, count(*) FILTER (WHERE NOT ok AND NOT auth AND nopdf) AS no_pdf, count(*) FILTER (WHERE NOT ok AND NOT auth AND NOT nopdf) AS failed, CAST(max(published) - min(published) AS BIGINT) AS span_days,
  string_agg(DISTINCT site, ',' ORDER BY site) AS sites, CAST(sum(pages) FILTER (WHERE ok) AS BIGINT) AS pages, CAST(sum(bytes) FILTER (WHERE ok) AS BIGINT) AS bytes FROM q""")
def source_quality(spark, sf_dir):
    k = F.col("report_id")
    facts = reports(spark, sf_dir).withColumns({"extraction_ok": k % 3 == 0, "requires_auth": k % 5 == 0, "pdf_url": F.when(k % 7 != 0, "pdf"), "pages": k % 20, "bytes": k * 10})
    return out(f.source_quality(facts).withColumn("sites", F.array_join("sites", ",")))


H_SQL = """h0 AS (SELECT o_orderkey AS rcept_no, o_custkey AS corp, CAST(o_orderdate AS DATE) AS filed, o_orderpriority AS reason, CASE o_orderstatus WHEN 'F' THEN 'major' WHEN 'O' THEN 'executive' ELSE 'other' END AS kind, (CAST(round(o_totalprice * 100) AS BIGINT) % 2000) / 100.0::DOUBLE AS pct, CAST(o_totalprice AS DOUBLE) AS shares FROM orders),
h AS (SELECT *, lag(pct) OVER (PARTITION BY corp ORDER BY filed, rcept_no) AS prev_pct, lag(shares) OVER (PARTITION BY corp ORDER BY filed, rcept_no) AS prev_shares FROM h0)"""


def holdings(spark, sf_dir):
    from pyspark.sql.window import Window as W

    s = F.col("o_orderstatus")
    h = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rcept_no"), F.col("o_custkey").alias("corp"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderpriority").alias("reason"),
        F.when(s == "F", "major").when(s == "O", "executive").otherwise("other").alias("kind"), (F.round(F.col("o_totalprice") * 100).cast("long") % 2000 / F.lit(100.0)).alias("pct"), F.col("o_totalprice").alias("shares"),
    )
    w = W.partitionBy("corp").orderBy("filed", "rcept_no")
    return h.withColumns({"prev_pct": F.lag("pct").over(w), "prev_shares": F.lag("shares").over(w)})


@query("filings_by_month", f"WITH {H_SQL} SELECT strftime(filed, '%Y-%m') AS month, count(*) FILTER (WHERE kind = 'major') AS major, count(*) FILTER (WHERE kind = 'executive') AS executive, count(*) FILTER (WHERE kind = 'other') AS other, count(*) AS total FROM h GROUP BY 1")
def filings_by_month(spark, sf_dir):
    return f.filings_by_month(holdings(spark, sf_dir), ["major", "executive", "other"])


@query("threshold_crossings", f"WITH {H_SQL} SELECT rcept_no, CASE WHEN prev_pct < 5 THEN 'entry' ELSE 'exit' END AS crossing FROM h WHERE (prev_pct < 5 AND pct >= 5) OR (prev_pct >= 5 AND pct < 5)")
def threshold_crossings(spark, sf_dir):
    return f.threshold_crossings(holdings(spark, sf_dir)).select("rcept_no", "crossing")


@query("big_moves", f"WITH {H_SQL}, d AS (SELECT rcept_no, pct - prev_pct AS delta FROM h) SELECT * FROM (SELECT rcept_no, round(delta, 6) AS delta, 'up' AS direction FROM d WHERE delta > 0 ORDER BY abs(d.delta) DESC, rcept_no LIMIT 15) UNION ALL SELECT * FROM (SELECT rcept_no, round(delta, 6) AS delta, 'down' FROM d WHERE delta < 0 ORDER BY abs(d.delta) DESC, rcept_no LIMIT 15)")
def big_moves(spark, sf_dir):
    return out(f.big_moves(holdings(spark, sf_dir)), "rcept_no", "delta", "direction")


@query("cumulative_change", f"WITH {H_SQL}, g AS (SELECT corp, first(prev_pct ORDER BY filed, rcept_no) FILTER (WHERE prev_pct IS NOT NULL) AS a, last(pct ORDER BY filed, rcept_no) AS b, count(*) AS n, min(filed) AS first_filed, max(filed) AS last_filed FROM h WHERE prev_pct IS NOT NULL GROUP BY 1) SELECT corp, round(a, 6) AS first_pct, round(b, 6) AS last_pct, round(b - a + 1e-8, 6) AS delta, n, first_filed, last_filed FROM g")
def cumulative_change(spark, sf_dir):
    return out(f.cumulative_change(holdings(spark, sf_dir).where("prev_pct is not null")))


@query("report_frequency", f"WITH {H_SQL} SELECT corp, count(*) AS n FROM h GROUP BY 1")
def report_frequency(spark, sf_dir):
    return holdings(spark, sf_dir).groupBy("corp").agg(F.count("*").alias("n"))


@query("reason_counts", f"WITH {H_SQL}, g AS (SELECT reason, count(*) AS n FROM h GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS share FROM g) SELECT reason, n, round(share, 6) AS share, regexp_matches(reason, 'URGENT|HIGH') AS pure_trade FROM s")
def reason_counts(spark, sf_dir):
    return out(f.reason_counts(holdings(spark, sf_dir), "URGENT|HIGH"))


@query("holding_histogram", f"WITH {H_SQL}, g AS (SELECT corp, last(pct ORDER BY filed, rcept_no) AS pct FROM h GROUP BY 1) SELECT CAST((pct >= 1)::INT + (pct >= 3)::INT + (pct >= 5)::INT + (pct >= 10)::INT AS BIGINT) AS band, count(*) AS n FROM g GROUP BY 1")
def holding_histogram(spark, sf_dir):
    return out(f.holding_histogram(holdings(spark, sf_dir)))


@query("quantity_vs_issuance", f"WITH {H_SQL}, q AS (SELECT rcept_no, (shares - prev_shares) / (prev_shares / nullif(prev_pct, 0) * 100) * 100 AS quantity_effect, pct - prev_pct AS d FROM h), i AS (SELECT rcept_no, quantity_effect, d - quantity_effect AS issuance_effect FROM q) SELECT rcept_no, round(quantity_effect, 6) AS quantity_effect, round(issuance_effect, 6) AS issuance_effect FROM i WHERE abs(i.issuance_effect) >= 0.3")
def quantity_vs_issuance(spark, sf_dir):
    return out(f.quantity_vs_issuance(holdings(spark, sf_dir)), "rcept_no", "quantity_effect", "issuance_effect")


@query("holder_filings", "SELECT o_orderkey AS rcept_no, CASE WHEN o_orderpriority LIKE '1%' THEN 'first' ELSE 'second' END AS kind FROM orders WHERE 'holder' || (o_custkey % 10) LIKE '%holder7%' AND (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')")
def holder_filings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rcept_no"), F.concat(F.lit("holder"), F.col("o_custkey") % 10).alias("filer"), F.col("o_orderpriority").alias("report_name"))
    return f.holder_filings(o, "holder7", {"^1": "first", "^2": "second"}).select("rcept_no", "kind")


@query("detail_scope", f"WITH {H_SQL} SELECT rcept_no FROM h WHERE corp IN (SELECT corp FROM h WHERE pct > 19.5)")
def detail_scope(spark, sf_dir):
    h = holdings(spark, sf_dir)
    return f.detail_scope(h, h.where("pct > 19.5")).select("rcept_no")


@query("enrich_filings", f"""WITH {H_SQL}, m AS (SELECT rcept_no, shares, CASE WHEN rcept_no % 4 = 0 THEN NULL ELSE pct END AS pct FROM h WHERE rcept_no % 3 <> 0), e AS (SELECT rcept_no, shares + 1 AS shares, pct FROM h WHERE rcept_no % 2 = 0),
j AS (SELECT h.rcept_no, h.kind, m.rcept_no IS NOT NULL AND h.kind <> 'executive' AS um, m.rcept_no, e.rcept_no IS NOT NULL AND h.kind <> 'major' AS ue, m.shares AS ms, m.pct AS mp, e.shares AS es, e.pct AS ep FROM h LEFT JOIN m ON m.rcept_no = h.rcept_no LEFT JOIN e ON e.rcept_no = h.rcept_no),
k AS (SELECT rcept_no, CASE WHEN um THEN ms WHEN ue THEN es END AS shares, CASE WHEN um THEN mp WHEN ue THEN ep END AS pct, um OR ue AS hit FROM j)
SELECT rcept_no, round(shares, 6) AS shares, round(pct, 6) AS pct, CASE WHEN NOT hit THEN 'no-match' WHEN shares IS NULL OR pct IS NULL THEN 'partial' ELSE 'ok' END AS status FROM k""")
def enrich_filings(spark, sf_dir):
    h = holdings(spark, sf_dir)
    major = h.where("rcept_no % 3 <> 0").select("rcept_no", F.lit(1).alias("seq"), "shares", F.when(F.col("rcept_no") % 4 != 0, F.col("pct")).alias("pct"))
    executive = h.where("rcept_no % 2 = 0").select("rcept_no", F.lit(1).alias("seq"), (F.col("shares") + 1).alias("shares"), "pct")
    return out(f.enriched(h.select("rcept_no", "kind"), major, executive, {"major": "major", "executive": "executive"}), "rcept_no", "shares", "pct", "status")


@query("latest_regular_filing", f"WITH {H_SQL} SELECT corp, kind, rcept_no FROM (SELECT *, row_number() OVER (PARTITION BY corp, kind ORDER BY filed DESC, rcept_no DESC) AS k FROM h WHERE filed <= DATE '2000-06-30' AND filed > DATE '2000-06-30' - INTERVAL 14 MONTH) WHERE k = 1")
def latest_regular_filing(spark, sf_dir):
    return f.latest_regular_filing(holdings(spark, sf_dir), F.lit("2000-06-30").cast("date")).select("corp", "kind", "rcept_no")


@query("standalone_quarter", "WITH q AS (SELECT c_nationkey AS corp, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, sum(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3), s AS (SELECT corp, CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter, x AS standalone, row_number() OVER (PARTITION BY corp, year ORDER BY quarter) > 1 AS derived FROM q) SELECT CAST(corp AS BIGINT) AS corp, year, quarter, round(standalone + 1e-8, 2) AS standalone, derived FROM s")
def standalone_quarter(spark, sf_dir):
    from pyspark.sql.window import Window as W

    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    q = o.groupBy(F.col("c_nationkey").alias("corp"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.sum("o_totalprice").alias("x"))
    upto = W.partitionBy("corp", "year").orderBy("quarter").rowsBetween(W.unboundedPreceding, 0)
    cumulative = q.withColumns({"amount": F.sum("x").over(upto), "account": F.lit("sales")}).drop("x")
    return out(f.standalone_quarter(cumulative), "corp", "year", "quarter", "standalone", "derived", digits=2)


K_SQL = "k AS (SELECT o_orderkey AS contract_id, o_custkey % 40 AS name, o_custkey % 7 AS counterparty, o_orderpriority AS project, CAST(o_orderdate AS DATE) AS disclosed, o_orderstatus AS state, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS amount, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 1500 AS INT) END AS ends FROM orders), kl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, counterparty, project ORDER BY disclosed DESC, contract_id DESC) AS n FROM k) WHERE n = 1)"


def contracts(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("contract_id"), (F.col("o_custkey") % 40).alias("name"), (F.col("o_custkey") % 7).alias("counterparty"), F.col("o_orderpriority").alias("project"), F.to_date("o_orderdate").alias("disclosed"), F.col("o_orderstatus").alias("state"),
        F.when(k % 6 != 0, F.col("o_totalprice")).alias("amount"), F.when(k % 9 != 0, F.date_add(F.to_date("o_orderdate"), (k % 1500).cast("int"))).alias("ends"),
    )


@query("contract_latest", f"WITH {K_SQL} SELECT name, counterparty, project, contract_id, state FROM kl")
def contract_latest(spark, sf_dir):
    return f.contract_latest(contracts(spark, sf_dir)).select("name", "counterparty", "project", "contract_id", "state")


@query("contract_maturity", f"WITH {K_SQL}, y AS (SELECT CAST(year(ends) AS BIGINT) AS end_year, count(*) AS n, sum(amount) AS amount, count(*) - count(amount) AS n_undisclosed FROM kl GROUP BY 1) SELECT end_year, n, round(amount, 2) AS amount, n_undisclosed, round(sum(amount) OVER (PARTITION BY end_year IS NULL ORDER BY end_year), 2) AS cumulative FROM y")
def contract_maturity(spark, sf_dir):
    return out(f.contract_maturity(f.contract_latest(contracts(spark, sf_dir))), digits=2)


@query("backlog_ratios", "WITH b AS (SELECT o_custkey AS corp, o_orderstatus AS basis, sum(o_totalprice) AS b FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), r AS (SELECT o_custkey AS corp, o_orderstatus AS basis, sum(o_totalprice) AS r FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2), j AS (SELECT b.corp, b.basis, b / r AS backlog_years FROM b JOIN r ON b.corp = r.corp AND b.basis = r.basis) SELECT corp, basis, round(backlog_years, 6) AS backlog_years FROM j")
def backlog_ratios(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "corp", "o_orderstatus": "basis"})
    side = lambda rest, name: o.where(F.col("o_orderkey") % 2 == rest).groupBy("corp", "basis").agg(F.sum("o_totalprice").alias(name))
    return out(f.backlog_ratios(side(0, "backlog"), side(1, "revenue")), "corp", "basis", "backlog_years")


@query("peer_table", "WITH p AS (SELECT p_brand AS ticker, avg(p_retailprice) AS pe FROM part GROUP BY 1) SELECT ticker, row_number() OVER (ORDER BY pe, ticker) AS rank, round(pe, 6) AS pe, round((SELECT median(pe) FROM p) + 1e-8, 6) AS median FROM p")
def peer_table(spark, sf_dir):
    peers = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.avg("p_retailprice").alias("pe"))
    return out(f.peer_table(peers, "pe"), "ticker", "rank", "pe", "median")


V_SQL = f"""WITH {BARS_SQL}, v AS (SELECT ticker, date, unnest(['close', 'volume']) AS metric, unnest([close, volume]) AS value FROM bars), n AS (SELECT ticker, metric, last(value ORDER BY date) AS current FROM v WHERE value > 0 GROUP BY 1, 2),
b AS (SELECT ticker, metric, current, min(value) AS low, median(value) AS median, max(value) AS high, avg((value <= current)::INT) * 100 AS percentile, (max(date) - min(date)) / 365.25 AS years FROM v JOIN n USING (ticker, metric) WHERE value > 0 GROUP BY 1, 2, 3)"""


@query("valuation_bands", f"{V_SQL} SELECT ticker, metric, round(current, 6) AS current, round(low, 6) AS low, round(median, 6) AS median, round(high, 6) AS high, round(percentile, 6) AS percentile, round(years, 6) AS years, CASE WHEN years < 3 THEN 'short-history' WHEN percentile <= 33 THEN 'lower' WHEN percentile >= 67 THEN 'upper' ELSE 'middle' END AS label FROM b")
def valuation_bands(spark, sf_dir):
    return out(f.valuation_bands(bars(spark, sf_dir), ["close", "volume"]))


@query("etf_overlap", """WITH h AS (SELECT s_nationkey AS fund, l_partkey AS symbol, last(l_quantity ORDER BY l_orderkey, l_linenumber, l_quantity) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), s AS (SELECT fund, count(*) AS n FROM h GROUP BY 1),
c AS (SELECT a.fund AS fund_a, b.fund AS fund_b, count(*) AS n_common, sum(least(a.w, b.w)) AS overlap FROM h a JOIN h b ON a.symbol = b.symbol AND a.fund < b.fund GROUP BY 1, 2)
SELECT CAST(fund_a AS BIGINT) AS fund_a, CAST(fund_b AS BIGINT) AS fund_b, n_common, round(overlap, 6) AS overlap, x.n - n_common AS only_a, y.n - n_common AS only_b FROM c JOIN s x ON x.fund = fund_a JOIN s y ON y.fund = fund_b""")
def etf_overlap(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return out(f.etf_overlap(h.select(F.col("s_nationkey").alias("fund"), F.col("l_partkey").alias("symbol"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("seq"), F.col("l_quantity").alias("weight"))))


POS_SQL = f"""WITH {BARS_SQL}, cl AS (SELECT ticker, last(close ORDER BY date) AS close FROM bars GROUP BY 1), p AS (SELECT o_orderkey AS id, o_custkey % 20 AS account, CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE 'Brand#' || (1 + o_orderkey % 25) END AS symbol, 'Brand#' || (1 + o_custkey % 30) AS fallback, o_totalprice / 100 AS cost, 1.0 + o_orderkey % 9 AS quantity, CASE WHEN o_orderkey % 13 = 0 THEN 500.0 END AS mp, CASE WHEN o_orderkey % 17 = 0 THEN 42.0 END AS mpnl FROM orders),
z AS (SELECT p.*, coalesce(mp, a.close, b.close) AS price FROM p LEFT JOIN cl a ON a.ticker = p.symbol LEFT JOIN cl b ON b.ticker = p.fallback), zz AS (SELECT *, coalesce(mpnl, (price - cost) * quantity) AS pnl FROM z)"""


def positions(spark, sf_dir):
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 20).alias("account"), F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit("Brand#"), 1 + k % 25)).alias("symbol"), F.concat(F.lit("Brand#"), 1 + F.col("o_custkey") % 30).alias("fallback"),
        (F.col("o_totalprice") / 100).alias("cost"), (1.0 + k % 9).alias("quantity"), F.when(k % 13 == 0, 500.0).alias("manual_price"), F.when(k % 17 == 0, 42.0).alias("manual_pnl"),
    )
    return f.position_prices(p, bars(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "date").alias("close")))


@query("position_prices", f"{POS_SQL} SELECT id, round(price, 6) AS price, round(pnl, 6) AS pnl FROM zz")
def position_prices(spark, sf_dir):
    return out(positions(spark, sf_dir), "id", "price", "pnl")


@query("portfolio_totals", f"{POS_SQL}, t AS (SELECT account, sum(pnl) AS pnl, sum(cost * quantity) AS cost, sum(pnl) / sum(cost * quantity) * 100 AS return_pct FROM zz GROUP BY 1) SELECT account, round(pnl + 1e-8, 1) AS pnl, round(cost + 1e-8, 1) AS cost, round(return_pct + 1e-8, 1) AS return_pct FROM t")
def portfolio_totals(spark, sf_dir):
    return out(f.portfolio_totals(positions(spark, sf_dir), "account"), digits=1)
