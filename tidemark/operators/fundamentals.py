"""Analyst reports, ownership filings, contracts, peers, valuation histories, funds and portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.spread import total_rank

RATINGS = ("BUY", "HOLD", "SELL")  # also the order in which equal counts win
TP_OFF, RECENT = 0.15, 6


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def with_price(reports: DataFrame) -> DataFrame:
    return reports.where(F.col("target_price") > 0)


def consensus(reports: DataFrame, by: str = "company") -> DataFrame:
    """Target prices, ratings, modal rating, brokers (a missing broker counts as one) and latest date of each company."""
    tp = F.when(F.col("target_price") > 0, F.col("target_price"))
    total = {r: F.count_if(F.col("rating") == r) for r in RATINGS}
    votes = reports.groupBy(by).agg(
        F.count("*").alias("n_reports"), F.count(tp).alias("n_tp"), F.median(tp).alias("tp_median"), F.avg(tp).alias("tp_mean"), F.min(tp).alias("tp_min"), F.max(tp).alias("tp_max"),
        *(x.alias(f"n_{r.lower()}") for r, x in total.items()), F.count_if(F.col("rating").isNull()).alias("n_unrated"),
        F.count_distinct(F.coalesce("broker", F.lit(""))).alias("n_brokers"), F.max("published").alias("latest"),
    )
    best = F.greatest(*(F.col(f"n_{r.lower()}") for r in RATINGS))
    modal = F.coalesce(*(F.when((F.col(f"n_{r.lower()}") == best) & (best > 0), r) for r in RATINGS))
    return votes.withColumn("modal_rating", modal)


def tp_trajectory(reports: DataFrame, by: str = "company") -> DataFrame:
    """Monthly median target price of companies with enough dated ones, and its level from 0 to 7."""
    rows = with_price(reports).where("published is not null").withColumn("__n", F.count("*").over(W.partitionBy(by))).where(F.col("__n") >= RECENT)
    months = rows.groupBy(by, F.trunc("published", "month").alias("month")).agg(F.median("target_price").alias("tp"))
    lo, hi = F.min("tp").over(W.partitionBy(by)), F.max("tp").over(W.partitionBy(by))
    return months.withColumn("level", F.when(hi == lo, 3).otherwise(F.floor(7 * (F.col("tp") - lo) / F.nullif(hi - lo, F.lit(0.0)) + 0.5)).cast("long"))


def tp_delta(reports: DataFrame, by: str = "company") -> DataFrame:
    """Relative change against the same broker's previous target price."""
    before = F.lag("target_price").over(W.partitionBy(by, "broker").orderBy("published", "report_id"))
    return with_price(reports).withColumn("tp_delta", (F.col("target_price") - before) / before)


def divergences(reports: DataFrame, by: str = "company") -> DataFrame:
    """Latest report of each broker whose target price or rating is off the company's median or modal one."""
    latest = first_per(reports, [by, "broker"], [F.desc("published"), F.desc("report_id")])
    both = latest.join(consensus(reports, by).select(by, "tp_median", "modal_rating"), by)
    off = (F.col("target_price") - F.col("tp_median")) / F.col("tp_median")
    tp = both.where((F.col("target_price") > 0) & (F.abs(off) > TP_OFF)).select(by, "broker", "report_id", F.lit("target-price").alias("kind"), off.alias("gap"))
    return tp.unionByName(both.where(F.col("rating") != F.col("modal_rating")).select(by, "broker", "report_id", F.lit("rating").alias("kind"), F.lit(None).cast("double").alias("gap")))


def preferred_reports(reports: DataFrame, sites: list[str]) -> DataFrame:
    """One row for each broker, day and title: that of the site named first, then of the least id."""
    key = F.lower(F.regexp_replace("title", r"\s+", ""))
    site = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, sites)), F.col("site")), F.lit(0)), F.lit(len(sites) + 1))
    return first_per(reports.withColumn("__title", key), ["broker", "published", "__title"], [site, F.asc("report_id")]).drop("__title")


def merged_views(views: DataFrame) -> DataFrame:
    """One view for each broker, day and target price: the base of the earliest article, with its gaps filled."""
    return views.groupBy("broker", "published", "target_price").agg(
        F.min_by("article", F.struct("article_date", "article")).alias("article"), F.min("article_date").alias("article_date"),
        F.max_by("snippet", F.struct(F.length("snippet"), "article")).alias("snippet"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("queries")))).alias("queries"),
    )


def broker_views(views: DataFrame, by: str = "company", most: int = 8) -> DataFrame:
    """Of a company's newest views (published, broker, report_id decide), up to ``most``: median target price (of two middle ones the mean, rounded),
    the brokers of each rating in that order, and whether the views agree.
    """
    nth = F.row_number().over(W.partitionBy(by).orderBy(F.desc_nulls_last("published"), "broker", "report_id"))
    shown = views.select(by, "broker", "rating", "target_price", nth.alias("nth")).where(F.col("nth") <= most)
    brokers = lambda r: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rating") == r, F.struct("nth", "broker")))), lambda x: x["broker"]), ", ").alias(f"{r.lower()}_brokers")
    middle = F.when(F.count("target_price") % 2 == 0, F.floor(F.median("target_price") + 0.5)).otherwise(F.median("target_price"))
    out = shown.groupBy(by).agg(F.count("*").alias("n_views"), middle.alias("tp_median"), *map(brokers, RATINGS), F.count_distinct("rating").alias("n_ratings"))
    return out.withColumn("verdict", F.when(F.col("n_ratings") == 0, "none").when(F.col("n_ratings") == 1, "agree").otherwise("split"))


def source_quality(reports: DataFrame) -> DataFrame:
    """How many reports were read, gated, without a file or failed; their days, sites, pages and bytes. Pages and bytes are those of what was read."""
    extracted, gated, none = F.col("extraction_ok"), F.col("requires_auth"), F.col("pdf_url").isNull()
    read = lambda c: F.coalesce(F.sum(F.when(extracted, F.col(c))), F.lit(0))
    return reports.agg(
        F.count("*").alias("n"), F.count_if(extracted).alias("extracted"), F.count_if(~extracted & gated).alias("gated"), F.count_if(~extracted & ~gated & none).alias("no_pdf"),
        F.count_if(~extracted & ~gated & ~none).alias("failed"), F.coalesce(F.date_diff(F.max("published"), F.min("published")), F.lit(0)).alias("span_days"), F.array_sort(F.collect_set("site")).alias("sites"),
        read("pages").alias("pages"), read("bytes").alias("bytes"),
    )


# Filings and ownership


def holder_filings(filings: DataFrame, holder: str, kinds: dict[str, str]) -> DataFrame:
    """Filings by a holder of one of the kinds (pattern to name), with the kind."""
    kind = F.coalesce(*(F.when(F.col("report_name").rlike(p), name) for p, name in kinds.items()))
    return filings.where(F.col("filer").contains(holder)).withColumn("kind", kind).where(F.col("kind").isNotNull())


def detail_scope(details: DataFrame, filings: DataFrame) -> DataFrame:
    return details.join(filings, "corp", "left_semi")


def enriched(filings: DataFrame, major: DataFrame, executive: DataFrame, match: dict[str, str]) -> DataFrame:
    """filings (rcept_no, kind) with the first matching detail (rcept_no, seq, shares, pct).

    match says by kind whether major, executive or both details count; status is ok,
    partial (a missing number) or no-match.
    """
    side = lambda d, p: first_per(d, ["rcept_no"], [F.asc("seq")]).select("rcept_no", F.col("shares").alias(f"{p}_shares"), F.col("pct").alias(f"{p}_pct"), F.lit(True).alias(p))
    both = filings.join(side(major, "m"), "rcept_no", "left").join(side(executive, "e"), "rcept_no", "left")
    use = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in match.items()), F.lit("both"))
    from_m = (use != "executive") & F.coalesce(F.col("m"), F.lit(False))
    from_e = ~from_m & (use != "major") & F.coalesce(F.col("e"), F.lit(False))
    pick = lambda c: F.when(from_m, F.col(f"m_{c}")).when(from_e, F.col(f"e_{c}"))
    out = both.withColumns({"shares": pick("shares"), "pct": pick("pct")})
    status = F.when(~(from_m | from_e), "no-match").when(F.col("shares").isNull() | F.col("pct").isNull(), "partial").otherwise("ok")
    return out.withColumn("status", status).drop("m", "e", "m_shares", "m_pct", "e_shares", "e_pct")


def latest_regular_filing(filings: DataFrame, as_of: Column, months: int = 14) -> DataFrame:
    """The latest filing of each company and regular kind within months before as_of."""
    near = filings.where((F.col("filed") <= as_of) & (F.col("filed") > F.add_months(as_of, -months)))
    return first_per(near, ["corp", "kind"], [F.desc("filed"), F.desc("rcept_no")])


def date_chunks(ranges: DataFrame, days: int = 80) -> DataFrame:
    """Rows with start and end dates, cut into chunks (chunk_start, chunk_end) of at most days days each; none where end is before start."""
    starts = F.sequence("start", "end", F.make_interval(days=F.lit(days)))
    each = ranges.where("start <= end").withColumn("chunk_start", F.explode(starts))
    return each.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col("end"))).drop("start", "end")


def standalone_quarter(accounts: DataFrame) -> DataFrame:
    """Amounts of single quarters from those added up over a fiscal year."""
    before = F.lag("amount").over(W.partitionBy("corp", "account", "year").orderBy("quarter"))
    return accounts.withColumns({"standalone": F.col("amount") - F.coalesce(before, F.lit(0.0)), "derived": before.isNotNull()})


def filings_by_month(filings: DataFrame, kinds: list[str]) -> DataFrame:
    counts = (F.count_if(F.col("kind") == k).alias(k) for k in kinds)
    return filings.groupBy(F.date_format("filed", "yyyy-MM").alias("month")).agg(*counts, F.count("*").alias("total"))


def threshold_crossings(holdings: DataFrame, at: float = 5.0) -> DataFrame:
    entry, leave = (F.col("prev_pct") < at) & (F.col("pct") >= at), (F.col("prev_pct") >= at) & (F.col("pct") < at)
    return holdings.withColumn("crossing", F.when(entry, "entry").when(leave, "exit")).where("crossing is not null")


def big_moves(holdings: DataFrame, top: int = 15) -> DataFrame:
    """The largest increases and decreases of single reports."""
    df = holdings.withColumn("delta", F.col("pct") - F.col("prev_pct"))
    side = lambda up: df.where(F.col("delta") > 0 if up else F.col("delta") < 0).orderBy(F.desc(F.abs("delta")), "rcept_no").limit(top).withColumn("direction", F.lit("up" if up else "down"))
    return side(True).unionByName(side(False))


def cumulative_change(holdings: DataFrame) -> DataFrame:
    at = F.struct("filed", "rcept_no")
    return holdings.groupBy("corp").agg(
        F.min_by("prev_pct", at).alias("first_pct"), F.max_by("pct", at).alias("last_pct"), (F.max_by("pct", at) - F.min_by("prev_pct", at)).alias("delta"),
        F.count("*").alias("n"), F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"),
    )


def reason_counts(holdings: DataFrame, trade: str) -> DataFrame:
    """Filings of each reason, its share, and whether it is a plain trade."""
    return holdings.groupBy("reason").agg(F.count("*").alias("n")).withColumns({"share": F.col("n") / F.sum("n").over(W.partitionBy()), "pure_trade": F.col("reason").rlike(trade)})


def holding_histogram(holdings: DataFrame, cuts: tuple[float, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Companies by band of their latest holding."""
    latest = holdings.groupBy("corp").agg(F.max_by("pct", F.struct("filed", "rcept_no")).alias("pct"))
    band = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c <= F.col("pct")))
    return latest.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def quantity_vs_issuance(holdings: DataFrame, least: float = 0.3) -> DataFrame:
    """How much of a change in percent comes from shares traded, and how much from shares issued or retired."""
    before = F.col("prev_shares") / F.nullif(F.col("prev_pct"), F.lit(0.0)) * 100
    quantity = (F.col("shares") - F.col("prev_shares")) / before * 100
    df = holdings.withColumns({"quantity_effect": quantity, "issuance_effect": F.col("pct") - F.col("prev_pct") - quantity})
    return df.where(F.abs("issuance_effect") >= least)


# Contracts


def contract_latest(contracts: DataFrame) -> DataFrame:
    """The effective state of each chain (name, counterparty, project): its latest disclosure."""
    return first_per(contracts, ["name", "counterparty", "project"], [F.desc("disclosed"), F.desc("contract_id")])


def contract_maturity(latest: DataFrame) -> DataFrame:
    """Amounts and chains by end year (null: undated), added up over the years; unknown amounts are counted apart."""
    by = latest.groupBy(F.year("ends").alias("end_year")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.count_if(F.col("amount").isNull()).alias("n_undisclosed"))
    upto = W.partitionBy(F.col("end_year").isNull()).orderBy("end_year").rowsBetween(W.unboundedPreceding, 0)
    return by.withColumn("cumulative", F.sum("amount").over(upto))


def backlog_ratios(backlog: DataFrame, revenue: DataFrame) -> DataFrame:
    """Backlog by revenue of the same company and basis, in years."""
    return backlog.join(revenue, ["corp", "basis"]).withColumn("backlog_years", F.col("backlog") / F.nullif(F.col("revenue"), F.lit(0.0)))


# Peers, valuations, funds, portfolios


def peer_table(peers: DataFrame, metric: str, ascending: bool = True) -> DataFrame:
    """Peers in order of a metric, missing ones last, with the median beside each."""
    order = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    middle = peers.agg(F.median(metric).alias("median"))
    return total_rank(peers, [order, F.asc("ticker")], "rank").crossJoin(F.broadcast(middle))


def band_label(percentile: Column) -> Column:
    return F.when(percentile.isNull(), "insufficient-data").when(percentile <= 33, "lower").when(percentile >= 67, "upper").otherwise("middle")


def valuation_bands(history: DataFrame, metrics: list[str], min_years: float = 3.0) -> DataFrame:
    """For each ticker and metric over its positive values: current, min, median, max, percentile and label."""
    long = history.unpivot(["ticker", "date"], metrics, "metric", "value").where(F.col("value") > 0)
    now = long.groupBy("ticker", "metric").agg(F.max_by("value", "date").alias("current"))
    out = long.join(now, ["ticker", "metric"]).groupBy("ticker", "metric").agg(
        F.first("current").alias("current"), F.min("value").alias("low"), F.median("value").alias("median"), F.max("value").alias("high"),
        (F.avg((F.col("value") <= F.col("current")).cast("double")) * 100).alias("percentile"), (F.date_diff(F.max("date"), F.min("date")) / 365.25).alias("years"),
    )
    return out.withColumn("label", F.when(F.col("years") < min_years, "short-history").otherwise(band_label(F.col("percentile"))))


def nice_step(span: Column, ticks: int = 5) -> Column:
    """An axis step of 1, 2 or 5 times a power of ten."""
    raw = span / ticks
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return base * F.when(raw / base <= 1, 1).when(raw / base <= 2, 2).when(raw / base <= 5, 5).otherwise(10)


def etf_overlap(holdings: DataFrame) -> DataFrame:
    """For each pair of funds: common symbols, overlap of weights, and symbols of one side alone.

    holdings (fund, symbol, seq, weight); of a repeated symbol the last counts. The join is
    by symbol, and pairs are counted before they meet, so its size follows the holdings.
    """
    own = first_per(holdings, ["fund", "symbol"], [F.desc("seq")]).select("fund", "symbol", "weight")
    size = own.groupBy("fund").agg(F.count("*").alias("n"))
    a, b = (own.select(F.col("fund").alias(f"fund_{x}"), "symbol", F.col("weight").alias(f"w_{x}")) for x in "ab")
    common = a.join(b, "symbol").where("fund_a < fund_b").groupBy("fund_a", "fund_b").agg(F.count("*").alias("n_common"), F.sum(F.least("w_a", "w_b")).alias("overlap"))
    for x in "ab":
        common = common.join(size.select(F.col("fund").alias(f"fund_{x}"), F.col("n").alias(f"n_{x}")), f"fund_{x}")
    return common.select("fund_a", "fund_b", "n_common", "overlap", (F.col("n_a") - F.col("n_common")).alias("only_a"), (F.col("n_b") - F.col("n_common")).alias("only_b"))


def position_prices(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """Positions with the close of their symbol, else of the fallback symbol; a manual price or P&L goes first."""
    side = lambda name, key: closes.select(F.col("ticker").alias(key), F.col("close").alias(name))
    df = positions.join(side("__own", "symbol"), "symbol", "left").join(side("__other", "fallback"), "fallback", "left")
    price = F.coalesce("manual_price", "__own", "__other")
    pnl = F.coalesce(F.col("manual_pnl"), (price - F.col("cost")) * F.col("quantity"))
    return df.withColumns({"price": price, "pnl": pnl}).drop("__own", "__other")


def portfolio_totals(priced: DataFrame, by: str) -> DataFrame:
    cost = F.sum(F.col("cost") * F.col("quantity"))
    return priced.groupBy(by).agg(F.sum("pnl").alias("pnl"), cost.alias("cost"), (F.sum("pnl") / F.nullif(cost, F.lit(0.0)) * 100).alias("return_pct"))
