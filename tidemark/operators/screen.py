"""The market screen: cross-sectional scores of one row per ticker, rankings and comparisons between days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import series
from tidemark.operators.rules import counts

SCREEN_RETURNS = (1, 7, 30, 60, 120, 252)
LENSES = ("short", "intermediate", "structural", "composite")
#: Category strength of leadership labels, weakest first.
STRENGTH = ["none", "watch", "short-spike", "intermediate-leader", "structural-leader", "all-round-leader"]


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def scaled(x: Column, lo: float, hi: float, top: float) -> Column:
    return clamp((x - lo) / (hi - lo) * top, 0.0, top)


def mean_present(*xs: Column) -> Column:
    """Mean of those that are there."""
    n = reduce(lambda a, b: a + b, (F.when(x.isNotNull(), 1).otherwise(0) for x in xs))
    total = reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0.0)) for x in xs))
    return total / F.nullif(n, F.lit(0))


def weighted_present(*xw: tuple[Column, float]) -> Column:
    """Weighted mean of those that are there, over their weights."""
    weight = reduce(lambda a, b: a + b, (F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in xw))
    return reduce(lambda a, b: a + b, (F.coalesce(x * w, F.lit(0.0)) for x, w in xw)) / F.nullif(weight, F.lit(0.0))


def rs_raw() -> Column:
    return 0.4 * F.col("return63") + 0.3 * F.col("return126") + 0.3 * F.col("return252")


def rs_lookup(entries: DataFrame, rs: DataFrame) -> DataFrame:
    """entries with rs_percentile of (ticker, rs_percentile), its status and the reason where it is missing."""
    known = rs.select("ticker", "rs_percentile", F.lit(True).alias("__there"))
    out = entries.join(known, "ticker", "left")
    reason = F.when(F.col("__there").isNull(), "ticker-not-in-cache").when(F.col("rs_percentile").isNull(), "percentile-missing")
    return out.withColumn("rs_reason", reason).withColumn("rs_status", F.when(reason.isNull(), "available").otherwise("unavailable")).drop("__there")


def market_relative(entries: DataFrame, backdrop: DataFrame | None = None, spans: tuple[int, ...] = (7, 30, 60), by: list[str] | None = None) -> DataFrame:
    """Adds relative<n>: the return less that of the row's own market (market, return<n>...), without a backdrop the mean of the market's entries."""
    if backdrop is None:
        own = W.partitionBy(*(by or []), "market")
        return entries.withColumns({f"relative{n}": F.col(f"return{n}") - F.avg(f"return{n}").over(own) for n in spans})
    names = {f"return{n}": f"market{n}" for n in spans}
    side = backdrop.select(*(by or []), "market", *(F.col(a).alias(b) for a, b in names.items()))
    out = entries.join(side, [*(by or []), "market"], "left")
    return out.withColumns({f"relative{n}": F.col(f"return{n}") - F.col(f"market{n}") for n in spans}).drop(*names.values())


def style_checks() -> tuple[Column, Column]:
    """(passed, available) of six checks."""
    rules = [F.col("return120") > 0, F.col("return252") > 0, F.col("rs_percentile") >= 70, F.col("high_ratio") >= 0.75, F.col("low_ratio") >= 1.3, F.col("volume_ratio") >= 0.8]
    yes, no, _ = counts(rules)
    return yes, yes + no


def caution_flags() -> Column:
    returns = [F.col(f"return{n}") for n in SCREEN_RETURNS]
    any_of = lambda xs: reduce(lambda a, b: a | b, xs)
    extreme = any_of([F.coalesce((r >= 5) | (r <= -0.8), F.lit(False)) for r in returns])
    zeros = reduce(lambda a, b: a + b, (F.when(r == 0, 1).otherwise(0) for r in returns))
    no_volume = F.col("volume_ratio").isNull()
    return F.array_compact(F.array(
        F.when(no_volume | F.coalesce(F.col("volume") == 0, F.lit(False)), "check-volume"),
        F.when(F.col("bars") < series.YEAR, "short-history"),
        F.when(F.size(F.filter("data_quality", lambda x: x.rlike("history|volume|latest|missing"))) > 0, "check-data"),
        F.when(F.size(F.filter("data_quality", lambda x: x.rlike("latest"))) > 0, "stale-latest"),
        F.when(extreme, "extreme-return"),
        F.when((zeros >= 4) & (no_volume | (F.col("volume_ratio") == 0)), "halted-or-relisted"),
    ))


def buyability() -> Column:
    """Additive score from 0 to 100 with penalties."""
    plus = lambda rule, n: F.when(rule, float(n)).otherwise(0.0)
    v, flags = F.col("volume_ratio"), F.size("caution_flags")
    total = (
        F.coalesce(scaled(F.col("rs_percentile"), 70, 100, 25), F.lit(0.0))
        + plus(F.col("return30") > 0, 10) + plus(F.col("return60") > 0, 10) + plus(F.col("return120") > 0, 10)
        + F.coalesce(scaled(F.col("high_proximity"), 85, 100, 20), F.lit(0.0))
        + F.when((v >= 1.2) & (v <= 5), 15.0).when((v >= 0.8) & (v < 1.2), 7.0).when((v > 5) & (v < 10), 5.0).otherwise(0.0)
        + plus(flags == 0, 10)
        - plus(F.col("return1") >= 0.2, 15) - plus(F.col("return7") >= 0.5, 20) - plus(v >= 10, 20)
        - F.least(F.lit(35.0), flags * 12.0)
    )
    return F.round(clamp(total), 2)


def setup_label() -> Column:
    yes = lambda x: F.coalesce(x, F.lit(False))
    v, rs = F.col("volume_ratio"), F.col("rs_percentile")
    hot = yes(F.col("return1") >= 0.2) | yes(F.col("return7") >= 0.5) | yes(v >= 10)
    spike = yes((F.col("structural_score") < 50) & (F.col("return7") >= 0.2))
    pullback = yes(F.col("structural_score") >= 75) & yes(F.col("intermediate_score") >= 65) & yes(F.col("return7") < 0.2) & F.coalesce(F.col("return1") < 0.2, F.lit(True)) & yes(rs >= 80)
    return (
        F.when(F.size("caution_flags") > 0, "check-data")
        .when(hot | spike, "overheated")
        .when(yes(F.col("high_proximity") >= 95) & yes(rs >= 90) & yes((v >= 1.2) & (v <= 5)), "breakout")
        .when(pullback, "pullback")
        .otherwise("watch")
    )


def leadership_label(short: Column, intermediate: Column, structural: Column) -> Column:
    at = lambda x, n: F.coalesce(x >= n, F.lit(False))
    return (
        F.when(at(short, 75) & at(intermediate, 75) & at(structural, 75), "all-round-leader")
        .when(at(structural, 75) & at(intermediate, 65), "structural-leader")
        .when(at(intermediate, 75), "intermediate-leader").when(at(short, 75), "short-spike").otherwise("watch")
    )


def strength(label: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STRENGTH)), F.coalesce(label, F.lit("none"))) - 1


def scored(entries: DataFrame, backdrop: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Scores, flags and labels of entries: panel rows with market, rs_percentile and data_quality; one per ticker (and by)."""
    df = market_relative(entries, backdrop, by=by)
    for n in SCREEN_RETURNS:
        df = series.percentile(df, f"return{n}", f"pct{n}", by)
    passed, available = style_checks()
    df = df.withColumns({"style_passed": passed, "style_available": available, "__high": F.col("high_ratio") * 100})
    gap = lambda n, k: clamp(F.col(f"relative{n}") * k + 50)
    col = F.col
    df = df.withColumns({
        "__short": mean_present(col("pct1"), col("pct7"), F.when(col("volume_ratio").isNotNull(), F.least(col("volume_ratio") / 2, F.lit(1.0)) * 100), gap(7, 500)),
        "__intermediate": mean_present(col("pct30"), col("pct60"), gap(30, 300), gap(60, 250)),
        "__structural": mean_present(col("pct120"), col("pct252"), col("rs_percentile"), F.when(col("__high").isNotNull(), F.least(col("__high"), F.lit(100.0))), passed / F.nullif(available, F.lit(0)) * 100),
    })
    df = df.withColumns({
        "short_score": F.round("__short", 2), "intermediate_score": F.round("__intermediate", 2), "structural_score": F.round("__structural", 2),
        "composite_score": F.round(weighted_present((col("__short"), 0.2), (col("__intermediate"), 0.4), (col("__structural"), 0.4)), 2),
        "high_proximity": F.round("__high", 2), "leadership_label": leadership_label(col("__short"), col("__intermediate"), col("__structural")), "caution_flags": caution_flags(),
    })
    df = df.withColumn("buyability", buyability()).withColumn("setup_label", setup_label())
    return df.drop("__high", "__short", "__intermediate", "__structural")


def lens_rankings(scores: DataFrame, top: int = 20, by: list[str] | None = None) -> DataFrame:
    """(lens, rank, ticker, score): the best of each lens, ties by ticker."""
    by = by or []
    long = scores.select(*by, "ticker", F.explode(F.array(*(F.struct(F.lit(x).alias("lens"), F.col(f"{x}_score").alias("score")) for x in LENSES))).alias("s")).select(*by, "ticker", "s.*")
    rank = F.row_number().over(W.partitionBy(*by, "lens").orderBy(F.desc("score"), "ticker"))
    return long.where("score is not null").withColumn("rank", rank).where(F.col("rank") <= top)


def candidate_lists(scores: DataFrame, least: float = 70, without_flags: bool = False) -> DataFrame:
    """(list, rank, ticker): buyable, pullback, breakout and caution candidates."""
    bad = F.col("setup_label").isin("overheated", "check-data")
    flagged = F.size("caution_flags") > 0
    lists = {
        "buyable": (F.col("buyability") >= least) & ~bad & (~flagged if without_flags else F.lit(True)),
        "pullback": F.col("setup_label") == "pullback", "breakout": F.col("setup_label") == "breakout", "caution": flagged | bad,
    }
    each = scores.where("buyability is not null").withColumn("list", F.explode(F.array_compact(F.array(*(F.when(rule, name) for name, rule in lists.items())))))
    order = [F.when(F.col("list") != "caution", F.col("buyability")).desc_nulls_last(), F.desc_nulls_last("composite_score"), F.asc("ticker")]
    return each.withColumn("rank", F.row_number().over(W.partitionBy("list").orderBy(*order))).select("list", "rank", "ticker", "buyability", "composite_score", "setup_label")


def new_entrants(now: DataFrame, before: DataFrame, top: int = 20) -> DataFrame:
    """Rows of the top of now whose (lens, ticker) is not in the top of before."""
    return now.where(F.col("rank") <= top).join(before.where(F.col("rank") <= top), ["lens", "ticker"], "left_anti")


def prior_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """Label upgrades and upward crossings against the day before; without a row before, as from below."""
    old = before.select("ticker", *(F.col(x).alias(f"old_{x}") for x in ("leadership_label", "rs_percentile", "high_proximity", "volume_ratio")))
    df = now.join(old, "ticker", "left")
    over = lambda x, n: F.coalesce(F.col(x) >= n, F.lit(False)) & F.coalesce(F.col(f"old_{x}") < n, F.lit(True))
    return df.withColumns({
        "upgraded": strength(F.col("leadership_label")) > strength(F.col("old_leadership_label")),
        "rs_cross": over("rs_percentile", 90), "proximity_cross": over("high_proximity", 95), "volume_cross": over("volume_ratio", 1.5),
    })


def entrant_events(now: DataFrame, before: DataFrame, now_ranks: DataFrame, before_ranks: DataFrame, top: int = 20) -> DataFrame:
    """One row per ticker with its event kinds, best ranks and scores."""
    entered = new_entrants(now_ranks, before_ranks, top).select("ticker", F.concat(F.lit("new-"), "lens").alias("event"))
    diff = prior_diff(now, before)
    kinds = {"upgraded": "upgrade", "rs_cross": "rs-cross", "proximity_cross": "proximity-cross", "volume_cross": "volume-cross"}
    crossed = diff.select("ticker", F.explode(F.array_compact(F.array(*(F.when(F.col(k), v) for k, v in kinds.items())))).alias("event"))
    events = entered.unionByName(crossed).groupBy("ticker").agg(F.array_sort(F.collect_set("event")).alias("events"))
    best = lambda r, name: r.groupBy("ticker").agg(F.min("rank").alias(name))
    out = events.join(best(now_ranks, "best_rank"), "ticker", "left").join(best(before_ranks, "prior_best_rank"), "ticker", "left")
    return out.join(now.select("ticker", "composite_score", "rs_percentile"), "ticker")


def latest_before(snapshots: DataFrame, date: Column, key: str = "as_of") -> DataFrame:
    """Rows of the latest snapshot strictly before date."""
    found = snapshots.where(F.col(key) < date).agg(F.max(key).alias("__at"))
    return snapshots.join(F.broadcast(found), F.col(key) == F.col("__at"), "left_semi")


def universe_counts(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count("*").alias("listed"), F.count_if(F.col("bars") >= series.YEAR).alias("full_history"), F.count("rs_percentile").alias("eligible"),
        F.count_if(F.col("rs_percentile").isNull()).alias("failed"),
    )


def theme_counts(scores: DataFrame, top: int = 20, most: int = 5) -> DataFrame:
    """Industries of the top of the composite ranking."""
    best = scores.where("composite_score is not null").orderBy(F.desc("composite_score"), "ticker").limit(top)
    theme = F.coalesce(F.nullif(F.trim("industry"), F.lit("")), F.nullif(F.trim("product"), F.lit("")), F.lit("unclassified"))
    return best.groupBy(theme.alias("theme")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme").limit(most)
