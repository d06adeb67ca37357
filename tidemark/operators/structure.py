"""Price structure per ticker: zones of pivots, touches, volume profile, waves and their levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FAR, BINS = 0.30, 50


def pivots(panel: DataFrame) -> DataFrame:
    """(ticker, date, n, price, kind) of the swing pivots."""
    p = panel.where("pivot_high or pivot_low").select("ticker", "date", "n", F.explode(F.array_compact(F.array(
        F.when(F.col("pivot_high"), F.struct(F.col("high").alias("price"), F.lit("high").alias("kind"))), F.when(F.col("pivot_low"), F.struct(F.col("low").alias("price"), F.lit("low").alias("kind"))),
    ))).alias("p"))
    return p.select("ticker", "date", "n", "p.*")


def zones(panel: DataFrame) -> DataFrame:
    """Clusters of two or more pivots by price: a new one begins where the gap is over the tolerance.

    The tolerance is the larger of half the last ATR and half a percent of the last close.
    """
    last = panel.where("n = bars").select("ticker", F.greatest(0.5 * F.coalesce("atr14", F.lit(0.0)), 0.005 * F.col("close")).alias("tolerance"))
    by = W.partitionBy("ticker").orderBy("price", "n", "kind")
    gap = F.col("price") - F.lag("price").over(by)
    marked = pivots(panel).join(last, "ticker").withColumn("new", F.when(gap > F.col("tolerance"), 1).otherwise(0))
    grouped = marked.withColumn("zone", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    found = grouped.groupBy("ticker", "zone").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("center"), F.count("*").alias("pivots"))
    return found.where("pivots >= 2")


def touches(zones_: DataFrame, bars: DataFrame) -> DataFrame:
    """zones with bars that overlap them: count, last one and its volume. bars: (ticker, n, date, high, low, volume)."""
    b = bars.select("ticker", "n", "date", F.col("high").alias("bar_high"), F.col("low").alias("bar_low"), "volume")
    hit = zones_.join(b, (zones_["ticker"] == b["ticker"]) & (F.greatest("bar_low", "low") <= F.least("bar_high", "high"))).drop(b["ticker"])
    return hit.groupBy("ticker", "zone", "low", "high", "center", "pivots").agg(F.count("*").alias("touches"), F.max("n").alias("last_n"), F.max("date").alias("last_touch"), F.sum("volume").alias("volume"))


def zone_status(touched: DataFrame, panel: DataFrame, hold: int = 3, current_price: float | None = None) -> DataFrame:
    """Adds type, status, distance and far; current_price is the last close unless given."""
    tail = panel.withColumn("back", F.col("bars") - F.col("n")).where(F.col("back") < 5)
    side = tail.groupBy("ticker").agg(
        F.first(F.col("bars")).alias("bars"), F.max_by("close", "n").alias("price"), F.count_if(F.col("back") < hold).alias("held"),
        F.max(F.when(F.col("back") < hold, F.col("close"))).alias("top"), F.min(F.when(F.col("back") < hold, F.col("close"))).alias("bottom"),
        F.collect_list(F.struct("high", "low")).alias("five"),
    )
    df = touched.join(side, "ticker")
    price = F.col("price") if current_price is None else F.lit(current_price)
    df = df.withColumn("price", price)
    kind = F.when(F.col("high") < price, "support").when(F.col("low") > price, "resistance").otherwise("inside")
    broken = (F.col("held") == hold) & (((kind == "support") & (F.col("top") < F.col("low"))) | ((kind == "resistance") & (F.col("bottom") > F.col("high"))))
    flipped = broken & F.exists("five", lambda b: F.greatest(b["low"], F.col("low")) <= F.least(b["high"], F.col("high")))
    turned = F.when(kind == "support", "resistance").otherwise("support")
    distance = F.abs(F.col("center") - price) / price
    return df.withColumns({
        "type": F.when(flipped, turned).otherwise(kind), "status": F.when(flipped, "flipped").when(broken, "broken").otherwise("active"), "distance": distance, "far": distance > FAR,
    }).drop("five", "top", "bottom", "held")


def zone_score(zones_: DataFrame) -> DataFrame:
    """Touches, recency, volume, distance and status, the first and third scaled within the ticker."""
    w = W.partitionBy("ticker")

    def scaled(x):
        lo, hi = F.min(x).over(w), F.max(x).over(w)
        return F.when(hi > lo, (F.col(x) - lo) / F.nullif(hi - lo, F.lit(0))).otherwise(0.5)

    bonus = F.when(F.col("status") == "active", 1.0).when(F.col("status") == "flipped", 0.7).otherwise(0.0)
    recency = F.exp(-(F.col("bars") - F.col("last_n")) / 30)
    near = F.greatest(F.lit(0.0), 1 - F.col("distance") / FAR)
    return zones_.withColumn("score", 0.35 * scaled("touches") + 0.25 * recency + 0.20 * scaled("volume") + 0.15 * near + 0.05 * bonus)


def drawn_zones(scored: DataFrame, top: int = 3) -> DataFrame:
    """The best supports and resistances of each ticker, without broken or far ones."""
    fit = scored.where(F.col("type").isin("support", "resistance") & (F.col("status") != "broken") & ~F.col("far"))
    rank = F.row_number().over(W.partitionBy("ticker", "type").orderBy(F.desc("score"), "zone"))
    return fit.withColumn("rank", rank).where(F.col("rank") <= top)


def volume_profile(bars: DataFrame, bins: int = BINS) -> DataFrame:
    """(ticker, bin, volume, poc): volume by equal bins of the typical price; poc marks the first largest."""
    w = W.partitionBy("ticker")
    lo, hi = F.min("low").over(w), F.max("high").over(w)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = bars.withColumns({"lo": lo, "hi": hi, "typical": typical}).where("hi > lo and typical is not null and volume is not null")
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("typical") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int")))
    by_bin = df.groupBy("ticker", at.alias("bin")).agg(F.sum("volume").alias("volume"))
    return by_bin.withColumn("poc", F.row_number().over(w.orderBy(F.desc("volume"), "bin")) == 1)


def alternating(points: Column, least: Column) -> Column:
    """Of pivots (n, kind, price) in order, kinds in turn: the more extreme of equal kinds stays, small swings are left out.

    What stays depends on what stayed before, so the array is gone through in order. It is that of a ticker's recent bars, a few dozen points.
    """
    last = lambda kept: F.get(kept, F.size(kept) - 1)

    def step(kept: Column, x: Column) -> Column:
        before = last(kept)
        beyond = F.when(x["kind"] == "high", x["price"] > before["price"]).otherwise(x["price"] < before["price"])
        return (
            F.when(F.size(kept) == 0, F.array(x)).when(x["kind"] == before["kind"], F.when(beyond, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))).otherwise(kept))
            .when((least > 0) & (F.abs(x["price"] - before["price"]) < least), kept).otherwise(F.concat(kept, F.array(x)))
        )

    return F.aggregate(points, F.array().cast("array<struct<n:int,kind:string,price:double>>"), step)


def recent_pivots(panel: DataFrame, recent: int = 120) -> DataFrame:
    """Pivots of the last bars of each ticker, with the number of its bars and the least swing."""
    near = panel.where(F.col("n") > F.col("bars") - recent)
    edge = (F.col("n") > F.greatest(F.col("bars") - recent, F.lit(0)) + 5).alias("inside")
    last = panel.where("n = bars").select("ticker", F.col("bars").alias("size"), F.greatest(F.coalesce("atr14", F.lit(0.0)), F.col("close") * 0.01).alias("least"))
    return pivots(near.where(edge)).join(last, "ticker")


def _turns(panel: DataFrame, recent: int) -> DataFrame:
    """(ticker, least, size, turns): the alternating pivots of each ticker as an array."""
    point = F.struct(F.col("n").cast("int").alias("n"), "kind", F.col("price").cast("double").alias("price"))
    points = recent_pivots(panel, recent).groupBy("ticker").agg(F.first("least").alias("least"), F.first("size").alias("size"), F.array_sort(F.collect_list(point)).alias("points"))
    return points.select("ticker", "least", "size", alternating(F.col("points"), F.col("least")).alias("turns"))


def alternating_pivots(panel: DataFrame, recent: int = 120) -> DataFrame:
    """(ticker, nth, n, kind, price): highs and lows in turn."""
    return _turns(panel, recent).select("ticker", F.posexplode("turns").alias("nth", "t")).select("ticker", "nth", "t.n", "t.kind", "t.price")


def waves(panel: DataFrame, recent: int = 120) -> DataFrame:
    """(ticker, kind, direction, confidence, drawable, first_n, last_n, first_price, last_price): five-leg moves, and corrections of two legs after them.

    The confidence weighs how legs compare with each other and with the least swing, and how recent the last one is.
    """
    rows = _turns(panel, recent).where("size(turns) >= 6").select("*", F.explode(F.sequence(F.lit(0), F.size("turns") - 6)).alias("i"))
    t = lambda k: F.get("turns", F.col("i") + k)
    rows = rows.select("ticker", "least", "size", *(t(k).alias(f"t{k}") for k in range(9)))
    price, leg = (lambda k: F.col(f"t{k}.price")), (lambda k: F.abs(F.col(f"t{k + 1}.price") - F.col(f"t{k}.price")))
    big = lambda *legs: sum((F.when(leg(k) >= F.col("least"), 1).otherwise(0) for k in legs), F.lit(0))
    up, one = F.col("t0.kind") == "low", F.greatest(leg(0), F.lit(1.0))
    over = (price(1) - price(4)) * F.when(up, 1).otherwise(-1)
    fresh = lambda k, days: F.greatest(F.lit(0.0), 1 - (F.col("size") - F.col(f"t{k}.n")) / days)
    move = F.lit(0.25) + 0.2 * big(0, 1, 2, 3, 4) / 5 + 0.25 * F.when(leg(2) >= 0.9 * leg(0), 1.0).otherwise(leg(2) / one)
    move = move + (0.2 * F.greatest(F.lit(0.0), 1 - F.greatest(over, F.lit(0.0)) / one) + 0.1 * fresh(5, 60))
    back = F.lit(0.3) + 0.25 * big(6, 7) / 2 + 0.25 * F.least(leg(6), leg(7)) / F.greatest(leg(6), leg(7), F.lit(1.0)) + 0.2 * fresh(8, 45)
    found = lambda kind, direction, score, a, b: F.struct(
        F.lit(kind).alias("kind"), direction.alias("direction"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("confidence"), (score >= 0.55).alias("drawable"),
        F.col(f"t{a}.n").alias("first_n"), F.col(f"t{b}.n").alias("last_n"), price(a).alias("first_price"), price(b).alias("last_price"),
    )
    trend = F.when(up, "bullish").otherwise("bearish")
    both = F.array(found("impulse", trend, move, 0, 5), F.when(F.col("t8").isNotNull(), found("corrective", F.when(up, "bearish-correction").otherwise("bullish-correction"), back, 6, 8)))
    return rows.select("ticker", F.inline(F.array_compact(both)))


def best_wave(candidates: DataFrame) -> DataFrame:
    """The drawable candidate of the highest confidence (to nine places) of each ticker, of those the latest, the earliest begun, and by kind."""
    order = W.partitionBy("ticker").orderBy(F.desc(F.round("confidence", 9)), F.desc("last_n"), "first_n", "kind")
    return candidates.where("drawable").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def fib_levels(moves: DataFrame) -> DataFrame:
    """Retracements and extensions of (ticker, first_price, last_price)."""
    delta = F.col("last_price") - F.col("first_price")
    back = [F.struct(F.lit("retracement").alias("level"), F.lit(r).alias("ratio"), (F.col("last_price") - delta * r).alias("price")) for r in (0.382, 0.5, 0.618)]
    on = [F.struct(F.lit("extension").alias("level"), F.lit(r).alias("ratio"), (F.col("first_price") + delta * r).alias("price")) for r in (1.0, 1.618)]
    return moves.where(delta != 0).select("ticker", F.inline(F.array(*back, *on)))
