"""Price-bar indicators: one row per (ticker, date), all tickers at once.

A rolling value is null until its window is full and every value in it is there. All native
windows share one partitioning and order, so they plan into one exchange and one sort. The
recursive indicators (EMA, MACD, Wilder RSI, ADX) run per ticker in a grouped map.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

YEAR = 252
RETURNS = (1, 7, 30, 60, 63, 120, 126, 252)
MEANS = (5, 20, 50, 60, 120, 150, 200)


def by_date():
    return W.partitionBy("ticker").orderBy("date")


def rows(first: int, last: int = 0):
    return by_date().rowsBetween(first, last)


def full(fn, x: Column | str, n: int, last: int = 0) -> Column:
    """fn(x) over the n rows that end at row `last`, if x is there in all of them."""
    w = rows(last - n + 1, last)
    return F.when(F.count(x).over(w) == n, fn(x).over(w))


def bars_from_trades(trades: DataFrame) -> DataFrame:
    """Daily bars of trades (ticker, date, seq columns a, b, price, quantity)."""
    at = F.struct("a", "b", "price")
    return trades.groupBy("ticker", "date").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"),
    )


def quality(bars: DataFrame, min_bars: int = 5, need_volume: bool = False) -> DataFrame:
    """Bars of tickers that have min_bars and a close (and, if asked, a volume) in every bar."""
    bad = F.count_if(F.col("close").isNull() | (F.lit(need_volume) & F.col("volume").isNull()))
    fit = bars.groupBy("ticker").agg(F.count("*").alias("n"), bad.alias("bad")).where((F.col("n") >= min_bars) & (F.col("bad") == 0))
    return bars.join(fit, "ticker", "left_semi")


def as_of(bars: DataFrame, date: str) -> DataFrame:
    return bars.where(F.col("date") <= F.lit(date).cast("date"))


def panel(bars: DataFrame) -> DataFrame:
    """Every native indicator of every bar."""
    close, prior = F.col("close"), F.lag("close").over(by_date())
    b = bars.withColumns({
        "n": F.row_number().over(by_date()),
        "bars": F.count("*").over(W.partitionBy("ticker")),
        "change": close - prior,
        "tr": F.when(prior.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))),
        "is_high": F.when(F.count("close").over(rows(-YEAR + 1, -1)) == YEAR - 1, (close > F.max("close").over(rows(-YEAR + 1, -1))).cast("int")),
    })
    gain = F.when(F.col("change") >= 0, F.col("change")).otherwise(0.0)
    loss = F.when(F.col("change") < 0, -F.col("change")).otherwise(0.0)
    last14 = rows(-13)
    gains, losses = F.sum(gain).over(last14), F.sum(loss).over(last14)
    mid, dev = full(F.avg, "close", 20), full(F.stddev_pop, "close", 20)
    half = lambda n: (full(F.max, "high", n) + full(F.min, "low", n)) / 2
    high52, low52 = full(F.max, "close", YEAR), full(F.min, "close", YEAR)
    at_high = F.max_by("n", F.struct("close", "n")).over(rows(-YEAR + 1))
    first_pivot = (F.col("n") > 5) & (F.col("n") <= F.col("bars") - 5)
    out = b.withColumns({
        **{f"ma{n}": full(F.avg, "close", n) for n in MEANS},
        "vol20": full(F.avg, "volume", 20),
        **{f"return{n}": F.when(F.lag("close", n).over(by_date()) != 0, close / F.lag("close", n).over(by_date()) - 1) for n in RETURNS},
        "rsi14": F.when(F.count("change").over(last14) == 14, F.when(losses == 0, 100.0).otherwise(100 - 100 / (1 + gains / F.nullif(losses, F.lit(0.0))))),
        "bb_mid": mid, "bb_upper": mid + 2 * dev, "bb_lower": mid - 2 * dev, "bandwidth": 4 * dev / F.nullif(mid, F.lit(0.0)),
        "breakout": full(F.max, "high", 20, -1), "breakdown": full(F.min, "low", 20, -1),
        "high52": high52, "low52": low52, "high_ratio": close / F.nullif(high52, F.lit(0.0)), "low_ratio": close / F.nullif(low52, F.lit(0.0)),
        "since_high": F.when(high52.isNotNull(), F.col("n") - at_high),
        "new_highs60": F.when(F.col("n") >= YEAR, F.coalesce(F.sum("is_high").over(rows(-59)), F.lit(0))),
        "atr14": F.when(F.col("n") >= 15, F.avg("tr").over(last14)),
        "tenkan": half(9), "kijun": half(26), "span_b": half(52),
        "pivot_high": first_pivot & (F.coalesce(F.max("high").over(rows(-5, -1)) <= F.col("high"), F.lit(True))) & (F.coalesce(F.max("high").over(rows(1, 5)) < F.col("high"), F.lit(True))),
        "pivot_low": first_pivot & (F.coalesce(F.min("low").over(rows(-5, -1)) >= F.col("low"), F.lit(True))) & (F.coalesce(F.min("low").over(rows(1, 5)) > F.col("low"), F.lit(True))),
    })
    span_a = (F.col("tenkan") + F.col("kijun")) / 2
    return out.withColumns({
        "span_a": span_a, "volume_ratio": F.col("volume") / F.nullif(F.col("vol20"), F.lit(0.0)), "ma200_past": F.lag("ma200", 20).over(by_date()),
    }).withColumns({"cloud_a": F.lag("span_a", 26).over(by_date()), "cloud_b": F.lag("span_b", 26).over(by_date())})


def latest(panel_: DataFrame) -> DataFrame:
    """The last row of each ticker."""
    return panel_.where(F.col("n") == F.col("bars"))


def latest_of_days(panel_: DataFrame, days: list[str]) -> DataFrame:
    """The last row of each ticker up to each of some days, with as_of; bars counts the history up to there.

    It uses the panel's own partitioning, so that several days cost one panel. Columns that
    look ahead (pivots) know what came after a day.
    """
    till = F.lead("date").over(by_date())
    each = F.filter(F.array(*(F.lit(d).cast("date") for d in days)), lambda d: (F.col("date") <= d) & (F.col("__next").isNull() | (F.col("__next") > d)))
    found = panel_.withColumn("__next", till).withColumn("as_of", F.explode(each))
    return found.withColumn("bars", F.col("n").cast("long")).drop("__next")


def bandwidth_median(panel_: DataFrame, last: int = 60) -> DataFrame:
    """(ticker, bandwidth_median60): over the last finite bandwidths."""
    known = panel_.where("bandwidth is not null").withColumn("k", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date"))))
    return known.where(F.col("k") <= last).groupBy("ticker").agg(F.median("bandwidth").alias("bandwidth_median60"))


def ema(values: np.ndarray, n: int) -> np.ndarray:
    """Seeded with the mean of the first n values; missing values give none and carry the state."""
    out, seed, state, m = np.full(len(values), np.nan), [], None, 2 / (n + 1)
    for i, x in enumerate(values):
        if np.isnan(x):
            continue
        if state is None:
            seed.append(x)
            if len(seed) < n:
                continue
            state = sum(seed) / n
        else:
            state = x * m + state * (1 - m)
        out[i] = state
    return out


def wilder_rsi(values: np.ndarray, n: int = 14, last: int = 42) -> np.ndarray:
    """RSI of each bar with Wilder smoothing over its last closes; the step of one more close is taken for all bars at once."""
    out = np.full(len(values), np.nan)
    moves = np.diff(values)
    if len(moves) < n:
        return out

    def smoothed(x: np.ndarray) -> np.ndarray:
        """Of each bar from the n-th on; a missing close leaves the bars that reach back to it without a value."""
        early = [x[:n].mean()]  # bars with fewer closes than last
        for v in x[n : last - 2]:
            early.append((early[-1] * (n - 1) + v) / n)
        if len(x) < last - 1:
            return np.array(early)
        spans = np.lib.stride_tricks.sliding_window_view(x, last - 1)
        full_ = spans[:, :n].mean(axis=1)
        for k in range(n, last - 1):
            full_ = (full_ * (n - 1) + spans[:, k]) / n
        return np.concatenate([early, full_])

    gain, loss = smoothed(np.maximum(moves, 0)), smoothed(np.maximum(-moves, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        out[n:] = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
    return out


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(+DI, -DI, ADX). After a gap the smoothed sums begin again from the next value, and ADX stays missing."""
    size = len(close)
    plus_di, minus_di, dx, out = (np.full(size, np.nan) for _ in range(4))
    if size <= 2 * n:
        return plus_di, minus_di, out
    move = np.full((size, 3), np.nan)
    up, down = np.diff(high), -np.diff(low)
    ok = ~np.isnan(np.stack([high[1:], low[1:], close[:-1], high[:-1], low[:-1]])).any(axis=0)
    ranges = np.maximum(high[1:] - low[1:], np.maximum(abs(high[1:] - close[:-1]), abs(low[1:] - close[:-1])))
    move[1:][ok] = np.stack([ranges, np.where((up > down) & (up > 0), up, 0), np.where((down > up) & (down > 0), down, 0)], axis=1)[ok]
    if np.isnan(move[1 : n + 1]).any():
        return plus_di, minus_di, out
    state = move[1 : n + 1].sum(axis=0)
    for i in range(n, size):
        if i > n:
            if np.isnan(move[i]).any():
                state = np.zeros(3)
                continue
            state = state - state / n + move[i]
        if state[0] == 0:
            continue
        plus_di[i], minus_di[i] = 100 * state[1] / state[0], 100 * state[2] / state[0]
        both = plus_di[i] + minus_di[i]
        dx[i] = 0 if both == 0 else 100 * abs(plus_di[i] - minus_di[i]) / both
    if np.isnan(dx[n : 2 * n]).any():
        return plus_di, minus_di, out
    out[2 * n - 1] = dx[n : 2 * n].mean()
    for i in range(2 * n, size):
        out[i] = (out[i - 1] * (n - 1) + dx[i]) / n
    return plus_di, minus_di, out


def folds(bars: DataFrame) -> DataFrame:
    """(ticker, date, ema12, ema26, macd, signal, histogram, rsi_wilder, plus_di, minus_di, adx) of every bar.

    One grouped map; a group is the history of one ticker.
    """
    names = ["ema12", "ema26", "macd", "signal", "histogram", "rsi_wilder", "plus_di", "minus_di", "adx"]

    def one(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("date")
        h, low, c = (b[x].to_numpy(float) for x in ("high", "low", "close"))
        fast, slow = ema(c, 12), ema(c, 26)
        signal = ema(fast - slow, 9)
        values = [fast, slow, fast - slow, signal, fast - slow - signal, wilder_rsi(c), *adx(h, low, c)]
        return pd.DataFrame({"ticker": b["ticker"], "date": b["date"], **dict(zip(names, values, strict=True))})

    found = bars.select("ticker", "date", "high", "low", "close").groupBy("ticker").applyInPandas(one, "ticker string, date date, " + ", ".join(f"{n} double" for n in names))
    return found.select("ticker", "date", *(F.nanvl(n, F.lit(None)).alias(n) for n in names))


def percentile(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Positional percentile, 100 for the largest; ties by ticker; a single row has 100; null values none.

    The cross-section is one row per ticker of a day.
    """
    part = [*(by or []), F.col(value).isNull()]
    rank = F.row_number().over(W.partitionBy(*part).orderBy(F.desc(value), "ticker"))
    n = F.count("*").over(W.partitionBy(*part))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.when(n == 1, 100.0).otherwise((n - rank) / F.greatest(n - 1, F.lit(1)) * 100)))


def last_finite(df: DataFrame, value: str) -> Column:
    """The last value there is, up to each row."""
    return F.last(value, ignorenulls=True).over(rows(W.unboundedPreceding))
