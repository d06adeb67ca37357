"""Labels and scores of single bars, as projections over the indicator panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_DATA = "insufficient-data"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known(*xs) -> Column:
    return reduce(lambda a, b: a & b, (c(x).isNotNull() for x in xs))


def falling(*xs) -> Column:
    """Every value above the next."""
    return reduce(lambda a, b: a & b, (c(x) > c(y) for x, y in zip(xs, xs[1:], strict=False)))


def rising(*xs) -> Column:
    return falling(*reversed(xs))


def sign_of(a, b, up: str, down: str, even: str) -> Column:
    return F.when(known(a, b), F.when(c(a) > c(b), up).when(c(a) < c(b), down).otherwise(even)).otherwise(NO_DATA)


def ma_structure() -> Column:
    """Order of the close and its means; the longest mean counts only where there is one."""
    up200, down200 = F.coalesce(F.col("ma120") > F.col("ma200"), F.lit(True)), F.coalesce(F.col("ma120") < F.col("ma200"), F.lit(True))
    return (
        F.when(~known("close", "ma5", "ma20", "ma60", "ma120"), NO_DATA)
        .when(falling("close", "ma5", "ma20", "ma60", "ma120") & up200, "strong-bullish")
        .when(rising("close", "ma5", "ma20", "ma60", "ma120") & down200, "strong-bearish")
        .when(falling("close", "ma20", "ma60", "ma120") & up200, "bullish")
        .when(rising("close", "ma20", "ma60", "ma120") & down200, "bearish")
        .when((F.col("close") > F.col("ma20")) & (F.col("close") < F.col("ma60")), "rebound-inside-downtrend")
        .when((F.col("close") < F.col("ma20")) & (F.col("close") > F.col("ma60")), "pullback-inside-uptrend")
        .otherwise("mixed")
    )


def bollinger_state() -> Column:
    width = F.col("bb_upper") - F.col("bb_lower")
    at = F.when(width == 0, 0.5).otherwise((F.col("close") - F.col("bb_lower")) / F.nullif(width, F.lit(0.0)))
    return (
        F.when(~known("close", "bb_upper", "bb_mid", "bb_lower"), NO_DATA)
        .when(F.col("close") > F.col("bb_upper"), "above-upper-band")
        .when(F.col("close") < F.col("bb_lower"), "below-lower-band")
        .when(at >= 0.65, "upper-half").when(at <= 0.35, "lower-half").otherwise("mid-band")
    )


def bandwidth_regime() -> Column:
    median = F.col("bandwidth_median60")
    return F.when(~known("bandwidth", median), NO_DATA).when(F.col("bandwidth") >= median * 1.25, "expanding").when(F.col("bandwidth") <= median * 0.8, "contracting").otherwise("normal")


def bands(x, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first cut that x reaches."""
    out = F.when(c(x).isNull(), NO_DATA)
    for cut, label in cuts:
        out = out.when(c(x) >= cut, label)
    return out.otherwise(rest)


def rsi_state(x="rsi14") -> Column:
    return F.when(c(x).isNull(), NO_DATA).when(c(x) >= 70, "overbought").when(c(x) <= 30, "oversold").otherwise("neutral")


def volume_regime() -> Column:
    x = F.col("volume_ratio")
    return F.when(x.isNull(), NO_DATA).when(x >= 1.5, "heavy").when(x <= 0.7, "light").otherwise("normal")


def macd_states() -> dict[str, Column]:
    """Needs macd, signal, histogram and their values of the bar before (prev_*)."""
    m, s, pm, ps = (F.col(x) for x in ("macd", "signal", "prev_macd", "prev_signal"))
    cross = (
        F.when(~known(m, s, pm, ps), NO_DATA)
        .when((m >= s) & (pm < ps), "bullish-cross").when((m <= s) & (pm > ps), "bearish-cross")
        .when(m > s, "bullish").when(m < s, "bearish").otherwise("flat")
    )
    now, before = F.abs("histogram"), F.abs("prev_histogram")
    return {
        "macd_cross": cross,
        "macd_zero": sign_of("macd", F.lit(0.0), "above-zero", "below-zero", "at-zero"),
        "macd_histogram": F.when(~known(now, before), NO_DATA).when(now > before * 1.03, "expanding").when(now < before * 0.97, "contracting").otherwise("stable"),
    }


def adx_states() -> dict[str, Column]:
    x, before = F.col("adx"), F.col("prev_adx")
    return {
        "adx_direction": sign_of("plus_di", "minus_di", "bullish", "bearish", "flat"),
        "adx_strength": bands("adx", [(25, "strong-trend"), (20, "building-trend")], "weak-trend"),
        "adx_slope": F.when(~known(x, before), NO_DATA).when(x > before + 0.5, "rising").when(x < before - 0.5, "falling").otherwise("flat"),
    }


def ichimoku_states() -> dict[str, Column]:
    top, bottom = F.greatest("cloud_a", "cloud_b"), F.least("cloud_a", "cloud_b")
    return {
        "cloud_position": F.when(~known("close", "cloud_a", "cloud_b"), NO_DATA).when(F.col("close") > top, "above-cloud").when(F.col("close") < bottom, "below-cloud").otherwise("inside-cloud"),
        "tk_cross": sign_of("tenkan", "kijun", "bullish", "bearish", "flat"),
        "cloud_bias": sign_of("span_a", "span_b", "bullish", "bearish", "flat"),
    }


#: Fixed values: (column, value, bullish points, bearish points) of the chart-flow vote.
FLOW_POINTS = [
    ("ma_structure", "strong-bullish", 3, 0), ("ma_structure", "bullish", 2, 0), ("ma_structure", "strong-bearish", 0, 3), ("ma_structure", "bearish", 0, 2),
    ("ma_structure", "rebound-inside-downtrend", 1, 2), ("ma_structure", "pullback-inside-uptrend", 2, 1),
    ("cloud_position", "above-cloud", 2, 0), ("cloud_position", "below-cloud", 0, 2),
    ("tk_cross", "bullish", 1, 0), ("tk_cross", "bearish", 0, 1), ("cloud_bias", "bullish", 1, 0), ("cloud_bias", "bearish", 0, 1),
    ("bollinger_state", "above-upper-band", 1, 0), ("bollinger_state", "upper-half", 1, 0), ("bollinger_state", "below-lower-band", 0, 1), ("bollinger_state", "lower-half", 0, 1),
    ("macd_cross", "bullish-cross", 1, 0), ("macd_cross", "bearish-cross", 0, 1),
]


def chart_flow() -> dict[str, Column]:
    """Bullish and bearish points of nine signals and the label. A missing number counts as zero here."""
    rsi, volume, ma20, ma120 = (F.coalesce(x, F.lit(0.0)) for x in ("rsi14", "volume_ratio", "ma20", "ma120"))
    trend = F.col("adx_strength").isin("strong-trend", "building-trend")
    votes = [(F.col(k) == v, a, b) for k, v, a, b in FLOW_POINTS]
    votes += [
        (rsi >= 60, 1, 0), (rsi <= 40, 0, 1),
        ((F.col("macd_cross") == "bullish") & (F.col("macd_zero") == "above-zero"), 1, 0), ((F.col("macd_cross") == "bearish") & (F.col("macd_zero") == "below-zero"), 0, 1),
        ((volume >= 1.2) & (F.col("close") >= ma20), 1, 0), ((volume >= 1.2) & (F.col("close") < ma20), 0, 1),
        (trend & (F.col("adx_direction") == "bullish"), 1, 0), (trend & (F.col("adx_direction") == "bearish"), 0, 1),
    ]
    bull, bear = (reduce(lambda x, y: x + y, (F.when(v[0], v[k]).otherwise(0) for v in votes if v[k])) for k in (1, 2))
    label = (
        F.when(bear >= bull + 3, "bearish continuation").when(bull >= bear + 3, "bullish continuation")
        .when((bull > bear) & (F.col("close") < ma120), "technical rebound inside broader downtrend")
        .when((bear > bull) & (F.col("close") > ma120), "pullback inside broader uptrend")
        .otherwise("range-bound or base-building")
    )
    return {"bull_points": bull, "bear_points": bear, "chart_flow": label}


def points(x, cuts: list[tuple[float, int]]) -> Column:
    """Points of the first cut that x reaches, else 0; null for a missing x."""
    out = F.when(c(x).isNull(), F.lit(None).cast("int"))
    for cut, value in cuts:
        out = out.when(c(x) >= cut, value)
    return out.otherwise(0)


def counts(rules: list[Column]) -> tuple[Column, Column, Column]:
    """(true, false, unknown) of three-valued rules."""
    total = lambda f: reduce(lambda a, b: a + b, (F.when(f(r), 1).otherwise(0) for r in rules))
    return total(lambda r: r), total(lambda r: ~r), total(lambda r: r.isNull())


def trend_template() -> dict[str, Column]:
    """Seven rules; any unknown makes the template incomplete."""
    close, m50, m150, m200 = (F.col(x) for x in ("close", "ma50", "ma150", "ma200"))
    both = lambda need, rule: F.when(known(*need), rule)
    rules = [
        both((close, m50, m150, m200), (close > m50) & (close > m150) & (close > m200)),
        both((m150, m200), m150 > m200),
        both((m50, m150, m200), (m50 > m150) & (m50 > m200)),
        both((m200, "ma200_past"), m200 > F.col("ma200_past")),
        F.col("low_ratio") >= 1.3,
        F.col("high_ratio") >= 0.75,
        F.col("rs_percentile") >= 70,
    ]
    yes, no, unknown = counts(rules)
    status = F.when(unknown > 0, "incomplete").when(no == 0, "pass").otherwise("fail")
    return {"template_passed": yes, "template_failed": no, "template_unknown": unknown, "template": status}


def leadership_score() -> dict[str, Column]:
    """Five components of 25, 25, 15, 20 and 15 points; a grade only if all are known."""
    aligned = falling("close", "ma50", "ma150", "ma200")
    volume = F.when(F.coalesce(F.col("volume_ratio") >= 1.2, F.lit(False)), 5).otherwise(0)
    trend = F.when(known("close", "ma50", "ma150", "ma200"), F.when(aligned, 10).otherwise(0) + volume).when(F.col("volume_ratio").isNotNull(), volume)
    parts = [
        (25, points("high_ratio", [(0.95, 25), (0.9, 18), (0.85, 10), (0.75, 5)])),
        (25, points(-F.col("since_high"), [(-20, 25), (-60, 18), (-120, 10), (-252, 5)])),
        (15, points("new_highs60", [(3, 15), (2, 10), (1, 5)])),
        (20, points("rs_percentile", [(90, 20), (80, 15), (70, 10), (60, 5)])),
        (15, trend),
    ]
    got = reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0)) for _, p in parts))
    most = reduce(lambda a, b: a + b, (F.when(p.isNull(), 0).otherwise(n) for n, p in parts))
    whole = reduce(lambda a, b: a & b, (p.isNotNull() for _, p in parts))
    grade = F.when(whole, F.when(got >= 85, "A").when(got >= 70, "B").when(got >= 55, "C").otherwise("D"))
    return {"points": got, "max_points": most, "leadership_status": F.when(whole, "complete").otherwise("partial"), "grade": grade}


def simple_trend() -> Column:
    """Close against its 20- and 50-bar means; without the longer mean, against the shorter."""
    close, m20, m50 = F.col("close"), F.col("ma20"), F.col("ma50")
    up = F.when(m50.isNull(), close > m20).otherwise((close > m20) & (m20 > m50))
    down = F.when(m50.isNull(), close < m20).otherwise((close < m20) & (m20 < m50))
    return F.when(m20.isNull(), NO_DATA).when(up, "bullish").when(down, "bearish").otherwise("mixed")


def position_status() -> Column:
    """Flags of a held position, or insufficient-data with fewer than 15 bars."""
    off = F.col("close") / F.nullif(F.col("ma20"), F.lit(0.0)) - 1
    flags = F.concat_ws(
        ",", F.when(F.col("rsi_wilder") > 70, "overbought"), F.when(F.col("rsi_wilder") < 30, "oversold"), F.when(off > 0.05, "extended"), F.when(off < -0.05, "below-trend")
    )
    return F.when(F.col("bars") < 15, NO_DATA).when(flags == "", "normal").otherwise(flags)


def support_levels() -> dict[str, Column]:
    """The nearest level below the close, and the two nearest above it."""
    levels = lambda names, rule: F.filter(F.array_compact(F.array(*names)), rule)
    above = F.array_sort(levels(["tenkan", "ma20", "kijun", "breakout", "cloud_a", "cloud_b"], lambda x: x > F.col("close")))
    below = levels(["breakdown", "bb_lower", "ma120", "cloud_a", "cloud_b"], lambda x: x < F.col("close"))
    return {"support": F.array_max(below), "recovery1": F.get(above, F.lit(0)), "recovery2": F.get(above, F.lit(1))}
