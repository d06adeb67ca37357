"""Indicator, rule and screen queries over bars made of lineitem and part.

A ticker is a brand; its bar of a day is the open, high, low and close of extended price by
quantity, and the sum of quantities. A market is the last digit of the brand.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import rules, screen, series, structure
from tidemark.plans.registry import out, query, table
from tidemark.sources.shared import written

AS_OF, PRIOR = "2001-10-31", "2001-09-28"


def bars(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return series.bars_from_trades(lines.select(
        F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"),
    ))


def panel(spark, sf_dir, date: str | None = None) -> DataFrame:
    b = bars(spark, sf_dir)
    return series.panel(series.as_of(b, date) if date else b)


BARS_SQL = """
trades AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey AS a, l_linenumber AS b, l_extendedprice / l_quantity AS price, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (SELECT ticker, date, first(price ORDER BY a, b, price) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY a, b, price) AS close, sum(q) AS volume FROM trades GROUP BY 1, 2)"""


def over(first: int, last: int = 0) -> str:
    side = lambda k: f"{-k} PRECEDING" if k <= 0 else f"{k} FOLLOWING"
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {side(first)} AND {side(last)})"


def full(fn: str, x: str, n: int, last: int = 0) -> str:
    w = over(last - n + 1, last)
    return f"CASE WHEN count({x}) {w} = {n} THEN {fn}({x}) {w} END"


D = "OVER (PARTITION BY ticker ORDER BY date)"


@cache
def panel_sql(date: str | None = None, name: str = "panel") -> str:
    """CTEs up to `name`, each name with its own suffix; bars must come before."""
    half = lambda n: f"({full('max', 'high', n)} + {full('min', 'low', n)}) / 2"
    columns = [f"{full('avg', 'close', n)} AS ma{n}" for n in series.MEANS] + [
        f"{full('avg', 'volume', 20)} AS vol20",
        *(f"close / nullif(lag(close, {n}) {D}, 0) - 1 AS return{n}" for n in series.RETURNS),
        f"CASE WHEN count(change) {over(-13)} = 14 THEN CASE WHEN sum(loss) {over(-13)} = 0 THEN 100.0 ELSE 100 - 100 / (1 + sum(gain) {over(-13)} / nullif(sum(loss) {over(-13)}, 0)) END END AS rsi14",
        f"{full('avg', 'close', 20)} AS bb_mid", f"{full('stddev_pop', 'close', 20)} AS dev",
        f"{full('max', 'high', 20, -1)} AS breakout", f"{full('min', 'low', 20, -1)} AS breakdown",
        f"{full('max', 'close', 252)} AS high52", f"{full('min', 'close', 252)} AS low52", f"max((close, n)) {over(-251)} AS at_high",
        f"CASE WHEN n >= 252 THEN coalesce(sum(is_high) {over(-59)}, 0) END AS new_highs60", f"CASE WHEN n >= 15 THEN avg(tr) {over(-13)} END AS atr14",
        f"{half(9)} AS tenkan", f"{half(26)} AS kijun", f"{half(52)} AS span_b",
        f"n > 5 AND n <= bars - 5 AND coalesce(max(high) {over(-5, -1)} <= high, true) AND coalesce(max(high) {over(1, 5)} < high, true) AS pivot_high",
        f"n > 5 AND n <= bars - 5 AND coalesce(min(low) {over(-5, -1)} >= low, true) AND coalesce(min(low) {over(1, 5)} > low, true) AS pivot_low",
    ]
    cut = f" WHERE date <= DATE '{date}'" if date else ""
    k = name
    return f"""{k}0 AS (SELECT *, row_number() {D} AS n, count(*) OVER (PARTITION BY ticker) AS bars, close - lag(close) {D} AS change,
  CASE WHEN lag(close) {D} IS NOT NULL THEN greatest(high - low, abs(high - lag(close) {D}), abs(low - lag(close) {D})) END AS tr,
  CASE WHEN count(close) {over(-251, -1)} = 251 THEN CAST(close > max(close) {over(-251, -1)} AS INT) END AS is_high FROM bars{cut}),
{k}1 AS (SELECT *, CASE WHEN change >= 0 THEN change ELSE 0 END AS gain, CASE WHEN change < 0 THEN -change ELSE 0 END AS loss FROM {k}0),
{k}2 AS (SELECT *, {', '.join(columns)} FROM {k}1),
{k}3 AS (SELECT *, bb_mid + 2 * dev AS bb_upper, bb_mid - 2 * dev AS bb_lower, 4 * dev / nullif(bb_mid, 0) AS bandwidth, close / nullif(high52, 0) AS high_ratio, close / nullif(low52, 0) AS low_ratio,
  CASE WHEN high52 IS NOT NULL THEN n - at_high[2] END AS since_high, (tenkan + kijun) / 2 AS span_a, volume / nullif(vol20, 0) AS volume_ratio, lag(ma200, 20) {D} AS ma200_past FROM {k}2),
{k} AS (SELECT *, lag(span_a, 26) {D} AS cloud_a, lag(span_b, 26) {D} AS cloud_b FROM {k}3)"""


#: Query name to (double columns, other columns) of the panel, for every bar.
PANEL_QUERIES = {
    "sma": [f"ma{n}" for n in series.MEANS] + ["vol20"],
    "rsi_simple": ["rsi14"], "bollinger": ["bb_mid", "bb_upper", "bb_lower", "bandwidth"], "ichimoku": ["tenkan", "kijun", "span_a", "span_b", "cloud_a", "cloud_b"],
    "returns_n": [f"return{n}" for n in series.RETURNS], "volume_ratio": ["volume_ratio"], "breakout_levels": ["breakout", "breakdown"],
    "stats_52w": ["high52", "low52", "high_ratio", "low_ratio", "since_high"], "new_high_count60": ["new_highs60"], "ma200_slope": ["ma200", "ma200_past"],
    "atr14_mean": ["atr14"], "day_change": ["change", "return1"],
}
WHOLE = {"since_high", "new_highs60"}

for _name, _cols in PANEL_QUERIES.items():
    _sql = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in WHOLE else f"round({c}, 6) AS {c}" for c in _cols)

    @query(_name, f"WITH {BARS_SQL}, {panel_sql()} SELECT ticker, date, {_sql} FROM panel")
    def _panel_query(spark, sf_dir, cols=tuple(_cols)):
        return out(panel(spark, sf_dir), "ticker", "date", *cols)


@query("bar_quality", f"WITH {BARS_SQL} SELECT ticker, count(*) AS n, max(date) AS latest FROM bars GROUP BY 1 HAVING count(*) >= 1400 AND count(close) = count(*) AND count(volume) = count(*)")
def bar_quality(spark, sf_dir):
    return series.quality(bars(spark, sf_dir), min_bars=1400, need_volume=True).groupBy("ticker").agg(F.count("*").alias("n"), F.max("date").alias("latest"))


@query("as_of_cut", f"WITH {BARS_SQL} SELECT ticker, count(*) AS n, max(date) AS latest FROM bars WHERE date <= DATE '{PRIOR}' GROUP BY 1")
def as_of_cut(spark, sf_dir):
    return series.as_of(bars(spark, sf_dir), PRIOR).groupBy("ticker").agg(F.count("*").alias("n"), F.max("date").alias("latest"))


@query("swing_pivots", f"WITH {BARS_SQL}, {panel_sql()} SELECT ticker, date, pivot_high, pivot_low FROM panel WHERE pivot_high OR pivot_low")
def swing_pivots(spark, sf_dir):
    return panel(spark, sf_dir).where("pivot_high or pivot_low").select("ticker", "date", "pivot_high", "pivot_low")


MEDIAN_SQL = "med AS (SELECT ticker, median(bandwidth) AS bandwidth_median60 FROM (SELECT ticker, bandwidth, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM panel WHERE bandwidth IS NOT NULL) WHERE k <= 60 GROUP BY 1)"


@query("bandwidth_median60", f"WITH {BARS_SQL}, {panel_sql()}, {MEDIAN_SQL} SELECT ticker, round(bandwidth_median60, 6) AS bandwidth_median60 FROM med")
def bandwidth_median60(spark, sf_dir):
    return out(series.bandwidth_median(panel(spark, sf_dir)))


@query("last_finite", f"WITH {BARS_SQL}, {panel_sql()} SELECT ticker, date, round(last_value(rsi14 IGNORE NULLS) {D}, 6) AS rsi14 FROM panel")
def last_finite(spark, sf_dir):
    p = panel(spark, sf_dir)
    return out(p.select("ticker", "date", series.last_finite(p, "rsi14").alias("rsi14")))


def ema_sql(name: str, source: str, x: str, n: int) -> str:
    """Recursive CTE (ticker, k, v) over source (ticker, k from 1 without gaps, x)."""
    m = 2 / (n + 1)
    return f"""{name} AS (SELECT ticker, {n}::BIGINT AS k, avg({x}) AS v FROM {source} WHERE k <= {n} GROUP BY 1 HAVING count(*) = {n}
  UNION ALL SELECT s.ticker, s.k, s.{x} * {m!r} + e.v * {1 - m!r} FROM {name} e JOIN {source} s ON s.ticker = e.ticker AND s.k = e.k + 1)"""


FOLD_SQL = f"""WITH RECURSIVE {BARS_SQL}, s AS MATERIALIZED (SELECT ticker, date, high, low, close, row_number() {D} AS k, lag(high) {D} AS ph, lag(low) {D} AS pl, lag(close) {D} AS pc FROM bars),
{ema_sql('e12', 's', 'close', 12)}, {ema_sql('e26', 's', 'close', 26)}, m AS MATERIALIZED (SELECT ticker, k - 25 AS k, e12.v - e26.v AS macd FROM e12 JOIN e26 USING (ticker, k)), {ema_sql('sig', 'm', 'macd', 9)},
mv AS MATERIALIZED (SELECT *, CASE WHEN k > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dn, count(*) OVER (PARTITION BY ticker) AS bars FROM s),
sm AS (SELECT ticker, 15::BIGINT AS k, sum(tr) AS tr, sum(up) AS up, sum(dn) AS dn FROM mv WHERE k BETWEEN 2 AND 15 AND bars > 28 GROUP BY 1
  UNION ALL SELECT mv.ticker, mv.k, sm.tr - sm.tr / 14 + mv.tr, sm.up - sm.up / 14 + mv.up, sm.dn - sm.dn / 14 + mv.dn FROM sm JOIN mv ON mv.ticker = sm.ticker AND mv.k = sm.k + 1),
di AS MATERIALIZED (SELECT ticker, k, 100 * up / tr AS p, 100 * dn / tr AS q, CASE WHEN up + dn = 0 THEN 0 ELSE 100 * abs(up - dn) / (up + dn) END AS dx FROM sm WHERE tr <> 0),
ad AS (SELECT ticker, 28::BIGINT AS k, avg(dx) AS v FROM di WHERE k BETWEEN 15 AND 28 GROUP BY 1 UNION ALL SELECT di.ticker, di.k, (ad.v * 13 + di.dx) / 14 FROM ad JOIN di ON di.ticker = ad.ticker AND di.k = ad.k + 1),
folds AS MATERIALIZED (SELECT s.ticker, s.date, e12.v AS ema12, e26.v AS ema26, m.macd, sig.v AS signal, m.macd - sig.v AS histogram, di.p AS plus_di, di.q AS minus_di, ad.v AS adx
  FROM s LEFT JOIN e12 USING (ticker, k) LEFT JOIN e26 USING (ticker, k) LEFT JOIN m ON m.ticker = s.ticker AND m.k = s.k - 25 LEFT JOIN sig ON sig.ticker = s.ticker AND sig.k = s.k - 25 LEFT JOIN di ON di.ticker = s.ticker AND di.k = s.k LEFT JOIN ad ON ad.ticker = s.ticker AND ad.k = s.k)"""

for _name, _cols in {"ema": ["ema12", "ema26"], "macd": ["macd", "signal", "histogram"], "adx_dmi": ["plus_di", "minus_di", "adx"]}.items():

    @query(_name, f"{FOLD_SQL} SELECT ticker, date, {', '.join(f'round({c}, 6) AS {c}' for c in _cols)} FROM folds")
    def _fold_query(spark, sf_dir, cols=tuple(_cols)):
        return out(series.folds(bars(spark, sf_dir)), "ticker", "date", *cols)


@query("rsi_wilder", f"""WITH RECURSIVE {BARS_SQL}, s AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars),
x AS MATERIALIZED (SELECT ticker, date, close - lag(close) {D} AS d, row_number() {D} - 1 AS k FROM s WHERE r <= 42),
w AS (SELECT ticker, 14::BIGINT AS k, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM x WHERE k BETWEEN 1 AND 14 GROUP BY 1
  UNION ALL SELECT x.ticker, x.k, (w.g * 13 + greatest(x.d, 0)) / 14, (w.l * 13 + greatest(-x.d, 0)) / 14 FROM w JOIN x ON x.ticker = w.ticker AND x.k = w.k + 1)
SELECT w.ticker, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END + 1e-8, 6) AS rsi_wilder FROM w JOIN (SELECT ticker, max(k) AS k FROM w GROUP BY 1) USING (ticker, k)""")
def rsi_wilder(spark, sf_dir):
    f = series.folds(bars(spark, sf_dir))
    return out(f.groupBy("ticker").agg(F.max_by("rsi_wilder", "date").alias("rsi_wilder")))


# Labels of the last bar of each ticker

READ_SQL = f"""{FOLD_SQL}, {panel_sql()}, {MEDIAN_SQL},
pf AS (SELECT *, lag(macd) {D} AS prev_macd, lag(signal) {D} AS prev_signal, lag(histogram) {D} AS prev_histogram, lag(adx) {D} AS prev_adx FROM folds),
rd AS (SELECT panel.*, pf.* EXCLUDE (ticker, date), med.bandwidth_median60 FROM panel JOIN pf USING (ticker, date) LEFT JOIN med USING (ticker) WHERE n = bars),
st AS (SELECT *, CASE WHEN close IS NULL OR ma5 IS NULL OR ma20 IS NULL OR ma60 IS NULL OR ma120 IS NULL THEN 'insufficient-data'
  WHEN close > ma5 AND ma5 > ma20 AND ma20 > ma60 AND ma60 > ma120 AND coalesce(ma120 > ma200, true) THEN 'strong-bullish'
  WHEN close < ma5 AND ma5 < ma20 AND ma20 < ma60 AND ma60 < ma120 AND coalesce(ma120 < ma200, true) THEN 'strong-bearish'
  WHEN close > ma20 AND ma20 > ma60 AND ma60 > ma120 AND coalesce(ma120 > ma200, true) THEN 'bullish'
  WHEN close < ma20 AND ma20 < ma60 AND ma60 < ma120 AND coalesce(ma120 < ma200, true) THEN 'bearish'
  WHEN close > ma20 AND close < ma60 THEN 'rebound-inside-downtrend' WHEN close < ma20 AND close > ma60 THEN 'pullback-inside-uptrend' ELSE 'mixed' END AS ma_structure,
  CASE WHEN bb_upper IS NULL THEN 'insufficient-data' WHEN close > bb_upper THEN 'above-upper-band' WHEN close < bb_lower THEN 'below-lower-band'
  WHEN (close - bb_lower) / nullif(bb_upper - bb_lower, 0) >= 0.65 THEN 'upper-half' WHEN (close - bb_lower) / nullif(bb_upper - bb_lower, 0) <= 0.35 THEN 'lower-half' ELSE 'mid-band' END AS bollinger_state,
  CASE WHEN bandwidth IS NULL OR bandwidth_median60 IS NULL THEN 'insufficient-data' WHEN bandwidth >= bandwidth_median60 * 1.25 THEN 'expanding' WHEN bandwidth <= bandwidth_median60 * 0.8 THEN 'contracting' ELSE 'normal' END AS bandwidth_regime,
  CASE WHEN rsi14 IS NULL THEN 'insufficient-data' WHEN rsi14 >= 70 THEN 'overbought' WHEN rsi14 <= 30 THEN 'oversold' ELSE 'neutral' END AS rsi_state,
  CASE WHEN volume_ratio IS NULL THEN 'insufficient-data' WHEN volume_ratio >= 1.5 THEN 'heavy' WHEN volume_ratio <= 0.7 THEN 'light' ELSE 'normal' END AS volume_regime,
  CASE WHEN macd IS NULL OR signal IS NULL OR prev_macd IS NULL OR prev_signal IS NULL THEN 'insufficient-data' WHEN macd >= signal AND prev_macd < prev_signal THEN 'bullish-cross' WHEN macd <= signal AND prev_macd > prev_signal THEN 'bearish-cross' WHEN macd > signal THEN 'bullish' WHEN macd < signal THEN 'bearish' ELSE 'flat' END AS macd_cross,
  CASE WHEN macd IS NULL THEN 'insufficient-data' WHEN macd > 0 THEN 'above-zero' WHEN macd < 0 THEN 'below-zero' ELSE 'at-zero' END AS macd_zero,
  CASE WHEN histogram IS NULL OR prev_histogram IS NULL THEN 'insufficient-data' WHEN abs(histogram) > abs(prev_histogram) * 1.03 THEN 'expanding' WHEN abs(histogram) < abs(prev_histogram) * 0.97 THEN 'contracting' ELSE 'stable' END AS macd_histogram,
  CASE WHEN plus_di IS NULL OR minus_di IS NULL THEN 'insufficient-data' WHEN plus_di > minus_di THEN 'bullish' WHEN plus_di < minus_di THEN 'bearish' ELSE 'flat' END AS adx_direction,
  CASE WHEN adx IS NULL THEN 'insufficient-data' WHEN adx >= 25 THEN 'strong-trend' WHEN adx >= 20 THEN 'building-trend' ELSE 'weak-trend' END AS adx_strength,
  CASE WHEN adx IS NULL OR prev_adx IS NULL THEN 'insufficient-data' WHEN adx > prev_adx + 0.5 THEN 'rising' WHEN adx < prev_adx - 0.5 THEN 'falling' ELSE 'flat' END AS adx_slope,
  CASE WHEN cloud_a IS NULL OR cloud_b IS NULL THEN 'insufficient-data' WHEN close > greatest(cloud_a, cloud_b) THEN 'above-cloud' WHEN close < least(cloud_a, cloud_b) THEN 'below-cloud' ELSE 'inside-cloud' END AS cloud_position,
  CASE WHEN tenkan IS NULL OR kijun IS NULL THEN 'insufficient-data' WHEN tenkan > kijun THEN 'bullish' WHEN tenkan < kijun THEN 'bearish' ELSE 'flat' END AS tk_cross,
  CASE WHEN span_a IS NULL OR span_b IS NULL THEN 'insufficient-data' WHEN span_a > span_b THEN 'bullish' WHEN span_a < span_b THEN 'bearish' ELSE 'flat' END AS cloud_bias,
  CASE WHEN ma20 IS NULL THEN 'insufficient-data' WHEN (ma50 IS NULL AND close > ma20) OR (close > ma20 AND ma20 > ma50) THEN 'bullish' WHEN (ma50 IS NULL AND close < ma20) OR (close < ma20 AND ma20 < ma50) THEN 'bearish' ELSE 'mixed' END AS us_trend,
  list_max(list_filter([breakdown, bb_lower, ma120, cloud_a, cloud_b], lambda x: x < close)) AS support, list_sort(list_filter([tenkan, ma20, kijun, breakout, cloud_a, cloud_b], lambda x: x > close)) AS above
  FROM rd)"""


def read(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir)
    p = series.panel(b)
    f = series.folds(b)
    lagged = f.withColumns({f"prev_{c}": F.lag(c).over(series.by_date()) for c in ("macd", "signal", "histogram", "adx")})
    df = series.latest(p).join(lagged, ["ticker", "date"]).join(series.bandwidth_median(p), "ticker", "left")
    return df.withColumns({
        "ma_structure": rules.ma_structure(), "bollinger_state": rules.bollinger_state(), "bandwidth_regime": rules.bandwidth_regime(), "rsi_state": rules.rsi_state(),
        "volume_regime": rules.volume_regime(), **rules.macd_states(), **rules.adx_states(), **rules.ichimoku_states(), "us_trend": rules.simple_trend(), **rules.support_levels(),
    })


for _name, _cols in {
    "ma_structure": ["ma_structure"], "bollinger_state": ["bollinger_state", "bandwidth_regime"], "rsi_volume_state": ["rsi_state", "volume_regime"], "macd_state": ["macd_cross", "macd_zero", "macd_histogram"],
    "adx_state": ["adx_direction", "adx_strength", "adx_slope"], "ichimoku_state": ["cloud_position", "tk_cross", "cloud_bias"], "us_trend": ["us_trend"],
}.items():

    @query(_name, f"{READ_SQL} SELECT ticker, {', '.join(_cols)} FROM st")
    def _state_query(spark, sf_dir, cols=tuple(_cols)):
        return read(spark, sf_dir).select("ticker", *cols)


@query("support_levels", f"{READ_SQL} SELECT ticker, round(support, 6) AS support, round(above[1], 6) AS recovery1, round(above[2], 6) AS recovery2 FROM st")
def support_levels(spark, sf_dir):
    return out(read(spark, sf_dir), "ticker", "support", "recovery1", "recovery2")


def _flow_sql() -> str:
    side = lambda k: " + ".join(f"CASE WHEN {v[0]} = '{v[1]}' THEN {v[k]} ELSE 0 END" for v in rules.FLOW_POINTS if v[k])
    extra = lambda rsi, way, zero, side_: f" + CASE WHEN coalesce(rsi14, 0) {rsi} THEN 1 ELSE 0 END + CASE WHEN macd_cross = '{way}' AND macd_zero = '{zero}' THEN 1 ELSE 0 END + CASE WHEN coalesce(volume_ratio, 0) >= 1.2 AND close {side_} coalesce(ma20, 0) THEN 1 ELSE 0 END + CASE WHEN adx_strength IN ('strong-trend', 'building-trend') AND adx_direction = '{way}' THEN 1 ELSE 0 END"
    return f"""{READ_SQL}, v AS (SELECT ticker, close, coalesce(ma120, 0) AS m, {side(2)}{extra('>= 60', 'bullish', 'above-zero', '>=')} AS bull, {side(3)}{extra('<= 40', 'bearish', 'below-zero', '<')} AS bear FROM st)
SELECT ticker, CAST(bull AS BIGINT) AS bull_points, CAST(bear AS BIGINT) AS bear_points, CASE WHEN bear >= bull + 3 THEN 'bearish continuation' WHEN bull >= bear + 3 THEN 'bullish continuation' WHEN bull > bear AND close < m THEN 'technical rebound inside broader downtrend' WHEN bear > bull AND close > m THEN 'pullback inside broader uptrend' ELSE 'range-bound or base-building' END AS chart_flow FROM v"""


@query("chart_flow", _flow_sql())
def chart_flow(spark, sf_dir):
    return out(read(spark, sf_dir).withColumns(rules.chart_flow()), "ticker", "bull_points", "bear_points", "chart_flow")


# The universe: one row per ticker as of a day


def universe(spark, sf_dir, *dates: str) -> DataFrame:
    """One row per ticker and day (as_of), of one panel for all days."""
    dates = dates or (AS_OF,)
    df = series.latest_of_days(panel(spark, sf_dir, max(dates)), list(dates)).withColumns({"market": F.right("ticker", F.lit(1)), "rs_raw": screen.rs_raw()})
    df = series.percentile(df, "rs_raw", "rs_percentile", ["as_of"])
    notes = F.array_compact(F.array(F.when(F.col("bars") < series.YEAR, "short history"), F.when(F.col("date") < F.date_sub("as_of", 7), "latest day missing")))
    return df.withColumn("data_quality", notes)


def backdrop(entries: DataFrame) -> DataFrame:
    return entries.groupBy("market").agg(*(F.avg(f"return{n}").alias(f"return{n}") for n in (7, 30, 60)))


def universe_sql(date: str = AS_OF, k: str = "u") -> str:
    pct = lambda x: f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN count(*) OVER (PARTITION BY {x} IS NULL) = 1 THEN 100.0 ELSE (count(*) OVER (PARTITION BY {x} IS NULL) - row_number() OVER (PARTITION BY {x} IS NULL ORDER BY {x} DESC, ticker)) / greatest(count(*) OVER (PARTITION BY {x} IS NULL) - 1, 1) * 100 END END"
    clamp = lambda x: f"CASE WHEN {x} IS NOT NULL THEN greatest(0.0, least(100.0, {x})) END"
    lm = lambda *xs: f"list_avg([{', '.join(f'CAST({x} AS DOUBLE)' for x in xs)}])"
    any_extreme = " OR ".join(f"coalesce(return{n} >= 5 OR return{n} <= -0.8, false)" for n in screen.SCREEN_RETURNS)
    zeros = " + ".join(f"CASE WHEN return{n} = 0 THEN 1 ELSE 0 END" for n in screen.SCREEN_RETURNS)
    checks = ["return120 > 0", "return252 > 0", "rs_percentile >= 70", "high_ratio >= 0.75", "low_ratio >= 1.3", "volume_ratio >= 0.8"]
    return f"""{panel_sql(date, 'p' + k)}, {k}1 AS (SELECT *, right(ticker, 1) AS market, 0.4 * return63 + 0.3 * return126 + 0.3 * return252 AS rs_raw, bars < 252 AS short, date < DATE '{date}' - 7 AS stale FROM p{k} WHERE n = bars),
{k}2 AS (SELECT *, {pct('rs_raw')} AS rs_percentile, {', '.join(f"{pct(f'return{n}')} AS pct{n}" for n in screen.SCREEN_RETURNS)} FROM {k}1),
{k}b AS (SELECT market, avg(return7) AS m7, avg(return30) AS m30, avg(return60) AS m60 FROM {k}1 GROUP BY 1),
{k}3 AS (SELECT {k}2.*, return7 - m7 AS relative7, return30 - m30 AS relative30, return60 - m60 AS relative60, {' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for c in checks)} AS style_passed, {' + '.join(f'CASE WHEN ({c}) IS NOT NULL THEN 1 ELSE 0 END' for c in checks)} AS style_available,
  round(high_ratio * 100, 2) AS high_proximity FROM {k}2 LEFT JOIN {k}b USING (market)),
{k}4 AS (SELECT *, {lm('pct1', 'pct7', 'least(volume_ratio / 2, CASE WHEN volume_ratio IS NOT NULL THEN 1.0 END) * 100', clamp('(relative7 * 500 + 50)'))} AS s1,
  {lm('pct30', 'pct60', clamp('(relative30 * 300 + 50)'), clamp('(relative60 * 250 + 50)'))} AS s2,
  {lm('pct120', 'pct252', 'rs_percentile', 'CASE WHEN high_ratio IS NOT NULL THEN least(high_ratio * 100, 100.0) END', 'style_passed / nullif(style_available, 0) * 100')} AS s3 FROM {k}3),
{k}5 AS (SELECT *, round(s1, 2) AS short_score, round(s2, 2) AS intermediate_score, round(s3, 2) AS structural_score,
  round((coalesce(s1 * 0.2, 0) + coalesce(s2 * 0.4, 0) + coalesce(s3 * 0.4, 0)) / nullif(CASE WHEN s1 IS NULL THEN 0 ELSE 0.2 END::DOUBLE + CASE WHEN s2 IS NULL THEN 0 ELSE 0.4 END::DOUBLE + CASE WHEN s3 IS NULL THEN 0 ELSE 0.4 END::DOUBLE, 0), 2) AS composite_score,
  CASE WHEN s1 >= 75 AND s2 >= 75 AND s3 >= 75 THEN 'all-round-leader' WHEN s3 >= 75 AND s2 >= 65 THEN 'structural-leader' WHEN s2 >= 75 THEN 'intermediate-leader' WHEN s1 >= 75 THEN 'short-spike' ELSE 'watch' END AS leadership_label,
  list_filter([CASE WHEN volume_ratio IS NULL OR volume = 0 THEN 'check-volume' END, CASE WHEN short THEN 'short-history' END, CASE WHEN short OR stale THEN 'check-data' END, CASE WHEN stale THEN 'stale-latest' END, CASE WHEN {any_extreme} THEN 'extreme-return' END,
    CASE WHEN {zeros} >= 4 AND (volume_ratio IS NULL OR volume_ratio = 0) THEN 'halted-or-relisted' END], lambda x: x IS NOT NULL) AS caution_flags FROM {k}4),
{k}6 AS (SELECT *, round(greatest(0.0, least(100.0, coalesce(greatest(0.0, least(25.0, (rs_percentile - 70) / 30 * 25)) * CASE WHEN rs_percentile IS NULL THEN NULL ELSE 1 END, 0) + CASE WHEN return30 > 0 THEN 10 ELSE 0 END + CASE WHEN return60 > 0 THEN 10 ELSE 0 END + CASE WHEN return120 > 0 THEN 10 ELSE 0 END
  + coalesce(greatest(0.0, least(20.0, (high_proximity - 85) / 15 * 20)) * CASE WHEN high_proximity IS NULL THEN NULL ELSE 1 END, 0) + CASE WHEN volume_ratio BETWEEN 1.2 AND 5 THEN 15 WHEN volume_ratio >= 0.8 AND volume_ratio < 1.2 THEN 7 WHEN volume_ratio > 5 AND volume_ratio < 10 THEN 5 ELSE 0 END
  + CASE WHEN len(caution_flags) = 0 THEN 10 ELSE 0 END - CASE WHEN return1 >= 0.2 THEN 15 ELSE 0 END - CASE WHEN return7 >= 0.5 THEN 20 ELSE 0 END - CASE WHEN volume_ratio >= 10 THEN 20 ELSE 0 END - least(35.0, len(caution_flags) * 12.0))), 2) AS buyability FROM {k}5),
{k} AS (SELECT *, CASE WHEN len(caution_flags) > 0 THEN 'check-data' WHEN return1 >= 0.2 OR return7 >= 0.5 OR volume_ratio >= 10 OR (structural_score < 50 AND return7 >= 0.2) THEN 'overheated' WHEN high_proximity >= 95 AND rs_percentile >= 90 AND volume_ratio BETWEEN 1.2 AND 5 THEN 'breakout'
  WHEN structural_score >= 75 AND intermediate_score >= 65 AND return7 < 0.2 AND coalesce(return1 < 0.2, true) AND rs_percentile >= 80 THEN 'pullback' ELSE 'watch' END AS setup_label FROM {k}6)"""


U_SQL = f"WITH {BARS_SQL}, {universe_sql()}"


def scores(spark, sf_dir) -> DataFrame:
    return screen.scored(universe(spark, sf_dir), by=["as_of"])


def both_days(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """What comparisons need of the scores of AS_OF and PRIOR, computed once."""
    df = screen.scored(universe(spark, sf_dir, AS_OF, PRIOR), by=["as_of"])
    df = written(df.select("as_of", "ticker", "leadership_label", "rs_percentile", "high_proximity", "volume_ratio", *(f"{x}_score" for x in screen.LENSES)), "scores")
    return tuple(df.where(F.col("as_of") == F.lit(d).cast("date")) for d in (AS_OF, PRIOR))


@query("positional_percentile", f"{U_SQL} SELECT ticker, round(rs_raw, 6) AS rs_raw, round(rs_percentile, 6) AS rs_percentile FROM u")
def positional_percentile(spark, sf_dir):
    return out(universe(spark, sf_dir), "ticker", "rs_raw", "rs_percentile")


@query("rs_raw", f"{U_SQL} SELECT ticker, round(rs_raw, 6) AS rs_raw FROM u")
def rs_raw(spark, sf_dir):
    return out(universe(spark, sf_dir), "ticker", "rs_raw")


@query("rs_lookup", f"{U_SQL} SELECT ticker, round(CASE WHEN rs_percentile >= 50 THEN rs_percentile END, 6) AS rs_percentile, CASE WHEN coalesce(rs_percentile >= 50, false) THEN 'available' ELSE 'unavailable' END AS rs_status, CASE WHEN NOT coalesce(rs_percentile >= 50, false) THEN 'ticker-not-in-cache' END AS rs_reason FROM u")
def rs_lookup(spark, sf_dir):
    u = universe(spark, sf_dir)
    return out(screen.rs_lookup(u.select("ticker"), u.where("rs_percentile >= 50")), "ticker", "rs_percentile", "rs_status", "rs_reason")


@query("market_relative", f"{U_SQL} SELECT ticker, market, round(relative7, 6) AS relative7, round(relative30, 6) AS relative30, round(relative60, 6) AS relative60 FROM u")
def market_relative(spark, sf_dir):
    u = universe(spark, sf_dir)
    return out(screen.market_relative(u, backdrop(u)), "ticker", "market", "relative7", "relative30", "relative60")


@query("minervini_template", f"""{U_SQL}, r AS (SELECT ticker, [close > ma50 AND close > ma150 AND close > ma200, ma150 > ma200, ma50 > ma150 AND ma50 > ma200, ma200 > ma200_past, low_ratio >= 1.3, high_ratio >= 0.75, rs_percentile >= 70] AS r, ma50 IS NULL OR ma150 IS NULL OR ma200 IS NULL AS part FROM u),
c AS (SELECT ticker, len(list_filter(r, lambda x: x)) AS y, len(list_filter(r, lambda x: NOT x)) AS f FROM r)
SELECT ticker, y AS template_passed, f AS template_failed, 7 - y - f AS template_unknown, CASE WHEN y + f < 7 THEN 'incomplete' WHEN f = 0 THEN 'pass' ELSE 'fail' END AS template FROM c""")
def minervini_template(spark, sf_dir):
    return out(universe(spark, sf_dir).withColumns(rules.trend_template()), "ticker", "template_passed", "template_failed", "template_unknown", "template")


@query("leadership_score", f"""{U_SQL}, p AS (SELECT ticker, CASE WHEN high_ratio >= 0.95 THEN 25 WHEN high_ratio >= 0.9 THEN 18 WHEN high_ratio >= 0.85 THEN 10 WHEN high_ratio >= 0.75 THEN 5 WHEN high_ratio IS NOT NULL THEN 0 END AS a,
  CASE WHEN since_high <= 20 THEN 25 WHEN since_high <= 60 THEN 18 WHEN since_high <= 120 THEN 10 WHEN since_high <= 252 THEN 5 WHEN since_high IS NOT NULL THEN 0 END AS b, CASE WHEN new_highs60 >= 3 THEN 15 WHEN new_highs60 >= 2 THEN 10 WHEN new_highs60 >= 1 THEN 5 WHEN new_highs60 IS NOT NULL THEN 0 END AS c,
  CASE WHEN rs_percentile >= 90 THEN 20 WHEN rs_percentile >= 80 THEN 15 WHEN rs_percentile >= 70 THEN 10 WHEN rs_percentile >= 60 THEN 5 WHEN rs_percentile IS NOT NULL THEN 0 END AS d,
  CASE WHEN ma200 IS NOT NULL THEN CASE WHEN close > ma50 AND ma50 > ma150 AND ma150 > ma200 THEN 10 ELSE 0 END + CASE WHEN volume_ratio >= 1.2 THEN 5 ELSE 0 END WHEN volume_ratio >= 1.2 THEN 5 WHEN volume_ratio IS NOT NULL THEN 0 END AS e FROM u),
q AS (SELECT ticker, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0) + coalesce(e, 0) AS points, CASE WHEN a IS NULL THEN 0 ELSE 25 END + CASE WHEN b IS NULL THEN 0 ELSE 25 END + CASE WHEN c IS NULL THEN 0 ELSE 15 END + CASE WHEN d IS NULL THEN 0 ELSE 20 END + CASE WHEN e IS NULL THEN 0 ELSE 15 END AS most FROM p)
SELECT ticker, CAST(points AS BIGINT) AS points, CAST(most AS BIGINT) AS max_points, CASE WHEN most = 100 THEN 'complete' ELSE 'partial' END AS leadership_status, CASE WHEN most = 100 THEN CASE WHEN points >= 85 THEN 'A' WHEN points >= 70 THEN 'B' WHEN points >= 55 THEN 'C' ELSE 'D' END END AS grade FROM q""")
def leadership_score(spark, sf_dir):
    return out(universe(spark, sf_dir).withColumns(rules.leadership_score()), "ticker", "points", "max_points", "leadership_status", "grade")


for _name, _ints, _doubles, _texts in (
    ("minervini_style", ["style_passed", "style_available"], [], []), ("lens_scores", [], ["short_score", "intermediate_score", "structural_score", "composite_score"], []),
    ("buyability", [], ["buyability"], []), ("setup_label", [], [], ["setup_label"]), ("leadership_label", [], [], ["leadership_label"]),
):

    @query(_name, f"{U_SQL} SELECT {', '.join(['ticker', *(f'CAST({c} AS BIGINT) AS {c}' for c in _ints), *_doubles, *_texts])} FROM u")
    def _score_query(spark, sf_dir, cols=(*_ints, *_doubles, *_texts)):
        return out(scores(spark, sf_dir), "ticker", *cols)


@query("caution_flags", f"{U_SQL} SELECT ticker, array_to_string(caution_flags, ',') AS caution_flags FROM u")
def caution_flags(spark, sf_dir):
    return scores(spark, sf_dir).select("ticker", F.array_join("caution_flags", ",").alias("caution_flags"))


LENS_SQL = lambda k, top: f"l{k} AS (SELECT * FROM (SELECT lens, ticker, score, row_number() OVER (PARTITION BY lens ORDER BY score DESC, ticker) AS rank FROM (SELECT ticker, unnest(['short', 'intermediate', 'structural', 'composite']) AS lens, unnest([short_score, intermediate_score, structural_score, composite_score]) AS score FROM {k}) WHERE score IS NOT NULL) WHERE rank <= {top})"


@query("lens_rankings", f"{U_SQL}, {LENS_SQL('u', 10)} SELECT lens, rank, ticker, score FROM lu")
def lens_rankings(spark, sf_dir):
    return out(screen.lens_rankings(scores(spark, sf_dir), 10), "lens", "rank", "ticker", "score")


@query("candidate_lists", f"""{U_SQL}, c AS (SELECT *, unnest([CASE WHEN buyability >= 30 AND setup_label NOT IN ('overheated', 'check-data') THEN 'buyable' END, CASE WHEN setup_label = 'pullback' THEN 'pullback' END, CASE WHEN setup_label = 'breakout' THEN 'breakout' END, CASE WHEN len(caution_flags) > 0 OR setup_label IN ('overheated', 'check-data') THEN 'caution' END]) AS list FROM u WHERE buyability IS NOT NULL)
SELECT list, row_number() OVER (PARTITION BY list ORDER BY CASE WHEN list <> 'caution' THEN buyability END DESC NULLS LAST, composite_score DESC NULLS LAST, ticker) AS rank, ticker, buyability, composite_score, setup_label FROM c WHERE list IS NOT NULL""")
def candidate_lists(spark, sf_dir):
    return out(screen.candidate_lists(scores(spark, sf_dir), least=30))


V_SQL = f"{U_SQL}, {universe_sql(PRIOR, 'v')}, {LENS_SQL('u', 20)}, {LENS_SQL('v', 20)}"


@query("new_entrants", f"{V_SQL} SELECT lens, ticker, score, rank FROM lu WHERE rank <= 8 AND (lens, ticker) NOT IN (SELECT (lens, ticker) FROM lv WHERE rank <= 8)")
def new_entrants(spark, sf_dir):
    now, before = map(screen.lens_rankings, both_days(spark, sf_dir))
    return out(screen.new_entrants(now, before, 8), "lens", "ticker", "score", "rank")


STRENGTH_SQL = lambda x: f"list_position(['none', 'watch', 'short-spike', 'intermediate-leader', 'structural-leader', 'all-round-leader'], coalesce({x}, 'none'))"
DIFF_SQL = f"""{V_SQL}, d AS (SELECT u.ticker, u.composite_score, u.rs_percentile, {STRENGTH_SQL('u.leadership_label')} > {STRENGTH_SQL('v.leadership_label')} AS upgraded, coalesce(u.rs_percentile >= 90, false) AND coalesce(v.rs_percentile < 90, true) AS rs_cross,
  coalesce(u.high_proximity >= 95, false) AND coalesce(v.high_proximity < 95, true) AS proximity_cross, coalesce(u.volume_ratio >= 1.5, false) AND coalesce(v.volume_ratio < 1.5, true) AS volume_cross FROM u LEFT JOIN v ON u.ticker = v.ticker)"""


@query("prior_diff", f"{DIFF_SQL} SELECT ticker, upgraded, rs_cross, proximity_cross, volume_cross FROM d")
def prior_diff(spark, sf_dir):
    return screen.prior_diff(*both_days(spark, sf_dir)).select("ticker", "upgraded", "rs_cross", "proximity_cross", "volume_cross")


@query("entrant_events", f"""{DIFF_SQL}, e AS (SELECT ticker, 'new-' || lens AS event FROM lu WHERE rank <= 8 AND (lens, ticker) NOT IN (SELECT (lens, ticker) FROM lv WHERE rank <= 8) UNION SELECT ticker, unnest([CASE WHEN upgraded THEN 'upgrade' END, CASE WHEN rs_cross THEN 'rs-cross' END, CASE WHEN proximity_cross THEN 'proximity-cross' END, CASE WHEN volume_cross THEN 'volume-cross' END]) FROM d)
SELECT e.ticker, string_agg(DISTINCT event, ',' ORDER BY event) AS events, (SELECT min(rank) FROM lu WHERE lu.ticker = e.ticker) AS best_rank, (SELECT min(rank) FROM lv WHERE lv.ticker = e.ticker) AS prior_best_rank, round(any_value(composite_score), 6) AS composite_score, round(any_value(d.rs_percentile), 6) AS rs_percentile FROM e JOIN d ON d.ticker = e.ticker WHERE event IS NOT NULL GROUP BY e.ticker""")
def entrant_events(spark, sf_dir):
    now, before = both_days(spark, sf_dir)
    df = screen.entrant_events(now, before, screen.lens_rankings(now), screen.lens_rankings(before), 8)
    return out(df.withColumn("events", F.array_join("events", ",")))


@query("latest_before", f"WITH {BARS_SQL} SELECT ticker, date, round(close, 6) AS close FROM bars WHERE date = (SELECT max(date) FROM bars WHERE date < DATE '{PRIOR}')")
def latest_before(spark, sf_dir):
    return out(screen.latest_before(bars(spark, sf_dir), F.lit(PRIOR).cast("date"), "date"), "ticker", "date", "close")


@query("universe_counts", f"{U_SQL} SELECT count(*) AS listed, count(*) FILTER (WHERE bars >= 252) AS full_history, count(rs_percentile) AS eligible, count(*) - count(rs_percentile) AS failed FROM u")
def universe_counts(spark, sf_dir):
    return out(screen.universe_counts(universe(spark, sf_dir)))


@query("theme_counts", f"{U_SQL} SELECT market AS theme, count(*) AS n FROM (SELECT * FROM u WHERE composite_score IS NOT NULL ORDER BY composite_score DESC, ticker LIMIT 20) GROUP BY 1 ORDER BY n DESC, theme LIMIT 5")
def theme_counts(spark, sf_dir):
    return screen.theme_counts(scores(spark, sf_dir).withColumns({"industry": F.col("market"), "product": F.lit(None).cast("string")}))


@query("portfolio_status", f"""{READ_SQL}, s AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars),
x AS MATERIALIZED (SELECT ticker, close - lag(close) {D} AS d, row_number() {D} - 1 AS k FROM s WHERE r <= 42), w AS (SELECT ticker, 14::BIGINT AS k, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM x WHERE k BETWEEN 1 AND 14 GROUP BY 1 UNION ALL SELECT x.ticker, x.k, (w.g * 13 + greatest(x.d, 0)) / 14, (w.l * 13 + greatest(-x.d, 0)) / 14 FROM w JOIN x ON x.ticker = w.ticker AND x.k = w.k + 1),
z AS (SELECT ticker, 100 - 100 / (1 + g / l) AS rsi FROM w JOIN (SELECT ticker, max(k) AS k FROM w GROUP BY 1) USING (ticker, k))
SELECT ticker, CASE WHEN bars < 15 THEN 'insufficient-data' ELSE coalesce(nullif(concat_ws(',', CASE WHEN rsi > 70 THEN 'overbought' END, CASE WHEN rsi < 30 THEN 'oversold' END, CASE WHEN close / ma20 - 1 > 0.05 THEN 'extended' END, CASE WHEN close / ma20 - 1 < -0.05 THEN 'below-trend' END), ''), 'normal') END AS status FROM st LEFT JOIN z USING (ticker)""".replace("s AS (SELECT ticker, date, close, row_number() OVER", "ss AS (SELECT ticker, date, close, row_number() OVER").replace("FROM s WHERE r <= 42", "FROM ss WHERE r <= 42"))
def portfolio_status(spark, sf_dir):
    return read(spark, sf_dir).select("ticker", rules.position_status().alias("status"))


# Price structure

ZONE_SQL = f"""WITH {BARS_SQL}, {panel_sql()}, pv AS (SELECT ticker, n, high AS price, 'high' AS kind FROM panel WHERE pivot_high UNION ALL SELECT ticker, n, low, 'low' FROM panel WHERE pivot_low),
tol AS (SELECT ticker, greatest(0.5 * coalesce(atr14, 0), 0.005 * close) AS tolerance FROM panel WHERE n = bars),
mk AS (SELECT pv.*, CASE WHEN price - lag(price) OVER (PARTITION BY ticker ORDER BY price, n, kind) > tolerance THEN 1 ELSE 0 END AS new FROM pv JOIN tol USING (ticker)),
gr AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY price, n, kind ROWS UNBOUNDED PRECEDING) AS zone FROM mk),
zn AS (SELECT ticker, CAST(zone AS BIGINT) AS zone, min(price) AS low, max(price) AS high, avg(price) AS center, count(*) AS pivots FROM gr GROUP BY 1, 2 HAVING count(*) >= 2),
tc AS (SELECT z.ticker, z.zone, z.low, z.high, z.center, z.pivots, count(*) AS touches, max(b.n) AS last_n, max(b.date) AS last_touch, sum(b.volume) AS volume FROM zn z JOIN panel b ON b.ticker = z.ticker AND greatest(b.low, z.low) <= least(b.high, z.high) GROUP BY ALL),
sd AS (SELECT ticker, any_value(bars) AS bars, last(close ORDER BY n) AS price FROM panel WHERE n > bars - 5 GROUP BY 1),
zs AS (SELECT tc.*, bars, price, CASE WHEN high < price THEN 'support' WHEN low > price THEN 'resistance' ELSE 'inside' END AS type, 'active' AS status, abs(center - price) / price AS distance FROM tc JOIN sd USING (ticker)),
sc AS (SELECT *, distance > 0.3 AS far, 0.35 * CASE WHEN max(touches) OVER w > min(touches) OVER w THEN (touches - min(touches) OVER w) / (max(touches) OVER w - min(touches) OVER w) ELSE 0.5 END + 0.25 * exp(-(bars - last_n) / 30)
  + 0.2 * CASE WHEN max(volume) OVER w > min(volume) OVER w THEN (volume - min(volume) OVER w) / (max(volume) OVER w - min(volume) OVER w) ELSE 0.5 END + 0.15 * greatest(0, 1 - distance / 0.3) + 0.05 AS score FROM zs WINDOW w AS (PARTITION BY ticker))"""


def scored_zones(spark, sf_dir):
    p = panel(spark, sf_dir)
    return structure.zone_score(structure.zone_status(structure.touches(structure.zones(p), p), p))


@query("price_zones", f"{ZONE_SQL} SELECT ticker, zone, round(low, 6) AS low, round(high, 6) AS high, round(center, 6) AS center, pivots FROM zn")
def price_zones(spark, sf_dir):
    return out(structure.zones(panel(spark, sf_dir)))


@query("zone_touches", f"{ZONE_SQL} SELECT ticker, zone, touches, last_touch, volume FROM tc")
def zone_touches(spark, sf_dir):
    p = panel(spark, sf_dir)
    return out(structure.touches(structure.zones(p), p), "ticker", "zone", "touches", "last_touch", "volume")


@query("zone_status", f"{ZONE_SQL} SELECT ticker, zone, type, status, round(distance, 6) AS distance, far FROM sc")
def zone_status(spark, sf_dir):
    return out(scored_zones(spark, sf_dir), "ticker", "zone", "type", "status", "distance", "far")


@query("zone_score", f"{ZONE_SQL} SELECT ticker, zone, round(score, 6) AS score FROM sc")
def zone_score(spark, sf_dir):
    return out(scored_zones(spark, sf_dir), "ticker", "zone", "score")


@query("drawn_zones", f"{ZONE_SQL} SELECT ticker, type, zone, rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker, type ORDER BY score DESC, zone) AS rank FROM sc WHERE type <> 'inside' AND NOT far) WHERE rank <= 3")
def drawn_zones(spark, sf_dir):
    return out(structure.drawn_zones(scored_zones(spark, sf_dir)), "ticker", "type", "zone", "rank")


@query("volume_profile", f"""WITH {BARS_SQL}, w AS (SELECT *, min(low) OVER (PARTITION BY ticker) AS lo, max(high) OVER (PARTITION BY ticker) AS hi, (high + low + close) / 3 AS typical FROM bars),
b AS (SELECT ticker, CAST(greatest(0, least(49, floor((typical - lo) / (hi - lo) * 50))) AS BIGINT) AS bin, sum(volume) AS volume FROM w GROUP BY 1, 2) SELECT ticker, bin, volume, row_number() OVER (PARTITION BY ticker ORDER BY volume DESC, bin) = 1 AS poc FROM b""")
def volume_profile(spark, sf_dir):
    return out(structure.volume_profile(bars(spark, sf_dir)), "ticker", "bin", "volume", "poc")


WAVE_SQL = f"""WITH {BARS_SQL}, {panel_sql()}, pv AS (SELECT ticker, n, high AS price, 'high' AS kind FROM panel WHERE pivot_high AND n > greatest(bars - 120, 0) + 5 UNION ALL SELECT ticker, n, low, 'low' FROM panel WHERE pivot_low AND n > greatest(bars - 120, 0) + 5),
ls AS (SELECT ticker, bars AS size, greatest(coalesce(atr14, 0), close * 0.01) AS least FROM panel WHERE n = bars),
ls2 AS (SELECT ticker, any_value(size) AS size, any_value(least) AS least, list([{{'n': CAST(n AS INTEGER), 'kind': kind, 'price': CAST(price AS DOUBLE)}}] ORDER BY n, kind) AS pts FROM pv JOIN ls USING (ticker) GROUP BY 1),
tn AS (SELECT ticker, size, least, list_reduce(pts, lambda a, b: CASE WHEN a[len(a)].kind = b[1].kind THEN CASE WHEN (b[1].kind = 'high' AND b[1].price > a[len(a)].price) OR (b[1].kind = 'low' AND b[1].price < a[len(a)].price) THEN list_append(a[1:len(a) - 1], b[1]) ELSE a END
  WHEN least > 0 AND abs(b[1].price - a[len(a)].price) < least THEN a ELSE list_append(a, b[1]) END) AS t FROM ls2),
sx AS (SELECT ticker, size, least, t, unnest(range(1, len(t) - 4)) AS i FROM tn WHERE len(t) >= 6),
g AS (SELECT ticker, size, least, t[i].kind = 'low' AS up, [t[i + k].price FOR k IN range(9)] AS p, [t[i + k].n FOR k IN range(9)] AS n, [abs(t[i + k + 1].price - t[i + k].price) FOR k IN range(8)] AS d FROM sx),
sc AS (SELECT *, 0.25::DOUBLE + 0.2::DOUBLE * len(list_filter(d[1:5], lambda x: x >= least)) / 5 + 0.25::DOUBLE * CASE WHEN d[3] >= 0.9::DOUBLE * d[1] THEN 1 ELSE d[3] / greatest(d[1], 1) END
    + (0.2::DOUBLE * greatest(0, 1 - greatest((p[2] - p[5]) * CASE WHEN up THEN 1 ELSE -1 END, 0) / greatest(d[1], 1)) + 0.1::DOUBLE * greatest(0, 1 - (size - n[6]) / 60)) AS move,
  0.3::DOUBLE + 0.25::DOUBLE * len(list_filter(d[7:8], lambda x: x >= least)) / 2 + 0.25::DOUBLE * least(d[7], d[8]) / greatest(d[7], d[8], 1) + 0.2::DOUBLE * greatest(0, 1 - (size - n[9]) / 45) AS back FROM g),
wv AS (SELECT ticker, 'impulse' AS kind, CASE WHEN up THEN 'bullish' ELSE 'bearish' END AS direction, least(1, greatest(0, move)) AS confidence, move >= 0.55 AS drawable, n[1] AS first_n, n[6] AS last_n, p[1] AS first_price, p[6] AS last_price FROM sc
  UNION ALL SELECT ticker, 'corrective', CASE WHEN up THEN 'bearish-correction' ELSE 'bullish-correction' END, least(1, greatest(0, back)), back >= 0.55, n[7], n[9], p[7], p[9] FROM sc WHERE n[9] IS NOT NULL)"""
_WAVE = "ticker, kind, direction, round(confidence, 6) AS confidence, drawable, CAST(first_n AS BIGINT) AS first_n, CAST(last_n AS BIGINT) AS last_n, round(first_price, 6) AS first_price, round(last_price, 6) AS last_price"


@query("wave_candidates", f"{WAVE_SQL} SELECT {_WAVE} FROM wv")
def wave_candidates(spark, sf_dir):
    return out(structure.waves(panel(spark, sf_dir)))


@query("alternating_pivots", f"{WAVE_SQL} SELECT ticker, CAST(k - 1 AS BIGINT) AS nth, CAST(x.n AS BIGINT) AS n, x.kind AS kind, round(price, 6) AS price FROM (SELECT ticker, k, x, x.price AS price FROM (SELECT ticker, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS k FROM tn))")
def alternating_pivots(spark, sf_dir):
    return out(structure.alternating_pivots(panel(spark, sf_dir)))


@query("best_wave", f"{WAVE_SQL} SELECT {_WAVE} FROM wv WHERE drawable QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY round(confidence::DOUBLE, 9) DESC, last_n DESC, first_n, kind) = 1")
def best_wave(spark, sf_dir):
    return out(structure.best_wave(structure.waves(panel(spark, sf_dir))))


@query("fib_levels", f"""WITH {BARS_SQL}, m AS (SELECT ticker, first(close ORDER BY date) AS a, last(close ORDER BY date) AS b FROM bars GROUP BY 1), l AS (SELECT ticker, unnest(['retracement', 'retracement', 'retracement', 'extension', 'extension']) AS level, unnest([0.382, 0.5, 0.618, 1.0, 1.618]::DOUBLE[]) AS ratio, unnest([b - (b - a) * 0.382::DOUBLE, b - (b - a) * 0.5::DOUBLE, b - (b - a) * 0.618::DOUBLE, b, a + (b - a) * 1.618::DOUBLE]) AS price FROM m WHERE a <> b)
SELECT ticker, level, round(ratio, 6) AS ratio, round(price, 6) AS price FROM l""")
def fib_levels(spark, sf_dir):
    m = bars(spark, sf_dir).groupBy("ticker").agg(F.min_by("close", "date").alias("first_price"), F.max_by("close", "date").alias("last_price"))
    return out(structure.fib_levels(m))
