"""Structured Streaming jobs. Over a finite input each gives what the batch operator gives."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tidemark.operators.fundamentals import holder_filings
from tidemark.operators.news import pattern_score, url_key


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of ticks (key, ts, seq, price, quantity) by event time; also of a batch of them. Late ticks are dropped."""
    at = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("key", F.window("ts", width).alias("w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"))
        .select("key", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")
    )


def filings(stream: DataFrame, holder: str, kinds: dict[str, str], late: str = "7 days") -> DataFrame:
    """The first row of each receipt number (rcept_no, filed_at, filer, report_name) of a holder's filings."""
    return holder_filings(stream, holder, kinds).withWatermark("filed_at", late).dropDuplicatesWithinWatermark(["rcept_no"])


def news(stream: DataFrame, day: Column, points: list[tuple[str, int]], late: str = "1 day") -> DataFrame:
    """Items of one day (published_at, url, text), once for each address, with their score."""
    own = stream.where(F.to_date("published_at") == day).withColumn("url_key", url_key("url"))
    return own.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["url_key"]).withColumn("score", pattern_score(F.col("text"), points))


def crossings(stream: DataFrame, level: float, late: str = "10 minutes", forget_days: int = 400) -> DataFrame:
    """Rows (key, ts, value) where a key's value reaches the level from below; a first value counts as from below.

    Rows may arrive in any order and in any batch: a key keeps what it has not decided yet, and a timer in event time
    releases those that the watermark has passed, by ts, then by value. Rows later than ``late`` are dropped. The state of a
    key is its last released value and the rows that wait; a key that stays silent for so many days of event time is
    forgotten, and its next value counts as a first one. It runs on any state store.
    """

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = (state.get[0], json.loads(state.get[1])) if state.exists else (None, [])
        if not state.hasTimedOut:
            for b in batches:
                waiting += zip(b["us"].tolist(), b["value"].tolist(), strict=True)
        elif not waiting:
            state.remove()
            return
        passed = state.getCurrentWatermarkMs()
        waiting = sorted(map(tuple, waiting))
        ready = [r for r in waiting if r[0] <= passed * 1000]
        waiting = waiting[len(ready) :]
        values = [v for _, v in ready]
        up = [r for r, b in zip(ready, [last, *values], strict=False) if r[1] >= level and (b is None or b < level)]
        state.update((values[-1] if values else last, json.dumps(waiting)))
        state.setTimeoutTimestamp(max(passed, waiting[0][0] // 1000) + 1 if waiting else passed + forget_days * 86_400_000)
        if up:
            yield pd.DataFrame({"key": key[0], "us": [t for t, _ in up], "value": [v for _, v in up]})

    rows = stream.where("value is not null").withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("us"), "value")
    found = rows.groupBy("key").applyInPandasWithState(one, "key string, us long, value double", "last double, waiting string", "append", "EventTimeTimeout")
    return found.select("key", F.timestamp_micros("us").alias("ts"), "value")


def crossings_batch(rows: DataFrame, level: float) -> DataFrame:
    from pyspark.sql.window import Window as W

    before = F.lag("value").over(W.partitionBy("key").orderBy("ts", "value"))
    return rows.where("value is not null").withColumn("__b", before).where((F.col("value") >= level) & (F.col("__b").isNull() | (F.col("__b") < level))).drop("__b")
