"""Streaming jobs over the events table, run until it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import out, query, table
from tidemark.sources.shared import shared_dir
from tidemark.streaming import jobs


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a streaming job appends over all of its input, as a table."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def events(spark, sf_dir) -> DataFrame:
    """The table as a stream of files; windows that its last rows leave open are not appended."""
    t = table(spark, sf_dir, "events")
    folder = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    t.write.parquet(folder)
    return spark.readStream.schema(t.schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


B_SQL = """SELECT event_type AS key, date_trunc('day', ts) AS start, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, round(sum(value) + 1e-8, 6) AS volume FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2"""


@query("stream_bars", f"WITH b AS ({B_SQL}) SELECT * FROM b WHERE start < (SELECT max(ts) FROM events) - INTERVAL 1 DAY - INTERVAL 10 MINUTE")
def stream_bars(spark, sf_dir):
    ticks = events(spark, sf_dir).where("event_type is not null").select(F.col("event_type").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.col("value").alias("quantity"))
    return out(drained(jobs.bars(ticks, "1 day")))


@query("stream_filings", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1")
def stream_filings(spark, sf_dir):
    """First filing of each user, a purchase standing in for a filing."""
    s = events(spark, sf_dir).select(F.col("user_id").alias("rcept_no"), F.col("ts").alias("filed_at"), F.lit("holder").alias("filer"), F.col("event_type").alias("report_name"))
    return drained(jobs.filings(s, "holder", {"purchase": "purchase"}, late="400 days")).groupBy(F.col("rcept_no").alias("user_id")).agg(F.count("*").alias("n"))


@query("stream_crossings", "WITH v AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, value) AS b FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL) SELECT key, ts, value FROM v WHERE value >= 20 AND (b IS NULL OR b < 20) AND ts <= (SELECT max(ts) FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL) - INTERVAL 10 MINUTE")
def stream_crossings(spark, sf_dir):
    """Rows of the last ten minutes still wait for what may come before them."""
    rows = events(spark, sf_dir).where("value is not null and user_id is not null").select(F.col("user_id").cast("string").alias("key"), "ts", "value")
    return drained(jobs.crossings(rows, 20.0))
