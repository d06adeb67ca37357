"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has several virtual nodes on a ring of fixed positions. A row's key has a
position; walking clockwise from it gives an order of the shards. A shard has a capacity.
Rows propose to the first shard of their order that has room; a full shard keeps those
that come first in a hashed order of turns, and the rest continue clockwise in the next
round. With load factor 1 the capacities are the exact shares (counts at most one apart);
with more, fewer rows leave their home. A new shard adds only its own virtual nodes.

All of it is DataFrame work on (id, size, crc, position, turn). Ranks come from counts of
fixed buckets of turns, so that no task holds a whole shard. The driver sees the ring and
a count for each shard.

Defined results: a null text has no bytes and checksum 0; a null id is a key like any
other; repeated rows are placed one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ranked, written

POSITIONS, TURNS = 2048, 4096


def ring(spark: SparkSession, n_shards: int, vnodes: int) -> DataFrame:
    """(position, prefs: array of all shards in clockwise order), a row for each position."""
    node = spark.range(n_shards * vnodes).select((F.col("id") % n_shards).cast("int").alias("shard"), (F.col("id") / n_shards).cast("int").alias("replica"))
    placed = node.select("shard", F.pmod(F.xxhash64(F.lit("vnode"), "shard", "replica"), F.lit(POSITIONS)).cast("int").alias("p")).orderBy("p", "shard").collect()
    clockwise = [(r["p"], r["shard"]) for r in placed]
    rows, start = [], 0
    for position in range(POSITIONS):
        while start < len(clockwise) and clockwise[start][0] < position:
            start += 1
        prefs = dict.fromkeys(s for _, s in clockwise[start:] + clockwise[:start])
        rows.append(f"({position}, array({', '.join(map(str, prefs))}))")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(position, prefs)")


def shard(
    docs: DataFrame, n_shards: int = 8, vnodes: int = 64, load_factor: float = 1.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, home_shard, shard, slot) of every row; slots are gapless from 0."""
    spark, text = docs.sparkSession, F.col(text_col)
    keys = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(id_col), F.lit(POSITIONS)).cast("int").alias("position"),
        F.xxhash64(F.lit("turn"), id_col).alias("turn"),
    ).withColumn("bucket", F.pmod("turn", F.lit(TURNS)).cast("int"))
    waiting = written(keys.join(F.broadcast(ring(spark, n_shards, vnodes)), "position"), "ring").withColumn("home_shard", F.col("prefs")[0])
    n = left = waiting.count()
    share, extra = divmod(n, n_shards)
    spare = math.ceil(n * (load_factor - 1) / n_shards)
    room = [share + (s < extra) + spare for s in range(n_shards)]
    turn, placed = ["turn", "doc_id", "text_crc32"], []
    while left:
        full = F.array(*(F.lit(s) for s in range(n_shards) if not room[s])).cast("array<int>")
        asked = waiting.withColumn("shard", F.array_except("prefs", full)[0])
        asked = written(ranked(asked, ["shard"], "bucket", turn, "rank").withColumn("fits", F.col("rank") < F.array(*map(F.lit, room))[F.col("shard")]), "ring")
        for r in asked.where("fits").groupBy("shard").count().collect():
            room[r["shard"]] -= r["count"]
            left -= r["count"]
        placed.append(asked.where("fits").drop("rank", "fits"))
        waiting = asked.where("not fits").drop("rank", "fits", "shard")
    rows = reduce(DataFrame.unionByName, placed) if placed else waiting.withColumn("shard", F.lit(0))
    return ranked(rows, ["shard"], "bucket", turn, "slot").select("doc_id", "size", "text_crc32", "home_shard", "shard", F.col("slot").cast("long").alias("slot"))
