"""Ranks over a whole table and linked rows, spread over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.sources.shared import written


def total_rank(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with the gapless rank, from 1, of each row in the order of the whole table.

    Rows are dealt by ranges of the order and sorted inside them; a row's rank is its place in its range and the rows
    of the ranges before. Only the sizes of the ranges, as many as there are partitions, meet in one place. Rows that order
    does not tell apart get ranks in any order.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    dealt = written(dealt.withColumns({"__part": part, "__place": F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)}), "ranked")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    return dealt.join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + F.col("__place") + 1).select(*df.columns, out)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v: long) can reach.

    Alternating large-star and small-star steps, about as many as the logarithm of the longest path. A node's least neighbour
    is found by partial aggregation and written before it is joined back, so that adaptive execution can split the join
    for a node with very many links.
    """

    def star(links: DataFrame) -> DataFrame:
        least = written(links.groupBy("a").agg(F.min("b").alias("m")), "least")
        return links.join(least, "a").select("a", "b", F.least("a", "m").alias("m"))

    def two_ways(links: DataFrame) -> DataFrame:
        return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))

    now, state = written(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct(), "links"), None
    for _ in range(rounds):
        large = written(star(written(two_ways(now), "links")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        small = star(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = written(small, "links")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
