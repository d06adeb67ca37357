"""What the operators of this package share: tables, the shared folder, ranks and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_texts(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs, after Arrow batches of the session were set to at most so many rows: with long texts, the usual 10,000 fill
    tens of MB for every task, in the executor and in its Python worker.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, rows)
    return docs


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is spark.checkpoint.dir. A temporary folder stands in only where that is
    unset and Spark runs in one process, as in tests.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Adds the gapless rank, from 0, of each row in its group, ordered by bucket and then by order.

    A group may be as large as the table: rows are numbered within (group, bucket),
    and the counts of the buckets before are added. bucket must take a bounded number
    of values, which also bounds the broadcast table of counts.
    """
    counts = df.groupBy(*group, bucket).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*group, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rows = df.join(F.broadcast(starts), [*group, bucket])
    within = F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order))
    return rows.withColumn(out, F.col("__start") + within - 1).drop("__start")


def unit_hash(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on cols alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v: long) can reach.

    Alternating large-star and small-star steps; each leaves as many links as there are
    nodes at most, and the number of rounds grows with the logarithm of the longest
    path. Minima are taken by partial aggregation; the join back to them is dealt by node, so
    the links of one node meet in one task there. Each round is a table in the shared folder.
    """

    def star(links: DataFrame) -> DataFrame:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        return links.join(least, "a").select("a", "b", F.least("a", "m").alias("m"))

    now = written(
        edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct(), "links"
    )
    state = None
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = star(large)
        small = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = written(small, "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
