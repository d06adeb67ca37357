"""Documents chosen to resemble good ones, by importance resampling.

Words and word pairs are hashed into a fixed number of buckets. One bag model is
counted over the target, documents that are labelled good, and one over all documents.
A document's log weight is the mean over its n-grams of log(target / raw), times a nominal
length, so that weights of documents of any length compare. Adding Gumbel noise (a hash of
the id, so that any executor draws the same) and keeping the k largest draws k documents
without replacement in proportion to their weights.

Both models are counted over all rows; only the ids of the target are a sample, of at
most about ``target_docs`` labelled rows drawn by hash, which bounds what is broadcast. The
k-th largest key is found by counting ranges of keys ever more narrowly, so that no task
sorts the whole table. k is a share of the rows; by default, that of the good among labels.

Defined results: a null or empty text has no n-grams and log weight 0; equal ids draw the
same noise, rows with a null id that of their text; ties of the key go to the smaller id,
then to the smaller hash of the text, and of repeated rows as many stay as there is room
for; texts of any length are read whole; without labelled good rows both models are equal
and all weights 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import unit_hash, written
from tidemark.llm.words import hashed_words, in_parts, shingle_hashes

BUCKETS, NOMINAL_LENGTH = 1 << 16, 100


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word and word pair, the text it is in)."""
    words, counts = hashed_words(texts)
    pairs, own = shingle_hashes(words, counts, 2)
    which = np.arange(len(texts))
    return (np.concatenate([words, pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([np.repeat(which, counts), np.repeat(which, own)])


def log_ratios(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target / raw) of each bucket over docs (text, good: boolean), each count plus one."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            good, done = b["good"].to_numpy(bool), 0
            for part in in_parts(b["text"]):
                f, owner = features(part, buckets)
                raw += np.bincount(f, minlength=buckets)
                target += np.bincount(f[good[done : done + len(part)][owner]], minlength=buckets)
                done += len(part)
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})

    sums = docs.select("text", "good").mapInPandas(counted, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in sums.collect():  # a row for each bucket at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weighted(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(id, content: long, log_weight) of docs (id, text); content is a hash of the text."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            means = [np.zeros(0)]
            for part in in_parts(b["text"]):
                f, owner = features(part, len(ratios))
                means.append(np.bincount(owner, ratios[f], len(part)) / np.maximum(np.bincount(owner, minlength=len(part)), 1))
            yield pd.DataFrame({"id": b["id"], "content": b["content"], "log_weight": np.concatenate(means) * NOMINAL_LENGTH})

    return docs.select("id", F.xxhash64("text").alias("content"), "text").mapInPandas(rows, "id long, content long, log_weight double")


def largest(rows: DataFrame, key: str, k: int, ties: list[str], ranges: int = 4096, together: int = 10_000) -> DataFrame:
    """The k rows of rows with the largest key; of equal keys, those with the least ties (numbers, nulls first).

    The k-th place is looked for in ever narrower ranges of the key, and where many rows have one key, of the ties after it.
    What is left in the last range is counted by distinct row, of which there are about ``together`` at most.
    """
    if k <= 0:
        return rows.limit(0)
    whole, edge, left = F.lit(False), F.lit(True), k  # all rows of whole are among the k, and left of those of edge
    for x in (F.col(key), *(F.coalesce(-F.col(t).cast("double"), F.lit(1e300)) for t in ties)):
        lo, hi, n = rows.where(edge).agg(F.min(x), F.max(x), F.count("*")).first()
        if n <= left:
            return rows.where(whole | edge)
        inside, span = edge, (lo, hi)
        while n > together:
            width = (span[1] - span[0]) / ranges
            if width <= 0 or span[0] + width <= span[0]:
                break
            nth = F.least(F.floor((x - span[0]) / width), F.lit(ranges - 1))
            counts = rows.where(inside).groupBy(nth.alias("nth")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).orderBy(F.desc("nth")).collect()
            for r in counts:
                if r["n"] >= left:
                    break
                left -= r["n"]
            span, n = (r["lo"], r["hi"]), r["n"]
            inside = edge & x.between(*span)
        whole, edge = whole | (edge & (x > span[1])), inside
        if n <= together:
            break
    same = rows.where(edge).groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    order = W.orderBy(F.desc(key), *ties, *rows.columns)
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = same.withColumn("__n", F.least("__n", F.lit(left) - before)).where("__n > 0")
    # equal rows are written out again, a thousand at a time, by many tasks
    thousands = kept.withColumn("__at", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / 1000)))).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    again = thousands.withColumn("__one", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("__n") - F.col("__at") * 1000))))
    return rows.where(whole).unionByName(again.select(*rows.columns))


def resampled(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, target_docs: int = 100_000, buckets: int = BUCKETS
) -> DataFrame:
    """(doc_id, log_weight, key) of the documents drawn; labels has (doc_id, quality, toxic)."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), (F.coalesce("quality", F.lit(0)) == 1).alias("fine"), (F.coalesce("toxic", F.lit(0)) == 0).alias("clean"))
    n, fine, good = known.agg(F.count("*"), F.count_if("fine"), F.count_if(F.col("fine") & F.col("clean"))).first()
    target = known.where(F.col("fine") & F.col("clean") & (unit_hash("id", F.lit("target")) < min(1.0, target_docs / max(good, 1)))).select("id").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    flagged = rows.join(F.broadcast(target.withColumn("good", F.lit(True))), "id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    scored = weighted(rows, log_ratios(flagged, buckets))
    drawn = F.when(F.col("id").isNull(), unit_hash("content", F.lit("gumbel"))).otherwise(unit_hash("id", F.lit("gumbel")))
    noise = -F.log(-F.log(F.greatest(drawn, F.lit(1e-16))))
    keyed = written(scored.withColumn("key", F.col("log_weight") + noise), "weights")
    k = round(keyed.count() * (share if share is not None else fine / n if n else 1.0))
    return largest(keyed, "key", k, ["id", "content"]).select(F.col("id").alias("doc_id"), "log_weight", "key")
