"""A corpus cleaned and encoded in five stages, each written as Parquet and read by the next.

1. language: drops documents whose language can't be told (no letter, or a score below 0.4).
2. near_duplicates: keeps one document of each group of five-word Jaccard 0.8 or more, that
   with the smallest id; of rows with that id, one.
3. shared_passages: cuts out passages of 50 words or more that a document with a smaller id
   has as well; a document of which nothing is left goes.
4. decontamination: drops documents that hold a benchmark item.
5. encoding: byte-level BPE of what is left, decoded again.

All but the last return the columns of documents. A row with a null id is in no group and
shares no passage, so stages 2 and 3 leave it as it is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, contamination, langid, passages, simhash
from tidemark.llm.common import table, written

LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    p = langid.predicted(langid.fitted(rows), F.col("text"))
    return docs.withColumn("__p", p).where((F.col("__p.lang") != "und") & (F.col("__p.score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with one id, which are one document, that with the least hash of its text, then of all columns, stays."""
    found = written(simhash.similar(docs), "groups")
    known = docs.where("doc_id is not null")
    marks = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("component_id") != F.col("doc_id")).alias("__goes"), (F.count("*") > 1).alias("__several"))
    marks = written(marks.where("__goes or __several"), "marks")
    once = known.join(marks, "doc_id", "left_anti")
    row = F.struct(*docs.columns)
    several = known.join(marks.where("not __goes"), "doc_id").groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))).alias("__row"))
    return docs.where("doc_id is null").unionByName(once.select(*docs.columns)).unionByName(several.select("__row.*").select(*docs.columns))


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = docs.withColumn("__length", F.length("text"))
    cut = passages.without(before, passages.shared_passages(docs))
    changed = F.col("__length") != F.length("text")
    left = cut.where(~F.coalesce(changed & (F.trim("text") == ""), F.lit(False)))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("shared_passages", shared_passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Hashes, trained weights and tokens can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
