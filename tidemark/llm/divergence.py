"""How far the words of each source depart from its language and from its language's other sources.

A term is a run of letters A-Z, lower-cased, and of characters beyond ASCII. One translation of a
text's bytes lowers the letters and blanks everything else, a split gives the terms, and a Counter
for each document their frequencies. A task adds them up by (language, source, term), with the
number of documents, and hands on what it holds whenever that is ``held`` terms. The rest is
Spark's: counts are dealt by (language, term), so that one shuffle serves the sums, the number of
documents and a term's sources.

The sums over all terms of a language are sparse. Of two sources, only terms that both have are
joined; those that one has are summed from how many of its terms have each count, and those that
neither has are a constant times their number. All arithmetic is in whole numbers.

Defined results: null texts, languages and sources are empty; each row is a document, repeated
or not, with or without an id; a source without terms, or without a kept one, counts like any
other, and in a language without a kept term all pairs have value 0; texts of any length are
read whole; ties go to the item whose UTF-8 is less; an empty table gives an empty result; other
columns are ignored. A term's rows and a language's pairs grow with its number of sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import written
from tidemark.llm.words import text_parts

#: Letters to lower case, bytes beyond ASCII as they are, all others blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE, SALTS = 1_000_000_000, 64


def counted(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs) of docs (lang, source, text, none null), in part sums."""

    def batches(sums: dict[tuple, tuple[Counter, dict]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, more) in sums.items():
            terms, n = pa.array(list(docs), pa.binary()).cast(pa.string()), [k + more.get(t, 0) for t, k in docs.items()]
            columns = [pa.array([x] * len(n), pa.string()) for x in (lang, source)] + [terms, pa.array(n, pa.int64()), pa.array(docs.values(), pa.int64())]
            yield from pa.Table.from_arrays(columns, names=["lang", "source", "term", "n", "docs"]).to_batches(20_000)
        sums.clear()

    def summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, size = {}, 0
        for part, texts in text_parts(rows):
            for lang, source, text in zip(part["lang"].to_pylist(), part["source"].to_pylist(), texts, strict=True):
                own = Counter(text.translate(TABLE).split())
                docs, more = sums.setdefault((lang, source), (Counter(), {}))  # documents, and occurrences beyond the first of each
                size -= len(docs)
                docs.update(own.keys())
                size += len(docs)
                for term, n in own.items():
                    if n > 1:
                        more[term] = more.get(term, 0) + n - 1
            if size >= held:
                yield from batches(sums)
                size = 0
        yield from batches(sums)

    return docs.select("lang", "source", "text").mapInArrow(summed, "lang string, source string, term string, n long, docs long")


def _p(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (size + terms)); products may be beyond 64 bits."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (size + terms).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _top(values: DataFrame, most: int) -> DataFrame:
    """The first ``most`` items of each (lang, source); in shares by a hash of the item first, so that no task sorts a whole source."""
    order = [F.desc("value"), F.asc("item")]
    share = values.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    share = share.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("rank") <= most)
    return share.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= most)


def audited(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, held: int = 200_000) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the divergence from each other source of the language, part
    ``term`` the terms by which a source exceeds its language most.
    """
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    own = W.partitionBy("lang", "term")
    sums = counted(rows, held).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    first = (F.row_number().over(own.orderBy("source")) == 1).cast("long").alias("first")
    kept = sums.select("lang", "term", "source", "n", F.sum("n").over(own).alias("lang_n"), F.sum("docs").over(own).alias("docs"), first)
    kept = written(kept.where(F.col("docs") >= least_docs).drop("docs"), "terms")

    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.sum("first").alias("v"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.na.fill(0, ["size", "terms", "lang_size", "v"]), "groups")

    known = kept.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("size"), F.col("v")))
    excess = known.withColumn("q", _p(F.col("lang_n"), F.col("lang_size"), F.col("v"))).where("p > q")
    terms = _top(excess.select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value")), most_terms)

    # of two sources: terms of both, of one alone (by how many have each count), of neither; p0 is that of a term a source lacks
    p0 = _p(F.lit(0), F.col("size"), F.col("v"))
    side = lambda df, x: df.select(*(F.col(c).alias(c if c in ("lang", "term") else f"{c}_{x}") for c in df.columns))
    f = lambda p, q: _f(F.col(p), F.col(q))
    whole = lambda x: F.sum(x.cast("decimal(38,0)"))
    two_ways = lambda df, ab, ba: df.select("lang", F.inline(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.col(v).alias("x")) for x, y, v in (("source_a", "source_b", ab), ("source_b", "source_a", ba))))))
    more = lambda a, b: whole(f(f"p_{a}", f"p_{b}") - f(f"p_{a}", f"p0_{b}") - f(f"p0_{a}", f"p_{b}") + f(f"p0_{a}", f"p0_{b}"))
    own_p = known.withColumn("p0", p0).select("lang", "term", "source", "p", "p0")
    both = side(own_p, "a").join(side(own_p, "b"), ["lang", "term"]).where("source_a < source_b")
    both = both.groupBy("lang", "source_a", "source_b").agg(more("a", "b").alias("ab"), more("b", "a").alias("ba"))

    zero = groups.where("v > 0").select("lang", "source", "terms", p0.alias("p0"))
    counts = known.groupBy("lang", "source", "p").agg(F.count("*").cast("decimal(19,0)").alias("k"))
    one = side(counts, "a").join(side(zero, "b"), "lang").where("source_a <> source_b")
    one = one.groupBy("lang", "source_a", "source_b").agg(whole(F.col("k_a") * f("p_a", "p0_b").cast("decimal(19,0)")).alias("ab"), whole(F.col("k_a") * f("p0_b", "p_a").cast("decimal(19,0)")).alias("ba"))

    every = side(groups.select("lang", "source", "v", "terms", F.when(F.col("v") > 0, p0).alias("p0")), "a")
    every = every.join(side(groups.select("lang", "source", "terms", F.when(F.col("v") > 0, p0).alias("p0")), "b"), "lang").where("source_a <> source_b")
    neither = (F.col("v_a") - F.col("terms_a") - F.col("terms_b")).cast("decimal(19,0)") * f("p0_a", "p0_b").cast("decimal(19,0)")
    every = every.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.when(F.col("v_a") > 0, neither).cast("decimal(38,0)").alias("x"))

    sums = every.unionByName(two_ways(both, "ab", "ba")).unionByName(two_ways(one, "ab", "ba"))
    pairs = sums.groupBy("lang", "source", "item").agg(F.coalesce(whole(F.col("x")), F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))

    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionByName(named(terms, "term"))
