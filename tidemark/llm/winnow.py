"""Document fingerprints by winnowing.

Words (runs of other than white space) are hashed, every run of ``k`` words gets a rolling
hash built from those of its halves, and of every window of ``w`` runs the least hash is
chosen, the rightmost of equal ones, with its position. Two texts that share a run of
w + k - 1 words share a chosen hash. Word runs rather than character runs keep the work
linear in native column functions, since a position in a UTF-8 string is found by reading
it from its start.

All steps are array functions inside one row; a text is never split over rows. The next
document is found by ranges of ids: rows meet their neighbour in one sorted range, and the first row
of each range is sent to the range before as well, as its end.

Defined results: a null text is an empty one; a text of fewer than k words has one hash of
all of its words, and of none, no hash; two fingerprints without hashes are alike (1.0);
equal ids follow each other in the order of their texts; null ids come first; a single
row is its own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

K, WINDOW = 4, 8
_POSITION_BITS = 31


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body reads it for every element."""
    return F.transform(F.array(value), body)[0]


def pairs(values: Column, gap: int, join) -> Column:
    """join(v[i], v[i + gap]) for every i that has both."""

    def zipped(v: Column) -> Column:
        n = F.greatest(F.size(v) - gap, F.lit(0))
        return F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(gap + 1), n), join)

    return let(values, zipped)


def chosen(text: Column, k: int = K, w: int = WINDOW) -> Column:
    """array<long> of the chosen hashes in order, each hash * 2^31 + (2^31 - 1 - position).

    k and w are powers of two: hashes and minima of runs are built by doubling. As the
    position counts down, the least number is that of the rightmost of equal hashes.
    """
    if k & (k - 1) or w & (w - 1):
        raise ValueError("k and w must be powers of two")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")

    def runs(h: Column) -> Column:
        step, out = 1, h
        while step < k:
            out = pairs(out, step, lambda a, b: F.xxhash64(a, b))
            step *= 2
        return F.when(F.size(h) >= k, out).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(out)

    def placed(h: Column) -> Column:
        top = F.lit((1 << _POSITION_BITS) - 1)
        return F.transform(h, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 64 - 32), _POSITION_BITS).bitwiseOR(top - i))

    def least(v: Column) -> Column:
        size = F.size(v)
        step, out = 1, v
        while step < w:
            out = pairs(out, step, lambda a, b: F.least(a, b))
            step *= 2
        return F.when(size >= w, F.array_distinct(out)).when(size > 0, F.array(F.array_min(v))).otherwise(v)

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(placed(runs(h)), least))


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda v: F.shiftrightunsigned(v, _POSITION_BITS)))


def positions(fp: Column) -> Column:
    return F.transform(fp, lambda v: F.lit((1 << _POSITION_BITS) - 1) - v.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))


def digest(fp: Column) -> Column:
    """16 hex digits of hashes and positions."""
    return F.lower(F.lpad(F.hex(F.xxhash64(fp)), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / F.greatest(every, F.lit(1)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WINDOW) -> DataFrame:
    """(doc_id, hashes: array<long>, positions: array<long>) of every row."""
    fp = docs.select(F.col(id_col).alias("doc_id"), chosen(F.col(text_col), k, w).alias("fp"))
    return fp.select("doc_id", F.transform("fp", lambda v: F.shiftrightunsigned(v, _POSITION_BITS)).alias("hashes"), positions(F.col("fp")).alias("positions"))


def with_next(docs: DataFrame, order: list[str], columns: list[str], ranges: int) -> DataFrame:
    """Adds next_<column> of the following row by order; of the first row for the last.

    order[0] is a number; its quantiles cut the rows into ranges, each sorted in one task.
    """
    key = order[0]
    cuts = docs.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>")
    part = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c < F.col(key).cast("double"))))
    rows = docs.withColumn("part", part.cast("int"))
    # the first row of each range, found by its id, also ends the range before; that of the first range ends the last
    least = rows.groupBy("part").agg(F.min(key).alias("least"))
    first = rows.join(F.broadcast(least.withColumnRenamed("part", "own")), (F.col("part") == F.col("own")) & F.col(key).eqNullSafe(F.col("least")))
    heads = first.groupBy("part").agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("head"))
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = heads.select(F.coalesce(F.lag("part").over(W.orderBy("part")), F.last("part").over(every)).alias("part"), "head.*")
    both = rows.withColumn("end", F.lit(False)).unionByName(ends.withColumn("end", F.lit(True)), allowMissingColumns=True)
    own = W.partitionBy("part").orderBy("end", *order)
    return both.withColumns({f"next_{c}": F.lead(c).over(own) for c in columns}).where("not end").drop("end", "part")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = WINDOW, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first
    ones of the next document. Returns (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).
    """
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(rows, ["doc_id", "text"], ["text"], ranges)
    changed = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    fp = rows.withColumn("changed", changed).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"),
        chosen(F.col("text"), k, w).alias("fp"), chosen(F.col("changed"), k, w).alias("changed_fp"), chosen(F.col("next_text"), k, w).alias("next_fp"),
    )
    sets = fp.withColumns({c: hashes(F.col(f)) for c, f in (("a", "fp"), ("b", "changed_fp"), ("c", "next_fp"))})
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("fp")).alias("fingerprint"), digest(F.col("changed_fp")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
