"""Passages that several documents share, found by content-defined chunks.

A passage is a stretch of words each of which is in a window of ``min_words`` words that
another document has as well; windows that overlap make one passage.

A gear hash rolls over a text's bytes; a chunk ends where it falls in a small range and
the chunk has a least size, so the cuts depend on the nearby bytes alone and come into
step again after an insertion. Chunks are compared by digest. Where shared chunks follow
each other and there are ``min_words`` words in them and beside them, as far as a shared
window can reach that has no further chunk in step, is a region. Only in regions are all
windows of words hashed and compared, which tells the passages word by word.

A cut is firm if no other place within LEAST bytes before it would do, and if it stands
REACH + LEAST bytes or more inside a window, every document that has the window has the
cut. A window with two firm cuts so has a chunk in step wherever it occurs. Windows with
fewer, as in text that repeats a few bytes or has very short words, are treated as chunks
of their own. So each window whose bytes another document repeats is found; where only the
white space between equal words differs, it is found if another chunk of it is shared.

Texts that are equal as a whole are told apart first: one of them takes part, and counts
as all of their ids. Digests and window hashes (64 bits) are counted by partial
aggregation, written, and joined back, so that what very many documents share is split
like any skewed join. Texts are only shuffled for documents with a region.

``repeated`` are the stretches of a passage whose windows a document with a smaller id
has, and ``without`` cuts them out; the first document keeps its words.

Defined results: a row with a null id, or a null or empty text, shares nothing and is left
as it is; rows with equal ids are one document, whose texts each have their own passages;
a repeat inside one document alone is no shared passage; a very long text is read as a
whole in one task, and its windows are rows; an empty table gives an empty result; other
columns are ignored here and kept by ``without``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm import words as wd
from tidemark.llm.common import for_texts, written
from tidemark.llm.words import mixed, numbers, text_parts

MIN_WORDS, MEAN, LEAST, REACH = 50, 32, 8, 16
_RANDOM = np.random.default_rng(3)
_GEAR = _RANDOM.integers(0, 1 << 16, 256, np.uint16)
_VALUES = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_GEAR[0] = _VALUES[0] = 0  # texts stand apart by NUL bytes
_BASE, _INVERSE = wd._BASE, wd._INVERSE
FILTER_BITS = 25


class Words:
    """Words of some texts, as places in their common buffer, and hashes of rows of them."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = data = np.frombuffer((bytes(REACH)).join([*texts, b""]), np.uint8)
        sizes = np.array([len(t) for t in texts])
        self.begin = np.cumsum(sizes + REACH) - sizes - REACH
        self.end = self.begin + sizes
        space = wd._SPACE[data] | (data == 0)
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        self.word_starts, self.word_ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.word_first, self.word_last = np.searchsorted(self.word_starts, self.begin), np.searchsorted(self.word_starts, self.end)
        self.terms = _VALUES[data] * wd._power(_BASE, len(data))

    def row_hashes(self, n: int) -> np.ndarray:
        """The hash of n words from each word on, of texts one after the other."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.terms, dtype=np.uint64)])
        own = mixed((sums[self.word_ends] - sums[self.word_starts]) * wd._power(_INVERSE, len(self.data) + 1)[self.word_starts])
        count = len(own)
        if count < n:
            return np.zeros(0, np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * wd._power(_BASE, count), dtype=np.uint64)])
        return mixed((sums[n:] - sums[:-n]) * wd._power(_INVERSE, count)[: count - n + 1] + np.uint64(n))

    def windows(self, n: int) -> np.ndarray:
        """Numbers of the words from which n words of one text follow."""
        counts = np.maximum(self.word_last - self.word_first - n + 1, 0)
        return np.repeat(self.word_first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


class Chunked(Words):
    """Chunks of some texts."""

    def __init__(self, texts: list[bytes]) -> None:
        super().__init__(texts)
        data = self.data
        h, width = _GEAR[data], 1
        while width < REACH:  # the hash of the last `width` bytes, doubled
            older = np.zeros_like(h)
            older[width:] = h[:-width] << np.uint16(width)
            h, width = h + older, 2 * width
        natural = np.union1d(np.flatnonzero(h < (1 << 16) // MEAN) + 1, self.begin)
        near = np.diff(natural, prepend=-LEAST) < LEAST
        near[np.searchsorted(natural, self.begin)] = False
        self.firm = natural[~near]
        taken, places = (~near).tolist(), natural.tolist()
        for k in np.flatnonzero(near).tolist():  # too near to the one before, unless that is left out
            j = k - 1
            while not taken[j]:
                j -= 1
            taken[k] = places[k] - places[j] >= LEAST
        starts = natural[np.array(taken, bool)]
        owner = np.searchsorted(self.begin, starts, "right") - 1
        inside = starts < self.end[owner]
        self.starts, owner = starts[inside], owner[inside]
        self.counts = np.bincount(owner, minlength=len(texts))
        self.first = np.cumsum(self.counts) - self.counts
        self.ends = np.append(self.starts[1:], 0)
        self.ends[(self.first + self.counts - 1)[self.counts > 0]] = self.end[self.counts > 0]
        begins = np.repeat(self.begin, self.counts)
        # of each chunk, how far before it a window can begin that has it as its first chunk in step
        far = self.firm[np.searchsorted(self.firm, self.starts, "right") - 1] - REACH - LEAST if len(self.starts) else self.starts
        self.back = np.maximum(np.concatenate([[0], far[:-1]])[: len(far)].astype(np.int64), begins)
        if len(self.starts):
            sums = np.add.reduceat(self.terms, self.starts) * wd._power(_INVERSE, len(data))[self.starts]
            self.digests = mixed(sums + (self.ends - self.starts).astype(np.uint64) * np.uint64(_INVERSE))
        else:
            self.digests = np.zeros(0, np.uint64)

    def words_around(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, word after the last) that a window can have of which a chunk is the first or the last in step."""
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        after = np.append(self.ends[1:], 0)
        after[(self.first + self.counts - 1)[self.counts > 0]] = self.end[self.counts > 0]
        first = self.word_first[owner]
        return np.searchsorted(self.word_starts, self.back) - first, np.searchsorted(self.word_starts, after) - first

    def unsure(self, n: int) -> np.ndarray:
        """Windows of n words that may have no chunk in step with another document's."""
        at = self.windows(n)
        cuts = np.searchsorted(self.firm, self.word_ends[at + n - 1], "right") - np.searchsorted(self.firm, self.word_starts[at] + REACH + LEAST)
        return at[cuts < 2]


PLACES = "digest long, id long, text_hash long, nth int, lo int, hi int"
PLACE_NAMES = [x.split()[0] for x in PLACES.split(", ")]


def chunks(docs: DataFrame, min_words: int = MIN_WORDS, wanted: Broadcast | None = None) -> DataFrame:
    """(digest, id, text_hash, nth, lo, hi) of docs (id, text_hash, text): a row for each chunk, and for each unsure window (nth: -1).

    lo to hi are the numbers of the words that a window can have around the chunk. With
    wanted, the bits of a filter, rows that it rules out are left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part in text_parts(batches):
            c = Chunked(part)
            lo, hi = c.words_around()
            nth = np.arange(len(lo)) - np.repeat(c.first, c.counts)
            at = c.unsure(min_words)
            of = np.searchsorted(c.word_first, at, "right") - 1
            digests = np.concatenate([c.digests, c.row_hashes(min_words)[at]])
            owner = np.concatenate([np.repeat(np.arange(len(part)), c.counts), of])
            begin = at - c.word_first[of]
            nth, lo, hi = (np.concatenate(x) for x in ((nth, np.full(len(at), -1)), (lo, begin), (hi, begin + min_words)))
            if wanted is not None:
                bit = digests >> np.uint64(64 - FILTER_BITS)
                keep = np.flatnonzero((wanted.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                digests, owner, nth, lo, hi = (x[keep] for x in (digests, owner, nth, lo, hi))
            ids, hashes = (numbers(own, n)[owner] for n in ("id", "text_hash"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digests.view(np.int64), ids, hashes, *(x.astype(np.int32) for x in (nth, lo, hi)))], PLACE_NAMES)

    return for_texts(docs).select("id", "text_hash", "text").mapInArrow(rows, PLACES)


def filter_of(digests: DataFrame) -> np.ndarray:
    """A bit for each value of the digests' first bits: 4 MB, however many digests there are.

    It only spares rows a shuffle; the join with the digests themselves decides.
    """
    at = F.shiftrightunsigned("digest", 64 - FILTER_BITS)
    words = digests.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def regions(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, text_hash, regions: array of (lo, hi)): word numbers between which there may be shared windows."""
    shared = chunks(docs, min_words).groupBy("digest").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("digest")
    shared = written(shared, "shared")
    wanted = docs.sparkSession.sparkContext.broadcast(filter_of(shared))
    hits = written(chunks(docs, min_words, wanted).join(shared, "digest", "left_semi").drop("digest"), "hits")
    island = F.col("nth") - F.dense_rank().over(W.partitionBy("id", "text_hash").orderBy("nth"))  # of repeated rows, chunks occur again
    runs = hits.where("nth >= 0").withColumn("island", island).groupBy("id", "text_hash", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = runs.drop("island").unionByName(hits.where("nth < 0").select("id", "text_hash", "lo", "hi")).where(F.col("hi") - F.col("lo") >= min_words)
    return found.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("regions"))


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, id, last, text_hash, nth, start, end) of docs (id, last, text_hash, text, regions): a row for each window of words in a region, with its place in bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part in text_parts(batches):
            c = Words(part)
            spans = [(k, r["lo"], r["hi"]) for k, found in enumerate(own.column(own.schema.get_field_index("regions")).to_pylist()) for r in found]
            k, lo, hi = np.array(spans, np.int64).reshape(-1, 3).T
            lo, hi = lo + c.word_first[k], np.minimum(hi + c.word_first[k], c.word_last[k])
            inside = np.zeros(len(c.word_starts) + 1, np.int64)  # how many regions a window can begin in
            fits = hi - lo >= min_words
            np.add.at(inside, lo[fits], 1)
            np.add.at(inside, (hi - min_words + 1)[fits], -1)
            at = np.flatnonzero(np.cumsum(inside) > 0)
            of = np.searchsorted(c.word_first, at, "right") - 1
            begin = c.begin[of]
            places = (at - c.word_first[of], c.word_starts[at] - begin, c.word_ends[at + min_words - 1] - begin)
            columns = [c.row_hashes(min_words)[at].view(np.int64), *(numbers(own, n)[of] for n in ("id", "last", "text_hash")), *(x.astype(np.int32) for x in places)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "id", "last", "text_hash", "nth", "start", "end"])

    return docs.mapInArrow(rows, "key long, id long, last long, text_hash long, nth int, start int, end int")


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, start, end, n_words, repeated: array of (start, end)): a row for each passage, in bytes of its text.

    text_hash is xxhash64 of the text, which tells rows with equal ids apart.
    """
    rows = docs.where(F.col(id_col).isNotNull() & (F.octet_length(text_col) > 0)).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )
    texts = rows.select("id", "text_hash", F.xxhash64(F.lit(1), "text").alias("again"))
    same = ["text_hash", "again"]
    classes = written(texts.groupBy(same).agg(F.min("id").alias("head"), F.max("id").alias("last")), "classes")
    heads = classes.select(F.col("head").alias("id"), "text_hash", "last")
    found = rows.join(regions(rows, min_words).join(heads, ["id", "text_hash"]), ["id", "text_hash"])
    all_windows = written(windows(found, min_words), "windows")
    shared = written(all_windows.groupBy("key").agg(F.min("id").alias("least"), F.max("last").alias("most")).where("least < most").select("key", "least"), "shared")
    text = W.partitionBy("id", "text_hash").orderBy("nth")
    is_new = lambda at: (at.isNull() | (F.col("nth") - at >= min_words)).cast("int")
    placed = (
        all_windows.join(shared, "key")
        .select("id", "text_hash", "nth", "start", "end", (F.col("least") < F.col("id")).alias("later"))
        .withColumn("before", F.lag("nth").over(text))
        .withColumn("before_later", F.last(F.when(F.col("later"), F.col("nth")), ignorenulls=True).over(text.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("passage", F.sum(is_new(F.col("before"))).over(text.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("stretch", F.when(F.col("later"), F.sum(F.when(F.col("later"), is_new(F.col("before_later"))).otherwise(0)).over(text.rowsBetween(W.unboundedPreceding, 0))))
    )
    of_text = ["id", "text_hash", "passage"]
    stretches = placed.groupBy(*of_text, "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("nth").alias("first"), F.max("nth").alias("final"))
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    passages = stretches.groupBy(of_text).agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), (F.max("final") - F.min("first") + min_words).alias("n_words"),
        F.sort_array(F.collect_list(F.when(F.col("stretch").isNotNull(), span))).alias("repeated"),
    )
    passages = written(passages.drop("passage").withColumnRenamed("id", "doc_id"), "passages")
    # of equal texts, all but the first repeat it as a whole
    whole = passages.join(heads.where("last > id").select(F.col("id").alias("doc_id"), "text_hash"), ["doc_id", "text_hash"])
    whole = written(whole.select(F.col("doc_id").alias("head"), "text_hash", "start", "end", "n_words"), "whole")
    several = classes.where("last > head")
    copies = texts.distinct().join(several, same).where("id > head").join(whole, ["head", "text_hash"])
    return passages.unionByName(copies.select(F.col("id").alias("doc_id"), "text_hash", "start", "end", "n_words", F.array(F.struct("start", "end")).alias("repeated")))


def kept(text: Column, cut: Column) -> Column:
    """text without the stretches of cut: disjoint (start, end) in bytes, at word edges, in order."""
    raw = text.cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda s: s["end"]))
    ends = F.concat(F.transform(cut, lambda s: s["start"]), F.array(F.length(raw).cast("long")))
    piece = lambda a, z: F.substring(raw, (a + 1).cast("int"), (z - a).cast("int")).cast("string")
    return F.array_join(F.zip_with(begins, ends, piece), "")


def without(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated stretches of passages cut out of their texts; all columns are kept."""
    spans = passages.where(F.size("repeated") > 0).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.array_sort(F.flatten(F.collect_list("repeated"))).alias("__cut"))
    both = docs.join(spans, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left")
    return both.withColumn(text_col, F.when(F.col("__cut").isNotNull(), kept(F.col(text_col), F.col("__cut"))).otherwise(F.col(text_col))).select(*docs.columns)
