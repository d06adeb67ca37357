"""Benchmark items inside documents, by size-partitioned MinHash and exact containment.

An item is found in a document if at least ``threshold`` of its distinct word shingles
occur there. A short item makes up little of a long document, so their sketches would
hardly ever agree. So items are partitioned by their number of shingles into sizes S that
double, and for each S a document is cut into blocks of S shingles; wherever an item of
that partition stands, two neighbouring blocks hold it, and it is a quarter of them or
more (less what the threshold lets go). A sketch is the least value of each of many
hash functions; a pair whose sketches share a value is a candidate, and its containment is
then counted on the words themselves. With 64 functions, an item that stands whole in a
document is missed with a chance of about 1e-8, one at the threshold of about 1e-5.
Items of so few shingles that their share could be smaller are looked up by each shingle.

Documents are never shuffled. The items go to all tasks in blocks of a bounded size in
bytes: each block is one pass over the documents' texts, whose result is written before the
next block is read, so neither the driver nor a task holds more than one block's index.

Defined results: words are lower-cased in A-Z and split at space and \\x09-\\x0D; a
null or empty text, of an item or a document, has no shingles and matches nothing; an item
of fewer words than a shingle is one shingle of all its words; repeated rows are matched
each; null ids are kept; very long texts are read as a whole; without items, or without
documents, nothing is found; other columns of both tables are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import for_texts, written
from tidemark.llm.words import hashed_words, in_parts, shingle_hashes

WORDS, THRESHOLD, FUNCTIONS, LEAST, BLOCK_BYTES = 5, 0.8, 64, 8, 4 << 20
_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(0, 1 << 63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, FUNCTIONS, np.uint64)


def shingles(text: bytes, size: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


class Items:
    """Index of a bounded block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int, threshold: float) -> None:
        self.size, self.threshold = size, threshold
        self.ids, self.sets, self.lengths = [], [], []
        keys: dict[int, list] = defaultdict(list)
        direct: dict[int, list] = defaultdict(list)
        for item_id, text in items:
            raw = (text or "").encode("utf-8", "surrogatepass")
            n = min(size, len(raw.split()))
            if not n:
                continue
            k = len(self.ids)
            own = shingles(raw, n)
            self.ids.append(item_id)
            self.sets.append(own)
            self.lengths.append(n)
            h = np.unique(shingle_hashes(*hashed_words([raw]), n)[0])
            if n < size or len(h) <= LEAST // 2:
                direct[n] += [(x, k) for x in h.tolist()]
            else:
                s = LEAST
                while s < len(h):
                    s *= 2
                keys[s] += [(v, k) for v in (np.array([(h * a).min() for a in _FACTORS]) + _OFFSETS).tolist()]
        self.tables = {s: self.table(x) for s, x in keys.items()}
        self.direct = {n: self.table(x) for n, x in direct.items()}

    @staticmethod
    def table(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs.sort()
        values = np.array([v for v, _ in pairs], np.uint64)
        bits = np.zeros(1 << 20, bool)
        bits[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return values, np.array([k for _, k in pairs]), bits

    @staticmethod
    def lookup(table: tuple, values: np.ndarray, docs: np.ndarray) -> set[tuple[int, int]]:
        keys, items, bits = table
        at = np.flatnonzero(bits[(values & np.uint64((1 << 20) - 1)).astype(np.int64)])
        values, docs = values[at], docs[at]
        lo, hi = np.searchsorted(keys, values), np.searchsorted(keys, values, "right")
        return {(int(docs[i]), int(items[j])) for i in np.flatnonzero(hi > lo) for j in range(lo[i], hi[i])}

    def candidates(self, texts: list[bytes]) -> set[tuple[int, int]]:
        words, counts = hashed_words(texts)
        found: set[tuple[int, int]] = set()
        for n, table in self.direct.items():
            h, own = shingle_hashes(words, counts, n)
            found |= self.lookup(table, h, np.repeat(np.arange(len(texts)), own))
        h, own = shingle_hashes(words, counts, self.size)
        if not self.tables or not len(h):
            return found
        blocks = -(-own // LEAST)
        doc = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(np.cumsum(own) - own, blocks) + nth * LEAST
        least = np.empty((FUNCTIONS, len(starts)), np.uint64)
        for j, a in enumerate(_FACTORS):
            np.minimum.reduceat(h * a, starts, out=least[j])
        s, largest = LEAST, max(self.tables)
        while True:
            if s in self.tables:
                two = least.copy()
                same = np.flatnonzero(doc[1:] == doc[:-1])
                two[:, same] = np.minimum(least[:, same], least[:, same + 1])
                two += _OFFSETS[:, None]
                for row in two:
                    found |= self.lookup(self.tables[s], row, doc)
            if s == largest:
                return found
            even = np.flatnonzero(nth % 2 == 0)
            least = np.minimum.reduceat(least, even, axis=1)
            doc, nth, s = doc[even], nth[even] // 2, s * 2

    def search(self, texts: list[bytes]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        seen: dict[tuple[int, int], set[bytes]] = {}
        for doc, k in sorted(self.candidates(texts)):
            if (own := seen.get((doc, self.lengths[k]))) is None:
                seen = {(doc, self.lengths[k]): (own := shingles(texts[doc], self.lengths[k]))}
            hits = len(self.sets[k] & own)
            if hits >= self.threshold * len(self.sets[k]):
                out[doc].append({"item_id": self.ids[k], "n_shingles": len(self.sets[k]), "n_found": hits})
        return out


def blocks_of(benchmark: DataFrame, id_col: str, item_col: str, block_bytes: int) -> Iterator[Broadcast]:
    """The items in blocks of about block_bytes, one at a time."""
    own = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(item_col).alias("t"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        sent = benchmark.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in rows])
        yield sent
        sent.unpersist()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_col: str = "text",
    size: int = WORDS, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): a row for each item found in each document."""
    rows = for_texts(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = []
    for index in blocks_of(benchmark, item_id_col, item_col, block_bytes):

        def matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            items = Items(index.value, size, threshold)  # noqa: B023 (run before the next block)
            for b in batches:
                hits = [(i, *h.values()) for i, own in zip(b["id"], (x for part in in_parts(b["text"]) for x in items.search(part)), strict=True) for h in own]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "n_shingles", "n_found"])

        found.append(written(rows.mapInPandas(matches, "doc_id long, item_id long, n_shingles int, n_found int"), "contaminated"))
    return reduce(DataFrame.unionByName, found).withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_col: str = "text",
    size: int = WORDS, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    left = for_texts(docs)
    for index in blocks_of(benchmark, item_id_col, item_col, block_bytes):

        def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            items = Items(index.value, size, threshold)  # noqa: B023
            for texts in batches:
                yield pd.Series([bool(x) for part in in_parts(texts) for x in items.search(part)], dtype=bool)

        left = written(left.where(~F.pandas_udf(holds, "boolean")(F.col(text_col))), "clean")
    return left
