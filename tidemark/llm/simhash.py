"""Near-duplicate documents by SimHash fingerprints that BK-trees link.

A fingerprint has 64 bits. The bits are cut into blocks; two fingerprints that differ in
at most ``radius`` bits agree on all of some ``blocks - radius`` blocks, so every choice
of that many blocks deals the fingerprints into shards, and two near ones meet in a shard.
Each shard holds its fingerprints in a BK-tree, whose children are keyed by their Hamming
distance to the parent; a search follows only the edges within the radius. A tree has a
bounded number of nodes: the fingerprints of a larger shard are dealt again, by blocks of the
bits that are left; where that leaves too many, the shard becomes several trees, and each of
its fingerprints is sent to the others as a query. Trees meet their queries by shuffle: all
trees together grow with the corpus, so no bound holds that would let them be broadcast. A tree's task emits a spanning forest of
what it links, never all pairs; the components are then found over all shards.

Defined results: a null text is an empty one; an empty text (no words) has fingerprint
zero and is linked like any other; repeated rows share a fingerprint; a row with a null id
takes the component of its fingerprint (null if no row of that has an id); an empty table
gives an empty result; other columns are ignored.

``similar`` finds what the narrow radius can't: documents whose sets of five-word shingles
have a Jaccard similarity of 0.8 or more, verified on the sets. There the shards are dealt
by bands of minima of the shingles' hashes, and their BK-trees hold fingerprints of 256
bits. Two sets at 0.8 meet in a shard with a probability of 0.9996, and differ by more than
64 bits, more than four deviations from the mean of 39, in about one case of 100,000.
Equal rules hold for nulls, empty texts, repeated rows and null ids; a text of fewer than
five words has one shingle.
"""


from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, for_texts, written
from tidemark.llm.words import hashed_words, mixed, numbers, shingle_hashes, text_parts

SHINGLE_WORDS, SEED, BITS = 3, 42, 64
SIMILAR_WORDS, LEAST, BANDS, ROWS, WIDE, WIDE_RADIUS = 5, 0.8, 20, 5, 256, 64
TREE_SHINGLES = 1 << 21
_RANDOM = np.random.default_rng(8)
_TURNS, _FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64), _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_WIDE_TURNS = _RANDOM.integers(0, 1 << 63, WIDE // 64, np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of the UTF-8 of a whole text.

    bytes.lower() changes A-Z only, bytes.split() splits at space and \\x09-\\x0D only.
    """
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp: long, the fingerprint's bits) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_parts(batches):
            fp = np.fromiter((fingerprint(t, size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return for_texts(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, "id long, fp long")


class BKTree:
    """Fingerprints by Hamming distance to their parent."""

    def __init__(self) -> None:
        self.root: tuple[int, int, dict] | None = None

    def add(self, fp: int, item: int) -> None:
        if self.root is None:
            self.root = (fp, item, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ fp).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = (fp, item, {})
                return
            node = child

    def near(self, fp: int, radius: int) -> Iterator[int]:
        """Items within radius; only children whose key is within radius of this distance can hold one."""
        stack = [self.root] if self.root else []
        while stack:
            own, item, children = stack.pop()
            d = (own ^ fp).bit_count()
            if d <= radius:
                yield item
            if children:
                if len(children) <= 2 * radius:
                    stack += [c for k, c in children.items() if d - radius <= k <= d + radius]
                else:
                    stack += [children[k] for k in range(d - radius, d + radius + 1) if k in children]


def forest(fps: list[int], members: list[bool], radius: int) -> list[tuple[int, int]]:
    """Links (i, root of i) that join what a tree of the members finds near any of fps."""
    tree, up = BKTree(), list(range(len(fps)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, (fp, member) in enumerate(zip(fps, members, strict=True)):
        if member:
            tree.add(fp, i)
    for i, fp in enumerate(fps):
        a = root(i)
        for j in tree.near(fp, radius):
            b = root(j)
            if a != b:
                up[max(a, b)] = a = min(a, b)
    return [(i, r) for i in range(len(fps)) if (r := root(i)) != i]


def shard_masks(radius: int, blocks: int, within: int = 0) -> list[int]:
    """A mask for each choice of blocks - radius blocks of the bits that within leaves, together with it; as signed 64-bit numbers."""
    free = [i for i in range(BITS) if not (within >> i) & 1]
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) | within & ((1 << BITS) - 1) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def sharded(nodes: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(choice, key, n, fp, rep) of nodes (fp, rep, within): every row in the shard of each (within, mask), with n, the number of its fingerprints.

    Shards of one fingerprint are left out. The counts are a table, so that adaptive execution can split a shard with very many rows.
    """
    choices = F.array(*(F.struct(F.lit(i).alias("choice"), F.lit(w).alias("own"), F.lit(m).alias("mask")) for i, (w, m) in enumerate(masks)))
    keyed = nodes.select("fp", "rep", F.explode(F.filter(choices, lambda c: c["own"] == F.col("within"))).alias("m"))
    keyed = keyed.select("fp", "rep", F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    sizes = written(keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    return keyed.join(sizes, ["choice", "key"])


def dealt_trees(nodes: DataFrame, radius: int = 3, blocks: int = 5, tree_size: int = 4096) -> DataFrame:
    """(choice, key, tree, fp, rep, member): the rows of all trees.

    The fingerprints of a shard of more than tree_size are dealt again, by choices of
    blocks of the bits on which they may still differ. Only a shard that is too large even
    then becomes ceil(n / tree_size) trees; a fingerprint is a member of one and a query to
    those after it, so all of the shard's pairs are met.
    """
    first = [(0, m) for m in shard_masks(radius, blocks)]
    shards = sharded(nodes.select("fp", "rep", F.lit(0).cast("long").alias("within")), first)
    mask_of = F.array(*(F.lit(m).cast("long") for _, m in first))
    crowded = written(shards.where(F.col("n") > tree_size).select("fp", "rep", mask_of[F.col("choice")].alias("within")), "crowded")
    again = sharded(crowded, [(m, finer) for _, m in first for finer in shard_masks(radius, blocks, m)])
    every = shards.where(F.col("n") <= tree_size).unionByName(again.withColumn("choice", F.col("choice") + len(first)))
    return (
        every.withColumn("trees", F.ceil(F.col("n") / tree_size).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
        .withColumn("tree", F.explode(F.sequence("own", F.col("trees") - 1)))
        .select("choice", "key", "tree", "fp", "rep", (F.col("tree") == F.col("own")).alias("member"))
    )


def links(nodes: DataFrame, radius: int = 3, blocks: int = 5, tree_size: int = 4096) -> DataFrame:
    """(u, v): links that join all of nodes (fp: long, distinct; rep: long) within radius bits.

    No task holds more than a tree and a batch of queries of its sort order.
    """
    dealt = dealt_trees(nodes, radius, blocks, tree_size)
    keys = ["choice", "key", "tree"]

    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by tree, members first; the rows of a tree may span batches."""
        held: list[pd.DataFrame] = []

        def out(part: pd.DataFrame) -> pd.DataFrame:
            cuts = np.flatnonzero((part[keys].to_numpy()[1:] != part[keys].to_numpy()[:-1]).any(axis=1)) + 1
            fps, reps, members = part["fp"].to_numpy().view(np.uint64).tolist(), part["rep"].tolist(), part["member"].tolist()
            found = []
            for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
                found += [(reps[a + i], reps[a + j]) for i, j in forest(fps[a:b], members[a:b], radius)]
            return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

        for b in batches:
            if b.empty:
                continue
            last = (b[keys] == b[keys].iloc[-1]).all(axis=1).to_numpy()
            first = int(np.argmax(last))
            if first == 0 and held and (held[-1][keys].iloc[-1] == b[keys].iloc[0]).all():
                held.append(b)
                continue
            yield out(pd.concat([*held, b.iloc[:first]])) if held or first else pd.DataFrame({"u": [], "v": []}, dtype="int64")
            held = [b.iloc[first:]]
        if held:
            yield out(pd.concat(held))

    return dealt.repartition(*keys).sortWithinPartitions(*keys, F.desc("member")).mapInPandas(forests, "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, radius: int = 3, blocks: int = 5, tree_size: int = 4096
) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id: the smallest id reachable) of every row."""
    own = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("id").alias("rep"))
    found = components(links(nodes.where("rep is not null"), radius, blocks, tree_size))
    classes = nodes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(classes, "fp", "left").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles: none without words, one with fewer words than size."""
    words, counts = hashed_words(texts)
    shingles, own = shingle_hashes(words, counts, size)
    for t, n, shorter in zip(texts, np.split(shingles, np.cumsum(own)[:-1]), (own == 0) & (counts > 0), strict=True):
        yield np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().split()), SEED)], np.uint64) if shorter else np.unique(n)


def set_digest(shingles: np.ndarray) -> int:
    """A signed 64-bit number for a set."""
    return int(mixed(mixed(shingles + np.uint64(1)).sum(dtype=np.uint64)[None] + np.uint64(len(shingles))).view(np.int64)[0])


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of minima; two sets of Jaccard j share one with a probability of j ** ROWS."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1 << 11):
        least = np.minimum(least, ((shingles[i : i + (1 << 11), None] ^ _TURNS) * _FACTORS).min(axis=0))
    rows = mixed(least).reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = mixed(keys ^ rows[:, j]) + np.uint64(j)
    return keys.view(np.int64)


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """The SimHash of a set, of WIDE bits."""
    ones = np.zeros(WIDE, np.int64)
    for i in range(0, len(shingles), 1 << 14):
        part = mixed(shingles[i : i + (1 << 14), None] ^ _WIDE_TURNS).astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(shingles), bitorder="little").tobytes()


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of least or more."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return False
    both = int((b[np.minimum(b.searchsorted(a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both)


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIMILAR_WORDS, least: float = LEAST, radius: int = WIDE_RADIUS, tree_size: int = 4096
) -> DataFrame:
    """(doc_id, component_id: the smallest id reachable over pairs of Jaccard least or more) of every row.

    Sets of shingles are only shuffled for documents that share a band with another set. A
    shard becomes as many trees as bound their members and those members' shingles; the
    queries of a tree pass through its task one by one.
    """
    rows = for_texts(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_parts(batches):
            found = [(set_digest(s), len(s), band_keys(s) if len(s) else []) for s in shingle_sets(texts, size)]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "digest", "size", "bands"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_parts(batches):
            found = [(d, wide_fingerprint(s), s.tobytes()) for d, s in zip(numbers(b, "digest").tolist(), shingle_sets(texts, size), strict=True) if set_digest(s) == d]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["digest", "fp", "shingles"])

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by tree, members first; the rows of a tree may span batches."""
        now, tree, sets, reps, up = None, BKTree(), {}, {}, []

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for b in batches:
            out = []
            for key, number, member, rep, fp, raw in zip(b["key"], b["tree"], b["member"], b["rep"], b["fp"], b["shingles"], strict=True):
                if (key, number) != now:
                    now, tree, sets, reps, up = (key, number), BKTree(), {}, {}, []
                bits, own, i = int.from_bytes(fp, "little"), np.frombuffer(raw, np.uint64), len(up)
                up.append(i)
                for j in tree.near(bits, radius):
                    r = root(j)
                    if r != root(i) and alike(own, sets[j], least):
                        up[root(i)] = r
                        out.append((rep, reps[j]))
                if member:
                    tree.add(bits, i)
                    sets[i], reps[i] = own, rep
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    own = written(rows.mapInArrow(banded, "id long, digest long, size int, bands array<long>"), "bands")
    nodes = own.groupBy("digest").agg(F.min("id").alias("rep")).where("rep is not null")
    keyed = own.withColumnRenamed("id", "rep").join(nodes, ["digest", "rep"], "left_semi").select("digest", "rep", "size", F.explode("bands").alias("key"))
    crowded = (
        keyed.groupBy("key")
        .agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.greatest(F.ceil(F.sum("size") / TREE_SHINGLES), F.ceil(F.count("*") / tree_size)).cast("int").alias("trees"))
        .where("a < b")
        .select("key", "trees")
    )
    hits = written(keyed.join(crowded, "key").select("key", "digest", "rep", "trees"), "hits")
    wanted = hits.select("digest", "rep").distinct()
    sets = written(rows.join(wanted, F.col("id") == F.col("rep")).select("digest", "text").mapInArrow(held, "digest long, fp binary, shingles binary").dropDuplicates(["digest"]), "sets")
    dealt = (
        hits.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("trees")).cast("int"))
        .withColumn("tree", F.explode(F.sequence("own", F.col("trees") - 1)))
        .join(sets, "digest")
        .select("key", "tree", (F.col("tree") == F.col("own")).alias("member"), "rep", "fp", "shingles")
    )
    links = dealt.repartition("key", "tree").sortWithinPartitions("key", "tree", F.desc("member")).mapInPandas(linked, "u long, v long")
    found = components(links)
    classes = nodes.join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return own.join(classes, "digest", "left").select(F.col("id").alias("doc_id"), "component_id")
