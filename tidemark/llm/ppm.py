"""Documents scored by prediction by partial matching over bytes, and by word counts.

The model is a byte-context trie of order ``ORDER``: how often each byte followed each
context of up to so many bytes in the training documents. A text's probability is the
product over its bytes and an end mark. At a context, a byte that followed it n times has
(2 n - 1) / (2 total); otherwise distinct / (2 total) is the escape to the next shorter
context, where the bytes just seen are excluded from both counts. Below the empty
context, bytes that never occurred are equally likely.

The trie grows with the corpus, so no task holds it. Documents are dealt into blocks of a
bounded size by a hash of the id and text. A block lists its distinct (context, byte) runs
and words with their training counts, as sorted arrays for each of several parts; runs are
dealt to parts by their last three context bytes, words by their hash. A part adds up what
all blocks hold, works out the log probability of each run, and answers each block in its
own order; the blocks are then read again and scored. The number of parts follows from the
bytes of text, so that what a part reads is bounded but for the most frequent three bytes.
Only the counts of three bytes in a row, which no corpus can have more than 256 ** 3 of and
text has some hundred thousands of, are the same for all and are broadcast.

Words are told apart by 64-bit hashes. Defined results: a null text is an empty one, which
has the end token and the end mark alone; a row with a null id is learned from; repeated
rows count each; with no row to learn from, bytes are equally likely; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import for_texts, written
from tidemark.llm.words import hashed_words, in_parts, mixed

ORDER, START, END = 5, 0xFE, 0xFF  # two bytes that UTF-8 never has
SYMBOLS = 255  # bytes and the end mark, without the start mark
WORD, RUN, PART = 0, 1, 1 << 20  # PART: bytes of text taken at once


def runs(texts: list[bytes]) -> np.ndarray:
    """Each byte and end mark of each text with the ORDER bytes before it, packed into a number, in order."""
    data = np.frombuffer(b"".join(bytes((START,)) * ORDER + t + bytes((END,)) for t in texts), np.uint8)
    wide = data.astype(np.uint64)
    out = wide[: len(data) - ORDER].copy()
    for j in range(1, ORDER + 1):
        out <<= np.uint64(8)
        out |= wide[j : len(data) - ORDER + j]
    return out[data[ORDER:] != START]


def counted(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of (keys, counts) arrays, and the sums of their counts."""
    keys = np.concatenate([k for k, _ in pairs] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([c for _, c in pairs] or [np.zeros(0, np.int64)])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def part_of(kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    """Runs with the same last three context bytes go to the same part."""
    return (mixed((keys >> np.uint64(8)) & np.uint64(0xFFFFFF) if kind == RUN else keys) % np.uint64(parts)).astype(np.int64)


def block_features(texts: list[str | None], train: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind: the distinct keys of all texts, sorted, and their counts in the texts to learn from."""
    found: dict[int, list] = {WORD: [], RUN: []}
    done = 0
    for part in in_parts(texts, PART):
        own = train[done : done + len(part)]
        words, n = hashed_words(part)
        for kind, keys, flags in ((WORD, words, np.repeat(own, n)), (RUN, runs(part), np.repeat(own, [len(t) + 1 for t in part]))):
            codes, distinct = pd.factorize(keys)
            found[kind].append((distinct, np.bincount(codes[flags], minlength=len(distinct))))
        done += len(part)
    return {kind: counted(x) for kind, x in found.items()}


class Short:
    """Counts of all runs of up to three bytes in the training text."""

    def __init__(self, triples: np.ndarray, counts: np.ndarray) -> None:
        self.triples, self.counts = triples, counts  # (byte, byte before, byte), sorted
        self.pairs = np.bincount((triples & np.uint64(0xFFFF)).astype(np.int64), counts, 1 << 16).reshape(256, 256)
        self.single = self.pairs.sum(axis=0)
        context = (triples >> np.uint64(8)).astype(np.int64)
        self.n, self.d = np.bincount(context, counts, 1 << 16), np.bincount(context, minlength=1 << 16)
        self.excluded = np.bincount(context, self.pairs[context & 255, (triples & np.uint64(0xFF)).astype(np.int64)], 1 << 16)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """How often each of three bytes occurred."""
        if not len(self.triples):
            return np.zeros(len(grams))
        at = np.minimum(np.searchsorted(self.triples, grams), len(self.triples) - 1)
        return np.where(self.triples[at] == grams, self.counts[at], 0)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, short: Short) -> np.ndarray:
    """log10 P(byte | context) of each run; all runs of a three-byte context must be there."""
    logp, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    symbol, before = (keys & np.uint64(0xFF)).astype(int), ((keys >> np.uint64(8)) & np.uint64(0xFF)).astype(int)
    levels = {}  # order: count of each run, and total and distinct of its context
    for k in range(ORDER, 2, -1):
        grams, at = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        c = np.bincount(at, counts, len(grams))
        contexts, ctx = np.unique(grams >> np.uint64(8), return_inverse=True)
        levels[k] = {"grams": grams, "at": at, "c": c, "ctx": ctx, "n": np.bincount(ctx, c, len(contexts)), "d": np.bincount(ctx, c > 0, len(contexts))}
    pairs, single = short.pairs, short.single
    row_n, row_d = pairs.sum(axis=1), (pairs > 0).sum(axis=1)

    def shorter(grams: np.ndarray, k: int) -> np.ndarray:
        """Counts of the runs one order below grams of order k."""
        if k == 3:
            return short.of(grams & np.uint64(0xFFFFFF))
        low = levels[k - 1]
        return low["c"][np.searchsorted(low["grams"], grams & np.uint64((1 << 8 * k) - 1))]

    pair_out = np.where(pairs > 0, single[None, :], 0).sum(axis=1)  # counts at order 0 of what followed each byte
    out_n, out_d = np.zeros(len(keys)), np.zeros(len(keys))  # what the longer context excludes here
    for k in range(ORDER, -1, -1):
        if k >= 3:
            x = levels[k]
            c, n, d = x["c"][x["at"]], x["n"][x["ctx"]][x["at"]], x["d"][x["ctx"]][x["at"]]
            seen = x["c"] > 0
            excluded = np.bincount(x["ctx"][seen], shorter(x["grams"][seen], k), len(x["n"]))[x["ctx"]][x["at"]]
        elif k == 2:
            context = ((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(int)
            c, n, d, excluded = short.of(keys & np.uint64(0xFFFFFF)), short.n[context], short.d[context], short.excluded[context]
        elif k == 1:
            c, n, d, excluded = pairs[before, symbol], row_n[before], row_d[before], pair_out[before]
        else:
            c, n, d, excluded = single[symbol], single.sum(), (single > 0).sum(), None
        total, distinct = n - out_n, d - out_d
        here = open_ & (n > 0) & (distinct > 0)
        hit = here & (c > 0)
        safe = np.maximum(2 * total, 1)
        logp += np.where(hit, np.log10(np.maximum(2 * c - 1, 1) / safe), 0) + np.where(here & ~hit, np.log10(np.maximum(distinct, 1) / safe), 0)
        open_ &= ~hit
        if k:
            out_n, out_d = excluded * (n > 0), d * (n > 0)
    return logp - np.where(open_, np.log10(max(1, SYMBOLS - int((single > 0).sum()))), 0)


def totals(docs: DataFrame) -> tuple[Short, dict[str, int]]:
    """Counts of short runs in the texts to learn from, and sums over all of docs (text, train)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sums = [], np.zeros(4, np.int64)
        for b in batches:
            train, done = b["train"].to_numpy(bool), 0
            for part in in_parts(b["text"], PART):
                own = train[done : done + len(part)]
                done += len(part)
                learned = [t for t, x in zip(part, own, strict=True) if x]
                if learned:
                    held.append(np.unique(runs(learned) & np.uint64(0xFFFFFF), return_counts=True))
                    held = [counted(held)] if len(held) > 8 else held
                sums += (sum(map(len, part)), len(part), len(learned), int(hashed_words(learned)[1].sum()) if learned else 0)
        keys, n = counted(held)
        yield pd.DataFrame({"key": np.concatenate([keys.astype(np.int64), -1 - np.arange(4)]), "n": np.concatenate([n, sums])})

    found = docs.select("text", "train").mapInPandas(rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    sums = dict(zip((-1 - keys[keys < 0]).tolist(), n[keys < 0].tolist(), strict=True))
    return Short(keys[keys >= 0].astype(np.uint64), n[keys >= 0]), dict(zip(("bytes", "docs", "train_docs", "train_words"), (sums.get(i, 0) for i in range(4)), strict=True))


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20, part_bytes: int = 16 << 20, least: int = 16) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A block has about block_bytes of text, and there are least of them, so that small tables
    keep all cores busy; a part has what about part_bytes of text hold.
    """
    spark = docs.sparkSession
    rows = for_texts(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (~held_out).alias("train"))
    short, sums = totals(rows)
    blocks = max(least, -(-sums["bytes"] // block_bytes), -(-sums["docs"] // 100_000))
    parts = max(2, -(-sums["bytes"] // part_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.crc32("text")), F.lit(blocks)).cast("int"))
    shared = spark.sparkContext.broadcast(short)

    def features(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, (keys, counts) in block_features(b["text"].tolist(), b["train"].to_numpy(bool)).items():
            part = part_of(kind, keys, parts)
            order = np.argsort(part, kind="stable")
            for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(x):
                    out.append((int(b["block"].iloc[0]), int(part[x[0]]), kind, keys[x].tobytes(), counts[x].astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=["block", "part", "kind", "keys", "counts"])

    def answers(b: pd.DataFrame) -> pd.DataFrame:
        kind = int(b["kind"].iloc[0])
        own = [np.frombuffer(k, np.uint64) for k in b["keys"]]
        keys, counts = counted([(k, np.frombuffer(c, np.int64)) for k, c in zip(own, b["counts"], strict=True)])
        values = counts.astype(np.int64) if kind == WORD else log_probabilities(keys, counts, shared.value).astype(np.float32)
        distinct = np.zeros(len(b), np.int64)
        distinct[0] = (counts > 0).sum() if kind == WORD else 0
        answer = [values[np.searchsorted(keys, k)].tobytes() for k in own]
        return pd.DataFrame({"block": b["block"], "part": b["part"], "kind": kind, "answer": answer, "distinct": distinct})

    asked = dealt.groupBy("block").applyInPandas(features, "block int, part int, kind int, keys binary, counts binary")
    answered = written(asked.groupBy("part", "kind").applyInPandas(answers, "block int, part int, kind int, answer binary, distinct long"), "runs")
    distinct = (answered.agg(F.sum("distinct")).first()[0] or 0) + (sums["train_docs"] > 0)
    n_train, end_count = sums["train_words"] + sums["train_docs"], sums["train_docs"]
    norm = float(np.log10(n_train + 0.5 * (distinct + 1)))

    def score(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        texts = b["text"].tolist()
        lookup = {}
        for kind, (keys, _) in block_features(texts, np.zeros(len(texts), bool)).items():
            part, values = part_of(kind, keys, parts), np.zeros(len(keys))
            order = np.argsort(part, kind="stable")
            got = a[a["kind"] == kind].sort_values("part")["answer"]
            values[order] = np.concatenate([np.zeros(0), *(np.frombuffer(x, np.int64 if kind == WORD else np.float32) for x in got)])
            lookup[kind] = (keys, values)

        def of(kind: int, wanted: np.ndarray) -> np.ndarray:
            codes, unique = pd.factorize(wanted)
            return lookup[kind][1][np.searchsorted(lookup[kind][0], unique)][codes] if len(wanted) else np.zeros(0)

        out = []
        for part in in_parts(texts, PART):
            words, n = hashed_words(part)
            c, owner = of(WORD, words), np.repeat(np.arange(len(part)), n)
            sizes = np.array([len(t) + 1 for t in part])
            out.append(
                pd.DataFrame(
                    {
                        "n_tokens": n + 1,
                        "n_known": np.bincount(owner[c > 0], minlength=len(part)) + (end_count > 0),
                        "base_score": np.bincount(owner, np.log10(c + 0.5), len(part)) + np.log10(end_count + 0.5) - (n + 1) * norm,
                        "score": np.add.reduceat(of(RUN, runs(part)), np.cumsum(sizes) - sizes),
                    }
                )
            )
        found = pd.concat(out, ignore_index=True)
        return pd.DataFrame({"doc_id": b["id"].array, "held_out": ~b["train"].to_numpy(bool)}).join(found).assign(train_tokens=n_train)

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(score, kinds)
