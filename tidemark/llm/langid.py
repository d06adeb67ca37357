"""Language of documents by a bidirectional gated recurrent network over bytes.

Bytes are read in segments of fixed length, forwards and backwards, by gated units::

    [a, b] = X[byte] + h U;  z = sigmoid(a);  c = tanh(b);  h' = (1 - z) h + z c

Both states at a position give a softmax over the languages there, which is the position's
label; a document's probabilities are the mean of those of all of its bytes. The weights
are trained in numpy by backpropagation through time, with Adam, on segments of a sample
of labelled documents. The sample is bounded by ``train_docs`` documents and ``train_bytes``
bytes for a language (as means of a draw by hash). Training draws 300 batches of 192
segments of it with replacement, as many of each language; on 93,566 sampled segments that
reaches 46 % of them once or more. Every other step reads all rows and all bytes. The weights
are a few KB.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every
row if no row can be learned from; NUL bytes count as padding; equal probabilities go to
the first label in order; a row with a null id is not held out; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import for_texts, unit_hash
from tidemark.llm.words import in_parts

LENGTH, UNITS, SEGMENTS_AT_ONCE = 64, 8, 4096


@dataclass
class Network:
    """X: two directions x 256 x 2 units; U: two x units x 2 units; V: 2 units x labels; d: labels."""

    labels: list[str]
    X: np.ndarray
    U: np.ndarray
    V: np.ndarray
    d: np.ndarray

    @staticmethod
    def states(X: np.ndarray, U: np.ndarray, data: np.ndarray, keep: bool = False):
        """(length, batch, units) states of one direction over data (length, batch); with keep, also z and c."""
        n, units = data.shape, U.shape[0]
        h = np.zeros((n[1], units), np.float32)
        out, gates = np.empty((*n, units), np.float32), np.empty((*n, 2 * units), np.float32) if keep else None
        for t in range(n[0]):
            g = X[data[t]]
            g += h @ U
            g[:, :units] *= 0.5
            np.tanh(g, out=g)
            z = g[:, :units]
            z += 1
            z *= 0.5
            if keep:
                gates[t] = g
            step = g[:, units:] - h
            step *= z
            h = np.add(h, step, out=out[t])
        return (out, gates) if keep else out

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """(length, batch, labels) of data (length, batch): the label of every position."""
        both = np.concatenate([self.states(self.X[0], self.U[0], data), self.states(self.X[1], self.U[1], data[::-1])[::-1]], axis=2)
        p = both.reshape(-1, both.shape[2]) @ self.V
        p += self.d
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p.reshape(*data.shape, -1)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, labels) mean probabilities over the bytes of each text."""
        data, owner = segments(texts)
        sums = np.zeros((len(texts), len(self.labels)))
        for i in range(0, len(data), SEGMENTS_AT_ONCE):
            part = np.ascontiguousarray(data[i : i + SEGMENTS_AT_ONCE].T)
            seen = (self.probabilities(part) * (part != 0)[:, :, None]).sum(axis=0)
            np.add.at(sums, owner[i : i + SEGMENTS_AT_ONCE], seen)
        return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(segments x length bytes, the text of each segment): all bytes of all texts, the rest zero."""
    counts = np.array([-(-len(t) // LENGTH) for t in texts], np.int64)
    data = np.zeros(int(counts.sum()) * LENGTH, np.uint8)
    for t, start in zip(texts, (np.cumsum(counts) - counts) * LENGTH, strict=True):
        data[start : start + len(t)] = np.frombuffer(t, np.uint8)
    return data.reshape(-1, LENGTH), np.repeat(np.arange(len(texts)), counts)


def trained(data: np.ndarray, y: np.ndarray, labels: list[str], steps: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 5) -> Network:
    """A network fitted to segments (n x length) with label numbers y."""
    rng = np.random.default_rng(seed)
    k, u = len(labels), UNITS
    new = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    w = {"X": new(2, 256, 2 * u, scale=0.3), "U": new(2, u, 2 * u, scale=0.3), "V": new(2 * u, k, scale=0.3), "d": np.zeros(k, np.float32)}
    first, second = ({n: np.zeros_like(v) for n, v in w.items()} for _ in range(2))
    by_label = [np.flatnonzero(y == i) for i in range(k)]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(x, -(-batch // k)) for x in by_label])
        g = gradients(w, np.ascontiguousarray(data[rows].T), y[rows])
        lr = rate * min(1, step / 20) * (1 - step / (steps + 1))
        for n in w:
            first[n] += 0.1 * (g[n] - first[n])
            second[n] += 0.01 * (g[n] ** 2 - second[n])
            w[n] -= (lr * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(labels, **w)


def gradients(w: dict[str, np.ndarray], data: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over positions, by backpropagation through time; data (length, batch)."""
    length, batch = data.shape
    units = w["U"].shape[1]
    runs = [Network.states(w["X"][i], w["U"][i], data[::step], keep=True) for i, step in ((0, 1), (1, -1))]
    both = np.concatenate([runs[0][0], runs[1][0][::-1]], axis=2)
    logits = both @ w["V"] + w["d"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    p[:, np.arange(batch), y] -= 1
    real = data != 0
    p *= real[:, :, None] / max(1, real.sum())
    flat = p.reshape(-1, p.shape[2])
    out = {"V": both.reshape(-1, 2 * units).T @ flat, "d": flat.sum(axis=0), "X": np.empty_like(w["X"]), "U": np.zeros_like(w["U"])}
    d_both = p @ w["V"].T
    for i, step in ((0, 1), (1, -1)):
        h, gates = runs[i]
        d_out = d_both[:, :, units * i : units * (i + 1)][::step]
        d_pre, carry = np.empty_like(gates), np.zeros((batch, units), np.float32)
        for t in range(length - 1, -1, -1):
            z, c = gates[t, :, :units], gates[t, :, units:]
            before = h[t - 1] if t else np.zeros_like(carry)
            dh = d_out[t] + carry
            d_pre[t, :, :units] = dh * (c - before) * z * (1 - z)
            d_pre[t, :, units:] = dh * z * (1 - c * c)
            carry = dh * (1 - z) + d_pre[t] @ w["U"][i].T
            out["U"][i] += before.T @ d_pre[t]
        b, flat = data[::step].ravel(), d_pre.reshape(-1, 2 * units)
        out["X"][i] = np.stack([np.bincount(b, flat[:, j], 256) for j in range(2 * units)], axis=1)
    return out


def sample(docs: DataFrame, train_docs: int, train_bytes: int, most_labels: int) -> list[tuple[str, str]]:
    """(lang, whole text) of some rows of docs (id, text, lang) for each language, drawn by hash.

    About train_docs rows are drawn, or fewer if those have more than train_bytes bytes. More than most_labels languages are refused.
    """
    known = for_texts(docs).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} languages; is this the language column?")
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, train_docs / r["n"], train_bytes / r["bytes"]))))
    drawn = known.where(unit_hash(F.coalesce("id", F.xxhash64("text")), F.lit("sample")) < share[F.col("lang")])
    return [(r["lang"], r["text"]) for r in drawn.select("lang", "text").orderBy("lang", "id", F.xxhash64("text")).collect()]


def fitted(docs: DataFrame, train_docs: int = 600, train_bytes: int = 8 << 20, most_labels: int = 500, **training) -> Network | None:
    """A network that has learned from docs (id: long, text, lang); None if no row can be learned from."""
    rows = sample(docs, train_docs, train_bytes, most_labels)
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    data, owner = segments([text.encode("utf-8", "surrogatepass") for _, text in rows])
    return trained(data, np.array([labels.index(lang) for lang, _ in rows])[owner], labels, **training)


def predicted(model: Network | None, text: Column) -> Column:
    """struct(lang: string, score: double) of a whole text."""
    if model is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    labels, weights = model.labels, (model.X, model.U, model.V, model.d)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        network = Network(labels, *weights)
        for texts in batches:
            p = np.concatenate([np.zeros((0, len(labels))), *map(network.pooled, in_parts(texts))])
            yield pd.DataFrame({"lang": [labels[i] for i in p.argmax(axis=1)], "score": p.max(axis=1, initial=0.0)})

    found = F.pandas_udf(predict, "lang string, score double")(text)
    none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), found).otherwise(none)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **params) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Learns from rows whose crc32(id as text) mod 3 is not 1; a prediction sees the text alone.
    """
    out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), out.alias("held_out"))
    model = fitted(rows.where("not held_out"), **params)
    found = rows.withColumn("p", predicted(model, F.col("text")))
    return found.select(F.col("id").alias("doc_id"), "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
