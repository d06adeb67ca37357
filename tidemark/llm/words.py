"""Words of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed randomness of the hash: a value for each byte, and an odd base with its inverse.
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_VALUES = np.where(_SPACE, np.uint64(0), _VALUES[_LOWER])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits of h."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, number of words of each text).

    Words are runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    sums = np.add.reduceat(_WORD_VALUES[data] * _power(_BASE, len(data)), starts)
    return mixed(sums * _power(_INVERSE, len(data))[starts]), counts


def in_parts(texts: Iterable[str | None], size: int = 1 << 19) -> Iterator[list[bytes]]:
    """UTF-8 of whole texts (null: empty), in lists of about size bytes or one longer text."""
    part, total = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        if part and total + len(b) > size:
            yield part
            part, total = [], 0
        part.append(b)
        total += len(b) + 1
    if part:
        yield part


def text_parts(batches: Iterable[pa.RecordBatch], size: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, UTF-8 of their whole texts; null: empty), about size bytes at once or one longer text.

    Only these texts are Python objects at a time, however many rows a batch has.
    """
    for b in batches:
        texts = b.column(b.schema.get_field_index("text"))
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i), [t or b"" for t in texts.slice(i, j - i).to_pylist()]
    pa.default_memory_pool().release_unused()


def numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """A column without nulls."""
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of size words inside a text, number of those of each text); shorter texts have none."""
    own = np.maximum(counts - size + 1, 0)
    if len(words) < size:
        return np.zeros(0, np.uint64), own
    h = words[: len(words) - size + 1].copy()
    for j in range(1, size):
        h = h * np.uint64(_BASE) + words[j : len(words) - size + 1 + j]
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words from here to the text's end
    return mixed(h[left[: len(h)] >= size]), own
