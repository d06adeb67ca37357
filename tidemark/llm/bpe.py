"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A piece is a match of the splitting pattern. If a whole piece is a token, that is its
encoding, as in the public library; otherwise the merges decide, by rank. The merges are
compiled into a transducer over bytes. What a left-to-right reading can still have open
are the positions where a token could start and reach past the end. Each position has one
last token, that of the encoding of what ends there: the one vocabulary token ending there
that may follow the last token of the position where it starts. Two tokens may stand
together if no merge takes bytes of both before each is whole. So a state is a small tree:
open positions, as nodes of the trie of tokens, with their last tokens, and the positions
on which these depend. What all open positions have in common is emitted, so the lookahead
is bounded by the longest token. States and moves are made when first reached. States are
numbered, and moves stand in a flat hash table of arrays, so that the distinct pieces of
many texts move together, a byte at a time. The tables grow with the variety of pieces,
to ``STATES`` states (about 200 MB) at most, and are then begun anew.

Decoding takes ids one by one and keeps a state of at most three bytes: the unfinished
UTF-8 sequence. Bytes that no continuation can make valid become U+FFFD.

Defined results: a null or empty text has no tokens; a very long text is read piece by
piece; repeated rows are encoded each; a null id is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import for_texts
from tidemark.llm.words import text_parts

STATES, TOGETHER = 1_000_000, 1 << 20  # TOGETHER: characters of text encoded at once
#: What the two pattern languages call white space differs in four control characters.
SPACES = {r"\s": r"\p{White_Space}", r"\S": r"\P{White_Space}"}
_CLOSED, _NONE = -1, -1


def ragged(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of each start and count, one after the other."""
    before = np.cumsum(counts) - counts
    return flat[np.repeat(starts - before, counts) + np.arange(int(counts.sum()))]


class Moves:
    """(state, byte) to (next state, number of what is emitted), open addressing in flat arrays."""

    def __init__(self, bits: int = 16) -> None:
        self.n, self.bits = 0, bits
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros((1 << bits, 2), np.int32)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 - the slot where it would stand."""
        at, left = self.home(keys), np.arange(len(keys))
        while len(left):
            own = self.keys[at[left]]
            left = left[(own != keys[left]) & (own != -1)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return np.where(self.keys[at] == keys, at, -1 - at)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.bits += (2 * self.n >> self.bits).bit_length()
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros((1 << self.bits, 2), np.int32)
        while len(keys):
            slots = -1 - self.find(keys)
            first = np.unique(slots, return_index=True)[1]  # of keys for one slot, the first takes it
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]


class Transducer:
    """Encoder of pieces for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.children: dict[int, int] = {}  # node * 256 + byte: node
        self.token_at, self.inner = array("i", [_NONE]), bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = 1
                below = self.children.setdefault(node << 8 | byte, len(self.inner))
                if below == len(self.inner):
                    self.inner.append(0)
                    self.token_at.append(_NONE)
                node = below
            self.token_at[node] = rank
        self.spines: dict[int, tuple[tuple[int, ...], tuple[int, ...]] | None] = {}
        self.begin()

    def begin(self) -> None:
        """Empty tables: one state, in which a piece begins."""
        self.moves = Moves()
        start = array("i", (0, _NONE, _NONE)).tobytes()
        self.numbers, self.states = {start: 0}, [start]
        self.rests = array("i", [-1])
        self.emissions: dict[tuple[int, ...], int] = {(): 0}
        self.out, self.out_start, self.out_size = array("I"), array("q", [0]), array("q", [0])

    def merged(self, piece: bytes) -> list[bytes]:
        """The definition: merge the leftmost pair of least rank until none is left."""
        return self.steps(piece)[0]

    def steps(self, piece: bytes) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
        """The parts left after all merges, and the pair of each merge in turn."""
        parts, done = [piece[i : i + 1] for i in range(len(piece))], []
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            done.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, done

    def spine(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The tokens that make up its left edge and its right edge, shortest first; None if the merges don't make it."""
        if token in self.spines:
            return self.spines[token]
        own, found = self.tokens[token], None
        parts, done = self.steps(own)
        if parts == [own]:
            left, right = done[-1] if done else (b"", b"")
            found = ((token,), (token,)) if not done else ((*self.spine(self.ranks[left])[0], token), (*self.spine(self.ranks[right])[1], token))
        self.spines[token] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a then b is an encoding; with no a, whether the merges make b at all.

        Merges come in the order of their ranks; until both tokens are whole, what stands on
        either side of the border grows along a's right and b's left edge.
        """
        if a == _NONE:
            return self.spine(b) is not None
        return self.spine(a) is not None and self.spine(b) is not None and self.stays_apart(self.spine(a)[1], self.spine(b)[0])

    def stays_apart(self, left: tuple[int, ...], right: tuple[int, ...]) -> bool:
        i, j, never = 0, 0, len(self.tokens) + len(self.ranks)
        while True:
            grow_left = left[i + 1] if i + 1 < len(left) else never
            grow_right = right[j + 1] if j + 1 < len(right) else never
            across = self.ranks.get(self.tokens[left[i]] + self.tokens[right[j]])
            if across is not None and across < grow_left and across <= grow_right:
                return False  # of equal ranks, the leftmost pair is merged first
            if grow_left == grow_right == never:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def move(self, state: bytes, byte: int) -> tuple[bytes, tuple[int, ...]]:
        """The state after one more byte, and the tokens that are settled by it.

        A state lists positions: (trie node or closed, last token, number of the position
        where that starts). Its first is the settled one, its last the end of what was read.
        """
        s = array("i", state)
        nodes, tokens, parents = list(s[0::3]), list(s[1::3]), list(s[2::3])
        last, start = _NONE, 0
        for i, node in enumerate(nodes):
            if node != _CLOSED:
                below = self.children.get(node << 8 | byte)
                if below is None:
                    nodes[i] = _CLOSED
                    continue
                own = self.token_at[below]
                if last == _NONE and own != _NONE and self.may_follow(tokens[i], own):
                    last, start = own, i
                nodes[i] = below if self.inner[below] else _CLOSED
        nodes.append(0)
        tokens.append(last)
        parents.append(start)
        below = [0] * len(nodes)  # positions that are needed and start at this one
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i] != _CLOSED or below[i]:
                below[parents[i]] += 1
        root, out = 0, []
        while nodes[root] == _CLOSED and below[root] == 1:
            root = next(i for i in range(root + 1, len(nodes)) if parents[i] == root and (nodes[i] != _CLOSED or below[i]))
            out.append(tokens[root])
        number, flat = {root: 0}, [nodes[root], tokens[root] if nodes[root] != _CLOSED else _NONE, _NONE]
        for i in range(root + 1, len(nodes)):
            if (nodes[i] != _CLOSED or below[i]) and parents[i] in number:
                number[i] = len(number)
                flat += (nodes[i], tokens[i], number[parents[i]])
        return array("i", flat).tobytes(), tuple(out)

    def emission(self, tokens: tuple[int, ...]) -> int:
        n = self.emissions.setdefault(tokens, len(self.out_size))
        if n == len(self.out_size):
            self.out_start.append(len(self.out))
            self.out_size.append(len(tokens))
            self.out.extend(tokens)
        return n

    def rest(self, state: int) -> int:
        """What is emitted if a piece ends in a state."""
        if self.rests[state] < 0:
            s = array("i", self.states[state])
            i, out = len(s) // 3 - 1, []
            while i:
                out.append(s[3 * i + 1])
                i = s[3 * i + 2]
            self.rests[state] = self.emission(tuple(reversed(out)))
        return self.rests[state]

    def made(self, key: int) -> tuple[int, int]:
        state, out = self.move(self.states[key >> 8], key & 255)
        n = self.numbers.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
            self.rests.append(-1)
        return n, self.emission(out)

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, one after the other, number of ids of each), by the merges."""
        if len(self.states) > STATES:
            self.begin()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data, starts = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        going = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0)) + 1), "left")  # pieces with a byte at each place
        state = np.zeros(len(pieces), np.int64)
        who, what = [], []
        for at, n in enumerate(going[:-1].tolist()):
            now = order[:n]
            keys = state[:n] << 8 | data[starts[now] + at]
            slot = self.moves.find(keys)
            if (slot < 0).any():
                new = np.unique(keys[slot < 0])
                self.moves.add(new, np.array([self.made(k) for k in new.tolist()], np.int32))
                slot = self.moves.find(keys)
            found = self.moves.values[slot]
            state[:n] = found[:, 0]
            emits = np.flatnonzero(found[:, 1])
            who.append(now[emits])
            what.append(found[emits, 1])
        last = np.unique(state)
        who.append(order)
        what.append(np.array([self.rest(s) for s in last.tolist()], np.int64)[np.searchsorted(last, state)])
        who, what = np.concatenate(who), np.concatenate(what)
        in_turn = np.argsort(who, kind="stable")
        who, what = who[in_turn], what[in_turn]
        sizes = np.array(self.out_size)[what]
        ids = ragged(np.array(self.out, np.uint32), np.array(self.out_start)[what], sizes)
        return ids, np.bincount(who, sizes, len(pieces)).astype(np.int64)


class Numbers(dict):
    """Numbers keys as they first occur."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Codec:
    """Texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        for a, b in SPACES.items():
            pattern = pattern.replace(a, b)
        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(ranks)
        self.bytes_of = self.transducer.tokens
        self.whole = {i: (t.decode(), b"") for t, i in ranks.items() if _complete(t)}

    def numbered(self, text: str, numbers: Numbers) -> np.ndarray:
        """The number of each piece of a text."""
        if len(text) <= TOGETHER:
            return np.array([numbers[p] for p in self.pattern.findall(text)], np.int32)
        found, parts = (m.group() for m in self.pattern.finditer(text)), []
        while part := [numbers[p] for p in islice(found, TOGETHER)]:
            parts.append(np.array(part, np.int32))
        return np.concatenate(parts)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers; each distinct piece is encoded once."""
        numbers = Numbers()
        codes = [self.numbered(t, numbers) for t in texts]
        pieces = [p.encode("utf-8", "surrogatepass") for p in numbers]
        whole = np.array([self.transducer.ranks.get(p, -1) for p in pieces], np.int64)
        other = np.flatnonzero(whole < 0)
        ids, sizes = self.transducer.encode_all([pieces[i] for i in other.tolist()])
        flat = np.concatenate([ids, whole[whole >= 0].astype(np.uint32)])
        counts, starts = np.ones(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        counts[other], starts[other] = sizes, np.cumsum(sizes) - sizes
        starts[whole >= 0] = len(ids) + np.arange(len(pieces) - len(other))
        return [ragged(flat, starts[c], counts[c]).astype("<u4") for c in codes]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete, an item for each id and one for what is left open."""
        whole, pending = self.whole, b""
        for i in ids:
            if not pending and (known := whole.get(i)):
                yield known[0]
                continue
            text, pending = utf8_step(pending, self.bytes_of[i])
            yield text
        if pending:
            yield pending.decode(errors="replace")


def _complete(token: bytes) -> bool:
    try:
        token.decode()
        return True
    except UnicodeDecodeError:
        return False


def utf8_step(pending: bytes, more: bytes) -> tuple[str, bytes]:
    """The text that pending and more complete, and the sequence left open."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    machine.setstate((pending, 0))
    return machine.decode(more), machine.getstate()[0]


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    """One for each task, or for each worker if it keeps its tables. The rank file is part of every worker's Python installation."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}, pattern)


def texts_of(batches: Iterable[pa.RecordBatch], keep: bool = False) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of rows (id, text), as many at once as make up TOGETHER bytes.

    The tables made for a task end with it, so that a worker that goes on to other work holds none, unless it is to keep them.
    """
    for rows, texts in text_parts(batches, TOGETHER):
        yield rows.column(0), [t.decode("utf-8", "surrogatepass") for t in texts]
    if not keep:
        codec.cache_clear()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array<int>) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for ids, texts in texts_of(batches):
            found = [x.astype(np.int32) for x in c.encode_all(texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.int32()))], ["id", "ids"])

    return _named(docs, id_col, text_col).mapInArrow(rows, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, text) of (id, ids) rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = ["".join(c.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else ())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(rows, "id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids, in one pass.

    keep: a worker keeps its states and moves from task to task, instead of making the same ones again. They are bounded by
    ``STATES``, but held while the worker does other work.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for own, texts in texts_of(batches, keep):
            found = c.encode_all(texts)
            columns = [
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()),
                pa.array([hashlib.sha256("".join(c.decode(x.tolist())).encode()).hexdigest() for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([own, *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _named(docs, id_col, text_col).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return for_texts(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
