"""Vectorised text primitives over Arrow string buffers.

Text reaches the operators as Arrow batches; the functions here work on the raw UTF-8 bytes with
numpy, so no Python string is made for a word.  Every batch is cut into pieces of at most
``CHUNK_BYTES`` (one longer text forms a piece of its own), which bounds a worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

#: Words are hashed by their polynomial at two points of the field of this prime: values of different words of any shape
#: agree with a chance of about (length / prime) ** 2, as the field has no structure that byte patterns could meet.
PRIME = (1 << 31) - 1
POINTS = (1_220_703_133, 762_939_453)
#: For each point its powers and those of its inverse.
_powers: list[np.ndarray] = [np.ones(1, np.uint64) for _ in range(4)]
#: Above this many bytes prefix sums are made again rather than kept.
_KEPT_BYTES = 4 << 20


def _byte_table(spec: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(spec.encode("latin-1"))] = True
    return table


#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = _byte_table(" \t\n\v\f\r")
NOT_SPACE = ~SPACE
#: Digits, A-Z, a-z and every byte of a non-ASCII character.
ALNUM = _byte_table("".join(map(chr, range(0x30, 0x3A))) + "".join(map(chr, range(0x41, 0x5B))) + "".join(map(chr, range(0x61, 0x7B))) + "".join(map(chr, range(0x80, 0x100))))
#: As ALNUM without digits.
LETTERS = ALNUM & ~_byte_table("0123456789")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _fold(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any unsigned x."""
    x = _fold(_fold(x))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the points and of their inverses modulo PRIME, for positions below n."""
    for k, base in enumerate(b for point in POINTS for b in (point, pow(point, -1, PRIME))):
        while len(_powers[k]) < n:
            step = np.uint64(pow(base, len(_powers[k]), PRIME))
            _powers[k] = np.concatenate([_powers[k], _modulo(_powers[k] * step)])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); spreads every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; a null is an empty text."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in pieces of at most `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


class Words:
    """The words of a run of texts: byte positions, the text each belongs to and 64-bit hashes."""

    __slots__ = ("_totals", "data", "end", "first", "hash", "start", "texts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True, hashed: bool = True):
        self.data = data = _LOWER[data] if lower else data
        self.texts = len(offsets) - 1
        self._totals: list[np.ndarray] = []
        inside = table[data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(data):
            before[1:], before[0] = inside[:-1], False
            after[:-1], after[-1] = inside[1:], False
            filled = offsets[1:] > offsets[:-1]
            before[offsets[:-1][filled]] = False
            after[offsets[1:][filled] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: Word index at which each text begins, and the total.
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self.hash_of(self.start, self.end) if hashed else None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.counts)

    def _prefix_sums(self) -> list[np.ndarray]:
        if self._totals:
            return self._totals
        powers, n, out = _power_tables(len(self.data) + 1), len(self.data), []
        values = self.data.astype(np.uint64) + np.uint64(1)
        for k in (0, 2):
            total, terms = np.zeros(n + 1, np.uint64), values * powers[k][:n]  # below 2**39 each
            np.cumsum(terms if n < 1 << 24 else _fold(terms), out=total[1:])
            out.append(total)
        if n <= _KEPT_BYTES:
            self._totals = out
        return out

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal byte strings, whatever their place."""
        totals, powers = self._prefix_sums(), _power_tables(len(self.data) + 1)
        a, b = (_modulo(_modulo(total[end] - total[start]) * powers[k][start]) for total, k in zip(totals, (1, 3), strict=True))
        return _joined(a, b, (end - start).astype(np.uint64))

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def words_of(column: pa.Array, table: np.ndarray = NOT_SPACE, lower: bool = True, hashed: bool = True) -> Words:
    data, offsets = strings(column)
    return Words(data, offsets, table, lower, hashed)


def _joined(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix((a << np.uint64(31) | b) + size * np.uint64(0x9E3779B97F4A7C15))


#: Words of up to this many bytes are hashed by blocks of eight bytes in block_hashes.
BLOCKED = 1 << 10
#: What is kept of a block, by the number of its bytes in the word; what sizes begin with.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEEDS = mix(mix(np.arange(1, BLOCKED + 2, dtype=np.uint64)))


def block_hashes(words: Words) -> np.ndarray:
    """Hashes of a run's words by eight bytes at a time, mixed after each: equal for equal byte strings, whatever their place.  Not those of
    Words.hash, but many times faster; longer words' are those."""
    data = np.append(words.data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(words.data) + 1,), "<u8", data, strides=(1,))
    size = words.end - words.start
    out = mix((eight[words.start] & _MASKS[np.minimum(size, 8)]) ^ _SEEDS[np.minimum(size, BLOCKED)])
    live = np.flatnonzero(size > 8)
    for k in range(8, BLOCKED, 8):
        if not len(live):
            break
        out[live] = mix(out[live] ^ (eight[words.start[live] + k] & _MASKS[np.minimum(size[live] - k, 8)]))
        live = live[size[live] > k + 8]
    long = np.flatnonzero(size > BLOCKED)
    if len(long):
        out[long] = words.hash_of(words.start[long], words.end[long])
    return out


def hash_bytes(value: bytes) -> int:
    """The same hash as Words gives, for one byte string."""
    a, b = (sum((c + 1) * pow(point, i, PRIME) for i, c in enumerate(value)) % PRIME for point in POINTS)
    return int(_joined(*(np.array([x], np.uint64) for x in (a, b, len(value))))[0])


class HashIndex:
    """Positions of 64-bit keys in a sorted key array, by a bucket table on the leading bits."""

    def __init__(self, keys: np.ndarray):
        # Keys that come sorted are their own order, which saves a look per find.
        self.order = None if (keys[1:] >= keys[:-1]).all() else np.argsort(keys, kind="stable")
        self.keys = np.ascontiguousarray(keys if self.order is None else keys[self.order])
        bits = min(24, max(4, int(np.ceil(np.log2(len(keys) + 1))) + 1))
        self.shift = np.uint64(64 - bits)
        self.begin = np.append(0, np.cumsum(np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits))).astype(np.int32)
        self.most = int(np.diff(self.begin).max()) if len(keys) else 0
        self.keys = np.append(self.keys, np.zeros(self.most + 1, np.uint64))
        if self.order is not None:
            self.order = np.append(self.order, np.full(self.most + 1, -1))
        self.n = len(keys)

    def _given(self, at: np.ndarray) -> np.ndarray:
        return at if self.order is None else self.order[at]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """For each wanted hash its position in the keys given, or -1."""
        if not self.n:
            return np.full(len(wanted), -1, np.int64)
        bucket = (wanted >> self.shift).astype(np.int64)
        # An empty bucket begins at another's key, which none of its own equals.
        at = self.begin[bucket]
        hit = self.keys[at] == wanted
        found = np.where(hit, self._given(at), np.int64(-1))
        live = np.flatnonzero(~hit)
        at, end = at[live], self.begin[bucket[live] + 1]
        for _ in range(1, self.most):
            at = at + 1
            more = at < end
            live, at, end = live[more], at[more], end[more]
            if not len(live):
                break
            hit = self.keys[at] == wanted[live]
            found[live[hit]] = self._given(at[hit])
            live, at, end = live[~hit], at[~hit], end[~hit]
        return found


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each run values[first[i]:first[i+1]]; 0 for an empty run."""
    n = len(first) - 1
    out = np.zeros(n, values.dtype)
    filled = np.flatnonzero(first[1:] > first[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(values, first[filled])
    return out
