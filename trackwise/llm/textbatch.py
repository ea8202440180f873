"""Arrow text columns as flat byte arrays: words, hashes, blocks.

A column of texts becomes one byte array and the offsets of its rows (null: empty).
Words are runs of bytes other than ``[\\x20\\x09-\\x0D]`` inside one row. A word's
hash is a polynomial over its bytes modulo 2**64, taken from prefix sums, so
that no Python object a word is made; it is mixed and depends on nothing but
the word. Work goes on in blocks of rows (``BLOCK_BYTES``, or one row if that
is longer), which bounds memory by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 2**64)
#: Any 256 distinct odd-looking numbers do; these are fixed by a rule.
_BYTE = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A5A5A55A5A5A5A)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self, base: int):
        self.base, self.all = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.all):
            size = max(n, 2 * len(self.all))
            self.all = np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.base)]).cumprod(dtype=np.uint64)
        return self.all[:n]


_UP, _DOWN = _Powers(_P), _Powers(_P_INVERSE)


def forget_powers() -> None:
    """Let go of the powers, which grow to the longest block seen; they are worked out again when needed."""
    for p in (_UP, _DOWN):
        p.all = np.ones(1, np.uint64)


class Prefix:
    """Polynomial prefix sums of a byte array: the hash of any slice in constant time."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        values = mix(_BYTE + np.uint64(seed)) if seed else _BYTE
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * _UP.upto(len(data)), out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.sums)
        return mix((self.sums[end] - self.sums[start]) * _DOWN.upto(n)[start] + (end - start).astype(np.uint64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, (offs - offs[0]) if len(column) else np.zeros(1, np.int64)


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``limit`` bytes of text each: (rows, bytes, offsets)."""
    raw, offs = flat(batch.column(column))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield batch.slice(a, b - a), raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


class Words:
    """The words of a block: ``start``, ``end`` and ``row`` of each, and ``edges``, the first word of each row."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.raw, self.offs = raw, offs
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~SPACE[raw]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        cut = offs[1:-1]  # a word ends with its row
        cut = cut[(cut > 0) & (cut < len(raw))]
        first[cut] = inside[1:-1][cut]
        last[cut - 1] = inside[1:-1][cut - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.edges = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.edges))

    def hashes(self) -> np.ndarray:
        return Prefix(self.raw).slices(self.start, self.end)


def row_reduce(ufunc: np.ufunc, values: np.ndarray, edges: np.ndarray, empty: float = 0) -> np.ndarray:
    """``ufunc`` over the values of each row (along axis 0); rows without any get ``empty``."""
    n = len(edges) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    has = edges[1:] > edges[:-1]
    if has.any():
        out[has] = ufunc.reduceat(values, edges[:-1][has], axis=0)
    return out


def distinct_by_row(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted, and the new edges."""
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(len(edges)))


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as a small binary value: compressed, equal places of all bytes together; ``rising``: sorted, as differences."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type = np.uint64, rising: bool = False) -> np.ndarray:
    """The ``n`` numbers of ``packed``."""
    wide = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * wide, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(raw.reshape(wide, n).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


class LongTable:
    """Row numbers of uint64 keys: open addressing in arrays, looked up a whole array at a time."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 1.5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.rows[at] < 0
            self.rows[at[free]] = todo[free]  # of several keys that claim a slot one stays
            won = self.rows[at] == todo
            self.keys[at[won]] = keys[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for keys that are not there."""
        slot = self._slot(keys)
        out, own = self.rows[slot], self.keys[slot] == keys
        more = np.flatnonzero(~own & (out >= 0))
        out[~own] = -1
        slot, keys = slot[more], keys[more]
        while len(more):
            slot = (slot + 1) & self.mask
            there = self.rows[slot]
            hit = (self.keys[slot] == keys) & (there >= 0)
            out[more[hit]] = there[hit]
            go = ~hit & (there >= 0)
            more, slot, keys = more[go], slot[go], keys[go]
        return out
