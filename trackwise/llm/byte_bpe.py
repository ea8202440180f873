"""Operator 5, byte-level BPE encoding and decoding.

Each match of the split pattern is a piece. The distinct pieces of a block of
documents are put into matrices by length, one piece a row, padded to the
length of the bucket. In each round every row merges its leftmost pair of
minimum rank; pair ranks come from an open-addressing hash table in numpy, and
rows that have no pair left are compacted away. A piece longer than
``LONG_PIECE`` bytes (one row of a matrix would take a round a byte) goes through a heap
with the same order (rank, then position).

The text of a document is encoded whole. Memory is bounded by the block of
documents (``BLOCK_BYTES``, or one document if that is longer) and the piece
memory (``MEMO_PIECES`` entries, emptied when full); the codec and its memory go at the end of a task.

Defined cases: null text encodes to no ids like empty text; repeated rows and ids give a row each;
an empty table gives no rows; other columns are not read by ``encode_documents`` and
are passed through by ``encode_table``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from trackwise.llm.common import released, ship_code

LONG_PIECE = 256
BLOCK_BYTES = 1 << 20
MEMO_PIECES = 200_000
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) → id of the merged token, open addressing with linear probing."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(pairs) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE, np.int32)
        slot, todo = self._slot(pairs), np.arange(len(pairs))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            cand = todo[free]
            _, first = np.unique(slot[cand], return_index=True)  # one claimant a slot
            won = cand[first]
            self.keys[slot[won]], self.values[slot[won]] = pairs[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask
        self.probes = self._longest_run()

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs * _MIX) >> self.shift).astype(np.int64)

    def _longest_run(self) -> int:
        used = np.flatnonzero(self.keys == np.uint64(2**64 - 1))
        return int(np.diff(np.concatenate([used, [used[0] + len(self.keys)]])).max()) if len(used) else len(self.keys)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of merged tokens, NONE where the pair does not merge. The arrays may have any shape."""
        pairs = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(pairs)
        found = self.keys[slot]
        out = np.where(found == pairs, self.values[slot], NONE)
        open_ = (found != pairs) & (found != np.uint64(2**64 - 1))
        if open_.any():
            at, want, slot = np.nonzero(open_), pairs[open_], slot[open_]
            for _ in range(self.probes):
                slot = (slot + 1) & self.mask
                found = self.keys[slot]
                hit = found == want
                if hit.any():
                    out[tuple(a[hit] for a in at)] = self.values[slot[hit]]
                more = ~hit & (found != np.uint64(2**64 - 1))
                if not more.any():
                    break
                at, want, slot = tuple(a[more] for a in at), want[more], slot[more]
        return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.byte_id = np.full(256, -1, np.int32)
        for b in range(256):
            self.byte_id[b] = ranks.get(bytes([b]), -1)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no token for some byte")
        lengths = np.zeros(size + 1, np.int64)
        for token, i in ranks.items():
            lengths[i + 1] = len(token)
        self.token_start = np.cumsum(lengths)
        blob = bytearray(int(self.token_start[-1]))
        left, right, merged = [], [], []
        for token, i in ranks.items():
            blob[self.token_start[i] : self.token_start[i] + len(token)] = token
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        self.blob = np.frombuffer(bytes(blob), np.uint8)
        pairs = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.table = PairTable(pairs, np.array(merged, np.int32))
        self.memo: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(ranks, pattern)

    # ---- encoding ------------------------------------------------------
    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian uint32 bytes."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        edges = [0, 1, 2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, LONG_PIECE]
        cuts = np.searchsorted(lengths[order], edges, "right")
        for lo, hi, width in zip(cuts[:-1], cuts[1:], edges[1:], strict=True):
            step = max(1, (1 << 19) // width)
            for a in range(lo, hi, step):
                rows = order[a : min(a + step, hi)]
                for r, ids in zip(rows.tolist(), self._merge_matrix([pieces[r] for r in rows], lengths[rows], width), strict=True):
                    out[r] = ids
        for r in order[cuts[-1] :].tolist():
            out[r] = self._merge_long(pieces[r])
        return out

    def _merge_matrix(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> list[bytes]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte_id[raw]
        column = np.arange(width)
        ids[column >= lengths[:, None]] = -1
        count, done = lengths.copy(), np.empty((n, width), np.uint32)
        live = np.arange(n)
        rank = np.full((n, width), NONE, np.int32)
        if width > 1:
            ok = ids[:, 1:] >= 0
            rank[:, :-1][ok] = self.table.get(ids[:, :-1][ok], ids[:, 1:][ok])
        while len(live):
            at = rank.argmin(axis=1)  # the first of equal minima
            i = np.arange(len(live))
            best = rank[i, at]
            stop = best == NONE
            if stop.any():  # compaction: finished rows leave the matrix
                done[live[stop], : ids.shape[1]] = ids[stop]
                go = ~stop
                live, ids, rank, at, best = live[go], ids[go], rank[go], at[go], best[go]
                if not len(live):
                    break
                used = int(count[live].max())
                ids, rank, i = ids[:, :used], rank[:, :used], np.arange(len(live))
            # the right token of the merged pair leaves, what follows moves left
            w = ids.shape[1]
            source = np.arange(w) + (np.arange(w) > at[:, None])
            pad = source >= w
            source[pad] = w - 1
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            ids[pad], rank[pad] = -1, NONE
            ids[i, at] = best
            count[live] -= 1
            has = at + 1 < count[live]
            rank[i, at] = NONE
            rank[i[has], at[has]] = self.table.get(best[has], ids[i[has], at[has] + 1])
            has = at > 0
            rank[i[has], at[has] - 1] = self.table.get(ids[i[has], at[has] - 1], best[has])
        flat = done.astype("<u4").tobytes()
        return [flat[r * 4 * width : r * 4 * width + 4 * k] for r, k in enumerate(count.tolist())]

    def _merge_long(self, piece: bytes) -> bytes:
        """A heap of (rank, position) over a linked list: the same merges, in n log n."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # token at i is piece[i:end[i]]
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        dead = bytearray(n + 1)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if dead[i] or end[i] != mid or mid >= n or dead[mid] or end[mid] != stop:
                continue
            dead[mid], end[i] = 1, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (b := before[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
                heapq.heappush(heap, (r, b, i, stop))
        at, ids = 0, []
        while at < n:
            ids.append(ranks[piece[at : end[at]]])
            at = end[at]
        return np.array(ids, "<u4").tobytes()

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian uint32 bytes."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        memo = self.memo
        new = set().union(*split).difference(memo)
        if new:
            order = list(new)
            memo.update(zip(order, self.encode_pieces([p.encode() for p in order]), strict=True))
        return [b"".join(map(memo.__getitem__, pieces)) for pieces in split]

    # ---- decoding ------------------------------------------------------
    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for; the ids alone are read."""
        i = np.frombuffer(ids, "<u4")
        start = self.token_start[i]
        length = self.token_start[i + 1] - start
        total = int(length.sum())
        shift = np.repeat(start - (np.cumsum(length) - length), length)
        return self.blob[shift + np.arange(total)].tobytes()


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """One codec a task."""
    return ByteBPE.from_file(path, pattern)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts take about ``limit`` bytes together."""
    size = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(size):
        yield at, len(size)


def encode_table(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None,
                 with_ids: bool = True) -> DataFrame:
    """``keep`` columns (all but the text by default) plus ``ids`` (array of int), ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256``; the text and the ids stay in the task that reads them unless ``with_ids``."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    clash = {"ids", "n_tokens", "ids_sha256", "decoded_sha256"} & set(keep)
    if clash:
        docs = docs.withColumnsRenamed({c: f"{c}_in" for c in clash})
        keep = [f"{c}_in" if c in clash else c for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in batches:
            column = batch.column(len(keep))
            for a, b in blocks(column):
                encoded = codec.encode_texts(column.slice(a, b - a).to_pylist())
                arrays = [batch.column(k).slice(a, b - a) for k in range(len(keep))]
                counts = np.fromiter((len(x) // 4 for x in encoded), np.int64, b - a)
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    flat = np.frombuffer(b"".join(encoded), "<i4")
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
                arrays += [
                    pa.array(counts),
                    pa.array([hashlib.sha256(x).hexdigest() for x in encoded]),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in encoded]),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names)

    ship_code(docs.sparkSession)
    shown = docs.select(*keep, text_col)
    schema = shown.drop(text_col).schema if keep else None
    fields = (schema.simpleString()[7:-1] + ", " if keep else "") + ("ids: array<int>, " if with_ids else "")
    out = fields + "n_tokens: bigint, ids_sha256: string, decoded_sha256: string"
    names = [*keep, *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
    return shown.mapInArrow(released(run, load.cache_clear), out)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's row for each document."""
    return encode_table(docs, path, pattern, keep=["doc_id"], with_ids=False)
