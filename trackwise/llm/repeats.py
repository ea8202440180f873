"""Operator 10, suffix-array dedup: bytes covered by a string of ``length`` bytes that starts twice.

Every string of ``length`` bytes (a window) has one anchor: the leftmost of its
``GRAM``-byte strings with the smallest hash. Equal windows have equal anchors at the same
place, so windows need to be compared only under one anchor, and neighbouring windows share
theirs; a run of windows with one anchor and the bytes they span is a context.

1. One pass makes the anchors and context hashes of each text. Texts that occur
   twice whole are known by their own hash and need nothing further.
2. Anchors that occur once are dropped (an aggregate with partial results). A context
   that occurs twice makes all its windows repeated, without its bytes being looked at, so
   copies cost a count only.
3. Anchors with several different contexts are left: the edges of shared passages.
   One row of each such context fetches its bytes, rows are dealt by anchor, and in
   each task the windows of many anchors are sorted as suffixes by deep-shallow
   sorting: a multikey quicksort on 8-byte symbols to a depth of ``SHALLOW`` symbols, then
   blind tries for the groups that are still tied. Windows equal over the whole length are repeated.
4. An anchor with more than ``HOT`` different contexts is not sorted in one task:
   its windows are counted by 128-bit fingerprints, dealt by fingerprint.

Texts are bytes in UTF-8; matches never cross texts; overlapping occurrences count.

Defined cases: null text is empty; texts shorter than ``length`` keep all bytes; rows that
repeat a text remove each other's bytes; an empty table gives no rows; a text of any
length is worked on in chunks of ``CHUNK`` window starts; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise.llm.common import parts_for, ship_code, stored
from trackwise.llm.textbatch import Prefix, blocks

LENGTH = 200
GRAM = 40
CHUNK = 1 << 22
#: Different contexts of one anchor that one task sorts; about 5 MB of bytes.
HOT = 20_000
SHALLOW = 8
BLOCK_CONTEXTS = 20_000
BLOCK_BYTES = 1 << 20
_PLACE = np.uint64((1 << 23) - 1)


# ---- anchors ---------------------------------------------------------------
def contexts(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first window start, last window start, anchor hash, context hash) of all contexts of some texts.

    Starts are counted from the row's own start. At most ``CHUNK + length`` bytes."""
    n, width = len(raw), length - gram + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    prefix = Prefix(raw)
    at = np.arange(n - gram + 1)
    hashes = prefix.slices(at, at + gram)
    # sliding minimum over `width` grams; the place in the low bits makes the leftmost win
    key = (hashes & ~_PLACE) | at.astype(np.uint64)
    key = np.concatenate([key, np.full(-len(key) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(key, axis=1).ravel()
    starts = n - length + 1
    place = (np.minimum(ahead[:starts], behind[width - 1 : width - 1 + starts]) & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:starts]
    start = np.flatnonzero(np.arange(starts) + length <= offs[row + 1])  # inside one row
    place, row = place[start], row[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    lo, hi, row = start[first], start[last], row[first]
    return row, lo - offs[row], hi - offs[row], hashes[place[first]].view(np.int64), prefix.slices(lo, hi + length).view(np.int64)


def chunked(raw: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    if len(raw) <= CHUNK:  # blocks are shorter, so a longer one is one row
        return contexts(raw, offs, length)
    parts = []
    for a in range(0, len(raw), CHUNK):
        part = raw[a : a + CHUNK + length - 1]
        got = contexts(part, np.array([0, len(part)]), length)
        parts.append((got[0], got[1] + a, got[2] + a, *got[3:]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


# ---- deep-shallow sorting ----------------------------------------------------
def equal_windows(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the windows data[start : start + length] equal another one of them."""
    repeated = np.zeros(len(starts), bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    symbol = np.zeros(len(data) + 1, np.uint64)
    for j in range(8):
        symbol = (symbol << np.uint64(8)) | padded[j : j + len(symbol)]
    # shallow: each round parts every tied group by its next symbol
    live, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    shallow = min(SHALLOW, length // 8)
    for depth in range(shallow):
        s = symbol[starts[live] + 8 * depth]
        order = np.argsort(s, kind="stable") if depth == 0 else np.lexsort((s, group))
        live, s, group = live[order], s[order], group[order]
        edge = np.ones(len(live) + 1, bool)
        edge[1:-1] = (s[1:] != s[:-1]) | (group[1:] != group[:-1])
        tied = ~(edge[:-1] & edge[1:])
        group = np.cumsum(edge[:-1])[tied]
        live = live[tied]
        if not len(live):
            return repeated
    # deep: a trie of two leaves is one comparison, made for all such groups at once
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(group)))
    two = first[size == 2]
    a, b = live[two], live[two + 1]
    at = list(range(8 * shallow, length - 7, 8))
    for depth in at + ([length - 8] if length % 8 and length >= 8 else []):
        same = symbol[starts[a] + depth] == symbol[starts[b] + depth]
        a, b = a[same], b[same]
    repeated[a] = repeated[b] = True
    blob = data.tobytes()
    for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        members = live[f : f + n]
        repeated[members] = blind_trie([blob[s : s + length] for s in starts[members].tolist()], 8 * shallow)
    return repeated


def blind_trie(windows: list[bytes], depth: int) -> list[bool]:
    """Which of equally long strings, alike up to ``depth``, equal another.

    A node holds the place where its strings differ first and a child for each byte there; a
    leaf is a string's number. A string is led down by those bytes alone, compared once with
    the leaf it comes to, and branches off where the two differ."""
    length, twice = len(windows[0]), [False] * len(windows)
    top: list | int = 0
    for k in range(1, len(windows)):
        w, path, node = windows[k], [], top
        while not isinstance(node, int):
            path.append(node)
            node = node[1].get(w[node[0]], node[2])  # an unknown byte: any leaf will do
        other = windows[node]
        if w == other:
            twice[k] = twice[node] = True
            continue
        differ = (int.from_bytes(w) ^ int.from_bytes(other)).bit_length()
        place = length - (differ + 7) // 8
        parent = None
        for step in path:
            if step[0] >= place:
                break
            parent = step
        below = top if parent is None else parent[1][w[parent[0]]]
        if not isinstance(below, int) and below[0] == place:
            below[1][w[place]] = k
            continue
        branch = [place, {other[place]: below, w[place]: k}, node]
        if parent is None:
            top = branch
        else:
            parent[1][w[parent[0]]] = branch
    return twice


# ---- the job -------------------------------------------------------------------
def identity(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a whole text."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("repeats"), text).alias("k2")


def find_contexts(docs: DataFrame, length: int) -> DataFrame:
    """k1, k2 and the arrays anchor, context, place, a row for each document; stored with a row number.

    ``place`` holds a context's first window start, and in its low 16 bits the number of further ones."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offs in blocks(batch, 2, BLOCK_BYTES):
                row, lo, hi, anchor, context = chunked(raw, offs, length)
                edges = pa.array(np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(edges, pa.array(v))
                    for v in (anchor.astype(np.int64), context.astype(np.int64), lo.astype(np.int64) << 16 | (hi - lo).astype(np.int64))
                ]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], names)

    names = ["k1", "k2", "anchor", "context", "place"]
    fields = "k1 bigint, k2 bigint, " + ", ".join(f"{c} array<bigint>" for c in names[2:])
    return stored(docs.select("k1", "k2", "text").mapInArrow(run, fields).withColumn("did", F.monotonically_increasing_id()), "repeats-contexts")


def sort_suffixes(slices: DataFrame, length: int) -> DataFrame:
    """Repeated windows among the contexts of each anchor: (did, lo, hi) of those of contexts that occur once.

    ``slices``: anchor, context, n, did, lo, bytes; every anchor's contexts come to one task."""

    def marks(held: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = [r for i, r in enumerate(held) if not i or (r["anchor"], r["context"]) != (held[i - 1]["anchor"], held[i - 1]["context"])]
        size = np.array([len(r["bytes"]) for r in rows])
        windows = size - length + 1
        base = np.repeat(np.cumsum(size) - size, windows)
        own = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        found = equal_windows(np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8), base + own, length)
        owner = np.repeat(np.arange(len(rows)), windows)
        once = np.array([r["n"] == 1 for r in rows])
        at = np.flatnonzero(found & once[owner])
        if not len(at):
            return
        new = np.append(True, (np.diff(at) != 1) | (np.diff(owner[at]) != 0))
        first, last = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
        did = np.array([r["did"] for r in rows])[owner[first]]
        lo = np.array([r["lo"] for r in rows])[owner[first]]
        yield pa.RecordBatch.from_arrays([pa.array(did), pa.array(lo + own[first]), pa.array(lo + own[last])], ["did", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            rows = held + batch.to_pylist()
            cut = len(rows)  # up to the last anchor, which may go on
            while cut and rows[cut - 1]["anchor"] == rows[-1]["anchor"]:
                cut -= 1
            if cut >= BLOCK_CONTEXTS:
                yield from marks(rows[:cut])
                rows = rows[cut:]
            held = rows
        if held:
            yield from marks(held)

    dealt = slices.repartition(parts_for(slices, 50_000), "anchor").sortWithinPartitions("anchor", "context")
    return dealt.mapInArrow(run, "did bigint, lo bigint, hi bigint")


def count_windows(slices: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts, by fingerprints of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], np.uint8)
                at = np.arange(len(data) - length + 1)
                h1, h2 = (Prefix(data, seed).slices(at, at + length).view(np.int64) for seed in (0, 77))
                same = [pa.array(np.full(len(at), row[c], np.int64)) for c in ("did", "n")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at + row["lo"]), pa.array(h1), pa.array(h2)], ["did", "n", "lo", "h1", "h2"])

    windows = stored(slices.dropDuplicates(["anchor", "context"]).mapInArrow(run, "did bigint, n bigint, lo bigint, h1 bigint, h2 bigint"), "repeats-windows")
    twice = windows.groupBy("h1", "h2").count().filter("count > 1")
    return windows.filter("n = 1").join(twice, ["h1", "h2"], "left_semi").select("did", "lo", F.col("lo").alias("hi"))


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """k1, k2, copies and marks (array of first and last start of repeated windows) for each different text."""
    texts = docs.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    found = find_contexts(docs, length)
    rows = found.select("did", F.inline(F.arrays_zip("anchor", "context", "place")))
    often = stored(rows.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "repeats-anchors")
    rows = stored(rows.join(often, "anchor"), "repeats-rows")

    kinds = rows.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("did", "place")).alias("r"))
    kinds = stored(kinds.select("anchor", "context", "n", "r.*"), "repeats-kinds")
    bounds = [F.shiftright("place", 16).alias("lo"), (F.shiftright("place", 16) + F.col("place").bitwiseAND(0xFFFF)).alias("hi")]
    sure = rows.join(kinds.filter("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select("did", *bounds)
    many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    wanted = kinds.join(many, "anchor").select("anchor", "context", "n", (F.col("kinds") > HOT).alias("hot"), "did", *bounds)
    lists = wanted.groupBy("did").agg(F.collect_list(F.struct("anchor", "context", "n", "hot", "lo", "hi")).alias("wanted"))
    where = lists.join(found.select("did", "k1", "k2"), "did").groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.transform("wanted", lambda w: w.withField("did", F.col("did"))))).alias("wanted"))
    cut = docs.join(where, ["k1", "k2"]).select(F.col("text").cast("binary").alias("raw"), F.explode("wanted").alias("w"))
    cut = cut.select("w.*", F.substring("raw", F.col("w.lo").cast("int") + 1, (F.col("w.hi") - F.col("w.lo")).cast("int") + length).alias("bytes"))
    slices = stored(cut, "repeats-slices")
    marks = sure.unionByName(sort_suffixes(slices.filter("NOT hot"), length)).unionByName(count_windows(slices.filter("hot"), length))
    marks = marks.groupBy("did").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    # texts that occur twice go by their length alone
    owners = found.select("did", "k1", "k2").join(texts.filter("copies = 1"), ["k1", "k2"], "left_semi")
    marks = owners.join(marks, "did").select("k1", "k2", "marks")
    return texts.join(marks, ["k1", "k2"], "left")


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """The contract's row for each document; ``with_text`` adds the bytes that stay and the removed spans."""
    k1, k2 = identity(F.col("text"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", k1, k2)
    joined = docs.join(repeated_starts(docs, length), ["k1", "k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offs in blocks(batch, 1):
                out = []
                copies, marks = rows.column(2).to_pylist(), rows.column(3)
                flat, edge = marks.flatten(), np.concatenate([[0], np.cumsum(np.nan_to_num(marks.value_lengths().to_numpy(zero_copy_only=False)))]).astype(int)
                lo, hi = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for k in range(rows.num_rows):
                    own = raw[offs[k] : offs[k + 1]]
                    change = np.zeros(len(own) + 1, np.int32)
                    if copies[k] > 1 and len(own) >= length:
                        change[0] = 1
                    np.add.at(change, lo[edge[k] : edge[k + 1]], 1)
                    np.add.at(change, hi[edge[k] : edge[k + 1]] + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    left = own[~gone].tobytes()
                    begin = np.flatnonzero(gone & ~np.append(False, gone[:-1])) if len(own) else []
                    end = np.flatnonzero(gone & ~np.append(gone[1:], False)) + 1 if len(own) else []
                    spans = ",".join(f"{a}:{b}" for a, b in zip(begin, end, strict=True)) if with_text else None
                    out.append((len(own), int(gone.sum()), len(begin), hashlib.sha256(left).hexdigest(), left, spans))
                columns = list(zip(*out, strict=True))[: 6 if with_text else 4]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *arrays], names[: 1 + len(arrays)])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.select("doc_id", "text", "copies", "marks").mapInArrow(run, fields + (", kept binary, removed string" if with_text else ""))
