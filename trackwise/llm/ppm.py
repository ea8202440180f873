"""Operator 3, language-model scores: prediction by partial matching over bytes.

The trie predicts each byte of a text from the bytes before it. A byte is predicted from the longest
context that the trie has; if it never followed there, the escape probability (method C: different
followers over occurrences plus followers) is paid and the next shorter
context is asked, with the symbols excluded that the longer one had; last come the symbols never
seen. Texts are scored with A-Z folded, followed by an end symbol (a zero byte).

Contexts are nested, each a part of the next shorter: the last six, five, four and three bytes; the last two and the last
one with the classes of the bytes up to the third; then the upper trie, three classes to none. There are 32
classes (each letter, white space, digits, marks, UTF-8 leads, UTF-8 tails, the end). The upper
trie has at most 32**3 × 256 counts, a bound that holds for any corpus; it is one table of log
probabilities. All contexts below it count.

Documents are dealt to units (runs of rows with at most ``UNIT_BYTES`` of text, or one row if that is longer). A unit asks for
each different gram (six bytes and the next) and each different word once, with the times it has them in training documents.
The counts and questions of all units meet by the three bytes before the symbol (words: by hash), are added up there, and
the answers go back to the units, which score their texts with them. Up to three bytes the contexts of a gram share its three
classes, so these levels are worked out first, from grams of three bytes and the next, dealt by classes (at most 64**3 × 256
grams have the same three, a bound that holds for any corpus).
Words are keyed by 64-bit hashes.

Defined cases: null text counts as empty and has the end only; without training documents every
token is unknown (N = V = 0) and the trie knows no byte; repeated rows and ids give a row each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwise.llm.common import discard, fold, release, released, ship_code, shuffles_freed, stored
from trackwise.llm.textbatch import LOWER, LongTable, Words, blocks, mix, packed, row_reduce, unpacked

SHARED_WORDS = 1 << 21  # a unit ends when it holds so many different words
SHARED_GRAMS = 1 << 22  # or grams
UNIT_BYTES = 1 << 25
ORDER, DEEP, CLASSES = 3, 6, 32
CELLS = CLASSES**ORDER * 256
BLOCK_BYTES = 1 << 20
COUNT_BYTES = 1 << 21
HELD_ENTRIES = 1 << 21
LEAST_BUCKETS = 64
WORDS, SHORT, GRAMS, TEXT = range(4)  # kinds of rows
PARTS = "kind int, unit bigint, bucket int, size int, keys binary, vals binary"

_CLASS = np.zeros(256, np.uint64)
_CLASS[1:128] = 30  # marks and control characters
_CLASS[[9, 10, 11, 12, 13, 32]] = 27
_CLASS[48:58] = 28
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:192] = 29
_CLASS[192:256] = 31



def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end of each text: the classes of the ``ORDER`` bytes before it, five bits each, and itself
    in the low eight bits. Also the row edges. ``raw`` is folded."""
    rows = len(offs) - 1
    size = np.diff(offs)
    begin = offs[:-1] + DEEP * np.arange(1, rows + 1)
    full = np.zeros(len(raw) + DEEP * (rows + 1), np.uint8)  # ends stand between the texts and before the first
    full[np.arange(len(raw)) + DEEP * (np.repeat(np.arange(rows), size) + 1)] = raw
    code, n = _CLASS[full], len(full) - DEEP
    gram = np.zeros(n, np.uint64)
    for j in range(DEEP - ORDER, DEEP):
        gram = (gram << np.uint64(5)) | code[j : j + n]
    gram = (gram << np.uint64(8)) | full[DEEP:]
    wanted = np.ones(n, bool)  # of the ends after a text only the first is a symbol
    for extra in range(1, DEEP):
        at = begin + size + extra - DEEP
        wanted[at[at < n]] = False
    return gram[wanted], np.concatenate([[0], np.cumsum(size + 1)])


def deep_grams(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The ``DEEP`` bytes before each byte and end, and itself: 56 bits."""
    size = np.diff(offs)
    full = np.zeros(len(raw) + DEEP * (len(size) + 1) + 2, np.uint8)  # ends stand between the texts and before the first
    wanted = np.zeros(len(full) - 7, bool)
    at = 1 + DEEP
    for k, n in enumerate(size.tolist()):
        full[at : at + n] = raw[offs[k] : offs[k] + n]
        wanted[at - 7 : at - 6 + n] = True
        at += n + DEEP
    eight = np.ndarray(len(wanted), ">u8", full, strides=(1,))  # the eight bytes up to each
    return eight[wanted].astype(np.uint64) & np.uint64((1 << 56) - 1)


def cells(gram: np.ndarray) -> np.ndarray:
    """The cell of the upper trie: three classes and the symbol."""
    return (gram & np.uint64(CELLS - 1)).astype(np.int32)


def cell_of(gram: np.ndarray) -> np.ndarray:
    """The same from a gram of ``DEEP`` bytes."""
    out = (gram & 255).astype(np.int32)
    for j in range(1, ORDER + 1):
        out |= _CLASS[gram >> 8 * j & 255].astype(np.int32) << 5 * j + 3
    return out


def log_table(counts: np.ndarray) -> np.ndarray:
    """log10 P(symbol | context) of every cell, from the counts of the cells."""
    third = counts.reshape(CLASSES, CLASSES, CLASSES, 256)
    second = third.sum(axis=0)
    first = second.sum(axis=0)
    none = first.sum(axis=0)
    out = np.empty((CLASSES, CLASSES, CLASSES, 256), np.float32)
    for b in range(CLASSES):
        p = np.zeros((CLASSES, CLASSES, 256))
        left = np.ones((CLASSES, CLASSES, 1))  # the probability that has escaped so far
        seen = np.zeros(p.shape, bool)
        for c in (third[:, b], second[b][None], first[None], none[None, None]):
            c = np.where(seen, 0, c)
            total, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
            every = np.maximum(total + kinds, 1)
            p += left * c / every
            left = left * np.where(total > 0, kinds / every, 1.0)
            seen |= c > 0
        unseen = ~seen
        rest = unseen.sum(axis=-1, keepdims=True)
        p += np.where(unseen, left / np.maximum(rest, 1), 0)
        out[:, b] = np.log10(p)
    return out.ravel()


def level_key(level: int, gram: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The keys of one level's grams: the context (from bit 8) and the symbol in the low eight bits; level 0 is the cell."""
    if level >= ORDER:
        return gram & np.uint64((1 << 8 * level + 8) - 1)
    return ((gram >> np.uint64(8)) & np.uint64((1 << 8 * level) - 1)) << np.uint64(23) | cell.astype(np.uint64)


def turned(gram: np.ndarray) -> np.ndarray:
    """Grams with the three bytes next to the symbol first, so that sorted ones lie close; turned twice they are as before."""
    return (gram >> np.uint64(8) & np.uint64(0xFFFFFF)) << np.uint64(32) | (gram >> np.uint64(32)) << np.uint64(8) | gram & np.uint64(255)


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sum of each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def tallied(keys: np.ndarray, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different keys with their times in training documents: those of training documents, then those of the others."""
    for own, counts in ((keys[~held], True), (keys[held], False)):
        own.sort()
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
        yield own[first], np.diff(np.append(first, len(own))) if counts else np.zeros(len(first), np.int64)


def bucket_count(spark) -> int:
    return max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_three(gram: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each gram: all that share the three bytes before the symbol have the same."""
    return (mix(gram >> np.uint64(8) & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def dealt(keys: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """bucket, size, keys and counts of each bucket, from sorted keys."""
    order = np.argsort(bucket, kind="stable")
    keys, n, bucket = keys[order], n[order], bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        yield int(bucket[a]), b - a, packed(keys[a:b], rising=True), packed(n[a:b].astype(np.uint64))


def part_rows(rows: list[tuple]) -> pa.Table:
    names = ["kind", "unit", "bucket", "size", "keys", "vals"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def gather(docs: DataFrame) -> DataFrame:
    """The units: rows of doc_id, held_out and text, and what each unit has of every bucket, different keys with their times in
    training documents: words (by hash), grams of three bytes and the next, grams. Without ``held_out`` all is for training."""
    spark = docs.sparkSession
    ship_code(spark)
    buckets, words_most, grams_most, unit_bytes, block_bytes = bucket_count(spark), SHARED_WORDS, SHARED_GRAMS, UNIT_BYTES, COUNT_BYTES
    if "held_out" not in docs.columns:
        docs = docs.withColumn("held_out", F.lit(False))
    docs = docs.select("doc_id", "held_out", "text")
    doc_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, seen = TaskContext.get().partitionId() << 32, 0
        held, fresh = {WORDS: [], GRAMS: []}, {WORDS: 0, GRAMS: 0}
        kinds = None

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys, n = zip(*held.pop(kind), strict=True)
            held[kind], fresh[kind] = [added(np.concatenate(keys), np.concatenate(n))], 0
            return held[kind][0]

        def asked() -> Iterator[pa.RecordBatch]:
            keys, n = merged(WORDS)
            rows = [(WORDS, unit, *x) for x in dealt(keys, n, (keys % np.uint64(buckets)).astype(np.int64))]
            keys, n = merged(GRAMS)
            short, m = added(keys & np.uint64(0xFFFFFFFF), n)
            rows += [(SHORT, unit, *x) for x in dealt(short, m, (mix((cell_of(short) >> 8).astype(np.uint64)) % np.uint64(LEAST_BUCKETS)).astype(np.int64))]
            keys, n = added(turned(keys), n)
            rows += [(GRAMS, unit, *x) for x in dealt(keys, n, by_three(turned(keys), buckets))]
            table = part_rows(rows)
            for name in ("doc_id", "held_out", "text"):
                table = table.append_column(name, pa.nulls(table.num_rows, kinds.field(name).type))
            yield from table.combine_chunks().to_batches()

        for batch in batches:
            kinds = batch.schema
            for rows, raw, offs in blocks(batch, 2, block_bytes):
                raw = LOWER[raw]
                out = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
                words = Words(raw, offs)
                for kind, keys, which in ((WORDS, words.hashes(), out[words.row]), (GRAMS, deep_grams(raw, offs), np.repeat(out, np.diff(offs) + 1))):
                    for some in tallied(keys, which):
                        held[kind].append(some)
                        fresh[kind] += len(some[0])
                    if fresh[kind] > HELD_ENTRIES:
                        merged(kind)
                seen += len(raw)
                n = rows.num_rows
                none = [pa.nulls(n, k) for k in (pa.int32(), pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, TEXT, np.int32)), pa.array(np.full(n, unit)), *none, *rows.columns],
                    ["kind", "unit", "bucket", "size", "keys", "vals", "doc_id", "held_out", "text"],
                )
                if seen > unit_bytes or any(sum(len(keys) for keys, _ in held[kind]) > most for kind, most in ((WORDS, words_most), (GRAMS, grams_most))):
                    yield from asked()
                    unit, seen = unit + 1, 0
                    held, fresh = {WORDS: [], GRAMS: []}, {WORDS: 0, GRAMS: 0}
        if held[GRAMS]:
            yield from asked()

    parts = docs.mapInArrow(released(run), f"{PARTS}, doc_id {doc_kind}, held_out boolean, text string")
    return stored(parts, "ppm-parts", compression="zstd")


def nested(gram: np.ndarray, n: np.ndarray, levels: range, answer: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each level its grams, their log10 p, their contexts and the escapes of these, and last the answers: log10 of what
    each gram gets. ``gram``: all different ones of some contexts, with their times; ``answer``: what each gets at the first level."""
    cell, below = cell_of(gram), None
    for level in levels:
        keys, rep, of = np.unique(level_key(level, gram, cell), return_index=True, return_inverse=True)
        times = np.bincount(of, n, len(keys))
        new = np.append(True, keys[1:] >> np.uint64(8) != keys[:-1] >> np.uint64(8))[: len(keys)]
        first, at = np.flatnonzero(new), np.cumsum(new) - 1
        met = times > 0
        total, kinds = (np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (times, met.astype(np.float64)))
        every = np.maximum(total + kinds, 1)
        p = times / every[at]
        direct = np.log10(np.where(met, p, 1))
        escape = np.zeros(len(first))
        if below is None:
            own = answer[rep]
        else:
            of_below, p_below, own_below = below
            lower = of_below[rep]
            mass = np.add.reduceat(np.where(met, p_below[lower], 0), first) if len(first) else np.zeros(0)
            # the shorter context answers without the symbols that this one has
            escape = np.where(total > 0, np.log10(np.where(total > 0, kinds, every) / every) - np.log10(np.maximum(1 - mass, 1e-9)), 0.0)
            own = np.where(met, direct, own_below[lower] + escape[at])
        below = of, p, own
        yield keys[met], direct[met], (keys[first] >> np.uint64(8))[total > 0], escape[total > 0], own[of]


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


class Model:
    """The upper trie and the grams of three bytes and the next (``short``: bucket, key, n), from the units.

    Shipped as the counts of the upper trie; the tasks work out its table."""

    def __init__(self, parts: DataFrame):
        def total(table: pa.Table) -> pa.Table:
            keys, n = added(*_columns(table))
            return pa.table({"bucket": np.full(len(keys), table["bucket"][0].as_py(), np.int32), "key": keys.view(np.int64), "n": n.view(np.int64)})

        with shuffles_freed(parts.sparkSession):
            short = parts.filter(F.col("kind") == SHORT).select("bucket", "size", "keys", "vals")
            self.short = stored(short.groupBy("bucket").applyInArrow(total, "bucket int, key bigint, n bigint"), "ppm-short")

        def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, n = added(cell_of(batch.column(0).to_numpy().view(np.uint64)).astype(np.int64), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["cell", "n"])

        upper = self.short.filter("n > 0").select("key", "n").mapInArrow(to_cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
        upper = upper.toArrow()  # at most CELLS rows
        self.upper = upper["cell"].to_numpy().astype(np.int32), narrow(upper["n"].to_numpy())

    @cached_property
    def table(self) -> np.ndarray:
        trie = np.zeros(CELLS, self.upper[1].dtype)
        trie[self.upper[0]] = self.upper[1]
        return log_table(trie)

    @cached_property
    def _next(self) -> tuple[np.ndarray, ...]:
        """The level next to the upper trie; its grams are bounded by a byte, two classes and the symbol."""
        def to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(0).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(level_key(1, key, cell_of(key)).view(np.int64)), *batch.columns], ["first", "key", "n"])

        rows = self.short.select("key", "n").mapInArrow(to_first, "first bigint, key bigint, n bigint")
        rows = rows.groupBy("first").agg(F.min("key").alias("key"), F.sum("n").alias("n")).toArrow()
        gram = rows["key"].to_numpy().view(np.uint64)
        return list(nested(gram, rows["n"].to_numpy(), range(2), self.table[cell_of(gram)].astype(np.float64)))[-1]

    grams = property(lambda self: self._next[0])
    direct = property(lambda self: self._next[1])
    contexts = property(lambda self: self._next[2])
    escape = property(lambda self: self._next[3])

    def __getstate__(self) -> dict:
        return {"upper": self.upper}


def _columns(table: pa.Table, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The keys and values of some rows of units, one after the other."""
    size = table["size"].to_pylist()
    keys = [unpacked(k, n, rising=True) for k, n in zip(table["keys"].to_pylist(), size, strict=True)]
    vals = [unpacked(v, n, kind) for v, n in zip(table["vals"].to_pylist(), size, strict=True)]
    return tuple(np.concatenate([np.zeros(0, t), *x]) for x, t in ((keys, np.uint64), (vals, kind)))


def short_answers(model: Model, buckets: int) -> DataFrame:
    """The answers to the grams of three bytes and the next, for the buckets of the longer ones (unit -1)."""
    shared = model.short.sparkSession.sparkContext.broadcast(model)

    def run(table: pa.Table) -> pa.Table:
        gram = table["key"].to_numpy().view(np.uint64)
        order = np.argsort(gram)
        gram = gram[order]
        *_, last = nested(gram, table["n"].to_numpy()[order], range(ORDER + 1), shared.value.table[cell_of(gram)].astype(np.float64))
        return part_rows([(GRAMS, -1, *x) for x in dealt(gram, last[-1].view(np.uint64), by_three(gram, buckets))])

    return model.short.groupBy("bucket").applyInArrow(run, PARTS)


def answers(parts: DataFrame, short: DataFrame) -> DataFrame:
    """For each unit its words with their training counts and its grams with their log10 probabilities; for unit -1 the number of
    different words and of all in training documents."""

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"][0].as_py()
        own = table.filter(pa.compute.greater_equal(table["unit"], 0))
        keys, n = _columns(own)
        if not len(keys):
            return part_rows([])
        keys, of = np.unique(keys, return_inverse=True)
        n = np.bincount(of, n, len(keys))
        rows = []
        if kind == WORDS:
            val = n.astype(np.uint64)
            rows.append((WORDS, -1, 0, 2, None, packed(np.array([(n > 0).sum(), n.sum()], np.uint64))))
        else:
            key, known = _columns(table.filter(pa.compute.less(table["unit"], 0)), np.float64)
            order = np.argsort(key)
            gram = turned(keys)
            at = order[np.searchsorted(key[order], gram & np.uint64(0xFFFFFFFF))]
            *_, last = nested(gram, n, range(ORDER, DEEP + 1), known[at])
            val = last[-1].astype(np.float32)
        a = 0
        for unit, size, k in zip(own["unit"].to_pylist(), own["size"].to_pylist(), own["keys"].to_pylist(), strict=True):
            rows.append((kind, unit, 0, size, k, packed(val[of[a : a + size]])))
            a += size
        release()
        return part_rows(rows)

    asked = parts.filter(F.col("kind").isin(WORDS, GRAMS)).select("kind", "unit", "bucket", "size", "keys", "vals")
    return asked.unionByName(short).groupBy("kind", "bucket").applyInArrow(run, PARTS)


def unit_scores(docs: pa.Table, words: tuple[np.ndarray, np.ndarray], grams_: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """doc_id, held_out, n_tokens, known, base, score of a unit's texts. base: log10 of each word's count and a half, added up."""
    words_at, count = LongTable(words[0]), words[1].astype(np.int64)
    gram = turned(grams_[0])
    order = np.argsort(gram)
    gram, bits = gram[order], grams_[1][order].astype(np.float64)
    weight = np.log10(count + 0.5)
    for batch in docs.combine_chunks().to_batches():
        for a in range(0, batch.num_rows, 256):  # a row's number takes the eight bits that a gram leaves
            for rows, raw, offs in blocks(batch.slice(a, 256), 2, BLOCK_BYTES):
                raw = LOWER[raw]
                n = rows.num_rows
                key = deep_grams(raw, offs) << np.uint64(8) | np.repeat(np.arange(n, dtype=np.uint64), np.diff(offs) + 1)
                key.sort()
                each = key >> np.uint64(8)
                new = np.append(True, each[1:] != each[:-1])
                at = np.searchsorted(gram, each[new])
                score = np.bincount((key & np.uint64(255)).astype(np.int64), bits[at[np.cumsum(new) - 1]], n)
                found = Words(raw, offs)
                at = words_at.get(found.hashes())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), rows.column(1), pa.array(np.diff(found.edges) + 1), pa.array(row_reduce(np.add, (count[at] > 0).astype(np.int64), found.edges)),
                        pa.array(row_reduce(np.add, weight[at], found.edges)), pa.array(score), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "known", "base", "score", "v", "n"],
                )


def unit_rows(parts: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``unit_scores`` for every unit; those without ``held_out`` hold v and n, which add up to V and N."""
    kind = parts.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        which = table["kind"]
        docs = table.filter(pa.compute.equal(which, TEXT)).select(["doc_id", "held_out", "text"])
        names = ["doc_id", "held_out", "n_tokens", "known", "base", "score", "v", "n"]
        if table["unit"][0].as_py() < 0:
            v, n = np.sum([unpacked(x, 2).astype(np.int64) for x in table["vals"].to_pylist()], axis=0).tolist()
            columns = [pa.nulls(1, docs.schema.field("doc_id").type), pa.nulls(1, pa.bool_()), *[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]]
            return pa.table([*columns, pa.array([v]), pa.array([n])], names)
        own = [_columns(table.filter(pa.compute.equal(which, k)), t) for k, t in ((WORDS, np.uint64), (GRAMS, np.float32))]
        out = pa.Table.from_batches(unit_scores(docs, *own))
        release()
        return out

    texts = parts.filter(F.col("kind") == TEXT).select("kind", "unit", "size", "keys", "vals", "doc_id", "held_out", "text")
    both = texts.unionByName(found.select("kind", "unit", "size", "keys", "vals"), allowMissingColumns=True)
    fields = f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double, v bigint, n bigint"
    return both.groupBy("unit").applyInArrow(run, fields)


def lm_scores(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    spark = docs.sparkSession
    parts = gather(docs.select("doc_id", "text", (fold(F.col("doc_id"), 5) == 1).alias("held_out")))
    model = Model(parts)
    found = answers(parts, short_answers(model, bucket_count(spark)))
    with shuffles_freed(spark):
        rows = stored(unit_rows(parts, found), "ppm-rows")
    discard(parts)
    discard(model.short)
    sums = rows.agg(
        F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(~F.col("held_out"), 1)).alias("ends")
    ).first()
    tokens = sums.n + sums.ends
    divisor = float(np.log10(tokens + 0.5 * (sums.v + (1 if sums.ends else 0) + 1)))
    end = float(np.log10(sums.ends + 0.5))
    return rows.filter("held_out IS NOT NULL").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.lit(1 if sums.ends else 0)).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.lit(end) - F.col("n_tokens") * F.lit(divisor)).alias("base_score"),
        "score",
    )
