"""Operator 9, MinHash near-dedup with odd sketches.

1. One pass makes each document's row: the number of distinct shingles, a
   128-bit key of the set, band keys of its MinHash samples and the odd sketch, a bitmap in which each (sample
   number, sample) flips one bit. Documents with equal keys are one class; only
   one row a class goes on, so exact copies never form pairs.
2. Classes that share a band key are candidates. In each shared band one member, the heaviest, is the centre
   and the others are compared with it on full sets (a star, never all pairs). Members that have not come into
   the centre's component form a star around the heaviest of them, and so on for ``STAR_ROUNDS`` rounds: that joins
   the families of copies that a band holds.
3. Two members of a band that are both linked with its first centre are in one component already. What is left are
   links between components of a member x that is not linked with that centre c. The size of the symmetric difference is a
   metric, and x and y differ in as many shingles as their differences from c do. So if x and y are linked,
   their differences from c share many elements, and by prefix filtering one of the first few in a fixed order: those that
   c lacks first, as edits of copies rarely agree there. An equi-join on (centre, element) with the ranks' bounds
   finds every such pair without pairing off a group of near copies; what passes the sizes and the
   sketches (the exclusive-or has few bits) is confirmed on full sets.
4. Components of the confirmed links are found by alternating large-star and small-star steps.

With b bands of r samples a pair of similarity s is no candidate with
probability (1 - s**r)**b: 3e-6 at 0.8 and 2e-8 at 0.85 for 24 bands of 4.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]`` with A-Z folded. Shingles are compared as 64-bit hashes.

Defined cases: a text of fewer words than a shingle has its whole sequence as one; null, empty and blank
texts have no shingles and link with nothing; rows that repeat a ``doc_id`` share its component;
the component of rows without an id only is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwise.llm.common import released, ship_code, stored
from trackwise.llm.textbatch import LOWER, Words, blocks, distinct_by_row, forget_powers, mix, row_reduce

BANDS, ROWS = 24, 4
SKETCH = 256
STAR_ROUNDS = 2
_STEP = np.uint64(0xD1342543DE82EF95)
_I = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
_MULTIPLY, _ADD = mix(_I * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix(_I + np.uint64(0x1234567))


def shingles(raw: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, and the row edges."""
    words = Words(LOWER[raw], offs)
    h, edges = words.hashes(), words.edges
    count = np.diff(edges)
    left = np.repeat(edges[1:], count) - np.arange(len(h))  # words from here to the row's end
    first = np.repeat(edges[:-1], count) == np.arange(len(h))
    short = np.repeat(count, count) < size
    total = np.zeros(len(h), np.uint64)
    weights = np.full(size, _STEP).cumprod(dtype=np.uint64)
    for j in range(size):
        at = np.flatnonzero(left > j)
        total[at] += h[at + j] * weights[j]
    keep = (left >= size) | (first & short)
    values = mix(total[keep] + np.minimum(left[keep], size).astype(np.uint64))
    kept = np.concatenate([[0], np.cumsum(keep)])
    return distinct_by_row(values, kept[edges])


def signatures(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows × BANDS) and odd sketches (rows × SKETCH / 64), as int64."""
    n = len(edges) - 1
    low = np.empty((n, BANDS * ROWS), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(BANDS * ROWS):
            low[:, i] = row_reduce(np.minimum, values * _MULTIPLY[i] + _ADD[i], edges)
        bands = np.zeros((n, BANDS), np.uint64)
        for r in range(ROWS):
            bands = mix(bands * _STEP + low[:, r::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64))
        spot = (mix(low + _I) >> np.uint64(64 - int(math.log2(SKETCH)))).astype(np.int64)
    flips = np.bincount((spot + np.arange(n)[:, None] * SKETCH).ravel(), minlength=n * SKETCH).reshape(n, SKETCH) & 1
    sketch = np.packbits(flips.astype(np.uint8), axis=1).view(np.int64)
    return bands.view(np.int64), sketch


def most_bits(num: int, den: int) -> int:
    """The exclusive-or of two sketches has more bits than this only far below the similarity num / den
    (five standard deviations of the samples that differ, three of the sketch)."""
    k, s = BANDS * ROWS, num / den
    differ = min(k, k * (1 - s) + 5 * math.sqrt(k * s * (1 - s)))
    share = 1 - math.exp(-4 * differ / SKETCH)
    return min(SKETCH, math.ceil(SKETCH / 2 * share + 3 * math.sqrt(SKETCH / 4 * share)))


def describe(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document: doc_id, text_hash, n, key, bands, sketch (stored)."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offs in blocks(batch, 2):
                values, edges = shingles(raw, offs, size)
                bands, sketch = signatures(values, edges)
                n = np.diff(edges)
                one = row_reduce(np.add, mix(values), edges).view(np.int64)
                two = row_reduce(np.add, mix(values ^ _STEP), edges).view(np.int64)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(n.astype(np.int64)), pa.array(one), pa.array(two), lists(bands), lists(sketch)], names
                )

    names = ["doc_id", "text_hash", "n", "key1", "key2", "bands", "sketch"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, text_hash bigint, n bigint, key1 bigint, key2 bigint, bands array<bigint>, sketch array<bigint>"
    shown = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return stored(shown.mapInArrow(released(run, forget_powers), fields).withColumn("rid", F.monotonically_increasing_id()), "minhash-rows")


def compare(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """For pairs (a, b): linked (den * common >= num * union), differ (the size of the symmetric difference), na,
    nb, and ``first``: elements of the difference, those of b before those of a, each in the order of hashes. As many
    as a link of b with something that a is not linked with, or of an unlinked b with anything, can need;
    ``right`` is how many the former can need. ``texts``: node, text."""
    with_b = pairs.join(texts.withColumnRenamed("node", "b").withColumnRenamed("text", "text_b"), "b")
    with_both = with_b.join(texts.withColumnRenamed("node", "a").withColumnRenamed("text", "text_a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offs in blocks(batch, 2):
                va, ea = shingles(raw, offs, size)
                _, raw_b, offs_b = next(blocks(rows, 3, 1 << 62))
                vb, eb = shingles(raw_b, offs_b, size)
                na, nb = np.diff(ea), np.diff(eb)
                row = np.concatenate([np.repeat(np.arange(len(e) - 1), np.diff(e)) for e in (ea, eb)])
                both, own = np.concatenate([va, vb]), np.repeat([False, True], [len(va), len(vb)])
                order = np.lexsort((both, row))
                both, row, own = both[order], row[order], own[order]
                same = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
                common = np.bincount(row[1:][same], minlength=rows.num_rows)
                linked = den * common >= num * (na + nb - common)
                alone = ~(np.append(same, False) | np.append(False, same))
                both, row, own = both[alone], row[alone], own[alone]
                order = np.lexsort((both, ~own, row))
                both, row = both[order], row[order]
                edges = np.searchsorted(row, np.arange(rows.num_rows + 1))
                differ = np.diff(edges)
                share = (den - num) / (den + num)
                most = np.floor(share * nb * (1 + den / num)).astype(np.int64)  # the largest difference from a partner
                other = np.floor(share * (na + nb * num / den)).astype(np.int64)  # an unlinked partner differs more from a
                right = np.clip((differ - other + most) // 2 + 1, 0, differ)
                keep = np.maximum(right, np.where(linked, 0, np.minimum(differ, most + 1)))
                rank = np.arange(len(both)) - np.repeat(edges[:-1], differ)
                both = both[rank < np.repeat(keep, differ)]
                cut = pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), rows.column(1), pa.array(linked), pa.array(na), pa.array(nb), pa.array(differ),
                        pa.array(right), pa.ListArray.from_arrays(cut, pa.array(both.view(np.int64))),
                    ],
                    ["a", "b", "linked", "na", "nb", "differ", "right", "first"],
                )

    fields = "a bigint, b bigint, linked boolean, na bigint, nb bigint, differ bigint, right bigint, first array<bigint>"
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(released(run, forget_powers), fields)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the edges (a, b).

    Large-star and small-star in turn, until every node has one edge and that to a node without one; each step's
    edges are stored, so neither lineage nor the driver grows. A centre's smallest neighbour comes from an
    aggregate with partial results."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's own edge to its minimum stays, so that it is not lost
        large = large.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = stored(small, "cc")
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if each.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


class NearDups:
    """Rows, classes and components of one run; see the module text."""

    def __init__(self, docs: DataFrame, size: int, num: int, den: int):
        self.size, self.num, self.den = size, num, den
        self.rows = describe(docs, size)
        classes = self.rows.filter("n > 0").groupBy("key1", "key2").agg(
            F.min(F.struct("rid", "doc_id", "text_hash")).alias("r"), F.min("doc_id").alias("min_id")
        )
        self.classes = stored(
            classes.select("key1", "key2", "min_id", F.col("r.rid").alias("node"), F.col("r.doc_id").alias("doc_id"), F.col("r.text_hash").alias("text_hash")),
            "minhash-classes",
        )
        self.texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
        self.links = self._links()

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """node, text of some nodes, stored: the only texts that are moved on."""
        where = self.classes.select("node", "doc_id", "text_hash").join(nodes, "node")
        found = self.texts.join(where, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")))
        return stored(found.select("node", "text").dropDuplicates(["node"]), "minhash-texts")

    def _compare(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        return stored(compare(pairs, texts, self.size, self.num, self.den), "minhash-compared")

    @staticmethod
    def _stars(banded: DataFrame) -> DataFrame:
        """key, node, weight, a: the other members of each band, with its heaviest as the centre ``a``."""
        best = banded.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("m"))).alias("b"))
        best = stored(best.select("key", (-F.col("b.m")).alias("a")), "minhash-centres")  # stored, so that the join may split hot keys
        return stored(banded.join(best, "key").filter("node <> a"), "minhash-members")

    def _links(self) -> DataFrame:
        nodes = stored(self.rows.join(self.classes.select(F.col("node").alias("rid")), "rid", "left_semi").select("rid", "sketch", "bands"), "minhash-nodes")
        banded = nodes.select(F.col("rid").alias("node"), F.explode("bands").alias("key"))
        shared = stored(banded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "minhash-shared")
        # the centre of a band is the member that meets the most others in all its bands: of a family of edited
        # copies the least edited, so that differences from it are the others' own
        met = stored(banded.join(shared, "key"), "minhash-met")
        weight = stored(met.groupBy("node").agg(F.sum("c").alias("weight")), "minhash-weights")
        member = self._stars(met.drop("c").join(weight, "node"))
        texts = self._texts(weight.select("node"))
        stars = self._compare(member.select("a", F.col("node").alias("b")).distinct(), texts)
        links = stars.filter("linked").select("a", "b")
        labels = components(links)
        for _ in range(1, STAR_ROUNDS):
            root = labels.select(F.col("node").alias("n"), "root")
            member = member.join(root.withColumnsRenamed({"n": "node", "root": "own"}), "node", "left")
            member = member.join(root.withColumnsRenamed({"n": "a", "root": "main"}), "a", "left")
            apart = F.coalesce("own", "node") != F.coalesce("main", "a")
            member = self._stars(stored(member.filter(apart).select("key", "node", "weight"), "minhash-members"))
            pairs = member.select("a", F.col("node").alias("b")).distinct()
            links = links.unionByName(self._compare(pairs, texts).filter("linked").select("a", "b"))
            labels = components(links)

        # members of a first star whose centre has someone unlinked; their sketches and components go along
        open_ = stars.filter("NOT linked").select("a").distinct()
        member = stars.join(open_, "a", "left_semi").join(labels.select(F.col("node").alias("b"), "root"), "b", "left")
        member = member.join(nodes.select(F.col("rid").alias("b"), "sketch"), "b")
        member = stored(member.withColumn("root", F.coalesce("root", "b")), "minhash-open")
        columns = ["b", "root", "sketch", F.col("nb").alias("n"), "differ"]
        left = member.filter("NOT linked").select("a", F.struct(*columns).alias("x"), F.posexplode("first").alias("rx", "e"))
        right = member.select("a", F.struct(*columns).alias("y"), F.posexplode(F.slice("first", 1, F.col("right").cast("int"))).alias("ry", "e"))
        # elements that only one component has lead nowhere
        roots = left.select("a", "e", F.col("x.root").alias("root")).unionByName(right.select("a", "e", F.col("y.root").alias("root")))
        several = roots.groupBy("a", "e").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("a", "e")
        several = stored(several, "minhash-elements")
        left, right = left.join(several, ["a", "e"], "left_semi"), right.join(several, ["a", "e"], "left_semi")
        bits = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
        # twice the number of common elements that a link needs; a rank that leaves fewer rules the pair out
        need = f"(x.differ + y.differ - floor((x.n + y.n) * {self.den - self.num} / {self.den + self.num}))"
        fits = (
            f"x.root <> y.root AND 2 * rx <= 2 * x.differ - {need} AND 2 * ry <= 2 * y.differ - {need} "
            f"AND {self.den} * least(x.n, y.n) >= {self.num} * greatest(x.n, y.n)"
        )
        near = left.join(right, ["a", "e"]).filter(F.expr(fits) & (bits <= most_bits(self.num, self.den)))
        rest = near.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()
        more = self._compare(rest, texts).filter("linked").select("a", "b")
        self.labels = components(links.unionByName(more))
        return links.unionByName(more)

    def documents(self) -> DataFrame:
        """doc_id, text_hash, n, component_id: a row for each document."""
        placed = self.classes.join(self.labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = placed.groupBy("root").agg(F.min("min_id").alias("component_id"))
        placed = placed.join(least, "root").select("key1", "key2", "component_id")
        full = self.rows.filter("n > 0").join(placed, ["key1", "key2"])
        bare = self.rows.filter("n = 0").withColumn("component_id", F.col("doc_id"))
        columns = ["doc_id", "text_hash", "n", "component_id"]
        return full.select(*columns).unionByName(bare.select(*columns))


def near_dedup(docs: DataFrame, size: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """The contract's row for each document."""
    got = NearDups(docs.select("doc_id", "text"), size, num, den).documents()
    return got.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def survivors(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group, and every document without shingles, as they came.

    Rows that repeat both id and text stay or go together."""
    got = NearDups(docs.select("doc_id", "text"), size, num, den).documents()
    kept = got.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h"))
    return docs.join(kept, same, "left_semi").select(*docs.columns)
