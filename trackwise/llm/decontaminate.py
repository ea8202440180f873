"""Operator 2, benchmark decontamination in DataFrame functions only.

Words are maximal runs of letters and digits in lower case; shingles are ``SIZE`` words (an
item with fewer words is one shingle of all its words), and a shingle weighs as
often as it occurs. The similarity of a window and an item is the weighted Jaccard index: the
sum of the smaller weights over the sum of the larger ones. A document is contaminated by an item
if an item-sized window of it has a similarity of at least ``num / den``.

1. Windows. Of an item with m shingles any m - ceil(s m) + 1 must contain one that a window of
   similarity s shares, so only that many are looked up, the rarest ones of the benchmark first. Every shingle of
   every document is hashed; where one of those is found, the window that lines up with
   the item is cut out. No window that could qualify shares none.
2. Fingerprints. Each window and item gets a 64-bit SimHash of its weighted shingles.
   They are cut into ``BLOCKS`` blocks. Items are indexed by every block and by all its variants
   with one changed bit; by the pigeonhole principle, every pair within ``RADIUS = 2 * BLOCKS - 1`` bits agrees with an entry
   of one block, and an equi-join finds it. A pair of similarity 0.8 differs in 9.7 bits on average, standard
   deviation 2.9.
3. Verification. Pairs within the radius are kept if their exact similarity reaches the threshold.

The index is broadcast in parts of at most ``PART_ROWS`` rows, so a benchmark of any size keeps
broadcasts bounded; documents are not shuffled.

Defined cases: null and empty documents match nothing; null and empty items (no word) are left out;
documents shorter than an item are compared whole; repeated rows and ids give one row for each
(doc_id, item_id); ties of windows go to the first; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwise.llm.common import stored

SIZE = 5
BLOCKS = 12
RADIUS = 2 * BLOCKS - 1
PART_ROWS = 1_000_000
#: Bits of each block: 4 of 6 and 8 of 5 bits.
WIDTHS = [64 // BLOCKS + (i < 64 % BLOCKS) for i in range(BLOCKS)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(words: str, size: int) -> Column:
    """The hashes of all runs of ``size`` words; empty for fewer words."""
    parts = ", ".join(f"get({words}, i + {j})" for j in range(size))
    return F.expr(
        f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> xxhash64({size}, {parts})) "
        f"ELSE cast(array() AS array<bigint>) END"
    )


def occurrences(hashes: str) -> Column:
    """Each shingle with its occurrence number, so that set operations respect weights."""
    return F.expr(f"transform(array_sort({hashes}), (h, i) -> struct(h AS h, i + 1 - array_position(array_sort({hashes}), h) AS k))")


def fingerprint(hashes: str) -> Column:
    """The SimHash: bit b is set if more shingles have it than not."""
    votes = f"aggregate({hashes}, 0, (n, h) -> n + cast(shiftright(h, b) & 1 AS int))"
    return F.expr(
        f"aggregate(transform(sequence(0, 63), b -> CASE WHEN 2 * {votes} > size({hashes}) THEN shiftleft(1L, b) ELSE 0L END), 0L, (x, y) -> x | y)"
    )


def blocks(print_: str, changed: bool) -> Column:
    """The block values of a fingerprint as (block, value); ``changed``: with all one-bit variants too."""
    out, at = [], 0
    for i, width in enumerate(WIDTHS):
        value = f"cast(shiftrightunsigned({print_}, {at}) & {(1 << width) - 1} AS int)"
        flips = ["0"] + ([str(1 << b) for b in range(width)] if changed else [])
        out += [f"struct({i} AS block, {value} ^ {f} AS value)" for f in flips]
        at += width
    return F.expr(f"array({', '.join(out)})")


def describe(df: DataFrame, size: int) -> DataFrame:
    """Adds hashes, occurrences and fingerprint to rows with ``words``."""
    df = df.withColumn("hashes", shingles("words", size))
    return df.withColumn("bag", occurrences("hashes")).withColumn("print", fingerprint("hashes"))


def find(docs: DataFrame, items: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, item_id, start, similarity of qualifying windows for items that have ``size``-word shingles.

    ``items``: item_id, words, n."""
    items = stored(describe(items, size), "decontaminate-items")
    # the shingles to look up: the rarest ones of each item
    each = items.select("item_id", "n", F.size("hashes").alias("m"), F.posexplode("hashes").alias("j", "h"))
    rarity = each.groupBy("h").count()
    order = Window.partitionBy("item_id").orderBy("count", "h", "j")
    needed = F.col("m") - F.ceil(F.col("m") * num / den) + 1
    looked = each.join(rarity, "h").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= needed)
    looked = stored(looked.select("h", F.col("j").cast("int").alias("j"), "n").distinct(), "decontaminate-index")
    parts = max(1, -(-looked.count() // PART_ROWS))

    hashed = docs.withColumn("hashes", shingles("words", size))
    # the outer form: from the inner one the optimizer infers a filter that would split each text once more a word
    exploded = hashed.select("doc_id", "words", F.posexplode_outer("hashes").alias("p", "h"))
    first = F.greatest(F.lit(0), F.least(F.col("p") - F.col("j"), F.size("words") - F.col("n")))
    hits = [
        exploded.join(F.broadcast(looked.filter(F.pmod(F.xxhash64("h"), F.lit(parts)) == k)), "h")
        .select("doc_id", "n", first.alias("start"), "words")
        .select("doc_id", "n", "start", F.slice("words", F.col("start") + 1, F.col("n")).alias("words"))
        for k in range(parts)
    ]
    windows = reduce(DataFrame.unionByName, hits).distinct()
    windows = stored(describe(windows, size).drop("words", "hashes"), "decontaminate-windows")

    left = windows.withColumn("b", F.explode(blocks("print", False))).select("doc_id", "start", "n", "b.*", "print", "bag")
    right = items.withColumn("b", F.explode(blocks("print", True))).select(
        "item_id", "n", "b.*", F.col("print").alias("item_print"), F.col("bag").alias("item_bag")
    )
    near = left.join(right, ["n", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    common = F.size(F.array_intersect("bag", "item_bag"))
    whole = F.size("bag") + F.size("item_bag") - common
    return near.filter(common * den >= whole * num).select("doc_id", "item_id", "start", (common / whole).alias("similarity"))


def contamination(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100, size: int = SIZE) -> DataFrame:
    """A row for each (doc_id, item_id) found: the similarity of the best window and its first word's number."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    docs = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("words"))
    lengths = [r[0] for r in items.select(F.least("n", F.lit(size)).alias("k")).distinct().collect()]  # at most `size` rows
    found = [find(docs, items.filter(F.least("n", F.lit(size)) == k), k, num, den) for k in sorted(lengths)]
    if not found:
        return docs.join(items, F.lit(False)).select("doc_id", "item_id", F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    best = F.max_by(F.struct("start", "similarity"), F.struct("similarity", -F.col("start")))
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The documents in which no item was found, as they came; all rows of a found id go, rows without an id
    are told apart by their texts."""
    row = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("text"))
    found = contamination(docs.select(row.alias("doc_id"), "text"), benchmark, num, den).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, row == F.col("_found"), "left_anti")
