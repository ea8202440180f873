"""Operator 12 [native], mixing sources to target weights by capped water-filling.

Every source has a weight and a cap, ``max_epochs`` times its size in words. The sources share ``share`` of all words by
weight. In rounds, sources above their cap are clamped to it and the excess goes to the others by weight, until none is
above. A round is one aggregate over the table of sources; the driver sees two sums. All of it is integer arithmetic:
the level is a fraction of two sums, so reruns give the same targets.

A source's target is whole repetitions of all its documents and a fractional one. For the latter the documents of the
source are put in a seeded order (a hash of seed, id and text) and taken while their middle lies below the goal. That is done
for the large documents first, then for the middling and the small ones (``TIERS``), and what a tier takes too little or too much
is made up by the next, so the words taken differ from the target by half a small document, or by half a large one where a
source has too few small ones. The order is worked out by ranges (``order.py``), so no source is sorted in one task.

``mix`` gives a row for each document, ``mixture`` the documents themselves, repeated as the mix takes them.

Defined cases: null text has no words; a null source is a source of its own, after all others; a source without words has
the target 0; rows that repeat id and text are documents of their own, and any of them may be the one that is taken; with a
``share`` above ``max_epochs`` every source is at its cap; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise.llm.common import stored
from trackwise.llm.order import attach, compact, place, ranged, running

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MAX_EPOCHS = 2
SEED = "mix-1"
#: Documents of more than a 20th of their source's words are drawn first, then those of more than a 400th, then the others.
TIERS = (20, 400)


def big(c: Column | int) -> Column:
    """A whole number of up to 38 digits."""
    return F.lit(Decimal(c)).cast("decimal(38,0)") if isinstance(c, int) else c.cast("decimal(19,0)")


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw_key(seed: str, doc_id: Column, text: Column) -> Column:
    """The seeded place of a document among those of its source."""
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 16)


def ranked_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, weight): the weights repeat over the sources by code point, null last."""
    rows = sources.withColumn("_none", F.col("source").isNull())
    by, order = [], ["_none", "source"]
    rows = place(ranged(rows, by, order, rows.count()), by, order, "_place")
    at = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    return rows.select("source", "source_size", at.cast("long").alias("weight"))


def water_level(sources: DataFrame, share: Fraction, max_epochs: int) -> tuple[int, int] | None:
    """The words for each unit of weight, as numerator and denominator; None if every source is clamped.

    The level never falls from round to round, so a clamped source stays clamped and the level is all there is to remember."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level, clamped = share * total, None, -1
    cap = big(F.col("source_size") * max_epochs)
    while True:
        above = F.lit(False) if level is None else big(F.col("weight")) * big(level[0]) > cap * big(level[1])
        seen = sources.agg(
            F.count_if(above).alias("n"),
            F.sum(F.when(above, cap)).alias("caps"),
            F.sum(F.when(~above, F.col("weight"))).alias("weights"),
        ).first()
        if not seen["weights"]:
            return None
        if seen["n"] == clamped:
            return level
        clamped = seen["n"]
        rest = (budget - int(seen["caps"] or 0)) / seen["weights"]
        level = rest.numerator, rest.denominator


def targets(sources: DataFrame, share: Fraction = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``, ``whole`` repetitions, and ``goal / den``: the words of
    the fractional one."""
    level = water_level(sources, share, max_epochs)
    size, none = F.col("source_size"), F.col("source_size") == 0
    cap = big(size * max_epochs)
    if level is None:
        return sources.select(
            "*", (size * max_epochs).cast("double").alias("target"), F.when(none, 0).otherwise(max_epochs).alias("whole"),
            big(0).alias("goal"), big(1).alias("den"),
        )
    num, den = big(level[0]), big(level[1])
    wanted = big(F.col("weight")) * num
    full = wanted > cap * den
    times = [(wanted >= big(size) * den * big(k)).cast("int") for k in range(1, max_epochs + 1)]  # decimal division would round
    whole = F.when(none, 0).when(full, max_epochs).otherwise(sum(times, F.lit(0)))
    rows = sources.select("*", wanted.alias("_wanted"), full.alias("_full"), whole.cast("int").alias("whole"))
    goal = F.col("_wanted") - big(F.col("whole")) * big(size) * den
    target = F.when(F.col("_full"), (size * max_epochs).cast("double")).otherwise(
        F.col("_wanted").cast("double") / F.lit(float(level[1]))
    )
    rows = rows.withColumns({"target": target, "goal": F.when(F.col("_full") | none, big(0)).otherwise(goal), "den": den})
    return rows.drop("_wanted", "_full")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """(doc_id, key, size, source, source_size, target, repeats, taken), one row a document."""
    rows = stored(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"),
            draw_key(seed, F.col("doc_id"), F.col("text")).alias("key"),
        ),
        "mix-sizes",
    )
    sources = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    plan = targets(stored(ranked_weights(sources, weights), "mix-weights"), share, max_epochs)
    count = rows.count()
    by, order = ["source"], ["key", "doc_id", "size"]
    placed = attach(ranged(rows, by, order, count), by, plan.drop("weight"))
    size, den = F.col("size"), F.col("den")
    tier = sum(((size * t <= F.col("source_size")).cast("int") for t in TIERS), F.lit(0))
    placed = placed.withColumns({"tier": tier, "extra": F.lit(0)})
    for k in range(len(TIERS) + 1):
        # a tier's goal is its share of the source's, and what the tiers before it took too little or too much
        so_far = placed.groupBy("source").agg(
            F.sum(F.when(F.col("tier") <= k, size)).alias("upto"), F.sum(F.when(F.col("extra") == 1, size)).alias("drawn")
        )
        placed = attach(placed, by, stored(so_far, "mix-drawn"))
        scale = den * big(F.col("source_size"))
        goal = F.col("goal") * big(F.coalesce("upto", F.lit(0))) - big(F.coalesce("drawn", F.lit(0))) * scale
        own = F.col("tier") == k
        placed = running(placed, by, order, F.when(own, size).otherwise(0), "before")
        extra = F.when(own, (big(2 * F.col("before") + size) * scale < 2 * goal).cast("int")).otherwise(F.col("extra"))
        placed = stored(compact(placed.withColumn("extra", extra).drop("before", "drawn", "upto"), count), "mix-placed")
    repeats = F.col("whole") + F.col("extra")
    return placed.select(
        "doc_id", "key", "size", "source", "source_size", "target", repeats.alias("repeats"), (size * repeats).alias("taken")
    )


def mixture(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it.

    Rows that repeat id and text are put together before they are repeated (others move as they are)."""
    taken = mix(docs, weights, share, max_epochs, seed).groupBy("doc_id", "key", "source").agg(
        F.sum("repeats").cast("int").alias("_mix_times"), F.count("*").alias("_mix_rows")
    ).filter("_mix_times > 0")
    taken = taken.select(
        F.col("doc_id").alias("_mix_id"), F.col("key").alias("_mix_key"), F.col("source").alias("_mix_source"), "_mix_times", "_mix_rows"
    )
    rows = docs.withColumn("_mix_own", draw_key(seed, F.col("doc_id"), F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & F.col("source").cast("string").eqNullSafe(F.col("_mix_source"))
    rows = rows.join(taken, (F.col("_mix_own") == F.col("_mix_key")) & same)
    once = rows.filter("_mix_rows = 1").drop("_mix_rows")
    many = rows.filter("_mix_rows > 1").drop("_mix_rows").dropDuplicates(["_mix_id", "_mix_key", "_mix_source"])
    both = once.unionByName(many).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times"))))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])


def _tier_sql() -> str:
    """A step for each tier: its running sum, and what it draws of the goal that the tiers before it have left."""
    out, names = [], []
    for k in range(len(TIERS) + 1):
        done = " + ".join(f"coalesce(sum(size) FILTER (WHERE x{i}) OVER (PARTITION BY source), 0)" for i in range(k)) or "0"
        out.append(f"""b{k} AS (
  SELECT *, goal * coalesce(sum(size) FILTER (WHERE tier <= {k}) OVER (PARTITION BY source), 0)::HUGEINT
           - den * source_size * ({done})::HUGEINT AS g{k}, coalesce(sum(CASE WHEN tier = {k} THEN size ELSE 0 END) OVER (
    PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS s{k}
  FROM {f"e{k - 1}" if k else "p"}
), e{k} AS (SELECT *, tier = {k} AND (2 * s{k} + size) * den * source_size < 2 * g{k} AS x{k} FROM b{k})""")
        names.append(f"x{k}")
    return ", ".join(out) + f"""
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN {" OR ".join(names)} THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e{len(TIERS)}
"""


#: DuckDB: the level from the sources sorted by cap for a unit of weight, instead of rounds.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')), 1, 16) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
         ([{", ".join(map(str, WEIGHTS))}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}]::HUGEINT AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS place FROM s
), c AS (
  SELECT *, {SHARE.numerator} * (sum(source_size) OVER ())::HUGEINT
              - {SHARE.denominator} * {MAX_EPOCHS} * coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS num,
         {SHARE.denominator} * (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS den
  FROM r
), l AS (  -- the first source that its own level leaves below the cap sets the level of all
  SELECT num, den FROM c WHERE weight * num <= {MAX_EPOCHS} * source_size * den ORDER BY place LIMIT 1
), t AS (
  SELECT s.*, l.num, l.den, l.num IS NULL OR weight * l.num > {MAX_EPOCHS} * source_size * l.den AS is_full
  FROM s LEFT JOIN l ON true
), w AS (
  SELECT *, CASE WHEN is_full THEN ({MAX_EPOCHS} * source_size)::DOUBLE ELSE (weight * num)::DOUBLE / den::DOUBLE END AS target,
         CASE WHEN source_size = 0 THEN 0 WHEN is_full THEN {MAX_EPOCHS} ELSE (weight * num) // (source_size * den) END AS whole
  FROM t
), p AS (
  SELECT d.doc_id, d.size, d.key, w.*, {" + ".join(f"(CASE WHEN d.size * {t} <= source_size THEN 1 ELSE 0 END)" for t in TIERS)} AS tier,
         CASE WHEN is_full OR source_size = 0 THEN 0 ELSE weight * num - whole * source_size * den END AS goal
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
), """ + _tier_sql()
