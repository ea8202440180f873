"""JN-07: company-key clustering.

Two keys name the same company when they are within one edit (Levenshtein ≤ 1)
or, when both are at least ``min_contain`` long, one contains the other.
"unknown" is never similar to anything.

Keys are walked in rank order (more rows first, then first seen); each key joins
the *first leader in rank order* it is similar to, else it becomes a leader.
That is an ordered greedy walk, not transitive closure, so the answer is not the
connected components of the similarity graph.

Distributed form:

1. Candidate pairs without a cartesian product, all exact:
   * substitution: keys of equal length that agree after deleting the same
     position — equi-join on (deletion variant, position, length);
   * insertion/deletion: a one-deletion variant of the longer key equals the
     shorter key — equi-join on the variant;
   * containment: the shorter key's rarest 7-gram must occur in the longer key —
     equi-join on that gram, then verify with ``instr``.
   Every join key is selective: a variant bucket holds at most one key per
   character value, and choosing the rarest gram keeps gram buckets small. Variants, parts and grams are several a key,
   which the size of the key table doesn't tell: their joins are merge joins, so the driver never gathers them.
2. Leader election over the edge list only. A key without an earlier neighbour leads; one with a leader among its earlier
   neighbours follows; one whose earlier neighbours all follow leads. A key that hangs on a single undecided neighbour is
   its opposite, so whoever looks at it may look at that neighbour instead and count the turn: chains shrink to half in each
   round, and rounds grow with the logarithm of their length. A round is a join and two aggregates over the
   undecided edges, written to the shared folder.
3. canonical = the earliest-ranked leader among a follower's earlier neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.session import stored

UNKNOWN = "unknown"


def _deletions(keys: DataFrame) -> DataFrame:
    """(key, len, pos, variant) for every single-character deletion."""
    k = keys.filter(F.col("len") >= 1)
    return k.select(
        "key",
        "len",
        F.posexplode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i", "pos"),
    ).select(
        "key",
        "len",
        "pos",
        F.concat(F.substring("key", 1, F.col("pos")), F.expr("substring(key, pos + 2)")).alias("variant"),
    )


def _merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of exploded keys, never by broadcast."""
    return left.join(right.hint("merge"), on, how)


def _sized(keys: DataFrame) -> DataFrame:
    return keys.select("key").filter(F.col("key") != UNKNOWN).withColumn("len", F.length("key"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _substrings(keys: DataFrame, size: Column) -> DataFrame:
    """(key, part): the distinct parts of ``size`` characters (one or an array of sizes)."""
    sized = keys.withColumn("n", size)
    at = sized.select("key", "n", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("n") + 1)).alias("at"))
    return at.select("key", F.col("key").substr(F.col("at"), F.col("n")).alias("part")).distinct()


def new_edges(old: DataFrame, fresh: DataFrame, min_contain: int = fixed.CONTAIN_MIN_LEN, min_len: int = 0) -> DataFrame:
    """The similar pairs (a, b), a < b, that ``fresh`` keys have with each other and with ``old`` ones.

    What is exploded far is the new keys; the old keys' side is a plain equi-join. An old key inside a new one is found
    among all parts of the new one; a new key inside an old one by the part of it that the fewest old keys have."""
    f, o = _sized(fresh), _sized(old)
    fe, oe = f.filter(F.col("len") >= min_len), o.filter(F.col("len") >= min_len)
    fd, od = _deletions(fe), _deletions(oe).select(F.col("key").alias("other"), "len", "pos", "variant")
    swapped = _merged(fd, od, ["variant", "pos", "len"]).filter(F.col("key") != F.col("other")).select(*_pair("key", "other"))
    longer = _merged(fd, oe.select(F.col("key").alias("variant")), "variant").select(*_pair("key", "variant"))
    shorter = _merged(od, fe.select(F.col("key").alias("variant")), "variant").select(*_pair("other", "variant"))

    fl, ol = f.filter(F.col("len") >= min_contain), o.filter(F.col("len") >= min_contain)
    parts = _substrings(fl, F.explode(F.sequence(F.lit(min_contain), F.col("len"))))
    inside = _merged(parts, ol.select(F.col("key").alias("part")), "part").select(*_pair("key", "part"))
    grams = _substrings(fl, F.lit(min_contain))
    holders = _merged(_substrings(ol, F.lit(min_contain)), grams.select("part").distinct(), "part", "left_semi")
    holders = holders.withColumnRenamed("key", "other")
    rare = _merged(grams, holders.groupBy("part").agg(F.count("*").alias("n")), "part", "left").groupBy("key").agg(
        F.min_by("part", F.struct(F.coalesce("n", F.lit(0)), "part")).alias("part")
    )
    around = _merged(rare, holders, "part").filter((F.length("other") > F.length("key")) & (F.instr(F.col("other"), F.col("key")) > 0))
    found = similarity_edges(fresh, min_contain, min_len)
    for e in (swapped, longer, shorter, inside, around.select(*_pair("key", "other"))):
        found = found.unionByName(e)
    return found.distinct()


def similarity_edges(keys: DataFrame, min_contain: int = fixed.CONTAIN_MIN_LEN, min_len: int = 0) -> DataFrame:
    """Undirected similar pairs (a, b), a < b, over distinct keys in column ``key``."""
    k = _sized(keys)

    edit_keys = k.filter(F.col("len") >= min_len)
    dels = _deletions(edit_keys)
    d1 = dels.select(F.col("key").alias("a"), "len", "pos", "variant")
    d2 = dels.select(F.col("key").alias("b"), "len", "pos", "variant")
    substitution = _merged(d1, d2, ["variant", "pos", "len"]).filter(F.col("a") < F.col("b")).select("a", "b")

    shorter = edit_keys.select(F.col("key").alias("short"), F.col("len").alias("slen"))
    insertion = (
        _merged(dels, shorter, dels["variant"] == shorter["short"])
        .select(F.least("key", "short").alias("a"), F.greatest("key", "short").alias("b"))
    )

    long_keys = k.filter(F.col("len") >= min_contain)
    grams = long_keys.select(
        "key",
        "len",
        F.posexplode(F.sequence(F.lit(0), F.col("len") - min_contain)).alias("i", "pos"),
    ).select("key", "len", "pos", F.expr(f"substring(key, pos + 1, {min_contain})").alias("gram"))
    gram_df = grams.select("key", "gram").distinct().groupBy("gram").agg(F.count("*").alias("df"))
    rarest = (
        _merged(grams, gram_df, "gram")
        .groupBy("key", "len")
        .agg(F.min_by("gram", F.struct("df", "pos")).alias("gram"))
        .select(F.col("key").alias("s"), F.col("len").alias("slen"), "gram")
    )
    holders = grams.select(F.col("key").alias("t"), F.col("len").alias("tlen"), "gram").distinct()
    containment = (
        _merged(rarest, holders, "gram")
        .filter((F.col("tlen") > F.col("slen")) & (F.instr(F.col("t"), F.col("s")) > 0))
        .select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
    )
    return substitution.unionByName(insertion).unionByName(containment).distinct()


def _earlier(a_cnt: Column, a_first: Column, b_cnt: Column, b_first: Column) -> Column:
    return (a_cnt > b_cnt) | ((a_cnt == b_cnt) & (a_first < b_first))


def cluster_keys(
    key_stats: DataFrame,
    min_contain: int = fixed.CONTAIN_MIN_LEN,
    min_len: int = 0,
) -> DataFrame:
    """``key_stats(key, cnt, first_seen)`` → ``(key, canonical)`` for every key.

    Ranking: ``cnt`` descending, then ``first_seen`` ascending (first seen = the
    smallest ``seq`` of the key's rows)."""
    stats = stored(key_stats.select("key", "cnt", "first_seen"), "key-stats")
    return assign_leaders(stats, similarity_edges(stats, min_contain, min_len))


def assign_leaders(stats: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, canonical, cnt, first_seen) for ``stats`` whose similar pairs (a, b) are ``edges``."""
    sa = stats.select(F.col("key").alias("a"), F.col("cnt").alias("a_cnt"), F.col("first_seen").alias("a_first"))
    sb = stats.select(F.col("key").alias("b"), F.col("cnt").alias("b_cnt"), F.col("first_seen").alias("b_first"))
    e = edges.join(sa, "a").join(sb, "b")
    a_first = _earlier(F.col("a_cnt"), F.col("a_first"), F.col("b_cnt"), F.col("b_first"))
    directed = e.select(
        F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("early"),
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("late"),
        F.when(a_first, F.struct((-F.col("a_cnt")).alias("c"), F.col("a_first").alias("f"))).otherwise(
            F.struct((-F.col("b_cnt")).alias("c"), F.col("b_first").alias("f"))
        ).alias("early_rank"),
    )
    directed = stored(directed, "directed")
    state = elect(directed)

    leaders = state.filter(F.col("state") == "L").select(F.col("key").alias("early"))
    follow = (
        directed.join(leaders, "early", "left_semi")
        .join(state.filter(F.col("state") == "F").select(F.col("key").alias("late")), "late", "left_semi")
        .groupBy("late")
        .agg(F.min_by("early", "early_rank").alias("canonical"))
        .select(F.col("late").alias("key"), "canonical")
    )
    out = stats.join(follow, "key", "left").select(
        "key", F.coalesce("canonical", "key").alias("canonical"), "cnt", "first_seen"
    )
    return stored(out, "clusters")


def elect(directed: DataFrame) -> DataFrame:
    """(key, state): 'L' or 'F' for every key of ``directed`` (early, late).

    Open edges are (late, early, flip): the late key sees a leader there if ``early`` leads, or with ``flip`` if it doesn't.
    An edge to a key with a single open edge of its own is moved on to that one's end."""
    lates = directed.select(F.col("late").alias("key")).distinct()
    roots = directed.select(F.col("early").alias("key")).distinct().join(lates, "key", "left_anti")
    marked = directed.select("early", "late").join(roots.select(F.col("key").alias("early"), F.lit(True).alias("root")), "early", "left")
    edges = marked.groupBy("late", "early").agg(F.max(F.coalesce("root", F.lit(False))).alias("hit"))
    edges = edges.withColumns({"flip": F.lit(False), "live": ~F.col("hit")})
    decided = [roots.withColumn("state", F.lit("L"))]
    while True:
        # one row an (late, early): both flips of one key mean that one of the two sees a leader
        seen = edges.groupBy("late", "early").agg(
            (F.max("hit") | ((F.count_if(F.col("live") & F.col("flip")) > 0) & (F.count_if(F.col("live") & ~F.col("flip")) > 0))).alias("hit"),
            F.max("live").alias("live"),
            F.max(F.col("live") & F.col("flip")).alias("flip"),
        )
        seen = stored(seen, "elect-edges")
        ends = F.when(F.col("live"), F.struct("early", "flip"))
        judged = seen.groupBy("late").agg(F.max("hit").alias("hit"), F.count_if("live").alias("n"), F.max(ends).alias("end"))
        judged = stored(judged.withColumn("state", F.when(F.col("hit"), "F").when(F.col("n") == 0, "L")), "elect-keys")
        decided.append(judged.filter("state IS NOT NULL").select(F.col("late").alias("key"), "state"))
        open_ = judged.filter("state IS NULL")
        if open_.isEmpty():
            break
        known = decided[1]  # roots are never looked at: an edge to one is a hit
        for d in decided[2:]:
            known = known.unionByName(d)
        single = open_.filter("n = 1").select(F.col("late").alias("key"), "end")
        about = known.withColumn("end", F.lit(None).cast(single.schema["end"].dataType)).unionByName(
            single.withColumn("state", F.lit(None).cast("string")).select("key", "state", "end")
        )
        edges = seen.filter("live").join(open_.select("late"), "late", "left_semi")
        edges = edges.join(about.withColumnRenamed("key", "early"), "early", "left")
        moved, told = F.col("end").isNotNull(), F.col("state").isNotNull()
        edges = edges.select(
            "late",
            F.when(moved, F.col("end.early")).otherwise(F.col("early")).alias("early"),
            # its opposite: flip, the end's flip, and one turn
            F.when(moved, F.col("flip") == F.col("end.flip")).otherwise(F.col("flip")).alias("flip"),
            (told & ((F.col("state") == "L") != F.col("flip"))).alias("hit"),
            (~told).alias("live"),
        )
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out
