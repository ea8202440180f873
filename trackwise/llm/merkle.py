"""Operator 13, Merkle dataset manifest: a hash tree over the rows of each source and over the sources.

``manifest`` numbers the leaves by ranges (``order.py``), then builds the tree level by level: every run of three
consecutive nodes becomes one aggregate row, so a level is a third of the one below. Levels are stored as parent-linked node
rows: ``(tree, level, pos)``, the hashes of the run's other nodes to the left and right, and the parent's key.
The node left in a source's tree links on into the tree over the sources.

``climb`` is a Spark recursive query (``WITH RECURSIVE``): one row for each leaf that ascends node by node, appending the
siblings that it meets and folding a hash with them. Each ascent emits a row, so no state grows with the depth. Nodes over a
``HOT_SHARE``-th of all leaves or more are few at every level, whatever the data, so the ascent
through them joins a broadcast table, and below them, where it joins by key, no key gathers more than that share of the rows.

Defined cases: null fields are ``-``; null sources are a source, before all others; rows with a null id come first in
their source; rows of one source with equal ids stand in the order of their leaves; a lone row is its own root and has an
empty proof (the hash of no text); an empty table gives no rows; other columns don't count. A null id counts as empty text where
ids choose the tampered rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise.llm.common import fold, stored
from trackwise.llm.order import attach, compact, place, ranged, running

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes over a 20,000th of all leaves are broadcast: 20,000 a level at most, and a third of that each level up.
HOT_SHARE = 20_000
#: The tree over the sources; the sources' own trees are numbered from 0.
TOP = -1


def digest(c: Column) -> Column:
    """sha256 as 32 bytes; the tree hashes digests as lower-case hex text."""
    return F.unhex(F.sha2(c.cast("binary"), 256))


def as_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(**changed: Column) -> Column:
    """The leaf of a row; ``changed`` columns stand in for the row's own."""
    return digest(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]))


def tampered_text() -> Column:
    """The text without its newlines where the id's checksum is even."""
    return F.when(fold(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


# ---------------------------------------------------------------------------
# building
# ---------------------------------------------------------------------------

NODE = ["tree", "level", "pos", "left", "right", "ptree", "plevel", "ppos", "phot", "hot", "subroot"]


def runs(level: DataFrame, extra: list[str]) -> DataFrame:
    """The runs of three of a level: ``tree``, ``up`` (the parent's place), ``kids`` (pos, hash, leaves, extra), and the
    parent's ``hash`` and ``leaves``. A run holds three rows at most."""
    kid = F.struct("pos", "hash", "leaves", *extra)
    grouped = level.groupBy("tree", "size", F.floor(F.col("pos") / ARITY).cast("long").alias("up")).agg(
        F.array_sort(F.collect_list(kid)).alias("kids")
    )
    whole = F.array_join(F.transform("kids", lambda k: as_hex(k["hash"])), "")
    leaves = F.aggregate("kids", F.lit(0).cast("long"), lambda a, k: a + k["leaves"])
    return grouped.select("tree", "size", "up", "kids", digest(whole).alias("hash"), leaves.alias("leaves"))


def node_rows(built: DataFrame, level: int, extra: list[str], total: int) -> DataFrame:
    """Parent-linked rows of the children of ``runs``."""
    k = F.col("k")
    rows = built.withColumn("k", F.explode("kids"))

    def side(keep) -> Column:
        return F.aggregate(F.filter("kids", keep), F.lit(b""), lambda a, x: F.concat(a, x["hash"]))

    return rows.select(
        "tree", F.lit(level).alias("level"), k["pos"].alias("pos"),
        side(lambda x: x["pos"] < k["pos"]).alias("left"), side(lambda x: x["pos"] > k["pos"]).alias("right"),
        F.col("tree").alias("ptree"), F.lit(level + 1).alias("plevel"), F.col("up").alias("ppos"),
        hot(F.col("leaves"), total).alias("phot"), hot(k["leaves"], total).alias("hot"), F.lit(None).cast("binary").alias("subroot"),
        k["hash"].alias("hash"), *[k[c].alias(c) for c in extra],
    )


def hot(leaves: Column, total: int) -> Column:
    return leaves * HOT_SHARE >= F.lit(total)


def build(
    level: DataFrame, extra: list[str], count: int, n_trees: int, largest: int, total: int, what: str
) -> tuple[list[DataFrame], DataFrame]:
    """Levels over ``level`` (tree, size, pos, hash, leaves), which has ``count`` rows; a tree has ``size`` nodes, the largest
    ``largest``. The node rows of each level, and the node left of every tree with its level ``at``. ``extra`` columns are
    kept on the lowest level."""
    nodes, left = [], level.filter("size = 1").select("tree", "hash", "leaves", F.lit(0).alias("at"))
    while largest > 1:
        at = len(nodes)
        built = stored(compact(runs(level.filter("size > 1"), extra), count), f"{what}-{at}")
        nodes.append(node_rows(built, at, extra, total))
        size = F.floor((F.col("size") + ARITY - 1) / ARITY).cast("long").alias("size")
        level = built.select("tree", size, F.col("up").alias("pos"), "hash", "leaves")
        left = left.unionByName(level.filter("size = 1").select("tree", "hash", "leaves", F.lit(at + 1).alias("at")))
        extra, largest, count = [], -(-largest // ARITY), count // ARITY + n_trees
    return nodes, left


# ---------------------------------------------------------------------------
# climbing
# ---------------------------------------------------------------------------


@contextmanager
def no_row_limit(spark: SparkSession) -> Iterator[None]:
    """Recursive queries stop at a million rows by default; the depth here is bounded by the tree's."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def climb(start: DataFrame, nodes: DataFrame, through_hot: bool) -> DataFrame:
    """Rows (leaf, step, tree, level, pos, hot, fold, sibs, subroot): those of ``start`` and one for each ascent of a leaf.

    (tree, level, pos) is where the leaf stands after ``step`` ascents and ``fold`` the hash there; ``sibs`` are the siblings met
    in this ascent; ``subroot`` is the stored hash of the node left of a source's tree, where the ascent leaves that. Only nodes
    whose ``hot`` is ``through_hot`` are passed."""
    query = f"""
    WITH RECURSIVE climb(leaf, step, tree, level, pos, hot, fold, sibs, subroot) AS (
      SELECT leaf, step, tree, level, pos, hot, fold, sibs, subroot FROM {{start}}
      UNION ALL
      SELECT {"/*+ BROADCAST(n) */" if through_hot else ""} c.leaf, c.step + 1, n.ptree, n.plevel, n.ppos, n.phot,
             unhex(sha2(CAST(concat(lower(hex(n.left)), lower(hex(c.fold)), lower(hex(n.right))) AS BINARY), 256)),
             concat(n.left, n.right), n.subroot
      FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos
      WHERE c.hot = {str(through_hot).lower()}
    )
    SELECT * FROM climb"""
    return start.sparkSession.sql(query, start=start, nodes=nodes)


def ascents(rows: DataFrame) -> tuple[DataFrame, bytes, tuple[int, int]] | None:
    """(rows with leaf and what the ascents gave, the root, its tree and level) for rows with source, doc_id, hash, fold."""
    spark = rows.sparkSession
    one = F.lit(1).cast("long")
    sizes = stored(rows.groupBy("source").agg(F.count("*").alias("size")), "merkle-sources")
    seen = sizes.agg(F.sum("size"), F.max("size"), F.count("*")).first()
    total, largest, n_trees = seen
    if not total:
        return None
    trees = running(ranged(sizes, [], ["source"], n_trees), [], ["source"], F.col("size"), "before")
    trees = stored(compact(place(trees, [], ["source"], "tree").drop("_range", "_tie"), n_trees), "merkle-trees")
    by, order = ["source"], ["doc_id", "hash", "fold"]
    leaves = place(attach(ranged(rows, by, order, total), by, trees), by, order, "pos")
    leaves = leaves.select("tree", "size", "pos", "hash", one.alias("leaves"), (F.col("before") + F.col("pos")).alias("leaf"), "doc_id", "fold")
    leaves = stored(compact(leaves, total), "merkle-placed")
    nodes, subroots = build(leaves, ["leaf", "doc_id", "fold"], total, n_trees, largest, total, "merkle")

    # the nodes left are the leaves of the tree over the sources; they are met under the keys that they have in their own trees
    tops = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).alias("size"), F.col("tree").alias("pos"), "hash", "leaves",
        F.col("tree").alias("own"), "at",
    )
    top_nodes, roots = build(stored(compact(tops, n_trees), "merkle-subroots"), ["own", "at"], n_trees, 1, n_trees, total, "merkle-top")
    root = roots.first()["hash"]  # one row
    where = (TOP, len(top_nodes)) if top_nodes else (0, len(nodes))
    links = [
        n.select(F.col("own").alias("tree"), F.col("at").alias("level"), F.lit(0).cast("long").alias("pos"), *NODE[3:10], F.col("hash").alias("subroot"))
        for n in top_nodes[:1]
    ]
    none = F.lit(None).cast("binary")
    uppers = leaves.limit(0).select(  # so that the union is never empty
        "tree", F.lit(0).alias("level"), "pos", none.alias("left"), none.alias("right"), F.col("tree").alias("ptree"),
        F.lit(0).alias("plevel"), F.col("pos").alias("ppos"), F.lit(True).alias("phot"), F.lit(True).alias("hot"), none.alias("subroot"),
    )
    for n in [*nodes[1:], *links, *top_nodes[1:]]:
        uppers = uppers.unionByName(n.select(*NODE))
    uppers = stored(compact(uppers, total), "merkle-nodes")

    # the first ascent needs no look-up: a leaf's run is at hand when it is built
    folded = digest(F.concat(as_hex(F.col("left")), as_hex(F.col("fold")), as_hex(F.col("right"))))
    alone = leaves.filter("size = 1").select(
        "leaf", F.lit(0).alias("step"), "tree", F.lit(0).alias("level"), "pos", hot(F.col("leaves"), total).alias("hot"), "fold",
        F.lit(b"").alias("sibs"), none.alias("subroot"), "doc_id", "hash",
    )
    start = alone
    for n in nodes[:1]:
        start = start.unionByName(n.select(
            "leaf", F.lit(1).alias("step"), F.col("ptree").alias("tree"), F.col("plevel").alias("level"), F.col("ppos").alias("pos"),
            F.col("phot").alias("hot"), folded.alias("fold"), F.concat("left", "right").alias("sibs"), none.alias("subroot"), "doc_id", "hash",
        ))
    start = stored(compact(start, total), "merkle-start")
    state = ["leaf", "step", "tree", "level", "pos", "hot", "fold", "sibs", "subroot"]
    with no_row_limit(spark):
        low = stored(compact(climb(start.select(*state), uppers.filter("NOT hot"), False), total), "merkle-climb")
        high = climb(low.filter("hot"), uppers.filter("hot"), True)
        steps = low.filter("NOT hot").unionByName(high)
        at_root = (F.col("tree") == where[0]) & (F.col("level") == where[1])
        steps = steps.select("leaf", "step", "sibs", F.when(at_root, F.col("fold")).alias("folded"), "subroot")
        unknown = [F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), none.alias("hash")]
        own = start.select(
            "leaf", F.lit(-1).alias("step"), F.lit(b"").alias("sibs"), none.alias("folded"), none.alias("subroot"), "doc_id", "hash"
        )
        path = F.array_sort(F.collect_list(F.struct("step", "sibs")))  # as many as the tree is deep
        found = own.unionByName(steps.select("*", *unknown)).groupBy("leaf").agg(
            F.first("doc_id", True).alias("doc_id"), F.first("hash", True).alias("hash"), F.first("subroot", True).alias("subroot"),
            F.first("folded", True).alias("folded"), path.alias("path"),
        )
        siblings = F.array_join(F.transform("path", lambda p: as_hex(p["sibs"])), "")
        found = found.select("doc_id", "hash", "subroot", "folded", digest(siblings).alias("proof"))
        return stored(found, "merkle-proofs"), bytes(root), where


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row a document."""
    rows = docs.select("doc_id", "source", leaf_hash().alias("hash"), leaf_hash(text=tampered_text()).alias("fold"))
    rows = stored(rows, "merkle-leaves")
    got = ascents(rows)
    if got is None:
        none = F.lit(None).cast("binary")
        found, root = rows.select("doc_id", "hash", none.alias("subroot"), none.alias("folded"), none.alias("proof")), b""
    else:
        found, root, _ = got
    top = F.lit(root)
    return found.select(
        "doc_id", as_hex(F.col("hash")).alias("leaf"), as_hex(F.coalesce("subroot", top)).alias("subroot"), as_hex(top).alias("root"),
        as_hex(F.col("proof")).alias("proof_sha256"), as_hex(F.col("folded")).alias("folded_root"),
        (F.col("folded") == top).alias("verified"),
    )


#: DuckDB: the trees are built by recursive queries over their levels, every leaf is joined with all its ancestors for the
#: proof, and the tampered leaves are folded by two more. DuckDB has no crc32, so that is spelled out bit by bit.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
           CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
           CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
           CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
    list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents
), e AS (
  SELECT *, CASE WHEN xor(crc, 4294967295) & 1 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM d
), l AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(changed) || ':' || changed END) AS tampered,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM e
), lv(source, lvl, pos, h, n) AS (
  SELECT source, 0, pos, leaf, n FROM l
  UNION ALL
  SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM lv WHERE n > 1 GROUP BY source, lvl, pos // 3, n
), sub AS (
  SELECT source, lvl, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1
), tp(lvl, pos, h, n) AS (
  SELECT 0, pos, h, n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM tp WHERE n > 1 GROUP BY lvl, pos // 3, n
), kin AS (  -- every node that has a parent, with the others of its run
  SELECT a.source, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS lft,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS rgt
  FROM lv a JOIN lv b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL
), topkin AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS lft,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS rgt
  FROM tp a JOIN tp b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL
), lower_part AS (
  SELECT l.source, l.pos, string_agg(k.lft || k.rgt, '' ORDER BY k.lvl) AS sibs
  FROM l JOIN kin k ON l.source IS NOT DISTINCT FROM k.source AND k.pos = l.pos // (3 ** k.lvl)::BIGINT GROUP BY ALL
), upper_part AS (
  SELECT s.source, string_agg(k.lft || k.rgt, '' ORDER BY k.lvl) AS sibs
  FROM sub s JOIN topkin k ON k.pos = s.pos // (3 ** k.lvl)::BIGINT GROUP BY ALL
), f(source, own, lvl, pos, h) AS (
  SELECT source, pos, 0, pos, tampered FROM l
  UNION ALL
  SELECT f.source, f.own, f.lvl + 1, f.pos // 3, sha256(k.lft || f.h || k.rgt)
  FROM f JOIN kin k ON f.source IS NOT DISTINCT FROM k.source AND f.lvl = k.lvl AND f.pos = k.pos
), g(source, own, lvl, pos, h) AS (
  SELECT f.source, f.own, 0, sub.pos, f.h FROM f JOIN sub ON f.source IS NOT DISTINCT FROM sub.source AND f.lvl = sub.lvl
  UNION ALL
  SELECT g.source, g.own, g.lvl + 1, g.pos // 3, sha256(k.lft || g.h || k.rgt) FROM g JOIN topkin k ON g.lvl = k.lvl AND g.pos = k.pos
), r AS (SELECT lvl, h AS root FROM tp WHERE n = 1)
SELECT l.doc_id, l.leaf, sub.h AS subroot, r.root, sha256(coalesce(a.sibs, '') || coalesce(b.sibs, '')) AS proof_sha256,
       g.h AS folded_root, g.h = r.root AS verified
FROM l JOIN sub ON l.source IS NOT DISTINCT FROM sub.source CROSS JOIN r
  JOIN g ON l.source IS NOT DISTINCT FROM g.source AND l.pos = g.own AND g.lvl = r.lvl
  LEFT JOIN lower_part a ON l.source IS NOT DISTINCT FROM a.source AND l.pos = a.pos
  LEFT JOIN upper_part b ON l.source IS NOT DISTINCT FROM b.source
"""
