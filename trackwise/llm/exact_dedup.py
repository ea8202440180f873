"""Operator 8, exact dedup: a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of documents is
digested once (narrow rows, the text stays behind), reduced to one row a
digest with partial aggregation, and sort-merge joined with the index, whose
side needs neither shuffle nor sort: digests that the index has are copies of
earlier batches, the others are appended to it.

Equal texts are those identical after deleting ``[\\x20\\x09-\\x0D]``. Within a
batch the row with the most code points stays, then the smallest ``doc_id``
(null ids last). A digest of an earlier batch keeps the row it has.

Defined cases: null text counts as empty, and empty texts are equal; rows that
repeat a ``doc_id`` and text are copies of each other, and ``survivors`` leaves one
of them; an empty batch gives no rows and leaves the index as it was; other
columns are passed through whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise.llm.common import ASCII_SPACE, scratch, stored

#: A digest with over total / HOT_PARTS rows is joined by broadcast; fewer than HOT_PARTS such digests can exist.
HOT_PARTS = 1000


def text_digest(text):
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, "")
    return F.sha2(plain.cast("binary"), 256)


class DigestIndex:
    """The stored digests: ``digest, keep_id, group_size``, one row a digest.

    ``buckets`` is fixed when the index is made; at 100 TB choose it so that a
    bucket fits one task (about 1e7 digests a bucket).
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.path = path or scratch(spark, "digest-index")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        rows = rows.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest")
        writer = rows.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet")
        if self.exists():
            writer.mode("append").saveAsTable(self.name)
        else:
            writer.option("path", self.path).saveAsTable(self.name)

    def add(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """Dedup a batch against the index and itself, and append what is new.

        Returns a row for each input row: ``doc_id, digest, keep_id, group_size``
        (rows of the batch that share the digest), ``known`` (an earlier batch
        had it), ``kept`` and ``ties`` (rows of the batch with the kept id)."""
        rows = stored(
            docs.select(
                F.col(id_col).alias("doc_id"),
                F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
                text_digest(F.col(text_col)).alias("digest"),
            ),
            "digests",
        )
        # most code points, then smallest id, nulls last: min over (-points, id is null, id)
        order = F.struct((-F.col("points")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
        counted = rows.groupBy("digest", order.alias("o")).agg(F.count("*").alias("n"))
        groups = counted.groupBy("digest").agg(
            F.min(F.struct("o", "n")).alias("first"), F.sum("n").alias("group_size")
        )
        fresh = groups.select(
            "digest", F.col("first.o.doc_id").alias("keep_id"), "group_size", F.col("first.n").alias("ties")
        )
        fresh = fresh.withColumn("known", F.lit(False))
        if self.exists():
            old = self.table().select("digest", F.col("keep_id").alias("old_id"))
            new = fresh.join(old.hint("merge"), "digest", "left_anti")
            seen = fresh.join(old.hint("merge"), "digest").select(
                "digest", F.col("old_id").alias("keep_id"), "group_size", "ties", F.lit(True).alias("known")
            )
            fresh = new.unionByName(seen)
        fresh = stored(fresh, "digest-groups")
        self.append(fresh.filter(~F.col("known")))

        # hot digests are few by arithmetic, so they may be broadcast; the rest go by sort-merge join
        total = rows.count()
        hot = F.broadcast(fresh.filter(F.col("group_size") * HOT_PARTS > total))
        cold = rows.join(hot.select("digest"), "digest", "left_anti").join(fresh.hint("merge"), "digest")
        out = rows.join(hot, "digest").unionByName(cold)
        return out.withColumn("kept", ~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The contract's row for each document."""
    index = index or DigestIndex(docs.sparkSession)
    got = index.add(docs)
    return got.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def survivors(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with the columns they came with.

    A join on id and digest picks the kept rows; only rows that repeat both
    are reduced once more, by an aggregate with partial results."""
    index = index or DigestIndex(docs.sparkSession)
    kept = index.add(docs).filter("kept").groupBy("doc_id", "digest").agg(F.max("ties").alias("ties"))
    key, sha, ties = "_keep_id", "_keep_digest", "_keep_ties"
    kept = kept.select(F.col("doc_id").alias(key), F.col("digest").alias(sha), F.col("ties").alias(ties))
    rows = docs.withColumn(sha + "_own", text_digest(F.col("text")))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(sha + "_own") == F.col(sha)), "inner")
    once = rows.filter(F.col(ties) == 1)
    many = rows.filter(F.col(ties) > 1).dropDuplicates([sha])
    return once.select(*docs.columns).unionByName(many.select(*docs.columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
