"""SM-01..07: incremental ingestion with Structured Streaming.

New message files arrive in a folder; ``readStream`` picks them up and
``foreachBatch`` runs the batch ingest plan (PL-01) on each micro-batch:

* SM-02 exactly one row per message: the batch plan keeps one row an id and drops ids in the ``processed`` table;
* SM-03/06 retry: failed and deferred messages are written to a ``retry``
  table and join later batches until they are processed (the stream's checkpoint always
  advances, unlike a cursor); the ``runs`` row holds the cursor that a scheduled scan may go on from;
* SM-04 late and undated messages go to a ``late`` table, which the backfill reads;
* SM-07 commit order: every output is written to its own ``run_id=<batch id>`` partition and the ``runs``
  partition is written last. Readers trust committed runs only.

A batch whose id is in ``runs`` is done and is left alone. Any other batch reads earlier committed runs only and
overwrites its own partitions, so a batch that died at any point gives the same tables when it is run again.

Tables live under ``root`` as parquet folders partitioned by ``run_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise.plans import ingest as I
from trackwise.session import cut_lineage

PROCESSED = "message_id string, thread_id string, processed_at string"
RUNS = "committed boolean, failed bigint, deferred bigint, cursor bigint"


def _path(root: str, name: str) -> str:
    return f"{root}/{name}"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there; other errors are the caller's to see."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    path, schema = _path(root, name), f"{schema}, run_id bigint"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def committed(spark: SparkSession, root: str, name: str, schema: str | None = None, besides: int | None = None) -> DataFrame:
    """Rows of ``name`` that belong to committed runs (``besides``: other than this one).

    Without a schema the table must have been written."""
    runs = _read(spark, root, "runs", RUNS).select("run_id")
    t = spark.read.parquet(_path(root, name)) if schema is None else _read(spark, root, name, schema)
    if besides is not None:  # a plain filter, so the partition that is being written is not even listed
        t, runs = t.filter(F.col("run_id") != besides), runs.filter(F.col("run_id") != besides)
    return t.join(runs.distinct(), "run_id", "left_semi")


def _write(df: DataFrame, root: str, name: str, run_id: int) -> None:
    (
        df.withColumn("run_id", F.lit(run_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(_path(root, name))
    )


def process_batch(batch: DataFrame, batch_id: int, spark: SparkSession, root: str, scorer, cfg: I.IngestConfig) -> None:
    """One micro-batch: (open retries ∪ batch) → ingest → writes in commit order."""
    if not _read(spark, root, "runs", RUNS).filter(F.col("run_id") == batch_id).isEmpty():
        return
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    processed = committed(spark, root, "processed", PROCESSED, besides=batch_id).select("message_id", "thread_id")
    retry = committed(spark, root, "retry", fields, besides=batch_id).select(*batch.columns)
    # open retries only: what has been processed since is closed
    retry = retry.join(processed.select("message_id"), "message_id", "left_anti").select(*batch.columns)
    # streaming batches are judged by arrival, not by the cursor bound
    cfg_b = I.IngestConfig(**{**cfg.__dict__, "cursor": None, "start_date": "1970-01-01"})
    res = I.ingest(cut_lineage(batch.unionByName(retry)), processed, scorer, cfg_b)
    _write(res.rows, root, "rows", batch_id)
    _write(res.raw, root, "raw", batch_id)
    _write(res.processed, root, "processed", batch_id)
    _write(res.alerts, root, "alerts", batch_id)
    _write(I.side_rows(res.routed), root, "late", batch_id)
    _write(res.routed.filter(F.col("route").isin("failed", "deferred")).select(*batch.columns), root, "retry", batch_id)
    run_start = int(I.dt.datetime.fromisoformat(cfg.as_of.replace("Z", "+00:00")).timestamp())
    counts = res.metrics.first()
    cursor = I.advance_cursor(counts, run_start, cfg.cursor)
    done = spark.createDataFrame([(True, counts["failed"], counts["deferred"], cursor)], RUNS)
    _write(done, root, "runs", batch_id)  # the commit marker, written last


def start_ingest(
    spark: SparkSession, source_dir: str, schema: str, root: str, scorer, cfg: I.IngestConfig, checkpoint: str, available_now: bool = True
):
    """SM-01: file-source stream of message rows → ``process_batch`` per micro-batch."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    writer = stream.writeStream.foreachBatch(lambda df, bid: process_batch(df, bid, spark, root, scorer, cfg)).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
