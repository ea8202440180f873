"""SNK-04, SNK-06: a stored tracker that is patched by key, bucket by bucket.

A patch rewrites the buckets of the rows that it names; the other buckets are neither read nor written, and readers see
the table before the patch or after it (``sources.bucket_store``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise.plans import repair as R
from trackwise.session import stored
from trackwise.sources.bucket_store import BucketStore, Table

TEXT = [
    "received", "company", "company_key", "role", "step", "category", "interview_datetime", "summary", "status", "source", "thread_id",
    "link", "interviewer", "message_id",
]
#: Text columns that files of before a column was added lack are blank, as an empty cell is.
TRACKER = Table(", ".join(f"{c} string" for c in TEXT) + ", seq long", "seq", {"link": "", "interviewer": "", "message_id": ""})


def patch_buckets(store: BucketStore, name: str, patch: DataFrame, cols: list[str]) -> list[int]:
    """Takes ``cols`` of ``patch`` (one row a key) into a stored table and commits. Returns the buckets that were rewritten;
    keys that the table doesn't have change nothing, a null leaves what is there."""
    key = store.tables[name].key
    patch = stored(patch.select(key, *cols), "patch")
    if not patch.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"the patch has several rows for one {key}")
    base = store.read(name, store.buckets_of(patch, key), store.seen)
    found = patch.join(base.select(key), key, "left_semi")
    touched = store.buckets_of(found, key)
    if touched:
        store.commit({name: (R.apply_patch(store.read(name, touched, store.seen), patch, key, cols), touched)})
    return touched


class TrackerStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.store = BucketStore(spark, root, {"tracker": TRACKER}, buckets)

    def append(self, rows: DataFrame) -> int:
        return self.store.commit({}, {"tracker": rows})

    def read(self, version: int | None = None) -> DataFrame:
        return self.store.read("tracker", version=version)

    def update_status(self, updates: DataFrame) -> tuple[list[int], DataFrame]:
        """ML-01: (buckets rewritten, rejected updates). Of several updates to a row the last by ``ord`` counts; to find the
        rows only ids, threads, times and ``seq`` are read."""
        patch, rejected = R.status_patch(self.read(self.store.seen), updates)
        rejected = stored(rejected, "rejected")
        return patch_buckets(self.store, "tracker", patch, ["status"]), rejected
