import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("trackwise-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tw-test-ckpt-"))
    yield s


TRACKER_COLS = [
    "received", "company", "company_key", "role", "step", "category", "interview_datetime", "summary",
    "status", "source", "thread_id", "link", "interviewer", "message_id",
]


def tracker_df(spark, rows):
    """rows: list of dicts (missing strings → ''), seq = list position."""
    data = []
    for i, r in enumerate(rows):
        base = {c: "" for c in TRACKER_COLS}
        base.update({"received": "2026-07-01T09:00:00.000Z", "company": "Acme", "company_key": "acme",
                     "step": "Applied", "category": "Applied", "thread_id": f"t-{i}", "message_id": f"m{i}"})
        base.update(r)
        if "status" not in r:
            base["status"] = base["step"]
        data.append(tuple(base[c] for c in TRACKER_COLS) + (i,))
    schema = ", ".join(f"{c} string" for c in TRACKER_COLS) + ", seq bigint"
    return spark.createDataFrame(data, schema)
