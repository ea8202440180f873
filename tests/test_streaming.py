"""SM-01..07: file drops through the streaming ingest equal one batch run; a batch that is
run again, after its commit or after a crash anywhere before it, gives the same tables."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_ingest import messages, no_processed
from trackwise.operators import scorer as S
from trackwise.plans import ingest as I
from trackwise.sources import adapters as A
from trackwise.streaming import ingest_stream as X

SF = "/root/testdata/sf0.001"
OUT = ["rows", "raw", "processed", "alerts", "late", "retry", "runs"]


def test_stream_equals_batch(spark, tmp_path):
    work = str(tmp_path)
    mail = A.mail(spark, SF).drop("conv_id", "turn")
    src = f"{work}/in"
    mail.filter(F.col("seq") % 2 == 0).write.parquet(f"{src}/drop1")
    mail.filter(F.col("seq") % 2 == 1).write.parquet(f"{src}/drop2")
    scorer = S.TableScorer(A.responses(spark, SF))
    cfg = I.IngestConfig(as_of=A.MAIL_AS_OF, candidate=A.CANDIDATE)
    q = X.start_ingest(spark, f"{src}/*", mail.schema.simpleString()[7:-1].replace(":", " "), f"{work}/out", scorer, cfg, f"{work}/ckpt")
    q.awaitTermination(300)
    got = X.committed(spark, f"{work}/out", "rows").drop("run_id")
    cfg_b = I.IngestConfig(as_of=A.MAIL_AS_OF, candidate=A.CANDIDATE, start_date="1970-01-01")
    want = I.ingest(mail, no_processed(spark), scorer, cfg_b).rows
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def answer(pdf: pd.DataFrame) -> pd.Series:
    ok = json.dumps({"is_relevant": True, "company": "Acme", "role": "Dev", "category": "Invitation", "step": "Interview"})
    return pd.Series([ok if "no answer" not in b else "oops" for b in pdf["body"]])


@pytest.fixture
def batches(spark):
    one = messages(spark, *[{"message_id": f"a{i}", "subject": "Phone screen", "received": f"2026-07-01T0{i}:00:00.000Z"} for i in range(5)],
                   {"message_id": "bad", "subject": "Phone screen", "body": "no answer"}, {"message_id": "blank", "received": ""})
    two = messages(spark, {"message_id": "b0", "subject": "News", "body": "unfortunately no"}, {"message_id": "a1", "subject": "Phone screen"})
    return [one, two]


CFG = I.IngestConfig(as_of="2026-07-02T00:00:00Z", terms=[], max_per_run=3)


def run(spark, batches, root):
    for i, b in enumerate(batches):
        X.process_batch(b, i, spark, root, S.PandasScorer(answer), CFG)


def tables(spark, root):
    return {t: sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in spark.read.parquet(f"{root}/{t}").collect()) for t in OUT}


def test_replays_and_crashes(spark, batches, tmp_path, monkeypatch):
    run(spark, batches, f"{tmp_path}/want")
    want = tables(spark, f"{tmp_path}/want")
    assert len(want["runs"]) == 2 and want["retry"] and len(want["late"]) == 1
    run(spark, batches, f"{tmp_path}/want")  # both batches again, after their commits
    assert tables(spark, f"{tmp_path}/want") == want

    write = X._write
    for crash in range(len(OUT)):
        root, calls = f"{tmp_path}/crash{crash}", []

        def dying(df, root, name, run_id, calls=calls, crash=crash):
            if run_id == 1 and len(calls) == crash:
                raise RuntimeError("gone")
            if run_id == 1:
                calls.append(name)
            write(df, root, name, run_id)

        monkeypatch.setattr(X, "_write", dying)
        with pytest.raises(RuntimeError):
            run(spark, batches, root)
        monkeypatch.setattr(X, "_write", write)
        run(spark, batches, root)
        assert tables(spark, root) == want


def test_unreadable_tables_stop_the_batch(spark, batches, tmp_path):
    run(spark, batches[:1], str(tmp_path))
    (tmp_path / "processed" / "run_id=0" / "part-bad.parquet").write_text("not parquet")
    with pytest.raises(Exception):  # noqa: B017
        X.process_batch(batches[1], 1, spark, str(tmp_path), S.PandasScorer(answer), CFG)
