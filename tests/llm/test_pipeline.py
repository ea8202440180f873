"""The pipeline: its stages, what they keep, and that the package can be taken away."""

import base64
import hashlib
import subprocess
import sys
from pathlib import Path

import corpus_pipeline as C
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tests.llm.test_toxicity import BAD, rows
from trackwise.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE = "one fine day the old miller walked along the river and counted every single stone that lay there in the sun"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = rows(400)
    d = tmp_path_factory.mktemp("sf")
    clean = [r for r in docs if not any(b in r[1] for bad in BAD.values() for b in bad)]
    long = " ".join(clean[k][1] for k in range(8))
    extra = [
        (1000, clean[0][1] + "\n", "en"), (1001, "before it " + PASSAGE + " after it", "en"), (1002, "", None), (1003, None, "en"),
        (1004, long, "en"), (1005, long + " one more", "en"), (1006, "only a clean one", "fr"),
    ]
    all_ = [(i, t, lang, "s", len(t or "")) for i, t, lang, *_ in [*docs, *extra]]
    spark.createDataFrame(all_, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), {r[0] for r in docs} - {r[0] for r in clean}, clean[0][0]


def test_stages(spark, folder):
    sf, toxic, copied = folder
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        if k < len(C.STAGES) - 1:
            assert out.columns == COLUMNS
            out.write.mode("overwrite").parquet(f"{sf}/stage{k}.parquet")
            docs = spark.read.parquet(f"{sf}/stage{k}.parquet")
            kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "decontamination", "byte_bpe"]
    assert len(kept["toxicity"] & toxic) <= 0.05 * len(toxic)
    gone = kept["toxicity"] - kept["exact_dedup"]
    assert copied in gone and 1000 in kept["exact_dedup"] and {1002, 1003} & gone  # the longer of two equal ones stays
    assert {1004, 1005} & (kept["exact_dedup"] - kept["minhash_near_dedup"]) == {1005}
    assert kept["minhash_near_dedup"] - kept["decontamination"] == {1001}
    assert 1006 in kept["decontamination"]

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows_ = C.run(spark, sf).collect()
    assert {r.doc_id for r in rows_} == set(texts)
    for r in rows_:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert list(r.ids) == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_queries_are_registered():
    import __spark_entry__ as E

    names = set(E.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) <= names and "op8_exact_dedup" in E.oracle_sql()


def test_the_rest_stands_alone():
    root = Path(__file__).resolve().parents[2]
    code = (
        "import sys; sys.modules['trackwise.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as E; names = set(E.queries()); assert 'pipeline' not in names and 'positions' in names\n"
        "assert not any(n.startswith('op') and n[2].isdigit() for n in names); print('ok')"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.stdout.strip().endswith("ok"), done.stderr
    rest = [p for p in (root / "trackwise").rglob("*.py") if "llm" not in p.parts]
    assert not any("trackwise.llm" in p.read_text() or "corpus_pipeline" in p.read_text() for p in rest)
