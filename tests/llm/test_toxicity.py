"""Operator 6: held-out quality, the convolution against loops, defined cases."""

import random
import zlib

import numpy as np

from trackwise.llm import toxicity as X

BAD = {"en": ["idiot", "scum", "moron"], "fr": ["crétin", "ordure"]}


def rows(n=900):
    rng = random.Random(3)
    words = [a + b for a in ("er", "on", "thi", "la", "que", "ment", "st", "or") for b in ("", "ing", "at", "eau", "tion")]
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randint(0, len(text)), rng.choice(BAD[lang]) + rng.choice(["", ",", "."]))
        docs.append((i, " ".join(text), lang, "keep"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


DOC, LABEL = "doc_id bigint, text string, lang string, score string", "doc_id bigint, quality int, toxic int"


def test_held_out_quality(spark):
    docs, labels = rows()
    odd = [(5000, None, "en", ""), (5001, "", None, ""), (5002, "er " * 30_000 + "idiot", "en", ""), (None, "on", "en", ""), (3, "la", "fr", "")]
    got = X.toxicity(spark.createDataFrame(docs + odd, DOC), spark.createDataFrame(labels + [(7000, 1, None), (7001, 0, 1)], LABEL)).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id != 3}
    assert by[5000].score == by[5001].score and by[5002].predicted == 1
    held = [(by[i].predicted, t) for i, _, t in labels if i in by and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in by if i is not None)
    hits = sum(p == t for p, t in held)
    assert len(held) > 150 and hits >= 0.95 * len(held)


def test_kept_rows_come_as_they_were(spark):
    docs, labels = rows()
    df = spark.createDataFrame(docs, DOC)
    kept = X.keep_clean(df, spark.createDataFrame(labels, LABEL))
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & ids) <= 0.05 * len(toxic) and len(ids - toxic) >= 0.98 * (len(docs) - len(toxic))
    assert kept.exceptAll(df).count() == 0


def test_no_labels(spark):
    docs, _ = rows(5)
    none = spark.createDataFrame([], LABEL)
    got = X.toxicity(spark.createDataFrame(docs, DOC), none).collect()
    assert {r.score for r in got} == {0.0} and X.keep_clean(spark.createDataFrame(docs, DOC), none).count() == 5
    assert X.toxicity(spark.createDataFrame([], DOC), none).count() == 0


def test_convolution_against_loops():
    rng = np.random.default_rng(1)
    model = X.Cnn(rng.normal(size=(2, X.BUCKETS, X.DIM)).astype(np.float32), [rng.normal(size=(w, X.DIM, X.FILTERS)).astype(np.float32) for w in X.WIDTHS],
                  rng.normal(size=X.FILTERS * len(X.WIDTHS)).astype(np.float32), 0.1)
    ids, edges = rng.integers(0, X.BUCKETS, (9, 2)).astype(np.int32), np.array([0, 4, 4, 5, 9])
    got = model.pooled(ids, edges)[0]
    for r in range(4):
        x = model.embed[0][ids[edges[r] : edges[r + 1], 0]] + model.embed[1][ids[edges[r] : edges[r + 1], 1]]
        want = []
        for k in model.kernels:
            values = [sum((x[i + j] @ k[j] for j in range(len(k)) if i + j < len(x)), np.zeros(X.FILTERS)) for i in range(len(x))]
            want.append(np.maximum(np.max(values, axis=0), 0) if values else np.zeros(X.FILTERS))
        assert np.allclose(got[r], np.concatenate(want), atol=1e-4)


def test_a_small_language_gets_its_own_threshold(spark, monkeypatch):
    """Thresholds come from all labelled rows outside the training sample, which is spread over the languages."""
    seen = []
    calibrate = X.calibrate
    monkeypatch.setattr(X, "calibrate", lambda bins, *rest: seen.extend(bins) or calibrate(bins, *rest))
    docs, labels = rows(2000)
    docs = [(i, t, "en" if i % 20 else "fr", s) for i, t, _, s in docs]  # a twentieth is French
    docs += [(9000 + i, "er " * 9000 + ("idiot" if i % 4 == 0 else "on"), "de", "") for i in range(80)]  # all too long to train on
    labels += [(9000 + i, 1, int(i % 4 == 0)) for i in range(80)]
    model = X.fit(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL), per_class=20)
    assert {None, "en", "de"} <= set(model.thresholds)
    assert sum(n for lang, _, _, n in seen if lang == "de") == 80
    assert 2080 - 60 <= sum(n for *_, n in seen) <= 2080 - 20
    assert X.rates({("en", 1): 10_000, ("fr", 1): 40, ("en", 0): 100, (None, 0): 4}, 100) == {
        ("fr", 1): 0.75, ("en", 1): 0.007, (None, 0): 0.75, ("en", 0): 0.75,
    }
