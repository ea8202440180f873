"""Operator 6, toxicity: a convolutional text classifier in numpy.

Words are hashed twice into two small embedding tables whose rows are added, so
that two words share an embedding only if both hashes agree. Filters of several widths
run over the word embeddings of the whole text, each filter's maximum over the text is kept,
and a logistic layer turns the maxima into the score. Trained by Adagrad on
the driver over a bounded sample; scoring is one pass over the table.

The sample: labelled rows with texts of at most ``max_chars`` characters, about ``per_class`` rows of each
class, drawn by hashed id and spread over the languages: each gives the same number, or ``MOST`` of its rows if it
has fewer. The score is corrected for the sample's share of
positive rows. A decision threshold for each language is chosen on all labelled rows that training
does not use, of any length: one pass scores them, and their counts by language, class and bin of the score, weighted
to the class's share in the language, give it. Languages with too few such rows, and null languages,
take the threshold of all. The language picks the threshold only, never the score.

Defined cases: null and empty texts have no words and get the score of the bias;
a document with several label rows is toxic if one of them is 1; null labels are
not learned; with no label of either class every score is 0; repeated rows give a row
each; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwise.llm.common import fold, release, released, ship_code, stored
from trackwise.llm.textbatch import LOWER, Words, blocks, forget_powers, mix, row_reduce

PER_CLASS = 3000
MAX_CHARS = 20_000
BUCKETS = 1 << 16
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
CUT = 0.3
MOST = 0.75  # of the rows of a language and class, the others calibrate
BINS = 32  # a unit of the log odds
FLOOR = -50.0
CHUNK_WORDS = 100_000


def word_ids(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bucket numbers for each word (letters of ASCII folded, punctuation at the ends kept out) and the row edges."""
    words = Words(LOWER[raw], offs)
    start, end = words.start, words.end
    for _ in range(2):  # up to two marks at either end
        inner = end - start > 1
        start = start + (inner & _MARK[words.raw[start]]) if len(start) else start
        inner = end - start > 1
        end = end - (inner & _MARK[words.raw[end - 1]]) if len(end) else end
    words.start, words.end = start, end
    h = words.hashes()
    ids = np.stack([(h % np.uint64(BUCKETS)), (mix(h) % np.uint64(BUCKETS))], axis=1).astype(np.int32)
    return ids, words.edges


_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


@dataclass
class Cnn:
    embed: np.ndarray  # 2 × BUCKETS × DIM
    kernels: list[np.ndarray]  # for each width: width × DIM × FILTERS
    out: np.ndarray
    bias: float
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def pooled(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The maximum of each filter over each row's words (0 at least), and the filters' values.

        A filter that hangs over the end of a row sees zeros there."""
        x = self.embed[0][ids[:, 0]] + self.embed[1][ids[:, 1]]
        wide = np.concatenate([k.transpose(1, 0, 2).reshape(DIM, -1) for k in self.kernels], axis=1)
        y = x @ wide
        left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(ids))  # words to the end of the row
        values, at = [], 0
        for k in self.kernels:
            v = y[:, at : at + FILTERS].copy()
            for j in range(1, len(k)):
                part = y[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
                v[:-j] += part * (left[:-j] > j)[:, None]
            values.append(v)
            at += len(k) * FILTERS
        return np.concatenate([np.maximum(row_reduce(np.maximum, v, edges), 0) for v in values], axis=1), values

    def scores(self, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(ids, edges)))

    def odds(self, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The log odds. Rows are taken together up to ``CHUNK_WORDS`` words (or one row), which bounds the filters' values."""
        out, a, n = [], 0, len(edges) - 1
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(edges, edges[a] + CHUNK_WORDS, "right")) - 1))
            pooled = self.pooled(ids[edges[a] : edges[b]], edges[a : b + 1] - edges[a])[0]
            out.append(pooled @ self.out)
            a = b
        z = np.concatenate(out or [np.zeros(0)]) + self.bias + self.shift
        return np.clip(z, FLOOR, -FLOOR)


def train(ids: np.ndarray, edges: np.ndarray, y: np.ndarray, share: float, epochs: int = 10, seed: int = 7) -> Cnn:
    """``share``: the positive rows among all labelled rows."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, (2, BUCKETS, DIM)).astype(np.float32)
    row = np.repeat(np.arange(len(y)), np.diff(edges))
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    for t in range(2):  # the first dimension begins at half the log odds of the bucket
        pair = np.unique(row.astype(np.int64) * BUCKETS + ids[:, t])
        r, b = pair // BUCKETS, pair % BUCKETS
        pos, all_ = np.bincount(b, y[r], BUCKETS), np.bincount(b, minlength=BUCKETS)
        embed[t, :, 0] = 0.5 * np.log(((pos + 0.5) / n1) / ((all_ - pos + 0.5) / n0)) * (all_ >= 3)
    kernels = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[0, 0, :] += 0.5
    model = Cnn(embed, kernels, rng.normal(0.3, 0.05, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)
    squares = [np.full_like(embed, 1e-3), [np.full_like(k, 1e-3) for k in kernels], np.full_like(model.out, 1e-3), 1e-3]
    rate = 0.05
    rows = np.arange(len(y))
    for _ in range(epochs):
        rng.shuffle(rows)
        for a in range(0, len(rows), 64):
            some = rows[a : a + 64]
            size = (edges[some + 1] - edges[some])
            sub = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(edges[some] - sub[:-1], size) + np.arange(sub[-1])
            own = ids[take]
            pooled, values = model.pooled(own, sub)
            z = pooled @ model.out + model.bias
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[some]) / len(some)
            d_out, d_bias, d_pool = pooled.T @ g, float(g.sum()), np.outer(g, model.out) * (pooled > 0)
            d_kernels, spots, slopes = [], [], []
            for f, (k, v) in enumerate(zip(model.kernels, values, strict=True)):
                dk = np.zeros_like(k)
                for r in np.flatnonzero((size > 0) & (d_pool[:, f * FILTERS : (f + 1) * FILTERS] != 0).any(axis=1)):
                    at = sub[r] + v[sub[r] : sub[r + 1]].argmax(axis=0)
                    d = d_pool[r, f * FILTERS : (f + 1) * FILTERS]
                    for j in range(len(k)):
                        ok = at + j < sub[r + 1]
                        i = own[at[ok] + j]
                        x = model.embed[0][i[:, 0]] + model.embed[1][i[:, 1]]
                        dk[j][:, ok] += (x * d[ok, None]).T
                        spots.append(i)
                        slopes.append(k[j][:, ok].T * d[ok, None])
                d_kernels.append(dk)
            if spots:
                i, s = np.concatenate(spots), np.concatenate(slopes).astype(np.float32)
                for t in range(2):
                    unique, inverse = np.unique(i[:, t], return_inverse=True)
                    total = np.zeros((len(unique), DIM), np.float32)
                    np.add.at(total, inverse, s)
                    squares[0][t][unique] += total**2
                    model.embed[t][unique] -= rate * total / np.sqrt(squares[0][t][unique])
            for k, dk, sq in zip(model.kernels, d_kernels, squares[1], strict=True):
                sq += dk**2
                k -= rate * dk / np.sqrt(sq)
            squares[2] += d_out**2
            model.out -= (rate * d_out / np.sqrt(squares[2])).astype(np.float32)
            squares[3] += d_bias**2
            model.bias -= rate * d_bias / squares[3] ** 0.5
    odds = lambda p: np.log(p / (1 - p))
    sampled = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model.shift = float(odds(min(max(share, 1e-3), 1 - 1e-3)) - odds(sampled))
    return model


def calibrate(bins: list, sizes: dict, least: int = 15) -> dict:
    """For each language the threshold with the best F1; ``None``: of all rows.

    ``bins``: (lang, toxic, bin of the log odds, rows); ``sizes``: all labelled rows of (lang, toxic), which the rows stand for."""
    found: dict = {}
    for lang, toxic, _, n in bins:
        found[lang, toxic] = found.get((lang, toxic), 0) + n

    def best(some: list) -> float:
        weight: dict = {}
        for lang, toxic, bin_, n in some:
            weight.setdefault(bin_, [0.0, 0.0])[toxic] += n * sizes[lang, toxic] / found[lang, toxic]
        order = sorted(weight, reverse=True)
        miss, hit = np.cumsum([weight[k] for k in order], axis=0).T
        k = int((2 * hit / (hit + miss + hit[-1])).argmax())
        below = order[k + 1] if k + 1 < len(order) else FLOOR * BINS
        return float(1 / (1 + np.exp(-((order[k] + below + 1) / 2) / BINS)))  # between the two bins

    out = {None: best(bins) if any(toxic for _, toxic, _, _ in bins) else CUT}
    for name in {x for x, _ in found if x is not None}:
        if min(found.get((name, 0), 0), found.get((name, 1), 0)) >= least:
            out[name] = best([b for b in bins if b[0] == name])
    return out


def rates(sizes: dict, per_class: int) -> dict:
    """The share to draw of each (lang, toxic): ``per_class`` rows a class, spread evenly as far as the rows go."""
    out = {}
    for toxic in (0, 1):
        left, own = float(per_class), sorted((n, str(lang), lang) for (lang, t), n in sizes.items() if t == toxic and n)
        for j, (n, _, lang) in enumerate(own):
            take = min(MOST * n, left / (len(own) - j))
            out[lang, toxic] = take / n
            left -= take
    return out


def binned(docs: DataFrame, model: Cnn) -> DataFrame:
    """doc_id, lang and the bin of the log odds of every row."""
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offs in blocks(batch, 2):
                at = np.floor(shared.value.odds(*word_ids(raw, offs)) * BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(at)], ["doc_id", "lang", "bin"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "lang", "text").mapInArrow(released(run, forget_powers), f"doc_id {kind}, lang string, bin int")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Cnn | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that ``labels`` (doc_id, toxic) marks."""
    spark = docs.sparkSession
    ids = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    short = F.coalesce(F.char_length("text") <= max_chars, F.lit(False)).alias("short")
    labelled = docs.select("doc_id", "lang", short).join(ids, "doc_id")
    groups = labelled.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.count_if("short").alias("short")).collect()  # two a language
    sizes = {(r.lang, r.toxic): r.n for r in groups}
    total = [sum(n for (_, t), n in sizes.items() if t == k) for k in (0, 1)]
    if not total[0] or not total[1]:
        return None
    draw = F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    rate = rates({(r.lang, r.toxic): r.short for r in groups}, per_class)
    rate = spark.createDataFrame([(lang, t, x) for (lang, t), x in rate.items()], "of string, class int, rate double")
    chosen = labelled.filter("short").join(F.broadcast(rate), F.col("lang").eqNullSafe(F.col("of")) & (F.col("toxic") == F.col("class")))
    chosen = stored(chosen.filter(draw < F.col("rate")).select("doc_id", "toxic").distinct(), "toxicity-sample")
    rows = (
        docs.filter(F.char_length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    )
    y = rows["toxic"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    pieces = [word_ids(raw, offs) for b in rows.select(["text"]).to_batches() for _, raw, offs in blocks(b, 0)]
    del rows
    at = np.cumsum([0] + [len(i) for i, _ in pieces])
    words = np.concatenate([i for i, _ in pieces])
    edges = np.concatenate([[0]] + [e[1:] + a for (_, e), a in zip(pieces, at, strict=False)]).astype(np.int64)
    del pieces
    model = train(words, edges, y, total[1] / sum(total))
    del words, edges
    forget_powers()
    release()
    seen = stored(
        binned(docs, model).join(ids, "doc_id").join(F.broadcast(chosen.select("doc_id", F.lit(True).alias("trained"))), "doc_id", "left")
        .groupBy("lang", "toxic", "bin", F.col("trained").isNotNull().alias("trained")).count(), "toxicity-bins",
    ).collect()  # a row for each bin of a language at most
    other = [(r.lang, r.toxic, r.bin, r["count"]) for r in seen if not r.trained]
    if not any(toxic for _, toxic, _, _ in other):  # too few rows to keep any back
        other = [(r.lang, r.toxic, r.bin, r["count"]) for r in seen]
    model.thresholds = calibrate(other, sizes)
    return model


def score(docs: DataFrame, model: Cnn | None, text_col: str = "text", only: list[str] | None = None, keep_below: bool = False) -> DataFrame:
    """The columns ``only`` (all by default) with ``score`` and ``toxic``, the decision by the language's threshold.

    ``keep_below``: instead, the rows that are not toxic, with the columns they came with."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("score", "toxic")] if only is None else only
    own = docs.columns if keep_below else own
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    shown = docs.select(*own, F.col(text_col).alias("_text"), lang.alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn = shared.value
        for batch in batches:
            for rows, raw, offs in blocks(batch, len(own)):
                if cnn is None:
                    got = np.zeros(rows.num_rows)
                    limit = np.ones(rows.num_rows)
                else:
                    got = cnn.scores(*word_ids(raw, offs)).astype(float)
                    limit = np.array([cnn.thresholds.get(x, cnn.thresholds[None]) for x in rows.column(len(own) + 1).to_pylist()])
                part = pa.RecordBatch.from_arrays([rows.column(k) for k in range(len(own))], own)
                if keep_below:
                    yield part.filter(pa.array(got < limit))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got), pa.array(got >= limit)], [*own, "score", "toxic"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    return shown.mapInArrow(released(run, forget_powers), fields if keep_below else f"{fields}, score double, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    held = fold(F.col("doc_id"), 4) == 2
    model = fit(docs.filter(~held), labels.filter(~held))
    out = score(docs.select("doc_id", "text", "lang", held.alias("held_out")), model, only=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "toxic")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, as they came."""
    return score(docs, fit(docs, labels), keep_below=True)
