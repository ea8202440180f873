"""Operator 1, language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word in a language is the sum, over all ways to cut it
into pieces, of the product of the pieces' probabilities; the forward algorithm
gives that sum in one pass over the word's characters. A text's score in a
language is the sum of its words' logarithms, and the language with the
largest score is the prediction.

The piece probabilities are fitted by expectation-maximisation. The E-step is
a Spark job: tasks run the forward-backward algorithm over their distinct
words and return expected piece counts, which are summed by (language, piece).
The fit reads a sample of at most about ``rows_per_lang`` labelled rows of each language
(rows whose hashed id and text are below the needed share, rows that repeat both once); prediction reads every whole text.

Words of any length are walked whole, with the lattice of a bounded window in memory.

Words are runs of other characters than ``[\\x20\\x09-\\x0D]`` in lower case, led by a mark
of the word's start. Characters that no piece has count as a piece of their own.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with nothing to
learn from, every text is ``und``; ties go to the language first in
alphabetical order; null languages are not learned; a null id counts as empty
text in the fold; repeated rows give a row each; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwise.llm.common import fold, ship_code
from trackwise.llm.textbatch import mix

LETTER = regex.compile(r"\p{L}")
MARK = "▁"
ROWS_PER_LANG = 2000
ROUNDS = 3
SMOOTHING = 0.05
WORD_BLOCK = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def sentencepiece_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file, lower-cased, in a fixed order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    pieces = (model.id_to_piece(i) for i in keep)
    return sorted({p.lower() for p in pieces if p.strip(MARK) and MARK not in p[1:]})


class PieceIndex:
    """Pieces by the hash of their characters; every character also is a piece (``other`` if unknown)."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.other = len(pieces)
        self.longest = max(map(len, pieces))
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        bits = int(len(pieces) * 8).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        for i, k in enumerate(keys.tolist()):
            at = k >> int(self.shift)
            while self.ids[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.ids[at] = k, i

    @staticmethod
    def _hash(piece: str) -> int:
        points = np.array([[ord(c) for c in piece]], np.uint32)
        return int(PieceIndex.rolled(points, [len(piece)])[0][0, 0])

    @staticmethod
    def rolled(points: np.ndarray, widths: list[int]) -> list[np.ndarray]:
        """For each width, the hashes of all slices of that width of each row."""
        n, length = points.shape
        out, h = [], np.zeros((n, length), np.uint64)
        coded = mix(points.astype(np.uint64) + np.uint64(1))
        for w in range(1, max(widths) + 1):
            h = h[:, : length - w + 1] * _BASE + coded[:, w - 1 :]
            if w in widths:
                out.append(mix(h))
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where no piece has the hash."""
        at = (hashes >> self.shift).astype(np.int32)
        own, out = self.keys[at] == hashes, self.ids[at]
        more = np.flatnonzero((~own & (out >= 0)).ravel())  # another piece sits there: look further
        out[~own] = -1
        flat, want, slot = out.reshape(-1), hashes.ravel()[more], at.ravel()[more]
        while len(more):
            slot = (slot + 1) & self.mask
            ids = self.ids[slot]
            hit = self.keys[slot] == want
            flat[more[hit]] = ids[hit]
            go = ~hit & (ids >= 0)
            more, want, slot = more[go], want[go], slot[go]
        return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of equally long words: (indices, code points)."""
    if not words:
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    values, first = np.unique(lengths[order], return_index=True)
    for n, a, b in zip(values.tolist(), first, [*first[1:], len(order)], strict=True):
        step = max(1, 2_000_000 // max(n, 1) // 8)
        for k in range(a, b, step):
            rows = order[k : min(k + step, b)]
            text = "".join([words[i] for i in rows.tolist()])
            yield rows, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(rows), n)


#: Positions whose lattice is held at once: a longer word is walked window by window.
WINDOW = 2000


def lattice(points: np.ndarray, index: PieceIndex) -> list[tuple[int, np.ndarray]]:
    """(width, piece ids of all slices of that width; -1 where there is none)."""
    widths = list(range(1, min(points.shape[1], index.longest) + 1))
    out = []
    for w, hashes in zip(widths, index.rolled(points, widths), strict=True):
        ids = index.find(hashes)
        if w == 1:
            ids[ids < 0] = index.other
        if w == 1 or (ids >= 0).any():
            out.append((w, ids))
    return out


#: Up to this length a product of the smallest probabilities stays far from the end of doubles.
UNSCALED = 32


def forward(points: np.ndarray, index: PieceIndex, table: np.ndarray) -> np.ndarray:
    """log P(word) for each word and language. ``table``: pieces × languages, a row of zeros last.

    In longer words the sums are scaled at each position, so that they do not underflow. A word of any length is walked
    whole: its lattice is made for ``WINDOW`` positions at a time, and the last sums go on into the next window."""
    n, length = points.shape
    langs = table.shape[1]
    alpha = {0: np.ones((n, langs))}
    total = np.zeros((n, langs))
    for start in range(0, length, WINDOW):
        stop, back = min(start + WINDOW, length), max(0, start - index.longest)  # pieces may begin in the window before
        cells = lattice(points[:, back:stop], index)
        reach = max(w for w, _ in cells) if length <= WINDOW else index.longest
        for i in range(start + 1, stop + 1):
            now = np.zeros((n, langs))
            for w, ids in cells:
                if w == 1:
                    now += alpha[i - 1] * table[ids[:, i - 1 - back]]
                elif w <= i - back:
                    some = np.flatnonzero(ids[:, i - w - back] >= 0)
                    if len(some):
                        now[some] += alpha[i - w][some] * table[ids[some, i - w - back]]
            if length > UNSCALED:
                total += np.log(now)
                for k in range(max(0, i - reach + 1), i):
                    alpha[k] = alpha[k] / now
                now = np.ones((n, langs))
            alpha[i] = now
            alpha.pop(i - reach, None)
    return total + np.log(alpha[length])


def expected(points: np.ndarray, weight: np.ndarray, index: PieceIndex, table: np.ndarray) -> np.ndarray:
    """Expected piece counts of the words in one language; ``table``: one column."""
    n, length = points.shape
    p = table[:, 0]
    alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
    scale = np.ones((length + 1, n))
    alpha[0] = 1
    for start in range(0, length, WINDOW):
        stop, back = min(start + WINDOW, length), max(0, start - index.longest)
        cells = lattice(points[:, back:stop], index)
        for i in range(start + 1, stop + 1):
            for w, ids in cells:
                if w <= i - back:
                    run = scale[i - w + 1 : i].prod(axis=0)
                    alpha[i] += alpha[i - w] * p[ids[:, i - w - back]] / run
            scale[i] = alpha[i]
            alpha[i] = 1
    beta[length] = 1
    counts = np.zeros(len(p))
    for start in reversed(range(0, length, WINDOW)):
        stop = min(start + WINDOW, length)
        cells = lattice(points[:, start : stop + index.longest], index)  # pieces may end in the window behind
        for i in range(stop - 1, start - 1, -1):
            for w, ids in cells:
                if i + w <= length and i - start < ids.shape[1]:
                    run = scale[i + 1 : i + w + 1].prod(axis=0)
                    share = p[ids[:, i - start]] * beta[i + w] / run
                    beta[i] += share
                    counts += np.bincount(ids[:, i - start] % len(p), weight * share * alpha[i], len(p))
    return counts


def split(text: str) -> list[str]:
    text = text.lower()
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


class LanguageModel:
    def __init__(self, langs: list[str], pieces: list[str], table: np.ndarray):
        self.langs, self.index, self.table = langs, PieceIndex(pieces), table
        self.memo: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)))

    def words(self, words: list[str]) -> np.ndarray:
        """log P of each distinct word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        for rows, points in by_length([MARK + w for w in words]):
            out[rows] = forward(points, self.index, self.table)
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Predicted language and its share of the likelihood."""
        cut = [split(t) if t and LETTER.search(t) else [] for t in texts]
        if len(self.memo) > WORD_BLOCK:
            self.memo, self.scores = {}, self.scores[:0]
        new = list(set().union(*cut).difference(self.memo))
        if new:
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.words(new)])
        names, shares = [], []
        for words in cut:
            if not words or not self.langs:
                names.append("und"), shares.append(0.0)
                continue
            at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
            total = self.scores[at].sum(axis=0)
            best = int(total.argmax())
            names.append(self.langs[best])
            shares.append(float(1 / np.exp(total - total[best]).sum()))
        return names, shares


def sampled(train: DataFrame, rows_per_lang: int) -> DataFrame:
    """lang, text of about ``rows_per_lang`` rows of each language at most. Rows are drawn by id and text, so that those without
    an id are drawn one by one; rows that repeat both count once."""
    train = train.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = train.groupBy("lang").count()  # a row a language
    hashed = F.xxhash64(F.col("doc_id").cast("string"), "text").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    drawn = train.join(F.broadcast(sizes), "lang").filter(hashed * F.col("count") < rows_per_lang)
    return drawn.select("doc_id", "lang", "text").distinct().select("lang", "text")


def fit(train: DataFrame, pieces: list[str], rows_per_lang: int = ROWS_PER_LANG, rounds: int = ROUNDS) -> LanguageModel:
    """``train``: doc_id, text, lang. The sample holds about ``rows_per_lang`` rows a language."""
    spark = train.sparkSession
    ship_code(spark)
    sample = sampled(train, rows_per_lang)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(split(text))
            for lang, c in counts.items():
                if c:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"]
                    )

    words = sample.mapInArrow(count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).cache()
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    index = PieceIndex(pieces) if langs else None
    size = len(pieces) + 1
    table = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast((langs, pieces, table))

        def e_step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            langs, pieces, table = shared.value
            index, sums = PieceIndex(pieces), np.zeros((len(pieces) + 1, len(langs)))
            for batch in batches:
                for k, lang in enumerate(langs):
                    own = batch[batch["lang"] == lang]
                    weight = own["n"].to_numpy(float)
                    column = np.append(table[:, k], 0.0)[:, None]
                    for rows, points in by_length([MARK + w for w in own["word"]]):
                        sums[:, k] += expected(points, weight[rows], index, column)[: len(sums)]
            at, k = np.nonzero(sums)
            yield pd.DataFrame({"k": k.astype("int32"), "piece": at.astype("int32"), "n": sums[at, k]})

        got = words.mapInPandas(e_step, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((size, len(langs)))
        counts[got["piece"], got["k"]] = got["n"]
        table = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0)
    words.unpersist()
    return LanguageModel(langs, pieces, np.vstack([table, np.zeros((1, len(langs)))]) if langs else np.zeros((size + 1, 0)))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``doc_id, held_out, text``."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.index.pieces, model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trackwise.llm.byte_bpe import blocks

        own = LanguageModel(*shared.value)
        for batch in batches:
            for a, b in blocks(batch.column(2)):
                names, shares = own.texts(batch.column(2).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(names, pa.string()), pa.array(shares, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, pieces: list[str], rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """The contract's row for each document."""
    docs = docs.select("doc_id", "text", "lang", (fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    return predict(docs, fit(docs.filter("NOT held_out"), pieces, rows_per_lang))
